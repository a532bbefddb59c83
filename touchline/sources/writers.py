"""Writers: appends and overwrites by partition, JSON lines, reports, and a ledger that replaces the old one at once."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame


def append(df: DataFrame, path: str, *partition: str) -> None:
    """Adds rows; captures of the same day lie beside each other."""
    df.write.mode("append").option("compression", "zstd").partitionBy(*partition).parquet(path)


def overwrite_partitions(df: DataFrame, path: str, *partition: str) -> None:
    """Replaces the partitions that df has rows of, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*partition).parquet(path)


def json_lines(df: DataFrame, path: str, per_file: int = 100_000) -> None:
    df.write.mode("append").option("maxRecordsPerFile", per_file).json(path)


def _files(df: DataFrame, path: str):
    jvm = df.sparkSession._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def replace_table(df: DataFrame, path: str) -> None:
    """Writes df beside path and then renames it there; df may read path.  Between two renames there is no table, and if the second one
    fails the old table is moved back."""
    fresh, old = f"{path}.{uuid.uuid4().hex}.new", f"{path}.{uuid.uuid4().hex}.old"
    df.write.json(fresh)
    files, at = _files(df, path)
    if files.exists(at(path)):
        files.rename(at(path), at(old))
    if not files.rename(at(fresh), at(path)):
        files.rename(at(old), at(path))
        raise OSError(f"could not move {fresh} to {path}")
    files.delete(at(old), True)


def report(df: DataFrame, path: str) -> dict:
    """A one-row summary as a JSON file, and as a dict."""
    row = df.limit(1).toJSON().first()
    files, at = _files(df, path)
    out = files.create(at(path), True)
    out.write(bytearray((row or "{}").encode()))
    out.close()
    return json.loads(row or "{}")
