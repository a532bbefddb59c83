"""Landed files by name of their source, and tables that follow them.

register() makes `landed_matches` (a season's CSV of each league, <path>/<2425>/<E0>.csv) and `landed_feed` (JSON documents of a capture, <path>/<captured>/<league>.json)
known to spark.read.format().  A file is a partition; conditions on league and season (or captured) that say which values are wanted leave out whole
files before any is opened.  Files are reached through pyarrow.fs, so the path may be any that it knows; driver and executors must share it.

refresh() keeps a table up to date with its landing folder: a manifest holds when each file was last changed, and only partitions with a new or changed file
are read again and overwritten."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from touchline.session import kept
from touchline.sources.readers import BOOKS_1X2, BOOKS_HANDICAP, BOOKS_TOTAL, MATCH_COUNTS

MATCH_COLUMNS = ["Date", "Time", "HomeTeam", "AwayTeam", "FTR", "Referee", *MATCH_COUNTS]
MATCH_COLUMNS += [f"{p}{s}" for p, _ in BOOKS_1X2 for s in "HDA"] + [f"{p}{s}" for p, _ in BOOKS_TOTAL for s in (">2.5", "<2.5")] + ["AHCh"] + [f"{p}{s}" for p, _ in BOOKS_HANDICAP for s in ("AHH", "AHA")]
#: Two digits of a year from which it is of the last century.
CENTURY = 70


def season_of(folder: str) -> str | None:
    """2425 to 2024-25, 9900 to 1999-00; None for other names."""
    if not re.fullmatch(r"\d{4}", folder):
        return None
    first = int(folder[:2])
    return f"{1900 + first if first >= CENTURY else 2000 + first}-{folder[2:]}"


@dataclass
class File(InputPartition):
    path: str
    league: str
    folder: str


class _Reader(DataSourceReader):
    """Files below the path, less those that conditions on the two columns of the path rule out."""

    def __init__(self, source: _Landed, schema):
        self.path, self.names, self.suffix, self.batch, self.outer, self.folder_of = source.options["path"], schema.names, source.suffix, source.batch, source.outer, source.folder_of
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In)) else None
            if column in ("league", self.outer):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[column] = self.wanted.get(column, values) & values
            else:
                yield f

    def partitions(self) -> list[File]:
        system, root = pa.fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (pa.fs.LocalFileSystem(), self.path)
        found = []
        for info in system.get_file_info(pa.fs.FileSelector(root.rstrip("/"), recursive=True)):
            parts = info.path[len(root.rstrip("/")) :].strip("/").split("/")
            if info.type == pa.fs.FileType.File and len(parts) == 2 and parts[1].endswith(self.suffix):
                file = File(info.path, parts[1].removesuffix(self.suffix), self.folder_of(parts[0]))
                if file.folder is not None and all(v in self.wanted.get(c, {v}) for c, v in (("league", file.league), (self.outer, file.folder))):
                    found.append(file)
        return sorted(found, key=lambda f: f.path)

    def read(self, file: File | None) -> Iterator[pa.RecordBatch]:
        if file is None:  # no file is left
            return
        system = pa.fs.FileSystem.from_uri(self.path)[0] if "://" in self.path or self.path.startswith("file:") else pa.fs.LocalFileSystem()
        with system.open_input_stream(file.path) as stream:
            yield from self.batch(stream, file, self.names)


class _Landed(DataSource):
    suffix, outer = "", ""

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self, schema)


def csv_batch(stream, file: File, names: list[str], size: int = 5_000) -> Iterator[pa.RecordBatch]:
    """Rows of a CSV with a header as text; columns that it lacks and empty cells are null."""
    rows: list[dict] = []

    def batch() -> pa.RecordBatch:
        given = {"league": [file.league] * len(rows), "season": [file.folder] * len(rows)}
        return pa.RecordBatch.from_arrays([pa.array(given.get(n) or [r.get(n) or None for r in rows], pa.string()) for n in names], names)

    for row in csv.DictReader(io.TextIOWrapper(stream, "utf-8-sig", errors="replace", newline="")):
        rows.append(row)
        if len(rows) == size:
            yield batch()
            rows = []
    if rows:
        yield batch()


def document_batch(stream, file: File, names: list[str]) -> Iterator[pa.RecordBatch]:
    """A file as one document."""
    given = {"league": file.league, "captured": file.folder, "document": stream.read().decode("utf-8", "replace")}
    yield pa.RecordBatch.from_arrays([pa.array([given[n]], pa.string()) for n in names], names)


class LandedMatches(_Landed):
    suffix, outer = ".csv", "season"
    batch, folder_of = staticmethod(csv_batch), staticmethod(season_of)

    @classmethod
    def name(cls) -> str:
        return "landed_matches"

    def schema(self) -> str:
        return ", ".join(f"`{c}` string" for c in ("league", "season", *MATCH_COLUMNS))


class LandedFeed(_Landed):
    suffix, outer = ".json", "captured"
    batch, folder_of = staticmethod(document_batch), staticmethod(str)

    @classmethod
    def name(cls) -> str:
        return "landed_feed"

    def schema(self) -> str:
        return "league string, captured string, document string"


def register(spark: SparkSession) -> None:
    """Makes both sources known, and lets conditions reach them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LandedMatches)
    spark.dataSource.register(LandedFeed)


def landed_files(spark: SparkSession, path: str, suffix: str = ".csv") -> DataFrame:
    """path and modified of the files below a folder, without reading them."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(path)
    return found.select("path", F.col("modificationTime").alias("modified"))


def stale(files: DataFrame, manifest: DataFrame | None) -> DataFrame:
    """The files that are new, or changed since the manifest (path, modified) was written."""
    if manifest is None:
        return files
    return files.join(manifest.select("path", F.col("modified").alias("__then")), "path", "left").where("__then is null or modified > __then").drop("__then")


def refresh(spark: SparkSession, landing: str, table: str, manifest: str, rows_of: Callable[[DataFrame], DataFrame]) -> list[tuple[str, str]]:
    """Reads again what has changed in the landing folder of match CSVs, and overwrites those (season, league) partitions of the table; returns them.

    rows_of makes the table's rows, with season and league, of raw ones.  The manifest is written last, as a new version, so that a run which broke off is done again."""
    versions = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(manifest)
    there = versions.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(versions)
    known = kept(spark.read.parquet(manifest).groupBy("path").agg(F.max("modified").alias("modified"))) if there else None
    files = kept(landed_files(spark, landing))
    folder = F.regexp_extract("path", r"(\d{4})/[^/]+\.csv$", 1)
    changed = stale(files, known).select(folder.alias("folder"), F.regexp_extract("path", r"([^/]+)\.csv$", 1).alias("league")).where("folder <> ''").distinct()
    pairs = sorted((season_of(r.folder), r.league) for r in changed.collect())  # a row per changed file
    if pairs:
        register(spark)
        raw = spark.read.format("landed_matches").option("path", landing).load().where(F.col("season").isin(sorted({s for s, _ in pairs})) & F.col("league").isin(sorted({x for _, x in pairs})))
        wanted = F.array(*(F.struct(F.lit(s).alias("season"), F.lit(x).alias("league")) for s, x in pairs))
        raw = raw.where(F.array_contains(wanted, F.struct("season", "league")))
        rows_of(raw).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("season", "league").parquet(table)
    stale(files, known).write.mode("append").parquet(manifest)
    return pairs
