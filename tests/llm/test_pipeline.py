"""The pipeline stage by stage against plain versions of what each decides."""

import random

import pytest

import corpus_pipeline as cp
from tests.llm.test_operators import brute_components, edited, prose, shingle_sets


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    bench = [(0, prose(900, 30)), (1, prose(901, 25))]
    r = random.Random(0)
    docs = []
    for i in range(160):
        text = prose(i, 120)
        if i % 20 == 1:
            text = edited(prose(i - 1, 120), i, 1)
        if i % 20 == 2:
            text = text + " " + bench[i // 20 % 2][1]
        docs.append((i, f"site menu {i % 2}\n{text}", "en", f"src{i % 2}", len(text)))
    docs += [(500, "123 456", "en", "src0", 7), (501, None, "en", "src0", 0), (None, prose(7777, 80), "en", "src1", 1)]
    r.shuffle(docs)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    kept = cp.language(spark, docs, folder)
    ids = lambda df: sorted(x.doc_id if x.doc_id is not None else -1 for x in df.select("doc_id").collect())
    assert kept.columns == columns and ids(kept) == [-1, *range(160)]
    cut = cp.lines(spark, kept, folder)
    assert cut.columns == columns and cut.schema == docs.schema
    texts = {x.doc_id: x for x in cut.collect()}
    assert texts[0].text == prose(0, 120) and texts[0].n_chars == len(texts[0].text)
    one = cp.near_duplicates(spark, cut, folder)
    rows = [(i, x.text) for i, x in texts.items() if i is not None]
    groups = brute_components(shingle_sets(rows, 5), 80, 100)
    assert one.columns == columns and ids(one) == [-1, *sorted({i for i in groups if groups[i] == i})]
    clean = cp.decontamination(spark, one, folder)
    assert ids(clean) == [i for i in ids(one) if i % 20 != 2 or i < 0]
    packed = cp.packing(spark, clean, folder)
    assert sorted({x.doc_id if x.doc_id is not None else -1 for x in packed.collect()}) == ids(clean)
    whole = cp.run(spark, folder)
    assert sorted(map(tuple, whole.select("doc_id", "piece", "length", "ids_crc32").fillna(-1, ["doc_id"]).collect())) == sorted(map(tuple, packed.select("doc_id", "piece", "length", "ids_crc32").fillna(-1, ["doc_id"]).collect()))


def test_lines_go_from_pages_of_much_furniture(spark, folder):
    menu = "\n".join(f"menu {prose(i, 30)}" for i in range(3))
    rows = [(i, f"{menu}\n{prose(50 + i, 20)}", "en", "h", 1) for i in range(10)] + [(20 + i, menu, "en", "h", 1) for i in range(2)] + [(30, None, "en", "h", 0), (31, "", "en", "h", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {x.doc_id: x.text for x in cp.lines(spark, docs, folder).collect()}
    assert got == {**{i: prose(50 + i, 20) for i in range(10)}, 20: menu, 21: menu, 30: None, 31: ""}


def test_empty(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, docs, folder).count() == 0
    assert len(cp.STAGES) == 5
