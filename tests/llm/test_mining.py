"""Hard negatives, fill-in-middle and URL filters against plain versions."""

import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.llm import fill_in_middle, hard_negatives, url_filter


def mined(rows, every=100, positives=5, negatives=10):
    """Every pair of rows in turn."""
    kept = []
    for i, label, vector in rows:
        if i is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        kept.append((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in vector]))
    product = lambda a, b: sum(x * y for x, y in zip(a, b))  # noqa: B905, E731
    out = []
    for i, label, v in sorted({i: (i, y, v) for i, y, v in sorted(kept, reverse=True) if i % every == 0}.values()):
        scored = sorted((-product(v, w), j, y) for j, y, w in kept if j != i)
        for s, j, _ in [x for x in scored if x[2] == label][:positives]:
            fit = [(n, m) for m, n, y in scored if y != label and 30 * -s <= 100 * -m <= 90 * -s][:negatives]
            out += [(i, j, rank, n, -s, -m) for rank, (n, m) in enumerate(fit, 1)]
    return sorted(out)


def mine(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumns({"score": F.lit(1), "rank": F.lit("x"), "slot": F.lit(None).cast("int")})
    return sorted(map(tuple, hard_negatives.hard_negatives(df, relabel=F.col("vec_id") % 7 == 0).collect()))


def test_negatives_equal_all_pairs(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    rows = []
    for i in range(1, 1501):
        x = centres[rng.integers(12)] * rng.uniform(0.2, 1.0) + rng.normal(size=16) * 0.4
        rows.append((i, int(rng.integers(10)), x.astype(np.float32).tolist()))
    assert mine(spark, rows) == mined(rows) != []


def test_negatives_of_copies_ties_and_odd_rows(spark):
    rng = np.random.default_rng(6)
    copy = [0.5, 0.25, -0.125, 0.75]
    rows = [(i, i % 3, copy if i % 3 else rng.integers(-3, 4, 4).astype(float).tolist()) for i in range(1, 700)]
    rows += [(700, 1, copy), (700, 1, copy), (800, 2, [1.0, 2.0]), (900, 3, []), (1000, 1, [0.0] * 4), (1100, 1, [-0.5, -0.25, 0.0, -0.75])]
    rows += [(None, 1, copy), (1200, None, copy), (1300, 1, None), (1400, 1, [1.0, None, 0.0, 0.0]), (1500, 1, [float("nan")] * 4), (1600, 1, [float("inf"), 0.0, 0.0, 0.0]), (705, 4, [-1.0] * 4)]
    assert mine(spark, rows) == mined(rows) != []
    assert mine(spark, []) == [] and mine(spark, [(100, 1, copy)]) == []


def test_negatives_refuse_scores_that_do_not_fit(spark):
    with pytest.raises(Exception, match="too large"):
        mine(spark, [(100, 1, [1e30, 1.0]), (1, 1, [1.0, 1.0])])


def test_best_candidates_keep_ties_by_id():
    rng = np.random.default_rng(7)
    heads = np.zeros(40, hard_negatives._REQUEST)
    heads["anchor_id"], heads["label"], heads["low"], heads["high"] = np.arange(40), rng.integers(0, 3, 40), -5, 9
    q, x = rng.integers(-2, 3, (40, 3)).astype(np.int32), rng.integers(-2, 3, (300, 3)).astype(np.int32)
    ids, labels = rng.permutation(300), rng.integers(0, 3, 300)
    for same in (True, False):
        for exact in (True, False):
            found = hard_negatives.candidates(heads, q, ids, labels, x, same, 4, exact)
            at = hard_negatives.kept(*found, 4)
            got = sorted(zip(*(c[at].tolist() for c in found), strict=True))
            want = []
            for h, v in zip(heads, q.astype(int), strict=True):
                s = sorted((-int(v @ w), int(j)) for w, j, y in zip(x.astype(int), ids, labels, strict=True) if (y == h["label"]) == same and (not same or j != h["anchor_id"]) and -5 <= v @ w <= 9)
                want += [(int(h["anchor_id"]), 0, -a, b) for a, b in s[:4]]
            assert got == sorted(want)


def test_bounds_hold_for_every_ring():
    rng = np.random.default_rng(8)
    x, q = rng.integers(-90, 90, (2000, 6)), rng.integers(-90, 90, (50, 6))
    square = float((x**2).sum(axis=1).max())
    keys = hard_negatives.Keys(x[:500], 6, 90, square)
    pivot, distance, ring = keys.of(x)
    cell = pivot * hard_negatives.RINGS + ring
    keys.directed([(c, distance[cell == c].min(), distance[cell == c].max(), int((cell == c).sum())) for c in np.unique(cell)])
    order, best, worst = keys.plan(q)
    scores = q @ x.T
    for i in range(len(q)):
        for at, c in enumerate(order[i]):
            if (cell == c).any():
                assert scores[i, cell == c].max() <= best[i, at] and scores[i, cell == c].min() >= worst[i, at]
    assert (np.diff(np.where(np.isfinite(best), best, -1e18), axis=1) <= 0).all()


def filled(doc_id, text):
    """The contract, by Python's strings."""
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    form = "plain" if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90 else "spm" if h4 % 100 < 20 else "psm"
    out = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return doc_id, n, form, *((None, None) if form == "plain" else (a, b - a)), sha(out), sha(text)


def test_fill_in_middle_equals_plain_strings(spark):
    rng = np.random.default_rng(9)
    letters = list("abc \n\r\t<>PSḾé漢😀‍  ")
    rows = [(i, "".join(rng.choice(letters, rng.integers(0, 60)))) for i in range(400)]
    rows += [(1000, None), (1001, ""), (None, "no id"), (1002, "<P>"), (1003, "a<S>b"), (1003, "a<S>b"), (1004, "😀́x\n" * 60_000), (-5, "minus"), (1005, "<S" * 500 + "<")]
    rows += [(2000 + i, "<" * (i % 4) + "P><M<S" * (i % 3)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"output": F.lit(1), "form": F.lit("x"), "n": F.lit(None).cast("int")})
    got = sorted(map(tuple, fill_in_middle.digest(df).collect()), key=str)
    assert got == sorted((filled(*r) for r in rows), key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert fill_in_middle.digest(df.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["", "a", "é😀́", "x" * 4, "y" * 131_073, "\n\r\n" * 70_000])
def test_units_are_code_points(text):
    assert fill_in_middle.unit_ends(text).tolist() == list(range(1, len(text) + 1))


def ruled(url):
    """Host, path, rule and its action, by Python's strings."""
    at = (url or "").find("://")
    rest = url[at + 3 :] if url and at >= 0 else ""
    host = re.split(r"[/?#]", rest)[0]
    path = re.split(r"[?#]", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h + p), len(h), a, h + p) for a, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fit)[2:] if fit else (None, None))


URLS = [
    None, "", "no scheme", "://", "http://", "http://com", "http://com/", "https://A.Example.COM/EN/x", "http://example.com/en/", "http://x.example.com/en/1?q#f", "http://example.com/en", "http://www.example.com/en/5",
    "http://m.www.example.com/en/", "http://awww.example.com/en/", "http://notcom/", "http://acom/", "http://x.net/es/", "http://x.net/es", "http://x.net/fr/1.html#t", "http://net/fr/", "http://NET?/fr/", "ftp://u@x.net:80/es/",
    "http://x.org#://y.com/", "http://x.com./", "http://.com/", "http://com/\n/x", "http://É.Com/é😀", "a" * 50_000 + "://b.net/fr/" + "c" * 300_000, "http://" + "a." * 5000 + "com/",
]


def test_url_rules_equal_plain_strings(spark):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(None, URLS[8]), (1, URLS[1])]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumns({"host": F.lit(1), "score": F.lit("x"), "rule": F.lit(None).cast("int")})
    got = url_filter.url_filter(df).collect()
    assert len(got) == len(rows)
    want = {(i, *ruled(u)) for i, u in rows}
    assert {(r.page_id, r.host, r.path, r.rule) for r in got} == {(i, h, p, rule) for i, h, p, _, rule in want}
    actions = {(i, rule): a for i, _, _, a, rule in want}
    for r in got:
        assert r.verdict == (actions[r.page_id, r.rule] or ("block" if r.score >= 0.5 else "allow"))
    assert url_filter.url_filter(df.limit(0)).count() == 0
    plan = url_filter.url_filter(df)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


def test_url_model_tells_held_out_hosts(spark):
    bad = ["slots-casino-bonus.example.org", "cheap-pills-shop.example.org", "xxx-adult-video.org", "free-betting.example.net", "ads-tracker.example.org"]
    good = ["thatcher.example.org", "www.gardening.example.net", "library.riverside.org", "blog.interstate.example.net", "history-museum.example.org"]
    df = spark.createDataFrame([(i, f"https://{h}{p}") for i, h in enumerate(bad + good) for p in ("/en/55", "/de/7.html", "/it/8?x=1", "")], "page_id long, url string")
    rows = url_filter.url_filter(df, rules=()).collect()
    right = sum((r.verdict == "block") == (r.page_id < len(bad)) for r in rows)
    assert all(r.rule is None for r in rows) and right >= 0.9 * len(rows)


def test_url_model_with_few_labels(spark):
    df = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    labels = lambda *x: spark.createDataFrame(list(x), "url string, label int")
    assert url_filter.url_filter(df, labels()).first().verdict == "allow"
    assert url_filter.url_filter(df, labels((None, 1), ("http://a.org/", None))).first().verdict == "allow"
    assert url_filter.url_filter(df, labels(("http://b.org/", 1))).first().verdict == "block"
    assert url_filter.url_filter(df, labels(("http://b.org/", 1), ("http://a.org/", 0))).first().score < 0.5
