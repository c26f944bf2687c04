from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from fathomline.operators import dense, evaluate, index, search
from fathomline.operators.search import best_windows

LSM = "# Storage\n\nLog trees keep sorted runs.\n\n## 2 Compaction\n\nLeveled compaction bounds read amplification.\nWrite amplification grows.\n"
NOTE = "# Pages\n\nA B-tree updates pages in place.\n"


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame([("docs/lsm.md", "lsm", LSM, 1.0), ("notes/btree.md", "btree", NOTE, 2.0)], "key string, name string, text string, mtime double").cache()


@pytest.fixture(scope="module")
def built(corpus):
    return index.build(corpus)


def test_located_hit_with_absent_term(spark, corpus, built):
    reply = search.search(spark, built, corpus, "leveled compaction read amplification zebra")
    hit = reply.hits.first()
    assert (hit["key"], hit["section"], hit["line"]) == ("docs/lsm.md", "2 Compaction", 5)
    assert reply.signals["terms_absent"] == ["zebra"]
    assert hit["version"] and "compaction" in hit["matched_terms"]


def test_absent_terms_weigh_most(spark, corpus, built):
    hit = search.search(spark, built, corpus, "zebra giraffe okapi compaction").hits.first()
    assert hit["matched_terms"] == ["compaction"] and hit["coverage"] < 0.5


def test_near_spellings(spark, corpus, built):
    near = search.search(spark, built, corpus, "compacton 2031 qx").signals["terms_near"]
    assert near == {"compacton": ["compaction"]}


def test_scope(spark, corpus, built):
    s = search.search(spark, built, corpus, "compaction pages", folder="notes").signals
    assert s["terms_absent_in_scope"] == ["compaction"] and s["terms_absent"] == [] and s["docs_in_scope"] == 1


def test_paging_with_exclude(spark):
    docs = spark.createDataFrame([(f"s{i}.md", f"s{i}", "supplier contract terms and prices", 1.0) for i in range(6)], "key string, name string, text string, mtime double")
    own = index.build(docs)
    one = search.search(spark, own, docs, "supplier contract", k=2)
    shown = [r["key"] for r in one.hits.collect()]
    assert len(shown) == 2 and one.signals["unseen"] == 4
    two = search.search(spark, own, docs, "supplier contract", k=2, exclude=tuple(shown))
    assert two.signals["excluded"] == 2 and two.signals["unseen"] == 2
    three = search.search(spark, own, docs, "supplier contract", k=2, exclude=tuple(shown + [r["key"] for r in two.hits.collect()]))
    assert three.signals["unseen"] == 0 and three.hits.count() == 2


def test_per_doc_and_groups(spark):
    text = "\n".join(f"## Part {i}\n\nalpha beta {'gamma' if i == 3 else ''}\n" for i in range(6))
    docs = spark.createDataFrame([("a.md", "a", text, 1.0), ("b.md", "b", "gamma delta", 1.0)], "key string, name string, text string, mtime double")
    reply = search.search(spark, index.build(docs), docs, "alpha beta", k=5, per_doc=2, queries=("gamma",))
    keys = [r["key"] for r in reply.hits.collect()]
    assert keys.count("a.md") == 2 and "b.md" in keys


def test_dense_alone_finds(spark):
    docs = spark.createDataFrame([("a.md", "a", "# One\n\ncars and roads\n", 1.0), ("b.md", "b", "# Two\n\nfish\n", 1.0)], "key string, name string, text string, mtime double")
    vectors = spark.createDataFrame([("b.md", 0, 0.9), ("a.md", 0, 0.1)], "key string, off int, cos double")
    hits = search.search(spark, index.build(docs), docs, "salmon", dense=vectors).hits.collect()
    assert hits[0]["key"] == "b.md" and hits[0]["dense"] == 0.9 and hits[0]["coverage"] == 0


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "", "cat dog", 0.0), (2, "", "cat cat fish", 0.0), (3, "", "bird", 0.0)], "key int, name string, text string, mtime double")
    got = {r["key"]: r["score"] for r in search.bm25(index.build(docs), ["cat"]).collect()}
    idf, avg = math.log(1 + (3 - 2 + 0.5) / 2.5), 2.0
    for key, tf, dl in ((1, 1, 2), (2, 2, 3)):
        assert got[key] == pytest.approx(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg)))


def test_windows():
    text = "\n".join(f"line {i:03d} filler words here" for i in range(60)).replace("line 030 filler", "line 030 target")
    (off, window), = best_windows(text, "target", 200)
    assert "target" in window
    (start, snapped), = best_windows(text, "target", 200, snap=True)
    assert text[start - 1] == "\n" and "target" in snapped and start <= off
    assert best_windows("short", "x", 100) == [(0, "short")]
    assert best_windows("a" * 300, "of", 100) == [(0, "a" * 100)]
    two = best_windows(text, "target line", 100, n=2)
    assert len(two) == 2 and two[0][0] + 100 <= two[1][0]


def test_refresh_is_incremental(spark, tmp_path):
    folder = str(tmp_path / "ix")
    schema = "key string, name string, text string, mtime double"
    first = spark.createDataFrame([("n0", "n0", "alpha", 1.0), ("n1", "n1", "beta", 1.0), ("n2", "n2", None, 1.0)], schema)
    assert index.index_state(spark, folder, first)["state"] == "cold"
    assert index.refresh(spark, folder, first) == {**index.index_state(spark, folder, first), "state": "ready", "docs": 2, "pending": 0}
    assert [tuple(r) for r in index.unreadable(spark, folder).collect()] == [("n2", "failed", "no text")]
    second = spark.createDataFrame([("n0", "n0", "alpha", 1.0), ("n1", "n1", "gamma", 0.5), ("n3", "n3", "delta", 1.0)], schema)
    assert {r["key"]: r["change"] for r in index.changes(second, first).collect()} == {"n1": "changed", "n2": "gone", "n3": "new"}
    assert index.index_state(spark, folder, second)["pending"] == 3
    index.refresh(spark, folder, second)
    terms = {(r["key"], r["term"]) for r in index.load(spark, folder).postings.collect()}
    assert {("n0", "alpha"), ("n1", "gamma"), ("n3", "delta")} <= terms and ("n1", "beta") not in terms


def test_quantised_and_ranked(spark):
    v = spark.createDataFrame([("a", 0, 1.0, [3.0, 4.0]), ("b", 0, 1.0, [0.0, 0.0]), ("c", 0, 9.0, [4.0, 3.0])], "key string, off int, mtime double, v array<float>")
    rows = v.select("key", "off", "mtime", dense.quantised(F.col("v")).alias("q")).select("key", "off", "mtime", "q.codes", "q.scale")
    q = {r["key"]: (r["codes"], r["scale"]) for r in rows.collect()}
    assert q["a"][0] == [95, 127] and q["b"] == ([0, 0], 0.0)
    live = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 1.0)], "key string, mtime double")
    got = {r["key"]: r["cos"] for r in dense.rank(rows, live, [3.0, 4.0]).collect()}
    assert got["a"] == pytest.approx(1.0, abs=1e-4) and got["b"] == 0 and "c" not in got


def test_embed_refresh(spark):
    units = spark.createDataFrame([("a", 0, 1.0, "one two three"), ("b", 0, 1.0, "four five")], "key string, off int, mtime double, unit string")
    first = dense.embed(units)
    later = spark.createDataFrame([("a", 0, 1.0, "one two three"), ("b", 0, 2.0, "six")], "key string, off int, mtime double, unit string")
    assert sorted((r["key"], r["mtime"]) for r in dense.refreshed(first, later).collect()) == [("a", 1.0), ("b", 2.0)]


def test_metrics(spark):
    run = spark.createDataFrame([("q", "a", 3.0), ("q", "b", 2.0), ("q", "c", 1.0), ("r", "z", 1.0)], "qid string, did string, score double")
    judged = spark.createDataFrame([("q", "b", 1), ("q", "x", 1), ("r", "y", 1)], "qid string, did string, rel int")
    got = {r["qid"]: r for r in evaluate.metrics(run, judged).collect()}
    ideal = 1 + 1 / math.log2(3)
    assert got["q"]["ndcg"] == pytest.approx((1 / math.log2(3)) / ideal) and got["q"]["mrr"] == 0.5 and got["q"]["recall"] == 0.5
    assert tuple(got["r"])[1:] == (0, 0, 0)
    mean, low, high = evaluate.bootstrap([(0.1, 0.2), (0.3, 0.5)])
    assert low <= mean <= high and mean == pytest.approx(0.15)
