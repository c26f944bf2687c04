"""Every query with SQL against DuckDB, and every other for its rows, over the smallest tables."""

from __future__ import annotations

import collections
import difflib
import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry_point
from fathomline.operators import codegraph
from fathomline.plans import queries


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for path in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def counted(frame):
    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        if str(frame[c].dtype).startswith("float"):
            frame[c] = frame[c].round(6)
    return collections.Counter(map(tuple, frame.astype(str).values.tolist()))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, duck, small, name):
    got, want = queries.QUERIES[name](spark, small).toPandas(), duck.execute(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert counted(got) == counted(want)


def test_queries_without_sql(spark, small):
    """Each by rules of its own."""
    assert set(queries.QUERIES) - set(queries.ORACLE_SQL) == {"near_terms", "search_hits", "search_code", "source_skeletons"}
    near = queries.near_terms(spark, small).collect()
    assert {("glosary", "glossary")} <= {(r["term"], r["near"]) for r in near}
    assert all(r["ratio"] >= 0.8 and r["ratio"] == pytest.approx(difflib.SequenceMatcher(None, r["near"], r["term"]).ratio()) and r["n"] <= 3 for r in near)
    texts = {r["path"]: r["text"] for r in queries.notes(spark, small).collect()}
    hits = queries.search_hits(spark, small).collect()
    assert 0 < len(hits) <= 8 and all(r["window"] in texts[r["key"]] for r in hits)
    assert all(r["window"].split("\n")[0] in texts[r["key"]].split("\n")[r["line"] - 1] for r in hits)
    assert all(set(r["matched_terms"].split()) <= {"open", "question", "glossary", "rough", "draft"} and 0 < r["coverage"] <= 1 for r in hits)
    files = {r["path"]: r["text"].replace("\r\n", "\n").split("\n") for r in queries.sources(spark, small).collect()}
    for r in queries.search_code(spark, small).collect():
        part = "\n".join(files[r["key"]][r["first_line"] - 1 : r["last_line"]])
        assert any(w in part.lower() for w in ("load", "posting", "manifest")) and (not r["section"] or r["section"].rpartition(".")[2] in part)
    found = {r["path"]: r for r in queries.source_skeletons(spark, small).collect()}
    assert set(found) == {p for p, t in files.items() if p.rpartition(".")[2] in codegraph.LANGUAGES}
    assert sum(r["symbols"] for r in found.values()) > len(found)


def test_entry(spark):
    rows = entry_point.entry(spark).collect()
    assert rows and set(entry_point.oracle_sql()) <= set(entry_point.queries())
