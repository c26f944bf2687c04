"""Two writers and a reader at once: nothing is lost, nothing half is read."""

from __future__ import annotations

import threading

import pytest

from fathomline import session
from fathomline.operators import index
from fathomline.sources.notes import Changed, Notes

SCHEMA = "key string, name string, text string, mtime double"


def together(*actions):
    out, gate = [None] * len(actions), threading.Barrier(len(actions))

    def run(i, action):
        gate.wait()
        try:
            out[i] = action()
        except Exception as error:
            out[i] = error

    threads = [threading.Thread(target=run, args=x) for x in enumerate(actions)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    return out


def test_compare_and_set_lets_one_through(spark, tmp_path):
    notes = Notes(spark, f"file://{tmp_path}/notes")
    first = notes.write("a.md", "one")
    got = together(*(lambda i=i: notes.write("a.md", f"by {i}", expect_version=first) for i in range(3)))
    assert sorted(isinstance(x, Changed) for x in got) == [False, True, True]
    winner = next(i for i, x in enumerate(got) if not isinstance(x, Changed))
    assert notes.one("a.md") == (f"by {winner}", got[winner]) and notes.snapshot() == 2
    made = together(*(lambda i=i: notes.write("new.md", str(i), create_only=True) for i in range(2)))
    assert sorted(isinstance(x, Changed) for x in made) == [False, True]


def test_writers_of_different_notes_both_count(spark, tmp_path):
    notes = Notes(spark, f"file://{tmp_path}/notes")
    got = together(*(lambda i=i: notes.write(f"{i}.md", f"text {i}") for i in range(3)))
    assert not [x for x in got if isinstance(x, Exception)]
    assert {r["path"] for r in notes.state().collect()} == {"0.md", "1.md", "2.md"} and notes.snapshot() == 3
    (tmp_path / "notes" / "log" / "000000000004").write_text("half")  # an entry that is still being written
    assert notes.snapshot() == 3


def test_two_refreshes_and_a_reader(spark, tmp_path):
    folder = f"file://{tmp_path}/index"
    base = [(f"n{i}", f"n{i}", f"alpha word{i}", 1.0) for i in range(20)]
    index.refresh(spark, folder, spark.createDataFrame(base, SCHEMA))
    later = spark.createDataFrame([*base[1:], ("n0", "n0", "changed", 2.0), ("x", "x", "extra", 1.0)], SCHEMA)
    got = together(lambda: index.refresh(spark, folder, later), lambda: index.refresh(spark, folder, later), lambda: index.load(spark, folder).postings.count())
    assert not [x for x in got if isinstance(x, Exception)] and got[0]["state"] == got[1]["state"] == "ready"
    terms = {(r["key"], r["term"]) for r in index.load(spark, folder).postings.collect()}
    assert ("n0", "changed") in terms and ("n0", "alpha") not in terms and ("x", "extra") in terms
    newest = max(p for p in (tmp_path / "index" / "manifests").iterdir() if p.suffix == ".json")
    (newest.parent / f"{int(newest.stem) + 1:012d}.json").write_text('{"version')  # a manifest that is being written
    assert index.load(spark, folder).documents == 21
    assert index.refresh(spark, folder, spark.createDataFrame(base, SCHEMA))["docs"] == 20


def test_refresh_writes_what_changed_and_merges(spark, tmp_path):
    folder, base = f"file://{tmp_path}/index", [(f"n{i}", f"n{i}", f"alpha beta word{i}", 1.0) for i in range(200)]
    index.refresh(spark, folder, spark.createDataFrame(base, SCHEMA))
    size = lambda: {p.name: sum(f.stat().st_size for f in p.rglob("*.parquet")) for p in (tmp_path / "index" / "segments").iterdir()}
    first = size()
    for i in range(3):
        base[i] = (f"n{i}", f"n{i}", f"gamma word{i}", 2.0)
    index.refresh(spark, folder, spark.createDataFrame(base, SCHEMA))
    fresh = {k: v for k, v in size().items() if k not in first}
    assert len(fresh) == 1 and spark.read.parquet(f"{folder}/segments/{next(iter(fresh))}/postings").select("key").distinct().count() == 3
    for round_ in range(index.MOST_SEGMENTS):
        base[10 + round_] = (f"n{10 + round_}", "", "delta", 3.0)
        index.refresh(spark, folder, spark.createDataFrame(base, SCHEMA))
    meta = index._manifest(spark, folder)
    assert len(meta["segments"]) < index.MOST_SEGMENTS
    built, want = index.load(spark, folder), index.build(spark.createDataFrame(base, SCHEMA))
    assert sorted(map(tuple, built.postings.collect())) == sorted(map(tuple, want.postings.collect()))
    assert (built.documents, built.average) == (want.documents, pytest.approx(want.average))


def test_a_damaged_segment_is_not_read(spark, tmp_path):
    import shutil

    folder = f"file://{tmp_path}/index"
    one = spark.createDataFrame([("a", "a", "alpha", 1.0)], SCHEMA)
    two = spark.createDataFrame([("a", "a", "alpha", 1.0), ("b", "b", "beta", 1.0)], SCHEMA)
    index.refresh(spark, folder, one)
    index.refresh(spark, folder, two)
    newest = sorted((tmp_path / "index" / "segments").iterdir())[-1]
    shutil.rmtree(newest / "postings")
    assert index.load(spark, folder).documents == 1  # the version before
    assert index.refresh(spark, folder, two)["docs"] == 2 and index.load(spark, folder).postings.count() > 1
    held = index.load(spark, folder).warm()
    assert held.postings.is_cached and held.postings.count() == index.load(spark, folder).postings.count()
    held.release()


def test_work_folder_only_off_a_cluster(monkeypatch):
    class Conf:
        def __init__(self, **values):
            self.values = values

        def get(self, name, other=None):
            return self.values.get(name, other)

        def set(self, name, value):
            self.values[name] = value

    class Cluster:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077", "getConf": staticmethod(lambda: Conf())})

    with pytest.raises(RuntimeError, match="checkpoint"):
        session.work_dir(Cluster())
    Cluster.conf = Conf(**{"spark.checkpoint.dir": "hdfs://name/shared/"})
    assert session.work_dir(Cluster()) == "hdfs://name/shared"


def test_ranks_and_release(spark):
    df = spark.range(500).selectExpr("id AS key", "CAST(id % 7 AS double) AS score")
    ranked = index.global_rank(df.repartition(5), ["score", "key"])
    got = [r["rank"] for r in ranked.orderBy("score", "key").collect()]
    assert got == list(range(1, 501))
    files, path = session.shared(spark, f"{session.work_dir(spark)}/fathomline/{session.RUN}")
    assert files.exists(path)
    session.release(spark)
    assert not files.exists(path)
