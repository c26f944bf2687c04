"""The inverted index: postings and document lengths as tables, built and kept up to date by anti-joins.

A corpus is a DataFrame (key, name, text, mtime). A document's name counts as text here, as it does not where sections
are scored. The index is a folder of segments, each written whole and never changed: `postings` (key, term, tf, seg)
sorted by term, so that a query's terms are found by row-group statistics, and `state` (key, mtime, outcome, reason,
name, dl, seg) of the documents that the segment adds, replaces or takes away. A refresh writes one segment, in
proportion to what changed; of several rows of a key the latest segment's counts. A numbered manifest names the segments
of a version; it is created exclusively, so that of two writers one has to begin again from the other's version, and a
reader takes the greatest whole one. Segments are merged into one when there are many or much of them is replaced.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions.text import PROFILES, line_at, section_title, sections
from fathomline.session import claim, names_in, read_small, shared, stash

TOKENIZER = 8  # of the token stream; an index made by another is as if it were never built


@dataclass(frozen=True)
class Index:
    postings: DataFrame
    lengths: DataFrame
    documents: int
    average: float

    def warm(self) -> Index:
        """The same index held in memory, read once now, for many questions; release() gives it back."""
        held = Index(self.postings.cache(), self.lengths.cache(), self.documents, self.average)
        held.postings.count(), held.lengths.count()
        return held

    def release(self) -> None:
        """Give back what a session-only index holds in memory."""
        self.postings.unpersist()
        self.lengths.unpersist()

    @classmethod
    def of(cls, postings: DataFrame, lengths: DataFrame) -> Index:
        row = lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avg")).first()
        return cls(postings, lengths, int(row["n"]), float(row["avg"] or 0.0))


def tokenised(corpus: DataFrame, profile: str = "full") -> DataFrame:
    """(key, term): a row for each token of name and text."""
    both = F.concat_ws("\n", F.coalesce("name", F.lit("")), F.coalesce("text", F.lit("")))
    return corpus.select("key", F.explode(PROFILES[profile](both)).alias("term"))


def postings_of(corpus: DataFrame, profile: str = "full") -> DataFrame:
    """(key, term, tf). The count combines before the shuffle."""
    return tokenised(corpus, profile).groupBy("key", "term").agg(F.count("*").alias("tf"))


def lengths_of(corpus: DataFrame, postings: DataFrame) -> DataFrame:
    """(key, name, dl): a document without terms has length 0."""
    return corpus.select("key", "name").join(postings.groupBy("key").agg(F.sum("tf").alias("dl")), "key", "left").select("key", "name", F.coalesce("dl", F.lit(0)).alias("dl"))


def build(corpus: DataFrame, profile: str = "full") -> Index:
    """An index held in the session only."""
    postings = postings_of(corpus, profile).cache()
    return Index.of(postings, lengths_of(corpus, postings).cache())


# --- persisted, incremental ---------------------------------------------------------------------------------------

MOST_SEGMENTS, MOST_REPLACED = 8, 0.3
STATE = "key {}, mtime double, outcome string, reason string, name string, dl long, seg long"


class Busy(RuntimeError):
    """Other writers kept being faster."""


def _manifest(spark: SparkSession, folder: str) -> dict:
    """The newest whole manifest of this tokeniser; its number counts on whatever made the ones before."""
    newest = 0
    for name in reversed(names_in(spark, f"{folder}/manifests")):
        if not re.fullmatch(r"\d{12}\.json", name):
            continue
        newest = newest or int(name[:12])
        try:
            meta = json.loads(read_small(spark, f"{folder}/manifests/{name}"))
        except ValueError:  # being written, or broken: the one before counts
            continue
        if meta.get("tokenizer") != TOKENIZER:
            return {"newest": newest}
        if all(_whole(spark, f"{folder}/segments/{s}") for s in meta["segments"]):
            return {**meta, "newest": newest}
    return {"newest": newest}


def _whole(spark: SparkSession, place: str) -> bool:
    """Whether a segment's tables are there; one that lost any isn't read, the version before it or a rebuild takes over."""
    return all("_SUCCESS" in names_in(spark, f"{place}/{t}") for t in ("postings", "state"))


def _tables(spark: SparkSession, folder: str, meta: dict, name: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [spark.read.parquet(f"{folder}/segments/{s}/{name}") for s in meta["segments"]])


def _state(spark: SparkSession, folder: str, meta: dict) -> DataFrame:
    """The present row of each document, those taken away left out."""
    rows = _tables(spark, folder, meta, "state")
    if len(meta["segments"]) > 1:
        kept = [c for c in rows.columns if c != "key"]
        rows = rows.groupBy("key").agg(F.max_by(F.struct(*kept), "seg").alias("r")).select("key", "r.*")
    return rows.where("outcome <> 'gone'")


def load(spark: SparkSession, folder: str) -> Index | None:
    """The current index of a folder; None if there is none or another tokeniser made it."""
    meta = _manifest(spark, folder)
    if not meta.get("segments"):
        return None
    lengths = _state(spark, folder, meta).where("outcome = 'indexed'")
    postings = _tables(spark, folder, meta, "postings")
    if len(meta["segments"]) > 1:
        postings = postings.join(lengths.select("key", "seg"), ["key", "seg"], "left_semi")
    return Index(postings.select("key", "term", "tf"), lengths.select("key", "name", "dl", "mtime"), meta["documents"], meta["average"])


def changes(live: DataFrame, state: DataFrame) -> DataFrame:
    """(key, change): new, changed (any difference of mtime), gone - one full outer join of the walk and the stamps."""
    a, b = live.select("key", F.col("mtime").alias("now")), state.select("key", F.col("mtime").alias("then"))
    kind = F.when(F.col("then").isNull(), "new").when(F.col("now").isNull(), "gone").when(F.col("now") != F.col("then"), "changed")
    return a.join(b, "key", "full_outer").select("key", kind.alias("change")).where("change is not null")


def index_state(spark: SparkSession, folder: str, live: DataFrame) -> dict:
    """state cold, stale or ready; how many documents are indexed and how many changes are pending."""
    meta = _manifest(spark, folder)
    if not meta.get("segments"):
        return {"state": "cold", "docs": 0, "built_at": None}
    pending = changes(live, _state(spark, folder, meta)).count()
    return {"state": "stale" if pending else "ready", "docs": meta["documents"], "built_at": meta["built_at"], "pending": pending}


def refresh(spark: SparkSession, folder: str, corpus: DataFrame, *, rebuild: bool = False, profile: str = "full", attempts: int = 5) -> dict:
    """Bring a folder's index up to the corpus (key, name, text, mtime) and return its state.

    Only documents whose mtime differs are tokenised and written; those that are gone are marked so. A null text is a
    document that could not be read: it is kept in the state with its outcome, and not in the postings, until its mtime
    changes. A writer that was overtaken begins again from the version that is there now, so nothing of either is lost;
    after `attempts` it raises Busy.
    """
    for _ in range(attempts):
        meta = _manifest(spark, folder)
        old = _state(spark, folder, meta) if meta.get("segments") and not rebuild else None
        fresh, gone = corpus, None
        if old is not None:
            todo = stash(changes(corpus, old), "index-changes")
            if todo.isEmpty():
                return {"state": "ready", "docs": meta["documents"], "built_at": meta["built_at"], "pending": 0}
            fresh = corpus.join(todo.where("change <> 'gone'"), "key", "left_semi")
            gone = todo.where("change = 'gone'").select("key")
        number = meta["newest"] + 1
        name = f"{number:012d}-{uuid.uuid4().hex[:8]}"
        _write_segment(spark, f"{folder}/segments/{name}", number, fresh, gone, profile)
        own = {"tokenizer": TOKENIZER, "built_at": time.time(), "segments": [*(meta["segments"] if old is not None else []), name]}
        if _publish(spark, folder, number, own):
            return index_state(spark, folder, corpus)
        files, path = shared(spark, f"{folder}/segments/{name}")
        files.delete(path, True)
    raise Busy(f"{folder} is being refreshed by others")


def upsert(spark: SparkSession, folder: str, rows: DataFrame, *, profile: str = "full", attempts: int = 5) -> int:
    """Add or replace the documents of rows (key, name, text, mtime), all others stay; returns the version's number.

    Of several rows of a key the greatest mtime counts, and a row older than what the index holds changes nothing, so a
    batch that is run again, or comes late, leaves the index as it is.
    """
    newest = rows.groupBy("key").agg(F.max_by(F.struct("name", "text", "mtime"), F.struct("mtime", "text")).alias("r")).select("key", "r.*")
    for _ in range(attempts):
        meta = _manifest(spark, folder)
        fresh = newest
        if meta.get("segments"):
            have = _state(spark, folder, meta).select("key", F.col("mtime").alias("held"))
            fresh = newest.join(have, "key", "left").where("held is null or mtime > held").drop("held")
        fresh = stash(fresh, "index-upsert")
        if meta.get("segments") and fresh.isEmpty():
            return meta["newest"]
        number = meta["newest"] + 1
        name = f"{number:012d}-{uuid.uuid4().hex[:8]}"
        _write_segment(spark, f"{folder}/segments/{name}", number, fresh, None, profile)
        if _publish(spark, folder, number, {"tokenizer": TOKENIZER, "built_at": time.time(), "segments": [*meta.get("segments", []), name]}):
            return number
        files, path = shared(spark, f"{folder}/segments/{name}")
        files.delete(path, True)
    raise Busy(f"{folder} is being written by others")


def _write_segment(spark: SparkSession, place: str, number: int, fresh: DataFrame, gone: DataFrame | None, profile: str) -> None:
    made = postings_of(fresh.where("text is not null"), profile).withColumn("seg", F.lit(number).cast("long"))
    made.repartitionByRange("term").sortWithinPartitions("term", "key").write.parquet(f"{place}/postings")
    sums = spark.read.parquet(f"{place}/postings").groupBy("key").agg(F.sum("tf").alias("dl"))
    outcome, reason = F.when(F.col("text").isNull(), "failed").otherwise("indexed"), F.when(F.col("text").isNull(), F.lit("no text"))
    rows = fresh.select("key", F.col("mtime").cast("double").alias("mtime"), outcome.alias("outcome"), reason.alias("reason"), "name")
    rows = rows.join(sums, "key", "left").withColumn("dl", F.coalesce("dl", F.lit(0)))
    if gone is not None:
        none = F.lit(None)
        rows = rows.unionByName(gone.select("key", none.cast("double").alias("mtime"), F.lit("gone").alias("outcome"), none.cast("string").alias("reason"), none.cast("string").alias("name"), F.lit(0).cast("long").alias("dl")))
    rows.withColumn("seg", F.lit(number).cast("long")).write.parquet(f"{place}/state")


def _publish(spark: SparkSession, folder: str, number: int, meta: dict) -> bool:
    """Merge the segments if there are many or half of them is out of date, count, and claim the number."""
    have = _tables(spark, folder, meta, "state").agg(F.count("*").alias("n"), F.count_distinct("key").alias("keys")).first()
    if len(meta["segments"]) > MOST_SEGMENTS or have["n"] > have["keys"] * (1 + MOST_REPLACED):
        state = _state(spark, folder, meta)
        live = state.where("outcome = 'indexed'").select("key", "seg")
        name, seg = f"{number:012d}-{uuid.uuid4().hex[:8]}", F.lit(number).cast("long")
        kept = _tables(spark, folder, meta, "postings").join(live, ["key", "seg"], "left_semi").withColumn("seg", seg)
        kept.repartitionByRange("term").sortWithinPartitions("term", "key").write.parquet(f"{folder}/segments/{name}/postings")
        state.withColumn("seg", seg).write.parquet(f"{folder}/segments/{name}/state")
        meta = {**meta, "segments": [name]}
    row = _state(spark, folder, meta).where("outcome = 'indexed'").agg(F.count("*").alias("n"), F.avg("dl").alias("avg")).first()
    meta = {**meta, "documents": int(row["n"]), "average": float(row["avg"] or 0.0)}
    return claim(spark, f"{folder}/manifests/{number:012d}.json", json.dumps(meta))


def unreadable(spark: SparkSession, folder: str) -> DataFrame:
    """(key, status, reason) of documents the index does not hold, failed ones first, then by key."""
    meta = _manifest(spark, folder)
    state = _state(spark, folder, meta) if meta.get("segments") else spark.createDataFrame([], STATE.format("string"))
    return state.where("outcome <> 'indexed'").select("key", F.col("outcome").alias("status"), "reason").orderBy(F.col("status") != "failed", "key")


# --- sections -----------------------------------------------------------------------------------------------------


def sections_of(corpus: DataFrame) -> DataFrame:
    """(key, off, section, title, line): heading sections of each text, offsets after line ends are made one newline."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), "\r\n?", "\n")
    cut = corpus.select("key", text.alias("text")).select("key", "text", F.explode(sections(F.col("text"))).alias("s"))
    return cut.select("key", F.col("s.off").alias("off"), F.col("s.section").alias("section"), section_title(F.col("s.section")).alias("title"), line_at(F.col("text"), F.col("s.off")).alias("line"))


def section_terms(found: DataFrame, profile: str = "full") -> DataFrame:
    """(key, off, term, tf, dl): terms of each section's own text and its length in tokens."""
    toks = found.select("key", "off", PROFILES[profile](F.col("section")).alias("toks"))
    each = toks.select("key", "off", F.size("toks").alias("dl"), F.explode("toks").alias("term"))
    return each.groupBy("key", "off", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def keys_with(built: Index, term: str) -> DataFrame:
    """The documents that hold a term."""
    return built.postings.where(F.col("term") == term).select("key")


def global_rank(df: DataFrame, by: list, name: str = "rank") -> DataFrame:
    """df with its rank, from 1, in a total order, without bringing the rows together.

    The rows are sorted by range over all partitions and written with their place in them, so that a lost executor can't
    change it; each partition's count (a number a partition comes to the driver) gives where the next one's ranks start.
    """
    ordered = stash(df.orderBy(*by).withColumn("_m", F.monotonically_increasing_id()), "rank")
    part = F.shiftright("_m", 33)
    counts = sorted((r[0], r[1]) for r in ordered.groupBy(part.alias("p")).count().collect())
    starts, total = [], 0
    for p, n in counts:
        starts += [F.lit(p), F.lit(total)]
        total += n
    if not starts:
        return df.withColumn(name, F.lit(0).cast("long"))
    start = F.create_map(*starts)[part]
    return ordered.withColumn(name, (F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)) + start + 1).cast("long")).drop("_m")
