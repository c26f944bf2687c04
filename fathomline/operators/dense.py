"""Vectors: int8 quantisation, exact cosine ranking in Arrow batches, a deterministic embedder, incremental upkeep."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions.text import PROFILES, stem_of
from fathomline.operators.index import sections_of

UNIT_CHARS, LEAST_TOKENS = 6000, 3


def unit_text(path: Column, title: Column, text: Column) -> Column:
    """What is embedded of a section: the file's stem, the title and the first 6,000 characters."""
    return F.concat(stem_of(path), F.lit(" › "), title, F.lit("\n"), F.substring(text, 1, UNIT_CHARS))


def normalised(vector: Column) -> Column:
    """Length one; a zero vector stays."""
    length = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(length > 0, F.transform(vector, lambda x: x / length)).otherwise(F.transform(vector, lambda x: x.cast("double")))


def quantised(vector: Column) -> Column:
    """struct<codes, scale>: the vector times 127 over its peak, rounded half to even, and one over the codes' length."""
    peak = F.array_max(F.transform(vector, lambda x: F.abs(x.cast("double"))))
    codes = F.when(peak > 0, F.transform(vector, lambda x: F.rint(x.cast("double") * 127.0 / peak).cast("tinyint"))).otherwise(F.transform(vector, lambda x: F.lit(0).cast("tinyint")))
    length = F.sqrt(F.aggregate(codes, F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double")))
    return F.struct(codes.alias("codes"), F.when(length > 0, (1 / length).cast("float")).otherwise(F.lit(0).cast("float")).alias("scale"))


def cosine(a: Column, b: Column) -> Column:
    """In the JVM, for few rows: no shared buffers, no Python."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return dot / (norm(a) * norm(b))


def scores(vectors: DataFrame, query: list[float]) -> DataFrame:
    """(key, off, cos) of every row of vectors (key, off, codes, scale) against one query vector: a matrix product a batch.

    Rows of another width, null or empty ones have no cosine and are left out.
    """
    q = np.asarray(query, np.float32)
    length = float(np.linalg.norm(q))
    q = q / length if length else q
    kinds = dict(vectors.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                m = np.stack(b["codes"].to_numpy()).astype(np.float32)
                yield pd.DataFrame({"key": b["key"], "off": b["off"], "cos": (m @ q * b["scale"].to_numpy(np.float32)).astype(np.float64)})

    own = vectors.where((F.size("codes") == len(q)) & F.col("scale").isNotNull()).select("key", "off", "codes", "scale")
    return own.mapInPandas(run, f"key {kinds['key']}, off {kinds['off']}, cos double")


def rank(vectors: DataFrame, live: DataFrame, query: list[float]) -> DataFrame:
    """(key, cos): the best section of each document; vectors of documents whose mtime has changed are ignored."""
    current = vectors.join(live.select("key", "mtime"), ["key", "mtime"], "left_semi")
    return scores(current, query).groupBy("key").agg(F.max("cos").alias("cos"))


def hashed_embedding(texts: list[str], dim: int = 64) -> np.ndarray:
    """A deterministic bag-of-words embedder: each word a signed direction, rows of length one."""
    out = np.zeros((len(texts), dim), np.float32)
    for i, t in enumerate(texts):
        for word in re.findall(r"\w+", t.lower()):
            h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
            out[i, h % dim] += 1 if h >> 63 else -1
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norms, out=out, where=norms > 0)


def section_units(corpus: DataFrame, profile: str = "full") -> DataFrame:
    """(key, off, mtime, unit) of a corpus (key, text, mtime), keys being paths: its heading sections with at least three
    tokens. A bare heading is no unit."""
    found = sections_of(corpus).where(F.size(PROFILES[profile](F.col("section"))) >= LEAST_TOKENS)
    return found.join(corpus.select("key", "mtime"), "key").select("key", "off", "mtime", unit_text(F.col("key"), F.col("title"), F.col("section")).alias("unit"))


def state(vectors: DataFrame | None, live: DataFrame) -> str:
    """off without an embedder's vectors, no_vectors if none is of a present document, stale if some document's is
    missing or old, else ready."""
    if vectors is None:
        return "off"
    have = live.select("key", "mtime").distinct().join(vectors.select("key", "mtime").distinct().withColumn("there", F.lit(1)), ["key", "mtime"], "left")
    n = have.agg(F.count("*").alias("all"), F.count("there").alias("there")).first()
    return "no_vectors" if not n["there"] else "stale" if n["there"] < n["all"] else "ready"


def embed(units: DataFrame, embedder: Callable[[list[str]], np.ndarray] = hashed_embedding, batch: int = 64) -> DataFrame:
    """(key, off, mtime, codes, scale) of units (key, off, mtime, unit), a batch at a time; section_units() leaves out those with too little text."""
    kinds = dict(units.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parts = [embedder(list(b["unit"].iloc[i : i + batch])) for i in range(0, len(b), batch)]
            yield b[["key", "off", "mtime"]].assign(v=list(np.concatenate(parts).astype(np.float32)) if parts else [])

    made = units.mapInPandas(run, f"key {kinds['key']}, off {kinds['off']}, mtime {kinds['mtime']}, v array<float>")
    return made.select("key", "off", "mtime", quantised(F.col("v")).alias("q")).select("key", "off", "mtime", "q.codes", "q.scale")


def refreshed(vectors: DataFrame, units: DataFrame, embedder: Callable[[list[str]], np.ndarray] = hashed_embedding) -> DataFrame:
    """vectors brought up to units: rows of unchanged documents stay, others are made anew, vanished ones leave."""
    stamps = units.select("key", "mtime").distinct()
    kept = vectors.join(stamps, ["key", "mtime"], "left_semi")
    return kept.unionByName(embed(units.join(vectors.select("key", "mtime").distinct(), ["key", "mtime"], "left_anti"), embedder))


def save(vectors: DataFrame, folder: str, *, model: str, prefix: str = "") -> None:
    """Write vectors with the model and prefix that made them; one Parquet commit, so a reader sees all or none."""
    vectors.withColumn("model", F.lit(model)).withColumn("prefix", F.lit(prefix)).write.mode("overwrite").parquet(folder)


def load(spark: SparkSession, folder: str, *, model: str, prefix: str = "") -> DataFrame:
    """(key, off, mtime, codes, scale) made by this model and prefix; the filter reaches the scan."""
    return spark.read.parquet(folder).where((F.col("model") == model) & (F.col("prefix") == prefix)).drop("model", "prefix")
