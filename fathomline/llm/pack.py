"""Texts of varying length packed into containers of fixed capacity, by conflict-constrained best fit.

Items are spread over shards of bounded size by the hash of their id, and each shard packs its own, the largest first.
Its open bins are kept in the order of what is left in them; an item goes to the bin with the least room that takes
it, found by successor search that moves on past bins it conflicts with. A bin carries the sources and the duplicate
clusters it holds as bitmaps: two copies of one text never share a container, nor do sources declared exclusive.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.shingle import band_keys
from fathomline.llm.tokens import VOCABULARY, encoding
from fathomline.session import stash


WORD = re.compile(r"\w+")


def best_fit(sizes: list[int], capacity: int, sources: list[int] | None = None, clusters: list[int] | None = None, banned: dict[int, int] | None = None) -> list[int]:
    """Bin of each item, from 0. sources and clusters give each item's bit sets; banned, of a source's bits, the bits of
    sources that may not be with it. Every size must be at most the capacity."""
    sources = sources or [0] * len(sizes)
    clusters = clusters or [0] * len(sizes)
    banned = banned or {}
    open_: list[tuple[int, int]] = []  # (room, bin), ascending
    holds: list[list[int]] = []
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = bisect_left(open_, (sizes[i], -1))
        while at < len(open_) and (holds[open_[at][1]][1] & clusters[i] or holds[open_[at][1]][0] & banned.get(sources[i], 0)):
            at += 1
        if at < len(open_):
            room, k = open_.pop(at)
        else:
            room, k = capacity, len(holds)
            holds.append([0, 0])
        holds[k][0] |= sources[i]
        holds[k][1] |= clusters[i]
        out[i] = k
        if room > sizes[i]:
            insort(open_, (room - sizes[i], k))
    return out


def copies(texts: list[str], bands: int, rows: int) -> list[list[int]]:
    """Keys that near-copies of each text share: its minhash bands, of a text without words its signs; of a blank one none."""
    keys = band_keys([WORD.findall(t.lower()) for t in texts], bands, rows)
    return [k or ([] if t.isspace() else [xxhash.xxh64_intdigest(" ".join(t.split())) - 2**63]) for k, t in zip(keys, texts, strict=True)]


SIZED = "doc_id long, source string, listed boolean, tokens long, bands array<long>"


def _sized(vocabulary: str, bands: int, rows: int):
    """Tokens and minhash bands of each text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(vocabulary)
        for b in batches:
            texts = b["text"].tolist()
            tokens = [len(enc.encode_ordinary(t)) for t in texts]
            yield b[["doc_id", "source", "listed"]].assign(tokens=tokens, bands=copies(texts, bands, rows))

    return run


def packed(
    documents: DataFrame, limits: DataFrame, *, listed: DataFrame | None = None, exclusive: tuple[tuple[str, str], ...] = (), per_shard: int = 20_000, vocabulary: str = VOCABULARY,
    bands: int = 14, rows: int = 3,
) -> DataFrame:
    """(item_kind, container, doc_id, part, token_start, token_end, tokens): where each text's tokens lie.

    documents has doc_id, text, source; limits item_kind, unit, max_size: each row whose unit is token is a kind of
    container. Other columns are ignored. A text is cut only if it exceeds the capacity: into full containers and a
    rest, which is packed like any other item. Null and empty texts and null ids take no container; a repeated doc_id
    is one document; without limits or documents nothing comes out. Texts whose words have shingles of five in common
    to four fifths lie in different containers, and equal texts without a word; blank texts have no copies. Pairs in `exclusive` name sources
    that are kept apart; with `listed` (source, at most 1000), so are its sources from all others, null ones included.
    """
    kinds = {r["item_kind"]: r["most"] for r in limits.where("lower(unit) = 'token' and max_size > 0").groupBy("item_kind").agg(F.min("max_size").alias("most")).collect()}
    source = F.coalesce(F.lower(F.trim("source")), F.lit(""))
    known = F.lit(True)
    if listed is not None:
        names = [r[0] for r in listed.where("source is not null").select(F.lower(F.trim("source"))).distinct().limit(1001).collect()]
        if len(names) > 1000:
            raise ValueError("more than 1000 sources")
        known = F.col("source").isin(names)
    docs = documents.where("doc_id is not null and length(text) > 0").groupBy("doc_id").agg(F.min_by(F.struct("text", source.alias("source")), F.struct("text", source)).alias("d"))
    docs = docs.select("doc_id", F.col("d.source").alias("source"), F.col("d.text").alias("text")).withColumn("listed", known)
    sized = stash(docs.mapInPandas(_sized(vocabulary, bands, rows), SIZED).where("tokens > 0"), "pack-sizes")
    schema = "item_kind string, container long, doc_id long, part int, token_start long, token_end long, tokens long"
    out = documents.sparkSession.createDataFrame([], schema)
    shards = max(1, math.ceil(sized.count() / per_shard))
    apart = [(a.strip().lower(), b.strip().lower()) for a, b in exclusive]

    def run(kind: str, capacity: int):
        def pack(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("doc_id", ignore_index=True)
            # only what occurs twice in the shard can conflict
            often = {c: 1 << i for i, c in enumerate(sorted(c for c, n in Counter(c for own in pdf["bands"] for c in own).items() if n > 1))}
            bits = {s: 4 << i for i, s in enumerate(sorted({s for pair in apart for s in pair}))}
            held = {(s, in_list): bits.get(s, 0) | (1 if in_list else 2) for s, in_list in set(zip(pdf["source"], pdf["listed"], strict=True))}
            banned = {mask: (2 if mask & 1 else 1) for mask in held.values()}
            for a, b in apart:
                for mask in banned:
                    banned[mask] |= (bits[b] if mask & bits[a] else 0) | (bits[a] if mask & bits[b] else 0)
            full, rest = [], []
            for doc, src, in_list, own, n in pdf[["doc_id", "source", "listed", "bands", "tokens"]].itertuples(index=False):
                whole = n // capacity if n > capacity else 0
                full += [(doc, p, p * capacity, (p + 1) * capacity) for p in range(whole)]
                if n > whole * capacity:
                    cluster = 0
                    for c in own:
                        cluster |= often.get(c, 0)
                    rest.append((doc, whole, whole * capacity, n, held[src, in_list], cluster))
            bins = best_fit([r[3] - r[2] for r in rest], capacity, [r[4] for r in rest], [r[5] for r in rest], banned)
            first = (max(bins) + 1) if bins else 0
            base = int(pdf["shard"].iloc[0]) << 32
            rows = [(kind, base + b, *r[:4], r[3] - r[2]) for b, r in zip(bins, rest, strict=True)]
            rows += [(kind, base + first + i, *f, capacity) for i, f in enumerate(full)]
            return pd.DataFrame(rows, columns=["item_kind", "container", "doc_id", "part", "token_start", "token_end", "tokens"])

        return pack

    spread = sized.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)))
    for kind, capacity in sorted(kinds.items()):
        out = out.unionByName(spread.groupBy("shard").applyInPandas(run(kind, capacity), schema))
    return out


def fill(containers: DataFrame, limits: DataFrame) -> DataFrame:
    """(item_kind, containers, tokens, capacity, unused_share) of a packing."""
    most = limits.where("lower(unit) = 'token'").groupBy("item_kind").agg(F.min("max_size").alias("capacity"))
    each = containers.groupBy("item_kind", "container").agg(F.sum("tokens").alias("n")).groupBy("item_kind").agg(F.count("*").alias("containers"), F.sum("n").alias("tokens"))
    return each.join(most, "item_kind").select("item_kind", "containers", "tokens", "capacity", (1 - F.col("tokens") / (F.col("containers") * F.col("capacity"))).alias("unused_share"))
