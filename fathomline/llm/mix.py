"""Records of several sources mixed so that each source has its target share of all tokens.

The shares of the tokens there are, raised to an exponent, lie between the natural mixture and the wished one: a
source's weight is its natural share to the power 1 - a times its target to the power a. The exponent is bisected to
the largest at which no source has to repeat a record more often than allowed within the wished total (or, without
targets, to the exponent of the natural shares that meets a wished entropy). The weights are then realised as whole
passes over each source and a part of one more, in the order of a permutation that is made of blocks: block totals are
summed first, so that running sums need no source in one place.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomline.llm.tokens import VOCABULARY, with_tokens
from fathomline.session import stash


class Plan(NamedTuple):
    exponent: float
    total: float
    weights: dict[str, float]


def normalised(weights: dict[str, float]) -> dict[str, float]:
    whole = sum(weights.values())
    return {k: v / whole for k, v in weights.items()} if whole else weights


def bisect(good, low: float, high: float, rounds: int = 60) -> float:
    """The largest value in [low, high] for which good holds; good must hold at low and, once false, stay false."""
    if good(high):
        return high
    for _ in range(rounds):
        middle = (low + high) / 2
        low, high = (middle, high) if good(middle) else (low, middle)
    return low


def plan(tokens: dict[str, float], targets: dict[str, float] | None = None, repeats: dict[str, int] | None = None, total: float | None = None, entropy: float | None = None) -> Plan:
    """Weights of the sources that have tokens, and the mixture's size.

    With targets: the largest exponent up to 1 that the repetition limits allow within `total`; by default the total is
    the largest at which the targets are met exactly. With an entropy (in bits): the exponent from 0 (uniform) to 1
    (natural) whose weights have it.
    """
    natural = normalised({s: float(n) for s, n in tokens.items() if n > 0})
    if not natural:
        return Plan(1.0, 0.0, {})
    most = {s: tokens[s] * (repeats or {}).get(s, 1) for s in natural}
    if entropy is not None:
        def spread(a: float) -> float:
            return -sum(w * math.log2(w) for w in normalised({s: p**a for s, p in natural.items()}).values() if w)

        a = bisect(lambda a: spread(a) >= entropy, 0.0, 1.0)
        weights = normalised({s: p**a for s, p in natural.items()})
    else:
        wished = normalised({s: (targets or natural).get(s, 0.0) for s in natural if (targets or natural).get(s, 0.0) > 0})
        if not wished:
            return Plan(1.0, 0.0, {})
        # as many tokens as the scarcest source allows at its target
        if total is None:
            return Plan(1.0, min(most[s] / w for s, w in wished.items()), wished)
        base = normalised({s: natural[s] for s in wished})

        def between(a: float) -> dict[str, float]:
            return normalised({s: base[s] ** (1 - a) * wished[s] ** a for s in wished})

        a = bisect(lambda a: all(total * w <= most[s] * (1 + 1e-12) for s, w in between(a).items()), 0.0, 1.0)
        weights = between(a)
    size = total if total is not None else min(most[s] / w for s, w in weights.items())
    return Plan(a, min(size, min(most[s] / w for s, w in weights.items())), weights)


def mixture(documents: DataFrame, source_weights: DataFrame, *, total: float | None = None, fraction: float | None = None, entropy: float | None = None, blocks: int = 4096, seed: int = 7, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, use_no, tokens, place): every use of every record; sorting by place mixes the sources evenly.

    documents has doc_id, text, source; source_weights source, target_weight, max_repeats (at most 1000 sources). Other
    columns are ignored; letter case and outer spaces of sources mean nothing. Null and empty texts, null ids, and
    records of sources that are null, not listed or have no positive target are left out. A repeated doc_id is one
    record. A listed source without records gets nothing and the others share its target; a null max_repeats is 1, of
    a source listed twice the first in order counts. A source misses its share by at most half a record.

    The size is `total` tokens, or that fraction of the tokens of the listed sources, or as much as the targets allow.
    Beyond what they allow, the weights lie between natural shares and targets, at the exponent that plan() bisects;
    with an entropy (bits), they are the natural shares at the exponent that gives it, whatever the targets.
    """
    name = F.lower(F.trim("source"))
    rows = source_weights.where("source is not null and target_weight > 0").groupBy(name.alias("source"))
    listed = {r["source"]: (r["x"]["w"], r["x"]["m"]) for r in rows.agg(F.min(F.struct(F.col("target_weight").alias("w"), F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)).alias("m"))).alias("x")).limit(1001).collect()}
    if len(listed) > 1000:
        raise ValueError("more than 1000 sources")
    docs = documents.where("doc_id is not null and text is not null").groupBy("doc_id").agg(F.min_by(F.struct("text", name.alias("source")), F.struct("text", name)).alias("d"))
    docs = docs.select("doc_id", F.col("d.source").alias("source"), F.col("d.text").alias("text")).where(F.col("source").isin(list(listed)) if listed else F.lit(False))
    order = F.xxhash64("doc_id", F.lit(seed))
    sized = with_tokens(docs, "text", vocabulary).where("tokens > 0").withColumn("h", order).withColumn("block", F.pmod("h", F.lit(blocks)))
    sized = stash(sized, "mix-sizes")
    per_block = stash(sized.groupBy("source", "block").agg(F.sum("tokens").alias("n")), "mix-blocks")
    have = {r["source"]: float(r["n"]) for r in per_block.groupBy("source").agg(F.sum("n").alias("n")).collect()}
    if total is None and fraction is not None:
        total = fraction * sum(have.values())
    p = plan(have, {s: w for s, (w, _) in listed.items()}, {s: m for s, (_, m) in listed.items()}, total, entropy)
    spark = documents.sparkSession
    wanted = spark.createDataFrame([(s, w * p.total, have[s]) for s, w in p.weights.items()], "source string, budget double, whole double")
    starts = per_block.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    inside = F.sum("tokens").over(Window.partitionBy("source", "block").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    run = sized.withColumn("inside", inside).join(starts, ["source", "block"]).join(wanted, "source").withColumn("end", F.col("before") + F.col("inside"))
    passes = F.floor(F.col("budget") / F.col("whole") + 1e-9)
    part = F.greatest(F.lit(0.0), F.col("budget") - passes * F.col("whole"))
    uses = (passes + F.when(F.col("end") - F.col("tokens") / 2 <= part, 1).otherwise(0)).cast("int")
    run = run.withColumn("uses", uses).where("uses > 0")
    out = run.select("doc_id", "source", F.explode(F.sequence(F.lit(1), F.col("uses"))).alias("use_no"), "tokens", "end", "whole", "budget")
    return out.select("doc_id", "source", "use_no", "tokens", (((F.col("use_no") - 1) * F.col("whole") + F.col("end") - F.col("tokens")) / F.col("budget")).alias("place"))


def shares(mixed: DataFrame, source_weights: DataFrame) -> DataFrame:
    """(source, target_share, reached_share, tokens, records, most_uses): what each listed source was to have and got."""
    name = F.lower(F.trim("source"))
    listed = source_weights.where("source is not null").groupBy(name.alias("source")).agg(F.min("target_weight").alias("w"))
    got = mixed.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.countDistinct("doc_id").alias("records"), F.max("use_no").alias("most_uses"))
    every = Window.partitionBy()
    both = listed.join(got, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    return both.select(
        "source", (F.col("w") / F.sum("w").over(every)).alias("target_share"), F.coalesce(F.col("tokens") / F.sum("tokens").over(every), F.lit(0.0)).alias("reached_share"),
        "tokens", F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"),
    )
