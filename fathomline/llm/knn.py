"""The most similar vectors of every vector, by multiprobe p-stable hashing and exact reranking.

Every distinct vector ("class" of identical code rows) is put into one bucket of each of `tables` hash tables. A
table's key joins `K` coordinates floor((a.v + b) / width) with Gaussian a (2-stable). A vector looks into its own
bucket and, in each table, into the `probes` perturbed buckets that are likeliest to hold a near vector: coordinates
are sorted by their distance to the bucket's borders and perturbation sets are taken in the order of their expected
squared distance. Candidates of all tables are merged, thinned by the Hamming distance of 256 random signs (set so
that one pair in ten thousand at the lowest cosine is lost), and their cosine is then computed exactly.

A crowded bucket holds too many vectors to list its pairs. It is compared in full all the same: its vectors and those
that look into it are dealt into blocks by a salt, and each pair of blocks is one matrix product, of which the k most
similar of every vector, on either side, are kept.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomline.session import stash

SIGNS = 256
BIG = np.uint64(0x9E3779B97F4A7C15)


def perturbations(k: int, count: int) -> list[tuple[int, ...]]:
    """The `count` sets of coordinates to move, by expected squared distance; 2k sorted border distances, 1-based.

    A set never holds j and 2k+1-j, which would move one coordinate both ways.
    """
    m = 2 * k

    def mean(j: int) -> float:
        if j <= k:
            return j * (j + 1) / (4 * (k + 1) * (k + 2))
        return 1 - (m + 1 - j) / (k + 1) + (m + 1 - j) * (m + 2 - j) / (4 * (k + 1) * (k + 2))

    cost = [mean(j) for j in range(1, m + 1)]
    found: list[tuple[int, ...]] = []
    heap = [(cost[0], (1,))]
    while heap and len(found) < count:
        total, chosen = heapq.heappop(heap)
        if all(m + 1 - j not in chosen for j in chosen):
            found.append(chosen)
        last = chosen[-1]
        if last < m:
            heapq.heappush(heap, (total - cost[last - 1] + cost[last], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (total + cost[last], (*chosen, last + 1)))
    return found


class Hasher:
    """Hash tables for one vector width; the same seed gives the same tables on every worker."""

    def __init__(self, dim: int, k: int, width: float, tables: int, probes: int, seed: int) -> None:
        rng = np.random.default_rng([seed, dim])
        self.k, self.width, self.tables = k, width, tables
        self.a = rng.standard_normal((tables, dim, k)).astype(np.float32)
        self.b = rng.uniform(0, width, (tables, k)).astype(np.float32)
        self.mix = rng.integers(1, 2**62, (tables, k), dtype=np.int64)
        self.base = rng.integers(1, 2**62, tables, dtype=np.int64)
        sets = perturbations(k, probes)
        self.sets = np.zeros((2 * k, len(sets)), np.int64)
        for i, chosen in enumerate(sets):
            self.sets[[j - 1 for j in chosen], i] = 1

    def keys(self, unit: np.ndarray, probing: bool) -> np.ndarray:
        """(rows, tables) keys, or (rows, tables * (1 + probes)) with the perturbed ones."""
        out = []
        for t in range(self.tables):
            at = (unit @ self.a[t] + self.b[t]) / np.float32(self.width)
            cell = np.floor(at)
            with np.errstate(over="ignore"):
                own = (cell.astype(np.int64) * self.mix[t]).sum(1) + self.base[t]
                out.append(own[:, None])
                if probing:
                    left = at - cell
                    order = np.argsort(np.concatenate([left, 1 - left], axis=1), axis=1)
                    move = np.concatenate([-self.mix[t], self.mix[t]])[order]
                    out.append(own[:, None] + move @ self.sets)
        return np.concatenate(out, axis=1)


def signs(unit: np.ndarray, seed: int) -> np.ndarray:
    """(rows, 4) longs: on which side of 256 random hyperplanes each vector lies."""
    plane = np.random.default_rng([seed, unit.shape[1], 1]).standard_normal((unit.shape[1], SIGNS)).astype(np.float32)
    return np.packbits(unit @ plane > 0, axis=1).view(np.int64)


def matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), dim).astype(np.float32)


def _hashed(k: int, width: float, tables: int, probes: int, seed: int, probing: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, Hasher] = {}
        for batch in batches:
            dims = np.asarray(batch["dim"])
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                if dim not in known:
                    known[dim] = Hasher(int(dim), k, width, tables, probes, seed)
                unit = matrix(part["codes"], int(dim))
                unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                keys = known[dim].keys(unit, probing)
                bits = signs(unit, seed)
                offsets = pa.array(np.arange(len(keys) + 1, dtype=np.int32) * keys.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [part["cid"], pa.ListArray.from_arrays(offsets, pa.array(keys.ravel())), *(pa.array(bits[:, i].copy()) for i in range(4))],
                    names=["cid", "keys", "s0", "s1", "s2", "s3"],
                )

    return run


def _cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        dims = np.asarray(batch["dim"])
        for dim in np.unique(dims):
            part = batch.filter(pa.array(dims == dim))
            x, y = (matrix(part[c], int(dim)).astype(np.float64) for c in ("codes_a", "codes_b"))
            cos = (x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1))
            yield pa.RecordBatch.from_arrays([part["a"], part["b"], pa.array(cos)], names=["a", "b", "cos"])


def nearest(x: np.ndarray, x_ids: np.ndarray, y: np.ndarray, y_ids: np.ndarray, k: int, least: float, rows: int = 512, columns: int = 4096) -> tuple[np.ndarray, ...]:
    """(id of x, id of y, cosine): for each row of x its k most similar rows of y with another id, ties to the smaller id.

    Products of whole numbers below 2^24 are exact in single precision, so only wide vectors need double. A tile's
    approximate cosines choose what may be among the k; the cosine that decides is the one of _cosines().
    """
    kind = np.float32 if x.shape[1] * 2**14 <= 2**24 else np.float64
    xx, yy = ((m.astype(np.float64) ** 2).sum(1) for m in (x, y))
    x, y, scale = x.astype(kind), y.astype(kind), (1 / np.sqrt(yy)).astype(kind)
    slack, out = 1e-5, []
    for top in range(0, len(x), rows):
        own, own_ids, own_xx = x[top : top + rows], x_ids[top : top + rows], xx[top : top + rows]
        length, floor = np.sqrt(own_xx).astype(kind)[:, None], np.full(len(own), least)
        r, c, cos = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for left in range(0, len(y), columns):
            dots = own @ y[left : left + columns].T
            near = dots * scale[left : left + columns] / length
            hit = near >= (floor - slack)[:, None]
            many = np.flatnonzero(hit.sum(1) > 4 * (k + 1))
            if len(many):  # the row itself may be one of the k + 1
                floor[many] = np.maximum(floor[many], np.partition(near[many], -(k + 1), axis=1)[:, -(k + 1)] - slack)
                hit[many] = near[many] >= (floor[many] - slack)[:, None]
            i, j = np.nonzero(hit)
            exact = dots[i, j].astype(np.float64) / np.sqrt(own_xx[i] * yy[left + j])
            good = (exact >= least) & (own_ids[i] != y_ids[left + j])
            r, c, cos = np.concatenate([r, i[good]]), np.concatenate([c, left + j[good]]), np.concatenate([cos, exact[good]])
            order = np.lexsort((y_ids[c], -cos, r))
            r, c, cos = r[order], c[order], cos[order]
            place = np.arange(len(r)) - np.searchsorted(r, r)
            r, c, cos, place = (m[place < k] for m in (r, c, cos, place))
            last = place == k - 1
            floor[r[last]] = np.maximum(floor[r[last]], cos[last])
        out.append((own_ids[r], y_ids[c], cos))
    return tuple(np.concatenate(m) for m in zip(*out, strict=True))


def _blocks(k: int, least: float):
    def run(held: pa.Table, asking: pa.Table) -> pa.Table:
        """One block of a bucket's vectors against one of those that look into it; those of the bucket look into it too."""
        parts = []
        if held.num_rows and asking.num_rows:
            dim = held["dim"][0].as_py()
            x, y = (matrix(t["codes"].combine_chunks(), dim) for t in (asking, held))
            x_ids, y_ids, other = asking["cid"].to_numpy(), held["cid"].to_numpy(), ~asking["own"].to_numpy()
            parts.append(nearest(x, x_ids, y, y_ids, k, least))
            if other.any():
                parts.append(nearest(y, y_ids, x[other], x_ids[other], k, least))
        x, y, cos = (np.concatenate(m) for m in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"x": x, "y": y, "cos": cos})

    return run


def crowded_pairs(base: DataFrame, probe: DataFrame, crowded: DataFrame, reps: DataFrame, k: int, least: float, block: int) -> DataFrame:
    """(a, b, cos), a < b: the pairs of crowded buckets in which one is among the k most similar of the other there.

    base (key, cid) are the vectors of each bucket, probe (key, cid) those that look into it, its own among them.
    """
    held = base.join(F.broadcast(crowded), "key", "left_semi").select("key", "cid", F.lit(True).alias("own"))
    asking = probe.join(F.broadcast(crowded), "key", "left_semi").select("key", "cid", F.lit(False).alias("own"))
    looks = stash(held.unionByName(asking).groupBy("key", "cid").agg(F.max("own").alias("own")), "knn-looks")
    parts = looks.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("n_asking"), F.ceil(F.count_if("own") / block).cast("int").alias("n_held"))
    full = looks.join(F.broadcast(parts), "key").join(reps.select("cid", "dim", "codes"), "cid")
    salt = F.xxhash64("cid", F.lit("block"))

    def side(mine: str, others: str, one: str, other: str, rows: DataFrame) -> DataFrame:
        same = (F.col(c).alias(c) for c in ("key", "dim", "cid", "codes", "own"))  # new columns, or the two sides are ambiguous
        return rows.select(*same, F.pmod(salt, F.col(mine)).cast("int").alias(one), F.explode(F.sequence(F.lit(0), F.col(others) - 1)).alias(other))

    at = ("key", "dim", "i", "j")
    left, right = side("n_held", "n_asking", "j", "i", full.where("own")), side("n_asking", "n_held", "i", "j", full)
    best = left.groupBy(*at).cogroup(right.groupBy(*at)).applyInArrow(_blocks(k, least), "x long, y long, cos double").distinct()
    order = Window.partitionBy("x").orderBy(F.desc("cos"), F.asc("y"))
    best = best.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k)
    return best.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "cos")


def collision(distance: np.ndarray, width: float) -> np.ndarray:
    """Chance that one coordinate of two vectors at this distance is equal."""
    c = np.maximum(distance, 1e-9) / width
    cdf = np.vectorize(lambda x: 0.5 * math.erfc(x / math.sqrt(2)))(1 / c)
    return 1 - 2 * cdf - 2 * c / math.sqrt(2 * math.pi) * (1 - np.exp(-1 / (2 * c * c)))


def coordinates(reps: DataFrame, n: int, width: float, lookups: int, budget: float, sample: int) -> int:
    """The fewest coordinates a key that keep the expected chance candidates of a vector under `budget`.

    Only this one number comes from a bounded sample (`sample` distinct vectors); every vector is hashed.
    """
    got = reps.orderBy(F.xxhash64("cid")).limit(sample).select("dim", "codes").toPandas()
    rates, weights = [], []
    for _, group in got.groupby("dim"):
        x = np.stack(group["codes"].to_numpy()).astype(np.float32)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        cos = (x @ x.T)[np.triu_indices(len(x), 1)]
        far = cos[cos < 0.9]
        if len(far):
            rates.append(collision(np.sqrt(2 - 2 * far), width))
            weights.append((len(x) / len(got)) ** 2)
    if not rates:
        return 16
    for k in range(8, 40):
        expected = sum(w * n * lookups * float((r**k).mean()) for r, w in zip(rates, weights, strict=True))
        if expected <= budget:
            return k
    return 40


def similar_pairs(
    df: DataFrame,
    *,
    id_col: str = "row_id",
    k: int = 10,
    min_cosine: float = 0.9,
    tables: int = 7,
    probes: int = 4,
    width: float = 2.0,
    budget: float = 1500.0,
    bucket: int = 1024,
    block: int = 16384,
    sample: int = 2000,
    seed: int = 11,
) -> DataFrame:
    """(row_id_a, row_id_b, cosine), a < b: pairs of one width in which one is among the k most similar of the other.

    df has id_col, dim, codes and mtime; other columns are ignored. Rows whose id, dim or codes is null, whose codes
    are empty, all zero or not dim long take no part; a repeated id is one row (greatest mtime); an empty table gives
    no pairs. Ties in similarity go to the smaller id. Rows with identical codes are one class: its first k+1 ids
    stand for it, so that n copies give at most k*n pairs.

    The pairs of a bucket with more than `bucket` vectors are not listed: blocks of up to `block` of its vectors are
    compared in full with blocks of those that look into it. Only pairs of at least min_cosine come out.
    """
    one = F.max_by(F.struct("dim", "codes"), F.struct("mtime", "codes"))
    rows = (
        df.where(F.col(id_col).isNotNull() & (F.size("codes") == F.col("dim")) & F.exists("codes", lambda c: c != 0))
        .groupBy(F.col(id_col).alias("id"))
        .agg(one.alias("v"))
        .select("id", F.col("v.dim").cast("int").alias("dim"), "v.codes", F.xxhash64("v.dim", "v.codes").alias("c1"), F.hash("v.codes", "v.dim").alias("c2"))
    )
    rows = stash(rows, "knn-rows")
    cls = rows.groupBy("c1", "c2").agg(F.min("id").alias("cid"), F.count("*").alias("m"), F.first("dim").alias("dim"), F.first("codes").alias("codes"))
    reps = stash(cls, "knn-classes")
    n = reps.count()
    if n == 0:
        return rows.select(F.col("id").alias("row_id_a"), F.col("id").alias("row_id_b"), F.lit(0.0).alias("cosine")).limit(0)
    size = coordinates(reps, n, width, tables * (1 + probes), budget, sample)

    # 256 signs differ in a share acos(c)/pi of places; four standard deviations above that share
    share = math.acos(min_cosine) / math.pi
    most = math.ceil(SIGNS * share + 4 * math.sqrt(SIGNS * share * (1 - share)))
    fields = "cid long, keys array<long>, s0 long, s1 long, s2 long, s3 long"
    source = reps.select("cid", "dim", "codes")
    base, probe = (
        source.mapInArrow(_hashed(size, width, tables, probes, seed, probing), fields).select(F.explode("keys").alias("key"), "cid", "s0", "s1", "s2", "s3")
        for probing in (False, True)
    )
    crowded = stash(base.groupBy("key").count().where(F.col("count") > bucket).select("key"), "knn-crowded")
    dense = None
    if not crowded.isEmpty():
        dense = crowded_pairs(base, probe, crowded, reps, k, min_cosine, block)
        base = base.join(F.broadcast(crowded), "key", "left_anti")
    b, p = base.alias("b"), probe.alias("p")
    apart = sum((F.bit_count(F.col(f"b.s{i}").bitwiseXOR(F.col(f"p.s{i}"))) for i in range(1, 4)), F.bit_count(F.col("b.s0").bitwiseXOR(F.col("p.s0"))))
    near = b.join(p, (F.col("b.key") == F.col("p.key")) & (F.col("b.cid") != F.col("p.cid")) & (apart <= most))
    found = near.select(F.least("b.cid", "p.cid").alias("a"), F.greatest("b.cid", "p.cid").alias("b")).distinct()
    left = reps.select(F.col("cid").alias("a"), "dim", F.col("codes").alias("codes_a"))
    right = reps.select(F.col("cid").alias("b"), F.col("dim").alias("dim_b"), F.col("codes").alias("codes_b"))
    pairs = found.join(left, "a").join(right, "b").where("dim = dim_b").select("a", "b", "dim", "codes_a", "codes_b")
    pairs = pairs.mapInArrow(_cosines, "a long, b long, cos double").where(F.col("cos") >= min_cosine)
    if dense is not None:
        pairs = pairs.unionByName(dense).groupBy("a", "b").agg(F.max("cos").alias("cos"))
    pairs = stash(pairs, "knn-pairs")

    # the first k+1 ids of each class with copies; the group limit runs before the shuffle
    member = rows.join(reps.where("m > 1").select("c1", "c2", "cid"), ["c1", "c2"]).select("cid", "id")
    first = member.withColumn("rn", F.row_number().over(Window.partitionBy("cid").orderBy("id"))).where(F.col("rn") <= k + 1)
    heads = stash(first.groupBy("cid").agg(F.sort_array(F.collect_list("id")).alias("ids")), "knn-heads")
    copies = member.join(heads, "cid").select("id", F.explode(F.slice(F.array_remove("ids", F.col("id")), 1, k)).alias("other"), F.lit(1.0).alias("cosine"))

    info = reps.select("cid", "m").join(heads, "cid", "left").select("cid", "m", F.coalesce("ids", F.array("cid")).alias("ids"))
    both = pairs.select(F.col("a").alias("x"), F.col("b").alias("y"), "cos").unionByName(pairs.select(F.col("b").alias("x"), F.col("a").alias("y"), "cos"))
    both = both.join(info.select(F.col("cid").alias("y"), "m", F.col("ids").alias("ids_y")), "y")
    order = Window.partitionBy("x").orderBy(F.desc("cos"), F.asc("y"))
    before = F.coalesce(F.sum(F.least("m", F.lit(k))).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = both.withColumn("before", before).where(F.col("before") < k)
    ranked = ranked.join(info.select(F.col("cid").alias("x"), F.col("m").alias("m_x"), F.col("ids").alias("ids_x")), "x")
    free = F.lit(k) - (F.col("m_x") - 1) - F.col("before")
    across = (
        ranked.where(free > 0)
        .select(F.explode("ids_x").alias("id"), F.slice("ids_y", F.lit(1), F.greatest(free, F.lit(0)).cast("int")).alias("others"), "cos")
        .select("id", F.explode("others").alias("other"), F.col("cos").alias("cosine"))
    )
    ends = copies.unionByName(across).select(F.least("id", "other").alias("row_id_a"), F.greatest("id", "other").alias("row_id_b"), "cosine")
    return ends.groupBy("row_id_a", "row_id_b").agg(F.max("cosine").alias("cosine"))
