"""How distinctive a term is for a record: a two-Poisson mixture per term.

A term's occurrence counts over all records (records without it included) are taken as a mixture of two Poisson
distributions, a low rate where the term is only mentioned and a high one in the records that are about it. The
mixture is fitted by expectation-maximisation on the term's frequency histogram, which is small whatever the corpus,
and each count is scored with the posterior probability of the high-rate ("elite") component. Counts above a ceiling are
fitted as the ceiling: else one record that repeats a term sixty times takes the high rate for itself, and records with
three occurrences fall to the low one.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.session import latest, stash

RUN = regex.compile(r"[\p{L}\p{Nd}]+")
CEILING = 5.0  # with it, three occurrences in at most five records score above 0.56 whatever the other counts
MARK = regex.compile(r"\p{M}+")


def terms(text: str, shortest: int = 1) -> list[str]:
    """Runs of letters and digits of text without accents, in lower case, in order."""
    plain = MARK.sub("", unicodedata.normalize("NFD", text))
    plain = MARK.sub("", unicodedata.normalize("NFD", plain.lower()))
    return [t for t in RUN.findall(plain) if len(t) >= shortest]


def fit(index: np.ndarray, count: np.ndarray, records: np.ndarray, total: int, rounds: int = 40) -> np.ndarray:
    """Posterior probability of the elite component for each (term index, count, number of records) of a histogram.

    total is the number of all records; those without the term are the histogram's zero.
    """
    size = int(index.max()) + 1
    with_it = np.bincount(index, records, size)
    mass = np.bincount(index, records * count, size)
    zero = np.maximum(total - with_it, 0.0)
    high = mass / with_it + 0.5
    low = np.maximum(mass / max(total, 1) * 0.25, 1e-9)
    share = np.clip(with_it / max(total, 1) * 0.75, 1e-9, 0.999)

    def elite(f: np.ndarray, at: np.ndarray | slice) -> np.ndarray:
        odds = np.log(share[at]) - np.log1p(-share[at]) + f * (np.log(high[at]) - np.log(low[at])) - (high[at] - low[at])
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))

    everyone = slice(None)
    for _ in range(rounds):
        p, p0 = elite(count, index), elite(np.zeros(size), everyone)
        weight = np.bincount(index, p * records, size) + p0 * zero
        rest = np.maximum(with_it + zero - weight, 1e-9)
        inside = np.bincount(index, p * records * count, size)
        high = np.maximum(inside / np.maximum(weight, 1e-12), 1e-6)
        low = np.clip((mass - inside) / rest, 1e-9, high)
        share = np.clip(weight / np.maximum(with_it + zero, 1), 1e-12, 1 - 1e-9)
    return elite(count, index)


def _occurrences(id_col: str, text_col: str, shortest: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, found, counts = [], [], []
            for key, text in zip(batch[id_col], batch[text_col], strict=True):
                if text:
                    c = Counter(terms(text, shortest))
                    ids += [key] * len(c)
                    found += c.keys()
                    counts += c.values()
            yield pd.DataFrame({"id": ids, "term": found, "tf": np.asarray(counts, np.int64)})

    return run


def _scores(total: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            sizes = batch["histogram"].map(len).to_numpy()
            index = np.repeat(np.arange(len(batch)), sizes)
            flat = [h for hist in batch["histogram"] for h in hist]
            count, records = np.array([h["tf"] for h in flat], float), np.array([h["n"] for h in flat], float)
            yield pd.DataFrame({
                "term": batch["term"].to_numpy()[index],
                "tf": count.astype(np.int64),
                "df": np.bincount(index, records, len(batch)).astype(np.int64)[index],
                "score": fit(index, np.minimum(count, CEILING), records, total),
            })

    return run


def distinctive_terms(df: DataFrame, *, id_col: str = "id", text_col: str = "body", shortest: int = 1, least_score: float | None = None) -> DataFrame:
    """(id, term, tf, df, score): every term of every record, how often it occurs there, in how many records, and the
    posterior probability, from 0 to 1, that the record is about it.

    df has id_col and text_col, and mtime and read_at if records may be repeated; other columns are ignored. A repeated
    id is one record (the latest row). Null or empty texts have no terms but count as records; a null id is no record;
    an empty table gives no rows. Two records with the same text both count. Terms shorter than `shortest` are left out.
    With least_score only terms come out whose posterior reaches it; the counts they are scored with are of all records.
    """
    records = latest(df, id_col, text_col)
    kind = dict(records.dtypes)[id_col]
    occ = stash(records.mapInPandas(_occurrences(id_col, text_col, shortest), f"id {kind}, term string, tf long"), "distinct-occurrences")
    total = df.select(id_col).where(F.col(id_col).isNotNull()).distinct().count()
    histogram = occ.groupBy("term", "tf").agg(F.count("*").alias("n")).groupBy("term").agg(F.collect_list(F.struct("tf", "n")).alias("histogram"))
    scores = histogram.mapInPandas(_scores(total), "term string, tf long, df long, score double")
    if least_score is not None:
        scores = scores.where(F.col("score") >= least_score)
    return occ.join(scores, ["term", "tf"]).select("id", "term", "tf", "df", "score")
