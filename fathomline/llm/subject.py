"""Subject areas of documents, by propagating a few hand-given labels over a similarity graph.

Documents are similar if they share distinctive terms, so the graph is kept in its factored form, document - term -
document: each round joins the documents' present labels to their terms, sums them a term, and joins the terms back to
the documents. No pair of documents is ever written out, and a term in a third of all documents is one row after the
map-side sum. A link is verified before it carries a label: a term passes one on only if the labels of its other
documents (the document's own evidence from that term left out) agree on one subject. Terms whose documents agree on
two or three subjects are ambiguous; they strengthen a subject that others show, and start none. Trusted seeds, the
given labels that the document's other evidence doesn't contradict, are clamped in every round that votes. The last one
only gives out what each document's own evidence says: a given label alone is no row.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.langid import COMMON, FENCE
from fathomline.session import stash

TONGUES = sorted(COMMON)
# each common word's languages, as places in TONGUES
USUAL: dict[str, tuple[int, ...]] = {}
for _i, _lang in enumerate(TONGUES):
    for _word in COMMON[_lang].split():
        USUAL[_word] = (*USUAL.get(_word, ()), _i)
END = re.compile(r"(?<=[.!?…])[\"'”’»)\]]*\s+(?=\S)|\n[ \t]*\n|\n(?=[ \t]*(?:#{1,6} |[-*+>] |\d+[.)] |\^|!\[|\|))")
WORD = re.compile(r"[^\W\d_]+")
LINE = re.compile(r"^[ \t]*(?:#{1,6}[ \t].*|\^[\w-]+[ \t]*|!\[.*|\|.*|---+[ \t]*)$", re.M)


def spoken(words: list[str]) -> int:
    """The language, by its place, most of whose commonest words a sentence has; -1 where two have as many."""
    hits = [0] * len(TONGUES)
    for w in words:
        for i in USUAL.get(w, ()):
            hits[i] += 1
    most = max(hits)
    return hits.index(most) if hits.count(most) == 1 else -1


def sentences(text: str | None) -> list[list[str]]:
    """The words of each whole sentence, in lower case; headings, tables, embeds and fragments are none."""
    text = re.sub(r"\r\n?", "\n", unicodedata.normalize("NFC", text or ""))
    text = LINE.sub("\n", FENCE.sub("\n\n", text))
    out = []
    for part in END.split(text):
        words = WORD.findall(part.lower())
        if len(words) >= 4 and re.search(r"[.!?…][\"'”’»)\]*_]*\s*$", part.strip()):
            out.append(words)
    return out


def doc_terms(text: str | None) -> tuple[int, int, dict[int, list[int]]]:
    """Number of sentences, the text's language, and the sentences each term occurs in. A term is a word in a language,
    so that words that two languages share stay apart; it is the word's 60-bit hash with the language's place in the
    four lowest bits. The commonest words of a language are on no subject and no terms."""
    found: dict[int, list[int]] = {}
    parts = sentences(text)
    langs = [spoken(p) for p in parts]
    usual = max({*langs} - {-1}, key=lambda x: (langs.count(x), x), default=15)
    for i, (words, lang) in enumerate(zip(parts, langs, strict=True)):
        tongue = lang if lang >= 0 else usual
        for w in set(words):
            if len(w) > 1 and tongue not in USUAL.get(w, ()):
                found.setdefault((hashed(w) & ~15) | tongue, []).append(i)
    return len(parts), usual, found


@lru_cache(200_000)
def hashed(word: str) -> int:
    return xxhash.xxh64_intdigest(word) - 2**63


GRAPH = "doc_id long, sentences int, tongue int, terms array<long>, at array<array<int>>"


def _graph(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for key, text in zip(batch["doc_id"], batch["text"], strict=True):
            n, tongue, found = doc_terms(text)
            rows.append((key, n, tongue, list(found), list(found.values())))
        yield pd.DataFrame(rows, columns=["doc_id", "sentences", "tongue", "terms", "at"])


def _verified(sums: DataFrame, known: DataFrame, k: int, agree: float, clear: float, least: float, rare: float) -> DataFrame:
    """(term, own, shares): terms whose documents agree; own is the subject of a specific term, null for an ambiguous one.
    known (term, df, docs, covered) are the documents that hold a term, two at least, all documents in its language, and
    whether four fifths of the subjects have labelled documents in it.

    Shares are smoothed and weighed against the square root of each subject's frequency in the term's language, since
    what is known at first differs between languages. A term's subject must also be three standard deviations more
    frequent with it than in its language, so that a common subject needs more documents. Where fewer than `least`
    times four labelled documents hold it, one standard deviation and less smoothing do, if few documents of the
    language (a share of `rare` at most) hold the term at all: words that are on no subject are in more. In a language
    where subjects have no labels, their words would fall to other subjects, so there this doesn't apply.
    """
    tongue = F.col("term").bitwiseAND(F.lit(15))
    usual = sums.groupBy(tongue.alias("tongue")).agg(*[F.sum(f"w{i}").alias(f"u{i}") for i in range(k)])  # a row a language
    whole = sum((F.col(f"u{i}") for i in range(1, k)), F.col("u0"))
    usual = usual.select("tongue", *[((F.col(f"u{i}") / whole + 0.02) / (1 + 0.02 * k)).alias(f"p{i}") for i in range(k)])
    n = sum((F.col(f"w{i}") for i in range(1, k)), F.col("w0"))
    near = sums.withColumn("n", n).where(F.col("n") > 0.3).join(known, "term").withColumn("tongue", tongue).join(F.broadcast(usual), "tongue")
    seldom = F.coalesce("covered", F.lit(False)) & (F.col("n") < 4 * least) & (F.col("df") <= rare * F.col("docs"))
    near = near.withColumn("seldom", seldom).where((F.col("n") >= least) | F.col("seldom"))
    prior = F.when(F.col("seldom"), 0.5).otherwise(2.0)
    lift = [(F.col(f"w{i}") + prior * F.col(f"p{i}")) / (F.col("n") + prior) / F.sqrt(f"p{i}") for i in range(k)]
    apart = [(F.col(f"w{i}") - F.col("n") * F.col(f"p{i}")) / F.sqrt(F.col("n") * F.col(f"p{i}") * (1 - F.col(f"p{i}")) + 1e-9) for i in range(k)]
    out = near.select("term", "n", "seldom", F.array(*lift).alias("l"), F.array(*apart).alias("z"))
    out = out.withColumn("s", F.aggregate("l", F.lit(0.0), lambda a, x: a + x)).select("term", "n", "seldom", "z", F.transform("l", lambda x: x / F.col("s")).alias("shares"))
    top = F.array_max("shares")
    at = F.array_position("shares", top).cast("int")
    strong = F.filter(F.arrays_zip("shares", "z"), lambda x: (x["shares"] >= clear) & (x["z"] >= 2))
    mass = F.aggregate(strong, F.lit(0.0), lambda a, x: a + x["shares"])
    # in many documents, one subject more frequent than usual and no other is as good as a clear share
    alone = (F.size(F.filter("z", lambda z: z >= 2)) == 1) & (top >= agree * 5 / 6) & (F.element_at("z", at) >= 5) & (F.col("n") >= 8 * least)
    out = out.where(F.element_at("z", at) >= F.when(F.col("seldom"), 1).otherwise(3)).withColumn("own", F.when((top >= agree) | alone, at - 1))
    return out.where(F.col("own").isNotNull() | (F.size(strong).between(2, 3) & (mass >= 0.7) & (F.col("n") >= 4 * least)))


def _rule(scores: list[float], sentences: int, brief: int) -> list[int]:
    """The one or two subjects with most sentences; one sentence is enough only in a text of fewer than `brief`."""
    need = 2 if sentences >= brief else 1
    ranked = sorted((i for i, s in enumerate(scores) if s >= need), key=lambda i: (-scores[i], i))
    return ranked[:2]


def assign(terms: list[dict], k: int, clear: float) -> list[float]:
    """Sentences of each subject in one document, from its verified terms {own, at, shares}."""
    touched: list[set[int]] = [set() for _ in range(k)]
    for t in terms:
        if t["own"] is not None and t["own"] == t["own"]:
            touched[int(t["own"])].update(t["at"])
    started = [bool(x) for x in touched]
    open_ = [t for t in terms if t["own"] is None or t["own"] != t["own"]]
    if not any(started) and len(open_) > 1:
        # several ambiguous terms that agree on one subject only
        votes = [sum(t["shares"][i] >= clear for t in open_) for i in range(k)]
        best = max(votes)
        if best > 1 and votes.count(best) == 1:
            started[votes.index(best)] = True
    for t in open_:
        able = [i for i in range(k) if started[i] and t["shares"][i] >= clear]
        if able:
            touched[max(able, key=lambda i: (len(touched[i]), -i))].update(t["at"])
    return [float(len(x)) for x in touched]


HELD = "struct<term: long, own: int, at: array<int>, shares: array<double>>"


class Held(NamedTuple):
    """The verified terms of a batch of documents, flat: document, term, subject (-1 if ambiguous), number of sentences."""

    doc: np.ndarray
    term: np.ndarray
    own: np.ndarray
    n: np.ndarray
    s: np.ndarray  # (documents, subjects): sentences of each


def _evidence(batch: pa.RecordBatch, k: int, clear: float) -> Held:
    """Sentences of each subject in each document; documents with ambiguous terms go through assign()."""
    column = batch["terms"]
    doc = np.repeat(np.arange(len(column)), np.asarray(pc.list_value_length(column)))
    term, own, at, shares = column.flatten().flatten()
    own = np.asarray(own.fill_null(-1)).astype(np.int64)
    n = np.asarray(pc.list_value_length(at)).astype(np.int64)
    clean = own >= 0
    rows = np.repeat(np.arange(len(doc)), n)
    sentence = np.asarray(at.flatten()).astype(np.int64)
    use = clean[rows]
    longest = int(sentence.max(initial=0)) + 1
    cells = np.unique((doc[rows[use]] * k + own[rows[use]]) * longest + sentence[use]) // longest
    s = np.bincount(cells, minlength=len(column) * k).reshape(len(column), k).astype(float)
    starts = np.searchsorted(doc, np.arange(len(column) + 1))
    for d in np.unique(doc[~clean]):
        a, b = int(starts[d]), int(starts[d + 1])
        some = zip(np.asarray(term.slice(a, b - a)).tolist(), own[a:b].tolist(), at.slice(a, b - a).to_pylist(), shares.slice(a, b - a).to_pylist(), strict=True)
        # in the order of terms, whatever order they came in
        s[d] = assign([{"own": o if o >= 0 else None, "at": x, "shares": y} for _, o, x, y in sorted(some, key=lambda t: t[0])], k, clear)
    return Held(doc, np.asarray(term), own, n, s)


def _dense(rows: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))


def _scored(k: int, clear: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["sentences"], _dense(_evidence(b, k, clear).s)], names=["doc_id", "sentences", "s"])

    return run


def _votes(k: int, clear: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each document's shares of its subjects (term null), and how much less of them each of its own terms sees."""
        for b in batches:
            h = _evidence(b, k, clear)
            # clamp: a given label that the document's evidence doesn't contradict counts as two sentences more
            given = b["given"]
            label = np.zeros_like(h.s, bool)
            label[np.repeat(np.arange(len(given)), np.asarray(pc.list_value_length(given).fill_null(0))), np.asarray(given.flatten()).astype(np.int64)] = True
            s = h.s + 2.0 * (label & ((h.s > 0) | ~h.s.any(1, keepdims=True)))
            whole = s.sum(1, keepdims=True)
            full = s / np.maximum(whole, 1e-12)
            some = np.flatnonzero(whole[:, 0] > 0)
            rows = np.flatnonzero(h.own >= 0)
            doc, own = h.doc[rows], h.own[rows]
            rest = s[doc]
            rest[np.arange(len(rows)), own] = np.maximum(0.0, rest[np.arange(len(rows)), own] - h.n[rows])
            left = rest.sum(1, keepdims=True)
            less = np.where(full[doc] > 0, np.divide(rest, left, out=np.zeros_like(rest), where=left > 0) - full[doc], 0.0)
            ids = np.asarray(b["doc_id"])
            term = pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(h.term[rows].astype(np.int64))])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([ids[some], ids[doc]])), term, _dense(np.concatenate([full[some], less]))], names=["doc_id", "term", "v"])

    return run


def _output(scored: DataFrame, seeded: DataFrame, names: list[str], brief: int) -> DataFrame:
    """(doc_id, subject, sentences, of): what each document's evidence says, and seeds that it neither shows nor denies.

    A given label is clamped in the output where the document's words are on no subject at all and most other seeds of
    that subject and language aren't found by their words either: its words are still unknown. Where they are known, a
    document without any of them contradicts its label.
    """
    k = len(names)
    none = F.array(*[F.lit(0.0)] * k)
    own = seeded.join(scored.select("doc_id", "s"), "doc_id", "left").select("doc_id", "sentences", "tongue", F.coalesce("s", none).alias("s"), F.explode("given").alias("i"))
    rate = own.groupBy("tongue", "i").agg(F.avg((F.get(F.col("s"), F.col("i")) > 0).cast("double")).alias("rate"))  # a row a language and subject
    blank = own.where(F.array_max("s") == 0).join(F.broadcast(rate), ["tongue", "i"]).where("rate < 0.5")
    clamped = blank.groupBy("doc_id").agg(F.first("sentences").alias("sentences"), F.slice(F.sort_array(F.collect_set("i")), 1, 2).alias("at"))

    def rule(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(key, names[i], int(s[i]), int(n)) for key, n, s in zip(b["doc_id"], b["sentences"], b["s"], strict=True) for i in _rule(s, n, brief)]
            yield pd.DataFrame(rows, columns=["doc_id", "subject", "sentences", "of"])

    shown = scored.mapInPandas(rule, "doc_id long, subject string, sentences int, of int")
    subject = F.explode(F.transform("at", lambda i: F.get(F.array(*map(F.lit, names)), i)))
    return shown.unionByName(clamped.select("doc_id", subject.alias("subject"), F.lit(0).alias("sentences"), F.col("sentences").alias("of")))


def subject_areas(
    documents: DataFrame, labels: DataFrame, areas: DataFrame, *, rounds: int = 8, agree: float = 0.6, clear: float = 0.15, least: float = 1.5,
    brief: int = 9, rare: float = 0.12, growth: float = 1.05,
) -> DataFrame:
    """(doc_id, subject, sentences, of): none, one or two subjects of each document and how many of its sentences are on it.

    documents has doc_id, text; labels doc_id, subject; areas subject (at most 200; repeated or null ones count once or
    not). Other columns are ignored. A repeated doc_id is one document (its first text in order); null and empty texts
    and documents without evidence have no rows; labels that are null, of no area or of no document are ignored, letter
    case and outer spaces apart, repeated ones count once. No labels at all give no rows. Documents with the same text
    get the same subjects.
    """
    names = sorted({r[0].strip() for r in areas.where("subject is not null").select("subject").distinct().limit(201).collect()})
    if len(names) > 200:
        raise ValueError("more than 200 subject areas")
    k, spark = len(names), documents.sparkSession
    empty = spark.createDataFrame([], "doc_id long, subject string, sentences int, of int")
    if not k:
        return empty
    index = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n.lower()), F.lit(i))])
    docs = documents.where("doc_id is not null and text is not null").groupBy("doc_id").agg(F.min("text").alias("text"))
    graph = stash(docs.mapInPandas(_graph, GRAPH).where("sentences > 0"), "subject-graph")
    given = labels.select("doc_id", index[F.lower(F.trim("subject"))].alias("s")).where("doc_id is not null and s is not null").distinct()
    seeds = stash(given.groupBy("doc_id").agg(F.collect_set("s").alias("given")), "subject-seeds")
    shown = graph.join(seeds, "doc_id").select("tongue", F.explode("given").alias("s")).groupBy("tongue").agg(F.count_distinct("s").alias("shown"))
    in_language = graph.groupBy("tongue").agg(F.count("*").alias("docs")).join(F.broadcast(shown), "tongue", "left")  # a row a language
    counted = graph.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).where("df > 1")
    known = counted.withColumn("tongue", F.col("term").bitwiseAND(F.lit(15)).cast("int")).join(F.broadcast(in_language), "tongue")
    known = stash(known.select("term", "df", "docs", (F.col("shown") >= 0.8 * k).alias("covered")), "subject-known")

    def summed(votes: DataFrame) -> DataFrame:
        """(term, w0...): votes (term, v), v a weight a subject."""
        return votes.groupBy("term").agg(*[F.sum(F.get("v", F.lit(i))).alias(f"w{i}") for i in range(k)])

    # each document's labels as one list, joined to its terms as one list, so that the graph is shuffled a row a document
    even = F.array(*[F.when(F.array_contains("given", i), F.lit(1.0) / F.size("given")).otherwise(0.0) for i in range(k)])
    sums = summed(graph.join(seeds, "doc_id").select(even.alias("v"), F.explode("terms").alias("term")))
    # a seed votes even where none of its terms is verified yet
    seeded = graph.select("doc_id", "sentences", "tongue").join(seeds, "doc_id")
    alone = seeded.select("doc_id", "sentences", "given", F.lit(None).cast(HELD).alias("t"))
    found, before = empty, 0
    for turn in range(rounds):
        terms = stash(_verified(sums, known, k, agree, clear, least, rare), "subject-terms").select("term", "own", "shares")
        specific = terms.where("own is not null").count()
        # the third round is the last unless words of subjects are still being found
        last = turn == rounds - 1 or (turn >= 2 and specific <= before * growth)
        before = specific
        edges = graph.select("doc_id", "sentences", F.explode(F.arrays_zip("terms", "at")).alias("e")).select("doc_id", "sentences", F.col("e.terms").alias("term"), F.col("e.at").alias("at"))
        hit = edges.join(terms, "term").select("doc_id", "sentences", F.lit(None).cast("array<int>").alias("given"), F.struct("term", "own", "at", "shares").alias("t"))
        held = hit.unionByName(alone).groupBy("doc_id").agg(F.first("sentences").alias("sentences"), F.max("given").alias("given"), F.collect_list("t").alias("terms"))
        if last:
            scored = stash(held.mapInArrow(_scored(k, clear), "doc_id long, sentences int, s array<double>"), "subject-scored")
            found = _output(scored, seeded, names, brief)
            break
        judged = stash(held.mapInArrow(_votes(k, clear), "doc_id long, term long, v array<double>"), "subject-votes")
        spread = graph.select("doc_id", "terms").join(judged.where("term is null").select("doc_id", "v"), "doc_id").select("v", F.explode("terms").alias("term"))
        sums = summed(spread.unionByName(judged.where("term is not null").select("v", "term")))
    return found
