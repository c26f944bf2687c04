"""Items larger than a size limit cut at natural boundaries, with an overlap between consecutive pieces.

An item is a run of units (characters, lines or tokens). The offsets at which it may be cut are a sorted array, each
with a rank: the higher, the more natural. A piece ends at the last boundary of the best rank under the limit, found
by binary search, if that leaves it at least half full, else at a lower rank's, and, where there is no boundary at
all, hard at the limit. The next piece starts a step of `overlap` back, wherever that is: ends are natural places, starts
need not be, for the step up to the next boundary would cost overlap.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate, pairwise

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm import code, markup
from fathomline.session import latest


def cut(size: int, boundaries: list[list[int]], limit: int, overlap: int) -> list[tuple[int, int]]:
    """Pieces [start, end) of an item of `size` units, each at most `limit` long; consecutive ones share `overlap`.

    boundaries holds a sorted list of offsets for each rank, the best first. The pieces cover the item, and each
    starts after the one before it. A limit below 1 counts as 1, an overlap of limit or more as limit - 1.
    """
    limit = max(1, limit)
    overlap = max(0, min(overlap, limit - 1))
    pieces, start = [], 0
    while size - start > limit:
        top, end = start + limit, 0
        for least in (limit // 2, 1):
            for rank in boundaries:
                i = bisect_right(rank, top) - 1
                if i >= 0 and rank[i] >= start + max(least, overlap + 1):
                    end = rank[i]
                    break
            if end:
                break
        end = end or top
        pieces.append((start, end))
        start = end - overlap
    pieces.append((start, size))
    return pieces


def cut_weighted(sizes: list[int], boundaries: list[list[int]], limit: int, overlap: int) -> list[tuple[int, int]]:
    """As cut(), where unit i takes sizes[i] (say the tokens of a word); pieces are ranges of units.

    Sizes are summed once; a piece's end is searched in the sums. A unit larger than the limit is a piece by itself.
    """
    sums = [0, *accumulate(sizes)]
    pieces, start = [], 0
    while sums[-1] - sums[start] > limit and start < len(sizes):
        top, end = max(start + 1, bisect_right(sums, sums[start] + limit) - 1), 0
        for rank in boundaries:
            i = bisect_right(rank, top) - 1
            if i >= 0 and sums[rank[i]] - sums[start] >= limit / 2:
                end = rank[i]
                break
        end = end or top
        pieces.append((start, end))
        start = max(start + 1, bisect_left(sums, sums[end] - overlap)) if overlap else end
    if start < len(sizes):
        pieces.append((start, len(sizes)))
    return pieces


def text_boundaries(text: str) -> list[list[int]]:
    """Offsets after which a text may be cut: paragraphs, lines, sentences, words."""
    return [[m.end() for m in re.finditer(p, text)] for p in (r"\n[ \t]*\n\s*", r"\n", r"[.!?…]['\")\]]*\s+", r"\s+")]


def line_boundaries(lines: list[str]) -> list[list[int]]:
    """Line offsets at which code may be cut: blank lines followed by shallow code, blank lines, shallow lines."""
    depth = [len(x) - len(x.lstrip()) if x.strip() else -1 for x in lines]
    inner = sorted({d for d in depth[1:] if d >= 0})
    shallow = inner[1] if len(inner) > 1 else inner[0] if inner else 0
    blank = [i for i in range(1, len(lines)) if depth[i - 1] < 0 <= depth[i]]
    opening = re.compile(r"\s*(?:[)\]}]|else\b|elif\b|except\b|finally\b|catch\b|case\b)")
    low = [i for i in range(1, len(lines)) if 0 <= depth[i] <= shallow and not opening.match(lines[i])]
    return [sorted({*blank} & {*low}), blank, low]


PIECES = "item_kind string, item_key string, item_start int, item_size int, piece_no int, piece_start int, piece_end int, piece string"


def _sections(limit: int, overlap: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, text in zip(batch["path"], batch["content"], strict=True):
                text = markup.normalise(text)
                heads = sorted({e.start for e in markup.elements(text) if e.kind == "heading"})
                for a, b in pairwise([*heads, len(text)]):
                    if b - a > limit:
                        part = text[a:b]
                        for n, (i, j) in enumerate(cut(b - a, text_boundaries(part), limit, overlap), 1):
                            rows.append(("section", path, a, b - a, n, a + i, a + j, part[i:j]))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PIECES.split(", ")])

    return run


def _symbols(limit: int, overlap: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, text, starts in zip(batch["path"], batch["text"], batch["starts"], strict=True):
                text, lang = code.normalise(text), code.language(path)
                lexed, lines = code.lex(text, lang), text.split("\n")
                rows_, starts_ = (code.Rows.of(lexed[0], text) if lang == "python" else None), code.Lines(text)
                for line in sorted(starts):
                    if not 1 <= line <= len(lines):
                        continue
                    last = code.last_line(text, lang, int(line), lexed, rows_, starts_)
                    if last - line + 1 > limit:
                        part = lines[line - 1 : last]
                        for n, (i, j) in enumerate(cut(len(part), line_boundaries(part), limit, overlap), 1):
                            rows.append(("symbol", path, line, len(part), n, line + i, line + j, "\n".join(part[i:j])))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PIECES.split(", ")])

    return run


def oversized_pieces(notes: DataFrame, sources: DataFrame, symbols: DataFrame, limits: DataFrame) -> DataFrame:
    """(item_kind, item_key, item_start, item_size, piece_no, piece_start, piece_end, piece): the pieces of every item over its limit.

    notes has note_id, path, content and mtime: its sections run from a heading to the next of any level; sources has
    path, text, mtime and symbols path, line: a symbol runs from its line to its true last line, found in the file.
    limits has item_kind, max_size, overlap with a row each for section and symbol (a kind without a row, or with a
    null max_size, isn't cut; of several rows the smallest limit counts; a null overlap is none). Piece offsets are in
    the item's unit: characters of the note, end exclusive, or lines of the file, from 1, end exclusive.

    Repeated notes, files and symbols count once, the latest state of notes and files. Null keys, texts and lines,
    lines beyond the file and items within the limit give nothing, nor do empty tables; other columns are ignored.
    """
    given = {r["item_kind"]: r for r in limits.where("max_size is not null").groupBy("item_kind").agg(F.min_by("max_size", "max_size").alias("most"), F.min_by("overlap", "max_size").alias("overlap")).collect()}
    spark = notes.sparkSession
    out = spark.createDataFrame([], PIECES)
    if s := given.get("section"):
        out = out.unionByName(latest(notes, "note_id", "path", "content").select("path", "content").mapInPandas(_sections(s["most"], s["overlap"] or 0), PIECES))
    if s := given.get("symbol"):
        wanted = symbols.where("path is not null and line is not null").groupBy("path").agg(F.collect_set("line").alias("starts"))
        files = latest(sources, "path", "text").join(wanted, "path")
        out = out.unionByName(files.mapInPandas(_symbols(s["most"], s["overlap"] or 0), PIECES))
    return out
