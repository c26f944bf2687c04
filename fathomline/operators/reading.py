"""Serving text: outlines, sections by title, slices of lines under a budget, pages."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def text_lines(df: DataFrame) -> DataFrame:
    """(key, line, content, off) of (key, text): lines from 1, and the character each starts at."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), "\r\n?", "\n")
    each = df.select("key", F.posexplode(F.split(text, "\n")).alias("i", "content"))
    before = F.sum(F.length("content") + 1).over(Window.partitionBy("key").orderBy("i").rowsBetween(Window.unboundedPreceding, -1))
    return each.select("key", (F.col("i") + 1).alias("line"), "content", F.coalesce(before, F.lit(0)).cast("int").alias("off"))


def find_headings(text: str) -> list[tuple[int, str, int, int]]:
    """(level, title, line, offset) of ATX and setext headings outside fenced and indented code."""
    out, off, fence, before = [], 0, "", ""
    for n, line in enumerate(text.split("\n"), 1):
        if fence:
            if re.match(rf" {{0,3}}{fence[0]}{{{len(fence)},}}[ \t]*$", line):
                fence = ""
            before = ""
        elif m := re.match(r" {0,3}(`{3,}(?=[^`]*$)|~{3,})", line):
            fence, before = m[1], ""
        elif m := re.match(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$", line):
            out.append((len(m[1]), (m[2] or "").strip(), n, off))
            before = ""
        elif before and (m := re.match(r" {0,3}(=+|-+)[ \t]*$", line)):
            out.append((1 if m[1][0] == "=" else 2, before.strip(), n - 1, off - len(before) - 1))
            before = ""
        elif re.match(r" {4}|\t| {0,3}(?:>|[-+*] |\d+[.)] |\|)", line) and not before or not line.strip():
            before = ""
        else:
            before = line
        off += len(line) + 1
    return out


def headings(df: DataFrame) -> DataFrame:
    """(key, level, title, line, off) of (key, text)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, *h) for k, t in zip(b["key"], b["text"], strict=True) if t for h in find_headings(re.sub(r"\r\n?", "\n", t))]
            yield pd.DataFrame(rows, columns=["key", "level", "title", "line", "off"])

    marked = df.where(F.col("text").rlike(r"(?m)^ {0,3}(?:#|=+\s*$|-+\s*$)")).select("key", "text")
    return marked.mapInPandas(run, f"key {dict(df.dtypes)['key']}, level int, title string, line int, off int")


def with_ends(found: DataFrame) -> DataFrame:
    """Headings with `end_off`: where the next heading of the same or a higher level starts; null at the last.

    One sorted pass a text: for each level the next heading at most that deep, then the heading's own level's.
    """
    later = Window.partitionBy("key").orderBy("off").rowsBetween(1, Window.unboundedFollowing)
    ends = [F.first(F.when(F.col("level") <= n, F.col("off")), ignorenulls=True).over(later) for n in range(1, 7)]
    return found.withColumn("end_off", F.element_at(F.array(*ends), F.col("level")))


def section_by_title(df: DataFrame, title: str) -> DataFrame:
    """(key, title, line, section, matches) of the headings named so, letter case apart, else of those that start so.

    matches above 1 means the title is ambiguous in that text.
    """
    want = title.strip().casefold()
    found = with_ends(headings(df))
    low = F.lower("title")
    kind = F.when(low == want, 0).when(F.startswith(low, F.lit(want)), 1)
    hit = found.withColumn("kind", kind).where("kind is not null")
    hit = hit.withColumn("best", F.min("kind").over(Window.partitionBy("key"))).where("kind = best")
    hit = hit.withColumn("matches", F.count("*").over(Window.partitionBy("key")))
    text = df.select("key", F.regexp_replace("text", "\r\n?", "\n").alias("text"))
    length = F.coalesce("end_off", F.length("text")) - F.col("off")
    return hit.join(text, "key").select("key", "title", "line", F.substring("text", F.col("off") + 1, length).alias("section"), "matches")


def line_slice(df: DataFrame, start: int = 1, end: int | None = None, budget: int = 20_000) -> DataFrame:
    """(key, text, first, last, next_start): lines from start to end while they and their breaks fit into the budget.

    The first line always comes. next_start is null where nothing was cut off.
    """
    lines = text_lines(df).where(F.col("line") >= start)
    lines = lines.where(F.col("line") <= end) if end is not None else lines
    order = Window.partitionBy("key").orderBy("line")
    used = F.sum(F.length("content") + 1).over(order.rowsBetween(Window.unboundedPreceding, 0))
    cut = lines.withColumn("used", used).withColumn("in", (F.col("used") <= budget) | (F.col("line") == start))
    kept = F.sort_array(F.collect_list(F.when(F.col("in"), F.struct("line", "content"))))
    out = cut.groupBy("key").agg(F.array_join(F.transform(kept, lambda x: x["content"]), "\n").alias("text"), F.min("line").alias("first"), F.max(F.when(F.col("in"), F.col("line"))).alias("last"), F.max("line").alias("most"))
    return out.select("key", "text", "first", "last", F.when(F.col("most") > F.col("last"), F.col("last") + 1).alias("next_start"))


def pages_of(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """lines (key, off) with the page (key, page, off) each lies on: as-of, by one sorted pass."""
    both = lines.select("key", "off", F.lit(None).cast("int").alias("page"), F.lit(1).alias("mine")).unionByName(pages.select("key", "off", "page", F.lit(0).alias("mine")))
    order = Window.partitionBy("key").orderBy("off", "mine").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("page", F.last("page", ignorenulls=True).over(order)).where("mine = 1").select("key", "off", "page")


def find_heading_offset(text: Column, concept: str) -> Column:
    """Position, from 1, of the first heading of level 1 to 4 that holds the concept as whole words; 0 if none does."""
    start, end = (r"\b" if re.match(r"\w", concept) else ""), (r"\b" if re.search(r"\w$", concept) else "")
    return F.regexp_instr(text, F.lit(rf"(?imd)^(#{{1,4}})\s+.*{start}{re.escape(concept)}{end}.*$"))


def concept_sections(df: DataFrame, concept: str) -> DataFrame:
    """(key, section) of (key, text): from the first heading that holds the concept to the next of its level or above."""
    text = F.regexp_replace("text", "\r\n?", "\n")
    at = find_heading_offset(F.col("text"), concept)
    found = df.select("key", text.alias("text")).withColumn("at", at).where("at > 0").select("key", F.expr("substring(text, at)").alias("rest"))
    level = F.length(F.regexp_extract("rest", r"\A(#+)", 1))
    cut = F.when(level == 1, F.regexp_extract("rest", r"(?sd)\A([^\n]*(?:\n(?!#{1,1}\s)[^\n]*)*)", 1))
    for n in (2, 3, 4):
        cut = cut.when(level == n, F.regexp_extract("rest", rf"(?sd)\A([^\n]*(?:\n(?!#{{1,{n}}}\s)[^\n]*)*)", 1))
    return found.select("key", F.trim(cut).alias("section"))


def section_images(df: DataFrame, concept: str) -> DataFrame:
    """(key, image): embeds of the section about a concept, each file name once, in order."""
    found = concept_sections(df, concept)
    embeds = F.regexp_extract_all("section", F.lit(r"!\[\[([^\]|]+?\.[A-Za-z0-9]+)(?:\|[^\]]*)?\]\]|!\[[^\]]*\]\(([^)\s]+)[^)]*\)"), F.lit(0))
    names = F.transform(embeds, lambda e: F.regexp_extract(F.regexp_replace(e, r"^!\[\[|(?:\|[^\]]*)?\]\]$|^!\[[^\]]*\]\(|[)\s].*$", ""), r"([^/]*)$", 1))
    return found.select("key", F.posexplode(F.array_distinct(names)).alias("n", "image")).select("key", "image")


def served(files: DataFrame, asked: DataFrame) -> DataFrame:
    """(path, served, reason): what a request for a path gets: the note itself, the note extracted beside a document, or
    why nothing. files has path; asked path."""
    have = files.select("path").distinct()
    stem = F.regexp_replace("path", r"\.[^./]*$", "")
    notes = have.where(F.lower("path").endswith(".md")).select(stem.alias("stem"), F.col("path").alias("note"))
    want = asked.select("path").distinct().withColumn("stem", stem).join(have.withColumn("there", F.lit(True)), "path", "left").join(notes, "stem", "left")
    text = F.lower("path").rlike(r"\.(?:md|txt|rst|csv|json|ya?ml|toml|xml|html)$|(?:^|/)[^./]+$")
    out = F.when(F.col("there").isNull(), F.lit(None)).when(text, F.col("path")).otherwise(F.col("note"))
    reason = F.when(F.col("there").isNull(), "not_found").when(~text & F.col("note").isNull(), "unconverted")
    return want.select("path", out.alias("served"), reason.alias("reason"))
