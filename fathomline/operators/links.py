"""The link graph of notes: extraction, resolution by joins, neighbours, orphans, unresolved targets, lint, context search."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Endings of files that are no notes.
FILES = ("png jpg jpeg pdf webp svg gif bmp tif tiff avif mp4 mov avi mkv zip html css ipynb csv tsv parquet").split()
# What a text must hold to hold any link; decided in the JVM before Python looks at it.
MARK = r"\[\[|\bADR-\d{4}\b|\]\(|\[[^\]\n]*\]:|<[A-Za-z][A-Za-z0-9+.-]{1,31}:|`[^`\s]+\.(?:" + "|".join(FILES) + r")`"

CODE = re.compile(r"^ {0,3}(`{3,}|~{3,})[^\n]*\n.*?(?:^ {0,3}\1[`~]*[ \t]*$|\Z)|(?<!`)(`+)(?!`)(?:.+?)(?<!`)\2(?!`)|<!--.*?-->", re.S | re.M)
FRONT = re.compile(r"\A\s*---\r?\n.*?\r?\n---[ \t]*(?:\r?\n|\Z)", re.S)
WIKI = re.compile(r"!?\[\[([^\[\]]+?)\]\]")
INLINE = re.compile(r"!?\[(?:[^\[\]]|\[[^\[\]]*\])*\]\(\s*(<[^<>\n]*>|(?:[^\s()]|\([^\s()]*\))*)(?:\s+(?:\"[^\"]*\"|'[^']*'))?\s*\)")
DEFINITION = re.compile(r"^ {0,3}(?:>[ ]?)*\[([^\]\n]+)\]:[ \t]*(\S+)", re.M)
AUTO = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^<>\s]*)>")
ADR = re.compile(r"\bADR-\d{4}\b")
WEB = ("http://", "https://", "mailto:")


def _targets(text: str) -> list[str]:
    """Link targets in order, anchors dropped, each once."""
    bare = CODE.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    known = {m[1].lower(): m[2].strip("<>") for m in DEFINITION.finditer(bare)}
    found: list[tuple[int, str]] = []
    for m in WIKI.finditer(bare):
        found.append((m.start(), re.split(r"[|#]", m[1])[0].strip() or (m[1].strip() if m[1].lstrip().startswith(("#", "^")) else "")))
    for m in INLINE.finditer(bare):
        found.append((m.start(), m[1].strip("<>")))
    for m in re.finditer(r"\[([^\[\]\n]+)\](?:\[([^\[\]\n]*)\])?(?![(:\[])", bare):
        name = (m[2] or m[1]).lower()
        if name in known:
            found.append((m.start(), known[name]))
    found += [(m.start(), m[1]) for m in AUTO.finditer(bare)]
    found += [(m.start(), m[0]) for m in ADR.finditer(bare)]
    out: dict[str, None] = {}
    for _, t in sorted(found, key=lambda x: x[0]):
        if t.startswith(WEB):
            continue
        t = re.sub(r"%20", " ", t)
        t = t if t.startswith(("#", "^")) else t.split("#")[0].strip()
        if t and not t.startswith("#"):
            out[t] = None
    return list(out)


def references(text: str | None) -> list[tuple[str, str, bool]]:
    """(target, kind, scaffold) of a note: kind is note, file or mention (a file cited in backticks). A target is
    scaffold if it stands only in front matter and heading lines."""
    text = text or ""
    body = FRONT.sub("", text, count=1)
    prose = set(_targets(re.sub(r"(?m)^[ \t]{0,3}#{1,6}[ \t].*$", "", body)))
    out = [(t, "file" if t.lower().rpartition(".")[2] in FILES and "." in t else "note", t not in prose) for t in _targets(text)]
    seen = {t for t, _, _ in out}
    fenced = re.sub(r"^ {0,3}(`{3,}|~{3,}).*?(?:^ {0,3}\1[`~]*[ \t]*$|\Z)", "", text, flags=re.S | re.M)
    for m in re.finditer(r"(?<!`)`([^`\s]+)`(?!`)", fenced):
        if m[1].lower().rpartition(".")[2] in FILES and m[1] not in seen:
            seen.add(m[1])
            out.append((m[1], "mention", False))
    return out


def extract(notes: DataFrame) -> DataFrame:
    """(src, n, target, kind, scaffold) of notes (path, text). Only texts with a mark of a link reach Python."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, i, *r) for p, t in zip(b["path"], b["text"], strict=True) for i, r in enumerate(references(t), 1)]
            yield pd.DataFrame(rows, columns=["src", "n", "target", "kind", "scaffold"])

    return notes.where(F.col("text").rlike(MARK)).select("path", "text").mapInPandas(run, "src string, n int, target string, kind string, scaffold boolean")


def _folder(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def _joined(target: Column, source: Column) -> Column:
    """A ./ or ../ target against its source's folder, without the steps; null if it leaves the root."""
    relative = target.rlike(r"^\.\.?/|/\.\.?/")
    parts = F.split(F.concat_ws("/", F.when(_folder(source) != "", _folder(source)), target), "/")
    # an escaped step leaves a marker that nothing matches
    walked = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda a, s: F.when((s == "") | (s == "."), a).when(s == "..", F.when(F.size(a) > 0, F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array(F.lit("\x00")))).otherwise(F.concat(a, F.array(s))),
    )
    path = F.array_join(walked, "/")
    return F.when(~relative, target).when(F.contains(path, F.lit("\x00")), F.lit(None)).otherwise(path)


def suffixes(paths: DataFrame) -> DataFrame:
    """(path, tail): every path with each of its tails in lower case, so that a suffix match is an equality."""
    parts = F.split(F.lower("path"), "/")
    return paths.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("tail"))


def _best(tails: DataFrame, keys: list[str]) -> DataFrame:
    """Of the paths of each key the one with fewest steps, then the lower."""
    order = F.struct(F.size(F.split("path", "/")), F.lower("path"), F.col("path"))
    return tails.groupBy(*keys).agg(F.min_by("path", order).alias("path"))


def _above(path: Column) -> Column:
    """The folders a path lies in, from the top."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.when(F.size(parts) > 1, F.array_join(F.slice(parts, F.lit(1), i), "/")).otherwise(""))


def resolve(links: DataFrame, notes: DataFrame) -> DataFrame:
    """links with `dst`, null where nothing matches. A target with a slash matches a whole path, else the end of one; a
    name the file's stem, ADR-0001 a stem 0001-*. Of several: the source's folder, then fewest steps, then the lower path.

    The best note is chosen for each name, and for each name and folder, before the links are joined, so that a name
    that many notes have and many links use costs one row a link.
    """
    unique = notes.select("path").distinct()
    asked = links.select("src", "target").distinct().withColumn("goal", _joined(F.col("target"), F.col("src")))
    own = asked.where(F.col("target").rlike(r"^[#^]")).select("src", "target", F.col("src").alias("dst"))
    goal = F.lower(F.regexp_replace(F.regexp_replace("goal", r"\.md$", ""), "^/+", ""))
    rest = asked.where(F.col("goal").isNotNull() & ~F.col("target").rlike(r"^[#^]"))
    rest = rest.select("src", "target", F.concat(goal, F.lit(".md")).alias("want"), _folder(F.col("src")).alias("folder"), F.regexp_extract("goal", r"^ADR-(\d{4})(?:\.md)?$", 1).alias("no"))
    tails = suffixes(unique.where(F.lower("path").endswith(".md")))
    exact = _best(unique.withColumn("want", F.lower("path")), ["want"]).withColumnRenamed("path", "exact")
    here = _best(tails.withColumn("folder", F.explode(_above(F.col("path")))).where("folder <> ''"), ["tail", "folder"]).select(F.col("tail").alias("want"), "folder", F.col("path").alias("here"))
    anywhere = _best(tails, ["tail"]).select(F.col("tail").alias("want"), F.col("path").alias("anywhere"))
    numbered = unique.withColumn("no", F.regexp_extract("path", r"(?:^|/)(\d{4})-[^/]*\.md$", 1)).where("no <> ''")
    order = F.struct(F.when(F.concat(F.lit("/"), F.lower("path")).contains("/adr/"), 0).otherwise(1), F.size(F.split("path", "/")), F.lower("path"))
    records = numbered.groupBy("no").agg(F.min_by("path", order).alias("record"))
    both = rest.join(exact, "want", "left").join(here, ["want", "folder"], "left").join(anywhere, "want", "left").join(records, "no", "left")
    dst = F.coalesce(F.when(F.contains("target", F.lit("/")), F.col("exact")), "here", "anywhere", "record")
    return links.join(both.select("src", "target", dst.alias("dst")).unionByName(own), ["src", "target"], "left")


def resolve_assets(refs: DataFrame, assets: DataFrame) -> DataFrame:
    """refs with `asset`: a whole path, else the end of one, else a file's name; of several as for notes, the source's own
    folder only where the target is a name."""
    asked = refs.select("src", "target").distinct().select("src", "target", F.lower(F.regexp_replace(F.trim(_joined(F.col("target"), F.col("src"))), "^/+", "")).alias("want"), _folder(F.col("src")).alias("folder"))
    unique = assets.select("path").distinct()
    tails = suffixes(unique)
    exact = _best(unique.withColumn("want", F.lower("path")), ["want"]).withColumnRenamed("path", "exact")
    here = _best(tails.where(~F.contains("tail", F.lit("/"))).withColumn("folder", _folder(F.col("path"))).where("folder <> ''"), ["tail", "folder"]).select(F.col("tail").alias("want"), "folder", F.col("path").alias("here"))
    anywhere = _best(tails, ["tail"]).select(F.col("tail").alias("want"), F.col("path").alias("anywhere"))
    both = asked.join(exact, "want", "left").join(here, ["want", "folder"], "left").join(anywhere, "want", "left")
    return refs.join(both.select("src", "target", F.coalesce("exact", "here", "anywhere").alias("asset")), ["src", "target"], "left")


def edges(resolved: DataFrame) -> DataFrame:
    """(src, dst, scaffold): each pair once; a link in prose makes the edge a prose edge."""
    return resolved.where("dst is not null and dst <> src").groupBy("src", "dst").agg(F.min(F.col("scaffold").cast("int")).cast("boolean").alias("scaffold"))


def unresolved(resolved: DataFrame) -> DataFrame:
    return resolved.where("dst is null and kind = 'note'").select("src", "target").distinct()


def orphans(notes: DataFrame, graph: DataFrame) -> DataFrame:
    """Notes no other note links to."""
    return notes.select("path").distinct().join(graph.select(F.col("dst").alias("path")), "path", "left_anti")


def degrees(notes: DataFrame, graph: DataFrame) -> DataFrame:
    """(path, links_out, links_in): the snapshot of the graph."""
    out = graph.groupBy(F.col("src").alias("path")).agg(F.count("*").alias("links_out"))
    into = graph.groupBy(F.col("dst").alias("path")).agg(F.count("*").alias("links_in"))
    both = notes.select("path").distinct().join(out, "path", "left").join(into, "path", "left")
    return both.select("path", F.coalesce("links_out", F.lit(0)).alias("links_out"), F.coalesce("links_in", F.lit(0)).alias("links_in"))


def patched(graph: DataFrame, changed: DataFrame, fresh: DataFrame) -> DataFrame:
    """The graph with the edges of changed notes (path) replaced by fresh ones."""
    return graph.join(changed.select(F.col("path").alias("src")), "src", "left_anti").unionByName(fresh)


def reach(graph: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """(path, hop): what is reached from start (path) along edges either way, at the fewest hops."""
    step = graph.select("src", "dst").unionByName(graph.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    seen = start.select("path").distinct().withColumn("hop", F.lit(0))
    for hop in range(1, hops + 1):
        more = seen.where(F.col("hop") == hop - 1).join(step, F.col("path") == F.col("src")).select(F.col("dst").alias("path"), F.lit(hop).alias("hop")).distinct()
        seen = seen.unionByName(more).groupBy("path").agg(F.min("hop").alias("hop"))
    return seen


def expanded(graph: DataFrame, start: DataFrame, *, hops: int = 2, decay: float = 0.5, damp: float = 0.5, prose: float = 1.0, scaffold: float = 0.5) -> DataFrame:
    """(path, score): start (path, score) spread over edges, weighed by their kind, divided by the target's in-degree to
    the power of damp (hubs count less) and by decay a hop; a note keeps the best it gets."""
    popular = graph.groupBy("dst").agg(F.count("*").alias("n"))
    step = graph.join(popular, "dst").select("src", "dst", (F.when(F.col("scaffold"), scaffold).otherwise(prose) / F.pow("n", F.lit(damp))).alias("w"))
    now = best = start.select("path", "score")
    for _ in range(hops):
        now = now.join(step, F.col("path") == F.col("src")).groupBy(F.col("dst").alias("path")).agg(F.max(F.col("score") * F.col("w") * decay).alias("score"))
        best = best.unionByName(now)
    return best.groupBy("path").agg(F.max("score").alias("score"))


def name_search(notes: DataFrame, text: str) -> DataFrame:
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"\.md$", "")
    return notes.where(F.contains(F.lower(stem), F.lit(text.lower()))).select("path").distinct()


def context_search(notes: DataFrame, queries: list[str], most: int = 20) -> DataFrame:
    """(query, path, line, snippet, note_matches): lines that hold a query, letter case apart, at most `most` a note;
    note_matches counts all occurrences. One pass over the texts for all queries."""
    asked = sorted({q for q in queries if q})
    if not asked:
        return notes.select(F.lit("").alias("query"), "path", F.lit(0).alias("line"), F.lit("").alias("snippet"), F.lit(0).alias("note_matches")).limit(0)
    text = F.regexp_replace("text", "\r\n?", "\n")
    own = notes.select("path", text.alias("text"), F.lower(text).alias("low"))
    live = own.where(F.array_contains(F.array(*[F.contains("low", F.lit(q.lower())) for q in asked]), True))
    each = live.select("path", "text", "low", F.explode(F.filter(F.array(*map(F.lit, asked)), lambda q: F.contains("low", F.lower(q)))).alias("query"))
    needle = F.lower("query")
    count = ((F.length("low") - F.length(F.replace("low", needle, F.lit("")))) / F.length(needle)).cast("int")
    lines = each.select("query", "path", count.alias("note_matches"), F.posexplode(F.split("text", "\n")).alias("i", "raw")).where(F.contains(F.lower("raw"), F.lower("query")))
    order = Window.partitionBy("query", "path").orderBy("i")
    return lines.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= most).select("query", "path", (F.col("i") + 1).alias("line"), F.trim("raw").alias("snippet"), "note_matches")


def lint(notes: DataFrame, resolved: DataFrame) -> DataFrame:
    """(path, issue): odd fences, odd $$ and ==, unequal brackets outside code, and unresolved targets with their line."""
    bare = F.regexp_replace(F.regexp_replace("text", r"(?smd)^ {0,3}(```+|~~~+).*?(?:^ {0,3}\1[^\n]*$|\z)", ""), r"`[^`\n]+`", "")
    n = lambda s, t: (F.length(t) - F.length(F.replace(t, F.lit(s), F.lit("")))) / len(s)
    found = F.array_compact(F.array(
        F.when(n("```", F.col("text")) % 2 != 0, "unclosed code fence"), F.when(n("$$", bare) % 2 != 0, "unbalanced $$ block"),
        F.when(n("==", bare) % 2 != 0, "unbalanced == highlight"), F.when(n("[[", bare) != n("]]", bare), "unbalanced [[wikilink]]"),
    ))
    odd = notes.select("path", F.explode(found).alias("issue"))
    missing = unresolved(resolved).join(notes.select(F.col("path").alias("src"), F.col("text")), "src")
    at = F.instr("text", F.concat(F.lit("[["), F.col("target")))
    head = F.substring("text", F.lit(1), at)
    line = F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1
    ghosts = missing.where(at > 0).select(F.col("src").alias("path"), F.concat(F.lit("line "), line.cast("string"), F.lit(": unresolved [["), "target", F.lit("]]")).alias("issue"))
    return odd.unionByName(ghosts)


def callouts(notes: DataFrame) -> DataFrame:
    """(path, callout): types of blockquote callouts, in order of the text."""
    quoted = F.regexp_extract_all("text", F.lit(r"(?md)(?:^|(?<=\n)(?![ \t]*>))[ ]{0,3}>[ \t]*\[!([A-Za-z]+)\]"), F.lit(1))
    return notes.select("path", F.posexplode(quoted).alias("n", "callout"))


def asset_backlinks(resolved: DataFrame) -> DataFrame:
    """(asset, notes): who embeds or links each file, by path."""
    return resolved.where("asset is not null").groupBy("asset").agg(F.sort_array(F.collect_set("src")).alias("notes"))


def document_links(notes: DataFrame) -> DataFrame:
    """(note, document): paths a note's front matter lists under documents. They are repository paths and never merged
    with the assets of the vault."""
    from fathomline.operators.prose import document_paths

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, d) for p, t in zip(b["path"], b["text"], strict=True) for d in document_paths(t)]
            yield pd.DataFrame(rows, columns=["note", "document"])

    listed = notes.where(F.startswith("text", F.lit("---")) & F.contains("text", F.lit("documents"))).select("path", "text")
    return listed.mapInPandas(run, "note string, document string")


def documented_by(document_links_: DataFrame, path: str) -> DataFrame:
    """Notes whose documents list names a path or ends with it."""
    return document_links_.where((F.col("document") == path) | F.endswith("document", F.lit("/" + path.lstrip("/")))).select("note").distinct()
