"""Functions paired with their documentation.

Comment spans and function spans are extracted independently; an as-of join attaches to each function the nearest
comment above it, and rejects it unless it ends on the line right above the declaration, so that nothing stands
between. Docstrings are spans that start at their function. Functions whose documentation is missing or says nothing
beyond names and placeholders are dropped.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomline.llm.code import comment_blocks, declarations, language, lex, normalise
from fathomline.session import latest

# Words that carry no statement in documentation; phrases that are placeholders, licences or directives.
EMPTY_WORDS = frozenset(
    "a an and any are as at be by can does do for from has have if in into is it its of on or so than that the their then there these this those to used uses "
    "using was were when where which while will with given specified "
    "function method class constructor destructor routine procedure helper docstring documentation doc getter setter property callback implementation impl "
    "stub todo fixme xxx hack tbd undocumented undefined none nothing na null void see above below inherited inheritdoc override auto generated autogenerated "
    "get gets set sets return returns param params parameter parameters arg args argument arguments value values result results".split()
)
PLACEHOLDER = re.compile(r"\b(?:TODO|FIXME|XXX|HACK|TBD)\b[:(]?[^\n.]*(?:\.|$)|\{?@inheritDoc\}?|\bauto-?generated (?:\w+ )?stub\b", re.I | re.M)
LICENCE = re.compile(r"\bcopyright\b|\(c\) ?\d{4}|\ball rights reserved\b|\blicen[sc]ed? under\b|\bpermission is (?:hereby )?granted\b|\bSPDX-|\bredistribution and use\b|\b(?:open|licen[sc]e) terms\b|\bwithout warrant", re.I)
DIRECTIVE = re.compile(
    r"^\W*(?:noqa|nolint\w*|noinspection|eslint|tslint|jshint|jslint|prettier-ignore|ts-(?:ignore|expect-error|nocheck)|@ts-\w+|type:\s*ignore|pylint|mypy|pyright|flake8|ruff|fmt:|isort|yapf|"
    r"pragma|clang-format|clang-tidy|cppcheck|istanbul|c8 ignore|v8 ignore|coverage|checkstyle|suppresswarnings|nosonar|nosec|biome-ignore|region|endregion|#?!|-\*-|vim:|coding[:=])",
    re.I,
)
CODE = re.compile(
    r"[;{}]\s*$|^\s*[\w.\[\]\"']+\s*(?:[+\-*/|&]?=)(?!=)\s*\S|^\s*(?:return|raise|throw|yield|await|del|assert|break|continue|pass|import|from)\b(?:\s+[\w.]+)?\s*;?$|^\s*(?:return|raise|throw|await|yield)\b.*[()\[\]]|"
    r"^\s*(?:if|for|while|elif|else|def|class|switch|case|try|except|catch|with)\b.*[:{)]\s*$|^\s*[\w.]+\([^)]*\)\s*;?$|^\s*(?:from\s+\S+\s+)?import\s+\S+$|^\s*#\s*(?:include|define)\b|^\s*@\w+\([^)]*\)$"
)
TAGGED = re.compile(r"^\s*(?:[@\\](?!brief\b|summary\b|description\b|details\b|note\b|remarks?\b)\w+.*|:(?:param|type|returns?|rtype|raises)\b.*)$")
FIELDS = re.compile(r"^\s*(?:Args|Arguments|Params|Parameters|Returns?|Yields|Raises|Throws|Attributes|Examples?|See Also)\s*:?\s*$", re.I)
INLINE_FIELDS = re.compile(r"(?<!\w)[@\\](?:param|return|returns|throws|exception|see|since|author|type|deprecated)\b.*", re.S)


def parts(name: str) -> list[str]:
    """Words of an identifier."""
    spaced = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1_\2", re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name))
    return [w.lower() for w in re.findall(r"[^\W\d_]+|\d+", spaced)]


def stem(word: str) -> str:
    for end in ("ings", "ing", "ies", "ied", "es", "ed", "s", "e"):
        if word.endswith(end) and len(word) - len(end) >= 3:
            word = word[: -len(end)]
            break
    return word[:-1] if len(word) > 3 and word[-1] == word[-2] else word


def description(doc: str) -> str:
    """The part of a documentation that describes: without licences, directives, placeholders, disabled code and field lists."""
    kept: list[str] = []
    for line in doc.replace("\r", "").split("\n"):
        if FIELDS.match(line):
            break
        bare = re.sub(r"^\s*\*?\s?", "", line)
        if TAGGED.match(bare) or LICENCE.search(bare) or DIRECTIVE.match(bare) or CODE.search(bare) or not re.search(r"\w", bare):
            continue
        kept.append(bare)
    text = "\n".join(kept)
    return re.sub(r"<[^<>\n]*>|\{@\w+ ([^{}]*)\}", r" \1 ", PLACEHOLDER.sub(" ", INLINE_FIELDS.sub("", text))).strip()


def says_something(doc: str | None, name: str, header: str, least: int = 2) -> bool:
    """Whether doc states at least `least` different words beyond the function's name, its parameters and placeholders."""
    if not doc:
        return False
    known = {stem(w) for w in parts(name)} | {stem(p) for w in re.findall(r"[^\W\d]\w*", header) for p in parts(w)}
    known |= {stem(x + y) for x, y in zip(parts(name), parts(name)[1:])}
    words = re.findall(r"[^\W\d_]+", unicodedata.normalize("NFC", description(doc)))
    fresh = {stem(w.lower()) for w in words if len(w) > 1 or ord(w) > 0x2E80} - known - {stem(w) for w in EMPTY_WORDS} - EMPTY_WORDS
    # scripts without spaces run several words together
    return len(fresh) >= least or any(len(w) >= 4 and ord(w[0]) > 0x2E80 for w in fresh)


def tidy(doc: str) -> str:
    return "\n".join(line.rstrip() for line in re.sub(r"(?m)^[ \t]*\*[ \t]?", "", doc).strip("\n").split("\n")).strip()


SPANS = "path string, kind string, first int, last int, name string, header string, body string, stop int, code string"


def _spans(code: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, text in zip(batch["path"], batch["text"], strict=True):
                text, lang = normalise(text), language(path)
                lexed = lex(text, lang)
                lines = text.split("\n")
                for first, last, body in comment_blocks(text, lexed[1], lang):
                    out.append((path, "comment", first, last, None, None, body, None, None))
                for f in declarations(text, lang, lexed):
                    out.append((path, "function", f.line, f.line, f.name, f.header, None, f.end_line, "\n".join(lines[f.line - 1 : f.end_line]) if code else None))
                    if f.doc is not None:
                        out.append((path, "docstring", f.line, f.line, None, None, f.doc, None, None))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SPANS.split(", ")]).astype({"stop": "Int32"})

    return run


def documented_functions(sources: DataFrame, *, least: int = 2, code: bool = True) -> DataFrame:
    """(path, name, line, end_line, signature, documentation, code): functions and methods with documentation that says something.

    sources has path, text and mtime; other columns are ignored. A repeated path is one file (the latest row). Null and
    empty texts and null paths give nothing, an empty table no rows; files in unknown languages are read as brace
    languages; a file that doesn't parse gives what can be told apart. `line` is the declaration's first line with its
    decorators or annotations. Prototypes, interface and abstract methods count where they end in ';'. Of a docstring and a comment above, the docstring is taken if it says something. Without `code` that
    column is null, and the functions' texts aren't shuffled.
    """
    spans = latest(sources, "path", "text").mapInPandas(_spans(code), SPANS)
    # as-of join: the last comment that ends above the function; one that ends there and is not adjacent is rejected
    order = Window.partitionBy("path").orderBy("last", F.when(F.col("kind") == "function", 0).otherwise(1))
    above = F.last(F.when(F.col("kind") == "comment", F.struct("last", "body")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    inside = F.max(F.when(F.col("kind") == "docstring", F.col("body"))).over(Window.partitionBy("path", "first"))
    joined = spans.withColumn("above", above).withColumn("inside", inside).where(F.col("kind") == "function")
    joined = joined.withColumn("above", F.when(F.col("above.last") == F.col("first") - 1, F.col("above.body")))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            docs = [next((d for d in (i, a) if says_something(d, n, h, least)), None) for i, a, n, h in zip(b["inside"], b["above"], b["name"], b["header"], strict=True)]
            out = b[["path", "name", "first", "stop", "header", "code"]].rename(columns={"first": "line", "stop": "end_line", "header": "signature"})
            out.insert(5, "documentation", [tidy(d) if d else None for d in docs])
            yield out[[d is not None for d in docs]]

    return joined.select("path", "name", "first", "stop", "header", "inside", "above", "code").mapInPandas(
        judge, "path string, name string, line int, end_line int, signature string, documentation string, code string"
    )
