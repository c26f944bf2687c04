"""Markdown, HTML, wiki and LaTeX markup to clean text that keeps headings, list items, code blocks and formulas.

A note may mix markups. One left-to-right scan takes the regions whose inside is not markup (front matter, comments,
scripts, page heads, code, formulas); what remains is cut into blocks, in two passes. The first pass decides the
blocks whose own form is clear: structural ones (headings, list items, code, formulas, tables) by their markup, running
text by stop-word density, length and link density ("good" or "bad"). Short blocks that may be either stay open; in
the second pass they inherit the label of the nearest decided neighbours, and lines that read differently in two
markups ("# x" is a heading in Markdown and a numbered item in a wiki) take the markup of their neighbours.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.code import Lines
from fathomline.session import latest

# Names of HTML elements, LaTeX environments and sectioning commands; stop words of the first pass.
TAGS = (
    "a abbr address area article aside b base big blockquote body br button caption center cite code col colgroup dd del details dfn div dl dt "
    "em fieldset figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main "
    "mark math meta nav nobr noscript ol optgroup option p param pre q ref s samp script section select small source span strike strong style sub "
    "summary sup svg syntaxhighlight table tbody td textarea tfoot th thead time title tr tt u ul var video wbr"
)
CODE_ENVIRONMENTS = "verbatim|Verbatim|lstlisting|minted|alltt"
MATH_ENVIRONMENTS = "equation|align|gather|multline|displaymath|math|eqnarray|flalign|alignat"
SECTIONS = {"part": 1, "chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4, "subparagraph": 5}
STOP_WORDS = frozenset(
    "a about after all an and are as at be been before but by can did do does for from had has have he her his how i if in into is it its more most no "
    "not of on only or our out over she so some than that the their them then there these they this those to up was we were what when which who will "
    "with would you your "
    "al alla anche che chi ci come con da dal dalla degli dei del della delle di e è gli ha hanno il la le lo ma nel nella non per più quando se si sono "
    "su una uno "
    "aber als am auch auf aus bei das dass dem den der des die doch ein eine einem einen einer er es für hat ich im ist man mit nach nicht noch nur oder "
    "sich sie sind über um und von vor war wenn wie wir wird zu zum zur "
    "au aux avec ce ces cette dans de des du elle en est et eux il ils je les leur mais même ne nous ou où par pas plus pour qu que qui sa ses son sont "
    "sur un une vous "
    "como con cuando desde el ella en entre es esta este hay los más muy o para pero por que sin sobre sus también y ya".split()
)

ATTRS = r"""(?:\s(?:[^<>"']|"[^"]*"|'[^']*')*|\s*)/?"""
REGION = re.compile(
    rf"""
    (?P<front>\A\ufeff?---[ \t]*\n.*?\n(?:---|\.\.\.)[ \t]*(?:\n|\Z))
  | (?P<fence>^[ ]{{0,3}}(?P<mark>`{{3,}}(?=[^`\n]*$)|~{{3,}})(?P<info>[^\n]*)\n?)
  | (?P<indent>^(?:[ ]{{4}}|[ ]{{0,3}}\t)[^\n]*)
  | (?P<comment><!--.*?(?:-->|\Z)|%%(?!%).*?%%|^[ \t]*%(?!%)[^\n]*\\[a-zA-Z][^\n]*)
  | <(?P<skip>script|style|head|noscript|template)\b{ATTRS}>.*?(?:</(?P=skip)\s*>|\Z)
  | <(?P<pre>pre|syntaxhighlight|source)\b(?P<preattrs>{ATTRS})>(?P<prebody>.*?)(?:</(?P=pre)\s*>|\Z)
  | <ref\b[^<>]*/>|<ref\b{ATTRS}>.*?</ref\s*>
  | \\begin\{{(?P<env>{CODE_ENVIRONMENTS})\*?\}}(?:\[[^\]\n]*\])?(?:\{{[^}}\n]*\}})?(?P<envbody>.*?)(?:\\end\{{(?P=env)\*?\}}|\Z)
  | \\begin\{{(?P<menv>(?:{MATH_ENVIRONMENTS})\*?)\}}(?P<m1>.*?)\\end\{{(?P=menv)\}}
  | <math\b{ATTRS}>(?P<m2>.*?)</math\s*>
  | (?<!\\)\$\$(?P<m3>(?:[^$\\]|\\.)+?)\$\$
  | (?<!\\)\\\[(?P<m4>.+?)\\\]
  | (?<!\\)\\\((?P<m5>.+?)\\\)
  | (?<![\\$])\$(?![\s$])(?P<m6>(?:[^$\\\n]|\\[^\n])*?(?<![\s\\]))\$(?![\d$])
  | (?P<tick>`+)(?!`)(?P<span>[^\n]+?)(?<!`)(?P=tick)(?!`)
    """,
    re.X | re.S | re.M | re.I,
)
MORE_INDENTED = re.compile(r"(?:\n(?:[ \t]*\n)*(?:[ ]{4}|[ ]{0,3}\t)[ \t]*\S[^\n]*)*")
HTML_HEADING = re.compile(rf"<h([1-6])\b{ATTRS}>(.*?)(?=</h[1-6]\s*>|<h[1-6]\b|\Z)", re.S | re.I)
HTML_ITEM = re.compile(rf"<li\b{ATTRS}>(.*?)(?=</?li\b|</?[uo]l\b|<(?:p|div|table|h[1-6]|pre)\b|\Z|\n[ \t]*\n)", re.S | re.I)
TEX_HEADING = re.compile(r"\\(part|chapter|section|subsection|subsubsection|paragraph|subparagraph)\*?[ \t]*(?:\[[^\]\n]*\])?[ \t]*\{")
TEX_ITEM = re.compile(r"\\item\b[ \t]*(?:\[[^\]\n]*\])?(.*?)(?=\\item\b|\\begin\{|\\end\{|\n[ \t]*\n|\Z)", re.S)
ATX = re.compile(r"[ ]{0,3}(?:>[ ]?)*[ ]{0,3}(#{1,6})[ \t]+(\S.*?)(?:[ \t]+#+)?[ \t]*$")
WIKI_HEADING = re.compile(r"[ \t]*(={1,6})(?!=)[ \t]*(\S.*?)[ \t]*(?<!=)\1[ \t]*$")
RULE = re.compile(r"[ ]{0,3}(?:(?:-[ \t]*){3,}|(?:\*[ \t]*){3,}|(?:_[ \t]*){3,})$")
ITEM = re.compile(r"(?:[ ]{0,3}>[ ]?)*([ \t]*)(?:([-+*])|(\d{1,9})[.)])[ \t]+(?:\[[ xX]\][ \t]+)?(\S.*)$")
WIKI_ITEM = re.compile(r"([*#]+[*#:;]*)[ \t]*(\S.*)$")
NUMBERED = re.compile(r"#+[*#:]* ?\S")
STARRED, NESTED = re.compile(r"(\*+[*#]*|#[*#]+)[ \t]*(\S.*)$"), re.compile(r"(\*{2,}|[*#]*\*#|#{2,}\*)[ \t]+(\S.*)$")
SETEXT = re.compile(r"[ ]{0,3}(=+|-+)[ \t]*$")
TABLE = re.compile(r"[ \t]*(?:\|.*\|?|\{\|.*|\|\}|!.*!!.*)[ \t]*$")
TAG = re.compile(rf"</?(?:{'|'.join(TAGS.split())})\b{ATTRS}>", re.I)
BREAK = re.compile(rf"<(?:br|hr|/?(?:p|div|li|tr|td|th|h[1-6]|table|ul|ol|blockquote|section|article))\b{ATTRS}>|</(?:p|div|li|tr|td|th|h[1-6]|table|ul|ol|blockquote)\s*>", re.I)
LINK = re.compile(rf"\[\[.*?\]\]|\[[^\]\n]*\]\([^)\n]*\)|<a\b{ATTRS}>.*?</a>|\\href\{{[^}}]*\}}\{{[^}}]*\}}|https?://\S+", re.S | re.I)
SPACE = re.compile(r"\s+")


class Element(NamedTuple):
    kind: str  # heading, list_item, code_block, formula
    level: int
    start: int
    end: int
    text: str


class Block(NamedTuple):
    label: str  # heading, list_item, code_block, formula, table, good, bad
    start: int
    end: int
    text: str


def squeeze(text: str) -> str:
    return SPACE.sub(" ", text).strip()


ENTITY = re.compile(r"&(?:#\d+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);")


def entities(text: str) -> str:
    return ENTITY.sub(lambda m: html.unescape(m[0]), text) if "&" in text else text


def braces(text: str, at: int) -> int:
    """Index of the brace that closes the one at `at`, or the end of its line."""
    depth, i = 0, at
    while i < len(text):
        c = text[i]
        if c == "\\":
            i += 1
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if not depth:
                return i
        elif c == "\n" and text[i : i + 2] == "\n\n":
            break
        i += 1
    end = text.find("\n", at)
    return len(text) if end < 0 else end


# Inline markup, in the order in which it is taken off: pattern, what stays.
HOLDS_CODE = re.compile(r"(`+)(?!`)(.+?)(?<!`)\1(?!`)", re.S)
HOLDS_MATH = (
    re.compile(rf"<math\b{ATTRS}>(.*?)</math\s*>", re.S | re.I),
    re.compile(r"\\\((.+?)\\\)", re.S),
    re.compile(r"\\\[(.+?)\\\]", re.S),
    re.compile(r"(?<![\\$])\$\$?(?![\s$])((?:[^$\\\n]|\\[^\n])*?(?<![\s\\]))\$\$?(?![\d$])"),
)
UNSEEN = (re.compile(r"<!--.*?-->|%%(?!%).*?%%", re.S), re.compile(r"<ref\b[^<>]*/>|<ref\b.*?</ref\s*>", re.S | re.I))
BRACKETS = tuple(
    (re.compile(p), r)
    for p, r in (
        (r"!\[\[[^\]\n]*\]\]", ""), (r"!\[([^\]\n]*)\]\([^)\n]*\)", r"\1"), (r"\[\[(?:[^\]|\n]*\|)?([^\]\n]*)\]\]", r"\1"), (r"\[\^[^\]\n]+\]", ""),
        (r"\[((?:[^\[\]\n]|\[[^\]\n]*\])*)\]\((?:[^()\n]|\([^()\n]*\))*\)", r"\1"), (r"\[(?:https?|ftp|mailto):\S+\s+([^\]\n]+)\]", r"\1"),
    )
)
TEMPLATE = re.compile(r"\{\{[^{}]*\}\}")
TEX_OUTER = tuple(
    (re.compile(p), r)
    for p, r in (
        (r"\\(?:cite[a-z]*|ref|label|footnote|index|vspace|hspace)\*?(?:\[[^\]]*\])*\{[^{}]*\}", ""),
        (r"\\(?:begin|end|documentclass|usepackage)(?:\[[^\]]*\])?\{[^{}]*\}(?:\{[^{}\n]*\})?", ""), (r"\\href\{[^{}]*\}\{", r"{"),
    )
)
TEX_INNER = tuple(
    (re.compile(p), r)
    for p, r in (
        (r"\{\\(?:it|bf|em|tt|sc|sl|rm|sf|itshape|bfseries|ttfamily)\b\s*([^{}]*)\}", r"\1"), (r"\\[a-zA-Z]+\*?(?:\[[^\]]*\])?\{([^{}]*)\}", r"\1"), (r"(?<!\\)\{([^{}]*)\}", r"\1"),
    )
)
TEX_BREAK, SOFT = re.compile(r"\\\\(?=\s|$)"), re.compile(rf"<wbr{ATTRS}>", re.I)
TIE, ESCAPED, TICKS = re.compile(r"(?<=\w)~(?=\w)|(?<=\w)~(?=\s|$)"), re.compile(r"\\([\\`*_{}\[\]()#+\-.!&%$~<>|^])"), re.compile(r"'{5}|'{3}|''")
MARKS = tuple(
    [(m, re.compile(rf"{re.escape(m)}(?=\S)(.+?)(?<=\S){re.escape(m)}")) for m in ("***", "**", "*", "~~", "==")]
    + [(m, re.compile(rf"(?<!\w){m}(?=\S)(.+?)(?<=\S){m}(?!\w)")) for m in ("___", "__", "_")]
)
ANCHOR, KEPT = re.compile(r"\s\^[\w-]+\s*$"), re.compile(r"\x00(\d+)\x01")
SIGNS = re.compile(r"[\x00\x01<`$\\\[{&~*_='^%]")


def plain(text: str) -> str:
    """Inline text without the markup of any of the four languages; entities resolved, white space runs made one."""
    if not SIGNS.search(text):  # most texts have no markup at all
        return squeeze(text)
    kept: list[str] = []

    def keep(value: str) -> str:
        kept.append(value)
        return f"\x00{len(kept) - 1}\x01"

    text = text.replace("\x00", " ").replace("\x01", " ")
    if "<" in text or "%" in text:
        text = UNSEEN[1].sub("", UNSEEN[0].sub(" ", text))
    if "`" in text:
        text = HOLDS_CODE.sub(lambda m: keep(m[2]), text)
    if "<" in text or "\\" in text or "$" in text:
        for p in HOLDS_MATH:
            text = p.sub(lambda m: keep(m[1]), text)
    if "[" in text:
        for p, r in BRACKETS:
            text = p.sub(r, text)
    if "{" in text:
        text = TEMPLATE.sub("", text)
        for p, r in TEX_OUTER:
            text = p.sub(r, text)
        for _ in range(8):
            new = text
            for p, r in TEX_INNER:
                new = p.sub(r, new)
            if new == text:
                break
            text = new
    if "\\" in text:
        text = TEX_BREAK.sub(" ", text)
    if "<" in text:
        text = TAG.sub("", BREAK.sub(" ", SOFT.sub("", text)))
    text = entities(text)
    if "~" in text:
        text = TIE.sub(" ", text)
    if "\\" in text:
        text = ESCAPED.sub(lambda m: keep(m[1]), text)
    if "'" in text:
        text = TICKS.sub("", text)
    for mark, p in MARKS:
        if mark in text:
            text = p.sub(r"\1", text)
    if "^" in text:
        text = ANCHOR.sub("", text)
    if kept:
        for _ in range(2):
            text = KEPT.sub(lambda m: kept[int(m[1])], text)
    return squeeze(text)


def first_line(body: str) -> str:
    return next((squeeze(line) for line in body.split("\n") if line.strip()), "")


def normalise(text: str | None) -> str:
    return re.sub(r"\r\n?", "\n", text or "")


def _blank(text: str) -> str:
    return re.sub(r"[^\n]", " ", text)


def _line_before(text: str, start: int) -> str | None:
    """The last line with text before the blank line right above `start`; empty at the text's start, None if that line
    isn't blank."""
    end, above = start - 1, 0
    while end >= 0:
        begin = text.rfind("\n", 0, end) + 1
        line = text[begin:end]
        if line.strip():
            return line if above else None
        above += 1
        end = begin - 1
    return ""


def scan(text: str) -> tuple[list[Element], str, str]:
    """Code blocks and formulas of text, text with everything opaque blanked, and text with only inline code blanked too."""
    found: list[Element] = []
    out: list[str] = []
    seen: list[str] = []
    at = 0
    while m := REGION.search(text, at):
        start, end = m.start(), m.end()
        inline = False
        if m["indent"] is not None:
            last = _line_before(text, start)
            if last is None or not m["indent"].strip() or ITEM.match(last) or "\\item" in last:
                out.append(text[at : start + 1])
                seen.append(text[at : start + 1])
                at = start + 1
                # the rest of the line is looked at again, but never as an indented block
                continue
            end = MORE_INDENTED.match(text, end).end()
            found.append(Element("code_block", 0, start, end, first_line(text[start:end])))
        elif m["fence"] is not None:
            mark = m["mark"]
            close = re.compile(rf"^[ ]{{0,3}}{re.escape(mark[0])}{{{len(mark)},}}[ \t]*$", re.M).search(text, end)
            body = text[end : close.start() if close else len(text)]
            end = close.end() if close else len(text)
            found.append(Element("code_block", 0, start, end, first_line(body)))
        elif m["pre"] is not None:
            body = m["prebody"]
            if m["pre"].lower() == "pre":
                body = entities(re.sub(rf"</?(?:code|span|b|i|em|strong|font|a)\b{ATTRS}>", "", body, flags=re.I))
            found.append(Element("code_block", 0, start, end, first_line(body)))
        elif m["env"] is not None:
            found.append(Element("code_block", 0, start, end, first_line(m["envbody"])))
        elif (tex := next((m[g] for g in ("m1", "m2", "m3", "m4", "m5", "m6") if m[g] is not None), None)) is not None:
            found.append(Element("formula", int(m["m5"] is None and m["m6"] is None), start, end, squeeze(entities(tex))))
            inline = m["m5"] is not None or m["m6"] is not None or m["m2"] is not None
        elif m["tick"] is not None:
            inline = True
        out += [text[at:start], re.sub(r"\S", "x", text[start:end]) if inline and "\n" not in text[start:end] else _blank(text[start:end])]
        seen += [text[at:start], text[start:end] if inline else _blank(text[start:end])]
        at = end
    out.append(text[at:])
    seen.append(text[at:])
    return found, "".join(out), "".join(seen)


SHOWS_TEX = re.compile(r"\s*\\(?:begin|end|item|(?:sub)*section)\b")
SHOWS_WIKI = re.compile(r"\s*(?:\{\||\|-|\|\}|={2,6}[^=].*={2,6}\s*$|\*\*? ?\S.*''|: ?<math)")
SHOWS_HTML = re.compile(r"\s*</?(?:p|div|ul|ol|li|h[1-6]|table|tr|body|html)\b", re.I)
SHOWS_MARKDOWN = re.compile(r"\s*(?:#{2,6} |[-+] |\d+[.)] |```|~~~|\|[ -:]+-)")
MARKDOWN_INLINE = re.compile(r"\*\*\S|\]\(|~~")


def _dialect(line: str) -> str | None:
    """The markup a line is surely written in, if it shows."""
    if SHOWS_TEX.match(line):
        return "tex"
    if SHOWS_WIKI.match(line) or "'''" in line or "{{" in line:
        return "wiki"
    if SHOWS_HTML.match(line):
        return "html"
    return "markdown" if SHOWS_MARKDOWN.match(line) or MARKDOWN_INLINE.search(line) else None


UNSURE = "?"  # a line that means two things in two markups, until its neighbours decide


def elements(text: str | None) -> list[Element]:
    """The structural elements of a text in reading order. Offsets count after line ends are made one newline."""
    text = normalise(text)
    scanned = scan(text)
    return settled(first_pass(text, *scanned), scanned[1])


def settled(parts: list[Element], bare: str) -> list[Element]:
    """Second pass over structural blocks: an unsure "# x" is a numbered item where the nearest decided line is wiki
    text, and a heading elsewhere."""
    if not any(e.kind == UNSURE for e in parts):
        return parts
    dialects, at = list(map(_dialect, bare.split("\n"))), Lines(bare)
    return [e._replace(kind="list_item" if _nearest(dialects, at.of(e.start) - 1) == "wiki" else "heading") if e.kind == UNSURE else e for e in parts]


def first_pass(text: str, found: list[Element], bare: str, seen: str) -> list[Element]:
    """Structural blocks by their own form, those that could be two things marked unsure."""
    found, lines, starts, pos = list(found), bare.split("\n"), [], 0
    for line in lines:
        starts.append(pos)
        pos += len(line) + 1
    taken = bytearray(len(text) + 1)
    dialects: list[str | None] = []

    def near(i: int) -> str | None:
        if not dialects:
            dialects.extend(map(_dialect, lines))
        return _nearest(dialects, i)

    def add(kind: str, level: int, start: int, end: int, content: str) -> None:
        value = plain(content)
        if value:
            found.append(Element(kind, level, start, end, value))
            taken[start:end] = b"\x01" * (end - start)

    for m in HTML_HEADING.finditer(bare):
        add("heading", int(m[1]), m.start(), m.end(), seen[m.start(2) : m.end(2)])
    for m in TEX_HEADING.finditer(bare):
        close = braces(bare, m.end() - 1)
        add("heading", SECTIONS[m[1]], m.start(), close + 1, seen[m.end() : close])
    for m in HTML_ITEM.finditer(bare):
        add("list_item", 1, m.start(), m.end(), seen[m.start(1) : m.end(1)])
    for m in TEX_ITEM.finditer(bare):
        add("list_item", 1, m.start(), m.end(), seen[m.start(1) : m.end(1)])

    paragraph: int | None = None
    i = 0
    while i < len(lines):
        line, start = lines[i], starts[i]
        raw = text[start : start + len(line)]
        if not line.strip():
            paragraph = None if not raw.strip() else paragraph
            i += 1
            continue
        lead = start + len(line) - len(line.lstrip())
        if taken[lead]:
            paragraph = None
            i += 1
            continue
        if (m := SETEXT.match(line)) and paragraph is not None and i > paragraph:
            first = starts[paragraph]
            first += len(lines[paragraph]) - len(lines[paragraph].lstrip())
            add("heading", 1 if m[1][0] == "=" else 2, first, start + len(line), seen[first : start - 1])
            paragraph = None
            i += 1
            continue
        if RULE.match(line):
            paragraph = None
            i += 1
            continue
        if m := ATX.match(line):
            run = len(m[1]) == 1 and any(0 <= j < len(lines) and NUMBERED.match(lines[j]) for j in (i - 1, i + 1))
            add(UNSURE if run else "heading", len(m[1]), start + m.start(1), start + len(line), seen[start + m.start(2) : start + m.end(2)])
            paragraph = None
            i += 1
            continue
        if m := WIKI_HEADING.match(line):
            add("heading", len(m[1]), lead, start + len(line), seen[start + m.start(2) : start + m.end(2)])
            paragraph = None
            i += 1
            continue
        m = ITEM.match(line)
        if m is None and line[0] in "*#":
            w = STARRED.match(line) if not line.startswith("**") else None
            w = w or NESTED.match(line)
            if w and (w[1] != "*" or "*" not in line[1:] and near(i) == "wiki"):
                m = w
        if m is not None:
            j, content_at = i + 1, start + m.start(m.lastindex)
            indent = len(line) - len(line.lstrip())
            while j < len(lines) and lines[j].strip() and not taken[starts[j] + len(lines[j]) - len(lines[j].lstrip())]:
                nxt = lines[j]
                if len(nxt) - len(nxt.lstrip()) <= indent or ITEM.match(nxt) or ATX.match(nxt) or WIKI_HEADING.match(nxt) or RULE.match(nxt) or TABLE.match(nxt) or nxt.lstrip().startswith((">", "*", "<", "\\")):
                    break
                j += 1
            end = starts[j - 1] + len(lines[j - 1])
            add("list_item", 1 + indent // 2, lead, end, seen[content_at:end])
            paragraph = None
            i = j
            continue
        if TABLE.match(line) or line.lstrip().startswith((">", "<")) and TAG.match(line.lstrip()) or line.lstrip().startswith(">"):
            paragraph = None
        elif paragraph is None:
            paragraph = i
        i += 1
    found.sort(key=lambda e: (e.start, e.end))
    return found


def _nearest(dialects: list[str | None], at: int) -> str | None:
    """The markup of the nearest decided line; of two as near, the one before."""
    for d in range(1, len(dialects)):
        for j in (at - d, at + d):
            if 0 <= j < len(dialects) and dialects[j]:
                return dialects[j]
    return None


class Labelled(NamedTuple):
    elements: list[Element]
    blocks: list[Block]


BARE_WORD = re.compile(r"[^\W\d_]+")
PARAGRAPH = re.compile(r"\S[^\n]*(?:\n(?![ \t]*\n)[^\n]*)*")
QUOTE = re.compile(r"(?m)^[ \t]*(?:>[ \t]?)+(?:\[![^\]]*\])?")
TABULAR = re.compile(rf"\s*<table\b{ATTRS}>|\s*\\begin\{{tabular", re.I)


def labelled(text: str | None, *, long: int = 200, short: int = 70, high: float = 0.32, low: float = 0.2, links: float = 0.4) -> Labelled:
    """The blocks of a text with their labels, after both passes, and the structural elements in them.

    A block's text is what is seen of it, with its markup; clean() takes that off. A formula within a line is an element
    of its block and no block.
    """
    text = normalise(text)
    scanned = found, bare, seen = scan(text)
    parts = first_pass(text, *scanned)
    shape = sorted((e for e in parts if e.kind != "formula" or e.level), key=lambda e: (e.start, -e.end))
    out: list[Block] = []
    at = 0
    for e in [*shape, Element("", 0, len(text), len(text), "")]:
        if e.start < at:
            continue
        # inline formulas and code are blank in `bare`; the visible text comes from `seen`
        for m in PARAGRAPH.finditer(bare, at, e.start):
            raw = seen[m.start() : m.end()]
            if TABLE.match(raw.split("\n")[0]) or TABULAR.match(raw):
                out.append(Block("table", m.start(), m.end(), raw))
                continue
            raw = QUOTE.sub("", raw)
            visible = squeeze(TAG.sub("", raw)) if "<" in raw else squeeze(raw)
            words = BARE_WORD.findall(visible.lower())
            if not visible:
                continue
            linked = sum(len(x[0]) for x in LINK.finditer(raw)) / len(raw) if "[" in raw or "<" in raw or "\\" in raw or "://" in raw else 0.0
            density = sum(w in STOP_WORDS for w in words) / max(1, len(words))
            if linked > links:
                label = "bad"
            elif len(visible) < short:
                label = "?" if density < high else "good?"
            elif density >= high:
                label = "good" if len(visible) > long else "good?"
            else:
                label = "good?" if density >= low else "bad"
            out.append(Block(label, m.start(), m.end(), raw))
        if e.kind:
            out.append(Block(e.kind, e.start, e.end, e.text if e.kind != "code_block" else text[e.start : e.end]))
        at = max(at, e.end)

    parts = settled(parts, bare)
    kinds = {e.start: e.kind for e in parts}
    out = [b._replace(label=kinds[b.start]) if b.label == UNSURE and b.start in kinds else b for b in out]
    structural = ("heading", "list_item", "code_block", "formula")
    decided = [b.label if b.label in ("good", "bad") else "good" if b.label in structural else None for b in out]
    before, after = [None] * len(out), [None] * len(out)
    for order, near in ((range(len(out)), before), (range(len(out) - 1, -1, -1), after)):
        last = None
        for i in order:
            near[i] = last
            last = decided[i] or last
    for i, b in enumerate(out):
        if b.label in ("?", "good?"):
            near = {before[i], after[i]} - {None}
            bad = near == {"bad"} if b.label == "good?" else "bad" in near and "good" not in near
            out[i] = b._replace(label="bad" if bad else "good")
    return Labelled(parts, out)


def blocks(text: str | None, **limits: float) -> list[Block]:
    """All blocks of a text with their labels, after both passes, their inline markup taken off."""
    return [b if b.label in ("heading", "list_item", "code_block", "formula") else b._replace(text=plain(b.text)) for b in labelled(text, **limits).blocks]


def clean(text: str | None, found: Labelled | None = None) -> str:
    """Clean text: headings as "#" lines, items as "-" lines, code fenced, formulas in dollars, boilerplate left out."""
    found = found or labelled(text)
    level = {e.start: e.level for e in found.elements if e.kind == "heading"}
    lines = []
    for b in found.blocks:
        if b.label == "heading":
            lines.append("#" * level.get(b.start, 1) + " " + b.text)
        elif b.label == "list_item":
            lines.append("- " + b.text)
        elif b.label == "code_block":
            lines.append("```\n" + code_body(b.text) + "\n```")
        elif b.label == "formula":
            lines.append("$$" + b.text + "$$")
        elif b.label in ("good", "table") and (value := plain(b.text)):
            lines.append(value)
    return "\n\n".join(lines)


def code_body(raw: str) -> str:
    """The lines of a code block without its fences, tags or environment."""
    if m := re.match(rf"<(pre|syntaxhighlight|source)\b{ATTRS}>(.*?)(?:</\1\s*>|\Z)", raw, re.S | re.I):
        body = m[2]
        return (entities(TAG.sub("", body)) if m[1].lower() == "pre" else body).strip("\n")
    if m := re.match(r"\\begin\{(\w+)\*?\}(?:\[[^\]\n]*\])?(.*?)(?:\\end\{\1\*?\}|\Z)", raw, re.S):
        return m[2].strip("\n")
    if m := re.match(r"[ ]{0,3}(`{3,}|~{3,})[^\n]*\n?(.*?)(?:\n[ ]{0,3}\1[`~]*[ \t]*)?\Z", raw, re.S):
        return m[2].strip("\n")
    return re.sub(r"(?m)^(?:[ ]{4}|\t)", "", raw).strip("\n")


def _elements(id_col: str, text_col: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, text in zip(batch[id_col], batch[text_col], strict=True):
                ordinal: dict[str, int] = {}
                for e in labelled(text).elements:
                    ordinal[e.kind] = ordinal.get(e.kind, 0) + 1
                    rows.append((key, e.kind, ordinal[e.kind], e.level, e.start, e.end, e.text))
            yield pd.DataFrame(rows, columns=["id", "element", "ordinal", "level", "start", "stop", "plain_text"])

    return run


def structural_elements(df: DataFrame, *, id_col: str = "note_id", text_col: str = "content") -> DataFrame:
    """(id, element, ordinal, level, start, stop, plain_text) of each text's present state.

    df has id_col, text_col and mtime; other columns are ignored. A repeated id is one text (greatest mtime, then
    read_at). Null and empty texts and a null id give no rows; so does an empty table. An unclosed fence, comment or
    environment runs to the end of the text.
    """
    kind = dict(df.dtypes)[id_col]
    return latest(df, id_col, text_col).mapInPandas(_elements(id_col, text_col), f"id {kind}, element string, ordinal int, level int, start int, stop int, plain_text string")


def clean_texts(df: DataFrame, *, id_col: str = "note_id", text_col: str = "content") -> DataFrame:
    """(id, clean_text, blocks, dropped) of each text's present state; null and empty texts come out empty."""
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = list(map(labelled, batch[text_col]))
            texts = [clean(t, x) for t, x in zip(batch[text_col], found, strict=True)]
            yield pd.DataFrame({"id": batch[id_col], "clean_text": texts, "blocks": [len(x.blocks) for x in found], "dropped": [sum(b.label == "bad" for b in x.blocks) for x in found]})

    return latest(df, id_col, text_col).mapInPandas(run, f"id {kind}, clean_text string, blocks int, dropped int").select("id", F.coalesce("clean_text", F.lit("")).alias("clean_text"), "blocks", "dropped")
