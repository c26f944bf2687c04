"""Comment, string, declaration and body spans of source files, for Python and the brace languages."""

from __future__ import annotations

import re
from bisect import bisect_right
from typing import NamedTuple

# File endings and the language they mean; words before a parenthesis that declare no function.
ENDINGS = {
    "py": "python", "pyi": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "ts": "typescript",
    "tsx": "typescript", "mts": "typescript", "java": "java", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hpp": "cpp",
}
NO_FUNCTION = frozenset("if for while switch catch return new else do try throw typeof sizeof delete await yield case with synchronized assert".split())

PY_TOKEN = re.compile(r"""(?P<s>[rRbBuUfF]{0,2}(?:\"{3}(?:[^\\]|\\.)*?(?:\"{3}|\Z)|'{3}(?:[^\\]|\\.)*?(?:'{3}|\Z)|"(?:[^"\\\n]|\\.)*(?:"|$|\Z)|'(?:[^'\\\n]|\\.)*(?:'|$|\Z)))|(?P<c>\#[^\n]*)""", re.S | re.M)
C_TOKEN = re.compile(
    r"""(?P<c>//[^\n]*|/\*.*?(?:\*/|\Z))
      |(?P<s>"(?:[^"\\\n]|\\.)*(?:"|$|\Z)|'(?:[^'\\\n]|\\.)*(?:'|$|\Z)|`(?:[^`\\]|\\.)*(?:`|\Z)|(?<=[(,=:\[!&|?{};])[ \t]*/(?![*/ ])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*)
      |(?P<p>^[ \t]*\#[^\n]*(?:\\\n[^\n]*)*)""",
    re.S | re.M | re.X,
)


class Span(NamedTuple):
    kind: str  # comment, string
    start: int
    end: int


class Function(NamedTuple):
    name: str
    line: int  # of the declaration, its decorators or annotations included; from 1
    head_line: int  # of the declaration itself
    end_line: int
    header: str
    doc: str | None  # docstring, without its quotes


def normalise(text: str | None) -> str:
    return re.sub(r"\r\n?", "\n", text or "")


def language(path: str | None, declared: str | None = None) -> str:
    """By the file's ending, else by what is declared, else empty."""
    ending = (path or "").rpartition("/")[2].rpartition(".")[2].lower()
    return ENDINGS.get(ending) or (declared or "").strip().lower()


def lex(text: str, lang: str) -> tuple[str, list[Span]]:
    """text with strings, comments and preprocessor lines blanked (a string keeps a quote at its start), and their spans."""
    spans, out, at = [], [], 0
    for m in (PY_TOKEN if lang == "python" else C_TOKEN).finditer(text):
        kind = m.lastgroup
        if kind == "p" and lang not in ("c", "cpp"):
            continue
        spans.append(Span({"c": "comment", "s": "string", "p": "directive"}[kind], m.start(), m.end()))
        blank = re.sub(r"[^\n]", " ", m[0])
        out += [text[at : m.start()], '"' + blank[1:] if kind == "s" else blank]
        at = m.end()
    out.append(text[at:])
    return "".join(out), spans


class Lines:
    def __init__(self, text: str) -> None:
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]

    def of(self, offset: int) -> int:
        return bisect_right(self.starts, offset)


def _depths(masked: str) -> list[int]:
    """Bracket depth at the start of each line."""
    depth, out = 0, [0]
    for c in re.findall(r"[\n()\[\]{}]", masked):
        if c == "\n":
            out.append(depth)
        else:
            depth = max(0, depth + (1 if c in "([{" else -1))
    return out


class Rows(NamedTuple):
    """A file's lines, masked and as they are, and the bracket depth at the start of each: made once a file."""

    masked: list[str]
    raw: list[str]
    depth: list[int]

    @classmethod
    def of(cls, masked: str, text: str) -> Rows:
        return cls(masked.split("\n"), text.split("\n"), _depths(masked))


def python_end(file: Rows, line: int) -> int:
    """Last line of the Python declaration whose first line (decorators included) is `line`."""
    rows, raw, depth = file
    at = line - 1
    while at < len(rows) - 1 and (depth[at] or not re.match(r"[ \t]*(?:async[ \t]+)?(?:def|class)\b", rows[at])):
        at += 1
    indent = len(rows[at]) - len(rows[at].lstrip()) if at < len(rows) else 0
    last, inside = at, False
    for i in range(at + 1, len(rows)):
        row = rows[i]
        if not row.strip():
            # a line within a string belongs to it; blank and comment lines wait for the next statement
            if raw[i].strip() and inside and not raw[i].lstrip().startswith("#"):
                last = i
            continue
        if depth[i] == 0 and len(row) - len(row.lstrip()) <= indent and not (row.lstrip().startswith('"') and raw[i].lstrip()[:1] not in "\"'rRbBuUfF"):
            break
        last, inside = i, True
    return last + 1


def _continued(masked: str, spans: list[Span], lines: Lines, last: int) -> int:
    """The line on which a string that is open at the end of line `last` closes."""
    if last >= len(lines.starts):
        return last
    # spans are in order and apart: only the one that reaches over the line's end can be open there
    i = bisect_right(spans, lines.starts[last] - 1, key=lambda s: s.start) - 1
    return lines.of(spans[i].end - 1) if i >= 0 and spans[i].kind == "string" and spans[i].end > lines.starts[last] else last


SIGN, BRACE = re.compile(r"[()\[\];{]"), re.compile(r"[{}]")


def brace_end(masked: str, start: int) -> int:
    """Offset of the last character of the declaration that starts at `start`: its closing brace, or its semicolon."""
    round_ = 0
    for sign in SIGN.finditer(masked, start):
        c = sign[0]
        if c in "([":
            round_ += 1
        elif c in ")]":
            round_ -= 1
        elif c == ";" and round_ <= 0:
            return sign.start()
        elif c == "{" and round_ <= 0:
            depth = 0
            for m in BRACE.finditer(masked, sign.start()):
                depth += 1 if m[0] == "{" else -1
                if not depth:
                    return m.start()
            return len(masked.rstrip()) - 1
    return max(start, len(masked.rstrip()) - 1)


def last_line(text: str, lang: str, line: int, lexed: tuple[str, list[Span]] | None = None, rows: Rows | None = None, lines: Lines | None = None) -> int:
    """The true last line of the declaration whose first line is `line`."""
    masked, spans = lexed or lex(text, lang)
    lines = lines or Lines(text)
    if line < 1 or line > len(lines.starts):
        return line
    if lang == "python":
        return _continued(masked, spans, lines, python_end(rows or Rows.of(masked, text), line))
    return lines.of(brace_end(masked, lines.starts[line - 1]))


def _python_functions(text: str, masked: str, spans: list[Span]) -> list[Function]:
    lines, file = Lines(text), Rows.of(masked, text)
    rows, _, depth = file
    strings = {s.start: s for s in spans if s.kind == "string"}
    out = []
    for m in re.finditer(r"^([ \t]*)(?:async[ \t]+)?def[ \t]+(\w+)", masked, re.M):
        head = lines.of(m.start())
        if depth[head - 1]:
            continue
        first = head
        while first > 1:
            i = first - 2
            while i > 0 and depth[i]:
                i -= 1
            if re.match(rf"{m[1]}@", rows[i]) and len(m[1]) == len(rows[i]) - len(rows[i].lstrip()):
                first = i + 1
            else:
                break
        round_, i = 0, m.end()
        while i < len(masked) and not (masked[i] == ":" and not round_):
            round_ += (masked[i] in "([{") - (masked[i] in ")]}")
            i += 1
        header, doc = text[m.start() : i].strip(), None
        body = re.compile(r"\s*").match(masked, i + 1)
        # the string's first quote stands in for its prefix
        if (s := strings.get(body.end())) and "f" not in (start := text[s.start : s.start + 2].lower().split('"')[0].split("'")[0]) and "b" not in start:
            after = text[s.end : s.end + 200].split("\n")[0]
            if not after.strip() or after.lstrip().startswith(("#", ";")):
                raw = text[s.start + len(start) : s.end]
                q = 3 if raw[:3] in ('"""', "'''") else 1
                doc = raw[q:-q] if len(raw) >= 2 * q else raw[q:]
        out.append(Function(m[2], first, head, _continued(masked, spans, lines, python_end(file, head)), header, doc))
    return out


ARROW = re.compile(r"(?:\b(?:const|let|var)\s+|(?:^|[\s;]))(?:[\w$]+\.)*([\w$]+)\s*(?::[^=]*)?=\s*(?:async\s*)?(?:<[^()]*>\s*)?(?:\((?:[^()]|\([^()]*\))*\)|[\w$]+)\s*(?::[^={}]*)?=>\s*$", re.S)
EXPRESSION = re.compile(r"([\w$]+)\s*(?::[^=]*)?=\s*(?:async\s+)?function\b\s*\*?\s*[\w$]*\s*\((?:[^()]|\([^()]*\))*\)\s*(?::[^{}]*)?$", re.S)
CALLABLE = re.compile(r"(?:^|[\s*&>~#:.])((?:operator\s*\S{1,2}|[\w$~]+))\s*(?:<[^()<>]*>)?\s*\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)\s*(?:(?:const|noexcept|override|final|volatile|mutable)\b\s*)*(?::\s*[^{}=;]*|->\s*[^{}=;]*|throws\s+[\w.,\s]+)?$", re.S)
CONTAINER = re.compile(r"\b(?:class|interface|enum|struct|union|namespace|module|trait|record)\b[^()=]*$|\bextern\s*\"\s*$|^\s*(?:export\s+)?namespace\b")
WORDS = re.compile(r"^\s*(?:@[\w.]+(?:\s*\((?:[^()]|\([^()]*\))*\))?\s*)*")


LOCAL = re.compile(
    r"^[ \t]*(?:(?:export[ \t]+)?(?:default[ \t]+)?(?:async[ \t]+)?function\b\s*\*?\s*([\w$]+)\s*(?:<[^()]*>\s*)?\((?:[^()]|\([^()]*\))*\)"
    r"|(?:export[ \t]+)?(?:const|let|var)\s+([\w$]+)\s*(?::[^=;{}]*)?=\s*(?:async\s*)?(?:<[^()]*>\s*)?(?:\((?:[^()]|\([^()]*\))*\)|[\w$]+)\s*(?::[^={};]*)?=>)",
    re.M,
)
PURE = re.compile(r"=\s*(?:0|default|delete)\s*$")


def _bodiless(head: str, lang: str, inside: bool) -> re.Match | None:
    """The name in a declaration that ends in ';': a prototype, or an interface's or abstract method.

    Outside a class it needs a type before its name (in JavaScript and TypeScript, `function`), or it is a call.
    """
    head = PURE.sub("", head)
    found = CALLABLE.search(head)
    if not found or found[1] in NO_FUNCTION or "=" in (before := head[: found.start(1)]) or re.search(r"\b(?:return|new|throw|case|typedef|using|delete|await|else|goto)\b", before):
        return None
    script = lang in ("javascript", "typescript")
    typed = re.search(r"\bfunction\b", before) if script else re.search(r"\w[\s*&>\]]*(?:[\w$]+::)*\s*$", before)
    first = re.match(r"\s*(?:<[^()<>]*>)?\s*\(\s*([^\s)]?)", head[found.end(1) :])
    return found if (inside or typed) and not (first and re.match(r"[\d\"'-]", first[1])) else None


def _expression_end(masked: str, at: int) -> int:
    """Offset of the last character of the arrow function's expression that begins at `at`."""
    depth, i = 0, at
    while i < len(masked):
        c = masked[i]
        depth += (c in "([{") - (c in ")]}")
        if depth < 0 or not depth and c in ";,":
            return i if c == ";" else i - 1
        if c == "\n" and not depth and masked[at:i].strip() and not re.match(r"\s*[.?:&|+*/=<>,)-]", masked[i:]) and not re.search(r"[.?:&|+*/=<>-]\s*$", masked[at:i]):
            return i - 1
        i += 1
    return len(masked) - 1


def declarations(text: str, lang: str, lexed: tuple[str, list[Span]] | None = None) -> list[Function]:
    """As functions(), with those that have no body (prototypes, interface and abstract methods that end in ';'), and in
    JavaScript and TypeScript named functions within functions and call arguments and arrows to an expression."""
    masked, spans = lexed or lex(text, lang)
    if lang == "python":
        return functions(text, lang, (masked, spans))
    out, lines = _brace_functions(text, masked, lang), Lines(text)
    if lang in ("javascript", "typescript"):
        known = {(f.name, f.line) for f in out}
        ends = {(f.name, f.end_line): i for i, f in enumerate(out)}
        for m in LOCAL.finditer(masked):
            start = m.end() - len(m[0].lstrip())
            name, line = m[1] or m[2], lines.of(start)
            if (name, line) not in known:
                arrow = m[2] and not re.match(r"\s*\{", masked[m.end() :])
                end = lines.of(_expression_end(masked, m.end())) if arrow else last_line(text, lang, line, (masked, spans))
                mine, i = Function(name, line, line, end, text[start : m.end()].strip(), None), ends.get((name, end))
                if i is None:
                    out.append(mine)
                elif re.search(r"[^\s\w]", masked[lines.starts[out[i].line - 1] : start]):
                    out[i] = mine  # a statement without ';' stood before it
    return sorted(out, key=lambda f: f.line)


def _brace_functions(text: str, masked: str, bodiless: str = "") -> list[Function]:
    """Those with a body; with a language in `bodiless`, also declarations that end in ';'."""
    lines, out = Lines(text), []
    stack: list[tuple[bool, int]] = []  # may declare functions; index in out, or -1
    begin, round_ = 0, 0
    for m in re.finditer(r"[{};()]", masked):
        c = m[0]
        if c == "(":
            round_ += 1
        elif c == ")":
            round_ = max(0, round_ - 1)
        elif round_ and c in ";":
            continue
        elif c == "{":
            if round_:
                stack.append((False, -2))
                continue
            head = masked[begin : m.start()]
            may, mine = all(s[0] for s in stack), -1
            is_container = bool(CONTAINER.search(head))
            if may and not is_container:
                found = ARROW.search(head) or EXPRESSION.search(head) or CALLABLE.search(head)
                if found and found[1] not in NO_FUNCTION and not re.search(r"\b(?:return|new|throw|case)\b[^()]*$", head[: found.start(1)]):
                    start = begin + len(head) - len(head.lstrip())
                    declared = start + WORDS.match(masked[start : m.start()]).end()
                    mine = len(out)
                    out.append(Function(found[1], lines.of(start), lines.of(declared), 0, text[declared : m.start()].strip(), None))
            stack.append((is_container and may, mine))
            begin = m.end()
        elif c == "}":
            if stack:
                _, mine = stack.pop()
                if mine == -2:
                    continue
                if mine >= 0:
                    out[mine] = out[mine]._replace(end_line=lines.of(m.start()))
            begin = m.end()
        elif c == ";":
            head = masked[begin : m.start()]
            if bodiless and all(s[0] for s in stack) and (found := _bodiless(head, bodiless, bool(stack))):
                start = begin + len(head) - len(head.lstrip())
                declared = start + WORDS.match(masked[start : m.start()]).end()
                out.append(Function(found[1], lines.of(start), lines.of(declared), lines.of(m.start()), text[declared : m.start()].strip(), None))
            begin = m.end()
    end = len(lines.starts)
    return [f if f.end_line else f._replace(end_line=end) for f in out]


def functions(text: str, lang: str, lexed: tuple[str, list[Span]] | None = None) -> list[Function]:
    """Functions and methods that a file declares at its top or in its classes, in order."""
    masked, spans = lexed or lex(text, lang)
    return _python_functions(text, masked, spans) if lang == "python" else _brace_functions(text, masked)


def comment_blocks(text: str, spans: list[Span], lang: str) -> list[tuple[int, int, str]]:
    """(first line, last line, text without markers) of comments that stand alone on their lines; runs of line comments are one."""
    lines = Lines(text)
    out: list[tuple[int, int, str]] = []
    run: list[str] = []
    first = last = column = 0
    for s in spans:
        if s.kind != "comment":
            continue
        a, b = lines.of(s.start), lines.of(s.end - 1)
        before = text[lines.starts[a - 1] : s.start]
        after = text[s.end : lines.starts[b] if b < len(lines.starts) else len(text)]
        if before.strip() or after.strip():
            continue
        raw = text[s.start : s.end]
        if raw.startswith("/*"):
            body = re.sub(r"(?m)^[ \t]*\*?[ \t]?", "", re.sub(r"\A/\*+!?|\**/\Z", "", raw))
            out.append((a, b, body))
            continue
        body = re.sub(r"\A(?:#+|/{2,}!?)[ \t]?", "", raw)
        if run and a == last + 1 and len(before) == column:
            run.append(body)
            out[-1] = (first, b, "\n".join(run))
        else:
            run, first, column = [body], a, len(before)
            out.append((a, b, body))
        last = b
    return out
