"""The text layer of PDF files, page by page, with the standard library.

Objects are found by their marks rather than by the cross-reference table, so that damaged files give what they hold.
Read are plain, Flate and hex streams, object streams, fonts with a ToUnicode map, and simple fonts in the Windows Latin
encoding; text comes in the order it is painted. Encrypted files and files without a text layer come out with a reason.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STREAM_MOST = 64 * 1024 * 1024
OBJECT = re.compile(rb"(?<!\d)(\d+)\s+\d+\s+obj\b(.*?)(?:\bendobj\b|(?=(?<!\d)\d+\s+\d+\s+obj\b)|\Z)", re.S)
STREAM = re.compile(rb"\bstream\r?\n(.*?)(?:\r?\n?endstream|\Z)", re.S)
REFERENCE = re.compile(rb"(\d+)\s+\d+\s+R\b")
TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/<>\[\]()]*|[-+]?\d*\.?\d+|[A-Za-z'\"*]+", re.S)
ESCAPE = re.compile(rb"\\(?:([0-7]{1,3})|(\r\n|\r|\n)|(.))", re.S)
NAMED = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class NoText(ValueError):
    """Why a file has no text layer that can be read."""


def _after(body: bytes, name: bytes) -> bytes:
    """What follows a name in a dictionary."""
    m = re.search(rb"/" + name + rb"(?![A-Za-z0-9])\s*", body)
    return body[m.end() :] if m else b""


def _references(value: bytes) -> list[int]:
    """The object, or the objects of the array, that a value refers to."""
    head = value[: value.find(b"]") + 1] if value.startswith(b"[") else value[:32]
    found = [int(m[1]) for m in REFERENCE.finditer(head)]
    return found if value.startswith(b"[") else found[:1] if REFERENCE.match(value) else []


def _decoded(body: bytes) -> bytes:
    m = STREAM.search(body)
    if not m:
        return b""
    data, head = m[1], body[: m.start()]
    if b"ASCIIHexDecode" in head:
        data = bytes.fromhex(re.sub(rb"[^0-9A-Fa-f]", b"", data.split(b">")[0]).decode())
    if b"FlateDecode" in head:
        try:
            data = zlib.decompressobj().decompress(data, STREAM_MOST)
        except zlib.error:
            return b""
    return data


def objects(data: bytes) -> dict[int, bytes]:
    """Each object's last body, those within object streams too."""
    found = {int(m[1]): m[2] for m in OBJECT.finditer(data)}
    for body in list(found.values()):
        if b"/ObjStm" in body:
            inner, first = _decoded(body), re.match(rb"\d+", _after(body, b"First"))
            if first:
                heads = list(map(int, re.findall(rb"\d+", inner[: int(first[0])])))
                starts = [int(first[0]) + x for x in heads[1::2]] + [len(inner)]
                for number, a, b in zip(heads[::2], starts, starts[1:], strict=False):
                    found.setdefault(number, inner[a:b])
    return found


def _pages(found: dict[int, bytes]) -> list[int]:
    """Page objects in reading order, by the page tree where there is one."""
    kids = {n: _references(_after(b, b"Kids")) for n, b in found.items() if re.search(rb"/Type\s*/Pages\b", b)}
    inside = {k for v in kids.values() for k in v}
    out: list[int] = []
    stack = sorted((n for n in kids if n not in inside), reverse=True)
    seen: set[int] = set()
    while stack:
        n = stack.pop()
        if n in seen:
            continue
        seen.add(n)
        if n in kids:
            stack += reversed(kids[n])
        elif n in found:
            out.append(n)
    return out or sorted(n for n, b in found.items() if re.search(rb"/Type\s*/Page\b(?!s)", b))


def _unicode(found: dict[int, bytes], font: bytes) -> tuple[dict[int, str], int]:
    """A font's map from codes to text, and the bytes of a code."""
    at = _references(_after(font, b"ToUnicode"))
    if not at or at[0] not in found:
        return {}, 1
    text, table = _decoded(found[at[0]]), {}
    plain = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    wide = [len(x) for x in re.findall(rb"<([0-9A-Fa-f]+)>", (re.search(rb"begincodespacerange(.*?)endcodespacerange", text, re.S) or [b"", b""])[1])]
    for part in re.findall(rb"beginbfchar(.*?)endbfchar", text, re.S):
        table |= {int(a, 16): plain(b) for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part)}
    for part in re.findall(rb"beginbfrange(.*?)endbfrange", text, re.S):
        for a, b, to in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part):
            first = plain(to)
            table |= {c: first[:-1] + chr(ord(first[-1]) + c - int(a, 16)) for c in range(int(a, 16), min(int(b, 16), int(a, 16) + 65535) + 1) if first}
    return table, max(wide, default=2) // 2


def _string(token: bytes) -> bytes:
    if token.startswith(b"<"):
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    return ESCAPE.sub(lambda m: bytes([int(m[1], 8) & 255]) if m[1] else b"" if m[2] else NAMED.get(m[3], m[3]), token[1:-1])


def painted(content: bytes, fonts: dict[bytes, tuple[dict[int, str], int]]) -> str:
    """The text a content stream paints: a new line where the position moves down, a space where it moves along."""
    lines, now, held, table = [""], [], [], ({}, 1)

    def show(data: bytes) -> None:
        codes, width = table
        if codes:
            lines[-1] += "".join(codes.get(int.from_bytes(data[i : i + width], "big"), "") for i in range(0, len(data), width))
        else:
            lines[-1] += data.decode("cp1252", "replace")

    for token in TOKEN.findall(content):
        if token[:1] in b"(<[]/" or re.fullmatch(rb"[-+]?\d*\.?\d+", token):
            held.append(token)
            continue
        if token == b"Tf" and len(held) > 1:
            table = fonts.get(held[-2], ({}, 1))
        elif token in (b"T*", b"ET") or (token in (b"Td", b"TD") and len(held) > 1 and float(held[-1])) or (token == b"Tm" and held[-6:] != now):
            now = held[-6:] if token == b"Tm" else now
            lines.append("")
        elif token in (b"Td", b"TD"):
            lines[-1] += " "
        elif token in (b"Tj", b"'", b'"') and held and held[-1][:1] in b"(<":
            if token != b"Tj":
                lines.append("")
            show(_string(held[-1]))
        elif token == b"TJ":
            for x in held:
                if x[:1] in b"(<":
                    show(_string(x))
                elif x[:1] not in b"[]/" and float(x) < -200:
                    lines[-1] += " "
        held = []
    return "\n".join(" ".join(x.split()) for x in lines if x.strip())


def page_texts(data: bytes) -> list[str]:
    """The text of each page; NoText if the file can't be read or no page has any."""
    if b"%PDF" not in data[:1024]:
        raise NoText("not a PDF file")
    if re.search(rb"/Encrypt\b", data):
        raise NoText("encrypted")
    found = objects(data)
    out = []
    for n in _pages(found):
        body = found[n]
        resources = body
        for name in (b"Resources", b"Font"):
            inner = _after(resources, name)
            at = _references(inner)
            resources = found.get(at[0], b"") if at else inner
        fonts = {b"/" + m[1]: _unicode(found, found.get(int(m[2]), b"")) for m in re.finditer(rb"/([^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R", resources)}
        out.append(painted(b"\n".join(_decoded(found.get(c, b"")) for c in _references(_after(body, b"Contents"))), fonts))
    if not any(out):
        raise NoText("no text layer")
    return out


def pages(files: DataFrame) -> DataFrame:
    """(key, page, off, text, reason) of PDF files (path, content): a row a page, from 1, off being where its text starts
    among all pages joined by a blank line; of a file without text one row with the reason."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    off = 0
                    for n, text in enumerate(page_texts(bytes(content) if content is not None else b""), 1):
                        rows.append((path, n, off, text, None))
                        off += len(text) + 2
                except Exception as error:  # one damaged file must not end a run over millions
                    rows.append((path, None, None, None, str(error) or type(error).__name__))
            yield pd.DataFrame(rows, columns=["key", "page", "off", "text", "reason"]).astype({"page": "Int32", "off": "Int32"})

    return files.select("path", "content").mapInPandas(run, "key string, page int, off int, text string, reason string")


def texts(found: DataFrame) -> DataFrame:
    """(key, text) of pages(): each file's pages joined by a blank line."""
    listed = F.sort_array(F.collect_list(F.struct("page", "text")))
    return found.where("reason is null").groupBy("key").agg(F.array_join(F.transform(listed, lambda x: x["text"]), "\n\n").alias("text"))
