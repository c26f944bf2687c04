"""PDF text layers and office files, built by hand."""

from __future__ import annotations

import io
import zipfile
import zlib

import pytest

from fathomline.operators import convert, reading
from fathomline.sources import pdf


def made(pages, *, packed=False, fonts="", extra=b"", kids=None):
    """A PDF file with a content stream a page."""
    out = [b"%PDF-1.5\n1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n"]
    refs = kids or " ".join(f"{10 + 2 * i} 0 R" for i in range(len(pages)))
    out.append(f"2 0 obj\n<< /Type /Pages /Kids [{refs}] /Count {len(pages)} >>\nendobj\n".encode())
    for i, content in enumerate(pages):
        data = zlib.compress(content) if packed else content
        out.append(f"{10 + 2 * i} 0 obj\n<< /Type /Page /Parent 2 0 R /Contents {11 + 2 * i} 0 R /Resources << /Font << {fonts} >> >> >>\nendobj\n".encode())
        out.append(f"{11 + 2 * i} 0 obj\n<< /Length {len(data)}{' /Filter /FlateDecode' if packed else ''} >>\nstream\n".encode() + data + b"\nendstream\nendobj\n")
    return b"".join([*out, extra, b"%%EOF\n"])


def test_plain_and_packed_pages():
    one, two = b"BT /F1 12 Tf 72 700 Td (Hello \\(world\\)\\041) Tj 0 -14 Td [(sp) 20 (lit) -400 (word)] TJ ET", b"BT (caf\\351 ) Tj <41> Tj T* (next) Tj ET"
    for packed in (False, True):
        assert pdf.page_texts(made([one, two], packed=packed)) == ["Hello (world)!\nsplit word", "café A\nnext"]
    assert pdf.page_texts(made([one, two], kids="12 0 R 10 0 R"))[1].startswith("Hello")  # the tree's order counts


def test_fonts_with_a_map_and_object_streams():
    cmap = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 2 beginbfchar <0001> <0048> <0002> <00660069> endbfchar 1 beginbfrange <0010> <0012> <0061> endbfrange"
    extra = b"30 0 obj\n<< /Type /Font /Subtype /Type0 /ToUnicode 31 0 R >>\nendobj\n31 0 obj\n<< /Length 1 >>\nstream\n" + cmap + b"\nendstream\nendobj\n"
    assert pdf.page_texts(made([b"BT /F1 9 Tf <000100020010> Tj ET"], fonts="/F1 30 0 R", extra=extra)) == ["Hfia"]
    inner = b"40 0 " + b"<< /Type /Font /ToUnicode 31 0 R >>"
    packed = zlib.compress(inner)
    extra = b"31 0 obj\n<< >>\nstream\n" + cmap + b"\nendstream\nendobj\n50 0 obj\n<< /Type /ObjStm /N 1 /First 5 /Filter /FlateDecode >>\nstream\n" + packed + b"\nendstream\nendobj\n"
    assert pdf.page_texts(made([b"BT /F1 9 Tf <00120011> Tj ET"], fonts="/F1 40 0 R", extra=extra)) == ["cb"]


def test_files_without_text(spark):
    odd = {"a.pdf": made([b"q 1 0 0 1 0 0 cm /Im0 Do Q"]), "b.pdf": b"hello", "c.pdf": made([b"BT (x) Tj ET"], extra=b"trailer << /Encrypt 9 0 R >>"), "d.pdf": None, "e.pdf": made([b"BT (one) Tj ET", b"", b"BT (three) Tj ET"]), "f.pdf": b"%PDF-1.4\n" + bytes(range(256)) * 50}
    found = pdf.pages(spark.createDataFrame(list(odd.items()), "path string, content binary")).collect()
    assert {r["key"]: r["reason"] for r in found if r["reason"]} == {"a.pdf": "no text layer", "b.pdf": "not a PDF file", "c.pdf": "encrypted", "d.pdf": "not a PDF file", "f.pdf": "no text layer"}
    assert [(r["page"], r["off"], r["text"]) for r in found if r["key"] == "e.pdf"] == [(1, 0, "one"), (2, 5, ""), (3, 7, "three")]
    frame = spark.createDataFrame([(k, v) for k, v in odd.items() if k == "e.pdf"], "path string, content binary")
    pages = pdf.pages(frame)
    text = pdf.texts(pages).first()["text"]
    assert text == "one\n\n\n\nthree"
    at = spark.createDataFrame([("e.pdf", text.index("three"))], "key string, off int")
    assert reading.pages_of(at, pages.select("key", "page", "off")).first()["page"] == 3
    assert [r["markdown"] for r in convert.converted(frame).collect()] == ["one\n\nthree"]


def zipped(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), text)
    return out.getvalue()


def test_sheets_and_slides():
    book = zipped(
        xl__workbook_dot_xml='<workbook xmlns:r="u"><sheets><sheet name="Two" r:id="r2"/><sheet name="One" r:id="r1"/></sheets></workbook>',
        **{"xl___rels__workbook_dot_xml_dot_rels": '<R><Relationship Id="r1" Target="worksheets/s1.xml"/><Relationship Id="r2" Target="/xl/worksheets/s2.xml"/></R>'},
        xl__sharedStrings_dot_xml="<sst><si><t>name</t></si><si><r><t>a </t></r><r><t>b</t></r></si></sst>",
        xl__worksheets__s1_dot_xml='<worksheet><sheetData><row><c t="s"><v>0</v></c><c><v>4</v></c></row><row/></sheetData></worksheet>',
        xl__worksheets__s2_dot_xml='<worksheet><sheetData><row><c t="s"><v>1</v></c><c t="inlineStr"><is><t>in</t></is></c></row></sheetData></worksheet>',
    )
    assert convert.from_xlsx(book) == "## Two\n\na b | in\n\n## One\n\nname | 4"
    deck = zipped(**{f"ppt__slides__slide{n}_dot_xml": f"<s><p><r><t>{t}</t></r></p><p/></s>" for n, t in ((10, "last"), (2, "first"))})
    assert convert.from_pptx(deck) == "## Slide 1\n\nfirst\n\n## Slide 2\n\nlast"
    with pytest.raises(convert.ConversionError):
        convert.from_xlsx(b"no zip")
