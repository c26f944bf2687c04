from __future__ import annotations

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from fathomline.operators import convert, files, history, prose, reading
from fathomline.sources.folder import corpus, walk
from fathomline.sources.notes import Changed, Notes


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("x")).first()["x"]


def test_cleaning(spark):
    assert one(spark, "a ![[x.png|300]] b\n\n\n\nc ![alt](u.png)", prose.without_images) == "a  b\n\nc "
    assert one(spark, "before\n![](a.png)\n<details><summary>x</summary>y</details>\nafter", prose.without_images) == "before\n\nafter"
    assert one(spark, "x $a^2$ y \\alpha z", prose.without_math).split() == ["x", "y", "z"]
    assert one(spark, "aaaaaaa 100000 ######", prose.collapse_runs) == "a 100000 ######"
    assert one(spark, "1. Größe der Scalabilità!", prose.clean_tag) == "groe-der-scalabilita"
    body = one(spark, "---\na: 1\n---\nsee [[One|two]] and [text](http://u.v) at http://x.y `code` &amp; ^abcd1\n```\nfence\n```\n", lambda c: prose.clean_body(c, fences=True))
    assert body.split() == ["see", "One", "two", "and", "text", "at", "&"]
    assert one(spark, "see doi 10.1234/abc.def, and arXiv: 2401.01234v2", prose.doi) == "10.1234/abc.def"
    assert one(spark, "arXiv: 2401.01234v2", prose.arxiv) == "2401.01234v2"
    assert one(spark, "x\n## Hello, World 2\n", prose.slug) == "hello-world-2"
    assert one(spark, "a\\nb", prose.unescaped_body) == "a\nb" and one(spark, "a\\nb\nc", prose.unescaped_body) == "a\\nb\nc"


@pytest.mark.parametrize(("text", "lang"), [("the cat and the dog of the house", "english"), ("il gatto e il cane della casa", "italian"), ("der Hund und die Katze sind nicht da", "german"), ("", "english"), ("кошка и собака не в доме", "russian")])
def test_language(spark, text, lang):
    assert one(spark, text, prose.detected) == lang


def test_segments():
    md = "# A\n" + "x" * 30 + "\n\n" + "y" * 30 + "\n# References\nr1\n# B\nz\n```\n# no heading\n```\n"
    got = prose.segments(md, 50)
    assert "".join(s for s, _ in got) == md
    assert [k for _, k in got] == ["", "", "references", ""]
    assert prose.segments("", 10) == [("", "")]
    assert prose.respaced("one,two `x` $a,b$\n```\na,b\n```\n") == "one, two `x` $a,b$\n```\na,b\n```\n"


def test_front_matter():
    assert prose.split_front("---\na: 1\n---\nbody") == ({"a": 1}, "a: 1", "body")
    assert prose.split_front("---\n\n---\nbody")[0] in ({}, None)
    assert prose.split_front("---\n- a\n---\nb")[0] is None and prose.split_front("---\na: [\n---\nb")[1] == "a: ["
    assert prose.split_front("no block")[1] is None
    assert prose.aliases("---\nalias: one, two\n---\n") == ["one", "two"]
    added = prose.add_alias("---\nalias: one\n---\nx", "Two")
    assert prose.aliases(added) == ["one", "Two"] and prose.add_alias(added, "TWO") == added
    assert prose.tag_issues("---\ntags: [Good Tag, fine]\n---\n") == ["tag 'Good Tag' not normalized -> 'good-tag'"]


def test_transcript(spark):
    vtt = "WEBVTT\n\n1\n00:00:01.000 --> 00:00:02.000\n<v A>Hello\n\n2\n00:00:02.000 --> 00:00:03.000\nHello\nworld\n\n3\n00:00:09.000 --> 00:00:10.000\nBye &amp; go"
    spoken = prose.cues(spark.createDataFrame([("k", vtt)], "key string, text string"))
    assert [r["line"] for r in spoken.orderBy("n").collect()] == ["Hello", "world", "Bye & go"]
    assert [r["text"] for r in prose.paragraphs(spoken, 3.0).orderBy("paragraph").collect()] == ["Hello\nworld", "Bye & go"]


def test_html_markdown():
    page = "<head><title>no</title></head><h1>T &amp; x</h1><p>a <b>b</b><br>c</p><ul><li>one<li>two</ul><table><tr><td>x</td><td>y</td></tr><tr><td>z</td></tr></table><pre>k\n  v</pre><script>if(a<b){}</script>"
    assert convert.html_markdown(page) == "# T & x\n\na b c\n\n- one\n- two\n\nx | y\nz\n\n```\nk\n  v\n```"


def zipped(**members):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for name, data in members.items():
            z.writestr(name.replace("__", "/").replace("_x", ".x"), data)
    return buf.getvalue()


def test_documents(spark):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    docx = io.BytesIO()
    with zipfile.ZipFile(docx, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>Body</w:t></w:r></w:p></w:body></w:document>')
        z.writestr("docProps/core.xml", '<c xmlns:dc="d" xmlns:t="t"><dc:title>My title</dc:title><dc:creator>Me</dc:creator><t:created>2024-04-02T09:00:00Z</t:created></c>')
    epub = io.BytesIO()
    with zipfile.ZipFile(epub, "w") as z:
        z.writestr("META-INF/container.xml", '<c><rootfiles><rootfile full-path="o/p.opf"/></rootfiles></c>')
        z.writestr("o/p.opf", '<p><manifest><item id="b" href="b.html"/><item id="a" href="a.html"/></manifest><spine><itemref idref="a"/><itemref idref="b"/></spine></p>')
        z.writestr("o/a.html", "<h1>A</h1>")
        z.writestr("o/b.html", "<p>B</p>")
    fb2 = b"<FictionBook><body><section><title><p>T</p></title><p>x</p></section></body></FictionBook>"
    rows = [("a.docx", docx.getvalue()), ("b.epub", epub.getvalue()), ("c.fb2", fb2), ("d.pdf", b"%PDF"), ("d.doc", b"x"), ("e.docx", b"junk"), ("f.fb2", b"<!DOCTYPE x><a/>"), ("g.rtf", rb"{\rtf1 Hello\par World}"), ("h.html", None)]
    got = {r["path"]: r for r in convert.converted(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got["a.docx"]["markdown"] == "# Head\n\nBody" and (got["a.docx"]["title"], got["a.docx"]["authors"], got["a.docx"]["date"]) == ("My title", "Me", "2024-04-02")
    assert got["b.epub"]["markdown"] == "# A\n\nB"
    assert got["c.fb2"]["markdown"].split() == ["##", "T", "x"]
    assert got["d.pdf"]["reason"] == "no text layer" and got["d.doc"]["reason"] == "no converter for .doc" and got["e.docx"]["reason"] == "not a zip file" and "document type" in got["f.fb2"]["reason"]
    assert got["g.rtf"]["markdown"] == "Hello\n\nWorld" and got["h.html"]["reason"] == "no text in the file"


def test_walk_and_ignore(spark, tmp_path):
    for p, t in {"a.md": "# A\r\ntext", "_b.md": "b", ".git/x": "h", "node_modules/y.js": "n", "docs/b c.txt": "plain", "secret/z.md": "s", "raw.bin": "a\0b"}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(t.encode())
    found = walk(spark, str(tmp_path), rules=["secret", "*.log", "# comment"])
    rows = {r["path"]: (r["excluded"], r["reason"]) for r in found.select("path", "excluded", "reason").collect()}
    assert rows == {"a.md": (False, None), "_b.md": (False, None), ".git/": (True, "hidden"), "node_modules/": (True, "ignore rule"), "docs/b c.txt": (False, None), "secret/": (True, "ignore rule"), "raw.bin": (False, None)}
    assert {r["key"]: r["text"] for r in corpus(found).collect()} == {"a.md": "# A\ntext", "_b.md": "b", "docs/b c.txt": "plain"}


def test_statuses(spark):
    listed = spark.createDataFrame([(p, 1, 1.0) for p in ("a.md", "b.md", "c.pdf", "d.docx", "e.docx", "e.md", "f.pdf", "g.png", "h.md", "noext", "k.py")], "path string, bytes int, mtime double")
    state = spark.createDataFrame([("a.md", 1.0, "indexed", None), ("b.md", 0.5, "indexed", None), ("c.pdf", 1.0, "skipped", "no text layer"), ("f.pdf", 1.0, "indexed", None), ("h.md", 1.0, "failed", "broken"), ("e.md", 1.0, "indexed", None), ("k.py", 1.0, "indexed", None)], "key string, mtime double, outcome string, reason string")
    got = {r["path"]: (r["status"], r["reason"]) for r in files.statuses(listed, state, code=True).collect()}
    assert got["a.md"] == ("indexed", None) and got["b.md"] == ("changed", None) and got["c.pdf"] == ("unconverted", "no text layer")
    assert got["d.docx"][0] == "unconverted" and got["e.docx"] == ("excluded", "converted: e.md") and got["f.pdf"] == ("indexed", None)
    assert got["g.png"] == ("excluded", "not indexed: .png") and got["h.md"] == ("failed", "broken") and got["noext"][1] == "not indexed: no extension" and got["k.py"][0] == "indexed"
    page = files.inventory_page(files.statuses(listed, state), offset=1, limit=2).collect()
    assert [r["path"] for r in page] == ["b.md", "c.pdf"] and page[0]["total"] == 11 and page[0]["truncated"]


def test_paths_and_since(spark):
    assert files.contained("a/./b/../c.md") == "a/c.md"
    for bad in ("../x", "/etc/passwd", "a/../..", ".", "C:/x"):
        with pytest.raises(ValueError):
            files.contained(bad)
    df = spark.createDataFrame([("a", 1767225600.0), ("b", 1767225601.0)], "p string, mtime double")
    assert [r["p"] for r in files.since(df, "2026-01-01T00:00:00+00:00").collect()] == ["b"]
    with pytest.raises(ValueError):
        files.since(df, "yesterday")


def test_reading(spark):
    text = "intro\n# One\nbody\n## Sub\nmore\n```\n# no\n```\nSet\n===\nend\n# One\nagain"
    df = spark.createDataFrame([("k", text)], "key string, text string")
    assert [(r["level"], r["title"], r["line"]) for r in reading.headings(df).orderBy("line").collect()] == [(1, "One", 2), (2, "Sub", 4), (1, "Set", 9), (1, "One", 12)]
    sub = reading.section_by_title(df, "SUB").first()
    assert sub["section"] == "## Sub\nmore\n```\n# no\n```\n" and sub["matches"] == 1
    assert {r["matches"] for r in reading.section_by_title(df, "one").collect()} == {2}
    cut = reading.line_slice(df, 2, None, 12).first()
    assert (cut["text"], cut["last"], cut["next_start"]) == ("# One\nbody", 3, 4)
    whole = reading.line_slice(df, 1, 3).first()
    assert whole["next_start"] is None and whole["text"] == "intro\n# One\nbody"
    pages = spark.createDataFrame([("k", 1, 0), ("k", 2, 10)], "key string, page int, off int")
    at = spark.createDataFrame([("k", 9), ("k", 10), ("k", 50)], "key string, off int")
    assert sorted((r["off"], r["page"]) for r in reading.pages_of(at, pages).collect()) == [(9, 1), (10, 2), (50, 2)]


def test_notes(spark, tmp_path):
    n = Notes(spark, str(tmp_path / "notes"))
    v = n.write("a.md", "one")
    mark = n.snapshot()
    with pytest.raises(Changed):
        n.write("a.md", "x", create_only=True)
    with pytest.raises(Changed):
        n.write("a.md", "x", expect_version="000000000000")
    n.write("a.md", "two", expect_version=v)
    n.append("b.md", "new")
    n.set_property("b.md", "tags", ["x"])
    n.move("b.md", "c.md")
    assert {r["path"] for r in n.state().collect()} == {"a.md", "c.md"}
    ops = {r["path"]: r["operation"] for r in n.restore(mark).collect()}
    assert ops == {"a.md": "restore_version", "c.md": "delete_created"}
    assert {r["path"]: r["text"] for r in n.state().collect()} == {"a.md": "one"}


def test_drift(spark):
    log = spark.createDataFrame([("c1", 10, "src/a.py"), ("c2", 20, "src/b.py"), ("c2", 20, "lib/x.py"), ("c3", 30, "hub.py"), ("c0", 15, "docs/r1.md")], "sha string, at long, path string")
    records = spark.createDataFrame([("docs/r1.md", "src", 0.0), ("docs/r1.md", "hub.py", 0.0), ("docs/r2.md", "hub.py", 5.0), ("docs/r3.md", "hub.py", 5.0), ("docs/r2.md", "lib/x.py", 5.0)], "record string, path string, mtime double")
    assert {r["record"]: r["commits"] for r in history.drift(log, records).collect()} == {"docs/r1.md": 1, "docs/r2.md": 1}


def test_concept_sections_and_served(spark):
    df = spark.createDataFrame([("k", "# A\nx\n## Cats and dogs\n![[i/a.png|3]] ![](b/c.jpg) ![[i/a.png]]\n### deep\ny\n## Next\nz")], "key string, text string")
    assert reading.concept_sections(df, "dogs").first()["section"].startswith("## Cats") and "Next" not in reading.concept_sections(df, "dogs").first()["section"]
    assert reading.concept_sections(df, "dog").count() == 0
    assert [r["image"] for r in reading.section_images(df, "cats").collect()] == ["a.png", "c.jpg"]
    have = spark.createDataFrame([("a.md",), ("b.pdf",), ("b.md",), ("c.pdf",)], "path string")
    asked = spark.createDataFrame([("a.md",), ("b.pdf",), ("c.pdf",), ("d.md",)], "path string")
    assert {r["path"]: (r["served"], r["reason"]) for r in reading.served(have, asked).collect()} == {"a.md": ("a.md", None), "b.pdf": ("b.md", None), "c.pdf": (None, "unconverted"), "d.md": (None, "not_found")}
    assert convert.relinked("![x](img/a.png) ![](no.png)", {"a.png": "n-a.png"}) == "![[n-a.png]] ![](no.png)"


def test_write_boundary_and_vectors(spark, tmp_path):
    from fathomline.operators import dense

    n = Notes(spark, str(tmp_path / "n"), within="Inbox")
    with pytest.raises(ValueError):
        n.write("other/a.md", "x")
    assert n.write("Inbox/a.md", "x", properties={"tags": ["t"]}) and n.one("Inbox/a.md")[0] == "---\ntags:\n- t\n---\n\nx"
    v = spark.createDataFrame([("a", 0, 1.0, [1, 2], 0.5)], "key string, off int, mtime double, codes array<tinyint>, scale float")
    dense.save(v, str(tmp_path / "v"), model="m1")
    assert dense.load(spark, str(tmp_path / "v"), model="m1").count() == 1 and dense.load(spark, str(tmp_path / "v"), model="m2").count() == 0


def test_hidden_paths_and_code_root(spark):
    paths = spark.createDataFrame([(p,) for p in ("sources/a.md", "w/sources/b.md", "W/sources/c.md", "/sources/d.md", "inbox/e.md", "w\\Inbox\\f.md", "log.md", "x/log.md", "notes/g.md")], "path string")
    col = F.col("path")
    got = {r["path"]: (r["s"], r["i"], r["a"]) for r in paths.select("path", files.is_source_leaf(col, "w").alias("s"), files.is_inbox(col, "w").alias("i"), files.is_artifact(col).alias("a")).collect()}
    assert [p for p, x in got.items() if x[0]] == ["sources/a.md", "w/sources/b.md", "/sources/d.md"]
    assert [p for p, x in got.items() if x[1]] == ["inbox/e.md", "w\\Inbox\\f.md"] and [p for p, x in got.items() if x[2]] == ["log.md"]
    assert files.as_note("a/./b") == "a/b.md" and files.as_note("a.md") == "a.md"
    assert files.code_root("/r/docs", ["/r", "/r/other"], False) == ("/r", None) and files.code_root("/r", ["/r"], True) == ("/r", None)
    assert files.code_root("/r/docs", ["/r"], True)[0] is None and files.code_root("/x", ["/r"], False) == (None, None)


def test_units_and_state_of_vectors(spark):
    from fathomline.operators import dense

    docs = spark.createDataFrame([("a/n.md", "# Bare\n\n## Three\n\nplain words follow\n", 1.0)], "key string, text string, mtime double")
    units = dense.section_units(docs)
    assert [r["unit"] for r in units.collect()] == ["n › Three\n## Three\n\nplain words follow\n"]
    made = dense.embed(units)
    assert dense.state(None, docs) == "off" and dense.state(made, docs) == "ready"
    assert dense.state(made.limit(0), docs) == "no_vectors" and dense.state(made, docs.unionByName(docs.withColumn("key", F.lit("b.md")))) == "stale"
