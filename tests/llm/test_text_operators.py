"""Languages, terms, markup, splitting, documentation: rules on small texts, and every odd input."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fathomline.llm import code, codedoc, distinct, langid, markup, split

TEXTS = {
    "english": "The committee met in the old library and agreed on a plan for the winter. Nobody knows when the next train will leave the station. We have to read the report before the meeting.",
    "italian": "Il comitato si è riunito nella vecchia biblioteca e ha deciso un piano per l'inverno. Nessuno sa quando parte il prossimo treno dalla stazione. Dobbiamo leggere la relazione prima della riunione.",
    "german": "Der Ausschuss traf sich in der alten Bibliothek und einigte sich auf einen Plan für den Winter. Niemand weiß, wann der nächste Zug vom Bahnhof abfährt. Wir müssen den Bericht vor der Sitzung lesen.",
    "swedish": "Kommittén möttes i det gamla biblioteket och enades om en plan för vintern. Ingen vet när nästa tåg avgår från stationen. Vi måste läsa rapporten före mötet.",
    "danish": "Udvalget mødtes i det gamle bibliotek og blev enige om en plan for vinteren. Ingen ved, hvornår det næste tog kører fra stationen. Vi skal læse rapporten før mødet.",
    "russian": "Комитет собрался в старой библиотеке и согласовал план на зиму. Никто не знает, когда отходит следующий поезд со станции. Мы должны прочитать отчёт до собрания.",
}


def labelled(rows):
    return [(f"{lang}{i}", lang, t) for i, (lang, t) in enumerate(rows)]


def test_labels_are_named():
    assert [langid.named(x) for x in ("EN", " English ", "Deutsch", "pt-BR", "ru", "xx", "", None, "unknown", "-")] == ["english", "english", "german", "portuguese", "russian", None, None, None, None, None]


def test_sentences_leave_out_what_is_none():
    text = "# Heading of the thing\n\nThis is a whole sentence (“un titolo citato”) here. `code is here too` term.\n\n```\nnot a sentence at all.\n```\nAnother whole one follows!"
    assert langid.sentences(text) == ["This is a whole sentence here.", "Another whole one follows!"]


def test_stretches_of_mixed_texts():
    judge = langid.Judge(langid.dictionaries([(k, v) for k, v in TEXTS.items()] * 2 + [("german", TEXTS["english"])]))
    for a, b in itertools.permutations(TEXTS, 2):
        got = [s.lang for s in langid.stretches(TEXTS[a] + "\n\n" + TEXTS[b], judge)]
        assert got == [a, b], (a, b, got)
    assert [s.lang for s in langid.stretches(TEXTS["swedish"].upper(), judge)] == ["swedish"]
    assert langid.stretches("", judge) == [] and langid.stretches(None, judge) == [] and langid.stretches("term", judge) == []


def test_language_cases(spark):
    rows = [(f"{k}{i}", k, v, 1.0) for k, v in TEXTS.items() for i in range(2)]
    rows += [("null", None, TEXTS["german"], 1.0), ("wrong", "english", TEXTS["german"], 1.0), ("code", "DE", TEXTS["german"], 1.0), ("mixed", "english", TEXTS["english"] + " " + TEXTS["italian"], 1.0)]
    rows += [("empty", "english", "", 1.0), ("none", "xx", None, 1.0), ("code", "DE", TEXTS["german"], 1.0), (None, "english", TEXTS["english"], 1.0), ("long", "english", TEXTS["english"] * 300, 1.0)]
    df = spark.createDataFrame(rows, "id string, lang string, body string, mtime double")
    got = {(r["id"], r["segment_no"]): r["found_lang"] for r in langid.language_stretches(df).where("is_case").collect()}
    assert got == {("null", 1): "german", ("wrong", 1): "german", ("mixed", 1): "english", ("mixed", 2): "italian"}
    assert langid.language_stretches(df.limit(0)).count() == 0


def test_terms_and_mixture(spark):
    assert distinct.terms("Café-CAFE\u0301 ab_c Été42 x²") == ["cafe", "cafe", "ab", "c", "ete42", "x"]
    rows = [(f"r{i}", "common word here " + "special " * (3 if i == 0 else 1 if i < 30 else 0), 1.0) for i in range(60)]
    rows += [("r0", rows[0][1], 1.0), ("null", None, 1.0), ("empty", "", 1.0), (None, "lost", 1.0), ("long", "z" * 100_000, 1.0)]
    df = spark.createDataFrame(rows, "id string, body string, mtime double").selectExpr("*", "1 AS term", "2 AS tf")
    got = {(r["id"], r["term"]): r for r in distinct.distinctive_terms(df).collect()}
    assert got["r0", "special"]["tf"] == 3 and got["r0", "special"]["df"] == 30
    assert got["r0", "special"]["score"] > got["r5", "special"]["score"]
    assert ("null", "lost") not in got and got["long", "z" * 100_000]["df"] == 1
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert distinct.distinctive_terms(df.limit(0)).count() == 0


def test_posterior_decides(spark):
    # "usual" is mentioned once in twenty records and used eight times in three; "rareword" is in two only
    rows = [(f"r{i}", "usual " * (8 if i % 20 == 0 else 1 if i % 3 == 0 else 0) + ("rareword " * 3 if i < 2 else "") + "other", 1.0) for i in range(60)]
    df = spark.createDataFrame(rows, "id string, body string, mtime double")
    elite = {(r["id"], r["term"]) for r in distinct.distinctive_terms(df, least_score=0.5).collect()}
    assert {("r0", "rareword"), ("r1", "rareword")} <= elite
    every = distinct.distinctive_terms(df).collect()
    assert {(r["id"], r["term"]) for r in every if r["score"] >= 0.5} == elite and len(elite) < len(every)
    assert ("r0", "usual") in elite and ("r3", "usual") not in elite


@pytest.mark.parametrize("total", [1, 2, 3, 5, 8, 40, 4000])
def test_posterior_of_what_few_records_repeat(total):
    """Whatever the table's size, three and more occurrences in at most five records are elite; p3_found loses none."""
    for k in range(1, min(total, 5) + 1):
        for held in itertools.combinations_with_replacement((1, 2, 3, 4, 5, 60), k):
            counts = sorted(set(held))
            got = distinct.fit(np.zeros(len(counts), int), np.minimum(np.array(counts, float), distinct.CEILING), np.array([held.count(c) for c in counts], float), total)
            assert all(score >= 0.5 for c, score in zip(counts, got, strict=True) if c >= 3), (total, held, got)


def found(text, kind=None):
    return [(e.kind, e.text) for e in markup.elements(text) if kind in (None, e.kind)]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("# A *b* `c` [d](u) #\n", [("heading", "A b c d")]),
        ("Set **ext**\n===\n", [("heading", "Set ext")]),
        ("#tag\n\\# no\n\n", []),
        ("- [x] one\n* two\n+ three\n1) four\n10. five\n", [("list_item", x) for x in ("one", "two", "three", "four", "five")]),
        ("***\n\n* * *\n\n---\n", []),
        ("```py\n\n  x  =  1\n# no\n```\n", [("code_block", "x = 1")]),
        ("~~~\na\n```\n~~~\n- b\n", [("code_block", "a"), ("list_item", "b")]),
        ("text\n\n    code $x$\n\n    more\n\nend\n", [("code_block", "code $x$")]),
        ("from $5 to $6 and $x_1$ and `$no$`\n", [("formula", "x_1")]),
        ("$$\na +  b\n$$\n", [("formula", "a + b")]),
        ("<h2\n id='a>b'>x &amp; <b>y</b></h2><ul><li>p<li>q <i>r</i></ul>", [("heading", "x & y"), ("list_item", "p"), ("list_item", "q r")]),
        ("<!-- # no\n- no --><script>'<h1>no</h1>'</script><head><title>no</title></head># no", []),
        ("<pre><code>\n a &lt; b\n</code></pre>", [("code_block", "a < b")]),
        ("== T [[A|b]] ==\n* ''i''\n** j\n: <math>x</math>\n", [("heading", "T b"), ("list_item", "i"), ("list_item", "j"), ("formula", "x")]),
        ("\\section*{A \\emph{b} R\\&D}\n\\begin{itemize}\n \\item c\n \\item \\href{u}{d}\n\\end{itemize}\n% \\section{no}\n", [("heading", "A b R&D"), ("list_item", "c"), ("list_item", "d")]),
        ("\\begin{verbatim}\n\\section{no}\n\\end{verbatim}\n\\begin{equation}\n y\n\\end{equation}\n\\(z\\)", [("code_block", "\\section{no}"), ("formula", "y"), ("formula", "z")]),
        ("---\ntitle: x\n# c\n---\n## h\r\n- i\r\n", [("heading", "h"), ("list_item", "i")]),
        ("%%# no%% Use snake_case_names, 2 * 3 * 4 and <your-name> in C:\\tex.\n", []),
        ("", []),
        (None, []),
    ],
)
def test_elements(text, expected):
    assert found(text) == expected


def test_ambiguous_lines_take_their_neighbours_markup():
    assert found("== W ==\n{|\n|}\n# one\n# two\n", "list_item") == [("list_item", "one"), ("list_item", "two")]
    assert found("## M\n\n# one\n# two\n", "heading") == [("heading", "M"), ("heading", "one"), ("heading", "two")]


def test_blocks_and_clean():
    prose_ = "This is the part of the page that the reader came for, and it says what has to be said about the matter in whole sentences. " * 3
    page = f"<div><a href='a'>home</a> <a href='b'>news</a> <a href='c'>about</a></div>\n\nLog in\n\n# Title\n\n{prose_}\n\n- item\n\n```\ncode\n```\n\n$$x$$\n\n{prose_}\n\nCopyright\n\n<a href='d'>imprint</a>\n"
    text = markup.clean(page)
    assert "home" not in text and "imprint" not in text
    assert text.index("# Title") < text.index("This is the part") < text.index("- item") < text.index("```\ncode") < text.index("$$x$$")


def test_both_passes_decide(monkeypatch):
    wiki, short = "== W ==\n{|\n|}\n# one\n# two\n", "<a href='a'>home</a>\n\nRead more\n\n<a href='b'>news</a>\n"
    kinds = lambda text: [e.kind for e in markup.labelled(text).elements]
    assert kinds(wiki) == ["heading", "list_item", "list_item"]
    assert [b.label for b in markup.blocks(short)] == ["bad", "bad", "bad"]  # the short block inherits
    assert [b.label for b in markup.blocks(short, links=2.0)] == ["good"] * 3  # without link density none is boilerplate
    monkeypatch.setattr(markup, "settled", lambda parts, bare: parts)
    assert kinds(wiki) == ["heading", markup.UNSURE, markup.UNSURE]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab #*-=`~$\n\\[](){}<>/h1li%&;|_'\t", max_size=120))
def test_markup_never_fails(text):
    for e in markup.elements(text):
        assert 0 <= e.start < e.end <= len(text)
    markup.clean(text)


def test_structural_elements_of_present_state(spark):
    rows = [(1, "old", "# Old", 1.0), (1, "new", "# New", 2.0), (2, "x", None, 1.0), (3, "y", "", 1.0), (4, "z", "# Z", 1.0), (4, "z", "# Z", 1.0), (None, "q", "# Q", 1.0), (5, "long", "- i\n" * 20_000, 1.0)]
    df = spark.createDataFrame(rows, "note_id long, element string, content string, mtime double")
    got = markup.structural_elements(df)
    assert sorted((r["id"], r["plain_text"]) for r in got.where("id < 5").collect()) == [(1, "New"), (4, "Z")]
    assert got.where("id = 5").count() == 20_000 and markup.structural_elements(df.limit(0)).count() == 0
    assert {r["id"]: r["clean_text"] for r in markup.clean_texts(df.where("note_id < 5")).collect()} == {1: "# New", 2: "", 3: "", 4: "# Z"}


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 300), st.lists(st.integers(0, 300), max_size=20), st.integers(1, 60), st.integers(0, 70))
def test_cut(size, marks, limit, overlap):
    ranks = [sorted(set(marks[::2])), sorted(set(marks[1::2]))]
    pieces = split.cut(size, ranks, limit, overlap)
    assert pieces[0][0] == 0 and pieces[-1][1] == size
    for (a, b), (c, d) in itertools.pairwise(pieces):
        assert a < c <= b < d and b - c <= overlap
    assert all(b - a <= limit for a, b in pieces)
    if size <= limit:
        assert len(pieces) == 1


def test_cut_prefers_boundaries():
    text = "First sentence here. Second one.\n\nSecond paragraph is this one, and it goes on."
    pieces = split.cut(len(text), split.text_boundaries(text), 50, 0)
    assert text[: pieces[0][1]] == "First sentence here. Second one.\n\n"
    assert split.cut_weighted([3, 3, 3, 3], [[2]], 6, 0) == [(0, 2), (2, 4)] and split.cut_weighted([9], [[]], 3, 1) == [(0, 1)]


@given(st.integers(0, 300), st.lists(st.integers(0, 300), max_size=20), st.integers(1, 60), st.integers(0, 70))
def test_cut_keeps_the_overlap(size, marks, limit, overlap):
    ranks = [sorted(set(marks[::2])), sorted(set(marks[1::2]))]
    assert all(b - c == min(overlap, limit - 1) for (_, b), (c, _) in itertools.pairwise(split.cut(size, ranks, limit, overlap)))


def test_overlap_beside_a_paragraph():
    text = "One word follows another. " * 3 + "End.\n\n" + "The next paragraph goes on and on. " * 3
    (_, end), (start, _) = split.cut(len(text), split.text_boundaries(text), 100, 30)[:2]
    assert end == text.index("The next") and start == end - 30


def test_oversized(spark):
    body = "pre\n# A\n" + "word " * 100 + "\n## B\nshort\n"
    notes = spark.createDataFrame([(1, "n.md", body, 2.0), (1, "n.md", "# X\n" + "y" * 900, 1.0), (2, "e.md", None, 1.0)], "note_id long, path string, content string, mtime double")
    py = "def small():\n    return 1\n\n\n@dec\ndef big(a,\n        b):\n    s = '''\ndef no():\n'''\n" + "    x = 1\n" * 20 + "    return s\n\nlast = 1\n"
    c = "int f(void) {\n" + '  t("}");\n' * 20 + "}\nint g;\n"
    src = spark.createDataFrame([("a.py", py, 1.0), ("a.c", c, 1.0), ("a.c", c, 1.0)], "path string, text string, mtime double")
    sym = spark.createDataFrame([("a.py", 1), ("a.py", 5), ("a.py", 5), ("a.c", 1), ("a.c", 999), ("gone.c", 1), ("a.c", None)], "path string, line int")
    limits = spark.createDataFrame([("section", "character", 100, 10), ("symbol", "line", 10, 2), ("container", "token", 5, 0)], "item_kind string, unit string, max_size int, overlap int")
    got = split.oversized_pieces(notes, src, sym, limits).collect()
    items = {(r["item_kind"], r["item_key"], r["item_start"]): r["item_size"] for r in got}
    assert items == {("section", "n.md", 4): 505, ("symbol", "a.py", 5): 27, ("symbol", "a.c", 1): 22}
    assert all(r["piece_end"] - r["piece_start"] <= (100 if r["item_kind"] == "section" else 10) for r in got)
    assert split.oversized_pieces(notes.limit(0), src.limit(0), sym.limit(0), limits).count() == 0
    assert split.oversized_pieces(notes, src, sym, limits.limit(0)).count() == 0


JS = """// Licensed under some Terms, version 2.
/** Sort the rows by owner, the newest first.
 * @param a the a
 */
export async function sortRows(a, b) { return "}"; }

/* detached comment about nothing */

const x = (y) => { if (y) { z(); } };
class K {
    // Returns what is left over after the cut.
    @Input()
    cutOff(a) { return `{`; }
    /** K */
    constructor() { /* } */ }
}
"""
PY = '''
# Licence text, all rights reserved.
@dec(1,
     2)
def load_cache(path):
    r"""Load cache. Reads the newest entry first."""
    s = """
def inner():
    """
    return s

# Moves every entry to the store.
async def move(): return 1

def plain(a): # see below
    "TODO: document"

# old = plain(1)
# return old
def dead(): pass
'''


def test_declarations_without_a_body():
    def names(text, lang):
        return [(f.name, f.line, f.end_line) for f in code.declarations(text, lang)]

    js = "const half = x => x / 2;\nconst twice = (x) =>\n  x * 2\nfunction outer() {\n  function inner(a) {\n    return a;\n  }\n  run(inner(1));\n}\nsuite(() => {\n  const low = (a) => { go(a); };\n});\nrun(outer());\n"
    assert names(js, "javascript") == [("half", 1, 1), ("twice", 2, 3), ("outer", 4, 9), ("inner", 5, 7), ("low", 11, 11)]
    assert names("interface A {\n  int size();\n  int full = size(3);\n}\nabstract class B {\n  abstract void go(int a);\n  void at() { go(1); }\n}\n", "java") == [("size", 2, 2), ("go", 6, 6), ("at", 7, 7)]
    assert names("int add(int a, int b);\nstatic int n = add(1, 2);\nSETUP(n);\nint main(void) {\n  add(1, 2);\n}\n", "c") == [("add", 1, 1), ("main", 4, 6)]
    assert names("interface A {\n  of(a: string): number;\n}\nfunction f(a: string): void;\nstart(1);\n", "typescript") == [("of", 2, 2), ("f", 4, 4)]


def test_functions():
    assert [(f.name, f.line, f.end_line) for f in code.functions(JS, "javascript")] == [("sortRows", 5, 5), ("x", 9, 9), ("cutOff", 12, 13), ("constructor", 15, 15)]
    assert [(f.name, f.line, f.end_line) for f in code.functions(PY, "python")] == [("load_cache", 3, 10), ("move", 13, 13), ("plain", 15, 16), ("dead", 20, 20)]
    assert code.last_line("class A {\n  int f() {\n  }\n}\n", "java", 1) == 4 and code.last_line("x", "c", 9) == 9
    java = "@Nullable\npublic static List<String> get(int a)\n{\n  return null;\n}\n"
    assert [(f.name, f.line, f.end_line) for f in code.functions("class Q {\n" + java + "}", "java")] == [("get", 2, 6)]


@pytest.mark.parametrize(
    ("doc", "good"),
    [
        ("Sorts rows by owner and drops the rest.", True), ("Load cache.", False), ("Loads the cache.", False), ("This function will load cache.", False), ("TODO: speed this up.", False),
        ("TODO: speed this up.\nKeeps only entries that were read twice.", True), ("@param path x\n@return the result", False), ("Copyright the authors. All rights reserved.", False),
        ("noqa: C901", False), ("eslint-disable-next-line", False), ("return cached(path);\n}", False), ("old = load(path)\nreturn old", False), ("--------", False), ("", False), (None, False),
        ("(undocumented)", False), ("Auto-generated stub", False), ("{@inheritDoc}", False), ("Divide il testo nei punti giusti.", True), ("n/a", False), ("Docstring.", False), ("see above", False),
    ],
)
def test_says_something(doc, good):
    assert codedoc.says_something(doc, "load_cache", "def load_cache(path)") is good


def test_documented(spark):
    rows = [("a.js", JS, 1.0), ("b.py", PY, 1.0), ("b.py", PY, 1.0), ("c.py", None, 1.0), ("d.py", "", 1.0), (None, PY, 1.0), ("e.py", "def (:\n'''", 1.0), ("f.c", "int f(void) {" * 2000, 1.0)]
    df = spark.createDataFrame(rows, "path string, text string, mtime double").selectExpr("*", "1 AS line")
    got = {(r["path"], r["name"]): (r["line"], r["documentation"]) for r in codedoc.documented_functions(df).collect()}
    assert set(got) == {("a.js", "sortRows"), ("a.js", "cutOff"), ("b.py", "load_cache"), ("b.py", "move")}
    assert got["b.py", "move"] == (13, "Moves every entry to the store.") and got["a.js", "sortRows"][0] == 5
    assert codedoc.documented_functions(df.limit(0)).count() == 0


def test_last_lines_against_nesting():
    rng = random.Random(4)
    for _ in range(50):
        depth, lines = 0, []
        for _ in range(rng.randint(1, 30)):
            if depth and rng.random() < 0.4:
                depth -= 1
                lines.append("}")
            else:
                depth += 1
                lines.append(rng.choice(['if (x) { // }', 'f("{{"); {', "/* } */ {"]))
        text = "void f(int a) {\n" + "\n".join(lines + ["}"] * depth) + "\n}\nint y;\n"
        assert code.last_line(text, "c", 1) == text.count("\n") - 1
