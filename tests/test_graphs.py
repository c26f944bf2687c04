from __future__ import annotations

import pytest

from fathomline.operators import codegraph, links

NOTES = {
    "Hub.md": "# Hub\n[[Spoke One]] and [[Spoke Two|two]]\n",
    "Spoke One.md": "back to [[Hub]]",
    "Spoke Two.md": "see [[MissingNote]] and [[Cell]]",
    "A/Cell.md": "in [[Cell]]? no: [up](../Hub.md)",
    "B/Cell.md": "## [[Isolated/Orphan]]\n",
    "B/User.md": "[[Cell]] and ![[img.png]]",
    "Isolated/Orphan.md": "alone",
    "adr/0003-choice.md": "decides",
    "Cites.md": "per ADR-0003 and `data/x.csv` and [web](https://x.y) and `[[not]]`\n```\n[[nor]]\n```\n[ref]\n\n[ref]: Hub.md\n[out](../../gone.md)",
}


@pytest.fixture(scope="module")
def graph(spark):
    notes = spark.createDataFrame(list(NOTES.items()), "path string, text string")
    resolved = links.resolve(links.extract(notes), notes).cache()
    return notes, resolved


def test_targets():
    assert [t for t, k, _ in links.references(NOTES["Cites.md"])] == ["ADR-0003", "Hub.md", "../../gone.md", "data/x.csv"]
    assert links.references("## [[A]]\ntext [[B]] and [[A#x]]") == [("A", "note", False), ("B", "note", False)]
    assert links.references("---\nup: \"[[A]]\"\n---\n# [[B]]\nprose [[C]]") == [("A", "note", True), ("B", "note", True), ("C", "note", False)]
    assert links.references(None) == []


def test_resolution(graph):
    _, resolved = graph
    got = {(r["src"], r["target"]): r["dst"] for r in resolved.collect()}
    assert got["Hub.md", "Spoke One"] == "Spoke One.md"
    assert got["Spoke Two.md", "Cell"] == "A/Cell.md" and got["B/User.md", "Cell"] == "B/Cell.md" and got["A/Cell.md", "Cell"] == "A/Cell.md"
    assert got["A/Cell.md", "../Hub.md"] == "Hub.md" and got["Cites.md", "ADR-0003"] == "adr/0003-choice.md"
    assert got["Cites.md", "../../gone.md"] is None and got["Spoke Two.md", "MissingNote"] is None
    assert got["B/Cell.md", "Isolated/Orphan"] == "Isolated/Orphan.md"


def test_edges_orphans_lint(spark, graph):
    notes, resolved = graph
    edges = links.edges(resolved)
    assert {(r["src"], r["dst"]): r["scaffold"] for r in edges.collect()}["B/Cell.md", "Isolated/Orphan.md"] is True
    assert {r["path"] for r in links.orphans(notes, edges).collect()} == {"B/User.md", "Cites.md"}
    assert {(r["src"], r["target"]) for r in links.unresolved(resolved).collect()} == {("Spoke Two.md", "MissingNote"), ("Cites.md", "../../gone.md")}
    degree = {r["path"]: (r["links_out"], r["links_in"]) for r in links.degrees(notes, edges).collect()}
    assert degree["Hub.md"] == (2, 3)
    issues = {(r["path"], r["issue"]) for r in links.lint(notes, resolved).collect()}
    assert ("Spoke Two.md", "line 1: unresolved [[MissingNote]]") in issues
    start = spark.createDataFrame([("Spoke One.md",)], "path string")
    assert {r["path"]: r["hop"] for r in links.reach(edges, start, 1).collect()} == {"Spoke One.md": 0, "Hub.md": 1}


def test_context_search(spark):
    notes = spark.createDataFrame([("a", "X one\nno\nx x\r\n"), ("b", "none")], "path string, text string")
    got = [tuple(r) for r in links.context_search(notes, ["x", "ONE"]).orderBy("query", "path", "line").collect()]
    assert got == [("ONE", "a", 1, "X one", 1), ("ONE", "b", 1, "none", 1), ("x", "a", 1, "X one", 3), ("x", "a", 3, "x x", 3)]


def test_assets(spark):
    refs = spark.createDataFrame([("n/a.md", "img.png"), ("n/a.md", "x/img.png"), ("n/a.md", "none.png")], "src string, target string")
    files = spark.createDataFrame([("img.png",), ("n/img.png",), ("deep/x/img.png",)], "path string")
    assert {r["target"]: r["asset"] for r in links.resolve_assets(refs, files).collect()} == {"img.png": "img.png", "x/img.png": "deep/x/img.png", "none.png": None}


SOURCES = {
    "pkg/__init__.py": "from pkg.util import helper\n__all__ = ['helper']\n",
    "pkg/util.py": '"""Utilities."""\nimport os\n\nLIMIT = 3\n\ndef helper(x):\n    """Help."""\n    return inner(x)\n\ndef inner(x):\n    return x\n',
    "pkg/main.py": "import json\nfrom pkg import util\nfrom . import missing\n\nclass Base:\n    pass\n\n@decorated\nclass Child(Base):\n    def run(self):\n        return util.helper(1)\n\nif __name__ == '__main__':\n    pass\n",
    "web/app.ts": "import { f } from './lib';\nimport React from 'react';\nexport function go(): void {\n  f(1);\n}\n",
    "web/lib.ts": "export const f = (x: number) => {\n  return x;\n};\n",
    "src/main/java/a/b/C.java": "package a.b;\nimport a.b.D;\nimport java.util.List;\npublic class C extends D {\n  int m(int x) {\n    return x;\n  }\n}\n",
    "src/main/java/a/b/D.java": "package a.b;\npublic class D {\n}\n",
    "c/x.c": '#include "x.h"\n#include <stdio.h>\nint main(void) {\n  return 0;\n}\n',
    "c/x.h": "int f(void);\n",
    "bad.py": "def (:\n",
}


@pytest.fixture(scope="module")
def code(spark):
    src = spark.createDataFrame(list(SOURCES.items()), "path string, text string")
    found = codegraph.skeletons(src).cache()
    return src, found, codegraph.import_edges(found, src).cache()


def test_symbols(code):
    _, found, _ = code
    got = {(r["path"], r["name"]): (r["kind"], r["parent"], r["line"], r["end_line"]) for r in codegraph.symbols(found).collect()}
    assert got["pkg/util.py", "helper"] == ("function", "", 6, 8) and got["pkg/util.py", "LIMIT"][0] == "constant"
    assert got["pkg/main.py", "Child"] == ("class", "", 8, 11) and got["pkg/main.py", "run"] == ("method", "Child", 10, 11)
    assert got["web/app.ts", "go"][:2] == ("function", "") and got["src/main/java/a/b/C.java", "m"] == ("method", "C", 5, 7)
    flags = {r["path"]: (r["parse_error"], r["has_main_guard"]) for r in found.collect()}
    assert flags["bad.py"][0] and flags["pkg/main.py"] == (False, True)


def test_imports(code):
    _, _, edges = code
    got = {(r["src"], r["module"]): (r["kind"], r["value"]) for r in edges.collect()}
    assert got["pkg/main.py", "pkg.util"] == ("resolved", "pkg/util.py") and got["pkg/main.py", "json"] == ("external", "json")
    assert got["pkg/main.py", ".missing"][0] in ("unresolved", "resolved")
    assert got["web/app.ts", "./lib"] == ("resolved", "web/lib.ts") and got["web/app.ts", "react"] == ("external", "react")
    assert got["src/main/java/a/b/C.java", "a.b.D"] == ("resolved", "src/main/java/a/b/D.java")
    assert got["src/main/java/a/b/C.java", "java.util.List"] == ("external", "java.util")
    assert got["c/x.c", '"x.h"'] == ("resolved", "c/x.h") and got["c/x.c", "<stdio.h>"] == ("external", "stdio.h")


def test_calls_hierarchy_pack(spark, code):
    src, found, edges = code
    calls = codegraph.call_edges(found, edges).cache()
    got = {(r["src"], r["target"], r["callee"], r["caller"]) for r in calls.collect()}
    assert ("pkg/main.py", "pkg/util.py", "helper", "Child.run") in got and ("pkg/util.py", "pkg/util.py", "inner", "helper") in got
    tree = {(r["class"], r["base"], r["base_path"]) for r in codegraph.hierarchy(found).collect()}
    assert ("Child", "Base", "pkg/main.py") in tree and ("C", "D", "src/main/java/a/b/D.java") in tree
    pack = codegraph.code_pack(src, found, edges, calls, "pkg/util.py#helper").orderBy("n").collect()
    assert pack[0]["block"].startswith("def helper") and any(r["section"] == "callers" and "Child.run" in r["block"] for r in pack)
    small = codegraph.code_pack(src, found, edges, calls, "pkg/util.py#L7", budget=60).orderBy("n").collect()
    kept = [r["kept"] for r in small]
    assert kept == sorted(kept, reverse=True) and small[0]["block"].startswith("def helper")
    assert [(r["name"], r["source"]) for r in codegraph.reexports(found, edges).collect()] == [("helper", "pkg/util.py")]


def test_units_and_diff(spark, code):
    src, found, _ = code
    units = {(r["path"], r["title"]): r["unit"] for r in codegraph.units(src, found).collect()}
    assert units["pkg/util.py", "helper"].lstrip().startswith("def helper") and "bad.py" in {p for p, _ in units}
    text = "import x\n# about f\ndef f():\n    pass\n"
    assert codegraph.code_units(text, [(3, 4, "f")]) == [(0, "import x\n# about f\ndef f():\n    pass\n", "f")] or codegraph.code_units(text, [(3, 4, "f")])[-1][2] == "f"
    long = "".join(f"x{i}\n" for i in range(200))
    assert [u[0] for u in codegraph.code_units(long, [])] == [0, len("".join(f"x{i}\n" for i in range(80))), len("".join(f"x{i}\n" for i in range(160)))]
    after = codegraph.skeletons(spark.createDataFrame([("pkg/util.py", SOURCES["pkg/util.py"].replace("def helper(x)", "def helper(x, y)").replace("import os\n", ""))], "path string, text string"))
    changes = {(r["change"], r["what"]) for r in codegraph.skeleton_diff(found.where("path = 'pkg/util.py'"), after).collect()}
    assert changes == {("-", "import os"), ("~", "function helper")}


def test_notebook():
    import json

    book = json.dumps({"cells": [{"cell_type": "code", "source": ["%magic\n", "x = 1"]}, {"cell_type": "markdown", "source": "note"}]})
    assert codegraph.notebook_source(book) == "\nx = 1\n\n# note" and codegraph.notebook_source("[") == ""


def test_neighbours_by_first_mention_and_hubs(spark):
    files = {
        "p/A.java": "package p;\nimport p.q.Late;\nimport p.q.Early;\nimport p.q.Never;\nclass A {\n  void run() {\n    Early e; Beside b; Late l;\n  }\n}\n",
        **{f"p/q/{n}.java": f"package p.q;\nclass {n} {{\n}}\n" for n in ("Late", "Early", "Never")}, **{f"p/{n}.java": f"package p;\nclass {n} {{\n}}\n" for n in ("Beside", "Unused")},
    }
    src = spark.createDataFrame(list(files.items()), "path string, text string")
    found = codegraph.skeletons(src)
    edges = codegraph.import_edges(found, src)
    pack = codegraph.code_pack(src, found, edges, codegraph.call_edges(found, edges), "p/A.java").where("section = 'neighborhood'").orderBy("n").collect()
    assert [r["label"] for r in pack] == ["p/q/Early.java", "p/Beside.java", "p/q/Late.java", "p/q/Never.java"]
    many = spark.range(5000).selectExpr("'importers' AS section", "CAST(id + 1 AS int) AS n", "CAST(id AS string) AS label", "CAST(id AS string) AS block")
    kept = codegraph.budgeted(many, 100)
    assert kept.count() == 5000 and kept.where("kept").agg({"n": "max"}).first()[0] == kept.where("kept").count() < 60
