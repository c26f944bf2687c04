"""Source files: skeletons, units, imports and calls, importers, hierarchy, context packs, differences.

Python is parsed with its own grammar; the other families by their comments, strings and braces. A skeleton is one
nested row a file; the graph's tables are exploded from it, and imports are resolved by equality joins on candidate
paths, best candidate first, never by scanning the file list.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.operators.index import global_rank
from fathomline.operators.links import suffixes

# Endings by language, platform namespaces, endings a script import may leave out, unit sizes.
LANGUAGES = {"py": "python", "pyi": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "java": "java", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "hpp": "cpp"}
SCRIPTS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")
PLATFORM = ("java", "javax", "jdk", "sun", "android", "androidx")
UNIT_LINES, WINDOW_LINES = 120, 80

SKELETON = (
    "path string, language string, parse_error boolean, module_doc string, has_main_guard boolean, imports array<string>, deferred array<string>, aliases map<string,string>, exported array<string>, "
    "symbols array<struct<kind: string, name: string, signature: string, doc: string, parent: string, doc_full: string, decorators: array<string>, line: int, end_line: int>>, calls array<struct<name: string, caller: string, line: int>>"
)
STRING_OR_COMMENT = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?|`(?:[^`\\]|\\.)*`?", re.S)
HEADER = re.compile(r"(?:\b(class|interface|enum|struct)\s+(\w+)[^;{}()]*|\b(?:const|let|var)\s+(\w+)\s*(?::[^=;{}]*)?=\s*(?:async\s*)?\([^;{}]*\)\s*(?::[^={}]*)?=>\s*|(?:^|[\s*&])([A-Za-z_$]\w*)\s*\((?:[^(){};]|\([^(){}]*\))*\)\s*(?:const|noexcept|override)?\s*(?::\s*[\w<>\[\], |.]+)?(?:throws\s+[\w., ]+)?\s*)$", re.S)
NO_NAME = frozenset("if for while switch catch return function else do try synchronized".split())


def language_of(path: str) -> str | None:
    return LANGUAGES.get(path.rpartition("/")[2].rpartition(".")[2].lower())


def _first(doc: str | None) -> str:
    return (doc or "").strip().split("\n")[0].strip()


def python_skeleton(text: str) -> dict:
    """Imports, symbols, calls and the like of a Python module; parse_error and nothing else if it doesn't parse."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return {"parse_error": True}
    lines = text.split("\n")
    out: dict = {"parse_error": False, "module_doc": ast.get_docstring(tree), "has_main_guard": False, "imports": [], "deferred": [], "aliases": {}, "exported": [], "symbols": [], "calls": []}

    def imported(node: ast.Import | ast.ImportFrom, deferred: bool) -> None:
        for a in node.names:
            if isinstance(node, ast.Import):
                module = a.name
                out["aliases"].setdefault(a.asname or a.name.split(".")[0], a.name if a.asname else a.name.split(".")[0])
            else:
                base = "." * node.level + (node.module or "")
                module = base if a.name == "*" else base + ("" if base.endswith(".") or not base else ".") + a.name
                out["aliases"].setdefault(a.asname or a.name, module)
            bag = out["deferred" if deferred else "imports"]
            if module not in bag:
                bag.append(module)

    def symbol(node, kind: str, parent: str) -> None:
        first = min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", []))])
        body = node.body[0].lineno - 1 if getattr(node, "body", None) else node.lineno
        head = " ".join(x.strip() for x in lines[node.lineno - 1 : max(node.lineno, body)])
        doc = ast.get_docstring(node)
        m = re.match(r"(.*?\)?\s*(?:->\s*[^:]+)?):(?:\s|$)", head)
        signature = (m[1] if m and m[1].count("(") == m[1].count(")") else head.split(":")[0]).strip()
        names = [ast.unparse(d).split("(")[0] for d in node.decorator_list]
        out["symbols"].append((kind, node.name, signature, _first(doc), parent, doc or "", names, first, node.end_lineno))

    def walk(node, parent: str, caller: str, depth: int) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.Import, ast.ImportFrom)):
                imported(child, depth > 0)
            elif isinstance(child, ast.ClassDef):
                if depth == 0:
                    symbol(child, "class", parent)
                walk(child, child.name if depth == 0 else parent, caller, depth)
                continue
            elif isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                if depth == 0:
                    symbol(child, "method" if parent else "function", parent)
                name = f"{parent}.{child.name}" if parent else child.name
                walk(child, parent, caller if depth else name, depth + 1)
                continue
            elif isinstance(child, ast.Call):
                try:
                    name = ast.unparse(child.func)
                except RecursionError:
                    name = ""
                if re.fullmatch(r"[\w.]+", name):
                    out["calls"].append((name, caller, child.lineno))
            walk(child, parent, caller, depth)

    for node in tree.body:
        if isinstance(node, ast.Assign) and len(node.targets) == 1 and isinstance(node.targets[0], ast.Name):
            name = node.targets[0].id
            if name == "__all__" and isinstance(node.value, (ast.List, ast.Tuple)):
                out["exported"] = [e.value for e in node.value.elts if isinstance(e, ast.Constant) and isinstance(e.value, str)]
            elif name.isupper():
                out["symbols"].append(("constant", name, lines[node.lineno - 1].strip(), "", "", "", [], node.lineno, node.end_lineno))
        if isinstance(node, ast.If) and "__name__" in ast.unparse(node.test):
            out["has_main_guard"] = True
    walk(tree, "", "", 0)
    out["symbols"].sort(key=lambda s: s[7])
    return out


def brace_skeleton(text: str, language: str) -> dict:
    """Declarations and imports of a file in a brace language."""
    bare = STRING_OR_COMMENT.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    bare = re.sub(r"(?m)^[ \t]*#[^\n]*", lambda m: " " * len(m[0]), bare) if language in ("c", "cpp") else bare
    out: dict = {"parse_error": bare.count("{") != bare.count("}"), "module_doc": None, "has_main_guard": bool(re.search(r"\bmain\s*\(", bare)), "imports": [], "deferred": [], "aliases": {}, "exported": [], "symbols": [], "calls": []}
    if language == "java":
        out["imports"] = re.findall(r"(?m)^[ \t]*import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;", text)
    elif language in ("c", "cpp"):
        out["imports"] = [m[1] for m in re.finditer(r"(?m)^[ \t]*#[ \t]*include[ \t]*(<[^>\n]+>|\"[^\"\n]+\")", text)]
    else:
        for m in re.finditer(r"(?m)^[ \t]*(?:import|export)\s+(?:([^;'\"]*?)\s+from\s+)?['\"]([^'\"\n]+)['\"]|\brequire\(\s*['\"]([^'\"\n]+)['\"]", text):
            module = m[2] or m[3]
            out["imports"].append(module)
            for name in re.findall(r"(?:\w+\s+as\s+)?([A-Za-z_$][\w$]*)", m[1] or ""):
                out["aliases"].setdefault(name, module)
        out["imports"] = list(dict.fromkeys(out["imports"]))
    if out["parse_error"]:
        return out
    line = 1 + 0
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    at = lambda off: next(i for i in range(len(starts), 0, -1) if starts[i - 1] <= off)
    stack: list[tuple[str, int]] = []
    begin = 0
    for m in re.finditer(r"[{};]", bare):
        if m[0] == "{":
            head = bare[begin : m.start()]
            h = HEADER.search(head)
            entry = ("", -1)
            if h and bare.count("(", begin, m.start()) == bare.count(")", begin, m.start()):
                name = h[2] or h[3] or h[4]
                parent = next((n for n, _ in reversed(stack) if n), "")
                open_ = all(i < 0 or out["symbols"][i][0] == "class" for _, i in stack)
                if name not in NO_NAME and open_:
                    kind = "class" if h[1] else "method" if parent else "function"
                    start = begin + len(head) - len(head.lstrip())
                    out["symbols"].append([kind, name, " ".join(text[start : m.start()].split()), "", parent, "", re.findall(r"@(\w+)", head), at(start), 0])
                    entry = (name if h[1] else "", len(out["symbols"]) - 1)
            stack.append(entry)
        elif m[0] == "}" and stack:
            _, i = stack.pop()
            if i >= 0:
                out["symbols"][i][8] = at(m.start())
        begin = m.end()
    del line
    out["symbols"] = [tuple(s) for s in out["symbols"]]
    spans = sorted((s[7], s[8], f"{s[4]}.{s[1]}" if s[4] else s[1]) for s in out["symbols"] if s[0] != "class")
    for m in re.finditer(r"([A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*)\s*\(", bare):
        n = at(m.start())
        inside = [s for s in spans if s[0] <= n <= s[1]]
        if inside and m[1] not in NO_NAME and not any(s[0] == n and s[2].rpartition(".")[2] == m[1] for s in inside):
            out["calls"].append((m[1], inside[-1][2], n))
    return out


def skeleton(text: str, language: str | None) -> dict:
    """Never raises: what can't be parsed comes out with parse_error."""
    try:
        return python_skeleton(text) if language == "python" else brace_skeleton(text, language or "")
    except Exception:  # one odd file must not end a run over millions
        return {"parse_error": True}


def skeletons(sources: DataFrame) -> DataFrame:
    """A nested row for each file (path, text) in a language that is parsed."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, text in zip(b["path"], b["text"], strict=True):
                lang = language_of(path or "")
                if lang is None or text is None:
                    continue
                s = skeleton(re.sub(r"\r\n?", "\n", text), lang)
                named = [dict(zip(("kind", "name", "signature", "doc", "parent", "doc_full", "decorators", "line", "end_line"), x, strict=True)) for x in s.get("symbols", [])]
                calls = [dict(zip(("name", "caller", "line"), x, strict=True)) for x in s.get("calls", [])]
                rows.append((path, lang, s["parse_error"], s.get("module_doc"), s.get("has_main_guard", False), s.get("imports", []), s.get("deferred", []), s.get("aliases", {}), s.get("exported", []), named, calls))
            yield pd.DataFrame(rows, columns=["path", "language", "parse_error", "module_doc", "has_main_guard", "imports", "deferred", "aliases", "exported", "symbols", "calls"])

    ending = F.lower(F.regexp_extract("path", r"[^/]\.([^./]*)$", 1))
    return sources.where(ending.isin(*LANGUAGES)).select("path", "text").mapInPandas(run, SKELETON)


def symbols(found: DataFrame) -> DataFrame:
    return found.select("path", F.explode("symbols").alias("s")).select("path", "s.*")


def notebook_source(text: str) -> str:
    """Code cells of an nbformat-4 notebook, without magics and shell lines; markdown cells as comments."""
    import json

    try:
        cells = json.loads(text).get("cells", [])
    except (ValueError, AttributeError):
        return ""
    out = []
    for c in cells:
        src = c.get("source", "")
        src = "".join(src) if isinstance(src, list) else str(src)
        if c.get("cell_type") == "code":
            out.append("\n".join("" if re.match(r"\s*[%!?]", x) else x for x in src.split("\n")))
        elif c.get("cell_type") == "markdown":
            out.append("\n".join("# " + x for x in src.split("\n")))
    return "\n\n".join(out)


# --- imports --------------------------------------------------------------------------------------------------------


def _steps(path: Column) -> Column:
    """A path without . and .. steps."""
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), lambda a, s: F.when((s == "") | (s == "."), a).when(s == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(s)))), "/")


def import_edges(found: DataFrame, files: DataFrame) -> DataFrame:
    """(src, module, deferred, kind, value): kind resolved (value a file of `files`), external (its top name) or
    unresolved. Candidates are exploded with their order and joined by equality; the first that exists wins."""
    every = found.select("path", "language", F.explode(F.array_distinct(F.concat(F.transform("imports", lambda m: F.struct(m.alias("module"), F.lit(False).alias("deferred"))), F.transform("deferred", lambda m: F.struct(m.alias("module"), F.lit(True).alias("deferred")))))).alias("i"))
    every = every.select(F.col("path").alias("src"), "language", "i.module", "i.deferred").where("module <> ''").groupBy("src", "language", "module").agg(F.min("deferred").alias("deferred"))
    here = F.regexp_replace("src", r"/?[^/]*$", "")
    dots = F.length(F.regexp_extract("module", r"^(\.*)", 1))
    up = F.repeat(F.lit("../"), F.greatest(dots - 1, F.lit(0)).cast("int"))
    rest = F.replace(F.regexp_replace("module", r"^\.+", ""), F.lit("."), F.lit("/"))
    stem = F.when(dots > 0, _steps(F.concat_ws("/", here, up, rest))).otherwise(rest)
    parent = F.regexp_replace(stem, r"/[^/]*$", "")
    python = F.array_compact(F.array(F.concat(stem, F.lit(".py")), F.concat(stem, F.lit("/__init__.py")), F.when(F.contains(stem, F.lit("/")), F.concat(parent, F.lit(".py"))), F.when(F.contains(stem, F.lit("/")), F.concat(parent, F.lit("/__init__.py")))))
    base = _steps(F.concat_ws("/", here, "module"))
    script = F.concat(F.when(F.lower(base).rlike(r"\.(?:tsx?|jsx?|mjs|cjs)$"), F.array(base)).otherwise(F.array().cast("array<string>")), F.array(*[F.concat(base, F.lit(x)) for x in SCRIPTS]), F.array(*[F.concat(base, F.lit("/index" + x)) for x in SCRIPTS]))
    quoted = F.regexp_replace("module", '^"|"$', "")
    include = F.array(_steps(F.concat_ws("/", here, quoted)), quoted)
    relative = F.col("module").rlike(r"^\.\.?(?:/|$)")
    whole = F.when(F.col("language") == "python", python).when(F.col("language").isin("c", "cpp") & ~F.startswith("module", F.lit("<")), include).when(F.col("language").isin("typescript", "javascript") & relative, script)
    tail = F.when((F.col("language") == "java") & ~F.endswith("module", F.lit(".*")), F.concat(F.replace("module", F.lit("."), F.lit("/")), F.lit(".java"))).when(F.col("language").isin("c", "cpp") & ~F.startswith("module", F.lit("<")), quoted)
    paths = files.select("path").distinct()
    by_path = every.select("src", "module", F.posexplode(whole).alias("o", "path")).join(paths, "path").select("src", "module", F.col("path").alias("value"), "o")
    ends = every.select("src", "module", F.lower(tail).alias("tail"), tail.alias("exact")).where("tail is not null").join(suffixes(paths), "tail")
    by_tail = ends.where(F.endswith("path", F.col("exact"))).select("src", "module", F.col("path").alias("value"), (F.length("path") + 100).alias("o"))
    order = Window.partitionBy("src", "module").orderBy("o", "value")
    best = by_path.unionByName(by_tail).withColumn("rn", F.row_number().over(order)).where("rn = 1").select("src", "module", "value")
    # names of the root's folders and files make an import first-party
    tops = paths.select(F.explode(F.array_distinct(F.concat(F.split(F.regexp_replace("path", r"\.py$", ""), "/"), F.array(F.regexp_replace(F.element_at(F.split("path", "/"), 1), r"\.py$", ""))))).alias("top"), F.element_at(F.split(F.regexp_replace("path", r"\.py$", ""), "/"), 1).alias("root"))
    roots = tops.groupBy("top").agg(F.max((F.col("top") == F.col("root")).cast("int")).alias("at_root"))
    top = F.regexp_extract("module", r"^([^./]*)", 1)
    named = every.join(best, ["src", "module"], "left").withColumn("top", top).join(roots, "top", "left")
    own = F.when(F.col("language") == "python", F.startswith("module", F.lit(".")) | (F.coalesce("at_root", F.lit(0)) == 1)).when(F.col("language") == "java", F.endswith("module", F.lit(".*")) | (~F.col("top").isin(*PLATFORM) & F.col("at_root").isNotNull())).when(F.col("language").isin("c", "cpp"), ~F.startswith("module", F.lit("<"))).otherwise(relative | F.startswith("module", F.lit("@/")) | F.startswith("module", F.lit("~/")))
    outside = F.when(F.col("language") == "java", F.regexp_extract("module", r"^([^.]*(?:\.[^.]*)?)", 1)).when(F.col("language").isin("c", "cpp"), F.trim(F.regexp_replace("module", "[<>]", ""))).when(F.col("language") == "python", top).otherwise(F.regexp_extract("module", "^([^/]*)", 1))
    kind = F.when(F.col("value").isNotNull(), "resolved").when(own, "unresolved").otherwise("external")
    return named.select("src", "module", "deferred", kind.alias("kind"), F.when(F.col("value").isNotNull(), F.col("value")).when(own, quoted).otherwise(outside).alias("value"))


def importers(edges: DataFrame) -> DataFrame:
    """(path, fan_in): how many files import each file."""
    return edges.where("kind = 'resolved'").groupBy(F.col("value").alias("path")).agg(F.count_distinct("src").alias("fan_in"))


def call_edges(found: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, target, callee, caller, line): calls whose spelled name matches an imported first-party module or name, or a
    function of the same file; the longest module wins, of several call sites the first line counts."""
    calls = found.select(F.col("path").alias("src"), "aliases", F.explode("calls").alias("c")).select("src", "aliases", F.col("c.name").alias("spelled"), F.col("c.caller").alias("caller"), F.col("c.line").alias("line"))
    head = F.regexp_extract("spelled", r"^([^.]*)", 1)
    alias = F.col("aliases")[head]
    name = F.when(alias.isNotNull(), F.concat(alias, F.expr("substring(spelled, length(regexp_extract(spelled, '^([^.]*)', 1)) + 1)"))).otherwise(F.col("spelled"))
    calls = calls.withColumn("name", name).drop("aliases")
    modules = edges.where("kind = 'resolved'").select("src", "module", F.col("value").alias("target"))
    both = calls.join(modules, "src")
    starts = (F.col("name") == F.col("module")) | F.startswith("name", F.concat("module", F.lit(".")))
    leaf = F.regexp_extract("module", r"([^./]*)$", 1)
    by_leaf = (head == leaf) & F.contains("module", F.lit("."))
    callee = F.when(starts, F.coalesce(F.nullif(F.expr("ltrim('.', substring(name, length(module) + 1))"), F.lit("")), leaf)).otherwise(F.coalesce(F.nullif(F.regexp_extract("spelled", r"^[^.]*\.(.*)$", 1), F.lit("")), F.col("spelled")))
    order = Window.partitionBy("src", "spelled", "caller", "line").orderBy(F.when(starts, 0).otherwise(1), F.desc(F.length("module")), "module")
    outward = both.where((starts | by_leaf) & (F.col("target") != F.col("src"))).withColumn("callee", callee).withColumn("rn", F.row_number().over(order)).where("rn = 1").select("src", "target", "callee", "caller", "line")
    own = symbols(found).where("kind in ('function', 'class') and parent = ''").select(F.col("path").alias("src"), F.col("name").alias("spelled")).distinct()
    inward = calls.where(~F.contains("spelled", F.lit("."))).join(own, ["src", "spelled"]).select("src", F.col("src").alias("target"), F.col("spelled").alias("callee"), "caller", "line")
    return outward.unionByName(inward).groupBy("src", "target", "callee", "caller").agg(F.min("line").alias("line"))


def reexports(found: DataFrame, edges: DataFrame) -> DataFrame:
    """(path, name, source): names of __all__ that the file imports instead of defining."""
    wanted = found.select("path", "aliases", F.explode(F.array_except("exported", F.transform("symbols", lambda s: s["name"]))).alias("name"))
    wanted = wanted.withColumn("module", F.col("aliases")[F.col("name")]).drop("aliases")
    return wanted.join(edges.where("kind = 'resolved'").select(F.col("src").alias("path"), "module", F.col("value").alias("source")), ["path", "module"]).where("source <> path").select("path", "name", "source")


def vocabulary(found: DataFrame, edges: DataFrame, most: int = 30) -> DataFrame:
    """(path, fan_in, name): the symbols of the files most imported."""
    best = importers(edges).orderBy(F.desc("fan_in"), "path").limit(most)
    return symbols(found).join(best, "path").select("path", "fan_in", "name").distinct()


def supertypes(signature: Column) -> Column:
    """Names of the declared bases in a class signature, generics and packages taken off, each once."""
    bare = F.regexp_replace(signature, r"//.*|/\*.*?\*/|#.*", "")
    for _ in range(3):
        bare = F.regexp_replace(bare, r"<[^<>]*>|\[[^\[\]]*\]", "")
    java = F.regexp_extract_all(bare, F.lit(r"\b(?:extends|implements)\s+([\w.,\s]+?)(?=\bextends\b|\bimplements\b|\{|$)"), F.lit(1))
    python = F.regexp_extract_all(bare, F.lit(r"^\s*class\s+\w+\s*\(([^()]*)\)"), F.lit(1))
    cpp = F.regexp_extract_all(bare, F.lit(r"^\s*(?:class|struct)\s+\w+\s*:\s*([^{(]+)$"), F.lit(1))
    parts = F.flatten(F.transform(F.concat(java, python, cpp), lambda g: F.split(g, ",")))
    names = F.transform(F.filter(parts, lambda p: ~F.contains(p, F.lit("="))), lambda p: F.regexp_extract(F.regexp_replace(p, r"\b(?:public|private|protected|virtual|final)\b", " "), r"(\w+)\s*\.?\s*$", 1))
    return F.array_distinct(F.filter(names, lambda n: n != ""))


def hierarchy(found: DataFrame) -> DataFrame:
    """(path, class, base, base_path): each class with its bases, and the files that declare a class of that name."""
    classes = symbols(found).where("kind = 'class'")
    bases = classes.select("path", F.col("name").alias("class"), F.explode(supertypes(F.col("signature"))).alias("base"))
    return bases.join(classes.select(F.col("name").alias("base"), F.col("path").alias("base_path")).distinct(), "base", "left").select("path", "class", "base", "base_path")


def innermost(lines: DataFrame, syms: DataFrame) -> DataFrame:
    """(path, line, selector): the innermost symbol whose declaration spans each line (path, line): a range join on the
    file, the narrowest span wins."""
    s = syms.where("kind in ('function', 'method', 'class') and line > 0").select("path", F.col("line").alias("a"), F.col("end_line").alias("b"), F.when(F.col("parent") != "", F.concat_ws(".", "parent", "name")).otherwise(F.col("name")).alias("selector"))
    hit = lines.join(s, "path").where("a <= line and line <= b")
    order = Window.partitionBy("path", "line").orderBy(F.col("b") - F.col("a"), F.desc("a"))
    return hit.withColumn("rn", F.row_number().over(order)).where("rn = 1").select("path", "line", "selector")


REMARK = re.compile(r"\s*(?:#|//|/\*|\*|$)")


def code_units(text: str, spans: list[tuple[int, int, str]]) -> list[tuple[int, str, str]]:
    """(offset, text, title): a unit a symbol, its comment block above included, and what lies between; longer ones in
    windows of lines. Each line belongs to the innermost symbol.

    Gaps and islands: lines are cut wherever a span begins or ends, each stretch takes its narrowest span's title, and
    neighbouring stretches of one title are one island.
    """
    offsets = [0, *(m.end() for m in re.finditer(r"\n(?=.)", text, re.S)), len(text)]
    count = len(offsets) - 1
    if not text or not count:
        return []
    s = pd.DataFrame(sorted(spans, key=lambda x: (x[0], -x[1])), columns=["a", "b", "title"])
    s = s.assign(a=s["a"] - 1, b=np.minimum(s["b"], count))
    edges = np.unique(np.concatenate([[0, count], s["a"], s["b"]]).astype(int).clip(0, count))
    at = np.searchsorted(edges, s[["a", "b"]].to_numpy(int))
    owner = np.full(len(edges) - 1, -1)
    for i, (first, end) in enumerate(at):  # later spans begin further in
        owner[first:end] = i
    titles = np.append(s["title"].to_numpy(object), "")[owner]
    new = np.flatnonzero(np.append(True, titles[1:] != titles[:-1]))
    begin, title = edges[new], titles[new]
    spoken = np.cumsum([0, *(REMARK.match(text[i:j]) is None for i, j in zip(offsets, offsets[1:], strict=False))])
    end = np.append(begin[1:], count)
    remarks = np.append(False, (spoken[end] == spoken[begin])[:-1]) & (title != "")  # what stands above is comment only
    begin = np.where(remarks, np.append(0, begin[:-1]), begin)
    end = np.where(np.append(remarks[1:], False), begin, end)
    out = []
    for a, b, name in zip(begin.tolist(), end.tolist(), title, strict=True):
        marks = [*range(a, b, WINDOW_LINES if b - a > UNIT_LINES else max(1, b - a)), b]
        out += [(offsets[i], part, name) for i, j in zip(marks, marks[1:], strict=False) if (part := text[offsets[i] : offsets[j]]).strip()]
    return out


def units(sources: DataFrame, found: DataFrame) -> DataFrame:
    """(path, off, title, unit) of each source file; files no parser covers come in windows."""
    spans = found.where("not parse_error").select("path", F.transform("symbols", lambda s: F.struct(s["line"].alias("a"), s["end_line"].alias("b"), F.when(s["parent"] != "", F.concat_ws(".", s["parent"], s["name"])).otherwise(s["name"]).alias("title"))).alias("spans"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, text, own in zip(b["path"], b["text"], b["spans"], strict=True):
                if text:
                    given = [(s["a"], s["b"], s["title"]) for s in own if 0 < s["a"] <= s["b"]] if own is not None else []
                    rows += [(path, off, title, unit) for off, unit, title in code_units(re.sub(r"\r\n?", "\n", text), given)]
            yield pd.DataFrame(rows, columns=["path", "off", "title", "unit"])

    return sources.join(spans, "path", "left").select("path", "text", "spans").mapInPandas(run, "path string, off int, title string, unit string")


def budgeted(entries: DataFrame, budget: int, used: int = 0) -> DataFrame:
    """entries (section, n, label, block), n from 1, with `kept`: taken in order while they fit. Once one doesn't, none
    after it is kept, so that what is dropped is a suffix.

    An entry costs a character at least, so only the first `budget` of them are summed in one place, however many files
    import a hub.
    """
    near, far = entries.where(F.col("n") <= budget), entries.where(F.col("n") > budget).withColumn("kept", F.lit(False))
    first = F.row_number().over(Window.partitionBy("section").orderBy("n")) == 1
    cost = F.length("block") + F.when(first, F.length("section") + 6).otherwise(1)
    total = F.sum("cost").over(Window.partitionBy().orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    return near.withColumn("cost", cost).withColumn("kept", F.lit(used) + total <= budget).drop("cost").unionByName(far)


IMPORT_LINES = r"(?m)^[ \t]*(?:import\b|from\b|export\b[^\n]*\bfrom\b|#[ \t]*include\b|package\b|[^\n]*\brequire\()[^\n]*$"


def _neighbours(text: DataFrame, mine: DataFrame, sources: DataFrame, path: str) -> DataFrame:
    """(label, o): files that a file imports, and for Java those of its folder that it names, by where their name is first
    used outside imports; those never used come last."""
    body = text.select(F.regexp_replace("text", IMPORT_LINES, "").alias("body"))  # one row
    named = F.regexp_extract(F.regexp_replace("module", '^"|"$', ""), r"([^./]+?)(?:\.(?:h|hpp|hh|js|mjs|ts|tsx|jsx))?$", 1)
    wanted = mine.where("kind = 'resolved'").select(F.col("value").alias("label"), named.alias("name"), F.lit(True).alias("imported"))
    if path.lower().endswith(".java"):
        folder = path.rpartition("/")[0]
        beside = sources.where(F.endswith("path", F.lit(".java")) & (F.col("path") != path) & (F.regexp_replace("path", r"/?[^/]*$", "") == folder))
        wanted = wanted.unionByName(beside.select(F.col("path").alias("label"), F.regexp_extract("path", r"([^/]*)\.java$", 1).alias("name"), F.lit(False).alias("imported")))
    at = F.when(F.col("name") != "", F.regexp_instr("body", F.concat(F.lit(r"\b\Q"), "name", F.lit(r"\E\b")))).otherwise(0)
    found = wanted.join(F.broadcast(body), F.lit(True)).withColumn("at", at).where("imported or at > 0")
    return found.groupBy("label").agg(F.min(F.when(F.col("at") > 0, F.col("at"))).alias("first")).select("label", F.coalesce("first", F.lit(2**31 - 1)).cast("int").alias("o"))


def code_pack(sources: DataFrame, found: DataFrame, edges: DataFrame, calls: DataFrame, target: str, *, budget: int = 12_000) -> DataFrame:
    """(section, n, label, block, kept) for "path", "path#Class.member" or "path#L12": the target, its class hierarchy,
    callers of the selected symbol, imported files, outside imports and importers, filled up to a budget of characters."""
    path, _, selector = target.partition("#")
    spark = sources.sparkSession
    if re.fullmatch(r"L\d+", selector):
        row = innermost(spark.createDataFrame([(path, int(selector[1:]))], "path string, line int"), symbols(found).where(F.col("path") == path)).first()
        selector = row["selector"] if row else ""
    text = sources.where(F.col("path") == path).select(F.regexp_replace("text", "\r\n?", "\n").alias("text"))
    own = symbols(found).where(F.col("path") == path)
    if selector:
        full = F.when(F.col("parent") != "", F.concat_ws(".", "parent", "name")).otherwise(F.col("name"))
        lines = own.where(full == selector).limit(1).crossJoin(text).select(F.array_join(F.slice(F.split("text", "\n"), F.col("line"), F.col("end_line") - F.col("line") + 1), "\n").alias("block"))
    else:
        outline = own.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "signature"))), lambda s: F.concat(s["line"].cast("string"), F.lit(": "), s["signature"])), "\n").alias("o"))
        lines = text.crossJoin(outline).select(F.when(F.length("text") <= budget, F.col("text")).otherwise(F.col("o")).alias("block"))
    parts = [lines.select(F.lit(0).alias("s"), F.lit("target").alias("section"), F.lit(path).alias("label"), "block", F.lit(None).cast("int").alias("o"))]
    tree = hierarchy(found)
    up = tree.where(F.col("path") == path).select(F.lit(1).alias("s"), F.lit("hierarchy").alias("section"), F.col("class").alias("label"), F.concat("class", F.lit(" extends "), "base").alias("block"))
    down = tree.where((F.col("base_path") == path) & (F.col("path") != path)).select(F.lit(1).alias("s"), F.lit("hierarchy").alias("section"), F.concat("path", F.lit("#"), "class").alias("label"), F.concat("base", F.lit(" <- "), "path", F.lit("#"), "class").alias("block"))
    parts += [up, down]
    if selector:
        where = F.concat("src", F.lit(":"), F.col("line").cast("string"))
        parts.append(calls.where((F.col("target") == path) & (F.regexp_extract("callee", r"([^.]*)$", 1) == selector.rpartition(".")[2])).select(F.lit(2).alias("s"), F.lit("callers").alias("section"), where.alias("label"), F.concat(where, F.lit(" in "), F.coalesce(F.nullif("caller", F.lit("")), F.lit("<module>"))).alias("block")))
    mine = edges.where(F.col("src") == path)
    parts.append(_neighbours(text, mine, sources, path).select(F.lit(3).alias("s"), F.lit("neighborhood").alias("section"), "label", F.col("label").alias("block"), "o"))
    parts.append(mine.where("kind = 'external'").select(F.lit(4).alias("s"), F.lit("external").alias("section"), F.col("value").alias("label"), F.col("value").alias("block")).distinct())
    parts.append(edges.where((F.col("value") == path) & (F.col("kind") == "resolved")).select(F.lit(5).alias("s"), F.lit("importers").alias("section"), F.col("src").alias("label"), F.col("src").alias("block")).distinct())
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p, allowMissingColumns=True)
    numbered = global_rank(every, ["s", F.asc_nulls_first("o"), "label", "block"], "n").drop("s", "o")
    return budgeted(numbered, budget).select("section", "n", "label", "block", "kept")


def skeleton_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change, what): imports and symbols that came (+) or went (-), and signatures that changed (~)."""
    def facts(df: DataFrame) -> DataFrame:
        imports = df.select("path", F.explode("imports").alias("what")).select("path", F.concat(F.lit("import "), "what").alias("what"), F.lit("").alias("signature"))
        named = symbols(df).select("path", F.concat_ws(" ", "kind", F.when(F.col("parent") != "", F.concat_ws(".", "parent", "name")).otherwise(F.col("name"))).alias("what"), "signature")
        return imports.unionByName(named).groupBy("path", "what").agg(F.max("signature").alias("signature"))

    a, b = facts(before).withColumnRenamed("signature", "old"), facts(after).withColumnRenamed("signature", "new")
    change = F.when(F.col("old").isNull(), "+").when(F.col("new").isNull(), "-").when(F.col("old") != F.col("new"), "~")
    return a.join(b, ["path", "what"], "full_outer").select("path", change.alias("change"), "what").where("change is not null")
