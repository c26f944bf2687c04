"""What a folder holds and what the index makes of it: statuses, scopes, filters, ignore rules, guards."""

from __future__ import annotations

import re
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.functions.text import in_folder, version

# File endings by what they are read as, and folders never entered.
PROSE = ("md", "txt", "rst")
TEXT = (*PROSE, "csv", "json", "yaml", "yml", "toml", "xml", "html")
DOCUMENTS = ("pdf", "docx", "doc", "odt", "rtf", "epub", "fb2", "pptx", "ppt", "odp", "xlsx", "xls", "ods", "htm")
PARSED = ("py", "pyi", "ts", "tsx", "js", "jsx", "mjs", "cjs", "java", "c", "h", "cc", "cpp", "hpp")
CODE = (*PARSED, "rs", "go", "rb", "php", "kt", "swift", "scala", "sh", "sql", "cfg", "ini", "yaml", "yml", "toml", "json")
NOISE = ("node_modules", "__pycache__", "venv", "dist", "build", "target", "site-packages")
CODE_MOST = 512 * 1024


def suffix(path: Column) -> Column:
    """The part after the last dot of the file's name, in lower case."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]*)$", 1))


def is_text(path: Column, content: Column) -> Column:
    """Known by its ending, or no zero byte in the first 4,096."""
    return suffix(path).isin(*TEXT) | (F.instr(F.hex(F.substring(content, 1, 4096)), "00") == 0) | ~F.hex(F.substring(content, 1, 4096)).rlike("^(?:..)*00")


def is_code(path: Column, size: Column) -> Column:
    return suffix(path).isin(*CODE) & (size <= CODE_MOST)


def since(df: DataFrame, moment: str, mtime: str = "mtime") -> DataFrame:
    """Rows modified strictly after an ISO moment (UTC where it names no zone); raises ValueError if it is none."""
    when = datetime.fromisoformat(moment.strip())
    at = when.timestamp() if when.tzinfo else when.timestamp() - datetime(1970, 1, 1).timestamp()
    return df.where(F.col(mtime) > at)


def scope_counts(df: DataFrame, folder: str) -> DataFrame:
    """One row: documents, unconverted and failed files under a folder, of rows (path, status)."""
    n = lambda s: F.count(F.when(F.col("status") == s, 1))
    return df.where(in_folder(F.col("path"), folder)).agg(F.count_distinct(F.when(F.col("status").isin("indexed", "changed"), F.col("path"))).alias("docs"), n("unconverted").alias("unconverted"), n("failed").alias("failed"))


def statuses(files: DataFrame, state: DataFrame, *, code: bool = False) -> DataFrame:
    """(path, bytes, mtime, status, reason): indexed, changed, excluded, failed or unconverted, each once.

    files has path, bytes, mtime; state key, mtime, outcome, reason. Failed comes before prose, documents, code and the
    rest. A document with a note of its stem beside it is excluded as converted: the note is indexed instead.
    """
    s = state.select(F.col("key").alias("path"), F.col("mtime").alias("stamp"), "outcome", F.col("reason").alias("why"))
    stem = F.regexp_replace("path", r"\.[^./]*$", "")
    notes = files.where(suffix(F.col("path")) == "md").select(stem.alias("stem"), F.col("path").alias("sidecar"))
    both = files.withColumn("stem", stem).join(s, "path", "left").join(notes, "stem", "left")
    ending = suffix(F.col("path"))
    fresh = F.when(F.col("stamp") == F.col("mtime"), "indexed").otherwise("changed")
    status = (
        F.when(F.col("outcome") == "failed", "failed")
        .when(ending.isin(*PROSE), fresh)
        .when(ending.isin(*DOCUMENTS) & F.col("sidecar").isNotNull(), "excluded")
        .when(ending.isin(*DOCUMENTS) & (ending != "pdf"), "unconverted")
        .when((ending == "pdf") & (F.col("outcome") == "indexed"), fresh)
        .when((ending == "pdf") & (F.col("stamp") == F.col("mtime")), "unconverted")
        .when(ending == "pdf", "changed")
        .when(F.lit(code) & ending.isin(*CODE), F.when(F.col("bytes") > CODE_MOST, "excluded").otherwise(fresh))
        .otherwise("excluded")
    )
    reason = (
        F.when(F.col("outcome") == "failed", F.col("why"))
        .when(ending.isin(*PROSE), F.lit(None))
        .when(ending.isin(*DOCUMENTS) & F.col("sidecar").isNotNull(), F.concat(F.lit("converted: "), "sidecar"))
        .when(ending.isin(*DOCUMENTS) & (ending != "pdf"), F.lit("no extracted .md beside it"))
        .when((ending == "pdf") & (F.col("stamp") == F.col("mtime")) & (F.col("outcome") != "indexed"), F.coalesce("why", F.lit("no text layer")))
        .when((ending == "pdf") | (F.lit(code) & ending.isin(*CODE) & (F.col("bytes") <= CODE_MOST)), F.lit(None))
        .when(F.lit(code) & ending.isin(*CODE), F.lit(f"not indexed: over {CODE_MOST // 1024} KB"))
        .otherwise(F.concat(F.lit("not indexed: "), F.when(ending == "", "no extension").otherwise(F.concat(F.lit("."), ending))))
    )
    return both.select("path", "bytes", "mtime", status.alias("status"), reason.alias("reason"))


def inventory_page(rows: DataFrame, *, status: str | None = None, offset: int = 0, limit: int = 100) -> DataFrame:
    """A page of rows by path, `total` and whether there is more beside each."""
    rows = rows.where(F.col("status") == status) if status else rows
    total = rows.count()
    return rows.orderBy("path").offset(offset).limit(limit).withColumn("total", F.lit(total)).withColumn("truncated", F.lit(offset + limit < total))


def source_state(notes: DataFrame, originals: DataFrame) -> DataFrame:
    """(path, source, source_state) of converted notes (path, source, source_sha256): current, stale or unverifiable."""
    own = originals.select(F.col("path").alias("source"), F.sha2("content", 256).alias("now"))
    state = F.when(F.col("source_sha256").isNull() | F.col("now").isNull(), "unverifiable").when(F.col("now") == F.col("source_sha256"), "current").otherwise("stale")
    return notes.where("source is not null").join(own, "source", "left").select("path", "source", state.alias("source_state"))


def guarded(notes: DataFrame, expected: DataFrame) -> DataFrame:
    """(path, version, outcome) for (path, expect_version): ok, changed or not_found."""
    now = notes.select("path", version(F.col("text")).alias("version"))
    outcome = F.when(F.col("version").isNull(), "not_found").when(F.col("expect_version").isNull() | (F.col("expect_version") == F.col("version")), "ok").otherwise("changed")
    return expected.join(now, "path", "left").select("path", "version", outcome.alias("outcome"))


def glob_regex(pattern: str) -> str:
    """A shell pattern as a regular expression; a star crosses slashes."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and (j := pattern.find("]", i + 2)) > 0:
            body = pattern[i + 1 : j]
            out += "[" + ("^" + body[1:] if body.startswith("!") else body).replace("\\", "\\\\") + "]"
            i = j
        else:
            out += re.escape(c)
        i += 1
    return out


def _any_matches(parts: Column, pattern: str) -> Column:
    return F.exists(parts, lambda p: F.rlike(p, F.lit(pattern)))


def ignored(path: Column, rules: list[str], noise: tuple[str, ...] = NOISE) -> Column:
    """Whether a path lies in a hidden or noise folder or matches a rule: a name, a glob, or a path from the root."""
    parts = F.split(path, "/")
    test = F.exists(parts, lambda p: (F.startswith(p, F.lit(".")) & (F.length(p) > 1)) | p.isin(*noise))
    for rule in (r.strip() for r in rules):
        if not rule or rule.startswith("#"):
            continue
        body = rule.strip("/")
        if "/" in body or rule.startswith("/"):
            test = test | path.rlike(f"^{glob_regex(body)}(?:/.*)?$")
        elif re.search(r"[*?\[]", body):
            test = test | _any_matches(parts, f"^{glob_regex(body)}$")
        else:
            test = test | F.array_contains(parts, body)
    return test


def contained(path: str) -> str:
    """A root-relative path without . and .. steps; ValueError if it leaves the root or is the root itself."""
    if path.startswith(("/", "\\")) or re.match(r"[A-Za-z]:", path):
        raise ValueError(f"{path!r} is outside the root")
    out: list[str] = []
    for step in path.replace("\\", "/").split("/"):
        if step == "..":
            if not out:
                raise ValueError(f"{path!r} is outside the root")
            out.pop()
        elif step not in ("", "."):
            out.append(step)
    if not out:
        raise ValueError("the root itself is no path")
    return "/".join(out)


def adopt_casing(folders: DataFrame, typed: str) -> str:
    """A typed folder path with each step in the letter case of the folder that exists, if one does."""
    out = ""
    for step in typed.strip("/").split("/"):
        want = f"{out}/{step}".strip("/")
        row = folders.where(F.lower("path") == want.lower()).agg(F.min("path")).first()
        out = row[0] if row and row[0] else want
    return out


def is_code_repository(files: DataFrame, most: int = 400) -> bool:
    """Build files at the root, or more code than prose among the first `most` files by path."""
    marks = ("pyproject.toml", "setup.py", "package.json", "pom.xml", "build.gradle", "Cargo.toml", "go.mod", "CMakeLists.txt", "Makefile")
    if not files.where(F.col("path").isin(*marks)).isEmpty():
        return True
    row = files.orderBy("path").limit(most).agg(F.count(F.when(suffix(F.col("path")).isin(*PARSED), 1)).alias("c"), F.count(F.when(suffix(F.col("path")).isin(*PROSE), 1)).alias("p")).first()
    return row["c"] > row["p"]


def epoch(files: DataFrame) -> DataFrame:
    """One row: a digest of all paths, times and sizes, that changes when any does; combined before the shuffle."""
    each = F.sha1(F.concat_ws("\x00", "path", F.col("mtime").cast("string"), F.col("bytes").cast("string")))
    pieces = [F.conv(F.substring(each, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)") for i in range(2)]
    return files.agg(F.sha1(F.concat_ws("-", F.count("*").cast("string"), *[F.sum(p).cast("string") for p in pieces])).alias("epoch"))


def doctor(checks: DataFrame) -> DataFrame:
    """One row with the worst of the outcomes (name, outcome: ok, warn, fail) and how many of each."""
    level = F.when(F.col("outcome") == "fail", 2).when(F.col("outcome") == "warn", 1).otherwise(0)
    n = lambda s: F.count(F.when(F.col("outcome") == s, 1)).alias(s)
    return checks.agg(F.max(level).alias("w"), n("ok"), n("warn"), n("fail")).select(F.element_at(F.array(F.lit("ok"), F.lit("warn"), F.lit("fail")), F.coalesce("w", F.lit(0)) + 1).alias("verdict"), "ok", "warn", "fail")


# --- paths that no search shows ----------------------------------------------------------------------------------------


def is_source_leaf(path: Column, written: str = "", leaves: str = "sources") -> Column:
    """Verbatim originals: what lies under the leaves' folder of the root, or of the folder that is written to."""
    inside = F.ltrim(F.replace(path, F.lit("\\"), F.lit("/")), F.lit("/"))
    roots = [leaves, *([f"{written.strip('/')}/{leaves}"] if written.strip("/") else [])]
    return reduce(lambda a, b: a | b, [F.startswith(inside, F.lit(r + "/")) for r in roots])


def is_inbox(path: Column, written: str = "", inbox: str = "Inbox") -> Column:
    """Staging, never written to or merged into: any inbox folder, letter case apart."""
    inside = F.lower(F.ltrim(F.replace(path, F.lit("\\"), F.lit("/")), F.lit("/")))
    roots = {inbox, "Inbox", *([f"{written.strip('/')}/{inbox}"] if written.strip("/") else [])}
    return reduce(lambda a, b: a | b, [F.startswith(inside, F.lit(r.strip("/").lower() + "/")) for r in sorted(roots) if r.strip("/")])


def is_artifact(path: Column, stems: tuple[str, ...] = ("log", "GRAPH_REPORT")) -> Column:
    """Files that earlier exports left at the root."""
    stem = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"\.md$", "")
    return stem.isin(*stems)


def as_note(path: str) -> str:
    """A contained path with the ending of a note."""
    path = contained(path)
    return path if path.endswith(".md") else path + ".md"


def code_root(vault: str, repositories: list[str], is_vault: bool) -> tuple[str | None, str | None]:
    """(root, warning): the innermost repository folder that holds the vault. A note vault within a repository of
    something else has none, with the reason: its code is never taken for the vault's."""
    holding = [r.rstrip("/") for r in repositories if f"{vault.rstrip('/')}/".startswith(r.rstrip("/") + "/")]
    if not holding:
        return None, None
    root = max(holding, key=len)
    if is_vault and root != vault.rstrip("/"):
        return None, f"{vault} lies in the repository {root} of something else"
    return root, None
