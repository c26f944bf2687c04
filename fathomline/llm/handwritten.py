"""Which source files nobody here wrote by hand: generated, minified, third-party and data files.

Character trigram models of identifiers are trained per language on all files. A file's names are then judged three
ways: mangled names cost far more bits a character than the language's usual file (minified or machine-made code),
template-like names and lines collapse to few when digits are taken out (generated code, data), and foreign naming
styles - files named and laid out as packages, with an upstream notice - are third-party. Copies of third-party files
are found wherever they lie, whatever their header: comment-free code is compared by shingles of five words, and
similarity of 0.8 or more to a known third-party file makes a copy.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.llm.code import Span, functions, language, lex, normalise
from fathomline.llm.shingle import WORDS, band_keys, shingles
from fathomline.session import latest, spread, stash

IDENTIFIER = re.compile(r"[^\W\d][\w$]*|\$[\w$]*")
# Words that are no names; folders that hold third-party packages; notices of tools and of upstream authors.
KEYWORDS = frozenset(
    "abstract and as assert async await auto bool boolean break byte case catch char class const constexpr continue def default del delete do double "
    "elif else enum except export extends extern False final finally float for from function global goto if implements import in inline instanceof int "
    "interface is lambda let long namespace native new None nonlocal not null nullptr number or override package pass private protected public raise "
    "return self short signed size_t sizeof static string String struct super switch template this throw throws True true false try typedef typeof "
    "undefined union unsigned using var virtual void volatile while with yield".split()
)
PACKAGES = re.compile(r"(?:^|/)(?:(?:node_modules|bower_components|site-packages)/|(?:third[_-]?party|3rd[_-]?party|_?vendor(?:ed)?|extern(?:al)?|deps)/[^/]+/)", re.I)
UPSTREAM = re.compile(r"\bupstream of this copy\b|\b(?:vendored|copied|taken|imported) (?:verbatim )?from (?:upstream|https?://|the [\w.-]+ (?:project|distribution|library))|\bupstream\s*:\s*https?://", re.I)
GENERATED = re.compile(
    r"""^\W*(?:
      (?:this\ (?:file|code|module|class)\ (?:is|was|has\ been)\ )?(?:auto[-\ ]?(?:matically\ )?|machine[-\ ])?generated\b(?!\ (?:method\ |function\ |class\ )?stub)(?:\ (?:by|from|on|with|code|file|using|automatically)\b|[;.,:!\s]|$)
    | (?:this\ (?:file|code)\ (?:is|was|has\ been)\ )(?:auto(?:matically)?[-\ ]?)?(?:created|produced|written)\ by\ (?:a\ tool|the\ compiler|a\ script)
    | auto[-\ ]?generated\b(?!\ (?:method\ |function\ |class\ )?stub)
    | code\ generated\b | @generated\b | <auto-?generated
    | do\ not\ (?:edit|modify|change|touch)\b | don't\ (?:edit|modify)\b
    | file\ generato\b | generato\ automaticamente | non\ modificare
    | automatisch\ (?:erzeugt|generiert) | nicht\ (?:bearbeiten|(?:ver)?ändern)
    | (?:fichier\ )?généré\ (?:automatiquement|par) | ne\ pas\ modifier
    | (?:archivo\ )?generado\ (?:automáticamente|por) | no\ (?:editar|modificar)
    | (?:ficheiro|arquivo)\ gerado | não\ (?:editar|modificar) )""",
    re.I | re.X | re.M,
)
OTHER = re.compile(r"[^a-z0-9_$]")
HUMP = re.compile(r"[a-z0-9][A-Z]")
ASSIGNED = re.compile(r"^[ \t]*(?:(?:export|const|let|var|static|final|public|private|#define|int|long|auto|constexpr)\s+)*([^\W\d]\w*)\s*(?::[^=\n]*)?(?:=(?!=)|\s\d)", re.M)


def names(masked: str) -> list[str]:
    return [w for w in IDENTIFIER.findall(masked) if w not in KEYWORDS]


def grams(name: str) -> list[str]:
    """Trigrams of a name in lower case; letters of other scripts are one letter, so that a model stays below 40 ** 3 entries."""
    padded = f"\x02\x02{OTHER.sub('?', name.lower())}\x03"
    return [padded[i - 2 : i + 1] for i in range(2, len(padded))]


def convention(name: str) -> str:
    """How a name joins its words: snake, camel or capital; empty for single words and constants, which show no style."""
    core = name.strip("_$")
    if not core or core.upper() == core:
        return ""
    if "_" in core:
        return "snake" if core.lower() == core else ""
    if HUMP.search(core):
        return "capital" if core[0].isupper() else "camel"
    return ""


def _train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Trigram counts of names (lang, name, n): each name counts once a file that has it."""
    count: Counter[tuple[str, str]] = Counter()
    for batch in batches:
        for lang, name, n in zip(batch["lang"], batch["name"], batch["n"], strict=True):
            for g in grams(name):
                count[lang, g] += n
    yield pd.DataFrame([(lang, g, n) for (lang, g), n in count.items()], columns=["lang", "gram", "n"])


class Model:
    """Trigram model of one language's identifiers."""

    def __init__(self, counts: dict[str, int]) -> None:
        context: Counter[str] = Counter()
        for g, n in counts.items():
            context[g[:2]] += n
        self.cost = {g: -math.log2((n + 0.1) / (context[g[:2]] + 4)) for g, n in counts.items()}
        self.new = {c: -math.log2(0.1 / (n + 4)) for c, n in context.items()}
        self.bits = lru_cache(100_000)(self._bits)

    def _bits(self, name: str) -> float:
        """Cross-entropy of a name, bits a character."""
        got = grams(name)
        return sum(self.cost.get(g) or self.new.get(g[:2], 5.3) for g in got) / len(got)


def diversity(items: list[str], window: int = 100) -> float:
    """Distinct share of items once digits are taken out; of long lists the mean over windows, so that size doesn't matter."""
    flat = [re.sub(r"\d+", "", x) for x in items]
    parts = [flat[i : i + window] for i in range(0, len(flat), window)]
    if len(parts) > 1 and len(parts[-1]) < window // 2:
        parts.pop()
    return float(np.mean([len(set(p)) / len(p) for p in parts])) if flat else 1.0


def top_comment(text: str, spans: list[Span]) -> str:
    """The comments before the first code or string of a file."""
    at, out = 0, []
    for s in spans:
        if s.kind != "comment" or text[at : s.start].strip():
            break
        out.append(re.sub(r"(?m)^[ \t]*(?:/?\*+!?/?|//+!?|#+!?)[ \t]?|\*+/[ \t]*$", "", text[s.start : s.end]))
        at = s.end
    return "\n".join(out)


def bare_code(text: str, spans: list[Span]) -> str:
    out, at = [], 0
    for s in spans:
        if s.kind == "comment":
            out.append(text[at : s.start])
            at = s.end
    return "".join([*out, text[at:]])


READ = (
    "path string, lang string, name array<string>, times array<int>, lines int, shapes double, declared double, literal double, notice boolean, package boolean, "
    "snake int, camel int, capital int, copy long, bands array<long>"
)


def _read(bands: int, rows: int):
    """All that is taken from a file's text, which is lexed once: its names, shapes, notices and shingles."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, words = [], []
            for path, text, declared in zip(batch["path"], batch["text"], batch["declared"], strict=True):
                text, lang = normalise(text), language(path, declared)
                masked, spans = lexed = lex(text, lang)
                found = Counter(names(masked))
                styles = Counter(map(convention, found))
                shown = list(masked)
                for x in spans:
                    if x.kind == "directive":
                        shown[x.start : x.end] = text[x.start : x.end]
                masked = "".join(shown)
                code = [line.strip() for line in masked.split("\n") if line.strip()]
                comments = sum(s.end - s.start for s in spans if s.kind == "comment")
                prose = sum(s.end - s.start for s in spans if s.kind == "string" and text[s.start : s.end].lstrip("rRbBuUfF")[:3] in ('"""', "'''"))
                held = sum(s.end - s.start for s in spans if s.kind == "string") - prose
                held += sum(map(len, re.findall(r"\b(?:0[xX][0-9a-fA-F]+|\d[\d.eE]*)\b[ \t]*,?", masked)))
                size = len(text) - comments - prose - sum(map(len, re.findall(r"\s+", masked.replace("  ", "")))) + 1
                declared_names = [f.name for f in functions(text, lang, lexed)]
                assigned = [m[1] for m in ASSIGNED.finditer(masked) if not m[0][:1].isspace() and m[0] == m[0].lstrip()]
                kinds = [diversity(x) for x in (declared_names, assigned) if len(x) >= 6]
                top = top_comment(text, spans)
                words.append(WORDS.findall(bare_code(text, spans)))
                out.append((
                    path, lang, list(found), list(found.values()), len(code), diversity(code), min(kinds, default=1.0), min(1.0, held / max(1, size)), bool(GENERATED.search(top)),
                    bool(PACKAGES.search(path) or UPSTREAM.search(top)), styles["snake"], styles["camel"], styles["capital"],
                    xxhash.xxh64_intdigest("\x1f".join(words[-1])) - 2**63 if words[-1] else 0,
                ))
            made = pd.DataFrame(out, columns=[c.split()[0] for c in READ.split(", ")][:-1])  # copy is 0 for none: a null would turn the ids into floats
            yield made.assign(bands=band_keys(words, bands, rows))

    return run


MEASURED = READ.replace("name array<string>, times array<int>", "bits double, names int, length double")


def _costs(counts: dict[str, dict[str, int]]):
    """Each file's row with the mean bits a character and mean length of its names, occurrences counted, in their place."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models = {lang: Model(c) for lang, c in counts.items()}
        for b in batches:
            out = []
            for lang, name, times in zip(b["lang"], b["name"], b["times"], strict=True):
                n = int(sum(times))
                bits = sum(models[lang].bits(x) * t for x, t in zip(name, times, strict=True)) / n if n else 0.0
                out.append((bits, n, sum(len(x) * t for x, t in zip(name, times, strict=True)) / n if n else 0.0))
            made = pd.DataFrame(out, columns=["bits", "names", "length"], index=b.index)
            yield pd.concat([b.drop(columns=["name", "times"]), made], axis=1)[[c.split()[0] for c in MEASURED.split(", ")]]

    return run


def _similar(similarity: float):
    """Of pairs (copy, seed) with both files' texts, those whose comment-free code is similar enough."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        @lru_cache(256)
        def own(path: str, declared: str | None, text: str) -> np.ndarray:
            text = normalise(text)
            return shingles(bare_code(text, lex(text, language(path, declared))[1]))

        for b in batches:
            good = []
            for copy, pa, da, a, pb, db, t in b[["copy", "path", "declared", "text", "seed_path", "seed_declared", "seed_text"]].itertuples(index=False):
                x, y = own(pa, da, a), own(pb, db, t)
                common = len(np.intersect1d(x, y, assume_unique=True))
                if common >= similarity * (len(x) + len(y) - common):
                    good.append(copy)
            yield pd.DataFrame({"copy": np.array(good, np.int64)})

    return run


STYLES = ("snake", "camel", "capital")


def foreign(least: int, share: float, usual: float) -> Column:
    """Whether a file's names of several words are in one convention that the other files of its language seldom use."""
    own = sum((F.col(c) for c in STYLES[1:]), F.col(STYLES[0]))
    rest = sum((F.col(f"all_{c}") for c in STYLES[1:]), F.col(f"all_{STYLES[0]}")) - own
    tests = [(F.col(c) >= share * own) & (F.col(f"all_{c}") - F.col(c) < usual * rest) for c in STYLES]
    return (own >= least) & (rest >= 10 * least) & (tests[0] | tests[1] | tests[2])


def not_handwritten(
    sources: DataFrame, skeletons: DataFrame | None = None, *, excess_bits: float = 1.0, mangled_length: float = 2.5, template: float = 0.25, template_names: float = 0.5,
    template_lines: int = 12, data_share: float = 0.6, style_names: int = 12, style_share: float = 0.8, style_usual: float = 0.02, similarity: float = 0.8, bands: int = 16, rows: int = 4,
) -> DataFrame:
    """(path, reasons): the files that nobody here wrote by hand, with any of generated, minified, third_party, data.

    sources has path, text and mtime; skeletons, if given, path and language (used where a file's ending says nothing).
    Other columns are ignored. A repeated path is one file (the latest row); a null path is no file; null and empty
    texts are hand-written; an empty table gives no rows; identical files all come out.

    A file is minified if its names cost excess_bits more than the median file of its language and are no longer than
    mangled_length on average; generated if its top comment says so, or its declared names or lines, without digits,
    are fewer than the given shares; data if literals make up data_share of it; third-party if it lies in a package
    folder, carries an upstream notice, or is similar to such a file.
    """
    files = latest(sources, "path", "text")
    if skeletons is not None:
        said = skeletons.where("path is not null").groupBy("path").agg(F.max(F.lower(F.trim("language"))).alias("declared"))
        files = files.join(said, "path", "left")
    else:
        files = files.withColumn("declared", F.lit(None).cast("string"))
    files = stash(spread(files.where(F.length(F.trim("text")) > 0)), "code-files")
    read = stash(files.mapInPandas(_read(bands, rows), READ), "code-read")
    each = read.select("lang", F.explode("name").alias("name")).groupBy("lang", "name").agg(F.count("*").alias("n"))
    counted = each.mapInPandas(_train, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts: dict[str, dict[str, int]] = defaultdict(dict)
    for lang, g, n in counted.toPandas().itertuples(index=False):  # at most 40 ** 3 a language
        counts[lang][g] = n
    features = stash(read.mapInPandas(_costs(dict(counts)), MEASURED), "code-features")
    usual = features.where("names >= 8").groupBy("lang").agg(F.percentile_approx("bits", 0.5).alias("usual"))
    house = features.groupBy("lang").agg(*[F.sum(c).alias(f"all_{c}") for c in STYLES])
    judged = features.join(F.broadcast(usual), "lang", "left").join(F.broadcast(house), "lang").select(  # a row a language
        "path", "copy", "bands", "package", foreign(style_names, style_share, style_usual).alias("foreign"),
        (F.col("notice") | ((F.col("lines") >= template_lines) & (F.col("shapes") <= template)) | (F.col("declared") <= template_names)).alias("generated"),
        ((F.col("bits") > F.col("usual") + excess_bits) & (F.col("length") <= mangled_length) & (F.col("names") >= 8)).alias("minified"),
        ((F.col("literal") >= data_share) | ((F.col("lines") >= template_lines) & (F.col("shapes") <= template) & (F.col("literal") >= data_share / 3))).alias("data"),
    )
    made = F.coalesce("generated", F.lit(False)) | F.coalesce("minified", F.lit(False)) | F.coalesce("data", F.lit(False))
    judged = stash(judged.withColumn("package", F.col("package") | (F.col("foreign") & ~made)).drop("foreign"), "code-judged")

    # copies of third-party files: exact ones share their shingles' hash and are one group; similar groups are met in
    # minhash bands, where only ids travel, and their files are read again for the exact similarity
    code = judged.where("copy <> 0").groupBy("copy").agg(F.max("package").alias("package"), F.min("path").alias("path"), F.first("bands").alias("bands"))
    groups = stash(code, "code-copies")
    seeds = groups.where("package").select(F.explode("bands").alias("band"), F.col("copy").alias("seed"))
    others = groups.where("not package").select(F.explode("bands").alias("band"), "copy")

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        texts = groups.select("copy", "path").join(files, "path")
        left = pairs.join(texts, "copy")
        right = texts.select(F.col("copy").alias("seed"), F.col("path").alias("seed_path"), F.col("declared").alias("seed_declared"), F.col("text").alias("seed_text"))
        return stash(left.join(right, "seed").mapInPandas(_similar(similarity), "copy long").distinct(), name)

    # first against one seed of each bucket, which settles nearly all; what is left against every seed of its buckets
    first = others.join(seeds.groupBy("band").agg(F.min("seed").alias("seed")), "band").select("copy", "seed").distinct()
    settled = confirmed(first, "code-near")
    rest = others.join(settled, "copy", "left_anti").join(seeds, "band").select("copy", "seed").distinct()
    copies = settled.unionByName(confirmed(rest, "code-rest")).unionByName(groups.where("package").select("copy")).distinct().withColumn("third_party", F.lit(True))
    reason = [F.when(F.col(r), F.lit(r)) for r in ("generated", "minified", "third_party", "data")]
    out = judged.join(copies, "copy", "left").withColumn("third_party", F.coalesce("third_party", F.lit(False)) | F.col("package"))
    return out.select("path", F.array_compact(F.array(*reason)).alias("reasons")).where(F.size("reasons") > 0)
