"""Language of each text and of each stretch of a mixed text, by compression.

One zstandard raw-content dictionary is made for each language. A sentence belongs to the language whose dictionary
compresses it to the fewest bytes; where the margin to the second is narrow it is rejected and takes the language of
the decided sentences around it.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomline.session import latest

# The languages, the ways in which their names are written, and their commonest words.
NAMES = {
    "english": "en eng english inglese englisch anglais inglés ingles inglês engels engelska engelsk английский",
    "italian": "it ita italian italiano italienisch italien italiaans italienska italiensk итальянский",
    "german": "de deu ger german deutsch tedesco allemand alemán aleman alemão duits tyska tysk немецкий",
    "french": "fr fra fre french français francais francese französisch francés frances francês frans franska fransk французский",
    "spanish": "es spa spanish español espanol castellano spagnolo spanisch espagnol espanhol spaans spanska spansk испанский",
    "portuguese": "pt por portuguese português portugues portoghese portugiesisch portugais portugués portugees portugisiska portugisisk португальский",
    "dutch": "nl nld dut dutch nederlands olandese niederländisch néerlandais neerlandais holandés holandês nederländska hollandsk нидерландский",
    "swedish": "sv swe swedish svenska svedese schwedisch suédois suedois sueco zweeds svensk шведский",
    "danish": "da dan danish dansk danese dänisch danois danés danes dinamarquês deens danska датский",
    "russian": "ru rus russian русский russo russisch russe ruso russisk ryska",
}
COMMON = {
    "english": "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were all her there been their has when who will more no if out so said what about into than only other can those",
    "italian": "di e il la che in a per un è non una sono da si con del le della i al come più lo nel alla ma anche gli ha dei questo se delle o cui dal ci quando molto stato nella essere ancora dopo prima così perché tutti",
    "german": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man",
    "french": "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se il ce sont avec mais son aux ou cette a été nous leur deux même elle on ces comme tout y après sans encore entre peut fait aussi lui",
    "spanish": "de la que el en y a los se del las un por con no una su para es al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante todos uno les ni otros ese eso",
    "portuguese": "de a o que e do da em um para com não uma os no se na por mais as dos como mas ao ele das à seu sua ou quando muito nos já eu também só pelo pela até isso ela entre depois sem mesmo aos seus quem nas esse eles você essa foi são está",
    "dutch": "de van een het en in is dat op te zijn voor met die niet aan er om ook als dan maar bij nog uit wordt door naar was tot over heeft of hij worden zij deze kan meer ze al geen wel moet zo na dit hun zou weer pas zonder eerst",
    "swedish": "och i att det som en på är av för med den till inte om ett har de men var jag sig från vi så kan när han skulle nu under också efter eller sin där mot ut vid bara utan mycket hon dem upp alla andra något än vad sedan två hade in",
    "danish": "og i at det er en til på som af for med den de ikke der et har var han fra om men vi jeg sig kan så når over hun ved eller efter skal blev også dem ud mod nu været under meget hvor alle bliver kun ind havde op noget uden anden",
    "russian": "и в не на я что он с как это по но из у за то все так его от же для о бы к мы она они был только когда уже или если при ещё до чтобы быть была нет без мне во время также там где есть надо тем себя после между этот",
}
SPELLINGS = {w: lang for lang, words in NAMES.items() for w in words.split()}

FENCE = re.compile(r"^[ \t]*(`{3,}|~{3,}).*?(?:^[ \t]*\1[`~]*[ \t]*$|\Z)", re.S | re.M)
QUOTED = re.compile(r"\([^()\n]{0,80}\)|\"[^\"\n]{1,120}\"|“[^”\n]{1,120}”|„[^“”\n]{1,120}[“”]|«[^»\n]{1,120}»|‘[^’\n]{1,120}’")
INLINE = re.compile(r"`[^`\n]*`|!?\[\[[^\]\n]*\]\]|\*\*[^*\n]*\*\*|https?://\S+|!?\[[^\]\n]*\]\([^)\n]*\)|<[^<>\n]{1,80}>")
END = re.compile(r"(?<=[.!?…])[\"'”’»)\]]*\s+(?=\S)|\n[ \t]*\n")
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")


def named(label: str | None) -> str | None:
    """The language a label names, whatever its spelling, or None."""
    text = unicodedata.normalize("NFC", label or "").strip().lower()
    return SPELLINGS.get(text) or SPELLINGS.get(re.split(r"[-_ (]", text)[0]) if text else None


def sentences(body: str | None) -> list[str]:
    """Whole sentences of a text in order: no headings, code, quoted titles or single terms."""
    text = re.sub(r"\r\n?", "\n", unicodedata.normalize("NFC", body or ""))
    text = FENCE.sub("\n\n", text)
    text = re.sub(r"^[ \t]*(?:#{1,6}[ \t].*|(?: {4}|\t)\S.*|[-=*_]{3,}[ \t]*)$", "\n", text, flags=re.M)
    text = re.sub(r"^[ \t]*(?:>[ \t]?|[-*+][ \t]+(?:\[.\][ \t]+)?|\d+[.)][ \t]+)", "", text, flags=re.M)
    text = INLINE.sub(" ", QUOTED.sub(" ", INLINE.sub(" ", text)))
    out = []
    for part in END.split(text):
        words = WORD.findall(part)
        if len(words) >= 4:
            out.append(" ".join(part.split()))
    return out


def _key(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", word.lower()) if not unicodedata.combining(c))


def dictionaries(labelled: list[tuple[str, str]], size: int = 32768) -> dict[str, bytes]:
    """Raw-content dictionaries from (language, text) pairs of which some are wrong.

    A sentence is kept for a language if the words of the sample, weighed by how often each language has them, agree.
    """
    count: dict[str, Counter[str]] = {lang: Counter({_key(w): 3 for w in words.split()}) for lang, words in COMMON.items()}
    split = [(lang, s, [_key(w) for w in WORD.findall(s)]) for lang, text in labelled for s in dict.fromkeys(sentences(text))]
    for lang, _, words in split:
        count[lang].update(set(words))
    total = {lang: sum(c.values()) + 1 for lang, c in count.items()}
    kept: dict[str, list[str]] = defaultdict(list)
    for lang, s, words in split:
        score = {x: sum(math.log((c[w] + 0.05) / total[x]) for w in set(words)) for x, c in count.items()}
        if max(score, key=score.__getitem__) == lang:
            kept[lang].append(s)
    out = {}
    for lang, words in COMMON.items():
        body, used, seen = [], 0, set()
        for s in kept[lang]:
            if used >= size:
                break
            if s not in seen:
                seen.add(s)
                body.append(s)
                used += len(s.encode()) + 1
        out[lang] = (words + "\n" + "\n".join(reversed(body))).lower().encode()
    return out


class Verdict(NamedTuple):
    lang: str
    margin: float  # (second - best) / best
    confidence: float


class Judge:
    """The language of a sentence: smallest compressed size, letter case apart; ties go to the first language."""

    def __init__(self, raw: dict[str, bytes], level: int = -1) -> None:
        self.langs, self.by = list(raw), []
        for data in raw.values():
            d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.by.append(zstandard.ZstdCompressor(dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))

    def __call__(self, text: str) -> Verdict:
        data = text.lower().encode()
        sizes = [len(c.compress(data)) for c in self.by]
        best = min(range(len(sizes)), key=lambda i: (sizes[i], i))
        rest = sorted(sizes)[1]
        share = sum(2.0 ** (-min(60, x - sizes[best])) for x in sizes)
        return Verdict(self.langs[best], (rest - sizes[best]) / max(1, sizes[best]), 1 / share)


class Stretch(NamedTuple):
    lang: str
    confidence: float
    sentences: int
    text: str


def stretches(body: str | None, judge, narrow: float = 0.08) -> list[Stretch]:
    """Longest stretches of sentences in one language, in the body's order.

    A sentence whose margin is under `narrow` is rejected, one under twice that too if both neighbours agree on another
    language; a rejected one joins the decided sentence before it, else the one after. If none is decided, the whole
    text is judged at once.
    """
    parts = sentences(body)
    if not parts:
        return []
    got = [judge(s) for s in parts]
    langs: list[str | None] = [v.lang if v.margin >= narrow else None for v in got]
    for i, v in enumerate(got):
        if v.margin < 2 * narrow and 0 < i < len(got) - 1 and got[i - 1].lang == got[i + 1].lang != v.lang:
            langs[i] = None
    if not any(langs):
        whole = judge(" ".join(parts))
        return [Stretch(whole.lang, whole.confidence, len(parts), " ".join(parts))]
    last = next(x for x in langs if x)
    out: list[list[int]] = []
    final: list[str] = []
    for i, x in enumerate(langs):
        last = x or last
        final.append(last)
        if i and final[i - 1] == last:
            out[-1].append(i)
        else:
            out.append([i])
    return [Stretch(final[g[0]], sum(got[i].confidence if langs[i] else 0.5 for i in g) / len(g), len(g), " ".join(parts[i] for i in g)) for g in out]


def language_stretches(
    df: DataFrame, *, id_col: str = "id", text_col: str = "body", label_col: str = "lang", per_language: int = 400, sample_chars: int = 20_000, dictionary: int = 32768, narrow: float = 0.08
) -> DataFrame:
    """(id, segment_no, found_lang, confidence, sentences, labelled, is_case): a row for each stretch of each record.

    df has id_col, text_col, label_col, mtime; other columns are ignored. A repeated id is one record (the latest row).
    `labelled` is the language its label names, null if it names none; is_case is true if that isn't the language of
    the whole body or the body has several. Null and empty texts and texts without a sentence give no rows, nor does a
    null id; an empty table gives none.

    The dictionaries are fitted on at most per_language labelled records of each language, taken by the hash of their
    id, and of each at most sample_chars characters, whatever the table's size; every record is judged whole.
    """
    records = latest(df, id_col, text_col, label_col)
    name = F.udf(named, "string")
    asked = df.where(F.col(label_col).isNotNull()).select(label_col).distinct()
    known = asked.withColumn("_l", name(label_col)).where("_l is not null")
    picked = df.join(known, label_col).where(F.length(text_col) > 40).select("_l", id_col, F.substring(text_col, 1, sample_chars).alias(text_col))
    first = picked.withColumn("_n", F.row_number().over(Window.partitionBy("_l").orderBy(F.xxhash64(id_col)))).where(F.col("_n") <= per_language)
    raw = dictionaries([(r["_l"], r[text_col]) for r in first.orderBy("_l", "_n").collect()], dictionary)
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = lru_cache(100_000)(Judge(raw))
        for batch in batches:
            rows = []
            for key, text, label in zip(batch[id_col], batch[text_col], batch[label_col], strict=True):
                found = stretches(text, judge, narrow)
                said = named(label)
                case = len(found) > 1 or bool(found) and found[0].lang != said
                rows += [(key, n, s.lang, s.confidence, s.sentences, said, case) for n, s in enumerate(found, 1)]
            yield pd.DataFrame(rows, columns=["id", "segment_no", "found_lang", "confidence", "sentences", "labelled", "is_case"])

    return records.mapInPandas(run, f"id {kind}, segment_no int, found_lang string, confidence double, sentences int, labelled string, is_case boolean")
