"""Named queries over the tables, each with its SQL where SQL can say it. All run over whole tables."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathomline.functions.text import STOP_WORDS, in_folder, line_at, stem_of, version
from fathomline.operators import codegraph, convert, dense, evaluate, files, history, index, links, prose, reading, search
from fathomline.plans import star
from fathomline.session import latest, names_in, prepare, shared, spread, table, work_dir
from fathomline.sources import pdf
from fathomline.streaming import refresh

QUESTION = "open question glossary compiler photosynthesis zebra"
SECOND = "reading list database cache"
FOLDER = "adr"
CUT = "2026-01-01"
CUT_SECONDS = 1767225600


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    """documents as a corpus: the key is the id, the name the stem of the path."""
    d = table(prepare(spark), folder, "documents")
    return spread(d.select(F.col("doc_id").alias("key"), stem_of(F.col("path")).alias("name"), "text", "mtime", "path"))


def notes(spark: SparkSession, folder: str) -> DataFrame:
    """The present state of each note: (path, text, mtime)."""
    n = table(prepare(spark), folder, "note_content")
    return latest(n, "note_id", "path", "content", "mtime").select("path", F.regexp_replace("content", "\r\n?", "\n").alias("text"), "mtime")


def sources(spark: SparkSession, folder: str) -> DataFrame:
    return latest(table(prepare(spark), folder, "sources"), "path", "text").select("path", "text")


def _kept(spark: SparkSession, folder: str, name: str, docs: DataFrame, profile: str) -> index.Index:
    """The persisted index of a corpus in the shared folder, brought up to date first: a change of nothing reads the
    documents' times only."""
    place = f"{work_dir(spark)}/fathomline-index/{name}-{profile}-{hashlib.sha1(folder.encode()).hexdigest()[:12]}"
    index.refresh(spark, place, docs, profile=profile)
    return index.load(spark, place)


def words_index(spark: SparkSession, folder: str) -> index.Index:
    return _kept(spark, folder, "documents", corpus(spark, folder), "words")


# --- tokens, index, ranking -----------------------------------------------------------------------------------------

# The function words again, for the SQL alone, so that an error in the column expressions shows.
STOPS_SQL = """
    i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs
    themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because
    as until while of at by for with about against between into through during before after above below to from up down in out on off over under again further
    then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don
    should now d ll m o re ve y ain aren couldn didn doesn hadn hasn haven isn ma mightn mustn needn shan shouldn wasn weren won wouldn versus via etc
    io me mi mio mia miei mie tu te ti tuo tua tuoi tue lui lei sé si suo sua suoi sue noi ci nostro nostra nostri nostre voi vi vostro vostra vostri vostre
    loro essi esse esso essa questo questa questi queste quello quella quelli quelle ciò che chi cui il lo la i gli le un uno una di a da in con su per tra fra
    del dello della dei degli delle al allo alla ai agli alle dal dallo dalla dai dagli dalle nel nello nella nei negli nelle sul sullo sulla sui sugli sulle e
    ed o ma se anche non né come dove quando perché mentre oppure sia ancora già più meno molto poco tutto tutti tutta tutte ogni qualche alcuni alcune altro
    altra altri altre stesso stessa stessi stesse sono sei è siamo siete eri eravamo erano essere stato stata stati ho hai ha abbiamo avete hanno aveva avevano
    avere avuto fa fanno fare fatto può possono qui qua lì là così poi
"""
STOPPED = f"(SELECT DISTINCT strip_accents(unnest(regexp_extract_all('{STOPS_SQL}', '[^\\s]+'))))"
NAME = r"regexp_replace(regexp_extract(path, '([^/]*)$', 1), '(.)\.[^.]*$', '\1')"
WORD_SQL = rf"""
    w AS (SELECT doc_id AS key, unnest(list_transform(regexp_extract_all(concat_ws(chr(10), {NAME}, coalesce(text, '')), '[\p{{L}}\p{{N}}]+'), lambda x: strip_accents(lower(x)))) AS term FROM documents),
    t AS (SELECT key, term, count(*) AS tf FROM w WHERE length(term) >= 2 AND term NOT IN {STOPPED} GROUP BY key, term),
    l AS (SELECT d.doc_id AS key, coalesce(sum(tf), 0) AS dl FROM documents d LEFT JOIN t ON t.key = d.doc_id GROUP BY d.doc_id),
    st AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl FROM l)"""


def ranking_sql(name: str, terms: list[str]) -> str:
    listed = ", ".join(f"'{x}'" for x in terms)
    return f"""
    i{name} AS (SELECT term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM t, st WHERE term IN ({listed}) GROUP BY term, n),
    r{name} AS (SELECT t.key, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * greatest(dl, 1) / avgdl))) AS score, list_sort(list(t.term)) AS matched
                FROM t JOIN i{name} i ON t.term = i.term JOIN l ON l.key = t.key, st GROUP BY t.key)"""


TERMS, TERMS2 = ["compiler", "glossary", "open", "photosynthesis", "question", "zebra"], ["cache", "database", "list", "reading"]
BOTH_SQL = f"WITH {WORD_SQL}, {ranking_sql('a', TERMS)}, {ranking_sql('b', TERMS2)}"
ONE_SQL = f"WITH {WORD_SQL}, {ranking_sql('a', TERMS)}, mass AS (SELECT sum(idf) + (SELECT {len(TERMS)} - count(*) FROM ia) * ln(1 + (n + 0.5) / 0.5) AS m FROM ia, st GROUP BY n), mm AS (SELECT coalesce(max(m), 1) AS m FROM mass)"
COVER_SQL = ONE_SQL + ", cv AS (SELECT r.key, any_value(r.score) AS score, sum(idf) / any_value(m) AS coverage FROM (SELECT key, score, unnest(matched) AS term FROM ra) r JOIN ia ON ia.term = r.term, mm GROUP BY r.key)"


def tokenize_words(spark, folder):
    t = index.tokenised(corpus(spark, folder), "words")
    return t.groupBy("key").agg(F.count("*").alias("n_tokens"), F.count_distinct("term").alias("n_terms"))


def postings(spark, folder):
    return index.postings_of(corpus(spark, folder), "words")


def index_build(spark, folder):
    """A new index of the corpus, written and read again."""
    place = f"{work_dir(prepare(spark))}/fathomline-index/new-{uuid.uuid4().hex}"
    index.refresh(spark, place, corpus(spark, folder), profile="words")
    return index.load(spark, place).postings


def function_words(spark, folder):
    return prepare(spark).createDataFrame([(w,) for w in STOP_WORDS], "word string")


def full_tokens(spark, folder):
    """The whole token stream, counted."""
    return index.postings_of(star.technical(spark, folder), "full")


def doc_freq_idf(spark, folder):
    return search.idf_table(words_index(spark, folder)).select("term", "df", F.round("idf", 6).alias("idf"))


def _ranked(spark, folder):
    own = words_index(spark, folder)
    terms = search.query_terms(spark, QUESTION, "words")
    weights = search.Weights.of(own, terms)
    return own, terms, weights, search.bm25(own, terms, weights)


def bm25_topk(spark, folder):
    return search.top(_ranked(spark, folder)[3], 20).select("key", F.round("score", 6).alias("score"), "rank")


def bm25_matched_terms(spark, folder):
    return _ranked(spark, folder)[3].select("key", F.array_join("matched", " ").alias("matched"), F.round("score", 6).alias("score"))


def coverage(spark, folder):
    _, _, weights, docs = _ranked(spark, folder)
    return docs.select("key", F.round(search.coverage(F.col("matched"), weights), 6).alias("coverage"))


def terms_absent(spark, folder):
    weights = _ranked(spark, folder)[2]
    return spark.createDataFrame([(t,) for t in weights.absent], "term string")


def terms_absent_in_scope(spark, folder):
    """Terms that documents hold and those of a folder don't; keys are paths here."""
    docs = corpus(spark, folder).withColumn("key", F.col("path"))
    own = _kept(spark, folder, "paths", docs, "words")
    return spark.createDataFrame([(t,) for t in search.absent_in(own, list(search.Weights.of(own, TERMS).known), FOLDER)], "term string")


def exclude_paging(spark, folder):
    """The second page of documents: a search without those of the first."""
    docs = corpus(spark, folder)
    own = words_index(spark, folder)

    def page(exclude):
        return search.search(spark, own, docs, QUESTION, k=5, exclude=exclude, profile="words").documents.where("rank <= 5").select("key", "rank")

    return page(tuple(r["key"] for r in page(()).collect()))


def unseen_count(spark, folder):
    _, _, weights, docs = _ranked(spark, folder)
    docs = docs.withColumn("coverage", search.coverage(F.col("matched"), weights))
    shown = search.top(docs, 5)
    bar = shown.agg(F.min("coverage").alias("bar"))
    rest = docs.join(shown.select("key"), "key", "left_anti").join(F.broadcast(bar), F.col("coverage") >= F.col("bar") - 1e-12)
    return rest.agg(F.count("*").alias("unseen"))


def query_groups_rrf(spark, folder):
    own = words_index(spark, folder)
    lists = [search.bm25(own, search.query_terms(spark, q, "words")) for q in (QUESTION, SECOND)]
    ranks = [index.global_rank(x, [F.desc(F.round("score", 9)), "key"]) for x in lists]
    return search.rrf(ranks, ["key"]).select("key", F.round("fused", 9).alias("fused"))


def rrf_hybrid(spark, folder):
    lexical = index.global_rank(_ranked(spark, folder)[3], [F.desc(F.round("score", 9)), "key"])
    vectors = index.global_rank(_cosines(spark, folder), [F.desc(F.round("cos", 9)), "key"])
    return search.rrf([lexical, vectors], ["key"]).select("key", F.round("fused", 9).alias("fused"))


def section_split(spark, folder):
    found = index.sections_of(notes(spark, folder).select(F.col("path").alias("key"), "text"))
    return found.select(F.col("key").alias("path"), "off", F.length("section").alias("n_chars"))


def section_bm25_pool(spark, folder):
    """The second stage: sections of the ten best documents, the documents' idf, the pool's average length."""
    own, terms, weights, docs = _ranked(spark, folder)
    pool = search.top(docs, 10)
    parts = reading.text_lines(corpus(spark, folder).join(pool, "key", "left_semi")).where("content <> ''")
    found = index.section_terms(parts.select("key", "off", F.col("content").alias("section")), "words").cache()
    average = found.select("key", "off", "dl").distinct().agg(F.avg("dl").alias("average"))
    part = search._bm25(F.col("tf"), F.col("dl"), F.col("average"), weights.column(F.col("term")))
    hit = found.where(F.col("term").isin(list(weights.known))).join(F.broadcast(average), F.lit(True))
    return hit.groupBy("key", "off").agg(F.round(F.sum(part), 6).alias("score"))


def per_doc_cap(spark, folder):
    """At most two lines of a document, eight in all, by how often they hold the word."""
    lines = reading.text_lines(corpus(spark, folder)).withColumn("n", F.size(F.regexp_extract_all(F.lower("content"), F.lit("checklist"), F.lit(0)))).where("n > 0")
    first = lines.withColumn("rn", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("n"), "line"))).where("rn <= 2")
    return first.orderBy(F.desc("n"), "key", "line").limit(8).select("key", "line", "n")


def hit_lines(spark, folder):
    at = F.instr("text", "glossary")
    return corpus(spark, folder).where(F.contains("text", F.lit("glossary"))).select("key", line_at(F.col("text"), at - 1).alias("line"))


def content_version(spark, folder):
    return corpus(spark, folder).where("text is not null").select("key", version(F.col("text")).alias("version"))


def version_guard(spark, folder):
    """Each delivered row of a note as an expected version against the note's present state."""
    rows = table(prepare(spark), folder, "note_content").where("content is not null")
    text = F.regexp_replace("content", "\r\n?", "\n")
    expected = rows.select("path", version(text).alias("expect_version")).distinct()
    out = files.guarded(notes(spark, folder).where("text is not null"), expected)
    return out.groupBy("outcome").agg(F.count("*").alias("n"))


def _note_corpus(spark, folder):
    return notes(spark, folder).select(F.col("path").alias("key"), stem_of(F.col("path")).alias("name"), "text", "mtime")


def search_hits(spark, folder):
    """Two query groups over the persisted index of the notes, with windows."""
    n = _note_corpus(spark, folder)
    hits = search.search(spark, _kept(spark, folder, "notes", n, "full"), n, "open question about the glossary", k=8, queries=("rough draft",)).hits
    return hits.select("key", "section", "line", "version", "score", F.array_join("matched_terms", " ").alias("matched_terms"), "coverage", "window")


def _search_sections(spark, folder):
    n = _note_corpus(spark, folder)
    return search.search(spark, _kept(spark, folder, "notes", n, "words"), n, QUESTION, k=8, profile="words")


def search_sections(spark, folder):
    """The whole search for one question: documents, then their sections, two of a document, eight in all."""
    return _search_sections(spark, folder).hits.select("key", "section", "off", "first_line", "last_line", "score", F.array_join("matched_terms", " ").alias("matched_terms"), "coverage")


def search_signals(spark, folder):
    """The counts beside the hits: candidates, and ranked documents that weren't shown and match as well."""
    s = _search_sections(spark, folder).signals
    return spark.createDataFrame([(s["candidates"], s["unseen"], s["docs_in_scope"], " ".join(s["terms_absent"]))], "candidates long, unseen long, docs long, absent string")


def search_documents(spark, folder):
    return _search_sections(spark, folder).documents.where("rank <= 8").select("key", "score", F.array_join("matched_terms", " ").alias("matched_terms"), "coverage", "rank")


def search_code(spark, folder):
    """Units of source files as what is cut, cited from first to last line."""
    s = sources(spark, folder).withColumn("mtime", F.lit(0.0))
    docs = s.select(F.col("path").alias("key"), stem_of(F.col("path")).alias("name"), "text", "mtime")
    parts = codegraph.units(s, codegraph.skeletons(s)).select(F.col("path").alias("key"), "off", F.col("unit").alias("section"), "title")
    hits = search.search(spark, _kept(spark, folder, "sources", docs, "full"), docs, "load posting manifest", k=8, parts=parts).hits
    return hits.select("key", "section", "first_line", "last_line", "score")


def near_terms(spark, folder):
    return search.near_terms(words_index(spark, folder), ["glosary", "compilor", "bibliografy"])


# --- vectors --------------------------------------------------------------------------------------------------------


def _cosines(spark, folder):
    e = table(prepare(spark), folder, "embeddings")
    q = [float(x) for x in e.where("vec_id = 0").select("embedding").first()[0]]
    literal = F.array(*map(F.lit, q))
    return e.select(F.col("vec_id").alias("key"), dense.cosine(F.col("embedding"), literal).alias("cos"))


def cosine_topk(spark, folder):
    best = _cosines(spark, folder).select("key", F.round("cos", 6).alias("cos")).orderBy(F.desc("cos"), "key").limit(20)
    return best


def int8_quantize(spark, folder):
    q = table(prepare(spark), folder, "embeddings").select("vec_id", dense.quantised(F.col("embedding")).alias("q"))
    return q.select("vec_id", F.array_join(F.col("q.codes").cast("array<string>"), " ").alias("codes"), F.round(F.col("q.scale").cast("double"), 6).alias("scale"))


def embed_units(spark, folder):
    """What is embedded of the notes: sections with three tokens and more, with stem and title before."""
    found = dense.section_units(_note_corpus(spark, folder), "words")
    return found.select("key", "off", F.length("unit").alias("n_chars"))


def _codes(spark, folder):
    """The embeddings' codes, quantised once for a state of the file and kept in the shared folder."""
    files_, path = shared(spark, f"{folder}/embeddings.parquet")
    status = files_.getFileStatus(path)
    stamp = hashlib.sha1(f"{folder} {status.getModificationTime()} {status.getLen()}".encode()).hexdigest()[:12]
    place = f"{work_dir(spark)}/fathomline-index/vectors-{stamp}"
    if "_SUCCESS" not in names_in(spark, place):
        e = table(spark, folder, "embeddings")
        made = e.select(F.col("label").alias("key"), F.col("vec_id").alias("off"), dense.quantised(F.col("embedding")).alias("q")).select("key", "off", "q.codes", "q.scale")
        dense.save(made, place, model="given")
    return dense.load(spark, place, model="given")


def dense_rank(spark, folder):
    """The int8 path over stored codes: scores in Arrow batches, best section of each document."""
    q = [float(x) for x in table(prepare(spark), folder, "embeddings").where("vec_id = 0").select("embedding").first()[0]]
    return dense.scores(_codes(spark, folder), q).groupBy("key").agg(F.round(F.max("cos"), 3).alias("cos"))


# --- files and reading ----------------------------------------------------------------------------------------------


def _files(spark, folder):
    d = table(prepare(spark), folder, "documents")
    listed = d.select("path", F.col("n_chars").alias("bytes"), "mtime")
    read = d.where(F.col("read_at") < F.lit(CUT).cast("timestamp"))
    state = read.select(F.col("path").alias("key"), "mtime", F.when(F.col("lang").isNull(), "failed").otherwise("indexed").alias("outcome"), F.when(F.col("lang").isNull(), "no language").alias("reason"))
    return listed, state


def files_status(spark, folder):
    return files.statuses(*_files(spark, folder)).select("path", "status", "reason")


def scope_counts(spark, folder):
    return files.scope_counts(files_status(spark, folder), FOLDER)


def inventory_counts(spark, folder):
    return files_status(spark, folder).groupBy("status").agg(F.count("*").alias("n"))


def hidden_paths(spark, folder):
    """Paths that no search shows: originals under the folder that is written to, staging, exports at the root."""
    d = table(prepare(spark), folder, "documents").select("doc_id", F.concat(F.element_at(F.array(F.lit(""), F.lit("sources/"), F.lit("INBOX/"), F.lit("Adr/Sources/"), F.lit("adr/sources/")), (F.col("doc_id") % 5 + 1).cast("int")), "path").alias("path"))
    path = F.col("path")
    kinds = (F.when(files.is_source_leaf(path, "adr"), "source"), F.when(files.is_inbox(path, "adr"), "inbox"), F.when(files.is_artifact(path), "artifact"))
    return d.select("doc_id", F.coalesce(*kinds).alias("kind")).where("kind is not null")


def index_changes(spark, folder):
    """What a refresh would do: live documents against stamps of those read in before a day."""
    d = table(prepare(spark), folder, "documents")
    live = d.where("lang is not null").select(F.col("path").alias("key"), "mtime")
    stamped = d.where(F.col("read_at") < F.lit(CUT).cast("timestamp")).select(F.col("path").alias("key"), F.when(F.lower("lang") == "en", F.col("mtime")).otherwise(F.col("mtime") - 1).alias("mtime"))
    return index.changes(live, stamped)


def since_filter(spark, folder):
    return files.since(table(prepare(spark), folder, "documents"), f"{CUT}T00:00:00+00:00").select("doc_id", "path")


def folder_scope(spark, folder):
    return corpus(spark, folder).where(in_folder(F.col("path"), "PROJECTS/birch/")).select("key", "path")


def latest_notes(spark, folder):
    return notes(spark, folder).select("path", F.coalesce(F.length("text"), F.lit(0)).alias("n_chars"), "mtime")


def read_slice_budget(spark, folder):
    return reading.line_slice(corpus(spark, folder).where("text is not null"), 1, None, 500).select("key", "first", "last", F.coalesce("next_start", F.lit(0)).alias("next_start"), F.length("text").alias("n_chars"))


def outline(spark, folder):
    return reading.headings(star.notes(spark, folder).select(F.col("path").alias("key"), "text"))


def section_ends(spark, folder):
    return reading.with_ends(outline(spark, folder)).withColumn("end_off", F.coalesce("end_off", F.lit(-1)))


def context_search(spark, folder):
    d = corpus(spark, folder).select(F.col("key").cast("string").alias("path"), "text")
    return links.context_search(d, ["Checklist", "open question"])


# --- prose ----------------------------------------------------------------------------------------------------------


def language_detect(spark, folder):
    return corpus(spark, folder).select("key", prose.detected(F.col("text")).alias("detected"))


def clean_tags(spark, folder):
    return table(prepare(spark), folder, "documents").where("source is not null").select("doc_id", prose.clean_tag(F.col("source")).alias("tag"))


def clean_bodies(spark, folder):
    body = prose.clean_body(F.col("text"), fences=True)
    return star.described(spark, folder).select("key", F.trim(F.regexp_replace(body, r"\s+", " ")).alias("body"))


def front_properties(spark, folder):
    return prose.front_properties(star.described(spark, folder))


def alias_index(spark, folder):
    return prose.alias_index(star.described(spark, folder).select(F.concat(F.lit("parts/p"), "key", F.lit(".md")).alias("path"), "text"))


def segments(spark, folder):
    return prose.segmented(star.sectioned(spark, folder), 230)


def html_to_markdown(spark, folder):
    return convert.converted(star.pages(spark, folder)).select("path", "markdown", "reason")


def pdf_pages(spark, folder):
    return pdf.pages(star.documents(spark, folder)).select("key", "page", "off", "text")


def pages_asof(spark, folder):
    """The page on which each of some offsets of a PDF file's text lies."""
    pages = pdf.pages(star.documents(spark, folder)).select("key", "page", "off")
    at = pages.select("key").distinct().select("key", F.explode(F.array(*map(F.lit, (0, 5, 25, 27, 29, 40)))).alias("off"))
    return reading.pages_of(at, pages)


def section_by_title(spark, folder):
    return reading.section_by_title(star.notes(spark, folder).select(F.col("path").alias("key"), "text"), " PLACE ")


def name_search(spark, folder):
    return links.name_search(star.notes(spark, folder), "nation_1")


# --- graphs ---------------------------------------------------------------------------------------------------------


def wikilink_targets(spark, folder):
    found = links.extract(corpus(spark, folder).select("path", "text")).where("kind = 'note'")
    return found.groupBy("target").agg(F.count_distinct("src").alias("documents"))


def _graph(spark, folder):
    own = star.notes(spark, folder)
    return own, links.resolve(links.extract(own), own)


def link_graph(spark, folder):
    return links.edges(_graph(spark, folder)[1])


def graph_reach(spark, folder):
    start = spark.createDataFrame([("regions/ASIA.md",)], "path string")
    return links.reach(link_graph(spark, folder), start, 2)


def unresolved_links(spark, folder):
    return links.unresolved(_graph(spark, folder)[1])


def orphans(spark, folder):
    own, resolved = _graph(spark, folder)
    return links.orphans(own, links.edges(resolved))


def link_degrees(spark, folder):
    own, resolved = _graph(spark, folder)
    return links.degrees(own, links.edges(resolved))


def note_lint(spark, folder):
    return links.lint(*_graph(spark, folder))


def code_symbols(spark, folder):
    return codegraph.symbols(codegraph.skeletons(star.sources(spark, folder))).drop("decorators")


def code_units(spark, folder):
    s = star.sources(spark, folder)
    return codegraph.units(s, codegraph.skeletons(s)).select("path", "off", "title", F.length("unit").alias("n_chars"))


def _code(spark, folder):
    s = star.sources(spark, folder)
    found = codegraph.skeletons(s)
    return s, found, codegraph.import_edges(found, s)


def import_edges(spark, folder):
    return _code(spark, folder)[2]


def fan_in(spark, folder):
    return codegraph.importers(_code(spark, folder)[2])


def code_vocabulary(spark, folder):
    _, found, edges = _code(spark, folder)
    return codegraph.vocabulary(found, edges, 10)


def call_edges(spark, folder):
    _, found, edges = _code(spark, folder)
    return codegraph.call_edges(found, edges)


def class_hierarchy(spark, folder):
    return codegraph.hierarchy(codegraph.skeletons(star.sources(spark, folder)))


def skeleton_changes(spark, folder):
    """Files before suppliers came and a function of each region took no argument, against the files now."""
    now = star.sources(spark, folder)
    before = now.where(~F.startswith("path", F.lit("geo/suppliers/"))).withColumn("text", F.regexp_replace("text", r"def open_(\w+)\(\)", r"def open_$1(old)"))
    return codegraph.skeleton_diff(codegraph.skeletons(before), codegraph.skeletons(now))


def source_skeletons(spark, folder):
    """What the given source files declare, a row a file."""
    found = codegraph.skeletons(sources(spark, folder))
    return found.select("path", "language", "parse_error", F.size("symbols").alias("symbols"), F.size("imports").alias("imports"), F.size("calls").alias("calls"))


def innermost_symbols(spark, folder):
    """Each declaration's line and the narrowest symbol of the table that spans it."""
    s = table(prepare(spark), folder, "symbols").where("end_line >= line").select("path", "kind", F.trim("name").alias("name"), F.coalesce("parent", F.lit("")).alias("parent"), "line", "end_line").distinct()
    return codegraph.innermost(s.select("path", "line").distinct(), s)


# --- evaluation, events ---------------------------------------------------------------------------------------------


def ndcg_mrr_recall(spark, folder):
    """Each subject's name as a query, scored by how often a document holds it, against the hand-given labels."""
    own = index.postings_of(corpus(spark, folder), "words")
    areas = table(spark, folder, "subject_areas").select(F.lower("subject").alias("term"))
    run = own.join(areas, "term").select(F.col("term").alias("qid"), F.col("key").alias("did"), F.col("tf").cast("double").alias("score"))
    labels = table(spark, folder, "subject_labels").where("subject is not null").select(F.lower(F.trim("subject")).alias("qid"), F.col("doc_id").alias("did"), F.lit(1).alias("rel")).distinct()
    return evaluate.metrics(run, labels, 10).select("qid", *[F.round(c, 6).alias(c) for c in ("ndcg", "mrr", "recall")])


def windowed_activity(spark, folder):
    out = refresh.windowed_activity(table(prepare(spark), folder, "events"))
    return out.select("starts", "event_type", "n", F.round("total", 4).alias("total"))


def user_sessions(spark, folder):
    return refresh.sessions(table(prepare(spark), folder, "events"))


def record_drift(spark, folder):
    """Folders of the corpus as records, deliveries of documents as commits: an interval join with hubs left out."""
    d = table(prepare(spark), folder, "documents")
    at = F.floor(F.unix_timestamp("read_at"))
    log = d.select(F.sha1("path").alias("sha"), at.cast("long").alias("at"), "path")
    records = d.where("lang = 'en'").groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("path")).agg(F.min("mtime").alias("mtime")).select(F.concat("path", F.lit("/README")).alias("record"), "path", "mtime")
    return history.drift(log, records)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        tokenize_words, postings, doc_freq_idf, bm25_topk, bm25_matched_terms, coverage, terms_absent, terms_absent_in_scope, exclude_paging, unseen_count, query_groups_rrf, rrf_hybrid,
        section_split, section_bm25_pool, per_doc_cap, hit_lines, content_version, version_guard, search_hits, search_sections, search_signals, search_documents, search_code, index_build, full_tokens, function_words, near_terms, cosine_topk, int8_quantize, embed_units, dense_rank, files_status, hidden_paths, scope_counts,
        inventory_counts, index_changes, since_filter, folder_scope, latest_notes, read_slice_budget, outline, section_ends, context_search, language_detect, clean_tags, clean_bodies,
        front_properties, alias_index, segments, html_to_markdown, pdf_pages, pages_asof, section_by_title, name_search, wikilink_targets, link_graph, graph_reach, unresolved_links, orphans, link_degrees, note_lint, code_symbols, code_units, import_edges, fan_in, call_edges, code_vocabulary,
        class_hierarchy, skeleton_changes, source_skeletons, innermost_symbols, ndcg_mrr_recall, windowed_activity, user_sessions, record_drift,
    )
}

NOTES_SQL = r"n AS (SELECT arg_max(path, (mtime, read_at)) AS path, arg_max(struct_pack(c := content), (mtime, read_at)).c AS raw, max(mtime) AS mtime FROM note_content GROUP BY note_id), nn AS (SELECT path, regexp_replace(raw, '\r\n?', chr(10), 'g') AS text, mtime FROM n)"
LINES_SQL = "ln AS (SELECT doc_id AS key, unnest(string_split(regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g'), chr(10))) AS content, generate_subscripts(string_split(regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g'), chr(10)), 1) AS line FROM documents)"
STATUS_SQL = f"""
    s AS (SELECT path, mtime, lang IS NULL AS failed FROM documents WHERE read_at < TIMESTAMP '{CUT}'),
    f AS (SELECT d.path, CASE WHEN s.failed THEN 'failed' WHEN s.mtime = d.mtime THEN 'indexed' ELSE 'changed' END AS status, CASE WHEN s.failed THEN 'no language' END AS reason FROM documents d LEFT JOIN s ON s.path = d.path)"""


def _language_sql() -> str:
    order = prose.ORDER
    counts = ", ".join(
        "struct_pack(n := len(list_filter(w, lambda x: x IN ({}))), i := {}, lang := '{}')".format(", ".join("'" + x.replace("'", "''") + "'" for x in prose.LANGUAGES[lang].split()), -i, lang) for i, lang in enumerate(order)
    )
    return rf"WITH d AS (SELECT doc_id AS key, list_transform(regexp_extract_all(coalesce(text, ''), '\p{{L}}+'), lambda x: lower(x)) AS w FROM documents) SELECT key, list_max([{counts}]).lang AS detected FROM d"


SECTIONS_SQL = f"""WITH {NOTES_SQL}, {WORD_SQL.replace("FROM documents)", "FROM nn WHERE text IS NOT NULL)").replace("doc_id AS key, unnest", "path AS key, unnest").replace("d.doc_id AS key", "d.path AS key").replace("FROM documents d LEFT JOIN t ON t.key = d.doc_id GROUP BY d.doc_id", "FROM nn d LEFT JOIN t ON t.key = d.path WHERE d.text IS NOT NULL GROUP BY d.path")}, {ranking_sql('a', TERMS)},
    mass AS (SELECT coalesce(max(m), 1) AS m FROM (SELECT sum(idf) + (SELECT {len(TERMS)} - count(*) FROM ia) * ln(1 + (n + 0.5) / 0.5) AS m FROM ia, st GROUP BY n)),
    cv AS (SELECT r.key, any_value(r.score) AS score, any_value(r.matched) AS matched, sum(idf) / any_value(m) AS coverage FROM (SELECT key, score, matched, unnest(matched) AS term FROM ra) r JOIN ia ON ia.term = r.term, mass GROUP BY r.key),
    pool AS (SELECT *, row_number() OVER (ORDER BY score DESC, key) AS rank FROM cv ORDER BY score DESC, key LIMIT 24),
    x AS (SELECT path, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM nn WHERE path IN (SELECT key FROM pool)),
    z AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^#{{1,4}} ') THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY i) AS part, coalesce(sum(length(line) + 1) OVER (PARTITION BY path ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM x),
    sec AS (SELECT path AS key, CAST(min(off) AS INT) AS off, string_agg(line, chr(10) ORDER BY i) AS section, min(i) AS first_line, max(i) FILTER (regexp_matches(line, '\\S')) AS last_line, max(i) AS last_i FROM z GROUP BY path, part HAVING max(length(regexp_replace(line, '\\s', '', 'g'))) > 0),
    tk AS (SELECT key, off, list_filter(list_transform(regexp_extract_all(section, '[\\p{{L}}\\p{{N}}]+'), lambda v: strip_accents(lower(v))), lambda v: length(v) >= 2 AND NOT list_contains(stops, v)) AS toks FROM sec, (SELECT list_transform(regexp_extract_all('{STOPS_SQL}', '[^\\s]+'), lambda u: strip_accents(u)) AS stops)),
    av AS (SELECT greatest(avg(len(toks)), 1e-9) AS a FROM tk), e AS (SELECT key, off, len(toks) AS dl, unnest(toks) AS term FROM tk),
    f AS (SELECT key, off, term, count(*) AS tf, any_value(dl) AS dl FROM e GROUP BY key, off, term),
    sc AS (SELECT key, off, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / a))) AS score, list_sort(list(f.term)) AS matched, sum(idf) / any_value(m) AS coverage FROM f JOIN ia ON ia.term = f.term, av, mass GROUP BY key, off),
    h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, off) AS rn FROM sc) WHERE rn <= 2 ORDER BY score DESC, key, off LIMIT 8)"""

ORACLE_SQL = {
    **star.ORACLE_SQL,
    "hidden_paths": r"""WITH p AS (SELECT doc_id, ['', 'sources/', 'INBOX/', 'Adr/Sources/', 'adr/sources/'][doc_id % 5 + 1] || path AS p FROM documents)
        SELECT * FROM (SELECT doc_id, CASE WHEN regexp_matches(p, '^(adr/)?sources/') THEN 'source' WHEN regexp_matches(lower(p), '^(adr/)?inbox/') THEN 'inbox' WHEN regexp_matches(p, '^(log|GRAPH_REPORT)(\.md)?$') THEN 'artifact' END AS kind FROM p) WHERE kind IS NOT NULL""",
    "embed_units": SECTIONS_SQL.replace("WHERE path IN (SELECT key FROM pool)", "WHERE text IS NOT NULL") + r" SELECT tk.key, tk.off, CAST(length(regexp_replace(regexp_extract(tk.key, '([^/]*)$', 1), '(.)\.[^.]*$', '\1')) + 4 + length(CASE WHEN starts_with(section, '#') THEN trim(regexp_replace(string_split(section, chr(10))[1], '^#+', '')) ELSE '' END) + least(6000, length(section) + CASE WHEN last_i < most THEN 1 ELSE 0 END) AS INT) AS n_chars FROM tk JOIN sec ON sec.key = tk.key AND sec.off = tk.off JOIN (SELECT path, max(i) AS most FROM x GROUP BY path) q ON q.path = tk.key WHERE len(toks) >= 3",
    "search_sections": SECTIONS_SQL + " SELECT h.key, CASE WHEN starts_with(section, '#') THEN trim(regexp_replace(string_split(section, chr(10))[1], '^#+', '')) ELSE '' END AS section, h.off, CAST(first_line AS INT) AS first_line, CAST(last_line AS INT) AS last_line, round(score, 2) AS score, array_to_string(matched, ' ') AS matched_terms, round(coverage, 2) AS coverage FROM h JOIN sec ON sec.key = h.key AND sec.off = h.off",
    "search_documents": SECTIONS_SQL + " SELECT key, round(score, 2) AS score, array_to_string(matched, ' ') AS matched_terms, round(coverage, 2) AS coverage, CAST(rank AS INT) AS rank FROM pool WHERE rank <= 8",
    "search_signals": SECTIONS_SQL + f", seen AS (SELECT DISTINCT key FROM h), bar AS (SELECT min(coverage) AS least FROM cv WHERE key IN (SELECT key FROM seen)) SELECT (SELECT count(*) FROM cv) AS candidates, (SELECT count(*) FROM cv, bar WHERE key NOT IN (SELECT key FROM seen) AND coverage >= least - 1e-12) AS unseen, (SELECT CAST(n AS BIGINT) FROM st) AS docs, (SELECT coalesce(string_agg(term, ' ' ORDER BY term), '') FROM (SELECT unnest([{', '.join(repr(x) for x in TERMS)}]) AS term EXCEPT SELECT term FROM ia)) AS absent",
    "index_build": f"WITH {WORD_SQL} SELECT key, term, tf FROM t WHERE key IN (SELECT doc_id FROM documents WHERE text IS NOT NULL)",
    "function_words": f"SELECT DISTINCT strip_accents(w) AS word FROM (SELECT unnest(regexp_extract_all('{STOPS_SQL}', '[^\\s]+')) AS w)",
    "tokenize_words": f"WITH {WORD_SQL} SELECT key, CAST(sum(tf) AS BIGINT) AS n_tokens, count(*) AS n_terms FROM t GROUP BY key",
    "postings": f"WITH {WORD_SQL} SELECT key, term, tf FROM t",
    "doc_freq_idf": f"WITH {WORD_SQL} SELECT term, count(*) AS df, round(ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)), 6) AS idf FROM t, st GROUP BY term, n",
    "bm25_topk": ONE_SQL + " SELECT key, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY score DESC, key) AS INT) AS rank FROM ra ORDER BY score DESC, key LIMIT 20",
    "bm25_matched_terms": ONE_SQL + " SELECT key, array_to_string(matched, ' ') AS matched, round(score, 6) AS score FROM ra",
    "coverage": COVER_SQL + " SELECT key, round(coverage, 6) AS coverage FROM cv",
    "terms_absent": ONE_SQL + f" SELECT unnest([{', '.join(repr(x) for x in TERMS)}]) AS term EXCEPT SELECT term FROM ia",
    "terms_absent_in_scope": f"WITH {WORD_SQL} SELECT DISTINCT term FROM t WHERE term IN ({', '.join(repr(x) for x in TERMS)}) EXCEPT SELECT term FROM t JOIN documents d ON d.doc_id = t.key WHERE lower(d.path) LIKE '{FOLDER}/%'",
    "exclude_paging": ONE_SQL + " SELECT key, CAST(rn - 5 AS INT) AS rank FROM (SELECT key, row_number() OVER (ORDER BY score DESC, key) AS rn FROM ra) WHERE rn BETWEEN 6 AND 10",
    "unseen_count": COVER_SQL + ", o AS (SELECT *, row_number() OVER (ORDER BY score DESC, key) AS rn FROM cv) SELECT count(*) AS unseen FROM o WHERE rn > 5 AND coverage >= (SELECT min(coverage) FROM o WHERE rn <= 5) - 1e-12",
    "query_groups_rrf": BOTH_SQL + " SELECT key, round(sum(1.0::DOUBLE / (60 + rn)), 9) AS fused FROM (SELECT key, row_number() OVER (ORDER BY round(score, 9) DESC, key) AS rn FROM ra UNION ALL SELECT key, row_number() OVER (ORDER BY round(score, 9) DESC, key) FROM rb) GROUP BY key",
    "rrf_hybrid": ONE_SQL + ", q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0), c AS (SELECT vec_id AS key, list_cosine_similarity(CAST(embedding AS DOUBLE[]), q) AS cos FROM embeddings, q) SELECT key, round(sum(1.0::DOUBLE / (60 + rn)), 9) AS fused FROM (SELECT key, row_number() OVER (ORDER BY round(score, 9) DESC, key) AS rn FROM ra UNION ALL SELECT key, row_number() OVER (ORDER BY round(cos, 9) DESC, key) FROM c) GROUP BY key",
    "section_split": f"""WITH {NOTES_SQL}, x AS (SELECT path, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i, len(string_split(coalesce(text, ''), chr(10))) AS most FROM nn),
        y AS (SELECT *, length(line) + CASE WHEN i < most THEN 1 ELSE 0 END AS size, CASE WHEN regexp_matches(line, '^#{{1,4}} ') THEN 1 ELSE 0 END AS starts FROM x),
        z AS (SELECT *, sum(starts) OVER (PARTITION BY path ORDER BY i) AS part, coalesce(sum(size) OVER (PARTITION BY path ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM y)
        SELECT path, CAST(min(off) AS INT) AS off, CAST(sum(size) AS INT) AS n_chars FROM z GROUP BY path, part HAVING max(length(regexp_replace(line, '\\s', '', 'g'))) > 0""",
    "section_bm25_pool": ONE_SQL + rf""", {LINES_SQL.replace("ln AS", "lines AS")}, pool AS (SELECT key FROM ra ORDER BY score DESC, key LIMIT 10),
        po AS (SELECT key, content, coalesce(sum(length(content) + 1) OVER (PARTITION BY key ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM lines WHERE key IN (SELECT key FROM pool)),
        sw AS (SELECT key, off, unnest(list_transform(regexp_extract_all(content, '[\p{{L}}\p{{N}}]+'), lambda x: strip_accents(lower(x)))) AS term FROM po WHERE content <> ''),
        sk AS (SELECT * FROM sw WHERE length(term) >= 2 AND term NOT IN {STOPPED}),
        sl AS (SELECT key, off, count(*) AS dl FROM sk GROUP BY key, off), sa AS (SELECT avg(dl) AS a FROM sl),
        sc AS (SELECT key, off, term, count(*) AS tf FROM sk GROUP BY key, off, term)
        SELECT sc.key, CAST(sc.off AS INT) AS off, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / a))), 6) AS score FROM sc JOIN ia ON ia.term = sc.term JOIN sl ON sl.key = sc.key AND sl.off = sc.off, sa GROUP BY sc.key, sc.off""",
    "per_doc_cap": f"WITH {LINES_SQL}, x AS (SELECT key, CAST(line AS INT) AS line, CAST(len(regexp_extract_all(lower(content), 'checklist')) AS INT) AS n FROM ln), y AS (SELECT * FROM x WHERE n > 0 QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC, line) <= 2) SELECT key, line, n FROM y ORDER BY n DESC, key, line LIMIT 8",
    "hit_lines": "SELECT doc_id AS key, CAST(len(string_split(left(text, instr(text, 'glossary') - 1), chr(10))) AS INT) AS line FROM documents WHERE contains(text, 'glossary')",
    "content_version": "SELECT doc_id AS key, left(sha1(text), 12) AS version FROM documents WHERE text IS NOT NULL",
    "version_guard": rf"WITH {NOTES_SQL}, e AS (SELECT DISTINCT path, left(sha1(regexp_replace(content, '\r\n?', chr(10), 'g')), 12) AS v FROM note_content WHERE content IS NOT NULL) SELECT CASE WHEN nn.text IS NULL THEN 'not_found' WHEN left(sha1(nn.text), 12) = v THEN 'ok' ELSE 'changed' END AS outcome, count(*) AS n FROM e LEFT JOIN nn ON nn.path = e.path GROUP BY 1",
    "cosine_topk": "WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0) SELECT vec_id AS key, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), q), 6) AS cos FROM embeddings, q ORDER BY cos DESC, key LIMIT 20",
    "int8_quantize": "WITH a AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), b AS (SELECT vec_id, list_transform(e, lambda x: CAST(round_even(x * 127.0::DOUBLE / list_max(list_transform(e, lambda y: abs(y))), 0) AS INT)) AS c FROM a) SELECT vec_id, array_to_string(c, ' ') AS codes, round(CAST(CAST(1 / sqrt(list_sum(list_transform(c, lambda x: CAST(x * x AS DOUBLE)))) AS FLOAT) AS DOUBLE), 6) AS scale FROM b",
    "dense_rank": "WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0), a AS (SELECT label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), b AS (SELECT label, list_transform(e, lambda x: round_even(x * 127.0::DOUBLE / list_max(list_transform(e, lambda y: abs(y))), 0)) AS c FROM a) SELECT label AS key, round(max(list_cosine_similarity(c, q)), 3) AS cos FROM b, q GROUP BY label",
    "files_status": f"WITH {STATUS_SQL} SELECT path, status, reason FROM f",
    "scope_counts": f"WITH {STATUS_SQL} SELECT count(DISTINCT path) FILTER (status IN ('indexed', 'changed')) AS docs, count(*) FILTER (status = 'unconverted') AS unconverted, count(*) FILTER (status = 'failed') AS failed FROM f WHERE lower(path) LIKE '{FOLDER}/%'",
    "inventory_counts": f"WITH {STATUS_SQL} SELECT status, count(*) AS n FROM f GROUP BY status",
    "index_changes": f"""WITH a AS (SELECT path AS key, mtime AS now FROM documents WHERE lang IS NOT NULL), b AS (SELECT path AS key, CASE WHEN lower(lang) = 'en' THEN mtime ELSE mtime - 1 END AS then_ FROM documents WHERE read_at < TIMESTAMP '{CUT}')
        SELECT * FROM (SELECT coalesce(a.key, b.key) AS key, CASE WHEN then_ IS NULL THEN 'new' WHEN now IS NULL THEN 'gone' WHEN now <> then_ THEN 'changed' END AS change FROM a FULL JOIN b ON a.key = b.key) WHERE change IS NOT NULL""",
    "since_filter": f"SELECT doc_id, path FROM documents WHERE mtime > {CUT_SECONDS}",
    "folder_scope": "SELECT doc_id AS key, path FROM documents WHERE lower(path) LIKE 'projects/birch/%'",
    "latest_notes": f"WITH {NOTES_SQL} SELECT path, CAST(coalesce(length(text), 0) AS INT) AS n_chars, mtime FROM nn",
    "read_slice_budget": f"""WITH {LINES_SQL}, u AS (SELECT l.*, sum(length(content) + 1) OVER (PARTITION BY key ORDER BY line) AS used FROM ln l JOIN documents d ON d.doc_id = l.key WHERE d.text IS NOT NULL),
        g AS (SELECT key, max(line) AS most, max(line) FILTER (used <= 500 OR line = 1) AS last, sum(length(content) + 1) FILTER (used <= 500 OR line = 1) - 1 AS n FROM u GROUP BY key)
        SELECT key, CAST(1 AS INT) AS first, CAST(last AS INT) AS last, CAST(CASE WHEN most > last THEN last + 1 ELSE 0 END AS INT) AS next_start, CAST(n AS INT) AS n_chars FROM g""",
    "context_search": f"""WITH {LINES_SQL}, q AS (SELECT unnest(['Checklist', 'open question']) AS query), m AS (SELECT query, doc_id AS key, CAST((length(low) - length(replace(low, lower(query), ''))) / length(query) AS INT) AS note_matches FROM (SELECT doc_id, lower(text) AS low FROM documents), q WHERE contains(low, lower(query)))
        SELECT m.query, CAST(m.key AS VARCHAR) AS path, CAST(line AS INT) AS line, trim(content) AS snippet, note_matches FROM ln JOIN m ON m.key = ln.key WHERE contains(lower(content), lower(m.query)) QUALIFY row_number() OVER (PARTITION BY m.query, m.key ORDER BY line) <= 20""",
    "language_detect": _language_sql(),
    "clean_tags": r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(strip_accents(lower(regexp_replace(source, '^\d+[.)]\s+', ''))), '[^a-z0-9\s-]', '', 'g'), '[\s_]+', '-', 'g'), '^-+|-+$', '', 'g') AS tag FROM documents WHERE source IS NOT NULL",
    "wikilink_targets": r"SELECT target, count(DISTINCT path) AS documents FROM (SELECT path, trim(unnest(regexp_extract_all(text, '\[\[([^\]|#]+)', 1))) AS target FROM documents) WHERE NOT regexp_matches(lower(target), '\.(png|jpg|jpeg|pdf|webp|svg|gif|csv)$') GROUP BY target",
    "innermost_symbols": """WITH s AS (SELECT DISTINCT path, kind, trim(name) AS name, coalesce(parent, '') AS parent, line, end_line FROM symbols WHERE end_line >= line), p AS (SELECT DISTINCT path, line FROM s)
        SELECT path, line, selector FROM (SELECT p.path, p.line, CASE WHEN parent <> '' THEN parent || '.' || name ELSE name END AS selector, row_number() OVER (PARTITION BY p.path, p.line ORDER BY s.end_line - s.line, s.line DESC) AS rn
        FROM p JOIN s ON s.path = p.path AND s.line <= p.line AND p.line <= s.end_line WHERE kind IN ('function', 'method', 'class') AND s.line > 0) WHERE rn = 1""",
    "ndcg_mrr_recall": f"""WITH {WORD_SQL}, run AS (SELECT term AS qid, key AS did, row_number() OVER (PARTITION BY term ORDER BY tf DESC, key) AS rank FROM t WHERE term IN (SELECT lower(subject) FROM subject_areas)),
        g AS (SELECT DISTINCT lower(trim(subject)) AS qid, doc_id AS did FROM subject_labels WHERE subject IS NOT NULL), c AS (SELECT qid, count(*) AS n FROM g GROUP BY qid),
        i AS (SELECT qid, n, list_sum(list_transform(range(1, least(n, 10) + 1), lambda r: 1 / log2(r + 1))) AS ideal FROM c),
        h AS (SELECT run.qid, sum(1 / log2(rank + 1)) AS gain, min(rank) AS first, count(*) AS found FROM run JOIN g ON g.qid = run.qid AND g.did = run.did WHERE rank <= 10 GROUP BY run.qid)
        SELECT i.qid, round(coalesce(gain / ideal, 0), 6) AS ndcg, round(coalesce(1 / first, 0), 6) AS mrr, round(coalesce(found / n, 0), 6) AS recall FROM i LEFT JOIN h ON h.qid = i.qid""",
    "windowed_activity": "SELECT date_trunc('hour', ts) AS starts, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "user_sessions": """WITH a AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM a)
        SELECT user_id, min(ts) AS starts, max(ts) + INTERVAL 30 MINUTE AS ends, count(*) AS n FROM b GROUP BY user_id, s""",
    "record_drift": """WITH r AS (SELECT regexp_replace(path, '/[^/]*$', '') AS path, floor(min(mtime)) AS anchor FROM documents WHERE lang = 'en' GROUP BY 1)
        SELECT r.path || '/README' AS record, count(DISTINCT sha1(d.path)) AS commits FROM documents d JOIN r ON starts_with(d.path, r.path || '/') OR d.path = r.path WHERE floor(epoch(read_at)) > r.anchor GROUP BY r.path""",
}
