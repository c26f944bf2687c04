"""The queries of the problems, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.llm import codedoc, distinct, handwritten, knn, langid, markup, mix, pack, split, subject
from fathomline.session import prepare, table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return langid.language_stretches(table(prepare(spark), folder, "keyphrase_cases")).where("is_case").select("id", "segment_no", "found_lang")


def p1_stretches(spark: SparkSession, folder: str) -> DataFrame:
    return langid.language_stretches(table(prepare(spark), folder, "keyphrase_cases"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return knn.similar_pairs(table(prepare(spark), folder, "vector_rows")).select("row_id_a", "row_id_b")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Terms of which the record is more likely an elite one than not; the counts asked for are then checked exactly."""
    elite = distinct.distinctive_terms(table(prepare(spark), folder, "keyphrase_cases"), shortest=6, least_score=0.5)
    return elite.where("tf >= 3 and df <= 5").select("id", "term")


def p3_scores(spark: SparkSession, folder: str) -> DataFrame:
    return distinct.distinctive_terms(table(prepare(spark), folder, "keyphrase_cases"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    found = markup.structural_elements(table(prepare(spark), folder, "note_content"))
    return found.select(F.col("id").alias("note_id"), "element", "ordinal", "plain_text")


def p4_clean(spark: SparkSession, folder: str) -> DataFrame:
    return markup.clean_texts(table(prepare(spark), folder, "note_content")).withColumnRenamed("id", "note_id")


def p5_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return split.oversized_pieces(*(table(prepare(spark), folder, t) for t in ("note_content", "sources", "symbols", "size_limits")))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return p5_pieces(spark, folder).where("piece_no = 1").select("item_kind", "item_key", "item_start")


def p6_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return codedoc.documented_functions(table(prepare(spark), folder, "sources"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return codedoc.documented_functions(table(prepare(spark), folder, "sources"), code=False).select("path", "name", "line")


def p7_reasons(spark: SparkSession, folder: str) -> DataFrame:
    return handwritten.not_handwritten(table(prepare(spark), folder, "sources"), table(spark, folder, "module_skeletons"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return p7_reasons(spark, folder).select("path")


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Near-copies in different containers, and sources that the mixture lists never with others."""
    documents, limits, weights = (table(prepare(spark), folder, t) for t in ("documents", "size_limits", "source_weights"))
    return pack.packed(documents, limits, listed=weights)


def p8_fill(spark: SparkSession, folder: str) -> DataFrame:
    return pack.fill(p8_containers(spark, folder), table(spark, folder, "size_limits"))


def p9_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return mix.mixture(table(prepare(spark), folder, "documents"), table(spark, folder, "source_weights"))


def p9_tempered(spark: SparkSession, folder: str) -> DataFrame:
    """A mixture of nine tenths of the listed sources' tokens: more than the targets allow, so the exponent is bisected."""
    weights = table(prepare(spark), folder, "source_weights")
    return mix.shares(mix.mixture(table(spark, folder, "documents"), weights, fraction=0.9), weights)


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mix.shares(p9_mixture(spark, folder), table(spark, folder, "source_weights"))


def p10_subjects(spark: SparkSession, folder: str) -> DataFrame:
    return subject.subject_areas(*(table(prepare(spark), folder, t) for t in ("documents", "subject_labels", "subject_areas")))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return p10_subjects(spark, folder).select("doc_id", "subject")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p1_found, p1_stretches, p2_found, p3_found, p3_scores, p4_found, p4_clean, p5_found, p5_pieces, p6_found, p6_pairs, p7_found, p7_reasons,
        p8_containers, p8_fill, p9_mixture, p9_shares, p9_tempered, p10_found, p10_subjects,
    )
}

ORACLE_SQL = {
    "p2_found": """
        WITH v AS (
          SELECT row_id, any_value(dim) AS dim, CAST(any_value(codes) AS DOUBLE[]) AS c
          FROM vector_rows WHERE len(codes) = dim AND list_max(list_transform(codes, lambda x: abs(CAST(x AS INT)))) > 0 GROUP BY row_id),
        p AS (
          SELECT a.row_id AS a, b.row_id AS b, list_cosine_similarity(a.c, b.c) AS cos
          FROM v a JOIN v b ON a.dim = b.dim AND a.row_id <> b.row_id),
        t AS (SELECT a, b, cos FROM p WHERE cos >= 0.8999999 QUALIFY row_number() OVER (PARTITION BY a ORDER BY round(cos, 12) DESC, b) <= 10)
        SELECT DISTINCT least(a, b) AS row_id_a, greatest(a, b) AS row_id_b FROM t WHERE cos >= 0.9""",
    "p3_found": r"""
        WITH r AS (SELECT id, arg_max(body, mtime) AS body FROM keyphrase_cases WHERE id IS NOT NULL GROUP BY id),
        w AS (SELECT id, unnest(regexp_extract_all(lower(strip_accents(coalesce(body, ''))), '[\p{L}\p{Nd}]+')) AS term FROM r),
        c AS (SELECT id, term, count(*) AS tf FROM w WHERE length(term) >= 6 GROUP BY id, term),
        d AS (SELECT *, count(*) OVER (PARTITION BY term) AS df FROM c)
        SELECT id, term FROM d WHERE tf >= 3 AND df <= 5""",
}
