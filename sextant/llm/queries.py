"""One query for each operation, over its whole table, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.llm import chat, line_dedup, media, merkle, mixing, near_duplicates, packing, quality, tokens, toxicity

#: Production mix: two sources are wanted more often than the rest.
MIX = {"weights": {"src1": 4.0, "src2": 2.0}, "default_weight": 1.0, "max_epochs": 2.0}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(_table(spark, sf_dir, "documents"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chats(_table(spark, sf_dir, "conversations"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.toxicity(docs, toxicity.toxicity_model(docs, _table(spark, sf_dir, "labels")))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.fingerprints(_table(spark, sf_dir, "documents"))


def fingerprint_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents against a later state: one source is withdrawn, in another some words have changed."""
    docs = _table(spark, sf_dir, "documents")
    later = docs.where("source <> 'src3' or source is null").withColumn("text", F.when(F.col("source") == "src5", F.replace("text", F.lit(" and "), F.lit(" or "))).otherwise(F.col("text")))
    return merkle.edits(merkle.merkle_trees(docs), merkle.merkle_trees(later))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(_table(spark, sf_dir, "documents"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.with_copies(_table(spark, sf_dir, "documents"), **MIX).select("doc_id", "source", "copies")


def op9_media_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.image_hashes(media.rendered(_table(spark, sf_dir, "embeddings")), "vec_id")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.with_quality(docs.select("doc_id", "text"), quality.quality_model(docs, _table(spark, sf_dir, "labels"))).select("doc_id", "quality_score", "keep")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_line_dedup, op2_chat_format, op3_simhash_near_dedup, op4_best_fit_packing, op5_toxicity, op6_fingerprints, op7_token_counts, op8_source_mixing, op9_media_hashes, op10_quality, fingerprint_edits)
}

_LEAVES = """
        line AS (
            SELECT d.side, d.n, d.doc_id, u.pos, trim(u.line, ' ') AS line
            FROM (SELECT *, row_number() OVER () AS n, string_split(text, chr(10)) AS lines FROM every WHERE text IS NOT NULL) d,
                 LATERAL (SELECT unnest(d.lines) AS line, generate_subscripts(d.lines, 1) AS pos) u),
        leaf AS (
            SELECT *, sha256(line) AS h, lag(line) OVER w AS before, lag(sha256(line)) OVER w AS hash_before
            FROM line WINDOW w AS (PARTITION BY n ORDER BY pos)),
        placed AS (
            SELECT side, n, doc_id, pos, h, sum((before IS NULL OR before = '' OR right(hash_before, 1) IN ('0', '8') OR line[1] = '#')::INT) OVER (PARTITION BY n ORDER BY pos) AS section
            FROM leaf WHERE line <> ''),
        section AS (SELECT side, n, doc_id, section, sha256(string_agg(h, '' ORDER BY pos)) AS sh, count(*) AS k FROM placed GROUP BY side, n, doc_id, section)"""

ORACLE: dict[str, str] = {
    "op2_chat_format": """
        SELECT conv_id,
               string_agg('<|im_start|>' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS formatted,
               count(*)::BIGINT AS n_turns,
               sum(strlen('<|im_start|>' || coalesce(role, 'unknown') || coalesce(text, '') || '<|im_end|>') + 2)::BIGINT AS n_bytes,
               coalesce(sum(strlen(text)) FILTER (role = 'assistant'), 0)::BIGINT AS assistant_bytes
        FROM conversations GROUP BY conv_id""",
    "op6_fingerprints": f"""
        WITH every AS (SELECT 'one' AS side, doc_id, text FROM documents), {_LEAVES},
        doc AS (SELECT n, string_agg(sh, '' ORDER BY section) AS a, string_agg(sh, ',' ORDER BY section) AS s, count(*) AS c, sum(k) AS k FROM section GROUP BY n),
        named AS (SELECT row_number() OVER () AS n, doc_id FROM every WHERE text IS NOT NULL)
        SELECT doc_id, sha256(coalesce(a, '')) AS root, coalesce(s, '') AS section_hashes, coalesce(c, 0)::BIGINT AS n_sections, coalesce(k, 0)::BIGINT AS n_paragraphs
        FROM named LEFT JOIN doc USING (n)
        UNION ALL SELECT doc_id, NULL, NULL, NULL, NULL FROM documents WHERE text IS NULL""",
    "fingerprint_edits": f"""
        WITH every AS (
            SELECT 'removed' AS side, doc_id, text FROM documents
            UNION ALL SELECT 'added', doc_id, CASE WHEN source = 'src5' THEN replace(text, ' and ', ' or ') ELSE text END FROM documents WHERE source <> 'src3' OR source IS NULL), {_LEAVES},
        own AS (SELECT p.*, sh, row_number() OVER (PARTITION BY p.n, p.section ORDER BY pos) - 1 AS paragraph FROM placed p JOIN section s ON s.n = p.n AND s.section = p.section),
        differs AS (SELECT o.*, row_number() OVER (PARTITION BY o.doc_id, o.h, o.side ORDER BY o.section, o.paragraph) AS nth FROM own o WHERE NOT EXISTS (SELECT 1 FROM section s WHERE s.doc_id = o.doc_id AND s.side <> o.side AND s.sh = o.sh)),
        times AS (SELECT doc_id, h, count(*) FILTER (side = 'removed') AS removed, count(*) FILTER (side = 'added') AS added FROM differs GROUP BY doc_id, h)
        SELECT doc_id, side AS change, (section - 1)::INT AS section, paragraph::INT AS paragraph, h AS hash
        FROM differs JOIN times USING (doc_id, h) WHERE nth > CASE side WHEN 'removed' THEN added ELSE removed END""",
    "op8_source_mixing": """
        WITH sizes AS (
            SELECT source, chars, weight, chars * 2.0::DOUBLE AS cap
            FROM (SELECT source, sum(coalesce(length(text), 0))::BIGINT AS chars, CASE source WHEN 'src1' THEN 4.0::DOUBLE WHEN 'src2' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM documents GROUP BY source)),
        level AS (
            SELECT source, chars, weight, cap,
                   (sum(chars) OVER ()::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                   / sum(weight) OVER (ORDER BY cap / weight, source NULLS FIRST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
            FROM sizes WHERE chars > 0),
        water AS (SELECT *, max(level) OVER () AS water FROM level),
        epochs AS (SELECT source, least(water * weight, cap) / chars AS epochs FROM water UNION ALL SELECT source, 0 FROM sizes WHERE chars = 0),
        chance AS (SELECT doc_id, source, ('0x' || left(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 8))::BIGINT / 4294967296.0::DOUBLE AS chance FROM documents)
        SELECT doc_id, c.source, (floor(epochs) + (chance < epochs - floor(epochs))::INT)::INT AS copies
        FROM chance c JOIN epochs e ON c.source IS NOT DISTINCT FROM e.source""",
}
