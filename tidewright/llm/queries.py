"""The subpackage's queries and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import quality_mil
from .chat_format import digests, format_conversations
from .common import materialize, table
from .decontamination import contaminated
from .embedding_dedup import near_vectors
from .html_extraction import main_texts
from .license_scan import find_licenses
from .minhash_dedup import near_duplicates
from .mixing import plan
from .substring_dedup import remove_repeats
from .token_store import store_and_verify


#: A domain is a group of sources; weights of domains, of languages in each, of sources that differ from 1.
DOMAINS = 4
MIX_WEIGHTS = {(f"domain{d}",): w for d, w in enumerate((4, 3, 2, 1))} | {(f"domain{d}", lang): w for d in range(DOMAINS) for lang, w in (("en", 4), ("de", 2), ("fr", 2), ("es", 2))}


def mix_leaves() -> list:
    return [F.concat(F.lit("domain"), F.pmod(F.crc32(F.coalesce(F.col("source"), F.lit("")).cast("binary")), F.lit(DOMAINS))), F.col("lang"), F.col("source")]


def op1_hierarchical_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(table(spark, sf_dir, "documents"), mix_leaves(), budget=0.8, weights=MIX_WEIGHTS, most_epochs=3, seed=42)


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_and_verify(table(spark, sf_dir, "documents")).select("doc_id", "start", "n_tokens", "ids_crc32", F.hex("merkle_root").alias("merkle_root"))


def op10_minhash_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


def op3_bm25_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_attention_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality_mil.score(docs.select("doc_id", "text"), quality_mil.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality_mil.held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.98)


OP5_SQL = """
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), links AS MATERIALIZED (
  SELECT a.vec_id AS i, b.vec_id AS j FROM v a JOIN v b ON a.label = b.label AND a.vec_id != b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach(i, j) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.i, l.j FROM reach r JOIN links l ON l.i = r.j
), degree AS (SELECT i, count(*) AS n FROM links GROUP BY i)
SELECT r.i AS vec_id, coalesce(max(d.n), 0) AS n_links, min(r.j) AS component_id, r.i = min(r.j) AS kept
FROM reach r LEFT JOIN degree d ON d.i = r.i GROUP BY r.i
"""


def op7_license_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_licenses(table(spark, sf_dir, "documents"))


def op8_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages")).drop("host")


def op9_chat_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.sql(f"SELECT * FROM VALUES (-7L, 0, 'user', '{odd}'), (-7L, 1, 'assistant', '{odd}') AS t(conv_id, turn, role, text)")
    return digests(materialize(format_conversations(rows.union(more)), "formatted")).drop("tokens", "loss_tokens")


OP9_SQL = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
), longer AS (
  SELECT *, length('<s>[ROLE][/ROLE]</s>') + length(regexp_replace(role, '([<\[])(\\*)(/?s>|\|endoftext\|>|/?(?:ROLE|INST)\])', '\1\\\2\3', 'g'))
    + length(regexp_replace(text, '([<\[])(\\*)(/?s>|\|endoftext\|>|/?(?:ROLE|INST)\])', '\1\\\2\3', 'g')) AS n FROM rows_
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM longer GROUP BY conv_id
"""


def op6_substring_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), length=13, with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP6_SQL = r"""
WITH words AS MATERIALIZED (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []::VARCHAR[]) AS w FROM documents
), windows AS MATERIALIZED (
  SELECT doc_id, p, array_to_string(w[p:p + 12], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM words)
), low AS (SELECT x, min(doc_id) AS low FROM windows GROUP BY x HAVING min(doc_id) < max(doc_id)
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS k FROM windows JOIN low USING (x) WHERE low < doc_id
), places AS (SELECT doc_id, list(k) AS ks FROM gone GROUP BY doc_id
), kept AS (
  SELECT doc_id, len(w) AS n_words, coalesce(len(ks), 0) AS n_removed,
    CASE WHEN ks IS NULL THEN w ELSE list_select(w, list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(ks, i))) END AS v
  FROM words LEFT JOIN places USING (doc_id)
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(coalesce(array_to_string(v, ' '), '')) AS kept_sha256 FROM kept
"""


OP10_SQL = r"""
WITH RECURSIVE words AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS MATERIALIZED (
  SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM words
), sizes AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM sets
), items AS MATERIALIZED (SELECT doc_id, hash(x) AS x FROM (SELECT doc_id, unnest(s) AS x FROM sets)
), common AS (SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS c FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL
), links AS MATERIALIZED (
  SELECT i, j FROM common JOIN sizes p ON p.doc_id = i JOIN sizes q ON q.doc_id = j WHERE 100 * c >= 85 * (p.n + q.n - c)
), sym AS MATERIALIZED (SELECT i, j FROM links UNION SELECT j, i FROM links
), reach(i, j) AS (SELECT doc_id, doc_id FROM sizes UNION SELECT r.i, s.j FROM reach r JOIN sym s ON s.i = r.j
)
SELECT n.doc_id, n.n AS n_shingles, m.c AS component_id, n.doc_id = m.c AS kept
FROM sizes n JOIN (SELECT i, min(j) AS c FROM reach GROUP BY i) m ON m.i = n.doc_id
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_hierarchical_mix": op1_hierarchical_mix,
    "op2_token_store": op2_token_store,
    "op3_bm25_wand": op3_bm25_wand,
    "op4_attention_mil": op4_attention_mil,
    "op5_projection_forest": op5_projection_forest,
    "op6_substring_doubling": op6_substring_doubling,
    "op7_license_classifier": op7_license_classifier,
    "op8_wrapper_induction": op8_wrapper_induction,
    "op9_chat_masks": op9_chat_masks,
    "op10_minhash_hamming": op10_minhash_hamming,
}

ORACLES: dict[str, str] = {
    "op5_projection_forest": OP5_SQL,
    "op6_substring_doubling": OP6_SQL,
    "op9_chat_masks": OP9_SQL,
    "op10_minhash_hamming": OP10_SQL,
}
