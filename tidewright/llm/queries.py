"""One query per operator, with production parameters, over whole tables; and DuckDB SQL where SQL can say the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import divergence, exact_dedup, html_text, media_avi, ordered_packing, packing, pieces, prefix_trie, quality_mil, simhash, substrings, token_counts, toxicity_pu
from .common import scratch_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(_table(spark, sf_dir, "documents"))


def op2_quality_attention_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality_mil.score(docs, quality_mil.train(docs, _table(spark, sf_dir, "labels")))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(substrings.remove_repeats(_table(spark, sf_dir, "documents")))


def op6_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of all documents. Estimates from their lengths are committed first, as a version of their own too, and again,
    to no effect; the counts of their tokens then revise them, the version of estimates is deleted, and all is compacted."""
    docs = _table(spark, sf_dir, "documents")
    estimate = F.ceil(F.coalesce(F.char_length("text"), F.lit(0)) / 4)
    load = docs.select("source", "lang", F.lit("byte_bpe_50k").alias("version"), estimate.alias("tokens"))
    rough = load.withColumn("version", F.lit("length"))
    exact = token_counts.counted(docs).withColumn("estimate", F.ceil(F.col("chars") / 4))
    store = token_counts.Rollup(spark, f"{scratch_dir(spark)}/rollup-{uuid.uuid4().hex}")
    store.commit("load", token_counts.as_inserts(load.unionByName(rough)))
    store.commit("load", token_counts.as_inserts(load))
    store.commit("tokens", token_counts.as_revisions(exact, "estimate"))
    store.compact()
    store.commit("length is gone", token_counts.as_inserts(rough, op="delete"))
    return store.totals()


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(_table(spark, sf_dir, "documents"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op9_toxicity_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity_pu.score(docs, toxicity_pu.train(docs, _table(spark, sf_dir, "labels")))


def op10_media_avi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_avi.digests(media_avi.stored(_table(spark, sf_dir, "documents")))


def op11_ordered_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered_packing.pack_in_order(_table(spark, sf_dir, "documents"))


def op12_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_best_fit_packing, op2_quality_attention_mil, op3_simhash_near_dedup, op4_exact_dedup, op5_substring_dedup, op6_token_rollup, op7_html_extraction, op8_sentencepiece, op9_toxicity_pu, op10_media_avi, op11_ordered_packing, op12_divergence_audit, op13_prefix_trie)
}

ORACLE_SQL: dict[str, str] = {
    "op4_exact_dedup": r"""
        WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents),
             w AS (SELECT doc_id, first_value(doc_id) OVER (PARTITION BY body ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size, sha256(body) AS text_sha256 FROM t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM w""",
    "op5_substring_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
             h AS (SELECT doc_id, unnest(range(1, len(ws) - 33)) AS i, unnest(list_transform(range(1, len(ws) - 33), lambda i: md5(array_to_string(ws[i : i + 34], ' ')))) AS win FROM t WHERE len(ws) >= 35),
             d AS (SELECT doc_id, i, count(*) OVER (PARTITION BY win) AS n FROM h),
             g AS (SELECT DISTINCT doc_id, i + o AS k FROM d, range(35) AS r(o) WHERE n > 1),
             w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS k FROM t),
             x AS (SELECT w.doc_id, word, w.k, g.k IS NOT NULL AS gone FROM w LEFT JOIN g ON w.doc_id = g.doc_id AND w.k = g.k),
             s AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY k) FILTER (NOT gone) AS kept FROM x GROUP BY 1)
        SELECT t.doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM t LEFT JOIN s ON t.doc_id = s.doc_id""",
    "op12_divergence_audit": r"""
        WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
             g AS (SELECT DISTINCT lang, source FROM d),
             k AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(ws)) AS term FROM d) GROUP BY ALL HAVING count(*) >= 30),
             o AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(ws) AS term FROM d) GROUP BY ALL),
             m AS (SELECT g.lang, g.source, k.term, coalesce(o.n, 0) AS n FROM g JOIN k ON g.lang = k.lang LEFT JOIN o ON g.lang = o.lang AND g.source = o.source AND k.term = o.term),
             s AS (SELECT *, sum(n) OVER (PARTITION BY lang, source)::HUGEINT AS total, count(*) OVER (PARTITION BY lang, source) AS v, sum(n) OVER (PARTITION BY lang, term)::HUGEINT AS ln, sum(n) OVER (PARTITION BY lang)::HUGEINT AS ltotal FROM m),
             p AS (SELECT *, (1 + 1000000000::HUGEINT * (n + 5) // (total + 5 * v))::BIGINT AS p, (1 + 1000000000::HUGEINT * (ln + 5) // (ltotal + 5 * v))::BIGINT AS q FROM s),
             f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
             r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
                   UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
        SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM r QUALIFY part = 'pair' OR rank <= 50""",
    "op13_prefix_trie": r"""
        WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS k FROM conversations WHERE conv_id IS NOT NULL),
             c AS (SELECT conv_id, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
                       lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END)))) % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)),
             r AS (SELECT c.conv_id, k, role, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 20 AND k <= h UNION ALL SELECT c.conv_id, k, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND k > h),
             p AS (SELECT conv_id, 0 AS depth, []::VARCHAR[][] AS path, 0 AS words FROM c
                   UNION ALL SELECT conv_id, row_number() OVER w, list([role, text]) OVER w, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY k)),
             n AS (SELECT min(conv_id) AS conv_id, depth, path, count(*) AS n_convs, any_value(words) AS words FROM p GROUP BY depth, path),
             m AS (SELECT p.conv_id AS member, p.depth, n.conv_id FROM p JOIN n ON p.depth = n.depth AND p.path = n.path),
             e AS (SELECT m.conv_id, m.depth, string_agg(member::VARCHAR, ',' ORDER BY member) AS ids FROM m JOIN (SELECT conv_id AS member, max(depth) AS depth FROM p GROUP BY 1) USING (member, depth) GROUP BY ALL),
             u AS (SELECT n.conv_id, n.depth, m.conv_id AS parent FROM n JOIN m ON m.member = n.conv_id AND m.depth = n.depth - 1),
             k AS (SELECT parent AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM u GROUP BY ALL),
             s AS (SELECT m.conv_id, m.depth, count(*) FILTER (k.n_children IS NULL) AS n_leaves, sum((n_convs - 1) * words) AS saved_tokens FROM n LEFT JOIN k USING (conv_id, depth) JOIN m ON m.member = n.conv_id AND m.depth <= n.depth GROUP BY ALL)
        SELECT n.conv_id, n.depth::BIGINT AS depth, u.parent AS parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
        FROM n JOIN s USING (conv_id, depth) LEFT JOIN k USING (conv_id, depth) LEFT JOIN u USING (conv_id, depth) LEFT JOIN e USING (conv_id, depth)""",
}
