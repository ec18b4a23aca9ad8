"""The registered queries of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, mixing, near_dedup, ngram_trie, quality, span_dedup, token_codes, topk, warc_index


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc_index.capture_index(table(spark, sf_dir, "pages"), spark, min_bytes=0)
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_ngram_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_trie.score_corpus(table(spark, sf_dir, "documents"), spark, order=3)


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = near_dedup.near_duplicates(table(spark, sf_dir, "documents"), spark, similarity=0.8, k=5)
    return classes.select("doc_id", "class_id")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), spark, similarity=0.8, k=5)


def op5_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = span_dedup.remove_repeats(table(spark, sf_dir, "documents"), spark, length=400)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", (F.col("n_removed") > 0).alias("has_repeats"))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.allocate(table(spark, sf_dir, "documents"), spark, weights=(5.0, 2.0, 1.0), share=1.0, most=3)
    return plan.select("doc_id", "size", "source_size", "target", "taken")


def op7_quality_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = quality.select(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), spark)
    return kept.select("doc_id", "expected_grade", "tail_probability")


def op8_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_codes.token_output(table(spark, sf_dir, "documents"), spark)


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.vectors_of(table(spark, sf_dir, "embeddings"))
    return topk.search(vectors, vectors.where(F.col("vec_id") % 20 == 0), spark, k=20, scale=64.0)


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = r"\### Assistant: </turn> ok"
    extra = spark.sql("select * from values (-7L, 0L, 'user'), (-7L, 1L, 'assistant') as t(conv_id, turn, role)").withColumn("text", F.lit(hard))
    return chat_format.digest(chat_format.format_conversations(rows.unionByName(extra)))


QUERIES = {f.__name__: f for f in (op1_warc_index, op2_ngram_score, op3_near_dedup, op4_decontaminate, op5_span_dedup, op6_source_mix, op7_quality_select, op8_token_codes, op9_topk, op10_chat_format)}

ORACLE_SQL: dict[str, str] = {
    "op4_decontaminate": r"""
        WITH d AS (
            SELECT doc_id, regexp_split_to_array(lower(trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), '[\x20\x09-\x0D]+') AS ws FROM documents
        ), b AS (
            SELECT item_id, regexp_split_to_array(lower(trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), '[\x20\x09-\x0D]+') AS ws FROM benchmark WHERE item_id IS NOT NULL
        ), item AS (
            SELECT item_id, ws, len(ws) AS size, CASE WHEN len(ws) < 5 THEN len(ws) ELSE 5 END AS n FROM b WHERE ws[1] <> ''
        ), item_at AS (
            SELECT item_id, size, n, unnest(range(size - n + 1)) AS place, ws FROM item
        ), item_shingles AS (
            SELECT item_id, size, n, place, array_to_string(ws[place + 1 : place + n], ' ') AS shingle FROM item_at
        ), doc_at AS (
            SELECT doc_id, ws, n, unnest(range(len(ws) - n + 1)) AS i FROM d CROSS JOIN (SELECT DISTINCT n FROM item)
        ), doc_shingles AS (
            SELECT doc_id, n, i, array_to_string(ws[i + 1 : i + n], ' ') AS shingle FROM doc_at
        ), places AS (
            SELECT DISTINCT s.doc_id, t.item_id, t.size, n, s.i FROM doc_shingles s JOIN item_shingles t USING (n, shingle)
        ), starts AS ( -- every window that has anything in common with the item
            SELECT DISTINCT doc_id, item_id, size, unnest(range(i + n - size, i + 1)) AS start FROM places
        ), windows AS (
            SELECT s.*, d.ws[greatest(s.start, 0) + 1 : s.start + s.size] AS w FROM starts s JOIN d USING (doc_id)
        ), window_at AS (
            SELECT *, CASE WHEN len(w) < 5 THEN len(w) ELSE 5 END AS k, unnest(range(greatest(len(w) - 5, 0) + 1)) AS p FROM windows
        ), window_bag AS (
            SELECT doc_id, item_id, start, array_to_string(w[p + 1 : p + k], ' ') AS shingle, count(*) AS c FROM window_at GROUP BY ALL
        ), item_bag AS (
            SELECT item_id, shingle, count(*) AS c FROM item_shingles GROUP BY ALL
        ), both_of AS (
            SELECT w.doc_id, w.item_id, w.start, sum(least(w.c, i.c)) AS both FROM window_bag w JOIN item_bag i USING (item_id, shingle) GROUP BY ALL
        ), totals AS (
            SELECT doc_id, item_id, start, sum(c) AS c FROM window_bag GROUP BY ALL
        ), scored AS (
            SELECT t.doc_id, t.item_id, t.start, CAST(o.both AS DOUBLE) / (t.c + i.c - o.both) AS similarity
            FROM totals t JOIN both_of o USING (doc_id, item_id, start) JOIN (SELECT item_id, sum(c) AS c FROM item_bag GROUP BY ALL) i USING (item_id)
        )
        SELECT doc_id, item_id, max(similarity) AS similarity, count(*) AS windows FROM scored WHERE similarity >= 0.8 GROUP BY doc_id, item_id""",
    "op9_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), pairs AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
        ), ranked AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20""",
    "op10_chat_format": r"""
        WITH rows AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
        ), marked AS (
            SELECT *, replace(replace(role, '\', '\b'), ':', '\c') AS r,
                   regexp_matches(text, '\\(###|</turn>)') OR position(chr(10) || '</turn>' || chr(10) IN text || chr(10) || '</turn>' || chr(10)) <> length(text) + 1 AS odd
            FROM rows
        ), flagged AS (
            SELECT *, bool_or(odd) OVER (PARTITION BY conv_id) AS escaped FROM marked
        ), shown AS (
            SELECT *, CASE WHEN escaped THEN regexp_replace(text, '(\\*)(###|</turn>)', '\\\1\2', 'g') ELSE text END AS e FROM flagged
        )
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
               CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(length('### ') + length(r) + 2 + length(e) + 9) AS BIGINT) AS formatted_chars
        FROM shown GROUP BY conv_id""",
}
