"""Registered queries of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (chat_format, decontaminate, licenses, line_dedup, near_dup, packing, ranked_search, search, sharding, spelling,
               token_counts, token_files, toxicity)
from .common import table


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat_format.rotate(table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("masks", lambda m: F.concat_ws(":", m["start"].cast("string"), m["end"].cast("string"))), ",")
    return out.select("conv_id", "perspective", "part", "start_char", "n_turns", "n_own", "text", spans.alias("masks"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), 1024, 2)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_digest(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return search.search(docs.filter("doc_id % 20 = 0"), docs, 10).withColumn("score", F.round("score", 3))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"), **line_dedup.EVERY_LINE)
    return out.select("doc_id", "text", "lines_in", "lines_out", "first_docs")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_documents(table(spark, sf_dir, "documents"), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"), "capacity")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_components(table(spark, sf_dir, "documents"), size=2, share=(80, 100))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.rank(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), 10)


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_forms(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_format": op1_chat_format,
    "op2_packing": op2_packing,
    "op3_decontamination": op3_decontamination,
    "op4_token_files": op4_token_files,
    "op5_toxicity": op5_toxicity,
    "op6_search": op6_search,
    "op7_line_dedup": op7_line_dedup,
    "op8_sharding": op8_sharding,
    "op9_licenses": op9_licenses,
    "op10_near_dedup": op10_near_dedup,
    "op11_token_counts": op11_token_counts,
    "op12_ranked_search": op12_ranked_search,
    "op13_spelling": op13_spelling,
}
_LOWER = f"translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}')"

ORACLE_SQL: dict[str, str] = {
    "op1_chat_format": r"""
        WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS s,
                          replace(replace(coalesce(text, ''), '<|im_start|>', '<|im_start |>'), '<|im_end|>', '<|im_end |>') AS x
                   FROM conversations),
        n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, s, x) - 1 AS i FROM t),
        p AS (SELECT DISTINCT conv_id AS c, s AS perspective FROM t WHERE s <> 'system'),
        r AS (SELECT n.*, perspective, i // 64 AS part, s = perspective AS own, x || '<|im_end|>' || chr(10) AS tail,
                     '<|im_start|>' || CASE WHEN s = perspective THEN 'assistant' WHEN s = 'system' THEN s
                                            ELSE 'user name=' || regexp_replace(s, '\s+', '_', 'g') END || chr(10) AS head
              FROM n JOIN p ON n.conv_id IS NOT DISTINCT FROM p.c),
        o AS (SELECT *, sum(length(head) + length(tail)) OVER (PARTITION BY conv_id, perspective ORDER BY i) AS upto FROM r),
        b AS (SELECT *, min(upto - length(head) - length(tail)) OVER (PARTITION BY conv_id, perspective, part) AS base FROM o)
        SELECT conv_id, perspective, CAST(part AS BIGINT) AS part, CAST(min(base) AS BIGINT) AS start_char,
               CAST(count(*) AS INTEGER) AS n_turns, CAST(count(*) FILTER (own) AS INTEGER) AS n_own,
               string_agg(head || tail, '' ORDER BY i) AS text,
               coalesce(string_agg(CAST(upto - length(tail) - base AS BIGINT) || ':' || CAST(upto - base AS BIGINT), ',' ORDER BY i)
                        FILTER (own), '') AS masks
        FROM b GROUP BY conv_id, perspective, part""",
    "op6_search": rf"""
        WITH w AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '{licenses.WORD}')) AS t FROM documents),
        tf AS (SELECT doc_id, t, count(*) AS c FROM w GROUP BY ALL),
        dl AS (SELECT doc_id, count(*) AS n FROM w GROUP BY ALL),
        st AS (SELECT CAST(count(*) AS DOUBLE) AS docs, (SELECT count(*) FROM w) / CAST(count(*) AS DOUBLE) AS mean FROM documents),
        df AS (SELECT t, ln(1 + (any_value(docs) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, st GROUP BY t),
        s AS (SELECT q.doc_id AS query_id, d.doc_id, sum(q.c * idf * d.c * 2.2 / (d.c + 1.2 * (0.25 + 0.75 * n / mean))) AS score
              FROM tf q JOIN df USING (t) JOIN tf d USING (t) JOIN dl ON dl.doc_id = d.doc_id, st
              WHERE q.doc_id % 20 = 0 GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM s)
        SELECT query_id, doc_id, round(score, 3) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10""",
    "op12_ranked_search": rf"""
        WITH w AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '{licenses.WORD}')) AS t FROM documents),
        tf AS (SELECT doc_id, t, count(*) AS c FROM w GROUP BY ALL),
        dl AS (SELECT doc_id, CAST(sum(c) AS BIGINT) AS n FROM tf GROUP BY ALL),
        st AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM dl),
        q AS (SELECT DISTINCT item_id, text, unnest(regexp_extract_all({_LOWER}, '{licenses.WORD}')) AS t FROM benchmark),
        df AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM tf, st GROUP BY t),
        s AS (SELECT q.item_id, q.text, tf.doc_id,
                     CAST(sum(weight * ((1000000000 * c) // (1000 * c + 8 * (10 + (90 * n * docs) // total)))) AS BIGINT) AS score
              FROM q JOIN df USING (t) JOIN tf USING (t) JOIN dl ON dl.doc_id = tf.doc_id, st GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 10""",
    "op10_near_dedup": rf"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 2 THEN w
                                                  ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY ALL),
        c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
        l AS (SELECT x, y FROM c JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
        reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, l.y FROM reach JOIN l ON reach.y = l.x),
        m AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
        SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
        FROM documents d JOIN m ON m.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""",
}
