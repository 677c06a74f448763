"""The queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, curriculum, decontam, eliasfano, langid, neardup, quality, repair, rope, secrets, topk, warc
from .common import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_warc(table(spark, sf_dir, "pages"), shared_dir(spark, "warc"))
    return warc.page_results(warc.read_warc(manifest, with_payload=False))


def op2_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2n (chosen) and 2n + 1 (rejected) are a pair."""
    turns = table(spark, sf_dir, "conversations").withColumns({"pair_id": F.expr("(conv_id - pmod(conv_id, 2)) div 2"), "chosen": F.expr("pmod(conv_id, 2) = 0")})
    return chat.preference_examples(turns)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", langid.held_out(5, 0))
    labels = table(spark, sf_dir, "labels").where(~langid.held_out(5, 0)).select("doc_id", F.col("quality").alias("label"))
    return quality.score(docs, quality.fit(docs, labels)).drop("text")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", langid.held_out(4, 2))
    model = langid.fit(docs.where("not held_out"))
    return langid.predict(docs.drop("lang"), model).drop("text")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(bpe.encode(docs, path, public_tokenizers.PATTERN, decoded_col="decoded"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "spans"))


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 64.0)
    return topk.top_k(vectors.where(F.col("vec_id") % 20 == 0), vectors, 20)


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    manifest = eliasfano.write_tokens(docs, shared_dir(spark, "tokens"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return eliasfano.read_tokens(manifest, with_ids=False)


def op11_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curriculum.by_document(curriculum.mix(table(spark, sf_dir, "documents")))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return rope.digests(rope.restore(rope.fill_in_middle(docs).drop("text")))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(repair.damaged(table(spark, sf_dir, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_preferences": op2_preferences,
    "op3_decontamination": op3_decontamination,
    "op4_quality": op4_quality,
    "op5_language": op5_language,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_secrets": op8_secrets,
    "op9_top_k": op9_top_k,
    "op10_token_ids": op10_token_ids,
    "op11_curriculum": op11_curriculum,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_repair": op13_repair,
}

ORACLE_SQL: dict[str, str] = {
    "op1_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        d AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS top FROM p)
        SELECT page_id, payload_bytes,
               array_to_string(list_transform(range(8), lambda i: list_transform([15, 10, 5, 0], lambda s:
                   substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((CAST('0x' || substr(x, CAST(5 * i + 1 AS INT), 5) AS INT) >> CAST(s AS INT)) & 31) + 1, 1)).array_to_string('')), '') AS payload_digest,
               CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id < top THEN top END AS refers_to,
               CASE WHEN page_id < top THEN 1 ELSE CAST(ceil((87 + payload_bytes + 5 + chunk) / 32768.0) AS INTEGER) END AS segments, 'ok' AS status
        FROM (SELECT *, CAST(coalesce(list_sum(list_transform(range(CAST(ceil(payload_bytes / 8192.0) AS BIGINT)), lambda i: 4 + length(printf('%x', CAST(least(8192, payload_bytes - 8192 * i) AS INT))))), 0) AS BIGINT) AS chunk FROM d)""",
    "op2_preferences": chat.ORACLE_SQL,
    "op3_decontamination": """
        WITH d AS (SELECT row_number() OVER () AS dr, doc_id, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents),
        i AS (SELECT row_number() OVER () AS ir, item_id, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
        dw AS (SELECT dr, doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d), iw AS (SELECT ir, item_id, len(w) AS n, unnest(w) AS x, generate_subscripts(w, 1) AS q FROM i),
        m AS (SELECT dr, doc_id, ir, item_id, n, p - q AS o, q FROM dw JOIN iw USING (x)),
        a AS (SELECT * FROM m QUALIFY count(*) OVER (PARTITION BY dr, ir, o) >= least(n, 4)),
        c AS (SELECT doc_id, item_id, n, count(*) OVER (PARTITION BY dr, ir, o ORDER BY q RANGE BETWEEN CURRENT ROW AND 12 FOLLOWING) AS k FROM a)
        SELECT doc_id, item_id, CAST(least(13, max(n)) AS INTEGER) AS window_words, CAST(max(k) AS INTEGER) AS matched_words, CAST(max(n) AS INTEGER) AS item_words
        FROM c WHERE k >= ceil(least(13, n) * 0.8) GROUP BY 1, 2""",
    "op7_near_duplicates": """
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
        n AS (SELECT doc_id, len(s) AS n FROM s), x AS (SELECT doc_id, unnest(s) AS x FROM s),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM x a JOIN x b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 80 * (na.n + nb.n - k)),
        e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
        r AS (SELECT doc_id, doc_id AS c FROM n UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id AND r.c < e.b)
        SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, min(c) AS component_id, n.doc_id = min(c) AS kept FROM n JOIN r USING (doc_id) GROUP BY n.doc_id, n.n""",
    "op9_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 64)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
              FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
        r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
        SELECT * FROM r WHERE rank <= 20""",
    "op11_curriculum": curriculum.ORACLE_SQL,
    "op12_fill_in_middle": rope.ORACLE_SQL,
    "op13_repair": repair.ORACLE_SQL,
}
