"""The registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversation_repair, exact_dedup, langid, mixing, packing, pii, quality_rules, simhash, substring_dedup, token_alignment, topk, toxicity, warc_store
from ._shared import table, written


def public_tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = warc_store.write_archive(table(spark, sf_dir, "pages"), least_revisit_bytes=0)
    return warc_store.read_archive(archive).select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_rates(table(spark, sf_dir, "documents"), weights=(1, 2, 3), most=3.0).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(table(spark, sf_dir, "documents"), shingle=4, seed=42, radius=4)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), window=50)


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    # floor() of a value that is not finite would be a number: such vectors go out first
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    vectors = table(spark, sf_dir, "embeddings").where(finite).select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("double")).alias("vector"))
    return topk.exact_topk(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op9_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    tokenizer = tokenizer or public_tokenizer("byte_bpe_50k.json")
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer, most=2048, end_id=0).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), digest_all=True)


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = written(quality_rules.quality_ledger(table(spark, sf_dir, "documents")), "quality-ledger")
    base = F.col("failures").bitwiseAND(F.lit(quality_rules.mask(("few_words", "repeated_words"))).cast("long"))
    return quality_rules.apply_policy(ledger, quality_rules.POLICIES[-1]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (base != 0).alias("base_failed"), "kept", "failures"
    )


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return conversation_repair.repair_report(conversation_repair.damaged(turns), turns)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align_tokenizers(table(spark, sf_dir, "documents"), public_tokenizer("byte_bpe_50k.json"), public_tokenizer("piece_bpe_32k.model"))


_OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT t, max(page_id) AS leader FROM p GROUP BY t)
SELECT page_id, CAST(strlen(p.t) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      CAST(1 + ((CAST('0x' || substr(h, CAST(10 * (i // 8) + 1 AS BIGINT), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS BIGINT)) & 31) AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = leader THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = leader THEN NULL ELSE leader END AS refers_to
FROM p JOIN g ON p.t = g.t
"""

_OP3_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rk FROM s),
w AS (SELECT *, CASE (rk - 1) % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS weight, source_size * 3.0::DOUBLE AS cap FROM r),
l AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER o, 0.0::DOUBLE))
        / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS DOUBLE) AS level
      FROM w WINDOW o AS (ORDER BY cap / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, (SELECT arg_min(level, cap / weight) FROM (SELECT * FROM l AS m WHERE m.level * m.weight <= m.cap)) AS final FROM l),
t AS (SELECT source, source_size, least(cap, coalesce(final * weight, cap)) AS target FROM f),
u AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate FROM t)
SELECT doc_id, size, source_size, target,
  CAST(size * (floor(rate) + CASE WHEN CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE
    < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source
"""

_OP7_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos, len(ws) AS n FROM d),
k AS (SELECT *, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING) AS key FROM w),
f AS (SELECT doc_id, word, pos, n, pos + 49 <= n AND min(doc_id) OVER (PARTITION BY key) < doc_id AS hit FROM k),
c AS (SELECT *, max(CASE WHEN hit THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM f),
g AS (SELECT doc_id, sum(gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (gone = 0), '') AS kept FROM c GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN g USING (doc_id)
"""

_OP8_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

_OP10_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

_OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
e AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
w AS (SELECT rid, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos, len(ws) AS n FROM e),
k AS (SELECT rid, pos, n, string_agg(word, ' ') OVER (PARTITION BY rid ORDER BY pos ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS key FROM w),
f AS (SELECT rid, pos, pos + 2 <= n AND count(*) FILTER (pos + 2 <= n) OVER (PARTITION BY rid, key) > 1 AS twice FROM k),
c AS (SELECT rid, max(CASE WHEN twice THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY pos ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS hit FROM f),
r AS (SELECT rid, sum(hit) AS n_repeat_words FROM c GROUP BY rid),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, len(ls) AS n_lines,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    len(list_filter(ls, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) AS n_bullet_lines,
    length(t) - length(regexp_replace(t, '\pL+', '', 'g')) AS n_letters
  FROM e LEFT JOIN r USING (rid)),
b AS (SELECT *, n_words < 50 AS f0, 100 * n_repeat_words > 50 * n_words AS f1, 10 * n_symbols > n_words AS f2, 10 * n_dup_lines > 3 * n_lines AS f3,
    word_chars < 2 * n_words AS f4, word_chars > 20 * n_words AS f5, 2 * n_letters < word_chars AS f6, 10 * n_bullet_lines > 9 * n_lines AS f7 FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f0 OR f1 AS base_failed,
  NOT (f0 OR f1 OR f2 OR f6) AND f3::INT + f4::INT + f5::INT + f7::INT <= 1 AS kept,
  CAST(f0::INT + 2 * f1::INT + 4 * f2::INT + 8 * f3::INT + 16 * f4::INT + 32 * f5::INT + 64 * f6::INT + 128 * f7::INT AS BIGINT) AS failures
FROM b
"""


def queries():
    return {
        "op1_langid": op1_langid,
        "op2_warc": op2_warc,
        "op3_mixing": op3_mixing,
        "op4_toxicity": op4_toxicity,
        "op5_pii": op5_pii,
        "op6_simhash": op6_simhash,
        "op7_substring_dedup": op7_substring_dedup,
        "op8_topk": op8_topk,
        "op9_packing": op9_packing,
        "op10_exact_dedup": op10_exact_dedup,
        "op11_quality_rules": op11_quality_rules,
        "op12_conversation_repair": op12_conversation_repair,
        "op13_token_alignment": op13_token_alignment,
    }


def oracle_sql():
    return {"op2_warc": _OP2_SQL, "op3_mixing": _OP3_SQL, "op7_substring_dedup": _OP7_SQL, "op8_topk": _OP8_SQL, "op10_exact_dedup": _OP10_SQL, "op11_quality_rules": _OP11_SQL}
