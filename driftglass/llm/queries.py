"""One query per operator over its whole table, and SQL where SQL can state the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from . import bpe, chat, hnsw, lexical, mixing, packing, passages, periodic, quality_llr, sharding, simhash, token_planes, url_filter
from .common import Stage, read_table


URL_RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge(read_table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", F.round("block_score", 6).alias("block_score"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_texts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    length = (F.octet_length("ids") / 4).cast("long").alias("length")
    return packed.select(F.col("id").alias("doc_id"), "start", length, F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "segment", "loss_tokens", "sequence_tokens")


def op3_hnsw_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_duplicates(read_table(spark, sf_dir, "embeddings"), least=0.9)


def op4_quality_llr(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_llr.judge(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "quality.*")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.by_bytes(read_table(spark, sf_dir, "documents"), shards=40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.interleave(read_table(spark, sf_dir, "documents"))


def op7_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passages.removed_passages(read_table(spark, sf_dir, "documents"), length=400)
    return found.select("doc_id", *passages.digests(), "text")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"), shingle=4, max_distance=4)
    return found.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op9_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = Stage(spark, "tokens")
    path = f"{stage.root}/files"
    token_planes.write(read_table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return token_planes.read_digests(spark, path, stage).withColumnRenamed("id", "doc_id")


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(told).alias("text"))
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    stage = Stage(spark, "chat")
    written = stage.save(chat.format_conversations(turns, public_tokenizers.path("byte_bpe_50k.json")), "formatted")
    return chat.read_back(written)


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), spaced=False, decoded=True)
    n_tokens = (F.octet_length("ids") / 4).cast("long").alias("n_tokens")
    return coded.select(F.col("id").alias("doc_id"), n_tokens, F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), k=10)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``, the words of a tenth of the documents repeating with a period from some word on."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    words = docs.select("doc_id", "text", h.alias("h"), g.alias("g"), F.when(h % 10 == 0, F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")).alias("words"))
    cut = words.withColumn("n", F.nullif(F.size("words"), F.lit(0))).withColumn("a", F.col("g") % F.col("n")).withColumn("p", F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)) + 1)
    a, p, n = (F.col(c).cast("int") for c in "apn")
    period = F.slice("words", a + 1, p)
    repeated = F.slice(F.flatten(F.array_repeat(period, F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
    planted = F.array_join(F.concat(F.slice("words", F.lit(1), a), repeated), " ")
    return cut.select("doc_id", F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), planted).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find_runs(with_planted_runs(read_table(spark, sf_dir, "documents")), exponent=4, shortest=6)
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    top = found.select("*", longest.alias("top"))
    length, period = -F.col("top.l"), F.col("top.period")
    return top.select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), F.col("top.start").alias("start"), length.alias("length"), period.alias("period"),
        F.expr("-1000 * top.l div top.period").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_packing": op2_packing,
    "op3_hnsw_near_dedup": op3_hnsw_near_dedup,
    "op4_quality_llr": op4_quality_llr,
    "op5_sharding": op5_sharding,
    "op6_pfair_mixing": op6_pfair_mixing,
    "op7_repeated_passages": op7_repeated_passages,
    "op8_simhash": op8_simhash,
    "op9_token_planes": op9_token_planes,
    "op10_chat_format": op10_chat_format,
    "op11_bpe": op11_bpe,
    "op12_lexical_search": op12_lexical_search,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLE_SQL: dict[str, str] = {
    "op12_lexical_search": r"""
WITH letters AS (SELECT '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+' AS pattern, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS upper_, 'abcdefghijklmnopqrstuvwxyz' AS lower_),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), upper_, lower_), pattern) AS terms FROM documents, letters),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), upper_, lower_), pattern)) AS term FROM benchmark, letters),
asked AS (SELECT item_id, term, count(*) AS c FROM q GROUP BY ALL),
totals AS (SELECT count(*) FILTER (WHERE len(terms) > 0) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM d),
held AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM d) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM held, totals GROUP BY term, n_docs),
lengths AS (SELECT doc_id, 25 + (75 * len(terms) * n_docs) // n_terms AS m FROM d, totals WHERE len(terms) > 0),
scored AS (SELECT item_id, doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM asked JOIN held USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id) GROUP BY ALL),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
""",
}
