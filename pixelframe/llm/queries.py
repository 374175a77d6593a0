"""The queries of the training-data operators, and DuckDB SQL for those that SQL can express.

Each query applies its operator to its whole table and derives the columns that are asked for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fertility, hosts, ledger, mixing, pu, simhash, tiling, tokencount, toolcalls, warc
from .common import read_table

#: Where public vocabularies are; None: the installed package's own files.
VOCABULARY_DIR: str | None = None


def vocabulary(name: str) -> str:
    if VOCABULARY_DIR:
        return f"{VOCABULARY_DIR}/{name}"
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken")
    trusted = read_table(spark, sf_dir, "labels").where("quality = 1")
    return fertility.quality_rules(read_table(spark, sf_dir, "documents"), {n: vocabulary(n) for n in names}, trusted)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.assignments(read_table(spark, sf_dir, "documents"))
    joined = lambda name: F.array_join(F.transform(f"copies.{name}", lambda x: x.cast("string")), ",")
    taken = (F.col("size") * F.size("copies")).cast("long").alias("taken")
    return out.select("doc_id", "size", "source_size", "target", taken, joined("shard").alias("shards"), joined("place").alias("places"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hosts.filter_urls(read_table(spark, sf_dir, "pages"), hosts.RULES)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(read_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    described = pu.features(read_table(spark, sf_dir, "documents"))
    return pu.score(described, pu.train(described, read_table(spark, sf_dir, "labels")))


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document is a path of a repository. Two pushes bring them: those of half of the ids by hash, then the others."""
    docs = read_table(spark, sf_dir, "documents")
    push = (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).bitwiseAND(1) + 1).cast("int")
    versions = docs.select(F.col("doc_id").alias("path"), push.alias("version"), F.col("text").alias("content"))
    found, _ = ledger.scan_history([versions.where("version = 1"), versions.where("version = 2")])
    base = F.filter("spans", lambda s: s["kind"].isin(*ledger.BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(F.col("path").alias("doc_id"), *map(count, ledger.BASE), F.sha2(ledger.joined_spans(base), 256).alias("base_sha256"), ledger.joined_spans(F.col("spans")).alias("spans"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.round_trip(spark, read_table(spark, sf_dir, "pages")).where(F.col("type").isNotNull())
    number = lambda name: F.try_element_at("headers", F.lit(name)).cast("long")
    return out.select(number("x-page-id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), number("x-refers-to-page").alias("refers_to"))


def op10_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toolcalls.link_tool_calls(toolcalls.turns_as_calls(read_table(spark, sf_dir, "conversations")), toolcalls.REPLY)
    return out.withColumn("errors", F.array_join("errors", "; "))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_quality_rules, op2_mixing, op3_url_filters, op4_simhash, op5_token_counts, op6_decontamination, op7_quality_classifier, op8_secret_scans, op9_warc, op10_tool_calls)
}

ORACLE_SQL: dict[str, str] = {
    "op2_mixing": mixing.ORACLE,
    "op3_url_filters": hosts.ORACLE,
    "op9_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, ''))::BIGINT AS n FROM pages),
        q AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY h) END AS kept FROM p)
        SELECT page_id, n AS payload_bytes, sha1(h) AS payload_digest,
               CASE WHEN kept <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN kept <> page_id THEN kept END AS refers_to
        FROM q""",
    "op10_tool_calls": toolcalls.ORACLE,
}
