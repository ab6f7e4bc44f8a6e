"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from effectspark.llm import bpe, conversations, decontaminate, exact_dedup, langid, line_dedup, near_dedup, repeats, spelling, token_cache, toxicity, url_rules, warc
from effectspark.llm.tables import start, table
from effectspark.sources.store import Workspace

Query = Callable[[SparkSession, str], DataFrame]

# Fixed values of the queries.
RANKS = "byte_bpe_multi_50k.tiktoken"
TOKENIZER = "word_bpe_49k.json"
TOKEN_LIMIT = 2048
URL_RULES = (
    url_rules.Rule("org", "/", "allow"),
    url_rules.Rule("example.org", "/es/", "block"),
    url_rules.Rule("example.org", "/en/1", "block"),
    url_rules.Rule("com", "/fr/", "allow"),
    url_rules.Rule("com", "/de/", "block"),
)


def _held_out(n: int, remainder: int) -> Column:
    """Whether crc32 of the doc_id as text leaves this remainder modulo n; false for a NULL doc_id."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    return F.coalesce(F.pmod(crc, F.lit(n)) == remainder, F.lit(False))


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    start(spark)
    return bpe_digests(table(spark, sf_dir, "documents"))


def bpe_digests(docs: DataFrame) -> DataFrame:
    coded = bpe.encode_decode(
        docs.select("doc_id", "text"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    )
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = start(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), ws)
    return found.select("doc_id", "contaminated", "n_items", "longest", "items")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = start(spark)
    pages = table(spark, sf_dir, "pages").select(
        "page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload")
    )
    files = warc.write(warc.decide_revisits(pages), ws, ws.path("archives"))
    page = F.expr("try_cast(substring_index({}, ':', -1) AS BIGINT)".format("record_id"))
    target = F.expr("try_cast(substring_index({}, ':', -1) AS BIGINT)".format("refers_to"))
    return warc.read(files.df).select(
        page.alias("page_id"), "payload_bytes", "payload_digest", "record_type", target.alias("refers_to")
    )


def op4_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = start(spark)
    found = repeats.remove_repeats(table(spark, sf_dir, "documents"), ws)
    return found.select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str, ws: Workspace) -> toxicity.Model | None:
    """Learned from the labels that are not held out."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(~_held_out(3, 1))
    return toxicity.fit(docs, labels, ws)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = start(spark, toxicity.BATCH_ROWS)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity_model(spark, docs, sf_dir, ws))
    return scored.select(
        "doc_id",
        _held_out(3, 1).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.TOXIC_FROM).cast("int").alias("predicted"),
        "spans",
    )


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = start(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = _held_out(4, 2)
    model = langid.fit(docs.filter(~held_out).select("text", "lang"), ws)
    found = langid.predict(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = start(spark)
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents"), ws)
    text = F.coalesce("text", F.lit(""))
    return found.select("doc_id", "n_lines", "n_removed", "n_chunks_removed", F.sha2(text, 256).alias("kept_sha256"))


def token_cache_folder(spark: SparkSession) -> str:
    """The lasting cache of counts, beside the folders of single runs."""
    return f"{Workspace(spark).root.rpartition('/')[0]}/effectspark-token-counts"


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = start(spark)
    counts = token_cache.token_counts(
        table(spark, sf_dir, "documents"), ws, public_tokenizers.path(TOKENIZER), token_cache_folder(spark)
    )
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = start(spark)
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), ws).drop("key")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = start(spark)
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"), ws)


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = start(spark)
    rows = table(spark, sf_dir, "conversations")
    return conversations.repair(conversations.damage(rows), ws, rows)


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = start(spark)
    return spelling.spelling_variants(table(spark, sf_dir, "documents"), ws)


def op13_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = start(spark)
    return url_rules.judge_urls(table(spark, sf_dir, "pages"), URL_RULES, ws)


def queries() -> dict[str, Query]:
    return {
        name: query for name, query in sorted(globals().items()) if name.startswith("op") and callable(query)
    }
