"""The queries over the driver's tables, one for each operator, and their SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_id, line_dedup
from .line_dedup import drop_spread_lines
from .url_filter import Rule, judge


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file on this machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = held_out(table(spark, sf_dir, "labels").select("doc_id", "toxic"), 5, 0)
    model = toxicity.fit(docs, labels.filter(~F.col("held_out")))
    found = toxicity.score(held_out(docs, 5, 0), model)
    return found.select("doc_id", "held_out", "score", "predicted", F.transform("evidence", lambda e: e.doc_id).alias("evidence"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, vocabulary("word_bpe_49k.json"), limit=2048).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op1_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .piece_codec import round_trip

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return round_trip(docs, vocabulary("piece_bpe_32k.model")).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "covered_bytes")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import leaks

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = leaks(docs, table(spark, sf_dir, "benchmark"))
    items, least = F.transform("leaks", lambda x: x.item_id), F.array_min(F.transform("leaks", lambda x: x.distance))
    return found.select("doc_id", (F.size("leaks") > 0).alias("contaminated"), items.alias("item_ids"), least.alias("distance"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=3, percent=85)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_spread_lines(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).drop("source")


def op4_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .span_dedup import drop_repeats

    return drop_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


def held_out(rows: DataFrame, folds: int, fold: int) -> DataFrame:
    """rows with held_out: whether crc32 of doc_id as text leaves `fold` when divided by `folds`."""
    return rows.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == fold, F.lit(False)))


def op5_hamming_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hamming_index import nearest

    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.filter(F.col("vec_id") % 100 == 0), k=10)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = held_out(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), 3, 1)
    model = language_id.fit(docs.filter(~F.col("held_out") & F.col("doc_id").isNotNull()))
    found = language_id.identify(docs.drop("lang"), model)
    return found.select("doc_id", "held_out", "lang_pred", "score", F.size("spans").alias("n_spans"))


#: Fixed values of the query's contract.
URL_RULES = [Rule("block", "net/"), Rule("allow", "example.net/en/"), Rule("block", "example.com/de/"), Rule("allow", "org/fr/")]


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "template", F.round("purity", 9).alias("purity"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_piece_codec": op1_piece_codec,
    "op2_toxicity": op2_toxicity,
    "op3_token_counts": op3_token_counts,
    "op4_span_dedup": op4_span_dedup,
    "op5_hamming_index": op5_hamming_index,
    "op6_language_id": op6_language_id,
    "op7_decontaminate": op7_decontaminate,
    "op8_near_dedup": op8_near_dedup,
    "op9_line_dedup": op9_line_dedup,
    "op10_url_filter": op10_url_filter,
}

#: Only where SQL can express the operator: the others are tested against brute force, the libraries or held-out labels.
ORACLES: dict[str, str] = {
    "op9_line_dedup": line_dedup.oracle(),
}
