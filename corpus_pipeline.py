"""From raw documents to token digests, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the
last return the columns that they were given. A stage's result is written and read again, so a
lost executor costs no earlier stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens.llm import decontaminate, language_id, line_dedup, near_dedup, piece_codec
from graphlens.llm.queries import held_out, table, vocabulary
from graphlens.llm.shared import stored

#: Share of a text's letters that its language must hold.
MIN_LANGUAGE = 0.5


def put_aside(docs: DataFrame, *names: str) -> tuple[DataFrame, list[Column]]:
    """docs with columns of these names, which an operator gives, renamed; and the columns as they were."""
    aside = {c: f"__docs_{c}" for c in names if c in docs.columns}
    return docs.withColumnsRenamed(aside), [F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that have no letter, and those of which no language holds half.

    The model learns from documents with a language whose crc32 leaves another remainder than 1
    when divided by 3. Texts in two languages stay as long as one of them holds half.
    """
    learn = held_out(docs.select("doc_id", "text", "lang"), 3, 1).filter(~F.col("held_out"))
    rows, columns = put_aside(docs, "lang_pred", "score", "spans")
    found = language_id.identify(rows, language_id.fit(learn), spans=False)
    return found.filter((F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANGUAGE)).select(*columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without lines that many sources share, but for their first occurrence; n_chars is counted anew.

    A document of which nothing but white space is left goes: all its lines are in others.
    """
    rows, columns = put_aside(docs, "n_lines_dropped")
    found = line_dedup.drop_spread_lines(rows)
    blank = (F.col("n_lines_dropped") > 0) & (F.length(F.trim(F.translate("text", "\n\t\r", "   "))) == 0)
    found = found.filter(~F.coalesce(blank, F.lit(False)))
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words, similarity of 0.8 or more.

    The smallest id of a group stays, with all rows of that id; rows with a null id stay only in
    groups without an id, and texts without a word are no copies.
    """
    kept = near_dedup.near_duplicates(docs).filter("kept").select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["__id"]), "left_semi")


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold an item of the benchmark, up to its edits.

    Null and empty texts hold none and stay; so does every row of a null or repeated id that is clean.
    """
    rows, columns = put_aside(docs, "leaks")
    found = decontaminate.leaks(rows, table(spark, sf_dir, "benchmark"))
    return found.filter(F.size("leaks") == 0).select(*columns)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of each document's token ids, and the digest of what they decode to.

    A null text counts as empty: no ids. Every row gives a row, whatever its id.
    """
    found = piece_codec.round_trip(docs, vocabulary("piece_bpe_32k.model"))
    return found.select("doc_id", "lang", "source", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language", language),
    ("lines", lines),
    ("near_copies", near_copies),
    ("benchmark", benchmark),
    ("pieces", pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Language scores, edit distances and token ids are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None
