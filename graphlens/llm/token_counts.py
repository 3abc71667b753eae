"""Token counts behind a digest cache.

The cache is a Parquet table (content_digest, tokenizer_digest, n_tokens) in a shared folder.
A run computes the digest of each normalised text in the JVM, anti-joins the digests with the
cache, encodes each distinct missing text once, appends the counts, and joins the counts to the
rows. Identical texts meet in a map-side partial aggregate, so a hot group of copies shuffles
one row per task.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import bounded_batches, coded, rows_of, shared_path, split, stored, sums, texts

#: Distinct words whose counts a Python worker remembers before it starts anew.
WORDS_KEPT = 150_000
#: Texts or words handed to the tokenizer's library in one call.
AT_ONCE = 1_000

CACHE_SCHEMA = T.StructType([
    T.StructField("content_digest", T.BinaryType()),
    T.StructField("tokenizer_digest", T.StringType()),
    T.StructField("n_tokens", T.LongType()),
])


def tokenizer_digest(path: str) -> str:
    """SHA-256 of the tokenizer's file: another version is another digest."""
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


def drops_whitespace(path: str) -> bool:
    """Whether no token of this tokenizer depends on, or reaches across, spaces and line ends.

    True for a `tokenizers` file whose first pre-tokenizer removes what a pattern without white
    space does not match. Then texts that differ in the white space between words alone have the
    same count, and words can be counted one by one.
    """
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    first = spec.get("pre_tokenizer") or {}
    first = (first.get("pretokenizers") or [first])[0]
    pattern = (first.get("pattern") or {}).get("Regex", "")
    kinds = {step.get("type") for step in (spec.get("normalizer") or {}).get("normalizers", [])}
    return (
        first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True
        and r"[^\s" in pattern and " " not in pattern and kinds <= {"NFC", "Replace", "Lowercase"}
    )


class Counter:
    """Counts the tokens of texts with the tokenizer's own library."""

    def __init__(self, path: str):
        self.by_word = drops_whitespace(path)
        self.known: dict[str, int] = {}
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            encode = Tokenizer.from_file(path).encode_batch_fast
            # the library keeps about a kilobyte for each encoded text: few at a time
            self.lengths = lambda xs: [len(e) for i in range(0, len(xs), AT_ONCE) for e in encode(xs[i : i + AT_ONCE], add_special_tokens=False)]
        else:
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.lengths = lambda xs: [len(ids) for ids in model.encode(xs, num_threads=1)]

    def count(self, array: pa.Array) -> np.ndarray:
        """Tokens of each (non-null) text."""
        if not self.by_word:
            return np.asarray(self.lengths(array.to_pylist()), np.int64)
        import pyarrow.compute as pc

        words, offsets = split(pc.replace_substring(array, "\n", " "))
        codes, distinct = coded(words)
        if len(self.known) > WORDS_KEPT:
            self.known.clear()
        missing = [w for w in distinct if w not in self.known]
        self.known.update(zip(missing, self.lengths(missing), strict=True))
        n = np.fromiter((self.known[w] for w in distinct), np.int64, len(distinct))
        return sums(n[codes] if len(codes) else np.zeros(0, np.int64), offsets)


@lru_cache(maxsize=2)
def counter_of(path: str, version: str) -> Counter:
    """One counter for all tasks of a worker: the library does not give back what each load takes."""
    return Counter(path)


def normal_form(text: Column, path: str) -> Column:
    """What the digest is taken of; equal forms have equal counts."""
    text = F.coalesce(text, F.lit(""))
    return F.trim(F.regexp_replace(text, "[ \\n]+", " ")) if drops_whitespace(path) else text


def digest(text: Column, path: str) -> Column:
    return F.unhex(F.sha2(normal_form(text, path), 256))


def read_cache(spark: SparkSession, cache: str) -> DataFrame:
    """The cache's rows; none if the table does not exist yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(cache)


def fill_cache(docs: DataFrame, tokenizer: str, cache: str, text: str = "text") -> None:
    """Count each distinct text that the cache lacks, and append the counts."""
    spark, version = docs.sparkSession, tokenizer_digest(tokenizer)
    wanted = docs.select(digest(F.col(text), tokenizer).alias("content_digest"), normal_form(F.col(text), tokenizer).alias("text"))
    known = read_cache(spark, cache).filter(F.col("tokenizer_digest") == version).select("content_digest")
    misses = wanted.join(known, "content_digest", "left_anti") if not known.isEmpty() else wanted
    misses = misses.groupBy("content_digest").agg(F.first("text").alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(tokenizer, version)
        for batch in rows_of(batches, "text"):
            n = counter.count(texts(batch))
            yield pa.RecordBatch.from_arrays(
                [batch.column("content_digest"), pa.array([version] * len(n), pa.string()), pa.array(n, pa.int64())],
                ["content_digest", "tokenizer_digest", "n_tokens"],
            )

    bounded_batches(spark)
    misses.mapInArrow(encode, CACHE_SCHEMA).write.mode("append").parquet(cache)


def count_tokens(docs: DataFrame, tokenizer: str, *, cache: str | None = None, text: str = "text", limit: int = 2048) -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit (n_tokens > limit) in place of such columns.

    tokenizer: path of a `tokenizers` .json or a sentencepiece .model file, the same on all
    machines. cache: path of the cache table; a new one in the shared folder by default. Two
    runs that append the same digest at the same time do no harm: counts of a digest are equal
    and meet in one row here. Null text counts as empty (0 tokens); repeated rows stay; an empty
    table gives an empty result; all other columns stay as they are.
    """
    spark = docs.sparkSession
    own, cache = cache is None, cache or shared_path(spark, "token-counts")
    fill_cache(docs, tokenizer, cache, text)
    counts = read_cache(spark, cache).filter(F.col("tokenizer_digest") == tokenizer_digest(tokenizer)).select(F.col("content_digest").alias("__digest"), F.col("n_tokens").alias("__n"))
    if not own:  # others may append to it: a digest may come twice
        counts = stored(counts.groupBy("__digest").agg(F.max("__n").alias("__n")), "known-counts")
    # both sides are plain rows, so a digest that many rows have is split at run time
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("n_bytes", "n_tokens", "over_limit")]
    rows = docs.select(
        *kept, F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias("n_bytes"), digest(F.col(text), tokenizer).alias("__digest")
    )
    return (
        rows.join(counts, "__digest", "left").drop("__digest")
        .withColumn("n_tokens", F.col("__n")).withColumn("over_limit", F.col("__n") > limit).drop("__n")
    )
