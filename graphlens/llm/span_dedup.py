"""Removal of repeated passages by hashes of sliding sentence spans.

A document is cut into units: sentences (at . ! ? before white space, at the ends that other
scripts write, and at line ends). A sentence of more than LONG words is cut where the hash of two
neighbouring words is the smallest within WINDOW places, so the cuts inside a passage depend on
the passage alone, wherever in such a sentence it begins; a passage within one sentence loses its
units but for a part of one at either end. In scripts without spaces each character is a word of
half the size. Spans are the shortest runs of at least `min_sentences` units with at least
`min_words` words that start at a unit, and those that end at one: every longer run is covered by
them. Span hashes meet over all documents; of a hash that several documents have, the first
document keeps its span, and in all others, and for every later occurrence within a document, the
units that the span covers are removed.

Hashes that one row alone has, nearly all, are found by counts of a 64-bit hash; the rows of
the others are compared by 32 further bits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import pairwise
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import bounded_batches, discard, rows_of, stored, texts

#: Units and words of a span at least.
MIN_SENTENCES, MIN_WORDS = 2, 20
#: Words beyond which a sentence is cut, the window of cuts, and words without a cut at most.
LONG, WINDOW, STRETCH = 18, 5, 40
_END = re.compile(r"[.!?]+\s+|[。！？｡]+[”’」』）]*\s*|[।॥።؟۔]+\s*|\n\s*")
# fixed values: code points of scripts without spaces (Thai to Myanmar, Khmer, CJK), and their signs
_DENSE = "\u0e00-\u109f\u1780-\u17ff\u3001-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff00-\uffef\U00020000-\U0003ffff"
_WORD = re.compile(rf"[{_DENSE}][。！？｡，、：；”’」』）]*|[^\s{_DENSE}]+")
_ONE = re.compile(rf"[{_DENSE}]")
_PLAIN = re.compile(r"\S+")

SPANS = T.StructType([
    T.StructField("doc", T.LongType()), T.StructField("text_key", T.LongType()), T.StructField("h1", T.LongType()), T.StructField("h2", T.IntegerType()),
    T.StructField("first", T.IntegerType()), T.StructField("n", T.IntegerType()),
])


def cuts(long: list[list[str]]) -> list[list[int]]:
    """Where each long sentence is cut (numbers of words before a cut), by the words around."""
    none = 1 << 32
    hashes: list[int] = []
    for words in long:
        hashes += [none] * WINDOW
        hashes += [crc32(f"{a} {b}".encode("utf-8", "replace")) for a, b in pairwise(words)]
    h = np.asarray([*hashes, *[none] * WINDOW], np.int64)
    around = np.lib.stride_tricks.sliding_window_view(h, WINDOW).min(1)
    middle = h[WINDOW:-WINDOW]
    own = np.flatnonzero((middle < around[: len(middle)]) & (middle <= around[WINDOW + 1 :])) + WINDOW
    out, start = [], 0
    bounds = np.searchsorted(own, np.cumsum([0, *(len(words) - 1 + WINDOW for words in long)]))
    for words, x, y in zip(long, bounds, bounds[1:], strict=False):
        found, last = [], 0
        for at in [*(own[x:y] - start - WINDOW + 1).tolist(), len(words)]:  # words that repeat have no smallest hash
            found += range(last + STRETCH, at, STRETCH)
            found.append(at)
            last = at
        out.append(found)
        start += len(words) - 1 + WINDOW
    return out


def sentences(text: str) -> tuple[list[int], list[str], list[int], list[int]]:
    """Where each unit ends, its words in lower case with single spaces, their size in half words, and the unit's sentence."""
    plain = text.isascii() or not _ONE.search(text)
    bounds = [m.end() for m in _END.finditer(text)]
    if not bounds or bounds[-1] < len(text):
        bounds.append(len(text))
    parts, long, a = [], [], 0
    for b in bounds:
        own = text[a:b].split() if plain else _WORD.findall(text[a:b])
        size = None if plain else [1 if _ONE.match(w) else 2 for w in own]
        parts.append((a, b, own, size, 2 * len(own) if plain else sum(size)))
        if parts[-1][4] > 2 * LONG:
            long.append([w.lower() for w in own])
        a = b
    cut = iter(zip(long, cuts(long), strict=True)) if long else iter(())
    ends, words, sizes, owner = [], [], [], []
    for number, (a, b, own, size, total) in enumerate(parts):
        if total <= 2 * LONG:
            ends.append(b), words.append(" ".join(own).lower()), sizes.append(total), owner.append(number)
            continue
        lower, places = next(cut)
        # each unit with the white space behind it; the first with that before it
        starts = [m.start() for m in (_PLAIN if plain else _WORD).finditer(text, a, b)]
        last = 0
        for at in places:
            ends.append(starts[at] if at < len(own) else b)
            words.append(" ".join(lower[last:at])), sizes.append(2 * (at - last) if plain else sum(size[last:at])), owner.append(number)
            last = at
    return ends, words, sizes, owner


def spans(sizes: list[int], min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS) -> list[tuple[int, int]]:
    """(first, end) of the spans, in order."""
    n = len(sizes)
    total = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
    start, ends = np.arange(n), np.arange(1, n + 1)
    end = np.maximum(np.searchsorted(total, total[:-1] + 2 * min_words), start + min_sentences)
    back = np.minimum(np.searchsorted(total, total[1:] - 2 * min_words, "right") - 1, ends - min_sentences)
    found = np.concatenate((start[end <= n] * (n + 1) + end[end <= n], (back * (n + 1) + ends)[back >= 0]))
    found = np.unique(found)
    return list(zip((found // (n + 1)).tolist(), (found % (n + 1)).tolist(), strict=True))


def hashed(words: list[str], a: int, b: int) -> int:
    return xxhash.xxh3_128_intdigest(" ".join(words[a:b]))


def drop_repeats(docs: DataFrame, *, doc: str = "doc_id", text: str = "text", min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS) -> DataFrame:
    """docs without the units that removed spans cover, and n_sentences_dropped (whole or in part).

    Spans are equal if their words are, in lower case; white space does not count. A null text
    stays null, an empty one empty; a text whose sentences all go becomes empty; every row
    stays. The first document is the one with the smallest id, then the smallest hash of its
    text; a null id comes after all others. Rows that are equal in id and text are one document:
    a span that only they have is removed only where it repeats within the text. Other columns
    stay; one named n_sentences_dropped is replaced.
    """
    bounded_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c != "n_sentences_dropped"]
    key = F.xxhash64(F.col(text))
    at = F.coalesce(F.col(doc).cast("long"), F.lit((1 << 63) - 1))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, "text"):
            owner, hashes, first, size = [], [], [], []
            for i, value in enumerate(texts(batch).to_pylist()):
                _, words, sizes, _ = sentences(value)
                seen = set()
                every = spans(sizes, min_sentences, min_words)
                for a, b in every:
                    h = hashed(words, a, b)
                    if h not in seen:
                        seen.add(h)
                        owner.append(i), hashes.append(h), first.append(a), size.append(b - a)
                if len(seen) < len(every):  # it repeats a span of its own: an empty span says so
                    owner.append(i), hashes.append(0), first.append(0), size.append(0)
            rows = pa.array(owner, pa.int64())
            h1, h2 = (np.fromiter((h >> shift & mask for h in hashes), t, len(hashes)) for shift, mask, t in ((0, (1 << 64) - 1, np.uint64), (64, (1 << 32) - 1, np.uint32)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc").take(rows), batch.column("text_key").take(rows), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int32)),
                 pa.array(first, pa.int32()), pa.array(size, pa.int32())], [f.name for f in SPANS.fields],
            )

    found = stored(docs.filter(F.col(text).isNotNull()).select(at.alias("doc"), key.alias("text_key"), F.col(text).alias("text")).mapInArrow(find, SPANS), "sentence-spans")
    # all joins are of plain rows, so a passage that many documents share is split at run time
    often = stored(found.filter("n > 0").groupBy("h1").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h1"), "span-hashes")
    common = stored(found.filter("n > 0").join(often, "h1").unionByName(found.filter("n = 0")), "common-spans")
    discard(found, often)
    place = F.struct("doc", "text_key")
    keepers = common.filter("n > 0").groupBy("h1", "h2").agg(F.min(place).alias("keeper"), F.max(place).alias("last")).filter("keeper < last").select("h1", "h2", "keeper")
    gone = common.join(stored(keepers, "first-spans"), ["h1", "h2"]).filter(place != F.col("keeper")).select("doc", "text_key", "first", "n")
    gone = gone.unionByName(common.filter("n = 0").select(*gone.columns))
    gone = gone.groupBy("doc", "text_key").agg(F.collect_set(F.struct("first", "n")).alias("__gone"))
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], at.alias("__doc"), key.alias("__key"))
    gone = gone.select(F.col("doc").alias("__doc"), F.col("text_key").alias("__key"), "__gone")
    rows = rows.join(gone, ["__doc", "__key"], "left").select(*[F.col(f"`{c}`") for c in kept], "__gone")
    schema = T.StructType([*docs.select(*[f"`{c}`" for c in kept]).schema.fields, T.StructField("n_sentences_dropped", T.IntegerType())])
    column = kept.index(text)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, text):
            new, counts = [], []
            for value, own in zip(batch.column(column).to_pylist(), batch.column("__gone").to_pylist(), strict=True):
                value, n = (value, 0) if own is None else without(value, [(x["first"], x["n"]) for x in own if x["n"]], min_sentences, min_words)
                new.append(value), counts.append(n)
            columns = [pa.array(new, pa.string()) if i == column else batch.column(i) for i in range(len(kept))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int32())], [f.name for f in schema.fields])

    return rows.mapInArrow(remove, schema)


def without(text: str | None, gone: list[tuple[int, int]], min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS) -> tuple[str | None, int]:
    """The text without the spans (first, n) and without later occurrences of its own spans."""
    if not text:
        return text, 0
    ends, words, sizes, owner = sentences(text)
    covered = np.zeros(len(words), bool)
    for first, n in gone:
        covered[first : first + n] = True
    seen: dict[int, tuple[int, int]] = {}
    removed = {(a, a + n) for a, n in gone}
    for a, b in spans(sizes, min_sentences, min_words):
        h = hashed(words, a, b)
        if h in seen:
            # an occurrence that overlaps the first one would take part of what is kept
            if a >= seen[h][1] or seen[h] in removed:
                covered[a:b] = True
        else:
            seen[h] = (a, b)
    if not covered.any():
        return text, 0
    starts = [0, *ends[:-1]]
    return "".join(text[a:b] for a, b, c in zip(starts, ends, covered.tolist(), strict=True) if not c).rstrip(), len(set(np.asarray(owner)[covered].tolist()))
