"""Toxicity by the nearest labelled examples.

Terms are all words of the examples and the beginnings of words. Examples and texts are TF-IDF
vectors of these terms; document frequencies are counted over all documents, and a term that
occurs in toxic examples significantly more often weighs more, by its significance.

Toxic and clean examples, similar ones side by side, lie in blocks of BLOCK_SIZE. The inverted
index has, for each term, its postings and, if they are more than FEW, the largest weight in each
block. Of a text, the few postings of rare terms and a dense matrix of the terms that many examples
have give a part of the cosine with every example; with the largest weights of the other terms
they bound the cosine with the examples of a block. The blocks of highest bound are opened first,
and the others only if their bound reaches the cosine of the nearest examples found so far; if many
bounds are ALIKE, few blocks could stay closed, and the postings of each term are read in one piece.
The dense matrix is in single precision, which leaves more examples than needed by a relative SLACK;
of those that are left the dense part is computed again with what single precision has cut off: the
nearest examples are exact. Their votes, weighted by distance, are calibrated by isotonic regression
on left-out examples.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property, lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import bounded_batches, buffers, coded, from_buffers, gather, rows_of, texts, words_of

#: Labelled rows of each label that are used as examples, about: chosen by the hash of their id.
MAX_EXAMPLES = 3_000
#: Likelihood-ratio statistic (G squared) and number of toxic examples from which a term weighs more.
MIN_G2, MIN_TOXIC = 25.0, 4
#: Lengths of the beginnings of words that are terms beside the words.
PREFIXES = (4, 5, 6)
NEIGHBOURS = 15
#: Texts whose cosines with common terms are computed together.
TOGETHER = 128
#: Examples of a block, blocks that are opened first, and postings up to which a term has no bounds by block.
BLOCK_SIZE, FIRST, FEW = 64, 4, 24
#: All blocks are opened at once if, by so many of a text's heaviest terms, more than this share of the bounds is at least that part of the REFERENCE-th highest,
#: or if more than this share of the blocks is left to open after the first ones: reading pieces takes less than picking from them.
HEAVIEST, ALIKE, REFERENCE = 32, (0.35, 0.1), 8
#: Groups of similar examples that the blocks are cut from, about, and dimensions in which they are formed.
GROUPS, SKETCH = 64, 256
#: Terms that more than one of so many examples has are rows of the dense matrix.
DENSE = 12
#: Relative error that single precision leaves in a cosine, at most: its terms are not negative, and a sum over N of them errs by N * 6e-8.
SLACK = 3e-4


@lru_cache(1)
def letters() -> np.ndarray:
    """Whether each code point is a letter or a mark, as Arrow's expressions have it."""
    points = np.concatenate((np.arange(0xD800), np.arange(0xE000, 0x110000)))
    out = np.zeros(0x110000, bool)
    out[points] = np.asarray(pc.match_substring_regex(pa.array(list(points.astype("<u4").tobytes().decode("utf-32-le"))), r"^[\p{L}\p{M}]"))
    return out


def filled_words(array: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """words_of without the empty strings; code points are looked up in a table, which takes less than an expression."""
    offsets, data = buffers(pc.utf8_lower(array))
    point = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), "<u4")
    inside = letters()[point]
    if len(point) < len(data):
        inside = np.repeat(inside, 1 + (point >= 0x80).astype(np.int8) + (point >= 0x800) + (point >= 0x10000))
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    row = offsets[:-1][offsets[:-1] < len(data)]
    first[row] = inside[row]
    start = np.flatnonzero(first)
    return from_buffers(np.append(np.cumsum(inside)[start] - 1, inside.sum()), data[inside]), np.searchsorted(start, offsets)


def term_codes(distinct: list[str]) -> tuple[list[np.ndarray], list[str]]:
    """For each kind of term the code of every word's term (-1: none), and the terms."""
    place: dict[str, int] = {}
    kinds = [np.fromiter((place.setdefault(f"w:{w}", len(place)) if w else -1 for w in distinct), np.int64, len(distinct))]
    for n in PREFIXES:
        kinds.append(np.fromiter((place.setdefault(f"p:{w[:n]}", len(place)) if len(w) > n else -1 for w in distinct), np.int64, len(distinct)))
    return kinds, list(place)


def spelled(words: pa.Array) -> list[str]:
    """The words, which hold no space: one long text is handed to Python in less time than each word."""
    if not len(words):
        return []
    return pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words.cast(pa.string())), " ")[0].as_py().split(" ")


@dataclass
class Model:
    terms: pa.Array = field(default_factory=lambda: pa.array([], pa.large_string()))
    idf: np.ndarray = field(default_factory=lambda: np.zeros(0))
    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    labels: np.ndarray = field(default_factory=lambda: np.zeros(0))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))  # rows of the corpus that an example stands for
    rank: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # for ties: places by id
    starts: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))  # postings of each term that has no dense row
    examples: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint16))  # of each posting, in the fewest bytes
    values: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bound_row: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # of each term, -1: none
    highest: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))  # terms with bounds x blocks, rounded up
    places: np.ndarray = field(default_factory=lambda: np.zeros((0, 1), np.int32))  # where each block's postings start
    dense_row: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # of each term, -1: none
    dense: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))  # terms with a dense row x examples, whole blocks
    cut_off: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))  # what single precision leaves out of dense
    base: float = 0.0  # share of toxic among examples without a word
    knots: tuple[np.ndarray, np.ndarray] = (np.asarray([0.0, 1.0]), np.asarray([0.0, 1.0]))
    opened: int = 0  # blocks opened and passed over so far
    passed: int = 0

    @cached_property
    def vectors(self) -> Vectors:
        return Vectors(self.terms, self.idf)

    @cached_property
    def pieces(self) -> tuple[list[bytes], list[bytes], np.ndarray]:
        """Examples and values of the postings of each term with bounds, and their number: joined, they take less time than numbers from many places."""
        ends = self.places[:, [0, -1]].tolist()
        return [self.examples[a:b].tobytes() for a, b in ends], [self.values[a:b].tobytes() for a, b in ends], self.places[:, -1] - self.places[:, 0]

    def nearest(self, terms: np.ndarray, values: np.ndarray, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The examples of highest cosine with a unit vector, and the cosines; ties to the first example."""
        return self.nearest_of([(terms, values)], [without])[0]

    def nearest_of(self, vectors: list[tuple[np.ndarray, np.ndarray]], without: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        k, n = len(vectors), self.dense.shape[1]
        if not n:
            return [(np.zeros(0, np.int64), np.zeros(0))] * k
        owner = np.repeat(np.arange(k), [len(terms) for terms, _ in vectors])
        terms, values = np.concatenate([x for x, _ in vectors]), np.concatenate([x for _, x in vectors])
        common = np.zeros((k, len(self.dense)))
        row = self.dense_row[terms]
        common[owner[row >= 0], row[row >= 0]] = values[row >= 0]
        about = common.astype(np.float32) @ self.dense
        owner, terms, values = owner[row < 0], terms[row < 0], values[row < 0]
        row = self.bound_row[terms]
        rare = row < 0
        size = self.starts[terms[rare] + 1] - self.starts[terms[rare]]
        at = gather(self.starts[terms[rare]], size)
        cosine = about + np.bincount(np.repeat(owner[rare] * n, size) + self.examples[at], self.values[at] * np.repeat(values[rare], size), k * n).reshape(k, n)
        known = cosine.reshape(k, -1, BLOCK_SIZE).max(2)
        owner, row, values = owner[~rare], row[~rare], values[~rare]
        cut = np.searchsorted(owner, np.arange(k + 1)).tolist()
        out = []
        for i, skip in enumerate(without or [-1] * k):
            at = slice(cut[i], cut[i + 1])
            found = self.search(cosine[i], known[i], row[at], values[at], skip)
            exact = cosine[i, found] - about[i, found] + self.dense_part(found, common[i])
            near = np.round(exact, 12)
            best = np.lexsort((self.rank[found], -near))[:NEIGHBOURS]
            best = best[near[best] > 1e-12]
            out.append((found[best], np.minimum(exact[best], 1.0)))
        return out

    def dense_part(self, found: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Of the cosines with these examples what the terms with a dense row give; wanted: the text's weight of each."""
        return self.dense.T[found] @ wanted + self.cut_off.T[found] @ wanted

    def search(self, cosine: np.ndarray, known: np.ndarray, row: np.ndarray, values: np.ndarray, without: int) -> np.ndarray:
        """The nearest examples, and those that may be as near.

        cosine: with all examples, over the terms without bounds; known: the largest of each block; row and values: the other terms.
        """
        n, heavy = len(cosine), np.argpartition(values, -HEAVIEST)[-HEAVIEST:] if len(values) > HEAVIEST else slice(None)
        bound = known + values[heavy].astype(np.float32) @ self.highest[row[heavy]]
        if np.count_nonzero(bound >= ALIKE[1] * np.partition(bound, -min(REFERENCE, len(bound)))[-min(REFERENCE, len(bound))]) > ALIKE[0] * len(bound):
            return self.through(cosine, row, values, without)
        bound = known + (values.astype(np.float32) @ self.highest[row]) * 1.0001
        places, todo = self.places[row], bound > 1e-12
        first = np.zeros(len(bound), bool)
        first[np.argpartition(bound, -min(FIRST, len(bound)))[-FIRST:]] = True
        seen, before = np.zeros(len(bound), bool), cosine.copy()
        for some in (first & todo, todo):
            if seen.any():
                some = some & ~seen & (bound >= self.least(cosine.reshape(-1, BLOCK_SIZE)[seen]) * (1 - SLACK) - 1e-9)
                if np.count_nonzero(some) > ALIKE[0] * len(bound):
                    cosine[:] = before
                    return self.through(cosine, row, values, without)
            # neighbouring blocks are opened together
            inside = np.zeros(len(some) + 2, bool)
            inside[1:-1] = some
            edges = np.flatnonzero(inside[1:] != inside[:-1])
            if len(edges):
                ranges = places[:, edges]
                start, size = ranges[:, ::2].ravel(), (ranges[:, 1::2] - ranges[:, ::2]).ravel()
                filled = np.flatnonzero(size)
                size = size[filled]
                at = gather(start[filled], size)
                cosine += np.bincount(self.examples[at], self.values[at] * np.repeat(values[filled // (len(edges) // 2)], size), n)
            if without >= 0:
                cosine[without] = 0
            seen |= some
        self.opened += int(seen.sum())
        self.passed += int((~seen).sum())
        return self.reached(cosine, seen)

    def through(self, cosine: np.ndarray, row: np.ndarray, values: np.ndarray, without: int) -> np.ndarray:
        """The same with all blocks opened: each term's postings are one piece."""
        self.opened += len(cosine) // BLOCK_SIZE
        examples, weights, size = self.pieces
        rows = row.tolist()
        held = np.frombuffer(b"".join(map(examples.__getitem__, rows)), self.examples.dtype)
        weight = np.repeat(values, size[row])
        weight *= np.frombuffer(b"".join(map(weights.__getitem__, rows)))
        cosine += np.bincount(held, weight, len(cosine))
        if without >= 0:
            cosine[without] = 0
        return self.reached(cosine)

    def reached(self, cosine: np.ndarray, seen: np.ndarray | None = None) -> np.ndarray:
        """Of the blocks seen (None: of all) the nearest examples, and those that may be as near."""
        blocks = cosine.reshape(-1, BLOCK_SIZE)
        found = np.flatnonzero(cosine > max(1e-12, self.least(blocks if seen is None else blocks[seen]) * (1 - SLACK)))
        return found if seen is None else found[seen[found // BLOCK_SIZE]]

    @staticmethod
    def least(blocks: np.ndarray) -> float:
        """The lowest cosine of the nearest examples in these blocks."""
        if len(blocks) > NEIGHBOURS:
            # as many blocks have an example each that reaches this
            blocks = blocks[blocks >= np.partition(blocks.max(1), -NEIGHBOURS)[-NEIGHBOURS]]
        blocks = blocks.ravel()
        return float(np.partition(blocks, -NEIGHBOURS)[-NEIGHBOURS]) if len(blocks) >= NEIGHBOURS else 0.0

    def vote(self, best: np.ndarray, cosine: np.ndarray) -> float:
        """Share of toxic votes, weighted by closeness and by the rows that an example stands for."""
        if not len(best):
            return self.base
        votes = self.weights[best] / (0.05 + 1 - cosine)
        # a doubtful neighbourhood leans to the base
        return float((votes @ self.labels[best] + 0.1 * self.base) / (votes.sum() + 0.1))

    def calibrated(self, vote: float) -> float:
        return float(min(1.0, max(0.0, 0.99 * np.interp(vote, *self.knots) + 0.01 * vote)))


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing function of x nearest to y (pool adjacent violators)."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # sum of w*y, sum of w, sum of w*x
    last = None
    for xi, yi, wi in zip(x[order].tolist(), y[order].tolist(), w[order].tolist(), strict=True):
        if xi == last:
            pools[-1] = [pools[-1][0] + wi * yi, pools[-1][1] + wi, pools[-1][2] + wi * xi]
        else:
            pools.append([wi * yi, wi, wi * xi])
        last = xi
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            top = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], top, strict=True)]
    return np.asarray([p[2] / p[1] for p in pools]), np.asarray([p[0] / p[1] for p in pools])


class Vectors:
    """TF-IDF vectors of texts over a vocabulary, of unit length."""

    def __init__(self, terms: pa.Array | list[str], idf: np.ndarray | None = None):
        names = pa.array(terms, pa.large_string()) if isinstance(terms, list) else terms
        self.size, self.idf, self.names = len(names), idf, names

    @cached_property
    def known(self) -> tuple[dict[str, int], np.ndarray, list[tuple[int, pa.Array, np.ndarray]]]:
        """The row of each known word; rows of its own term and those of its beginnings (-1: none), last one without any; the beginnings by length, and their terms."""
        text = pc.utf8_slice_codeunits(self.names, 2)
        sizes = np.where(np.asarray(pc.starts_with(self.names, "w:")), 0, np.asarray(pc.utf8_length(text)))
        kinds = [(n, text.filter(pa.array(sizes == n)), np.flatnonzero(sizes == n)) for n in PREFIXES]
        words = spelled(text.filter(pa.array(sizes == 0)))
        rows = np.full((len(words) + 1, 1 + len(PREFIXES)), -1)
        rows[:-1, 0] = np.flatnonzero(sizes == 0)
        for i, (n, begins, terms) in enumerate(kinds, 1):
            place = dict(zip(spelled(begins), terms.tolist(), strict=True))
            rows[:-1, i] = [place.get(w[:n], -1) if len(w) > n else -1 for w in words]
        return {w: i for i, w in enumerate(words)}, rows, kinds

    def counts(self, array: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, occurrences) of the terms that occur, by row and term."""
        words, offsets = filled_words(array)
        found = words.dictionary_encode()
        codes, distinct = np.asarray(found.indices), found.dictionary
        places, terms_of, kinds = self.known
        every = spelled(distinct)
        row = np.fromiter(map(places.get, every, repeat(-1)), np.int64, len(every))
        term = terms_of[row]
        other = np.flatnonzero(row < 0)
        rest = distinct.take(pa.array(other))
        length = np.asarray(pc.utf8_length(rest))
        for i, (n, known, terms) in enumerate(kinds, 1):
            found = pc.utf8_slice_codeunits(rest, 0, n).dictionary_encode()
            # the texts' own words are fewer than the known ones: these are looked up among them
            place = np.asarray(pc.fill_null(pc.index_in(known, value_set=found.dictionary), -1))
            own = np.full(len(found.dictionary), -1)
            own[place[place >= 0]] = terms[place >= 0]
            term[other, i] = np.where(length > n, own[np.asarray(found.indices)], -1)
        size = max(1, self.size)
        each = term[codes]
        keys = np.sort((np.repeat(np.arange(len(array)) * size, np.diff(offsets))[:, None] + each)[each >= 0])
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        n, keys = np.diff(first, append=len(keys)), keys[first]
        rows = np.repeat(np.arange(len(array)), np.diff(np.searchsorted(keys, np.arange(len(array) + 1) * size)))
        return rows, keys - rows * size, n

    def unit(self, terms: np.ndarray, n: np.ndarray) -> np.ndarray:
        value = (1 + np.log(n)) * self.idf[terms]
        return value / max(1e-12, float(np.sqrt(value @ value)))


def examples_of(docs: DataFrame, labels: DataFrame, doc: str, text: str, toxic: str, limit: int) -> tuple[DataFrame, dict[int, float]]:
    """(doc, toxic, text) of about `limit` rows of each label, and the rows that each stands for."""
    known = labels.select(F.col(doc).alias("doc"), F.col(toxic).cast("int").alias("toxic")).filter("doc is not null and toxic in (0, 1)")
    known = known.groupBy("doc").agg(F.max("toxic").alias("toxic"))
    counts = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = {k: min(1.0, limit / n) for k, n in counts.items()}
    at = F.pmod(F.xxhash64(F.lit(5), "doc"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = known.filter(at < F.when(F.col("toxic") == 1, share.get(1, 0.0)).otherwise(share.get(0, 0.0)))
    # at most about two times `limit` rows of two columns
    rows = docs.select(F.col(doc).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc")
    return rows.select("doc", "toxic", "text"), {k: 1 / s for k, s in share.items()}


def fit(docs: DataFrame, labels: DataFrame, *, doc: str = "doc_id", text: str = "text", toxic: str = "toxic", limit: int = MAX_EXAMPLES) -> Model:
    """Learn from labels (doc, toxic 0 or 1; others are ignored) of docs; frequencies from all docs.

    doc is an integer column; rows with a null doc are no examples. A doc that is labelled twice is
    toxic if once. Without any example the model scores 0.
    """
    bounded_batches(docs.sparkSession)
    rows, weight = examples_of(docs, labels, doc, text, toxic, limit)
    schema = T.StructType([T.StructField("term", T.StringType()), T.StructField("toxic", T.LongType()), T.StructField("clean", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, "text"):
            bad = np.asarray(batch.column("toxic")).astype(np.int64)
            words, offsets = words_of(texts(batch))
            codes, distinct = coded(words)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            kinds, names = term_codes(distinct)
            size = max(1, len(names))
            keys = np.concatenate([(owner * size + k[codes])[k[codes] >= 0] for k in kinds]) if len(codes) else np.zeros(0, np.int64)
            keys = np.unique(keys)
            n1 = np.bincount(keys % size, bad[keys // size], size)[: len(names)]
            n = np.bincount(keys % size, minlength=size)[: len(names)]
            # the number of examples of each label, as a term that no word is
            sums = [[*n1.astype(np.int64).tolist(), int(bad.sum())], [*(n - n1).astype(np.int64).tolist(), int((1 - bad).sum())]]
            yield pa.RecordBatch.from_arrays([pa.array([*names, "all"], pa.string()), *(pa.array(x, pa.int64()) for x in sums)], ["term", "toxic", "clean"])

    counted = rows.mapInArrow(count, schema).groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counted = counted.toArrow()  # the terms of at most about two times `limit` examples
    counted = counted.take(pc.sort_indices(counted.column("term").combine_chunks()))
    names = counted.column("term").combine_chunks().cast(pa.large_string())
    a, b = (np.asarray(counted.column(c)).astype(np.float64) for c in ("toxic", "clean"))
    term = np.asarray(pc.not_equal(names, "all"))
    n1, n0 = float(a[~term].sum()), float(b[~term].sum())
    if not n1 or not n0:
        return Model()
    terms = names.filter(pa.array(term))
    boost = emphasis(a[term], b[term], n1, n0)
    # a worker keeps what it was sent, and so makes the tables of its words once
    sent = docs.sparkSession.sparkContext.broadcast(Vectors(terms))

    found = T.StructType([T.StructField("term", T.LongType()), T.StructField("n", T.LongType())])

    def frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, rows = sent.value, 0
        total = np.zeros(vectors.size, np.int64)
        for batch in rows_of(batches, "text"):
            total += np.bincount(vectors.counts(texts(batch))[1], minlength=len(total))
            rows += batch.num_rows
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, -1), pa.int64()), pa.array(np.append(total[seen], rows), pa.int64())], ["term", "n"])

    in_all = docs.select(F.col(text).alias("text")).mapInArrow(frequency, found).groupBy("term").agg(F.sum("n").alias("n"))
    in_all = in_all.toArrow()
    at, n = np.asarray(in_all.column("term")), np.asarray(in_all.column("n"))
    df = np.zeros(len(terms), np.int64)
    df[at[at >= 0]] = n[at >= 0]
    idf = (np.log((1 + n[at < 0].sum()) / (1 + df)) + 1) * boost

    vector = T.StructType([
        T.StructField("doc", T.LongType()), T.StructField("toxic", T.IntegerType()), T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("n", T.ArrayType(T.IntegerType())),
    ])

    def vectorise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = sent.value
        for batch in rows_of(batches, "text"):
            owner, term, n = vectors.counts(texts(batch))
            cut = np.searchsorted(owner, np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(cut, pa.array(x.astype(np.int32))) for x in (term, n)]
            yield pa.RecordBatch.from_arrays([batch.column("doc").cast(pa.int64()), batch.column("toxic").cast(pa.int32()), *lists], [f.name for f in vector.fields])

    got = rows.mapInArrow(vectorise, vector).toArrow()  # bounded by limit
    own = []
    for batch in got.to_batches():
        cut = np.asarray(batch.column("terms").offsets)
        term, n = (np.asarray(batch.column(c).values) for c in ("terms", "n"))
        for doc_id, bad, x, y in zip(batch.column("doc").to_pylist(), batch.column("toxic").to_pylist(), cut[:-1], cut[1:], strict=True):
            own.append((doc_id, bad, term[x:y], n[x:y]))
    sent.unpersist()
    return build(terms, idf, own, weight)


def emphasis(a: np.ndarray, b: np.ndarray, n1: float, n0: float) -> np.ndarray:
    """Weight of terms that a of n1 toxic and b of n0 clean examples have: 1, and G squared more where it is significant."""

    def part(x: np.ndarray, e: np.ndarray) -> np.ndarray:
        return np.where(x > 0, x * np.log(np.maximum(x, 1e-300) / np.maximum(e, 1e-300)), 0.0)

    share = (a + b) / (n1 + n0)
    g2 = 2 * (part(a, n1 * share) + part(b, n0 * share) + part(n1 - a, n1 * (1 - share)) + part(n0 - b, n0 * (1 - share)))
    return np.where((a >= MIN_TOXIC) & (a / n1 > 3 * b / n0) & (g2 >= MIN_G2), 1 + g2, 1.0)


def side_by_side(example: np.ndarray, term: np.ndarray, value: np.ndarray, n: int, terms: int) -> np.ndarray:
    """An order of n examples in which similar ones are near: groups by random projections."""
    rng = np.random.Generator(np.random.PCG64(17))
    sketch = np.empty((n, SKETCH))
    for i in range(SKETCH):
        sketch[:, i] = np.bincount(example, value * rng.choice(np.asarray([-1, 1], np.int8), terms)[term], n)
    sketch /= np.maximum(1e-9, np.linalg.norm(sketch, axis=1, keepdims=True))
    centres = sketch[rng.choice(n, min(n, GROUPS), replace=False)]
    for _ in range(10):
        group = (sketch @ centres.T).argmax(1)
        centres = np.stack([sketch[group == k].mean(0) if (group == k).any() else c for k, c in enumerate(centres)])
        centres /= np.maximum(1e-9, np.linalg.norm(centres, axis=1, keepdims=True))
    return np.lexsort((sketch @ rng.normal(size=SKETCH), group))


def indexed(example: np.ndarray, term: np.ndarray, value: np.ndarray, n: int, n_terms: int) -> dict[str, np.ndarray]:
    """The index of n examples' weights of terms, which lie example by example: fields of Model."""
    count = np.bincount(term, minlength=n_terms)
    common = np.flatnonzero(count * DENSE > n)
    dense_row = np.full(n_terms, -1, np.int32)
    dense_row[common] = np.arange(len(common))
    # an example's values side by side
    dense, cut_off = (np.zeros((-(-n // BLOCK_SIZE) * BLOCK_SIZE, len(common)), np.float32).T for _ in range(2))
    row = dense_row[term]
    held = row >= 0
    at = row[held], example[held]
    dense[at] = value[held]
    cut_off[at] = value[held] - dense[at]
    term, example, value = term[~held], example[~held], value[~held]
    order = np.lexsort((example, term))
    term, example, value = term[order], example[order], value[order]
    starts = np.searchsorted(term, np.arange(n_terms + 1))
    bounded = np.flatnonzero(np.diff(starts) > FEW)
    bound_row = np.full(n_terms, -1, np.int32)
    bound_row[bounded] = np.arange(len(bounded))
    n_blocks, row = dense.shape[1] // BLOCK_SIZE, bound_row[term]
    highest = np.zeros((len(bounded), n_blocks), np.float32)
    block = example // BLOCK_SIZE
    np.maximum.at(highest, (row[row >= 0], block[row >= 0]), np.nextafter(value[row >= 0].astype(np.float32), np.float32(2)))
    # term by term and block by block, so the places of all blocks follow each other
    of = np.bincount(row[row >= 0] * n_blocks + block[row >= 0], minlength=len(bounded) * n_blocks).reshape(-1, max(1, n_blocks))
    places = np.concatenate((np.zeros((len(bounded), 1), np.int64), np.cumsum(of, 1)), 1) + starts[bounded][:, None]
    return {
        "starts": starts, "examples": example.astype(np.min_scalar_type(max(n, 1 << 8))), "values": value, "bound_row": bound_row, "highest": highest, "places": places.astype(np.int32), "dense_row": dense_row, "dense": dense, "cut_off": cut_off,
    }


def build(terms: pa.Array | list[str], idf: np.ndarray, rows: list[tuple[int, int, np.ndarray, np.ndarray]], weight: dict[int, float]) -> Model:
    """The index of the examples, and the calibration by leaving each out."""
    vectors = Vectors(terms, idf)
    filled = sorted(((doc, bad, own, vectors.unit(own, n)) for doc, bad, own, n in rows if len(own)), key=lambda x: (x[0], x[1], x[2].tobytes()))
    blank = [(weight[bad] * bad, weight[bad]) for _, bad, own, _ in rows if not len(own)]
    rank = np.zeros(0, np.int64)
    if filled:
        sizes = [len(x[2]) for x in filled]
        rank = side_by_side(np.repeat(np.arange(len(filled), dtype=np.int32), sizes), np.concatenate([x[2] for x in filled]), np.concatenate([x[3] for x in filled]), len(filled), len(terms))
        filled = [filled[i] for i in rank]
    labels, weights = np.asarray([x[1] for x in filled], np.float64), np.asarray([weight[x[1]] for x in filled])
    # without an example that has no word: the share of toxic among all
    share = float(weights @ labels / weights.sum()) if filled else 0.25
    base = np.sum([*blank, (2.0 * share, 2.0)], 0)
    example = np.repeat(np.arange(len(filled), dtype=np.int32), [len(x[2]) for x in filled])
    term = np.concatenate([x[2] for x in filled]).astype(np.int32) if filled else np.zeros(0, np.int64)
    value = np.concatenate([x[3] for x in filled]) if filled else np.zeros(0)
    model = Model(
        pa.array(terms, pa.large_string()) if isinstance(terms, list) else terms, idf, np.asarray([x[0] for x in filled], np.int64), labels, weights, rank,
        base=float(base[0] / base[1]), **indexed(example, term, value, len(filled), len(terms)),
    )
    votes = []
    for at in range(0, len(filled), TOGETHER):
        some = [x[2:] for x in filled[at : at + TOGETHER]]
        votes += [model.vote(*found) for found in model.nearest_of(some, list(range(at, at + len(some))))]
    model.opened = model.passed = 0
    vars(model).pop("pieces", None)  # each worker makes its own
    x = np.asarray([*votes, model.base])
    y = np.asarray([*model.labels, model.base])
    w = np.asarray([*model.weights, float(base[1])])
    model.knots = isotonic(x, y, w)
    return model


EVIDENCE = T.ArrayType(T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("cosine", T.DoubleType()), T.StructField("toxic", T.IntegerType())]))


def score(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """docs with score (0 to 1), predicted (1 from 0.5) and evidence, the nearest examples.

    Texts whose nearest examples are all clean have no evidence of toxicity: theirs is empty,
    though these examples make their score. Null and empty texts and those without any word of
    the examples have no neighbour: they get the share of toxic among examples without a word.
    Ties among neighbours go to the example that the index has first. Repeated rows and other
    columns stay; columns named score, predicted, evidence are replaced.
    """
    new = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("evidence", EVIDENCE)]
    kept = [c for c in docs.columns if c not in {f.name for f in new}]
    inner = docs.select(*[docs[f"`{c}`"] for c in kept], docs[f"`{text}`"].alias("__text"))
    schema = T.StructType([*docs.select(*[f"`{c}`" for c in kept]).schema.fields, *new])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by MAX_EXAMPLES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        vectors = m.vectors
        none = m.calibrated(m.base) if len(m.terms) else 0.0
        for batch in rows_of(batches, "__text"):
            owner, term, n = vectors.counts(texts(batch, "__text"))
            cut = np.searchsorted(owner, np.arange(batch.num_rows + 1)).tolist()
            # equal texts of a slice are looked up once
            keys = [term[a:b].tobytes() + n[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
            place = {key: (a, b) for key, a, b in zip(keys, cut[:-1], cut[1:], strict=True) if a < b}
            known: dict[bytes, tuple[float, list[dict]]] = {b"": (none, [])}
            every = list(place.items())
            for at in range(0, len(every), TOGETHER):
                some = every[at : at + TOGETHER]
                found = m.nearest_of([(term[a:b], vectors.unit(term[a:b], n[a:b])) for _, (a, b) in some])
                for (key, _), (best, cosine) in zip(some, found, strict=True):
                    proof = zip(best, cosine, strict=True) if m.labels[best].any() else ()
                    known[key] = (m.calibrated(m.vote(best, cosine)), [{"doc_id": int(m.ids[i]), "cosine": float(c), "toxic": int(m.labels[i])} for i, c in proof])
            values, every = [known[key][0] for key in keys], [known[key][1] for key in keys]
            columns = [batch.column(i) for i in range(len(kept))]
            arrow = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())]))
            columns += [pa.array(values, pa.float64()), pa.array([int(v >= 0.5) for v in values], pa.int32()), pa.array(every, arrow)]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in schema.fields])

    bounded_batches(docs.sparkSession)
    return inner.mapInArrow(run, schema)
