"""Approximate nearest neighbours by multi-index hashing.

A rotation learned on a bounded sample (principal axes, then iterative quantisation) turns each
vector into a binary code. Codes are cut into SUBSTRINGS parts and each part is an index of its
own: a code within Hamming radius r of a query agrees with it in some part up to
floor(r / SUBSTRINGS) bits (pigeonhole), so probing these part values finds every code within r.
What is found is ranked by exact distance between the original vectors.

The radius is learned on the sample as the one that holds RECALL of true neighbours; nearer
neighbours of the whole table lie in it all the more. Queries for which fewer than k rows lie in
the radius are asked again with a wider one, until they have k or all candidates. Rows and
queries meet in blocks: a row goes to one block of rows for each block of queries and the other
way round, and each cell keeps the nearest found of each query.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import stored

#: Vectors that rotation and radius are learned from, about, and queries among them.
SAMPLE, SAMPLE_QUERIES = 4_000, 200
#: Parts of a code.
SUBSTRINGS = 8
#: Bits of a code at most; a multiple of SUBSTRINGS. Vectors of fewer dimensions have fewer bits.
BITS = 64
#: Share of the sample's true neighbours that the radius holds.
RECALL = 0.97
ITERATIONS = 30
#: Rows and queries of a cell, about.
ROW_BLOCK, QUERY_BLOCK = 20_000, 2_000
SEED = 7
#: Bits by which the radius is widened for queries that have found too few.
WIDEN = 2 * SUBSTRINGS


@dataclass
class Rotation:
    mean: np.ndarray
    axes: np.ndarray  # dimensions x bits
    radius: int

    @property
    def bits(self) -> int:
        return self.axes.shape[1]

    def codes(self, x: np.ndarray) -> np.ndarray:
        """Bits of each vector, grouped into parts: rows x SUBSTRINGS, each part an integer."""
        bits = ((x - self.mean) @ self.axes > 0).reshape(len(x), SUBSTRINGS, -1)
        return bits @ (1 << np.arange(bits.shape[2]))


def fit_rotation(x: np.ndarray, k: int, seed: int = SEED) -> Rotation:
    """Learn axes and radius from sample vectors (rows)."""
    rng = np.random.Generator(np.random.PCG64(seed))
    mean = x.mean(0)
    centred = x - mean
    bits = max(SUBSTRINGS, min(BITS, x.shape[1] // SUBSTRINGS * SUBSTRINGS))
    _, _, right = np.linalg.svd(centred, full_matrices=False)
    axes = right[:bits].T
    if axes.shape[1] < bits:  # few dimensions or few vectors: more directions than axes
        axes = np.concatenate((axes, rng.normal(size=(x.shape[1], bits - axes.shape[1]))), 1)
    low = centred @ axes
    turn, _ = np.linalg.qr(rng.normal(size=(bits, bits)))
    for _ in range(ITERATIONS):
        u, _, vt = np.linalg.svd(np.where(low @ turn > 0, 1.0, -1.0).T @ low)
        turn = (u @ vt).T
    model = Rotation(mean, axes @ turn, bits)
    code = ((x - mean) @ model.axes > 0).astype(np.float32)
    asked = np.arange(0, len(x), max(1, len(x) // SAMPLE_QUERIES))
    far: list[int] = []
    for i in asked.tolist():
        d = ((x - x[i]) ** 2).sum(1)
        d[i] = np.inf
        near = np.argsort(d, kind="stable")[: min(k, len(x) - 1)]
        far += np.abs(code[near] - code[i]).sum(1).astype(int).tolist()
    model.radius = int(np.quantile(far, RECALL, method="higher")) if far else bits
    return model


class Parts:
    """The index of one block: for each part, rows sorted by the part's value."""

    def __init__(self, model: Rotation, x: np.ndarray, radius: int | None = None):
        self.model, self.x = model, x
        self.radius = model.radius if radius is None else radius
        self.codes = model.codes(x)
        self.width = model.bits // SUBSTRINGS
        self.order = [np.argsort(self.codes[:, p], kind="stable") for p in range(SUBSTRINGS)]
        self.starts = [np.searchsorted(self.codes[o, p], np.arange((1 << self.width) + 1)) for p, o in enumerate(self.order)]
        each = self.radius // SUBSTRINGS
        flips = [sum(1 << b for b in c) for n in range(min(each, self.width) + 1) for c in combinations(range(self.width), n)]
        self.flips = np.asarray(flips, np.int64)
        self.popcount = np.asarray([bin(i).count("1") for i in range(1 << self.width)], np.uint8)

    def within(self, code: np.ndarray) -> np.ndarray:
        """Rows whose code lies within the radius, by probing every part."""
        hit = np.zeros(len(self.x), bool)
        for p in range(SUBSTRINGS):
            probe = code[p] ^ self.flips
            order, starts = self.order[p], self.starts[p]
            for a, b in zip(starts[probe].tolist(), starts[probe + 1].tolist(), strict=True):
                if a < b:
                    hit[order[a:b]] = True
        found = np.flatnonzero(hit)
        self.probed = len(found)  # of the last query
        return found[self.popcount[self.codes[found] ^ code].sum(1) <= self.radius]


FOUND = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])


def sound(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(id, v) of the rows that take part: an id and a vector that is not null, zero or unsound."""
    v = F.col("v")
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    good = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.filter(F.col("id").isNotNull() & v.isNotNull() & good)


def nearest(vectors: DataFrame, queries: DataFrame, *, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k nearest rows of vectors found for each row of queries: query_id, rank, vec_id, score.

    score is the Euclidean distance in double precision, smallest first, ties to the smaller
    vec_id; a row with the query's id is no candidate. Every query gets k rows, or all candidates
    if they are fewer. Rows with a null id, and vectors that are
    null, zero or hold a null or non-finite component take no part; neither do vectors of
    another length than most have. Rows of equal id and vector count once; of a repeated id, the
    nearest vector. Empty tables give an empty result; other columns are not read.
    """
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], T.StructType([T.StructField("query_id", T.LongType()), T.StructField("rank", T.IntegerType()), *FOUND.fields[1:]]))
    rows, asked = sound(vectors, vec_id, vector), sound(queries, vec_id, vector)
    lengths = rows.groupBy(F.size("v").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "size").first()
    if lengths is None:
        return empty
    rows, asked = (x.filter(F.size("v") == lengths.size) for x in (rows, asked))
    n, m = lengths.n, asked.count()
    share = F.lit(int(min(1.0, SAMPLE / n) * (1 << 30)))
    sample = rows.filter(F.pmod(F.xxhash64(F.lit(SEED), "id"), F.lit(1 << 30)) < share).dropDuplicates(["v"]).orderBy("id").limit(2 * SAMPLE).collect()
    if len(sample) < 2:
        sample = rows.orderBy("id").limit(100).collect()
    model = spark.sparkContext.broadcast(fit_rotation(np.asarray([r.v for r in sample], np.float64), k))
    across = -(-n // ROW_BLOCK)
    block = lambda n: F.pmod(F.xxhash64(F.lit(SEED + 1), "id", "v"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    distinct = rows.distinct()

    def search(here: pa.Table, ask: pa.Table, radius: int) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        matrix = lambda t: np.asarray(t.column("v").combine_chunks().flatten(), np.float64).reshape(t.num_rows, -1)
        if here.num_rows and ask.num_rows:
            ids, x = np.asarray(here.column("id")), matrix(here)
            index = Parts(model.value, x, radius)
            wanted = matrix(ask)
            for query, own, code in zip(np.asarray(ask.column("id")).tolist(), wanted, model.value.codes(wanted), strict=True):
                found = index.within(code)
                found = found[ids[found] != query]
                distance = np.sqrt(((x[found] - own) ** 2).sum(1))
                own_ids = ids[found]
                if len(found) > 4 * k:  # before the full sort, what can be among the first
                    near = distance <= np.partition(distance, 4 * k - 1)[4 * k - 1]
                    if len(np.unique(own_ids[near])) >= k:
                        own_ids, distance = own_ids[near], distance[near]
                order = np.lexsort((own_ids, distance))
                # a repeated id counts once, by its nearest vector
                _, first = np.unique(own_ids[order], return_index=True)
                order = order[np.sort(first)][:k]
                out.append((np.full(len(order), query), own_ids[order], distance[order]))
        join = lambda i, t: np.concatenate([np.zeros(0, t), *(o[i] for o in out)])
        return pa.table({"query_id": pa.array(join(0, np.int64), pa.int64()), "vec_id": pa.array(join(1, np.int64), pa.int64()), "score": pa.array(join(2, np.float64), pa.float64())})

    def ask(asked: DataFrame, m: int, radius: int) -> DataFrame:
        down = max(1, -(-m // QUERY_BLOCK))
        cells = distinct.select(block(across).alias("i"), every(down).alias("j"), "id", "v")
        wanted = asked.select(every(across).alias("i"), block(down).alias("j"), "id", "v")
        found = wanted.groupBy("i", "j").cogroup(cells.groupBy("i", "j")).applyInArrow(lambda ask, here: search(here, ask, radius), FOUND)
        # k rows of each query and block of rows at most
        found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
        order = Window.partitionBy("query_id").orderBy("score", "vec_id")
        return found.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)

    asked = asked.distinct()
    candidates = rows.select("id").distinct().count()
    done, radius = [], model.value.radius
    while True:
        got = stored(ask(asked, m, radius), "nearest")
        if radius >= model.value.bits:
            return unions([*done, got])
        full = got.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min(k, candidates)).select(F.col("query_id").alias("id"))
        asked = stored(asked.join(full, "id", "left_anti"), "open-queries")
        m = asked.count()
        if not m:
            return unions([*done, got])
        done.append(got.join(full.withColumnRenamed("id", "query_id"), "query_id", "left_semi"))
        radius = min(model.value.bits, radius + WIDEN)


def unions(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def exact(rows: Iterator[tuple[int, np.ndarray]], query: np.ndarray, own: int, k: int) -> list[tuple[int, float]]:
    """Brute force over (id, vector), to measure recall against."""
    return sorted(((i, float(np.sqrt(((v - query) ** 2).sum()))) for i, v in rows if i != own), key=lambda x: (x[1], x[0]))[:k]
