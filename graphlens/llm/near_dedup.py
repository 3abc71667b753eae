"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

Signatures: a first permutation places each shingle in 0..D-1; coordinate k of the signature is
the smallest value that a second permutation, circularly shifted by k, has at those places. The
values that one place contributes to all coordinates are thus one window of the second
permutation. Rows of ROWS coordinates are hashed to BANDS band keys; documents that share a key
are candidates. A pair at the similarity 0.8 shares none with probability (1 - 0.8**6)**48 = 4e-7,
at 0.85 with 1e-10.

Documents with equal shingle sets are one node from the start. Nodes that share band keys are
compared star-wise: every bucket takes a pivot that all its members of other components are
compared with, verified links join components, and buckets within one component are done. Of
what is left, buckets of at most SMALL members compare all of them. The nodes of larger ones
are joined by exact prefixes instead: shingles are ordered by how often they (their hash slots)
occur in these nodes, rarest first, and two sets can reach the similarity only if they share a shingle among the first
of each, as many as their sizes leave room for. Copies of one template that are no near copies
differ in their rare shingles and so do not meet again; what meets are real candidates, again
star-wise, with eight times as many pivots each round. No pair is verified twice, every pair of
a bucket is verified unless it is already connected, and no bucket gathers in a task.

Pairs whose signatures agree in too few coordinates (8 standard deviations below the expectation
at the threshold) are not carried to the exact check; the estimator's variance with circulant
permutations is below that of independent ones. In sets near UNIVERSE shingles coordinates agree
too often, which adds candidates and loses none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import bounded_batches, buffers, coded, discard, forget_shuffles, from_buffers, mix64, rows_of, split, stored, texts

BANDS, ROWS = 48, 6
WIDTH = BANDS * ROWS
#: Size of the universe that the permutations act on.
UNIVERSE = 1 << 20
SEED = 20240917
#: Members up to which a bucket compares all that is left pair by pair.
SMALL = 16
#: Rows of a round that one task handles, and pairs with the sets of both sides.
ROWS_PER_TASK, SETS_PER_TASK = 20_000, 2_000
#: Hash slots in which occurrences of shingles are counted, to tell rare ones.
SLOTS = 1 << 21
#: Rows up to which a side is broadcast, for keys of a few bytes.
BROADCAST_ROWS = 200_000

#: Bytes with A-Z in lower case and ASCII white space as spaces.
PLAIN = np.arange(256, dtype=np.uint8)
PLAIN[65:91] += 32
PLAIN[9:14] = 32

SIGNED = T.StructType([
    T.StructField("doc", T.LongType()), T.StructField("text_key", T.BinaryType()), T.StructField("n_shingles", T.LongType()),
    T.StructField("node", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sig", T.BinaryType()),
])


def text_key(text: str) -> Column:
    return F.unhex(F.md5(text)).alias("text_key")


class Shingler:
    """Distinct word shingles of texts as 64-bit hashes."""

    def __init__(self, size: int):
        self.size = size

    def shingles(self, array: pa.Array) -> list[np.ndarray]:
        """Sorted distinct hashes of each text; a text with fewer words has one, without words none."""
        offsets, data = buffers(array)
        values, offsets = split(from_buffers(offsets, PLAIN[data]), " ")
        codes, distinct = coded(values)
        hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in distinct), np.uint64, len(distinct))
        full = np.fromiter((bool(w) for w in distinct), bool, len(distinct))
        keep = full[codes] if len(codes) else np.zeros(0, bool)
        words = hashes[codes[keep]] if len(codes) else hashes
        places = np.concatenate(([0], np.cumsum(keep)))[offsets]
        grams = np.zeros(len(words), np.uint64)
        with np.errstate(over="ignore"):
            for i in range(self.size):
                grams[: max(0, len(words) - i)] = mix64(grams[: max(0, len(words) - i)] * np.uint64(0x9E3779B97F4A7C15) + words[i:])
        out = []
        for a, b in zip(places[:-1].tolist(), places[1:].tolist(), strict=True):
            if b - a >= self.size:
                out.append(np.unique(grams[a : b - self.size + 1]))
            else:
                short = xxhash.xxh64_intdigest(words[a:b].tobytes(), seed=b - a)
                out.append(np.asarray([short] if b > a else [], np.uint64))
        return out


class Signer:
    def __init__(self) -> None:
        second = np.random.Generator(np.random.PCG64(SEED)).permutation(UNIVERSE).astype(np.uint32)
        self.windows = np.lib.stride_tricks.sliding_window_view(np.concatenate((second, second[:WIDTH])), WIDTH)

    def sign(self, shingles: np.ndarray) -> np.ndarray:
        """The WIDTH minima of a non-empty set."""
        with np.errstate(over="ignore"):
            places = ((shingles * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(44)).astype(np.int64)
        out = np.full(WIDTH, UNIVERSE, np.uint32)
        for i in range(0, len(places), 2048):
            np.minimum(out, self.windows[places[i : i + 2048]].min(0), out=out)
        return out


def signed(docs: DataFrame, doc: str, text: str, size: int) -> DataFrame:
    """One row per document: its set's size and digest, band keys, and a byte of each coordinate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, signer = Shingler(size), Signer()
        order = np.arange(BANDS, dtype=np.uint64)
        for batch in rows_of(batches, "text"):
            sets = shingler.shingles(texts(batch))
            nodes, bands, sigs = [], [], []
            for own in sets:
                if not len(own):
                    nodes.append(None), bands.append(None), sigs.append(None)
                    continue
                sig = signer.sign(own)
                key = order.copy()
                with np.errstate(over="ignore"):
                    for column in sig.reshape(BANDS, ROWS).T:
                        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + column)
                nodes.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                bands.append(key.view(np.int64))
                sigs.append((sig & 0xFF).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), batch.column("text_key"), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.binary()),
                 pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())], [f.name for f in SIGNED.fields],
            )

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(doc).cast("long").alias("doc"), text_key(text), F.col(text).alias("text"))
    return rows.mapInArrow(run, SIGNED)


def sets_of(docs: DataFrame, nodes: DataFrame, text: str, size: int) -> DataFrame:
    """(node, shingles) of nodes (node, text_key), from one text of each."""
    want = nodes.select("node", F.col("text_key"))
    small = want.count() <= BROADCAST_ROWS
    rows = docs.select(text_key(text), F.col(text).alias("text"))
    rows = rows.join(F.broadcast(want) if small else want, "text_key")
    schema = T.StructType([T.StructField("node", T.BinaryType()), T.StructField("shingles", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen = Shingler(size), set()
        for batch in rows_of(batches, "text"):
            fresh = [i for i, n in enumerate(batch.column("node").to_pylist()) if n not in seen and not seen.add(n)]
            own = batch.take(pa.array(fresh, pa.int64()))
            data = [s.tobytes() for s in shingler.shingles(texts(own))]
            yield pa.RecordBatch.from_arrays([own.column("node"), pa.array(data, pa.binary())], ["node", "shingles"])

    made = rows.select("node", "text").mapInArrow(run, schema)
    return made.groupBy("node").agg(F.first("shingles").alias("shingles"))


def likely(pairs: DataFrame, info: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes allow the similarity and whose signatures make it possible."""
    p = percent / 100
    least = int(WIDTH * p - 8 * (WIDTH * p * (1 - p)) ** 0.5)
    side = lambda x: info.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("sig").alias(f"s{x}"))
    near = pairs.join(side("a"), "a").join(side("b"), "b").filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, WIDTH) for c in ("sa", "sb"))
            mask = pa.array((a == b).sum(1) >= least)
            yield batch.select(["a", "b"]).filter(mask)

    return near.select("a", "b", "sa", "sb").mapInArrow(run, pairs.select("a", "b").schema)


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets have at least the similarity."""
    full = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("xa")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("xb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("xa"), batch.column("xb"), strict=True):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate((a, b))
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= percent * (len(a) + len(b) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return full.select("a", "b", "xa", "xb").mapInArrow(run, pairs.select("a", "b").schema)


def joined(labels: DataFrame, links: DataFrame, parts: int) -> DataFrame:
    """labels (node, label) after joining the components that the links (a, b) connect.

    The graph of components is contracted until no link is left: each component moves to its
    smallest neighbour's smallest neighbour, and links follow. A star takes two steps, a chain
    of n components about log n.
    """
    at = lambda x, to: labels.select(F.col("node").alias(x), F.col("label").alias(to))
    both = lambda e: e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    edges = links.join(at("a", "u"), "a").join(at("b", "v"), "b").filter("u != v").select("u", "v")
    edges = stored(both(edges), "near-edges", parts)
    old = []
    while not edges.isEmpty():
        low = edges.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("to"))
        step = low.join(low.select(F.col("u").alias("to"), F.col("to").alias("far")), "to").select("u", F.least("to", "far").alias("to"))
        step = stored(step, "near-steps", parts)
        labels = labels.join(step.select(F.col("u").alias("label"), "to"), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
        start, end = (step.select(F.col("u").alias(x), F.col("to").alias(f"{x}2")) for x in ("u", "v"))
        old += [edges, step]
        edges = edges.join(start, "u").join(end, "v").filter("u2 != v2").select(F.col("u2").alias("u"), F.col("v2").alias("v"))
        edges = stored(edges.distinct(), "near-edges", parts)
    if old:
        labels = stored(labels, "near-labels", parts)
    discard(edges, *old)
    return labels


def tasks(rows: int, each: int = ROWS_PER_TASK) -> int:
    return 4 + rows // each


def rarity(sets: DataFrame) -> np.ndarray:
    """How often the shingles of each of SLOTS hash slots occur in the sets."""
    slots = T.StructType([T.StructField("slot", T.IntegerType()), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for x in batch.column("shingles"):
                total[np.frombuffer(x.as_buffer(), np.uint64) & np.uint64(SLOTS - 1)] += 1
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen])], ["slot", "n"])

    found = sets.mapInArrow(run, slots).groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # SLOTS rows at most
    out = np.zeros(SLOTS, np.int64)
    out[np.asarray(found.column("slot"))] = np.asarray(found.column("n"))
    return out


def prefixes(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(key, node, n, reach): the shingles by which nodes (node, n) can meet a near copy among them.

    Any order of the shingles will do, and the rarest first leaves the fewest pairs. reach is the
    size of the largest partner that the shingle can be needed for: o shared of n and m shingles
    are similar enough if (100 + percent) * o >= percent * (n + m), and then the first shared one
    has at least o - 1 behind it in either order.
    """
    own = sets.join(nodes, "node").select("node", "n", "shingles")
    shared = sets.sparkSession.sparkContext.broadcast(rarity(own))  # SLOTS numbers
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("node", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("reach", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in batches:
            owner, keys, reaches = [], [], []
            for i, x in enumerate(batch.column("shingles")):
                found = np.frombuffer(x.as_buffer(), np.uint64)
                often = counts[found & np.uint64(SLOTS - 1)]
                n, place = len(found), np.arange(len(found))
                order = np.lexsort((found, often))
                reach = (n - place) * (100 + percent) // percent - n
                # a shingle that no other node has meets nothing
                kept = (100 * reach >= percent * n) & (often[order] > 1)
                owner.append(np.full(int(kept.sum()), i)), keys.append(found[order[kept]].view(np.int64)), reaches.append(reach[kept])
            rows = pa.array(np.concatenate([np.zeros(0, np.int64), *owner]))
            every = (pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in (keys, reaches))
            yield pa.RecordBatch.from_arrays([next(every), batch.column("node").take(rows), batch.column("n").take(rows), next(every)], ["key", "node", "n", "reach"])

    return stored(own.mapInArrow(run, schema), "near-prefixes")


class Components:
    """Components of the nodes that share a band with another, joined round by round."""

    def __init__(self, docs: DataFrame, info: DataFrame, text: str, size: int, percent: int):
        self.docs, self.text, self.size, self.percent = docs, text, size, percent
        banded = info.select("node", F.col("n_shingles").alias("n"), F.floor(F.col("n_shingles") * 100 / percent).alias("reach"), F.explode("bands").alias("key"))
        full = banded.groupBy("key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1").select("key")
        self.members = stored(banded.join(full, "key").select("key", "node", "n", "reach"), "near-members")
        nodes = self.members.select("node").distinct()
        self.inner = stored(info.join(nodes, "node", "left_semi").select("node", "n_shingles", "sig", "text_key"), "near-nodes")
        self.labels = self.inner.select("node", F.col("node").alias("label"))
        self.verified: list[DataFrame] = []
        self._sets: DataFrame | None = None

    @property
    def sets(self) -> DataFrame:
        if self._sets is None:
            self._sets = stored(sets_of(self.docs, self.inner, self.text, self.size), "near-sets")
        return self._sets

    def opened(self, members: DataFrame) -> tuple[DataFrame, int]:
        """members with label and left, of the buckets that hold several components; and their number."""
        placed = members.join(self.labels, "node")
        keys = placed.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("left")).filter("lo != hi").select("key", "left")
        out = stored(placed.join(keys, "key"), "near-open")
        return out, out.count()

    def pairs(self, ours: DataFrame, theirs: DataFrame, once: bool) -> DataFrame:
        """(a, b) of rows with one key, in different components, that their sizes allow."""
        side = lambda x, i: x.select("key", *(F.col(c).alias(f"{c}{i}") for c in ("node", "n", "reach", "label")))
        both = side(ours, 1).join(side(theirs, 2), "key").filter("label1 != label2 and n1 <= reach2 and n2 <= reach1")
        both = both.filter("node1 < node2") if once else both
        return both.select(F.least("node1", "node2").alias("a"), F.greatest("node1", "node2").alias("b"))

    def verify(self, pairs: DataFrame, rows: int) -> None:
        """Join the components of the pairs (about so many rows) that are near copies."""
        pairs = pairs.distinct()
        for known in self.verified:
            pairs = pairs.join(known, ["a", "b"], "left_anti")
        pairs = stored(pairs, "near-pairs", tasks(rows))
        parts = tasks(pairs.count())
        near = stored(likely(pairs, self.inner, self.percent), "near-likely", parts)
        n = near.count()
        if n:
            links = stored(linked(near, self.sets, self.percent), "near-links", tasks(n, SETS_PER_TASK))
            before, self.labels = self.labels, joined(self.labels, links, tasks(n))
            discard(links, *([before] if before is not self.labels else []))
        discard(near)
        self.verified.append(pairs)
        forget_shuffles(self.docs.sparkSession)

    def stars(self, placed: DataFrame, pivots: int) -> tuple[DataFrame, DataFrame]:
        """Pairs of each bucket's pivots with its members, and the pivots."""
        # by one order for all buckets, so that buckets of one group mostly choose the same
        slot = F.pmod(F.xxhash64("node", F.lit(pivots)), F.lit(pivots)) if pivots > 1 else F.lit(0)
        row = F.struct("node", "n", "reach", "label")
        chosen = placed.groupBy("key", slot.alias("slot")).agg(F.min_by(row, F.xxhash64("node")).alias("p")).select("key", "p.*")
        chosen = stored(chosen, "near-pivots")
        return self.pairs(placed, chosen, False), chosen

    def close(self) -> None:
        discard(self.inner, *self.verified, *([self._sets] if self._sets is not None else []))

    def run(self) -> DataFrame:
        """(node, label); label: the component's smallest node."""
        members = self.members
        placed, left = self.opened(members)
        if not left:
            return self.labels
        star, chosen = self.stars(placed, 1)
        self.verify(star, left)
        members = placed.join(chosen.select("key", "node"), ["key", "node"], "left_anti").select(*members.columns)
        rest, left = self.opened(members)
        discard(placed, chosen, self.members)
        if not left:
            return self.labels
        small = rest.filter(F.col("left") <= SMALL)
        self.verify(self.pairs(small, small, True), left * SMALL // 4)
        large = rest.filter(F.col("left") > SMALL).select("node", "n").distinct()
        if large.isEmpty():
            return self.labels
        members, pivots = prefixes(large, self.sets, self.percent), 1
        discard(rest)
        while True:
            placed, left = self.opened(members)
            if not left:
                return self.labels
            # a pivot meets its whole bucket, a small bucket meets itself
            small, large = (placed.filter(x) for x in (F.col("left") <= SMALL, F.col("left") > SMALL))
            star, chosen = self.stars(large, pivots)
            self.verify(self.pairs(small, small, True).union(star), left * max(pivots, SMALL // 4))
            old, members = members, stored(large.join(chosen.select("key", "node"), ["key", "node"], "left_anti").select("key", "node", "n", "reach"), "near-members")
            discard(placed, chosen, old)
            pivots *= 8


def near_duplicates(docs: DataFrame, *, doc: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs: doc, n_shingles, component_id, kept.

    Words are runs of characters other than ASCII white space, A-Z in lower case; documents are
    linked if 100 * intersection >= percent * union of their distinct shingles of `shingle` words
    (fewer words: the whole sequence is the one shingle). component_id is the smallest id that
    links reach, its own included; kept is doc = component_id. A null or empty text has no
    shingle, and is its own component. Rows with a null id count as documents: they get their
    component's smallest id (null if it has none) and are kept only if there is none. Repeated
    rows stay and share a component; an empty table gives an empty result; other columns are not
    read. `doc` must be an integer column.
    """
    rows = stored(signed(docs, doc, text, shingle), "near-signed")
    info = rows.filter("node is not null").groupBy("node").agg(
        F.min("doc").alias("id"), F.min("text_key").alias("text_key"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("sig").alias("sig")
    )
    info = stored(info, "near-info")
    # bands and signatures of all documents go before those of the nodes are spread by their keys
    thin = stored(rows.select("doc", "n_shingles", "node"), "near-docs")
    discard(rows)
    forget_shuffles(docs.sparkSession)
    work = Components(docs, info, text, shingle, percent)
    ids = stored(info.select("node", "id"), "near-ids")
    discard(info)
    forget_shuffles(docs.sparkSession)
    placed = ids.join(work.run(), "node", "left").withColumn("label", F.coalesce("label", "node"))
    placed = stored(placed, "near-placed")
    work.close()
    smallest = placed.groupBy("label").agg(F.min("id").alias("component_id"))
    final = stored(placed.join(smallest, "label").select("node", "component_id"), "near-components")
    discard(ids, placed)
    out = thin.join(final, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc")).otherwise(F.col("component_id"))
    return out.select(F.col("doc").alias(doc), "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col(doc) == F.col("component_id"), F.col("component_id").isNull())
    )
