"""Documents that hold a benchmark item, up to a few edits.

An item of n characters has an error budget of e edits and is cut into e + 1 pieces: whatever
e edits do, one piece stays as it is (pigeonhole). All pieces go into one Aho-Corasick automaton
that runs over each normalised document once; around each hit, Myers' bit-parallel algorithm
gives the smallest edit distance of the whole item to any substring of the window. Items and
documents have a space at either end, so an item that is found begins and ends with words.

A benchmark of more than BLOCK_CHARS characters is handled in blocks one after the other: each
block reads the documents once and writes what it finds, and its automaton goes with its tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import bounded_batches, discard, rows_of, stored, texts

#: Edits allowed for each character of an item.
ERRORS = 0.05
#: Characters of a piece at least; a shorter item has a smaller budget.
MIN_PIECE = 16
#: Characters of normalised items that one pass over the documents holds (a block of items).
BLOCK_CHARS = 4_000_000

_SPACES = re.compile(r"[\W_]+")


def normal(text: str) -> str:
    """Letters and digits in lower case, all else as single spaces."""
    return _SPACES.sub(" ", text.lower()).strip()


def framed(text: str) -> str:
    """A normal form with a space at either end."""
    return f" {text} "


def budget(n: int, errors: float = ERRORS) -> int:
    """Edits allowed for an item of n characters."""
    return max(0, min(int(n * errors), n // MIN_PIECE - 1))


def allowed(item: str, errors: float = ERRORS) -> int:
    """Edits allowed for a framed item: the frame does not count."""
    return budget(len(item) - 2, errors)


def pieces(item: str, errors: float = ERRORS) -> list[tuple[int, str]]:
    """budget + 1 pieces of nearly equal length with their places, end to end."""
    k = allowed(item, errors) + 1
    cuts = [len(item) * i // k for i in range(k + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Pattern:
    """Myers' algorithm for one item: one machine word of any width, one step per character."""

    def __init__(self, item: str):
        self.n = len(item)
        self.masks: dict[str, int] = {}
        for i, c in enumerate(item):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def distance(self, window: str, enough: int) -> tuple[int, int]:
        """Smallest edit distance to a substring of the window, and its end; stops at `enough`."""
        full, top = (1 << self.n) - 1, 1 << (self.n - 1)
        plus, minus, score, best, end = full, 0, self.n, self.n, 0
        for i, c in enumerate(window, 1):
            eq = self.masks.get(c, 0)
            xv = eq | minus
            xh = (((eq & plus) + plus) ^ plus) | eq
            hp = minus | (full & ~(xh | plus))
            hm = plus & xh
            if hp & top:
                score += 1
            elif hm & top:
                score -= 1
            hp, hm = hp << 1 & full, hm << 1 & full
            plus, minus = hm | (full & ~(xv | hp)), hp & xv
            if score < best:
                best, end = score, i
                if best <= enough:
                    break
        return best, end


class Matcher:
    """Finds a block of items in texts."""

    def __init__(self, items: list[tuple[int, str]], errors: float):
        import ahocorasick

        self.items, self.errors = items, errors
        self.patterns = [None] * len(items)
        owners: dict[str, list[tuple[int, int]]] = {}
        for i, (_, item) in enumerate(items):
            for at, piece in pieces(item, errors):
                owners.setdefault(piece, []).append((i, at))
        self.automaton = ahocorasick.Automaton()
        for piece, own in owners.items():
            self.automaton.add_word(piece, (len(piece), own))
        if owners:
            self.automaton.make_automaton()
        self.empty = not owners

    def find(self, text: str) -> dict[int, tuple[int, int]]:
        """item_id -> smallest edit distance, of the items found in a framed text."""
        found: dict[int, int] = {}
        tried: dict[int, list[tuple[int, int]]] = {}
        if self.empty:
            return {}
        for end, (size, own) in self.automaton.iter(text):
            for i, at in own:
                item = self.items[i][1]
                if found.get(i) == 0:
                    continue
                start = end + 1 - size - at  # where the item would begin
                if text.startswith(item, max(0, start)) and start >= 0:
                    found[i] = 0
                    continue
                e = allowed(item, self.errors)
                a, b = max(0, start - e), start + len(item) + e
                if any(x <= a and b <= y for x, y in tried.get(i, ())):
                    continue
                # overlapping hits of one item lie within 2e of each other: widen, try once
                a, b = max(0, a - e), b + e
                tried.setdefault(i, []).append((a, b))
                pattern = self.patterns[i] = self.patterns[i] or Pattern(item)
                distance, _ = pattern.distance(text[a:b], 0)
                if distance <= e and distance < found.get(i, e + 1):
                    found[i] = distance
        return {self.items[i][0]: d for i, d in found.items()}


LEAK = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("distance", T.IntegerType())])


def leaks(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text", errors: float = ERRORS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs with leaks: for each benchmark item found, its id and edit distance, by id.

    An item is found if a substring of the normalised document (lower case, single spaces for
    what is no letter or digit, a space at either end) is within errors * length edits of the
    item in the same form, and at most one edit for each MIN_PIECE characters: an item of fewer
    than 2 * MIN_PIECE characters is found only as it is, as whole words. Null and empty items and those with a null id match nothing;
    equal items are all reported; an id that comes twice is reported once, with its smallest
    distance. Null and empty texts have no leaks; repeated rows and other columns stay; a column
    named leaks is replaced. The benchmark comes to the driver in blocks of `block_chars`
    characters; documents are read once for each block, and written between blocks.
    """
    bounded_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c != "leaks"]
    out = docs.select(*[docs[f"`{c}`"] for c in kept], F.array().cast(T.ArrayType(LEAK)).alias("leaks"))
    rows = benchmark.select(F.col(item).cast("long").alias("id"), F.col(item_text).alias("text")).filter("id is not null and text is not null")
    before = None
    for block in blocks(rows, block_chars):
        if before is not None:
            out = stored(out, "leaks")
            discard(read)
            before.unpersist()
        read = out
        before = docs.sparkSession.sparkContext.broadcast(block)  # bounded by block_chars
        out = with_block(out, text, before, errors)
    return out


def blocks(rows: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The framed items in blocks of block_chars characters; one block is on the driver at a time."""
    held: list[tuple[int, str]] = []
    size = 0
    for r in rows.distinct().orderBy("id", "text").toLocalIterator():
        own = normal(r.text)
        if not own:
            continue
        held.append((r.id, framed(own)))
        size += len(own)
        if size >= block_chars:
            yield held
            held, size = [], 0
    if held:
        yield held


def with_block(docs: DataFrame, text: str, shared: Broadcast, errors: float) -> DataFrame:
    names = docs.columns
    at = names.index("leaks")
    arrow = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shared.value, errors)
        for batch in rows_of(batches, text):
            merged = []
            for value, before in zip(texts(batch, text).to_pylist(), batch.column(at).to_pylist(), strict=True):
                found = matcher.find(framed(normal(value)))
                for x in before:
                    found[x["item_id"]] = min(x["distance"], found.get(x["item_id"], x["distance"]))
                merged.append([{"item_id": i, "distance": d} for i, d in sorted(found.items())])
            columns = [pa.array(merged, arrow) if i == at else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, docs.schema)
