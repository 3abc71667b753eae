"""SentencePiece encoding with source offsets, and decoding.

A text is first normalised by longest-prefix match against the model's compiled character map
(a double-array trie followed by its replacement strings), with the source byte of every
normalised byte recorded. The normalised text is segmented by the library's engine with its own
normaliser turned off, and every piece is projected through the recorded alignment to a span of
source bytes.

Segmentation works on chunks: no piece of the vocabulary reaches across a change from another
character to the space symbol, so each run of space symbols with what follows is segmented by
itself and remembered. Models in which a piece does reach across are segmented text by text.
"""

from __future__ import annotations

import hashlib
import re
import struct
from array import array as numbers
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .shared import bounded_batches, buffers, coded, gather, rows_of, split, sums, texts

#: Chunks that a Python worker remembers before it starts anew.
CHUNKS_KEPT = 150_000
SPACE = "▁"


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a serialised protocol buffer."""
    at, end = 0, len(data)

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < end:
        key = varint()
        number, kind = key >> 3, key & 7
        if kind == 0:
            yield number, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield number, data[at : at + size]
            at += size


@dataclass
class Piece:
    text: str
    #: 1 normal, 2 unknown, 3 control, 4 user-defined, 5 unused, 6 byte
    kind: int


class CharacterMap:
    """Longest-prefix lookup in a compiled character map."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if size else []
        self.strings = blob[4 + size :]
        #: First bytes at which some key starts; at others nothing can match.
        self.starts = bytes(b for b in range(256) if self.units and self._step(self._base(0), b) is not None)

    def _base(self, position: int) -> int:
        unit = self.units[position]
        return position ^ ((unit >> 10) << ((unit & (1 << 9)) >> 6))

    def _step(self, base: int, byte: int) -> int | None:
        at = base ^ byte
        if at >= len(self.units) or (self.units[at] & 0x800000FF) != byte:
            return None
        return at

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Bytes matched at this place and what replaces them."""
        if not self.units:
            return None
        found, base, i = None, self._base(0), at
        while i < len(data):
            position = self._step(base, data[i])
            if position is None:
                break
            i += 1
            base = self._base(position)
            if self.units[position] & 0x100:
                found = (i - at, self.units[base] & 0x7FFFFFFF)
        if found is None:
            return None
        return found[0], self.strings[found[1] : self.strings.index(b"\0", found[1])]


class Model:
    """What the codec needs of a model file: pieces, the character map, and the flags."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            self.blob = file.read()
        self.pieces: list[Piece] = []
        blob, self.dummy, self.squeeze, self.escape = b"", True, True, True
        for number, value in fields(self.blob):
            if number == 1:
                own = dict(fields(value))
                self.pieces.append(Piece(own[1].decode(), own.get(3, 1)))
            elif number == 3:
                for inner, flag in fields(value):
                    if inner == 2:
                        blob = flag
                    elif inner in (3, 4, 5):
                        setattr(self, {3: "dummy", 4: "squeeze", 5: "escape"}[inner], bool(flag))
        self.map = CharacterMap(blob)
        self.user = sorted((p.text.encode() for p in self.pieces if p.kind == 4), key=len, reverse=True)
        #: Byte pieces leave no unknown characters, which the library would join across chunks.
        bytes_known = any(p.kind == 6 for p in self.pieces)
        spelled = [p.text for p in self.pieces if p.kind in (1, 4, 5)]
        self.chunked = bytes_known and not self.user and not any(re.search(f"[^{SPACE}]{SPACE}", t) for t in spelled)
        self.lines_apart = self.chunked and not any("\n" in t for t in spelled)

    def bare(self) -> bytes:
        """The same model with a normaliser that changes nothing: later fields win."""
        spec = b"\x0a\x08identity" + b"\x12\x00" + b"\x18\x00\x20\x00\x28\x00"
        return self.blob + b"\x1a" + bytes([len(spec)]) + spec


class Normalizer:
    def __init__(self, model: Model):
        self.model = model
        #: Nothing but spaces changes: the alignment follows from their places.
        self.plain = not model.map.units and not model.user and model.escape and model.dummy and not model.squeeze

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text and, for each of its bytes and its end, the source byte it came from."""
        m, data = self.model, text.encode("utf-8", "replace")
        units: list[tuple[bytes, int, int]] = []  # replacement, start, end
        at = 0
        while at < len(data):
            user = next((u for u in m.user if data.startswith(u, at)), None)
            if user is not None:
                units.append((user, at, at + len(user)))
            elif (hit := m.map.longest(data, at)) is not None:
                units.append((hit[1], at, at + hit[0]))
            else:
                lead = data[at]
                n = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                units.append((data[at : at + n], at, at + n))
            at = units[-1][2]
        symbol = SPACE.encode() if m.escape else b" "
        if m.squeeze:
            while units and not units[0][0].strip(b" "):
                units.pop(0)
        out, source = bytearray(), []
        if units and m.dummy:
            out += symbol
            source += [units[0][1]] * len(symbol)
        spaced = m.squeeze
        for replaced, start, _ in units:
            if m.squeeze and spaced:
                replaced = replaced.lstrip(b" ")
            if not replaced:
                continue
            spaced = replaced.endswith(b" ")
            replaced = replaced.replace(b" ", symbol)
            out += replaced
            source += [start] * len(replaced)
        end = units[-1][2] if units else len(data)
        if m.squeeze:
            while out.endswith(symbol):
                end = source[-len(symbol)]
                del out[-len(symbol) :], source[-len(symbol) :]
        source.append(end)
        return out.decode("utf-8", "replace"), np.asarray(source, np.int64)


class Codec:
    """Encoder and decoder of one worker, with its memory of chunks."""

    def __init__(self, path: str):
        import sentencepiece

        self.path, self.model = path, Model(path)
        self.normalizer = Normalizer(self.model)
        self.engine = sentencepiece.SentencePieceProcessor(model_proto=self.model.bare())
        surfaces, sizes = [], []
        for p in self.model.pieces:
            raw = bytes([int(p.text[3:5], 16)]) if p.kind == 6 else p.text.encode()
            sizes.append(len(raw))
            surfaces.append(b"" if p.kind == 3 else b" \xe2\x81\x87 " if p.kind == 2 else raw.replace(SPACE.encode(), b" "))
        self.sizes = np.asarray(sizes, np.int64)
        self.surface_sizes = np.asarray([len(s) for s in surfaces], np.int64)
        self.surface_starts = np.concatenate(([0], np.cumsum(self.surface_sizes)[:-1]))
        self.surface_bytes = np.frombuffer(b"".join(surfaces), np.uint8)
        digits = [b"%d," % i for i in range(len(surfaces))]
        self.digit_sizes = np.asarray([len(d) for d in digits], np.int64)
        self.digit_starts = np.concatenate(([0], np.cumsum(self.digit_sizes)[:-1]))
        self.digit_bytes = np.frombuffer(b"".join(digits), np.uint8)
        #: The decoder drops the space that the encoder has put in front.
        self.strips = self.model.dummy or self.model.squeeze
        self.forget()

    @cached_property
    def library(self):
        """The library with the model as it is: only for texts that do not decode piece by piece."""
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=self.path)

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.starts, self.lengths = numbers("i"), numbers("q"), numbers("q")

    def learn(self, chunks: list[str]) -> None:
        missing = [c for c in dict.fromkeys(chunks) if c not in self.known]
        for chunk, ids in zip(missing, self.engine.encode(missing, num_threads=1), strict=True):
            self.known[chunk] = len(self.starts)
            self.starts.append(len(self.ids))
            self.lengths.append(len(ids))
            self.ids.extend(ids)

    def chunks(self, array: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
        """Codes of the chunks, the distinct chunks, and where each row's chunks are."""
        normalised = pc.replace_substring(array, " ", "\0" + SPACE)
        if self.model.lines_apart:
            normalised = pc.replace_substring(normalised, "\n", "\0\n\0")
        filled = pc.greater(pc.binary_length(array), 0)
        big = lambda x: pa.scalar(x, pa.large_string())
        normalised = pc.if_else(filled, pc.binary_join_element_wise(big(SPACE), normalised, big("")), big(""))
        values, offsets = split(normalised, "\0")
        codes, distinct = coded(values)
        odd = pc.or_(pc.match_substring_regex(array, f"^ |  |{SPACE}"), pc.match_substring(array, "\0"))
        rows = np.flatnonzero(np.asarray(odd))
        if len(rows):
            place = {c: i for i, c in enumerate(distinct)}
            pattern = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+" if self.model.lines_apart else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
            parts, last = [], 0
            counts = np.diff(offsets)
            for row in rows:
                own = pattern.findall(SPACE + array[int(row)].as_py().replace(" ", SPACE))
                parts += [codes[offsets[last] : offsets[row]], np.asarray([place.setdefault(c, len(place)) for c in own], codes.dtype)]
                counts[row], last = len(own), row + 1
            codes = np.concatenate([*parts, codes[offsets[last] :]])
            offsets, distinct = np.concatenate(([0], np.cumsum(counts))), list(place)
        return codes, distinct, offsets

    def encode(self, array: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all rows, each id's source span (start, end) in bytes, and each row's offsets."""
        if self.model.chunked and self.normalizer.plain:
            if len(self.known) > CHUNKS_KEPT:
                self.forget()
            codes, distinct, offsets = self.chunks(array)
            self.learn(distinct)
            at = np.fromiter((self.known[c] for c in distinct), np.int64, len(distinct))
            # copies, so that the arrays can grow again
            lengths, starts = (np.array(x, np.int64)[at][codes] if len(codes) else np.zeros(0, np.int64) for x in (self.lengths, self.starts))
            ids = np.array(self.ids, np.int32)[gather(starts, lengths)].astype(np.int64)
            offsets = np.concatenate(([0], np.cumsum(sums(lengths, offsets))))
            return ids, *self.plain_spans(array, ids, offsets), offsets
        every, begins, ends, counts = [], [], [], []
        for text in array.to_pylist():
            normalised, source = self.normalizer.normalise(text)
            ids = np.asarray(self.engine.encode(normalised), np.int64)
            places = self.piece_ends(normalised, ids)
            every.append(ids)
            begins.append(source[np.concatenate(([0], places[:-1])).astype(np.int64)] if len(ids) else ids)
            ends.append(source[places] if len(ids) else ids)
            counts.append(len(ids))
        join = lambda parts: np.concatenate([np.zeros(0, np.int64), *parts])
        return join(every), join(begins), join(ends), np.concatenate(([0], np.cumsum(counts))).astype(np.int64)

    def piece_ends(self, normalised: str, ids: np.ndarray) -> np.ndarray:
        """End of each piece in the normalised bytes; an unknown piece has the length of its text."""
        if all(self.model.pieces[i].kind != 2 for i in set(ids.tolist())):
            return np.cumsum(self.sizes[ids])
        sizes = [len(piece.encode()) for piece in self.engine.encode(normalised, out_type=str)]
        return np.cumsum(np.asarray(sizes, np.int64))

    def plain_spans(self, array: pa.Array, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Spans where normalisation only writes three bytes for a space and puts one in front."""
        n = len(array)
        bounds, source = buffers(array)
        row_sizes = np.diff(bounds)
        spaces = np.flatnonzero(source == 32)
        before = np.searchsorted(spaces, bounds)  # spaces before each row
        filled = (row_sizes > 0).astype(np.int64)
        # all rows end to end, each with its symbol in front: where rows and spaces lie
        front = np.cumsum(filled) - filled
        row_at = bounds[:-1] + 2 * before[:-1] + 3 * front
        space_row = np.repeat(np.arange(n), np.diff(before))
        space_at = spaces + 2 * np.arange(len(spaces)) + 3 * (front + filled)[space_row]
        ends = np.cumsum(self.sizes[ids])
        row = np.repeat(np.arange(n), np.diff(offsets))
        starts = ends - self.sizes[ids]

        def project(places: np.ndarray) -> np.ndarray:
            rank = np.searchsorted(space_at, places)  # spaces wholly before
            gone = places - row_at[row] - 3 - 2 * (rank - before[row])
            return np.clip(gone, 0, row_sizes[row])

        return project(starts), project(ends)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The text of each row of ids, as the library's decode(ids) gives it."""
        sizes = self.surface_sizes[ids]
        data = self.surface_bytes[gather(self.surface_starts[ids], sizes)].tobytes()
        at = np.concatenate(([0], np.cumsum(sums(sizes, offsets)))).tolist()
        out = []
        for i in range(len(offsets) - 1):
            raw = data[at[i] : at[i + 1]]
            try:
                text = raw.decode()
                out.append(text[1:] if self.strips and not self.model.squeeze and text.startswith(" ") and self.first_spaced(ids, offsets, i) else text)
                if self.model.squeeze and text.startswith(" "):
                    raise ValueError
            except ValueError:  # bytes that are no text, or white space that the library squeezes
                out[i:] = [self.library.decode(ids[offsets[i] : offsets[i + 1]].tolist())]
        return out

    def first_spaced(self, ids: np.ndarray, offsets: np.ndarray, row: int) -> bool:
        """Whether the first piece that has text is spelled with the space symbol."""
        for i in ids[offsets[row] : offsets[row + 1]]:
            if self.model.pieces[i].kind != 3:
                return self.model.pieces[i].text.startswith(SPACE)
        return False

    def decimals(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """Each row's ids in decimal, joined by commas."""
        sizes = self.digit_sizes[ids]
        data = self.digit_bytes[gather(self.digit_starts[ids], sizes)].tobytes()
        at = np.concatenate(([0], np.cumsum(sums(sizes, offsets)))).tolist()
        return [data[at[i] : max(at[i], at[i + 1] - 1)] for i in range(len(offsets) - 1)]


@lru_cache(maxsize=1)
def codec_of(path: str) -> Codec:
    """One codec for all tasks of a worker: the library does not give back all that a load takes."""
    return Codec(path)


ENCODED = [
    T.StructField("ids", T.ArrayType(T.IntegerType())),
    T.StructField("starts", T.ArrayType(T.IntegerType())),
    T.StructField("ends", T.ArrayType(T.IntegerType())),
]


def added(docs: DataFrame, text: str, new: list[T.StructField], make) -> DataFrame:
    """docs with new columns from make(texts) -> arrays, in place of columns of these names."""
    names = {f.name for f in new}
    kept = [c for c in docs.columns if c not in names]
    inner = docs.select(*[docs[f"`{c}`"] for c in kept], docs[f"`{text}`"].alias("__text"))
    schema = T.StructType([f for f in docs.select(*[f"`{c}`" for c in kept]).schema.fields] + new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in rows_of(batches, "__text"):
            columns = [batch.column(i) for i in range(len(kept))]
            yield pa.RecordBatch.from_arrays(columns + work(texts(batch, "__text")), [*kept, *(f.name for f in new)])

    bounded_batches(docs.sparkSession)
    return inner.mapInArrow(run, schema)


def encode(docs: DataFrame, model: str, *, text: str = "text") -> DataFrame:
    """docs with ids and, for each id, the source bytes [start, end) of the text in UTF-8.

    Spans follow each other; together they cover the text, but for white space that the model's
    normaliser drops. The symbol put in front has the empty span 0..0 if it is a piece by itself;
    the pieces of one character that falls to bytes divide its bytes. Null and empty texts give
    empty lists; repeated rows and extra columns stay; columns named ids, starts, ends are
    replaced. model: path of a sentencepiece .model file, the same on all machines.
    """

    def make():
        codec = codec_of(model)

        def work(array: pa.Array) -> list[pa.Array]:
            ids, starts, ends, offsets = codec.encode(array)
            lists = [pa.ListArray.from_arrays(offsets.astype(np.int32), pa.array(x, pa.int32())) for x in (ids, starts, ends)]
            return lists

        return work

    return added(docs, text, ENCODED, make)


def decode(rows: DataFrame, model: str, *, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """rows with the decoded text of a column of id lists; null lists give empty texts."""
    kept = [c for c in rows.columns if c != out]
    schema = T.StructType([*rows.select(*[f"`{c}`" for c in kept]).schema.fields, T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model)
        for batch in batches:
            lists = batch.column(kept.index(ids)).to_pylist()
            flat = np.asarray([i for own in lists for i in own or ()], np.int64)
            offsets = np.concatenate(([0], np.cumsum([len(own or ()) for own in lists]))).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codec.decode(flat, offsets), pa.string())], [*kept, out])

    return rows.select(*[f"`{c}`" for c in kept]).mapInArrow(run, schema)


DIGESTS = [
    T.StructField("n_tokens", T.LongType()),
    T.StructField("ids_sha256", T.StringType()),
    T.StructField("decoded_sha256", T.StringType()),
    T.StructField("covered_bytes", T.LongType()),
    T.StructField("decoded_text", T.StringType()),
]


def round_trip(docs: DataFrame, model: str, *, text: str = "text", with_text: bool = False) -> DataFrame:
    """docs with digests of the ids and of the decoded text, made in the worker that encodes.

    For tables whose id lists need not be kept: lists and texts stay in the worker.
    covered_bytes: bytes of the source that the pieces' spans cover. decoded_text: only with
    with_text. Nulls, repeated rows and extra columns as in encode().
    """
    new = DIGESTS if with_text else DIGESTS[:-1]

    def make():
        codec = codec_of(model)

        def work(array: pa.Array) -> list[pa.Array]:
            ids, starts, ends, offsets = codec.encode(array)
            decoded = codec.decode(ids, offsets)
            sha = lambda xs: pa.array([hashlib.sha256(x).hexdigest() for x in xs], pa.string())
            return [
                pa.array(np.diff(offsets), pa.int64()), sha(codec.decimals(ids, offsets)), sha(x.encode() for x in decoded), pa.array(sums(ends - starts, offsets), pa.int64()),
                *([pa.array(decoded, pa.string())] if with_text else []),
            ]

        return work

    return added(docs, text, new, make)
