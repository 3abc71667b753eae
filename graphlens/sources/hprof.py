"""Heap dumps (HPROF 1.0.1 / 1.0.2, 4- or 8-byte ids; plain, gzip or zip) as typed tables.

The driver reads the outermost records alone and seeks over what heap records hold: it collects
names and where each heap record lies. Tasks, one for each piece of the list of heap records, then
find the class dumps, and in a second pass emit rows of one wide staging table as Arrow batches;
Spark splits it into the tables of a GraphHeap by joins on raw ids. A heap record is read by one
task. Compressed dumps cannot be read from the middle: they are one piece, and the driver reads
them whole.

The path must be readable by all executors as a file.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import os
import pickle
import struct
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import ARRAY_LETTERS, TYPE_SIZES, dotted, shallow_size
from ..model import TABLES, GraphHeap

# fixed values: record tags of the format, in order
UTF8, LOAD_CLASS, HEAP_DUMP, HEAP_SEGMENT = 0x01, 0x02, 0x0C, 0x1C
# fixed values: heap sub-record tags
ROOT_UNKNOWN, CLASS_DUMP, INSTANCE_DUMP, OBJECT_ARRAY, PRIMITIVE_ARRAY = 0xFF, 0x20, 0x21, 0x22, 0x23
# fixed values: bytes after the id of each root sub-record, as (ids, 4-byte numbers)
ROOT_REST = {0xFF: (0, 0), 1: (1, 0), 2: (0, 2), 3: (0, 2), 4: (0, 1), 5: (0, 0), 6: (0, 1), 7: (0, 0), 8: (0, 2)}
# fixed values: layout letters of the types for struct
LAYOUT = {4: "b", 5: "H", 6: "f", 7: "d", 8: "b", 9: "h", 10: "i", 11: "q"}
ARRAY_HEADER = 16
#: Bytes of heap segments that one task reads, about.
PIECE_BYTES = 64 << 20
#: Bytes from which a payload is passed over by seeking.
SEEK_BYTES = 1 << 12
#: Rows of an Arrow batch.
BATCH_ROWS = 20_000
FORMAT = 3
FINGERPRINT_BYTES = 64 << 10


class BadDump(ValueError):
    pass


def opened(path: str) -> tuple[BinaryIO, bool]:
    """The dump's bytes, and whether they can be read from the middle."""
    file = open(path, "rb")  # noqa: SIM115
    magic = file.read(4)
    file.seek(0)
    if magic[:2] == b"\x1f\x8b":
        return gzip.open(file), False
    if magic[:2] == b"PK":
        archive = zipfile.ZipFile(file)
        names = archive.namelist()
        if not names:
            raise BadDump("the archive is empty")
        return archive.open(next((n for n in names if n.endswith(".hprof")), names[0])), False
    return file, True


@dataclass
class ClassShape:
    raw: int
    super_raw: int = 0
    loader: int = 0
    size: int = 0
    #: (name string id, type code), own fields in order
    fields: list[tuple[int, int]] = field(default_factory=list)
    #: (kind, name string id, raw id): super, loader, signers, protection domain, then static fields
    refs: list[tuple[str, int, int]] = field(default_factory=list)


@dataclass
class Outline:
    """What the first pass finds; bounded by the program's classes and names, not by its data."""

    id_size: int
    millis: int
    strings: dict[int, str] = field(default_factory=dict)
    names: dict[int, int] = field(default_factory=dict)  # raw class id -> string id
    classes: dict[int, ClassShape] = field(default_factory=dict)
    #: (position, length) of each heap record
    segments: list[tuple[int, int]] = field(default_factory=list)

    def chain(self, raw: int) -> list[ClassShape]:
        """A class and its superclasses, most derived first."""
        out, seen = [], set()
        while raw in self.classes and raw not in seen:
            seen.add(raw)
            out.append(self.classes[raw])
            raw = self.classes[raw].super_raw
        return out


class Reader:
    """Numbers and ids from a stream."""

    def __init__(self, stream: BinaryIO, id_size: int = 4, size: int | None = None):
        """size: of a stream that can be read from the middle."""
        self.stream, self.at, self.size = stream, 0, size
        self.use(id_size)

    def use(self, id_size: int) -> None:
        if id_size not in (4, 8):
            raise BadDump(f"ids of {id_size} bytes")
        self.id_size, self.id_form = id_size, ">I" if id_size == 4 else ">Q"

    def take(self, n: int) -> bytes:
        data = self.stream.read(n)
        if len(data) != n:
            raise BadDump("the dump ends in the middle of a record")
        self.at += n
        return data

    def skip(self, n: int) -> None:
        if self.size is not None and n > SEEK_BYTES:
            if self.at + n > self.size:
                raise BadDump("the dump ends in the middle of a record")
            self.stream.seek(n, io.SEEK_CUR)
            self.at += n
            return
        while n > 0:
            n -= len(self.take(min(n, 1 << 20)))

    def u1(self) -> int:
        return self.take(1)[0]

    def u2(self) -> int:
        return int.from_bytes(self.take(2))

    def u4(self) -> int:
        return int.from_bytes(self.take(4))

    def raw(self) -> int:
        return int.from_bytes(self.take(self.id_size))


def header(reader: Reader) -> int:
    magic = bytearray()
    while (c := reader.take(1)) != b"\0":
        magic += c
        if len(magic) > 64:
            raise BadDump("not a heap dump")
    if not magic.startswith(b"JAVA PROFILE"):
        raise BadDump("not a heap dump")
    reader.use(reader.u4())
    return int.from_bytes(reader.take(8))


def outline(path: str, classes: bool = True) -> Outline:
    """Names and places of the heap records; with classes, also the class dumps inside these records."""
    stream, seekable = opened(path)
    reader = Reader(io.BufferedReader(stream, 1 << 20), size=os.path.getsize(path) if seekable else None)
    millis = header(reader)
    out = Outline(reader.id_size, millis)
    while tag := reader.stream.read(1):
        reader.at += 1
        reader.skip(4)
        length = reader.u4()
        if tag[0] == UTF8:
            raw = reader.raw()
            out.strings[raw] = reader.take(length - reader.id_size).decode("utf-8", "replace")
        elif tag[0] == LOAD_CLASS:
            reader.skip(4)
            raw = reader.raw()
            reader.skip(4)
            out.names[raw] = reader.raw()
        elif tag[0] in (HEAP_DUMP, HEAP_SEGMENT):
            out.segments.append((reader.at, length))
            if classes:
                for kind, _ in sub_records(reader, reader.at + length, only_classes=True):
                    out.classes[kind.raw] = kind
            else:
                reader.skip(length)
        else:
            reader.skip(length)
    stream.close()
    if classes:
        named(out)
    return out


def named(out: Outline) -> None:
    """Keep only the names that classes and their fields use."""
    used = set(out.names.values()) | {n for c in out.classes.values() for n, _ in c.fields} | {n for c in out.classes.values() for _, n, _ in c.refs}
    out.strings = {k: v for k, v in out.strings.items() if k in used}


def read_pieces(spark: SparkSession, path: str, out: Outline, read: Callable[[Reader, int, int], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """What read(reader, heap record, its end) gives for every heap record: one task for each piece of them."""
    _, seekable = opened(path)
    pieces, size = [[]], 0
    for k, (at, length) in enumerate(out.segments):
        if seekable and size > PIECE_BYTES:
            pieces.append([])
            size = 0
        pieces[-1].append((k, at, length))
        size += length
    id_size = out.id_size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in batch.column("piece").to_pylist():
                stream, can_seek = opened(path)
                reader = Reader(io.BufferedReader(stream, 1 << 20), id_size, os.path.getsize(path) if can_seek else None)
                for k, at, length in json.loads(own):
                    if can_seek:
                        reader.stream.seek(at)
                        reader.at = at
                    else:
                        reader.skip(at - reader.at)
                    yield from read(reader, k, at + length)
                stream.close()

    rows = spark.createDataFrame([(json.dumps(p),) for p in pieces], "piece string").repartition(len(pieces))
    return rows.mapInArrow(run, schema)


def described(spark: SparkSession, path: str, out: Outline) -> None:
    """Fill in the class dumps, found by tasks that read the heap records: as many as the program has classes."""

    def read(reader: Reader, k: int, end: int) -> Iterator[pa.RecordBatch]:
        found = [pickle.dumps(kind) for kind, _ in sub_records(reader, end, only_classes=True)]
        yield pa.RecordBatch.from_arrays([pa.array([k] * len(found), pa.int32()), pa.array(found, pa.binary())], ["k", "shape"])

    schema = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("shape", T.BinaryType())])
    for row in sorted(read_pieces(spark, path, out, read, schema).collect(), key=lambda r: r.k):
        kind = pickle.loads(row.shape)
        out.classes[kind.raw] = kind
    named(out)


def sub_records(reader: Reader, end: int, only_classes: bool = False) -> Iterator[tuple]:
    """Sub-records of a heap record: (tag, values), or (ClassShape, None) for classes."""
    while reader.at < end:
        tag = reader.u1()
        if tag in ROOT_REST:
            raw = reader.raw()
            ids, numbers = ROOT_REST[tag]
            reader.skip(ids * reader.id_size + 4 * numbers)
            if not only_classes:
                yield tag, raw
        elif tag == CLASS_DUMP:
            yield class_dump(reader), None
        elif tag == INSTANCE_DUMP:
            raw, _, own, n = reader.raw(), reader.u4(), reader.raw(), reader.u4()
            if only_classes:
                reader.skip(n)
            else:
                yield tag, (raw, own, reader.take(n))
        elif tag == OBJECT_ARRAY:
            raw, _, n, own = reader.raw(), reader.u4(), reader.u4(), reader.raw()
            if only_classes:
                reader.skip(n * reader.id_size)
            else:
                yield tag, (raw, own, struct.unpack(f">{n}{reader.id_form[1]}", reader.take(n * reader.id_size)))
        elif tag == PRIMITIVE_ARRAY:
            raw, _, n, kind = reader.raw(), reader.u4(), reader.u4(), reader.u1()
            size = n * TYPE_SIZES[kind]
            if only_classes:
                reader.skip(size)
            else:
                yield tag, (raw, kind, n, reader.take(size))
        else:
            raise BadDump(f"unknown heap record 0x{tag:02x}")


def class_dump(reader: Reader) -> ClassShape:
    shape = ClassShape(reader.raw())
    reader.skip(4)
    shape.super_raw, shape.loader, signers, domain = (reader.raw() for _ in range(4))
    reader.skip(2 * reader.id_size)
    shape.size = reader.u4()
    value = lambda kind: reader.raw() if kind == 2 else reader.skip(TYPE_SIZES[kind])
    for _ in range(reader.u2()):  # constants
        reader.skip(2)
        value(reader.u1())
    statics = []
    for _ in range(reader.u2()):
        name, kind = reader.raw(), reader.u1()
        ref = value(kind)
        if kind == 2:
            statics.append(("static", name, ref))
    shape.fields = [(reader.raw(), reader.u1()) for _ in range(reader.u2())]
    shape.refs = [("super", 0, shape.super_raw), ("loader", 0, shape.loader), ("signers", 0, signers), ("pd", 0, domain), *statics]
    return shape


#: One wide row for everything: what a row is says `row`.
STAGING = T.StructType([
    T.StructField("row", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("raw", T.LongType()), T.StructField("class_raw", T.LongType()), T.StructField("ref_raw", T.LongType()),
    T.StructField("ord", T.IntegerType()), T.StructField("slot", T.IntegerType()), T.StructField("code", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("name", T.StringType()),
    T.StructField("long_val", T.LongType()), T.StructField("double_val", T.DoubleType()), T.StructField("data", T.BinaryType()),
])
_NAMES = STAGING.fieldNames()


def signed(raw: int) -> int:
    return raw - (1 << 64) if raw >= 1 << 63 else raw


class Rows:
    """Staging rows as Arrow batches."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.schema = pa.schema([
            ("row", pa.string()), ("seq", pa.int64()), ("raw", pa.int64()), ("class_raw", pa.int64()), ("ref_raw", pa.int64()), ("ord", pa.int32()), ("slot", pa.int32()),
            ("code", pa.int32()), ("kind", pa.string()), ("name", pa.string()), ("long_val", pa.int64()), ("double_val", pa.float64()), ("data", pa.binary()),
        ])

    def add(self, row: str, seq: int, raw: int, **more) -> None:
        self.rows.append((row, seq, raw, *(more.get(n) for n in _NAMES[3:])))

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [[] for _ in _NAMES]
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, self.schema.types, strict=True)], schema=self.schema)


def emit(out: Outline, reader: Reader, segment: int, end: int) -> Iterator[pa.RecordBatch]:
    """Staging rows of a heap record. seq orders all rows of the dump: record, then place in it."""
    rows = Rows()
    base = segment << 40
    layouts: dict[int, list[tuple[int, str, int]]] = {}
    text = lambda n: out.strings.get(n, "?")
    for i, (tag, value) in enumerate(sub_records(reader, end)):
        seq = base + i
        if isinstance(tag, ClassShape):
            rows.add("object", seq, signed(tag.raw), kind="class", long_val=0)
            for k, (kind, name, ref) in enumerate(tag.refs):
                if ref:
                    rows.add("edge", seq, signed(tag.raw), ord=k, ref_raw=signed(ref), kind=kind, name=text(name) if kind == "static" else kind)
        elif tag in ROOT_REST:
            rows.add("root", seq, signed(value), code=tag)
        elif tag == INSTANCE_DUMP:
            raw, own, data = value
            if own not in layouts:
                layouts[own] = [(k, text(n), code) for k, (n, code) in enumerate(f for c in out.chain(own) for f in c.fields)]
            shape = out.classes.get(own)
            rows.add("object", seq, signed(raw), class_raw=signed(own), kind="instance", long_val=shape.size if shape else 0)
            at = 0
            for k, name, code in layouts[own]:
                size = out.id_size if code == 2 else TYPE_SIZES[code]
                if at + size > len(data):
                    raise BadDump(f"instance 0x{raw:x} is too short for its class")
                if code == 2:
                    ref = int.from_bytes(data[at : at + size])
                    rows.add("field", seq, signed(raw), class_raw=signed(own), ord=k, code=2, name=name, ref_raw=signed(ref) if ref else None)
                    if ref:
                        rows.add("edge", seq, signed(raw), ord=k, ref_raw=signed(ref), kind="field", name=name)
                else:
                    number = struct.unpack_from(">" + LAYOUT[code], data, at)[0]
                    real = code in (6, 7)
                    rows.add("field", seq, signed(raw), class_raw=signed(own), ord=k, code=code, name=name, long_val=None if real else int(number), double_val=float(number) if real else None)
                at += size
        elif tag == OBJECT_ARRAY:
            raw, own, elements = value
            rows.add("object", seq, signed(raw), class_raw=signed(own), ord=len(elements), kind="objarray", long_val=ARRAY_HEADER + len(elements) * out.id_size)
            for k, ref in enumerate(elements):
                if ref:
                    rows.add("edge", seq, signed(raw), ord=k, slot=k, ref_raw=signed(ref), kind="element", name=f"[{k}]")
        else:
            raw, code, n, data = value
            rows.add("object", seq, signed(raw), code=code, ord=n, kind="primarray", long_val=ARRAY_HEADER + len(data))
            rows.add("payload", seq, signed(raw), code=code, ord=n, data=data)
        if len(rows.rows) >= BATCH_ROWS:
            yield rows.batch()
    yield rows.batch()


def staged(spark: SparkSession, path: str, out: Outline) -> DataFrame:
    """The staging table."""
    shared = spark.sparkContext.broadcast(out)
    return read_pieces(spark, path, out, lambda reader, k, end: emit(shared.value, reader, k, end), STAGING)


def ingest(spark: SparkSession, path: str, folder: str) -> GraphHeap:
    """The GraphHeap of a dump, written as Parquet to a folder, or read from it if it is of this dump.

    Dense ids follow the order of the dump, from 1. A reference to an object that the dump does
    not hold is dropped; of an id that comes twice, and of a root with several types, the first
    counts. The manifest is written last, so a folder without one is made anew.
    """
    print_of = fingerprint(path)
    if manifest(spark, folder) != print_of:
        _, seekable = opened(path)
        out = outline(path, classes=not seekable)
        if seekable:
            described(spark, path, out)
        rows = staged(spark, path, out)
        rows.write.mode("overwrite").parquet(f"{folder}/staging")
        build(spark, spark.read.schema(STAGING).parquet(f"{folder}/staging"), out, folder)
        spark.createDataFrame([(json.dumps(print_of),)], "manifest string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest")
    tables = [spark.read.schema(schema).parquet(f"{folder}/{name}") for name, schema in TABLES.items()]
    return GraphHeap(spark, *tables)


def fingerprint(path: str) -> dict:
    with open(path, "rb") as file:
        start = file.read(FINGERPRINT_BYTES)
        size = file.seek(0, io.SEEK_END)
    return {"format": FORMAT, "sha256": hashlib.sha256(start).hexdigest(), "bytes": size}


def manifest(spark: SparkSession, folder: str) -> dict | None:
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    row = spark.read.text(f"{folder}/manifest").first()
    return json.loads(row.value) if row else None


def build(spark: SparkSession, staging: DataFrame, out: Outline, folder: str) -> None:
    def write(df: DataFrame, name: str) -> DataFrame:
        df.select(*spark.createDataFrame([], TABLES[name]).columns).write.mode("overwrite").parquet(f"{folder}/{name}")
        return spark.read.schema(TABLES[name]).parquet(f"{folder}/{name}")

    # dense ids: numbered within each heap record by place, records one after the other
    first = staging.filter("row = 'object'").groupBy("raw").agg(F.min("seq").alias("seq"))
    sizes = {r.k: r.n for r in first.groupBy(F.shiftright("seq", 40).alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()}
    before, total = {}, 0
    for k in sorted(sizes):
        before[k], total = total, total + sizes[k]
    from pyspark.sql import Window

    starts = spark.createDataFrame(sorted(before.items()) or [(0, 0)], "k bigint, start bigint")
    place = F.row_number().over(Window.partitionBy("k").orderBy("seq"))
    ids = first.withColumn("k", F.shiftright("seq", 40)).withColumn("place", place).join(F.broadcast(starts), "k")  # one row for each heap record
    ids.select("raw", "seq", (F.col("start") + F.col("place")).alias("id")).write.mode("overwrite").parquet(f"{folder}/ids")
    ids = spark.read.parquet(f"{folder}/ids")
    to = lambda raw, dense: ids.select(F.col("raw").alias(raw), F.col("id").alias(dense))

    shapes = [(signed(raw), dotted(out.strings.get(out.names.get(raw, 0), f"<unknown@{raw:x}>")), signed(c.super_raw), signed(c.loader), c.size) for raw, c in out.classes.items()]
    classes = spark.createDataFrame(shapes, "raw bigint, name string, super_raw bigint, loader_raw bigint, instance_size int").join(to("raw", "class_id"), "raw")
    classes = classes.join(to("super_raw", "super_id"), "super_raw", "left").join(to("loader_raw", "loader_id"), "loader_raw", "left")
    arrays = spark.createDataFrame([(-code, f"[{letter}", None, None, None) for code, letter in ARRAY_LETTERS.items()], TABLES["classes"])
    # primitive array classes that the dump does not describe get negative ids of their own
    classes = write(classes.select("class_id", component_name(F.col("name")).alias("name"), "super_id", "loader_id", "instance_size").unionByName(
        arrays.join(classes.select("name"), "name", "left_anti")), "classes")
    by_letter = {r.name: r.class_id for r in classes.filter(F.col("name").isin([f"[{x}" for x in ARRAY_LETTERS.values()])).collect()}
    own_class = F.lit(None).cast("long")
    for code, letter in ARRAY_LETTERS.items():
        own_class = F.when((F.col("kind") == "primarray") & (F.col("code") == code), F.lit(by_letter[f"[{letter}"])).otherwise(own_class)
    meta = classes.filter("name = 'java.lang.Class'").select("class_id").first()
    objects = staging.filter("row = 'object'").join(ids, ["raw", "seq"]).join(to("class_raw", "of"), "class_raw", "left")
    write(objects.select(
        "id", F.coalesce("of", own_class, F.when(F.col("kind") == "class", F.lit(meta.class_id if meta else None))).alias("class_id"), "kind", F.col("code").alias("elem_type"),
        F.col("ord").alias("length"), shallow_size(F.col("long_val")).alias("shallow")), "objects")
    write(staging.filter("row = 'edge'").join(to("raw", "src"), "raw").join(to("ref_raw", "dst"), "ref_raw").select("src", "ord", "dst", F.col("name").alias("label"), "slot", "kind"), "edges")
    roots = staging.filter("row = 'root'").join(to("raw", "id"), "raw").groupBy("id").agg(F.min(F.struct("seq", "code")).alias("r"))
    write(roots.select("id", F.col("r.code").alias("root_type"), F.col("r.seq").alias("ord")), "gc_roots")
    described = [(signed(raw), k, signed(c.raw), out.strings.get(n, "?"), code) for raw in out.classes for k, (c, (n, code)) in enumerate((c, f) for c in out.chain(raw) for f in c.fields)]
    fields = spark.createDataFrame(described, "raw bigint, ordinal int, declaring bigint, name string, type_code int")
    write(fields.join(to("raw", "class_id"), "raw").join(to("declaring", "declaring_class_id"), "declaring"), "class_fields")
    payload = staging.filter("row = 'payload'").join(to("raw", "id"), "raw")
    prims = write(payload.select("id", F.col("code").alias("elem_type"), F.col("ord").alias("n"), "data"), "prim_arrays")
    values = staging.filter("row = 'field'").join(to("raw", "id"), "raw").join(to("class_raw", "class_id"), "class_raw").join(to("ref_raw", "ref_id"), "ref_raw", "left")
    values = write(values.select("id", "class_id", F.col("ord").alias("ordinal"), "name", F.col("code").alias("type_code"), "long_val", "double_val", "ref_id", F.lit(None).cast("string").alias("string_val")), "field_values")
    write(strings(classes, values, prims), "string_values")


def component_name(name):
    """`[Ljava.lang.String;` as `java.lang.String[]`; other names as they are."""
    deep = F.length(F.regexp_extract(name, r"^(\[+)L", 1))
    return F.when(deep > 0, F.concat(F.regexp_extract(name, r"^\[+L(.*?);?$", 1), F.repeat(F.lit("[]"), deep.cast("int")))).otherwise(name)


def strings(classes: DataFrame, values: DataFrame, prims: DataFrame) -> DataFrame:
    """Text of each java.lang.String: by its array's type, and by `coder` for bytes (1: UTF-16 of the machine)."""
    ids = [r.class_id for r in classes.filter("name = 'java.lang.String'").collect()]
    own = values.filter(F.col("class_id").isin(ids)) if ids else values.filter(F.lit(False))
    value = own.filter("name = 'value' and ref_id is not null").select("id", "ref_id")
    coder = own.filter("name = 'coder'").select("id", F.col("long_val").alias("coder"))
    rows = value.join(prims.select(F.col("id").alias("ref_id"), "elem_type", "data"), "ref_id").join(coder, "id", "left")
    text = F.when(F.col("elem_type") == 5, F.decode("data", "UTF-16BE")).when(F.col("coder") == 1, F.decode("data", "UTF-16LE")).otherwise(F.decode("data", "ISO-8859-1"))
    return rows.select("id", text.alias("value"))
