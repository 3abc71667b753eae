"""Queries over a heap dump that is written, read in and asked: readers, sessions and displays against SQL.

The dump holds the regions and nations as objects (two tables of a fixed size, so it is as small
at any scale), with strings, arrays, a thread, references and all kinds of roots. Dense ids follow
the order of the dump, so the SQL knows them: classes, then three objects for each region and
nation (name's bytes, name, place), arrays of the regions' nations, and single objects.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .model import GraphHeap
from .operators import reports
from .plans import lower
from .plans.ast import Complete, Pipeline
from .plans.parser import parse
from .session import ErrorResult, Session, VoidResult
from .sources.hprof import ingest
from .sources.hprof_writer import Dump
from .storage import shared_dir

#: (name, super, fields) in order: dense ids 1, 2, ...
SHAPES = [
    ("java/lang/Object", 0, ()), ("java/lang/Class", 1, ()), ("java/lang/String", 1, (("value", "object"), ("coder", "byte"))), ("java/lang/Thread", 1, (("name", "object"),)),
    ("java/lang/ref/Reference", 1, (("referent", "object"),)), ("java/lang/ref/SoftReference", 5, ()), ("java/lang/ref/WeakReference", 5, ()), ("java/lang/ref/PhantomReference", 5, ()),
    ("java/lang/ClassLoader", 1, ()), ("shop/Place", 1, (("name", "object"),)), ("shop/Region", 10, (("regionkey", "int"),)),
    ("shop/Nation", 10, (("region", "object"), ("nationkey", "int"), ("even", "boolean"), ("share", "double"))), ("[Ljava/lang/Object;", 1, ()),
]
CLASSES = len(SHAPES)
HIGH = 1 << 63  # ids of objects have the top bit set


def write_dump(spark: SparkSession, sf_dir: str, path: str) -> None:
    regions = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/region.parquet").select("r_regionkey", "r_name").orderBy("r_regionkey").collect()]
    nations = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name", "n_regionkey").orderBy("n_nationkey").collect()]
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    d = Dump(8)
    for k, (name, parent, fields) in enumerate(SHAPES, 1):
        d.cls(k, name, fields, sup=parent)
    at = {k: HIGH + CLASSES + 3 * i + 1 for i, (k, _) in enumerate(regions)}  # of the bytes; string and place follow
    for k, name in regions:
        d.prims(at[k], "byte", name.encode())
        d.obj(at[k] + 1, 3, at[k], 0)
        d.obj(at[k] + 2, 11, k, at[k] + 1)
    d.segment()
    first = HIGH + CLASSES + 3 * len(regions) + 1
    for j, (k, name, region) in enumerate(nations):
        d.prims(first + 3 * j, "byte", name.encode())
        d.obj(first + 3 * j + 1, 3, first + 3 * j, 0)
        d.obj(first + 3 * j + 2, 12, at[region] + 2, k, k % 2 == 0, k / 8, first + 3 * j + 1)
    arrays = first + 3 * len(nations)
    d.segment()
    rest = b"\0" * 8
    for i, (k, _) in enumerate(regions):
        d.array(arrays + i, 13, 0, *(first + 3 * j + 2 for j, n in enumerate(nations) if n[2] == k))
        d.root(1, arrays + i, d.raw(0))
    x = arrays + len(regions)
    d.obj(x, 9)
    d.obj(x + 1, 4, at[regions[0][0]] + 1)
    for i in range(3):
        d.obj(x + 2 + i, 6 + i, first + 3 * i + 2)
    d.obj(x + 5, 10, at[regions[1][0]] + 1)
    d.prims(x + 6, "int", [n[0] - 5 for n in nations])
    d.prims(x + 7, "double", [n[0] * 1.5 - 4 for n in nations])
    d.prims(x + 8, "char", [ord(c) for c in " ".join(name for _, name in regions)])
    for kind, raw, more in ((2, x + 2, rest), (3, x + 1, rest), (4, x + 3, rest[:4]), (5, x, b""), (6, x + 4, rest[:4]), (7, x + 6, b""), (8, x + 1, rest), (0xFF, x + 5, b"")):
        d.root(kind, raw, more)
    d.write(path)


_HEAPS: dict[tuple[str, str], GraphHeap] = {}


def place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def heap_of(spark: SparkSession, sf_dir: str) -> GraphHeap:
    """The dump of these tables, written and read in once for a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _HEAPS:
        path = place(spark, "dump").removeprefix("file:")
        path = "/" + path.lstrip("/")
        write_dump(spark, sf_dir, path)
        _HEAPS[key] = ingest(spark, path, f"{path}.tables")
    return _HEAPS[key]


def table(make: Callable[[GraphHeap], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: make(heap_of(spark, sf_dir))


def ids(text: str) -> Callable[[SparkSession, str], DataFrame]:
    """The ids that a pipeline finds."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        heap, found = heap_of(spark, sf_dir), parse(text)
        assert isinstance(found, Complete) and isinstance(found.query, Pipeline), found
        return lower.id_set(heap, found.query, lambda name: heap.empty_ids())

    return run


def session(*commands: str, reopen: bool = False) -> Callable[[SparkSession, str], DataFrame]:
    """The rows of the last of a session's commands; with reopen, a new session on the same folder gives it."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = Session(heap_of(spark, sf_dir), place(spark, "session"))
        for text in commands[:-1]:
            found = own.execute(text)
            assert not isinstance(found, ErrorResult), (text, found)
        own = Session(own.heap, own.folder) if reopen else own
        found = own.execute(commands[-1])
        if isinstance(found, ErrorResult):
            return spark.createDataFrame([(found.error,)], "error string")
        if isinstance(found, VoidResult):
            rows = found.info.get("names") or found.info.get("history") or [found.info]
            rows = [{k: str(v) for k, v in r.items() if k != "timestamp"} for r in rows]
            return spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"{k} string" for k in rows[0]))
        return found.rows

    return run


def on_nation(make: Callable[[GraphHeap, int], DataFrame], field: int) -> Callable[[SparkSession, str], DataFrame]:
    """A report of the object that lies so many ids after the last region's."""
    return table(lambda heap: make(heap, CLASSES + 3 * region_count(heap) + field))


def region_count(heap: GraphHeap) -> int:
    return heap.objects.filter("class_id = 11 and kind = 'instance'").count()


def single(make: Callable[[GraphHeap, int], DataFrame], k: int) -> Callable[[SparkSession, str], DataFrame]:
    """A report of the k-th of the single objects at the end of the dump."""
    return table(lambda heap: make(heap, heap.objects.count() - 8 + k))


def sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nations by chance: their number, and how many of them are nations."""
    rows = session("CLASS shop.Nation SAMPLE 10")(spark, sf_dir)
    return rows.agg(F.count_distinct("id").alias("n"), F.count_if(F.col("type") == "shop.Nation").alias("nations"))


SQL = f"""with r as (select r_regionkey as k, r_name as name, row_number() over (order by r_regionkey) - 1 as i from region),
n as (select n_nationkey as k, n_name as name, n_regionkey, row_number() over (order by n_nationkey) - 1 as j from nation),
c as (select (select count(*) from r) as rs, (select count(*) from n) as ns),
spots as (select {CLASSES} + 3 * rs as n0, {CLASSES} + 3 * rs + 3 * ns as a0, {CLASSES} + 4 * rs + 3 * ns as x0, ns from c),
names as (select {CLASSES} + 3 * i as b, name from r union all select n0 + 3 * j, name from n, spots),
regions as (select {CLASSES} + 3 * i + 3 as id, k, name, i from r),
nations as (select n0 + 3 * j + 3 as id, n.k, n.name, j, regions.id as region, regions.i from n join regions on regions.k = n_regionkey, spots),
eight as (select id, type, kind, (size // 8) * 8 as shallow from (
  select b + 1 as id, '[B' as type, 'primarray' as kind, 16 + length(name) as size from names
  union all select b + 2, 'java.lang.String', 'instance', 25 from names
  union all select id, 'shop.Region', 'instance', 28 from regions
  union all select id, 'shop.Nation', 'instance', 45 from nations
  union all select a0 + i + 1, 'java.lang.Object[]', 'objarray', 24 + 8 * (select count(*) from nations m where m.i = regions.i) from regions, spots
  union all select x0 + 1, 'java.lang.ClassLoader', 'instance', 16 from spots
  union all select x0 + 2, 'java.lang.Thread', 'instance', 24 from spots
  union all select x0 + 3, 'java.lang.ref.SoftReference', 'instance', 24 from spots
  union all select x0 + 4, 'java.lang.ref.WeakReference', 'instance', 24 from spots
  union all select x0 + 5, 'java.lang.ref.PhantomReference', 'instance', 24 from spots
  union all select x0 + 6, 'shop.Place', 'instance', 24 from spots
  union all select x0 + 7, '[I', 'primarray', 16 + 4 * ns from spots
  union all select x0 + 8, '[D', 'primarray', 16 + 8 * ns from spots
  union all select x0 + 9, '[C', 'primarray', 16 + 2 * (select sum(length(name) + 1) - 1 from r) from spots)),
refs as (
  select b + 2 as src, b + 1 as dst, 'value' as label, 'field' as how, cast(null as int) as slot from names
  union all select id, id - 1, 'name', 'field', null from regions
  union all select id, id - 1, 'name', 'field', null from nations
  union all select id, region, 'region', 'field', null from nations
  union all select a0 + i + 1, id, null, 'element', cast(row_number() over (partition by i order by id) as int) from nations, spots
  union all select x0 + 2, {CLASSES} + 2, 'name', 'field', null from spots
  union all select x0 + 3 + j, nations.id, 'referent', 'field', null from nations, spots where j < 3
  union all select x0 + 6, {CLASSES} + 5, 'name', 'field', null from spots),
size as (select nations.id, nations.k, nations.name, nations.j, 40 + 24 + ((16 + length(name)) // 8) * 8 as retained from nations)
"""
NATION_ROWS = "id, 'shop.Nation' as type, retained as \"retainedSize\", 40 as \"shallowSize\", cast(null as varchar) as description from size"
SHOW_10 = f"select row_number() over (order by retained desc, id) as rank, {NATION_ROWS} order by rank limit 10"

#: name -> (query, SQL)
ALL: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "d_objects": (
        table(lambda h: h.objects.filter("kind != 'class'").join(h.classes.select("class_id", F.col("name").alias("type")), "class_id").select("id", "type", "kind", "shallow")),
        "select id, type, kind, cast(shallow as bigint) as shallow from eight",
    ),
    "d_classes": (
        table(lambda h: h.classes.filter("class_id > 0").select("class_id", "name", F.coalesce("super_id", F.lit(0)).alias("super_id"), "instance_size")),
        "select * from (values " + ", ".join(
            f"({k}::bigint, '{name.replace('/', '.') if name[0] != '[' else 'java.lang.Object[]'}', {parent}::bigint, "
            f"{16 + sum({'object': 8, 'byte': 1, 'int': 4, 'boolean': 1, 'double': 8}[t] for c in ((k, 10) if parent == 10 else (k, 5) if parent == 5 else (k,)) for _, t in SHAPES[c - 1][2])})"
            for k, (name, parent, _) in enumerate(SHAPES, 1)) + ") t(class_id, name, super_id, instance_size)",
    ),
    "d_class_fields": (
        table(lambda h: h.class_fields.filter("class_id = 12").select("ordinal", "name", "type_code", "declaring_class_id")),
        "select * from (values (0, 'region', 2, 12::bigint), (1, 'nationkey', 10, 12), (2, 'even', 4, 12), (3, 'share', 7, 12), (4, 'name', 2, 10)) t(ordinal, name, type_code, declaring_class_id)",
    ),
    "d_edges": (
        table(lambda h: h.edges.filter(f"src > {CLASSES}").select("src", "dst", F.when(F.col("kind") != "element", F.col("label")).alias("label"), F.coalesce("slot", F.lit(-1)).alias("slot"))),
        "select src, dst, label, coalesce(slot, -1) as slot from refs",
    ),
    "d_class_edges": (
        table(lambda h: h.edges.filter(f"src <= {CLASSES}").select("src", "dst", "label")),
        "select * from (values " + ", ".join(f"({k}::bigint, {parent}::bigint, 'super')" for k, (_, parent, _) in enumerate(SHAPES, 1) if parent) + ") t(src, dst, label)",
    ),
    "d_roots": (
        table(lambda h: h.gc_roots.select("id", "root_type")),
        """select a0 + i + 1 as id, 1 as root_type from regions, spots union all select x0 + 3, 2 from spots union all select x0 + 2, 3 from spots union all select x0 + 4, 4 from spots
        union all select x0 + 1, 5 from spots union all select x0 + 5, 6 from spots union all select x0 + 7, 7 from spots union all select x0 + 6, 255 from spots""",
    ),
    "d_fields": (
        table(lambda h: h.field_values.filter("class_id = 12").select("id", "name", "type_code", F.coalesce("long_val", F.lit(-1)).alias("long_val"), "double_val", F.coalesce("ref_id", F.lit(0)).alias("ref_id"))),
        """select id, 'nationkey' as name, 10 as type_code, cast(k as bigint) as long_val, cast(null as double) as double_val, cast(0 as bigint) as ref_id from nations
        union all select id, 'even', 4, case when k % 2 = 0 then 1 else 0 end, null, 0 from nations union all select id, 'share', 7, -1, k / 8.0, 0 from nations
        union all select id, 'region', 2, -1, null, region from nations union all select id, 'name', 2, -1, null, id - 1 from nations""",
    ),
    "d_strings": (table(lambda h: h.string_values.select("id", "value")), "select b + 2 as id, name as value from names"),
    "d_arrays": (
        table(lambda h: h.prim_arrays.select("id", "elem_type", "n")),
        """select b + 1 as id, 8 as elem_type, cast(length(name) as int) as n from names union all select x0 + 7, 10, cast(ns as int) from spots union all select x0 + 8, 11 - 4, cast(ns as int) from spots
        union all select x0 + 9, 5, (select cast(sum(length(name) + 1) - 1 as int) from r) from spots""",
    ),
    "d_summary": (
        table(lambda h: reports.summary(h).select("objectCount", "unreachableCount")),
        f"select {CLASSES} + (select count(*) from eight) as \"objectCount\", cast({CLASSES} + 2 as bigint) as \"unreachableCount\"",
    ),
    "d_histogram": (table(reports.histogram), "select type as \"className\", count(*) as \"instanceCount\" from eight where kind != 'primarray' group by type"),
    "d_threads": (ids("Threads"), "select x0 + 2 as id from spots"),
    "d_class_loaders": (ids("ClassLoaders"), "select x0 + 1 as id from spots"),
    "d_soft_references": (ids("SoftReferences"), "select x0 + 3 as id from spots"),
    "d_weak_references": (ids("WeakReferences"), "select x0 + 4 as id from spots"),
    "d_phantom_references": (ids("PhantomReferences"), "select x0 + 5 as id from spots"),
    "d_of_type": (ids("ALL OF TYPE shop.Place"), "select id from regions union all select id from nations union all select x0 + 6 from spots"),
    "d_of_type_exactly": (ids("ALL OF TYPE EXACTLY shop.Place"), "select x0 + 6 as id from spots"),
    "d_where_string": (ids('CLASS shop.Nation WHERE name = *"1"'), "select id from nations where ends_with(name, '1')"),
    "d_where_inherited": (ids('ALL OF TYPE shop.Place WHERE name = "A"*'), "select id from nations where starts_with(name, 'A') union all select id from regions where starts_with(name, 'A') union all select x0 + 6 from spots, regions where i = 1 and starts_with(name, 'A')"),
    "d_where_double": (ids("CLASS shop.Nation WHERE share >= 1.5"), "select id from nations where k / 8.0 >= 1.5"),
    "d_where_boolean": (ids("CLASS shop.Nation WHERE even = false"), "select id from nations where k % 2 = 1"),
    "d_default_display": (session("CLASS shop.Nation"), SHOW_10),
    "d_descriptions": (
        session("CLASS java.lang.String TOP 12 BY shallowSize"),
        """select row_number() over (order by b) as rank, b + 2 as id, 'java.lang.String' as type, 24 + ((16 + length(name)) // 8) * 8 as "retainedSize", 24 as "shallowSize", name as description
        from names order by b limit 12""",
    ),
    "d_thread_description": (
        session("Threads"),
        "select 1 as rank, x0 + 2 as id, 'java.lang.Thread' as type, 24 as \"retainedSize\", 24 as \"shallowSize\", (select name from r where i = 0) as description from spots",
    ),
    "d_sample": (sampled, "select 10::bigint as n, 10::bigint as nations"),
    "d_read_string": (on_nation(reports.read, 2), "select n0 + 2 as id, name as content from nations, spots where j = 0"),
    "d_read_bytes": (on_nation(reports.read, 1), "select n0 + 1 as id, name as content from nations, spots where j = 0"),
    "d_read_chars": (single(reports.read, 8), "select x0 + 9 as id, (select string_agg(name, ' ' order by i) from r) as content from spots"),
    "d_read_other": (on_nation(reports.read, 3), "select n0 + 3 as id, '(not a String or byte[]/char[])' as content from spots"),
    "d_inspect": (
        on_nation(lambda h, i: reports.inspect(h, i).select("at", "field", "value", "type", F.coalesce("ref", F.lit(0)).alias("ref"), "description"), 3),
        """select 0 as at, 'region' as field, cast(null as varchar) as value, 'shop.Region' as type, region as ref, cast(null as varchar) as description from nations where j = 0
        union all select 1, 'nationkey', cast(k as varchar), 'int', 0, null from nations where j = 0 union all select 2, 'even', case when k % 2 = 0 then 'true' else 'false' end, 'boolean', 0, null from nations where j = 0
        union all select 3, 'share', cast(k / 8.0 as varchar), 'double', 0, null from nations where j = 0 union all select 4, 'name', null, 'java.lang.String', id - 1, name from nations where j = 0""",
    ),
    "d_inspect_slots": (
        table(lambda h: reports.inspect(h, h.objects.filter("kind = 'objarray'").agg(F.min("id")).first()[0]).select("at", "field", "type", "ref", "retainedSize")),
        """select slot as at, '[' || slot || ']' as field, 'shop.Nation' as type, dst as ref, retained as "retainedSize" from refs join size on size.id = dst, spots where how = 'element' and src = a0 + 1""",
    ),
    "d_inspect_ints": (
        single(lambda h, i: reports.inspect(h, i).select("at", "field", "value", "type"), 6),
        "select cast(j as int) as at, '[' || j || ']' as field, cast(k - 5 as varchar) as value, 'int' as type from nations",
    ),
    "d_inspect_doubles": (
        single(lambda h, i: reports.inspect(h, i).select("at", F.col("value").cast("double").alias("value"), "type"), 7),
        "select cast(j as int) as at, k * 1.5::double - 4 as value, 'double' as type from nations",
    ),
    "d_inspect_class": (table(lambda h: reports.inspect(h, 12).select("at", "field", "value")), "select 0 as at, 'class' as field, 'shop.Nation' as value"),
    "d_explain": (
        on_nation(lambda h, i: reports.explain(h, i).select("depth", "id", "type", "field", "description", "notes"), 3 * 4 - 1),
        """select 0 as depth, n0 + 11 as id, 'java.lang.String' as type, cast(null as varchar) as field, name as description, cast(null as varchar) as notes from nations, spots where j = 3
        union all select 1, id, 'shop.Nation', 'name', null, null from nations where j = 3
        union all select 2, src, 'java.lang.Object[]', '[' || slot || ']', null, 'GC root (JNI global)' from refs join nations on dst = nations.id where j = 3 and how = 'element'""",
    ),
    "s_that": (session("CLASS shop.Nation WHERE nationkey > 10", "THAT COUNT"), "select count(*) as count from nations where k > 10"),
    "s_empty_line": (session("CLASS shop.Nation", ""), SHOW_10),
    "s_history_set": (session("CLASS shop.Nation", "CLASS shop.Region", "h1 COUNT"), "select count(*) as count from nations"),
    "s_recall": (session("CLASS shop.Nation", "CLASS shop.Region", "h1"), SHOW_10),
    "s_named": (session("CLASS shop.Region", "CALL THAT areas", "CLASS shop.Nation REFERENCING areas COUNT"), "select count(*) as count from nations"),
    "s_undo": (session("CLASS shop.Region", "CALL THAT areas", "CLASS shop.Nation", "CALL THAT areas", "UNDO", "areas COUNT"), "select count(*) as count from regions"),
    "s_forget": (session("CLASS shop.Region", "CALL THAT areas", "FORGET areas", "areas COUNT"), "select 'Unknown name: areas' as error"),
    "s_names": (session("CLASS shop.Region", "CALL THAT areas", "CLASS shop.Nation", "CALL h1 again", "CALL THAT lands", "NAMES a*"), "select 'again' as name, '1' as \"histId\" union all select 'areas', '1'"),
    "s_history": (session("CLASS shop.Region COUNT", "SUMMARY", "HISTORY"), "select '2' as id, 'SUMMARY' as command union all select '1', 'CLASS shop.Region COUNT'"),
    "s_provenance": (session("CLASS shop.Region", "CALL THAT areas", "ALL REFERENCED BY areas", "CALL THAT parts", "EXPLAIN parts"), "select 'parts' as name, '3' as \"histId\", 'bitset' as type, 'ALL REFERENCED BY areas' as command, '[''areas'']' as \"derivedFrom\""),
    "s_sql": (
        session("CLASS shop.Nation", "CALL THAT lands", "SELECT label, count(*) AS n FROM lands JOIN edges ON src = id GROUP BY label"),
        "select label, count(*) as n from refs join nations on src = nations.id group by label",
    ),
    "s_sql_table": (session("SELECT root_type, count(*) AS n FROM gc_roots GROUP BY root_type", "SELECT sum(n) AS roots FROM t1"), "select cast(rs + 7 as bigint) as roots from c"),
    "s_reopened_name": (session("CLASS shop.Region", "CALL THAT areas", "areas COUNT", reopen=True), "select count(*) as count from regions"),
    "s_reopened_that": (session("CLASS shop.Nation WHERE nationkey > 3", "THAT REFERENCED BY ALL", "THAT COUNT", reopen=True), "select count(*) as count from nations where k > 3"),
}
QUERIES = {name: query for name, (query, _) in ALL.items()}
ORACLES = {name: SQL + sql for name, (_, sql) in ALL.items() if sql is not None}
