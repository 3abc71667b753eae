"""Sources and filters: each gives a DataFrame of ids, lazily, for Catalyst to plan as a whole."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import compare, dotted, glob_regex, text_matches
from ..model import GraphHeap
from ..storage import stored
from .dominators import reached_from

#: Rounds of frontier joins after which reachability goes to the single-task kernel.
MAX_ROUNDS = 30
#: Disjoint intervals up to which RETAINED BY is a broadcast range join.
FEW_INTERVALS = 64
# fixed values: names of built-in sets and the classes they hold
CLASS_SETS = {
    "Threads": "java.lang.Thread", "ClassLoaders": "java.lang.ClassLoader", "SoftReferences": "java.lang.ref.SoftReference",
    "WeakReferences": "java.lang.ref.WeakReference", "PhantomReferences": "java.lang.ref.PhantomReference",
}


def class_ids(heap: GraphHeap, pattern: str) -> list[int]:
    """Classes of this name, all of them if loaders share one, or of a pattern with *."""
    regex = re.compile(glob_regex(pattern), re.DOTALL)
    return sorted(i for i, (name, _) in heap.class_tree.items() if regex.match(dotted(name or "")))


def with_subclasses(heap: GraphHeap, seeds: list[int]) -> list[int]:
    found, known = set(seeds), heap.class_tree
    while more := {i for i, (_, up) in known.items() if up in found and i not in found}:
        found |= more
    return sorted(found)


def instances(heap: GraphHeap, classes: list[int]) -> DataFrame:
    """Objects of these classes; class objects are not instances of what they describe."""
    return heap.objects.filter(F.col("class_id").isin(classes) & (F.col("kind") != "class")).select("id") if classes else heap.empty_ids()


def built_in(heap: GraphHeap, name: str) -> DataFrame | None:
    if name in CLASS_SETS:
        return instances(heap, class_ids(heap, CLASS_SETS[name]))
    if name == "GcRoots":
        return heap.gc_roots.select("id").distinct()
    if name == "Unreachable":
        return heap.dom.filter(F.col("pre").isNull()).select("id")
    return None


def of_ids(heap: GraphHeap, ids: tuple[int, ...]) -> DataFrame:
    """These objects; numbers that no object has give nothing."""
    return heap.objects.filter(F.col("id").isin(list(ids))).select("id") if ids else heap.empty_ids()


def within(ids: DataFrame, other: DataFrame) -> DataFrame:
    return ids.join(other, "id", "left_semi")


def without(ids: DataFrame, other: DataFrame) -> DataFrame:
    return ids.join(other, "id", "left_anti")


def by_size(heap: GraphHeap, ids: DataFrame, column: str, test) -> DataFrame:
    """column: retained or shallow."""
    table = heap.dom if column == "retained" else heap.objects
    return within(ids, table.filter(test(F.col(column))).select("id"))


def intervals(heap: GraphHeap, owners: DataFrame) -> DataFrame:
    """Disjoint preorder intervals (low, high) that the owners' subtrees cover: the outermost subtrees."""
    own = heap.dom.filter(F.col("pre").isNotNull()).join(owners, "id", "left_semi").select("id", "pre", (F.col("pre") + F.col("subtree") - 1).alias("high"))
    return _outermost(own)


def _outermost(own: DataFrame) -> DataFrame:
    """Owners that lie in no other owner's interval: dominator subtrees are nested or apart.

    The running maximum of earlier ends is taken in ranges of the preorder: within each range by
    a window, and across ranges by the ranges' own maxima, so no window sees all owners.
    """
    width = 1 << 20
    ranged = own.withColumn("range", F.floor(F.col("pre") / width))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each range of a million numbers
    carried = ranged.groupBy("range").agg(F.max("high").alias("top")).select("range", F.max("top").over(before).alias("carried"))
    inner = Window.partitionBy("range").orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.greatest(F.max("high").over(inner), F.col("carried"))
    marked = ranged.join(carried, "range").withColumn("seen", seen)
    return marked.filter(F.col("seen").isNull() | (F.col("seen") < F.col("pre"))).select(F.col("pre").alias("low"), "high")


def retained_by(heap: GraphHeap, ids: DataFrame, owners: DataFrame) -> DataFrame:
    """Ids in the dominator subtrees of the owners, and the owners themselves."""
    ranges = stored(intervals(heap, owners), "intervals")
    points = heap.dom.filter(F.col("pre").isNotNull()).join(ids, "id", "left_semi").select("id", "pre")
    if ranges.count() <= FEW_INTERVALS:
        found = points.join(F.broadcast(ranges), (F.col("pre") >= F.col("low")) & (F.col("pre") <= F.col("high")), "left_semi").select("id")
    else:
        found = _in_ranges(points, ranges)
    return within(ids, found.union(within(ids, owners)).distinct())


def _in_ranges(points: DataFrame, ranges: DataFrame) -> DataFrame:
    """Points in disjoint ranges, by equi-joins on pieces of the number line."""
    width = 1 << 16
    pieces = ranges.select("low", "high", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor(F.col("high") / width))).alias("piece"))
    near = points.withColumn("piece", F.floor(F.col("pre") / width)).join(pieces, "piece")
    return near.filter((F.col("pre") >= F.col("low")) & (F.col("pre") <= F.col("high"))).select("id")


def referencing(heap: GraphHeap, ids: DataFrame, targets: DataFrame, label: str = "") -> DataFrame:
    edges = heap.edges.filter(F.col("label") == label) if label else heap.edges
    hit = edges.join(targets.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id"))
    return within(ids, hit)


def referenced_by(heap: GraphHeap, ids: DataFrame, sources: DataFrame) -> DataFrame:
    hit = heap.edges.join(sources.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id"))
    return within(ids, hit)


def follow(heap: GraphHeap, ids: DataFrame, label: str) -> DataFrame:
    """What the set refers to through a field."""
    hit = heap.edges.filter(F.col("label") == label).join(ids.withColumnRenamed("id", "src"), "src", "left_semi")
    return hit.select(F.col("dst").alias("id")).distinct()


def unfollow(heap: GraphHeap, ids: DataFrame, label: str, owners: DataFrame) -> DataFrame:
    """Owners that refer to the set through a field."""
    return referencing(heap, owners, ids, label)


def closure(heap: GraphHeap, seeds: DataFrame) -> DataFrame:
    """Everything reached from the seeds, seeds included.

    Each round joins the frontier with the references and leaves out what earlier rounds have
    written; it writes only what is new, so rounds are not run again. A graph that is deeper than MAX_ROUNDS goes on in the kernel.
    """
    seen = front = stored(within(heap.ids(), seeds), "reached")
    for _ in range(MAX_ROUNDS):
        hop = heap.edges.join(front.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
        front = stored(hop.join(seen, "id", "left_anti"), "reached")
        if front.isEmpty():
            return seen
        seen = seen.union(front)
    return reached_from(heap, seen)


def reachable_from(heap: GraphHeap, ids: DataFrame, seeds: DataFrame) -> DataFrame:
    return within(ids, closure(heap, seeds))


def field_rows(heap: GraphHeap, classes: list[int], name: str, text: bool) -> DataFrame:
    """The rows of the first field of that name, most derived class first; objects do not count as numbers."""
    rows = heap.fields(classes, name)
    rows = rows.filter((F.col("type_code") == 2) if text else (F.col("type_code") != 2))
    described = heap.class_fields.filter((F.col("name") == name) & F.col("class_id").isin(classes))
    described = described.filter((F.col("type_code") == 2) if text else (F.col("type_code") != 2))
    first = {r.class_id: r.ordinal for r in described.groupBy("class_id").agg(F.min("ordinal").alias("ordinal")).collect()}
    if not first:
        raise ValueError(f"No field {name} in the context's classes")
    test: Column = F.lit(False)
    for ordinal in sorted(set(first.values())):
        test = test | ((F.col("ordinal") == ordinal) & F.col("class_id").isin([c for c, o in first.items() if o == ordinal]))
    return rows.filter(test)


def where_number(heap: GraphHeap, ids: DataFrame, classes: list[int], name: str, op: str, value: float) -> DataFrame:
    """Typed comparison: floats and doubles as such, the others as whole numbers."""
    rows = field_rows(heap, classes, name, text=False)
    whole = compare(F.col("long_val"), op, F.lit(value))
    test = F.when(F.col("type_code").isin(6, 7), compare(F.col("double_val"), op, F.lit(float(value)))).otherwise(whole)
    return within(ids, rows.filter(test).select("id"))


def where_text(heap: GraphHeap, ids: DataFrame, classes: list[int], name: str, kind: str, value: str) -> DataFrame:
    """Comparison with the whole text, however long."""
    rows = field_rows(heap, classes, name, text=True)
    direct = rows.filter(text_matches(F.col("string_val"), kind, value)).select("id")
    texts = heap.string_values.filter(text_matches(F.col("value"), kind, value)).select(F.col("id").alias("ref_id"))
    return within(ids, direct.union(rows.join(texts, "ref_id", "left_semi").select("id")))


def duplicates(heap: GraphHeap, ids: DataFrame, classes: list[int], name: str) -> DataFrame:
    """Members whose field has a value that another member has too."""
    try:
        rows = field_rows(heap, classes, name, text=False)
    except ValueError:
        rows = field_rows(heap, classes, name, text=True)
    rows = within(rows, ids).join(heap.string_values.select(F.col("id").alias("ref_id"), "value"), "ref_id", "left")
    value = F.coalesce("string_val", "value", F.col("double_val").cast("string"), F.col("long_val").cast("string"))
    rows = rows.select("id", value.alias("value")).filter("value is not null")
    many = rows.groupBy("value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return rows.join(many, "value", "left_semi").select("id")
