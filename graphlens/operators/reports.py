"""Rankings, aggregates and inspections: small tables made after the limit, so joins stay small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import TYPE_SIZES, decoded, primitive_text, root_label, shown, type_name
from ..model import GraphHeap
from .sets import class_ids

#: Elements of a primitive array that INSPECT shows (the feature's own limit).
SHOWN_ELEMENTS = 100
SIZE_COLUMNS = {"retainedSize": "retained", "shallowSize": "shallow"}


def sized(heap: GraphHeap, ids: DataFrame) -> DataFrame:
    """ids with class_id, kind, retained and shallow."""
    return heap.objects.join(ids, "id", "left_semi").join(heap.dom.select("id", "retained"), "id").select("id", "class_id", "kind", "retained", "shallow")


def described(heap: GraphHeap, rows: DataFrame, suffix: str = "") -> DataFrame:
    """rows (id, class_id, kind, ...) with type and description: what a class, string or thread is called."""
    names = heap.classes.select("class_id", "name")
    text = heap.string_values.select("id", shown(F.col("value")).alias("text"))
    via = heap.field_values.filter((F.col("name") == "name") & F.col("ref_id").isNotNull()).select("id", "class_id", "ref_id")
    threads = class_ids(heap, "java.lang.Thread")
    via = via.filter(F.col("class_id").isin(threads)) if threads else via.filter(F.lit(False))
    via = via.join(heap.string_values.select(F.col("id").alias("ref_id"), shown(F.col("value")).alias("thread")), "ref_id").select("id", "thread")
    own = names.select(F.col("class_id").alias("id"), F.concat("name", F.lit(suffix)).alias("represents"))
    out = rows.join(names.withColumnRenamed("name", "type"), "class_id", "left").join(text, "id", "left").join(via, "id", "left").join(own, "id", "left")
    represents = F.when(F.col("kind") == "class", F.col("represents"))
    return out.withColumn("description", F.coalesce(represents, "text", "thread")).drop("text", "thread", "represents")


def top(heap: GraphHeap, ids: DataFrame, n: int, by: str = "retainedSize", *, smallest: bool = False) -> DataFrame:
    """rank (from 1), id, type, retainedSize, shallowSize, description of the n largest; ties by id."""
    key = F.col(SIZE_COLUMNS[by])
    order = [key.asc() if smallest else key.desc(), F.col("id")]
    rows = sized(heap, ids).orderBy(*order).limit(n)
    return ranked(heap, rows, order)


def ranked(heap: GraphHeap, rows: DataFrame, order: list[Column]) -> DataFrame:
    rows = rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    return described(heap, rows).select(
        "rank", "id", "type", F.col("retained").alias("retainedSize"), F.col("shallow").alias("shallowSize"), "description"
    ).orderBy("rank")


def sample(heap: GraphHeap, ids: DataFrame, n: int, seed: int | None = None) -> DataFrame:
    """n members, each set of n equally likely; all members if there are fewer."""
    rows = sized(heap, ids).withColumn("draw", F.rand(seed) if seed is not None else F.rand()).orderBy("draw").limit(n)
    return ranked(heap, rows, [F.col("draw")])


def count(ids: DataFrame) -> DataFrame:
    return ids.agg(F.count(F.lit(1)).alias("count"))


def aggregate(heap: GraphHeap, ids: DataFrame, func: str, by: str = "retainedSize") -> DataFrame:
    """sum or max of a size over the set, 0 for an empty set; nested retained sizes count twice in a sum."""
    column = SIZE_COLUMNS[by]
    value = F.sum(column) if func == "sum" else F.max(column)
    return sized(heap, ids).agg(F.coalesce(value, F.lit(0)).cast("long").alias(by))


def by_class(heap: GraphHeap, ids: DataFrame, n: int | None = None) -> DataFrame:
    """Per class: number, shallow and retained bytes; largest retained first."""
    rows = sized(heap, ids).groupBy("class_id").agg(F.count(F.lit(1)).alias("n"), F.sum("shallow").alias("shallowSize"), F.sum("retained").alias("retainedSize"))
    rows = rows.join(heap.classes.select("class_id", F.col("name").alias("type")), "class_id", "left").select("type", "n", "shallowSize", "retainedSize")
    rows = rows.orderBy(F.desc("retainedSize"), "type")
    return rows if n is None else rows.limit(n)


def summary(heap: GraphHeap) -> DataFrame:
    rows = heap.objects.join(heap.dom.select("id", F.col("pre").isNotNull().alias("reached")), "id")
    reached, lost = F.col("reached"), ~F.col("reached")
    total = lambda test: F.coalesce(F.sum(F.when(test, F.col("shallow"))), F.lit(0)).cast("long")
    sums = rows.agg(
        F.count(F.lit(1)).alias("objectCount"), F.count_if(reached).alias("reachableCount"), F.count_if(lost).alias("unreachableCount"),
        total(reached).alias("reachableBytes"), total(lost).alias("unreachableBytes"),
    )
    return sums.crossJoin(heap.classes.agg(F.count(F.lit(1)).alias("classCount")))  # one row each


def class_counts(heap: GraphHeap, pattern: str) -> DataFrame:
    """Instances of each class of the pattern, classes without any included; most first, then by name."""
    wanted = heap.classes.filter(F.col("class_id").isin(class_ids(heap, pattern)))
    n = heap.objects.filter("kind != 'class'").groupBy("class_id").agg(F.count(F.lit(1)).alias("n"))
    rows = wanted.join(n, "class_id", "left").select(F.col("class_id").alias("id"), F.col("name").alias("className"), F.coalesce("n", F.lit(0)).alias("instanceCount"))
    return rows.orderBy(F.desc("instanceCount"), "className", "id")


def histogram(heap: GraphHeap, n: int = 50) -> DataFrame:
    """Instances and object arrays per class; primitive arrays are not counted."""
    rows = heap.objects.filter(F.col("kind").isin("instance", "objarray")).groupBy("class_id").agg(F.count(F.lit(1)).alias("instanceCount"))
    name = F.coalesce("name", F.concat(F.lit("<unknown@"), F.col("class_id"), F.lit(">")))
    rows = rows.join(heap.classes.select("class_id", "name"), "class_id", "left").select(name.alias("className"), "instanceCount")
    return rows.orderBy(F.desc("instanceCount"), "className").limit(n)


def explain(heap: GraphHeap, target: int) -> DataFrame:
    """The chain of dominators of an object, itself first (depth 0): why it is alive.

    field names what in the dominator refers to the node before it, `(indirect)` if nothing does
    so directly; null for the object itself. The chain is an interval test on preorder numbers.
    """
    own = heap.dom.filter(F.col("id") == target).select(F.col("pre").alias("at"))
    chain = heap.dom.join(F.broadcast(own), (F.col("pre") <= F.col("at")) & (F.col("at") < F.col("pre") + F.col("subtree")))  # one row
    alone = heap.dom.filter((F.col("id") == target) & F.col("pre").isNull())
    chain = chain.select("id", "retained", F.col("depth").alias("level")).union(alone.select("id", "retained", F.lit(None).cast("int")))
    order = Window.orderBy(F.desc("level"))
    chain = chain.withColumn("depth", F.row_number().over(order) - 1).withColumn("before", F.lag("id").over(order))
    label = F.when(F.col("kind") == "element", F.concat(F.lit("["), F.col("slot"), F.lit("]"))).otherwise(F.col("label"))
    links = heap.edges.select(F.col("src").alias("id"), F.col("dst").alias("before"), F.struct("ord", label.alias("label")).alias("edge"))
    links = links.join(chain.select("id", "before"), ["id", "before"]).groupBy("id", "before").agg(F.min("edge").alias("edge"))
    roots = heap.gc_roots.groupBy("id").agg(F.min(F.struct("ord", "root_type")).alias("root"))
    rows = chain.join(links, ["id", "before"], "left").join(roots, "id", "left").join(heap.objects.select("id", "class_id", "kind"), "id")
    field = F.when(F.col("before").isNull(), F.lit(None).cast("string")).otherwise(F.coalesce("edge.label", F.lit("(indirect)")))
    note = F.when(F.col("level").isNull(), "not reachable from any GC root").when(F.col("root").isNotNull(), root_label(F.col("root.root_type")))
    rows = described(heap, rows.withColumn("field", field).withColumn("notes", note), ".class")
    return rows.select("depth", "id", "type", "field", F.col("retained").alias("retainedSize"), "description", "notes").orderBy("depth")


def inspect(heap: GraphHeap, target: int) -> DataFrame:
    """The fields or elements of an object: field, value (primitives), type, ref (its id), sizes, description."""
    own = heap.objects.filter(F.col("id") == target)
    found = own.join(heap.classes.select("class_id", "name"), "class_id", "left").select("kind", "elem_type", "name").first()
    none = lambda t: F.lit(None).cast(t)
    if found is None:
        rows = heap.objects.filter(F.lit(False)).select(F.lit(0).alias("at"), F.lit("").alias("field"), none("string").alias("value"), none("string").alias("prim"), none("long").alias("ref"))
    elif found.kind == "class":
        rows = heap.classes.filter(F.col("class_id") == target).select(F.lit(0).alias("at"), F.lit("class").alias("field"), F.col("name").alias("value"), none("string").alias("prim"), none("long").alias("ref"))
    elif found.kind == "objarray":
        rows = heap.edges.filter((F.col("src") == target) & (F.col("kind") == "element"))
        rows = rows.select(F.col("slot").alias("at"), F.concat(F.lit("["), "slot", F.lit("]")).alias("field"), none("string").alias("value"), none("string").alias("prim"), F.col("dst").alias("ref"))
    elif found.kind == "primarray":
        size = TYPE_SIZES[found.elem_type]
        part = F.transform(F.sequence(F.lit(0), F.least(F.col("n"), F.lit(SHOWN_ELEMENTS)) - 1), lambda i: F.substring("data", i * size + 1, F.lit(size)))
        rows = heap.prim_arrays.filter((F.col("id") == target) & (F.col("n") > 0)).select(F.posexplode(part).alias("at", "raw"))
        rows = rows.select("at", F.concat(F.lit("["), "at", F.lit("]")).alias("field"), element_text("raw", found.elem_type).alias("value"), type_name(F.lit(found.elem_type)).alias("prim"), none("long").alias("ref"))
    else:
        rows = heap.field_values.filter(F.col("id") == target)
        value = F.when(F.col("type_code") == 2, F.col("string_val")).otherwise(primitive_text(F.col("type_code"), F.col("long_val"), F.col("double_val")))
        rows = rows.select(F.col("ordinal").alias("at"), F.col("name").alias("field"), value.alias("value"), F.when(F.col("type_code") != 2, type_name(F.col("type_code"))).alias("prim"), F.col("ref_id").alias("ref"))
    refs = heap.objects.select(F.col("id").alias("ref"), "class_id", "kind", "shallow").join(heap.dom.select(F.col("id").alias("ref"), "retained"), "ref")
    rows = rows.join(refs, "ref", "left").withColumn("id", F.col("ref"))
    rows = described(heap, rows, ".class")
    return rows.select("at", "field", "value", F.coalesce("prim", "type").alias("type"), "ref", F.col("retained").alias("retainedSize"), F.col("shallow").alias("shallowSize"), "description").orderBy("at")


def element_text(raw: str, elem_type: int) -> Column:
    """A big-endian element for display."""
    if elem_type in (6, 7):
        return floating(raw, elem_type).cast("string")
    size = TYPE_SIZES[elem_type]
    number = F.conv(F.hex(raw), 16, 10).cast("decimal(20,0)")
    if elem_type in (8, 9, 10, 11):
        number = F.when(number >= whole(8 * size - 1), number - whole(8 * size)).otherwise(number)
    return primitive_text(F.lit(elem_type), number.cast("long"), F.lit(None).cast("double"))


def whole(power: int) -> Column:
    """A power of two beyond the range of a long."""
    return F.lit(str(2**power)).cast("decimal(20,0)")


def floating(raw: str, elem_type: int) -> Column:
    """The number of a big-endian IEEE 754 element, from its sign, exponent and fraction."""
    bits, wide, kind = (32, 23, "float") if elem_type == 6 else (64, 52, "double")
    number = F.conv(F.hex(raw), 16, 10).cast("decimal(20,0)")
    signed = F.when(number >= whole(bits - 1), number - whole(bits)).otherwise(number).cast("long")
    top = (1 << (bits - 1 - wide)) - 1
    exponent, fraction = F.shiftright(signed, wide).bitwiseAND(F.lit(top)), signed.bitwiseAND(F.lit((1 << wide) - 1)).cast("double")
    # powers of two are exact; the smallest exponent stands for numbers without a leading one
    scale = F.pow(F.lit(2.0), (F.greatest(exponent, F.lit(1)) - top // 2).cast("double"))
    size = scale * (F.when(exponent > 0, 1.0).otherwise(0.0) + fraction / float(1 << wide))
    size = F.when(exponent == top, F.when(fraction == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))).otherwise(size)
    return F.when(signed < 0, -size).otherwise(size).cast(kind)


def read(heap: GraphHeap, target: int) -> DataFrame:
    """The whole text of a string, byte[] or char[], or what it is instead; one row, none for no object."""
    own = heap.objects.filter(F.col("id") == target).select("id", "kind", "elem_type")
    arrays = heap.prim_arrays.select("id", decoded(F.col("data"), F.col("elem_type")).alias("array"), "n")
    rows = own.join(heap.string_values, "id", "left").join(arrays, "id", "left")
    other = F.concat(F.lit("("), type_name(F.col("elem_type")), F.lit("[]: INSPECT shows its elements)"))
    text = (
        F.when(F.col("value").isNotNull(), F.col("value")).when(F.col("kind") != "primarray", "(not a String or byte[]/char[])")
        .when(~F.col("elem_type").isin(5, 8), other).when(F.coalesce("n", F.lit(0)) == 0, "(empty)").otherwise(F.col("array"))
    )
    return rows.select("id", F.when(F.length(text) == 0, "(empty)").otherwise(text).alias("content"))


