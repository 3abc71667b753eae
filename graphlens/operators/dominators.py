"""The dominator table of a GraphHeap.

Objects that refer to nothing are taken off, then those that refer only to such, and so on, by
joins: a layer's immediate dominators are nearest common ancestors of its predecessors, which all
lie in later layers. What is left, the core of cycles and what leads to them, goes to the kernel
in one Arrow task; small graphs go there whole. Sizes then go up the layers, preorder numbers down.
"""

from __future__ import annotations

import uuid
from functools import reduce
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import discard, stored
from . import kernel

if TYPE_CHECKING:
    from ..model import GraphHeap

#: Objects and references of a graph that goes to the kernel whole.
SMALL = 400_000
#: Objects left at which no more layers are taken off; layers at most; share of the rest that a layer must have.
CORE, MAX_LAYERS, LEAST_SHARE = 100_000, 30, 0.05
#: Children of one dominator that are numbered by one task.
FAMILY = 200_000
ROWS = "id bigint, idom bigint, pre bigint, subtree bigint, depth int, retained bigint"


def dense(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids (sorted), sizes, references as positions, and positions of the marked ids."""
    kind, a, b = (table.column(c).to_numpy() for c in ("kind", "a", "b"))
    ids, first = np.unique(a[kind == 0], return_index=True)
    shallow = b[kind == 0][first]
    at = lambda x: np.searchsorted(ids, x)
    known = lambda x: (at(x) < len(ids)) & (ids[np.minimum(at(x), len(ids) - 1)] == x) if len(ids) else np.zeros(len(x), bool)
    src, dst = a[kind == 1], b[kind == 1]
    both = known(src) & known(dst)
    marked = a[kind == 2]
    marked = marked[known(marked)]
    return ids, shallow, at(src[both]), at(dst[both]), np.unique(at(marked))


def tagged(heap: GraphHeap, marked: DataFrame, sizes: bool = True) -> DataFrame:
    """One narrow table of objects (0), references (1) and marked ids (2)."""
    return _tagged(heap.objects.select("id", "shallow" if sizes else F.lit(0).alias("shallow")), heap.edges, marked)


def _tagged(objects: DataFrame, edges: DataFrame, marked: DataFrame) -> DataFrame:
    row = lambda df, k, a, b: df.select(F.lit(k).cast("byte").alias("kind"), F.col(a).alias("a"), b.cast("long").alias("b"))
    return row(objects, 0, "id", F.col("shallow")).unionByName(row(edges, 1, "src", F.col("dst"))).unionByName(row(marked, 2, "id", F.lit(0)))


def dominator_table(heap: GraphHeap) -> DataFrame:
    """idom (null: the super-root or unreachable), pre, subtree, depth (null if unreachable), retained, rank.

    Every root hangs from the super-root, whatever else refers to it. An unreachable object
    retains itself. rank 0 is the largest retained size, ties by id.
    """
    if heap.objects.count() + heap.edges.count() > SMALL:
        return _by_layers(heap)
    from ..model import DOM

    def run(table: pa.Table) -> pa.Table:
        ids, shallow, src, dst, roots = dense(table)
        idom, order = kernel.dominators(len(ids), src, dst, roots)
        found = kernel.tree(idom, order, shallow)
        rank = np.empty(len(ids), np.int64)
        rank[np.lexsort((ids, -found["retained"]))] = np.arange(len(ids))
        lost = idom == kernel.UNREACHED
        column = lambda x, none=lost: pa.array(x, pa.int64(), mask=none)
        return pa.table({
            "id": pa.array(ids, pa.int64()), "idom": column(ids[np.maximum(idom, 0)] if len(ids) else ids, idom < 0), "pre": column(found["pre"]), "subtree": column(found["subtree"]),
            "depth": column(found["depth"]).cast(pa.int32()), "retained": pa.array(found["retained"], pa.int64()), "rank": pa.array(rank, pa.int64()),
        })

    rows = tagged(heap, heap.gc_roots).groupBy(F.lit(0).alias("all")).applyInArrow(run, DOM)
    return stored(rows, "dom")


def _search(table: pa.Table) -> pa.Table:
    """The core's reached objects in an order in which each comes after its dominator, with their labels."""
    ids, shallow, src, dst, roots = dense(table)
    idom, order = kernel.dominators(len(ids), src, dst, roots)
    depth = kernel.tree(idom, order, shallow)["depth"]
    sizes, values = kernel.labels(idom, order, depth)
    is_id = np.arange(len(values)) % 3 != 1
    values[is_id] = ids[values[is_id]]
    up = idom[order]
    return pa.table({
        "at": pa.array(np.arange(len(order)), pa.int64()), "id": pa.array(ids[order], pa.int64()), "idom": pa.array(ids[np.maximum(up, 0)], pa.int64(), mask=up < 0),
        "label": pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(values, pa.int64())), "core": pa.array(sizes, pa.int32()),
    })


def _settle(table: pa.Table) -> pa.Table:
    """The core's part of the table, with sizes that have come up to it, and where its later children begin."""
    table = table.sort_by("at")
    ids, sizes, counts = (table.column(c).to_numpy() for c in ("id", "shallow", "n"))
    by = np.argsort(ids)
    none = table.column("idom").is_null().to_numpy()
    above = table.column("idom").fill_null(0).to_numpy()
    idom = np.where(none, kernel.SUPER, by[np.minimum(np.searchsorted(ids, above, sorter=by), len(ids) - 1)])
    found = kernel.tree(idom, np.arange(len(ids)), sizes, counts)
    return pa.table({"id": table.column("id"), "idom": table.column("idom")} | {k: pa.array(found[k], pa.int32() if k == "depth" else pa.int64()) for k in ("pre", "subtree", "depth", "retained", "free")})


def _owners(members: DataFrame, edges: DataFrame, known: DataFrame, roots: DataFrame) -> DataFrame:
    """members (id, shallow) with idom, label, core and lost, all whose predecessors that are reached are known.

    A label is the way down from the super-root: core numbers for the chains of the core, then one
    id for each layer. In the order of labels, the least and the greatest part where all part.
    """
    met = edges.join(known.select(F.col("id").alias("src"), "label", "core"), "src").groupBy(F.col("dst").alias("id"))
    met = met.agg(F.min("label").alias("a"), F.max("label").alias("b"), F.max("core").alias("core"))
    rows = members.join(met, "id", "left").join(roots.withColumn("root", F.lit(True)), "id", "left")
    # common numbers; those that part on one chain of the core part at the upper one's exit
    same = F.array_position(F.zip_with("a", "b", lambda x, y: x.eqNullSafe(y)), False).cast("int") - 1
    rows = rows.withColumn("same", F.when(same < 0, F.size("a")).otherwise(same))
    on_chain = (F.col("same") % 3 == 1) & (F.col("core") > F.col("same"))
    shared = F.slice("a", F.lit(1), F.col("same") + F.when(on_chain, 2).otherwise(0))
    rows = rows.withColumn("way", F.when(F.col("root").isNull(), shared).otherwise(F.array().cast("array<bigint>")))
    return rows.select(
        "id", "shallow", F.get("way", F.size("way") - 1).alias("idom"), F.concat("way", F.array("id")).alias("label"),
        F.when(F.col("root").isNull(), F.least("core", F.size("way"))).otherwise(0).alias("core"), F.col("way").isNull().alias("lost"),
    )


def _by_layers(heap: GraphHeap) -> DataFrame:
    folder = f"dominators-{uuid.uuid4().hex}"
    keep = lambda df, name: stored(df, f"{folder}/{name}")
    only = lambda df, ids, column="id", how="left_semi": df.join(ids.select(F.col("id").alias(column)), column, how)
    sources = lambda edges: edges.select(F.col("src").alias("id")).distinct()
    union = lambda parts: reduce(DataFrame.unionByName, parts)

    objects = heap.objects.groupBy("id").agg(F.min("shallow").alias("shallow"))
    every = heap.edges.select("src", "dst")
    roots = keep(heap.gc_roots.select("id").distinct(), "roots")
    rest = inner = keep(only(objects, sources(every)), "inner")
    edges = among = keep(only(only(every, inner, "dst"), inner, "src"), "edges")
    layers: list[DataFrame] = []
    left = inner.count()
    while left > CORE and len(layers) < MAX_LAYERS:
        above = keep(only(rest, sources(edges)), "above")
        n = above.count()
        if left - n < LEAST_SHARE * left:
            break
        layers.append(keep(only(rest, above, how="left_anti"), "layer"))
        edges = keep(only(edges, above, "dst"), "edges")
        rest, left = above, n

    # immediate dominators, from the core outwards
    one_task = lambda df, run, schema: df.groupBy(F.lit(0).alias("all")).applyInArrow(run, schema)
    found = keep(one_task(_tagged(rest, edges, roots), _search, "at bigint, id bigint, idom bigint, label array<bigint>, core int"), "core")
    known, owned = found.select("id", "label", "core"), []
    for layer in reversed(layers):
        owned.insert(0, keep(_owners(layer, only(among, layer, "dst"), known, roots), "owned"))
        known = known.unionByName(owned[0].filter("not lost").select("id", "label", "core"))
    sinks = keep(_owners(only(objects, inner, how="left_anti"), every, known, roots).select("id", "shallow", "idom", "lost"), "sinks")

    # sizes, from the sinks inwards
    grown = [sinks.filter("not lost").select("id", "idom", F.col("shallow").alias("retained"), F.lit(1).cast("long").alias("subtree"))]
    families: list[DataFrame] = []
    for members in [*owned, None]:
        family = grown[-1].groupBy("idom").agg(F.sum("retained").alias("more"), F.sum("subtree").alias("under"), F.count(F.lit(1)).alias("children"))
        families.append(keep(family, "families"))
        given = union(families).filter("idom is not null").groupBy(F.col("idom").alias("id")).agg(F.sum("more").alias("more"), F.sum("under").alias("under"))
        if members is not None:
            rows = members.filter("not lost").join(given, "id", "left")
            grown.append(keep(rows.select("id", "idom", _plus("shallow", "more").alias("retained"), _plus(F.lit(1), "under").alias("subtree")), "grown"))
    rows = found.join(rest, "id").join(given, "id", "left").select("at", "id", "idom", _plus("shallow", "more").alias("shallow"), _plus(F.lit(1), "under").alias("n"))
    core = keep(one_task(rows, _settle, f"{ROWS}, free bigint"), "core")

    # preorder numbers, from the core outwards
    seated = keep(_seats(union(rows.withColumn("layer", F.lit(k)) for k, rows in enumerate(grown)), union(families), keep), "seated")
    first = core.filter("idom is null").agg(F.coalesce(F.sum("subtree"), F.lit(0))).first()[0]
    parents, parts = core.select("id", "free", "depth"), [core.drop("free")]
    for k in reversed(range(len(grown))):
        rows = seated.filter(F.col("layer") == k)
        # those of the super-root need no join, which would bring them together
        low = rows.filter("idom is not null").join(parents.withColumnRenamed("id", "idom"), "idom")
        high = rows.filter("idom is null").withColumn("free", F.lit(first)).withColumn("depth", F.lit(0))
        placed = low.unionByName(high).select("id", "idom", (F.col("free") + F.col("seat")).alias("pre"), "subtree", (F.col("depth") + 1).alias("depth"), "retained")
        if k:
            placed = keep(placed, "placed")
            parents = parents.unionByName(placed.select("id", (F.col("pre") + 1).alias("free"), "depth"))
        parts.append(placed)
    lost = union([sinks, *(x.select(sinks.columns) for x in owned)]).filter("lost").select("id", "shallow").unionByName(only(rest, found, how="left_anti"))
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    parts.append(lost.select("id", none("idom", "long"), none("pre", "long"), none("subtree", "long"), none("depth", "int"), F.col("shallow").alias("retained")))
    table = _ranked(keep(union(parts), "rows"), keep)
    discard(heap.spark, folder)
    return table


def _plus(base, more):
    return (F.col(base) if isinstance(base, str) else base) + F.coalesce(more, F.lit(0))


def _seats(rows: DataFrame, families: DataFrame, keep) -> DataFrame:
    """rows with seat: the objects under siblings that come before; large families are summed in parts."""
    large = families.groupBy("idom").agg(F.sum("children").alias("children")).filter(F.col("children") > FAMILY)
    large = keep(large.select(F.col("idom").alias("owner"), F.ceil(F.col("children") / FAMILY).alias("parts")), "large")
    rows = rows.join(F.broadcast(large), F.col("idom").eqNullSafe(F.col("owner")), "left").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))).drop("owner", "parts")
    before = Window.partitionBy("idom", "part").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = keep(rows.withColumn("seat", F.sum("subtree").over(before) - F.col("subtree")), "siblings")
    sums = rows.filter("part is not null").groupBy(F.col("idom").alias("owner"), F.col("part").alias("of")).agg(F.sum("subtree").alias("under"))
    earlier = Window.partitionBy("owner").orderBy("of").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("owner", "of", F.sum("under").over(earlier).alias("carried"))
    rows = rows.join(F.broadcast(sums), F.col("idom").eqNullSafe(F.col("owner")) & (F.col("part") == F.col("of")), "left")
    return rows.withColumn("seat", _plus("seat", "carried")).drop("owner", "of", "carried", "part")


def _ranked(rows: DataFrame, keep) -> DataFrame:
    """rows with rank: sorted in ranges, whose sizes are then summed."""
    order = [F.desc("retained"), F.col("id")]
    ranges = rows.repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    number = F.monotonically_increasing_id()
    ranges = keep(ranges.withColumn("number", number), "ranges").withColumn("range", F.shiftright("number", 33))
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each range
    sums = ranges.groupBy("range").agg(F.count(F.lit(1)).alias("n")).select("range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("carried"))
    rank = F.col("number").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("carried")
    return stored(ranges.join(F.broadcast(sums), "range").select(*rows.columns, rank.alias("rank")), "dom")


def reached_from(heap: GraphHeap, seeds: DataFrame) -> DataFrame:
    """Ids reached from the seeds along references, in one task: for deep graphs."""

    def run(table: pa.Table) -> pa.Table:
        ids, _, src, dst, marked = dense(table)
        return pa.table({"id": pa.array(ids[kernel.reachable(len(ids), src, dst, marked)], pa.int64())})

    return tagged(heap, seeds, sizes=False).groupBy(F.lit(0).alias("all")).applyInArrow(run, "id bigint")
