"""An object graph over the relational tables region .. lineitem.

Owners refer to what they own; regions and small parts are roots. Ids are BASE * class + key, so
they need no shuffle; line items, whose keys repeat, are numbered within a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import shallow_size
from ..model import CLASS_FIELDS, CLASSES, PRIM_ARRAYS, STRINGS, GraphHeap
from ..storage import stored

BASE = 10**15
ROOT_PART_SIZE = 10
PACKAGE = "shop."
#: name -> (class id, superclass)
TREE = {
    "Object": (10, None), "Entity": (9, "Object"), "Party": (8, "Entity"), "Region": (1, "Entity"), "Nation": (2, "Entity"), "Supplier": (3, "Party"),
    "Customer": (4, "Party"), "Part": (5, "Entity"), "Order": (6, "Entity"), "LineItem": (7, "Entity"),
}
SOURCES = {
    "Region": ("region", "r_regionkey"), "Nation": ("nation", "n_nationkey"), "Supplier": ("supplier", "s_suppkey"), "Customer": ("customer", "c_custkey"),
    "Part": ("part", "p_partkey"), "Order": ("orders", "o_orderkey"), "LineItem": ("lineitem", None),
}
SIZES = {"Region": "16", "Nation": "24", "Supplier": "40", "Customer": "40", "Part": "8 * p_size", "Order": "48", "LineItem": "16 + 8 * cast(l_quantity as bigint)"}
#: owner, owned, column of the owned that holds the owner's key
OWNS = (
    ("Region", "Nation", "n_regionkey"), ("Nation", "Supplier", "s_nationkey"), ("Nation", "Customer", "c_nationkey"), ("Customer", "Order", "o_custkey"),
    ("Order", "LineItem", "l_orderkey"), ("Supplier", "LineItem", "l_suppkey"), ("Part", "LineItem", "l_partkey"),
)
#: numeric and string fields that can be asked for
FIELDS = {
    "Region": ["r_regionkey", "r_name"], "Nation": ["n_nationkey", "n_regionkey", "n_name"], "Supplier": ["s_suppkey", "s_nationkey", "s_acctbal", "s_name"],
    "Customer": ["c_custkey", "c_nationkey", "c_acctbal", "c_name", "c_mktsegment"], "Part": ["p_partkey", "p_size", "p_retailprice", "p_name", "p_brand", "p_type"],
    "Order": ["o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority"],
    "LineItem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "isLarge", "l_returnflag"],
}
CODES = {"int": 10, "bigint": 11, "double": 7, "boolean": 4, "string": 2}


def rows_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The rows of a class with their ids."""
    file, key = SOURCES[name]
    rows = spark.read.parquet(f"{sf_dir}/{file}.parquet")
    number = F.lit(TREE[name][0] * BASE)
    if key:
        return rows.withColumn("id", number + F.col(key))
    rest = [c for c in rows.columns if c not in ("l_orderkey", "l_linenumber")]
    again = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy(*rest))
    return rows.withColumn("isLarge", F.col("l_quantity") > 25).withColumn("id", number + F.col("l_orderkey") * 10_000 + F.col("l_linenumber") * 100 + again)


def relational_heap(spark: SparkSession, sf_dir: str) -> GraphHeap:
    """The graph of the tables in a folder: objects and references are written as tables, fields stay columns of theirs."""
    rows = {name: rows_of(spark, sf_dir, name) for name in SOURCES}
    rows["LineItem"] = stored(rows["LineItem"], "line-items")
    union = lambda parts: _union(list(parts))
    objects = union(
        df.select("id", F.lit(TREE[n][0]).cast("long").alias("class_id"), F.lit("instance").alias("kind"), F.lit(None).cast("int").alias("elem_type"), F.lit(None).cast("int").alias("length"),
                  shallow_size(F.expr(SIZES[n]).cast("long")).alias("shallow"))
        for n, df in rows.items()
    )
    classes = spark.createDataFrame([(i, PACKAGE + n, TREE[s][0] if s else None, None, None) for n, (i, s) in TREE.items()], CLASSES)
    edges = union(
        rows[owned].select((F.lit(TREE[owner][0] * BASE) + F.col(key)).alias("src"), F.lit(k).alias("ord"), F.col("id").alias("dst"), F.lit(SOURCES[owned][0]).alias("label"),
                           F.lit(None).cast("int").alias("slot"), F.lit("field").alias("kind"))
        for k, (owner, owned, key) in enumerate(OWNS)
    )
    small = rows["Part"].filter(F.col("p_size") <= ROOT_PART_SIZE)
    roots = union(df.select("id", F.lit(t).alias("root_type"), F.lit(0).cast("long").alias("ord")) for df, t in ((rows["Region"], 5), (small, 1)))
    described, values = [], {}
    for name, names in FIELDS.items():
        kinds = dict(rows[name].dtypes)
        for k, own in enumerate(names):
            code = CODES[kinds[own]]
            described.append((TREE[name][0], k, TREE[name][0], own, code))
            values[TREE[name][0], own] = _field(rows[name], TREE[name][0], k, own, code)
    return GraphHeap(
        spark, stored(objects, "objects"), classes, spark.createDataFrame(described, CLASS_FIELDS), stored(edges, "edges"), roots, union(values.values()),
        spark.createDataFrame([], PRIM_ARRAYS), spark.createDataFrame([], STRINGS), values,
    )


def _field(rows: DataFrame, class_id: int, ordinal: int, name: str, code: int) -> DataFrame:
    """One field in the long form; a filter on its name prunes the other fields' branches."""
    none = lambda t: F.lit(None).cast(t)
    value: Column = F.col(name)
    return rows.select(
        "id", F.lit(class_id).cast("long").alias("class_id"), F.lit(ordinal).alias("ordinal"), F.lit(name).alias("name"), F.lit(code).alias("type_code"),
        (value.cast("long") if code in (4, 10, 11) else none("long")).alias("long_val"), (value if code == 7 else none("double")).alias("double_val"),
        none("long").alias("ref_id"), (value if code == 2 else none("string")).alias("string_val"),
    )


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


_HEAPS: dict[tuple[str, str], GraphHeap] = {}


def heap_of(spark: SparkSession, sf_dir: str) -> GraphHeap:
    """relational_heap, kept for the application: its dominator table is made once."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _HEAPS:
        _HEAPS[key] = relational_heap(spark, sf_dir)
    return _HEAPS[key]
