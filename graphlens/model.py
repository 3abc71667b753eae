"""The object graph as DataFrames, and its schemas."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OBJECTS = "id bigint, class_id bigint, kind string, elem_type int, length int, shallow bigint"
CLASSES = "class_id bigint, name string, super_id bigint, loader_id bigint, instance_size int"
CLASS_FIELDS = "class_id bigint, ordinal int, declaring_class_id bigint, name string, type_code int"
EDGES = "src bigint, ord int, dst bigint, label string, slot int, kind string"
GC_ROOTS = "id bigint, root_type int, ord bigint"
FIELD_VALUES = "id bigint, class_id bigint, ordinal int, name string, type_code int, long_val bigint, double_val double, ref_id bigint, string_val string"
PRIM_ARRAYS = "id bigint, elem_type int, n int, data binary"
STRINGS = "id bigint, value string"
DOM = "id bigint, idom bigint, pre bigint, subtree bigint, depth int, retained bigint, rank bigint"

TABLES = {
    "objects": OBJECTS, "classes": CLASSES, "class_fields": CLASS_FIELDS, "edges": EDGES, "gc_roots": GC_ROOTS, "field_values": FIELD_VALUES, "prim_arrays": PRIM_ARRAYS,
    "string_values": STRINGS,
}


@dataclass
class GraphHeap:
    """An object graph. `dom` is made on first use and then kept."""

    spark: SparkSession
    objects: DataFrame
    classes: DataFrame
    class_fields: DataFrame
    edges: DataFrame
    gc_roots: DataFrame
    field_values: DataFrame
    prim_arrays: DataFrame
    string_values: DataFrame
    #: one DataFrame for each (class_id, field name), where fields are columns of given tables
    columns: dict[tuple[int, str], DataFrame] = field(default_factory=dict, repr=False)
    _dom: DataFrame | None = field(default=None, repr=False)
    _names: dict[int, tuple[str, int | None]] | None = field(default=None, repr=False)

    @property
    def dom(self) -> DataFrame:
        if self._dom is None:
            from .operators.dominators import dominator_table

            self._dom = dominator_table(self)
        return self._dom

    @property
    def class_tree(self) -> dict[int, tuple[str, int | None]]:
        """class_id -> (name, super_id). Classes are the program's, not its data: few."""
        if self._names is None:
            self._names = {r.class_id: (r.name, r.super_id) for r in self.classes.select("class_id", "name", "super_id").collect()}
        return self._names

    def fields(self, classes: list[int], name: str) -> DataFrame:
        """Values of a field in these classes; only its own columns are read where fields are columns."""
        if not self.columns:
            return self.field_values.filter((F.col("name") == name) & F.col("class_id").isin(classes))
        parts = [self.columns[c, name] for c in classes if (c, name) in self.columns]
        if not parts:
            return self.field_values.filter(F.lit(False))
        return reduce(DataFrame.unionByName, parts)

    def ids(self) -> DataFrame:
        return self.objects.select("id")

    def empty_ids(self) -> DataFrame:
        return self.ids().filter(F.lit(False))
