"""Lowering of parsed pipelines to lazy DataFrames over a GraphHeap."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import GraphHeap
from ..operators import sets
from .ast import Filter, Pipeline, Source

Resolve = Callable[[str], DataFrame]


class Unresolved(ValueError):
    """A name, class or field that there is none of."""


def source(heap: GraphHeap, src: Source, resolve: Resolve | None) -> DataFrame:
    if src.kind == "all":
        return heap.ids()
    if src.kind == "class":
        return sets.instances(heap, sets.class_ids(heap, src.name))
    if src.kind in ("object", "set"):
        return sets.of_ids(heap, src.ids)
    own = sets.built_in(heap, src.name) if src.kind == "name" else None
    if own is not None:
        return own
    if resolve is None:
        raise Unresolved(f"Unknown name: {src.name or 'THAT'}")
    return resolve("THAT" if src.kind == "that" else src.name)


def id_set(heap: GraphHeap, plan: Pipeline, resolve: Resolve | None = None) -> DataFrame:
    """The ids that the source and the filters leave, filters from left to right."""
    ids = source(heap, plan.source, resolve)
    context = sets.class_ids(heap, plan.source.name) if plan.source.kind == "class" else None
    for f in plan.filters:
        ids, context = _filtered(heap, ids, context, f, resolve)
    return ids


def _filtered(heap: GraphHeap, ids: DataFrame, context: list[int] | None, f: Filter, resolve: Resolve | None) -> tuple[DataFrame, list[int] | None]:
    other = source(heap, f.source, resolve) if f.source else None
    if f.kind == "in":
        return sets.within(ids, other), context
    if f.kind == "not_in":
        return sets.without(ids, other), context
    if f.kind == "retained_by":
        return sets.retained_by(heap, ids, other), context
    if f.kind == "retaining":
        return sets.by_size(heap, ids, "retained", lambda c: sets.compare(c, f.op, F.lit(f.value))), context
    if f.kind == "sized":
        return sets.by_size(heap, ids, "shallow", lambda c: sets.compare(c, f.op, F.lit(f.value))), context
    if f.kind == "sized_between":
        return sets.by_size(heap, ids, "shallow", lambda c: c.between(f.value, f.value2)), context
    if f.kind in ("of_type", "of_type_exactly"):
        classes = sets.class_ids(heap, f.name)
        classes = classes if f.kind == "of_type_exactly" else sets.with_subclasses(heap, classes)
        return sets.within(ids, sets.instances(heap, classes)), classes
    if f.kind == "referencing":
        return sets.referencing(heap, ids, other, f.name), context
    if f.kind == "referenced_by":
        return sets.referenced_by(heap, ids, other), context
    if f.kind == "reachable_from":
        return sets.reachable_from(heap, ids, other), context
    if f.kind == "follow":
        return sets.follow(heap, ids, f.name), None
    if f.kind == "unfollow":
        classes = sets.class_ids(heap, str(f.value))
        return sets.unfollow(heap, ids, f.name, sets.instances(heap, classes)), classes
    if context is None:
        raise Unresolved("A field needs a class: begin with CLASS <name> or filter OF TYPE <name> first")
    if not context:
        raise Unresolved("Unknown class")
    try:
        if f.kind == "where_text":
            return sets.where_text(heap, ids, context, f.name, f.op, str(f.value)), context
        if f.kind == "duplicates":
            return sets.duplicates(heap, ids, context, f.name), context
        return sets.where_number(heap, ids, context, f.name, f.op, f.value), context
    except ValueError as wrong:
        raise Unresolved(str(wrong)) from None
