"""Queries over the object graph of the relational tables, with their SQL for comparison.

The SQL uses the closed form of the dominator tree: a line item with a root part hangs from the
super-root; else it belongs to the nation that its customer and supplier share, else to their
common region, else to the super-root.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .model import GraphHeap
from .operators import reports
from .plans import lower
from .plans.ast import Complete, Pipeline
from .plans.parser import parse
from .sources.tables import BASE, ROOT_PART_SIZE, heap_of

K = BASE
#: Sets that the queries name, as a session's user would.
NAMED = {"big": "CLASS shop.LineItem WHERE isLarge = true", "rich": "CLASS shop.Customer WHERE c_acctbal > 5000"}

BASE_SQL = f"""with li as (
  select *, {7 * K} + l_orderkey * 10000 + l_linenumber * 100 + row_number() over (partition by l_orderkey, l_linenumber
    order by l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) as id from lineitem),
objects as (
  select {K} + r_regionkey as id, 'shop.Region' as type, 16 as shallow, true as reached from region
  union all select {2 * K} + n_nationkey, 'shop.Nation', 24, true from nation
  union all select {3 * K} + s_suppkey, 'shop.Supplier', 40, true from supplier
  union all select {4 * K} + c_custkey, 'shop.Customer', 40, true from customer
  union all select {5 * K} + p_partkey, 'shop.Part', 8 * p_size, p_size <= {ROOT_PART_SIZE} from part
  union all select {6 * K} + o_orderkey, 'shop.Order', 48, true from orders
  union all select id, 'shop.LineItem', 16 + 8 * cast(l_quantity as bigint), true from li),
edges as (
  select {K} + n_regionkey as src, {2 * K} + n_nationkey as dst, 'nation' as label from nation
  union all select {2 * K} + s_nationkey, {3 * K} + s_suppkey, 'supplier' from supplier
  union all select {2 * K} + c_nationkey, {4 * K} + c_custkey, 'customer' from customer
  union all select {4 * K} + o_custkey, {6 * K} + o_orderkey, 'orders' from orders
  union all select {6 * K} + l_orderkey, id, 'lineitem' from li
  union all select {3 * K} + l_suppkey, id, 'lineitem' from li
  union all select {5 * K} + l_partkey, id, 'lineitem' from li),
owner as (
  select {2 * K} + n_nationkey as id, {K} + n_regionkey as idom from nation
  union all select {3 * K} + s_suppkey, {2 * K} + s_nationkey from supplier
  union all select {4 * K} + c_custkey, {2 * K} + c_nationkey from customer
  union all select {6 * K} + o_orderkey, {4 * K} + o_custkey from orders
  union all select li.id, case when p_size <= {ROOT_PART_SIZE} then null when c_nationkey = s_nationkey then {2 * K} + c_nationkey
      when cn.n_regionkey = sn.n_regionkey then {K} + cn.n_regionkey end
    from li join part on p_partkey = l_partkey join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey
    join nation cn on cn.n_nationkey = c_nationkey join supplier on s_suppkey = l_suppkey join nation sn on sn.n_nationkey = s_nationkey),
up as (
  select id, id as anc from objects
  union all select id, idom from owner where idom is not null
  union all select a.id, b.idom from owner a join owner b on a.idom = b.id where b.idom is not null
  union all select a.id, c.idom from owner a join owner b on a.idom = b.id join owner c on b.idom = c.id where c.idom is not null),
kept as (select anc as id, cast(sum(shallow) as bigint) as retained from up join objects using (id) group by anc),
sized as (select objects.*, retained from objects join kept using (id)),
big as (select id from li where l_quantity > 25),
rich as (select {4 * K} + c_custkey as id from customer where c_acctbal > 5000)
"""

ROWS = "id, type, retained as \"retainedSize\", shallow as \"shallowSize\", cast(null as varchar) as description"


def _resolver(heap: GraphHeap) -> Callable[[str], DataFrame]:
    def resolve(name: str) -> DataFrame:
        if name not in NAMED:
            raise lower.Unresolved(f"Unknown name: {name}")
        return lower.id_set(heap, _plan(NAMED[name]))

    return resolve


def _plan(text: str) -> Pipeline:
    found = parse(text)
    assert isinstance(found, Complete) and isinstance(found.query, Pipeline), (text, found)
    return found.query


def pipeline(text: str) -> Callable[[SparkSession, str], DataFrame]:
    """The result of a pipeline: ids, or what its terminal makes of them."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        heap = heap_of(spark, sf_dir)
        plan = _plan(text)
        ids = lower.id_set(heap, plan, _resolver(heap))
        t = plan.terminal
        if t.kind == "none":
            return ids
        if t.kind == "count":
            return reports.count(ids)
        if t.kind in ("sum", "max"):
            return reports.aggregate(heap, ids, t.kind, t.by)
        if t.kind == "group":
            return reports.by_class(heap, ids, t.n or None)
        if t.kind == "sample":
            return reports.sample(heap, ids, t.n)
        return reports.top(heap, ids, t.n, t.by, smallest=t.kind == "bottom")

    return run


def on_heap(make: Callable[[GraphHeap], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: make(heap_of(spark, sf_dir))


def sql_over_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL over a named set and the base tables."""
    heap = heap_of(spark, sf_dir)
    lower.id_set(heap, _plan(NAMED["rich"])).createOrReplaceTempView("rich")
    heap.edges.createOrReplaceTempView("heap_edges")
    return spark.sql("select count(distinct dst) as n, count(distinct id) as owners from rich join heap_edges on src = id where label = 'orders'")


def _top(order: str, n: int, where: str = "true") -> str:
    return f"select row_number() over (order by {order}) as rank, {ROWS} from sized where {where} order by rank limit {n}"


_IN_REGION_1 = f"select id from up where anc = {K + 1}"

#: name -> (query, SQL; None where SQL cannot say it)
ALL: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "src_all": (pipeline("ALL"), "select id from objects"),
    "src_class": (pipeline("CLASS shop.Customer"), "select id from objects where type = 'shop.Customer'"),
    "src_class_glob": (pipeline("CLASS shop.*er"), "select id from objects where type like 'shop.%er'"),
    "src_class_star": (pipeline("CLASS * COUNT"), "select count(*) as count from objects"),
    "src_object": (pipeline(f"i{2 * K + 3}"), f"select id from objects where id = {2 * K + 3}"),
    "src_set": (pipeline(f"FROM {{i{2 * K + 3}, i{K + 1}, i{9 * K}}}"), f"select id from objects where id in ({2 * K + 3}, {K + 1}, {9 * K})"),
    "src_name": (pipeline("rich"), "select id from rich"),
    "src_gcroots": (pipeline("GcRoots"), "select id from objects where type = 'shop.Region' or (type = 'shop.Part' and reached)"),
    "src_unreachable": (pipeline("Unreachable"), "select id from objects where not reached"),
    "src_threads": (pipeline("Threads COUNT"), "select 0::bigint as count"),
    "f_in": (pipeline("CLASS shop.Part IN GcRoots"), "select id from objects where type = 'shop.Part' and reached"),
    "f_not_in": (pipeline("CLASS shop.Customer NOT IN rich"), "select id from objects where type = 'shop.Customer' and id not in (select id from rich)"),
    "f_retained_by": (pipeline(f"CLASS shop.LineItem RETAINED BY i{K + 1}"), f"{_IN_REGION_1} intersect select id from li"),
    "f_retained_by_many": (pipeline("ALL RETAINED BY rich"), "select distinct id from up where anc in (select id from rich)"),
    "f_retaining": (pipeline("ALL RETAINING >= 400"), "select id from sized where retained >= 400"),
    "f_sized": (pipeline("CLASS shop.LineItem SIZED < 100"), "select id from objects where type = 'shop.LineItem' and shallow < 100"),
    "f_sized_between": (pipeline("ALL SIZED BETWEEN 40 AND 48"), "select id from objects where shallow between 40 and 48"),
    "f_of_type": (pipeline("ALL OF TYPE shop.Party"), "select id from objects where type in ('shop.Supplier', 'shop.Customer')"),
    "f_of_type_exactly": (pipeline("ALL OF TYPE EXACTLY shop.Party COUNT"), "select 0::bigint as count"),
    "f_referencing": (pipeline("CLASS shop.Order REFERENCING big"), f"select distinct src as id from edges where dst in (select id from big) and src between {6 * K} and {7 * K}"),
    "f_referencing_via": (pipeline("ALL REFERENCING rich VIA customer"), "select distinct src as id from edges where dst in (select id from rich) and label = 'customer'"),
    "f_referenced_by": (pipeline("CLASS shop.LineItem REFERENCED BY Unreachable"), "select distinct dst as id from edges where src in (select id from objects where not reached)"),
    "f_reachable_from": (
        pipeline(f"ALL REACHABLE FROM i{2 * K + 3}"),
        f"""select {2 * K + 3} as id union select dst from edges where src = {2 * K + 3}
        union select b.dst from edges a join edges b on a.dst = b.src where a.src = {2 * K + 3}
        union select c.dst from edges a join edges b on a.dst = b.src join edges c on b.dst = c.src where a.src = {2 * K + 3}""",
    ),
    "f_where_num": (pipeline("CLASS shop.Customer WHERE c_acctbal > 5000.5"), f"select {4 * K} + c_custkey as id from customer where c_acctbal > 5000.5"),
    "f_where_int": (pipeline("CLASS shop.Part WHERE p_size <= 20 WHERE p_size > 10"), f"select {5 * K} + p_partkey as id from part where p_size <= 20 and p_size > 10"),
    "f_where_bool": (pipeline("CLASS shop.LineItem WHERE isLarge = true"), "select id from big"),
    "f_where_str_exact": (pipeline('CLASS shop.Customer WHERE c_mktsegment = "BUILDING"'), f"select {4 * K} + c_custkey as id from customer where c_mktsegment = 'BUILDING'"),
    "f_where_str_prefix": (pipeline('CLASS shop.Customer WHERE c_mktsegment = "A"*'), f"select {4 * K} + c_custkey as id from customer where starts_with(c_mktsegment, 'A')"),
    "f_where_str_suffix": (pipeline('CLASS shop.Supplier WHERE s_name = *"1"'), f"select {3 * K} + s_suppkey as id from supplier where ends_with(s_name, '1')"),
    "f_where_str_contains": (pipeline('CLASS shop.Part WHERE p_brand = *"#2"*'), f"select {5 * K} + p_partkey as id from part where contains(p_brand, '#2')"),
    "f_where_of_type": (pipeline('ALL OF TYPE shop.Party WHERE c_mktsegment = "BUILDING" COUNT'), "select count(*) as count from customer where c_mktsegment = 'BUILDING'"),
    "f_follow": (pipeline("rich FOLLOW orders"), "select distinct dst as id from edges where src in (select id from rich) and label = 'orders'"),
    "f_unfollow": (pipeline("big UNFOLLOW lineitem TO shop.Supplier"), f"select distinct src as id from edges where dst in (select id from big) and src between {3 * K} and {4 * K}"),
    "f_duplicates": (
        pipeline("CLASS shop.Supplier DUPLICATES BY s_nationkey"),
        f"select {3 * K} + s_suppkey as id from supplier where s_nationkey in (select s_nationkey from supplier group by 1 having count(*) > 1)",
    ),
    "t_top": (pipeline("CLASS shop.Customer TOP 20 BY retainedSize"), _top("retained desc, id", 20, "type = 'shop.Customer'")),
    "t_show": (pipeline("SHOW 5"), _top("retained desc, id", 5)),
    "t_default10": (pipeline("Unreachable SHOW 10"), _top("retained desc, id", 10, "not reached")),
    "t_bottom": (pipeline("CLASS shop.Order BOTTOM 7 BY shallowSize"), _top("shallow, id", 7, "type = 'shop.Order'")),
    "t_sample": (pipeline("CLASS shop.Order SAMPLE 25"), None),
    "a_count": (pipeline("big COUNT"), "select count(*) as count from big"),
    "a_sum": (pipeline("CLASS shop.Nation SUM retainedSize"), "select cast(coalesce(sum(retained), 0) as bigint) as \"retainedSize\" from sized where type = 'shop.Nation'"),
    "a_max": (pipeline("ALL MAX retainedSize"), "select cast(coalesce(max(retained), 0) as bigint) as \"retainedSize\" from sized"),
    "a_group": (
        pipeline("ALL GROUP BY CLASS TOP 100"),
        "select type, count(*) as n, cast(sum(shallow) as bigint) as \"shallowSize\", cast(sum(retained) as bigint) as \"retainedSize\" from sized group by type",
    ),
    "a_summary": (
        on_heap(reports.summary),
        """select count(*) as "objectCount", count(*) filter (reached) as "reachableCount", count(*) filter (not reached) as "unreachableCount",
        cast(coalesce(sum(shallow) filter (reached), 0) as bigint) as "reachableBytes", cast(coalesce(sum(shallow) filter (not reached), 0) as bigint) as "unreachableBytes",
        10::bigint as "classCount" from objects""",
    ),
    "a_classes": (
        on_heap(lambda heap: reports.class_counts(heap, "shop.P*")),
        "select 5::bigint as id, 'shop.Part' as \"className\", count(*) as \"instanceCount\" from part union all select 8, 'shop.Party', 0",
    ),
    "a_histogram": (on_heap(reports.histogram), "select type as \"className\", count(*) as \"instanceCount\" from objects group by type"),
    "x_explain": (
        on_heap(lambda heap: reports.explain(heap, 4 * K + 7)),
        f"""select depth, id, type, field, retained as "retainedSize", cast(null as varchar) as description, notes from (
        select 0 as depth, {4 * K} + c_custkey as id, cast(null as varchar) as field, cast(null as varchar) as notes from customer where c_custkey = 7
        union all select 1, {2 * K} + c_nationkey, 'customer', null from customer where c_custkey = 7
        union all select 2, {K} + n_regionkey, 'nation', 'GC root (sticky class)' from customer join nation on n_nationkey = c_nationkey where c_custkey = 7) x join sized using (id)""",
    ),
    "x_inspect": (
        on_heap(lambda heap: reports.inspect(heap, 2 * K + 3).select("at", "field", "value", "type")),
        """select 0 as at, 'n_nationkey' as field, cast(n_nationkey as varchar) as value, 'int' as type from nation where n_nationkey = 3
        union all select 1, 'n_regionkey', cast(n_regionkey as varchar), 'int' from nation where n_nationkey = 3
        union all select 2, 'n_name', n_name, null from nation where n_nationkey = 3""",
    ),
    "x_rank": (
        on_heap(lambda heap: heap.dom.select("id", "idom", "retained", "rank")),
        "select sized.id, idom, retained, row_number() over (order by retained desc, sized.id) - 1 as rank from sized left join owner on owner.id = sized.id",
    ),
    "sql_over_named": (sql_over_named, "select count(distinct dst) as n, count(distinct rich.id) as owners from rich join edges on src = rich.id where label = 'orders'"),
}

QUERIES = {name: query for name, (query, _) in ALL.items()}
ORACLES = {name: BASE_SQL + sql for name, (_, sql) in ALL.items() if sql is not None}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What keeps most of the memory alive."""
    return pipeline("TOP 10 BY retainedSize")(spark, sf_dir)
