import numpy as np
import pytest
from graphlens import queries
from graphlens.operators import kernel
from graphlens.plans.ast import Command, Complete, Filter, Incomplete, Invalid, Pipeline, Source, Terminal
from graphlens.plans.parser import parse


def brute(n, src, dst, roots):
    """Immediate dominators by taking out each node."""

    def without(x):
        keep = (src != x) & (dst != x)
        return kernel.reachable(n, src[keep], dst[keep], roots[roots != x])

    full = without(-9)
    above = {v: set() for v in range(n)}
    for x in np.flatnonzero(full):
        left = without(x)
        for v in np.flatnonzero(full & ~left):
            if v != x:
                above[int(v)].add(int(x))
    return [kernel.UNREACHED if not full[v] else next((x for x in above[v] if len(above[x]) == len(above[v]) - 1), kernel.SUPER) for v in range(n)]


@pytest.mark.parametrize("seed", range(60))
def test_dominators_of_random_graphs(seed):
    rng = np.random.default_rng(seed)
    n, m = int(rng.integers(1, 25)), int(rng.integers(0, 50))
    src, dst = rng.integers(0, n, m), rng.integers(0, n, m)
    roots = np.unique(rng.integers(0, n, int(rng.integers(0, 4))))
    idom, order = kernel.dominators(n, src, dst, roots)
    assert idom.tolist() == brute(n, src, dst, roots)
    shallow = rng.integers(1, 9, n)
    found = kernel.tree(idom, order, shallow)
    for v in range(n):
        if idom[v] == kernel.UNREACHED:
            assert found["pre"][v] == -1 and found["retained"][v] == shallow[v]
            continue
        inside = [u for u in range(n) if found["pre"][u] >= 0 and found["pre"][v] <= found["pre"][u] < found["pre"][v] + found["subtree"][v]]
        assert found["retained"][v] == sum(shallow[u] for u in inside) and len(inside) == found["subtree"][v]


def test_deep_chain():
    n = 100_000
    idom, order = kernel.dominators(n, np.arange(n - 1), np.arange(1, n), np.asarray([0]))
    assert kernel.tree(idom, order, np.ones(n, np.int64))["retained"][0] == n


@pytest.mark.parametrize(
    ("text", "query"),
    [
        ("all", Pipeline(Source("all"))), ("CLASS *", Pipeline(Source("all"))), ("TOP 5", Pipeline(Source("all"), (), Terminal("top", 5))),
        ("class a.B retaining >= 10 top 3 by retainedsize", Pipeline(Source("class", "a.B"), (Filter("retaining", op=">=", value=10),), Terminal("top", 3))),
        ('CLASS a WHERE s = *"x y"* COUNT', Pipeline(Source("class", "a"), (Filter("where_text", name="s", op="contains", value="x y"),), Terminal("count"))),
        ("ALL NOT IN x OF TYPE EXACTLY b.C", Pipeline(Source("all"), (Filter("not_in", Source("name", "x")), Filter("of_type_exactly", name="b.C")))),
        ("EXPLAIN i7", Command("explain", n=7)), ("EXPLAIN foo", Command("explain_name", "foo")), ("CALL h3 foo", Command("call", "foo", 3)), ("H12", Command("recall", n=12)),
        ("HISTORY", Command("history", n=10)), ("NAMES f*", Command("names", "f*")), ("THAT", Command("that")), ("SUMMARY", Command("summary")),
    ],
)
def test_parses(text, query):
    found = parse(text)
    assert isinstance(found, Complete) and found.query == query


@pytest.mark.parametrize("text", ["TOP 0", "TOP x", "ALL FROB", "CLASS a WHERE s > \"x\"", "ALL SIZED ! 3", "EXPLAIN 5 6", "CALL THAT ALL", "INSPECT 5", "ALL COUNT COUNT", "ALL WHERE a = b"])
def test_rejects(text):
    assert isinstance(parse(text), Invalid)


@pytest.mark.parametrize(("text", "expected"), [("", "ALL"), ("CLASS", "<class>"), ("ALL RETAINED", "BY"), ("ALL SUM", "RETAINEDSIZE"), ("CALL THAT", "<new-name>"), ("ALL SIZED", ">=")])
def test_completions(text, expected):
    found = parse(text)
    assert isinstance(found, Incomplete) and expected in found.completions


SOME = ["src_class_glob", "f_retained_by_many", "f_referencing", "f_where_of_type", "f_reachable_from", "t_top", "a_summary", "a_group", "x_explain", "x_rank", "sql_over_named"]


@pytest.mark.parametrize("name", SOME)
def test_against_sql(spark, name):
    import duckdb

    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem".split():
        db.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    expected = db.sql(queries.ORACLES[name])
    rows = queries.QUERIES[name](spark, sf)
    names = sorted(rows.columns)
    assert sorted(expected.columns) == names
    order = [expected.columns.index(n) for n in names]
    assert sorted((tuple(r[n] for n in names) for r in rows.collect()), key=repr) == sorted((tuple(x[i] for i in order) for x in expected.fetchall()), key=repr)


def test_sample_is_of_the_set(spark):
    rows = queries.QUERIES["t_sample"](spark, "/root/testdata/sf0.001").collect()
    assert [r["rank"] for r in rows] == list(range(1, 26)) and {r.type for r in rows} == {"shop.Order"} and len({r.id for r in rows}) == 25
