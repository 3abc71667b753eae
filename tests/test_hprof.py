import os

import dump_writer
import pytest
from graphlens.operators import reports
from graphlens.plans import lower
from graphlens.plans.parser import parse
from graphlens.session import ErrorResult, Session
from graphlens.formats import records, render
from graphlens.sources import hprof


@pytest.fixture(scope="module")
def heap(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("dump")
    return hprof.ingest(spark, dump_writer.known_objects().write(at / "known.hprof"), str(at / "tables"))


@pytest.fixture(scope="module")
def session(heap, tmp_path_factory):
    return Session(heap, str(tmp_path_factory.mktemp("session")))


def ask(session, text):
    return records(session.execute(text))


def n(session, text):
    return ask(session, text + " COUNT")[0]["count"]


def test_tables(heap):
    assert heap.objects.count() == heap.objects.select("id").distinct().count() == 10 + 17
    assert sorted(r.id for r in heap.objects.select("id").collect()) == list(range(1, 28))
    names = {r.name for r in heap.classes.collect()}
    assert {"demo.Base", "demo.Sub", "java.lang.Object[]", "[I", "[D"} <= names
    assert {r.root_type for r in heap.gc_roots.collect()} == {1, 8, 5, 0xFF}  # the first type of a root counts
    texts = {r.value for r in heap.string_values.collect()}
    assert texts == {"hello world", "grüße", "x" * 60}


def test_labels_do_not_shift_after_a_null(heap):
    sub = next(k for k, (name, _) in heap.class_tree.items() if name == "demo.Sub")
    own = heap.objects.filter((heap.objects.class_id == sub) & (heap.objects.kind == "instance")).first().id
    assert {(r.label, r.ord) for r in heap.edges.filter(heap.edges.src == own).collect()} == {("second", 1), ("ref", 3)}
    labels = {r.label for r in heap.edges.filter(heap.edges.src == sub).collect()}
    assert labels == {"super", "loader", "one", "two"}


def test_slots_of_arrays(heap):
    assert sorted(r.slot for r in heap.edges.filter("kind = 'element'").collect()) == [0, 2, 3]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("CLASS demo.Base", 3), ("CLASS demo/Base", 3), ("ALL OF TYPE demo.Base", 4), ("ALL OF TYPE EXACTLY demo.Base", 3), ("CLASS *Foo", 2), ("CLASS FooFoo", 2),
        ("CLASS demo.Base WHERE n = 42", 1), ("CLASS demo.Base WHERE n > 10", 2), ("ALL OF TYPE demo.Base WHERE n > 100", 1), ("CLASS demo.All WHERE f > 1.2", 1),
        ("CLASS demo.All WHERE d < -2", 1), ("CLASS demo.All WHERE c = 65535", 1), ("CLASS demo.All WHERE z = true", 1), ("CLASS demo.All WHERE s = -300", 1),
        ('CLASS java.lang.Thread WHERE name = "hello world"', 1), ('CLASS java.lang.Thread WHERE name = "hello"*', 1), ('CLASS java.lang.Thread WHERE name = *"x"*', 0),
        ("Threads", 1), ("GcRoots", 4), ("i0", 0), ("i999", 0), ("CLASS nope", 0), ("ALL", 27), ("ALL REACHABLE FROM Threads", 3), ("ALL REFERENCING CLASS java.lang.String", 2),
        ("CLASS demo.Sub FOLLOW second", 1),
    ],
)
def test_counts(session, text, expected):
    assert n(session, text) == expected


def test_sizes(session, heap):
    rows = {(r["type"], r["shallowSize"]) for r in ask(session, "ALL SHOW 100")}
    assert {("demo.Base", 24), ("[I", 24), ("java.lang.Object[]", 48), ("demo.Sub", 48)} <= rows  # 28, 28, 48 and 48 bytes in eights


def test_inspect_read_explain(session, heap):
    sub = ask(session, "CLASS demo.Sub SHOW 1")[0]["id"]
    rows = ask(session, f"INSPECT {sub}")
    assert [r["field"] for r in rows] == ["first", "second", "m", "ref", "n"]
    assert [r.get("value") for r in rows] == [None, None, "7", None, "111"]
    assert rows[0]["ref"] == "null"
    array = ask(session, "CLASS java.lang.Object[] SHOW 1")[0]["id"]
    assert [r["field"] for r in ask(session, f"INSPECT {array}")] == ["[0]", "[2]", "[3]"]
    ints = ask(session, "CLASS [I SHOW 1")[0]["id"]
    assert [r["value"] for r in ask(session, f"INSPECT {ints}")] == ["1", "-2", "3"]
    assert ask(session, f"READ {ints}")[0]["content"].startswith("(int[]")
    assert {ask(session, f"READ {r['id']}")[0]["content"] for r in ask(session, "CLASS java.lang.String SHOW 9")} == {"hello world", "grüße", "x" * 60}
    chain = ask(session, f"EXPLAIN {sub}")
    assert [(r["depth"], r["field"], r["type"]) for r in chain] == [(0, "", "demo.Sub"), (1, "[3]", "java.lang.Object[]")]
    assert chain[1]["notes"] == "GC root (JNI global)"
    lost = ask(session, "Unreachable OF TYPE FooFoo SHOW 1")[0]["id"]
    assert ask(session, f"EXPLAIN {lost}")[0]["notes"] == "not reachable from any GC root"
    assert ask(session, "EXPLAIN i999") == []
    long_text = next(r for r in ask(session, "CLASS java.lang.String SHOW 9") if len(r["description"]) == 43)
    assert "..." in long_text["description"]


def test_where_needs_a_class(session):
    assert "class" in ask(session, "ALL WHERE n = 1 COUNT")[0]["error"]
    assert "error" in ask(session, "CLASS demo.Base WHERE nope = 1 COUNT")[0]


def test_session(session, tmp_path):
    assert len(ask(session, "CLASS demo.Base TOP 2")) == 2
    assert n(session, "THAT") == 2
    ask(session, "CLASS demo.Base SHOW 2")
    assert n(session, "THAT") == 3
    assert ask(session, "CALL THAT bases")[0]["name"] == "bases"
    assert n(session, "ALL NOT IN bases") == 24
    assert n(session, "bases IN bases") == 3
    ask(session, "CLASS FooFoo")
    ask(session, "CALL THAT bases")
    assert n(session, "bases") == 2
    ask(session, "UNDO")
    assert n(session, "bases") == 3
    assert ask(session, "NAMES b*")[0]["names"][0]["name"] == "bases"
    rows = ask(session, "SELECT count(*) AS n FROM bases JOIN objects USING (id)")
    assert rows == [{"n": 3}]
    assert isinstance(session.execute("THAT COUNT"), ErrorResult)  # THAT is a table now
    again = Session(session.heap, str(session.folder))
    assert n(again, "bases") == 3 and len(again.history) == len(session.history) + 1
    ask(again, "FORGET bases")
    assert "error" in ask(again, "bases")[0]
    assert "error" in ask(again, "CALL h9999 x")[0]
    assert ask(again, "EXPLAIN h1")[0]["histId"] == 1
    assert "error" in ask(again, "h9999")[0]
    assert render(again.execute("CLASS nope"), "human") == "(no results)"


@pytest.mark.parametrize(("form", "id_size"), [("gzip", 8), ("zip", 4), ("plain", 4)])
def test_forms(spark, tmp_path, form, id_size):
    heap = hprof.ingest(spark, dump_writer.known_objects(id_size).write(tmp_path / "d", form), str(tmp_path / "t"))
    assert heap.objects.count() == 27 and heap.string_values.count() == 3
    found = parse("CLASS demo.Base WHERE n = 42").query
    assert lower.id_set(heap, found).count() == 1


def test_cache_is_kept_and_remade(spark, tmp_path):
    path = dump_writer.known_objects().write(tmp_path / "d")
    hprof.ingest(spark, path, str(tmp_path / "t"))
    made = os.stat(tmp_path / "t/objects/_SUCCESS").st_mtime_ns
    hprof.ingest(spark, path, str(tmp_path / "t"))
    assert os.stat(tmp_path / "t/objects/_SUCCESS").st_mtime_ns == made
    other = dump_writer.known_objects()
    other.obj(50, 8)
    other.write(tmp_path / "d")
    assert hprof.ingest(spark, path, str(tmp_path / "t")).objects.count() == 28


def test_bad_dumps(tmp_path):
    (tmp_path / "x").write_bytes(b"JAVA PROFILE 1.0.2\0\0\0\0\x03")
    with pytest.raises(hprof.BadDump):
        hprof.outline(str(tmp_path / "x"))
    (tmp_path / "y").write_bytes(dump_writer.known_objects().bytes()[:-40])
    with pytest.raises(hprof.BadDump):
        hprof.outline(str(tmp_path / "y"))


def test_roots_dominate_nothing_of_each_other(spark, tmp_path):
    d = dump_writer.Dump()
    d.cls(1, "java/lang/Object", size=16)
    d.cls(2, "Node", [("next", "object")], sup=1)
    d.obj(10, 2, 11)
    d.obj(11, 2, 0)
    d.root(5, 10)
    d.root(5, 11)
    heap = hprof.ingest(spark, d.write(tmp_path / "d"), str(tmp_path / "t"))
    assert all(r.idom is None for r in heap.dom.collect())
    assert reports.summary(heap).first().reachableCount == 2
