import os

from graphlens.llm import near_dedup
from graphlens.llm.shared import shared_dir


def test_wide_tables_go_before_the_next_ones_are_made(spark, monkeypatch):
    """No band keys of all documents are left when members are written, and none of the nodes when these are compared."""
    kept, forgotten, real = {}, [], near_dedup.stored
    there = lambda: {x.rsplit("-", 1)[0] for x in os.listdir(shared_dir(spark).removeprefix("file:")) if x not in before}
    monkeypatch.setattr(near_dedup, "stored", lambda df, name, *a: (kept.setdefault(name, there()), real(df, name, *a))[1])
    monkeypatch.setattr(near_dedup, "forget_shuffles", forgotten.append, raising=False)
    before = set(os.listdir(shared_dir(spark).removeprefix("file:")))
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*words, "more"])), (3, "other"), (4, None)], "doc_id long, text string")
    rows = near_dedup.near_duplicates(docs, shingle=3, percent=85).collect()
    assert sorted((r.doc_id, r.component_id) for r in rows) == [(1, 1), (2, 1), (3, 3), (4, 4)]
    assert "near-signed" not in kept["near-members"] and "near-info" not in kept["near-open"]
    assert not there() & {"near-signed", "near-info", "near-ids"} and len(forgotten) >= 2
