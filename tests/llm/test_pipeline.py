"""The pipeline against brute force over a small corpus with planted cases."""

import hashlib
import random

import corpus_pipeline
import pytest
import sentencepiece
from graphlens.llm import decontaminate

FORMS = {"aa": "ka ko mi tan rel so".split(), "bb": "sch ung ein mer dow pf".split()}


def make(rng, lang, n):
    return " ".join("".join(rng.choice(FORMS[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    at = str(tmp_path_factory.mktemp("corpus"))
    items = [(i, make(rng, "aa", 30)) for i in range(3)]
    docs = [(i, make(rng, lang, 60), lang, f"s{i % 15}", 0) for i, lang in enumerate(rng.choice(["aa", "bb"]) for _ in range(60))]
    line = "this line is all over the sites"
    docs += [(100 + i, f"{make(rng, 'aa', 40)}\n{line}", "aa", f"s{i}", 0) for i in range(12)]
    near = docs[0][1].split()
    docs += [(200 + i, " ".join([*near[:50], f"x{i}", *near[51:]]), "aa", "s0", 0) for i in range(4)]
    docs += [(300, make(rng, "aa", 20) + " " + items[1][1].upper() + ". " + make(rng, "aa", 20), "aa", "s1", 0), (400, "12 34", None, "s1", 0), (401, None, "aa", None, None), (402, "", "aa", "s2", 0)]
    docs += [(500 + i, line, "aa", f"s{i}", 0) for i in range(3)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, docs, items, line


def test_pipeline(spark, folder, piece_model):
    at, docs, items, line = folder
    library = sentencepiece.SentencePieceProcessor(model_file=piece_model)
    expected = {}
    for i, text, lang, source, _ in docs:
        if not any(c.isalpha() for c in text or ""):
            continue  # no language
        if i > 100 and line in text:
            text = "\n".join(x for x in text.split("\n") if x != line)
        if not text or 200 <= i < 300:
            continue  # all in others; near copies of document 0
        if any(decontaminate.normal(b) in decontaminate.normal(text) for _, b in items):
            continue
        ids = library.encode(text)
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        expected[i] = (lang, source, len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids)))
    rows = corpus_pipeline.run(spark, at).collect()
    assert {r.doc_id: (r.lang, r.source, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows} == expected
    assert len(rows) == len(expected) and 0 in expected and 300 not in expected and 500 not in expected


def test_stages_keep_the_columns(spark, folder):
    at, *_ = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), at).count() == 0
        out = stage(spark, docs, at)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes


def test_odd_rows(spark, folder, odd_docs, tmp_path):
    """Nulls, repeated rows, long texts and columns whose names the stages use themselves."""
    at, docs, items, _ = folder
    extra = ["lang_pred", "spans", "n_lines_dropped", "kept", "leaks", "component_id", "score", "n_tokens"]
    rows = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    rows = rows.unionByName(odd_docs.selectExpr("doc_id + 1000 as doc_id", "text", "lang", "source", "0L as n_chars")).unionByName(rows.filter("doc_id in (5, 6)"))
    rows = rows.unionByName(rows.filter("doc_id = 7").selectExpr("cast(null as long) as doc_id", "concat(text, ' ko') as text", "lang", "source", "n_chars"))
    for name in extra:
        rows = rows.selectExpr("*", f"cast(doc_id as string) as {name}")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows, at)
        assert out.columns == rows.columns, name
        got = [r.doc_id for r in out.collect()]
        assert got.count(5) == 2 and got.count(6) == 2, name  # repeated rows stay together
    last = corpus_pipeline.STAGES[-1][1](spark, rows, at)
    assert last.count() == rows.count()
