import pickle
import random

import numpy as np
import pyarrow as pa
from graphlens.llm import toxicity
from graphlens.llm.shared import gather, words_of


def test_words_by_table_are_those_of_the_expression():
    rng = random.Random(1)
    odd = ["", " ", "a", "É", "é b", "日本語。テスト", "😀x😀", "a\0b", "नमस्ते दुनिया", "x́y", "İstanbul", "ａｂ 12 ab", "\U00010400\U00010428 q"]
    rows = [*odd, "", *("".join(rng.choice("aBé日😀́ 1.\n\U0001d538ก") for _ in range(rng.randint(0, 40))) for _ in range(300)), *odd]
    array = pa.array(rows, pa.large_string())
    words, offsets = toxicity.filled_words(array)
    flat, cut = words_of(array)
    assert [words.slice(a, b - a).to_pylist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == [
        [w for w in flat.slice(a, b - a).to_pylist() if w] for a, b in zip(cut[:-1], cut[1:], strict=True)
    ]
    assert [len(x) for x in toxicity.filled_words(array.slice(0, 0))] == [0, 1] and toxicity.filled_words(pa.array(["", "1"], pa.large_string()))[1].tolist() == [0, 0, 0]


def test_cosines_that_single_precision_cannot_tell_apart():
    """Examples whose cosines differ by less than 1e-8: the dense matrix is in single precision, the order of the nearest is not."""
    n, rng = 400, np.random.default_rng(2)
    example, term = np.repeat(np.arange(n), 3), np.tile([0, 1, 2], n)
    angle = 0.5 + rng.permutation(n) * 1e-9
    value = np.stack((np.cos(angle), np.sin(angle) * 0.6, np.sin(angle) * 0.8), 1)
    none = np.zeros(n)
    index = toxicity.indexed(example, term, value.ravel(), n, 4)
    assert index["dense"].dtype == np.float32 and index["dense"].shape == (3, 448)
    model = toxicity.Model(pa.array(["w:a", "w:b", "w:c", "w:d"], pa.large_string()), np.ones(4), np.arange(n), none, none + 1, np.arange(n), **index)
    best, cosine = model.nearest(np.asarray([0, 3]), np.asarray([0.8, 0.6]))
    exact = value[:, 0] * 0.8
    expected = np.lexsort((np.arange(n), -np.round(exact, 12)))[: toxicity.NEIGHBOURS]
    assert best.tolist() == expected.tolist() and np.abs(cosine - exact[expected]).max() < 1e-14


def test_a_worker_makes_its_tables_once():
    """What is sent holds no table, and one model gives every task the same."""
    vectors = toxicity.Vectors([f"w:w{i}" for i in range(1000)])
    size = len(pickle.dumps(vectors))
    model = toxicity.Model(vectors.names, np.ones(1000))
    assert size < 30_000 and model.vectors is model.vectors and model.vectors.known is model.vectors.known


def test_postings_are_one_piece_if_all_blocks_are_as_near(monkeypatch):
    """Texts as near to one block as to another: no posting is picked out, and the nearest examples are those of a full scan."""
    rng, n = np.random.default_rng(5), 1280
    rows = []
    for i in range(n):
        terms = np.unique(rng.integers(0, 600, 30))
        rows.append((i, i % 2, terms, rng.integers(1, 4, len(terms))))
    model = toxicity.build([f"w:{i}" for i in range(600)], rng.uniform(1, 5, 600), rows, {0: 1.0, 1: 1.0})
    vectors = toxicity.Vectors(model.terms, model.idf)
    full = np.zeros((n, 600))
    for k, i in enumerate(model.ids.tolist()):
        full[k, rows[i][2]] = vectors.unit(rows[i][2], rows[i][3])
    some = [np.unique(rng.integers(0, 600, 40)) for _ in range(60)]
    asked = [(x, vectors.unit(x, np.ones(len(x)))) for x in some]
    picked = []
    monkeypatch.setattr(toxicity, "gather", lambda starts, lengths: picked.append(int(lengths.sum())) or gather(starts, lengths))
    found = model.nearest_of([*asked, (np.zeros(0, np.int64), np.zeros(0))])
    for (terms, values), (best, cosine) in zip(asked, found, strict=False):
        every = full[:, terms] @ values
        expected = np.lexsort((model.rank, -np.round(every, 12)))[: toxicity.NEIGHBOURS]
        assert best.tolist() == expected.tolist() and np.abs(cosine - every[expected]).max() < 1e-14
    assert len(found[-1][0]) == 0 and sum(picked) == 0 and model.passed <= len(model.highest[0])
