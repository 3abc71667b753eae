import random

import pytest
from graphlens.llm import line_dedup, near_dedup, span_dedup


def brute_components(texts, size, percent):
    import re

    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_near_copies_by_brute_force(spark, size, percent):
    rng = random.Random(size)
    texts = {}
    for g in range(12):
        words = [rng.choice("abcdefghij") + str(rng.randint(0, 400)) for _ in range(rng.randint(40, 120))]
        for _ in range(rng.choice([1, 2, 5, 30])):
            own = list(words)
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = f"new{rng.randint(0, 10**6)}"
            texts[len(texts)] = " ".join(own)
    texts |= {len(texts) + k: t for k, t in enumerate(["", None, "one", "one", "One two", "one  two", " \t\n"])}
    docs = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    rows = near_dedup.near_duplicates(docs, shingle=size, percent=percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute_components(texts, size, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def template_group(rng, n, edits, size=150):
    words = [f"w{rng.randint(0, 10**6)}" for _ in range(size)]
    group = []
    for _ in range(n):
        own = list(words)
        for _ in range(edits):
            own[rng.randrange(size)] = f"new{rng.randint(0, 10**9)}"
        group.append(" ".join(own))
    return group


def test_near_copies_around_the_threshold(spark):
    """Copies of one template, some linked and some not, many more than a small bucket has."""
    rng = random.Random(8)
    texts = dict(enumerate([*template_group(rng, 60, 7), *template_group(rng, 40, 3)]))
    words = texts[0].split()
    texts |= {1000 + i: " ".join([*words[: 140 - i % 30], *(f"x{i}-{k}" for k in range(rng.randint(1, 14)))]) for i in range(60)}
    docs = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    rows = near_dedup.near_duplicates(docs, shingle=3, percent=85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute_components(texts, 3, 85)


def test_near_copies_verify_in_proportion(spark, monkeypatch):
    """A template group without links: verified pairs grow with the group, not with its square."""
    rng, seen = random.Random(6), []
    real = near_dedup.likely
    monkeypatch.setattr(near_dedup, "likely", lambda pairs, *a: (seen.append([(bytes(r.a), bytes(r.b)) for r in pairs.collect()]), real(pairs, *a))[1])
    counts = []
    for n in (60, 240):
        docs = spark.createDataFrame([*enumerate(template_group(rng, n, 9))], "doc_id long, text string")
        seen.clear()
        rows = near_dedup.near_duplicates(docs, shingle=3, percent=85).collect()
        pairs = [x for some in seen for x in some]
        assert len(pairs) == len(set(pairs))  # none twice
        assert sum(r.kept for r in rows) > 0.9 * n
        counts.append(len(pairs))
    assert counts[1] < 8 * counts[0] and counts[1] < 240 * 239 / 8


def test_near_copies_odd_rows(spark, odd_docs, no_docs):
    rows = near_dedup.near_duplicates(odd_docs).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in rows) == [
        (0, 0, True), (1, 1, True), (2, 2, True), (3, 3, True), (4, 4, True), (4, 4, True), (5, 5, True), (6, 6, True), (7, 4, False),
    ]
    assert near_dedup.near_duplicates(no_docs).count() == 0


def test_lines(spark, odd_docs, no_docs):
    common = "This line is on many sites."
    rows = [(i, f"own text number {i} of its site\n{common}\nshort", f"s{i % 12}") for i in range(24)]
    rows += [(100, f"near one\n{common}", None), (101, "seen on nine sites only", "s0")] + [(200 + i, "seen on nine sites only", f"s{i}") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    every = {r.doc_id: r.text for r in line_dedup.drop_spread_lines(docs).collect()}
    assert every[0] == rows[0][1] and every[5] == "own text number 5 of its site"  # short lines count too
    got = {r.doc_id: r for r in line_dedup.drop_spread_lines(docs, min_chars=12).collect()}
    assert got[0].text == rows[0][1] and got[0].n_lines_dropped == 0  # the first keeps it
    assert got[5].text == "own text number 5 of its site\nshort" and got[5].n_lines_dropped == 1
    assert got[100].text == "near one"
    assert all(got[200 + i].n_lines_dropped == 0 for i in range(9))
    odd = line_dedup.drop_spread_lines(odd_docs)
    assert odd.columns == [*odd_docs.columns, "n_lines_dropped"] and sorted(map(str, odd.drop("n_lines_dropped").collect())) == sorted(map(str, odd_docs.collect()))
    assert line_dedup.drop_spread_lines(no_docs).count() == 0


def test_lines_without_a_sketch_decide_the_same(spark):
    """All lines near the threshold: the exact counts decide."""
    rows = [(i, f"line number {i % 7} of the test", f"s{i % 13}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    one, other = (sorted((r.doc_id, r.n_lines_dropped) for r in line_dedup.drop_spread_lines(docs, min_sites=9, near=n).collect()) for n in (0.01, 0.99))
    spread = {k for k in range(7) if len({i % 13 for i in range(60) if i % 7 == k}) >= 9}
    assert one == other == [(i, int(i % 7 in spread and i >= 7)) for i in range(60)]


def sentence(rng, n):
    return " ".join("".join(rng.choice("bcdfgaeiou") for _ in range(rng.randint(2, 8))) for _ in range(n)).capitalize() + "."


def test_spans(spark):
    rng = random.Random(4)
    passage = " ".join(sentence(rng, n) for n in (14, 9, 3, 21, 12))
    long_one = sentence(rng, 70)
    docs, own = [], {}
    for i in range(40):
        own[i] = [sentence(rng, rng.randint(4, 15)) for _ in range(8)]
        middle = [passage] if i % 4 == 0 else [long_one] if i % 4 == 1 else []
        docs.append((i, " ".join(own[i][:4]) + "\n" + "".join(m + "\n" for m in middle) + " ".join(own[i][4:]), i))
    docs += [(100, docs[2][1], 7), (None, docs[3][1], 8), (101, None, 9), (102, "", 9)]
    got = {r.doc_id: r for r in span_dedup.drop_repeats(spark.createDataFrame(docs, "doc_id long, text string, n_sentences_dropped int")).collect()}
    assert got[0].text == docs[0][1] and got[1].text == docs[1][1] and got[2].text == docs[2][1]
    for i in range(4, 40):
        assert passage not in got[i].text and long_one not in got[i].text
        assert got[i].text.split() == " ".join(own[i]).split()
    assert got[100].text == "" and got[None].text == "" and got[101].text is None and got[102].text == ""


def test_spans_within_sentences(spark):
    """A passage is found wherever in a sentence it begins, and goes but for a part of a unit at either end; whole at its last sentences, and without spaces."""
    rng = random.Random(9)
    plain = lambda n: sentence(rng, n)[:-1].lower()
    han = lambda n: "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(n))
    inner, ending, chinese = plain(60), " ".join(sentence(rng, n) for n in (15, 10, 5)), f"{han(25)}。{han(70)}。"
    docs, own = [], {}
    for i in range(39):
        before, after = (han(11 + i), han(13)) if i % 3 == 2 else (plain(19 + i), plain(25))
        own[i] = (before, after)
        docs.append((i, before + ([f" {inner} ", f".\n{ending} ", f"。{chinese}"][i % 3]) + after))
    got = {r.doc_id: r for r in span_dedup.drop_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(got[i].text == docs[i][1] and got[i].n_sentences_dropped == 0 for i in range(3))
    for i in range(3, 39):
        before, after = own[i]
        if i % 3 == 0:  # within one sentence: at most a unit stays at either end
            left = got[i].text.removeprefix(before).removesuffix(after).split()
            assert got[i].text.startswith(before) and got[i].text.endswith(after) and len(left) <= 30 and got[i].n_sentences_dropped == 1
            continue
        assert got[i].text == before + [" ", ".\n", "。"][i % 3] + after
        assert got[i].n_sentences_dropped == [1, 3, 2][i % 3]


def test_spans_of_any_length_and_equal_ids(spark):
    """Without a least number of words, two short sentences are a span; texts of one id or of none differ by their text."""
    rng = random.Random(2)
    pair = "One two three four five six. Seven eight nine ten eleven twelve thirteen."
    docs = [(i, f"{sentence(rng, 9)} {pair} {sentence(rng, 8)}") for i in (1, 2, 3, 3, None, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert all(r.n_sentences_dropped == 0 for r in span_dedup.drop_repeats(frame).collect())
    got = span_dedup.drop_repeats(frame, min_words=1).collect()
    assert sorted(r.n_sentences_dropped for r in got) == [0, 2, 2, 2, 2, 2]
    assert next(r for r in got if r.doc_id == 1).n_sentences_dropped == 0 and all("Seven eight" not in r.text for r in got if r.doc_id != 1)


def test_spans_by_brute_force(spark):
    """Every run of units of at least the size that an earlier document has, compared word by word."""
    rng = random.Random(12)
    stock = [sentence(rng, rng.randint(3, 30)) for _ in range(25)]
    docs = [(i, " ".join(rng.choice(stock) if rng.random() < 0.8 else sentence(rng, rng.randint(3, 30)) for _ in range(rng.randint(2, 12)))) for i in range(60)]
    units = {i: [w for _, w in zip(*span_dedup.sentences(t)[:2], strict=True)] for i, t in docs}
    runs = {}
    for i, own in units.items():
        for a in range(len(own)):
            for b in range(a + 2, len(own) + 1):
                if sum(len(u.split()) for u in own[a:b]) >= 20:
                    runs.setdefault(" ".join(own[a:b]), []).append((i, a, b))
    gone = {i: set() for i, _ in docs}
    for found in runs.values():
        first = found[0]
        for x in found[1:]:
            if x[0] != first[0] or x[1] >= first[2]:
                gone[x[0]].update(range(x[1], x[2]))
    rows = span_dedup.drop_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sum(map(len, gone.values())) > 50
    for r in rows:
        expected = [u for k, u in enumerate(units[r.doc_id]) if k not in gone[r.doc_id]]
        assert r.text.lower().split() == " ".join(expected).split()


def test_spans_odd_rows(odd_docs, no_docs):
    rows = span_dedup.drop_repeats(odd_docs)
    assert rows.count() == odd_docs.count() and span_dedup.drop_repeats(no_docs).count() == 0
    kept = {r.doc_id: r.text for r in rows.collect()}
    assert kept[4] == kept[7] == "Plain words of a text."  # too short for a span
