import random

import numpy as np
import pytest
from graphlens.llm import decontaminate, hamming_index, language_id, toxicity, url_filter
from graphlens.llm.url_filter import Rule


def languages(rng, n):
    forms = {"aa": "ka ko mi tan rel".split(), "bb": "sch ung ein mer dow".split(), "cc": "жил был кот вот дом".split()}
    make = lambda lang, k: " ".join("".join(rng.choice(forms[lang]) for _ in range(rng.randint(1, 3))) for _ in range(k))
    return make, [(i, make(lang, rng.randint(5, 60)), lang) for i, lang in enumerate(rng.choice(list(forms)) for _ in range(n))]


def test_languages(spark, odd_docs, no_docs):
    make, rows = languages(random.Random(1), 200)
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["aa", "bb", "cc"]
    _, fresh = languages(random.Random(2), 60)
    found = language_id.identify(spark.createDataFrame([*fresh, (900, make("aa", 40) + " " + make("bb", 30), "aa")], "doc_id long, text string, lang string"), model)
    got = {r.doc_id: r for r in found.collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in fresh)
    assert [s.lang for s in got[900].spans] == ["aa", "bb"] and 38 <= got[900].spans[0].n_words <= 42 and 0.4 < got[900].score < 0.75
    odd = language_id.identify(odd_docs, model).collect()
    assert len(odd) == odd_docs.count() and {r.lang_pred for r in odd if not (r.text or "").strip()} == {"und"}
    assert language_id.identify(no_docs, model).count() == 0
    nothing = language_id.fit(odd_docs.filter("lang = 'none'"))
    assert {r.lang_pred for r in language_id.identify(odd_docs, nothing).collect()} == {"und"}


def test_rare_language_without_spaces(spark):
    """Words that are all seen once open their language's script, whatever the other languages have."""
    rng = random.Random(3)
    clause = lambda: "".join(chr(rng.randint(0x0E01, 0x0E2E)) for _ in range(20))
    _, rows = languages(random.Random(1), 200)
    rows += [(1000 + i, f"{clause()} {clause()}", "th") for i in range(5)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_words=40)
    assert model.languages == ["aa", "bb", "cc", "th"]
    found = language_id.identify(spark.createDataFrame([(1, clause())], "doc_id long, text string"), model).first()
    assert (found.lang_pred, found.score) == ("th", 1.0)


def test_viterbi_by_brute_force():
    from itertools import product

    model = language_id.Model(["a", "b"], {}, np.zeros(2), [np.ones((language_id.SLOTS, 2))] * 3, [np.ones((language_id.SLOTS, 2))] * 2, np.ones((2, 1), bool))
    work = language_id.Identifier(model, 3.0)
    rng = np.random.default_rng(0)
    for _ in range(60):
        scores = rng.normal(0, 3, (int(rng.integers(1, 9)), 2)).astype(np.float32)
        value = lambda p: sum(scores[i, x] for i, x in enumerate(p)) - 3.0 * sum(x != y for x, y in zip(p, p[1:], strict=False))  # noqa: B023, E731
        assert np.isclose(value(work.path(scores).tolist()), max(map(value, product((0, 1), repeat=len(scores)))), atol=1e-4)


def test_toxicity(spark, odd_docs, no_docs):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("bcdfgaeiou") for _ in range(rng.randint(2, 6)))
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        rows.append((i, " ".join([word() for _ in range(30)] + ([rng.choice(["zorgish", "zorgling", "vrukk"])] if bad else []))))
        labels.append((i, int(bad)) if i < 300 else (i, None))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, known)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert all(got[i].predicted == int(i % 4 == 0) for i in range(300, 400))
    assert all(0 <= r.score <= 1 and bool(r.evidence) == (r.doc_id % 4 == 0) for r in got.values())
    odd = toxicity.score(odd_docs, model)
    assert odd.count() == odd_docs.count() and odd.columns == [*[c for c in odd_docs.columns if c != "score"], "score", "predicted", "evidence"]
    assert toxicity.score(no_docs, model).count() == 0
    assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, known.filter("toxic = 2"))).collect()} == {0.0}


def test_known_terms_are_looked_up_among_the_words_of_a_slice(monkeypatch):
    """A hash table of all known terms for each slice of texts would cost more than the texts themselves."""
    tables, index_in = [], toxicity.pc.index_in
    monkeypatch.setattr(toxicity.pc, "index_in", lambda values, value_set, **more: tables.append(len(value_set)) or index_in(values, value_set=value_set, **more))
    vectors = toxicity.Vectors([*(f"w:word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(500)), "p:word", "p:quit", "w:a"])
    rows, terms, n = vectors.counts(toxicity.pa.array(["wordaa, Wordba wordaa", "", "a quite a", "unknown"], toxicity.pa.large_string()))
    assert [x.tolist() for x in (rows, terms, n)] == [[0, 0, 0, 2, 2], [0, 1, 500, 501, 502], [2, 1, 3, 1, 2]]
    assert tables and max(tables) <= 6
    assert [len(x) for x in vectors.counts(toxicity.pa.array(["", "1 2"], toxicity.pa.large_string()))] == [0, 0, 0]


def test_toxicity_of_texts_without_a_toxic_term(spark):
    """A copy of a toxic example whose words are no other's is found by its ordinary words."""
    rng = random.Random(11)
    text = lambda: " ".join("".join(rng.choice("bcdfgaeiou") for _ in range(rng.randint(3, 7))) for _ in range(30))
    rows = [(i, text() + (" zorgish" if i % 4 == 0 else "")) for i in range(200)] + [(900, text()), (901, text())]
    docs = spark.createDataFrame([*rows, (902, rows[-2][1]), (903, rows[-1][1])], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([*((i, int(i % 4 == 0)) for i in range(200)), (900, 1), (901, 0)], "doc_id long, toxic int"))
    assert set(model.ids.tolist()) == {*range(200), 900, 901}
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    first = got[902].evidence[0]
    assert (first.doc_id, first.toxic) == (900, 1) and first.cosine == pytest.approx(1) and got[902].score > got[903].score


def test_block_max_is_exact():
    rng = np.random.default_rng(3)
    rows = []
    for i in range(300):
        terms = np.unique(rng.integers(0, 40, int(rng.integers(0, 8))))
        rows.append((i, int(rng.integers(0, 2)), terms, rng.integers(1, 4, len(terms))))
    model = toxicity.build([f"w:{i}" for i in range(40)], np.linspace(1, 3, 40), rows, {0: 1.0, 1: 1.0})
    vectors = toxicity.Vectors(model.terms, model.idf)
    dense = np.zeros((len(model.ids), 40))
    own = {r[0]: r for r in rows}
    for k, i in enumerate(model.ids):
        dense[k, own[int(i)][2]] = vectors.unit(own[int(i)][2], own[int(i)][3])
    for _ in range(100):
        terms = np.unique(rng.integers(0, 40, 5))
        values = vectors.unit(terms, np.ones(len(terms)))
        cosine = dense[:, terms] @ values
        best, found = model.nearest(terms, values)
        assert np.allclose(found, np.sort(cosine)[::-1][: len(found)]) and np.allclose(cosine[best], found)
        assert len(best) == min(toxicity.NEIGHBOURS, int((cosine > 1e-12).sum()))


def test_block_max_passes_blocks_over():
    """Texts near a group of examples leave the blocks of other groups closed, and find the same as a full scan."""
    rng = np.random.default_rng(7)
    rows = []
    for i in range(3840):
        group = i % 6
        terms = np.unique(np.concatenate((rng.integers(group * 60, group * 60 + 60, 25), rng.integers(360, 380, 4))))
        rows.append((i, int(rng.integers(0, 2)), terms, rng.integers(1, 3, len(terms))))
    model = toxicity.build([f"w:{i}" for i in range(380)], rng.uniform(1, 5, 380), rows, {0: 1.0, 1: 1.0})
    vectors = toxicity.Vectors(model.terms, model.idf)
    own = {r[0]: (r[2], vectors.unit(r[2], r[3])) for r in rows}
    full = np.zeros((3840, 380))
    for k, i in enumerate(model.ids.tolist()):
        full[k, own[i][0]] = own[i][1]
    for i in range(0, 3840, 40):
        terms = np.unique(np.concatenate((own[i][0][: len(own[i][0]) // 2], rng.integers((i % 6) * 60, (i % 6) * 60 + 60, 8))))
        values = vectors.unit(terms, np.ones(len(terms)))
        best, found = model.nearest(terms, values)
        expected = np.sort(full[:, terms] @ values)[::-1][: toxicity.NEIGHBOURS]
        assert np.allclose(found, expected)
    assert model.passed > model.opened


def levenshtein_in(item, text):
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_edit_matching_by_brute_force(spark, odd_docs, no_docs):
    rng = random.Random(6)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))
    items = [(i, text(rng.randint(8, 40)).capitalize()) for i in range(8)] + [(50, None), (51, "  "), (None, "never found")]
    docs = []
    for i in range(60):
        own = list(items[i % 8][1])
        for _ in range(rng.randint(0, 12)):
            at = rng.randrange(len(own))
            own[at : at + 1] = rng.choice([[], ["z"], [own[at], "q"]])
        docs.append((i, f"{text(20)} {''.join(own)}\n{text(9)}" if i % 3 else text(40)))
    found = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert any(r.leaks for r in found)
    for r in found:
        expected = {}
        for i, item in items[:8]:
            item = decontaminate.normal(item)
            d = levenshtein_in(f" {item} ", f" {decontaminate.normal(r.text)} ")
            if d <= decontaminate.budget(len(item)):
                expected[i] = d
        assert {x.item_id: x.distance for x in r.leaks} == expected
    bench = spark.createDataFrame(items, "item_id long, text string")
    small = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench, block_chars=1)  # a block for each item
    assert {r.doc_id: r.leaks for r in small.collect()} == {r.doc_id: r.leaks for r in found}
    assert small._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert decontaminate.leaks(odd_docs, bench).count() == odd_docs.count() and decontaminate.leaks(no_docs, bench).count() == 0
    assert {len(r.leaks) for r in decontaminate.leaks(odd_docs, bench.limit(0)).collect()} == {0}


def test_hamming_index(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(20, 32))
    rows = [(i, (centres[i % 20] + rng.normal(size=32) * 0.3).tolist()) for i in range(1500)] + [(2000, None), (2001, [0.0] * 32), (2002, [1.0] * 31 + [None]), (2003, [float("nan")] * 32)]
    rows += [(3000 + i, rows[0][1]) for i in range(30)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    good = [(i, np.asarray(v)) for i, v in rows if i < 2000 or i >= 3000]
    got = {}
    for r in hamming_index.nearest(table, table.filter("vec_id % 50 = 0")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = total = 0
    for i, v in good:
        if i % 50 == 0:
            expected = hamming_index.exact(iter(good), v, i, 10)
            own = sorted(got[i])
            assert [x[0] for x in own] == list(range(1, len(own) + 1)) and [x[2] for x in own] == sorted(x[2] for x in own)
            hits += len({x[1] for x in own} & {x[0] for x in expected})
            total += 10
    assert hits >= 0.9 * total
    assert [x[1] for x in sorted(got[0])] == list(range(3000, 3010))  # ties go to the smaller id
    assert 2000 not in got and hamming_index.nearest(table.limit(0), table.limit(0)).count() == 0


def found_by(spark, rows, where, k=10):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string, score string, query_id string, id int, v int")
    got = {}
    for r in hamming_index.nearest(table, table.filter(where), k=k).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: [x[1:] for x in sorted(own)] for q, own in got.items()}


def test_every_query_gets_its_number(spark):
    """Outlying queries, few rows, and one; null and clashing extra columns."""
    rng = np.random.default_rng(3)
    extra = (None, "x", None, 1, None)
    rows = [(i, (rng.normal(size=64) * 0.02 + 1).tolist(), *extra) for i in range(1500)]
    rows += [(5000 + i, (-50 * rng.normal(size=64)).tolist(), *extra) for i in range(5)]
    got = found_by(spark, rows, "vec_id >= 5000 or vec_id % 300 = 0")
    assert len(got) == 10 and all(len(x) == 10 for x in got.values())
    few = found_by(spark, rows[:11], "vec_id % 5 = 0")
    assert len(few) == 3 and all(len(x) == 10 for x in few.values())
    for q, own in few.items():
        assert own == hamming_index.exact(((r[0], np.asarray(r[1])) for r in rows[:11]), np.asarray(rows[q][1]), q, 10)
    assert all(len(x) == 3 for x in found_by(spark, rows[:4], "true").values()) and found_by(spark, rows[:1], "true") == {}


def test_repeated_ids_count_once(spark):
    rng = np.random.default_rng(4)
    centre, extra = rng.normal(size=32), (None,) * 5
    rows = [(i % 40, (centre + rng.normal(size=32)).tolist(), *extra) for i in range(2000)] + [(100, centre.tolist(), *extra)] * 3
    got = found_by(spark, rows, "vec_id = 100")
    nearest = {}
    for i, v, *_ in rows[:2000]:
        d = float(np.sqrt(((np.asarray(v) - centre) ** 2).sum()))
        nearest[i] = min(d, nearest.get(i, d))
    own = got[100]
    assert len(own) == 10 and len({i for i, _ in own}) == 10
    assert len({i for i, _ in own} & set(sorted(nearest, key=nearest.get)[:10])) >= 9


def test_clustered_vectors_are_probed_in_part():
    """Vectors in clusters: a small radius, few rows probed, and the neighbours found."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(60, 64))
    x = np.concatenate([c + rng.normal(size=(50, 64)) * 0.05 for c in centres])
    model = hamming_index.fit_rotation(x, 10)
    index, hits, probed = hamming_index.Parts(model, x), 0, 0
    for i in range(0, 3000, 30):
        found = index.within(index.codes[i])
        probed += index.probed
        near = np.argsort(((x - x[i]) ** 2).sum(1), kind="stable")[1:11]
        hits += len(set(near.tolist()) & set(found.tolist()))
    assert hits >= 900 and probed < 0.1 * 3000 * 100


def test_parts_find_every_code_in_the_radius():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 24))
    model = hamming_index.fit_rotation(x, 10)
    index = hamming_index.Parts(model, x)
    for code in index.codes[:40]:
        far = index.popcount[index.codes ^ code].sum(1)
        assert index.within(code).tolist() == np.flatnonzero(far <= model.radius).tolist()


def test_items_are_whole_words(spark):
    docs = spark.createDataFrame([(1, "the cathode is hot"), (2, "The CAT, is hot"), (3, "cat"), (4, "concat")], "doc_id long, text string")
    found = decontaminate.leaks(docs, spark.createDataFrame([(1, "cat")], "item_id long, text string")).collect()
    assert {r.doc_id: [x.item_id for x in r.leaks] for r in found} == {1: [], 2: [1], 3: [1], 4: []}


def brute_purities(leaves):
    """{(host, template): purity} of (host, template without its first slash, blocked, labelled), plainly."""
    from collections import defaultdict

    rate = {(h, t): (b / n if n else None) for h, t, b, n in leaves}
    known = {(h, t): n > 0 for h, t, _, n in leaves}
    counts = {(h, t): (b, n) for h, t, b, n in leaves}
    group = {k: k for k in rate}
    for level in range(max(len(t.split("/")) for _, t in rate) - 1, -1, -1):
        own = defaultdict(list)
        for h, t in rate:
            p = t.split("/")
            if level < len(p):
                own[h, "/".join(p[:level]), "/".join(p[level + 1 :]), len(p), known[h, t]].append((h, t))
        pooled = defaultdict(lambda: [0, 0])
        for k, g in group.items():
            for i in (0, 1):
                pooled[g][i] += counts[k][i]
        chains = defaultdict(list)
        for place, some in own.items():
            for h, t in some if len(some) > 1 else ():
                b, n = pooled[group[h, t]]
                chains[place[:4], n > 0].append((b / n if n else 0.0, t.split("/")[level], b, n, group[h, t]))
        for (_, labelled), chain in chains.items():
            chain.sort(key=lambda x: x[:2])
            for (r1, _, b1, n1, g1), (r2, _, b2, n2, g2) in zip(chain, chain[1:], strict=False):
                if labelled:
                    p = (b1 + b2) / (n1 + n2)
                    if abs(r1 - r2) > url_filter.Z * (p * (1 - p) * (1 / n1 + 1 / n2)) ** 0.5:
                        continue
                x, y = ({group[k] for k in group if k in (g,) or group[k] == g or k == g} for g in (g1, g2))
                low = min(x | y)
                for k in group:
                    if group[k] in x | y:
                        group[k] = low
    prior = {}
    for h, t in rate:
        est, p = url_filter.PRIOR, t.split("/")
        for k in range(len(p)):
            votes = [r for (h2, t2), r in rate.items() if h2 == h and len(t2.split("/")) > k and t2.split("/")[:k] == p[:k] and r is not None]
            est = (sum(votes) + url_filter.STRENGTH * est) / (len(votes) + url_filter.STRENGTH)
        prior[h, t] = est
    out = {}
    for k, g in group.items():
        members = [m for m in group if group[m] == g]
        b, n = (sum(counts[m][i] for m in members) for i in (0, 1))
        out[k] = (b + url_filter.STRENGTH * sum(prior[m] for m in members) / len(members)) / (n + url_filter.STRENGTH)
    return out


def purity_of(spark, leaves):
    """What the operator finds for (host, head, rest, blocked, labelled)."""
    found = url_filter.purities(spark.createDataFrame(leaves, "host string, head string, rest string, blocked long, labelled long")).collect()
    expected = brute_purities([(h, a + b, x, n) for h, a, b, x, n in leaves])
    assert len(found) == len(leaves) and {(r.host, r.head + r.rest): round(r.purity, 6) for r in found} == {k: round(v, 6) for k, v in expected.items()}
    return {r.head + r.rest: r.purity for r in found}


def test_purities_by_brute_force(spark):
    rng = random.Random(21)
    for _ in range(3):
        leaves = {}
        for _ in range(40):
            parts = [rng.choice("abc") for _ in range(rng.randint(1, 4))]
            n = rng.choice([0, 0, 3, 20, 40])
            leaves[rng.choice(["g", "h"]), parts[0], "".join(f"/{p}" for p in parts[1:])] = (round(n * rng.choice([0, 0.05, 0.5, 1])), n)
        purity_of(spark, [(*k, *v) for k, v in leaves.items()])


def test_url_hot_host_and_repeated_rows(spark):
    """A host with most pages, repeated rows, and evidence of its branches for those without."""
    urls = [f"http://hot.com/{a}/{i}" for a in "abcdefghijkl" for i in range(30)] + ["http://hot.com/new/x"] * 5 + ["http://other.com/a/1", None, None]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    marks = [("hot.com", f"/{a}/{i}", True) for a in "abcdefghijkl" for i in range(10)]
    rows = url_filter.judge(pages, RULES, labels=spark.createDataFrame(marks, "host string, path string, blocked boolean")).collect()
    assert len(rows) == len(urls) and sorted(r.page_id for r in rows) == list(range(len(urls)))
    new = [r for r in rows if r.path == "/new/x"]
    assert len(new) == 5 and {r.verdict for r in new} == {"block"} and 0.8 <= new[0].purity < 0.95  # twelve blocked branches beside it
    assert {r.verdict for r in rows if r.host != "hot.com"} == {"allow"} and all(r.verdict == "block" for r in rows if r.host == "hot.com")


RULES = [Rule("block", "net/"), Rule("allow", "example.net/en/"), Rule("block", "example.com/de/"), Rule("allow", "org/fr/")]


def test_url_rules(spark):
    cases = {
        None: ("", "", None, "allow"), "no scheme": ("", "", None, "allow"), "http://A.Example.NET/en/1?x": ("a.example.net", "/en/1", "example.net/en/", "allow"),
        "http://example.net/de/1#y": ("example.net", "/de/1", "net/", "block"), "https://example.com/de/": ("example.com", "/de/", "example.com/de/", "block"),
        "https://notexample.com/de/": ("notexample.com", "/de/", None, "allow"), "x://b.org/fr/2": ("b.org", "/fr/2", "org/fr/", "allow"), "http://a.net": ("a.net", "", None, "allow"),
        "http://a.net?q=/": ("a.net", "", None, "allow"), "http://Ünet.org/EN": ("Ünet.org", "/EN", None, "allow"), "a://b://c.net/": ("b:", "//c.net/", None, "allow"),
    }
    pages = spark.createDataFrame(list(enumerate(cases)), "page_id long, url string")
    got = {r.url: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, RULES).collect()}
    assert got == cases
    assert url_filter.judge(pages.limit(0), RULES).count() == 0


def test_url_templates(spark):
    urls = [f"http://h.com/shop/{i}.html" for i in range(40)] + [f"http://h.com/blog/post-{chr(97 + i % 26)}{chr(97 + i // 26)}x/view" for i in range(60)] + ["http://h.com/about"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    marks = [("h.com", f"/shop/{i}.html", i > 0) for i in range(30)] + [("h.com", f"/blog/post-{chr(97 + i)}ax/view", False) for i in range(20)]
    rows = url_filter.judge(pages, RULES, labels=spark.createDataFrame(marks, "host string, path string, blocked boolean")).collect()
    assert {(r.template, r.verdict) for r in rows} == {("/shop/#.html", "block"), ("/blog/*/view", "allow"), ("/about", "allow")}
    root = (29 / 30 + 0 + 4 * 0.5) / (2 + 4)
    shop = (29 / 30 + 4 * root) / (1 + 4)
    assert {round(r.purity, 6) for r in rows if r.template.startswith("/shop")} == {round((29 + 4 * shop) / (30 + 4), 6)}
    # siblings with like rates are one branch, unlike ones are not
    purity = purity_of(spark, [("h", "a", "/#", 9, 10), ("h", "b", "/#", 18, 20), ("h", "c", "/#", 0, 20), ("h", "d", "/#", 0, 0)])
    assert purity["a/#"] == purity["b/#"] > 0.8 and purity["c/#"] < 0.2 and 0.5 < purity["d/#"] < 0.6


def test_url_templates_of_deep_paths(spark):
    """Branches below the fourth level are told apart, and like siblings below the first are pooled."""
    urls = [f"http://h.com/a/b/c/d/{x}/{i}" for x in ("spam", "good") for i in range(40)] + ["http://h.com/" + "x/" * 60]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    marks = [("h.com", f"/a/b/c/d/{x}/{i}", x == "spam") for x in ("spam", "good") for i in range(30)]
    rows = url_filter.judge(pages, RULES, labels=spark.createDataFrame(marks, "host string, path string, blocked boolean")).collect()
    assert {(r.template, r.verdict) for r in rows[:]} == {("/a/b/c/d/spam/#", "block"), ("/a/b/c/d/good/#", "allow"), ("/" + "x/" * 60, "allow")}
    leaves = [("h", "a", "/b/x/#", 9, 10), ("h", "a", "/b/y/#", 18, 20), ("h", "a", "/b/z/#", 0, 20), ("h", "a", "/c/x", 1, 1)]
    purity = purity_of(spark, leaves)
    assert purity["a/b/x/#"] == purity["a/b/y/#"] > 0.8 and purity["a/b/z/#"] < 0.2 and 0.5 < purity["a/c/x"] < 0.8
