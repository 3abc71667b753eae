"""Language of texts, and of spans in texts of mixed language.

A text is a sequence of words. The script of a word (by code point ranges) narrows the candidate
languages; each candidate scores the word with a mixture of its word counts and an interpolated
character trigram model; Viterbi with a penalty for each switch labels the words. Runs of one
label are the spans; the language with most letters is the text's.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import bounded_batches, coded, discard, rows_of, stored, texts, words_of

#: Log-probability that one change of language costs.
SWITCH = 8.0
#: Training rows for each language, about: chosen by the hash of their text.
MAX_ROWS = 1_500
#: Words with counts that the model keeps of each language, the most frequent; spelling and scripts are learnt from all.
MAX_WORDS = 80_000
#: Hash slots of the character models.
SLOTS = 1 << 16
#: Words whose scores a Python worker remembers before it starts anew.
WORDS_KEPT = 150_000
#: Weights of words are summed as whole numbers of this fraction: the order of the sum does not matter.
UNIT = 1 << 20
#: A script belongs to a language if it holds this share of its training letters.
SCRIPT_SHARE = 0.02
#: Score of a word in a language that does not use its script.
FOREIGN = -40.0
#: Weights of trigram, bigram, single character, and any character.
MIXTURE = (0.7, 0.2, 0.09, 0.01)

# fixed values: code point ranges of scripts (Unicode blocks), in order
SCRIPTS = (
    (0x0041, 0x024F, "Latin"), (0x0250, 0x02AF, "Latin"), (0x0370, 0x03FF, "Greek"), (0x0400, 0x052F, "Cyrillic"), (0x0530, 0x058F, "Armenian"),
    (0x0590, 0x05FF, "Hebrew"), (0x0600, 0x06FF, "Arabic"), (0x0700, 0x074F, "Syriac"), (0x0750, 0x077F, "Arabic"), (0x0780, 0x07BF, "Thaana"),
    (0x0900, 0x097F, "Devanagari"), (0x0980, 0x09FF, "Bengali"), (0x0A00, 0x0A7F, "Gurmukhi"), (0x0A80, 0x0AFF, "Gujarati"), (0x0B00, 0x0B7F, "Oriya"),
    (0x0B80, 0x0BFF, "Tamil"), (0x0C00, 0x0C7F, "Telugu"), (0x0C80, 0x0CFF, "Kannada"), (0x0D00, 0x0D7F, "Malayalam"), (0x0D80, 0x0DFF, "Sinhala"),
    (0x0E00, 0x0E7F, "Thai"), (0x0E80, 0x0EFF, "Lao"), (0x0F00, 0x0FFF, "Tibetan"), (0x1000, 0x109F, "Myanmar"), (0x10A0, 0x10FF, "Georgian"),
    (0x1100, 0x11FF, "Hangul"), (0x1200, 0x137F, "Ethiopic"), (0x1780, 0x17FF, "Khmer"), (0x1800, 0x18AF, "Mongolian"), (0x1E00, 0x1EFF, "Latin"),
    (0x1F00, 0x1FFF, "Greek"), (0x3040, 0x309F, "Hiragana"), (0x30A0, 0x30FF, "Katakana"), (0x3400, 0x4DBF, "Han"), (0x4E00, 0x9FFF, "Han"),
    (0xAC00, 0xD7AF, "Hangul"), (0xF900, 0xFAFF, "Han"), (0xFB50, 0xFDFF, "Arabic"), (0xFE70, 0xFEFF, "Arabic"), (0x20000, 0x3FFFF, "Han"),
)
_STARTS = np.asarray([s[0] for s in SCRIPTS])
_ENDS = np.asarray([s[1] for s in SCRIPTS])
_NAMES = sorted({s[2] for s in SCRIPTS})
_CODES = np.asarray([_NAMES.index(s[2]) for s in SCRIPTS])


class Spelling:
    """Code points of words end to end, each as ^^word$, with the slots of their n-grams."""

    def __init__(self, words: list[str]):
        sizes = np.fromiter((len(w) for w in words), np.int64, len(words))
        letters = np.frombuffer("".join(words).encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
        self.n = len(words)
        #: the letters and the end sign of each word
        ends = np.cumsum(sizes + 1)
        self.row = np.repeat(np.arange(self.n), sizes + 1)
        points = np.zeros(int(ends[-1]) if self.n else 0, np.int64)
        inner = np.ones(len(points), bool)
        inner[ends - 1] = False
        points[inner] = letters
        first = np.zeros(len(points), bool)
        first[ends - sizes - 1] = True
        before = np.where(first, 1, np.concatenate(([0], points[:-1])))
        second = np.concatenate(([False], first[:-1]))
        before2 = np.where(first | second, 1, np.concatenate(([0, 0], points[:-2]))[: len(points)])
        self.letters, self.inner = points, inner
        single = points % SLOTS
        self.contexts = ((before * 40503 + before2 * 8191) % SLOTS, before % SLOTS)
        self.grams = ((before * 40503 + before2 * 8191 + points * 29) % SLOTS, (before * 331 + points * 29) % SLOTS, single)

    def scripts(self) -> np.ndarray:
        """Script code of each letter, -1 for others."""
        at = np.searchsorted(_STARTS, self.letters, "right") - 1
        return np.where(self.inner & (at >= 0) & (self.letters <= _ENDS[at]), _CODES[at], -1)


@dataclass
class Model:
    languages: list[str]
    words: dict[str, int]  # rows of counts
    totals: np.ndarray
    grams: list[np.ndarray]  # slots x languages, of three, two and one characters
    contexts: list[np.ndarray]
    scripts: np.ndarray  # languages x scripts
    counts: np.ndarray | None = None  # words x languages


def sampled(docs: DataFrame, text: Column, lang: Column, max_rows: int) -> DataFrame:
    """(lang, text) of about max_rows rows of each language, by the hash of the text."""
    rows = docs.select(lang.cast("string").alias("lang"), text.alias("text")).filter("lang is not null and text is not null")
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, max_rows / n)]) if counts else None
    if share is None:
        return rows
    return rows.filter(F.pmod(F.xxhash64(F.lit(11), "text"), F.lit(1 << 30)) < F.try_element_at(share, F.col("lang")) * (1 << 30))


def fit(docs: DataFrame, *, text: str = "text", lang: str = "lang", max_rows: int = MAX_ROWS, max_words: int = MAX_WORDS) -> Model:
    """Learn from rows with text and language; about max_rows of each language are read.

    Words are counted in the executors, and so are the characters and scripts of all of them; the
    max_words most frequent words of each language come to the driver. The languages are those
    of the labelled rows. Rows with a null in either column are not used; repeated rows count
    each; without any row the model has no language and identifies nothing.
    """
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, "text"):
            names, tags = coded(batch.column("lang"))
            words, offsets = words_of(texts(batch))
            codes, distinct = coded(words)
            row_lang = np.repeat(names, np.diff(offsets))
            for i, name in enumerate(tags):
                n = np.bincount(codes[row_lang == i], minlength=len(distinct))
                used = [j for j in np.flatnonzero(n) if distinct[j]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(used), pa.string()), pa.array([distinct[j] for j in used], pa.string()), pa.array(n[used], pa.int64())], ["lang", "word", "n"]
                )

    bounded_batches(docs.sparkSession)
    sample = sampled(docs, docs[f"`{text}`"], docs[f"`{lang}`"], max_rows)
    counted = sample.mapInArrow(count, schema).groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counted = stored(counted, "language-words")
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    rows = counted.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= max_words).select("lang", "word", "n").toArrow()
    parts = T.StructType([T.StructField("lang", T.StringType()), T.StructField("kind", T.IntegerType()), T.StructField("slot", T.LongType()), T.StructField("n", T.LongType())])

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, tags = coded(batch.column("lang"))
            spelled = Spelling(batch.column("word").to_pylist())
            # each distinct word counts once and its logarithm more: frequent words do not drown spelling
            weight = np.round(np.log1p(np.asarray(batch.column("n"))) * UNIT)[spelled.row]
            scripts = spelled.scripts()
            for kind, slots in enumerate([*spelled.grams, *spelled.contexts, scripts]):
                for i, tag in enumerate(tags):
                    own = (codes[spelled.row] == i) & (slots >= 0)
                    at, place = np.unique(slots[own], return_inverse=True)
                    n = np.bincount(place, weight[own], len(at)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([tag] * len(at), pa.string()), pa.array([kind] * len(at), pa.int32()), pa.array(at, pa.int64()), pa.array(n)], [f.name for f in parts.fields])

    spelt = counted.mapInArrow(spell, parts).groupBy("lang", "kind", "slot").agg(F.sum("n").alias("n")).toArrow()
    discard(counted)
    languages = sorted(r.lang for r in sample.select("lang").distinct().collect())
    place = {name: i for i, name in enumerate(languages)}
    width = len(languages)
    known: dict[str, int] = {}
    at = np.fromiter((known.setdefault(w, len(known)) for w in rows.column("word").to_pylist()), np.int64, rows.num_rows)
    counts = np.zeros((len(known), width), np.float32)
    np.add.at(counts, (at, np.fromiter((place[x] for x in rows.column("lang").to_pylist()), np.int64, rows.num_rows)), np.asarray(rows.column("n")))
    totals = counts.sum(0, dtype=np.float64)
    own = np.fromiter((place[x] for x in spelt.column("lang").to_pylist()), np.int64, spelt.num_rows)
    kind, slot, n = (np.asarray(spelt.column(c)) for c in ("kind", "slot", "n"))
    tables = []
    for k, size in enumerate([SLOTS] * 5 + [len(_NAMES)]):
        tables.append(np.zeros((size, width)))
        tables[k][slot[kind == k], own[kind == k]] = n[kind == k] / UNIT
    letters = tables[5].T
    scripts = letters / np.maximum(1e-9, letters.sum(1, keepdims=True)) >= SCRIPT_SHARE
    tables = [t.astype(np.float32) for t in tables]
    return Model(languages, known, totals, tables[:3], tables[3:5], scripts, counts)


class Identifier:
    """Labels words in one worker."""

    def __init__(self, model: Model, switch: float):
        self.model, self.switch, self.width = model, switch, len(model.languages)
        totals = model.grams[2].sum(0)
        over = lambda g, c: g / np.maximum(c, 1e-9)
        self.single = over(model.grams[2], totals)
        self.over = over
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {"": 0}
        self.scores = np.zeros((1, self.width), np.float32)

    def score(self, words: list[str]) -> np.ndarray:
        """Log-probability of each word in each language."""
        if not self.width:
            return np.zeros((len(words), 0), np.float32)
        m, s = self.model, Spelling(words)
        chars = MIXTURE[3] / SLOTS + MIXTURE[2] * self.single[s.grams[2]]
        for i in (0, 1):
            chars += MIXTURE[i] * np.minimum(1, self.over(m.grams[i][s.grams[i]], m.contexts[i][s.contexts[i]]))
        logs = np.zeros((len(words), self.width))
        np.add.at(logs, s.row, np.log(chars))
        at = np.fromiter((m.words.get(w, -1) for w in words), np.int64, len(words))
        own = np.zeros((len(words), self.width))
        if (at >= 0).any():
            own[at >= 0] = m.counts[at[at >= 0]] / np.maximum(1, m.totals)
        out = np.logaddexp(logs + np.log(0.5), np.log(0.5 * own + 1e-300))
        # candidates by script: the languages that use the script of most letters
        codes, rows = s.scripts(), s.row
        seen = np.bincount(rows[codes >= 0] * len(_NAMES) + codes[codes >= 0], minlength=len(words) * len(_NAMES)).reshape(len(words), -1)
        allowed = m.scripts[:, seen.argmax(1)].T & (seen.max(1) > 0)[:, None]
        none = ~allowed.any(1)
        out = np.where(allowed, out, np.where(none[:, None], 0.0, out.max(1, keepdims=True) + FOREIGN))
        return out.astype(np.float32)

    def rows(self, distinct: list[str]) -> np.ndarray:
        if len(self.known) > WORDS_KEPT:
            self.forget()
        missing = [w for w in distinct if w not in self.known]
        fresh = [self.scores]
        for i in range(0, len(missing), 20_000):
            fresh.append(self.score(missing[i : i + 20_000]))
        self.known.update(zip(missing, range(len(self.scores), len(self.scores) + len(missing)), strict=True))
        self.scores = np.concatenate(fresh)
        return np.fromiter((self.known[w] for w in distinct), np.int64, len(distinct))

    def path(self, scores: np.ndarray) -> np.ndarray:
        """Viterbi labels of the words of one text; ties go to the language that is first by name."""
        best = int(scores.sum(0, dtype=np.float64).argmax())
        # one language throughout is optimal if no run of words gains more in another than a switch costs
        gain = np.concatenate((np.zeros((1, self.width)), np.cumsum(scores - scores[:, best : best + 1], 0, dtype=np.float64)))
        if (gain - np.minimum.accumulate(gain)).max() <= self.switch:
            return np.full(len(scores), best)
        back, value = [], scores[0].tolist()
        for own in scores[1:].tolist():
            top = max(value)
            at, floor = value.index(top), top - self.switch
            back.append([i if v >= floor else at for i, v in enumerate(value)])
            value = [(v if v >= floor else floor) + o for v, o in zip(value, own, strict=True)]
        label = value.index(max(value))
        labels = [label]
        for step in reversed(back):
            label = step[label]
            labels.append(label)
        return np.asarray(labels[::-1])


SPAN = T.StructType([
    T.StructField("lang", T.StringType()), T.StructField("first_word", T.IntegerType()), T.StructField("n_words", T.IntegerType()), T.StructField("n_letters", T.IntegerType()),
])


def identify(docs: DataFrame, model: Model, *, text: str = "text", switch: float = SWITCH, spans: bool = True) -> DataFrame:
    """docs with lang_pred, score and (with spans) the spans of one language, in order.

    score: share of the text's letters that the predicted language's spans hold. A null text and
    one without a letter get `und`, score 0.0 and no span; letters of a script that no language
    uses count for the language of the words around them. Repeated rows and other columns stay;
    columns named lang_pred, score, spans are replaced. first_word counts the text's words (runs
    of letters and marks) from 0.
    """
    new = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), *([T.StructField("spans", T.ArrayType(SPAN))] if spans else [])]
    kept = [c for c in docs.columns if c not in {"lang_pred", "score", "spans"}]
    inner = docs.select(*[docs[f"`{c}`"] for c in kept], docs[f"`{text}`"].alias("__text"))
    schema = T.StructType([*docs.select(*[f"`{c}`" for c in kept]).schema.fields, *new])
    session = docs.sparkSession
    shared = session.sparkContext.broadcast(model)  # bounded by languages, MAX_WORDS and SLOTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = Identifier(shared.value, switch)
        names = work.model.languages
        for batch in rows_of(batches, "__text"):
            words, offsets = words_of(texts(batch, "__text"))
            codes, distinct = coded(words)
            full = np.asarray([bool(w) for w in distinct], bool)[codes] if len(codes) else np.zeros(0, bool)
            # a word of marks alone has no letter
            letters = np.asarray([sum(c.isalpha() for c in w) if not w.isalpha() else len(w) for w in distinct], np.int64)
            place = work.rows(distinct)
            langs, scores, every = [], [], []
            for i in range(batch.num_rows):
                own = codes[offsets[i] : offsets[i + 1]]
                own = own[full[offsets[i] : offsets[i + 1]]]
                size = letters[own]
                total = int(size.sum())
                if not total or not names:
                    langs.append("und"), scores.append(0.0), every.append([])
                    continue
                labels = work.path(work.scores[place[own]])
                share = np.bincount(labels, size, len(names))
                langs.append(names[int(share.argmax())]), scores.append(float(share.max() / total))
                if spans:
                    cuts = np.concatenate(([0], np.flatnonzero(np.diff(labels)) + 1, [len(labels)])).tolist()
                    every.append([{"lang": names[labels[a]], "first_word": a, "n_words": b - a, "n_letters": int(size[a:b].sum())} for a, b in zip(cuts, cuts[1:], strict=False)])
            columns = [batch.column(j) for j in range(len(kept))] + [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            if spans:
                inner_type = pa.struct([("lang", pa.string()), ("first_word", pa.int32()), ("n_words", pa.int32()), ("n_letters", pa.int32())])
                columns.append(pa.array(every, pa.list_(inner_type)))
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in schema.fields])

    bounded_batches(session)
    return inner.mapInArrow(run, schema)
