"""Language identification by interpolated Kneser-Ney character models.

For each language a model of order ``ORDER`` over the letters of a word, begun and ended by a mark; lower orders count
in how many contexts a letter occurs.  All n-grams of all languages are kept as sorted arrays of 64-bit hashes.  A text
goes to the language with the lowest cross-entropy a letter; softmax with a temperature fitted on training rows held
back gives the score, and texts under a score that nearly all of those reach are rejected.  So are texts whose
cross-entropy is far above that of the rows held back in their language: they are in none of the languages learned.

As a model's context ends at the word, a text's entropy is a sum over words: workers remember the sums of words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, free, table, texts

ORDER = 4
DISCOUNT = 0.75
#: Bound of the sample a model is fitted on: documents a language.  Rows are taken by a hash of their id.
FIT_DOCS = 1_000
#: Languages learned at most, the most frequent first: the sample is bounded whatever a column holds.
LANGS = 256
#: Entries of a worker's tables of words and of n-grams.
CACHE = 150_000
#: A text's bits a letter may be so many times those of nearly all rows held back.
LOOSE = 1.5
UNKNOWN = "und"
LETTERS = re.compile(r"[^\W\d_]+")


def letters(text: str) -> Counter:
    """Counts of the lower-case words of letters; signs that only stand for numbers are no letters."""
    found = Counter(LETTERS.findall(text.lower()))
    for w in [w for w in found if not w.isalpha()]:
        n = found.pop(w)
        for part in "".join(c if c.isalpha() else " " for c in w).split():
            found[part] += n
    return found


def _hashes(grams: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(g) for g in grams], np.uint64)


class KneserNey:
    """Models of all languages.  words: language -> word -> count."""

    def __init__(self, words: dict[str, Counter], order: int = ORDER, discount: float = DISCOUNT):
        self.order, self.langs = order, sorted(words)
        alphabet = {c for w in words.values() for x in w for c in x}
        self.memory = Memory(CACHE)
        self.base = 1 / (len(alphabet) + 2)  # the end mark and letters never seen
        self.grams: list[list[tuple[np.ndarray, np.ndarray]]] = []
        self.contexts: list[list[tuple[np.ndarray, np.ndarray]]] = []
        for lang in self.langs:
            top: Counter = Counter()
            for word, n in words[lang].items():
                marked = "\x02" * (order - 1) + word + "\x03"
                for i in range(len(word) + 1):
                    top[marked[i : i + order]] += n
            counts = {order: top}
            for k in range(order - 1, 0, -1):
                counts[k] = Counter(g[1:] for g in counts[k + 1])
            lower: dict[str, float] = {}
            grams, contexts = [], []
            for k in range(1, order + 1):
                total: Counter = Counter()
                kinds: Counter = Counter()
                for g, n in counts[k].items():
                    total[g[:-1]] += n
                    kinds[g[:-1]] += 1
                back = {c: discount * kinds[c] / total[c] for c in total}
                lower = {g: (n - discount) / total[g[:-1]] + back[g[:-1]] * (lower[g[1:]] if k > 1 else self.base) for g, n in counts[k].items()}
                grams.append(self._sorted(lower))
                contexts.append(self._sorted(back))
            self.grams.append(grams)
            self.contexts.append(contexts)

    @staticmethod
    def _sorted(values: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
        h = _hashes(list(values))
        order = np.argsort(h)
        return h[order], np.array(list(values.values()))[order]

    @staticmethod
    def _find(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray, missing: float) -> tuple[np.ndarray, np.ndarray]:
        h, v = table
        at = np.minimum(np.searchsorted(h, keys), len(h) - 1)
        hit = h[at] == keys
        return np.where(hit, v[at], missing), hit

    def _grams_bits(self, grams: list[str]) -> np.ndarray:
        """Minus log2 of each whole gram's last letter (rows) under each language (columns)."""
        keys = [_hashes([g[self.order - k :] for g in grams]) for k in range(1, self.order + 1)]
        befores = [_hashes([g[self.order - k : -1] for g in grams]) for k in range(1, self.order + 1)]
        out = np.empty((len(grams), len(self.langs)))
        for j in range(len(self.langs)):
            p = np.full(len(grams), self.base)
            for k in range(self.order):
                seen, hit = self._find(self.grams[j][k], keys[k], 0.0)
                back, _ = self._find(self.contexts[j][k], befores[k], 1.0)
                p = np.where(hit, seen, back * p)
            out[:, j] = -np.log2(p)
        return out

    def bits(self, words: list[str]) -> np.ndarray:
        """Minus log2 of each word's probability (rows) under each language (columns)."""
        n = self.order
        marked = ["\x02" * (n - 1) + w + "\x03" for w in words]
        tops = [m[i : i + n] for m in marked for i in range(len(m) - n + 1)]
        starts = np.cumsum([0, *(len(m) - n + 1 for m in marked[:-1])])
        return np.add.reduceat(self.memory.rows(tops, self._grams_bits), starts, axis=0)


class Memory:
    """Rows of numbers by key; a full memory is emptied."""

    def __init__(self, most: int):
        self.most, self.at, self.values = most, {}, None

    def __getstate__(self):
        return {"most": self.most, "at": {}, "values": None}

    def rows(self, keys: list[str], compute) -> np.ndarray:
        """The rows of keys; compute(new keys) gives those not kept."""
        if fresh := set(keys).difference(self.at):
            if len(self.at) + len(fresh) > self.most:
                self.at, self.values, fresh = {}, None, set(keys)
            fresh = sorted(fresh)
            got = compute(fresh)
            n = len(self.at)
            if self.values is None or n + len(got) > len(self.values):
                room = np.empty((max(2 * n, n + len(got), 4096), got.shape[1]))
                if n:
                    room[:n] = self.values[:n]
                self.values = room
            self.values[n : n + len(got)] = got
            self.at.update(zip(fresh, range(n, n + len(got)), strict=True))
        return self.values[np.fromiter(map(self.at.__getitem__, keys), np.int64, len(keys))]


class Identifier:
    def __init__(self, model: KneserNey, temperature: float = 1.0, threshold: float = 0.0, most: np.ndarray | None = None):
        self.model, self.temperature, self.threshold = model, temperature, threshold
        self.most = np.full(len(model.langs), np.inf) if most is None else most  # bits a letter, by language
        self.memory = Memory(CACHE)

    def all_entropies(self, texts_: list[str]) -> list[np.ndarray | None]:
        """Bits a letter (the end mark counted) of each text under each language; None without letters."""
        counts = [letters(t) for t in texts_]
        words = [w for c in counts for w in c]
        if not words or not self.model.langs:
            return [None] * len(texts_)
        rows = self.memory.rows(words, self.model.bits)
        n = np.fromiter((k for c in counts for k in c.values()), float, len(words))
        size = np.fromiter(map(len, words), float, len(words)) + 1
        some = [k for k, c in enumerate(counts) if c]
        starts = np.cumsum([0, *(len(counts[k]) for k in some[:-1])])
        h = np.add.reduceat(rows * n[:, None], starts, axis=0) / np.add.reduceat(n * size, starts)[:, None]
        out: list[np.ndarray | None] = [None] * len(texts_)
        for k, x in zip(some, h, strict=True):
            out[k] = x
        return out

    def judge_all(self, texts_: list[str]) -> list[tuple[str, float, bool]]:
        """Language, score and rejection of each text."""
        return [self._judge(h) for h in self.all_entropies(texts_)]

    def _judge(self, h: np.ndarray | None) -> tuple[str, float, bool]:
        if h is None:
            return UNKNOWN, 0.0, True
        k = int(h.argmin())
        score = float(1 / np.exp2((h[k] - h) * self.temperature).sum())
        return self.model.langs[k], score, bool(score < self.threshold or h[k] > self.most[k])


def calibrate(model: KneserNey, found: list[tuple[str, np.ndarray]]) -> Identifier:
    """Temperature of least log loss on rows (language, entropies), a threshold that all but one in 1000 of those it gets
    right reach, and a limit of the cross-entropy in each language (of all rows, where a language has none)."""
    some = [(h, model.langs.index(lang)) for lang, h in found if lang in model.langs]
    if not some:
        return Identifier(model)
    h, y = np.array([x for x, _ in some]), np.array([k for _, k in some])

    def scores(t: float) -> np.ndarray:
        z = np.exp2((h.min(1, keepdims=True) - h) * t)
        return z / z.sum(1, keepdims=True)

    t = min((2.0**k for k in range(-2, 8)), key=lambda t: -np.log(np.maximum(scores(t)[np.arange(len(y)), y], 1e-12)).mean())
    s = scores(t)
    ok = s.argmax(1) == y
    if not ok.any():
        return Identifier(model, t)
    bits = h.min(1)
    most = [LOOSE * float(np.quantile(bits[some if some.any() else ok], 0.999)) for some in (ok & (y == k) for k in range(len(model.langs)))]
    return Identifier(model, t, min(float(np.quantile(s[np.arange(len(y)), y][ok], 0.001)) / 2, 0.5), np.array(most))


def fit(rows: DataFrame, id_col: str, text_col: str = "text", lang_col: str = "lang", fit_docs: int = FIT_DOCS) -> Identifier:
    """Fit on at most about ``fit_docs`` rows of each of the ``LANGS`` most frequent languages, one in ten of them held back
    to calibrate.

    Rows without a language or text take no part.  No rows: everything is ``und``.  Repeated rows are drawn together.
    Texts are counted, and scored to calibrate, where they are: only counts and entropies come to the driver.
    """
    rows = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGS).collect()}
    if not sizes:
        return Identifier(KneserNey({}))
    parts = 1 << 30
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(parts, max(1, parts * fit_docs // n)))) for k, n in sizes.items()])
    draw = F.pmod(F.xxhash64("id"), F.lit(parts))
    sample = rows.where(draw < share).withColumn("held", F.pmod(F.hash("id"), F.lit(10)) == 0)
    bounded_batches(rows.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[str, Counter] = {}
        for b in batches:
            for text, lang in zip(texts(b, "text"), b.column(1).to_pylist(), strict=True):
                by.setdefault(lang, Counter()).update(letters(text))
        for lang, words in by.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words)), pa.array(list(words)), pa.array(list(words.values()), pa.int64())], names=["lang", "word", "n"])

    counted = sample.where("not held").select("text", "lang").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words: dict[str, Counter] = {}
    for r in counted.toArrow().to_batches():  # of the bounded sample
        for lang, word, n in zip(*(c.to_pylist() for c in r.columns), strict=True):
            words.setdefault(lang, Counter())[word] = n
    model = KneserNey(words)
    plain = rows.sparkSession.sparkContext.broadcast(Identifier(model))  # bounded by the sample

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(lang, h.tolist()) for lang, h in zip(b.column(1).to_pylist(), plain.value.all_entropies(list(texts(b, "text"))), strict=True) if h is not None]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in got], pa.string()), pa.array([h for _, h in got], pa.list_(pa.float64()))], names=["lang", "h"])

    held = sample.where("held").select("text", "lang").mapInArrow(score, "lang string, h array<double>").collect()
    return calibrate(model, [(r.lang, np.array(r.h)) for r in held])


def identify(docs: DataFrame, model: Identifier, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (columns ``keep``) with lang_pred, lang_score and lang_rejected.  Null texts and texts without letters:
    ``und``, 0, rejected.

    Texts are taken whole, however long: a text's entropy is a sum over its distinct words.  Repeated rows are judged
    each; ties go to the first language by name; no rows: no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # bounded by the sample
    keep = list(docs.columns) if keep is None else keep
    given = free(docs.columns, "text")
    kept = docs.select(*keep, F.col(text_col).alias(given))
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("lang_score", "double").add("lang_rejected", "boolean")
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = shared.value.judge_all(list(texts(b, given)))
            lang, score, rejected = (pa.array([x[i] for x in found], k) for i, k in enumerate((pa.string(), pa.float64(), pa.bool_())))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], lang, score, rejected], names=names)

    return kept.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id", parts: int = 3, part: int = 1) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == part


def op6(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~F.coalesce(held_out(), F.lit(True))), "doc_id")
    found = identify(docs, model, keep=["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents whose language is told with enough certainty, in their own columns; the model learns from docs."""
    model = fit(docs, "doc_id")
    # docs' columns travel within a struct: whatever their names, they don't meet those made here
    bare = docs.select(F.struct(*docs.columns).alias("row"), F.col("text").alias("text"))
    return identify(bare, model, keep=["row"]).where("not lang_rejected").select("row.*")
