"""Quality rules: repetition counts, then divergence of a document's histograms from language references.

A language's reference is its distribution over character classes and over its most common words (all others are one
word), learned from labelled texts. A document is kept if, for some language, the Jensen-Shannon distance (root of the
divergence to base 2, 0 to 1) of both of its histograms is small enough. Histograms of too few characters or words say
nothing, so each comparison has a least length.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textshield import runtime
from textshield.llm import rows

LEAST_WORDS, MOST_REPEATED, WINDOW = 20, 30, 8

SYMBOLS = "#*$%&|<>"

#: Common words kept of each language; most languages.
COMMON, MOST_LANGUAGES = 40, 4096

#: Words lower-cased at once, and words of a language added up at once.
RUN, ADDED_UP = 20_000, 200_000


@dataclass(frozen=True)
class Limits:
    """Largest distances, and least lengths for them to count."""

    classes: float = 0.18
    words: float = 0.36
    least_chars: int = 200
    least_words: int = 100


_WORDS = re.compile("[^\x20\x09-\x0d]+")
_SEPARATORS = re.compile("[\x1c-\x1f]")
_EDGES = ".,;:!?\"'()"

#: Kinds of characters: lower case, upper case, other letters and marks, digits, blanks, sentence marks, all else.
KINDS = 7

_kinds: list[np.ndarray] = []


def _kind(i: int) -> int:
    c, g = chr(i), unicodedata.category(chr(i))
    if g[0] in "LM":
        return 0 if g == "Ll" else 1 if g in ("Lu", "Lt") else 2
    return 3 if g[0] == "N" else 4 if g[0] == "Z" or c in "\t\n\v\f\r" else 5 if c in ".,;:!?'\"()-" or (g[0] == "P" and i > 127) else 6


def kinds() -> np.ndarray:
    if not _kinds:
        _kinds.append(np.fromiter(map(_kind, range(0x110000)), np.uint8, 0x110000))
    return _kinds[0]


def kind_counts(text: str) -> np.ndarray:
    return np.bincount(kinds()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)], minlength=KINDS)


def repeated_words(words: list[str], window: int = WINDOW) -> int:
    """Words that lie in a window which occurs twice or more, first occurrences included.

    Windows are numbered exactly: by equal pairs of words, then of pairs, and so on. Where all of one length differ, so do
    longer ones.
    """
    n = len(words) - window + 1
    if n < 2:
        return 0
    number = dict(zip(words, range(len(words)), strict=True))
    if len(number) > len(words) - window:  # too few words occur again
        return 0
    ids, size = np.fromiter(map(number.__getitem__, words), np.int64, len(words)), 1
    while size < window:
        step = min(size, window - size)
        found, ids = np.unique(ids[: len(ids) - step] * (int(ids.max()) + 1) + ids[step:], return_inverse=True)
        if len(found) == len(ids):
            return 0
        size += step
    again = (np.bincount(ids) > 1)[ids].astype(np.int64)
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:n] += again
    edge[window:] -= again
    return int((np.cumsum(edge[:-1]) > 0).sum())


def split(text: str) -> list[str]:
    return text.split() if text.isascii() and not _SEPARATORS.search(text) else _WORDS.findall(text)


def base(text: str) -> tuple[list[str], int, int, int, int]:
    """Words, their code points, symbols, duplicate lines, repeated words."""
    words = split(text)
    lines = [x for x in text.split("\n") if _WORDS.search(x)]
    return words, sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def failed(n_words: int, n_repeat: int) -> bool:
    return n_words < LEAST_WORDS or 100 * n_repeat > MOST_REPEATED * n_words


def distances(found: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of one histogram from each row of distributions."""
    p = found / max(found.sum(), 1)
    m = (p + references) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = np.where(p > 0, p * np.log2(p / m), 0) + np.where(references > 0, references * np.log2(references / m), 0)
    return np.sqrt(np.clip(parts.sum(-1) / 2, 0, 1))


def plain_words(words: list[str]) -> Iterator[list[str]]:
    """The words in lower case without marks at their ends, in runs of bounded length (a blank ends what lower() looks at)."""
    for at in range(0, len(words), RUN):
        yield [w.strip(_EDGES) for w in " ".join(words[at : at + RUN]).lower().split(" ")]


class References:
    """Distributions of the languages: kinds of characters, and common words of any of them with one for all others."""

    def __init__(self, kinds_of: dict[str, np.ndarray], words_of: dict[str, dict[str, float]]):
        self.languages = sorted(kinds_of)
        self.place = {w: i for i, w in enumerate(sorted({w for c in words_of.values() for w in c}))}
        self.kinds = np.array([kinds_of[x] / max(kinds_of[x].sum(), 1) for x in self.languages]).reshape(-1, KINDS)
        self.words = np.zeros((len(self.languages), len(self.place) + 1))
        for i, x in enumerate(self.languages):
            for w, share in words_of.get(x, {}).items():
                self.words[i, self.place[w]] = share
            self.words[i, -1] = 1 - self.words[i].sum()

    def compare(self, text: str, words: list[str], limits: Limits) -> tuple[str | None, float | None, float | None, bool]:
        """Language that comes closest, distances from it (null: too short), and whether any is close enough."""
        if not self.languages:
            return None, None, None, True
        a = distances(kind_counts(text), self.kinds) if len(text) >= limits.least_chars else None
        b = None
        if len(words) >= limits.least_words:
            n = len(self.place) + 1
            found = sum(np.bincount(np.fromiter(map(self.place.get, x, repeat(n - 1)), np.int64, len(x)), minlength=n) for x in plain_words(words))
            b = distances(found, self.words)
        worst = np.maximum(0 if a is None else a / limits.classes, 0 if b is None else b / limits.words)
        if np.ndim(worst) == 0:
            return None, None, None, True
        i = int(worst.argmin())
        return self.languages[i], None if a is None else float(a[i]), None if b is None else float(b[i]), bool(worst[i] <= 1)


class _Taught:
    """What texts of one language in a batch add to its sums."""

    def __init__(self):
        self.kinds, self.words, self.sizes, self.shares = np.zeros(KINDS + 1), [], [], []

    def add(self, name: str, text: str, words: list[str]):
        k = kind_counts(text)
        self.kinds += np.append(k / k.sum(), 1)
        for some in plain_words(words):
            self.words += some
            self.sizes.append(len(some))
            self.shares.append(1 / len(words))
            if len(self.words) >= ADDED_UP:
                yield self.word_sums(name)

    def word_sums(self, name: str) -> pa.RecordBatch:
        found = pa.array(self.words, pa.string()).dictionary_encode()
        sums = np.bincount(found.indices.to_numpy(), np.repeat(self.shares, self.sizes), len(found.dictionary))
        self.words, self.sizes, self.shares = [], [], []
        return _sums(name, "w", found.dictionary, sums)

    def rest(self, name: str):
        yield _sums(name, "k", pa.array(map(str, range(KINDS))), self.kinds[:KINDS])
        yield _sums(name, "n", pa.array([""]), self.kinds[KINDS:])
        if self.words:
            yield self.word_sums(name)


def _sums(name: str, what: str, which: pa.Array, x: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array([c], pa.string()).take(pa.array(np.zeros(len(x), np.int64))) for c in (name, what)]
    return pa.RecordBatch.from_arrays([*columns, which, pa.array(x, pa.float64())], ["name", "what", "which", "x"])


def learn(docs: DataFrame, text: str = "text", label: str = "lang", common: int = COMMON) -> References:
    """References from all labelled texts of each language.

    Texts that fail the base rules teach nothing, nor do null ones; repeated rows teach once each. An empty table gives no
    reference. Other columns are not read. A word's share is the mean of its shares in single texts, and so is a kind's, so
    that a few long texts do not make a reference.
    """
    runtime.prepare(docs.sparkSession)
    labelled = docs.select(text, label).where(F.col(text).isNotNull() & F.col(label).isNotNull())

    def run(batches):
        for batch in batches:
            taught, found = {}, []
            for name, x in zip(batch.column(label).to_pylist(), rows.texts(batch.column(text)), strict=True):
                words = split(x)
                if len(words) < LEAST_WORDS or 20 * sum(map(x.count, SYMBOLS)) > len(words) or failed(len(words), repeated_words(words)):
                    continue
                if name not in taught:
                    taught[name] = _Taught()
                found += taught[name].add(name, x, words)
            for name, one in taught.items():
                found += one.rest(name)
            if found:
                yield from pa.Table.from_batches(found).combine_chunks().to_batches()
            del taught, found
        rows.release()

    parts = labelled.mapInArrow(run, "name string, what string, which string, x double").groupBy("name", "what", "which").agg(F.sum("x").alias("x"))
    order = Window.partitionBy("name", "what").orderBy(F.desc("x"), "which")
    top = parts.withColumn("r", F.row_number().over(order)).where(F.col("r") <= max(common, KINDS)).where((F.col("what") != "w") | (F.col("r") <= common)).drop("r")
    found = top.take(MOST_LANGUAGES * (common + KINDS + 1) + 1)
    count = {r["name"]: r["x"] for r in found if r["what"] == "n"}
    if len(count) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    kinds_of = {name: np.zeros(KINDS) for name in count}
    words_of: dict[str, dict[str, float]] = {name: {} for name in count}
    for r in found:
        if r["what"] == "k":
            kinds_of[r["name"]][int(r["which"])] = r["x"] / count[r["name"]]
        elif r["what"] == "w":
            words_of[r["name"]][r["which"]] = r["x"] / count[r["name"]]
    return References(kinds_of, words_of)


ADDED = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField(c, T.BooleanType()) for c in ("base_failed", "kept")]
    + [T.StructField("closest", T.StringType())]
    + [T.StructField(c, T.DoubleType()) for c in ("class_distance", "word_distance")]
)


def judge(docs: DataFrame, references: References, limits: Limits = Limits(), text: str = "text") -> DataFrame:
    """Add the base counts and verdicts, the closest language and the distances from it; other columns stay.

    A null text counts as empty: it has no words and fails. Where there is no reference, the base rules alone decide.
    Whole texts are read, repeated rows and ties get equal answers, an empty table stays empty, and columns already
    called like the new ones give way.
    """
    spark = runtime.prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(references)

    def make():
        refs = shared.value

        def each(batch):
            out = []
            for x in rows.texts(batch.column(text)):
                words, chars, symbols, lines, again = base(x)
                bad = failed(len(words), again)
                near, a, b, close = refs.compare(x, words, limits)
                out.append((len(words), chars, symbols, lines, again, bad, close and not bad, near, a, b))
            kinds_ = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.string()] + [pa.float64()] * 2
            return [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds_, strict=True)]

        return each

    return rows.appended(docs, list(ADDED), make)


def kept_rows(docs: DataFrame, references: References, limits: Limits = Limits(), text: str = "text") -> DataFrame:
    """The rows that judge() keeps; all columns stay, whatever they are called."""
    spark = runtime.prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(references)

    def make():
        refs = shared.value

        def keep(batch):
            out = []
            for x in rows.texts(batch.column(text)):
                words, _, _, _, again = base(x)
                out.append(not failed(len(words), again) and refs.compare(x, words, limits)[3])
            return out

        return keep

    return rows.filtered(docs, make)


def query(docs: DataFrame) -> DataFrame:
    return judge(docs.select("doc_id", "text"), learn(docs)).drop("text")
