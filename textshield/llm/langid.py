"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1, drawn from its code point. An n-gram's vector binds its letters' vectors,
each permuted (rotated) by its place, by elementwise product. A text's vector bundles its n-grams' vectors by sum, a
language's prototype those of all its training texts. A text goes to the language whose prototype has the highest cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textshield import runtime
from textshield.llm import rows

DIMENSIONS = 1024

#: Prototypes are sent to every task: 8 KB for each language.
MOST_LANGUAGES = 4096

#: Characters handled at once; a longer text makes a piece of its own.
AT_ONCE = 400_000

#: N-grams whose vectors are made and summed at once.
GRAMS = 4096

#: N-grams, over all languages, that a task of fit() counts before it sums their vectors; languages handed on at once.
HELD_GRAMS, VECTORS_AT_ONCE = 1 << 19, 64

UNDETERMINED = "und"

_GAP = 0
_vectors: dict[int, np.ndarray] = {}
_alpha: list[np.ndarray] = []


def letter_vector(code: int) -> np.ndarray:
    """The vector of a letter, or of the gap between words; the same in every process."""
    if code not in _vectors:
        if len(_vectors) > 20_000:
            _vectors.clear()
        _vectors[code] = np.random.default_rng([code, DIMENSIONS, 7]).choice(np.array([-1, 1], np.int8), DIMENSIONS)
    return _vectors[code]


def _is_letter() -> np.ndarray:
    if not _alpha:
        _alpha.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _alpha[0]


def symbols(text: str) -> np.ndarray:
    """Code points of the lower-cased letters; each run of other characters, and either end, is one gap."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(_is_letter()[codes], codes, _GAP).astype(np.int64)
    codes = np.concatenate([[_GAP], codes, [_GAP]])
    return codes[(codes != _GAP) | np.concatenate([[True], codes[:-1] != _GAP])]


def ngram_vectors(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Bound vectors of trigrams, a row each."""
    codes, place = np.unique(np.concatenate([a, b, c]), return_inverse=True)
    table = np.stack([letter_vector(int(x)) for x in codes])
    n = len(a)
    return (np.roll(table, 2, 1)[place[:n]] * np.roll(table, 1, 1)[place[n : 2 * n]] * table[place[2 * n :]]).astype(np.float32)


def text_vectors(found: list[np.ndarray]) -> np.ndarray:
    """The bundled vectors of texts given by their symbols, a row each; no trigram: zero."""
    alphabet, place = np.unique(np.concatenate(found), return_inverse=True)
    k = len(alphabet)
    owner = np.repeat(np.arange(len(found)), [len(x) for x in found])
    key = (place[:-2] * k + place[1:-1]) * k + place[2:]
    inside = owner[:-2] == owner[2:]
    if not inside.any():
        return np.zeros((len(found), DIMENSIONS), np.float32)
    grams, column = np.unique(key[inside], return_inverse=True)
    pairs, counts = np.unique(column * len(found) + owner[:-2][inside], return_counts=True)  # by n-gram, then by text
    column, owner = pairs // len(found), pairs % len(found)
    out = np.zeros((len(found), DIMENSIONS), np.float32)
    for at in range(0, len(grams), GRAMS):  # only this many n-grams' vectors, and their counts by text, are held at once
        g = grams[at : at + GRAMS]
        a, b = np.searchsorted(column, (at, at + len(g)))
        some = np.zeros((len(found), len(g)), np.float32)
        some[owner[a:b], column[a:b] - at] = counts[a:b]
        out += some @ ngram_vectors(alphabet[g // (k * k)], alphabet[g // k % k], alphabet[g % k])
    return out


def groups(texts: list[str]):
    """Texts in runs of bounded length, as (first, symbols of each)."""
    first, run, size = 0, [], 0
    for i, x in enumerate(texts):
        run.append(symbols(x))
        size += len(run[-1])
        if size >= AT_ONCE or len(run) >= 128:
            yield first, run
            first, run, size = i + 1, [], 0
    if run:
        yield first, run


class _Counts:
    """Numbers of n-grams of each language, by the code points of their letters."""

    def __init__(self):
        self.parts: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.size = 0

    def add(self, name: str, found: list[np.ndarray]) -> None:
        """Count the n-grams of texts given by their symbols; a language whose texts have none is noted too."""
        s = np.concatenate(found)
        owner = np.repeat(np.arange(len(found)), [len(x) for x in found])
        key = (s[:-2] << 42 | s[1:-1] << 21 | s[2:])[owner[:-2] == owner[2:]]
        grams, counts = np.unique(key, return_counts=True)
        self.parts.setdefault(name, []).append((grams, counts))
        self.size += len(grams) + 1

    def merge(self) -> None:
        for name, found in self.parts.items():
            if len(found) > 1:
                grams, place = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
                counts = np.bincount(place, np.concatenate([c for _, c in found]), len(grams))  # whole numbers, exact below 2^53
                self.parts[name] = [(grams, counts)]
        self.size = sum(len(found[0][0]) + 1 for found in self.parts.values())

    def vectors(self) -> Iterator[pa.RecordBatch]:
        """The bundled vector of each language."""
        self.merge()
        names = list(self.parts)
        for at in range(0, len(names), VECTORS_AT_ONCE):
            some = names[at : at + VECTORS_AT_ONCE]
            made = [bundled(*self.parts[x][0]).tolist() for x in some]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(made, pa.list_(pa.float64()))], ["name", "v"])


def bundled(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sum of the vectors of n-grams, each as often as it was counted."""
    out, low = np.zeros(DIMENSIONS), (1 << 21) - 1
    for at in range(0, len(grams), GRAMS):
        g = grams[at : at + GRAMS]
        out += counts[at : at + GRAMS].astype(np.float64) @ ngram_vectors(g >> 42, g >> 21 & low, g & low)
    return out


def fit(docs: DataFrame, text: str = "text", label: str = "lang") -> tuple[list[str], np.ndarray]:
    """Prototypes of the languages of a labelled table, from all its texts.

    Rows without label or text teach nothing; repeated rows and ties count each. An empty table gives no language. Very
    long texts are read whole. Other columns are not read. N-grams are counted first, so that each one's vector is made
    once for many texts. Returns the languages in order and a matrix with a row for each.
    """
    runtime.prepare(docs.sparkSession)
    labelled = docs.select(text, label).where(F.col(text).isNotNull() & F.col(label).isNotNull())

    def run(batches):
        counts = _Counts()
        for batch in batches:
            names = batch.column(label).to_pylist()
            for first, found in groups(rows.texts(batch.column(text))):
                by: dict[str, list[np.ndarray]] = {}
                for name, x in zip(names[first:], found, strict=False):
                    by.setdefault(name, []).append(x)
                for name, some in by.items():
                    counts.add(name, some)
                if counts.size > HELD_GRAMS:
                    counts.merge()
                    if counts.size > HELD_GRAMS // 2:
                        yield from counts.vectors()
                        counts = _Counts()
        yield from counts.vectors()
        del counts
        rows.release()

    parts = labelled.mapInArrow(run, "name string, v array<double>")
    summed = parts.select("name", F.posexplode("v").alias("i", "x")).groupBy("name", "i").agg(F.sum("x").alias("x"))
    found = summed.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v")).orderBy("name").take(MOST_LANGUAGES + 1)
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    names = [r["name"] for r in found]
    return names, np.array([[x["x"] for x in r["v"]] for r in found], np.float64).reshape(len(names), DIMENSIONS)


def predictor(model: tuple[list[str], np.ndarray]):
    """A function from texts to their languages and cosines."""
    names, prototypes = model
    unit = prototypes / np.maximum(np.linalg.norm(prototypes, axis=1, keepdims=True), 1e-12) if names else None

    def each(texts: list[str]) -> tuple[list[str], list[float]]:
        best, cosine = [], []
        for _, found in groups(texts):
            if unit is None:
                best += [UNDETERMINED] * len(found)
                cosine += [0.0] * len(found)
                continue
            v = text_vectors(found).astype(np.float64)
            c = v @ unit.T / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
            for x, i, row in zip(found, c.argmax(1), c, strict=True):
                known = bool((x != _GAP).any())
                best.append(names[i] if known else UNDETERMINED)
                cosine.append(min(1.0, max(0.0, float(row[i]))) if known else 0.0)
        return best, cosine

    return each


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", language: str = "lang_pred", score: str = "score") -> DataFrame:
    """Add the language of each whole text and its cosine (0 to 1; negative: 0); other columns stay.

    A null text, one without a letter, and every text where there is no prototype are `und` with score 0. Of equal
    cosines the first language in order wins. Repeated rows get equal answers, an empty table stays empty, and columns
    already called like the new ones give way.
    """
    runtime.prepare(docs.sparkSession)

    def make():
        each = predictor(model)
        return lambda batch: [pa.array(x, t) for x, t in zip(each(rows.texts(batch.column(text))), (pa.string(), pa.float64()), strict=True)]

    return rows.appended(docs, [T.StructField(language, T.StringType()), T.StructField(score, T.DoubleType())], make)


def told(docs: DataFrame, model: tuple[list[str], np.ndarray], least: float, text: str = "text") -> DataFrame:
    """The rows whose language can be told with a cosine of `least` or more; all columns stay, whatever they are called.

    What predict() says of null, empty and repeated texts holds: those that are `und` go.
    """
    runtime.prepare(docs.sparkSession)

    def make():
        each = predictor(model)

        def keep(batch):
            languages, cosines = each(rows.texts(batch.column(text)))
            return [x != UNDETERMINED and c >= least for x, c in zip(languages, cosines, strict=True)]

        return keep

    return rows.filtered(docs, make)


def held_out(key: str = "doc_id"):
    """Whether a row is kept from training: a quarter of all, by a checksum of the id (null: of nothing)."""
    return F.crc32(F.encode(F.coalesce(F.col(key).cast("string"), F.lit("")), "UTF-8")) % 4 == 2


def held_out_query(docs: DataFrame) -> DataFrame:
    """Fit on three quarters of the documents, predict all."""
    model = fit(docs.where(~held_out()))
    return predict(docs.select("doc_id", "text", held_out().alias("held_out")), model).drop("text")
