"""URL filter: longest rule first, then words of host and path scored by naive Bayes.

Hosts often join words. A unigram model, learned from the words of page texts, splits each label of a host into its
likeliest words by the Viterbi algorithm. Multinomial naive Bayes, learned from the urls that rules decide, scores the
words of host and path of the others.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textshield import runtime
from textshield.llm import rows

ALLOW, BLOCK = "allow", "block"

#: Rules of the query, as (verdict, host and path).
RULES = ((ALLOW, "com/"), (BLOCK, "example.com/en/"), (ALLOW, "www.example.com/en/"), (BLOCK, "net/es/"), (BLOCK, "net/fr/"))

#: Labelled urls that teach naive Bayes of each class: the bound of what is fitted on.
PER_CLASS = 20_000

LONGEST_WORD = 24

_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_TAG = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", re.S | re.I)
_WORD = re.compile(r"[^\W\d_]+")
_TOKEN = re.compile(r"[^\W\d_]+|\d+")


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty where there is no `://`."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    m = re.search(r"[/?#]", rest)
    host, tail = (rest, "") if not m else (rest[: m.start()], rest[m.start() :])
    return host.translate(_UPPER), re.split(r"[?#]", tail, maxsplit=1)[0]


class Rules:
    """Rules by host; the longest that fits a url decides."""

    def __init__(self, given):
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for verdict, rule in given:
            host, slash, path = rule.partition("/")
            self.by_host.setdefault(host.translate(_UPPER), []).append((slash + path, rule, verdict))

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        found, at = [], 0
        while True:
            found += [(len(rule), rule, verdict) for start, rule, verdict in self.by_host.get(host[at:], ()) if path.startswith(start)]
            dot = host.find(".", at)
            if dot < 0:
                break
            at = dot + 1
        return max(found)[1:] if found else None


class Segmenter:
    """Unigram Viterbi: the likeliest words of a run of letters."""

    def __init__(self, counts: dict[str, int]):
        total = sum(counts.values()) + 1
        self.logp = {w: math.log(n / total) for w, n in counts.items() if 0 < len(w) <= LONGEST_WORD}
        self.unknown = [math.log(1 / total) - 2.3 * k for k in range(LONGEST_WORD + 1)]
        self.kept: dict[str, list[str]] = {}

    def split(self, run: str) -> list[str]:
        found = self.kept.get(run)
        if found is None:
            best, back = [0.0], [0]
            for i in range(1, len(run) + 1):
                score, j = max((best[j] + self.logp.get(run[j:i], self.unknown[i - j]), j) for j in range(max(0, i - LONGEST_WORD), i))
                best.append(score)
                back.append(j)
            found, i = [], len(run)
            while i:
                found.append(run[back[i] : i])
                i = back[i]
            found.reverse()
            if len(run) <= 64:
                if len(self.kept) > 200_000:
                    self.kept.clear()
                self.kept[run] = found
        return found


def tokens(segmenter: Segmenter, host: str, path: str) -> list[str]:
    """Words of the host, marked as such, and of the path; a number is one kind of word."""
    return [mark + w for mark, part in (("h:", host), ("p:", path.lower())) for run in _TOKEN.findall(part) for w in (["#"] if run.isdecimal() else segmenter.split(run))]


def learn_words(pages: DataFrame, html: str = "html", url: str = "url") -> dict[str, int]:
    """Word counts of the texts of all pages, of words that occur in a run of letters of some url; "" counts the others.

    No other word can be looked up, so that splits are those of the whole table.
    """

    def run(batches):
        for batch in batches:
            c = Counter()
            for x in rows.texts(batch.column(html)):
                c.update(_WORD.findall(_TAG.sub(" ", x).lower()))
            if c:
                yield pa.RecordBatch.from_arrays([pa.array(list(c)), pa.array(list(c.values()), pa.int64())], ["w", "n"])

    def parts(batches):
        for batch in batches:
            runs = {r for x in batch.column(url).to_pylist() for part in split_url(x) for r in _TOKEN.findall(part.lower()) if not r.isdecimal()}
            found = {r[i:j] for r in runs for i in range(len(r)) for j in range(i + 1, min(len(r), i + LONGEST_WORD) + 1)}
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string())], ["w"])

    counted = runtime.written(pages.select(html).mapInArrow(run, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")), "url-words")
    needed = pages.select(url).mapInArrow(parts, "w string").distinct()
    out = {r["w"]: r["n"] for r in counted.join(needed, "w", "left_semi").collect()}
    total = counted.agg(F.sum("n")).first()[0] or 0
    return out | {"": total - sum(out.values())} if total > sum(out.values()) else out


def learn_bayes(pages: DataFrame, rules: Rules, segmenter: Segmenter, url: str = "url", key: str = "page_id", per_class: int = PER_CLASS) -> dict[str, dict[str, int]]:
    """Token counts of each class over urls that rules decide, about per_class of each (rows.labelled_sample)."""

    def label():
        def each(batch):
            found = [rules.match(*split_url(x)) for x in batch.column(url).to_pylist()]
            return [pa.array([m and m[1] for m in found], pa.string())]

        return each

    labelled = rows.appended(pages.select(url, key), [T.StructField("verdict", T.StringType())], label)
    sample = rows.labelled_sample(labelled, "verdict", key, per_class, url)

    def run(batches):
        for batch in batches:
            c = Counter()
            for v, x in zip(batch.column("verdict").to_pylist(), batch.column(url).to_pylist(), strict=True):
                c.update((v, t) for t in tokens(segmenter, *split_url(x)))
            if c:
                yield pa.RecordBatch.from_arrays([pa.array([v for v, _ in c]), pa.array([t for _, t in c]), pa.array(list(c.values()), pa.int64())], ["v", "t", "n"])

    out: dict[str, dict[str, int]] = {}
    for r in sample.mapInArrow(run, "v string, t string, n long").groupBy("v", "t").agg(F.sum("n").alias("n")).collect():
        out.setdefault(r["v"], {})[r["t"]] = r["n"]
    return out


class Bayes:
    """Multinomial naive Bayes with add-one smoothing; equal priors, since rules say nothing of how common a class is."""

    def __init__(self, counts: dict[str, dict[str, int]]):
        words = {t for c in counts.values() for t in c}
        total = {v: sum(c.values()) + len(words) for v, c in counts.items()}
        self.weight = {t: math.log((counts[BLOCK].get(t, 0) + 1) / total[BLOCK]) - math.log((counts[ALLOW].get(t, 0) + 1) / total[ALLOW]) for t in words} if {ALLOW, BLOCK} <= counts.keys() else {}

    def score(self, found: list[str]) -> float:
        """Log odds of block; words never seen say nothing."""
        return sum(self.weight.get(t, 0.0) for t in found)


def judge(pages: DataFrame, given=RULES, url: str = "url", html: str = "html", key: str = "page_id") -> DataFrame:
    """Add host, path, rule, verdict and score (log odds of block) of each url; other columns stay.

    A null url, or one without `://`, has an empty host and path, fits no rule and is allowed at odds 0, like any url of
    no known word, and like all where rules decide no url of one class. Repeated rows get equal answers, an empty table
    stays empty, very long urls are read whole, and columns already called like the new ones give way.
    """
    runtime.prepare(pages.sparkSession)
    rules = Rules(given)
    segmenter = Segmenter(learn_words(pages, html, url))
    bayes = Bayes(learn_bayes(pages, rules, segmenter, url, key))
    shared = pages.sparkSession.sparkContext.broadcast((rules, segmenter, bayes))  # words that urls can hold and the sample's tokens

    def make():
        rules, segmenter, bayes = shared.value

        def each(batch):
            out = []
            for x in batch.column(url).to_pylist():
                host, path = split_url(x)
                m = rules.match(host, path)
                odds = bayes.score(tokens(segmenter, host, path))
                out.append((host, path, m and m[0], m[1] if m else BLOCK if odds > 0 else ALLOW, odds))
            return [pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.string(), pa.string(), pa.string(), pa.string(), pa.float64()), strict=True)]

        return each

    s = T.StringType()
    add = [T.StructField("host", s), T.StructField("path", s), T.StructField("rule", s), T.StructField("verdict", s), T.StructField("score", T.DoubleType())]
    return rows.appended(pages, add, make)
