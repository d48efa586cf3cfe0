"""Detection: signatures on the text and on its folded copy, two heuristics, a noisy-OR score and a verdict.

The signatures run in one Arrow UDF, each behind the words that it cannot match without (a text is taken apart into words
once, for all of them): the expressions are Python's. Rows come back as the few hits with their spans; findings, score, bucket and verdict are built from those by native expressions.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Sequence
from functools import lru_cache
from itertools import repeat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textshield.functions import columns as C
from textshield.functions.signatures import ANCHORS, RUNS, SIGNATURES, Signature
from textshield.operators.sanitize import clean, findings

#: First words that make a line a command.
COMMANDS = (
    "ignore disregard forget stop do don't dont never always print output repeat reveal send post fetch execute run "
    "call follow obey respond reply answer write say tell act pretend become switch override bypass summarize translate"
).split()

#: The first word of a line, and what addresses the model.
FIRST_WORD = r"^[\s\-\*\d\.\)#>]*([a-zA-Z']+)"
DIRECTIVE = r"\byou\s+(?:must|should|shall|need\s+to|have\s+to|are\s+(?:required|instructed|now))\b"

PAD = 24

HIT = T.StructType([T.StructField("place", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("excerpt", T.StringType())])
SIGNALS = T.StructType([T.StructField("hits", T.ArrayType(HIT)), *(T.StructField(c, T.IntegerType()) for c in ("lines", "commands", "directives"))])

#: Letters that ignoring case takes for ASCII ones.
_LIKE_ASCII = (("İ", "i"), ("ı", "i"), ("ſ", "s"), ("\u212a", "k"))

#: In place of a copy: the text's own, folded.
FOLDED = True

_FOLD = str.maketrans(C.LEET[0] + C.CONFUSABLES[0], C.LEET[1] + C.CONFUSABLES[1])
_LEET_BYTES = bytes.maketrans(C.LEET[0].encode(), C.LEET[1].encode())
_UNLEET = bytes(sorted(set(range(256)) - set(C.LEET[0].encode())))
#: Where folded letters beyond ASCII begin; two that share their first byte with common letters or signs stand apart.
_APART = "ı․"
_CONFUSABLE_LEADS = frozenset(c.encode()[0] for c in C.CONFUSABLES[0] if c not in _APART)

_COMMANDS = frozenset(COMMANDS)
_first_word = re.compile(FIRST_WORD.removeprefix("^"))
_directive = re.compile(DIRECTIVE, re.I)
_DIRECTIVES = frozenset(b"must should shall need have are".split())


def _only(kept: bytes, by: bytes | None = None) -> bytes:
    """A table for bytes.translate: what is kept, as it is or as one sign, and blanks for all else."""
    return bytes((by[0] if by else i) if i in kept else 32 for i in range(256))


#: Bytes of ASCII words, and of long runs; a letter beyond ASCII parts them, so none is overlooked.
_WORD_BYTES = _only(b"abcdefghijklmnopqrstuvwxyz0123456789_")
_RUN_BYTES = _only(b"abcdefghijklmnopqrstuvwxyz0123456789+/", b"x")
_NOT_LEADS = bytes(range(0xC0))


class _Needs:
    """What a table of signatures needs to find in a text, by place in the table."""

    def __init__(self, signatures: tuple[Signature, ...]):
        self.words: dict[int, list[frozenset[bytes]]] = {}
        self.parts: dict[int, list[tuple[frozenset[bytes], list[bytes]]]] = {}
        self.runs: dict[int, bytes] = {}
        self.always: list[int] = []
        self.by_word: dict[bytes, list[int]] = {}
        for i, s in enumerate(signatures):
            words, self.parts[i] = [], []
            for group in ANCHORS.get(s.id, ()):
                terms = group.split(" ")
                whole = frozenset(t.encode() for t in terms if re.fullmatch(r"\w+", t, re.A))
                parts = [t.removesuffix("*").encode() for t in terms if t.encode() not in whole]
                if parts:
                    self.parts[i].append((whole, parts))
                else:
                    words.append(whole)
            if s.id in RUNS:
                self.runs[i] = b"x" * RUNS[s.id]
            self.words[i] = words[1:]
            for w in words[0] if words else ():
                self.by_word.setdefault(w, []).append(i)
            if not words:
                self.always.append(i)
        self.known = frozenset(self.by_word).union(_DIRECTIVES, (b"you",), *(g for gs in self.words.values() for g in gs), *(g for gs in self.parts.values() for g, _ in gs))

    def found(self, low: bytes) -> frozenset[bytes]:
        """The words of the text that some signature or the heuristics ask for."""
        return self.known.intersection(low.translate(_WORD_BYTES).split())

    def places(self, low: bytes, found: frozenset[bytes]) -> list[int]:
        """The signatures that can match, in order."""
        tried = set(self.always)
        for w in found:
            tried.update(self.by_word.get(w, ()))
        leads = None if low.isascii() else frozenset(low.translate(None, _NOT_LEADS))

        def there(part: bytes) -> bool:
            if part[0] >= 0xC0:
                return leads is not None and part[0] in leads and part in low
            return part in low

        run = low.translate(_RUN_BYTES) if self.runs else b""
        return [
            i
            for i in sorted(tried)
            if not any(g.isdisjoint(found) for g in self.words[i]) and all(not whole.isdisjoint(found) or any(map(there, parts)) for whole, parts in self.parts[i]) and (i not in self.runs or self.runs[i] in run)
        ]


@lru_cache(8)
def _compiled(signatures: tuple[Signature, ...]) -> list[tuple[int, re.Pattern, tuple[str, ...]]]:
    return [(i, re.compile(s.pattern, re.I | re.M), ANCHORS.get(s.id, ())) for i, s in enumerate(signatures)]


@lru_cache(8)
def _needs(signatures: tuple[Signature, ...]) -> _Needs:
    return _Needs(signatures)


def _lowered(text: str) -> bytes:
    """The text in UTF-8, with the letters that ignoring case takes for ASCII ones as small ASCII letters."""
    if not text.isascii():
        for letter, plain in _LIKE_ASCII:
            if letter in text:
                text = text.replace(letter, plain)
    return text.encode("utf-8", "surrogatepass").lower()


def _matched(text: str, places: list[int], signatures: tuple[Signature, ...]) -> list[tuple[int, int, int]]:
    compiled = _compiled(signatures)
    return [(i, *m.span()) for i in places if (m := compiled[i][1].search(text))]


def matches(text: str, signatures: tuple[Signature, ...] = SIGNATURES) -> list[tuple[int, int, int]]:
    """Place in the table, start and end of the first match of each signature that matches, in order."""
    needs, low = _needs(signatures), _lowered(text)
    return _matched(text, needs.places(low, needs.found(low)), signatures)


def _folded(text: str, low: bytes) -> bytes | None:
    """The folded copy of a text, lowered as the text is; null where folding surely changes nothing."""
    if not low.isascii() and (any(c in text for c in _APART) or not _CONFUSABLE_LEADS.isdisjoint(low.translate(None, _NOT_LEADS))):
        return _lowered(text.translate(_FOLD))
    return low.translate(_LEET_BYTES) if low.translate(None, _UNLEET) else None


def _first_words(text: str) -> list[str]:
    """The first word of each line that has one, after bullets and numbers."""
    return [m[1] for x in text.split("\n") if (m := _first_word.match(x))]


def excerpt(text: str, start: int, end: int) -> str:
    """What stands around a match, on one line."""
    a, b = max(0, start - PAD), min(len(text), end + PAD)
    return ("…" if a else "") + text[a:b].replace("\n", " ").strip() + ("…" if b < len(text) else "")


def signals(text: str | None, copy: object, signatures: tuple[Signature, ...] = SIGNATURES) -> tuple:
    """Hits on the text, then those that only the copy has, and the counts that the heuristics use."""
    if text is None:
        return [], 0, 0, 0
    needs, low = _needs(signatures), _lowered(text)
    words = needs.found(low)
    hits = [(*m, excerpt(text, *m[1:])) for m in _matched(text, needs.places(low, words), signatures)]
    other = _folded(text, low) if copy is FOLDED else _lowered(copy) if copy is not None and copy != text else None
    if other is not None:
        seen = {h[0] for h in hits}
        places = [i for i in needs.places(other, needs.found(other)) if i not in seen]
        if places:
            copy = text.translate(_FOLD) if copy is FOLDED else copy
            hits += [(*m, excerpt(copy, *m[1:])) for m in _matched(copy, places, signatures)]
    first = _first_words(text) if text.count("\n") >= 3 else []  # fewer lines than count
    told = b"you" in words and not _DIRECTIVES.isdisjoint(words)
    return hits, len(first), sum(w.lower() in _COMMANDS for w in first), len(_directive.findall(text)) if told else 0


_HITS = pa.list_(pa.struct([("place", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("excerpt", pa.string())]))
_NOTHING = ([], 0, 0, 0)


def _signaled(texts: list[str | None], copies: Iterable, signatures: tuple[Signature, ...]) -> pa.Array:
    """Signals of each text. A text that comes again in the batch, with the same copy, is matched once."""
    known: dict[tuple, tuple] = {(None, FOLDED): _NOTHING, (None, None): _NOTHING}
    out = []
    for pair in zip(texts, copies):
        got = known.get(pair)
        if got is None:
            hits, *counts = signals(*pair, signatures)
            got = known[pair] = ([dict(zip(HIT.names, h, strict=True)) for h in hits], *counts)
        out.append(got)
    columns = zip(*out, strict=True) if out else ([],) * len(SIGNALS)
    return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, (_HITS, *[pa.int32()] * 3), strict=True)], SIGNALS.names)


def _signals(text: Column, also: Column | None, fold: bool, signatures: tuple[Signature, ...]) -> Column:
    @F.arrow_udf(SIGNALS)
    def alone(texts: pa.Array) -> pa.Array:
        return _signaled(texts.to_pylist(), repeat(FOLDED if fold else None), signatures)

    @F.arrow_udf(SIGNALS)
    def paired(texts: pa.Array, copies: pa.Array) -> pa.Array:
        return _signaled(texts.to_pylist(), copies.to_pylist(), signatures)

    return alone(text) if also is None else paired(text, also)


@lru_cache(8)
def _table(signatures: tuple[Signature, ...]) -> str:
    return json.dumps([{"id": s.id, "category": s.category, "severity": s.severity, "weight": s.weight, "message": s.message} for s in signatures])


def described(hits: Column, signatures: Sequence[Signature] = SIGNATURES) -> Column:
    """Findings of the hits. The table is one literal, which costs less to build than a literal for each of its values."""
    table = F.from_json(F.lit(_table(tuple(signatures))), "array<struct<id: string, category: string, severity: string, weight: double, message: string>>")

    def one(h: Column) -> Column:
        s = F.element_at(table, h["place"] + 1)
        return F.struct(F.lit("detect").alias("stage"), s["category"].alias("category"), s["severity"].alias("severity"), s["message"].alias("message"), s["weight"].alias("weight"), h["excerpt"].alias("excerpt"), F.struct(h["start"].alias("start"), h["end"].alias("end")).alias("span"), s["id"].alias("pattern_id")).cast(C.FINDING)

    return F.transform(hits, one)


def directive_share(count: Column, text: Column) -> Column:
    """How many directives there are in each thousand characters; a shorter text counts as a thousand."""
    return count / F.greatest(F.lit(1.0), F.length(text) / F.lit(1000.0))


def heuristics(found: Column, text: Column) -> Column:
    lines, commands, count = (found[c] for c in ("lines", "commands", "directives"))
    return C.gather(
        F.when((lines >= 4) & (commands >= 3) & (commands / lines >= 0.4), C.finding("detect", "imperative_density", "medium", F.concat(commands.cast("string"), F.lit(" of "), lines.cast("string"), F.lit(" lines are commands")), 0.45)),
        F.when((count >= 2) & (directive_share(count, text) >= 1.5), C.finding("detect", "directive_density", "medium", F.concat(count.cast("string"), F.lit(" phrases tell the model what to do")), 0.40)),
    )


def detect(df: DataFrame, text: str, into: str = "detected", *, threshold: float = 0.5, extra: Column | None = None, fold: bool = True, also: Column | None = None, use_heuristics: bool = True, signatures: Sequence[Signature] = SIGNATURES) -> DataFrame:
    """Add a struct of score, risk, injected, threshold and findings; a null text gives a null struct.

    Findings come in the order extra, text, folded copy (signatures not seen before), heuristics. `also` stands for the
    folded copy where it isn't the text's own.
    """
    t = F.col(text)
    df = df.withColumn("__dt_signals", _signals(t, also, fold, tuple(signatures)))
    found = [described(F.col("__dt_signals.hits"), signatures)]
    if extra is not None:
        found.insert(0, extra)
    if use_heuristics:
        found.append(heuristics(F.col("__dt_signals"), t))
    df = df.withColumn("__dt_found", F.concat(*found))
    df = df.withColumn("__dt_score", C.noisy_or(F.col("__dt_found.weight")))
    result = F.struct(F.col("__dt_score").alias("score"), C.bucket(F.col("__dt_score")).alias("risk"), ((F.col("__dt_score") >= threshold) | C.any_high(F.col("__dt_found"))).alias("injected"), F.lit(float(threshold)).alias("threshold"), F.col("__dt_found").alias("findings"))
    return df.withColumn(into, F.when(t.isNotNull(), result)).drop("__dt_signals", "__dt_found", "__dt_score")


def scan(df: DataFrame, text: str = "text", into: str = "scan", *, threshold: float = 0.5) -> DataFrame:
    """Sanitize and detect, without a cap on length."""
    df = clean(df, text, "__dt_clean")
    return detect(df.withColumn("__dt_text", F.col("__dt_clean.text")), "__dt_text", into, threshold=threshold, extra=findings(F.col("__dt_clean"))).drop("__dt_clean", "__dt_text")
