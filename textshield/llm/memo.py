"""Ids of texts by their distinct chunks: what stands between white space is looked up once for a run of texts.

Texts are split, and their chunks numbered, by Arrow; only chunks and words that were not seen before are encoded one by
one. What is kept of them is compact and bounded: those of the last texts stay, others are let go.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from textshield.llm import rows

#: Distinct chunks, and words, that one worker keeps between runs of texts, and their bytes.
KEPT, KEPT_BYTES = 250_000, 8 << 20

#: Characters that need nothing of Unicode's tables but a fixed lower case; control strings are no words either.
UNUSUAL = r"[^\t\n\r\x20-\x7e\x{a1}-\x{ff}]|<\|"

#: Words of lower-cased chunks of usual characters: letters, a digit, an ending, a run of others; and the ends of chunks.
WORDS = re.compile(r"\n|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|'(?:[stmd]|re|ve|ll)|[^\s0-9a-zªµºß-öø-ÿ²³¹¼-¾]+")

Ids = tuple[np.ndarray, np.ndarray]


def encoded(lists: list[list[int]]) -> Ids:
    """Lists of ids as one array and the ends of each."""
    ends = np.zeros(len(lists) + 1, np.int64)
    np.cumsum([len(x) for x in lists], out=ends[1:])
    return np.fromiter((i for x in lists for i in x), np.uint32, int(ends[-1])), ends


def gathered(ids: np.ndarray, ends: np.ndarray, at: np.ndarray) -> Ids:
    """The ids at those places, one after the other, and the ends of each."""
    n = ends[at + 1] - ends[at]
    out = np.zeros(len(at) + 1, np.int64)
    np.cumsum(n, out=out[1:])
    return ids[np.arange(out[-1]) + np.repeat(ends[at] - out[:-1], n)], out


def text_buffers(column: pa.Array) -> Ids:
    """The bytes of a text or binary column without nulls as one array, after where each value's begin and the last's end."""
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return ends - ends[0], np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]]


def joined(column: pa.Array, by: str) -> str:
    """The texts of a column, joined."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column), by)[0].as_py()


class Memo:
    """Ids of distinct strings; `ask` makes those of strings that are not kept."""

    def __init__(self, ask: Callable[[pa.Array], Ids]):
        self.ask = ask
        self.known, self.ids, self.ends = pa.array([], pa.string()), np.zeros(0, np.uint32), np.zeros(1, np.int64)

    @classmethod
    def of_chunks(cls, words: Memo, whole: Callable[[pa.Array], Ids]) -> Memo:
        """Chunks by their words; those of unusual characters are asked whole."""

        def ask(chunks: pa.Array) -> Ids:
            odd = pc.match_substring_regex(chunks, UNUSUAL)
            usual = chunks.filter(pc.invert(odd))
            found = pa.array(WORDS.findall(joined(usual, "\n").lower()), pa.string())
            end = pc.equal(found, "\n")
            inside = pc.invert(end)
            ids, ends = words.of(found.filter(inside))
            end = end.to_numpy(zero_copy_only=False)
            n = np.bincount(np.cumsum(end)[~end], np.diff(ends), len(usual)).astype(np.int64)
            if len(usual) == len(chunks):
                return ids, np.concatenate([[0], np.cumsum(n)])
            rest, rest_ends = whole(chunks.filter(odd))
            n = np.concatenate([n, np.diff(rest_ends)])
            odd = odd.to_numpy(zero_copy_only=False)
            place = np.argsort(np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)]))
            return gathered(np.concatenate([ids, rest]), np.concatenate([[0], np.cumsum(n)]), place)

        return cls(ask)

    def _places(self, found: pa.Array) -> np.ndarray:
        """Where the ids of distinct strings are kept, all of them now."""
        at = pc.index_in(found, value_set=self.known).fill_null(-1).to_numpy().astype(np.int64)
        new = found.filter(pa.array(at < 0))
        if len(self.known) + len(new) > KEPT or self.known.nbytes + new.nbytes > KEPT_BYTES:
            here = np.flatnonzero(at >= 0)
            stay = at[here]
            self.known = self.known.take(pa.array(stay))
            self.ids, self.ends = gathered(self.ids, self.ends, stay)
            at[here] = np.arange(len(here))
        if len(new):
            ids, ends = self.ask(new)
            at[at < 0] = len(self.known) + np.arange(len(new))
            self.known = pa.concat_arrays([self.known, new])
            self.ids, self.ends = np.concatenate([self.ids, ids]), np.concatenate([self.ends, self.ends[-1] + ends[1:]])
        return at

    def of(self, found: pa.Array) -> Ids:
        """The ids of strings, one after the other, and the ends of each."""
        numbered = found.dictionary_encode()
        at = self._places(numbered.dictionary)[numbered.indices.to_numpy()]
        return gathered(self.ids, self.ends, at)

    def of_texts(self, texts: pa.Array) -> Ids:
        """The ids of texts by their chunks (null: none), one after the other, and the ends of each text's."""
        parts, ends, size = [], [np.zeros(1, np.int64)], 0
        for part in rows.slices(texts):
            lists = pc.ascii_split_whitespace(part.cast(pa.string()).fill_null(""))
            ids, stops = self.of(lists.flatten())
            parts.append(ids)
            ends.append(size + stops[lists.offsets.to_numpy() - lists.offsets[0].as_py()][1:])
            size += len(ids)
            rows.release(collect=False)  # what the split and the new words took
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32), np.concatenate(ends)
