"""BPE encoding and decoding through a deterministic tokenization automaton.

The automaton reads tokens and accepts exactly the token sequences that the merges produce. It starts as one state
with a loop for each base symbol. The merges are then built in, best first, each by a gadget: where arc u leads to a
state with an arc v, the target is copied without v (u may no longer be followed by v) and a new arc for uv goes where
v went. Every arc of one token leads to one state, so a state is known by its token.

The gadgets are compiled into a transition table when a file is loaded. The gadget of u and v takes the arc v, and all
arcs that are later made from it, from the state u and all states that are later copied from it. States numbered along
their copies, and arcs along their left parts (both latest first), make each of these two sets one run of numbers. The
table has, for each state, the runs of arcs that it lacks, joined and sorted: some tens of bytes for each token.

A word is encoded by one pass over its symbols. Every beginning of a word has one accepted path, so each place is
reached by one arc; the arcs on the path to the last place are the word's tokens. Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import hashlib
import json
import re
from bisect import bisect_right
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from textshield import runtime
from textshield.llm import rows
from textshield.llm.memo import Ids, Memo, gathered, text_buffers

START = -1

#: Words encoded at once; longer ones, in symbols, are encoded by themselves.
AT_ONCE, LONG = 50_000, 200


class Automaton:
    """The merges of a vocabulary as an automaton over its tokens, as a compiled table."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        parts: dict[int, tuple[int, int, int]] = {}  # token: left, right, time of its gadget
        taken: dict[int, dict[int, int]] = {}  # state: token whose arc it lost, and when
        dead: set[int] = set()
        for m, (a, b) in enumerate(merges):
            u, v, uv = vocab[a], vocab[b], vocab[a + b]
            if uv in parts:
                raise ValueError(f"two merges make {a + b!r}")
            if _has_arc(parts, taken, dead, u, v, m):
                taken.setdefault(u, {})[v] = m
                parts[uv] = (u, v, m)
            else:
                dead.add(uv)
        self.spelled = {v: k for k, v in vocab.items() if v not in dead}
        self._compile(parts)

    def _compile(self, parts: dict[int, tuple[int, int, int]]) -> None:
        """The transition table, and the trie of the arcs' spellings.

        `edges` are the ends of the runs of arcs that states lack, as row * width + number, where each state has a row
        and each arc a number: an arc is lacking where an odd count of edges is at or below it.
        """
        self.width = width = max(self.spelled, default=-1) + 2
        arcs, arc_runs = _numbered(parts, 0, width - 1)
        states, state_runs = _numbered(parts, 1, width - 1)
        runs = np.array([(*state_runs(u, m + 1), *arc_runs(v, m)) for u, v, m in parts.values()], np.int64).reshape(-1, 4)
        rows_ = runs[:, 1] - runs[:, 0]
        row = np.arange(rows_.sum()) + np.repeat(runs[:, 0] - (np.cumsum(rows_) - rows_), rows_)
        low, high = np.repeat(runs[:, 2], rows_) + row * width, np.repeat(runs[:, 3], rows_) + row * width
        order = np.argsort(low, kind="stable")
        low, reach = low[order], np.maximum.accumulate(high[order])
        begins = np.concatenate([np.ones(len(low[:1]), bool), low[1:] > reach[:-1]])  # runs that overlap or touch become one
        at = np.flatnonzero(begins)
        kind = np.uint32 if width * width < 1 << 32 else np.int64
        self.edges = np.stack([low[at], reach[np.append(at[1:], len(low))[: len(at)] - 1]], 1).ravel().astype(kind)
        self.rows, self.arcs = np.array(states, np.int64), np.array(arcs, np.int64)
        known = {k[:i]: START for k in self.spelled.values() for i in range(1, len(k))}  # what only begins tokens is none
        known.update({k: v for v, k in self.spelled.items()})
        letters = sorted({c for k in known for c in k})
        self.letter = {c: i for i, c in enumerate(letters)}
        self.fan = len(letters) or 1
        nodes = {k: i for i, k in enumerate(["", *sorted(known)])}
        self.token = np.array([START, *(known[k] for k in list(nodes)[1:])], np.int64)
        steps = np.array(sorted((nodes[k[:-1]] * self.fan + self.letter[k[-1]], i) for k, i in nodes.items() if k), np.int64).reshape(-1, 2)
        self.steps, self.nodes = steps[:, 0].copy(), steps[:, 1].copy()

    def lacking(self, state: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Which of the states lack the arc for the token beside them."""
        key = (self.rows[state] * self.width + self.arcs[token]).astype(self.edges.dtype)
        return (np.searchsorted(self.edges, key, "right") & 1).astype(bool)

    def follows(self, state: int, token: int) -> bool:
        """Whether the state reached by one token has an arc for the other."""
        return state == START or not self.lacking(np.array([state]), np.array([token]))[0]

    def encode(self, symbols: str) -> list[int]:
        """The tokens on the accepted path of a word's symbols."""
        return self.encode_all(np.array([self.letter[c] for c in symbols], np.int64), np.array([0, len(symbols)]))[0].tolist()

    def encode_all(self, symbols: np.ndarray, ends: np.ndarray) -> Ids:
        """The tokens of words, given as one run of letters (numbers of `letter`) and where each begins and the last ends."""
        long = np.flatnonzero(np.diff(ends) > LONG)
        if len(long):  # each by itself, so that the others need few steps
            short, there = gathered(symbols, ends, np.flatnonzero(np.diff(ends) <= LONG))
            ids, stops = self._encode(short, there)
            alone = [self._encode(symbols[ends[i] : ends[i + 1]], np.array([0, ends[i + 1] - ends[i]])) for i in long]
            n = np.concatenate([np.diff(stops), *(np.diff(x) for _, x in alone)])
            order = np.argsort(np.concatenate([np.flatnonzero(np.diff(ends) <= LONG), long]))
            return gathered(np.concatenate([ids, *(x for x, _ in alone)]), np.concatenate([[0], np.cumsum(n)]), order)
        parts = [self._encode(symbols[ends[a] : ends[b]], ends[a : b + 1] - ends[a]) for a, b in ((a, min(a + AT_ONCE, len(ends) - 1)) for a in range(0, len(ends) - 1, AT_ONCE))]
        ids = np.concatenate([np.zeros(0, np.uint32), *(x for x, _ in parts)])
        return ids, np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *(np.diff(x) for _, x in parts)]))])

    def _encode(self, symbols: np.ndarray, ends: np.ndarray) -> Ids:
        """All words at once: the arcs that begin at each place by the trie, then the states place by place by the table."""
        lengths, words = np.diff(ends), len(ends) - 1
        word = np.repeat(np.arange(words), lengths)
        stop, at, node = ends[1:][word], np.arange(len(symbols)), np.zeros(len(symbols), np.int64)
        begun, tokens, size = [], [], 0
        long: list[int] = []
        while len(at):
            key = node * self.fan + symbols[at + size]
            i = np.minimum(np.searchsorted(self.steps, key), len(self.steps) - 1)
            there = self.steps[i] == key
            at, node, stop, size = at[there], self.nodes[i[there]], stop[there], size + 1
            t = self.token[node]
            arc = t >= 0
            begun.append(at[arc])
            tokens.append(t[arc])
            long.append(size)
            more = at + size < stop
            at, node, stop = at[more], node[more], stop[more]
        size = np.repeat(long, [len(x) for x in begun])
        begun, tokens = np.concatenate([np.zeros(0, np.int64), *begun]), np.concatenate([np.zeros(0, np.int64), *tokens])
        place = begun + word[begun]  # a word has a place before each symbol and one at its end
        step = begun - ends[word[begun]]
        order = np.argsort(step, kind="stable")
        cuts = np.searchsorted(step[order], np.arange(lengths.max(initial=0) + 1))
        by, came = np.full(len(symbols) + words, START, np.int64), np.zeros(len(symbols) + words, np.int64)
        for k, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
            x = order[a:b]
            if k:
                state = by[place[x]]
                x = x[(state >= 0) & ~self.lacking(state, tokens[x])]
            to = place[x] + size[x]
            by[to], came[to] = tokens[x], size[x]
        path = np.zeros(len(by), bool)
        last = np.arange(1, words + 1) + ends[1:] - 1
        first = last - lengths
        while len(last):
            going = last > first
            last, first = last[going], first[going]
            path[last] = True
            if (by[last] < 0).any():
                raise ValueError("a symbol that no token spells")
            last = last - came[last]
        n = np.bincount(np.repeat(np.arange(words), lengths + 1)[path], minlength=words)
        return by[path].astype(np.uint32), np.concatenate([[0], np.cumsum(n)])


def _has_arc(parts: dict, taken: dict, dead: set, state: int, token: int, now: int) -> bool:
    """Whether, before the gadget of that time, the state had an arc for the token: neither lost it, nor was made from one that was."""
    when = now - 1
    while state not in dead:
        s, t = state, when
        while True:  # the state and those that it was copied from, each as it was then
            lost = taken.get(s, {}).get(token)
            if lost is not None and lost <= t:
                return False
            if s not in parts:
                break
            _, s, born = parts[s]
            t = min(t, born - 1)
        if token not in parts:
            return token not in dead
        token, _, born = parts[token]
        when = min(when, born)
    return False


def _numbered(parts: dict[int, tuple[int, int, int]], side: int, size: int):
    """Numbers of tokens along the tree of their left (side 0) or right parts, those made latest first.

    Also a function of a token and a time: the run of its number and those of what was made from it at that time or later.
    """
    made: dict[int, list[tuple[int, int]]] = {}
    for t, p in parts.items():
        made.setdefault(p[side], []).append((p[2], t))
    for x in made.values():
        x.sort(reverse=True)
    number, below, order = [0] * size, [1] * size, []
    left = [t for t in range(size) if t not in parts]
    while left:
        t = left.pop()
        number[t] = len(order)
        order.append(t)
        left += [x for _, x in reversed(made.get(t, ()))]
    for t in reversed(order):
        if t in parts:
            below[parts[t][side]] += below[t]

    births = {t: [-born for born, _ in x] for t, x in made.items()}
    sizes = {t: [0, *accumulate(below[k] for _, k in x)] for t, x in made.items()}

    def run(token: int, since: int) -> tuple[int, int]:
        later = sizes[token][bisect_right(births[token], -since)] if token in made else 0
        return number[token], number[token] + 1 + later

    return number, run


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    letter, extra = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in letter:
            letter[b] = chr(extra)
            extra += 1
    return [letter[b] for b in range(256)]


#: The normalizer and the splitter of the file whose words are found here; of other files the library finds them.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


class Form:
    """What a vocabulary file says of how texts become words and ids text again."""

    def __init__(self, spec: str):
        d = json.loads(spec)
        self.model, self.added = d["model"], d["added_tokens"]
        contents = [a["content"] for a in self.added]
        apart = all(not re.search(r"\s", c) and "<|" in c and not a["normalized"] for a, c in zip(self.added, contents, strict=True))
        #: Whether what stands between white space can be encoded by itself, and its words found by `memo.WORDS`.
        self.by_chunk = apart and d["normalizer"] == NORMALIZER and d["pre_tokenizer"] == SPLITTER
        self.labels_joined = d.get("decoder") is None
        self.suffix = self.model.get("end_of_word_suffix") or ""


class Codec:
    """A byte-level BPE vocabulary file: words, special tokens, automaton, labels."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.form = Form(spec)
        model, self.suffix = self.form.model, self.form.suffix
        if model["type"] != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("byte_fallback") or model.get("ignore_merges"):
            raise ValueError("no plain BPE model")
        merges = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
        added = {a["content"] for a in self.form.added}
        plain = {self._symbols(k): v for k, v in model["vocab"].items() if k not in added}
        self.automaton = Automaton(plain, [(self._symbols(a), self._symbols(b)) for a, b in merges])
        labels = [""] * (max([*model["vocab"].values(), *(a["id"] for a in self.form.added)]) + 1)
        for k, v in [*model["vocab"].items(), *((a["content"], a["id"]) for a in self.form.added)]:
            labels[v] = k + " "  # the blank belongs to each but a text's last
        self.labels = pa.array(labels, pa.large_string())
        self.special = {a["content"]: a["id"] for a in self.form.added}
        self.cut = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.letters = byte_letters()
        self.letter_to_byte = {c: b for b, c in enumerate(self.letters)}
        self.letter_of_byte = np.array([self.automaton.letter.get(c, -1) for c in self.letters])
        ending = np.array([self.automaton.letter.get(chr(ord(c) + 0x10000), -1) for c in self.letters])
        self.last_of_byte = ending if self.suffix else self.letter_of_byte
        if (self.letter_of_byte < 0).any() or (self.last_of_byte < 0).any():
            raise ValueError("not every byte has a token")
        self.library = Tokenizer.from_str(spec)
        self.words = Memo(self._words)
        self.chunks = Memo.of_chunks(self.words, lambda chunks: self._whole(chunks.to_pylist())) if self.form.by_chunk else None

    def _symbols(self, token: str) -> str:
        """A token with one character for each base symbol: the last one stands for itself with the suffix."""
        if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix):
            token = token[: -len(self.suffix)]
            return token[:-1] + chr(ord(token[-1]) + 0x10000)
        return token

    def _words(self, words: pa.Array) -> Ids:
        ends, data = text_buffers(words)
        keep = np.concatenate([[True], np.diff(ends) > 0])  # an empty word has no letter to end
        ends_of_some = ends[keep]
        symbols = self.letter_of_byte[data]
        symbols[ends_of_some[1:] - 1] = self.last_of_byte[data[ends_of_some[1:] - 1]]
        ids, stops = self.automaton.encode_all(symbols, ends_of_some)
        return ids, stops[np.cumsum(keep) - 1]

    def _whole(self, texts: list[str]) -> Ids:
        """Ids of texts whose words the library's normalizer and splitter find."""
        words: list[bytes] = []  # a special token stands between words as its content
        owner: list[int] = []
        special: list[tuple[int, int]] = []
        for i, text in enumerate(texts):
            for x in self.cut.split(text) if self.cut else [text]:
                if x in self.special:
                    special.append((len(words), self.special[x]))
                    words.append(b"a")
                    owner.append(i)
                    continue
                if self.library.normalizer:
                    x = self.library.normalizer.normalize_str(x)
                for word, _ in self.library.pre_tokenizer.pre_tokenize_str(x):
                    words.append(bytes(map(self.letter_to_byte.__getitem__, word)))
                    owner.append(i)
        ids, ends = self._words(pa.array(words, pa.binary()))
        n = np.diff(ends)
        for at, token in special:
            ids[ends[at]] = token  # "a" is one token
        per_text = np.bincount(np.array(owner, np.int64), n, len(texts)).astype(np.int64)
        return ids, np.concatenate([[0], np.cumsum(per_text)])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts (null: none) as one array, and where each text's begin and the last's end."""
        if self.chunks is None:
            return self._whole(rows.texts(texts))
        return self.chunks.of_texts(texts)

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[memoryview]:
        """The labels of the arcs in UTF-8, as the library joins them: by blanks where a file has no decoder of its own."""
        if not self.form.labels_joined:
            return [memoryview(self.library.decode(ids[a:b].tolist(), skip_special_tokens=False).encode()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        stops, data = text_buffers(self.labels.take(pa.array(ids)))
        data, stops = memoryview(data), stops[ends].tolist()
        return [data[a : max(a, b - 1)] for a, b in zip(stops[:-1], stops[1:], strict=True)]


_codecs: dict[str, Codec] = {}


def codec(spec: str) -> Codec:
    """The codec of a vocabulary file's text, built once by each worker."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _codecs:
        _codecs[key] = Codec(spec)
    return _codecs[key]


def read_spec(path: str) -> str:
    """A vocabulary file's text; some MB at most, sent to the tasks with their code."""
    with open(path, encoding="utf-8") as f:
        spec = f.read()
    if len(spec) > 64 << 20:
        raise ValueError(f"{path}: too large to send to every task")
    return spec


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def packed(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Each text's ids as little-endian unsigned 32-bit integers."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer((4 * ends).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(ids, "<u4"))])


def encode(docs: DataFrame, path: str | None = None, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add the ids of each whole text as packed bytes; other columns stay.

    A null text counts as empty and has no ids. Repeated rows and ties are encoded each by itself, an empty table stays
    empty, and a column that is already called like the new one gives way. Memory is bounded by a batch and the chunks kept.
    """
    spark = runtime.prepare(docs.sparkSession)
    spec = spark.sparkContext.broadcast(read_spec(path or default_path()))

    def make():
        c = codec(spec.value)
        return lambda batch: [packed(*c.encode(batch.column(text))).cast(pa.binary())]

    return rows.appended(docs, [T.StructField(ids, T.BinaryType())], make)


def decode(coded: DataFrame, path: str | None = None, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add the decoded text of packed ids; other columns stay.

    Null ids and none at all give an empty text. Repeated rows and ties are decoded each by itself, an empty table stays
    empty, and a column that is already called like the new one gives way. Bytes that are no ids of the file end the job.
    """
    spark = runtime.prepare(coded.sparkSession)
    spec = spark.sparkContext.broadcast(read_spec(path or default_path()))

    def make():
        c = codec(spec.value)

        def each(batch):
            found = [x or b"" for x in batch.column(ids).to_pylist()]
            ends = np.cumsum([0, *(len(x) // 4 for x in found)])
            return [pa.array([str(x, "utf-8") for x in c.decode(np.frombuffer(b"".join(found), "<u4"), ends)], pa.string())]

        return each

    return rows.appended(coded, [T.StructField(decoded, T.StringType())], make)


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The contract's columns: ids made by the automaton, text decoded from those ids, both as digests.

    A null text counts as empty: no ids, and the digests of nothing. Whole texts are read, however long. Repeated rows,
    ties and null identifiers give a row each, an empty table gives none, and columns but doc_id and text are not read.
    """
    spark = runtime.prepare(docs.sparkSession)
    spec = spark.sparkContext.broadcast(read_spec(path or default_path()))

    def make():
        c = codec(spec.value)

        def each(batch):
            a, b, n = [], [], []
            for part in rows.slices(batch.column("text")):
                ids, ends = c.encode(part)
                n += np.diff(ends).tolist()
                view, at = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B"), (4 * ends).tolist()
                a += [hashlib.sha256(view[x:y]).hexdigest() for x, y in zip(at[:-1], at[1:], strict=True)]
                b += [hashlib.sha256(x).hexdigest() for x in c.decode(ids, ends)]
            return [pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]

        return each

    add = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return rows.appended(docs.select("doc_id", "text"), add, make, keep=["doc_id"])

