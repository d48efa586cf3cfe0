"""Best-fit packing after Martello and Toth's reduction.

A piece is as long as its tokens, so the instance is a count for each length, whatever the corpus: at most as many rows
as a sequence has places. The driver plans over those counts. It first fixes sets that provably dominate all others
with the same largest piece, in bulk, then packs the rest by best fit, longest first, also in bulk: equal sequences are
one run. Tasks then find each piece's sequence from its rank among the pieces of its length.
"""

from __future__ import annotations

import os
import struct
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from textshield import runtime
from textshield.llm import bpe, rows
from textshield.llm.memo import Ids, Memo, encoded

CAPACITY, END = 4096, 1

class LibraryIds:
    """Ids as the tokenizers library makes them; of texts that can be split at white space, each word is asked once and kept."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library, form = Tokenizer.from_str(spec), bpe.Form(spec)
        self.model = self.library.model
        self.letters = dict(enumerate(bpe.byte_letters()))
        self.chunks = Memo.of_chunks(Memo(self._words), self._each) if form.by_chunk else None

    def _each(self, texts: pa.Array) -> Ids:
        return encoded([x.ids for x in self.library.encode_batch_fast(rows.texts(texts), add_special_tokens=False)])

    def _words(self, words: pa.Array) -> Ids:
        """Ids of single words: the model alone takes them in the letters that stand for their bytes."""
        ask = self.model.tokenize
        shown = (w if w.isascii() else w.encode().decode("latin-1").translate(self.letters) for w in words.to_pylist())
        return encoded([[t.id for t in ask(w)] for w in shown])

    def encode(self, texts: pa.Array) -> Ids:
        """The ids of whole texts (null: none) as one array, and where each text's begin and the last's end."""
        return self.chunks.of_texts(texts) if self.chunks else self._each(texts)


_ids: dict[int, LibraryIds] = {}


def library_ids(spec: str) -> LibraryIds:
    key = hash(spec)
    if key not in _ids:
        _ids[key] = LibraryIds(spec)
    return _ids[key]


class Plan:
    """Runs (length, first rank, first sequence, pieces in each sequence, offset of the first) over counts by length."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY):
        self.capacity, self.sequences, self.fixed = capacity, 0, 0
        self.left = [0] * (capacity + 1)
        for length, n in counts.items():
            self.left[length] = n
        self.taken = [0] * (capacity + 1)
        self.runs: list[tuple[int, int, int, int, int]] = []
        self.reduce()
        self.fixed = self.sequences
        self.best_fit()

    def _put(self, length: int, sequence: int, count: int, each: int, offset: int) -> None:
        self.runs.append((length, self.taken[length], sequence, each, offset))
        self.taken[length] += count * each
        self.left[length] -= count * each

    def _fix(self, lengths: list[int], count: int) -> None:
        offset = 0
        for x in lengths:
            self._put(x, self.sequences, count, 1, offset)
            offset += x
        self.sequences += count

    def reduce(self) -> None:
        """Fix dominating sets for each length, longest first, until none is found.

        {j} dominates where nothing fits beside j. {j, k}, with k the longest that fits, dominates a set j, x, y, ... if
        k is at least x + y + ...: always where j + k is full or no two others fit, else if two at most fit and none
        two are longer than k. {j, k, b}, with b the longest that fits beside both, dominates where two at most fit and
        no second one is longer than b. Fewer pieces leave fewer sets to dominate, so a set is fixed as often as it can be.
        """
        changed = True
        while changed:
            changed = False
            for j in range(self.capacity, 0, -1):
                while self.left[j]:
                    found = self._dominating(j)
                    if not found:
                        break
                    self._fix(found, min(self.left[x] // found.count(x) for x in found))
                    changed = True

    def _dominating(self, j: int) -> list[int] | None:
        room = self.capacity - j
        free = lambda x, used=(): self.left[x] - (x == j) - used.count(x)
        k = next((x for x in range(room, 0, -1) if free(x) > 0), 0)
        if not k:
            return [j]
        if k == room:
            return [j, k]
        least: list[int] = []
        for x in range(1, room + 1):
            least += [x] * min(free(x), 3 - len(least))
            if len(least) == 3 or sum(least) > room:
                break
        if sum(least[:2]) > room or len(least) < 2:
            return [j, k]
        if len(least) == 3 and sum(least) <= room:
            return None
        there = [x for x in range(1, room) if free(x) > 0]
        longest_pair = second = 0
        for y in there:
            x = next((x for x in range(room - y, y - 1, -1) if free(x, (y,)) > 0), 0)
            if x:
                longest_pair, second = max(longest_pair, x + y), y
        if k >= longest_pair:
            return [j, k]
        b = next((x for x in range(room - k, 0, -1) if free(x, (k,)) > 0), 0)
        return [j, k, b] if b >= second else None

    def best_fit(self) -> None:
        """Longest first into the fullest sequence that has room, else a new one; runs of equal sequences at once."""
        open_: dict[int, list[tuple[int, int]]] = {}  # room: runs of sequences (first, how many)
        rooms: list[int] = []  # sorted
        for length in range(self.capacity, 0, -1):
            while n := self.left[length]:
                at = bisect_right(rooms, length - 1)
                if at < len(rooms):
                    room = rooms[at]
                    first, many = open_[room].pop()
                    if not open_[room]:
                        del open_[room], rooms[at]
                else:
                    room, first, many = self.capacity, self.sequences, -(-n // (self.capacity // length))
                    self.sequences += many
                each = room // length
                full = min(many, n // each)
                if full:
                    self._put(length, first, full, each, self.capacity - room)
                    self._open(open_, rooms, room - each * length, first, full)
                if many > full and (rest := n - full * each):
                    if rest < each:  # the last one of this length
                        self._put(length, first + full, 1, rest, self.capacity - room)
                        self._open(open_, rooms, room - rest * length, first + full, 1)
                        full += 1
                if many > full:
                    self._open(open_, rooms, room, first + full, many - full)

    @staticmethod
    def _open(open_: dict, rooms: list[int], room: int, first: int, many: int) -> None:
        if room:
            if room not in open_:
                rooms.insert(bisect_right(rooms, room), room)
            open_.setdefault(room, []).append((first, many))

    def tables(self) -> dict[int, tuple[np.ndarray, ...]]:
        """Runs by length, as arrays in order of rank."""
        out: dict[int, list] = {}
        for length, *run in sorted(self.runs):
            out.setdefault(length, []).append(run)
        return {k: tuple(np.array(v, np.int64).T) for k, v in out.items()}


PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, rank long, task int"


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Pieces of each document's ids and their rank among those of their length in their task."""
    spark = runtime.prepare(docs.sparkSession)
    spec = spark.sparkContext.broadcast(bpe.read_spec(path or bpe.default_path()))
    end = struct.pack("<I", END)

    def run(batches):
        library, task, ranks = library_ids(spec.value), TaskContext.get().partitionId(), {}
        for batch in batches:
            out: list[tuple] = []
            names, at = batch.column("doc_id").to_pylist(), 0
            for part in rows.slices(batch.column("text")):
                ids, ends = library.encode(part)
                packed = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                for doc, a, b in zip(names[at : at + len(part)], ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    for i, s in enumerate(range(a, b + 1, capacity)):  # the end token is at b
                        stop = min(s + capacity, b + 1)
                        crc = zlib.crc32(packed[4 * s : 4 * min(stop, b)])
                        if stop > b:
                            crc = zlib.crc32(end, crc)
                        ranks[stop - s] = rank = ranks.get(stop - s, -1) + 1
                        out.append((doc, i, s - a, stop - s, crc, rank, task))
                at += len(part)
            if out:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "rank", "task"])
        rows.release()

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, PIECES)


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text counts as empty: its only token is the end token, like that of an empty one. Only documents of more than
    `capacity` tokens are cut, whole texts are read, repeated rows and ties are packed each by itself, and a null
    identifier has no effect. Other columns are not read; an empty table gives no rows.

    Sent to the driver: one count for each length; to the tasks: the plan's runs, some for each length.
    """
    found = runtime.written(pieces(docs, path, capacity, text, key), "packing-pieces")
    counts = found.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    counts = runtime.written(counts, "packing-counts")
    plan = Plan({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    tables = found.sparkSession.sparkContext.broadcast(plan.tables())
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = found.join(runtime.if_small(starts), ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("rank")).alias("rank"))

    def make():
        runs = tables.value

        def each(batch):
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length):
                here = length == x
                first, number, many, at = runs[int(x)]
                k = np.searchsorted(first, rank[here], "right") - 1
                within = rank[here] - first[k]
                sequence[here] = number[k] + within // many[k]
                offset[here] = at[k] + within % many[k] * x
            return [pa.array(sequence), pa.array(offset)]

        return each

    placed = rows.appended(ranked, [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())], make)
    return placed.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")
