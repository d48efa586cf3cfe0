"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Groups of equal texts are placed whole, each where the dot product of its vector with the shard's residual capacity is
highest, largest first. The largest groups, of which there are few, are placed over the shards by the driver. All others
are dealt into cells by a hash of their text; in each cell a task places them one by one into its part of what the
largest left free, so that every shard gets an equal share of every cell. Only a group that exceeds a shard's whole fair
share in some dimension is dealt out in equal parts, the fewest that fit.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from textshield import runtime
from textshield.functions import columns as C
from textshield.llm import rows

SHARDS = 8

#: The share of all (in any dimension) from which a group is placed by the driver, and the groups of a cell, about.
LARGE, CELL_GROUPS, MOST_CELLS = 1 / 4096, 100_000, 4096

LAW = "bytes"


def _measured(docs: DataFrame, text: str, key: str) -> DataFrame:
    located = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def make():
        def each(batch):
            full = rows.raw(batch.column("text"))
            return [
                pa.array([len(x) + 1 for x in full], pa.int64()),
                pa.array([len(x.split()) for x in full], pa.int64()),
                pa.array([zlib.crc32(x) for x in full], pa.int64()),
                pa.array([hashlib.sha256(x).digest()[:16] for x in full], pa.binary()),
            ]

        return each

    add = [T.StructField("size", T.LongType()), T.StructField("tokens", T.LongType()), T.StructField("text_crc32", T.LongType()), T.StructField("digest", T.BinaryType())]
    return rows.appended(located, add, make, keep=["doc_id"])


AMOUNTS = ("size", "tokens", "rows")


class Residual:
    """What each shard has left, in parts of a shard's fair share, by dimension."""

    def __init__(self, left: np.ndarray):
        self.left = left.astype(float)

    def put(self, part: np.ndarray) -> int:
        """The shard that takes an item.

        A shard is closed to an item that exceeds its residual of the first dimension, while another has room: that
        dimension comes out near equal, the others as far as the dot product can balance them beside it.
        """
        fits = self.left[:, 0] >= part[0]
        best = int(np.where(fits, self.left @ part, -np.inf).argmax() if fits.any() else self.left[:, 0].argmax())
        self.left[best] -= part
        return best


def place(items: np.ndarray, shards: int, total: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The shard of each item, a row of non-negative amounts, largest first, and what is left of each shard.

    The amounts of all there is, of which a shard's fair share is an equal part, are those of the items unless given.
    """
    total = np.maximum(items.sum(0) if total is None else total, 1)
    part = items / total * shards
    residual = Residual(np.ones((shards, items.shape[1])))
    out = np.zeros(len(items), int)
    for i in np.lexsort((np.arange(len(items)), -part.sum(1), -part.max(1))):
        out[i] = residual.put(part[i])
    return out, residual.left


def _placed_by_cells(groups: DataFrame, total: np.ndarray, left: np.ndarray, shards: int, cell_groups: int) -> DataFrame:
    """Digest and shard of groups that are not large: each cell is placed into its share of what is left of the shards."""
    count = groups.count()
    cells = max(1, min(MOST_CELLS, -(-count // cell_groups)))
    dealt = groups.withColumn("cell", F.pmod(F.xxhash64("digest"), F.lit(cells)).cast("int"))
    sums = {r["cell"]: np.array([r[c] for c in AMOUNTS], float) for r in dealt.groupBy("cell").agg(*(F.sum(c).alias(c) for c in AMOUNTS)).collect()}
    small = np.maximum(sum(sums.values(), np.zeros(len(AMOUNTS))), 1)
    sent = groups.sparkSession.sparkContext.broadcast((sums, small))
    largest = F.greatest(*(F.col(c) / F.lit(float(t)) for c, t in zip(AMOUNTS, total, strict=True)))

    def run(batches):
        (sums, small), cell, residual = sent.value, None, None
        for batch in batches:
            parts = np.stack([batch.column(c).to_numpy() for c in AMOUNTS], 1) / total * shards
            out = []
            for c, part in zip(batch.column("cell").to_pylist(), parts, strict=True):
                if c != cell:
                    cell, residual = c, Residual(left * (sums[c] / small))
                out.append(residual.put(part))
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(out, pa.int32())], ["digest", "shard"])

    return dealt.repartition(cells, "cell").sortWithinPartitions("cell", F.desc(largest), "digest").mapInArrow(run, "digest binary, shard int")


def shard(docs: DataFrame, shards: int = SHARDS, text: str = "text", key: str = "doc_id", *, large: float = LARGE, cell_groups: int = CELL_GROUPS) -> DataFrame:
    """One row for each row: doc_id, size, text_crc32, shard, slot (its place in the shard, gapless from 0).

    The size is the text's UTF-8 bytes plus one. A null text counts as empty and is equal to one; repeated rows and ties
    of identifiers are rows like any other, and a null identifier has no effect. A very long text is an item of its own
    that no dimension can split. Other columns are not read; an empty table gives no rows.

    Sent to the driver: the groups over the share `large` of all in some dimension (3 / large at most) and one row for
    each cell (MOST_CELLS at most). The shares differ between shards by the largest group, and by the last small ones of
    each cell.
    """
    spark = runtime.prepare(docs.sparkSession)
    measured = runtime.written(_measured(docs, text, key), "shard-measured")
    groups = measured.groupBy("digest").agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"))
    groups = runtime.written(groups, "shard-groups")
    total = np.maximum(np.array([x or 0 for x in groups.agg(*(F.sum(c) for c in AMOUNTS)).first()], float), 1)
    is_large = C.any_of([F.col(c) > F.lit(float(t * large)) for c, t in zip(AMOUNTS, total, strict=True)])
    names, items = [], []
    for r in groups.where(is_large).orderBy("digest").collect():
        v = np.array([r[c] for c in AMOUNTS], float)
        n = min(r["rows"], max(1, math.ceil(max(v / total) * shards - 1e-9)))
        names += [bytes(r["digest"])] * n
        items += [v / n] * n
    where: dict[bytes, list[int]] = {}
    found, left = place(np.array(items).reshape(-1, len(AMOUNTS)), shards, total)
    for name, s in zip(names, found, strict=True):
        where.setdefault(name, []).append(int(s))
    alone = spark.createDataFrame(list(where.items()), "digest binary, parts array<int>")
    tagged = measured.join(F.broadcast(alone), "digest", "left")
    small = _placed_by_cells(groups.where(~is_large), total, left, shards, cell_groups)
    of_small = tagged.where("parts is null").drop("parts").join(small, "digest").withColumn("parts", F.array("shard")).drop("shard")

    def run(batches):
        task, filled, dealt = TaskContext.get().partitionId(), [0] * shards, {}
        for batch in batches:
            at, rank = [], []
            for d, parts in zip(batch.column("digest").to_pylist(), batch.column("parts").to_pylist(), strict=True):
                if len(parts) == 1:
                    s = parts[0]
                else:  # the rows of a group that is in several shards take turns, from a place that depends on the task
                    k = dealt[d] = dealt.get(d, task - 1) + 1
                    s = parts[k % len(parts)]
                at.append(s)
                rank.append(filled[s])
                filled[s] += 1
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("size"), batch.column("text_crc32"), pa.array(at, pa.int32()), pa.array(rank, pa.int64()), pa.array([task] * n, pa.int32())], ["doc_id", "size", "text_crc32", "shard", "rank", "task"])

    placed = tagged.where("parts is not null").unionByName(of_small).mapInArrow(run, "doc_id long, size long, text_crc32 long, shard int, rank long, task int")
    placed = runtime.written(placed, "shard-placed")
    filled = placed.groupBy("shard", "task").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = filled.select("shard", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return placed.join(runtime.if_small(starts), ["shard", "task"]).select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("rank")).alias("slot"))


def query(docs: DataFrame) -> DataFrame:
    return shard(docs).select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
