"""SimHash near-duplicates through covering locality-sensitive hashing.

Bit i of a fingerprint has a non-zero vector m(i) of radius + 1 bits. For each non-zero vector v there is a table whose
mask holds the bits with an odd product of m(i) and v. At most `radius` differing bits leave a v that is orthogonal to
all their vectors, so the pair agrees on v's whole mask: every pair within the radius shares a bucket of some table.

Equal fingerprints are one class beforehand. A bucket gives one link less than each of its components has classes, never
all pairs. A bucket of more classes than BUCKET is dealt out
again by masks over the bits that its own mask leaves free, built the same way; what shares a bucket then is compared at
once, however many classes it has.

Where a link counts only if the texts are similar too, a tree is not enough: see similar_groups.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textshield import runtime
from textshield.llm import rows

SHINGLE, RADIUS, SEED = 3, 3, 42

#: Classes in a bucket that are compared at once; larger buckets are dealt out again.
BUCKET = 16384


def _hashes(text: bytes, shingle: int) -> np.ndarray:
    """Of each shingle, repeats included; of a text of fewer words one, of no word none."""
    words = text.lower().split()
    h, join = xxhash.xxh64_intdigest, b" ".join
    if len(words) <= shingle:
        return np.array([h(join(words), SEED)] if words else [], np.uint64)
    return np.fromiter((h(join(s), SEED) for s in zip(*(words[i:] for i in range(shingle)), strict=False)), np.uint64, len(words) - shingle + 1)


def _majority(hashes: np.ndarray) -> int:
    """A bit is set if over half of the hashes have it."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """A bit is set if over half of the shingles' hashes have it; no word: zero."""
    return _majority(_hashes(text, shingle))


def remixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """Other hashes of the same shingles: the k-th step of a splitmix generator over them; the 0th are they."""
    if not k:
        return hashes
    with np.errstate(over="ignore"):
        z = hashes + np.uint64(0x9E3779B97F4A7C15 * k & (1 << 64) - 1)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def fingerprints(text: bytes, shingle: int, many: int) -> list[int]:
    """So many fingerprints, the first of which is the text's fingerprint."""
    hashes = _hashes(text, shingle)
    return [_majority(remixed(hashes, k)) for k in range(many)]


def covering_masks(bits: list[int], radius: int) -> list[int]:
    """2^(radius + 1) - 1 masks over the given bits; any `radius` of them are outside of one mask.

    Where there are more vectors than bits, a fixed permutation spreads the vectors over all dimensions, so that every
    mask has about half of the bits.
    """
    n = (1 << radius + 1) - 1
    vectors = list(range(1, n + 1)) if n < len(bits) else random.Random(SEED).sample(range(1, n + 1), n)
    return [sum(1 << b for i, b in enumerate(bits) if (vectors[i % n] & v).bit_count() & 1) for v in range(1, n + 1)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def components(found: np.ndarray, radius: int, star: bool = True) -> list[tuple[int, int]]:
    """Links of distinct fingerprints, one less than each component has members.

    Each component grows by the fingerprint that is nearest to it (Prim's tree). As a star, its members are linked to
    its least one; else each is linked to the one that it was nearest to, which is within the radius.
    """
    if len(found) == 2:
        a, b = sorted(map(int, found))
        return [(a, b)] if ((a ^ b) & (1 << 64) - 1).bit_count() <= radius else []
    left = np.sort(found)
    out: list[tuple[int, int]] = []
    while len(left):
        centre = last = left[0]
        left = left[1:]
        far, nearest = np.full(len(left), 65, np.uint8), np.full(len(left), centre)
        while len(left):
            apart = np.bitwise_count((left ^ last).view(np.uint64))
            closer = apart < far
            far[closer], nearest[closer] = apart[closer], last
            i = int(far.argmin())
            if far[i] > radius:
                break
            last = left[i]
            out.append((int(centre), int(last)) if star else tuple(sorted((int(nearest[i]), int(last)))))
            left, far, nearest = np.delete(left, i), np.delete(far, i), np.delete(nearest, i)
    return out


LINKS = "a long, b long, bucket int, fp long"


def _link(dealt: DataFrame, radius: int, most: int | None, star: bool) -> DataFrame:
    """Links within buckets (bucket, key, fp), or, of buckets of over `most` classes, their members for another round."""

    def run(batches):
        a, b, again, members = [], [], [], []
        held: list[np.ndarray] = []  # of the bucket that the last batch ended in
        size, at, passed = 0, None, False

        def close():
            nonlocal held, size, passed
            if size > 1 and not passed:
                for x, y in components(np.concatenate(held), radius, star):
                    a.append(x)
                    b.append(y)
            held, size, passed = [], 0, False

        def made():
            n, m = len(a), len(members)
            batch = pa.RecordBatch.from_arrays([pa.array(a + [None] * m, pa.int64()), pa.array(b + [None] * m, pa.int64()), pa.array([None] * n + again, pa.int32()), pa.array([None] * n + members, pa.int64())], ["a", "b", "bucket", "fp"])
            for x in (a, b, again, members):
                x.clear()
            return batch

        for batch in batches:
            bucket, key, fp = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "key", "fp"))
            cuts = np.flatnonzero((bucket[1:] != bucket[:-1]) | (key[1:] != key[:-1])) + 1
            starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(fp)]])
            whole = (ends - starts > 1) | (starts == 0) | (ends == len(fp))  # others are alone
            for s, e in zip(starts[whole], ends[whole], strict=True):
                here = (int(bucket[s]), int(key[s]))
                if here != at:
                    close()
                    at = here
                held.append(fp[s:e])
                size += e - s
                if most and size > most:  # let the members go, and those that follow
                    passed = True
                    for x in held:
                        again += [here[0]] * len(x)
                        members += x.tolist()
                    held = []
                if e < len(fp):
                    close()
                    at = None
            if len(a) + len(members) >= 20_000:
                yield made()
        close()
        if a or members:
            yield made()

    return dealt.repartition("bucket", "key").sortWithinPartitions("bucket", "key").mapInArrow(run, LINKS)


def _dealt_again(members: DataFrame, masks: list[int], radius: int) -> DataFrame:
    """Members of large buckets by masks that cover the bits which their bucket's mask leaves free."""

    def run(batches):
        for batch in batches:
            bucket, fp = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "fp"))
            for i in np.unique(bucket):
                mine, mask = fp[bucket == i].astype(np.int64), masks[int(i) % len(masks)]
                for j, sub in enumerate(covering_masks([b for b in range(64) if not mask >> b & 1], radius)):
                    key = mine & np.int64(signed(mask | sub))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(mine), int(i) * len(masks) + j, np.int32)), pa.array(key), pa.array(mine)], ["bucket", "key", "fp"])

    return members.select("bucket", "fp").mapInArrow(run, "bucket int, key long, fp long")


def links(classes: DataFrame, radius: int = RADIUS, most: int = BUCKET, star: bool = True) -> DataFrame:
    """Links (a, b), a below b, whose components are those of all pairs of distinct fingerprints (fp) within the radius.

    Not as stars, every link is itself such a pair.
    """
    masks = covering_masks(list(range(64)), radius)
    dealt = classes.select("fp", F.explode(F.array(*(F.struct(F.lit(i).alias("bucket"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for i, m in enumerate(masks)))).alias("x")).select("x.bucket", "x.key", "fp")
    first = runtime.written(_link(dealt, radius, most, star), "simhash-links")
    found = first.where("a is not null").select("a", "b")
    large = first.where("fp is not null")
    if not large.isEmpty():
        found = found.unionByName(_link(_dealt_again(large, masks, radius), radius, None, star).select("a", "b"))
    return found.distinct()


#: A bucket gives its pairs if they are at most so many for each of its classes, else a tree.
DENSE = 1


def near(found: np.ndarray, radius: int):
    """All pairs of sorted distinct fingerprints within the radius, as arrays (a, b), block by block."""
    step = max(1, (1 << 20) // max(1, len(found)))
    for s in range(0, len(found) - 1, step):
        i, j = np.nonzero(np.bitwise_count((found[s : s + step, None] ^ found[None, s + 1 :]).view(np.uint64)) <= radius)
        i, j = i[j >= i] + s, j[j >= i] + s + 1
        if len(i):
            yield found[i], found[j]


def _buckets(batches, names: tuple[str, ...], most: int | None):
    """Buckets of two rows or more of sorted batches: bucket, key, columns, and whether it is one of over `most` rows, which comes in pieces."""
    at, held, size = None, [], 0

    def joined():
        return at[0], at[1], [np.concatenate(x) for x in zip(*held, strict=True)], bool(most and size > most)

    for batch in batches:
        bucket, key, *columns = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "key", *names))
        if not len(bucket):
            continue
        cuts = np.flatnonzero((bucket[1:] != bucket[:-1]) | (key[1:] != key[:-1])) + 1
        starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(bucket)]])
        whole = (ends - starts > 1) | (starts == 0) | (ends == len(bucket))  # others are alone
        for s, e in zip(starts[whole], ends[whole], strict=True):
            here = (int(bucket[s]), int(key[s]))
            if here != at:
                if held and size > 1:
                    yield joined()
                at, held, size = here, [], 0
            held.append([c[s:e] for c in columns])
            size += e - s
            if most and size > most:
                yield joined()
                held = []
    if held and size > 1:
        yield joined()


COMPARED = "k int, a long, b long, tree boolean, bucket int, fp long"


def _dealt(classes: DataFrame, masks: list[int]) -> DataFrame:
    """Each fingerprint (the k-th of its texts, fp) once for each mask, whose buckets are numbered from k times the masks on.

    The masks are no part of the plan.
    """

    def run(batches):
        by = np.array([signed(m) for m in masks], np.int64)
        for batch in batches:
            k, fp = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("k", "fp"))
            for at in range(0, len(fp), 512):
                x = fp[at : at + 512]
                bucket = k[at : at + 512, None] * len(by) + np.arange(len(by))[None, :]
                yield pa.RecordBatch.from_arrays([pa.array(bucket.ravel().astype(np.int32)), pa.array((x[:, None] & by[None, :]).ravel()), pa.array(np.repeat(x, len(by)))], ["bucket", "key", "fp"])
        rows.release()

    return classes.select("k", "fp").mapInArrow(run, "bucket int, key long, fp long")


def _compare(dealt: DataFrame, radius: int, most: int | None, dense: int, per: int) -> DataFrame:
    """All pairs of each bucket (k, a, b); of a dense one a tree of them; of one of over `most` classes its members (bucket, fp).

    per: buckets of one k.
    """

    def run(batches):
        out, rows_ = [], 0

        def made():
            return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*out, strict=True)], ["k", "a", "b", "tree", "bucket", "fp"])

        def pairs(bucket, a, b, tree):
            n = len(a)
            out.append([pa.array(np.full(n, bucket // per, np.int32)), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(np.full(n, tree)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64())])
            return n

        def members(bucket, fp):
            n = len(fp)
            out.append([pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.bool_()), pa.array(np.full(n, bucket, np.int32)), pa.array(fp, pa.int64())])
            return n

        for bucket, _, (fp,), large in _buckets(batches, ("fp",), most):
            if large:
                rows_ += members(bucket, fp)
            else:
                fp, found, n = np.sort(fp), [], 0
                for a, b in near(fp, radius):
                    found.append((a, b))
                    n += len(a)
                    if n > dense * len(fp):
                        break
                if n > dense * len(fp):
                    rows_ += pairs(bucket, *map(list, zip(*components(fp, radius, star=False), strict=True)), True)
                else:
                    rows_ += sum(pairs(bucket, a, b, False) for a, b in found)
            if rows_ >= 20_000:
                yield made()
                out, rows_ = [], 0
        if out:
            yield made()
        del out
        rows.release()

    return dealt.repartition("bucket", "key").sortWithinPartitions("bucket", "key").mapInArrow(run, COMPARED)


def candidates(classes: DataFrame, radius: int, most: int = BUCKET, dense: int = DENSE) -> DataFrame:
    """Pairs (k, a, b, tree) of distinct k-th fingerprints (k, fp) within the radius.

    Every pair within the radius is among them, or is connected by pairs that are marked as those of a tree.
    """
    masks = covering_masks(list(range(64)), radius)
    n = len(masks)
    found = runtime.written(_compare(_dealt(classes, masks), radius, most, dense, n), "simhash-compared")
    large = found.where("fp is not null")
    if not large.isEmpty():
        found = found.unionByName(_compare(_dealt_again(large, masks, radius), radius, None, dense, n * n))
    return found.where("a is not null").groupBy("k", "a", "b").agg(F.max("tree").alias("tree"))


def shingles(text: bytes, words: int) -> frozenset:
    """Distinct runs of so many lower-cased words; of a shorter text the whole."""
    w = text.lower().split()
    return frozenset(zip(*(w[i:] for i in range(words)), strict=False)) if len(w) > words else frozenset([tuple(w)])


def similar(pairs: DataFrame, bodies: DataFrame, words: int, least: float) -> DataFrame:
    """The pairs (a, b) of rows (row, text) whose word shingles have a Jaccard similarity of `least` or more.

    The texts of a's partners are streamed past a's own, so a row with many partners is held once.
    """
    first = pairs.select("a").distinct().join(bodies, F.col("a") == F.col("row")).select("a", F.lit(None).cast("long").alias("b"), "text")
    second = pairs.join(bodies, F.col("b") == F.col("row")).select("a", "b", "text")

    def run(batches):
        own = frozenset()
        for batch in batches:
            out = []
            for a, b, text in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), rows.raw(batch.column("text")), strict=True):
                if b is None:
                    own = shingles(text, words)
                else:
                    other = shingles(text, words)
                    both = len(own & other)
                    if both >= least * (len(own) + len(other) - both):
                        out.append((a, b))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])
        rows.release()

    return first.unionByName(second).repartition("a").sortWithinPartitions("a", "b").mapInArrow(run, "a long, b long")


def connected(pairs: DataFrame) -> DataFrame:
    """Component label (the least member) of each node of the links, as (node, label), by alternating stars.

    Every round is written to the shared folder, where its lineage ends; rounds grow with the logarithm of a component.
    """
    spark = pairs.sparkSession
    with runtime.scratch(spark):
        edges = runtime.written(_stars(pairs), "components", keep=True)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def _stars(pairs: DataFrame) -> DataFrame:
    """Links (u, v) of each node with the least member of its component."""
    edges = runtime.written(pairs.select(F.col("b").alias("u"), F.col("a").alias("v")), "stars")

    def mark(df):
        r = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return r[0], r[1]

    now = mark(edges)
    while now[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = runtime.written(large, "stars")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = runtime.written(small, "stars")
        before, now = now, mark(edges)
        if now == before:
            break
    return edges


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", *, shingle: int = SHINGLE, radius: int = RADIUS, most: int = BUCKET) -> DataFrame:
    """One row for each row: doc_id, locator, fingerprint (16 hex digits), component_id (smallest identifier reachable), cluster.

    A null or empty text has fingerprint zero and is linked like any other; texts of fewer words than a shingle are
    hashed whole. Whole texts are read, however long. Repeated rows and ties fall into one component. A null identifier
    is the smallest (null) only where a component has no other. Other columns are not read; an empty table gives no rows.
    """
    runtime.prepare(docs.sparkSession)
    located = rows.with_locator(rows.settled(docs).select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), "locator")

    def make():
        return lambda batch: [pa.array([signed(fingerprint(x, shingle)) for x in rows.raw(batch.column("text"))], pa.int64())]

    prints = runtime.written(rows.appended(located, [T.StructField("fp", T.LongType())], make, keep=["doc_id", "locator"]), "simhash-prints")
    classes = runtime.written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-classes")
    labels = connected(links(classes, radius, most)).withColumnRenamed("node", "fp")
    joined = classes.join(labels, "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    joined = runtime.written(joined, "simhash-labels")
    smallest = joined.groupBy("label").agg(F.min("least").alias("component_id"))
    answer = joined.join(smallest, "label").select("fp", "component_id", "label")
    digits = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    return prints.join(answer, "fp").select("doc_id", "locator", digits("fp").alias("fingerprint"), "component_id", digits("label").alias("cluster"))


#: Rows, and bytes of text, of a family that are compared at once with as many others.
BLOCK_ROWS, BLOCK_BYTES = 2000, 16 << 20


def family_links(members: DataFrame, radius: int, words: int, least: float, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Links (a, b) between rows (row, fps, text) of one family whose fingerprints and texts are near enough.

    All such pairs are compared, but those that others link already; no pair is made a row but links, of which a task
    gives fewer than it has rows. A large family is dealt into blocks, and each two blocks are a task of bounded size.
    """
    size = members.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text").cast("long")).alias("bytes"))
    blocks = F.ceil(F.greatest(F.col("n") / F.lit(block_rows), F.coalesce("bytes", F.lit(0)) / F.lit(block_bytes))).cast("int")
    sized = members.join(size.select("family", blocks.alias("blocks")), "family").withColumn("block", F.pmod(F.xxhash64("row"), "blocks").cast("int"))
    paired = sized.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    paired = paired.select("family", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "row", "fps", "text")

    def run(batches):
        at, held = None, []
        for batch in batches:
            own = zip(*(batch.column(c).to_pylist() for c in ("family", "p", "q", "block", "row", "fps")), rows.raw(batch.column("text")), strict=True)
            out: list[tuple[int, int]] = []
            for family, p, q, *row in own:
                if (family, p, q) != at:
                    out += _linked(held, at, radius, words, least)
                    at, held = (family, p, q), []
                held.append((*row[:3], hashed_shingles(row[3], words)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])
        if out := _linked(held, at, radius, words, least):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])
        del held
        rows.release()

    return paired.repartition("family", "p", "q").sortWithinPartitions("family", "p", "q").mapInArrow(run, "a long, b long")


def _linked(held: list[tuple], at: tuple | None, radius: int, words: int, least: float) -> list[tuple[int, int]]:
    """A forest of the links between rows (block, row, fingerprints, shingles) of two blocks, or within one."""
    if len(held) < 2:
        return []
    one = at[1] == at[2]
    block, row = np.array([h[0] for h in held]), [h[1] for h in held]
    fps = np.array([h[2] for h in held], np.int64).view(np.uint64)
    root, out = list(range(len(held))), []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for i in range(1, len(held)):
        apart = np.bitwise_count(fps[:i] ^ fps[i]).min(1)
        close = np.flatnonzero((apart <= radius) if one else (apart <= radius) & (block[:i] != block[i]))
        for j in close[np.argsort(apart[close], kind="stable")].tolist():
            x, y = find(i), find(j)
            if x != y and alike(held[i][3], held[j][3], least):
                root[x] = y
                out.append((min(row[i], row[j]), max(row[i], row[j])))
    return out


def hashed_shingles(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of so many lower-cased words; of a shorter text of the whole."""
    return np.unique(_hashes(text, words)) if text.split() else np.zeros(1, np.uint64)


def alike(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether the Jaccard similarity of two sorted sets is `least` or more."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) < least * len(b):
        return False
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return both >= least * (len(a) + len(b) - both)


def similar_groups(docs: DataFrame, text: str = "text", key: str = "doc_id", *, shingle: int, radius: int, prints: int = 1, words: int = 5, least: float = 0.8, most: int = BUCKET, dense: int = DENSE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows that are in a group of near copies: doc_id, locator, group.

    A text has `prints` fingerprints, by as many hashes. Two rows are linked if some k-th fingerprints of theirs are
    within the radius and their shingles of `words` words are similar enough. Where few fingerprints are near each other,
    each such pair of rows is compared. Where many are, and where several rows share a fingerprint, the rows are one
    family, in which all pairs are compared block by block (family_links). So no link is missed, and pairs are rows only
    where they are few. Edge cases are those of near_duplicates.
    """
    runtime.prepare(docs.sparkSession)
    located = rows.with_locator(rows.settled(docs).select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), "locator")

    def make():
        return lambda batch: [pa.array([[signed(x) for x in fingerprints(t, shingle, prints)] for t in rows.raw(batch.column("text"))], pa.list_(pa.int64()))]

    printed = rows.appended(located, [T.StructField("fps", T.ArrayType(T.LongType()))], make, keep=["doc_id", "locator"])
    known = runtime.written(printed.withColumn("row", F.monotonically_increasing_id()), "simhash-prints")
    of = known.select("row", F.posexplode("fps").alias("k", "fp"))
    classes = runtime.written(of.groupBy("k", "fp").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n")), "simhash-classes")

    place = lambda c: classes.select("k", F.col("fp").alias(c), F.col("first").alias(f"row_{c}"), F.col("n").alias(f"n_{c}"))
    found = candidates(classes, radius, most, dense).join(place("a"), ["k", "a"]).join(place("b"), ["k", "b"])
    crowded = F.col("tree") | (F.col("n_a") > 1) | (F.col("n_b") > 1)
    pairs = found.select(F.least("row_a", "row_b").alias("a"), F.greatest("row_a", "row_b").alias("b"), crowded.alias("crowded"))
    pairs = runtime.written(pairs.where("a != b").groupBy("a", "b").agg(F.max("crowded").alias("crowded")), "simhash-pairs")
    within = of.join(classes.where("n > 1"), ["k", "fp"]).where(F.col("first") != F.col("row")).select(F.col("first").alias("a"), F.col("row").alias("b"))
    families = runtime.written(connected(pairs.where("crowded").select("a", "b").unionByName(within).distinct()), "simhash-families")

    def bodies(wanted: DataFrame) -> DataFrame:
        """Text of rows (row and more columns)."""
        wanted = runtime.written(known.select("row", "locator", "fps").join(wanted, "row"), "simhash-wanted")
        return located.select(F.col("locator").alias("at"), "text").join(runtime.if_small(wanted), F.col("at") == F.col("locator")).drop("at", "locator")

    alone = pairs.where("not crowded").select("a", "b")
    for c in ("a", "b"):  # pairs of one family are compared there
        alone = alone.join(families.select(F.col("node").alias(c), F.col("label").alias(f"family_{c}")), c, "left")
    alone = runtime.written(alone.where("family_a is null or family_b is null or family_a != family_b").select("a", "b"), "simhash-alone")
    texts = runtime.written(bodies(alone.select(F.explode(F.array("a", "b")).alias("row")).distinct()).select("row", "text"), "simhash-bodies")
    members = runtime.written(bodies(families.select(F.col("node").alias("row"), F.col("label").alias("family"))), "simhash-members")
    links_ = similar(alone, texts, words, least).unionByName(family_links(members, radius, words, least, block_rows))
    labels = connected(links_.distinct())
    return known.join(labels.select(F.col("node").alias("row"), F.col("label").alias("group")), "row").select("doc_id", "locator", "group")


def kept_rows(docs: DataFrame, text: str = "text", key: str = "doc_id", **how) -> DataFrame:
    """One row of each group of near copies, with all its columns, and every row that is in none.

    The row of the smallest identifier stays (null last), of repeated ones the first place.
    """
    docs = rows.settled(docs)
    with runtime.scratch(docs.sparkSession):
        found = runtime.written(similar_groups(docs, text, key, **how), "simhash-found")
        first = found.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "locator")).alias("s"))
        dropped = found.join(first.select(F.col("s.locator").alias("locator")), "locator", "left_anti").select("locator")
        dropped = runtime.written(dropped, "simhash-dropped", keep=True)
    return rows.without(docs, dropped)
