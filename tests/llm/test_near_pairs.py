import random

import numpy as np
import pytest
from pyspark.sql import Row

from textshield.llm import simhash

WORDS = [a + b + c for a in "bdfgk" for b in "aeiou" for c in "lmnrs"]


def text(segments):
    """Segments between one word: any order of them has the same two-word shingles, so the same fingerprint."""
    return "zz " + " zz ".join(segments) + " zz"


def bits(a, b):
    return (simhash.fingerprint(a.encode(), 2) ^ simhash.fingerprint(b.encode(), 2)).bit_count()


def alike(a, b):
    x, y = simhash.shingles(a.encode(), 5), simhash.shingles(b.encode(), 5)
    return len(x & y) >= 0.8 * len(x | y)


def between():
    """Two near copies, and a text of other shingles whose fingerprint lies between theirs."""
    r = random.Random(3)
    while True:
        a = [" ".join(r.sample(WORDS, 2)) for _ in range(40)]
        b, c = list(a), list(a)
        for i in range(2):
            b[i] = " ".join(r.sample(WORDS, 2))
        c[0] = b[0]
        r.shuffle(c)
        a, b, c = map(text, (a, b, c))
        if max(bits(a, c), bits(b, c)) < bits(a, b) <= 7 and alike(a, b) and not alike(a, c) and not alike(b, c):
            return [c, a, b]


def one_class():
    """Rows of one fingerprint, of which only the later two are alike."""
    r = random.Random(4)
    a = [" ".join(r.sample(WORDS, 2)) for _ in range(40)]
    first = text(a)
    r.shuffle(a)
    second = text(a)
    a[3], a[4] = a[4], a[3]
    return [first, second, text(a)]


def near(a, b, radius, prints):
    pairs = zip(simhash.fingerprints(a.encode(), 2, prints), simhash.fingerprints(b.encode(), 2, prints), strict=True)
    return any((x ^ y).bit_count() <= radius for x, y in pairs)


def groups(texts, radius=7, prints=1):
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if near(texts[i], texts[j], radius, prints) and alike(texts[i], texts[j]):
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    return {frozenset(i for i, x in enumerate(label) if x == y) for y in label if label.count(y) > 1}


def found(spark, texts, radius=7, **how):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    out = {}
    for r in simhash.similar_groups(df, shingle=2, radius=radius, **how).collect():
        out.setdefault(r.group, set()).add(r.doc_id)
    return set(map(frozenset, out.values()))


def test_a_text_between_two_copies_hides_none(spark):
    texts = between()
    assert groups(texts) == {frozenset({1, 2})} == found(spark, texts)


def test_a_first_row_unlike_the_others_hides_none(spark):
    texts = one_class()
    assert len({simhash.fingerprint(t.encode(), 2) for t in texts}) == 1
    assert groups(texts) == {frozenset({1, 2})} == found(spark, texts)


@pytest.mark.parametrize("how", [{"dense": 0}, {"most": 8}, {"most": 8, "dense": 0}, {"radius": 4, "prints": 3}, {"radius": 4, "prints": 3, "most": 4, "dense": 0}, {"dense": 0, "block_rows": 3}])
def test_crowded_buckets_against_all_pairs(spark, how):
    r = random.Random(5)
    texts = between() + one_class()
    for _ in range(6):
        a = [" ".join(r.sample(WORDS, 2)) for _ in range(40)]
        for _ in range(6):
            if r.random() < 0.5:
                r.shuffle(a)
            b = list(a)
            b[r.randrange(40)] = " ".join(r.sample(WORDS, 2))
            texts += [text(a), text(b)]
    texts = sorted(set(texts), key=texts.index)
    want = groups(texts, how.get("radius", 7), how.get("prints", 1))
    assert len(want) > 8 and found(spark, texts, **how) == want


@pytest.mark.parametrize("block_rows", [4, 2000])
def test_a_large_family_of_which_few_are_copies(spark, block_rows):
    """Copies of one text with more and more changes: near fingerprints, and links between some only."""
    r = random.Random(8)
    base = r.choices(WORDS, k=120)
    texts = []
    for _ in range(60):
        w = list(base)
        for i in r.sample(range(120), r.randint(0, 12)):
            w[i] = r.choice(WORDS)
        texts.append(" ".join(w))
    texts = sorted(set(texts), key=texts.index) + ["short text", "short Text", "", " "]
    want = groups(texts, 5, 4)
    assert len(want) > 1 and 5 < max(map(len, want)) < len(texts) - 10
    assert found(spark, texts, radius=5, prints=4, block_rows=block_rows) == want


def test_hashed_similarity_is_that_of_the_shingles():
    r = random.Random(1)
    for _ in range(300):
        a = r.choices(WORDS[:30], k=r.randint(0, 40))
        b = list(a)
        for i in r.sample(range(len(b)), min(len(b), r.randint(0, 2))):
            b[i] = r.choice(WORDS)
        a, b = (" ".join(x).encode() for x in (a, b))
        assert simhash.alike(simhash.hashed_shingles(a, 5), simhash.hashed_shingles(b, 5), 0.8) == alike(a.decode(), b.decode())


@pytest.mark.parametrize("radius", range(1, 9))
def test_masks_are_about_half_of_the_bits(radius):
    masks = simhash.covering_masks(list(range(64)), radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    assert min(m.bit_count() for m in masks) >= 16 and max(m.bit_count() for m in masks) <= 48
    if radius < 8:
        again = [simhash.covering_masks([b for b in range(64) if not m >> b & 1], radius) for m in masks]
        assert min(m.bit_count() for few in again for m in few) >= (4 if radius < 7 else 2)


@pytest.mark.parametrize("radius", range(1, 9))
def test_masks_cover_every_difference_of_that_many_bits(radius):
    r = random.Random(radius)
    for bits_ in (list(range(64)), r.sample(range(64), 32)):
        masks = simhash.covering_masks(bits_, radius)
        for _ in range(300):
            apart = sum(1 << b for b in r.sample(bits_, radius))
            assert any(not m & apart for m in masks)


def parts(pairs):
    """Sets of connected (k, fingerprint)."""
    label = {}
    for p in pairs:
        a, b = (label.setdefault((p.k, x), {(p.k, x)}) for x in (p.a, p.b))
        if a is not b:
            a |= b
            label.update((x, a) for x in b)
    return {frozenset(x) for x in label.values()}


def test_fingerprints_of_one_text_are_of_unlike_hashes():
    r = random.Random(2)
    made = np.array([simhash.fingerprints(" ".join(r.choices(WORDS, k=200)).encode(), 2, 4) for _ in range(300)], np.uint64)
    assert made[5, 0] == simhash.fingerprint(b"") or len(set(made[5])) == 4
    for k in range(1, 4):
        differ = np.bitwise_count(made[:, 0] ^ made[:, k])
        assert 30 < differ.mean() < 34
    assert simhash.fingerprints(b" ", 2, 3) == [0, 0, 0]


@pytest.mark.parametrize("most", [16, 16384])
def test_candidates_are_all_pairs_within_the_radius(spark, most):
    r = random.Random(6)
    prints = {r.getrandbits(64) for _ in range(30)}
    for p in list(prints):
        prints |= {p ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 7))) for _ in range(8)}
    prints = sorted(map(simhash.signed, prints))
    other = prints[::3] + [p ^ 1 for p in prints[::7]]
    df = spark.createDataFrame([(0, p) for p in prints] + [(2, p) for p in sorted(set(other))], "k int, fp long")
    got = {(x.k, x.a, x.b) for x in simhash.candidates(df, 7, most, dense=1000).collect()}
    near_ = lambda k, some: {(k, p, q) for i, p in enumerate(some) for q in some[i + 1 :] if ((p ^ q) & (1 << 64) - 1).bit_count() <= 7}
    assert got == near_(0, prints) | near_(2, sorted(set(other)))
    assert not list(simhash.near(np.array(prints[:1]), 7))
    pairs = simhash.candidates(df, 7, most, dense=0).collect()
    assert all(x.tree for x in pairs) and {(x.k, x.a, x.b) for x in pairs} < got
    assert parts(pairs) == parts([Row(k=k, a=a, b=b) for k, a, b in got])
