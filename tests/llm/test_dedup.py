import random

import numpy as np
import pytest
import xxhash

from textshield.llm import exact, simhash

TEXTS = ["Same text", "same TEXT", "SAME TEXT", "other", "", None, "ÄB", "äb", " ", "x" * 50_000, "X" * 50_000, "other"]


def brute(texts):
    out = {}
    for i, t in enumerate(texts):
        group = [j for j, u in enumerate(texts) if exact.normalised((u or "").encode()) == exact.normalised((t or "").encode())]
        out[i] = (max(group), len(group), i == max(group))
    return out


@pytest.mark.parametrize("how", [{}, {"hits_sent": 0}, {"digest_bytes": 0}, {"digest_bytes": 0, "hits_sent": 0}, {"files_at_once": 1}])
def test_exact(documents, how):
    if how.get("digest_bytes") == 0:
        how = {**how, "digest_bytes": 1}
        texts = TEXTS + [f"text {i // 2}" for i in range(600)]  # more texts than digests
    else:
        texts = TEXTS
    found = exact.deduplicate(documents([(i, t, None) for i, t in enumerate(texts)]), **how).collect()
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in found} == brute(texts)
    assert len(found) == len(texts)


def test_exact_null_and_repeated_identifiers(documents):
    found = exact.deduplicate(documents([(1, "a", None), (1, "a", None), (None, "a", None), (None, "b", None)])).collect()
    a = [r for r in found if r.text_sha256 == found[0].text_sha256 or r.keep_id == 1]
    assert sorted(r.group_size for r in found) == [1, 3, 3, 3]
    assert sum(r.kept for r in found) == 2 and all(r.keep_id == 1 for r in a if r.group_size == 3)
    assert exact.kept_rows(documents([(1, "a", None), (1, "A", None), (2, "b", None)])).count() == 2


@pytest.mark.parametrize("digest_bytes", [32, 1])
def test_exact_state_meets_later_data(spark, documents, tmp_path, digest_bytes):
    """Groups are those of all calls with one folder, whether their rows come from files or not."""
    texts = TEXTS + [f"text {i % 130}" for i in range(390)]
    calls = [list(range(0, 150)), list(range(150, 300)), [], list(range(300, len(texts)))]
    seen = []
    for n, call in enumerate(calls):
        df = documents([(i, texts[i], None) for i in call])
        if n == 1:
            df.write.parquet(str(tmp_path / "in"))
            df = spark.read.parquet(str(tmp_path / "in"))
        seen += call
        found = exact.deduplicate(df, folder=str(tmp_path / "state"), digest_bytes=digest_bytes).collect()
        want = brute([texts[i] for i in seen])
        assert {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in found} == {i: want[i] for i in call}


def test_exact_empty_table(documents):
    assert exact.deduplicate(documents([])).collect() == []


def fingerprint(text, k=3):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    runs = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(x, 42) for x in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reach(prints, radius):
    """Smallest place reachable over links, by a search over all pairs."""
    n, out = len(prints), {}
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            x = todo.pop()
            new = [j for j in range(n) if j not in seen and (prints[x] ^ prints[j]).bit_count() <= radius]
            seen.update(new)
            todo += new
        out[i] = min(seen)
    return out


def corpus(n, seed=3):
    r = random.Random(seed)
    base = [" ".join(r.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) for _ in range(r.randint(1, 60))) for _ in range(n)]
    return base + [b + " " + r.choice(["x", "y"]) for b in base[: n // 2]] + [base[0], "", None, " \t", "one", "two words", "ONE"]


def test_simhash_against_all_pairs(documents):
    texts = corpus(60)
    prints = [fingerprint(t) for t in texts]
    want = reach(prints, 3)
    found = {r.doc_id: r for r in simhash.near_duplicates(documents([(i, t, None) for i, t in enumerate(texts)])).collect()}
    assert {i: r.fingerprint for i, r in found.items()} == {i: f"{p:016x}" for i, p in enumerate(prints)}
    assert {i: r.component_id for i, r in found.items()} == want


@pytest.mark.parametrize("radius", [1, 3, 4])
def test_masks_cover_every_pair_within_the_radius(radius):
    masks, r = simhash.covering_masks(list(range(64)), radius), random.Random(1)
    assert len(masks) == 2 ** (radius + 1) - 1
    for _ in range(3000):
        flips = sum(1 << b for b in r.sample(range(64), r.randint(0, radius)))
        assert any(not flips & m for m in masks)


@pytest.mark.parametrize("most", [2, 5, 4096])
def test_dense_buckets_are_dealt_again(spark, most):
    """Fingerprints around a few centres share buckets of any size."""
    r = random.Random(5)
    prints = {r.getrandbits(64) for _ in range(20)} | {0, (1 << 64) - 1}
    for c in list(prints)[:4]:
        prints |= {c ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 4))) for _ in range(60)}
    prints = sorted(prints)
    df = spark.createDataFrame([(simhash.signed(p),) for p in prints], "fp long")
    labels = {x.node & (1 << 64) - 1: x.label for x in simhash.connected(simhash.links(df, 3, most)).collect()}
    want = reach(prints, 3)
    groups = {}
    for i, p in enumerate(prints):
        groups.setdefault(want[i], set()).add(labels.get(p, simhash.signed(p)))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_trees_are_within_the_radius():
    r = random.Random(2)
    c = r.getrandbits(60)
    found = np.array(sorted({c ^ sum(1 << b for b in r.sample(range(60), r.randint(0, 5))) for _ in range(50)}), np.int64)
    tree, star = simhash.components(found, 3, star=False), simhash.components(found, 3)
    assert len(tree) == len(star) and all((a ^ b).bit_count() <= 3 for a, b in tree)


def test_long_chain_is_one_component(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(500, 501)], "a long, b long")
    assert {r.node: r.label for r in simhash.connected(df).collect()} == {i: 0 for i in range(101)} | {500: 500, 501: 500}


def test_simhash_empty_table_and_null_identifier(documents):
    assert simhash.near_duplicates(documents([])).collect() == []
    found = simhash.near_duplicates(documents([(None, "a", None), (4, "a", None), (None, "b c d e f", None)])).collect()
    assert sorted((str(r.component_id) for r in found)) == ["4", "4", "None"]


def test_kept_rows_drop_copies_and_nothing_else(documents):
    r = random.Random(9)
    words = [f"w{i}" for i in range(500)]
    base = [[r.choice(words) for _ in range(120)] for _ in range(12)]
    near = [b[:50] + ["changed"] + b[51:] for b in base[:5]]
    texts = [" ".join(x) for x in base + near]
    kept = simhash.kept_rows(documents([(i, t, "en") for i, t in enumerate(texts)]), shingle=2, radius=7, words=5, least=0.8)
    assert kept.columns == ["doc_id", "text", "lang", "kept", "shard"]
    assert sorted(x.doc_id for x in kept.collect()) == list(range(12))
