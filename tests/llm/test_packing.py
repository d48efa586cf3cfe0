import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pytest

from textshield.llm import packing, shards

pytest.importorskip("public_tokenizers")


def optimum(items, capacity):
    """Fewest bins, by trying all."""
    best = len(items)

    def go(rest, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if not rest:
            best = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + rest[0] <= capacity and bins[i] not in bins[:i]:
                go(rest[1:], bins[:i] + [bins[i] + rest[0]] + bins[i + 1 :])
        go(rest[1:], bins + [rest[0]])

    go(sorted(items, reverse=True), [])
    return best


def test_reduction_never_costs_a_sequence():
    r = random.Random(4)
    for _ in range(250):
        capacity = r.choice([10, 17, 30])
        items = [r.randint(1, capacity) for _ in range(r.randint(1, 9))]
        plan = packing.Plan({}, capacity)
        counts = {}
        for x in items:
            counts[x] = counts.get(x, 0) + 1
        plan.left = [counts.get(i, 0) for i in range(capacity + 1)]
        plan.reduce()
        rest = [x for x in range(capacity + 1) for _ in range(plan.left[x])]
        assert plan.sequences + optimum(rest, capacity) == optimum(items, capacity), items


def test_best_fit_against_one_by_one():
    r = random.Random(8)
    for _ in range(100):
        capacity = 50
        items = sorted((r.randint(1, capacity) for _ in range(r.randint(1, 120))), reverse=True)
        rooms = []
        for x in items:
            fits = [i for i in range(len(rooms)) if rooms[i] >= x]
            if fits:
                rooms[min(fits, key=lambda i: rooms[i])] -= x
            else:
                rooms.append(capacity - x)
        plan = packing.Plan.__new__(packing.Plan)
        plan.capacity, plan.sequences, plan.runs, plan.taken = capacity, 0, [], [0] * (capacity + 1)
        plan.left = [items.count(i) for i in range(capacity + 1)]
        plan.best_fit()
        assert plan.sequences == len(rooms)


def test_pack(documents):
    from tokenizers import Tokenizer

    from textshield.llm import bpe

    library = Tokenizer.from_file(bpe.default_path())
    r = random.Random(1)
    texts = [" ".join(r.choice(["a", "of", "tion", "x1", "Ünder"]) for _ in range(r.choice([1, 5, 60, 200]))) for _ in range(60)] + [None, "", "<|endoftext|> 日本", "same", "same"]
    capacity = 100
    found = packing.pack(documents([(i, t, None) for i, t in enumerate(texts)]), capacity=capacity).collect()
    pieces = {(x.doc_id, x.piece): x for x in found}
    for i, t in enumerate(texts):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        for p, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            x = pieces.pop((i, p))
            assert (x.start, x.length, x.ids_crc32) == (at, len(part), zlib.crc32(b"".join(k.to_bytes(4, "little") for k in part)))
    assert not pieces
    by = lambda x: x.sequence_id
    for _, group in itertools.groupby(sorted(found, key=by), by):
        at = 0
        for x in sorted(group, key=lambda x: x.offset):
            assert x.offset == at
            at += x.length
        assert at <= capacity
    assert len({x.sequence_id for x in found}) <= 1.1 * sum(x.length for x in found) / capacity + 1


def test_pack_null_and_repeated_ids_and_a_text_over_many_pieces(documents):
    rows = [(None, "a b", None), (3, "c", None), (3, "c", None), (3, "d", None), (9, "word " * 9001, None), (10, " ".join("1" * 4095), None)]
    found = packing.pack(documents(rows)).collect()
    assert sorted((x.doc_id or -1, x.piece, x.start, x.length) for x in found) == [(-1, 0, 0, 3), (3, 0, 0, 2), (3, 0, 0, 2), (3, 0, 0, 2), (9, 0, 0, 4096), (9, 1, 4096, 4096), (9, 2, 8192, 810), (10, 0, 0, 4096)]
    places = {}
    for x in found:
        places.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for p in places.values():
        assert [a for a, _ in sorted(p)] == list(itertools.accumulate([0, *(n for _, n in sorted(p))]))[:-1]


def test_pack_empty_table(documents):
    assert packing.pack(documents([])).collect() == []


def test_shards(documents):
    r = random.Random(2)
    texts = ["".join(r.choice("ab c") for _ in range(r.randint(0, 400))) for _ in range(600)] + [None, ""] + ["copy " * 5] * 40
    found = shards.query(documents([(i, t, None) for i, t in enumerate(texts)])).collect()
    assert sorted(x.doc_id for x in found) == list(range(len(texts)))
    places, sizes, groups = {}, [0] * 8, {}
    for x in found:
        t = texts[x.doc_id] or ""
        assert (x.size, x.text_crc32, x.law, x.grown_shard) == (len(t.encode()) + 1, zlib.crc32(t.encode()), "bytes", None)
        places.setdefault(x.shard, []).append(x.slot)
        sizes[x.shard] += x.size
        groups.setdefault(t, set()).add(x.shard)
    assert all(sorted(v) == list(range(len(v))) for v in places.values())
    assert max(sizes) <= 1.02 * min(sizes)
    assert all(len(g) == 1 for g in groups.values())


def test_group_larger_than_a_shard_is_dealt_out(documents):
    texts = ["hot text"] * 400 + [f"text number {i}" for i in range(400)]
    found = shards.shard(documents([(i, t, None) for i, t in enumerate(texts)])).collect()
    sizes = [sum(x.size for x in found if x.shard == s) for s in range(8)]
    assert max(sizes) <= 1.1 * min(sizes)
    assert len({x.shard for x in found if x.doc_id < 400}) < 8


def test_an_item_goes_where_the_dot_product_is_highest():
    r = shards.Residual(np.array([[0.5, 0.9, 0.1], [0.6, 0.2, 0.2], [0.05, 1.0, 1.0]]))
    assert r.put(np.array([0.1, 0.4, 0.0])) == 0  # 0.41 beats 0.14; the third has no room in bytes
    assert np.allclose(r.left[0], [0.4, 0.5, 0.1])
    assert r.put(np.array([0.1, 0.0, 0.5])) == 1
    assert r.put(np.array([0.9, 0.1, 0.1])) == 1  # no room anywhere: the one with most bytes left


def by_hand(items, total, left, tie=lambda v: 0):
    """Every item, largest first (then by tie, then by digest), against the shards one by one."""
    left, out = [list(x) for x in left], {}
    parts = {k: [8 * a / t for a, t in zip(v, total, strict=True)] for k, v in items.items()}
    for k in sorted(parts, key=lambda k: (-max(parts[k]), tie(parts[k]), k)):
        v = parts[k]
        fit = [s for s in range(8) if left[s][0] >= v[0]]
        best = max(fit, key=lambda s: (round(sum(a * b for a, b in zip(left[s], v, strict=True)), 12), -s)) if fit else max(range(8), key=lambda s: (left[s][0], -s))
        left[best] = [a - b for a, b in zip(left[best], v, strict=True)]
        out[k] = best
    return out, left


def test_every_group_is_placed_by_the_rule(documents, monkeypatch):
    """With one cell the result is that of placing all groups one by one: the large first, then the others."""
    r = random.Random(6)
    texts = [" ".join(["w" * r.randint(1, 12)] * r.randint(1, 40)) + str(i) for i in range(150)]
    texts += [t for t in texts[:20] for _ in range(r.randint(1, 6))] + ["big " * 4000, "big too " * 3000]
    groups = {}
    for t in texts:
        d = hashlib.sha256(t.encode()).digest()[:16]
        x = groups.setdefault(d, [0, 0, 0])
        for i, a in enumerate((len(t.encode()) + 1, len(t.split()), 1)):
            x[i] += a
    total = [sum(v[i] for v in groups.values()) for i in range(3)]
    large = {k: v for k, v in groups.items() if any(a > t / 100 for a, t in zip(v, total, strict=True))}
    assert 0 < len(large) < len(groups)
    parts = {}
    for k, v in large.items():
        n = min(v[2], max(1, math.ceil(max(a / t for a, t in zip(v, total, strict=True)) * 8 - 1e-9)))
        assert n == 1
        parts[k] = v
    first, left = by_hand(parts, total, [[1.0] * 3] * 8, lambda v: -sum(v))
    rest, _ = by_hand({k: v for k, v in groups.items() if k not in large}, total, left)
    want = first | rest
    found = shards.shard(documents([(i, t, None) for i, t in enumerate(texts)]), large=1 / 100).collect()
    wrong = [x for x in found if want[hashlib.sha256(texts[x.doc_id].encode()).digest()[:16]] != x.shard]
    assert not wrong


def test_bytes_tokens_and_rows_are_balanced_over_many_cells(documents):
    r = random.Random(9)
    texts = [" ".join("x" * r.choice([1, 2, 30]) for _ in range(r.choice([1, 10, 100]))) + f" {i}" for i in range(3000)]
    found = shards.shard(documents([(i, t, None) for i, t in enumerate(texts)]), cell_groups=300).collect()
    assert sorted(x.doc_id for x in found) == list(range(3000))
    for of, slack in ((lambda x: x.size, 1.01), (lambda x: len(texts[x.doc_id].split()), 1.25), (lambda x: 1, 1.25)):
        amounts = [sum(of(x) for x in found if x.shard == s) for s in range(8)]
        assert max(amounts) <= slack * min(amounts), amounts


def test_shards_of_repeated_rows_null_ids_and_a_very_long_text(documents):
    rows = [(5, "same", None)] * 3 + [(None, "same", None), (None, None, None), (7, "long " * 300_000, None)] + [(i, f"t{i}", None) for i in range(50)]
    found = shards.shard(documents(rows)).collect()
    assert sorted(str(x.doc_id) for x in found) == sorted(str(d) for d, *_ in rows)
    for s in range(8):
        assert sorted(x.slot for x in found if x.shard == s) == list(range(sum(x.shard == s for x in found)))


def test_shards_empty_table(documents):
    assert shards.query(documents([])).collect() == []
