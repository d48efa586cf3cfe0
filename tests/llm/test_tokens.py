import hashlib
import json
import random

import pyarrow as pa
import pytest

from textshield.llm import bpe, memo, rows

tokenizers = pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")

ODD = ["", None, " ", "\n\t ", "it's DON'T they'll", "<|endoftext|>a<|startoftext|> b", "<|ENDOFTEXT|>", "éèçñßüÄÖ İı ſ K Σς", "日本語 кириллица ٣½²", "a\x1cb\x85c\xa0d\x00e", "😀👍🏽 z‍w", "aaaaaaaaaaaaaaaaaaaaaaaaaa" * 40, "!!!!!!!!!!????....", "é é"]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(bpe.default_path())


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.read_spec(bpe.default_path()))


def ids(library, text):
    return b"".join(i.to_bytes(4, "little") for i in library.encode(text or "", add_special_tokens=False).ids)


def encoded(codec, texts):
    found, ends = codec.encode(pa.array(texts, pa.string()))
    return [found[a:b].astype("<u4").tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]


def test_automaton_equals_the_library(library, codec):
    r = random.Random(7)
    vocabulary = [k.replace("</w>", "") for k in library.get_vocab()]
    words = ["".join(r.choice(vocabulary) for _ in range(r.randint(1, 4))) if r.random() < 0.5 else "".join(r.choice("abcdeiorstnh'") for _ in range(r.randint(1, 20))) for _ in range(4000)]
    words += ["ab" * 300, "the" * 500 + "é"]
    for word, found in zip(words, encoded(codec, words), strict=True):
        assert found == ids(library, word), word


def test_texts_of_all_kinds_of_chunks(library, codec):
    r = random.Random(3)
    kinds = [*"abcXYZ .,'!?0189\t\n\x0b\x0c\r\x1c\x85\xa0\xad\u200bñßéÿªµº²³¹¼×÷İıſσς日́", "<|endoftext|>", "<|", "'ll", "'re", "don't"]
    texts = ["".join(r.choice(kinds) for _ in range(r.randint(0, 60))) for _ in range(1500)]
    for text, found in zip(texts, encoded(codec, texts), strict=True):
        assert found == ids(library, text), repr(text)


def test_strings_kept_stay_right_when_others_are_let_go(library, monkeypatch):
    monkeypatch.setattr(memo, "KEPT", 40)
    monkeypatch.setattr(rows, "SLICE", 300)
    codec = bpe.Codec(bpe.read_spec(bpe.default_path()))
    r = random.Random(5)
    texts = [" ".join(r.choice(["The", "of", "é", "日本", "it's", "q%d" % r.randint(0, 300)]) for _ in range(r.randint(0, 80))) for _ in range(200)]
    assert encoded(codec, texts) == [ids(library, x) for x in texts]
    assert len(codec.chunks.known) < 200


def test_other_files_go_the_librarys_way(library):
    d = json.loads(bpe.read_spec(bpe.default_path()))
    d["normalizer"] = {"type": "NFC"}
    d["decoder"] = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
    other, spec = tokenizers.Tokenizer.from_str(json.dumps(d)), json.dumps(d)
    codec = bpe.Codec(spec)
    assert codec.chunks is None
    for text in ["Some TEXT<|endoftext|>it's", "a  b\n\nc", "ÉÈ"]:
        found, ends = codec.encode(pa.array([text]))
        assert found.tolist() == other.encode(text, add_special_tokens=False).ids
        assert bytes(codec.decode(found, ends)[0]).decode() == other.decode(found.tolist(), skip_special_tokens=False)
    d["model"]["byte_fallback"] = True
    with pytest.raises(ValueError, match="plain"):
        bpe.Codec(json.dumps(d))


def test_table_against_gadgets_one_by_one():
    """The automaton built state by state and arc by arc, with every arc kept."""
    r = random.Random(11)
    for _ in range(60):
        letters = "abc"[: r.randint(1, 3)]
        vocab, merges = {c: i for i, c in enumerate(letters)}, []
        while len(merges) < 12:
            a, b = r.choice(list(vocab)), r.choice(list(vocab))
            if a + b not in vocab:
                merges.append((a, b))
                vocab[a + b] = len(vocab)
        arcs = {s: set(letters) for s in letters}
        for u, v in merges:
            if v not in arcs.get(u, ()):
                continue
            copy = set(arcs[v])
            arcs[u].discard(v)
            for s in arcs:
                if u in arcs[s]:
                    arcs[s].add(u + v)
            arcs[u + v] = copy | ({u + v} if u in copy else set())
        a = bpe.Automaton(vocab, merges)
        assert set(a.spelled.values()) == set(arcs)
        for s in arcs:
            assert {t for t in arcs if a.follows(vocab[s], vocab[t])} == arcs[s], (merges, s)


def test_small_automaton_by_hand():
    a = bpe.Automaton({"a": 0, "b": 1, "aa": 2, "ab": 3}, [("a", "a"), ("a", "b")])
    spell = lambda w: [a.spelled[t] for t in a.encode(w)]
    assert spell("aaaaa") == ["aa", "aa", "a"]
    assert spell("aab") == ["aa", "b"]
    assert spell("aaab") == ["aa", "ab"]
    assert not a.follows(0, 0) and not a.follows(0, 1) and a.follows(2, 2)


def test_merge_that_never_applies_is_no_arc():
    a = bpe.Automaton({"a": 0, "b": 1, "c": 2, "ab": 3, "bc": 4, "abc": 5}, [("a", "b"), ("b", "c"), ("a", "bc")])
    assert [a.spelled[t] for t in a.encode("abc")] == ["ab", "c"]
    assert 5 not in a.spelled


def test_digests(documents, library):
    texts = [*ODD, ODD[4], "the the " * 5000]
    found = {r.doc_id: r for r in bpe.digests(documents([(i, t, None) for i, t in enumerate(texts)])).collect()}
    assert len(found) == len(texts)
    for i, t in enumerate(texts):
        want = ids(library, t)
        back = library.decode([int.from_bytes(want[k : k + 4], "little") for k in range(0, len(want), 4)], skip_special_tokens=False)
        assert (found[i].n_tokens, found[i].ids_sha256, found[i].decoded_sha256) == (len(want) // 4, hashlib.sha256(want).hexdigest(), hashlib.sha256(back.encode()).hexdigest())


def test_encode_and_decode_keep_other_columns(documents):
    coded = bpe.decode(bpe.encode(documents([(1, "Some Text", "en"), (2, None, None)]), ids="kept"), ids="kept")
    assert coded.columns == ["doc_id", "text", "lang", "shard", "kept", "decoded"]
    assert {r.doc_id: r.decoded for r in coded.collect()} == {1: "some</w> text</w>", 2: ""}


def test_empty_table(documents):
    assert bpe.digests(documents([])).collect() == []
