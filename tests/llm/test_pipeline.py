import random

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline as P
from textshield import runtime
from textshield.llm import exact, langid, packing, quality, simhash

WORDS = {"en": "the of and to in is that it was for on are with as at be this have from or".split(), "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split()}
SYLLABLES = {"en": ["th", "er", "ing", "ow", "an"], "de": ["sch", "ung", "ä", "ei", "keit"]}


def corpus():
    r, out = random.Random(11), []
    for lang in ("en", "de"):
        for _ in range(50):
            out.append(([r.choice(WORDS[lang]) if r.random() < 0.4 else "".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 4))) for _ in range(120)], lang))
    rows = [(i, " ".join(w), lang) for i, (w, lang) in enumerate(out)]
    rows += [(200, rows[0][1].upper().lower(), "en"), (201, rows[0][1].capitalize(), "en"), (202, rows[60][1], "de")]  # copies
    near = list(out[5][0])
    near[40] = "otherword"
    rows += [(210, " ".join(near), "en"), (211, " ".join(out[5][0]) + " tail", "en")]
    rows += [(300, None, "en"), (301, "", "de"), (302, "12 34", None), (303, "spam " * 100, "en"), (304, "the few", "en")]
    return rows


def jaccard(a, b):
    x, y = simhash.shingles(a.encode(), P.WORDS), simhash.shingles(b.encode(), P.WORDS)
    return len(x & y) / len(x | y)


def test_stages_against_brute_force(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame([(i, t, lang, "src", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    docs = runtime.load(spark, str(tmp_path), "documents")
    names, kept = docs.columns, {i: t for i, t, _ in rows}

    def run(name, docs):
        out = dict(P.STAGES)[name](spark, docs, str(tmp_path))
        if name != P.STAGES[-1][0]:
            assert out.columns == names
            out.write.parquet(str(tmp_path / name))
            return spark.read.parquet(str(tmp_path / name))
        return out

    langs, protos = langid.fit(docs)
    docs1 = run("language_id", docs)
    ids = {r.doc_id for r in docs1.collect()}
    told = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, (langs, protos)).collect()}
    assert ids == {i for i, (lang, s) in told.items() if lang != "und" and s >= P.LEAST_COSINE} and set(range(100)) <= ids and not ids & {300, 301, 302}

    refs = quality.learn(docs1)
    docs2 = run("quality_rules", docs1)
    want = set()
    for i in ids:
        words, *_, again = quality.base(kept[i])
        if not quality.failed(len(words), again) and refs.compare(kept[i], words, quality.Limits())[3]:
            want.add(i)
    assert {r.doc_id for r in docs2.collect()} == want and set(range(100)) <= want and not want & {303, 304}

    docs3 = run("exact_dedup", docs2)
    groups = {}
    for i in want:
        groups.setdefault(exact.normalised(kept[i].encode()), []).append(i)
    once = {max(g) for g in groups.values()}
    assert {r.doc_id for r in docs3.collect()} == once and 201 in once and 0 not in once

    docs4 = run("simhash_near_dedup", docs3)
    left = {r.doc_id for r in docs4.collect()}
    near = {tuple(sorted((a, b))) for a in once for b in once if a < b and jaccard(kept[a], kept[b]) >= P.SIMILARITY}
    assert near == {(5, 210), (5, 211), (210, 211)}
    assert left == once - {210, 211}

    pieces = run("best_fit_packing", docs4).collect()
    assert {r.doc_id for r in pieces} == left and all(r.length <= packing.CAPACITY for r in pieces)
    again = {(r.doc_id, r.piece, r.length, r.ids_crc32) for r in P.run(spark, str(tmp_path)).collect()}
    assert again == {(r.doc_id, r.piece, r.length, r.ids_crc32) for r in pieces}


CLASHES = "kept score lang_pred n_words locator group digest row fp fps k bytes size family __language __dropped __of_label shard rank".split()


def test_columns_with_names_of_ours_and_repeated_rows(spark, tmp_path):
    rows = corpus()
    rows += [rows[7], rows[7], (None, rows[9][1], "en"), (None, rows[9][1] + " more", None)]
    schema = "doc_id long, text string, lang string, " + ", ".join(f"{c} string" for c in CLASHES)
    spark.createDataFrame([(*r, *(f"{c} {r[0]}" for c in CLASHES)) for r in rows], schema).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    docs = runtime.load(spark, str(tmp_path), "documents")
    names, counts = docs.columns, []
    for name, stage in P.STAGES[:-1]:
        kept = stage(spark, docs, str(tmp_path))
        assert kept.columns == names
        kept.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        found = docs.collect()
        assert all(r[c] == f"{c} {r.doc_id}" for r in found for c in CLASHES)
        counts.append((sum(r.doc_id == 7 for r in found), sum(r.doc_id is None for r in found), sum(r.doc_id == 9 for r in found)))
    assert counts == [(3, 2, 1), (3, 2, 1), (1, 1, 1), (1, 0, 1)]
    assert P.pack(spark, docs, str(tmp_path)).count() == len(found)


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert P.run(spark, str(tmp_path)).collect() == []


def test_stages_learn_from_every_text(spark, tmp_path, monkeypatch):
    from textshield.llm import rows as helpers

    monkeypatch.delattr(helpers, "labelled_sample")
    docs = spark.createDataFrame([(i, t, lang) for i, t, lang in corpus()], "doc_id long, text string, lang string")
    told = P.identify_language(spark, docs, str(tmp_path))
    assert {r.doc_id for r in told.collect()} >= set(range(100))
    assert {r.doc_id for r in P.keep_quality(spark, told, str(tmp_path)).collect()} >= set(range(100))
