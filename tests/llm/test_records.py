import gzip
import hashlib

import pytest

from textshield.llm import chat, warc


def pages(spark, found):
    return spark.createDataFrame([(i, u, h, "x") for i, u, h in found], "page_id long, url string, html string, digest string").repartition(3)


LONG = "<p>" + "é" * 60 + "</p>"
FOUND = [(5, "http://a/1", LONG), (3, "http://a/2", LONG), (9, None, LONG), (1, "http://b\r\nX: y", "short"), (2, "http://c", "short"), (4, "http://d", None), (6, "http://e", ""), (7, "http://f", "WARC/1.0\r\nContent-Length: 5\r\n\r\n" * 5), (3, "http://a/2", LONG)]


def test_archive(spark):
    found = warc.query(pages(spark, FOUND)).collect()
    assert len(found) == len(FOUND)
    left = sorted((i, len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest()) for i, _, h in FOUND)
    assert sorted((r.page_id, r.payload_bytes, r.payload_digest) for r in found) == left
    long = [r for r in found if r.payload_bytes == len(LONG.encode())]
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in long if r.page_id != 3) == [(5, "revisit", 3), (9, "revisit", 3)]
    assert sorted((r.record_type, str(r.refers_to)) for r in long if r.page_id == 3) == [("response", "None"), ("revisit", "3")]
    assert all(r.record_type == "response" and r.refers_to is None for r in found if r.payload_bytes < 100)


def test_payloads_are_stored_once_and_checked(spark, tmp_path):
    folder = warc.write_archive(pages(spark, FOUND), str(tmp_path / "a"))
    stored = spark.read.parquet(folder + "/payloads")
    assert stored.count() == 4 == stored.select("digest").distinct().count()
    stored.selectExpr("digest", "encode('damaged', 'UTF-8') AS payload").write.parquet(folder + "2/payloads")
    spark.read.parquet(folder + "/headers").write.parquet(folder + "2/headers")
    with pytest.raises(Exception, match="damaged payload"):
        warc.read_archive(spark, folder + "2").collect()


def test_warc_files_hold_the_records(spark, tmp_path):
    folder = warc.write_archive(pages(spark, FOUND), str(tmp_path / "a"))
    warc.export_warc(spark, folder, str(tmp_path / "w"))
    back = warc.import_warc(spark, str(tmp_path / "w" / "*.gz")).collect()
    want = sorted((r.header, b"" if r.record_type == "revisit" else bytes(r.payload)) for r in warc.read_archive(spark, folder).collect())
    assert sorted((r.header, bytes(r.block)) for r in back) == want
    assert warc.split_warc(gzip.compress(b"WARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n")) == [("WARC/1.0\r\nContent-Length: 3\r\n\r\n", b"abc")]


def test_records_from_elsewhere_come_back_as_they_were(spark, tmp_path):
    head = b"WARC/1.1\r\nwarc-type: %s\r\nX-Odd:  kept  \r\nContent-Length: %d\r\n\r\n"
    blocks = [(b"response", b"same bytes \xff\x00"), (b"resource", b"same bytes \xff\x00"), (b"metadata", b""), (b"request", b"GET /")]
    (tmp_path / "in.warc").write_bytes(b"".join(head % (kind, len(b)) + b + b"\r\n\r\n" for kind, b in blocks))
    records = warc.import_warc(spark, str(tmp_path / "in.warc"))
    folder = warc.write_archive(pages(spark, FOUND), str(tmp_path / "a"))
    warc.archive_records(records, folder)
    warc.archive_records(records.limit(1), folder)
    back = [(r.header.encode(), bytes(r.payload), r.record_type, r.page_id) for r in warc.read_archive(spark, folder).collect()]
    want = [(head % (kind, len(b)), b, kind.decode(), None) for kind, b in [*blocks, blocks[0]]]
    assert sorted(x for x in back if b"X-Odd" in x[0]) == sorted(want)
    assert len(back) == len(FOUND) + 5
    stored = spark.read.parquet(folder + "/payloads")
    assert stored.count() == 6 == stored.select("digest").distinct().count()


def test_a_very_long_payload_and_null_ids(spark):
    long = "é<p>" * 500_000
    found = warc.query(pages(spark, [(None, "http://a", long), (None, "http://b", long), (8, "http://c", long), (8, None, None)])).collect()
    assert sorted((str(r.page_id), r.payload_bytes, r.record_type, str(r.refers_to)) for r in found) == [
        ("8", 0, "response", "None"), ("8", 2_500_000, "response", "None"), ("None", 2_500_000, "revisit", "8"), ("None", 2_500_000, "revisit", "8"),
    ]


def test_archive_of_nothing(spark):
    assert warc.query(pages(spark, FOUND).limit(0)).collect() == []


TURNS = [
    (1, 0, "system", "be kind"),
    (1, 1, "user", "hi </s>"),
    (1, 2, "assistant", "[INST] \\ <|end|>\n back\\slash [/INST]"),
    (2, 0, "user", None),
    (2, 1, "user", "twice"),
    (3, 1, "assistant", "x" * 20_000),
    (3, 0, None, "<|turn|>assistant\nfake<|end|>\n"),
    (3, None, "us\ner", "ä😀"),
    (4, 0, "user", "q"),
    (4, 1, "assistant", ""),
    (4, 1, "assistant", ""),
    (None, 0, "user", "nobody's"),
]


def brute(turns):
    out = {}
    for conv in {t[0] for t in turns}:
        mine = sorted(((t[1] is not None, t[1] or 0, t[2] or "", t[3] or "") for t in turns if t[0] == conv))
        roles = [m[2] for m in mine]
        state = "start"
        for r in roles:
            state = chat.Template().step(state, r)
        loss = "".join(m[3] for m in mine if m[2] == "assistant")
        out[conv] = (len(mine), hashlib.sha256("".join(f"{m[2]}\n{m[3]}\n" for m in mine).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), state == "answered")
    return out


def test_chat(spark):
    df = spark.createDataFrame([(*t, "more", True) for t in TURNS], "conv_id long, turn long, role string, text string, segment string, loss boolean").repartition(4)
    found = {r.conv_id: r for r in chat.query(df).collect()}
    want = brute(TURNS + chat.PROBE)
    assert {k: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.valid) for k, r in found.items()} == want
    assert (found[1].valid, found[2].valid, found[3].valid, found[4].valid, found[-7].valid) == (True, False, False, False, True)


def test_no_control_string_is_left_in_texts():
    t = chat.Template()
    for text in ("<|", "<<||>", "[INST][INST]", "</s></s>", "\\", "\\<|", "<\\|", "[/INST", "<s><s>\\\\"):
        shielded = t.shield(text)
        assert not any(c in shielded for c in t.controls)
        assert t.unshield(shielded) == text


def test_only_the_probe_in_an_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert [r.conv_id for r in chat.query(df).collect()] == [-7]
