"""The queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from textshield import runtime
from textshield.llm import bpe, chat, exact, langid, packing, quality, shards, simhash, urls, warc


def spread(spark, sf_dir: str, table: str):
    """A table, dealt out over the cores where it is a few small files; not for what keeps the places of rows in files."""
    return runtime.spread(runtime.load(spark, sf_dir, table))


def op1_chat_formatting(spark, sf_dir):
    return chat.query(runtime.load(spark, sf_dir, "conversations"))


def op2_quality_rules(spark, sf_dir):
    return quality.query(spread(spark, sf_dir, "documents"))


def op3_sharding(spark, sf_dir):
    return shards.query(spread(spark, sf_dir, "documents"))


def op4_simhash_near_dedup(spark, sf_dir):
    return simhash.near_duplicates(runtime.load(spark, sf_dir, "documents")).drop("locator")


def op5_language_id(spark, sf_dir):
    return langid.held_out_query(spread(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark, sf_dir):
    return packing.pack(spread(spark, sf_dir, "documents"))


def op7_exact_dedup(spark, sf_dir):
    return exact.deduplicate(runtime.load(spark, sf_dir, "documents")).drop("locator")


def op8_warc_archive(spark, sf_dir):
    return warc.query(runtime.load(spark, sf_dir, "pages"))


def op9_url_filters(spark, sf_dir):
    return urls.judge(spread(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("url", "html")


def op10_bpe_tokenization_automaton(spark, sf_dir):
    return bpe.digests(spread(spark, sf_dir, "documents"))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_formatting": chat.ORACLE, "op7_exact_dedup": exact.ORACLE, "op8_warc_archive": warc.ORACLE}
