"""Spotlighting: content is marked as data, between boundary lines that carry a secret number."""

from __future__ import annotations

import secrets
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Default tag and mark.
TAG, MARKER = "untrusted_content", "▁"

NONCE_BYTES = 9


def _secret(n_bytes: int):
    @F.pandas_udf(T.StringType())
    def hexes(seed: pd.Series) -> pd.Series:
        return seed.map(lambda _: secrets.token_hex(n_bytes))

    return hexes.asNondeterministic()


def random_hex(n_bytes: int = NONCE_BYTES) -> Column:
    """Cryptographically random hex digits, new for each row. Write the rows before reading them twice."""
    return _secret(n_bytes)(F.lit(0))


def derived_hex(seed: str, key: Column, n_bytes: int = NONCE_BYTES) -> Column:
    """Hex digits that only the holder of the seed can foretell, the same on every evaluation; a null key counts as empty."""
    return F.substring(F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 2 * n_bytes)


def delimit(text: Column, nonce: Column, tag: str = TAG) -> Column:
    return F.concat(F.lit(f'<{tag} data-nonce="'), nonce, F.lit('">\n'), text, F.lit(f'\n</{tag} data-nonce="'), nonce, F.lit('">'))


def datamark(text: Column, marker: str = MARKER) -> Column:
    return F.replace(text, F.lit(" "), F.lit(marker))


def encode_base64(text: Column) -> Column:
    """Standard base64 of the UTF-8 bytes, in one line."""
    return F.regexp_replace(F.base64(F.encode(text, "UTF-8")), "[\r\n]", "")


def spotlight(df: DataFrame, text: Column, nonce: Column, into: str = "spotlight", *, methods: Sequence[str] = ("delimit",), marker: str = MARKER, tag: str = TAG) -> DataFrame:
    """Add a struct of content, nonce, methods, marker and base64_encoded.

    Base64 wins over marks, and the boundary is always there. The nonce is made a column first: it is read three times.
    """
    coded, marked = "base64" in methods, "datamark" in methods and "base64" not in methods
    inner = encode_base64(text) if coded else datamark(text, marker) if marked else text
    applied = (["base64"] if coded else ["datamark"] if marked else []) + ["delimit"]
    df = df.withColumn("__nonce", nonce)
    result = F.struct(
        delimit(inner, F.col("__nonce"), tag).alias("content"),
        F.col("__nonce").alias("nonce"),
        F.array(*map(F.lit, applied)).alias("methods"),
        F.lit(marker if marked else None).cast("string").alias("marker"),
        F.lit(coded).alias("base64_encoded"),
    )
    return df.withColumn(into, result).drop("__nonce")
