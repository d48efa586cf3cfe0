"""Checks of the model's reply, each on the text that the one before has left.

The steps change the text that later ones read, so as columns their expressions double with each step; one Arrow UDF
runs them on each reply instead, and the findings are built from its few numbers by native expressions.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textshield.functions import columns as C
from textshield.operators.prompt import CANARY_PREFIX, FINGERPRINTS
from textshield.operators.sanitize import _ANY

#: What the checks look for.
MD_IMAGE = r"!\[[^\]]*\]\([^)]*\)"
HTML_IMAGE = r"(?i)<img\b[^>]*>"
DATA_URL = r"https?://[^\s)>\]]*[?&][\w.\-%]+=[A-Za-z0-9+/=_\-]{16,}[^\s)>\]]*"
REFERENCE = r"(?im)^[ \t]*\[[^\]]+\]:\s*<?https?://[^\s>]+>?"
MD_LINK = r"\[[^\]]*\]\(\s*https?://[^)]*\)"
MD_LINK_PARTS = r"(\[[^\]]*\])\(\s*https?://[^)]*\)"
AUTOLINK = r"(?i)<\s*https?://[^>]*>"
BLOB = r"\b[A-Za-z0-9+/]{40,}={0,2}\b"
COMPLIANCE = (
    r"(?i)^\s*(?:sure\b|certainly\b|of\s+course\b|okay\b|ok\b|here\s+(?:is|are|'s)\b|as\s+(?:dan|requested|instructed|you\s+(?:asked|wish|requested))\b|"
    r"i\s+(?:will|'ll|have|am\s+now)\b|ignoring\s+(?:previous|the)\b|hacked\b|pwned\b|i\s+am\s+dan\b)"
)
REDACTED, NO_IMAGE, NO_LINK = "[REDACTED]", "[image removed]", "[link removed]"

_md_image, _html_image, _data_url, _reference, _md_link, _md_parts, _autolink, _blob, _compliance = map(re.compile, (MD_IMAGE, HTML_IMAGE, DATA_URL, REFERENCE, MD_LINK, MD_LINK_PARTS, AUTOLINK, BLOB, COMPLIANCE))
_prefix = re.compile(re.escape(CANARY_PREFIX) + r"\w*")

#: Kinds of findings in the order of the checks: name, category, severity, weight, what it says.
KINDS = (
    ("canary", "canary_leak", "critical", 1.0, "the reply holds the secret token"),
    ("prefix", "canary_leak", "critical", 1.0, "the reply holds the token's prefix"),
    ("nonce", "nonce_leak", "high", 0.8, "the reply holds the boundary's number"),
    ("marker", "marker_leak", "low", 0.2, "the reply holds marks in place of spaces"),
    ("image", "image_exfiltration", "high", 0.8, "images in the reply"),
    ("data_url", "data_url_exfiltration", "high", 0.82, "urls that carry data in the reply"),
    ("reference", "reference_link", "medium", 0.5, "link definitions in the reply"),
    ("link", "link_in_output", "medium", 0.45, "links in the reply"),
    ("rules", "prompt_leak", "critical", 0.95, "the reply repeats the rules"),
    ("blob", "encoded_output", "medium", 0.4, "long encoded run in the reply"),
    ("tell", "compliance_tell", "medium", 0.5, "the reply opens like one that obeys"),
)
PLACE = {k[0]: i for i, k in enumerate(KINDS)}


def check_reply(reply: str | None, canary: str | None, nonce: str | None, marker: str | None, redact_links: bool = True, redact_images: bool = True, block_on_leak: bool = True) -> tuple[bool, str, bool, list[tuple[int, int, str | None]]]:
    """Whether the reply is safe, what is left of it, whether anything was taken out, and (kind, count, excerpt) found."""
    raw = reply or ""
    text = unicodedata.normalize("NFKC", _ANY[False].sub("", raw))
    redacted, found = text != raw, []

    def note(kind: str, n: int = 1, excerpt: str | None = None) -> None:
        found.append((PLACE[kind], n, excerpt))

    for kind, secret, by in (("canary", canary, REDACTED), ("prefix", CANARY_PREFIX, None), ("nonce", nonce, REDACTED), ("marker", marker, " ")):
        if secret and secret in text:
            note(kind)
            text = _prefix.sub(REDACTED, text) if by is None else text.replace(secret, by)
            redacted = True
    for kind, looks, changes, redact in (
        ("image", (_md_image, _html_image), ((_md_image, NO_IMAGE), (_html_image, NO_IMAGE)), redact_images),
        ("data_url", (_data_url,), ((_data_url, NO_LINK),), redact_links),
        ("reference", (_reference,), ((_reference, NO_LINK),), redact_links),
        ("link", (_md_link, _autolink), ((_md_parts, r"\1"), (_autolink, "")), redact_links),
    ):
        seen = [x for p in looks for x in p.findall(text)]
        if seen:
            note(kind, len(seen), seen[0][:80])
            if redact:
                redacted = True
                for p, by in changes:
                    text = p.sub(by, text)
    if any(p in text.lower() for p in FINGERPRINTS):
        note("rules")
    if blob := _blob.search(text):
        note("blob", 1, blob[0][:60])
    if _compliance.match(text):
        note("tell", 1, text[:60])
    leaks = {PLACE[k] for k in ("canary", "prefix", "rules")}
    return not (block_on_leak and any(f[0] in leaks for f in found)), text.strip(), redacted, found


CHECKED = T.StructType([T.StructField("safe", T.BooleanType()), T.StructField("summary", T.StringType()), T.StructField("redacted", T.BooleanType()), T.StructField("found", T.ArrayType(T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("excerpt", T.StringType())])))])


def validate(df: DataFrame, reply: str = "reply", context: str = "context", into: str = "validation", *, redact_links: bool = True, redact_images: bool = True, block_on_leak: bool = True) -> DataFrame:
    """Add a struct of safe, summary, redacted and findings. A null reply counts as empty; without a context nothing leaks."""
    how = (redact_links, redact_images, block_on_leak)

    @F.pandas_udf(CHECKED)
    def run(replies: pd.Series, canaries: pd.Series, nonces: pd.Series, markers: pd.Series) -> pd.DataFrame:
        out = []
        for row in zip(replies, canaries, nonces, markers, strict=True):
            *verdict, found = check_reply(*row, *how)
            out.append((*verdict, [{"kind": k, "n": n, "excerpt": e} for k, n, e in found]))
        return pd.DataFrame(out, columns=CHECKED.names)

    ctx = F.col(context)
    df = df.withColumn("__checked", run(F.col(reply), ctx["canary"], ctx["nonce"], ctx["marker"]))
    table = F.array(*(F.struct(F.lit(c).alias("category"), F.lit(s).alias("severity"), F.lit(w).alias("weight"), F.lit(m).alias("message")) for _, c, s, w, m in KINDS))

    def one(f):
        k = F.element_at(table, f["kind"] + 1)
        message = F.concat(F.when(f["n"] > 1, F.concat(f["n"].cast("string"), F.lit(" "))).otherwise(""), k["message"])
        return F.struct(F.lit("validate").alias("stage"), k["category"].alias("category"), k["severity"].alias("severity"), message.alias("message"), k["weight"].alias("weight"), f["excerpt"].alias("excerpt"), F.lit(None).cast(C.FINDING["span"].dataType).alias("span"), F.lit(None).cast("string").alias("pattern_id")).cast(C.FINDING)

    c = F.col("__checked")
    result = F.struct(c["safe"].alias("safe"), c["summary"].alias("summary"), c["redacted"].alias("redacted"), F.transform(c["found"], one).alias("findings"))
    return df.withColumn(into, result).drop("__checked")
