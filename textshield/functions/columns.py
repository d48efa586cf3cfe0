"""Column expressions that the stages share: findings, severities, scores, folding, invisible characters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEVERITIES = ("info", "low", "medium", "high", "critical")

FINDING = T.StructType(
    [
        T.StructField("stage", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("weight", T.DoubleType()),
        T.StructField("excerpt", T.StringType()),
        T.StructField("span", T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])),
        T.StructField("pattern_id", T.StringType()),
    ]
)
FINDINGS = T.ArrayType(FINDING)
_FINDING_DDL = FINDING.simpleString()


def finding(stage: str, category: str, severity: str, message, weight: float, excerpt=None, span=None, pattern_id: str | None = None) -> Column:
    """One finding; message, excerpt and span may be columns.

    The constants are parsed at once: a column for each of them takes many more calls to build.
    """
    given = {"stage": stage, "category": category, "severity": severity, "message": message, "weight": float(weight), "excerpt": excerpt, "span": span, "pattern_id": pattern_id}
    fields = ", ".join(f"'{k}', {'NULL' if v is None or isinstance(v, Column) else f'{v!r}D' if isinstance(v, float) else _quoted(v)}" for k, v in given.items())
    out = F.expr(f"named_struct({fields})")
    for k, v in given.items():
        if isinstance(v, Column):
            out = out.withField(k, v)
    return out.cast(_FINDING_DDL)


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def let(value: Column, body) -> Column:
    """body(value), with the value worked out once however often the body reads it."""
    return F.transform(F.array(value), body)[0]


def gather(*maybe: Column) -> Column:
    """An array of the findings that are there, in order."""
    return F.array_compact(F.array(*maybe)) if maybe else F.array().cast(FINDINGS)


def rank(severity: Column) -> Column:
    """Severities in order, from 0 (info) to 4 (critical)."""
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), severity).cast("int") - 1


def noisy_or(weights: Column) -> Column:
    """1 - product of (1 - weight), each weight held between 0 and 0.99; no weight: 0."""
    held = lambda w: F.greatest(F.lit(0.0), F.least(F.lit(0.99), w))
    return F.lit(1.0) - F.aggregate(weights, F.lit(1.0), lambda a, w: a * (F.lit(1.0) - held(w)))


#: Least score of each severity.
BUCKETS = ((0.90, "critical"), (0.70, "high"), (0.40, "medium"), (0.15, "low"))


def exploded(df: DataFrame, findings: str, *keep: str, into: str = "f") -> DataFrame:
    """One row for each finding, with the columns kept.

    The rows are made as if every text had some finding, and those without are dropped after: a plain explode lets the
    optimizer push "has findings" down, and so run everything that makes them twice.
    """
    return df.select(*keep, F.explode_outer(findings).alias(into)).where(F.col(into).isNotNull())


def bucket(score: Column) -> Column:
    out = F.lit("info")
    for least, name in reversed(BUCKETS):
        out = F.when(score >= least, name).otherwise(out)
    return out


def any_high(findings: Column) -> Column:
    return F.exists(findings, lambda f: f["severity"].isin("high", "critical"))


# -- folding: look-alikes to ASCII, one character for one, on the copy that only the detector sees

#: Digits and signs written for letters, and those letters.
LEET = ("013457@$", "oieastas")

#: Letters of other scripts that look like ASCII ones, and those.
CONFUSABLES = (
    "аеорсухіјѕӏԁк" "АВЕКМНОРСТУХІЈЅ" "οαρνικς" "ΟΑΒΕΗΙΚΜΝΡΤΥΧΖ" "ı․",
    "aeopcyxijsldk" "ABEKMHOPCTYXIJS" "oapvikc" "OABEHIKMNPTYXZ" "i.",
)


def fold_leet(text: Column) -> Column:
    return F.translate(text, *LEET)


def fold_confusables(text: Column) -> Column:
    return F.translate(text, *CONFUSABLES)


def fold_detection(text: Column) -> Column:
    """Both folds in one pass; no letter that one makes is changed by the other."""
    return F.translate(text, LEET[0] + CONFUSABLES[0], LEET[1] + CONFUSABLES[1])


# -- invisible characters

#: Key of the count, character class, then category, severity and weight of the finding, and what it says.
INVISIBLE = (
    ("tag_chars", r"\x{E0000}-\x{E007F}", "ascii_smuggling", "critical", 0.90, "tag characters that hide text"),
    ("bidi_controls", r"\x{202A}-\x{202E}\x{2066}-\x{2069}\x{200E}\x{200F}\x{061C}", "bidi_control", "high", 0.62, "direction controls"),
    ("variation_selectors", r"\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}", "variation_smuggling", "high", 0.66, "variation selectors"),
    ("zero_width", r"\x{200B}-\x{200D}\x{2060}-\x{2064}\x{FEFF}\x{180E}\x{00AD}", "zero_width", "low", 0.24, "zero-width characters"),
    ("control_chars", r"\x{00}-\x{08}\x{0B}\x{0C}\x{0E}-\x{1F}\x{7F}-\x{9F}", "control_chars", "low", 0.15, "control characters"),
)

EMOJI_SELECTORS = r"\x{FE00}-\x{FE0F}"


def invisible_classes(keep_emoji_variation: bool = False) -> dict[str, str]:
    return {key: cls.replace(EMOJI_SELECTORS, "") if keep_emoji_variation else cls for key, cls, *_ in INVISIBLE}


def invisible_counts(text: Column, keep_emoji_variation: bool = False) -> dict[str, Column]:
    """How many characters of each class a text holds; nothing is counted in texts that hold none at all."""
    classes = invisible_classes(keep_emoji_variation)
    some = text.rlike("[" + "".join(classes.values()) + "]")
    return {k: F.when(some, F.regexp_count(text, F.lit(f"[{c}]"))).otherwise(F.lit(0)) for k, c in classes.items()}


def strip_invisible(text: Column, keep_emoji_variation: bool = False) -> Column:
    return F.regexp_replace(text, "[" + "".join(invisible_classes(keep_emoji_variation).values()) + "]", "")


def invisible_findings(counts: dict[str, Column]) -> list[Column]:
    return [F.when(counts[key] > 0, finding("sanitize", category, severity, F.concat(F.lit("removed "), counts[key].cast("string"), F.lit(" " + what)), weight)) for key, _, category, severity, weight, what in INVISIBLE]


# -- white space

HORIZONTAL = r"(?U)[^\S\n]+"


def squeeze(text: Column) -> Column:
    return F.regexp_replace(text, HORIZONTAL, " ")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def tidy(text: Column) -> Column:
    """One blank for each run, no blanks at line ends, at most one empty line at a time, none at either end."""
    lines = F.regexp_replace(squeeze(text), r"(?Ud)(?m)^[^\S\n]+|[^\S\n]+$", "")
    return strip(F.regexp_replace(lines, r"\n{3,}", "\n\n"))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
