"""The whole guard over DataFrames: sanitize, detect, spotlight, build messages, ask a model, validate, report."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textshield import runtime
from textshield.functions import columns as C
from textshield.operators import detect as D
from textshield.operators import prompt as P
from textshield.operators import sanitize as S
from textshield.operators import spotlight as L
from textshield.operators import validate as V

Model = Callable[[list[dict[str, str]]], str]


@dataclass(frozen=True)
class GuardConfig:
    """Settings; the defaults and the presets below are fixed values."""

    strip_html: bool | str = "auto"
    normalize_unicode: bool = True
    keep_emoji_variation: bool = False
    fold_confusables: bool = True
    max_content_chars: int = 200_000
    detection_threshold: float = 0.5
    use_heuristics: bool = True
    block_before_llm: str | None = None
    spotlight_methods: Sequence[str] = ("delimit",)
    marker: str = L.MARKER
    max_words: int | None = 200
    language: str | None = None
    extra_instruction: str | None = None
    redact_output_links: bool = True
    redact_output_images: bool = True
    block_on_output_leak: bool = True
    #: Where set, nonces and canaries are derived from it and the row's id, and so survive recomputation.
    secret_seed: str | None = None

    @classmethod
    def balanced(cls) -> GuardConfig:
        return cls()

    @classmethod
    def strict(cls) -> GuardConfig:
        return cls(spotlight_methods=("datamark", "delimit"), block_before_llm="critical", detection_threshold=0.4)

    @classmethod
    def paranoid(cls) -> GuardConfig:
        return cls(spotlight_methods=("base64", "delimit"), block_before_llm="high", detection_threshold=0.3)

    def with_seed(self, seed: str) -> GuardConfig:
        return replace(self, secret_seed=seed)


class Guard:
    """Transforms of a table with an id and a text column."""

    def __init__(self, config: GuardConfig = GuardConfig(), model: Model | None = None, *, text: str = "text", key: str = "id"):
        self.config, self.model, self.text, self.key = config, model, text, key

    def sanitize(self, df: DataFrame, into: str = "sanitized") -> DataFrame:
        c = self.config
        return S.sanitize(df, self.text, into, strip_html=c.strip_html, normalize_unicode=c.normalize_unicode, keep_emoji_variation=c.keep_emoji_variation, max_chars=c.max_content_chars)

    def scan(self, df: DataFrame, into: str = "detected") -> DataFrame:
        c = self.config
        df = self.sanitize(df).withColumn("__text", F.col("sanitized.text"))
        return D.detect(df, "__text", into, threshold=c.detection_threshold, extra=F.col("sanitized.findings"), fold=c.fold_confusables, use_heuristics=c.use_heuristics).drop("__text")

    def _secret(self, purpose: str, n_bytes: int) -> Column:
        seed = self.config.secret_seed
        return L.random_hex(n_bytes) if seed is None else L.derived_hex(f"{seed}/{purpose}", F.col(self.key), n_bytes)

    def prepare(self, df: DataFrame) -> DataFrame:
        """Add sanitized, detected, spotlight, messages, context, and whether the model is not to be asked.

        Without a secret_seed the nonces are random: write the result before reading it twice.
        """
        c = self.config
        df = L.spotlight(self.scan(df), F.col("sanitized.text"), self._secret("nonce", L.NONCE_BYTES), methods=c.spotlight_methods, marker=c.marker)
        df = P.build_messages(df, F.concat(F.lit(P.CANARY_PREFIX), self._secret("canary", 8)), max_words=c.max_words, language=c.language, extra_instruction=c.extra_instruction)
        least = c.block_before_llm
        return df.withColumn("blocked", F.lit(False) if least is None else C.rank(F.col("detected.risk")) >= C.SEVERITIES.index(least))

    def finalize(self, replies: DataFrame, prepared: DataFrame, reply: str = "reply") -> DataFrame:
        """Join replies to prepared rows by id, validate them and give the verdicts.

        Rows without a reply are left out. A null id is an id like any other. An id that two prepared rows have ends the
        job: a reply to it could be to either (summarize, which numbers the rows itself, takes them).
        """
        same = Window.partitionBy(self.key)
        several = F.raise_error(F.concat(F.lit("several prepared rows have the id "), F.coalesce(F.col(self.key).cast("string"), F.lit("null"))))
        once = prepared.withColumn("__once", F.when(F.count(F.lit(1)).over(same) > 1, several.cast("boolean")).otherwise(True)).where("__once").drop("__once")
        found = replies.select(F.col(self.key).alias("__of"), F.col(reply).alias("reply"))
        return self._assemble(self._validated(once.join(found, F.col(self.key).eqNullSafe(F.col("__of"))).drop("__of")))

    def _validated(self, df: DataFrame) -> DataFrame:
        c = self.config
        return V.validate(df, redact_links=c.redact_output_links, redact_images=c.redact_output_images, block_on_leak=c.block_on_output_leak)

    def ask(self, prepared: DataFrame, model: Model | None = None) -> DataFrame:
        """Replies of the model to the rows that are not blocked; an error is kept with its row and does not end the job."""
        model = model or self.model
        if model is None:
            raise ValueError("no model: give one to the guard or to the call, or use prepare and finalize")
        return self._asked(prepared, model, self.key)

    def _asked(self, prepared: DataFrame, model: Model, key: str) -> DataFrame:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                replies, errors = [], []
                for messages in frame["messages"]:
                    try:
                        replies.append(model([{"role": m["role"], "content": m["content"]} for m in messages]))
                        errors.append(None)
                    except Exception as e:
                        replies.append(None)
                        errors.append(f"{type(e).__name__}: {e}")
                yield pd.DataFrame({key: frame[key], "reply": replies, "error": errors})

        asked = prepared.where(~F.col("blocked")).select(key, "messages")
        return asked.mapInPandas(run, T.StructType([asked.schema[key], T.StructField("reply", T.StringType()), T.StructField("error", T.StringType())]))

    def summarize(self, df: DataFrame, model: Model | None = None) -> DataFrame:
        """Ask the model for all rows that are not blocked, and give one verdict for each row.

        Prepared rows and replies are written to the shared folder: a secret is drawn, and a model asked, once for each
        row. Repeated and null ids are rows like any other.
        """
        model = model or self.model
        if model is None:
            raise ValueError("no model: give one to the guard or to the call, or use prepare and finalize")
        row = "__row"  # ids may repeat or be null: a reply belongs to a row
        prepared = runtime.written(self.prepare(df).withColumn(row, F.monotonically_increasing_id()), "prepared")
        replies = runtime.written(self._asked(prepared, model, row), "replies")
        done = self._assemble(self._validated(prepared.where(~F.col("blocked")).join(replies, row)))
        held = prepared.where("blocked").withColumns({"reply": F.lit(None).cast("string"), "error": F.lit(None).cast("string"), "validation": F.lit(None).cast(done.schema["validation"].dataType)})
        return done.unionByName(self._assemble(held)).drop(row)

    def _assemble(self, df: DataFrame) -> DataFrame:
        val, none = F.col("validation"), F.array().cast(C.FINDINGS)
        df = df.withColumn("findings", F.concat(F.coalesce(F.col("detected.findings"), none), F.coalesce(val["findings"], none)))
        df = df.withColumn("risk_score", C.noisy_or(F.col("findings.weight")))
        df = df.withColumns({
            "risk": C.bucket(F.col("risk_score")),
            "injection_detected": F.coalesce(F.col("detected.injected"), F.lit(False)),
            "summary": F.when(~F.col("blocked"), val["summary"]),
            "safe": ~F.col("blocked") & F.coalesce(val["safe"], F.lit(False)),
        })
        return df.withColumn("status", status(F.col("blocked"), F.col("safe"), F.col("injection_detected")))


def status(blocked: Column, safe: Column, injected: Column) -> Column:
    return F.when(blocked, "BLOCKED").when(~safe, "UNSAFE").when(injected, "CONTAINED").otherwise("SAFE")


#: Findings that a report shows, unless told otherwise.
SHOWN = 12


def report(status: Column, risk: Column, score: Column, findings: Column, most: int | None = SHOWN) -> Column:
    """A few lines for people: the verdict, then the gravest findings first, `most` of them (None: all)."""

    @F.pandas_udf(T.StringType())
    def run(status: pd.Series, risk: pd.Series, score: pd.Series, findings: pd.Series) -> pd.Series:
        return pd.Series([report_text(s, r, x, [] if f is None else list(f), most) for s, r, x, f in zip(status, risk, score, findings, strict=True)])

    return run(status, risk, score, findings)


def report_text(status: str, risk: str, score: float, found: list, most: int | None) -> str:
    lines = [f"Guard: {status}  (risk={risk}, score={score:.2f})"]
    if not found:
        return lines[0] + "\n  Nothing found."
    lines.append(f"  {len(found)} finding(s):")
    for f in sorted(found, key=lambda f: -C.SEVERITIES.index(f["severity"]))[:most]:
        lines.append(f"    [{f['severity']:>8}] {f['stage']}/{f['category']}: {f['message']}" + (f" — {f['excerpt']!r}" if f["excerpt"] else ""))
    if most is not None and len(found) > most:
        lines.append(f"    … and {len(found) - most} more")
    return "\n".join(lines)


def to_json(score: Column, risk: Column, injected: Column, threshold: Column, findings: Column) -> Column:
    """A scan as JSON, with weights and score to four digits and spans as pairs."""
    short = F.transform(findings, lambda f: F.struct(f["stage"].alias("stage"), f["category"].alias("category"), f["severity"].alias("severity"), f["message"].alias("message"), F.round(f["weight"], 4).alias("weight"), f["excerpt"].alias("excerpt"), F.when(f["span"].isNotNull(), F.array(f["span"]["start"], f["span"]["end"])).alias("span"), f["pattern_id"].alias("pattern_id")))
    return F.to_json(F.struct(F.round(score, 4).alias("score"), risk.alias("risk"), injected.alias("injected"), threshold.alias("threshold"), short.alias("findings")), {"ignoreNullFields": "false"})
