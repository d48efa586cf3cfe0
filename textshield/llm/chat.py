"""Chat formatting: a finite-state machine over roles, and a template that says which segments carry loss.

Each turn becomes three segments: an opening mark with the role, the text, a closing mark. Inside roles and texts the
escape character is doubled and put after the first character of every control string, so that no control string is
left in them and dropping each escape character restores them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textshield import runtime


@dataclass(frozen=True)
class Template:
    """Marks, control strings, loss roles, and the machine: its start, moves by (state, role), and end states."""

    opening: tuple[str, str] = ("<|turn|>", "\n")
    closing: str = "<|end|>\n"
    controls: tuple[str, ...] = ("<|", "</s>", "<s>", "[INST]", "[/INST]")
    escape: str = "\\"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    moves: tuple[tuple[str, str, str], ...] = (
        ("start", "system", "told"),
        ("start", "user", "asked"),
        ("told", "user", "asked"),
        ("asked", "assistant", "answered"),
        ("answered", "user", "asked"),
    )
    ends: tuple[str, ...] = ("answered",)
    wrong: str = "wrong"

    def step(self, state: str, role: str) -> str:
        return next((to for at, r, to in self.moves if (at, r) == (state, role)), self.wrong)

    def shield(self, text: str) -> str:
        text = text.replace(self.escape, self.escape * 2)
        return re.sub("(?=" + "|".join(map(re.escape, self.controls)) + ")(.)", lambda m: m[1] + self.escape, text, flags=re.S)

    def unshield(self, text: str) -> str:
        return re.sub(re.escape(self.escape) + "(.)", lambda m: m[1], text, flags=re.S)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """A turn as (text, loss) segments. A line end in a role is escaped like a control string's first character."""
        mark = self.shield(role).replace("\n", self.escape + "\n")
        return [(self.opening[0] + mark + self.opening[1], False), (self.shield(text), role in self.loss_roles), (self.closing, False)]


class Reader:
    """Reads formatted segments back into turns: only marks and escapes count, not where the segments were cut."""

    def __init__(self, template: Template):
        e = re.escape(template.escape)
        self.t = template
        self.turn = re.compile(re.escape(template.opening[0]) + f"((?:[^{e}\n]|{e}.)*)" + re.escape(template.opening[1]) + "(.*?)" + re.escape(template.closing), re.S)
        self.buffer = ""

    def feed(self, text: str) -> Iterator[tuple[str, str]]:
        """The (role, text) of each turn that ends with this piece."""
        self.buffer += text
        if not text.endswith(self.t.closing):
            return
        at = 0
        while m := self.turn.match(self.buffer, at):
            yield self.t.unshield(m[1]), self.t.unshield(m[2])
            at = m.end()
        self.buffer = self.buffer[at:]


SEGMENTS = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("segment", T.LongType()),
        T.StructField("state", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("loss", T.BooleanType()),
        T.StructField("last", T.BooleanType()),
    ]
)


def _turns(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True)


def format_conversations(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """Segments of all conversations, in order, with a loss flag each and the machine's state after their turn.

    Turns are read by turn, then role, then text (null turns first, a null role or text as empty); repeated rows are
    turns of their own, and rows of a null conv_id are one conversation. A turn that the machine refuses puts the
    conversation into the state `wrong` for good; it is formatted all the same. `last` marks a conversation's last
    segment: it is valid if the state there is one of the template's ends. Other columns are not read; an empty table
    gives none. One conversation is one sequence, so its turns are streamed through one task, a batch at a time.
    """
    runtime.prepare(turns.sparkSession)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = ["conv_id", "turn", "role", "text"]

    def run(batches):
        out: list[tuple] = []
        held: list[tuple] | None = None  # the latest turn, until it is known whether another follows
        conv, state, n = None, template.start, 0

        def let_go(last):
            if held:
                out.extend(held[:-1])
                out.append((*held[-1][:-1], last))

        def batch():
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.bool_()), strict=True)], SEGMENTS.names)
            out.clear()
            return made

        for c, role, text in _turns(batches):
            if held is not None and c == conv:
                let_go(False)
            else:
                let_go(True)
                conv, state, n = c, template.start, 0
            state = template.step(state, role)
            held = [(c, n + i, state, t, loss, False) for i, (t, loss) in enumerate(template.segments(role, text))]
            n += len(held)
            if len(out) >= 2000:
                yield batch()
        let_go(True)
        if out:
            yield batch()

    return rows.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(run, SEGMENTS)


DIGESTS = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("n_turns", T.LongType()),
        T.StructField("turns_sha256", T.StringType()),
        T.StructField("loss_chars", T.LongType()),
        T.StructField("loss_sha256", T.StringType()),
        T.StructField("formatted_chars", T.LongType()),
        T.StructField("valid", T.BooleanType()),
    ]
)


def read_back(segments: DataFrame, template: Template = Template()) -> DataFrame:
    """One row for each formatted conversation: its turns and its text under the loss mask, read from the output alone.

    Works on the partitions of format_conversations as they are, and holds one turn at a time. An empty text gives an
    empty segment and counts no character, repeated turns are counted each, the conversation of null rows is one row, and
    no segment gives no row.
    """

    def run(batches):
        done: list[tuple] = []

        def fresh():
            return Reader(template), hashlib.sha256(), hashlib.sha256()

        reader, turns, loss = fresh()
        n_turns = loss_chars = chars = 0
        for batch in batches:
            for conv, state, text, masked, last in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "state", "text", "loss", "last")), strict=True):
                chars += len(text)
                if masked:
                    plain = template.unshield(text)
                    loss_chars += len(plain)
                    loss.update(plain.encode())
                for role, said in reader.feed(text):
                    n_turns += 1
                    turns.update(f"{role}\n{said}\n".encode())
                if last:
                    done.append((conv, n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, state in template.ends))
                    reader, turns, loss = fresh()
                    n_turns = loss_chars = chars = 0
            if len(done) >= 1000:
                yield _digest_batch(done)
                done = []
        if done:
            yield _digest_batch(done)

    return segments.mapInArrow(run, DIGESTS)


def _digest_batch(done: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], DIGESTS.names)


#: The conversation that says control strings.
PROBE = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def query(turns: DataFrame) -> DataFrame:
    probe = turns.sparkSession.createDataFrame(PROBE, "conv_id long, turn long, role string, text string")
    return read_back(format_conversations(turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(probe)))


ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), s AS (
  SELECT *, regexp_replace(replace(role, '\', '\\'), '(<)(\||/?s>)|(\[)(/?INST\])', '\1\3\\\2\4', 'g') AS r,
    regexp_replace(replace(text, '\', '\\'), '(<)(\||/?s>)|(\[)(/?INST\])', '\1\3\\\2\4', 'g') AS x,
    lag(role) OVER w AS before
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(r) + length(replace(r, chr(10), '')) * 0 + length(r) - length(replace(r, chr(10), '')) + length(x) + 17) AS BIGINT) AS formatted_chars,
  bool_and(CASE WHEN before IS NULL THEN role IN ('system', 'user') WHEN before = 'system' THEN role = 'user'
    WHEN before = 'user' THEN role = 'assistant' WHEN before = 'assistant' THEN role = 'user' ELSE false END)
    AND arg_max(role, (turn, role, text)) = 'assistant' AS valid
FROM s GROUP BY conv_id
"""
