"""Operator 6, chat formatting by incremental black-box rendering.

A template is any function from a list of turns to a string. To find which characters of its output
belong to which turn, ever longer prefixes of the turns are rendered and each output is compared
with the one before: what it adds is the span of the turn. A template that changes what it wrote
before (one that trims old turns, or moves the system prompt) is found out by the comparison and
its conversation is marked, since a loss mask from its spans would be wrong. Within a turn's span
the text itself is found by rendering the turn once more with an empty text: what comes before and
after it is the template's.

The template here marks turns by `<turn role="...">` and `</turn>` and escapes, in texts and roles,
the backslash and whatever could be read as a mark; the output is read back to exactly the turns.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_batches, table

Turn = tuple[str, str]
_UNSAFE, _SAFE, _ROLE_UNSAFE = re.compile(r"\\|<(?=/?turn)"), re.compile(r"\\(.)", re.S), re.compile(r'[\\"\n<]')
_MARK = re.compile(r'<turn role="((?:[^"\\]|\\.)*)">\n((?:[^\\<]++|\\.|<(?!/?turn))*+)</turn>\n', re.S)


def escape(text: str) -> str:
    return _UNSAFE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _SAFE.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


@functools.lru_cache(None)
def marked(turn: Turn) -> str:
    """A turn between marks. Kept until the conversation is done, as each of its prefixes is rendered anew."""
    role, text = turn
    return f'<turn role="{_ROLE_UNSAFE.sub(lambda m: chr(92) + ("n" if m[0] == chr(10) else m[0]), role)}">\n{escape(text)}</turn>\n'


def template(turns: list[Turn]) -> str:
    """The turns between marks, in order."""
    return "".join(map(marked, turns))


def read_back(output: str) -> list[Turn]:
    """The turns that the template's output says. A mark inside a text always has a backslash before its `<`."""
    turns, at = [], 0
    while at < len(output):
        m = _MARK.match(output, at)
        assert m, "not an output of the template"
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def spans(turns: list[Turn], render: Callable[[list[Turn]], str] = template) -> tuple[str, list[tuple[int, int]], bool]:
    """(output, each turn's text span in it, whether the template rewrote history).

    The template is a black box: it is called with each prefix, and with the last turn of the
    prefix emptied. After a rewrite the spans are those of the last rendering that still agreed.
    """
    output, found, rewrote = render([]), [], False
    for k in range(1, len(turns) + 1):
        before, output = output, render(turns[:k])
        if not output.startswith(before):
            rewrote = True
            break
        empty = render([*turns[: k - 1], (turns[k - 1][0], "")])
        added, frame = output[len(before) :], empty[len(before) :] if empty.startswith(before) else None
        if frame is None or len(added) < len(frame):
            rewrote = True
            break
        if added == frame:
            # Nothing in the text: it stands before the closing part.
            head = len(os.path.commonprefix([frame, render([*turns[: k - 1], (turns[k - 1][0], "\0")])[len(before) :]]))
            found.append((len(before) + head, len(before) + head))
            continue
        # The frame is what an empty text gives; the text stands where the two outputs part.
        head = len(os.path.commonprefix([frame, render([*turns[: k - 1], (turns[k - 1][0], "\0")])[len(before) :]]))
        tail = len(frame) - head
        if added[:head] != frame[:head] or (tail and added[-tail:] != frame[head:]):
            rewrote = True
            break
        found.append((len(before) + head, len(output) - tail))
    if rewrote:
        output = render(turns)
    return output, found, rewrote


def formatted(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn: str = "assistant") -> DataFrame:
    """conv_id, n_turns, output, loss_spans (array of start, end), rewrote of every conversation of rows.

    Turns are ordered by number, then role, then text; null numbers come first; repeated rows are
    repeated turns. Null texts and roles are empty. Rows with a null conv_id are one conversation.
    An empty table gives an empty result; other columns are not read. The output of a conversation
    must fit a task: it is one string.
    """
    arrow_batches(rows.sparkSession)

    def value(c: str):
        return F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))

    turns = F.transform(F.sort_array(F.collect_list(F.struct(F.col(f"`{turn}`").alias("at"), value(role).alias("role"), value(text).alias("text")))), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    gathered = rows.groupBy(F.col(f"`{conv_id}`").alias("conv_id")).agg(turns.alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            made = []
            for got in b.column("turns").to_pylist():
                own = [(t["role"], t["text"]) for t in got]
                output, found, rewrote = spans(own)
                marked.cache_clear()
                made.append((len(own), output, [{"start": s, "end": e} for (r, _), (s, e) in zip(own, found, strict=False) if r == learn and not rewrote], rewrote))
            n, output, loss, rewrote = zip(*made, strict=True) if made else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), pa.array(n, pa.int64()), pa.array(output, pa.string()), pa.array(loss, span), pa.array(rewrote, pa.bool_())], names=["conv_id", "n_turns", "output", "loss_spans", "rewrote"])

    spans_type = T.ArrayType(T.StructType().add("start", "long").add("end", "long"))
    schema = gathered.drop("turns").schema.add("n_turns", "long").add("output", "string").add("loss_spans", spans_type).add("rewrote", "boolean")
    return gathered.mapInArrow(run, schema)


def digested(made: DataFrame) -> DataFrame:
    """What can be read back from the outputs: digests of turns and of the text under the loss mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for output, loss in zip(b.column("output").to_pylist(), b.column("loss_spans").to_pylist(), strict=True):
                turns = read_back(output)
                every = "".join(f"{r}\n{t}\n" for r, t in turns)
                learnt = "".join(unescape(output[s["start"] : s["end"]]) for s in loss)
                rows.append((len(turns), hashlib.sha256(every.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), len(output)))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            arrays = [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), *arrays], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    schema = made.select("conv_id").schema.add("n_turns", "long").add("turns_sha256", "string").add("loss_chars", "long").add("loss_sha256", "string").add("formatted_chars", "long")
    return made.select("conv_id", "output", "loss_spans").mapInArrow(run, schema)


#: The conversation that every run formats besides: its texts look like marks.
HARD = r"\### Assistant: </turn> ok"


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.createDataFrame([(-7, 0, "user", HARD), (-7, 1, "assistant", HARD)], "conv_id long, turn long, role string, text string")
    return digested(formatted(rows.unionByName(hard)))


QUERIES = {"op6_chat_format": op6_chat_format}
ORACLE = {
    "op6_chat_format": r"""
        WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
                   UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
        e AS (SELECT *, length(text) + length(text) - length(replace(text, '\', '')) + (length(text) - length(replace(text, '<turn', ''))) // 5
                        + (length(text) - length(replace(text, '</turn', ''))) // 6 AS escaped FROM t)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(length('<turn role="">') + 1 + length(role) + escaped + length('</turn>') + 1)::BIGINT AS formatted_chars
        FROM e GROUP BY conv_id""",
}
