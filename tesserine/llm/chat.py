"""Chat formatting by incremental rendering of a black-box template.

A template is any function from a list of turns to a string. Each prefix of a conversation is rendered; where an output continues
the one before, the new part is the span of the new turn. An output that does not continue the one before means that the template
rewrites its history: such conversations are marked, and only turns whose text is still in place get spans. Where a turn's text
lies in its span is found by rendering the same prefix with two other texts in its place: what the outputs share is not text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from os.path import commonprefix

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.llm.common import query, table

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]
START, END = "<|im_start|>", "<|im_end|>"
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)


def escape(text: str) -> str:
    """No `<|` is left: a backslash is put before the bar. Backslashes already there gain one, so `unescape` undoes it."""
    return re.sub(r"<(\\*)\|", r"<\1\\|", text) if "<" in text else text


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text) if "<" in text else text


def marked(turns: list[Turn]) -> str:
    """The template: turns between start and end marks, roles and texts escaped."""
    return "".join(f"{START}{_role(role)}\n{escape(text)}{END}\n" for role, text in turns)


def _role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def parse(formatted: str) -> list[Turn]:
    """The turns of a text that `marked` has made."""
    back = lambda role: re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))
    return [(back(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def render(turns: list[Turn], template: Template) -> tuple[str, list[tuple[int, int, int, int]], bool]:
    """The formatted text, per turn (start, end, text start, text end), and whether the template rewrites history.

    A turn whose rendering is rewritten by a later one has the span (-1, -1, -1, -1).
    """
    before, spans, rewrites = template([]), [], False
    for k, (role, text) in enumerate(turns):
        after = template(turns[: k + 1])
        same = len(before) if after.startswith(before) else len(commonprefix([before, after]))
        if same < len(before):
            rewrites = True
            spans = [s if s[1] <= same else (-1, -1, -1, -1) for s in spans]
        probes = [template([*turns[:k], (role, probe)])[same:] for probe in ("a", "b")]
        head = len(commonprefix(probes))
        tail = len(commonprefix([p[::-1] for p in probes]))
        spans.append((same, len(after), same + head, max(same + head, len(after) - tail)) if probes[0] != probes[1] else (same, len(after), len(after), len(after)))
        before = after
    return before, spans, rewrites


SPAN = pa.struct([(n, pa.int64()) for n in ("start", "end", "text_start", "text_end")] + [("loss", pa.bool_())])
FORMATTED = "conv_id long, formatted string, spans array<struct<start:long,end:long,text_start:long,text_end:long,loss:boolean>>, rewrites_history boolean"


def format_conversations(rows: DataFrame, template: Template = marked, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         text_col: str = "text", loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: conv_id, formatted, spans of its turns (loss: its text is learnt), rewrites_history.

    Turns are ordered by (turn, role, text), null turns first; null role and text count as empty. Repeated rows are turns of
    their own; rows without a conversation id form one conversation. An empty table gives no rows; other columns are not read.
    A task streams its sorted rows and holds one conversation at a time; rendering all prefixes costs the square of its turns.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(done: list[tuple[object, list[Turn]]]) -> pa.RecordBatch:
            made = [(i, turns, *render(turns, template)) for i, turns in done]
            return pa.RecordBatch.from_arrays([
                pa.array([m[0] for m in made], pa.int64()), pa.array([m[2] for m in made], pa.string()),
                pa.array([[dict(zip(("start", "end", "text_start", "text_end"), s, strict=True), loss=role in loss_roles) for s, (role, _) in zip(m[3], m[1], strict=True)]
                          for m in made], pa.list_(SPAN)), pa.array([m[4] for m in made], pa.bool_())], ["conv_id", "formatted", "spans", "rewrites_history"])

        now, turns, done = None, [], []
        for batch in batches:
            for i, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if turns and i != now:
                    done.append((now, turns))
                    turns = []
                    if len(done) >= 500:
                        yield emit(done)
                        done = []
                now = i
                turns.append((role, text))
        if turns:
            done.append((now, turns))
        if done:
            yield emit(done)

    kept = rows.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"),
                       F.coalesce(text_col, F.lit("")).alias("text"))
    return kept.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text").mapInArrow(run, FORMATTED)


def _digest(formatted: pd.Series, spans: pd.Series) -> pd.DataFrame:
    out = []
    for text, rows in zip(formatted, spans, strict=True):
        turns = parse(text)
        loss = "".join(unescape(text[s["text_start"]: s["text_end"]]) for s in rows if s["loss"])
        whole = "".join(f"{role}\n{said}\n" for role, said in turns)
        out.append((len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
    return pd.DataFrame(out, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


@query("op7_incremental_chat")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = f"{END}{START}assistant ok"
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(own)
    fields = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    made = format_conversations(rows).withColumn("d", F.pandas_udf(_digest, fields)("formatted", "spans"))
    return made.select("conv_id", "d.*", "rewrites_history")
