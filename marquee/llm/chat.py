"""Chat formatting with a grammar round trip.

A turn is rendered as `<|im_start|>role\\ntext<|im_end|>\\n`. A deterministic parser reads rendered text back; a turn whose
parse differs from its source is escaped once more until it is identical. Escaping puts one backslash after the `<` of
every control string, `<|im_end|>` -> `<\\|im_end|>` and `<\\|im_end|>` -> `<\\\\|im_end|>`; the parser takes one away. Texts
without control strings stay as they are. Roles are treated alike, and their line breaks and backslashes as `\\n`, `\\\\`.

A conversation is a run of records of at most about `record_chars` characters, each made of whole turns, so that one of
any length needs no more memory than a record. Null text or role counts as empty. Turns are ordered by (turn, role, text)
and repeated rows are kept. Rows with a null conv_id form one conversation; a null turn comes first. An empty table gives
no record. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import n_parts

START, END, BREAK = "<|im_start|>", "<|im_end|>", "\n"
CONTROL = re.compile(r"<(\\*)\|(im_start|im_end)\|>")
ESCAPED = re.compile(r"<\\(\\*)\|(im_start|im_end)\|>")


def escape(text: str) -> str:
    return CONTROL.sub(r"<\\\1|\2|>", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"<\1|\2|>", text)


def role_line(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def read_role(line: str) -> str:
    return re.sub(r"\\([\\n])", lambda m: "\n" if m[1] == "n" else "\\", unescape(line))


def parse(rendered: str) -> list[tuple[str, str, int, int]]:
    """Turns (role, text, begin and end of the text as rendered); ValueError where the text isn't in the grammar."""
    turns, at = [], 0
    while at < len(rendered):
        line, stop = rendered.find(BREAK, at), rendered.find(END + BREAK, at)
        if not rendered.startswith(START, at) or line < 0 or stop < line:
            raise ValueError(f"no turn at {at}")
        body = rendered[line + 1 : stop]
        if START in body or END in body or START in rendered[at + len(START) : line] or END in rendered[at + len(START) : line]:
            raise ValueError(f"control string inside a turn at {at}")
        turns.append((read_role(rendered[at + len(START) : line]), unescape(body), line + 1, stop))
        at = stop + len(END) + len(BREAK)
    return turns


def render(role: str, text: str, most: int = 3) -> tuple[str, int, int]:
    """A turn as rendered, and where its text lies in it; escaped until the parse gives the source back."""
    line, body = role_line(role), text
    for _ in range(most):
        whole = f"{START}{line}{BREAK}{body}{END}{BREAK}"
        try:
            turns = parse(whole)
        except ValueError:
            turns = []
        if len(turns) == 1 and turns[0][:2] == (role, text):
            return whole, turns[0][2], turns[0][3]
        body = escape(body)
    raise ValueError("a turn can't be escaped")


def format_chat(turns: DataFrame, record_chars: int = 1 << 20) -> DataFrame:
    """Records (conv_id, record, text, loss): the rendered turns of a conversation in order of `record`; loss holds the spans
    (begin, end) of assistant texts in the record, in code points. Turns are dealt by ranges of (conv_id, turn, role, text), so that a very long conversation is many
    tasks'; a record ends where a range does. Of the text its first characters tell the ranges."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, number, text, chars, loss, out = None, TaskContext.get().partitionId() << 32, [], 0, [], []

        def close():
            nonlocal number, text, chars, loss
            if text:
                out.append({"conv_id": conv[0], "record": number, "text": "".join(text), "loss": loss})
                number, text, chars, loss = number + 1, [], 0, []

        for batch in batches:
            for c, role, said in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "role", "text")), strict=True):
                if conv != (c,):
                    close()
                    conv = (c,)
                whole, begin, end = render(role or "", said or "")
                if role == "assistant":
                    loss.append({"begin": chars + begin, "end": chars + end})
                text.append(whole)
                chars += len(whole)
                if chars >= record_chars:
                    close()
            if out:
                yield pa.RecordBatch.from_pylist(out, RECORD)
                out = []
        close()
        if out:
            yield pa.RecordBatch.from_pylist(out, RECORD)

    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    dealt = rows.repartitionByRange(n_parts(turns.sparkSession), "conv_id", "turn", "role", F.substring("text", 1, 64))
    return dealt.sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(records, "conv_id long, record long, text string, loss array<struct<begin:long,end:long>>")


RECORD = pa.schema([("conv_id", pa.int64()), ("record", pa.int64()), ("text", pa.string()), ("loss", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))])


def parsed(records: DataFrame) -> DataFrame:
    """(conv_id, record, said, loss, n_turns, chars) of records: what their turns and loss spans say, parsed and unescaped; of each record alone."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(*(batch.column(x).to_pylist() for x in ("text", "loss")), strict=True):
                turns = [(role, body) for role, body, _, _ in parse(text)]
                out.append(("".join(f"{role}\n{body}\n" for role, body in turns), "".join(unescape(text[x["begin"] : x["end"]]) for x in spans), len(turns), len(text)))
            told = list(zip(*out, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("record"), pa.array(told[0], pa.string()), pa.array(told[1], pa.string()), pa.array(told[2], pa.int64()), pa.array(told[3], pa.int64())], ["conv_id", "record", "said", "loss", "n_turns", "chars"])

    return records.select("conv_id", "record", "text", "loss").mapInArrow(rows, "conv_id long, record long, said string, loss string, n_turns long, chars long")


def read_back(records: DataFrame) -> DataFrame:
    """Parse records again: (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars). Records are parsed wherever they lie; only the digests, which
    go on from each byte to the next, take a conversation's texts as one stream."""

    def conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, said, loss, n, chars, whole, out = None, None, None, 0, 0, 0, []

        def close():
            if conv:
                out.append({"conv_id": conv[0], "n_turns": n, "turns_sha256": said.hexdigest(), "loss_chars": chars, "loss_sha256": loss.hexdigest(), "formatted_chars": whole})

        for batch in batches:
            for c, text, loss_text, turns, size in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "said", "loss", "n_turns", "chars")), strict=True):
                if conv != (c,):
                    close()
                    conv, said, loss, n, chars, whole = (c,), hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                said.update(text.encode())
                loss.update(loss_text.encode())
                n, chars, whole = n + turns, chars + len(loss_text), whole + size
            if out:
                yield pa.RecordBatch.from_pylist(out, CONVERSATION)
                out = []
        close()
        if out:
            yield pa.RecordBatch.from_pylist(out, CONVERSATION)

    ordered = parsed(records).repartition(n_parts(records.sparkSession), "conv_id").sortWithinPartitions("conv_id", "record")
    return ordered.mapInArrow(conversations, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


CONVERSATION = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
