"""Chat logs to formatted conversations.

A log holds events of a conversation in sequence: deltas add text to a message, an
edit replaces what a message says, a regeneration starts a message anew and takes
back every later message. Folding keeps, for each message, the deltas behind its
last edit or regeneration, in sequence. Rendering writes a message between marks;
control strings inside a role or a text are broken up by a backslash, so the marks
can always be told from the text, and reading back gives the text as it was. What
assistants say is under the loss mask.

Messages are folded and rendered one by one, so a conversation of any length is
spread over tasks. Only what is defined over a whole conversation in order, a
running hash, reads its sorted messages as a stream, holding one at a time.

Defined cases: a null text or role is empty; a null turn comes first; an event
that repeats another in every respect was delivered twice and counts once; events
of one message with equal sequence apply in order of their text; an empty table
gives no rows. Columns other than the named ones are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import rows_to_arrow

START, MIDDLE, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
# Strings that some chat template gives a meaning.
CONTROL = ("<|im_start|>", "<|im_sep|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    doubled = text.replace("\\", "\\\\")
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], doubled)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def fold(events: DataFrame, message_col: str | None = None) -> DataFrame:
    """Final messages (conv_id, turn, role, text) of events (conv_id, seq, kind, turn, role, text).

    ``kind`` is ``delta``, ``edit`` or ``regenerate``; the last two may bring the first
    text of the new version. Events of one turn and role are one message, or, with
    ``message_col``, one message for each value of that column.
    """
    key = ["conv_id", "turn", "role", *([message_col] if message_col else [])]
    said = F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    log = events.select("conv_id", "seq", "kind", "turn", *key[3:], *said).distinct()
    redone = log.where("kind = 'regenerate'").groupBy("conv_id", "turn").agg(F.max("seq").alias("at"))
    upto = Window.partitionBy("conv_id").orderBy("turn")
    redone = redone.select(  # from which turn to which one what came before ``cut`` is taken back
        F.col("conv_id").alias("of"),
        F.col("turn").alias("after"),
        F.lead("turn").over(upto).alias("upto"),
        F.max("at").over(upto).alias("cut"),
    )
    hit = F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("turn") > F.col("after"))
    hit &= F.col("upto").isNull() | (F.col("turn") <= F.col("upto"))
    log = log.join(redone, hit, "left").where("cut is null or seq > cut")
    message = Window.partitionBy(*key)
    restart = F.max(F.when(F.col("kind") != "delta", F.col("seq"))).over(message)
    log = log.withColumn("restart", restart).where("restart is null or seq >= restart")
    parts = F.sort_array(F.collect_list(F.struct("seq", (F.col("kind") == "delta").alias("adds"), "text")))
    return (
        log.groupBy(*key)
        .agg(parts.alias("parts"))
        .select("conv_id", "turn", "role", F.array_join(F.col("parts.text"), "").alias("text"))
    )


def render(messages: DataFrame) -> DataFrame:
    """Messages with ``segment``, their part of the formatted conversation, and the loss mask.

    The mask is code points ``mask_start`` to ``mask_end`` of the segment; it is
    empty for all but assistants. Segments put together by turn, role and text are the
    formatted conversation.
    """
    schema = pa.schema(
        [("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("segment", pa.string())]
        + [("mask_start", pa.int64()), ("mask_end", pa.int64())]
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                head, body = START + escape(row["role"]) + MIDDLE, escape(row["text"])
                mask = (len(head), len(head) + len(body)) if row["role"] == "assistant" else (0, 0)
                out.append((row["conv_id"], row["turn"], row["role"], head + body + END, *mask))
            yield rows_to_arrow(out, schema)

    narrow = messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return narrow.mapInArrow(run, "conv_id long, turn long, role string, segment string, mask_start long, mask_end long")


def read_segment(segment: str) -> tuple[str, str]:
    """The role and text that a segment was rendered from."""
    if not (segment.startswith(START) and segment.endswith(END)):
        raise ValueError("not a segment")
    role, text = segment[len(START) : -len(END)].split(MIDDLE)
    return unescape(role), unescape(text)


def conversations(segments: DataFrame) -> DataFrame:
    """(conv_id, formatted): whole conversations as one text each."""
    parts = F.sort_array(F.collect_list(F.struct("turn", "role", "segment")))
    return segments.groupBy("conv_id").agg(F.array_join(parts.getField("segment"), "").alias("formatted"))


def digests(segments: DataFrame) -> DataFrame:
    """Per conversation, read back from its segments in order: turns, loss text, length.

    (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars). Each
    task streams sorted segments and holds the state of one conversation: two
    running hashes and three counts.
    """
    schema = pa.schema(
        [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string())]
        + [("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, current = None, None

        def done():
            return current, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if state is None or row["conv_id"] != current:
                    if state is not None:
                        out.append(done())
                    state, current = [0, hashlib.sha256(), 0, hashlib.sha256(), 0], row["conv_id"]
                segment = row["segment"]
                role, text = read_segment(segment)
                loss = unescape(segment[row["mask_start"] : row["mask_end"]])
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                state[2] += len(loss)
                state[3].update(loss.encode("utf-8", "surrogatepass"))
                state[4] += len(segment)
            yield rows_to_arrow(out, schema)
        if state is not None:
            yield rows_to_arrow([done()], schema)

    ordered = segments.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "segment")
    return ordered.mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
