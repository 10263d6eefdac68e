"""Formatting conversations with a black-box template and finding the loss spans.

A template is any function of a list of ``(role, text)`` and the number of turns
before the list. It is rendered for successive turn prefixes. If each output starts with the
one before, the difference is the turn's span; if not, the template rewrites
history, the conversation is marked, and only turns whose text still stands in
the last output keep a span. Where the text lies inside a span is found by
rendering the turn with two probe texts that differ in every character: what the
two outputs share in front and behind is the template's.

A template is rendered on the whole conversation, for it may depend on any turn, unless it has
an attribute ``look_back``: it then promises that the output of a turn depends on that many
turns before it only, on none behind it, and on the number of all before the list. Conversations
of more than ``PART_TURNS`` turns are then rendered in parts, each in its own group, with exactly
so many earlier turns as context, so one huge conversation is spread over tasks.

Null role or text counts as empty, null turns come first, rows with equal turns
are put in the order of role and text and all kept; a null ``conv_id`` is a
conversation of its own; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PART_TURNS = 64
TRAINED_ROLE = "assistant"

# --- fixed values: control strings of widespread chat formats ----------------
TURN_START, TURN_END = "<|im_start|>", "<|im_end|>"
CONTROLS = [TURN_START, TURN_END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
# --- end of fixed values ------------------------------------------------------

SPANS = "array<struct<role:string,start:bigint,end:bigint,text_start:bigint,text_end:bigint,loss:boolean>>"
SCHEMA = f"conv_id bigint, part bigint, n_turns bigint, formatted string, spans {SPANS}, rewrites_history boolean"
_INTS = [(n, pa.int64()) for n in ("start", "end", "text_start", "text_end")]
_ARROW = pa.schema(
    [
        ("conv_id", pa.int64()), ("part", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()),
        ("spans", pa.list_(pa.struct([("role", pa.string()), *_INTS, ("loss", pa.bool_())]))), ("rewrites_history", pa.bool_()),
    ]
)
Turns = list[tuple[str, str]]
Template = Callable[[Turns, int], str]


def escape(text: str) -> str:
    """No control string is left in the result; ``unescape`` gives the text back."""
    text = text.replace("\\", "\\\\")
    for control in CONTROLS:
        text = text.replace(control, control[0] + "\\" + control[1:])
    return text


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def marked_turns(turns: Turns, before: int = 0) -> str:
    """The package's template: a marked head line with the role, the text, an end mark."""
    head = lambda role: escape(role).replace("\n", "\\\n")
    return "".join(f"{TURN_START}{head(role)}\n{escape(text)}{TURN_END}\n" for role, text in turns)


marked_turns.look_back = 0

_TURN = re.compile(re.escape(TURN_START) + r"((?:[^\\\n]|\\.)*)\n(.*?)" + re.escape(TURN_END) + "\n", re.DOTALL)


def read_turns(formatted: str) -> Turns:
    """The inverse of ``marked_turns``."""
    out, at = [], 0
    while at < len(formatted):
        found = _TURN.match(formatted, at)
        if not found:
            raise ValueError("not a formatted conversation")
        out.append((unescape(found[1]), unescape(found[2])))
        at = found.end()
    return out


def _text_place(template: Template, before_turns: Turns, role: str, before: int, base: int) -> tuple[int, int]:
    """Characters of the template in front of and behind the text of the next turn."""
    probes = [template([*before_turns, (role, c * 3)], before)[base:] for c in "QZ"]
    front = len(os.path.commonprefix(probes))
    back = len(os.path.commonprefix([p[::-1] for p in probes]))
    return front, back


def render_part(template: Template, context: Turns, turns: Turns, before: int) -> tuple[str, list[dict], bool]:
    """(formatted text of the turns, spans, whether an output did not start with the one before)."""
    base = template(context, before) if context else ""
    outputs, rewrites = [base], False
    for k in range(1, len(turns) + 1):
        outputs.append(template(context + turns[:k], before))
        rewrites |= not outputs[-1].startswith(outputs[-2])
    last = outputs[-1]
    shift = len(base) if last.startswith(base) else 0
    spans = []
    for k, (role, _) in enumerate(turns):
        was, now = outputs[k], outputs[k + 1]
        start = len(was) if now.startswith(was) else len(os.path.commonprefix([was, now]))
        if last[start : len(now)] != now[start:]:
            continue  # rewritten later: this turn has no place in the last output
        loss = role == TRAINED_ROLE
        front, back = _text_place(template, context + turns[:k], role, before, start) if loss else (0, 0)
        if loss and front + back > len(now) - start:
            continue
        spans.append(
            {
                "role": role, "start": start - shift, "end": len(now) - shift,
                "text_start": start + front - shift, "text_end": len(now) - back - shift, "loss": loss,
            }
        )
    return last[shift:], spans, rewrites


def _rows(batches) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns))


def _in_parts(rows: DataFrame, part_turns: int, look_back: int) -> DataFrame:
    """Parts of ``part_turns`` turns and the ``look_back`` turns before each. Places are counted in
    ranges of turn numbers and the ranges by running sums, so no conversation has to meet in one task."""
    rows = rows.withColumn("_range", F.coalesce(F.floor(F.col("turn") / part_turns), F.lit(-(1 << 62))))
    sizes = rows.groupBy("conv_id", "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("conv_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col("conv_id").alias("_conv"), F.col("_range").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("conv_id", "_range").orderBy("turn", "role", "text")
    rows = rows.withColumn("_i", F.row_number().over(inside) - 1)
    rows = rows.join(sizes, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_range") == F.col("_of")))
    place = F.col("_before") + F.col("_i")
    own = F.floor(place / part_turns)
    # the parts that have the turn among their own or among those before them
    last = F.floor((place + look_back) / part_turns)
    rows = rows.withColumn("_own", own).withColumn("part", F.explode(F.sequence(own, last)))
    return rows.select("conv_id", "part", (F.col("part") != F.col("_own")).alias("_ctx"), "turn", "role", "text")


def format_conversations(conversations: DataFrame, template: Template = marked_turns, part_turns: int = PART_TURNS) -> DataFrame:
    """One row per part of a conversation (most have one): the formatted text and
    the span of each turn in it. The loss mask is the text of the assistant's turns. Only
    templates with a ``look_back`` are rendered in parts."""
    rows = conversations.select(
        F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    look_back = getattr(template, "look_back", None)
    if look_back is None:
        rows = rows.select("conv_id", F.lit(0).cast("bigint").alias("part"), F.lit(False).alias("_ctx"), "turn", "role", "text")
    else:
        rows = _in_parts(rows, part_turns, look_back)

    def render(batches):
        waiting, size = [], 0
        for (conv_id, part), group in groupby(_rows(batches), key=lambda r: r[:2]):
            context, turns = [], []
            for row in group:
                (context if row[2] else turns).append((row[4], row[5]))
            if not turns:
                continue  # only the end of the part before
            text, spans, rewrites = render_part(template, context, turns, part * part_turns - len(context))
            waiting.append((conv_id, part, len(turns), text, spans, rewrites))
            size += len(text)
            if size > 4 << 20:
                yield _batch(waiting)
                waiting, size = [], 0
        if waiting:
            yield _batch(waiting)

    order = ["conv_id", "part", F.desc("_ctx"), "turn", "role", "text"]
    return rows.repartition("conv_id", "part").sortWithinPartitions(*order).mapInArrow(render, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


DIGESTS = (
    "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint,"
    " rewrites_history boolean"
)
_DIGESTS = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewrites_history"]


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """Read the turns and the masked text back from the formatted parts, a conversation
    after the other; a digest needs its text in order, but only a part is held at a time."""

    def digest(batches):
        out = []
        for conv_id, parts in groupby(_rows(batches), key=lambda r: r[0]):
            turns, loss = hashlib.sha256(), hashlib.sha256()
            n_turns = loss_chars = chars = 0
            rewrites = False
            for _, _, text, spans, rewritten in parts:
                for role, said in read_turns(text):
                    turns.update(f"{role}\n{said}\n".encode())
                    n_turns += 1
                for span in spans:
                    if span["loss"]:
                        said = unescape(text[span["text_start"] : span["text_end"]])
                        loss.update(said.encode())
                        loss_chars += len(said)
                chars += len(text)
                rewrites |= rewritten
            out.append((conv_id, n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, rewrites))
            if len(out) == 4096:
                yield _digest_batch(out)
                out = []
        if out:
            yield _digest_batch(out)

    rows = formatted.select("conv_id", "part", "formatted", "spans", "rewrites_history")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(digest, DIGESTS)


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)], _DIGESTS)
