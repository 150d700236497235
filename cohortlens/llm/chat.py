"""Chat formatting whose output provably parses back to its source.

Grammar of the output (one conversation is its turns one after another)::

    turn := "<|im_start|>" role "\\n" body "<|im_end|>" "\\n"

The parser is deterministic: the role ends at the first newline, the body at the first
``<|im_end|>``; a role or body that holds either control string bare is no turn. It takes
one backslash out of every ``<|\\...\\im_start|>`` and ``<|\\...\\im_end|>``; in a role it then
reads ``\\n`` as a newline and ``\\\\`` as a backslash.
A turn is first rendered as it stands and parsed back; only what does not come back
identical is escaped, until it does.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.bytestrings import slices
from cohortlens.shipping import ship_package

START, END = "<|im_start|>", "<|im_end|>"
_CONTROL = re.compile(r"<\|(\\*)(im_start|im_end)\|>")
_ESCAPED_CONTROL = re.compile(r"<\|\\(\\*)(im_start|im_end)\|>")
_ESCAPED_ROLE = re.compile(r"\\([n\\])")


def escape_body(text: str) -> str:
    return _CONTROL.sub(r"<|\\\1\2|>", text)


def unescape_body(text: str) -> str:
    return _ESCAPED_CONTROL.sub(r"<|\1\2|>", text) if "<|\\" in text else text


def escape_role(role: str) -> str:
    return escape_body(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return _ESCAPED_ROLE.sub(lambda m: "\n" if m[1] == "n" else "\\", unescape_body(role)) if "\\" in role else role


def parse(rendered: str) -> Iterator[tuple[str, str, int, int]]:
    """Each turn's role, text, and where its body starts and ends in `rendered`."""
    at = 0
    while at < len(rendered):
        if not rendered.startswith(START, at):
            raise ValueError(f"no turn starts at {at}")
        header = rendered.find("\n", at)
        end = rendered.find(END, header + 1) if header >= 0 else -1
        if end < 0 or not rendered.startswith("\n", end + len(END)):
            raise ValueError(f"the turn at {at} does not end")
        role, body = rendered[at + len(START) : header], rendered[header + 1 : end]
        if START in role or END in role or START in body:
            raise ValueError(f"the turn at {at} holds a bare control string")
        yield unescape_role(role), unescape_body(body), header + 1, end
        at = end + len(END) + 1


def round_trips(rendered: str, role: str, text: str) -> bool:
    try:
        return [turn[:2] for turn in parse(rendered)] == [(role, text)]
    except ValueError:
        return False


def render_turn(role: str, text: str) -> str:
    """The turn's rendered form, with as little escaping as the round trip allows."""
    for shown_role, body in (
        (role, text),
        (role, escape_body(text)),
        (escape_role(role), text),
        (escape_role(role), escape_body(text)),
    ):
        rendered = f"{START}{shown_role}\n{body}{END}\n"
        if round_trips(rendered, role, text):
            return rendered
    raise ValueError("the escaped turn does not parse back")


def format_conversations(
    turns: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    loss_role: str = "assistant",
) -> DataFrame:
    """One row per turn: its rendered `segment`, and the loss mask as a span of code points in it.

    A conversation's formatted text is its segments in the order of (`turn`, `segment`). It
    stays in rows, so a conversation of any length fits. Null roles and texts render as
    empty; a null turn sorts first; repeated rows are turns of their own. Columns other
    than the four named ones are left behind. An empty table gives no rows.
    """
    ship_package(turns.sparkSession)

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            segments, starts, ends = [], [], []
            for who, said in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                segment = render_turn(who or "", said or "")
                _, _, start, end = next(parse(segment))
                segments.append(segment)
                starts.append(start if who == loss_role else 0)
                ends.append(end if who == loss_role else 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(segments, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())],
                names=["conversation", "turn", "segment", "loss_start", "loss_end"],
            )

    source = turns.select(
        F.col(conversation).alias("conversation"), F.col(turn).alias("turn"), F.col(role).cast("string"), F.col(text).cast("string")
    )
    kinds = dict(source.dtypes)
    return source.mapInArrow(
        render, f"conversation {kinds['conversation']}, turn {kinds['turn']}, segment string, loss_start int, loss_end int"
    )


def digest_formatted(formatted: DataFrame) -> DataFrame:
    """One row per conversation, read back from `format_conversations` output alone.

    Segments stream through their task in order and only the running hashes are held, so
    memory does not grow with a conversation. A SHA-256 over a whole conversation is
    sequential, so one conversation's segments do pass through one task.
    """
    ship_package(formatted.sparkSession)
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        kind, key, state = None, None, None

        def close() -> None:
            turns, turn_hash, chars, loss_hash, size = state
            done.append((key, turns, turn_hash.hexdigest(), chars, loss_hash.hexdigest(), size))

        def flush() -> pa.RecordBatch:
            columns = list(zip(*done)) or [()] * 6
            types = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)
            done.clear()
            return out

        for batch in slices(batches):
            kind = batch.schema.field(0).type
            for conv, segment, start, end in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4))):
                if state is None or conv != key:
                    if state is not None:
                        close()
                    key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text, _, _ in parse(segment):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                masked = unescape_body(segment[start:end])
                state[2] += len(masked)
                state[3].update(masked.encode())
                state[4] += len(segment)
            if len(done) >= 4096:
                yield flush()
        if state is not None:
            close()
            yield flush()

    ordered = formatted.repartition("conversation").sortWithinPartitions("conversation", "turn", "segment")
    kind = dict(formatted.dtypes)["conversation"]
    return ordered.mapInArrow(
        read_back,
        f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )
