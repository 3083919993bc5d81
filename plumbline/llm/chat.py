"""Chat formatting with loss masks that follow character offsets.

A whole conversation is rendered at once and encoded once with offsets. The spans of the turns lie in order, and so do
those of the tokens, so a turn's tokens are found by binary search. A token that crosses a turn's edge is in the mask
with the part that lies inside: mask spans say which characters of a token count.

Template, for each turn: `### role:` and a line feed, the text, `</turn>` and a line feed. Backslash escapes the control
strings where they occur in a text or role, and itself, so that what was said can be read back exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

OPEN, CLOSE = "### ", "</turn>\n"
SCHEMA = "conv_id long, n_turns long, formatted string, token_ids array<int>, mask_token array<int>, mask_start array<int>, mask_end array<int>"
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*):\n((?:[^\\]|\\.)*?)</turn>\n", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("</turn>", "<\\/turn>").replace("### ", "#\\## ")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(turns: Sequence[tuple[str, str]]) -> tuple[str, list[tuple[int, int, int]]]:
    """The formatted conversation, and (turn, start, end) of each turn's text in it."""
    parts, spans, at = [], [], 0
    for i, (role, text) in enumerate(turns):
        head, body = f"{OPEN}{escape(role).replace(':', chr(92) + ':')}:\n", escape(text)
        spans.append((i, at + len(head), at + len(head) + len(body)))
        parts += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def mask(offsets: Sequence[tuple[int, int]], spans: Sequence[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, first character, character after the last) of what tokens cover of the spans; both lie in order.

    A byte-level vocabulary may split a character over tokens, whose offsets then overlap: the first of them has the
    character, the others are in the mask with nothing.
    """
    start, end = np.array(offsets, np.int64).reshape(-1, 2).T
    a, b = np.array(spans, np.int64).reshape(-1, 2).T
    first, last = np.searchsorted(end, a, "right"), np.searchsorted(start, b, "left")
    count = np.maximum(last - first, 0)
    span = np.repeat(np.arange(len(a)), count)
    token = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
    hi = np.maximum(np.minimum(end[token], b[span]), a[span])
    done = np.maximum.accumulate(hi) if len(hi) else hi  # spans lie apart and in order, so a maximum never reaches a later span
    before = np.concatenate(([0], done[:-1])) if len(hi) else hi
    lo = np.maximum(np.maximum(start[token], a[span]), before)
    return token, lo, np.maximum(done, lo)


def read_back(formatted: str, lo: Sequence[int], hi: Sequence[int]) -> str:
    """The text under a mask, unescaped: neighbouring pieces are joined before that, as a token may end at a backslash."""
    return unescape("".join(formatted[a:b] for a, b in zip(lo, hi, strict=True)))


def _encoder(vocabulary: str) -> Callable:
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(vocabulary)
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text, add_special_tokens=False)


def format_chats(turns: DataFrame, tokenizer_path: str, learn_from: str = "assistant") -> DataFrame:
    """One row per conversation: SCHEMA. turns: conv_id, turn, role, text.

    Turns come in order of turn, then role, then text; null turns first, null role and text as empty. Rows without a
    conv_id are one conversation with a null id. Turns of role `learn_from` are under the mask. Conversations are
    streamed from partitions sorted by (conv_id, turn): a task holds one conversation at a time, which has to be encoded
    as a whole. Repeated rows are turns of their own; an empty table gives an empty result. The vocabulary file is read
    by the driver and goes to the executors with the function.
    """
    vocabulary = Path(tokenizer_path).read_text(encoding="utf-8")
    base = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text_or_empty("role").alias("role"), text_or_empty("text").alias("text"))
    dealt = base.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")

    def row(encode: Callable, conv: int | None, said: list[tuple[str, str]]) -> tuple:
        text, spans = render(said)
        found = encode(text)
        return conv, len(said), text, found.ids, *mask(found.offsets, [(a, b) for i, a, b in spans if said[i][0] == learn_from])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(vocabulary)
        types = [pa.int64(), pa.int64(), pa.string(), *[pa.list_(pa.int32())] * 4]
        names = ["conv_id", "n_turns", "formatted", "token_ids", "mask_token", "mask_start", "mask_end"]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        conv, said, rows, size = None, [], [], 0
        for batch in batches:
            for c, role, text in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                if said and c != conv:
                    rows.append(row(encode, conv, said))
                    size += len(rows[-1][2])
                    said = []
                    if size > 1 << 21:
                        yield batch_of(rows)
                        rows, size = [], 0
                conv = c
                said.append((role, text))
        if said:
            rows.append(row(encode, conv, said))
        if rows:
            yield batch_of(rows)

    return dealt.mapInArrow(run, SCHEMA)


def digest(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_tokens, read back from format_chats' output."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, text, n_tokens, lo, hi in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
                said = parse(text)
                whole = "".join(f"{role}\n{said_}\n" for role, said_ in said)
                loss = read_back(text, lo, hi)
                rows.append((conv, len(said), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text), n_tokens))
            cols = list(zip(*rows, strict=True)) or [()] * 7
            types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens"])

    wanted = formatted.select("conv_id", "formatted", F.size("token_ids").cast("long"), "mask_start", "mask_end")
    return wanted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long")
