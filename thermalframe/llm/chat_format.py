"""Chat formatting by columnar byte assembly.

A conversation becomes ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn. Inside roles and texts a ``<`` before a
``|`` gets a backslash in between (one more if there are some already), and a role's line feeds and backslashes are
escaped, so control strings mark turns only and everything is read back as it was.

Rows are dealt by conversation and sorted by turn (then role and text, for repeated turns); a task streams them.
For each batch the lengths of all headers, contents and inserted backslashes give offsets, and one gather copies
headers and contents into a preallocated buffer. A conversation that crosses a batch goes on in a further part,
so that one of any length is never held whole.

Null roles and texts are empty; a null turn comes first; rows with a null conversation form one conversation. Only
conv_id, turn, role and text are read, so further columns cannot clash. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from thermalframe.llm import text as X
from thermalframe.llm.store import parts

START, END = "<|im_start|>", "<|im_end|>"
HEAD, GAP, TAIL = START.encode(), b"\n", (END + "\n").encode()
FORMATTED = "conv_id long, part long, formatted string, loss array<struct<start:long,length:long>>"


def escape_role(role: str) -> str:
    return role.replace("\\", "\\\\").replace("\n", "\\n").replace("|", "\\p")


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "p": "|"}.get(m[1], m[1]), role)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text) if "<\\" in text else text


def _inserts(data: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Positions after each ``<`` that stands, with any backslashes between, before a ``|`` of the same text."""
    bar = np.flatnonzero(data == ord("|"))
    low = limits[np.searchsorted(limits, bar, "right") - 1]
    at, open_ = bar - 1, np.zeros(len(bar), bool)
    live = at >= low
    while live.any():
        byte = data[np.maximum(at, 0)]
        open_ |= live & (byte == ord("<"))
        live &= byte == ord("\\")
        at = np.where(live, at - 1, at)
        live &= at >= low
    return at[open_] + 1


def _chars(data: np.ndarray) -> np.ndarray:
    """Code points before each byte position."""
    return np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])


def assemble(roles: pa.Array, texts: pa.Array, conv: np.ndarray) -> tuple[pa.Array, list, np.ndarray]:
    """Formatted text and loss spans of each run of equal ``conv``, and the runs' first rows."""
    n = len(texts)
    role_bytes, role_limits = X.flat(roles)
    data, limits = X.flat(texts)
    cut = _inserts(data, limits)
    # sources: constants, roles, texts in one buffer
    fixed = HEAD + GAP + TAIL + b"\\"
    source = np.concatenate([np.frombuffer(fixed, np.uint8), role_bytes, data])
    role_at, text_at = len(fixed), len(fixed) + len(role_bytes)
    # segments of each row: header, role, gap, pieces of the text with a backslash before all but the first, tail
    row_of_cut = np.searchsorted(limits, cut, "right") - 1
    piece_row = np.concatenate([np.arange(n), row_of_cut])
    piece_from = np.concatenate([limits[:-1], cut])
    order = np.lexsort((piece_from, piece_row))
    piece_row, piece_from, cut_piece = piece_row[order], piece_from[order], order >= n
    piece_to = np.append(piece_from[1:], len(data))
    last = np.append(piece_row[1:] != piece_row[:-1], True) if n else np.zeros(0, bool)
    piece_to[last] = limits[1:]
    key, begin, length = [], [], []

    def segments(row, rank, start, size) -> None:
        key.append(row * 8.0 + rank)
        begin.append(np.broadcast_to(start, row.shape))
        length.append(np.broadcast_to(size, row.shape))

    row = np.arange(n)
    segments(row, 0, 0, len(HEAD))
    segments(row, 1, role_at + role_limits[:-1], np.diff(role_limits))
    segments(row, 2, len(HEAD), len(GAP))
    rank = 3 + (np.arange(len(piece_row)) - np.searchsorted(piece_row, piece_row)) / (len(piece_row) + 1)
    segments(piece_row[cut_piece], rank[cut_piece] - 0.25 / (len(piece_row) + 1), len(fixed) - 1, 1)
    segments(piece_row, rank, text_at + piece_from, piece_to - piece_from)
    segments(row, 7, len(HEAD) + len(GAP), len(TAIL))
    order = np.argsort(np.concatenate(key), kind="stable")
    begin, length = np.concatenate(begin)[order], np.concatenate(length)[order]
    offset = np.concatenate([[0], np.cumsum(length)])
    out = source[np.repeat(begin - offset[:-1], length) + np.arange(offset[-1])]
    # rows and runs
    inserted = np.bincount(row_of_cut, minlength=n)
    text_size = np.diff(limits) + inserted
    head_size = len(HEAD) + np.diff(role_limits) + len(GAP)
    row_end = np.cumsum(head_size + text_size + len(TAIL))
    text_end = row_end - len(TAIL)
    run = np.flatnonzero(np.append(True, conv[1:] != conv[:-1])) if n else np.zeros(0, np.int64)
    run_limits = np.concatenate([[0], row_end[np.append(run[1:], n) - 1]]) if n else np.zeros(1, np.int64)
    chars = _chars(out)
    learn = np.array([r == "assistant" for r in roles.to_pylist()], bool)
    first_char = chars[run_limits[np.searchsorted(run, row, "right") - 1]] if n else row
    start = chars[text_end - text_size] - first_char
    size = chars[text_end] - chars[text_end - text_size]
    spans = [[{"start": int(start[i]), "length": int(size[i])} for i in range(a, b) if learn[i]]
             for a, b in zip(run.tolist(), [*run[1:].tolist(), n])]
    text = pa.LargeStringArray.from_buffers(len(run), pa.py_buffer(run_limits.astype(np.int64)), pa.py_buffer(out))
    return text, spans, run


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, part = None, 0
    for batch in X.slices(batches):
        ids = batch.column("conv_id").to_pylist()
        group = np.cumsum([i > 0 and ids[i] != ids[i - 1] for i in range(len(ids))])
        roles = pa.array([escape_role(r or "") for r in batch.column("role").to_pylist()], pa.string())
        text, spans, run = assemble(roles, batch.column("text"), group)
        keys = [ids[i] for i in run.tolist()]
        numbers = []
        for key in keys:
            part = part + 1 if at == (key,) else 0
            at = (key,)
            numbers.append(part)
        yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(numbers, pa.int64()), text.cast(pa.string()),
                               pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))],
                              ["conv_id", "part", "formatted", "loss"])


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, part, formatted, loss) with parts of a conversation in order, in one task, one after another.

    ``loss`` lists the code-point spans of the assistant's texts inside ``formatted``.
    """
    rows = turns.select("conv_id", "turn", "role", "text")
    return (rows.repartition(parts(turns.sparkSession), "conv_id")
            .sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn").mapInArrow(_format, FORMATTED))


def parse(formatted: str) -> list[tuple[str, str]]:
    """Turns (role, text) of a formatted part."""
    turns = []
    for piece in formatted.split(END + "\n")[:-1]:
        role, _, text = piece.removeprefix(START).partition("\n")
        turns.append((unescape_role(role), unescape(text)))
    return turns


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, state, done = None, None, []

    def out() -> pa.RecordBatch:
        columns = list(zip(*done)) or [()] * 6
        types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
        done.clear()
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names)

    def close() -> None:
        if state:
            done.append((at[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

    for batch in batches:
        for conv, formatted, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss"))):
            if at != (conv,):
                close()
                at, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text in parse(formatted):
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
            for span in loss:
                text = unescape(formatted[span["start"]:span["start"] + span["length"]])
                state[2] += len(text)
                state[3].update(text.encode())
            state[4] += len(formatted)
        yield out()
    close()
    yield out()


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of every conversation, from the output of ``format_chats`` alone; its parts are streamed."""
    return formatted.select("conv_id", "formatted", "loss").mapInArrow(
        _read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
