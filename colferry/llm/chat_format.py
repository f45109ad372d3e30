"""Chat formatting on tokens: segments are encoded by themselves, reserved ids spliced between, masks summed up.

A turn is [role id] text ids [end id]; as text `### Role:\\n` text `\\n</turn>\\n`. A role other than the four known
ones is [other id] role ids [colon id]. Content cannot make a reserved id, as it is encoded as ordinary text, and a
control string inside it gets one backslash more before it, which reading back takes off again. A control string of
the template never has a backslash before it: a newline or, where a role of another name ends, a space always does;
so the shown text alone can be read back, too. The loss mask is the prefix sum of +1 where an
assistant text begins and -1 where it ends.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from colferry.llm.common import byte_bpe, slices, small_batches

ROLES = ("system", "user", "assistant", "tool")
FIRST_ID = 50257
ROLE_ID = {role: FIRST_ID + k for k, role in enumerate(ROLES)}
OTHER, COLON, END = FIRST_ID + 4, FIRST_ID + 5, FIRST_ID + 6
SHOWN = {i: f"### {r.capitalize()}:\n" for r, i in ROLE_ID.items()} | {OTHER: "### [", COLON: " ]:\n", END: "\n</turn>\n"}
_CONTROL = r"(?=### (?:System|User|Assistant|Tool):|### \[|\]:\n|</turn>|<\|)"
_ESCAPE, _UNESCAPE = re.compile(r"(?<!\\)(\\*)" + _CONTROL), re.compile(r"\\(\\*)" + _CONTROL)


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\\\1", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def encode_turn(role: str, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids and loss mask of one turn."""
    enc = byte_bpe()
    ids = lambda s: np.asarray(enc.encode_ordinary(escape(s)), np.int32)
    head = np.array([ROLE_ID[role]], np.int32) if role in ROLE_ID else np.concatenate([[OTHER], ids(role), [COLON]]).astype(np.int32)
    body = ids(text)
    steps = np.zeros(len(head) + len(body) + 2, np.int32)
    if role == "assistant":
        steps[len(head)] += 1
        steps[len(head) + len(body)] -= 1
    return np.concatenate([head, body, np.array([END], np.int32)]), np.cumsum(steps[:-1]).astype(np.int8)


def show(ids: np.ndarray) -> str:
    """The formatted text of whole turns."""
    out, enc = [], byte_bpe()
    marks = np.flatnonzero(ids >= FIRST_ID)
    at = 0
    for m in [*marks.tolist(), len(ids)]:
        out.append(enc.decode_bytes(ids[at:m].tolist()).decode("utf-8"))
        if m < len(ids):
            out.append(SHOWN[int(ids[m])])
        at = m + 1
    return "".join(out)


def read_turn(ids: np.ndarray) -> tuple[str, str]:
    """Role and text of one turn, read back from its ids."""
    enc = byte_bpe()
    text = lambda part: unescape(enc.decode_bytes(part.tolist()).decode("utf-8"))
    if ids[0] == OTHER:
        colon = int(np.flatnonzero(ids == COLON)[0])
        return text(ids[1:colon]), text(ids[colon + 1 : -1])
    return ROLES[int(ids[0]) - FIRST_ID], text(ids[1:-1])


SCHEMA = "conv_id long, turn long, formatted string, ids array<int>, mask array<byte>, start long"


def format_turns(conversations: DataFrame) -> DataFrame:
    """A row per turn: conv_id, turn, formatted text, ids, loss mask, start (the conversation's ids before it).

    A conversation's turns come in order of turn (null first; ties by role, then text), in one partition, and stream
    through it, so that one of any length takes bounded memory. Null text or role: empty. Rows with a null conv_id
    make one conversation; repeated rows are turns each; an empty table gives none; other columns are not read.
    Lone surrogates, which UTF-8 cannot hold, do not occur in Spark strings.
    """

    def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, start = object(), 0
        for whole in batches:
            for batch in slices(whole):
                cols: list[list] = [[], [], [], []]
                for conv, role, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                    if conv != last:
                        last, start = conv, 0
                    ids, mask = encode_turn(role or "", text or "")
                    for c, x in zip(cols, (show(ids), ids, mask, start)):
                        c.append(x)
                    start += len(ids)
                lists = lambda rows, kind: pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), pa.array(np.concatenate([*rows, np.zeros(0, rows[0].dtype if rows else np.int32)]), kind))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cols[0], pa.string()), lists(cols[1], pa.int32()), lists(cols[2], pa.int8()), pa.array(cols[3], pa.int64())], names=["conv_id", "turn", "formatted", "ids", "mask", "start"])

    src = small_batches(conversations).select(*[conversations[c].cast(t) for c, t in (("conv_id", "long"), ("turn", "long"), ("role", "string"), ("text", "string"))])
    return src.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(turns, SCHEMA)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(turns: DataFrame) -> DataFrame:
    """Digest of each conversation, from what format_turns returns (in its order): ids and masks are decoded again."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = object(), None
        out: list[tuple] = []
        close = lambda: out.append((last, own[0], own[1].hexdigest(), own[2], own[3].hexdigest(), own[4]))
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))], names=[c.split()[0] for c in DIGEST.split(", ")])
        for whole in batches:
            for batch in slices(whole):
                ends = np.cumsum(batch.column(3).value_lengths().to_numpy())
                ids_of, mask_of = (np.split(batch.column(c).flatten().to_numpy(), ends[:-1]) for c in (3, 4))
                for conv, formatted, ids, mask in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), ids_of, mask_of):
                    if conv != last:
                        if own:
                            close()
                        last, own = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                    role, text = read_turn(ids)
                    own[0] += 1
                    own[1].update(f"{role}\n{text}\n".encode())
                    loss = unescape(byte_bpe().decode_bytes(ids[mask > 0].tolist()).decode("utf-8"))
                    own[2] += len(loss)
                    own[3].update(loss.encode())
                    own[4] += len(formatted)
                if out:
                    yield pack()
                    out.clear()
        if own:
            close()
            yield pack()

    return turns.mapInArrow(digest, DIGEST)
