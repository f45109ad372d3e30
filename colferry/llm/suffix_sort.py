"""External induced sorting of suffixes, with common-prefix values, up to a given depth.

Suffixes that begin below their successor after one above it (S*) are put in order first; one sweep over the leading
bytes upwards induces the L-suffixes from them, one sweep downwards the S-suffixes. A suffix that a sweep induces
goes to the queue of its leading byte; as sources come in order, so do the entries of each queue, and the 256 queues
together are a monotone priority queue. They, the L-lists and the parts of the S* sort go to disk beyond a budget.
Each entry carries its position and the common prefix with the entry before it: one more than the least such value
among the sources since the last push to the same queue (found by a sparse table of minima, a block at a time).

The order of the S*-suffixes is found by recursive radix partition (to disk, byte by byte, while a part is larger
than the budget) and by words of 8 bytes within a part; as only `depth` bytes count, that ends after depth / 8 words.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np

ENTRY = np.dtype([("pos", "<i8"), ("lcp", "u1")])
BLOCK = 1 << 18


class Store:
    """Memory budget (bytes) and folder shared by queues."""

    def __init__(self, folder: str | None = None, budget: int = 64 << 20) -> None:
        base = folder or os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None
        self.folder = tempfile.mkdtemp(prefix="suffixes-", dir=base)
        self.budget, self.held, self.files = budget, 0, 0

    def close(self) -> None:
        shutil.rmtree(self.folder, ignore_errors=True)

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


class Queue:
    """Arrays in order of arrival; in memory while the store's budget lasts, else in a file."""

    def __init__(self, store: Store, dtype=ENTRY) -> None:
        self.store, self.dtype = store, np.dtype(dtype)
        self.parts: list = []
        self.path: str | None = None
        self.size = 0

    def add(self, data: np.ndarray) -> None:
        if not len(data):
            return
        self.size += len(data)
        if self.store.held + data.nbytes <= self.store.budget:
            self.store.held += data.nbytes
            self.parts.append(data)
            return
        if self.path is None:
            self.store.files += 1
            self.path = os.path.join(self.store.folder, str(self.store.files))
        with open(self.path, "ab") as f:
            at = f.tell()
            f.write(data.tobytes())
        self.parts.append((at, len(data)))

    def read(self, k: int) -> np.ndarray:
        part = self.parts[k]
        if isinstance(part, np.ndarray):
            return part
        with open(self.path, "rb") as f:
            f.seek(part[0])
            return np.frombuffer(f.read(part[1] * self.dtype.itemsize), self.dtype)

    def take(self) -> Iterator[np.ndarray]:
        """All that is there, about a block at a time, with what is added meanwhile; each part is let go."""
        k = 0
        while k < len(self.parts):
            some, n = [], 0
            while k < len(self.parts) and n < BLOCK:
                some.append(self.read(k))
                n += len(some[-1])
                if isinstance(self.parts[k], np.ndarray):
                    self.store.held -= some[-1].nbytes
                self.parts[k] = None
                k += 1
            yield np.concatenate(some) if len(some) > 1 else some[0]
        self.drop()

    def backwards(self) -> Iterator[np.ndarray]:
        """All entries from the last to the first, about a block at a time."""
        k = len(self.parts)
        while k:
            some, n = [], 0
            while k and n < BLOCK:
                k -= 1
                some.append(self.read(k)[::-1])
                n += len(some[-1])
            yield np.concatenate(some) if len(some) > 1 else some[0]

    def drop(self) -> None:
        self.store.held -= sum(p.nbytes for p in self.parts if isinstance(p, np.ndarray))
        self.parts, self.size = [], 0
        if self.path:
            os.remove(self.path)
            self.path = None


def words(text: np.ndarray, pos: np.ndarray, at: int) -> np.ndarray:
    """The 8 bytes from pos + at on as big-endian numbers."""
    view = np.lib.stride_tricks.sliding_window_view(text, 8)
    return np.ascontiguousarray(view[pos + at]).view(">u8").ravel().astype(np.uint64)


def s_star(text: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """Positions of S*-suffixes, from the end on, in blocks; text[n:] is padding."""
    carry = False  # is the suffix after the block an S-suffix; the end counts as L
    after = np.int16(-1)
    held: int | None = None
    for low in range((n - 1) // BLOCK * BLOCK, -1, -BLOCK):
        t = text[low : min(n, low + BLOCK)].astype(np.int16)
        step = np.append(t[1:], after) - t
        known = np.where(step != 0, np.arange(len(t)), len(t))
        known = np.minimum.accumulate(known[::-1])[::-1]
        s = np.where(known < len(t), step[np.minimum(known, len(t) - 1)] > 0, carry)
        if held is not None:  # the first of the block above is S; S* if this block's last is L
            if not s[-1]:
                yield np.array([held], np.int64)
            held = None
        star = np.flatnonzero(s[1:] & ~s[:-1]) + 1
        if len(star):
            yield (star + low)[::-1].astype(np.int64)
        held = low if s[0] else None
        carry, after = bool(s[0]), t[0]


def _sorted(text: np.ndarray, pos: np.ndarray, depth: int) -> np.ndarray:
    """Entries of these positions in order of their first `depth` bytes (ties: as they come)."""
    n = len(pos)
    key = words(text, pos, 0)
    order = np.argsort(key, kind="stable")
    pos, key = pos[order], key[order]
    lcp = np.full(n, depth, np.uint8)
    if n:
        lcp[0] = 0

    def settle(at: np.ndarray, x: np.ndarray, w: int) -> None:
        """Common prefixes of neighbours that differ in word w; x: their exclusive or."""
        top = np.zeros(len(x), np.int64)
        for shift in (32, 16, 8):  # zero bytes in front
            small = (x >> np.uint64(64 - shift)) == 0 if shift < 64 else x == 0
            top += np.where(small, shift // 8, 0)
            x = np.where(small, x << np.uint64(shift), x)
        lcp[at] = np.minimum(depth, 8 * w + top)

    differ = np.flatnonzero(key[1:] != key[:-1]) + 1
    settle(differ, key[differ] ^ key[differ - 1], 0)
    for w in range(1, -(-depth // 8)):
        tied = np.zeros(n + 1, bool)  # equal to the entry before so far
        tied[1:n] = (lcp[1:] == depth) if n else False
        at = np.flatnonzero(tied[:n] | tied[1:])
        if not len(at):
            break
        group = np.cumsum(~tied[at])
        key = words(text, pos[at], 8 * w)
        order = np.lexsort((key, group))
        pos[at], key = pos[at[order]], key[order]
        inner = np.flatnonzero(tied[at])
        inner = inner[key[inner] != key[inner - 1]]
        settle(at[inner], key[inner] ^ key[inner - 1], w)
    out = np.empty(n, ENTRY)
    out["pos"], out["lcp"] = pos, lcp
    return out


def _common(text: np.ndarray, p: int, q: int, depth: int) -> int:
    a, b = text[p : p + depth], text[q : q + depth]
    unlike = np.flatnonzero(a != b)
    return int(unlike[0]) if len(unlike) else depth


def _order_stars(text: np.ndarray, parts: Iterator[np.ndarray], store: Store, depth: int, limit: int, level: int = 0) -> Iterator[tuple[int, np.ndarray]]:
    """(leading byte, entries) in order; parts above the limit are partitioned by their next byte, on disk."""
    queues = [Queue(store, np.int64) for _ in range(256)]
    for pos in parts:
        lead = text[pos + level]
        order = np.argsort(lead, kind="stable")
        cuts = np.searchsorted(lead[order], np.arange(257))
        for c in np.unique(lead).tolist():
            queues[c].add(pos[order[cuts[c] : cuts[c + 1]]])
    for c, q in enumerate(queues):
        if not q.size:
            continue
        if q.size <= limit or level + 1 >= depth:
            for_one = [p for p in q.take()]
            yield c, _sorted(text, np.concatenate(for_one), depth)
        else:
            for _, entries in _order_stars(text, q.take(), store, depth, limit, level + 1):
                yield c, entries


class _Push:
    """Sends the predecessors of a block of sources to their queues, with common-prefix values."""

    def __init__(self, text: np.ndarray, depth: int, queues: list[Queue]) -> None:
        self.text, self.depth, self.queues = text, depth, queues
        self.run = np.zeros(256, np.uint8)  # least value since the last push to each queue

    def block(self, pos: np.ndarray, lcp: np.ndarray, lead: np.ndarray, send: np.ndarray) -> None:
        """lead: byte before each source; send: whether its predecessor is induced here. lcp: to the source before."""
        n = len(pos)
        at = np.flatnonzero(send)
        total = lcp.min()
        if not len(at):
            np.minimum(self.run, total, out=self.run)
            return
        c = lead[at]
        order = np.argsort(c, kind="stable")
        at, c = at[order], c[order]
        first = np.ones(len(at), bool)
        first[1:] = c[1:] != c[:-1]
        start = np.where(first, 0, np.append(0, at[:-1] + 1))
        length = at - start + 1
        level = (np.frexp(length.astype(np.float64))[1] - 1).astype(np.int64)
        value = np.empty(len(at), np.uint8)
        table, width = lcp, 1
        for k in range(int(level.max()) + 1):
            own = np.flatnonzero(level == k)
            if len(own):
                value[own] = np.minimum(table[start[own]], table[at[own] - width + 1])
            if k < level.max():
                table = np.minimum(table[:-width], table[width:]) if len(table) > width else table
                width *= 2
        heads = np.flatnonzero(first)
        value[heads] = np.minimum(value[heads], self.run[c[heads]])
        suffix = np.append(np.minimum.accumulate(lcp[::-1])[::-1], self.depth).astype(np.uint8)
        np.minimum(self.run, total, out=self.run)
        ends = np.append(heads[1:], len(at))
        self.run[c[heads]] = suffix[at[ends - 1] + 1]
        entries = np.empty(len(at), ENTRY)
        entries["pos"] = pos[at] - 1
        entries["lcp"] = np.minimum(self.depth, value.astype(np.int64) + 1)
        for lo, hi in zip(heads.tolist(), ends.tolist()):
            self.queues[int(c[lo])].add(entries[lo:hi])


def suffixes(text: bytes | np.ndarray, depth: int, store: Store, limit: int = 1 << 20) -> Iterator[np.ndarray]:
    """Entries of all suffixes, largest first, in blocks: position, and common prefix (up to depth) with the entry before.

    The order is exact on the first depth bytes. limit: S*-suffixes sorted at once.
    """
    data = np.frombuffer(text, np.uint8) if isinstance(text, bytes) else text
    n = len(data)
    if not n:
        return
    if isinstance(data, np.memmap):
        padded = data  # whoever maps a file pads it
        n -= depth + 8
    else:
        padded = np.concatenate([data, np.zeros(depth + 8, np.uint8)])
    stars: list[Queue] = [Queue(store) for _ in range(256)]
    for c, entries in _order_stars(padded, s_star(padded, n), store, depth, limit):
        entries = entries.copy()
        if stars[c].size:  # parts of one leading byte follow each other
            last = stars[c].read(len(stars[c].parts) - 1)[-1]
            entries["lcp"][0] = _common(padded, int(last["pos"]), int(entries["pos"][0]), depth)
        stars[c].add(entries)

    lists = [Queue(store) for _ in range(256)]
    queues = [Queue(store) for _ in range(256)]
    push = _Push(padded, depth, queues)

    def lead_of(pos: np.ndarray) -> np.ndarray:
        return padded[np.maximum(pos - 1, 0)]

    # upwards: the end of the text is the first source
    push.block(np.array([n]), np.zeros(1, np.uint8), padded[n - 1 : n], np.ones(1, bool))
    for c in range(256):
        last = None
        for data in queues[c].take():
            for at in range(0, len(data), BLOCK):
                e = data[at : at + BLOCK].copy()
                if last is None:
                    e["lcp"][0] = 0
                last = int(e["pos"][-1])
                lists[c].add(e)
                lead = lead_of(e["pos"])
                push.block(e["pos"], e["lcp"], lead, (lead >= c) & (e["pos"] > 0))
        for data in stars[c].take():
            e = data.copy()
            if last is not None:
                e["lcp"][0] = _common(padded, last, int(e["pos"][0]), depth)
            last = int(e["pos"][-1])
            for at in range(0, len(e), BLOCK):
                b = e[at : at + BLOCK]
                lead = lead_of(b["pos"])
                push.block(b["pos"], b["lcp"], lead, (lead > c) & (b["pos"] > 0))
    # downwards
    queues = [Queue(store) for _ in range(256)]
    push = _Push(padded, depth, queues)
    for c in range(255, -1, -1):
        last = None
        for data in queues[c].take():
            for at in range(0, len(data), BLOCK):
                e = data[at : at + BLOCK].copy()
                if last is None:
                    e["lcp"][0] = 0
                last = int(e["pos"][-1])
                yield e
                lead = lead_of(e["pos"])
                push.block(e["pos"], e["lcp"], lead, (lead <= c) & (e["pos"] > 0))
        above: np.ndarray | None = None  # lcp of the entry above with the one below it, carried over parts
        for e in lists[c].backwards():
            e = e.copy()
            down = np.empty(len(e), np.uint8)
            down[1:] = e["lcp"][:-1]
            down[0] = above if above is not None else 0 if last is None else _common(padded, last, int(e["pos"][0]), depth)
            above = e["lcp"][-1]
            e["lcp"] = down
            last = int(e["pos"][-1])
            for at in range(0, len(e), BLOCK):
                b = e[at : at + BLOCK]
                yield b
                lead = lead_of(b["pos"])
                push.block(b["pos"], b["lcp"], lead, (lead < c) & (b["pos"] > 0))
        lists[c].drop()
