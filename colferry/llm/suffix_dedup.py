"""Removal of repeated byte strings across documents, by suffix sorting in shards.

A string of MATCH bytes belongs to the shard of its anchor: the place in it whose K bytes have the least hash. Equal
strings have equal anchors, so each shard holds all copies of its strings, and shards are independent. Only anchors
that occur twice in the corpus matter; the text around them (so long that every string with that anchor lies in it)
is what a shard sorts, by external induced sorting. Neighbours with a common prefix of MATCH bytes form a run of
equal strings, of which all but the first in the corpus are covered.

A string of MATCH bytes also holds the BESIDE bytes before its anchor or those behind it. So an anchor counts by its
two longer strings, and what is common but short (a licence line) brings no text into any shard.

Whole copies of a document are told by their hash first, and only the first of them goes on. Shuffled are then: two
hashes an anchor (copies within a batch are told at once and sent once), the places of repeated anchors, the documents
that have such places, and the segments of text around them, each distinct text once a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colferry.llm.common import Scratch, free_name, slices, small_batches
from colferry.llm.suffix_sort import Store, suffixes

MATCH, K = 100, 32
#: K-byte places in a string; bytes beside an anchor that its two longer strings have.
WINDOW, BESIDE = MATCH - K + 1, (MATCH - K) // 2
#: Bytes of segments that a shard is planned for, and that a task keeps to tell copies before it sends them.
SHARD_BYTES, HELD_BYTES = 8 << 20, 16 << 20
#: Bytes of a shard's text, and segments to tell copies among, that a task keeps in memory.
MEMORY_BYTES, KNOWN = 48 << 20, 400_000
#: Tables of spans up to this size are broadcast; larger ones are joined by shuffle.
BROADCAST_BYTES = 32 << 20
#: Whole copies up to which their ids (16 bytes) are broadcast.
BROADCAST_COPIES = 1 << 20
#: Documents with repeated places up to which their ids are broadcast (8 bytes each), so that others' texts aren't shuffled.
BROADCAST_DOCS = 1 << 21
#: Bytes of text to a bucket in which anchors are told apart; a task holds one bucket at a time.
BUCKET_BYTES = 4 << 20
#: Documents without an id come after all others, by 62 bits of their text's hash.
NULL_ID = 1 << 62
_MIX = np.random.default_rng(100).integers(0, 1 << 64, 256, np.uint64) | np.uint64(1)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the K bytes from each place on."""
    with np.errstate(over="ignore"):
        h, width = _MIX[data], 1
        while width < K:
            h = h[:-width] * _ODD + (h[width:] ^ (h[:-width] >> np.uint64(29)))
            width *= 2
        h ^= h >> np.uint64(32)
        return h * _ODD


def _sliding(x: np.ndarray, width: int, op: np.ufunc) -> np.ndarray:
    done = 1
    while done * 2 <= width:
        x = op(x[:-done], x[done:])
        done *= 2
    return op(x[: len(x) - (width - done)], x[width - done :]) if done < width else x


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(all hashes, places of anchors): the least hash of a string, all of them if several are equal."""
    if len(data) < MATCH:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = hashes(data)
    least = _sliding(h, WINDOW, np.minimum)
    edge = np.zeros(WINDOW - 1, np.uint64)
    most = _sliding(np.concatenate([edge, least, edge]), WINDOW, np.maximum)
    return h, np.flatnonzero(most == h)


def sides(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, codes) of the anchors' longer strings: code 2 p of the one before p, 2 p + 1 of the one behind it.

    K-byte hashes at three places cover each of them.
    """
    left, right = at[at >= BESIDE], at[at + BESIDE < len(h)]
    with np.errstate(over="ignore"):
        a = (h[left] * _ODD ^ h[left - BESIDE]) * _ODD + h[left - BESIDE + K]
        b = (h[right] * _ODD ^ h[right + BESIDE]) * _ODD - h[right + K]
        both = np.concatenate([a ^ a >> np.uint64(31), ~(b ^ b >> np.uint64(31))]) * _ODD
    return both, np.concatenate([2 * left, 2 * right + 1])


def reach(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last start of the strings whose anchor is at each place."""
    low, high = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
    pad = np.concatenate([np.full(WINDOW, ~np.uint64(0)), h, np.full(WINDOW, ~np.uint64(0))])
    view = np.lib.stride_tricks.sliding_window_view(pad, WINDOW)
    for k in range(0, len(at), 4096):
        p = at[k : k + 4096]
        before = view[p + 1][:, ::-1] < h[p][:, None]  # the places p, p - 1, ...
        after = view[p + WINDOW] < h[p][:, None]  # the places p, p + 1, ...
        left = np.where(before.any(1), before.argmax(1), WINDOW)
        right = np.where(after.any(1), after.argmax(1), WINDOW)
        low[k : k + 4096] = p - left + 1
        high[k : k + 4096] = p + right - WINDOW
    return np.maximum(low, 0), np.minimum(high, len(h) - WINDOW)


def _key(id_col: Column, text_col: Column) -> Column:
    return F.coalesce(id_col.cast("long"), F.xxhash64(F.coalesce(text_col, F.lit(""))).bitwiseAND(F.lit(NULL_ID - 1)).bitwiseOR(F.lit(NULL_ID)))


def _rows(kinds: str, *cols) -> pa.RecordBatch:
    types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    names = [c.split() for c in kinds.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(cols, names)], names=[n for n, _ in names])


ANCHOR = np.dtype([("hash", "<u8"), ("doc", "<i8"), ("at", "<i8"), ("twice", "u1")])
SENT = "bucket int, anchors binary"
PLACES = "doc long, at long"
SEGMENTS = "shard int, doc long, version long, start long, starts int, segment binary"
COVERED = "doc long, version long, start long, end long"


def repeated_places(docs: DataFrame, buckets: int) -> DataFrame:
    """(doc, at) of the anchors' longer strings that occur at least twice; at: their codes."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                found = []
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    h, at = anchors(np.frombuffer((text or "").encode(), np.uint8))
                    keys, codes = sides(h, at)
                    rows = np.zeros(len(codes), ANCHOR)
                    rows["hash"], rows["doc"], rows["at"] = keys, doc, codes
                    found.append(rows)
                rows = np.concatenate(found) if found else np.zeros(0, ANCHOR)
                if not len(rows):
                    continue
                order = np.argsort(rows["hash"], kind="stable")
                h = rows["hash"][order]
                first = np.append(True, h[1:] != h[:-1])
                again = order[~first]
                twice = np.append(~first[1:], False) & first
                rows["twice"][order[twice]] = 1
                send = rows[order[first]]
                bucket = (send["hash"] >> np.uint64(33)).astype(np.int64) % buckets
                by = np.argsort(bucket, kind="stable")
                cuts = np.searchsorted(bucket[by], np.arange(buckets + 1))
                some = np.flatnonzero(cuts[1:] > cuts[:-1])
                blobs = [send[by[cuts[b] : cuts[b + 1]]].tobytes() for b in some]
                # copies within the batch are known to be repeated: they go along, wherever there is room
                rows["twice"][again] = 2
                rest = [rows[again[k : k + 4096]].tobytes() for k in range(0, len(again), 4096)]
                begin = int(rows["hash"][0] % np.uint64(buckets))
                yield _rows(SENT, [*some.tolist(), *((begin + k) % buckets for k in range(len(rest)))], [*blobs, *rest])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []

        def settle() -> pa.RecordBatch:
            rows = np.concatenate(held)
            order = np.argsort(rows["hash"], kind="stable")
            h = rows["hash"][order]
            same = np.append(h[1:] == h[:-1], False)
            keep = same | np.append(False, same[:-1])
            rows = rows[order[keep | (rows["twice"][order] > 0)]]
            return _rows(PLACES, rows["doc"], rows["at"])

        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if bucket != last and held:
                    yield settle()
                    held = []
                last = bucket
                rows = np.frombuffer(blob, ANCHOR)
                if rows[0]["twice"] == 2:
                    yield _rows(PLACES, rows["doc"], rows["at"])
                else:
                    held.append(rows)
        if held:
            yield settle()

    return docs.mapInArrow(find, SENT).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(count, PLACES)


def merged(doc: np.ndarray, version: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spans of bytes, with those of one document that touch or overlap as one."""
    if not len(doc):
        return doc, version, start, end
    order = np.lexsort((start, version, doc))
    doc, version, start, end = doc[order], version[order], start[order], end[order]
    other = np.append(True, (doc[1:] != doc[:-1]) | (version[1:] != version[:-1]))
    group = np.cumsum(other)
    far = int(end.max()) + 1
    reach = np.maximum.accumulate(end + group * far) - group * far  # the furthest end in the document so far
    new = other | np.append(True, start[1:] > reach[:-1])
    at = np.flatnonzero(new)
    return doc[at], version[at], start[at], reach[np.append(at[1:] - 1, len(doc) - 1)]


def segments(docs: DataFrame, shards: int) -> DataFrame:
    """Text around the given places (column places) of each document, by shard; copies within a task are sent once,
    and come back as spans that are covered already (shard -1, without text)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple] = {}  # text -> shard, doc, version, start, starts of its first copy
        size = 0
        extra: list[tuple] = []

        def send() -> pa.RecordBatch:
            told = np.array(extra, np.int64).reshape(-1, 4)
            doc, version, start, end = merged(told[:, 0], told[:, 1], told[:, 2], told[:, 2] + told[:, 3] - 1 + MATCH)
            n = len(doc)
            own = list(zip(*held.values())) or [[]] * 5
            cols = [np.append(np.asarray(x, np.int64), y) for x, y in zip(own, (np.full(n, -1), doc, version, start, end - start - MATCH + 1))]
            return _rows(SEGMENTS, *cols, [*held, *[b""] * n])

        for whole in batches:
            for batch in slices(whole, 4 << 20):
                columns = [batch.column(c).to_pylist() for c in range(3)]
                places, ends = batch.column(3).flatten().to_numpy(), np.append(0, np.cumsum(batch.column(3).value_lengths().to_numpy()))
                for k, (doc, text, version) in enumerate(zip(*columns)):
                    raw = text.encode()
                    h, at = anchors(np.frombuffer(raw, np.uint8))
                    own = places[ends[k] : ends[k + 1]]
                    before, behind = np.isin(2 * at, own), np.isin(2 * at + 1, own)
                    at, before, behind = (x[before | behind] for x in (at, before, behind))
                    low, high = reach(h, at)
                    high = np.where(behind, high, np.minimum(high, at - BESIDE))
                    low = np.where(before, low, np.maximum(low, at - BESIDE + 1))
                    at, low, high = (x[low <= high] for x in (at, low, high))
                    shard = (h[at] >> np.uint64(20)).astype(np.int64) % shards
                    for s, a, n in zip(shard.tolist(), low.tolist(), (high - low + 1).tolist()):
                        piece = raw[a : a + n - 1 + MATCH]
                        this = (s, doc, version, a, n)
                        other = held.get(piece)
                        if other is None:
                            held[piece] = this
                            size += len(piece) + 250
                        elif this[1:4] != other[1:4]:
                            if this[1:4] < other[1:4]:
                                held[piece], this = this, other
                            extra.append(this[1:])
                            size += 150
                if size > HELD_BYTES:
                    yield send()
                    held.clear()
                    extra.clear()
                    size = 0
        if held or extra:
            yield send()

    return docs.mapInArrow(cut, SEGMENTS)


RUN = np.dtype([("start", "<i8"), ("end", "<i8")])
OWNER = np.dtype([("doc", "<i8"), ("version", "<i8"), ("start", "<i8"), ("starts", "<i4"), ("at", "<i8")])


def covered_by(owners: np.ndarray, text: np.ndarray, folder: str | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(owner, start in the document) of strings of MATCH bytes that also start earlier, among the owners' segments."""
    begins = owners["at"]
    with Store(folder) as store:
        carry: list[tuple] = []  # first string of a run that goes on in the next block
        last = None  # the entry before, which may begin a run
        for entries in suffixes(text, MATCH, store):
            if last is not None:
                entries = np.concatenate([last, entries])
            last = entries[-1:].copy()
            goes_on = np.append(entries["lcp"][1:] >= MATCH, False)
            shared = goes_on | (entries["lcp"] >= MATCH)  # of an entry alone there is nothing to tell
            shared[-1] = False  # it comes again
            # a run goes on where the common prefix is whole; places that start no string of ours are passed over
            run = np.cumsum(entries["lcp"] < MATCH)
            open_run = run[-1]
            pos, run = entries["pos"][shared], run[shared]
            own = np.searchsorted(begins, pos, "right") - 1
            offset = pos - begins[own]
            valid = offset < owners["starts"][own]
            own, start, run = own[valid], (owners["start"][own] + offset)[valid], run[valid]
            if carry:
                first_run = 0 if entries["lcp"][0] >= MATCH else -1
                held = carry.pop()
                own, start, run = (np.concatenate([c, x]) for c, x in zip((*held, np.full(1, first_run)), (own, start, run)))
            if not len(own):
                continue
            first, later = _split(owners, own, start, run)
            keep = first[run[first] == open_run]
            if len(keep):
                carry.append((own[keep], start[keep]))
            if len(later):
                yield own[later], start[later]
        if last is not None and carry and last["lcp"][0] >= MATCH:
            own = np.searchsorted(begins, last["pos"], "right") - 1
            offset = last["pos"] - begins[own]
            if offset[0] < owners["starts"][own][0]:
                held = carry.pop()
                own, start = np.append(held[0], own), np.append(held[1], owners["start"][own] + offset)
                _, later = _split(owners, own, start, np.zeros(2, np.int64))
                if len(later):
                    yield own[later], start[later]


def _split(owners: np.ndarray, own: np.ndarray, start: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the first string of each run, and of those that start later."""
    doc, version = owners["doc"][own], owners["version"][own]
    order = np.lexsort((start, version, doc, run))
    new = np.append(True, run[order[1:]] != run[order[:-1]])
    head = order[np.maximum.accumulate(np.where(new, np.arange(len(run)), 0))]
    later = (start[order] != start[head]) | (doc[order] != doc[head]) | (version[order] != version[head])
    return order[new], order[later]


class Shard:
    """Segments of a shard: text in memory, or in a file where Spark spills, beyond MEMORY_BYTES.

    Copies among the first KNOWN segments are told at once; later ones are left to the sort.
    """

    def __init__(self) -> None:
        self.known: dict[bytes, list] = {}
        self.owners: list[np.ndarray] = []
        self.rest: list[tuple] = []
        self.chunks: list[bytes] = []
        self.held = self.size = 0
        self.store: Store | None = None

    def add(self, doc: int, version: int, start: int, starts: int, piece: bytes) -> tuple | None:
        """A copy that starts later than another of the same text, if there is one."""
        name = xxhash.xxh3_128_digest(piece)
        other = self.known.get(name)
        if other is not None:
            if (doc, version, start) == tuple(other[:3]):
                return None
            if (doc, version, start) < tuple(other[:3]):
                later = (*other[:3], starts)
                other[:3] = doc, version, start
                return later
            return doc, version, start, starts
        own = [doc, version, start, starts, self.size]
        if len(self.known) < KNOWN:
            self.known[name] = own
        else:
            self.rest.append(tuple(own))
            if len(self.rest) >= KNOWN:
                self.owners.append(np.array(self.rest, OWNER))
                self.rest.clear()
        self.chunks.append(piece)
        self.size += len(piece)
        self.held += len(piece)
        if self.held > MEMORY_BYTES:
            self._spill()
        return None

    def _spill(self) -> None:
        self.store = self.store or Store()
        with open(f"{self.store.folder}/text", "ab") as f:
            f.write(b"".join(self.chunks))
        self.chunks.clear()
        self.held = 0

    def close(self) -> tuple[np.ndarray, np.ndarray]:
        """Owners in order of their text, and the text; a mapped file is padded, as the sort wants it."""
        owners = np.concatenate([np.array([tuple(v) for v in self.known.values()], OWNER), *self.owners, np.array(self.rest, OWNER)])
        self.known.clear()
        if self.store is None:
            text = np.frombuffer(b"".join(self.chunks), np.uint8)
            self.chunks.clear()
            return owners, text
        self.chunks.append(bytes(MATCH + 8))
        self._spill()
        return owners, np.memmap(f"{self.store.folder}/text", np.uint8, "r")

    def drop(self) -> None:
        if self.store:
            self.store.close()
            self.store = None


def sort_shards(rows: DataFrame, shards: int) -> DataFrame:
    """Covered spans, from segments; each shard's text is sorted by itself."""

    def spans(doc: list, version: list, start: list, end: list) -> pa.RecordBatch:
        return _rows(COVERED, *merged(*(np.concatenate(x).astype(np.int64) for x in (doc, version, start, end))))

    def solve(shard: Shard) -> Iterator[pa.RecordBatch]:
        owners, text = shard.close()
        found: list[tuple] = []
        size = 0
        for own, start in covered_by(owners, text):
            found.append((owners["doc"][own], owners["version"][own], start, start + MATCH))
            size += len(own)
            if size > 1 << 19:
                yield spans(*map(list, zip(*found)))
                found, size = [], 0
        if found:
            yield spans(*map(list, zip(*found)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, shard = None, Shard()
        told: list[tuple] = []

        def tell() -> pa.RecordBatch:
            x = np.array(told, np.int64)
            told.clear()
            return spans([x[:, 0]], [x[:, 1]], [x[:, 2]], [x[:, 2] + x[:, 3] - 1 + MATCH])

        try:
            for batch in batches:
                for name, doc, version, start, starts, piece in zip(*(batch.column(c).to_pylist() for c in range(6))):
                    if name != last and shard.size:
                        yield from solve(shard)
                        shard.drop()
                        shard = Shard()
                    last = name
                    later = (doc, version, start, starts) if name < 0 else shard.add(doc, version, start, starts, piece)
                    if later:
                        told.append(later)
                if len(told) > 200_000:
                    yield tell()
            if shard.size:
                yield from solve(shard)
            if told:
                yield tell()
        finally:
            shard.drop()

    tasks = min(shards, 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # a task sorts its shards one by one
    spread = F.when(F.col("shard") < 0, F.pmod(F.hash("doc", "start"), F.lit(shards))).otherwise(F.col("shard"))
    return rows.withColumn("__to", spread).repartition(tasks, "__to").sortWithinPartitions("shard").drop("__to").mapInArrow(work, COVERED)


def copies(src: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """(doc, version, start, end) of documents that are whole copies of an earlier one and have MATCH bytes; all texts' bytes."""
    ids = scratch.write(src.where(F.octet_length("text") >= MATCH).select("doc", "version", F.xxhash64(F.lit(1), "text").alias("check"), F.octet_length("text").cast("long").alias("end")), "ids")
    first = ids.groupBy("version", "check").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("last > first").drop("last")
    found = ids.join(first, ["version", "check"]).where("doc > first").select("doc", "version", F.lit(0).cast("long").alias("start"), "end")
    return scratch.write(found.distinct(), "copies"), ids.agg(F.sum("end")).first()[0] or 0


def covered_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, version, spans (packed RUN records, disjoint): bytes covered by a string that also starts earlier."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    src = small_batches(docs).select(_key(docs[id_col], docs[text_col]).alias("doc"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    src = src.withColumn("version", F.xxhash64("text"))
    again, size = copies(src, scratch)
    few = again.count() <= BROADCAST_COPIES
    names = again.select("doc", "version")
    src = src.join(F.broadcast(names) if few else names, ["doc", "version"], "left_anti").select("doc", "text", "version")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    places = scratch.write(repeated_places(src, parts * max(1, -(-size // parts // BUCKET_BYTES))), "places")
    by_doc = places.groupBy("doc").agg(F.collect_set("at").alias("places"))  # some thirtieth of a document's bytes
    shards = max(1, -(-places.count() * (MATCH + BESIDE) // SHARD_BYTES))
    having = scratch.write(places.select("doc").distinct(), "having")
    if having.count() <= BROADCAST_DOCS:
        src = src.join(F.broadcast(having), "doc", "left_semi")
    # the places by shuffle at any size: so the cost follows the input
    cut = segments(src.hint("merge").join(by_doc, "doc").select("doc", "text", "version", "places"), shards)
    found = sort_shards(cut, shards)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            n = lists.value_lengths().to_numpy()
            pair = lists.flatten()
            row = np.repeat(np.arange(len(n)), n)
            at, _, start, end = merged(row, np.zeros(len(row), np.int64), pair.field(0).to_numpy(), pair.field(1).to_numpy())
            out = np.empty(len(at), RUN)
            out["start"], out["end"] = start, end
            cuts = np.searchsorted(at, np.arange(len(n) + 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([out[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())], names=["doc", "version", "spans"])

    lists = found.unionByName(again).groupBy("doc", "version").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    spans = scratch.write(lists.mapInArrow(join, "doc long, version long, spans binary"), "spans")
    scratch.keep("spans")
    return spans


def with_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, str]:
    """docs and one column more, whose name is given, too: an array of version and packed spans, null where nothing is covered."""
    spans = covered_spans(docs, id_col, text_col)
    # rows with one id and different texts are told apart by the text's hash
    of_doc = spans.groupBy(F.col("doc").alias("__doc")).agg(F.collect_list(F.struct("version", "spans")).alias("__spans"))
    size = spans.agg(F.sum(F.length("spans") + 24)).first()[0] or 0
    name = free_name(docs, "__spans")
    small = F.broadcast(of_doc) if size <= BROADCAST_BYTES else of_doc
    joined = docs.join(small, _key(docs[id_col], docs[text_col]) == of_doc["__doc"], "left")
    return joined.select(*[docs[c] for c in docs.columns], of_doc["__spans"].alias(name)), name


def _own(raw: bytes, spans: list | None) -> np.ndarray:
    if not spans:
        return np.zeros(0, RUN)
    version = int(np.uint64(xxhash.xxh64_intdigest(raw, 42)).astype(np.int64))
    return next((np.frombuffer(s["spans"], RUN) for s in spans if s["version"] == version), np.zeros(0, RUN))


def _kept(raw: bytes, own: np.ndarray) -> bytes:
    cuts = [0, *(x for r in own.tolist() for x in r), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(cuts[::2], cuts[1::2]))


DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document, each cut by its spans.

    Null text: empty. Documents without an id come after all others (ids are taken to be below 2^62), by their texts'
    hashes, each text a document of its own. Rows with one id and one text are one document (removed
    alike); with one id and unlike texts, the text's hash orders them. Texts below MATCH bytes stay whole, long ones
    are read whole. Empty table: empty result. Other columns are not read.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                out = []
                for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                    raw = (text or "").encode()
                    own = _own(raw, spans)
                    out.append((len(raw), int((own["end"] - own["start"]).sum()), len(own), hashlib.sha256(_kept(raw, own)).hexdigest()))
                cols = list(zip(*out)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], names=[c.split()[0] for c in DIGEST.split(", ")])

    joined, _ = with_spans(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")))
    return joined.mapInArrow(work, DIGEST)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the covered bytes cut from their texts; bytes of a character cut in two are dropped with it.

    Other columns pass through, whatever their names; a null text stays null; null ids as in digest.
    """
    joined, name = with_spans(docs, id_col, text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            at, s = whole.schema.get_field_index(text_col), whole.schema.get_field_index(name)
            for batch in slices(whole):
                texts = []
                for text, spans in zip(batch.column(at).to_pylist(), batch.column(s).to_pylist()):
                    if spans:
                        raw = text.encode()
                        text = _kept(raw, _own(raw, spans)).decode("utf-8", "ignore")
                    texts.append(text)
                cols = [pa.array(texts, batch.schema.field(k).type) if k == at else batch.column(k) for k in range(batch.num_columns) if k != s]
                yield pa.RecordBatch.from_arrays(cols, names=[f.name for k, f in enumerate(batch.schema) if k != s])

    return joined.mapInArrow(work, docs.schema)
