"""SimHash for near copies: sets of 5-word shingles with a Jaccard similarity of 0.8 or more, all of them.

Such sets of n and m shingles differ in at most (n + m) / 9 of them. So a document's fingerprint here is a long one:
its shingles are spread over that many buckets and some more, by hash, and each bucket gives a 64-bit SimHash. Two
close documents differ in fewer buckets than there are, hence share a block (pigeonhole). Documents of like size are
joined on blocks, and the Hamming distance of their sets decides. Blocks that many documents share are passed over, but for documents that
may share nothing else with a close one; those are spread anew, and must share a block in that, too. Equal sets are one row from the start.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colferry.llm.common import Scratch, slices, small_batches
from colferry.llm.components import components
from colferry.llm.simhash import BROADCAST_IDS, without_ids

WORDS, SEED = 5, 42
#: Pairs to be compared for each set of a block beyond which it is hot; how often sets are spread anew for that.
HOT, LEVELS = 16, 6
#: Sets that are compared with one in one place.
HUB_ROWS = 4096
#: Sets that a task remembers in order not to tell of them again.
REMEMBER = 1 << 18
#: Least sizes of the classes: sets alike to 0.8 are of the same or of neighbouring classes.
CLASSES = [1]
while CLASSES[-1] < 1 << 40:
    CLASSES.append(max(CLASSES[-1] + 1, -(-5 * CLASSES[-1] // 4)))
_ODD, _MORE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ x >> np.uint64(33)) * _MORE
        return x ^ x >> np.uint64(33)


def shingles(text: str) -> np.ndarray:
    """Sorted distinct hashes of the word runs; the whole of a shorter text is one, and no words are none."""
    words = text.encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < WORDS:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    h = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), np.uint64, len(words))
    n = len(words) - WORDS + 1
    with np.errstate(over="ignore"):
        x = h[:n].copy()
        for k in range(1, WORDS):
            x = (x ^ x >> np.uint64(29)) * _ODD + h[k : n + k]
    return np.unique(_mixed(x))


def name_of(found: np.ndarray) -> int:
    """The id of a set, as a signed long."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes(), SEED)).view(np.int64))


def spreadings(n: int) -> list[tuple[int, int, int]]:
    """(class, buckets, empty ones that don't matter) of a set of n shingles: with its own class's sizes and up, and down."""
    c = bisect_right(CLASSES, n) - 1
    out = []
    for p in (c, c - 1):
        most = (CLASSES[p + 1] - 1) // 4 if p >= 0 else 0  # differing shingles: n / 4 of the smaller set
        if most:
            spare = 2 + most // 8
            out.append((p, most + 1 + spare, spare))
    return out


def majorities(x: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The SimHash of each run of x: bits that over half of it have. Counted in bit planes, 64 bits at once."""
    planes = [np.zeros(len(starts), np.uint64) for _ in range(int(sizes.max(initial=0)).bit_length())]
    left = np.arange(len(starts))
    for k in range(int(sizes.max(initial=0))):
        left = left[sizes[left] > k]
        carry = x[starts[left] + k]
        for plane in planes[: (k + 1).bit_length()]:
            plane[left], carry = plane[left] ^ carry, plane[left] & carry
    more, same = np.zeros(len(starts), np.uint64), np.full(len(starts), ~np.uint64(0))
    half = (sizes // 2).astype(np.uint64)
    for j in reversed(range(len(planes))):
        bit = np.uint64(0) - (half >> np.uint64(j) & np.uint64(1))
        more |= same & planes[j] & ~bit
        same &= ~(planes[j] ^ bit)
    return more


def blocks(sets: list[np.ndarray], level: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the sets' blocks, and which set each is of. Sets alike to 0.8 share one that isn't empty, unless both have
    more empty buckets than don't matter; then an empty one, which is a key in that case."""
    if level:
        with np.errstate(over="ignore"):
            sets = [np.sort(_mixed(x + np.uint64(level) * _ODD)) for x in sets]
    ways = [spreadings(len(x)) for x in sets]
    keys, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for turn in (0, 1):
        rows = np.array([i for i, w in enumerate(ways) if len(w) > turn], np.int64)
        if not len(rows):
            continue
        p, buckets, spare = (np.array(c, np.uint64) for c in zip(*(ways[i][turn] for i in rows)))
        n = np.array([len(sets[i]) for i in rows])
        x, of = np.concatenate([sets[i] for i in rows]), np.repeat(np.arange(len(rows)), n)
        bucket = (x >> np.uint64(32)) * buckets[of] >> np.uint64(32)
        starts = np.flatnonzero(np.append(True, (bucket[1:] != bucket[:-1]) | (of[1:] != of[:-1])))
        sim, which, owner = majorities(x, starts, np.diff(np.append(starts, len(x)))), bucket[starts], of[starts]
        for r in np.flatnonzero(buckets - np.bincount(owner, minlength=len(rows)).astype(np.uint64) > spare):
            empty = np.setdiff1d(np.arange(buckets[r], dtype=np.uint64), which[owner == r])
            sim, which = np.append(sim, np.full(len(empty), 12345, np.uint64)), np.append(which, empty)
            owner = np.append(owner, np.full(len(empty), r))
        with np.errstate(over="ignore"):
            key = _mixed(sim + _mixed(which * _ODD + p[owner] * _MORE + np.uint64(level)))
        keys.append(key & ~np.uint64(1) | p[owner] & np.uint64(1))  # the last bit tells a set's two spreadings apart
        owners.append(rows[owner])
    return np.concatenate(keys), np.concatenate(owners)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return small_batches(docs).select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    for whole in batches:
        for batch in slices(whole, 2 << 20):
            yield [shingles(t or "") for t in batch.column(batch.num_columns - 1).to_pylist()]


def _longs(names: list[str], *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(c).view(np.int64)) for c in columns], names=names)


def _told(texts: DataFrame, fps: DataFrame):
    """The ids of fps as a broadcast sorted array, if they are few (8 bytes each); else of None."""
    fps = fps.select("fp").distinct()
    few = fps.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return texts.sparkSession.sparkContext.broadcast(np.sort(np.array([r[0] for r in fps.collect()], np.int64)) if few else None)


def holders(texts: DataFrame, prints: DataFrame, fps: DataFrame) -> DataFrame:
    """Rows of texts in which all the sets that fps names are, one document each, and those without an id."""
    ids = prints.join(fps.select("fp").distinct(), "fp", "left_semi").select("doc_id").where("doc_id IS NOT NULL").distinct()
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return texts.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi").unionByName(texts.where("doc_id IS NULL"))


def _distinct(batches: Iterator[pa.RecordBatch], told=None) -> Iterator[dict[int, np.ndarray]]:
    """Sets by id, those told of, without most of those that were there before."""
    seen: set[int] = set()
    for found in _each(batches):
        rows = {name: x for x in found if len(x) and (name := name_of(x)) not in seen}
        if told is not None and told.value is not None:
            rows = {n: rows[n] for n in np.intersect1d(np.fromiter(rows, np.int64, len(rows)), told.value).tolist()}
        if len(seen) > REMEMBER:
            seen.clear()
        seen.update(rows)
        yield rows


def all_blocks(texts: DataFrame, level: int = 0, told=None) -> DataFrame:
    """(key, fp): the blocks of each set; a row may come more than once."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _distinct(batches, told):
            keys, owners = blocks(list(rows.values()), level)
            yield _longs(["key", "fp"], keys, np.fromiter(rows, np.int64, len(rows))[owners])

    return texts.select("text").mapInArrow(keyed, "key long, fp long")


def unavoidable(hot: DataFrame, texts: DataFrame, level: int) -> DataFrame:
    """(fp, part) of the sets whose hot blocks may be all that they share with a close one.

    Of the blocks in the spreading made for its classes, a close pair shares all but a quarter of the smaller size. A
    set with fewer hot blocks than that shares another block, too, with each set close to it, and they meet there.
    """

    def needs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _distinct(batches, told):
            out: list[tuple] = []
            keys, owners = blocks(list(rows.values()), level)
            for turn in (0, 1):
                count = np.bincount(owners[keys & np.uint64(1) == turn], minlength=len(rows))
                for (fp, x), n in zip(rows.items(), count.tolist()):
                    p, buckets = next(((p, b) for p, b, _ in spreadings(len(x)) if p & 1 == turn), (0, 0))
                    most = min(len(x), CLASSES[p + 1] - 1) // 4  # that a set of this class and one of the next may differ in
                    out.append((fp, turn, n - most if n < buckets else 1))  # if n = buckets, empty ones may be among them
            cols = list(zip(*out)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["fp", "turn", "need"])

    told = _told(texts, hot)
    need = texts.select("text").mapInArrow(needs, "fp long, turn long, need long").groupBy("fp", "turn").agg(F.min("need").alias("need"))
    hot = hot.withColumn("turn", F.col("key").bitwiseAND(F.lit(1)))
    some = hot.groupBy("fp", "turn").agg(F.count("*").alias("n"), F.first("part").alias("part")).join(need, ["fp", "turn"])
    return some.where("n >= need").select("fp", "part").distinct()


def shared_blocks(texts: DataFrame) -> DataFrame:
    """(key, fp, rep): the blocks of at least two different sets, with each of these; rep: one of a block's."""

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted; what goes on in the next batch is the last row, and its run's rep if that was told."""
        key, fp, rep = np.zeros(0, np.int64), np.zeros(0, np.int64), None
        for batch in batches:
            if not batch.num_rows:
                continue
            k = np.concatenate([key[-1:], batch.column(0).to_numpy()])
            f = np.concatenate([fp[-1:], batch.column(1).to_numpy()])
            new = np.append(True, (k[1:] != k[:-1]) | (f[1:] != f[:-1]))
            k, f = k[new], f[new]
            first = np.append(True, k[1:] != k[:-1])
            reps = f[np.maximum.accumulate(np.where(first, np.arange(len(k)), 0))]
            many = ~first | np.append(~first[1:], False)
            if rep is not None:  # the first row's run was told of already, and the row, too
                reps[k == k[0]] = rep
                many[0] = False
            yield _longs(["key", "fp", "rep"], k[many], f[many], reps[many])
            rep = reps[-1] if many[-1] or rep is not None and k[-1] == k[0] else None
            key, fp = k, f

    return all_blocks(texts).repartition("key").sortWithinPartitions("key", "fp").mapInArrow(repeated, "key long, fp long, rep long")


def print_of(found: np.ndarray) -> bytes:
    """Parities of the shingles' counts in two to four times as many places as there are shingles."""
    k = max(3, (2 * len(found) - 1).bit_length())
    places = np.bincount((found >> np.uint64(64 - k)).astype(np.int64), minlength=1 << k)
    return np.packbits(places & 1).tobytes()


def least_distance(x: bytes, y: bytes) -> int:
    """A lower bound of two sets' Hamming distance: that of their prints, the longer one folded to the shorter one's places."""
    a, b = sorted((np.unpackbits(np.frombuffer(v, np.uint8)) for v in (x, y)), key=len)
    while len(b) > len(a):
        b = b[::2] ^ b[1::2]
    return int((a ^ b).sum())


def likely(pairs: DataFrame, prints: DataFrame) -> DataFrame:
    """The pairs (a, b) whose prints leave a similarity of 0.8 possible."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in range(2, 6)))
            keep = [5 * min(n, m) >= 4 * max(n, m) and 9 * least_distance(x, y) <= n + m for n, x, m, y in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    of = lambda s: prints.select(F.col("fp").alias(s), F.col("n").alias(f"n_{s}"), F.col("print").alias(f"print_{s}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "n_a", "print_a", "n_b", "print_b").mapInArrow(check, "a long, b long")


def sets_for(texts: DataFrame, sends: DataFrame) -> DataFrame:
    """sends with found: the set that fp names. Few names are broadcast (8 bytes each); more are joined by shuffle."""
    told = _told(texts, sends)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _distinct(batches, told):
            yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int64()), pa.array([x.tobytes() for x in rows.values()], pa.binary())], names=["fp", "found"])

    full = texts.select("text").mapInArrow(whole, "fp long, found binary")
    return full.join(F.broadcast(sends) if sends.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else sends, "fp")


def close(pairs: DataFrame, texts: DataFrame, prints: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The pairs (a, b) of sets whose Hamming distance is at most a ninth of their sizes' sum: 0.8 of the union is shared.

    A set goes to each a that it is paired with, and a's own once, in parts of HUB_ROWS sets.
    """
    hubs = pairs.groupBy("a").agg(F.ceil(F.count("*") / HUB_ROWS).cast("int").alias("parts"))
    to = pairs.join(hubs, "a").select(F.col("a").alias("hub"), F.pmod(F.xxhash64("b"), "parts").cast("int").alias("part"), F.col("b").alias("fp"))
    own = hubs.select(F.col("a").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("a").alias("fp"))
    sends = scratch.write(to.union(own), f"sends-{name}")

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, mine, told = None, None, None
        for whole_batch in batches:
            for batch in slices(whole_batch, 2 << 20):
                out: list[tuple] = []
                for hub, part, fp, found in zip(*(batch.column(c).to_pylist() for c in range(4))):
                    if (hub, part) != last:
                        last, mine, told = (hub, part), np.frombuffer(found, np.uint64), None
                    if fp in (hub, told):  # equal sets may come from several tasks
                        continue
                    told, other = fp, np.frombuffer(found, np.uint64)
                    if 9 * len(np.setxor1d(mine, other, assume_unique=True)) <= len(mine) + len(other):
                        out.append((hub, fp))
                cols = list(zip(*out)) or [[], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a", "b"])

    sent = sets_for(holders(texts, prints, sends), sends).select("hub", "part", "fp", "found").repartition("hub", "part")
    return sent.sortWithinPartitions("hub", "part", F.col("fp") != F.col("hub"), "fp").mapInArrow(alike, "a long, b long")


def _prints(texts: DataFrame) -> DataFrame:
    """doc_id, fp, n, print of every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 2 << 20):
                found = [shingles(t or "") for t in batch.column(1).to_pylist()]
                cols = [pa.array([name_of(x) for x in found], pa.int64()), pa.array([len(x) for x in found], pa.int64()), pa.array([print_of(x) for x in found], pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["doc_id", "fp", "n", "print"])

    return texts.mapInArrow(work, "doc_id long, fp long, n long, print binary")


def links(texts: DataFrame, scratch: Scratch, spare: bool = False, named: DataFrame | None = None) -> DataFrame:
    """(a, b): all pairs of different sets (by their ids) of similarity 0.8 or more. named: what _prints gives.

    spare: only as many as connect what is connected. Each set is compared with one of those that share a block first,
    and then only those pairs that these links leave apart; so that a thousand near copies of one text are not a
    million pairs.
    """
    named = scratch.write(_prints(texts), "prints") if named is None else named
    scratch.settle()
    shared = scratch.write(shared_blocks(texts), "shared")
    scratch.settle()
    prints = named.join(shared.select("fp").distinct(), "fp", "left_semi").groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("print").alias("print"))
    prints = scratch.write(prints, "prints-shared")
    out = None
    if spare:
        often = shared.where("fp <> rep").groupBy("fp", "rep").count().groupBy("fp").agg(F.max_by("rep", F.struct("count", "rep")).alias("rep"))
        star = scratch.write(likely(often.select(F.col("rep").alias("a"), F.col("fp").alias("b")), prints), "star-pairs")
        scratch.settle()
        out = scratch.write(close(star, texts, prints, scratch, "star"), "star")
        scratch.settle()
        part = components(out, scratch, "star-cc")
        shared = shared.join(part.select(F.col("node").alias("fp"), F.col("root").alias("part")), "fp", "left")
    rows = shared.select("key", "fp", F.coalesce("part", "fp").alias("part") if spare else F.col("fp").alias("part"))
    pairs = None
    for level in range(LEVELS + 1):
        # pairs of a key between different parts: half of n^2 less the squares of the parts' counts
        sizes = rows.groupBy("key", "part").agg(F.count("*").alias("c")).groupBy("key").agg(F.sum("c").alias("n"), (F.pow(F.sum("c"), 2) - F.sum(F.col("c") * F.col("c"))).alias("pairs"))
        keyed = scratch.write(rows.join(sizes.where("pairs > 0"), "key"), f"blocks{level}")
        rows = sizes = None
        scratch.settle()
        few = keyed if level == LEVELS else keyed.where(F.col("pairs") <= 2 * HOT * F.col("n"))
        a, b = (few.select("key", F.col("fp").alias(s), F.col("part").alias(f"part_{s}")) for s in "ab")
        found = scratch.write(likely(a.join(b, "key").where("a < b AND part_a <> part_b").select("a", "b").distinct(), prints), f"pairs{level}")
        scratch.settle()
        pairs = found if pairs is None else pairs.union(found)
        hot = keyed.where(F.col("pairs") > 2 * HOT * F.col("n")).select("key", "fp", "part")
        if level == LEVELS or not hot.head(1):
            break
        left = scratch.write(unavoidable(hot, holders(texts, prints, hot), level), f"left{level}")
        rows = all_blocks(holders(texts, prints, left), level + 1, _told(texts, left)).distinct().join(left, "fp").select("key", "fp", "part")
    pairs = scratch.write(pairs.distinct(), "pairs")
    scratch.settle()
    more = close(pairs, texts, prints, scratch, "pairs")
    return more if out is None else out.union(more)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those that links lead from to a smaller id. Rows with one id stay together; null ids stay.

    Null, empty or wordless text: the empty set, linked to its like. Texts of any length are compared whole. Empty
    table: empty result. Other columns pass through.
    """
    scratch, texts = Scratch(docs.sparkSession), _texts(docs, id_col, text_col)
    named = scratch.write(_prints(texts), "named")
    roots = scratch.write(components(links(texts, scratch, True, named), scratch), "roots")
    by_fp = named.select("doc_id", "fp").join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = by_fp.groupBy("root").agg(F.min("doc_id").alias("least"))
    dropped = scratch.write(by_fp.join(least, "root").where("doc_id <> least").select(F.col("doc_id").alias("id")), "dropped")
    scratch.keep("dropped")
    return without_ids(docs, dropped, id_col)
