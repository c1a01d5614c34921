"""Similarity join of word-shingle sets by chosen paths.

Every text is a set of hashed shingles, and every set is embedded by min-hashing: coordinate i holds the
smallest value of hash i. A run starts with all sets in one bucket and splits buckets: a bucket samples
coordinates, one and a quarter on average for a similarity of 0.8, and each set goes on to the bucket of
the value it has there, so two sets stay together as often as they share sampled values. Buckets that are
small enough are compared by brute force; larger ones are split again. Runs are repeated until a pair at the
threshold is found with the target probability. Sets that may be close meet again with their full sets, where
every pair of them is checked.

Dense groups are settled before anything is split: their sets are dealt into blocks a few times, which joins most of a
group in one class. A bucket that is mostly of one class gives that class up: its other sets meet the class's members
once, however many runs and buckets they share, and only they are split on. Buckets that stay large at the end are dealt
into blocks until every two sets that are not of one class have met.

Equal sets count once throughout, so copies are never paired with each other.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Memo, dealt, small_batches, staged

WORDS = 5  # words in a shingle
THRESHOLD = 0.8
TARGET = 0.999  # probability with which a pair at the threshold is found
COORDINATES = 128
SMALL = 128  # sets compared by brute force in one bucket
BLOCK = 1024  # sets of a class counted against another block's at once
BLOCK_BYTES = 32 << 20  # shingles of such a block, about
CELLS = 20_000_000  # of a 0/1 matrix of sets and shingles looked at together
SETTLING = 2  # times that the sets of large buckets are dealt into blocks before splitting
SETTLED_ROUNDS = 2  # of labelling the classes of large buckets; what they leave apart meets in the buckets
MOSTLY = 0.75  # share of a large bucket's sets in one class from which the class is taken out
MET_SKETCHES, MET_SETS = 2048, 256  # members of a class in a block that other sets meet by sketches, and in full
DEPTH = 4  # levels of splitting before a bucket counts as dense
CONTRACTED = 200_000  # edges that a task unites at a time
BYTES = 5  # of a shingle's hash, kept for the exact check
MAX_WORDS = 300_000  # remembered word hashes in one Python worker

_WORD = re.compile(r"\w+")
_MULTIPLIERS = np.random.default_rng(20).integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = np.random.default_rng(21).integers(1, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_hash_of = Memo(lambda w: xxhash.xxh3_64_intdigest(w), MAX_WORDS)


def runs_for(threshold: float = THRESHOLD, target: float = TARGET, levels: int = 2) -> int:
    """Runs until a pair at the threshold is found with the target probability, if it has to pass ``levels`` splits."""
    return math.ceil(math.log(1 - target) / math.log(1 - threshold**levels))


def survival(threshold: float, levels: int) -> float:
    """Probability that a pair at the threshold is still together in some bucket after ``levels`` splits.

    A split draws one coordinate, or two with the share that makes it 1 / threshold on average.
    """
    more, found = min(1.0, 1 / threshold - 1), 1.0
    for _ in range(levels):
        one = threshold * found
        found = (1 - more) * one + more * (1 - (1 - one) ** 2)
    return found


def runs_through(threshold: float = THRESHOLD, target: float = TARGET) -> int:
    """Runs until a pair at the threshold is found with the target probability, if it has to pass all DEPTH splits."""
    missed, runs, deeper = 1.0, 0, survival(threshold, DEPTH - 1)
    while missed > 1 - target:
        missed *= (1 - threshold * deeper) ** len(root_coordinates(runs, threshold))
        runs += 1
    return runs


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return h ^ (h >> np.uint64(29))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all shingles of lower-case words; a text of fewer words is one shingle."""
    words = _WORD.findall((text or "").lower())
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_hash_of.__getitem__, words), np.uint64, len(words))
    size = min(WORDS, len(h))
    count = len(h) - size + 1
    out = np.full(count, size, np.uint64)
    for k in range(size):
        out += _mixed(h[k : k + count] * _PLACES[k])
    return np.unique(_mixed(out))


def embedded(shingle: np.ndarray, block: int = 4096) -> np.ndarray:
    """The smallest value of each of COORDINATES hashes over the set, 32 bits each."""
    best = np.full(COORDINATES, np.iinfo(np.uint64).max)
    for at in range(0, len(shingle), block):
        np.minimum(best, (shingle[None, at : at + block] * _MULTIPLIERS[:, None]).min(axis=1), out=best)
    return (best >> np.uint64(32)).astype(np.uint32)


def root_coordinates(run: int, threshold: float = THRESHOLD) -> np.ndarray:
    """The coordinates that the root bucket of a run samples: one at least, 1 / threshold on average."""
    rng = np.random.default_rng(1000 + run)
    n = 1 + rng.binomial(1, min(1.0, 1 / threshold - 1))
    return rng.permutation(COORDINATES)[:n]


def with_sets(docs: DataFrame, text: str, runs: int, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each document: id, hash of id and text, hash of its set (null if empty), first buckets and sketch."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        picked = [root_coordinates(r, threshold) for r in range(runs)]
        salt = [np.uint64(0x9E3779B97F4A7C15) * np.uint64(1 + r * COORDINATES) for r in range(runs)]
        for batch in batches:
            sets, keys, sketches = [], [], []
            for t in batch.column(2).to_pylist():
                own = shingles(t)
                if not len(own):
                    sets.append(None), keys.append(None), sketches.append(None)
                    continue
                values = embedded(own)
                sets.append(xxhash.xxh3_128_digest(own.tobytes()))
                first = np.concatenate([_mixed(values[c].astype(np.uint64) ^ (s + c.astype(np.uint64))) for c, s in zip(picked, salt)])
                keys.append(first.view(np.int64))
                sketches.append(values.astype(np.uint8).tobytes())
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(sets, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary())],
                names=["doc_id", "row", "set_id", "keys", "sketch"],
            )

    return small_batches(docs.select("doc_id", "row", text)).mapInArrow(rows, "doc_id long, row long, set_id binary, keys array<long>, sketch binary")


def _forest(n: int, edges: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Places of the edges that a spanning forest takes in their order, and each row's tree."""
    root = list(range(n))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    taken = []
    for place, (i, j) in enumerate(edges):
        x, y = find(i), find(j)
        if x != y:
            root[max(x, y)] = min(x, y)
            taken.append(place)
    return taken, [find(k) for k in range(n)]


def compare(sketches: np.ndarray, threshold: float, classes: np.ndarray | None = None) -> list[list[int]]:
    """Groups of a block's rows that are connected by pairs which may reach the threshold; all their pairs are to be checked.

    A pair may reach the threshold if its estimate, corrected for values that agree by chance, is less than
    3.4 standard errors below. With ``classes`` only pairs of different classes count.
    """
    n = len(sketches)
    spread = math.sqrt(threshold * (1 - threshold) / COORDINATES)
    near = []
    for i in range(n - 1):
        estimate = ((sketches[i + 1 :] == sketches[i]).mean(axis=1) - 1 / 256) / (1 - 1 / 256)
        close = estimate >= threshold - 3.4 * spread
        if classes is not None:
            close &= classes[i + 1 :] != classes[i]
        near += [(i, i + 1 + k) for k in np.flatnonzero(close).tolist()]
    groups: dict[int, list[int]] = {}
    for k, tree in enumerate(_forest(n, near)[1]):
        groups.setdefault(tree, []).append(k)
    return [g for g in groups.values() if len(g) > 1]


def whole_groups(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[pa.RecordBatch]:
    """The groups of batches sorted by a number, each as one batch; a group may span batches."""
    held = None
    for batch in batches:
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        if not batch.num_rows:
            continue
        starts = [0, *(np.flatnonzero(np.diff(batch.column(by).to_numpy())) + 1).tolist()]
        for x, y in zip(starts, starts[1:]):
            yield batch.slice(x, y - x)
        held = batch.slice(starts[-1])
    if held is not None:
        yield held


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray | None]]:
    """(set ids, sketches, classes by root if there is that column) of each block of at least two sets."""
    for part in whole_groups(batches, "block"):
        if part.num_rows > 1:
            found = dict(zip(part.column("set_id").to_pylist(), part.column("sketch").to_pylist()))
            ids = sorted(found)
            classes = None
            if "root" in part.schema.names:
                root, number = dict(zip(part.column("set_id").to_pylist(), part.column("root").to_pylist())), {}
                classes = np.array([number.setdefault(root[i], len(number)) for i in ids])
            yield ids, np.frombuffer(b"".join(found[i] for i in ids), np.uint8).reshape(len(ids), COORDINATES), classes


def _meetings(blocks: DataFrame, threshold: float) -> DataFrame:
    """Rows (block, set_id, sketch) to (meeting, set_id): the sets that are to be checked with each other.

    With a column root only sets of different roots have to be. A meeting is named by a hash of its sets, so one that several blocks find can be checked once.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[int] = []
        sets: list[bytes] = []
        for ids, sketches, classes in _blocks(batches):
            for group in compare(sketches, threshold, classes):
                own = [ids[k] for k in group]
                names += [xxhash.xxh3_64_intdigest(b"".join(own)) - (1 << 63)] * len(own)
                sets += own
            if len(sets) >= 20_000:
                yield _rows(names, sets)
                names, sets = [], []
        if sets:
            yield _rows(names, sets)

    held = [c for c in ("block", "set_id", "sketch", "root") if c in blocks.columns]
    dealt_out = blocks.select(*held).repartition("block").sortWithinPartitions("block")
    return dealt_out.mapInArrow(rows, "meeting long, set_id binary")


def _rows(names: list[int], sets: list[bytes]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(names, pa.int64()), pa.array(sets, pa.binary())], names=["meeting", "set_id"])


def _sizes(entries: DataFrame) -> DataFrame:
    return entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumnRenamed("key", "of")


def _split(entries: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The next level: a bucket's key draws its coordinates, one at least and 1 / threshold on average."""

    def child(salt: str) -> Column:
        place = F.pmod(F.xxhash64("key", F.lit(salt)), F.lit(COORDINATES)).cast("int") + 1
        return F.xxhash64("key", F.lit(salt), F.substring("sketch", place, F.lit(1)))

    second = F.pmod(F.xxhash64("key", F.lit("more")), F.lit(100)) < round(100 * (1 / threshold - 1))
    keys = F.when(second, F.array(child("one"), child("two"))).otherwise(F.array(child("one")))
    return entries.select(F.explode(keys).alias("key"), "set_id", "sketch")


def first_entries(sets: DataFrame) -> DataFrame:
    """(key, n, set_id, sketch) for the first buckets of all runs that hold several sets."""
    first = sets.select(F.explode("keys").alias("key"), "set_id")
    live = first.join(_sizes(first), F.col("key") == F.col("of")).select("key", "n", "set_id")
    return staged(live.join(sets.select("set_id", "sketch"), "set_id"), "join-level-1")


def settled(large: DataFrame, sets: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) and classes (set_id, root) among the sets of large buckets, each set once in its largest bucket.

    They are dealt into blocks SETTLING times at once. This misses links, which the buckets then find; it makes a dense
    group one class for the most part. For the same reason a few rounds of labelling are enough here.
    """
    once = large.groupBy("set_id").agg(F.max_by("key", F.struct("n", "key")).alias("key"), F.min("sketch").alias("sketch"))
    once = staged(once, "join-settling")
    placed = once.join(_keyed(once.groupBy(F.col("key").alias("of")).agg(F.count(F.lit(1)).alias("n"))), F.col("key") == F.col("of")).drop("of")
    turn = F.explode(F.array(*[F.lit(100 + t) for t in range(SETTLING)]))
    part = F.pmod(F.xxhash64("set_id", "key", "turn"), F.ceil(F.col("n") / SMALL).cast("long"))
    blocks = placed.withColumn("turn", turn).withColumn("block", F.xxhash64("key", part, "turn"))
    links = staged(checked(_meetings(blocks, threshold).distinct(), sets, threshold), "join-settled")
    return links, staged(components(links, SETTLED_ROUNDS), "join-settled-roots")


def _keyed(by_key: DataFrame) -> DataFrame:
    """A table with one row for each large bucket, broadcast if its counted size allows."""
    by_key = staged(by_key, "join-keys")
    return F.broadcast(by_key) if by_key.count() <= 200_000 else by_key


def taken_out(large: DataFrame, root: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Large buckets without the class that makes up most of them, with the sets' roots, and (class, set_id) that share such a bucket."""
    rooted = large.join(root, "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    rooted = staged(rooted.select("key", "n", "set_id", "sketch", "root"), "join-rooted")
    counts = rooted.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"))
    most = counts.groupBy(F.col("key").alias("of")).agg(F.max_by("root", F.struct("c", "root")).alias("most"), F.max("c").alias("majors"), F.sum("c").alias("all"))
    given = F.col("majors") >= MOSTLY * F.col("all")
    most = staged(most, "join-most")
    if most.where(given).isEmpty():
        return rooted, None
    both = rooted.join(F.broadcast(most) if most.count() <= 200_000 else most, F.col("key") == F.col("of")).drop("of")
    left = both.where(~given | (F.col("root") != F.col("most"))).withColumn("n", F.when(given, F.col("all") - F.col("majors")).otherwise(F.col("n")))
    others = both.where(given & (F.col("root") != F.col("most"))).select(F.col("most").alias("class"), "set_id").distinct()
    return left.select("key", "n", "set_id", "sketch", "root").where("n > 1"), others


def candidates(entries: DataFrame, root: DataFrame | None, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """Distinct (meeting, set_id) of the small buckets; the rows of buckets that stay large, and (class, set_id) to meet, if there are any.

    ``entries`` are the first buckets; ``root`` names the classes of settled sets, (set_id, root).
    """
    blocks, others = [], []
    for level in range(1, DEPTH + 1):
        blocks.append(entries.where(F.col("n") <= SMALL).select(F.col("key").alias("block"), "set_id", "sketch"))
        large = entries.where(F.col("n") > SMALL)
        if root is None or large.isEmpty():
            large = None
            break
        left, met = taken_out(large, root)
        if met is not None:
            left = staged(left, f"join-left-{level}")
            others.append(staged(met, f"join-others-{level}"))
            blocks.append(left.where(F.col("n") <= SMALL).select(F.xxhash64("key", F.lit("left")).alias("block"), "set_id", "sketch"))
        large = left.where(F.col("n") > SMALL).drop("root")
        if large.isEmpty():
            large = None
            break
        if level < DEPTH:
            children = staged(_split(large, threshold), f"join-split-{level}")  # read twice below
            entries = staged(children.join(_sizes(children), F.col("key") == F.col("of")).select("key", "n", "set_id", "sketch"), f"join-level-{level + 1}")
    return _meetings(_united(blocks), threshold).distinct(), large, _united(others).distinct() if others else None


def _class_blocks(others: DataFrame, root: DataFrame, per_block: int) -> DataFrame:
    """(class, block, set_id, member): the members and other sets of each class in pairs of blocks, so that each other set meets each member."""
    named = others.select("class").distinct()
    members = root.join(named, F.col("root") == F.col("class")).select("class", "set_id", F.lit(True).alias("member"))
    members = members.unionByName(named.select("class", F.col("class").alias("set_id"), F.lit(True).alias("member"))).distinct()
    both = members.unionByName(others.select("class", "set_id", F.lit(False).alias("member")))
    sizes = both.groupBy("class").agg(*[F.ceil(F.count_if(F.col("member") == k) / per_block).cast("long").alias(c) for c, k in (("x", True), ("y", False))])
    dealt_out = both.join(_keyed(sizes.withColumnRenamed("class", "of")), F.col("class") == F.col("of"))
    own = F.pmod(F.xxhash64("set_id", F.lit(per_block)), F.when(F.col("member"), F.col("x")).otherwise(F.col("y")))
    met = F.sequence(F.lit(0).cast("long"), F.when(F.col("member"), F.col("y")).otherwise(F.col("x")) - 1)
    spread = dealt_out.select("class", "set_id", "member", own.alias("own"), F.explode(met).alias("o"))
    first, second = F.when(F.col("member"), F.col("own")).otherwise(F.col("o")), F.when(F.col("member"), F.col("o")).otherwise(F.col("own"))
    return spread.select("class", F.xxhash64("class", first, second).alias("block"), "set_id", "member")


def meet_classes(others: DataFrame, root: DataFrame, sketches: DataFrame, full: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between classes and other sets, (class, set_id): one for each set that reaches the threshold with a member.

    Sets whose sketch is near no member's are left out first; the others meet every member in full.
    """

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit = threshold - 3.4 * math.sqrt(threshold * (1 - threshold) / COORDINATES)
        for part in whole_groups(batches, "block"):
            member = part.column("member").to_numpy(zero_copy_only=False)
            held = np.frombuffer(b"".join(part.column("sketch").to_pylist()), np.uint8).reshape(-1, COORDINATES)
            own = held[member]
            close = [k for k in np.flatnonzero(~member).tolist() if len(own) and ((own == held[k]).mean(axis=1).max() - 1 / 256) / (1 - 1 / 256) >= limit]
            yield part.select(["class", "set_id"]).take(pa.array(close, pa.int64()))

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_groups(batches, "block"):
            ids, member = part.column("set_id").to_pylist(), part.column("member").to_numpy(zero_copy_only=False)
            order = np.argsort(~member, kind="stable")
            n = int(member.sum())
            sets = [_wide(part.column("shingles")[int(k)].as_py()) for k in order]
            reach = reached(sets, threshold, n)
            pairs = [sorted((ids[order[int(row.argmax())]], ids[order[n + k]])) for k, row in enumerate(reach.T) if row.any()]
            yield pa.record_batch([pa.array([p[i] for p in pairs], pa.binary()) for i in (0, 1)], names=["a", "b"])

    def blocks(of: DataFrame, size: int, what: DataFrame, column: str) -> DataFrame:
        rows = _class_blocks(of, root, size).join(what, F.col("set_id") == F.col("s")).select("class", "block", "set_id", "member", column)
        return rows.repartition("block").sortWithinPartitions("block")

    by_sketch = blocks(others, MET_SKETCHES, sketches.select(F.col("set_id").alias("s"), "sketch"), "sketch")
    close = staged(by_sketch.mapInArrow(near, "class binary, set_id binary").distinct(), "join-near-classes")
    return blocks(close, MET_SETS, full, "shingles").mapInArrow(linked, "a binary, b binary").distinct()


def _dense(entries: DataFrame, threshold: float, sets: DataFrame | None = None, root: DataFrame | None = None) -> DataFrame:
    """Links (a, b) of buckets that stay large: every two of a bucket's sets that are not of one class meet in blocks.

    ``root`` names the classes known so far. Without ``sets`` the sketches decide.
    """
    placed = entries.select("key", "set_id", "sketch")
    placed = placed.withColumn("root", F.col("set_id")) if root is None else placed.join(root, "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    met = _meetings(_block_pairs(_by_class(staged(placed, "join-stay-large"))), threshold)
    return staged(_linked(met, sets, threshold), "join-block-pairs")


def _by_class(placed: DataFrame) -> DataFrame:
    """The sets of buckets that hold several roots; ``major`` are those of the bucket's most frequent root, ``majors`` their number."""
    counts = placed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"))
    most = counts.groupBy(F.col("key").alias("of")).agg(
        F.sum("c").alias("n"), F.max("c").alias("majors"), F.max_by("root", F.struct("c", "root")).alias("most"), F.count(F.lit(1)).alias("roots")
    )
    several = placed.join(most.where("roots > 1"), F.col("key") == F.col("of"))
    return several.select("key", "n", "set_id", "sketch", "root", "majors", (F.col("root") == F.col("most")).alias("major"))


def _linked(meetings: DataFrame, sets: DataFrame | None, threshold: float) -> DataFrame:
    """Links of the meetings, checked on the full sets; without ``sets`` all of a meeting is linked."""
    if sets is not None:
        return checked(meetings.distinct(), sets, threshold)
    least = meetings.groupBy(F.col("meeting").alias("of")).agg(F.min("set_id").alias("a"))
    return meetings.join(least, F.col("meeting") == F.col("of")).select("a", F.col("set_id").alias("b")).where("a < b")


def _block_pairs(entries: DataFrame) -> DataFrame:
    """Each set goes to all pairs of blocks that its own block is in, so that every two sets of a bucket meet.

    With columns major and majors, sets that are both major need not meet: their blocks meet the other sets' only.
    """
    split = "major" in entries.columns
    major, majors = (F.col("major"), F.col("majors")) if split else (F.lit(False), F.lit(0))
    others = F.ceil(2 * (F.col("n") - majors) / SMALL).cast("long")
    blocks = others + F.ceil(2 * majors / SMALL).cast("long")
    place = F.pmod(F.xxhash64("set_id", "key", F.lit("pairs")), F.greatest(F.when(major, blocks - others).otherwise(others), F.lit(1)))
    own = place + F.when(major, others).otherwise(F.lit(0))
    last = F.when(major, others).otherwise(blocks) - 1
    met = F.transform(F.sequence(F.lit(0).cast("long"), last), lambda o: F.struct(F.least(own, o).alias("x"), F.greatest(own, o).alias("y")))
    held = [c for c in ("key", "n", "set_id", "sketch", "root") if c in entries.columns]
    return entries.select(*held, F.explode(met).alias("m")).select(*held, F.xxhash64("key", "m.x", "m.y").alias("block"))


def _united(found: list[DataFrame]) -> DataFrame:
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def full_sets(needed: DataFrame, docs: DataFrame, representatives: DataFrame, text: str) -> DataFrame:
    """(s, shingles): the sorted hashes, BYTES each, of every set that ``needed`` names, staged.

    ``representatives`` names one row of each set; only their texts are read again and cut into shingles.
    """
    wanted = representatives.join(needed, "set_id", "leftsemi").select(F.col("row").alias("of"), F.col("set_id").alias("s"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingles(t) >> np.uint64(64 - 8 * BYTES)) for t in batch.column(1).to_pylist()]
            data = [x.view(np.uint8).reshape(-1, 8)[:, :BYTES].tobytes() for x in sets]
            yield pa.record_batch([batch.column(0), pa.array(data, pa.binary())], names=["s", "shingles"])

    texts = docs.select("row", text).join(wanted, F.col("row") == F.col("of")).select("s", text)
    return staged(small_batches(texts).mapInArrow(cut, "s binary, shingles binary").groupBy("s").agg(F.min("shingles").alias("shingles")), "join-sets")


def _wide(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // BYTES, 8), np.uint8)
    out[:, :BYTES] = np.frombuffer(data, np.uint8).reshape(-1, BYTES)
    return out.view(np.uint64).ravel()


def shared_counts(sets: list[np.ndarray], first: int | None = None) -> np.ndarray:
    """How many values every two sets share, or each of the ``first`` sets and each other one.

    Values are looked at in 0/1 matrices of bounded size; those that only one set holds are left out.
    """
    sizes = [len(x) for x in sets]
    row = np.repeat(np.arange(len(sets)), sizes)
    _, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = times > 1
    number = np.cumsum(several) - 1
    kept = several[place]
    row, place = row[kept], number[place[kept]]
    order = np.argsort(place, kind="stable")
    row, place = row[order], place[order]
    left, right = slice(0, first), slice(first or 0, len(sets))
    out = np.zeros((len(sets[left]), len(sets[right])), np.float32)
    top, columns = int(place[-1]) + 1 if len(place) else 0, max(100, CELLS // max(1, len(sets)))
    for at in range(0, top, columns):
        x, y = np.searchsorted(place, [at, at + columns])
        held = np.zeros((len(sets), min(columns, top - at)), np.float32)
        held[row[x:y], place[x:y] - at] = 1
        out += held[left] @ held[right].T
    if first is None:
        np.fill_diagonal(out, sizes)
    return out


def checked(meetings: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) of distinct (meeting, set_id): every two sets of a meeting are compared in full.

    Of the pairs that reach the threshold each meeting gives a spanning forest, so what is linked stays connected and
    no meeting gives more rows than it has sets.
    """

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_groups(batches, "meeting"):
            ids = part.column("set_id").to_pylist()
            linked = reached([_wide(x) for x in part.column("shingles").to_pylist()], threshold)
            edges = np.argwhere(np.triu(linked, 1)).tolist()
            pairs = [sorted((ids[edges[k][0]], ids[edges[k][1]])) for k in _forest(len(ids), edges)[0]]
            yield pa.record_batch([pa.array([p[i] for p in pairs], pa.binary()) for i in (0, 1)], names=["a", "b"])

    both = meetings.join(sets, F.col("set_id") == F.col("s")).select("meeting", "set_id", "shingles")
    return both.repartition("meeting").sortWithinPartitions("meeting").mapInArrow(links, "a binary, b binary").distinct()


def reached(sets: list[np.ndarray], threshold: float, first: int | None = None) -> np.ndarray:
    """Which two sets reach the threshold, or which of the ``first`` sets and the others."""
    sizes = np.array([len(x) for x in sets], np.float64)
    shared = shared_counts(sets, first)
    return shared >= threshold * (sizes[:first, None] + sizes[None, first or 0 :] - shared) - 1e-6


def link_counts(members: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(set_id, n_links): for every set of a class, (root, set_id), the other sets that reach the threshold with it.

    Links lie within classes. A class is dealt into blocks of about BLOCK sets or BLOCK_BYTES of shingles and every two
    blocks meet once, so all its pairs are counted, but a row is given for a set and a meeting only, never for a pair.
    """
    sized = members.join(sets.select("s", F.octet_length("shingles").alias("bytes")), F.col("set_id") == F.col("s"))
    sizes = sized.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")).where("n > 1")
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("bytes") / BLOCK_BYTES)).cast("long")
    own = F.pmod(F.xxhash64("set_id"), blocks)
    met = F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda o: F.struct(F.least(own, o).alias("x"), F.greatest(own, o).alias("y"), (own <= o).alias("first"), (own >= o).alias("second")))
    spread = members.join(sizes, "root").select("root", "set_id", F.explode(met).alias("m"))
    spread = spread.select(F.xxhash64("root", "m.x", "m.y").alias("block"), "set_id", "m.first", "m.second")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_groups(batches, "block"):
            ids = part.column("set_id").to_pylist()
            held = [_wide(x) for x in part.column("shingles").to_pylist()]
            first, second = (part.column(c).to_numpy(zero_copy_only=False) for c in ("first", "second"))
            linked = reached(held, threshold)
            same = first & second  # a block that meets itself
            linked &= ~np.eye(len(ids), dtype=bool) & ((same[:, None] & same[None, :]) | (first[:, None] != first[None, :]))
            yield pa.record_batch([pa.array(ids, pa.binary()), pa.array(linked.sum(axis=1), pa.int64())], names=["set_id", "n"])

    with_shingles = spread.join(sets, F.col("set_id") == F.col("s")).select("block", "first", "second", "set_id", "shingles")
    counted = with_shingles.repartition("block").sortWithinPartitions("block").mapInArrow(count, "set_id binary, n long")
    return counted.groupBy("set_id").agg(F.sum("n").alias("n_links"))


def components(links: DataFrame, rounds: int | None = None) -> DataFrame:
    """(set_id, root): the smallest set id that is reached over links (a, b).

    Every round contracts the edges that a task holds, links a set's larger neighbours to its smallest one, then its
    smaller neighbours and itself; each leaves connected what is connected. The rounds end when all edges are stars.
    After a given number of rounds that may not be so yet: then sets of one root are connected, but not all
    connected sets have one root.
    """
    edges = links.select("a", "b")
    for turn in range(rounds) if rounds else count():
        edges = contracted(edges)
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        larger = both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a < b")
        down = larger.distinct()
        least = down.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))
        smaller = down.withColumnRenamed("b", "u").join(least, "u").select(F.col("m").alias("a"), F.explode(F.array("a", "u")).alias("b"))
        edges = staged(smaller.where("a < b").distinct(), f"components-{turn}")
        if rounds is None and all_stars(edges):
            break
    return edges.groupBy(F.col("b").alias("set_id")).agg(F.min("a").alias("root"))


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (a, b) as stars around the smallest set of what is connected within a task, CONTRACTED edges at a time."""

    def stars(held: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        names = sorted({x for pair in held for x in pair})
        place = {x: k for k, x in enumerate(names)}
        _, tree = _forest(len(names), [(place[a], place[b]) for a, b in held])
        pairs = [(names[t], names[k]) for k, t in enumerate(tree) if t != k]
        return pa.record_batch([pa.array([p[i] for p in pairs], pa.binary()) for i in (0, 1)], names=["a", "b"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, bytes]] = []
        for batch in batches:
            held += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            if len(held) >= CONTRACTED:
                yield stars(held)
                held = []
        if held:
            yield stars(held)

    return edges.select("a", "b").mapInArrow(rows, "a binary, b binary")


def all_stars(edges: DataFrame) -> bool:
    """Whether every set of distinct edges (a, b) is the end of one edge at most, and then the start of none."""
    ends = edges.select(F.col("a").alias("u"), F.lit(0).alias("n")).unionByName(edges.select(F.col("b").alias("u"), F.lit(1).alias("n")))
    seen = ends.groupBy("u").agg(F.sum("n").alias("n"), F.min("n").alias("starts"))
    return seen.where("n > 1 OR (n = 1 AND starts = 0)").isEmpty()


def joined(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, with_links: bool = True
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, row (a hash of id and text), class_id, n_links and class_key (null without words).

    Rows belong to one class if they are connected by sets of a similarity of at least ``threshold``;
    class_id is the smallest doc_id in the class (null ids count last). n_links is the number of other sets
    that reach the threshold with the row's own, counted on the full sets of its class; it is null without
    ``with_links``, which saves the counting where only classes are asked for. Rows whose text is null, empty or without a
    word are a class each, without links. Repeated rows and copies share class and links. An empty
    table gives no row. Other columns are not read.
    """
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), row_hash(doc_id, text).alias("row"), F.col(text).alias("text"))
    rows = staged(with_sets(dealt(own), "text", runs_through(threshold), threshold), "join-rows")
    some = rows.where("set_id IS NOT NULL")
    members = staged(some.groupBy("set_id").agg(F.min("doc_id").alias("least"), F.min("row").alias("row")), "join-members")
    sets = some.select("set_id", "row", "keys", "sketch").join(members.select("set_id", "row"), ["set_id", "row"])
    sets = staged(sets.dropDuplicates(["set_id"]).drop("row"), "join-distinct")
    entries, root, extra = first_entries(sets), None, []
    crowded = staged(entries.where(F.col("n") > SMALL), "join-crowded")
    dense = None
    if not crowded.isEmpty():
        dense = full_sets(crowded.select("set_id").distinct(), own, members.select("set_id", "row"), "text")
        links, root = settled(crowded, dense, threshold)
        extra.append(links)
    meetings, large, others = candidates(entries, root, threshold)
    meetings = staged(meetings, "join-meetings")
    needed = meetings.select("set_id").distinct()
    if dense is not None:
        needed = needed.join(dense.select("s"), F.col("set_id") == F.col("s"), "leftanti")
    full = full_sets(needed, own, members.select("set_id", "row"), "text")
    full = full if dense is None else full.unionByName(dense)
    if others is not None and not others.isEmpty():
        extra.append(staged(meet_classes(others, root, sets, full, threshold), "join-class-links"))
    links = _united([staged(checked(meetings, full, threshold), "join-links"), *extra])
    if large is not None:
        links = _united([links, _dense(large, threshold, full, root)])
    root = staged(components(links), "join-roots")
    placed = members.join(root, "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    classes = placed.groupBy("root").agg(F.min("least").alias("class_id"))
    of_set = placed.join(classes, "root").select(F.col("set_id").alias("s"), "root", "class_id")
    if with_links:
        linked = root.unionByName(root.select(F.col("root").alias("set_id"), "root").distinct())
        of_set = of_set.join(link_counts(linked, full, threshold), F.col("s") == F.col("set_id"), "left").drop("set_id")
    else:
        of_set = of_set.withColumn("n_links", F.lit(None).cast("long"))
    out = rows.select("doc_id", "row", "set_id").join(staged(of_set, "join-classes"), F.col("set_id") == F.col("s"), "left")
    return out.select(
        "doc_id", "row", F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        (F.coalesce("n_links", F.lit(0)).cast("long") if with_links else F.col("n_links")).alias("n_links"), F.col("root").alias("class_key"),
    )


def row_hash(doc_id: str, text: str) -> Column:
    return F.xxhash64(F.col(doc_id).cast("long"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with one row of each class: that with the smallest doc_id (nulls last, ties by a hash).

    Rows whose texts have no words all stay. Of repeated rows in a class one stays.
    """
    rows = staged(joined(docs, doc_id, text, with_links=False), "join-joined")
    worded = rows.where("class_key IS NOT NULL")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    kept = worded.groupBy("class_key").agg(F.min(order).alias("k")).select(F.col("k.row").alias("r"))
    often = worded.groupBy(F.col("row").alias("r")).count().where("count > 1").select("r")
    repeated = staged(kept.join(often, "r", "leftsemi"), "join-repeated")
    empty = rows.where("class_key IS NULL").select(F.col("row").alias("r")).distinct()
    keyed = docs.withColumn("__row", row_hash(doc_id, text))
    plain = kept.join(repeated, "r", "leftanti").unionByName(empty)
    stays = keyed.join(plain, F.col("__row") == F.col("r"), "leftsemi")
    if not repeated.isEmpty():
        stays = stays.unionByName(keyed.join(repeated, F.col("__row") == F.col("r"), "leftsemi").dropDuplicates(["__row"]))
    return stays.drop("__row")
