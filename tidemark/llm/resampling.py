"""Importance resampling towards a target: hashed n-gram gains as an array, ranks by a distributed radix sort.

Features are runs of 1 to 3 words, hashed into BUCKETS by CRC-32. A bucket's gain says how much more often it occurs
in the target than in the corpus; a document's weight is the sum of its features' gains, looked up in one array.
Documents are drawn without replacement by the largest weights plus Gumbel noise.

Ranks come from an LSD radix sort over the digits of (score descending, doc_id ascending): every pass counts digits in
each block of positions, turns the counts into global offsets, and sends each row to its new position. Passes are stable,
so after the last digit a row's position is its rank.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (as pa.compute)
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import dealt, small_batches, staged

BUCKETS = 10_000
LONGEST = 3  # words in a feature at most
SCALE = 1000  # gains and noise are whole numbers in units of 1 / SCALE
SHARE = 5  # percent of the documents that are long enough are drawn
MIN_WORDS = 20
SEED = 42
DIGIT_BITS = 11
BLOCK_ROWS, MOST_BLOCKS = 16_384, 4096  # positions of a block at least, and blocks at most
MAX_WORDS = 200_000  # remembered words in one Python worker, about 50 MB
TOGETHER = 1_000_000  # bytes of text whose features are hashed at once

_WORD = re.compile(rb"[0-9a-z\x80-\xFF]+")  # of UTF-8 whose A-Z are lower-cased


def _zero_byte() -> np.ndarray:
    """What one zero byte after a text does to each bit of its CRC-32 register."""
    table = np.zeros(256, np.uint32)
    for k in range(256):
        c = k
        for _ in range(8):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        table[k] = c
    return table


class Checksums:
    """CRC-32 of joined texts from those of their parts, for whole arrays.

    The CRC of a text followed by n bytes is a linear function of its own CRC, exclusive or the CRC of the bytes. The
    function of each n is kept as four tables over the bytes of a CRC.
    """

    def __init__(self):
        self.step = _zero_byte()
        self.tables = np.zeros((1, 4, 256), np.uint32)
        for k in range(4):
            self.tables[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)

    def longer(self, n: int) -> None:
        """Tables for up to ``n`` following bytes."""
        more, last = [], self.tables[-1]
        for _ in range(len(self.tables), n + 1):
            last = (last >> np.uint32(8)) ^ self.step[last & np.uint32(255)]
            more.append(last)
        if more:
            self.tables = np.concatenate([self.tables, np.stack(more)])

    def joined(self, before: np.ndarray, after: np.ndarray, size: np.ndarray) -> np.ndarray:
        """CRCs of texts with CRC ``before``, each followed by one of ``size`` bytes with CRC ``after``."""
        flat, at, out = self.tables.ravel(), size * 1024, after.copy()
        for k in range(4):
            out ^= flat.take(at + (256 * k) + ((before >> np.uint32(8 * k)) & np.uint32(255)))
        return out


LONG_WORD = 256  # bytes; texts with longer words take their checksums from the features' bytes

_checksums = Checksums()
_checksums.longer(LONG_WORD + 1)


class Words(dict):
    """Numbers of words, with the CRC of a word, that of the word behind a space, and the bytes of the latter.

    It starts anew when it holds MAX_WORDS.
    """

    def __init__(self):
        super().__init__()
        self.facts: list[tuple[int, int, int]] = []
        self.table = np.zeros((0, 3), np.int64)

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.facts)
        self.facts.append((zlib.crc32(word), zlib.crc32(b" " + word), len(word) + 1))
        return number

    def of(self, words: list[bytes]) -> np.ndarray:
        """The facts of each word, as columns."""
        if len(self) > MAX_WORDS:
            self.clear()
            self.facts, self.table = [], self.table[:0]
        numbers = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if len(self.facts) > len(self.table):
            self.table = np.concatenate([self.table, np.array(self.facts[len(self.table) :], np.int64).reshape(-1, 3)])
        return self.table[numbers].T


_words = Words()


def words(text: bytes | str | None) -> list[bytes]:
    """Runs of letters, digits and characters above ASCII, only A-Z lower-cased, as UTF-8."""
    return _WORD.findall((text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b"").lower())


def _from_bytes(own: list[bytes]) -> np.ndarray:
    return np.array([zlib.crc32(b" ".join(own[i : i + n])) % BUCKETS for i in range(len(own)) for n in range(1, LONGEST + 1) if i + n <= len(own)], np.int64)


def buckets(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of every feature of many texts' words, repeats included, and the number of the text it is in.

    A bucket is the CRC-32 of the feature's UTF-8 bytes modulo BUCKETS.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    alone, behind, size = _words.of([w for t in texts for w in t])
    text = np.repeat(np.arange(len(texts)), sizes)
    odd = np.unique(text[size > LONG_WORD + 1])
    size = np.minimum(size, LONG_WORD + 1)
    run, alone, behind = alone.astype(np.uint32), alone.astype(np.uint32), behind.astype(np.uint32)
    found, owner = [alone], [text]
    for n in range(1, LONGEST):
        if len(text) <= n:
            break
        run = _checksums.joined(run[: len(text) - n], behind[n:], size[n:])
        inside = text[n:] == text[:-n]
        found.append(run[inside])
        owner.append(text[:-n][inside])
    bucket, owner = np.concatenate(found).astype(np.int64) % BUCKETS, np.concatenate(owner)
    if len(odd):
        stays = ~np.isin(owner, odd)
        more = [_from_bytes(texts[k]) for k in odd.tolist()]
        bucket, owner = np.concatenate([bucket[stays], *more]), np.concatenate([owner[stays], np.repeat(odd, [len(m) for m in more])])
    return bucket, owner


def _together(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    """Stretches of rows with the words of their texts, about TOGETHER bytes of text at once."""
    for batch in batches:
        data = batch.column(column).cast(pa.binary())
        ends = np.cumsum([0 if x is None else x for x in pa.compute.binary_length(data).to_pylist()])
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TOGETHER, "right")))
            yield batch.slice(at, to - at), [words(t) for t in data.slice(at, to - at).to_pylist()]
            at = to


def bucket_counts(texts: DataFrame, text: str = "text") -> np.ndarray:
    """How many features of all texts fall into each bucket: one row a task and bucket is shuffled, BUCKETS are collected."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(BUCKETS, np.int64)
        for _, own in _together(batches, 0):
            n += np.bincount(buckets(own)[0], minlength=BUCKETS)
        there = np.flatnonzero(n)
        yield pa.record_batch([pa.array(there, pa.int64()), pa.array(n[there], pa.int64())], names=["bucket", "n"])

    counted = small_batches(texts.select(text)).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS, np.int64)
    for r in counted.collect():
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(SCALE * ln of a bucket's share in the target over that in the corpus), both with one added to each bucket."""
    all_s, all_t = float(corpus.sum()) + BUCKETS, float(target.sum()) + BUCKETS
    return np.array([math.floor(SCALE * math.log((float(t) + 1) * all_s / ((float(s) + 1) * all_t))) for s, t in zip(corpus, target)], np.int64)


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """Gumbel noise in units of 1 / SCALE from a hash of the id, so a retry draws the same."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-SCALE * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, doc_id: str = "doc_id", text: str = "text", seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every row; ``gain`` has BUCKETS numbers and goes to all tasks."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for rows, own in _together(batches, 1):
            bucket, owner = buckets(own)
            order = np.argsort(owner, kind="stable")
            sums = np.concatenate([[0], np.cumsum(gain[bucket[order]])])
            n = np.bincount(owner, minlength=len(own))
            ends = np.cumsum(n)
            weight = sums[ends] - sums[ends - n]
            drawn = weight + np.array([noise(i, seed) for i in rows.column(0).to_pylist()], np.int64)
            columns = [np.array([len(w) for w in own], np.int64), n, weight, drawn]
            yield pa.record_batch([rows.column(0), *map(pa.array, columns)], names=["doc_id", "n_words", "n_features", "weight", "score"])

    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return small_batches(own).mapInArrow(score, "doc_id long, n_words long, n_features long, weight long, score long")


def _digit(key: Column, at: int) -> Column:
    return F.shiftrightunsigned(key, at).bitwiseAND(F.lit((1 << DIGIT_BITS) - 1)).cast("int")


def _varying_digits(rows: DataFrame, keys: list[str]) -> list[tuple[str, int]]:
    """(key, lowest bit) of the digits that are not the same in all rows, from the least significant of the last key on."""
    bits = rows.agg(*[f(k).alias(f"{n}_{k}") for k in keys for n, f in (("or", F.bit_or), ("and", F.bit_and))]).collect()[0]
    out = []
    for k in reversed(keys):
        differ = ((bits[f"or_{k}"] or 0) ^ (bits[f"and_{k}"] or 0)) & ((1 << 64) - 1)
        out += [(k, at) for at in range(0, 64, DIGIT_BITS) if (differ >> at) & ((1 << DIGIT_BITS) - 1)]
    return out


def positions(rows: DataFrame, keys: list[str], block_rows: int | None = None) -> DataFrame:
    """``rows`` with ``position``, from 0, in the order of the whole-number ``keys``, each as an unsigned 64-bit number.

    Rows with equal keys follow each other in an order that is fixed once and kept by all passes. Each pass moves
    every row once, to the block of its new position; blocks are of equal size, so equal keys cannot pile up. Columns
    named position, block, digit or place are replaced.
    """
    start = staged(rows.withColumn("place", F.monotonically_increasing_id()), "radix-start")  # the files fix it
    counts = start.groupBy(F.shiftright("place", 33).alias("part")).agg(F.count(F.lit(1)).alias("n"))
    total = start.count()
    block_rows = block_rows or max(BLOCK_ROWS, math.ceil(total / MOST_BLOCKS))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # one row a task of the write
    offsets = counts.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    held = start.withColumn("part", F.shiftright("place", 33)).join(F.broadcast(offsets), "part")
    held = held.withColumn("position", F.col("before") + inside).drop("part", "before", "place")
    for turn, (key, at) in enumerate(_varying_digits(start, keys)):
        held = staged(counting_pass(held, _digit(F.col(key), at), block_rows), f"radix-{turn}")
    return held


def counting_pass(held: DataFrame, digit: Column, block_rows: int) -> DataFrame:
    """One stable counting sort by a digit: rows with ``position`` get their new position.

    Where a row goes: behind all rows of smaller digits, behind those of its digit in earlier blocks, behind those of its
    digit at earlier positions of its block. Digits and blocks are bounded in number, blocks in size.
    """
    blocked = held.withColumns({"block": F.expr(f"position div {block_rows}"), "digit": digit})
    counts = blocked.groupBy("block", "digit").agg(F.count(F.lit(1)).alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("digit").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    totals = counts.groupBy("digit").agg(F.sum("n").alias("n"))  # at most 2 ** DIGIT_BITS rows
    smaller = F.sum("n").over(Window.orderBy("digit").rowsBetween(Window.unboundedPreceding, -1))
    smaller = totals.select("digit", F.coalesce(smaller, F.lit(0)).alias("smaller"))
    offsets = counts.withColumn("earlier", F.coalesce(earlier, F.lit(0))).join(F.broadcast(smaller), "digit")
    offsets = offsets.select("block", "digit", (F.col("smaller") + F.col("earlier")).alias("first"))
    rank = F.row_number().over(Window.partitionBy("block", "digit").orderBy("position")) - 1
    moved = blocked.withColumn("rank", rank).join(offsets, ["block", "digit"])
    return moved.withColumn("position", F.col("first") + F.col("rank")).drop("block", "digit", "rank", "first")


def ranked(rows: DataFrame, share: int = SHARE, min_words: int = MIN_WORDS, block_rows: int | None = None) -> DataFrame:
    """``rows`` (doc_id, n_words, score and others) with ``rank`` of the drawn ones, floor(share percent) of those long enough."""
    rows = staged(rows, "resampling-scored")
    able = rows.where(F.col("n_words") >= min_words)
    figures = able.agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("top")).collect()[0]
    drawn = share * figures["n"] // 100
    keyed = able.withColumns(
        {
            "falling": F.lit(figures["top"]).cast("long") - F.col("score"),
            "none": F.col("doc_id").isNull().cast("long"),
            "rising": F.coalesce("doc_id", F.lit(0)).bitwiseXOR(F.lit(-(1 << 63))),
        }
    )
    placed = positions(keyed, ["falling", "none", "rising"], block_rows).drop("falling", "none", "rising")
    placed = placed.withColumn("rank", F.when(F.col("position") < drawn, F.col("position") + 1)).drop("position")
    others = rows.where((F.col("n_words") < min_words) | F.col("n_words").isNull())
    return placed.unionByName(others.withColumn("rank", F.lit(None).cast("long")))


def resampled(
    docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", share: int = SHARE,
    min_words: int = MIN_WORDS, seed: int = SEED,
) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) for every row of ``docs``, weighted towards ``target``'s texts.

    Null and empty texts have no feature, weight 0 and no rank; they count in neither side. Very long texts are counted
    whole. A null doc_id draws its noise from an empty id and follows the others at equal scores. Repeated rows are
    drawn each; rows with equal score and id are ranked in either order. An empty target gives every bucket the
    corpus's inverse share; an empty table gives no row. Other columns are not read, so their names may clash.
    """
    own = dealt(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    gain = gains(bucket_counts(own), bucket_counts(dealt(target.select(F.col(text).alias("text")))))
    return ranked(scored(own, gain, seed=seed), share, min_words)
