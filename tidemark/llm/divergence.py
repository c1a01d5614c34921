"""How the sources of a language differ in their terms: exact term vectors, group sums, sparse divergences.

CountVectorizer counts terms that are marked with their language, so one fit gives every language its own
vocabulary with the least document frequency in that language, however many languages there are. Its
vocabulary passes through the driver's JVM; it is therefore fitted on slices of the terms by their hash, as many as
keep a slice below ``slice_terms`` distinct terms. Every task first adds up the terms of its documents, so that
CountVectorizer meets a term a few times a task instead of once for each occurrence. Its sparse vectors are summed per
(lang, source) on their non-zero entries only, like Summarizer's sums without its dense buffers: every task sums its
own rows, and sums travel as arrays over blocks of terms.

Shares are whole numbers in units of 1e-9 with add-one smoothing, so every figure is exact:
p = 1 + floor(UNIT * (count + 1) / (N + V)), and a term's divergence of p from q is floor((p - q)^2 / q).
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.errors import IllegalArgumentException
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import dealt, shared_path, small_batches, staged

MIN_DF = 3  # documents of the language that a term occurs in at least
VOCAB_SIZE = 2**31 - 1  # CountVectorizer's largest: no term is cut off
TOP_TERMS = 200
UNIT = 1_000_000_000
SLICE_TERMS = 4_000_000  # distinct terms, rare ones included, whose vocabulary the driver's JVM holds at once: 100 bytes each
BLOCK_TERMS = 8192  # kept terms of a block
BLOCK_SOURCES = 64  # sources of a block, about
HELD_ENTRIES = 2_000_000  # sums that a task holds before it hands them on

JOINED_BYTES = 16_000_000  # terms that a task takes up at once
HELD_BYTES = 16_000_000  # different terms that a task holds before it hands their counts on
HELD_GROUPS = 100_000  # groups likewise
ROW_BYTES = 16_384  # terms of a row of counts, unless one is longer
SENT_BYTES = 32_000_000  # rows of counts handed to Spark at once, about

COUNTED = 64  # one term in so many, by its hash, is counted to estimate how many there are

_LOW = np.arange(256, dtype=np.uint8)
_LOW[ord("A") : ord("Z") + 1] += 32
_INSIDE = (_LOW >= ord("a")) & (_LOW <= ord("z")) | (_LOW >= 128)  # bytes of terms in UTF-8
_MARK = "\x01"  # stands between language and term; no term holds it


def terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The terms of whole texts in UTF-8, one text after another, and how many each text has: runs of ASCII letters and
    characters above ASCII, only A-Z lower-cased."""
    texts = texts.cast(pa.large_binary())
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    inside = _INSIDE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    new = ends[:-1][ends[:-1] < len(data)]  # a term does not go on into the next text
    begins[new] = inside[new]
    lasts = inside.copy()
    lasts[:-1] &= ~inside[1:] | begins[1:]
    starts = np.flatnonzero(begins)
    offsets = np.concatenate([[0], np.cumsum(np.flatnonzero(lasts) + 1 - starts)]).astype(np.int64)
    found = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(_LOW[data[inside]])])
    return found, np.diff(np.searchsorted(starts, ends))


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys in order, and how often each occurs."""
    key = np.sort(key)
    first = np.flatnonzero(np.diff(key, prepend=key[0] - 1)) if len(key) else np.zeros(0, np.int64)
    return key[first], np.diff(np.append(first, len(key)))


class _Held:
    """Counts by key, reduced when they become many."""

    def __init__(self):
        self.key, self.n, self.entries = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0

    def add(self, key: np.ndarray, n: np.ndarray) -> bool:
        """Whether these are too many to hold more."""
        self.key.append(key)
        self.n.append(n)
        self.entries += len(key)
        return self.entries >= HELD_ENTRIES and len(self.reduced()[0]) >= HELD_ENTRIES // 2

    def reduced(self) -> tuple[np.ndarray, np.ndarray]:
        key, n = _reduced(np.concatenate(self.key), np.concatenate(self.n))
        self.key, self.n, self.entries = [key], [n], len(key)
        return key, n


COUNTS = "lang string, source string, weight long, terms array<string>, seen array<string>, counted array<long>"


def _count_batch(lang: str, marked: pa.Array, width: np.ndarray, lists: list[tuple[str | None, int, np.ndarray]], counted: list[int]) -> pa.RecordBatch:
    """COUNTS of lists of terms of one language: (source, weight, places in ``marked``), as ``seen`` if there is no source."""
    sources, weights, sizes, places = [], [], ([], []), ([np.zeros(0, np.int64)], [np.zeros(0, np.int64)])
    for source, weight, at in lists:
        _, cuts = np.unique(np.cumsum(width[at]) // ROW_BYTES, return_counts=True)
        cuts = cuts.tolist() or [0]
        kind = int(source is None)
        sources += [source] * len(cuts)
        weights += [weight] * len(cuts)
        places[kind].append(at)
        sizes[kind].extend(cuts)
        sizes[1 - kind].extend([0] * len(cuts))
    columns = [pa.array([lang] * len(sources), pa.string()), pa.array(sources, pa.string()), pa.array(weights, pa.int64())]
    for at, n in zip(places, sizes):
        columns.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *n]), pa.int32()), marked.take(pa.array(np.concatenate(at))).cast(pa.string())))
    columns.append(pa.array([counted, *[[]] * (len(sources) - 1)], pa.list_(pa.int64())))
    return pa.record_batch(columns, names=["lang", "source", "weight", "terms", "seen", "counted"])


def _count_rows(groups: dict[tuple[str, str], int], langs: dict[str, int], known: pa.Array, seen: _Held, sums: _Held, min_df: int) -> Iterator[pa.RecordBatch]:
    """COUNTS of what a task holds, language by language."""
    seen_key, seen_n = seen.reduced()
    sums_key, sums_n = sums.reduced()
    of_lang: dict[str, list[tuple[str, int]]] = {x: [] for x in langs}
    for (lang, source), group in groups.items():
        of_lang[lang].append((source, group))
    for lang, code in langs.items():
        low, high = np.searchsorted(seen_key, [code << 32, code + 1 << 32])
        own, df = seen_key[low:high] & 0xFFFFFFFF, seen_n[low:high]
        marked = pc.binary_join_element_wise(pa.scalar((lang + _MARK).encode(), pa.large_binary()), known.take(pa.array(own)), pa.scalar(b"", pa.large_binary()))
        width = pc.binary_length(marked).to_numpy()
        counted = [h for h in map(zlib.crc32, marked.to_numpy(zero_copy_only=False)) if h % COUNTED == 0]

        def lists() -> Iterator[tuple[str | None, int, np.ndarray]]:
            for level in range(1, min(max(min_df, 1), int(df.max(initial=0))) + 1):  # noqa: B023
                yield None, 0, np.flatnonzero(df >= level)  # noqa: B023
            for source, group in of_lang[lang]:  # noqa: B023
                low, high = np.searchsorted(sums_key, [group << 32, group + 1 << 32])
                at, n = np.searchsorted(own, sums_key[low:high] & 0xFFFFFFFF), sums_n[low:high]  # noqa: B023
                for digit in range(max(1, int(n.max(initial=0)).bit_length())):
                    there = at[n >> digit & 1 == 1]
                    if digit == 0 or len(there):
                        yield source, 1 << digit, there

        now, size = [], 0
        for one in lists():
            now.append(one)
            size += int(width[one[2]].sum())
            if size >= SENT_BYTES:
                yield _count_batch(lang, marked, width, now, counted)
                now, size, counted = [], 0, []
        if now:
            yield _count_batch(lang, marked, width, now, counted)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[tuple[str, str]], pa.Array, np.ndarray]]:
    """(lang, source) of texts, their terms and numbers of terms, from as many batches as together have JOINED_BYTES."""
    own, found, sizes, held = [], [], [], 0
    for batch in batches:
        own += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
        now, of_text = terms(batch.column(2))
        found.append(now)
        sizes.append(of_text)
        held += now.nbytes + 100 * batch.num_rows
        if held >= JOINED_BYTES:
            yield own, pa.concat_arrays(found), np.concatenate(sizes)
            own, found, sizes, held = [], [], [], 0
    if own:
        yield own, pa.concat_arrays(found), np.concatenate(sizes)


def _counts(batches: Iterator[pa.RecordBatch], min_df: int) -> Iterator[pa.RecordBatch]:
    """COUNTS of batches of (lang, source, text)."""
    none = pa.array([], pa.large_binary())
    groups, langs, known, seen, sums = {}, {}, none, _Held(), _Held()
    for own, found, sizes in _joined(batches):
        words = found.dictionary_encode()
        codes, width = words.indices.to_numpy().astype(np.int64), max(1, len(words.dictionary))
        at = pc.fill_null(pc.index_in(words.dictionary, known), -1).to_numpy().astype(np.int64)
        new = np.flatnonzero(at < 0)
        at[new] = len(known) + np.arange(len(new))
        known = pa.concat_arrays([known, words.dictionary.take(pa.array(new))])
        lang_of = np.array([langs.setdefault(x, len(langs)) for x, _ in own], np.int64)
        group_of = np.array([groups.setdefault(g, len(groups)) for g in own], np.int64)
        once, _ = _runs(np.repeat(np.arange(len(own)), sizes) * width + codes)
        key, n = _runs(lang_of[once // width] * width + once % width)
        full = seen.add((key // width << 32) | at[key % width], n)
        key, n = _runs(np.repeat(group_of, sizes) * width + codes)
        full |= sums.add((key // width << 32) | at[key % width], n)
        if full or known.nbytes >= HELD_BYTES or len(groups) >= HELD_GROUPS:
            yield from _count_rows(groups, langs, known, seen, sums, min_df)
            groups, langs, known, seen, sums = {}, {}, none, _Held(), _Held()
    yield from _count_rows(groups, langs, known, seen, sums, min_df)


def marked_terms(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", min_df: int = MIN_DF) -> DataFrame:
    """COUNTS: what each task counts in its documents, every term behind its language; nulls count as ''.

    A row with a source lists different ``terms`` that occur ``weight`` times in the group; a term's count is the sum of
    its rows' weights, which are powers of two. A row without source lists in ``seen`` different terms of one document
    more, up to ``min_df`` documents: a term has that many documents if it is in that many rows, over all tasks.
    Every group has a row, also without terms. ``counted`` holds hashes of those terms that stand for COUNTED others.
    """

    plain = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    return small_batches(plain).mapInArrow(lambda batches: _counts(batches, min_df), COUNTS)


def slices_of(tokens: DataFrame, slice_terms: int) -> int:
    """Slices that keep the distinct terms of each below ``slice_terms``, estimated from one in COUNTED."""
    return max(1, math.ceil(COUNTED * tokens.where("source IS NULL").select(F.explode("counted")).distinct().count() / slice_terms))


def sliced(tokens: DataFrame, slices: int) -> list[DataFrame]:
    """The counts by a hash of the term, each slice readable on its own; written once more if there are several."""
    columns = "lang string, source string, weight long, terms array<string>, seen array<string>"
    if slices == 1:
        return [tokens.drop("counted")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind in ("terms", "seen"):
                words = batch.column(kind)
                flat = words.flatten().dictionary_encode()
                codes = flat.indices.to_numpy(zero_copy_only=False)
                of_word = np.array([xxhash.xxh3_64_intdigest(w) % slices for w in flat.dictionary.to_pylist()], np.int64)
                row = np.repeat(np.arange(batch.num_rows), np.diff(words.offsets.to_numpy()))
                key = of_word[codes] * batch.num_rows + row if len(codes) else np.zeros(0, np.int64)
                order = np.argsort(key, kind="stable")
                there, first = np.unique(key[order], return_index=True)
                offsets = pa.array(np.append(first, len(order)), pa.int32())
                lists = {k: pa.array([[]] * len(there), pa.list_(pa.string())) for k in ("terms", "seen")}
                lists[kind] = pa.ListArray.from_arrays(offsets, flat.dictionary.take(pa.array(codes[order])))
                rows, which = pa.array(there % max(batch.num_rows, 1)), pa.array(there // max(batch.num_rows, 1), pa.int32())
                same = [batch.column(k).take(rows) for k in ("lang", "source", "weight")]
                yield pa.record_batch([*same, lists["terms"], lists["seen"], which], names=["lang", "source", "weight", "terms", "seen", "slice"])

    path = shared_path(tokens.sparkSession, "divergence-slices")
    parts = tokens.drop("counted").mapInArrow(cut, f"{columns}, slice int")
    parts.write.partitionBy("slice").option("compression", "zstd").parquet(path)
    back = tokens.sparkSession.read.schema(f"{columns}, slice int").parquet(path)
    return [back.where(F.col("slice") == k).drop("slice") for k in range(slices)]


def vectorized(tokens: DataFrame, min_df: int) -> tuple[DataFrame, DataFrame] | None:
    """Rows of counts with their sparse vectors, and (place, lang, term) of the vocabulary; None if no term is kept.

    The vocabulary is read back from the saved model, so Python on the driver never holds it.
    """
    try:
        model = CountVectorizer(inputCol="seen", outputCol="vector", minDF=float(min_df), vocabSize=VOCAB_SIZE).fit(tokens.where("source IS NULL").select("seen"))
    except IllegalArgumentException as none:
        if "vocabulary size should be > 0" in str(none):
            return None
        raise
    path = shared_path(tokens.sparkSession, "divergence-model")
    model.save(path)
    names = tokens.sparkSession.read.parquet(f"{path}/data").select(F.posexplode("vocabulary").alias("place", "marked"))
    own = F.substring_index("marked", _MARK, -1)
    language = F.expr(f"left(marked, length(marked) - length(substring_index(marked, '{_MARK}', -1)) - 1)")
    vectors = model.setInputCol("terms").transform(tokens.where("source IS NOT NULL").select("lang", "source", "weight", "terms"))
    return vectors, names.select(F.col("place").cast("long").alias("place"), language.alias("lang"), own.alias("term"))


SUMS = "lang string, source string, whole boolean, part long, at array<int>, n array<long>"


def _reduced(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.diff(key, prepend=key[0] - 1)) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(n, first) if len(key) else n


def _summed(vectors: DataFrame, first_part: int) -> DataFrame:
    """SUMS of each task's rows by (lang, source), and by lang alone (``whole``), with one row a block of terms."""

    def rows(groups: dict[tuple[str, str], int], key: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        names = list(groups)
        langs = sorted({g[0] for g in names})
        lang_of = np.array([langs.index(g[0]) for g in names], np.int64)
        of_lang = _reduced((lang_of[key >> 32] << 32) | (key & 0xFFFFFFFF), n)
        for whole, (k, v), owner in ((False, (key, n), names), (True, of_lang, [(x, None) for x in langs])):
            place = k & 0xFFFFFFFF
            block = ((k >> 32) << 32) | (place // BLOCK_TERMS)
            there, first = np.unique(block, return_index=True)
            offsets = pa.array(np.append(first, len(k)), pa.int32())
            own = [owner[c] for c in (there >> 32).tolist()]
            yield pa.record_batch(
                [
                    pa.array([o[0] for o in own], pa.string()), pa.array([o[1] for o in own], pa.string()), pa.array([whole] * len(own), pa.bool_()),
                    pa.array(first_part + (there & 0xFFFFFFFF), pa.int64()),
                    pa.ListArray.from_arrays(offsets, pa.array(place % BLOCK_TERMS, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(v, pa.int64())),
                ],
                names=["lang", "source", "whole", "part", "at", "n"],
            )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], int] = {}
        keys, counts, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        for batch in batches:
            own = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            code = np.array([groups.setdefault(g, len(groups)) for g in own], np.int64)
            places = batch.column(2)
            sizes = np.diff(places.offsets.to_numpy())
            keys.append((np.repeat(code, sizes) << 32) | places.flatten().to_numpy().astype(np.int64))
            counts.append(np.repeat(batch.column(3).to_numpy(), sizes))
            held += len(keys[-1])
            if held >= HELD_ENTRIES:
                key, n = _reduced(np.concatenate(keys), np.concatenate(counts))
                keys, counts, held = [key], [n], len(key)
                if held >= HELD_ENTRIES // 2:
                    yield from rows(groups, key, n)
                    groups, keys, counts, held = {}, [key[:0]], [n[:0]], 0
        if held:
            yield from rows(groups, *_reduced(np.concatenate(keys), np.concatenate(counts)))

    entries = vectors.select("lang", "source", F.unwrap_udt("vector")["indices"].alias("at"), "weight")  # the terms of a row differ
    return entries.mapInArrow(add, SUMS)


def _merged(sums: DataFrame) -> DataFrame:
    """One row of SUMS for each (lang, source, whole, part), with its ``total``; a task holds one block at a time."""

    def row(key: tuple, dense: np.ndarray) -> tuple:
        at = np.flatnonzero(dense)
        return (*key, at.astype(np.int32), dense[at], int(dense.sum()))

    def out(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["lang", "whole", "source", "part", "at", "n", "total"])

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, dense, done = None, np.zeros(BLOCK_TERMS, np.int64), []
        for batch in batches:
            for *key, at, n in zip(*(batch[c] for c in ("lang", "whole", "source", "part", "at", "n"))):
                if now is not None and key != now:
                    done.append(row(now, dense))
                    dense[:] = 0
                now = key
                dense[at] += n
            if len(done) >= 200:
                yield out(done)
                done = []
        yield out([*done, row(now, dense)] if now is not None else [])

    by = ["lang", "whole", "source", "part"]
    schema = "lang string, whole boolean, source string, part long, at array<int>, n array<long>, total long"
    return sums.repartition(*by).sortWithinPartitions(*by).mapInPandas(merge, schema)


def group_sums(tokens: DataFrame, min_df: int = MIN_DF, slice_terms: int = SLICE_TERMS) -> tuple[DataFrame, DataFrame] | None:
    """Merged sums of kept terms in each group and language, and (place, lang, term) of the kept terms; None if there are none.

    A term stands at ``place`` = part * BLOCK_TERMS + at. Sums are combined before they are shuffled, so a group with a
    third of all documents brings one row a task and block.
    """
    sums, kept, first = [], [], 0
    for k, part in enumerate(sliced(tokens, slices_of(tokens, slice_terms))):
        if (got := vectorized(part, min_df)) is None:
            continue
        vectors, names = got
        names = staged(names.withColumn("place", F.col("place") + first * BLOCK_TERMS), f"divergence-terms-{k}")
        sums.append(staged(_merged(_summed(vectors, first)), f"divergence-sums-{k}"))
        kept.append(names)
        first += math.ceil(names.count() / BLOCK_TERMS)
    if not sums:
        return None
    for more in (sums, kept):
        while len(more) > 1:
            more[0] = more[0].unionByName(more.pop())
    return sums[0], kept[0]


def share(count: Column, total: Column, size: Column) -> Column:
    """1 + floor(UNIT * (count + 1) / (total + size)), in decimals that hold any product of two counts."""
    above = F.lit(UNIT).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)")
    return F.when(total + size > 0, 1 + F.call_function("div", above, (total + size).cast("decimal(20,0)"))).cast("long")


def shares(n: np.ndarray, whole: int) -> np.ndarray:
    """The same for an array of counts; ``whole`` is total + size."""
    n = np.asarray(n, np.int64)
    if len(n) and n.max() >= 9_000_000_000:  # beyond 64 bits: Python's own whole numbers
        return np.array([1 + UNIT * (int(k) + 1) // int(whole) for k in n], np.int64)
    return 1 + UNIT * (n + 1) // int(whole)


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def term_rows(sums: DataFrame, kept: DataFrame, roster: DataFrame, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, item, value): of each group and block the terms that the group holds a larger share of than its
    language does, as far as they are among the block's ``top`` values or equal to the last of them."""
    of_lang = sums.where("whole")
    totals = of_lang.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    q = of_lang.join(totals, "lang").select("lang", "part", F.col("at").alias("lang_at"), F.col("n").alias("lang_n"), "lang_total")
    own = sums.where("NOT whole").join(roster.select("lang", "source", "size", F.col("total").alias("own_total")), ["lang", "source"])
    both = own.select("lang", "source", "part", "at", "n", "size", "own_total").join(q, ["lang", "part"])

    def telling(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                dense = np.zeros(BLOCK_TERMS, np.int64)
                dense[r.lang_at] = shares(r.lang_n, r.lang_total + r.size)
                p, q = shares(r.n, r.own_total + r.size), dense[r.at]
                value, at = _f(p, q)[p > q], np.asarray(r.at)[p > q]
                if len(value) > top:
                    stays = value >= np.partition(value, -top)[-top]
                    value, at = value[stays], at[stays]
                yield pd.DataFrame({"lang": r.lang, "source": r.source, "place": r.part * BLOCK_TERMS + at.astype(np.int64), "value": value})

    found = both.mapInPandas(telling, "lang string, source string, place long, value long")
    return found.join(kept.select("place", F.col("term").alias("item")), "place").select("lang", "source", "item", "value")


def pair_values(sums: DataFrame, roster: DataFrame) -> DataFrame:
    """(lang, source, item, value) for every two sources of a language, from entries that are not zero.

    A pair's value is size * f(p0, q0), as if all terms were lacking, plus what present terms change. Entries meet in
    blocks of BLOCK_TERMS terms and two blocks of sources, which bounds what a task holds; a block gives one row a pair.
    """
    counts = roster.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / BLOCK_SOURCES).cast("long").alias("blocks"))
    sources = roster.join(counts, "lang").withColumn("own", F.pmod(F.xxhash64("source"), F.col("blocks")))
    parts = sums.where("whole").select("lang", "part")
    entries = sums.where("NOT whole").select("lang", "source", "part", "at", "n")
    listed = sources.join(parts, "lang").select("lang", "source", "part", "own", "blocks", "size", "total", "p0").join(entries, ["lang", "source", "part"], "left")
    met = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda o: F.struct(F.least("own", o).alias("x"), F.greatest("own", o).alias("y")))
    meetings = listed.select("lang", "part", "own", "source", "size", "total", "p0", "at", "n", F.explode(met).alias("m"))
    meetings = meetings.select("lang", "part", "own", "source", "size", "total", "p0", "at", "n", F.col("m.x").alias("x"), F.col("m.y").alias("y"))
    changed = meetings.groupBy("lang", "part", "x", "y").applyInPandas(_changes, "lang string, source string, item string, value long")
    changed = changed.groupBy("lang", "source", "item").agg(F.sum("value").alias("changed"))
    a = roster.select("lang", "source", "size", F.col("p0").alias("p"))
    b = roster.select("lang", F.col("source").alias("item"), F.col("p0").alias("q"))
    pairs = a.join(b, "lang").where("source <> item").join(changed, ["lang", "source", "item"], "left")
    base = F.when(F.col("size") > 0, F.col("size") * divergence(F.col("p"), F.col("q"))).otherwise(0)
    return pairs.select("lang", "source", "item", (base + F.coalesce("changed", F.lit(0))).alias("value"))


def _changes(meeting: pd.DataFrame) -> pd.DataFrame:
    """What the present terms of one block change in every pair of its sources."""
    names, block, p0 = meeting["source"].tolist(), meeting["own"].to_numpy(), meeting["p0"].to_numpy(np.int64)
    at = [np.zeros(0, np.int64) if x is None else np.asarray(x, np.int64) for x in meeting["at"]]
    own = [shares(n, t + z) if len(a) else a for a, n, t, z in zip(at, meeting["n"], meeting["total"], meeting["size"])]
    starts = np.concatenate([[0], np.cumsum([len(a) for a in at])])
    who, term, p = np.repeat(np.arange(len(names)), np.diff(starts)), np.concatenate(at), np.concatenate(own)
    q0, x, y = p0[who], int(meeting["x"].iloc[0]), int(meeting["y"].iloc[0])
    out: list[tuple[str, str, int]] = []
    for a in range(len(names)):
        dense = np.zeros(BLOCK_TERMS, np.int64)
        dense[at[a]] = own[a]
        other = (block == (y if block[a] == x else x)) & (np.arange(len(names)) != a)
        # a's terms as if the other source lacked them
        values, times = np.unique(own[a], return_counts=True)
        lacking = _f(p0[a], p0)
        change = np.array([int((times * (_f(values, q) - z)).sum()) for q, z in zip(p0, lacking)], np.int64)
        # the other sources' terms: together with a, or alone
        met = dense[term]
        both = np.where(met > 0, _f(np.maximum(met, 1), p) - _f(np.maximum(met, 1), q0), _f(p0[a], p) - lacking[who])
        sums = np.concatenate([[0], np.cumsum(both)])
        change += sums[starts[1:]] - sums[starts[:-1]]
        out += [(names[a], names[b], int(change[b])) for b in np.flatnonzero(other)]
    got = pd.DataFrame(out, columns=["source", "item", "value"])
    got.insert(0, "lang", meeting["lang"].iloc[0])
    return got


def _roster(sums: DataFrame, kept: DataFrame, groups: DataFrame) -> DataFrame:
    """Groups with the language's vocabulary size, their total and the share ``p0`` of a term that the group lacks."""
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("size"))
    totals = sums.where("NOT whole").groupBy("lang", "source").agg(F.sum("total").alias("total"))
    roster = groups.join(sizes, "lang", "left").join(totals, ["lang", "source"], "left").fillna(0, ["size", "total"])
    return staged(roster.withColumn("p0", share(F.lit(0), F.col("total"), F.col("size"))), "divergence-groups")


def audit(
    docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text",
    min_df: int = MIN_DF, top: int = TOP_TERMS, slice_terms: int = SLICE_TERMS,
) -> DataFrame:
    """(lang, source, part, item, value, rank) for every group of documents with one language and source.

    Part ``pair`` lists the other sources of the language by divergence, all of them; part ``term`` the ``top`` terms
    that the group holds a larger share of than its language. Ranks start at 1, largest value first, ties in byte
    order of the item. Null language, source or text counts as ''. Groups without terms take part in pairs; in a
    language that keeps no term all pairs have value 0. A source that is alone in its language has no pair. Very long
    texts are one row of counts like any other; repeated rows count each; an empty table gives no row. Other columns
    are not read, so their names may clash.
    """
    tokens = staged(marked_terms(dealt(docs.select(lang, source, text)), lang, source, text, min_df), "divergence-tokens", "lz4")
    groups = staged(tokens.where("source IS NOT NULL").select("lang", "source").distinct(), "divergence-roster")
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    if (got := group_sums(tokens, min_df, slice_terms)) is None:
        pairs = groups.join(groups.withColumnRenamed("source", "item"), "lang").where("source <> item").withColumn("value", F.lit(0).cast("long"))
        return pairs.withColumns({"rank": place, "part": F.lit("pair")}).select("lang", "source", "part", "item", "value", "rank")
    sums, kept = got
    roster = _roster(sums, kept, groups)
    pairs = pair_values(sums, roster).withColumn("rank", place).withColumn("part", F.lit("pair"))
    telling = term_rows(sums, kept, roster, top).withColumn("rank", place).where(F.col("rank") <= top).withColumn("part", F.lit("term"))
    return pairs.unionByName(telling).select("lang", "source", "part", "item", "value", "rank")
