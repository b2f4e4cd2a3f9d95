"""Exact removal of long strings that occur earlier, by bucket-pointer refinement.

A suffix array sorts all positions by what follows them; to find strings of ``length``
bytes that occur twice, positions need sorting to that depth only. Bucket-pointer
refinement starts with buckets of positions that share their first q bytes and refines
a bucket by the bucket identifiers found at later offsets, using the refined
identifiers again for the next depth; a bucket with one member needs no more work.
Here a bucket's identifier is a number computed from its string, so that tasks that
never meet name the same bucket alike, and each round is a Spark aggregate:

1. *q-gram buckets.* Every window of ``length`` bytes holds a least q-gram (the leftmost
   if several); equal windows hold it at the same place. A position that is the least of
   some windows is an anchor, with an unbroken range of windows. Anchors alone are
   bucketed, about one position in forty. Windows of an anchor alone in its bucket
   occur once, and are done.
2. *Ranges.* The identifier of a window is refined from the identifiers at offsets
   q, 2q and so on by doubling; that of an anchor's range from those of its first and
   last window, which together cover it. In a bucket of equal ranges every one but the
   earliest is a repeat throughout.
3. *Windows.* Where a q-gram bucket holds several ranges, the earliest of each is taken
   apart into buckets of single windows. All but the earliest of a bucket repeat. A q-gram
   bucket of up to ``SMALL_BUCKET`` ranges is sorted within one task, from the ranges'
   strings; the windows of larger ones are rows of their own and aggregated like before.

The texts are read four times and shuffled twice (rounds 1 and 2 move numbers only,
the strings of open ranges and the result need texts by document). No bucket without a
bound is gathered: minima are combined before each shuffle and joined back, and adaptive
execution splits a hot bucket's join. Identifiers have 128 bits, except for q-gram buckets (64), where two
strings sharing a number cost work but no correctness.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickreports.llm import texts
from clickreports.llm.steps import Steps, numbered, without

_ANCHORS = "__row long, k long, s long, first int, n int"
_OPEN = "k long, kinds long, __row long, first int, n int, string binary"
_WINDOWS = "__row long, first int, a long, b long"

SMALL_BUCKET = 32_768  # ranges of a q-gram bucket that are refined within one task, some megabytes


def remove_repeats(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = 100, keep_text: bool = True
) -> DataFrame:
    """Remove every byte covered by a ``length``-byte string that also starts earlier.

    Earlier means in a row of smaller id, or in the same row further left; of rows with
    equal ids, or with none (before all others), the one with the smaller text hash is
    earlier, and of equal rows any one. Strings are judged on the input and never cross
    rows. Null and empty texts have no bytes; texts shorter than ``length`` lose nothing.

    Returns the columns of ``docs``, then ``n_bytes``, ``n_removed``, ``spans`` (start and
    end byte of each maximal removed run) and ``kept_sha256``; input columns of these
    names are replaced. With ``keep_text`` the text column holds what is left; where a
    cut parts a code point, the broken bytes become U+FFFD (``kept_sha256`` is of the
    bytes themselves). Without it the text column is left out.
    """
    if not 16 <= length <= 30_000:
        raise ValueError("length must be 16 to 30000")
    steps = Steps(docs.sparkSession)
    keyed, _ = numbered(docs, id_column, text_column, steps)
    text_rows = keyed.select("__row", F.col(text_column).alias("text")).where(F.octet_length("text") >= length)

    # Anchors are worked out twice: that costs less than keeping those whose bucket is theirs alone.
    grams = text_rows.select("text").mapInArrow(_anchor_rows(length, grams_only=True), "k long")
    shared = grams.groupBy("k").agg(F.count(F.lit(1)).alias("members")).where("members > 1").select("k")
    shared = steps.land("shared", shared)
    anchors = text_rows.mapInArrow(_anchor_rows(length), _ANCHORS)
    active = steps.land("active", anchors.join(shared, "k", "left_semi"))
    steps.drop("shared")

    ranges = active.groupBy("k", "s").agg(
        F.min(F.struct("__row", "first", "n")).alias("least"), F.count(F.lit(1)).alias("members")
    )
    ranges = steps.land("ranges", ranges)
    whole = _all_but_least(active, ranges, ["k", "s"], "d.n")

    kinds = ranges.groupBy("k").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    open_ranges = ranges.join(kinds, "k").select("least.*", "k", "kinds")
    # A row's list is bounded by the row's own bytes, here and below.
    per_row = open_ranges.groupBy("__row").agg(F.collect_list(F.struct("first", "n", "k", "kinds")).alias("at"))
    per_row = steps.land("open", per_row)
    spelled = per_row.join(text_rows, "__row").mapInArrow(_range_texts(length), _OPEN)
    spelled = steps.land("spelled", spelled)
    small = spelled.where(F.col("kinds") <= SMALL_BUCKET).repartition("k").sortWithinPartitions("k")
    near = steps.land("near", small.mapInArrow(_refined(length), "__row long, first int, n int"))
    windows = spelled.where(F.col("kinds") > SMALL_BUCKET).mapInArrow(_window_rows(length), _WINDOWS)
    windows = steps.land("windows", windows)
    steps.drop("spelled", "open")
    earliest = windows.groupBy("a", "b").agg(
        F.min(F.struct("__row", "first")).alias("least"), F.count(F.lit(1)).alias("members")
    )
    single = _all_but_least(windows, earliest, ["a", "b"], F.lit(1).alias("n")).unionByName(near)

    found = whole.unionByName(single)
    covered = found.groupBy("__row").agg(F.sort_array(F.collect_list(F.struct("first", "n"))).alias("__at"))
    covered = steps.land("covered", covered)
    steps.drop("active", "ranges", "windows", "near")
    added = ("n_bytes", "n_removed", "spans", "kept_sha256")
    joined = keyed.join(covered, "__row", "left").select(*without(docs, *added), "__at", _text(text_column))
    fields = [docs.schema[c] for c in without(docs, *added) if keep_text or c != text_column]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    schema += ", n_bytes long, n_removed long, spans array<struct<start:long,stop:long>>, kept_sha256 string"
    return joined.mapInArrow(_cut(length, text_column, [f.name for f in fields]), schema)


def _text(column: str):
    return F.col(column).alias("__text")


def _all_but_least(members: DataFrame, groups: DataFrame, key: list[str], n) -> DataFrame:
    least = groups.where("members > 1").select(*key, "least.__row", "least.first")
    later = (F.col("d.__row") != F.col("e.__row")) | (F.col("d.first") != F.col("e.first"))
    return members.alias("d").join(least.alias("e"), key).where(later).select("d.__row", "d.first", n)


class _Depths:
    """Bucket identifiers of ``length``-byte windows, by doubling from q-grams."""

    def __init__(self, block: texts.Block, length: int, seed: int = 0):
        self.length, self.q = length, length // 4
        self.grams = texts.Rolling(block.data, seed).grams(self.q)
        self._seed = seed

    def windows(self, at: np.ndarray) -> np.ndarray:
        q, g = self.q, self.grams
        half = texts.combine(g[at], g[at + q], self._seed)
        other = texts.combine(g[at + 2 * q], g[at + 3 * q], self._seed)
        deep = texts.combine(half, other, self._seed)
        return deep if 4 * q == self.length else texts.combine(deep, g[at + self.length - q], self._seed)


def _least_in_window(grams: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` positions, the leftmost one with the least upper hash half."""
    least = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    span = 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: span - width], least[width - span :])
    return (least & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _anchor_rows(length: int, grams_only: bool = False):
    def anchors(block: texts.Block):
        depths = _Depths(block, length)
        owner = _least_in_window(depths.grams, length - depths.q + 1)
        starts, stops = block.offsets[:-1], np.maximum(block.offsets[1:] - length + 1, block.offsets[:-1])
        edge = np.zeros(len(block.data) + 1, dtype=np.int32)
        np.add.at(edge, starts, 1)
        np.add.at(edge, stops, -1)
        valid = np.cumsum(edge)[: len(owner)] > 0
        row_start = np.zeros(len(block.data) + 1, dtype=bool)
        row_start[starts] = True
        new = valid.copy()
        new[1:] &= ~valid[:-1] | (owner[1:] != owner[:-1]) | row_start[1 : len(owner)]
        last = valid.copy()
        last[:-1] &= ~valid[1:] | new[1:]
        first, last = np.flatnonzero(new), np.flatnonzero(last)
        if grams_only:
            return depths.grams[owner[first]]
        n = last - first + 1
        kinds = texts.combine(depths.windows(first), depths.windows(last) + n.astype(np.uint64))
        rows = block.rows_of(first)
        return rows, depths.grams[owner[first]], kinds, first - block.offsets[rows], n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in texts.blocks(batch.column("text")):
                if len(block.data) < length:
                    continue
                if grams_only:
                    yield pa.RecordBatch.from_arrays([pa.array(texts.signed(anchors(block)))], ["k"])
                    continue
                ids = np.asarray(batch.column("__row"))
                rows, k, s, first, n = anchors(block)
                columns = [ids[block.lo + rows], texts.signed(k), texts.signed(s), first.astype("i4"), n.astype("i4")]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["__row", "k", "s", "first", "n"])

    return run


def _flat(lists: pa.Array, lo: int, hi: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rows (from 0 at ``lo``) and fields of the entries of rows ``lo`` to ``hi``."""
    part = lists.slice(lo, hi - lo)
    sizes = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(part), 0)).astype(np.int64)
    entries = part.flatten()
    fields = [np.asarray(entries.field(i)).astype(np.int64) for i in range(entries.type.num_fields)]
    return np.repeat(np.arange(hi - lo), sizes), fields


def _expanded(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers ``starts`` to ``starts + sizes`` of every pair, one after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def _range_texts(length: int):
    """The string that each open range's windows cover together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = np.asarray(batch.column("__row")), batch.column("at")
            for block in texts.blocks(batch.column("text")):
                rows, (first, n, k, kinds) = _flat(lists, block.lo, block.hi)
                sizes = n - 1 + length
                data = block.data[_expanded(first + block.offsets[rows], sizes)]
                offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                strings = pa.Array.from_buffers(
                    pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(data)]
                )
                columns = [pa.array(c) for c in (k, kinds, ids[block.lo + rows], first.astype("i4"), n.astype("i4"))]
                yield pa.RecordBatch.from_arrays([*columns, strings], ["k", "kinds", "__row", "first", "n", "string"])

    return run


def _windows_of(batch: pa.RecordBatch | pa.Table, length: int):
    """Of every window of the batch's ranges: its range, place in it, and identifier in two halves."""
    n = batch.column("n").to_numpy().astype(np.int64)
    strings = batch.column("string").to_pylist()
    data = np.frombuffer(b"".join(strings), dtype=np.uint8)
    block = texts.Block(0, len(strings), data, np.cumsum([0, *map(len, strings)]))
    at = _expanded(block.offsets[:-1], n)
    ranges = np.repeat(np.arange(len(n)), n)
    a, b = (_Depths(block, length, seed).windows(at) for seed in (0, 1))
    return ranges, at - block.offsets[ranges], a, b


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 8192) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def _window_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            ranges, place, a, b = _windows_of(batch, length)
            ids, first = np.asarray(batch.column("__row"))[ranges], np.asarray(batch.column("first"))[ranges]
            columns = [ids, (first + place).astype("i4"), texts.signed(a), texts.signed(b)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["__row", "first", "a", "b"])

    return run


def _refined(length: int):
    """Windows that are not the earliest of their bucket, among whole q-gram buckets (rows come sorted by k)."""

    def repeated(table: pa.Table) -> pa.RecordBatch:
        ranges, place, a, b = _windows_of(table, length)
        ids, first = table.column("__row").to_numpy()[ranges], table.column("first").to_numpy()[ranges] + place
        order = np.lexsort((first, ids, b, a))
        same = np.zeros(len(order), dtype=bool)
        same[1:] = (a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1])
        at = np.sort(order[same])
        # Neighbouring windows of one range become one row again.
        new = np.ones(len(at), dtype=bool)
        new[1:] = (np.diff(at) != 1) | (np.diff(ranges[at]) != 0)
        opens = np.flatnonzero(new)
        n = np.diff(np.append(opens, len(at)))
        columns = [ids[at][opens], first[at][opens].astype("i4"), n.astype("i4")]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["__row", "first", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in _slices(batches):
            k = np.asarray(batch.column("k"))
            if not len(k):
                continue
            # Up to the last bucket's start everything is complete.
            cut = int(np.searchsorted(k, k[-1]))
            if cut or (held and held[-1].column("k")[0].as_py() != k[0]):
                yield repeated(pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks())
                held = []
            held.append(batch.slice(cut))
        if held:
            yield repeated(pa.Table.from_batches(held).combine_chunks())

    return run


def removed_runs(first: np.ndarray, n: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal byte runs that windows at ``first`` (ascending), ``n`` each, cover."""
    if not len(first):
        return first, first
    stop = np.maximum.accumulate(first + n - 1 + length)
    opens = np.concatenate(([True], first[1:] > stop[:-1]))
    return first[opens], stop[np.concatenate((opens[1:], [True]))]


def _cut(length: int, text_column: str, columns: list[str]):
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def one(raw: bytes, first: np.ndarray, n: np.ndarray):
        starts, stops = removed_runs(first, n, length)
        cuts = [0, *(x for pair in zip(starts.tolist(), stops.tolist(), strict=True) for x in pair), len(raw)]
        kept = b"".join(raw[cuts[i] : cuts[i + 1]] for i in range(0, len(cuts), 2))
        spans = [{"start": a, "stop": b} for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
        return kept, spans

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, kept, spans, sizes = batch.column("__at"), [], [], []
            for block in texts.blocks(batch.column("__text")):
                rows, (first, n) = _flat(lists, block.lo, block.hi)
                ends = np.searchsorted(rows, np.arange(len(block) + 1))
                for i in range(len(block)):
                    raw = block.row(i)
                    left, cut = one(raw, first[ends[i] : ends[i + 1]], n[ends[i] : ends[i + 1]])
                    kept.append(left)
                    spans.append(cut)
                    sizes.append(len(raw))
            arrays = []
            for name in columns:
                if name == text_column:
                    whole = batch.column("__text").to_pylist()
                    arrays.append(
                        pa.array(
                            [t if t is None else k.decode("utf-8", "replace") for t, k in zip(whole, kept, strict=True)],
                            pa.string(),
                        )
                    )
                else:
                    arrays.append(batch.column(name))
            gone = [size - len(k) for size, k in zip(sizes, kept, strict=True)]
            hashes = [hashlib.sha256(k).hexdigest() for k in kept]
            arrays += [pa.array(sizes, pa.int64()), pa.array(gone, pa.int64())]
            arrays += [pa.array(spans, spans_type), pa.array(hashes, pa.string())]
            names = [*columns, "n_bytes", "n_removed", "spans", "kept_sha256"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run
