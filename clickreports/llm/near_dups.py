"""Near-duplicate documents by SetSketch registers, banding and exact verification.

A document is the set of its word shingles. Its sketch has ``REGISTERS`` registers: each
is the least of an exponentially distributed hash over the set, on a grid of powers of
``SPACING``, cut to 0..255. Registers of a union are the register-wise maxima, and two
sets agree in a register about as often as their Jaccard similarity.

1. One pass over the texts lands sizes, set identifiers and sketches (no shingles).
   Equal sets become one class, so that copies cost one row from here on.
2. Bands of ``BAND`` registers name buckets. Each class of a bucket is paired with the
   bucket's smallest class only. Pairs whose sizes rule the similarity out go, and those
   that the joint likelihood of both sketches rules out (see ``_plausible``).
3. Pairs are verified on the full shingle sets, read once more from the texts of the
   classes concerned. Verified links are joined to components by large-star and
   small-star rounds.
4. What stays apart within a bucket gets its exact turn: the classes outside their
   bucket's main component are matched by prefix filtering (see ``_sharing_prefix``) with
   every class of such a bucket that is not in their component, and verified. Links between
   classes of one component change nothing.

Every register is in two of the 80 bands of 8. A pair at similarity 0.8 shares no bucket
with a probability of about 1e-6, and less with more similarity; the likelihood test errs
with about the same. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickreports.llm import texts
from clickreports.llm.steps import ROW, Steps, numbered

REGISTERS = 320
BAND = 8
LEAST_PERCENT = 80  # below, pairs share no band too often, and sets of under four shingles may be near
SLOTS = 1 << 20  # of shingle counts, which only order shingles
SPACING = 1.1
SHIFT = 14  # registers of the largest hash values, for the smallest sets, are just above 0
MARGIN = 14.0  # in log likelihood
MOST_ROUNDS = 200  # rounds grow with the logarithm of a component; beyond, the job fails

_SKETCHED = "id long, n long, set_a long, set_b long, sketch binary"


def near_duplicates(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    words: int = 5,
    percent: int = 80,
) -> DataFrame:
    """Components of documents linked by Jaccard similarity of at least ``percent`` / 100.

    A-Z are lower-cased; words are runs of bytes other than 0x20 and 0x09-0x0D; a set
    holds the distinct shingles of ``words`` words, or, of a shorter text, the whole
    sequence as one. Null, empty and blank texts have empty sets, linked with nothing.
    Every row is a document of its own, also rows that share an id or have none; their
    ids are whole numbers.

    Returns one row per row of ``docs``: ``doc_id``, ``n_shingles``, ``component_id`` (the
    smallest id reachable, null if no document of the component has one) and ``kept``
    (the id is the component's, or the row is the one that ``one_of_each`` keeps).
    A ``percent`` below ``LEAST_PERCENT`` is refused.
    """
    steps = Steps(docs.sparkSession)
    rows, named = numbered(docs, id_column, text_column, steps, nulls_last=True)
    found = _components(steps, rows, text_column, words, percent)
    if named:
        component = F.col("component").alias("component_id")
        found = found.select(F.col("row").alias("doc_id"), F.col("n").alias("n_shingles"), component)
        return steps.result(found.withColumn("kept", F.col("doc_id") == F.col("component_id")))
    ids = rows.select(F.col(ROW).alias("row"), F.col(id_column).cast("long").alias("doc_id"))
    # Rows ascend with the id: a component's smallest row has its smallest id.
    found = found.join(ids, "row").join(ids.select(F.col("row").alias("component"), F.col("doc_id").alias("component_id")), "component")
    same = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    found = found.select("doc_id", F.col("n").alias("n_shingles"), "component_id", (same | (F.col("row") == F.col("component"))).alias("kept"))
    return steps.result(found)


def one_of_each(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = 5, percent: int = 80
) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component the row of smallest id.

    Of rows that share that id the one of smallest text hash stays; rows without an id
    come after all others. Texts without words are linked with nothing and stay.
    """
    steps = Steps(docs.sparkSession)
    rows, _ = numbered(docs, id_column, text_column, steps, nulls_last=True)
    found = _components(steps, rows, text_column, words, percent)
    gone = steps.land("gone", found.where("row != component").select(F.col("row").alias(ROW)))
    steps.drop("sketched", "grouped")
    return rows.join(gone, ROW, "left_anti").select(*docs.columns)


def _components(steps: Steps, docs: DataFrame, text_column: str, words: int, percent: int) -> DataFrame:
    """``row``, ``n`` and ``component`` (the smallest row reachable) of every row of ``docs``."""
    if percent < LEAST_PERCENT:
        raise ValueError(f"percent is {percent}; bands and least set size hold from {LEAST_PERCENT}")
    rows = docs.select(F.col(ROW).alias("id"), F.col(text_column).alias("text"))
    sketched = steps.land("sketched", rows.mapInArrow(_sketches(words), _SKETCHED))
    # Equal sets are one class, named by its smallest row.
    classes = sketched.where("n > 0").groupBy("set_a", "set_b").agg(
        F.min("id").alias("id"), F.first("n").alias("n"), F.first("sketch").alias("sketch")
    )
    classes = steps.land("classes", classes)
    buckets = steps.land("buckets", _buckets(classes))

    led = buckets.groupBy("bucket").agg(F.min(F.struct("id", "n")).alias("leader"), F.count(F.lit(1)).alias("size"))
    led = led.where("size > 1").select("bucket", "leader.id", "leader.n")
    pairs = _pairs(buckets, led, F.col("a.id") != F.col("b.id"), percent)
    links = steps.land("links", _verified(steps, "first", pairs, classes, rows, words, percent))
    steps.drop("first_pairs", "first_likely", "first_needed", "first_sets")
    labels = connected(steps, "first", links)

    labelled = buckets.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    sizes = labelled.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("size"))
    mixed = sizes.groupBy("bucket").agg(F.max(F.struct("size", "component")).alias("main"), F.count("size").alias("kinds"))
    mixed = mixed.where("kinds > 1").select("bucket", "main.component")
    split = labelled.join(mixed.withColumnRenamed("component", "main"), "bucket")
    split = split.groupBy("id", "component").agg(F.max(F.col("component") != F.col("main")).alias("outer"))
    split = steps.land("split", split)
    steps.drop("buckets")
    rest = _sharing_prefix(steps, split, rows, words, percent)
    steps.drop("split_sets", "prefixes", "prefix_pairs")
    # Components are linked from here on; their inner links are done.
    more = rest.join(split.select(F.col("id").alias("x"), F.col("component").alias("p")), "x")
    more = more.join(split.select(F.col("id").alias("y"), F.col("component").alias("q")), "y")
    upper = connected(steps, "second", more.select(F.col("p").alias("x"), F.col("q").alias("y")))
    upper = upper.select(F.col("id").alias("component"), F.col("component").alias("top"))

    grouped = classes.select("set_a", "set_b", "id").join(labels, "id", "left")
    grouped = grouped.withColumn("component", F.coalesce("component", "id")).join(upper, "component", "left")
    grouped = grouped.select("set_a", "set_b", F.coalesce("top", "component").alias("component"))
    grouped = steps.land("grouped", grouped)
    steps.drop("classes", "split", "links", "prefix_links")
    found = sketched.drop("sketch").join(grouped, ["set_a", "set_b"], "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    return found.select(F.col("id").alias("row"), "n", component.alias("component"))


def shingle_hashes(block: texts.Block, words: int) -> list[np.ndarray]:
    """The distinct shingle hashes, ascending, of every row of a block."""
    lowered = texts.lower_ascii(block.data)
    starts, ends = texts.words(block)
    single = texts.Rolling(lowered).spans(starts, ends)
    at = np.searchsorted(starts, block.offsets)
    whole = single
    for step in range(1, words):
        whole = texts.combine(whole[:-1], single[step:]) if len(whole) > 1 else whole[:0]
    out = []
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if hi - lo >= words:
            out.append(np.unique(whole[lo : hi - words + 1]))
        elif hi > lo:
            one = single[lo : lo + 1]
            for i in range(lo + 1, hi):
                one = texts.combine(one, single[i : i + 1])
            out.append(texts.mix(one, 7 + hi - lo))
        else:
            out.append(single[:0])
    return out


def _sketches(words: int):
    numbers = texts.mix(np.arange(1, 2 * REGISTERS + 1, dtype=np.uint64), 3)
    flips = (numbers[:REGISTERS] >> np.uint64(32)).astype(np.uint32)
    factors = (numbers[REGISTERS:] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)

    def sketch(hashes: np.ndarray) -> bytes:
        short = (hashes >> np.uint64(32)).astype(np.uint32)
        least = np.full(REGISTERS, 0xFFFFFFFF, dtype=np.uint32)
        for lo in range(0, len(short), 256):
            part = short[lo : lo + 256, None] ^ flips
            np.multiply(part, factors, out=part)
            # The low bits of a product know only the low bits of its factors.
            part ^= part >> np.uint32(15)
            np.minimum(least, part.min(axis=0), out=least)
        exponential = -np.log1p(-(least + 0.5) / 2.0**32)
        return np.clip(np.floor(1 - np.log(exponential) / np.log(SPACING)) + SHIFT, 0, 255).astype(np.uint8).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, first, second, sketches = [], [], [], []
            for block in texts.blocks(batch.column("text")):
                for hashes in shingle_hashes(block, words):
                    sizes.append(len(hashes))
                    first.append(int(texts.mix(hashes, 11).sum(dtype=np.uint64).astype(np.int64)))
                    second.append(int(texts.mix(hashes, 12).sum(dtype=np.uint64).astype(np.int64)))
                    sketches.append(sketch(hashes) if len(hashes) else None)
            columns = [pa.array(sizes, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64())]
            columns = [batch.column("id"), *columns, pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n", "set_a", "set_b", "sketch"])

    return run


def _buckets(classes: DataFrame) -> DataFrame:
    """A row per class and band. Sets of under four shingles are near none but their equals."""
    bands = REGISTERS // BAND
    near = f"transform(sequence(0, {bands - 1}), i -> xxhash64(i, substring(sketch, i * {BAND} + 1, {BAND})))"
    across = ", ".join(f"substring(sketch, i + {bands * k} + 1, 1)" for k in range(BAND))
    far = f"transform(sequence(0, {bands - 1}), i -> xxhash64(i + {bands}, {across}))"
    keys = F.expr(f"concat({near}, {far})")
    return classes.where("n >= 4").select(F.explode(keys).alias("bucket"), "id", "n")


def _pairs(left: DataFrame, right: DataFrame, condition, percent: int) -> DataFrame:
    sizes = F.least("a.n", "b.n") * 100 >= F.greatest("a.n", "b.n") * percent
    both = left.alias("a").join(right.alias("b"), F.col("a.bucket") == F.col("b.bucket")).where(condition & sizes)
    return both.select(F.col("a.id").alias("x"), F.col("b.id").alias("y")).distinct()


def _verified(steps: Steps, name: str, pairs: DataFrame, classes: DataFrame, rows: DataFrame, words: int, percent: int):
    """The pairs (x, y) whose shingle sets are as similar as asked."""
    pairs = steps.land(f"{name}_pairs", pairs)
    sketch = classes.groupBy("id").agg(F.first(F.struct("n", "sketch")).alias("of"))
    estimated = pairs.join(sketch.select(F.col("id").alias("x"), F.col("of").alias("p")), "x")
    estimated = estimated.join(sketch.select(F.col("id").alias("y"), F.col("of").alias("q")), "y")
    estimated = estimated.select("x", "y", "p.n", "p.sketch", F.col("q.n").alias("m"), F.col("q.sketch").alias("other"))
    likely = steps.land(f"{name}_likely", estimated.mapInArrow(_plausible(percent / 100), "x long, y long"))
    needed = likely.select(F.col("x").alias("id")).union(likely.select("y")).distinct()
    needed = steps.land(f"{name}_needed", needed)
    sets = rows.join(needed, "id", "left_semi").mapInArrow(_sets(words), "id long, n long, shingles binary")
    sets = steps.land(f"{name}_sets", sets)
    return _compared(likely, sets, percent)


def _sharing_prefix(steps: Steps, split: DataFrame, rows: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (x, y) between an outer class and any class of another component, exactly.

    Shingles are put in one order, rare ones first. Of two sets as similar as asked, each
    has a common shingle among its first (1 - J) n + 1, and where they meet first tells how
    many they can have in common at most; most pairs fall here, before they are rows.
    """
    sets = rows.join(split.select("id"), "id", "left_semi").mapInArrow(_sets(words), "id long, n long, shingles binary")
    sets = steps.land("split_sets", sets)
    counts = sets.select("shingles").mapInArrow(_shingle_counts, "slot int, times long")
    counts = counts.groupBy("slot").agg(F.sum("times").alias("times")).toArrow()  # SLOTS rows at most
    rarity = np.zeros(SLOTS, dtype=np.int64)
    rarity[np.asarray(counts.column("slot").combine_chunks())] = np.asarray(counts.column("times").combine_chunks())
    prefixes = sets.mapInArrow(_prefixes(rarity, percent), "shingle long, place long, id long, n long")
    prefixes = prefixes.join(split, "id")
    prefixes = steps.land("prefixes", prefixes)
    left, right = prefixes.where("outer").alias("a"), prefixes.alias("b")
    most = F.least(F.col("a.n") - F.col("a.place"), F.col("b.n") - F.col("b.place"))
    enough = most * (100 + percent) >= (F.col("a.n") + F.col("b.n")) * percent
    apart = (F.col("a.component") != F.col("b.component")) & (~F.col("b.outer") | (F.col("a.id") > F.col("b.id")))
    pairs = left.join(right, (F.col("a.shingle") == F.col("b.shingle")) & apart & enough)
    pairs = steps.land("prefix_pairs", pairs.select(F.col("a.id").alias("x"), F.col("b.id").alias("y")).distinct())
    return steps.land("prefix_links", _compared(pairs, sets, percent))


def _compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    left = pairs.join(sets.select(F.col("id").alias("x"), F.col("shingles").alias("p")), "x")
    both = left.join(sets.select(F.col("id").alias("y"), F.col("shingles").alias("q")), "y")
    return both.select("x", "y", "p", "q").mapInArrow(_similar(percent), "x long, y long").distinct()


def _shingle_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(SLOTS, dtype=np.int64)
    for batch in batches:
        for cell in batch.column("shingles"):
            np.add.at(counts, np.frombuffer(cell.as_buffer(), np.uint64) % np.uint64(SLOTS), 1)
    slots = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(slots.astype(np.int32)), pa.array(counts[slots])], ["slot", "times"])


def _prefixes(rarity: np.ndarray, percent: int):
    """The first shingles of every set by rarity, with the number of those before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                shingles, places, take = [], [], []
                for row, cell in enumerate(part.column("shingles")):
                    one = np.frombuffer(cell.as_buffer(), np.uint64)
                    size = len(one) - -(-len(one) * percent // 100) + 1 if len(one) else 0
                    first = np.argsort(rarity[one % np.uint64(SLOTS)], kind="stable")[:size]
                    shingles.append(one[first])
                    places.append(np.arange(size))
                    take.append(np.full(size, row))
                which = pa.array(np.concatenate(take))
                columns = [pa.array(texts.signed(np.concatenate(shingles))), pa.array(np.concatenate(places))]
                columns += [part.column(c).take(which) for c in ("id", "n")]
                yield pa.RecordBatch.from_arrays(columns, ["shingle", "place", "id", "n"])

    return run


def _plausible(threshold: float):
    """Drop pairs whose registers say that the similarity is below ``threshold``.

    With the sizes known, a register of one set is above, below or equal to the other's
    with probabilities that depend on the similarity J alone. A pair stays unless the
    likelihood at its best J is e^MARGIN times the best at any J from the threshold up.
    """
    grid = np.linspace(0, 1, 101)
    base = SPACING

    def above(share: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(share, 0, 1) * (base - 1) / base) / np.log(base)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                n, m = (np.asarray(part.column(c)).astype(float)[:, None] for c in ("n", "m"))
                one, other = (
                    np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint8).reshape(-1, REGISTERS)
                    for c in ("sketch", "other")
                )
                more, fewer = ((one > other).sum(1)[:, None], (one < other).sum(1)[:, None])
                u, v = n / (n + m), m / (n + m)
                j = np.minimum(grid, np.minimum(u / v, v / u))
                p, q = above(u - v * j), above(v - u * j)
                tiny = 1e-12
                fit = (
                    more * np.log(p + tiny)
                    + fewer * np.log(q + tiny)
                    + (REGISTERS - more - fewer) * np.log(np.maximum(1 - p - q, 0) + tiny)
                )
                near = np.where(grid >= threshold - 1e-9, fit, -np.inf).max(1)
                stays = fit.max(1) - near <= MARGIN
                yield part.select(["x", "y"]).filter(pa.array(stays))

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in texts.blocks(batch.column("text")):
                hashes = shingle_hashes(block, words)
                columns = [
                    batch.column("id").slice(block.lo, len(block)),
                    pa.array([len(h) for h in hashes], pa.int64()),
                    pa.array([h.tobytes() for h in hashes], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n", "shingles"])

    return run


def _similar(percent: int):
    def linked(p: bytes, q: bytes) -> bool:
        one, other = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
        if len(one) == 0 or len(other) == 0:
            return False
        at = np.minimum(np.searchsorted(other, one), len(other) - 1)
        common = int((other[at] == one).sum())
        return 100 * common >= percent * (len(one) + len(other) - common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, q = batch.column("p"), batch.column("q")
            stays = [linked(p[i].as_buffer(), q[i].as_buffer()) for i in range(batch.num_rows)]
            yield batch.select(["x", "y"]).filter(pa.array(stays, pa.bool_()))

    return run


def connected(steps: Steps, name: str, links: DataFrame) -> DataFrame:
    """``id``, ``component`` (smallest id reachable) of every linked id.

    Large-star hooks the larger neighbours of a vertex to its smallest, small-star the
    smaller ones; both only aggregate minima and join them back. The driver sees the number
    of links and a checksum, and stops when a round changes neither.
    """
    edges = links.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).where("u != v").distinct()
    edges = steps.land(f"{name}_edges", edges)
    seen = None
    for turn in range(MOST_ROUNDS):
        both = edges.unionByName(edges.selectExpr("v AS u", "u AS v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u AND v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hooked = large.join(least, "u")
        small = hooked.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(hooked.select("u", F.col("m").alias("v"))).distinct()
        edges = steps.land(f"{name}_edges{turn}", small)
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        steps.drop(f"{name}_edges{turn - 1}" if turn else f"{name}_edges")
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components are not settled after {MOST_ROUNDS} rounds")
    # Now every vertex hangs on its component's smallest.
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
