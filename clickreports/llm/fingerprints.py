"""Homomorphic multiset hashes of paragraphs: order-independent document fingerprints.

A paragraph hashes to a wide vector and a document's fingerprint is the sum of its
paragraphs' vectors, modulo powers of two. Order does not matter, and a paragraph is put
in or taken out by adding or subtracting its vector. The vector has two parts:

* ``EXACT`` lanes modulo 2^64, uniform numbers from the paragraph's digest. Equal multisets
  have equal lanes, and different ones differ but for a chance of about 2^-256.
* ``COUNTED`` lanes modulo 2^32 in ``TURNS`` equal parts, into one lane of each of which every
  pair of neighbouring words of the paragraph adds or subtracts one, lanes and signs by a
  hash (a single word counts as a pair with nothing). The sum over lanes of squares
  estimates a sum of squared counts, and that of two fingerprints' difference how far the
  multisets are apart. Two frequent pairs that share a lane of one part do so in the
  others with little chance, which bounds the error of texts of a few repeated lines.

Likeness is one minus the squared distance over the sum of both squared lengths, cut to
0..1: about the share of word pairs in common, with a standard error of some hundredths.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickreports.llm import texts
from clickreports.llm.steps import Steps

EXACT = 4
COUNTED = 256
TURNS = 4


class Sums:
    """Fingerprints of many texts at once: word pairs of a block are hashed together."""

    def __init__(self, column: pa.Array):
        self.exact, self.counted = [], []
        for block in texts.blocks(column):
            self._add(block)

    def _add(self, block: texts.Block) -> None:
        starts, ends = texts.words(block)
        line = np.cumsum(block.data == 10, dtype=np.int64)
        single = texts.Rolling(block.data).spans(starts, ends)
        rows = block.rows_of(starts)
        lines = line[starts] if len(starts) else np.zeros(0, np.int64)
        joined = np.zeros(len(starts), dtype=bool)
        joined[:-1] = (rows[:-1] == rows[1:]) & (lines[:-1] == lines[1:])
        following = np.where(joined, np.append(single[1:], np.uint64(0)), np.uint64(0))
        # The last word of a paragraph has no pair of its own unless it is the only one.
        counts = joined | ~np.append(False, joined[:-1])
        hashes = texts.combine(single, following, 21)[counts]
        each = COUNTED // TURNS
        sums = np.zeros((len(block), TURNS, each))
        for turn in range(TURNS):
            lanes = ((hashes >> np.uint64(12 * turn)) % np.uint64(each)).astype(np.int64)
            signs = 1 - 2 * ((hashes >> np.uint64(60 + turn)) & np.uint64(1)).astype(np.int64)
            flat = rows[counts] * each + lanes
            sums[:, turn] = np.bincount(flat, weights=signs, minlength=len(block) * each).reshape(-1, each)
        self.counted.extend(sums.astype(np.int64).reshape(-1, COUNTED))
        for i in range(len(block)):
            digests = b"".join(
                hashlib.blake2b(p, digest_size=8 * EXACT).digest() for p in block.row(i).split(b"\n") if p
            )
            self.exact.append(np.frombuffer(digests, dtype="<u8").reshape(-1, EXACT).sum(axis=0, dtype=np.uint64))


def encoded(exact: np.ndarray, counted: np.ndarray) -> str:
    """A fingerprint as text: both parts in hexadecimal, lanes little-endian."""
    return exact.astype("<u8").tobytes().hex() + (counted % (1 << 32)).astype("<u4").tobytes().hex()


def decoded(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    raw = bytes.fromhex(fingerprint)
    return np.frombuffer(raw[: 8 * EXACT], "<u8"), np.frombuffer(raw[8 * EXACT :], "<i4").astype(np.int64)


def fingerprint(text: str | None) -> str:
    """The fingerprint of one text; null as empty."""
    sums = Sums(pa.array([text], pa.string()))
    return encoded(sums.exact[0], sums.counted[0])


def plus(one: str, other: str, sign: int = 1) -> str:
    """Insert (``sign`` 1) or delete (-1) the paragraphs of ``other``."""
    (a, c), (b, d) = decoded(one), decoded(other)
    return encoded(a + b if sign > 0 else a - b, c + sign * d)


def likeness(one: np.ndarray, other: np.ndarray) -> float:
    """Of the counted lanes of two fingerprints, 0 to 1; two empty texts are alike."""
    one, other = one.astype(float), other.astype(float)
    both, apart = float(one @ one + other @ other), float(((one - other) ** 2).sum())
    return 1.0 if both == 0 else min(1.0, max(0.0, 1.0 - apart / both))


def edited_text(text: str, following: str) -> str:
    """``text`` with its last third (rounded down) replaced by as much of ``following``'s beginning."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def _parts_of(doc_id: Column, spread: Column, borders: list, kind: str, unnamed: int) -> Column:
    """The part of a row: parts follow each other by falling id, null ids last.

    ``borders`` fall; an id that is several borders holds about as many shares of the rows,
    and these are dealt by ``spread``, from 0 to 1, over as many parts in its order.
    ``unnamed`` parts take the null ids.
    """
    distinct = sorted(set(borders), reverse=True)
    times = Counter(borders)
    # Part k holds the ids from border k - 1 downwards; before them come the shares of that border itself.
    shares = [0] + [times[border] if times[border] > 1 else 0 for border in distinct]
    starts = [0, *accumulate(1 + n for n in shares)]
    listed = lambda values, of="int": F.array(*[F.lit(v) for v in values]).cast(f"array<{of}>")
    if distinct:
        # Found in two steps, over every ``stride``-th border and then between two of those.
        stride = max(1, math.isqrt(len(distinct)))
        passed = F.size(F.filter(listed(distinct[stride - 1 :: stride], kind), lambda border: border >= doc_id)) * stride
        between = F.slice(listed(distinct, kind), passed + 1, F.lit(stride))
        k = passed + F.size(F.filter(between, lambda border: border >= doc_id))
        mine = F.get(listed(shares), k)
        own = F.get(listed(distinct, kind), k - 1) == doc_id
        share = F.least(F.floor(spread * mine).cast("int"), mine - 1)
        part = F.get(listed(starts), k) + F.when(own & (mine > 0), share).otherwise(mine)
    else:
        part = F.lit(0)
    last = F.least(F.floor(spread * unnamed).cast("int"), F.lit(unnamed - 1))
    return F.when(doc_id.isNull(), F.lit(starts[-1]) + last).otherwise(part).cast("int")


def compare_neighbours(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Fingerprint every text, its edited form and its neighbour.

    The neighbour is the next row by falling id; after the last comes the first. Rows
    that share an id follow by a hash of their text, and so do null ids, which come last.
    Null texts are empty, and a single row is its own neighbour. Paragraphs are the non-empty lines.

    Texts move once: partitions are ranges of the id, and of the text's hash where one id
    fills several, and each also gets the row that follows its last one, so that neighbours
    meet without joining texts to texts. Returns ``doc_id``, ``n_chars``, ``edited_sha256``,
    ``fingerprint``, ``edited_fingerprint``, ``near_edited``, ``near_next``.
    """
    spark = docs.sparkSession
    steps = Steps(spark)
    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(text_column, F.lit("")).alias("text"))
    rows = rows.withColumn("hash", F.xxhash64("text"))
    # As many parts as the cluster's partitions ask for, whatever the table's size.
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / parts for i in range(1, parts)]
    found = rows.agg(
        F.percentile_approx("doc_id", shares, 20 * parts).alias("at"), F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("named")
    ).first()
    unnamed = max(1, math.ceil(parts * (found["n"] - found["named"]) / max(1, found["n"])))
    spread = (F.col("hash").cast("double") + 2.0**63) / 2.0**64
    part = _parts_of(F.col("doc_id"), spread, found["at"] or [], kind, unnamed)
    placed = rows.withColumn("part", part)
    # The first row of every part goes to the part before it as well, as its closing row.
    tops = placed.groupBy("part").agg(F.max(F.struct("doc_id", F.bitwise_not("hash").alias("hash"))).alias("top"))
    tops = steps.land("tops", tops.select(F.col("part").alias("top_part"), "top"))
    # One row per part.
    first = F.col("doc_id").eqNullSafe(F.col("top.doc_id")) & (F.col("hash") == F.bitwise_not("top.hash"))
    same = (F.col("part") == F.col("top_part")) & first
    heads = placed.join(F.broadcast(tops), same).groupBy("part").agg(F.min("text").alias("text"))
    heads = steps.land("heads", heads)
    present = sorted(r["part"] for r in heads.select("part").collect())
    before = {p: present[i - 1] for i, p in enumerate(present)}
    moved = F.create_map(*[F.lit(x) for pair in before.items() for x in pair]) if before else F.create_map()
    closing = heads.select(
        F.element_at(moved, F.col("part")).alias("part"), F.lit(1).alias("last"), F.lit(None).cast(kind).alias("doc_id"), F.lit(0).cast("long").alias("hash"), "text"
    )
    all_rows = placed.select("part", F.lit(0).alias("last"), "doc_id", "hash", "text").unionByName(closing)
    dealt = all_rows.repartition("part").sortWithinPartitions(
        "part", "last", F.col("doc_id").desc_nulls_last(), "hash", "text"
    )
    dealt = dealt.drop("hash")
    schema = (
        f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )
    return dealt.mapInArrow(_compared, schema)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a part in order, its closing row last; parts follow each other whole."""
    held: list[tuple] = []
    size = 0
    for batch in batches:
        ids = batch.column("doc_id")
        for i, (last, text) in enumerate(zip(batch.column("last").to_pylist(), batch.column("text").to_pylist(), strict=True)):
            held.append((last, ids.slice(i, 1), text))
            size += len(text)
            if size > texts.BLOCK_BYTES and len(held) > 1:
                yield _finished(held)
                held, size = held[-1:], len(text)
    if len(held) > 1:
        yield _finished(held)


def _finished(held: list[tuple]) -> pa.RecordBatch:
    """Results of all rows but the last, which is the one before it's neighbour."""
    own = [text for _, _, text in held]
    edited = [edited_text(a, b) for a, b in zip(own, own[1:], strict=False)]
    sums = Sums(pa.array(own, pa.large_string()))
    others = Sums(pa.array(edited, pa.large_string()))
    at = [i for i in range(len(held) - 1) if not held[i][0]]
    columns = [
        pa.concat_arrays([held[i][1] for i in at]) if at else held[0][1].slice(0, 0),
        pa.array([len(own[i]) for i in at], pa.int64()),
        pa.array([hashlib.sha256(edited[i].encode()).hexdigest() for i in at], pa.string()),
        pa.array([encoded(sums.exact[i], sums.counted[i]) for i in at], pa.string()),
        pa.array([encoded(others.exact[i], others.counted[i]) for i in at], pa.string()),
        pa.array([likeness(sums.counted[i], others.counted[i]) for i in at], pa.float64()),
        pa.array([likeness(sums.counted[i], sums.counted[i + 1]) for i in at], pa.float64()),
    ]
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return pa.RecordBatch.from_arrays(columns, names)
