"""Ranked lexical search over document FP-trees.

A document counts only by the terms that the queries use: its term vector, restricted to
them and ordered by falling document frequency. Each task builds tries over the vectors
of ``TRIE_DOCS`` documents at a time, where equal beginnings share a path. A node keeps
the largest tf of its term and the least m among the documents below it; subtrees of up
to ``SUBTREE_DOCS`` documents keep the largest tf of every term they hold as well. Per query
the subtrees are visited depth first: one whose bound, the score of a document with all
those maxima and the least m, is under the query's ``k``-th best score so far is left out;
in the others the bounds are added up along the paths, and only documents whose path still
reaches that score are scored exactly. Scores are whole numbers and bounds are never
below them, so the result is exact.

Texts are read once and their restricted vectors landed. Queries come in blocks of about
``BLOCK_TERMS`` terms, which bounds what is broadcast: the block's terms, weights and
queries. A task keeps ``k`` rows a query; tasks' lists are merged in two steps.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clickreports.llm import texts
from clickreports.llm.steps import Steps

BLOCK_TERMS = 1 << 18
TRIE_DOCS = 8192
TRIE_POSTINGS = 1 << 21
SUBTREE_DOCS = 256
MERGED = 256  # groups of tasks whose lists are merged first

_TERM_BYTES = np.array([chr(b).isalnum() and b < 128 or b >= 128 for b in range(256)])


def search(
    docs: DataFrame, queries: DataFrame, k: int = 50, id_column: str = "doc_id", query_column: str = "item_id", text_column: str = "text"
) -> DataFrame:
    """The ``k`` best documents for every query, scores above 0 only.

    Terms are runs of ASCII letters, digits and bytes above 0x7F, A-Z in lower case, in the
    whole text; null and empty texts have none. N documents have a term, L is the number
    of all their terms, n of one document's, df the documents that hold a term, tf how
    often one does. A term weighs w = floor(1000 * ln((2N + 2) / (2df + 1))); m is
    50 + 50 * n * N div L; a document scores the sum of w * (10^9 * tf div (1000 * tf + 20 * m))
    over the query's distinct terms.

    Every row of ``docs`` is a document, also if rows share an id. Query rows that share an
    id are one query with the terms of all. Ties go to the smaller id, rows without one
    come last. Ids are whole numbers; other columns play no part, whatever their names.
    Terms are compared by 64-bit hashes. Returns ``item_id``, ``rank`` (from 1), ``doc_id``, ``score``.
    """
    spark = docs.sparkSession
    steps = Steps(spark)
    asked = queries.select(F.col(query_column).cast("long").alias("item"), F.col(text_column).alias("text"))
    asked = asked.mapInArrow(_item_terms, "item long, term string").distinct()
    asked = asked.groupBy("item").agg(F.sort_array(F.collect_list("term")).alias("terms"))
    asked = steps.land("items", asked)
    total = asked.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // BLOCK_TERMS))
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    lists = None
    for block in range(blocks):
        # At most about BLOCK_TERMS terms, dealt by a hash of the query.
        mine = asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).sort("item").collect()
        found = _block(spark, steps, rows, mine, block, k)
        lists = found if lists is None else lists.unionByName(found)
    order = (F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    best = Window.partitionBy("item_id", F.col("part") % MERGED).orderBy(*order)
    lists = lists.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    best = Window.partitionBy("item_id").orderBy(*order)
    ranked = lists.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return steps.result(ranked.select("item_id", "rank", "doc_id", "score"))


def _block(spark: SparkSession, steps: Steps, rows: DataFrame, asked: list, block: int, k: int) -> DataFrame:
    terms = sorted({term for item in asked for term in item["terms"]})
    number = {term: i for i, term in enumerate(terms)}
    hashes = _hashes(terms)
    order = np.argsort(hashes)
    known = spark.sparkContext.broadcast((hashes[order], order))
    vectors = steps.land(f"vectors_{block}", rows.mapInArrow(_vectors(known), "doc_id long, n long, terms array<int>, tfs array<int>"))
    n_docs, n_terms = vectors.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    counted = vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    df = np.zeros(len(terms), dtype=np.int64)
    for term, n in counted.collect():  # one row a term of the block
        df[term] = n
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for n in df.tolist()], dtype=np.int64)
    by_frequency = np.argsort(-df, kind="stable")
    place = np.empty(len(terms), dtype=np.int64)
    place[by_frequency] = np.arange(len(terms))
    items = [np.sort(place[[number[t] for t in item["terms"]]]) for item in asked]
    names = [item["item"] for item in asked]
    shared = spark.sparkContext.broadcast((place, weights[by_frequency], items, names, n_docs, n_terms, k))
    found = vectors.where(F.size("terms") > 0).mapInArrow(_searched(shared), "part int, item_id long, doc_id long, score long")
    found = steps.land(f"lists_{block}", found)
    steps.drop(f"vectors_{block}")
    return found


def _spans(block: texts.Block) -> tuple[np.ndarray, np.ndarray]:
    return texts.runs(block, _TERM_BYTES[block.data])


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        items, found = [], []
        ids = batch.column("item").to_pylist()
        for block in texts.blocks(batch.column("text")):
            data = texts.lower_ascii(block.data)
            starts, ends = _spans(block)
            for row, a, b in zip(block.rows_of(starts), starts, ends, strict=True):
                items.append(ids[block.lo + row])
                found.append(data[a:b].tobytes().decode())
        yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.array(found, pa.string())], ["item", "term"])


def _hashes(terms: list[str]) -> np.ndarray:
    raw = [term.encode() for term in terms]
    ends = np.cumsum([len(x) for x in raw], dtype=np.int64)
    starts = ends - np.array([len(x) for x in raw], dtype=np.int64)
    return texts.Rolling(np.frombuffer(b"".join(raw), dtype=np.uint8)).spans(starts, ends)


def _vectors(known):
    """Documents with a term: their number of terms, the block's terms among them and their tf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, numbers = known.value
        for batch in batches:
            for block in texts.blocks(batch.column("text")):
                starts, ends = _spans(block)
                rows = block.rows_of(starts)
                n = np.bincount(rows, minlength=len(block))
                found = texts.Rolling(texts.lower_ascii(block.data)).spans(starts, ends)
                at = np.minimum(np.searchsorted(hashes, found), max(0, len(hashes) - 1))
                hit = hashes[at] == found if len(hashes) else np.zeros(len(found), dtype=bool)
                width = max(1, len(hashes))
                pairs, tfs = np.unique(rows[hit] * width + numbers[at[hit]], return_counts=True)
                has = np.flatnonzero(n)
                sizes = np.bincount(pairs // width, minlength=len(block))[has]
                offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (pairs % width, tfs)]
                ids = batch.column("doc_id").slice(block.lo, len(block)).take(pa.array(has))
                yield pa.RecordBatch.from_arrays([ids, pa.array(n[has].astype(np.int64)), *lists], ["doc_id", "n", "terms", "tfs"])

    return run


def _gain(weights, tfs: np.ndarray, m: np.ndarray) -> np.ndarray:
    """A term's part of a score; it rises with tf and falls with m."""
    return weights * ((1_000_000_000 * tfs) // (1000 * tfs + 20 * m))


def _flat(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions of all spans, one after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class Trie:
    """Term vectors in the order of their paths, the nodes and the subtrees over them.

    ``places`` are terms by falling frequency and ascend within a document; ``offsets``
    are where each document's begin.
    """

    def __init__(self, ids: np.ndarray, missing: np.ndarray, m: np.ndarray, offsets: np.ndarray, places: np.ndarray, tfs: np.ndarray, terms: int):
        keys = [places[a:b].astype(">u4").tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        order = np.array(sorted(range(len(keys)), key=keys.__getitem__))
        sizes = np.diff(offsets)[order]
        at = _flat(offsets[:-1][order], sizes)
        self.ids, self.missing, self.m = ids[order], missing[order], m[order]
        self.places, self.tfs = places[at], tfs[at].astype(np.int64)
        self.sizes, self.starts = sizes, np.cumsum(sizes) - sizes
        self._doc = np.repeat(np.arange(len(sizes)), sizes)
        self._nodes()
        self._subtrees(terms)

    def _nodes(self) -> None:
        depth = np.arange(len(self.places)) - self.starts[self._doc]
        above = np.maximum(self._doc - 1, 0)
        same = (self._doc > 0) & (depth < self.sizes[above])
        same[same] = self.places[(self.starts[above] + depth)[same]] == self.places[same]
        differ = np.cumsum(~same)
        opens = differ > (differ - ~same)[self.starts[self._doc]]  # the path differs from the document before
        by_depth = np.argsort(depth, kind="stable")
        first = np.flatnonzero(opens[by_depth])
        lead = by_depth[first]
        node = np.empty(len(by_depth), dtype=np.int64)
        node[by_depth] = np.cumsum(opens[by_depth]) - 1
        self._node_of = node
        term, low = self.places[lead], self._doc[lead]
        count = np.diff(np.append(first, len(by_depth)))
        tf = np.maximum.reduceat(self.tfs[by_depth], first)
        m = np.minimum.reduceat(self.m[self._doc[by_depth]], first)
        self._count = count
        # The header table: nodes by term, then place; those of one term hold different documents.
        self.span = len(self.sizes) + 1
        header = np.lexsort((low, term))
        self.header = (term * self.span + low)[header]
        self.node_low, self.node_high = low[header], (low + count)[header]
        self.node_tf, self.node_m = tf[header], m[header]

    def _subtrees(self, terms: int) -> None:
        """Cut the documents into runs of neighbouring subtrees, each whole if it fits."""
        fits = self._count[self._node_of] <= SUBTREE_DOCS
        top = np.full(len(self.sizes), -1, dtype=np.int64)
        # The topmost fitting node of a document; without one its deepest, which a group of equal vectors shares.
        at = np.flatnonzero(fits)[::-1]
        top[self._doc[at]] = self._node_of[at]
        none = top < 0
        top[none] = self._node_of[(self.starts + self.sizes - 1)[none]]
        edges = np.flatnonzero(np.diff(top, prepend=-2))
        cuts, last = [0], 0
        for edge, following in zip(edges, np.append(edges[1:], len(top)), strict=True):
            if following - last > SUBTREE_DOCS and edge > last:
                cuts.append(int(edge))
                last = edge
        self.cuts = np.array([*cuts, len(top)])
        subtree = np.searchsorted(self.cuts, np.arange(len(top)), side="right") - 1
        self.most = np.zeros((len(cuts), terms), dtype=np.int32)
        np.maximum.at(self.most, (subtree[self._doc], self.places), self.tfs.astype(np.int32))
        self.least_m = np.minimum.reduceat(self.m, self.cuts[:-1])

    def within(self, item: np.ndarray, gains: np.ndarray, weights: np.ndarray, subtree: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents of one subtree that score at least ``least``, and their scores.

        ``gains`` bounds each of the item's terms within the subtree.
        """
        low, high = self.cuts[subtree], self.cuts[subtree + 1]
        held = gains > 0
        item, gains, weights = item[held], gains[held], weights[held]
        first = np.maximum(np.searchsorted(self.header, item * self.span + low, side="right") - 1, 0)
        sizes = np.searchsorted(self.header, item * self.span + high) - first
        nodes, which = _flat(first, sizes), np.repeat(np.arange(len(item)), sizes)
        on = (self.header[nodes] // self.span == item[which]) & (self.node_high[nodes] > low)
        nodes, which = nodes[on], which[on]
        bound = np.minimum(_gain(weights[which], self.node_tf[nodes], self.node_m[nodes]), gains[which])
        change = np.zeros(high - low + 1, dtype=np.int64)
        np.add.at(change, np.maximum(self.node_low[nodes], low) - low, bound)
        np.add.at(change, np.minimum(self.node_high[nodes], high) - low, -bound)
        docs = np.flatnonzero(np.cumsum(change[:-1]) >= least) + low
        if not len(docs):
            return docs, docs
        postings = _flat(self.starts[docs], self.sizes[docs])
        owner = np.repeat(np.arange(len(docs)), self.sizes[docs])
        found = np.minimum(np.searchsorted(item, self.places[postings]), len(item) - 1)
        hit = item[found] == self.places[postings]
        postings, owner, found = postings[hit], owner[hit], found[hit]
        scores = np.zeros(len(docs), dtype=np.int64)
        np.add.at(scores, owner, _gain(weights[found], self.tfs[postings], self.m[docs][owner]))
        enough = scores >= least
        return docs[enough], scores[enough]


class Best:
    """A query's best documents so far."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids, self.missing = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    @property
    def least(self) -> int:
        return max(1, int(self.scores[-1])) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> None:
        columns = [np.concatenate(x) for x in ((self.scores, scores), (self.ids, ids), (self.missing, missing))]
        order = np.lexsort((columns[1], columns[2], -columns[0]))[: self.k]
        self.scores, self.ids, self.missing = (x[order] for x in columns)


def _tries(batches: Iterator[pa.RecordBatch], place: np.ndarray, n_docs: int, n_terms: int) -> Iterator[Trie]:
    held: list[tuple] = []

    def trie() -> Trie:
        ids, missing, n, sizes, places, tfs = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        m = 50 + (50 * n * n_docs) // n_terms
        # A document's terms by falling frequency.
        owner = np.repeat(np.arange(len(sizes)), sizes)
        order = np.lexsort((places, owner))
        offsets = np.concatenate(([0], np.cumsum(sizes)))
        return Trie(ids, missing, m, offsets, places[order], tfs[order], len(place))

    for whole in batches:
        for lo in range(0, whole.num_rows, 1024):
            batch = whole.slice(lo, 1024)
            ids, terms = batch.column("doc_id"), batch.column("terms")
            held.append(
                (
                    np.asarray(ids.fill_null(0)).astype(np.int64),
                    np.asarray(ids.is_null()).astype(bool),
                    np.asarray(batch.column("n")).astype(np.int64),
                    np.asarray(terms.value_lengths()).astype(np.int64),
                    place[np.asarray(terms.flatten())],
                    np.asarray(batch.column("tfs").flatten()),
                )
            )
            if sum(len(x[0]) for x in held) >= TRIE_DOCS or sum(len(x[4]) for x in held) >= TRIE_POSTINGS:
                yield trie()
    if held:
        yield trie()


def _searched(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, weights, items, names, n_docs, n_terms, k = shared.value
        best = [Best(k) for _ in items]
        edges = np.concatenate(([0], np.cumsum([len(x) for x in items]))).astype(np.int64)
        flat = np.concatenate(items) if items else np.zeros(0, np.int64)
        for trie in _tries(batches, place, n_docs, n_terms):
            for subtree, (most, m) in enumerate(zip(trie.most, trie.least_m, strict=True)):
                gains = np.append(_gain(weights[flat], most[flat].astype(np.int64), m), 0)
                bounds = np.add.reduceat(gains, edges[:-1])
                least = np.array([b.least for b in best])
                for i in np.flatnonzero(bounds >= least):
                    span = slice(edges[i], edges[i + 1])
                    docs, scores = trie.within(items[i], gains[span], weights[items[i]], subtree, best[i].least)
                    if len(docs):
                        best[i].add(scores, trie.ids[docs], trie.missing[docs])
        part = TaskContext.get().partitionId()
        for name, b in zip(names, best, strict=True):
            n = len(b.scores)
            if n:
                ids = pa.array(b.ids, pa.int64(), mask=b.missing)
                columns = [pa.array([part] * n, pa.int32()), pa.array([name] * n, pa.int64()), ids, pa.array(b.scores)]
                yield pa.RecordBatch.from_arrays(columns, ["part", "item_id", "doc_id", "score"])

    return run
