"""Language-model scores: a word baseline and a subword lattice.

The base model counts words of the training documents, add-one smoothed. The lattice
scores a text as a sequence of units: the pieces of an existing subword vocabulary and, as
longer edges, the words known from training. A unit has a probability, a segmentation the
product of its units', and the text the sum over all segmentations that spell it, by a
forward recursion in logs over byte positions. Every word starts with the vocabulary's
space mark and no piece has one inside, so the sum falls into a product over words and a
word is worked out once per block of texts. A word seen n times among N in training, V
distinct, is the known word's edge with weight n, or spelt by pieces with weight V + 1, of
N + V + 1 in all: V + 1 words have been new so far.

The pieces' probabilities are estimated by expectation: from the vocabulary's own segmentation
of the distinct training words, ``ROUNDS`` rounds (one, as each reads all distinct words) of forward and backward sums over each
word's lattice give every piece's expected number of uses. Each distinct word counts once,
for pieces spell words that are new.

Beside it stands a mixture over classes of training documents (their language): words are
drawn from the counts of one class, else like above, by a Dirichlet-multinomial process, by
which a word used once is likelier again; the text's probability is the sum over all classes.

Learning reads all training documents: words are counted by a Spark aggregate, and the
expected uses of pieces summed over the distinct words by another. Scoring needs a count
for every word of every document. The most frequent words (``HEAD_WORDS`` at most) go to all
tasks; the others are joined by word, one row per document and word, so hot words never
meet in one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickreports.llm import texts
from clickreports.llm.steps import Steps

HEAD_WORDS = 200_000
FOLDS = 7
HELD_OUT = 2
CLASSES = 8  # the most frequent ones; all others form the last
CONCENTRATION = 1000.0  # of the mixture: training words that weigh as much as the text's own; not fitted to any text
ROUNDS = 1
SPACE = "▁"
_LOG10 = math.log(10.0)
_FLUSH = 1_000_000


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


class _Words:
    """The lower-cased words of a block, and its distinct ones."""

    def __init__(self, block: texts.Block):
        data = texts.lower_ascii(block.data)
        starts, ends = texts.words(block)
        self.rows = block.rows_of(starts)
        hashes = texts.Rolling(data).spans(starts, ends)
        self.hashes, first, self.of = np.unique(hashes, return_index=True, return_inverse=True)
        # A hash stands for its first word; two words of a block sharing one is out of reach.
        self.data, self.starts, self.ends = data, starts[first], ends[first]

    def texts(self, which: np.ndarray) -> pa.Array:
        starts, ends = self.starts[which], self.ends[which]
        sizes = ends - starts
        at = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
        return pa.StringArray.from_buffers(len(which), pa.py_buffer(offsets), pa.py_buffer(self.data[at]))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and their counts by class, merged within the task as far as memory allows."""
    held: list[pa.Table] = []
    size = 0
    names = ["word", "class", "n"]

    def merged(parts: list[pa.Table]) -> pa.Table:
        table = pa.concat_tables(parts).group_by(["word", "class"]).aggregate([("n", "sum")])
        return table.rename_columns({"n_sum": "n"}).select(names)

    for batch in batches:
        for block in texts.blocks(batch.column("text")):
            words = _Words(block)
            of_row = np.asarray(batch.column("class").slice(block.lo, len(block)))
            pairs, counts = np.unique(words.of * CLASSES + of_row[words.rows], return_counts=True)
            columns = [words.texts(pairs // CLASSES), (pairs % CLASSES).astype(np.int32), counts.astype(np.int64)]
            held.append(pa.table(columns, names))
            size += len(pairs)
            if size > _FLUSH:
                table = merged(held)
                held, size = [table], table.num_rows
                if size > _FLUSH // 2:
                    yield from table.to_batches(50_000)
                    held, size = [], 0
    if held:
        yield from merged(held).to_batches(50_000)


class Pieces:
    """A piece vocabulary as byte strings with log probabilities, looked up by hash."""

    def __init__(self, pieces: list[bytes], logs: np.ndarray):
        spans = np.cumsum([0, *(len(p) for p in pieces)])
        hashes = texts.Rolling(np.frombuffer(b"".join(pieces), np.uint8), 5).spans(spans[:-1], spans[1:])
        self.order = np.argsort(hashes)
        self.hashes, self.logs = hashes[self.order], logs[self.order]
        self.sizes = np.unique([len(p) for p in pieces])

    def word_logs(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Log of the summed probability of all segmentations of each word, space mark first."""
        out = np.empty(len(starts))
        for some, size in _alike(ends - starts, 1 << 17):
            lengths, ending, _ = self._edges(data, starts[some], size, placed=False)
            out[some] = _forward(lengths, ending)[-1]
        return out

    def expected(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Expected uses of every piece in the given words, each once."""
        totals = np.zeros(len(self.logs))
        for some, size in _alike(ends - starts, 1 << 16):
            lengths, ending, at = self._edges(data, starts[some], size)
            reach, rest = _forward(lengths, ending), _backward(lengths, ending)
            for k, length in enumerate(lengths.tolist()):
                uses = np.exp(reach[:-length] + ending[k, length:] + rest[length:] - reach[-1])
                totals += np.bincount(at[k, length:].ravel(), weights=uses.ravel(), minlength=len(totals))
        out = np.empty(len(totals))
        out[self.order] = totals
        return out

    def _edges(self, data: np.ndarray, starts: np.ndarray, size: int, placed: bool = True):
        """Piece lengths, and by length, end and word the log probability of the piece there (-inf: none) and its place."""
        count, width = len(starts), size + 1
        grid = np.empty((count, width), dtype=np.uint8)
        grid[:, 0] = 32
        grid[:, 1:] = data[starts[:, None] + np.arange(size)]
        rolling = texts.Rolling(grid.ravel(), 5)
        lengths = self.sizes[self.sizes <= width]
        ending = np.full((len(lengths), width + 1, count), -np.inf)
        places = np.zeros((len(lengths), width + 1, count), dtype=np.int32) if placed else None
        base = np.arange(count) * width
        for k, length in enumerate(lengths.tolist()):
            ends = np.arange(length, width + 1)[:, None] + base
            hashes = rolling.spans(ends - length, ends)
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            ending[k, length:] = np.where(self.hashes[at] == hashes, self.logs[at], -np.inf)
            if placed:
                places[k, length:] = at
        return lengths, ending, places


def _alike(sizes: np.ndarray, cells: int) -> Iterator[tuple[np.ndarray, int]]:
    """Places of equal sizes, in parts of about so many cells."""
    order = np.argsort(sizes, kind="stable")
    lo = 0
    while lo < len(order):
        size = int(sizes[order[lo]])
        hi = int(np.searchsorted(sizes[order], size, side="right"))
        step = max(1, cells // (size + 1))
        for a in range(lo, hi, step):
            yield order[a : min(hi, a + step)], size
        lo = hi


def _summed(ways: np.ndarray) -> np.ndarray:
    top = ways.max(axis=0)
    # Byte pieces reach every place.
    return top + np.log(np.exp(ways - top).sum(axis=0))


def _forward(lengths: np.ndarray, ending: np.ndarray) -> np.ndarray:
    """By place, the log of the summed probability of all ways to it."""
    reach = np.full(ending.shape[1:], -np.inf)
    reach[0] = 0.0
    for end in range(1, len(reach)):
        usable = lengths <= end
        reach[end] = _summed(reach[end - lengths[usable]] + ending[usable, end])
    return reach


def _backward(lengths: np.ndarray, ending: np.ndarray) -> np.ndarray:
    """By place, the log of the summed probability of all ways from it to the end."""
    rest = np.full(ending.shape[1:], -np.inf)
    rest[-1] = 0.0
    width = len(rest) - 1
    for start in range(width - 1, -1, -1):
        usable = np.flatnonzero(lengths <= width - start)
        stops = start + lengths[usable]
        rest[start] = _summed(rest[stops] + ending[usable, stops])
    return rest


def _log(counts: np.ndarray) -> np.ndarray:
    return np.log(counts, out=np.full(len(counts), -np.inf), where=counts > 0)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Of numbers from eight on, by Stirling's series."""
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)


def log_rising(log_a: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Log of a(a + 1)...(a + times - 1), from the log of a."""
    out = np.where(times > 0, log_a, 0.0)
    for j in range(1, 8):
        more = np.flatnonzero(times > j)
        out[more] += np.log(np.exp(log_a[more]) + j)
    far = np.flatnonzero(times > 8)
    a = np.exp(log_a[far])
    out[far] += _log_gamma(a + times[far]) - _log_gamma(a + 8)
    return out


@dataclass(frozen=True)
class Mixture:
    """Training documents, words and distinct words by class, and distinct words of all."""

    docs: np.ndarray
    words: np.ndarray
    types: np.ndarray
    all_types: int

    def shared(self, n: np.ndarray, lattice: np.ndarray) -> np.ndarray:
        """Log probability of words seen ``n`` times in training, from their lattice's."""
        spelt = self.all_types + 1
        return np.logaddexp(_log(n), math.log(spelt) + lattice) - math.log(self.words.sum() + spelt)

    def draws(self, k: int, n: np.ndarray, shared: np.ndarray) -> np.ndarray:
        """Log weight of words seen ``n`` times in class ``k``, to be drawn with ``log_rising``."""
        other = self.types[k] + 1
        p = np.logaddexp(_log(n), math.log(other) + shared) - math.log(self.words[k] + other)
        return p + math.log(CONCENTRATION)

    def frame(self, k: int, length: np.ndarray) -> np.ndarray:
        """Log probability of class ``k`` and of a text of ``length`` words, without the words' own."""
        end = (self.docs[k] + 1) / (self.docs[k] + self.words[k] + 2)
        prior = (self.docs[k] + 1) / (self.docs.sum() + len(self.docs))
        total = log_rising(np.full(len(length), math.log(CONCENTRATION)), length)
        return math.log(prior) + math.log(end) + length * math.log1p(-end) - total


def _classes(training: DataFrame, column: str | None) -> tuple[list, list[int]]:
    """The most frequent values of a column, and the number of rows of each and, last, of all others."""
    if column is None:
        return [], [training.count()]
    by_class = training.groupBy("label").count().orderBy(F.col("count").desc(), "label")
    rows = by_class.limit(CLASSES - 1).collect()
    others = training.count() - sum(r["count"] for r in rows)
    return [r["label"] for r in rows], [r["count"] for r in rows] + [others]


@lru_cache(maxsize=2)
def _vocabulary(path: str) -> tuple[list[bytes], dict[int, int]]:
    """Distinct byte strings of a subword model's pieces, and each piece id's place among them.

    The space mark counts as one space byte. Byte pieces spell one byte each, so every
    text has a segmentation; pieces with a space mark inside, and control pieces, are left out.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    strings: dict[bytes, int] = {}
    place = {}
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            continue
        piece = model.id_to_piece(i)
        raw = bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace(SPACE, " ").encode()
        if raw and b" " not in raw[1:]:
            place[i] = strings.setdefault(raw, len(strings))
    for byte in range(256):
        strings.setdefault(bytes([byte]), len(strings))
    return list(strings), place


def _piece_counts(path: str):
    """Pieces of the vocabulary's own segmentation of words, each word once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        strings, place = _vocabulary(path)
        of = np.full(model.get_piece_size(), -1, dtype=np.int64)
        of[list(place)] = list(place.values())
        totals = np.zeros(len(strings))
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                found = model.encode(batch.column("word").slice(lo, 4096).to_pylist(), num_threads=1)
                ids = of[np.fromiter((i for f in found for i in f), dtype=np.int64)]
                totals += np.bincount(ids[ids >= 0], minlength=len(strings))
        yield _used(totals)

    return run


def _expected_counts(model: Pieces):
    """Expected uses of pieces over the lattices of words, each word once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(len(model.logs))
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                raw = [w.encode() for w in batch.column("word").slice(lo, 4096).to_pylist()]
                spans = np.cumsum([0, *map(len, raw)])
                totals += model.expected(np.frombuffer(b"".join(raw), np.uint8), spans[:-1], spans[1:])
        yield _used(totals)

    return run


def _used(totals: np.ndarray) -> pa.RecordBatch:
    used = np.flatnonzero(totals)
    return pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(totals[used])], ["piece", "n"])


def _fitted(counts: DataFrame, vocabulary: str) -> Pieces:
    """The vocabulary's pieces with probabilities estimated on the distinct words of ``counts``."""
    strings, _ = _vocabulary(vocabulary)
    model = None
    for _ in range(ROUNDS + 1):
        step = _piece_counts(vocabulary) if model is None else _expected_counts(model)
        used = counts.select("word").mapInArrow(step, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n"))
        used = used.toArrow()  # a row per piece at most
        weights = np.full(len(strings), 0.1)
        weights[np.asarray(used.column("piece").combine_chunks())] += np.asarray(used.column("n").combine_chunks())
        model = Pieces(strings, np.log(weights / weights.sum()))
    return model


def score(
    docs: DataFrame,
    vocabulary: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    class_column: str | None = "lang",
) -> DataFrame:
    """Score every text under all models, learnt from the rows that are not held out.

    A-Z are lower-cased; tokens are the words (bytes other than 0x20 and 0x09-0x0D) and one
    end. Null and empty texts are the end alone. Rows are scored each, also those that
    share an id. ``class_column`` is read of training rows only; null is a class like any
    other, and without a column there is one class. Without training rows the base model
    knows no token (N and V are 0), all pieces are equally likely and the lattice spells every word.

    Returns ``doc_id``, ``held_out``, ``n_tokens``, ``n_known`` (tokens seen in training),
    ``train_tokens``, and log10 of the text's probability as ``base_score``, ``score`` (the
    lattice), ``piece_score`` (the lattice of pieces alone, without edges for known words) and
    ``mixture_score``. All but the base's probabilities add up to one at most over all token
    sequences; the base gives every unknown word the same share, however many there are.
    """
    steps = Steps(docs.sparkSession)
    label = F.col(class_column) if class_column else F.lit(None)
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"), label.alias("label"))
    rows = rows.withColumn("held_out", held_out(F.col("doc_id")))
    training = rows.where("NOT held_out")
    labels, class_rows = _classes(training, class_column)
    ends, ks = sum(class_rows), range(len(class_rows))
    of_row = F.lit(len(labels))
    for k, value in enumerate(labels):
        of_row = F.when(F.col("label").eqNullSafe(F.lit(value)), k).otherwise(of_row)
    counts = training.select(of_row.alias("class"), "text").mapInArrow(_word_counts, "word string, class int, n long")
    by_class = [F.coalesce(F.sum(F.when(F.col("class") == k, F.col("n"))), F.lit(0)).alias(f"n{k}") for k in ks]
    counts = steps.land("counts", counts.groupBy("word").agg(F.sum("n").alias("n"), *by_class))
    totals = [F.sum(c).alias(f"sum_{c}") for c in ["n", *(f"n{k}" for k in ks)]]
    totals += [F.count_if(F.col(f"n{k}") > 0).alias(f"types{k}") for k in ks]
    sums = counts.agg(F.count(F.lit(1)).alias("types"), *totals).first()
    tokens, types = (sums["sum_n"] or 0) + ends, sums["types"] + (ends > 0)
    denominator = math.log10(tokens + types + 1)
    mixture = Mixture(
        np.array(class_rows),
        np.array([sums[f"sum_n{k}"] or 0 for k in ks]),
        np.array([sums[f"types{k}"] for k in ks]),
        sums["types"],
    )

    model = _fitted(counts, vocabulary)
    # A text ends after each word with the share of ends among all training tokens.
    end = (ends + 1) / (tokens + 2)
    frame = (math.log(end), math.log1p(-end))

    head, least = _head(counts, len(ks), model)
    known_end = math.log10(ends + 1)
    class_columns = ", ".join(f"s{k} double" for k in ks)
    scored = rows.select("doc_id", "held_out", "text").mapInArrow(
        _scored(model, mixture, frame, head, known_end, ends > 0),
        "row long, doc_id {0}, held_out boolean, n_tokens long, n_known long, base double, lattice double, piece_score double, "
        "{1}, words array<struct<word:string,times:int,lattice:double>>".format(
            docs.schema[id_column].dataType.simpleString(), class_columns
        ),
    )
    numbered = scored.withColumn("row", F.monotonically_increasing_id())
    numbered = steps.land("scored", numbered)
    rare = numbered.select("row", F.explode("words").alias("w")).select("row", "w.*")
    # Words above the head's least count are in the head; a joined word has at most ``least`` occurrences.
    tail = counts.where(F.col("n") < least)
    met = rare.join(tail, "word").drop("word").mapInArrow(
        _known(mixture), f"row long, more_known long, more double, more_lattice double, {class_columns}"
    )
    sums_of = [F.sum(c).alias(c) for c in ("more_known", "more", "more_lattice")] + [F.sum(f"s{k}").alias(f"more{k}") for k in ks]
    result = numbered.drop("words").join(met.groupBy("row").agg(*sums_of), "row", "left")
    base = F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.lit(denominator)
    by_class = F.array(*(F.col(f"s{k}") + F.coalesce(f"more{k}", F.lit(0.0)) for k in ks))
    likeliest = F.array_max(by_class)
    rest = F.aggregate(by_class, F.lit(0.0), lambda total, s: total + F.exp(s - likeliest))
    return steps.result(result.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        ((F.col("lattice") + F.coalesce("more_lattice", F.lit(0.0))) / F.lit(_LOG10)).alias("score"),
        "piece_score",
        ((likeliest + F.log(rest)) / F.lit(_LOG10)).alias("mixture_score"),
    ))


@dataclass(frozen=True)
class Head:
    """Frequent words by hash: counts in all and by class, and the lattice's log probability."""

    hashes: np.ndarray
    counts: np.ndarray
    lattice: np.ndarray

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are in the head, and the places of those."""
        if not len(self.hashes):
            return np.zeros(len(hashes), bool), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        found = self.hashes[at] == hashes
        return found, at[found]


def _head(counts: DataFrame, classes: int, model: Pieces) -> tuple[Head, int]:
    """All words with ``least`` occurrences or more, ``HEAD_WORDS`` at most; ``least``.

    The number of words by count is a short list: its rows have distinct counts that add
    up to the number of tokens.
    """
    columns = ["n", *(f"n{k}" for k in range(classes))]
    by_count = counts.groupBy("n").agg(F.count(F.lit(1)).alias("words"))
    total, least = 0, None
    for row in by_count.orderBy(F.col("n").desc()).limit(HEAD_WORDS).collect():
        if total + row["words"] > HEAD_WORDS:
            break
        total, least = total + row["words"], row["n"]
    if least is None:
        return Head(np.zeros(0, np.uint64), np.zeros((0, classes + 1), np.int64), np.zeros(0)), 1 << 62
    schema = "hash long, " + "".join(f"{c} long, " for c in columns) + "lattice double"
    table = counts.where(F.col("n") >= least).mapInArrow(_spelt(model, columns), schema).toArrow()
    column = lambda c: np.asarray(table.column(c).combine_chunks())
    hashes = column("hash").view(np.uint64)
    order = np.argsort(hashes)
    return Head(hashes[order], np.stack([column(c) for c in columns], axis=1)[order], column("lattice")[order]), least


def _spelt(model: Pieces, columns: list[str]):
    """Words as hashes, with their counts and the lattice's log probability."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [w.encode() for w in batch.column("word").to_pylist()]
            spans = np.cumsum([0, *map(len, raw)])
            data = np.frombuffer(b"".join(raw), np.uint8)
            hashes = texts.Rolling(data).spans(spans[:-1], spans[1:])
            lattice = model.word_logs(data, spans[:-1], spans[1:])
            found = [pa.array(texts.signed(hashes)), *(batch.column(c) for c in columns), pa.array(lattice)]
            yield pa.RecordBatch.from_arrays(found, ["hash", *columns, "lattice"])

    return run


def _known(mixture: Mixture):
    """What a rare word's counts add to its row, over a word never seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lattice, times, n = (np.asarray(batch.column(c)) for c in ("lattice", "times", "n"))
            seen, unseen = mixture.shared(n, lattice), mixture.shared(np.zeros_like(n), lattice)
            columns = [batch.column("row"), pa.array(times.astype(np.int64)), pa.array(times * np.log10(n + 1.0))]
            columns.append(pa.array(times * (seen - unseen)))
            for k in range(len(mixture.docs)):
                of_class = np.asarray(batch.column(f"n{k}"))
                more = log_rising(mixture.draws(k, of_class, seen), times)
                columns.append(pa.array(more - log_rising(mixture.draws(k, np.zeros_like(n), unseen), times)))
            names = ["row", "more_known", "more", "more_lattice", *(f"s{k}" for k in range(len(mixture.docs)))]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _scored(
    model: Pieces,
    mixture: Mixture,
    frame: tuple[float, float],
    head: Head,
    known_end: float,
    seen_end: bool,
):
    ks = range(len(mixture.docs))

    def one(block: texts.Block):
        words = _Words(block)
        n, distinct = len(block), len(words.hashes)
        found, at = head.find(words.hashes)
        seen = np.zeros((distinct, len(ks) + 1), dtype=np.int64)
        seen[found] = head.counts[at]
        per_word = np.empty(distinct)
        per_word[found] = head.lattice[at]
        per_word[~found] = model.word_logs(words.data, words.starts[~found], words.ends[~found])
        pairs, times = np.unique(words.rows * max(1, distinct) + words.of, return_counts=True)
        row, word = pairs // max(1, distinct), pairs % max(1, distinct)
        tokens = np.bincount(words.rows, minlength=n)
        frequent = seen[:, 0] > 0
        known = np.bincount(row, weights=times * frequent[word], minlength=n)
        base = np.bincount(row, weights=times * np.log10(seen[:, 0] + 1.0)[word], minlength=n)
        shared = mixture.shared(seen[:, 0], per_word)
        around = frame[0] + tokens * frame[1]
        lattice = np.bincount(row, weights=times * shared[word], minlength=n) + around
        pieces = np.bincount(row, weights=times * per_word[word], minlength=n) + around
        scores = []
        for k in ks:
            drawn = log_rising(mixture.draws(k, seen[:, k + 1], shared)[word], times)
            scores.append(pa.array(np.bincount(row, weights=drawn, minlength=n) + mixture.frame(k, tokens)))
        rare = ~frequent[word]
        row, word, times = row[rare], word[rare], times[rare]
        offsets = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=n)))).astype(np.int32)
        parts = [words.texts(word), pa.array(times.astype(np.int32)), pa.array(per_word[word])]
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(parts, ["word", "times", "lattice"]))
        return [
            pa.array((tokens + 1).astype(np.int64)),
            pa.array(known.astype(np.int64) + int(seen_end)),
            pa.array(base + known_end),
            pa.array(lattice),
            pa.array(pieces / _LOG10),
            *scores,
            lists,
        ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "lattice", "piece_score"]
        names += [*(f"s{k}" for k in ks), "words"]
        for batch in batches:
            for block in texts.blocks(batch.column("text")):
                part = batch.slice(block.lo, len(block))
                row = pa.array(np.zeros(len(block), np.int64))
                columns = [row, part.column("doc_id"), part.column("held_out"), *one(block)]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run
