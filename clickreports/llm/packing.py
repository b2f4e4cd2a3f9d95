"""Best-fit packing of token pieces into sequences, improved by swaps.

Texts become tokens in one pass over them; from there on only lengths move. Pieces are
dealt to groups of about ``GROUP_ROWS`` by a hash of their place in the landed table, not
of their id, so that a repeated document spreads too. Each group packs on its own: best
fit in order of falling length, then local search. Documents move, change places one
for one or two for one between underfull bins, always so that the fuller bin gains; the
sum of squared fills rises with every step, the emptiest bins run empty and go. What
grouping costs is at most a few underfull sequences in every ``GROUP_ROWS`` pieces.
"""

from __future__ import annotations

import heapq
import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickreports.llm.steps import Steps, without

GROUP_ROWS = 20_000
CAPACITY = 2048


@lru_cache(maxsize=2)
def byte_bpe(path: str):
    """The encoder of a byte-level BPE tokenizer file: text to the ids its library gives.

    Texts that hold one of the file's added tokens, such as the end of a text, are encoded
    by the library. For all others the file's vocabulary is loaded as merge ranks, which give
    the same ids several times faster where every merge makes the token with the next higher
    id; else the library encodes them too.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)

    def exact(text: str) -> list[int]:
        return tokenizer.encode(text, add_special_tokens=False).ids

    with open(path, encoding="utf-8") as file:
        whole = json.load(file)
    model, added = whole["model"], [t["content"] for t in whole.get("added_tokens") or []]
    vocabulary, merges = model["vocab"], model["merges"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
    made = [vocabulary["".join(pair)] for pair in pairs]
    single = [t for t in vocabulary if len(t) == 1]
    ranked = all(a < b for a, b in zip(made, made[1:], strict=False)) and len(single) == 256
    if not ranked:
        return exact

    import public_tokenizers
    import tiktoken

    # Byte-level files write byte b as a printable code point: itself, or the next from 256 on.
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in printable]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(hidden)}
    tokens = set(single).union("".join(pair) for pair in pairs)
    ranks = {bytes(byte_of[c] for c in token): vocabulary[token] for token in tokens}
    encoding = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: exact(text) if any(token in text for token in added) else encoding.encode_ordinary(text)


def token_pieces(
    docs: DataFrame,
    tokenizer: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    capacity: int = CAPACITY,
    end: int = 0,
    with_ids: bool = False,
) -> DataFrame:
    """Each document's tokens and the ``end`` id, cut into pieces of ``capacity``.

    Only longer documents are cut; their first piece is the shorter one. A null or empty
    text is the end id alone. Columns: ``doc_id`` (as in ``docs``, null too), ``piece``,
    ``start``, ``length``, ``ids_crc32``, and with ``with_ids`` the ``ids`` themselves.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_bpe(tokenizer)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows, place, start, length, checks, ids = [], [], [], [], [], []
                for row, text in enumerate(part.column("text").to_pylist()):
                    tokens = np.array([*encode(text or ""), end], dtype="<u4")
                    full = (len(tokens) - 1) // capacity
                    cuts = [0, *(len(tokens) - capacity * k for k in range(full, -1, -1))]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        rows.append(row)
                        place.append(k)
                        start.append(a)
                        length.append(b - a)
                        checks.append(zlib.crc32(tokens[a:b].tobytes()))
                        if with_ids:
                            ids.append(tokens[a:b].astype(np.int32))
                columns = [part.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(place, pa.int32())]
                columns += [pa.array(x, pa.int64()) for x in (start, length, checks)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns, names = [*columns, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(run, schema + (", ids array<int>" if with_ids else ""))


def pack(pieces: DataFrame, capacity: int = CAPACITY, length_column: str = "length") -> DataFrame:
    """Give every piece a place: its columns with ``sequence_id`` and ``offset``.

    A sequence's pieces follow each other from offset 0 without gaps and hold at most
    ``capacity`` together. Lengths are 1 to ``capacity``; others fail the job. Repeated rows
    are pieces of their own; columns named like the two new ones are replaced.
    """
    steps = Steps(pieces.sparkSession)
    columns = without(pieces, "sequence_id", "offset")
    landed = steps.land("pieces", pieces.select(*columns))
    fields = [landed.schema[c] for c in columns]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    groups = -(-landed.count() // GROUP_ROWS) or 1
    # The landed files do not change, so neither does a row's number, nor its group.
    numbered = landed.withColumn("__group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))

    def place(group: pa.Table) -> pa.Table:
        lengths = group.column(length_column).to_numpy().astype(np.int64)
        if lengths.min() < 1 or lengths.max() > capacity:
            raise ValueError(f"lengths must be 1 to {capacity}")
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for number, members in enumerate(packed(lengths, capacity)):
            sequence[members] = number
            offset[members] = np.cumsum(lengths[members]) - lengths[members]
        sequence += group.column("__group")[0].as_py() << 32
        out = group.drop_columns(["__group"]).append_column("sequence_id", pa.array(sequence))
        return out.append_column("offset", pa.array(offset))

    return numbered.groupBy("__group").applyInArrow(place, f"{schema}, sequence_id long, offset long")


def packed(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of positions of ``lengths``, each holding at most ``capacity``."""
    bins = _best_fit(lengths, capacity)
    return _search(bins, lengths, capacity)


def _best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Falling lengths, each into the fullest bin that takes it."""
    bins: list[list[int]] = []
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set where some bin has room r
    for item in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[item])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            at = with_room[room].pop()
            if not with_room[room]:
                rooms ^= 1 << room
            bins[at].append(item)
        else:
            room, at = capacity, len(bins)
            bins.append([item])
        if room > size:
            with_room[room - size].append(at)
            rooms |= 1 << (room - size)
    return bins


def _search(bins: list[list[int]], lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Fill bins from emptier ones until no exchange helps; bins that run empty go.

    A pass takes the underfull bins, the fullest first, and lets each change up to two of
    its items for one or two of a bin with at least as much room, or take items for none;
    all gains and all pairs are looked at, the largest gain first. What the fuller bin gains the
    emptier one loses, so the sum of squared fills rises with every step, and the search
    ends when a pass finds nothing.
    """
    sizes = lengths.tolist()
    room = [capacity - sum(sizes[i] for i in b) for b in bins]
    loose = [b for b in range(len(bins)) if room[b]]
    # Fewer free tokens than a bin holds: no bin can run empty any more.
    while sum(room[b] for b in loose) >= capacity and _pass(bins, room, sizes, loose):
        loose = [b for b in loose if bins[b] and room[b]]
    return [b for b in bins if b]


def _pass(bins: list[list[int]], room: list[int], sizes: list[int], loose: list[int]) -> int:
    """Let every underfull bin gain what it can; the number of exchanges."""
    offers, steps = _Offers(bins, sizes), 0
    waiting = [(room[b], b) for b in loose]
    for _, b in waiting:
        offers.link(b)
    heapq.heapify(waiting)
    while waiting:
        known, b = heapq.heappop(waiting)
        if known != room[b] or b not in offers.linked:
            continue  # its room has grown since, and it waits again
        # All bins still linked have at least as much room.
        offers.unlink(b)
        while room[b] and bins[b]:
            best = offers.best(b, room[b])
            if best is None:
                break
            gain, given, taken = best
            other = max(taken.values(), key=room.__getitem__)
            items = next(items for items, owner in taken.items() if owner == other)
            offers.unlink(other)
            bins[b] = [i for i in bins[b] if i not in given] + list(items)
            bins[other] = [i for i in bins[other] if i not in items] + list(given)
            room[b] -= gain
            room[other] += gain
            steps += 1
            if bins[other]:
                offers.link(other)
                heapq.heappush(waiting, (room[other], other))
    return steps


class _Offers:
    """Single items and pairs of the linked bins by size: ``by_size[n][size]`` maps items to their bin.

    ``masks[n]`` has a bit for every size at which sets of ``n`` items are offered, so that the
    largest gain within a bin's room is found without trying sizes one by one.
    """

    def __init__(self, bins: list[list[int]], sizes: list[int]):
        self._bins, self._sizes = bins, sizes
        self.linked: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
        self.by_size: dict[int, dict[int, dict[tuple[int, ...], int]]] = {1: {}, 2: {}}
        self.masks = {1: 0, 2: 0}

    def _sets(self, b: int) -> list[tuple[int, tuple[int, ...]]]:
        """One set of items for every size and number that the bin has, one or two items each."""
        items, sizes = self._bins[b], self._sizes
        found: dict[tuple[int, int], tuple[int, ...]] = {(1, sizes[x]): (x,) for x in items}
        # Items of one size are interchangeable: two of each size make all pairs.
        kinds: dict[int, list[int]] = {}
        for x in items:
            kinds.setdefault(sizes[x], []).append(x)
        listed = sorted(kinds.items())
        for k, (size, members) in enumerate(listed):
            if len(members) > 1:
                found.setdefault((2, 2 * size), (members[0], members[1]))
            for less, others in listed[:k]:
                found.setdefault((2, size + less), (members[0], others[0]))
        return [(size, items) for (_, size), items in found.items()]

    def link(self, b: int) -> None:
        self.linked[b] = self._sets(b)
        for size, items in self.linked[b]:
            n = len(items)
            self.by_size[n].setdefault(size, {})[items] = b
            self.masks[n] |= 1 << size

    def unlink(self, b: int) -> None:
        for size, items in self.linked.pop(b):
            n = len(items)
            at = self.by_size[n][size]
            del at[items]
            if not at:
                self.masks[n] ^= 1 << size

    def best(self, b: int, room: int) -> tuple[int, tuple[int, ...], dict[tuple[int, ...], int]] | None:
        """The largest gain: gain, items given for it, and the offers that make it. Two are not changed for two."""
        best = None
        for size, items in [(0, ()), *self._sets(b)]:
            for n in (1, 2) if len(items) < 2 else (1,):
                gain = ((self.masks[n] >> (size + 1)) & ((1 << room) - 1)).bit_length()
                if gain and (best is None or gain > best[0]):
                    best = gain, items, self.by_size[n][size + gain]
        return best
