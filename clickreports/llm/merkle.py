"""A Merkle manifest of a table: one digest for all rows, kept hash states for cheap changes.

Every row is a leaf. The leaves of a group, such as a source, stand in order and every
``FAN`` consecutive nodes become their parent, up to one subroot a group; the subroots,
ordered by group, become the root the same way. A parent is the SHA-256 of its children's
hex digests, 64 bytes each, so that the hash state before any child is 32 bytes
(``midstates``). Each parent keeps those states. To put a changed leaf's digest in its
place, ``fold`` resumes the state before it and reads the new digest and the siblings to
its right only, level by level up to the root.

Leaves are numbered by one range-partitioned sort, whose row ids and per-part counts give
the places, so a group of any size is spread over tasks. A task of a level sees runs of
``FAN`` nodes; levels shrink sixteenfold and their number is the logarithm of the largest group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickreports.llm import midstates
from clickreports.llm.steps import Steps

FAN = 16
BATCH_ROWS = 1024  # parents folded together

_NODE = "tree string, grp long, width long, node binary, digests binary, states binary"
_STEP = "struct<slot: int, digests: binary, states: binary>"


def leaf_digest(columns: Sequence[str | Column]) -> Column:
    """Hex SHA-256 of the values: ``-`` for null, else UTF-8 byte count, ``:`` and the text."""
    parts = []
    for column in columns:
        text = (F.col(column) if isinstance(column, str) else column).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


class Manifest:
    """The landed tree of ``rows``; see the module.

    ``key`` orders the leaves of a group and names the rows in results; ``group`` parts
    them (null is a group of its own, the first). ``leaf`` is a row's hex digest and
    ``claim`` the digest that a holder of the row claims now. Rows that share a key are
    leaves of their own, ordered by digest; a null key comes first. Other columns of
    ``rows`` play no part, whatever their names. An empty table has no root and no rows.
    """

    def __init__(self, rows: DataFrame, leaf: Column, claim: Column, key: str = "doc_id", group: str = "source"):
        self._steps = Steps(rows.sparkSession)
        tree = F.coalesce(F.concat(F.lit("1"), F.col(group).cast("string")), F.lit("0"))
        leaves = rows.select(
            tree.alias("tree"), F.col(key).alias("key"), F.unhex(leaf).alias("node"), F.unhex(claim).alias("claim")
        )
        leaves = self._numbered(leaves, "leaves", "key", "node", "claim")
        one = F.struct("place", "key", "node", "claim")
        runs = leaves.groupBy("tree", F.floor(F.col("place") / FAN).alias("grp")).agg(
            F.max("width").alias("width"), F.sort_array(F.collect_list(one)).alias("members")
        )
        members = "members array<struct<place: long, key: {}, node: binary, claim: binary>>"
        key_type = rows.schema[key].dataType.simpleString()
        schema = f"{_NODE}, {members.format(key_type)}"
        first = self._steps.land("level_0", runs.mapInArrow(_parents("members"), schema))
        self._steps.drop("leaves")
        subroots, self._levels = self._raise("level", first)
        tops = self._numbered(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("key"), "node"), "tops", "key", "node")
        members = F.sort_array(F.collect_list(F.struct("place", "key", "node")))
        runs = tops.groupBy("tree", F.floor(F.col("place") / FAN).alias("grp")).agg(
            F.max("width").alias("width"), members.alias("members")
        )
        schema = f"{_NODE}, members array<struct<place: long, key: string, node: binary>>"
        self.root, self._top_levels = self._raise(
            "top", self._steps.land("top_0", runs.mapInArrow(_parents("members"), schema))
        )

    def _numbered(self, nodes: DataFrame, name: str, *order: str) -> DataFrame:
        """Landed with ``place`` in the tree's order, from 0, and the tree's ``width``."""
        sorted_nodes = nodes.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
        landed = self._steps.land(name, sorted_nodes.withColumn("row", F.monotonically_increasing_id()))
        landed = landed.withColumn("part", F.shiftright("row", 33).cast("int"))
        parts = landed.groupBy("tree", "part").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
        before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        parts = parts.select(
            "tree",
            "part",
            (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("offset"),
            F.sum("n").over(Window.partitionBy("tree")).alias("width"),
        )
        parts = self._steps.land(f"{name}_parts", parts)
        return landed.join(parts, ["tree", "part"]).withColumn("place", F.col("row") + F.col("offset")).drop("row", "part", "offset")

    def _raise(self, name: str, level: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
        """The trees' last nodes, and all levels of parents."""
        levels, ends = [level], []
        while True:
            ends.append(level.where(F.col("width") <= FAN).select("tree", "node"))
            open_nodes = level.where(F.col("width") > FAN)
            runs = open_nodes.groupBy("tree", F.floor(F.col("grp") / FAN).alias("up")).agg(
                F.ceil(F.max("width") / FAN).alias("width"),
                F.sort_array(F.collect_list(F.struct(F.col("grp").alias("place"), "node"))).alias("members"),
            )
            runs = runs.withColumnRenamed("up", "grp").mapInArrow(_parents("members", keep=False), _NODE)
            level = self._steps.land(f"{name}_{len(levels)}", runs)
            if level.isEmpty():
                break
            levels.append(level)
        last = ends[0]
        for end in ends[1:]:
            last = last.unionByName(end)
        return last, levels

    def _attach(self, name: str, levels: list[DataFrame], above: DataFrame) -> DataFrame:
        """The lowest level with ``path``, the steps from each of its parents up to the root."""
        carried = None
        for number in range(len(levels) - 1, -1, -1):
            level = levels[number]
            tops = level.where(F.col("width") <= FAN).join(above, "tree")
            if carried is not None:
                up = carried.select(
                    "tree", F.col("grp").alias("up"), F.col("digests").alias("d"), F.col("states").alias("s"), "path", "subroot", "root"
                )
                step = F.struct(F.pmod("grp", F.lit(FAN)).cast("int").alias("slot"), F.col("d").alias("digests"), F.col("s").alias("states"))
                rest = level.where(F.col("width") > FAN).withColumn("up", F.floor(F.col("grp") / FAN)).join(up, ["tree", "up"])
                rest = rest.withColumn("path", F.concat(F.array(step), "path")).drop("d", "s", "up")
                tops = tops.unionByName(rest)
            carried = self._steps.land(f"{name}_path_{number}", tops) if number else tops
        return carried

    def fold(self, siblings: bool = False) -> DataFrame:
        """Every leaf's proof, and the root that its ``claim`` leads to.

        Returns ``key``, ``leaf``, ``claim``, ``subroot``, ``root``, ``proof_sha256`` (of the hex
        siblings, level by level, left to right), ``folded_root``, ``verified`` and, if asked
        for, ``siblings``, the proof itself as an array of levels.
        """
        step = f"CAST(array() AS array<{_STEP}>)"
        root = self.root.select("tree", F.col("node").alias("root"))
        top = self._top_levels[0]
        above = root.select("tree", F.expr(step).alias("path"), F.lit(None).cast("binary").alias("subroot"), "root")
        top = self._attach("top", self._top_levels, above).withColumn("member", F.explode("members"))
        slot = F.pmod(F.col("member.place"), F.lit(FAN)).cast("int")
        own = F.array(F.struct(slot.alias("slot"), "digests", "states"))
        path = F.when(F.col("digests").isNull(), F.col("path")).otherwise(F.concat(own, "path"))
        above = top.select(F.col("member.key").alias("tree"), path.alias("path"), F.col("member.node").alias("subroot"), "root")
        above = self._steps.land("above", above)
        rows = self._attach("level", self._levels, above).select("members", "digests", "states", "path", "subroot", "root")
        key = rows.schema["members"].dataType.elementType["key"].dataType.simpleString()
        schema = f"key {key}, leaf string, claim string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
        if siblings:
            schema += ", siblings array<array<string>>"
        return self._steps.result(rows.mapInArrow(_fold(siblings), schema))


def _bytes(cells: pa.Array) -> np.ndarray:
    """Digests as rows of 32 bytes."""
    return np.frombuffer(b"".join(cells.to_pylist()), dtype=np.uint8).reshape(-1, 32)


def _parents(column: str, keep: bool = True):
    """Adds to each run of nodes its parent's digest and the states before every child.

    A lone leaf is its tree's last node itself: it has no digests and no states.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(lo, BATCH_ROWS)
                if not batch.num_rows:
                    continue
                members = batch.column(column)
                counts = np.asarray(members.value_lengths()).astype(np.int64)
                digests = _bytes(members.flatten().field("node"))
                starts = np.concatenate(([0], np.cumsum(counts)))
                blocks = midstates.hex_blocks(digests)
                states = np.tile(midstates.INITIAL, (len(counts), 1))
                kept = np.empty((len(digests), 8), dtype=np.uint32)
                for slot in range(int(counts.max())):
                    on = np.flatnonzero(counts > slot)
                    at = starts[on] + slot
                    kept[at] = states[on]
                    states[on] = midstates.absorb(states[on], blocks[at])
                nodes = midstates.to_bytes(midstates.absorb(states, midstates.last_blocks(counts)))
                kept_bytes = midstates.to_bytes(kept)
                widths = batch.column("width").to_pylist()
                node, below, before = [], [], []
                for i, width in enumerate(widths):
                    lone, span = keep and width == 1, slice(starts[i], starts[i + 1])
                    node.append(digests[starts[i]].tobytes() if lone else nodes[i].tobytes())
                    below.append(None if lone else digests[span].tobytes())
                    before.append(None if lone else kept_bytes[span].tobytes())
                columns = [batch.column("tree"), batch.column("grp"), batch.column("width")]
                columns += [pa.array(x, pa.binary()) for x in (node, below, before)]
                names = ["tree", "grp", "width", "node", "digests", "states"]
                if keep:
                    columns, names = [*columns, members], [*names, column]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _resume(values: np.ndarray, slots: np.ndarray, counts: np.ndarray, digests: np.ndarray, states: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The parents' digests with ``values`` put at ``slots``: the state kept there, then the siblings to its right.

    Row ``i``'s parent has ``counts[i]`` children, whose digests and states begin at ``starts[i]``.
    """
    state = midstates.absorb(midstates.from_bytes(states[starts + slots]), midstates.hex_blocks(values))
    for right in range(1, FAN):
        on = np.flatnonzero(slots + right < counts)
        if not len(on):
            break
        state[on] = midstates.absorb(state[on], midstates.hex_blocks(digests[(starts + slots)[on] + right]))
    return midstates.to_bytes(midstates.absorb(state, midstates.last_blocks(counts)))


def _fold(siblings: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(lo, BATCH_ROWS)
                if batch.num_rows:
                    yield folded(batch)

    def folded(batch: pa.RecordBatch) -> pa.RecordBatch:
        members, paths = batch.column("members"), batch.column("path")
        counts = np.asarray(members.value_lengths()).astype(np.int64)
        run_of = np.repeat(np.arange(len(counts)), counts)
        place = np.arange(len(run_of)) - np.repeat(np.cumsum(counts) - counts, counts)
        flat = members.flatten()
        leaves, claims = _bytes(flat.field("node")), _bytes(flat.field("claim"))
        # Step 0 is a leaf's own run, the others those of its path: (run, step) -> digests, states, slot.
        runs: list[list[tuple[int, bytes, bytes]]] = []
        own = zip(batch.column("digests").to_pylist(), batch.column("states").to_pylist(), paths.to_pylist(), strict=True)
        for digests, states, path in own:
            steps = [] if digests is None else [(-1, digests, states)]
            runs.append(steps + [(s["slot"], s["digests"], s["states"]) for s in path])
        values, owner = claims.copy(), run_of
        depth = np.array([len(x) for x in runs])
        for step in range(int(depth.max())):
            on = np.flatnonzero(depth[owner] > step)
            used = [x[step] if len(x) > step else (0, b"", b"") for x in runs]
            sizes = np.array([len(x[1]) // 32 for x in used])
            starts = np.cumsum(sizes) - sizes
            digests, states = (np.frombuffer(b"".join(x[k] for x in used), np.uint8).reshape(-1, 32) for k in (1, 2))
            fixed = np.array([x[0] for x in used])[owner[on]]
            slots = np.where(fixed < 0, place[on], fixed) if step == 0 else fixed
            values[on] = _resume(values[on], slots, sizes[owner[on]], digests, states, starts[owner[on]])
            if step == 0:
                # Leaves of a run that lead to one digest share the way from there.
                named = np.concatenate((owner.astype(">i8").view(np.uint8).reshape(-1, 8), values), axis=1)
                _, first, back = np.unique(named.view("V40").ravel(), return_index=True, return_inverse=True)
                values, owner = values[first], owner[first]
        proofs, listed = _proofs(runs, run_of, place, siblings)
        subroots, roots = ([x.hex() for x in batch.column(name).to_pylist()] for name in ("subroot", "root"))
        ends = [x.tobytes().hex() for x in values]
        root, found = [roots[i] for i in run_of], [ends[i] for i in (back if depth.max() else range(len(ends)))]
        columns = {
            "key": flat.field("key"),
            "leaf": [x.tobytes().hex() for x in leaves],
            "claim": [x.tobytes().hex() for x in claims],
            "subroot": [subroots[i] for i in run_of],
            "root": root,
            "proof_sha256": proofs,
            "folded_root": found,
            "verified": [a == b for a, b in zip(root, found, strict=True)],
        }
        if siblings:
            columns["siblings"] = pa.array(listed, pa.list_(pa.list_(pa.string())))
        return pa.RecordBatch.from_pydict(columns)

    return run


def _proofs(runs, run_of: np.ndarray, place: np.ndarray, siblings: bool) -> tuple[list[str], list[list[list[str]]]]:
    proofs, listed, last = [], [], -1
    for i, slot in zip(run_of, place, strict=True):
        if i != last:
            levels = [[digests[k : k + 32].hex() for k in range(0, len(digests), 32)] for _, digests, _ in runs[i]]
            upper = [[x for k, x in enumerate(level) if k != s[0]] for level, s in zip(levels, runs[i], strict=True)]
            rest = "".join("".join(x) for level, x in zip(runs[i], upper, strict=True) if level[0] >= 0)
            last = i
        mine = [list(x) for x in upper] if siblings else []
        text = rest
        if runs[i] and runs[i][0][0] < 0:
            beside = [x for k, x in enumerate(levels[0]) if k != slot]
            text = "".join(beside) + rest
            mine = [beside, *mine[1:]]
        proofs.append(hashlib.sha256(text.encode()).hexdigest())
        listed.append(mine)
    return proofs, listed


def audit(docs: DataFrame, columns: Sequence[str], changed: dict[str, Column], key: str = "doc_id", group: str = "source") -> DataFrame:
    """The manifest of ``docs`` over ``columns`` and, for each row, whether its present content leads to the root.

    ``changed`` gives the present content of columns that may differ. Returns what
    ``Manifest.fold`` returns, the key under its own name.
    """
    claim = leaf_digest([changed.get(c, F.col(c)) for c in columns])
    found = Manifest(docs, leaf_digest(columns), claim, key, group).fold()
    return found.withColumnRenamed("key", key)
