"""Ranked search, collision search and the manifest against brute force; what a run leaves behind."""

from __future__ import annotations

import hashlib
import math
import os
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from clickreports.llm import collision_search, merkle, midstates, queries, ranked_search, tiles
from clickreports.llm.steps import Steps, ship

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def spark(spark):
    return ship(spark)


# --- ranked search ---

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_search(docs, items, k):
    """(item, rank, id, score) by scoring every document."""
    held = [(i, Counter(terms_of(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms_of(text))
    out = []
    for item, terms in asked.items():
        scored = []
        for i, c in held:
            m = 50 + 50 * sum(c.values()) * n_docs // n_terms
            weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in terms & set(c)}
            score = sum(w * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t, w in weight.items())
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(scored)[:k], 1)]
    return out


def shown(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


@pytest.mark.parametrize("sizes", [{}, {"TRIE_DOCS": 40, "SUBTREE_DOCS": 6}, {"SUBTREE_DOCS": 1, "BLOCK_TERMS": 30}])
def test_ranked_search(spark, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(ranked_search, name, value)
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(40)] + ["É\u00e9", "漢字", "naïve"]
    chance = 1 / np.arange(1, len(words) + 1)
    text = lambda n: " ".join(rng.choice(words, n, p=chance / chance.sum()))
    docs = [(i, text(int(rng.integers(0, 60)))) for i in range(300)]
    docs += [(1000 + i, "w7 w9 W9, copy") for i in range(30)] + [(5, "w1 w2"), (5, "w1 w2"), (None, "w1 w30"), (None, None)]
    docs += [(2000, ""), (2001, "!? --"), (2002, "w3 " * 30_000), (2003, "a-b a_b\x00c")]
    items = [(1, "w1 w2 W2 w39"), (2, "w7, w9!"), (3, "nothing of this"), (4, None), (5, "漢字 É\u00e9"), (5, "w30"), (None, "w0"), (6, "a b c")]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    table = table.withColumns({"n": F.lit(1), "terms": F.lit("x"), "score": F.lit(2)})
    asked = spark.createDataFrame(items, "item_id long, text string").withColumns({"doc_id": F.lit(1), "item": F.lit(2)})
    for k in (5, 50):
        found = [tuple(r) for r in ranked_search.search(table, asked, k=k).collect()]
        assert shown(found) == shown(brute_search(docs, items, k))


def test_ranked_search_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "w1")], "item_id long, text string")
    assert ranked_search.search(docs, items).count() == 0
    one = spark.createDataFrame([(1, "w1")], "doc_id long, text string")
    assert ranked_search.search(one, items.limit(0)).count() == 0
    assert [tuple(r) for r in ranked_search.search(one, items).collect()] == brute_search([(1, "w1")], [(1, "w1")], 50)


def test_bounds_are_never_below_scores():
    rng = np.random.default_rng(4)
    vectors = [np.sort(rng.choice(12, rng.integers(1, 8), replace=False)) for _ in range(400)]
    sizes = np.array([len(v) for v in vectors])
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    tfs, m = rng.integers(1, 9, offsets[-1]), rng.integers(50, 300, 400)
    trie = ranked_search.Trie(np.arange(400), np.zeros(400, bool), m, offsets, np.concatenate(vectors), tfs, 12)
    item, weights = np.array([0, 3, 4, 9]), np.array([10, 500, 70, 4000])
    exact = {}
    for d in range(400):
        places, tf = vectors[d], tfs[offsets[d] : offsets[d + 1]]
        exact[d] = sum(int(ranked_search._gain(weights[j], tf[places == t][0], m[d])) for j, t in enumerate(item) if t in places)
    for least in (1, sorted(exact.values())[350]):
        found = {}
        for subtree, most in enumerate(trie.most):
            gains = ranked_search._gain(weights, most[item].astype(np.int64), trie.least_m[subtree])
            low, high = trie.cuts[subtree], trie.cuts[subtree + 1]
            assert max(exact[d] for d in trie.ids[low:high]) <= gains.sum()
            docs, scores = trie.within(item, gains, weights, subtree, least)
            found |= dict(zip(trie.ids[docs].tolist(), scores.tolist(), strict=True))
        assert found == {d: s for d, s in exact.items() if s >= least}
    # The trie shares paths: far fewer nodes than postings.
    assert len(trie.header) < offsets[-1] / 2


# --- collision search ---


def brute_nearest(rows, asked, k):
    out = []
    for q, (name, vector) in enumerate(rows):
        if asked(name):
            near = sorted((math.dist(vector, v), i) for p, (i, v) in enumerate(rows) if p != q and len(v) == len(vector))
            out.append((name, near[:k]))
    return out


def test_collision_search(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16))
    rows = [(i, (centres[i % 20] + 0.3 * rng.normal(size=16)).tolist()) for i in range(1500)]
    rows += [(300, rows[0][1]), (301, rows[0][1]), (1400, (2 * centres[3]).tolist()), (5000, [1.0, 2.0]), (5001, [1.0, 2.5])]
    rows += [(6000, [1e300] * 16), (6001, [1e-300] * 16)]
    odd = [(7000, None), (7001, [0.0] * 16), (7002, [math.nan] * 16), (7003, [None] + [1.0] * 15), (None, rows[0][1]), (7100, []), (7200, [math.inf] * 16)]
    table = spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<double>")
    table = table.withColumns({"row": F.lit(1), "dims": F.lit(2), "asked": F.lit(3), "score": F.lit(4)})
    for values in (1 << 18, 1 << 12):
        monkeypatch.setattr(tiles, "SHARD_VALUES", values)
        found = {}
        for r in collision_search.nearest(table, F.col("vec_id") % 100 == 0, k=10).collect():
            found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
        hits = total = 0
        for name, near in brute_nearest(rows, lambda i: i % 100 == 0, 10):
            mine = sorted(found[name])
            if name in (300, 1400):  # two rows ask under this id
                continue
            assert [r for r, _, _ in mine] == list(range(1, len(near) + 1))
            exact = dict((i, d) for d, i in near)
            for _, i, score in mine:
                if i in exact:
                    assert score == pytest.approx(exact[i], rel=1e-12, abs=1e-12)
            assert [(s, i) for _, i, s in mine] == sorted((s, i) for _, i, s in mine)
            hits += len(exact.keys() & {i for _, i, _ in mine})
            total += len(near)
        assert hits >= 0.95 * total
        assert len(found[300]) == 20 and len(found[1400]) == 20 and len(found[5000]) == 1
        assert {(1, 0, 0.0), (2, 301, 0.0)} <= set(found[300])
    assert collision_search.nearest(table.limit(0), F.lit(True)).count() == 0


def test_recall_on_the_given_vectors(spark):
    table = queries.table(spark, "/root/testdata/sf0.1", "embeddings")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    found = {}
    for r in queries.queries()["op13_collision_search"](spark, "/root/testdata/sf0.1").collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    near = brute_nearest(rows, lambda i: i % 100 == 0, 10)
    assert sum(len(found[q] & {i for _, i in best}) for q, best in near) >= 0.95 * sum(len(best) for _, best in near)


# --- manifest ---


def test_kept_states():
    assert midstates.INITIAL[0] == 0x6A09E667
    digests = np.random.default_rng(0).integers(0, 256, (20, 32), dtype=np.uint8)
    states, kept = midstates.INITIAL[None, :], []
    for block in midstates.hex_blocks(digests):
        kept.append(midstates.to_bytes(states))
        states = midstates.absorb(states, block[None, :])
    whole = midstates.to_bytes(midstates.absorb(states, midstates.last_blocks(np.array([20]))))
    expected = hashlib.sha256(b"".join(d.tobytes().hex().encode() for d in digests)).digest()
    assert whole.tobytes() == expected
    resumed = midstates.absorb(midstates.from_bytes(kept[19]), midstates.hex_blocks(digests[19:]))
    assert (resumed == states).all()


def brute_manifest(rows, changed):
    """key -> (leaf, subroot, root, proof, folded) of rows (key, source, columns), built twice over."""
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()

    def leaf(values):
        texts = [None if v is None else str(v) for v in values]
        return sha("".join("-" if t is None else f"{len(t.encode())}:{t}" for t in texts))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            last = levels[-1]
            levels.append([sha("".join(last[i : i + 16])) for i in range(0, len(last), 16)])
        return levels

    def climb(levels, place, value):
        proof = ""
        for level in levels[:-1]:
            low = place // 16 * 16
            run = list(level[low : low + 16])
            proof += "".join(x for i, x in enumerate(run) if i != place - low)
            run[place - low] = value
            place, value = place // 16, sha("".join(run))
        return proof, value

    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append((row[0] is not None, row[0] or 0, leaf(row[2]), row))
    sources = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in sources}
    top = tree([trees[s][-1][0] for s in sources])
    out = []
    for number, s in enumerate(sources):
        for place, (_, _, own, row) in enumerate(sorted(groups[s], key=lambda x: x[:3])):
            proof, value = climb(trees[s], place, leaf(changed(row)))
            more, folded = climb(top, number, value)
            out.append((row[0], own, trees[s][-1][0], top[-1][0], sha(proof + more), folded, folded == top[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [1, 16, 17, 700])
def test_manifest(spark, size):
    rng = np.random.default_rng(size)
    rows = []
    for i in range(size):
        text = [None, "", "é Text", f"Text {i} " * (20_000 if i == 3 else 1)][int(rng.integers(0, 4))]
        key = None if i % 50 == 7 else 11 if i % 50 == 8 else i
        rows.append((key, text, None if i % 11 == 0 else "en", None if i % 3 == 0 else f"s{i % 40 if i % 2 else 1}", len(text or "")))
    rows += rows[8:9]
    table = spark.createDataFrame(rows, SCHEMA).repartition(4)
    table = table.withColumns({"tree": F.lit("t"), "leaf": F.lit(1), "key": F.lit(2), "node": F.lit(3), "root": F.lit(4)})
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    struck = F.coalesce(F.col("doc_id") % 5 == 0, F.lit(False))
    changed = {"text": F.when(struck, F.lower("text")).otherwise(F.col("text"))}
    found = [tuple(r) for r in merkle.audit(table, columns, changed).drop("claim").collect()]
    low = lambda r: r[1].lower() if r[0] is not None and r[0] % 5 == 0 and r[1] is not None else r[1]
    shaped = [(r[0], r[3], (r[0], r[3], r[2], r[4], r[1]), (r[0], r[3], r[2], r[4], low(r))) for r in rows]
    assert sorted(found, key=str) == brute_manifest(shaped, lambda row: row[3])


def test_siblings_prove_a_leaf(spark):
    docs = queries.table(spark, "/root/testdata/sf0.001", "documents")
    leaf = merkle.leaf_digest(["doc_id", "text"])
    rows = merkle.Manifest(docs, leaf, leaf, group="lang").fold(siblings=True).collect()
    for r in rows:
        assert r.verified and r.proof_sha256 == hashlib.sha256("".join(x for level in r.siblings for x in level).encode()).hexdigest()


def test_manifest_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert merkle.audit(empty, ["doc_id", "text"], {}).count() == 0


# --- what stays behind ---


@pytest.mark.parametrize("name", ["op3_top_k_search", "op5_near_duplicates", "op11_ranked_search", "op12_merkle_manifest", "op13_collision_search"])
def test_a_run_leaves_only_its_result(spark, monkeypatch, name):
    folders = []
    made = Steps.__init__

    def noted(self, session):
        made(self, session)
        folders.append(self.folder)

    monkeypatch.setattr(Steps, "__init__", noted)
    rows = queries.queries()[name](spark, "/root/testdata/sf0.001").count()
    assert rows > 0 and folders
    left = [entry for folder in folders for entry in os.listdir(folder.removeprefix("file:"))]
    assert [x for x in left if not x.startswith(".")] == ["result"]
