"""Every operator against brute force on small tables, with the awkward cases among them."""

from __future__ import annotations

import datetime as dt
import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from clickreports.llm import (
    fingerprints,
    html_text,
    language_id,
    lm_scoring,
    mixing,
    near_dups,
    packing,
    queries,
    repeats,
    texts,
    tiles,
    topk,
    url_filters,
)
from clickreports.llm.steps import Steps, ship

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i * i}" for i in range(3000))
PASSAGE = "the quick brown fox jumps over the lazy dog and runs through the long dark forest until morning comes again"


@pytest.fixture(scope="module")
def spark(spark):
    return ship(spark)


def rows_of(texts, **more):
    return [(i, t, more.get("lang", "en"), f"s{i % 3}" if i % 4 else None, len(t or "")) for i, t in enumerate(texts)]


TEXTS = [
    PASSAGE,
    None,
    "",
    "  \n\t ",
    "one",
    "One",
    "é ünïcødé 漢字 " + PASSAGE,
    LONG,
    LONG + " tail",
    PASSAGE.upper() + " !",
    "x" * 250,
    PASSAGE + "\n" + PASSAGE,
    "a b c d e f g h i j k l m n o p",
    "a b c d e f g h i j k l m n o p q",
    PASSAGE,
    "line one\nline two\nline three",
    "line three\nline one\nline two",
    "a <|endoftext|> b",
]


@pytest.fixture(scope="module")
def docs(spark):
    extra = [F.lit(7).alias("n"), F.lit("x").alias("id"), F.lit(1).alias("row"), F.lit(0).alias("k"), F.lit(2).alias("copy")]
    return spark.createDataFrame(rows_of(TEXTS), SCHEMA).repartition(3).select("*", *extra)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- URL filters ---


def test_url_filters(spark):
    at = lambda day, hour=0: dt.datetime(2024, 1, day, hour)
    entries = [
        ("a.com", "block", at(2)),
        ("a.com", "remove", at(5)),
        ("A.com", "block", at(20)),
        ("a.com/x/", "allow", at(3)),
        ("b.com", "allow", at(1)),
        ("b.com", "block", at(1)),
        (None, "block", at(1)),
        ("c.com", "block", None),
        ("c.com", "odd", at(1)),
    ]
    captures = [
        (1, "http://a.com/", at(1)),
        (2, "http://www.A.com/y", at(2)),
        (3, "http://a.com/x/1?q#f", at(4)),
        (4, "http://a.com/x", at(2, 5)),
        (5, "https://u@a.com:80", at(6)),
        (6, "http://a.com./", at(25)),
        (7, "http://b.com", at(1)),
        (8, "http://c.com", at(9)),
        (9, None, at(9)),
        (10, "no url", at(9)),
        (11, "http://b.com", None),
        (11, "http://b.com", None),
    ]
    listed = spark.createDataFrame(entries, "pattern string, action string, dated timestamp")
    table = spark.createDataFrame(captures, "page_id long, url string, fetched timestamp").withColumn("verdict", F.lit("old"))
    found = {r.page_id: (r.verdict, r.pattern) for r in url_filters.evaluate(table, listed).collect()}
    assert found == {
        1: ("unlisted", None),
        2: ("block", "a.com"),
        3: ("allow", "a.com/x/"),
        4: ("block", "a.com"),
        5: ("unlisted", None),
        6: ("block", "a.com"),
        7: ("block", "b.com"),
        8: ("unlisted", None),
        9: ("invalid", None),
        10: ("invalid", None),
        11: ("invalid", None),
    }
    assert url_filters.evaluate(table, listed).count() == len(captures)
    assert url_filters.evaluate(table.limit(0), listed.limit(0)).count() == 0


def test_url_filters_far_apart(spark):
    entries = spark.createDataFrame(
        [("a.com", "block", dt.datetime(1960, 1, 1)), ("a.com", "allow", dt.datetime(2000, 6, 1))]
        + [(f"p{i}.org", "block", dt.datetime(2001, 1, 1)) for i in range(200)],
        "pattern string, action string, dated timestamp",
    )
    times = [dt.datetime(1970, 1, 1), dt.datetime(1955, 1, 1), dt.datetime(2000, 6, 1), dt.datetime(9999, 12, 31), dt.datetime(2024, 1, 1)]
    rows = [(i, "http://a.com/", at) for i, at in enumerate(times)] + [(9, "http://p7.org", dt.datetime(9999, 1, 1))]
    captures = spark.createDataFrame(rows, "page_id long, url string, fetched timestamp").withColumns({"slice": F.lit(1), "entry": F.lit(2)})
    found = {r.page_id: r.verdict for r in url_filters.evaluate(captures, entries).collect()}
    assert found == {0: "block", 1: "unlisted", 2: "allow", 3: "allow", 4: "allow", 9: "block"}
    # One row at most per asked pattern and slice is carried forward, however long the time between.
    asked = spark.createDataFrame([("a.com", 0), ("a.com", 366_000)], "pattern string, slice long")
    intervals = url_filters.validity(entries).withColumn("slice", F.floor(F.unix_timestamp("valid_from") / url_filters._SLICE))
    entry = F.struct("valid_from", "action", "valid_to").alias("entry")
    assert url_filters._carried(intervals.select("pattern", "slice", entry), asked).count() == 2
    none = url_filters.evaluate(captures, entries.limit(0))
    assert {r.verdict for r in none.collect()} == {"unlisted"} and none.count() == 6


# --- packing ---


def test_pieces_and_packing(spark, docs, empty):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path(queries.PACKING_TOKENIZER)
    tokenizer = Tokenizer.from_file(path)
    placed = packing.pack(packing.token_pieces(docs, path, with_ids=True)).collect()
    by_doc = {}
    for r in placed:
        by_doc.setdefault(r.doc_id, []).append(r)
    assert set(by_doc) == set(range(len(TEXTS)))
    for i, text in enumerate(TEXTS):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        pieces = sorted(by_doc[i], key=lambda r: r.piece)
        assert [t for p in pieces for t in p.ids] == ids
        assert [p.piece for p in pieces] == list(range(len(pieces)))
        assert all(p.length == 2048 for p in pieces[1:]) and (len(pieces) == 1 or len(ids) > 2048)
        for p in pieces:
            assert ids[p.start : p.start + p.length] == p.ids
            assert p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes())
    in_order(placed)
    assert packing.pack(packing.token_pieces(empty, path)).count() == 0


def in_order(placed, capacity=2048):
    sequences = {}
    for r in placed:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for members in sequences.values():
        end = 0
        for offset, length in sorted(members):
            assert offset == end
            end += length
        assert end <= capacity
    return len(sequences)


def exchanges_left(bins, lengths, capacity):
    """Exchanges of one or two items for one, or moves, that would fill a bin from one with as much room."""
    rooms = [capacity - int(lengths[b].sum()) for b in bins]
    loose = [k for k, r in enumerate(rooms) if r]
    if sum(rooms[k] for k in loose) < capacity:
        return 0
    sets = {k: [(x,) for x in bins[k]] + list(itertools.combinations(bins[k], 2)) for k in loose}
    left = 0
    for b, other in itertools.permutations(loose, 2):
        if rooms[other] > rooms[b]:
            sums = [(int(lengths[list(t)].sum()), len(t)) for t in sets[other]]
            for given in [(), *sets[b]]:
                size = int(lengths[list(given)].sum()) if given else 0
                left += any(0 < taken - size <= rooms[b] and (n, len(given)) != (2, 2) for taken, n in sums)
    return left


@pytest.mark.parametrize(("low", "high"), [(600, 1101), (650, 721), (300, 901)])
def test_local_search_leaves_no_exchange(low, high):
    lengths = np.random.default_rng(low).integers(low, high, 120)
    bins = packing.packed(lengths, 2048)
    assert sorted(i for b in bins for i in b) == list(range(120))
    assert exchanges_left(bins, lengths, 2048) == 0
    # Figures of a search over all gains and pairs for 2,000 such pieces.
    lengths = np.random.default_rng(1).integers(low, high, 2000)
    assert len(packing.packed(lengths, 2048)) <= {600: 906, 650: 723, 300: 600}[low]


def test_columns_of_the_places_are_replaced(spark):
    pieces = spark.createDataFrame([(1, 5, 9, 9), (1, 5, 9, 9)], "doc_id long, length long, sequence_id long, offset int")
    rows = packing.pack(pieces).collect()
    assert sorted((r.doc_id, r.length, r.offset) for r in rows) == [(1, 5, 0), (1, 5, 5)] and len({r.sequence_id for r in rows}) == 1


def test_local_search_packs_close_to_the_bound():
    rng = np.random.default_rng(5)
    for low, high in ((300, 1200), (700, 1100), (1, 2047)):
        lengths = rng.integers(low, high, 3000)
        first = packing._best_fit(lengths, 2048)
        bins = packing.packed(lengths, 2048)
        assert sorted(i for b in bins for i in b) == list(range(3000))
        assert all(lengths[b].sum() <= 2048 for b in bins)
        assert len(bins) <= len(first)
        if low == 300:
            assert len(bins) <= 1.015 * math.ceil(lengths.sum() / 2048) and len(bins) < len(first)


# --- top-k ---


def brute_top(rows, asked, k):
    """Best scores of each asked row of (id, codes), by place."""
    out = []
    for q, (name, codes) in enumerate(rows):
        if asked(name):
            score = lambda c: min(max(sum(a * b for a, b in zip(codes, c, strict=True)), -(1 << 63)), (1 << 63) - 1)  # noqa: B023, E731
            others = [(-score(c), i) for p, (i, c) in enumerate(rows) if p != q and len(c) == len(codes)]
            out += [(name, rank, i, -s) for rank, (s, i) in enumerate(sorted(others)[:k], 1)]
    return sorted(out)


def test_top_k(spark, monkeypatch):
    rng = np.random.default_rng(1)
    vectors = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(130)]
    vectors[7] = (7, vectors[9][1])  # ties go to the smaller id
    vectors += [(50, vectors[3][1]), (51, [2.0] * 6), (51, [-2.0] * 6), (250, [1.0]), (300, [1e200] * 6), (301, [-1e200] * 6), (150, [])]
    odd = [(200, None), (201, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (202, [math.nan] * 6), (203, [math.inf] * 6), (None, [1.0] * 6)]
    table = spark.createDataFrame([*vectors, *odd], "vec_id long, embedding array<double>")
    named = table.withColumns({"id": F.lit(1), "row": F.lit(2), "shard": F.lit(3), "score": F.lit(4)})
    whole = lambda x: int(x) * 256 if abs(x) > 2**53 else math.floor(256 * x)
    expected = brute_top([(i, [whole(x) for x in v]) for i, v in vectors], lambda i: i % 50 == 0, 5)
    for values in (1 << 18, 60):
        monkeypatch.setattr(tiles, "SHARD_VALUES", values)
        monkeypatch.setattr(tiles, "BLOCK_VALUES", values)
        found = topk.top_k(named, F.col("vec_id") % 50 == 0, k=5).collect()
        assert sorted(tuple(r) for r in found) == expected
    assert topk.top_k(table.limit(0), F.lit(True)).count() == 0
    single = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<double>")
    assert topk.top_k(single, F.lit(True)).count() == 0


def test_products_beyond_doubles_are_exact():
    big = np.array([[float(1 << 40), 3.0]])
    assert topk.product(big, np.array([[float(1 << 21), 1.0], [5.0, 7.0]])).tolist() == [[(1 << 61) + 3, 5 * (1 << 40) + 21]]
    assert topk.product(np.array([[2.0**40]]), np.array([[2.0**40], [-(2.0**40)]])).tolist() == [[(1 << 63) - 1, -(1 << 63)]]


# --- mixing ---


def test_mixing(spark, docs, empty):
    rates = spark.createDataFrame([("s0", 0.0), ("s1", 2.5), (None, 40.0), ("s2", None)], "source string, rate double")
    found = mixing.replicate(docs, rates)
    assert found.columns == [*(c for c in docs.columns if c != "copy"), "copy", "shuffle_key"]
    counts = {r.doc_id: r["count"] for r in found.groupBy("doc_id").count().collect()}
    for i in range(len(TEXTS)):
        rate = 40.0 if i % 4 == 0 else {0: 0.0, 1: 2.5}.get(i % 3, 0.0)
        u = int(hashlib.md5(f"mix/{i}".encode()).hexdigest()[:13], 16) / 2.0**52
        n, p = 0, math.exp(-rate)
        total = p
        while total <= u:
            n += 1
            p *= rate / n
            total += p
        assert counts.get(i, 0) == n
    assert mixing.replicate(empty, mixing.source_rates(empty)).count() == 0


def test_poisson_counts_have_the_rate_as_mean(spark):
    many = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"))
    rates = spark.createDataFrame([("s", 1.7)], "source string, rate double")
    assert abs(mixing.replicate(many, rates).count() / 20_000 - 1.7) < 0.04


@pytest.mark.parametrize("rate", [650.0, 800.0, 6000.0])
def test_poisson_counts_of_high_rates(spark, rate):
    many = spark.range(100).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"))
    rates = spark.createDataFrame([("s", rate)], "source string, rate double")
    counts = np.array([r["count"] for r in mixing.replicate(many, rates).groupBy("doc_id").count().collect()])
    assert len(counts) == 100 and abs(counts.mean() - rate) < 4 * math.sqrt(rate / 100)
    assert 0.5 < counts.var() / rate < 1.7


@pytest.mark.parametrize("ids", ["null", "shared"])
def test_rows_that_share_an_id_draw_on_their_own(spark, ids):
    named = F.lit(None).cast("long") if ids == "null" else F.lit(3).cast("long")
    rows = spark.range(20_000).select(named.alias("doc_id"), F.lit("s").alias("source"))
    rates = spark.createDataFrame([("s", 1.0)], "source string, rate double")
    for seed in ("mix", "a", "b", "c", "d"):
        assert abs(mixing.replicate(rows, rates, seed=seed).count() / 20_000 - 1) < 0.03


def test_the_statement_draws_in_parts_above_the_largest_rate(spark, tmp_path):
    import duckdb

    rows = spark.range(30).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 2, "rare").otherwise("many").alias("source"))
    rows = rows.withColumn("n_chars", F.when(F.col("doc_id") < 2, 1).otherwise(300_000).cast("long"))
    rates = {r.source: r.rate for r in mixing.source_rates(rows).collect()}
    assert rates["rare"] > mixing.WHOLE
    found = mixing.replicate(rows, mixing.source_rates(rows))
    rows.write.parquet(f"{tmp_path}/rows")
    sql = queries.mixing_sql(f"SELECT * FROM '{tmp_path}/rows/*.parquet'", "doc_id, source, n_chars")
    assert sorted(map(tuple, found.collect())) == sorted(duckdb.connect().execute(sql).fetchall())


# --- near duplicates ---


def brute_components(texts, words, percent=80):
    sets = {}
    for i, text in texts.items():
        low = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
        w = re.findall(rb"[^\x20\x09-\x0D]+", low)
        sets[i] = {tuple(w[j : j + words]) for j in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
            x, y = find(a), find(b)
            top[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near_duplicates(spark, docs):
    rng = np.random.default_rng(3)
    base = [f"v{i}" for i in range(150)]
    texts = list(TEXTS)
    for n in range(60):  # a group of near copies on both sides of the threshold
        words = list(base)
        for place in rng.choice(150, size=int(rng.integers(0, 16)), replace=False):
            words[place] = f"e{n}x{place}"
        texts.append(" ".join(words))
    table = spark.createDataFrame([*rows_of(texts), (None, PASSAGE, "en", "s0", 1)], SCHEMA)
    found = near_dups.near_duplicates(table.withColumn("n", F.lit(1)), words=2).collect()
    expected = brute_components(dict(enumerate(texts)), 2)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found if r.doc_id is not None} == expected
    assert [(r.component_id, r.kept) for r in found if r.doc_id is None] == [(0, False)]
    assert all(r.kept == (r.doc_id == r.component_id) for r in found if r.doc_id is not None)
    again = table.where("doc_id IN (0, 1, 4)").withColumns({"row": F.lit(1), "component": F.lit(2)})
    kept = near_dups.one_of_each(again.unionByName(again))
    assert kept.columns == again.columns
    # Texts without words are linked with nothing.
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 1, 4]


def test_rows_with_shared_or_missing_ids_are_documents_of_their_own(spark):
    other = " ".join(f"o{i}" for i in range(40))
    third = " ".join(f"t{i}" for i in range(40))
    rows = [(5, PASSAGE), (5, other), (9, PASSAGE), (12, other), (None, PASSAGE), (None, third), (None, third), (None, None), (7, "")]
    table = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    kept = near_dups.one_of_each(table).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == sorted([(5, PASSAGE), (5, other), (0, third), (0, ""), (7, "")])
    found = near_dups.near_duplicates(table).collect()
    assert len(found) == len(rows)
    seen = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in found)
    assert seen == sorted([(5, 5, True), (5, 5, True), (9, 5, False), (12, 5, False), (0, 5, False), (0, 0, True), (0, 0, False), (0, 0, True), (7, 7, True)])


def test_unsettled_components_fail(spark, monkeypatch):
    monkeypatch.setattr(near_dups, "MOST_ROUNDS", 1)
    links = spark.range(20).selectExpr("id AS x", "id + 1 AS y")
    with pytest.raises(RuntimeError, match="settled"):
        near_dups.connected(Steps(spark), "chain", links)


def test_near_duplicates_of_nothing(empty):
    assert near_dups.near_duplicates(empty).count() == 0


def test_near_duplicates_refuse_what_the_bands_would_miss(empty):
    with pytest.raises(ValueError, match="79"):
        near_dups.near_duplicates(empty, percent=79)


# --- fingerprints ---


def test_fingerprints(spark, docs, empty):
    found = {r.doc_id: r for r in fingerprints.compare_neighbours(docs).collect()}
    texts = [t or "" for t in TEXTS]
    assert sorted(found) == list(range(len(texts)))
    for i, text in enumerate(texts):
        following = texts[i - 1]  # by falling id; after the last comes the first
        third = len(text) // 3
        edited = text[: len(text) - third] + following[:third]
        r = found[i]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == fingerprints.fingerprint(text)
        assert r.edited_fingerprint == fingerprints.fingerprint(edited)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert found[15].fingerprint == found[16].fingerprint and found[16].near_next == 1.0  # order does not matter
    assert found[0].fingerprint != found[4].fingerprint
    assert fingerprints.compare_neighbours(empty).count() == 0
    one = docs.where("doc_id = 0")
    assert fingerprints.compare_neighbours(one).first().near_next == 1.0
    twice = fingerprints.compare_neighbours(one.unionByName(one)).collect()
    assert len(twice) == 2 and twice[0] == twice[1]


def exact_likeness(one, other):
    """Of the counts of word pairs within paragraphs."""

    def pairs(text):
        out = Counter()
        for line in (text or "").encode().split(b"\n"):
            words = re.findall(rb"[^\x20\x09-\x0D]+", line)
            out.update(zip(words, words[1:], strict=False) if len(words) > 1 else [(w, None) for w in words])
        return out

    a, b = pairs(one), pairs(other)
    both = sum(x * x for x in a.values()) + sum(x * x for x in b.values())
    apart = sum((a[k] - b[k]) ** 2 for k in a | b)
    return 1.0 if not both else max(0.0, 1 - apart / both)


def test_likeness_against_whole_counts(spark):
    table = queries.table(spark, "/root/testdata/sf0.001", "documents").withColumns({"part": F.lit(1), "hash": F.lit(2)})
    texts_of = {r.doc_id: r.text or "" for r in table.collect()}
    falling = sorted(texts_of, reverse=True)
    found = {r.doc_id: r for r in fingerprints.compare_neighbours(table).collect()}
    errors = []
    for i, after in zip(falling, falling[1:] + falling[:1], strict=True):
        text, following = texts_of[i], texts_of[after]
        edited = fingerprints.edited_text(text, following)
        errors += [found[i].near_edited - exact_likeness(text, edited), found[i].near_next - exact_likeness(text, following)]
    assert np.abs(errors).max() < 0.3 and np.sqrt(np.mean(np.square(errors))) < 0.06


def test_a_line_repeated_many_times(spark):
    text = "one line of words\n" * 50_000
    table = spark.createDataFrame([(2, text), (1, "x y z\n" * 50_000)], "doc_id long, text string")
    found = {r.doc_id: r for r in fingerprints.compare_neighbours(table).collect()}
    edited = fingerprints.edited_text(text, "x y z\n" * 50_000)
    assert abs(found[2].near_edited - exact_likeness(text, edited)) < 0.05
    assert fingerprints.plus(fingerprints.fingerprint(text), fingerprints.fingerprint("one line of words"), -1) == (
        fingerprints.fingerprint("one line of words\n" * 49_999)
    )


def test_missing_and_shared_ids_spread_and_keep_their_neighbours(spark):
    number = F.col("id")
    rows = spark.range(3000).select(
        F.when(number % 3 == 0, None).when(number % 3 == 1, 77).otherwise(number).alias("doc_id"),
        F.concat(F.lit("text "), number).alias("text"),
    )
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        found = fingerprints.compare_neighbours(rows)
        parts = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
        ids = [r.doc_id for r in found.collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sum(parts) == 3000 and sorted(i or 0 for i in ids) == sorted(r.doc_id or 0 for r in rows.collect())
    # Every text is the neighbour of one other: the hashes of the edited texts say which.
    by_place = sorted(((r.doc_id, r.text) for r in rows.withColumn("h", F.xxhash64("text")).sort(F.desc_nulls_last("doc_id"), "h").collect()), key=lambda _: 0)
    expected = Counter(
        hashlib.sha256(fingerprints.edited_text(a, b).encode()).hexdigest()
        for (_, a), (_, b) in zip(by_place, by_place[1:] + by_place[:1], strict=True)
    )
    assert Counter(r.edited_sha256 for r in found.collect()) == expected
    share = F.lit(0.5)
    assert fingerprints._parts_of(F.lit(3), share, [], "long", 1) is not None


def test_paragraphs_go_in_and_out():
    both, one, other = (fingerprints.fingerprint(t) for t in ("a b c\nd e f", "a b c", "d e f"))
    assert fingerprints.plus(one, other) == both and fingerprints.plus(both, other, -1) == one


# --- repeats ---


def brute_repeats(rows, length=100):
    seen, out = set(), {}
    for i, text in rows:
        raw = (text or "").encode()
        covered = bytearray(len(raw))
        for j in range(len(raw) - length + 1):
            part = raw[j : j + length]
            if part in seen:
                covered[j : j + length] = b"\x01" * length
            seen.add(part)
        kept = bytes(b for b, c in zip(raw, covered, strict=True) if not c)
        spans = [m.span() for m in re.finditer(b"\x01+", bytes(covered))]
        out.setdefault(i, []).append((len(raw), sum(covered), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("small_bucket", [1, repeats.SMALL_BUCKET])
def test_repeats(spark, docs, monkeypatch, small_bucket):
    monkeypatch.setattr(repeats, "SMALL_BUCKET", small_bucket)
    found = repeats.remove_repeats(docs.withColumn("spans", F.lit(1))).collect()
    expected = brute_repeats(list(enumerate(TEXTS)))
    shown = {r.doc_id: [(r.n_bytes, r.n_removed, [tuple(s) for s in r.spans], r.kept_sha256)] for r in found}
    assert shown == expected
    assert {r.doc_id: r.text for r in found}[1] is None


def test_repeats_with_repeated_ids(spark, empty):
    rows = [(5, PASSAGE, "en", "s", 1), (5, PASSAGE, "en", "s", 1), (None, PASSAGE + "!", "en", "s", 1)]
    found = repeats.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id is None, r.n_removed) for r in found) == [(False, len(PASSAGE)), (False, len(PASSAGE)), (True, 0)]
    assert repeats.remove_repeats(empty).count() == 0


# --- HTML ---

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script></head><body>
<nav><ul><li><a href="/">Home page</a></li></ul></nav><div class="ad">Buy now and save a lot.</div>
<article><h1>Head &amp; line</h1><p>First   words &lt;here&gt; of a text that is long enough.<p>Second <b>bold</b>&nbsp;one.<br>
<form>Name <input></form><div class="comments">I like it</div><aside>See also</aside><p>End &copy 2024.</article>
<footer>Imprint and contact, all rights reserved</footer>"""


def test_html(spark):
    pages = spark.createDataFrame(
        [(i, "http://u", PAGE) for i in range(30)] + [(30, None, None), (31, "", ""), (32, "u", "<p>broken <"), (33, "u", "plain")],
        "page_id long, url string, html string",
    ).withColumn("text", F.lit("old"))
    found = {r.page_id: r for r in html_text.extract(pages, html_text.learn(pages)).collect()}
    assert found[0].text == (
        "Head & line\nFirst words <here> of a text that is long enough.\nSecond bold one.\nEnd © 2024."
    )
    assert found[0].n_chars == len(found[0].text)
    assert found[30].text == found[31].text == "" and found[33].text == "plain" and found[32].text == "broken <"
    assert html_text.extract(pages.limit(0), html_text.learn(pages.limit(0))).count() == 0


TEXT = "Many plain words that make up the whole paragraph of the article."


@pytest.mark.parametrize(
    "page",
    [
        f"<body><div class='site-content has-sidebar'><article><p>{TEXT}</p></article></div></body>",
        f"<body><div class='no-sidebar'><main><p>{TEXT}</p></main></div></body>",
        f"<body><div class='sidebar'><article><p>{TEXT}</p></article></div></body>",
        f"<body><div id='comments'><main><p>{TEXT}</p></main></div></body>",
        f"<body><div class='ads'><form><article><p>{TEXT}</p></article></form></div></body>",
        f"<body><div role='search'><article><p>{TEXT}</p></article></div></body>",
        f"<body><div class='menu'>Home News Contact</div><div class='ad'>Buy now</div><article><p>{TEXT}</p></article></body>",
        f"<body><article><p>{TEXT}</p><div class='comments'><article>Nice.</article></div></article></body>",
        f"<body><article><p>{TEXT}</p><div class='share-buttons'>Tell friends</div></article></body>",
        f"<body><article><p>{TEXT}</p></article><div class='sidebar'>Other pages of ours</div></body>",
    ],
)
def test_article_within_hinted_elements(page):
    assert html_text.main_text(page, {}) == TEXT


@pytest.mark.parametrize("name", ["related-work", "search", "menu", "notices", "comments-on-method"])
def test_sections_named_by_their_heading(name):
    page = f"<article><p>{TEXT}</p><section id='{name}'><h2 id='{name}'>On this</h2><p>{TEXT}</p></section></article>"
    assert html_text.main_text(page, {}) == f"{TEXT}\nOn this\n{TEXT}"


def test_headers_formulas_and_labels_of_the_article():
    for name in ("article-header", "entry-header", "header"):
        page = f"<article><div class='{name}'><h1>The name of a thing</h1></div><p>{TEXT}</p></article>"
        text = html_text.main_text(page, {"word h1": 2.0, "hint h1": 2.0})
        assert text == f"The name of a thing\n{TEXT}"
    formula = "<math><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow><annotation>x=2</annotation></math>"
    page = f"<article><p>{TEXT} {formula} <label>a label</label> <object>an object</object></p><p>{TEXT}</p></article>"
    assert html_text.main_text(page, {}) == f"{TEXT} x=2 a label an object\n{TEXT}"


def test_a_page_in_one_form():
    page = f"<body><form id='page'><nav>Home News</nav><h1>Title</h1><p>{TEXT}</p><p>{TEXT}</p><input name='q'><button>Go</button></form></body>"
    tags = {name: -0.1 for name in ("h1", "/h1", "p", "/p")}
    assert html_text.main_text(page, tags) == f"Title\n{TEXT}\n{TEXT}"
    # A form within the text is one, and goes.
    page = f"<body><p>{TEXT}</p><form>Your name <input></form><p>{TEXT}</p></body>"
    assert html_text.main_text(page, {}) == f"{TEXT}\n{TEXT}"


def test_holes_do_not_part_the_article():
    advert = "buy this now " * 200
    page = f"<body><article><p>{TEXT}</p><div class='ad'>{advert}</div><p>{TEXT * 3}</p></article></body>"
    weights = html_text.weights_of(html_text.counted(page) | {("word side ads", False): 10_000, ("word p", True): 5000})
    assert weights["word side ads"] < -5
    assert html_text.main_text(page, weights) == f"{TEXT}\n{TEXT * 3}"
    bare = f"<body><div><p>{TEXT * 3}</p><div class='ad'>{advert}</div><p>{TEXT * 3}</p></div></body>"
    assert html_text.main_text(bare, weights) == f"{TEXT * 3}\n{TEXT * 3}"


def test_learned_weights_choose_the_region(spark):
    """Boilerplate that no list names: only its kind of element tells it from the article."""
    boiler = "".join(f"<dl><dd>Plain words of the house number {i} and what it has to say</dd></dl>" for i in range(8))
    marked = [f"<body>{boiler}<article><p>{TEXT}</p><p>{TEXT} {i}</p></article></body>" for i in range(40)]
    bare = f"<body>{boiler}<div><p>{TEXT}</p><p>{TEXT}</p></div></body>"
    pages = spark.createDataFrame([(i, "u", h) for i, h in enumerate([*marked, bare])], "page_id long, url string, html string")
    weights = html_text.learn(pages)
    assert html_text.main_text(bare, weights) == f"{TEXT}\n{TEXT}"
    constant = {k: 1.0 if k.startswith("word ") else -2.0 for k in weights}
    assert html_text.main_text(bare, constant) != f"{TEXT}\n{TEXT}"


def test_weights_of_hinted_words_are_learned():
    labelled = f"<article><p>{TEXT}</p><div class='menu'><p>Soup and bread</p></div></article><div class='sidebar'><b>Old news</b></div>"
    counts = {k: 40 * n for k, n in html_text.counted(labelled).items()}
    weights = html_text.weights_of(counts)
    assert weights["hint p"] > 0 > weights["hint div"]
    assert html_text.main_text(labelled, weights) == f"{TEXT}\nSoup and bread"


def test_best_run():
    for scores in ([1, -2, 3, 4, -1, 2, -9, 5], [-1, -2], [], [2.0], [1, -1, 1]):
        start, end = html_text.best_run(scores)
        best = max((sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=0)
        assert sum(scores[start:end]) == max(best, 0)


# --- language ---


def test_language(spark, empty):
    table = queries.table(spark, "/root/testdata/sf0.01", "documents")
    model = language_id.fit(table.where("doc_id % 2 = 0"))
    odd = spark.createDataFrame([(5000, None, "en", "s", 0), (5001, "12 34", "en", "s", 0), (None, "the of and", "en", "s", 0)], SCHEMA)
    asked = table.where("doc_id % 2 = 1").unionByName(odd).withColumn("letters", F.lit("x"))
    evidence = language_id.page_evidence(queries.table(spark, "/root/testdata/sf0.01", "pages"))
    found = language_id.identify(asked, model, evidence, host_column="source")
    judged = {r.id: r for r in found.collect()}
    truth = {r.doc_id: r.lang for r in table.where("doc_id % 2 = 1").select("doc_id", "lang").collect()}
    assert sum(judged[i].lang == lang for i, lang in truth.items()) >= 0.99 * len(truth)
    assert all(judged[i].accepted for i in truth if judged[i].lang == truth[i])
    assert not judged[5000].accepted and not judged[5001].accepted and judged[None].lang == "en"
    kept = language_id.accepted_rows(asked, found)
    assert kept.columns == asked.columns and kept.where("doc_id >= 5000").count() == 0
    assert language_id.identify(empty, model).count() == 0
    assert [r.accepted for r in language_id.identify(odd, language_id.fit(empty)).collect()] == [False] * 3


def test_posterior_by_brute_force(spark):
    """Every factor of the posterior worked out again, row by row."""
    samples = {"en": "the house and the garden of the people", "de": "das haus und der garten der leute", "fr": "la maison et le jardin des gens"}
    rng = np.random.default_rng(0)
    rows, said = [], []
    for i in range(90):
        lang = list(samples)[i % 3]
        words = [w for other in samples for w in samples[other].split() if other == lang or rng.random() < 0.3]
        text = None if i == 17 else "" if i == 18 else " ".join(rng.permutation(words)[: int(rng.integers(1, 9))])
        rows.append((i, text, lang, f" Host{i % 4}.org" if i % 5 else None, 0))
        if i % 2:
            said.append((i, ["EN-gb", "de", "", None][i % 4], [f"http://a{i % 3}.example.{lang}/x", "nothing", None][i % 3]))
    table = spark.createDataFrame(rows, SCHEMA)
    evidence = spark.createDataFrame(said, "doc_id long, declared string, url string")
    model = language_id.fit(table)
    found = {r.id: r for r in language_id.identify(table, model, evidence, host_column="source").collect()}

    def softmax(x):
        e = np.exp(x - x.max())
        return e / e.sum()

    size = len(model.languages)
    read, notes = {}, {i: (d, u) for i, d, u in said}
    for i, text, _, source, _ in rows:
        (block,) = texts.blocks(pa.array([text or ""]))
        buckets = language_id._trigrams(block)[1]
        score = model.logs[:, buckets].astype(float).sum(axis=1) * min(1.0, language_id.EVIDENCE / max(1, len(buckets)))
        declared, url = notes.get(i, (None, None))
        declared = (re.match("[a-z]*", (declared or "").lower())[0]) or None
        address = (re.match("https?://([^/]+)", url or "") or [None, None])[1]
        host = address or (source.strip().lower() if source else None)
        domain = ".".join(host.split(".")[-2:]) if host else None
        read[i] = (len(buckets), score, softmax(score), declared, address.rsplit(".", 1)[-1] if address else None, host, domain)
    lettered = [r for r in read.values() if r[0]]
    summed = lambda place, value: sum((r[2] for r in lettered if r[place] == value), np.zeros(size))
    base = sum(r[2] for r in lettered) + language_id.SMOOTHING
    overall = base / base.sum()
    for i, (letters, score, _, declared, suffix, host, domain) in read.items():
        logs = score.copy()
        for place, value in ((3, declared), (4, suffix)):
            if value is not None and any(r[place] == value for r in lettered):
                logs += np.log(summed(place, value) + 0.1 * language_id.SMOOTHING) - np.log(base)
        if host is not None and any(r[5] == host for r in lettered):
            strength = language_id.HOST_STRENGTH
            near = sum((r[2] for r in lettered if r[6] == domain), np.zeros(size))
            prior = (near + strength * overall) / (near.sum() + strength)
            own = summed(5, host)
            logs += np.log((own + strength * prior) / (own.sum() + strength))
        else:
            logs += np.log(overall)
        posterior = softmax(logs)
        r = found[i]
        assert (r.declared, r.suffix, r.host) == (declared, suffix, host)
        assert r.probability == pytest.approx(posterior.max(), abs=1e-9)
        assert posterior[model.languages.index(r.lang)] == pytest.approx(posterior.max(), abs=1e-9)
        assert r.accepted == (letters > 0 and r.probability >= language_id.THRESHOLD)


def test_too_many_labels_are_refused(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MAX_LANGUAGES", 2)
    rows = [(i, "some letters", lang, "s", 0) for i, lang in enumerate(["en", "de", "fr"])]
    with pytest.raises(ValueError, match="more than 2 labels"):
        language_id.fit(spark.createDataFrame(rows, SCHEMA))


def test_rows_go_by_their_own_verdict(spark):
    table = queries.table(spark, "/root/testdata/sf0.01", "documents")
    good = "the people of the house and the time of the year were what they had all been waiting for"
    rows = [(None, good), (None, ""), (None, None), (None, "12 34"), (7001, good), (7001, ""), (7002, None), (7002, good), (7003, " ")]
    odd = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)
    asked = table.where("doc_id % 2 = 1").unionByName(odd).unionByName(odd.limit(1))
    evidence = language_id.page_evidence(queries.table(spark, "/root/testdata/sf0.01", "pages"))
    found = language_id.identify(asked, language_id.fit(table), evidence, host_column="source")
    kept = language_id.accepted_rows(asked, found)
    assert kept.columns == asked.columns
    left = sorted((r.doc_id or 0, r.text) for r in kept.where("doc_id IS NULL OR doc_id > 7000").collect())
    assert left == [(0, good), (0, good), (7001, good), (7002, good)]
    assert kept.count() == found.where("accepted").count()


def test_rare_labels_are_learned(spark, monkeypatch):
    monkeypatch.setattr(language_id, "TRAINING_ROWS", 50)
    rare = {"da": "bcd", "de": "fgh", "fi": "jkl", "fr": "mnp", "ga": "qrs"}
    rows = [(i, f"aeio uaei {i % 7 * 'ou'} eiou", "en", "s", 0) for i in range(3000)]
    rows += [(None, 9 * f"{x} ", lang, "s", 0) for lang, x in rare.items()]
    rows += [(i, "12 34", lang, "s", 0) for i, lang in enumerate(["xx", "yy", *1000 * ["da"]])]
    model = language_id.fit(spark.createDataFrame(rows, SCHEMA))
    assert model.languages == tuple(sorted({"en", *rare}))
    learned = np.ptp(model.logs, axis=1)
    assert (learned > 1).all()
    asked = spark.createDataFrame([(i, f"{x} {x} {x}", None, "s", 0) for i, x in enumerate(rare.values())], SCHEMA)
    found = {r.id: r for r in language_id.identify(asked, model).collect()}
    assert [(found[i].lang, found[i].accepted) for i in range(5)] == [(lang, True) for lang in rare]


def test_texts_with_trigrams_are_found(spark):
    pieces = ["a", "Z", " ", "\t", "1", "-", "é", "漢", "😀", "\x1f", "\x7f"]
    texts_of = ["".join(x) for n in range(5) for x in itertools.product(pieces, repeat=n)]
    rows = spark.createDataFrame([(t,) for t in texts_of], "text string")
    found = {r.text for r in rows.where(F.col("text").rlike(language_id.HAS_TRIGRAM)).collect()}
    (block,) = texts.blocks(pa.array(texts_of))
    assert found == {texts_of[i] for i in set(language_id._trigrams(block)[0])}


# --- scores ---


def test_scores(spark, docs, empty):
    path = queries.tokenizer_path(queries.SCORING_VOCABULARY)
    found = {r.doc_id: r for r in lm_scoring.score(docs, path).collect()}
    low = lambda t: bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode())
    tokens = {i: [*re.findall(rb"[^\x20\x09-\x0D]+", low(t)), None] for i, t in enumerate(TEXTS)}
    out = {i for i in tokens if zlib.crc32(str(i).encode()) % 7 == 2}
    counts = {}
    for i, words in tokens.items():
        for w in words if i not in out else []:
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    for i, words in tokens.items():
        r = found[i]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (i in out, len(words), n)
        assert r.n_known == sum(w in counts for w in words)
        assert r.base_score == pytest.approx(sum(math.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in words))
        assert r.piece_score < 0 and r.mixture_score < 0 and r.piece_score <= r.score < 0
    assert lm_scoring.score(empty, path).count() == 0


def test_rare_words_are_joined(spark, docs, monkeypatch):
    path = queries.tokenizer_path(queries.SCORING_VOCABULARY)
    columns = ["doc_id", "n_known", F.round("base_score", 6), F.round("score", 6), F.round("mixture_score", 6)]
    whole = sorted(lm_scoring.score(docs, path).select(*columns).collect())
    monkeypatch.setattr(lm_scoring, "HEAD_WORDS", 5)
    assert whole == sorted(lm_scoring.score(docs, path).select(*columns).collect())


@pytest.mark.parametrize("column", ["lang", None])
def test_mixture_draws_words_one_by_one(spark, column):
    path = queries.tokenizer_path(queries.SCORING_VOCABULARY)
    texts = [" ".join(f"{'ab' if i % 3 else 'cd'}{(i * j) % 11}" for j in range(i)) for i in range(24)]
    langs = [None if i == 9 else "x" if i % 3 else "y" for i in range(24)]
    rows = [(i, t, lang, "s", len(t)) for i, (t, lang) in enumerate(zip(texts, langs, strict=True))]
    table = spark.createDataFrame(rows, SCHEMA)
    found = {r.doc_id: r for r in lm_scoring.score(table, path, class_column=column).collect()}
    one = spark.createDataFrame([(i, w, None, None, 0) for i, w in enumerate({w for t in texts for w in t.split()})], SCHEMA)

    train = [i for i in range(24) if zlib.crc32(str(i).encode()) % 7 != 2]
    classes = [{i for i in train if langs[i] == v} for v in {langs[i] for i in train}] if column else [set(train)]
    classes = [c for c in classes if c] + ([set()] if column else [])
    counts = [{} for _ in classes]
    for mine, c in zip(classes, counts, strict=True):
        for i in mine:
            for w in texts[i].split():
                c[w] = c.get(w, 0) + 1
    total = {w: sum(c.get(w, 0) for c in counts) for c in counts for w in c}
    n, v, big = sum(total.values()), len(total), lm_scoring.CONCENTRATION
    lattice = _lattice_of(path, total, [r.text for r in one.collect()])
    stop = (len(train) + 1) / (n + len(train) + 2)
    for i, text in enumerate(texts):
        words = text.split()
        spelt = [(total.get(w, 0) + (v + 1) * lattice[w]) / (n + v + 1) for w in words]
        assert found[i].score == pytest.approx(math.log10(stop) + sum(math.log10((1 - stop) * p) for p in spelt))
        assert found[i].piece_score == pytest.approx(math.log10(stop) + sum(math.log10((1 - stop) * lattice[w]) for w in words))
        whole = 0.0
        for mine, c in zip(classes, counts, strict=True):
            n_k, v_k = sum(c.values()), len(c)
            end = (len(mine) + 1) / (len(mine) + n_k + 2)
            p = (len(mine) + 1) / (len(train) + len(classes)) * end
            before = []
            for w in text.split():
                shared = (total.get(w, 0) + (v + 1) * lattice[w]) / (n + v + 1)
                of_class = (c.get(w, 0) + (v_k + 1) * shared) / (n_k + v_k + 1)
                p *= (1 - end) * (before.count(w) + big * of_class) / (len(before) + big)
                before.append(w)
            whole += p
        assert found[i].mixture_score == pytest.approx(math.log10(whole))


def _lattice_of(path, known, words):
    """Probability of each word by plain recursions, the pieces' own estimated on the known words."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    strings, place = lm_scoring._vocabulary(path)

    def forward(raw, chance):
        reach = [1.0]
        for end in range(1, len(raw) + 1):
            reach.append(sum(reach[a] * chance.get(raw[a:end], 0.0) for a in range(end)))
        return reach

    uses = {s: 0.1 for s in strings}
    for w in known:
        for i in model.encode(w):
            uses[strings[place[i]]] += 1
    for turn in range(lm_scoring.ROUNDS + 1):
        chance = {s: x / sum(uses.values()) for s, x in uses.items()}
        if turn == lm_scoring.ROUNDS:
            break
        uses = {s: 0.1 for s in strings}
        for w in known:
            raw = b" " + w.encode()
            there = forward(raw, chance)
            rest = forward(raw[::-1], {s[::-1]: x for s, x in chance.items()})[::-1]
            for a, b in itertools.combinations(range(len(raw) + 1), 2):
                if raw[a:b] in chance:
                    uses[raw[a:b]] += there[a] * chance[raw[a:b]] * rest[b] / there[-1]
    return {w: forward(b" " + w.encode(), chance)[-1] for w in words}


def test_scores_of_null_and_shared_ids(spark):
    path = queries.tokenizer_path(queries.SCORING_VOCABULARY)
    rows = [(i, f"some words w{i % 5}", "en", "s", 0) for i in range(30)] + [(None, "some words", None, "s", 0), (None, None, None, "s", 0), (3, "w3", "en", "s", 0)]
    found = lm_scoring.score(spark.createDataFrame(rows, SCHEMA).withColumns({"word": F.lit(1), "n": F.lit(2)}), path).collect()
    assert sorted((r.doc_id is None, r.n_tokens) for r in found if r.doc_id in (None, 3)) == [(False, 2), (False, 4), (True, 1), (True, 3)]
    assert len(found) == len(rows) and all(r.score < 0 for r in found)


def test_rising_factorials():
    a, times = np.array([1e-9, 0.5, 3.0, 700.0, 2.0, 1.0]), np.array([1, 8, 9, 40, 0, 3000])
    expected = [math.lgamma(x + t) - math.lgamma(x) for x, t in zip(a, times, strict=True)]
    assert lm_scoring.log_rising(np.log(a), times) == pytest.approx(expected, abs=1e-8)


def test_lattice_sums_all_segmentations():
    pieces = [b" a", b"a", b"b", b"ab", b" ", b"ba", b" ab"]
    logs = np.log(np.arange(1, 8) / 28.0)
    known = dict(zip(pieces, logs, strict=True))

    def ways(text):
        return 1.0 if not text else sum(math.exp(known[p]) * ways(text[len(p) :]) for p in pieces if text.startswith(p))

    data = np.frombuffer(b"abba", np.uint8)
    model = lm_scoring.Pieces(pieces, logs)
    found = model.word_logs(data, np.array([0, 0, 1]), np.array([4, 2, 2]))
    assert np.exp(found) == pytest.approx([ways(b" abba"), ways(b" ab"), ways(b" b")])
