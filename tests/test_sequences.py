from __future__ import annotations

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from clickreports.operators import sequences as S

START = dt.datetime(2024, 1, 1)
NAMES = ["page_view", "login", "view_cart", "purchase"]


def walk(uid, *names, minutes=10):
    return [
        {"uid": uid, "name": name, "ts": str(START + dt.timedelta(minutes=minutes * i))} for i, name in enumerate(names)
    ]


@pytest.fixture(scope="module")
def random_rows():
    """Users with few and with many events, equal and unknown times, long pauses."""
    rng = random.Random(7)
    rows = []
    for user in range(30):
        for _ in range(rng.choice([1, 3, 40, 120])):
            moment = START + dt.timedelta(hours=rng.choice([0, 1, 2, 30, 31]), minutes=rng.randrange(0, 60, 5))
            rows.append(
                {
                    "uid": f"U{user}",
                    "name": rng.choices(NAMES, [6, 1, 1, 1])[0],
                    "ts": None if rng.random() < 0.02 else str(moment),
                    "id": rng.randrange(10**9),
                }
            )
    return rows


def brute_force(rows):
    """Collapsed event names per user, in order."""
    by_user = {}
    for row in sorted(rows, key=lambda r: (r["ts"] is not None, r["ts"] or "", r["id"])):
        names = by_user.setdefault(row["uid"], [])
        if not names or names[-1] != row["name"]:
            names.append(row["name"])
    return by_user


@pytest.mark.parametrize("seconds", [600, 3600, 10**9])
def test_slices_do_not_change_results(events, random_rows, seconds):
    view, expected = events(random_rows), brute_force(random_rows)

    kept = S.collapse_repeats(view, seconds).collect()
    assert Counter(r.uid for r in kept) == {uid: len(names) for uid, names in expected.items()}

    pairs = {(r.source_event, r.target_event): r.user_count for r in S.transition_users(S.user_transitions(view, seconds)).collect()}
    seen = Counter(pair for names in expected.values() for pair in set(zip(names, names[1:])))
    assert pairs == seen

    for n in (1, 3, 10):
        paths = {r.uid: r.path for r in S.user_paths(S.first_steps(view, n, seconds)).collect()}
        assert paths == {uid: names[:n] for uid, names in expected.items()}


def test_unlisted_events_do_not_break_neighbours(events):
    view = S.only_events(events(walk("U1", "login", "scroll", "login", "purchase")), NAMES)
    assert [tuple(r)[1:] for r in S.transitions(view).collect()] == [("login", "purchase")]


def test_links_lead_forward_only_and_the_limit_counts_them(events):
    rows = walk("U1", "page_view", "login", "page_view") + walk("U2", "login", "page_view")
    view = S.user_transitions(events(rows))
    links = [tuple(r) for r in S.transition_links(view, min_users=1).collect()]
    assert links == [("Page View", "Login", 1)]
    assert S.transition_links(view, min_users=1, limit=1).count() == 1
    # The most common transition leads backwards: a limit that comes first takes it, the filter drops it.
    assert S.transition_links(view, min_users=1, limit=1, limit_first=True).count() == 0
    assert S.transition_links(view, min_users=3).count() == 0


def test_nodes_by_depth(events):
    links = S.transition_links(S.user_transitions(events(walk("U1", "first_visit", "login", "purchase"))), min_users=1)
    nodes = S.link_nodes(links).orderBy("depth").collect()
    assert [r.name for r in nodes] == ["First Visit", "Login", "Purchase"]


def test_events_outside_the_depth_table(spark):
    edges = spark.createDataFrame([("Login", "New"), ("New", "Login"), ("New", "First Visit")], "source string, target string")
    kept = {tuple(r) for r in S.forward_edges(edges).collect()}
    assert kept == {("Login", "New"), ("New", "Login")}


def test_longer_journeys_are_told_from_those_of_exactly_ten_steps(events):
    ten = ["login", "page_view"] * 5
    view = events(walk("U1", *ten) + walk("U2", *ten, "login", "purchase") + walk("U3", "login", "login"))
    found = S.common_journeys(view).orderBy("raw_path", "longer").collect()
    assert [(r.path, r.users, r.steps, r.longer) for r in found] == [
        (["Login"], 1, 1, False),
        (["Login", "Page View"] * 5, 1, 10, False),
        (["Login", "Page View"] * 5, 1, 10, True),
    ]


def test_journeys_keep_the_most_common_with_ties_by_path(events):
    rows = []
    for number, name in enumerate(["purchase", "login", "view_cart"]):
        rows += walk(f"U{number}", name)
    rows += walk("U8", "signup") + walk("U9", "signup")
    found = S.common_journeys(events(rows), limit=3).orderBy(F.desc("users"), "raw_path").collect()
    assert [r.path for r in found] == [["Signup"], ["Login"], ["Purchase"]]


@pytest.mark.parametrize("seconds", [600, 10**9])
def test_without_ids_ties_count_once(events, random_rows, seconds):
    """Events of one time and name follow each other, whatever their number."""
    view = events([{**row, "id": None} for row in random_rows]).drop("event_id")
    in_order = sorted(random_rows, key=lambda r: (r["ts"] is not None, r["ts"] or "", r["name"]))
    expected = {}
    for row in in_order:
        names = expected.setdefault(row["uid"], [])
        if not names or names[-1] != row["name"]:
            names.append(row["name"])
    paths = {r.uid: r.path for r in S.user_paths(S.first_steps(view, 10, seconds)).collect()}
    assert paths == {uid: names[:10] for uid, names in expected.items()}
    kept = S.collapse_repeats(view, seconds).collect()
    assert Counter(r.uid for r in kept) == {uid: len(names) for uid, names in expected.items()}
    assert S.with_previous(view, seconds).agg(F.sum("repeats")).first()[0] == len(random_rows)
