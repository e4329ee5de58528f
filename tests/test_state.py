from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from pipelinekit.operators.state import apply_changes, overlay, override, snapshot_diff

STATE = "seq long, id string, name string, type string, external_job_id string, fabric_id string, is_paused boolean, skip_processing boolean, release_tag string"
DESIRED = "id string, fabric_id string, external_job_id string, enabled boolean, valid boolean"
CHANGES = "seq long, operation string, failed boolean, id string, name string, type string, external_job_id string, fabric_id string, is_paused boolean, skip_processing boolean, release_tag string"


def state_row(seq, id, place, ext="x", type="A", paused=False, skip=False, tag=None):
    return (seq, id, f"n{id}", type, ext, place, paused, skip, tag)


def classes(df):
    return sorted((r["id"], r["fabric_id"] or "", r["class"]) for r in df.collect())


def test_overlay_row_wins_whole_and_null_keys_match(spark, rows):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, v string")
    top = spark.createDataFrame([(2, None), (3, "z"), (None, "n")], "k int, v string")
    assert rows(overlay(base, top, ["k"])) == [(None, "n"), (1, "a"), (2, None), (3, "z")]


def test_override_first_and_non_empty(spark, rows):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", None)], "id string, place int")
    over = spark.createDataFrame([(1, "a", "9"), (2, "a", "8"), (1, "b", ""), (2, "b", "7")], "n int, id string, p string")
    assert rows(override(df, over, "id", "place", "p", ["n"])) == [("a", "9"), ("b", "2"), ("c", "3"), ("d", None)]


@pytest.fixture(scope="module")
def state(spark):
    return spark.createDataFrame(
        [
            state_row(1, "same", "1"),
            state_row(2, "moved", "2"),
            state_row(3, "two", "1"),
            state_row(4, "two", "2"),
            state_row(5, "gone", "1"),
            state_row(6, "gone2", "99"),
            state_row(7, "skipped", "1", skip=True),
            state_row(8, "other", "1", type="B"),
            state_row(9, "invalid", "1"),
            state_row(10, "renamed", "1", ext="old"),
            state_row(11, "off", "1"),
            state_row(12, "offpaused", "1", paused=True),
            state_row(13, "offmoved", "1"),
            state_row(14, "offmoved", "2"),
            state_row(15, "outside", "1"),
        ],
        STATE,
    )


@pytest.fixture(scope="module")
def desired(spark):
    return spark.createDataFrame(
        [
            ("same", "1", "x", True, True),
            ("moved", "1", "x", True, True),
            ("two", "1", "x", True, True),
            ("skipped", "1", "x", True, True),
            ("other", "1", "x", True, True),
            ("invalid", "1", "x", True, False),
            ("renamed", "1", "new", True, True),
            ("off", "1", "x", False, True),
            ("offpaused", "1", "x", None, True),
            ("offmoved", "1", "x", False, True),
            ("new", "1", "x", True, True),
            ("newoff", "2", "x", False, True),
            ("outside", "77", "x", True, True),
            ("homeless", None, "x", True, True),
        ],
        DESIRED,
    )


def test_snapshot_diff_in_place(state, desired):
    got = classes(snapshot_diff(state, desired, F.col("type") == "A", allowed=["1", "2"]))
    assert got == sorted(
        [
            ("same", "1", "REFRESH"),
            ("moved", "2", "MOVED"),
            ("moved", "1", "ADD"),
            ("two", "1", "REFRESH"),
            ("two", "2", "MOVED"),
            ("gone", "1", "REMOVE"),
            ("gone2", "99", "REMOVE"),
            ("skipped", "1", "ADD"),  # its recorded row is left out
            # "other" is recorded by another type: neither ADD nor REFRESH
            ("invalid", "1", "SKIP"),
            ("renamed", "1", "REFRESH"),
            ("off", "1", "REFRESH"),
            ("offpaused", "1", "REFRESH"),
            ("offmoved", "1", "REFRESH"),
            ("offmoved", "2", "MOVED"),
            ("new", "1", "ADD"),
            ("newoff", "2", "ADD"),
            ("outside", "77", "SKIP"),
            ("outside", "1", "REMOVE"),
            ("homeless", "", "SKIP"),
        ]
    )


def test_snapshot_diff_redeploy(state, desired):
    got = classes(snapshot_diff(state, desired, F.col("type") == "A", redeploy=True, known=["1", "2"]))
    assert got == sorted(
        [
            ("same", "1", "ADD"),
            ("moved", "2", "MOVED"),
            ("moved", "1", "ADD"),
            ("two", "2", "MOVED"),
            ("two", "1", "ADD"),
            ("gone", "1", "REMOVE"),  # gone2 lies in an unknown place
            ("skipped", "1", "ADD"),
            ("other", "1", "ADD"),
            ("invalid", "1", "SKIP"),
            ("renamed", "1", "RENAME"),
            ("renamed", "1", "ADD"),
            ("off", "1", "PAUSE"),
            ("offmoved", "2", "MOVED"),  # and so its other row is not paused
            ("new", "1", "ADD"),
            ("outside", "1", "MOVED"),
            ("outside", "77", "ADD"),
            ("homeless", "", "ADD"),
        ]
    )


def test_snapshot_diff_with_places_as_tables(spark, state, desired):
    of_type, places = F.col("type") == "A", lambda *p: spark.createDataFrame([(x,) for x in [*p, p[0], None]], "place string")
    assert classes(snapshot_diff(state, desired, of_type, allowed=places("1", "2"))) == classes(
        snapshot_diff(state, desired, of_type, allowed=["1", "2"])
    )
    assert classes(snapshot_diff(state, desired, of_type, redeploy=True, known=places("1"))) == classes(
        snapshot_diff(state, desired, of_type, redeploy=True, known=["1"])
    )


def replayed(state, changes):
    """The rules one change at a time: an ordered dict holds the rows of each key, in the order of a list."""
    listed, fresh = {}, iter(range(10**9))

    def drop(change):
        for at in [at for at, row in listed.items() if (row["id"], row["fabric_id"]) == (change["id"], change["fabric_id"])]:
            del listed[at]

    for row in sorted(state, key=lambda r: r["seq"]):
        listed[next(fresh)] = row
    for kind in ("DELETED", "REFRESH", "CREATED"):
        for change in sorted((c for c in changes if c["operation"] == kind and not c["failed"]), key=lambda c: c["seq"]):
            tags = [row["release_tag"] for row in listed.values() if row["id"] == change["id"]] if kind == "CREATED" else []
            drop(change)
            if kind != "DELETED":
                listed[next(fresh)] = change | {"release_tag": tags[0] if tags else change["release_tag"]}
    names = [f.split()[0] for f in STATE.split(", ")][1:]
    return sorted(str([row[n] for n in names]) for row in listed.values())


@pytest.mark.parametrize("seed", range(3))
def test_apply_changes_against_replay(spark, seed):
    """A thousand ids a run, each with its own few places, so that keys are often changed more than once."""
    rng = random.Random(seed)
    state, changes = [], []
    for i in [None, *range(999)]:
        places = rng.sample([None, "1", "2", "3", "4"], rng.randint(1, 4))
        kinds = rng.choice([["CREATED"], ["CREATED"] * 5 + ["DELETED", "REFRESH", "UPDATED"], ["CREATED", "DELETED", "REFRESH"]])
        name = None if i is None else f"j{i}"
        state += [(name, rng.choice(places)) for _ in range(rng.randint(0, 3))]
        changes += [(name, rng.choice(places), rng.choice(kinds)) for _ in range(rng.choice([0, 1, 3, 8, 20]))]
    rng.shuffle(state), rng.shuffle(changes)
    state = [state_row(n, i, p, tag=rng.choice([None, f"t{n}"])) for n, (i, p) in enumerate(state)]
    changes = [
        (n, kind, rng.choice([False, False, False, None, True]), i, f"m{n}", "A", f"y{n}", p, True, False, rng.choice([None, f"own{n}"]))
        for n, (i, p, kind) in enumerate(changes)
    ]
    sdf, cdf = spark.createDataFrame(state, STATE), spark.createDataFrame(changes, CHANGES)
    got = apply_changes(sdf, cdf)
    assert got.columns == sdf.columns[1:]
    dicts = lambda df, rows: [dict(zip(df.columns, r, strict=True)) for r in rows]
    assert sorted(str(list(r)) for r in got.collect()) == replayed(dicts(sdf, state), dicts(cdf, changes))


def test_a_key_created_again_and_again(spark):
    """One id takes all changes; each creation copies one far back, and tags go round over its places."""
    rng = random.Random(5)
    state = [state_row(1, "a", "0", tag="A"), state_row(2, "a", "1", tag="B")]
    changes = [
        (n, "CREATED", False, "a", f"m{n}", "A", f"y{n}", str(rng.randint(0, 4)), True, False, f"own{n}") for n in range(700)
    ]
    sdf, cdf = spark.createDataFrame(state, STATE), spark.createDataFrame(changes, CHANGES).repartition(5)
    dicts = lambda df, rows: [dict(zip(df.columns, r, strict=True)) for r in rows]
    assert sorted(str(list(r)) for r in apply_changes(sdf, cdf).collect()) == replayed(dicts(sdf, state), dicts(cdf, changes))


def test_nothing_to_apply(spark):
    state = spark.createDataFrame([state_row(1, "a", "1", tag="A")], STATE)
    none = spark.createDataFrame([], CHANGES)
    assert [r["release_tag"] for r in apply_changes(state, none).collect()] == ["A"]
    assert apply_changes(state.filter("false"), none).collect() == []


def test_created_twice_while_an_earlier_row_lasts(spark):
    sdf = spark.createDataFrame([state_row(1, "a", "1", tag="A"), state_row(2, "a", "2", tag="B")], STATE)
    change = lambda seq: (seq, "CREATED", False, "a", "n", "A", "y", "1", False, False, f"own{seq}")
    got = apply_changes(sdf, spark.createDataFrame([change(1), change(2)], CHANGES))
    assert {(r["fabric_id"], r["release_tag"]) for r in got.collect()} == {("2", "B"), ("1", "B")}


def test_created_twice_with_nothing_recorded(spark):
    """The first creation heads the list; the second one takes its tag."""
    change = lambda seq: (seq, "CREATED", False, "a", "n", "A", "y", "1", False, False, f"own{seq}")
    got = apply_changes(spark.createDataFrame([], STATE), spark.createDataFrame([change(2), change(3)], CHANGES))
    assert [(r["fabric_id"], r["release_tag"]) for r in got.collect()] == [("1", "own2")]
