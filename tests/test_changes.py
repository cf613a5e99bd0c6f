"""State of processed records and the diffs built on it."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lodewell.operators import upkeep
from lodewell.operators.changes import StateStore, changed_records, latest_by


def test_latest_by_breaks_ties_and_keeps_null_keys(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 5), ("a", 2, 5), (None, 3, 1)], "k string, id int, t int")
    got = {(r["k"], r["id"]) for r in latest_by(df, ["k"], [F.desc("t"), F.desc("id")]).collect()}
    assert got == {("a", 2), (None, 3)}


def test_changed_records(spark):
    cur = spark.createDataFrame([(1, "AA", "x"), (2, "bb", "x"), (3, None, "x"), (4, "dd", "x"), (4, "dd", "x"), (5, "ee", "x")], "id int, h string, content_hash string")
    state = spark.createDataFrame([(1, "aa", "v1"), (2, "zz", "v1"), (5, "ee", "old")], "key int, content_hash string, version string")
    got = {(r["id"], r["change"]) for r in changed_records(cur, state, "id", "h", "key", "content_hash", F.col("version") == "v1").collect()}
    assert got == {(2, "changed"), (4, "new"), (5, "changed")}
    assert changed_records(cur, state.filter("false"), "id", "h", "key", "content_hash").count() == 4
    assert changed_records(cur.filter("false"), state, "id", "h", "key", "content_hash").count() == 0


def test_state_store_survives_a_failed_run(spark, tmp_path):
    s = StateStore(spark, str(tmp_path / "state"))
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, h string")
    assert s.select(rows, "id", "h").count() == 2 and s.version() == 0
    assert s.commit(rows, "id", "h") == 1
    more = spark.createDataFrame([(1, "a"), (2, "B2"), (3, "c")], "id int, h string")
    assert {r["id"] for r in s.select(more, "id", "h").collect()} == {2, 3}

    class Broken(Exception):
        pass

    with pytest.raises(Exception):  # noqa: B017 - the write fails half-way
        bad = more.withColumn("h", F.when(F.col("id") == 3, F.raise_error(F.lit("lost"))).otherwise(F.col("h")))
        s.commit(bad, "id", "h")
    assert s.version() == 1 and {r["id"] for r in s.select(more, "id", "h").collect()} == {2, 3}
    assert s.commit(more, "id", "h") == 2
    assert s.select(more, "id", "h").count() == 0
    with pytest.raises(RuntimeError):
        s.commit(more, "id", "h", base=1)


def test_state_is_kept_in_deltas(spark, tmp_path):
    s = StateStore(spark, str(tmp_path / "state"))
    for i in range(12):
        s.commit(spark.createDataFrame([(i, f"h{i}"), (100, f"v{i}")], "id int, h string"), "id", "h")
        assert len(s.folders(s.version())) <= s.COMPACT
    now = {(r["record_key"], r["content_hash"]) for r in s.read().collect()}
    assert now == {(str(i), f"h{i}") for i in range(12)} | {("100", "v11")}
    assert s.vacuum() and {(r["record_key"], r["content_hash"]) for r in s.read().collect()} == now
    two = spark.createDataFrame([(7, "a"), (7, "B"), (7, None), (None, "x")], "id int, h string")
    s.commit(two, "id", "h")  # a key of two contents is covered by both
    assert s.select(two.filter("id is not null"), "id", "h").count() == 0


def test_of_two_racing_commits_one_wins(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    s = StateStore(spark, str(tmp_path / "state"))
    s.commit(spark.createDataFrame([(0, "a")], "id int, h string"), "id", "h")

    def run(i):
        try:
            return StateStore(spark, s.root).commit(spark.createDataFrame([(i, "x")], "id int, h string"), "id", "h", base=1)
        except RuntimeError:
            return None

    with ThreadPoolExecutor(4) as pool:
        won = list(pool.map(run, range(1, 5)))
    assert sorted(w for w in won if w) == [2] and s.read().count() == 2


def test_a_crash_before_the_swap_changes_nothing(spark, tmp_path, monkeypatch):
    from lodewell.operators import changes

    s = StateStore(spark, str(tmp_path / "state"))
    rows = spark.createDataFrame([(1, "a")], "id int, h string")

    def dies(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
        m.setattr(changes, "publish_once", dies)
        s.commit(rows, "id", "h")
    assert s.version() == 0 and s.select(rows, "id", "h").count() == 1
    assert s.commit(rows, "id", "h") == 1 and s.select(rows, "id", "h").count() == 0


def test_diff_classes(spark):
    old = spark.createDataFrame([("a", "h", 1, 1), ("b", "h", 1, 1), ("c", "h", 1, 1), ("d", "h", 1, 1)], "path string, content_hash string, size_bytes long, mtime_ms long")
    new = spark.createDataFrame([("a", "h", 1, 1), ("b", "H", 1, 2), ("c", "x", 2, 2), ("e", "h", 1, 1)], old.schema)
    assert {r["path"]: r["change"] for r in upkeep.diff(old, new).collect()} == {"a": "unchanged", "b": "touched", "c": "changed", "d": "deleted", "e": "new"}
    assert {r["path"] for r in upkeep.to_read(old, new).collect()} == {"b", "c", "e"}


def test_upserts(spark):
    old = spark.createDataFrame([("1", "file", "a", "r1", "m1"), ("2", "symbol", "s", "c1", "m")], "node_id string, type string, label string, ref_id string, metadata string")
    new = spark.createDataFrame([("9", "file", "a", None, "m2"), ("8", "symbol", "s", "c2", "m")], old.schema)
    got = sorted(tuple(r) for r in upkeep.upsert_nodes(old, new).collect())
    assert got == [("1", "file", "a", "r1", "m2"), ("2", "symbol", "s", "c1", "m"), ("8", "symbol", "s", "c2", "m")]
    e = spark.createDataFrame([("a", "b", "t", "1")], "from_id string, to_id string, type string, edge_id string")
    n = spark.createDataFrame([("a", "b", "t", "2"), ("a", "c", "t", "4"), ("a", "c", "t", "3")], e.schema)
    assert sorted(r["edge_id"] for r in upkeep.insert_ignore(e, n, ["from_id", "to_id", "type"], [F.asc("edge_id")]).collect()) == ["1", "3"]


def test_snapshots_refuse_an_older_epoch(spark, tmp_path):
    s = upkeep.Snapshots(spark, str(tmp_path / "snap"))
    s.publish({"n": spark.range(3)}, 2)
    with pytest.raises(RuntimeError):
        s.publish({"n": spark.range(5)}, 1)
    with pytest.raises(ValueError):
        s.publish({"n": spark.range(5)}, float("nan"))
    assert s.read("n").count() == 3


def test_claims(spark):
    t = lambda x: dt.datetime(2026, 1, 1, 0, 0, x)
    leases = spark.createDataFrame([("w1", "a", t(10)), ("w2", "a", t(50)), ("w3", None, None)], "workspace_id string, owner string, expires_at timestamp")
    claims = spark.createDataFrame([(w, "b", t(20), t(40)) for w in ("w1", "w2", "w3", "w4")], "workspace_id string, owner string, at timestamp, until timestamp")
    assert {r["workspace_id"]: r["owner"] for r in upkeep.claim(leases, claims).collect()} == {"w1": "b", "w2": "a", "w3": "b", "w4": "b"}


def test_settings():
    s = upkeep.Settings.from_json('{"chunking": {"targetTokens": 5, "overlapTokens": 1}, "other": 1}')
    assert s.chunking == {"targetTokens": 5, "overlapTokens": 1} and s.retrieval["finalLimit"] == 10
    assert upkeep.settings_fingerprint({"a": 1, "b": 2}) == upkeep.settings_fingerprint({"b": 2, "a": 1})
