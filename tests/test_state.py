"""The state table against a dictionary that does the same one row after another."""

from __future__ import annotations

import random
import re
from datetime import datetime, timedelta

import pytest

from vitrine.sources.state import StateTable

FIRST = datetime(2024, 1, 1)


def seeded(spark, items):
    return spark.createDataFrame(items, "id string, key string, size_bytes long")


def recorded(spark, rows):
    return spark.createDataFrame(rows, "id string, status string, error string, elapsed_ms double, updated_at timestamp")


def rows_of(df):
    return {r.id: (r.key, r.size_bytes, r.status, r.error, r.elapsed_ms) for r in df.collect()}


class Plain:
    """Insert or ignore, update by id."""

    def __init__(self):
        self.rows = {}

    def seed(self, items):
        for i, key, size in items:
            if i is not None:
                self.rows.setdefault(i, (key, size, "pending", None, None))

    def record(self, rows):
        for i, status, error, elapsed, _ in sorted(rows, key=lambda r: r[4]):
            if i in self.rows:
                self.rows[i] = (*self.rows[i][:2], status, error, elapsed)


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_any_order_of_changes_and_folds(spark, tmp_path, monkeypatch, broadcast):
    monkeypatch.setattr("vitrine.sources.state.BROADCAST_ROWS", broadcast)
    rnd, table, plain = random.Random(3), StateTable(spark, str(tmp_path / "s"), 4), Plain()
    at = 0
    for step in range(12):
        kind = rnd.choice(["seed", "record", "record", "fold"])
        if kind == "seed":
            items = [(rnd.choice([None, *map(str, range(30))]), f"k{step}-{i}", i) for i in range(8)]
            items = list({i[0]: i for i in reversed(items)}.values())[::-1]
            table.seed(seeded(spark, items).coalesce(1))
            plain.seed(items)
        elif kind == "record":
            rows = []
            for _ in range(8):
                at += 1
                rows.append((str(rnd.randrange(35)), rnd.choice(["done", "failed", "skipped"]), rnd.choice([None, "e"]), float(at), FIRST + timedelta(seconds=at)))
            rnd.shuffle(rows)
            table.record(recorded(spark, rows))
            plain.record(rows)
        else:
            table.fold()
        if step % 3 == 2:
            assert rows_of(table.current()) == plain.rows
    table.fold()
    assert rows_of(table.current()) == plain.rows and not table.fold()
    some = ["3", "7", "none"]
    assert rows_of(table.of(some)) == {i: r for i, r in plain.rows.items() if i in some}
    done = {i for i, r in plain.rows.items() if r[2] == "done"}
    assert {r.id for r in table.finished(retry_failed=True).collect()} == done
    assert {r.id for r in table.pending(seeded(spark, [("3", "", 0), ("new", "", 0)])).collect()} == {"new"} | ({"3"} if plain.rows.get("3", (0, 0, "pending"))[2] == "pending" else set())


def test_a_fold_that_dies_changes_nothing(spark, tmp_path, monkeypatch):
    table = StateTable(spark, str(tmp_path / "s"), 4)
    table.seed(seeded(spark, [("a", "ka", 1), ("b", "kb", 2)]))
    assert table.fold()
    table.record(recorded(spark, [("a", "done", None, 1.0, FIRST)]))
    before = rows_of(table.current())

    def dies(manifest):
        raise RuntimeError("power cut")

    with monkeypatch.context() as patched, pytest.raises(RuntimeError, match="power"):
        patched.setattr(table, "_publish", dies)
        table.fold()
    assert rows_of(table.current()) == before == {"a": ("ka", 1, "done", None, 1.0), "b": ("kb", 2, "pending", None, None)}
    assert len(list((tmp_path / "s" / "snapshots").iterdir())) == 2
    # a batch whose writer died has no mark of success
    torn = tmp_path / "s" / "changes" / f"{9:012}"
    torn.mkdir()
    (torn / "part-0.parquet").write_bytes(b"torn")
    assert rows_of(table.current()) == before
    assert table.seed(seeded(spark, [("c", "kc", 3)])) == 10
    assert table.fold() and table.sweep() == 6  # the old snapshot and the dead one, three changes and the torn one
    assert rows_of(table.current()) == before | {"c": ("kc", 3, "pending", None, None)}


def test_only_what_is_needed_is_read(spark, tmp_path):
    table = StateTable(spark, str(tmp_path / "s"), 8)
    table.seed(spark.range(1000).selectExpr("CAST(id AS string) AS id", "concat('k', id) AS key", "id AS size_bytes"))
    table.fold()
    table.record(recorded(spark, [("5", "done", None, 1.0, FIRST)]))
    plan = table.of(["5"])
    assert re.search(r"PartitionFilters: \[isnotnull\(bucket#\d+\), \(bucket#\d+ = \d\)\]", plan._jdf.queryExecution().explainString(plan.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")))
    assert rows_of(plan) == {"5": ("k5", 5, "done", None, 1.0)}
    # history that was folded isn't read again
    assert not [f for f in table.current().inputFiles() if f"changes/{0:012}" in f]
    # a few changes go to the snapshot, which isn't shuffled
    text = table.current()._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


def test_facts(spark, tmp_path):
    table = StateTable(spark, str(tmp_path / "s"))
    assert table.fact("model") is None and table.current().count() == 0
    table.remember("model", "a")
    table.remember("model", "b")
    table.remember("dims", "3")
    assert (StateTable(spark, str(tmp_path / "s")).fact("model"), table.fact("dims")) == ("b", "3")
    with pytest.raises(RuntimeError, match="another writer"):
        table._publish({"version": 1, "snapshot": None, "folded": -1, "buckets": 4, "facts": {}})
    table.drop()
    assert not (tmp_path / "s").exists()
