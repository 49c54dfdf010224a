import json
import random
import time

import pytest
from pyspark.sql import functions as F
from runlens.streaming import ledger, store

SCHEMA = "instance_id string, repo string, resolve_rate double"
KEY = "instance_id"


@pytest.fixture
def schema(spark):
    return spark.createDataFrame([], SCHEMA).schema


def rows(spark, ids, repo="r"):
    return spark.createDataFrame([(i, repo, 0.5) for i in ids], SCHEMA)


def ids_of(spark, root, schema):
    return sorted(r[KEY] for r in store.read(spark, root, schema).collect())


def put(spark, root, schema, ids, batch, stream="s"):
    return store.add(rows(spark, ids), root, schema, KEY, stream, batch, {"rates": F.col("resolve_rate")})


def test_batches_levels_and_sums(spark, tmp_path, monkeypatch, schema):
    monkeypatch.setattr(store, "FAN", 2)
    root, rng, want = str(tmp_path / "t"), random.Random(1), set()
    assert ids_of(spark, root, schema) == []
    for batch in range(9):
        ids = {f"i{rng.randint(0, 30)}" for _ in range(5)}
        assert put(spark, root, schema, ids, batch)
        want |= ids
        assert ids_of(spark, root, schema) == sorted(want)
        seen = store.snapshot(spark, root)
        assert seen.totals == {"rows": len(want), "rates": len(want) / 2}
        assert sum(s.rows for s in seen.segments) == len(want)
        per_level = [s.level for s in seen.segments]
        assert all(per_level.count(level) < 2 for level in per_level)
    assert max(s.level for s in seen.segments) >= 2
    assert not put(spark, root, schema, ["late"], 8)
    assert len(list((tmp_path / "t" / "_commits").glob("*.json"))) <= store.KEPT
    live = {p.name for p in (tmp_path / "t" / "data").iterdir()}
    listed = {s.path.split("/")[1] for s in seen.segments}
    assert listed <= live and len(live) <= len(listed) + 3 * store.KEPT


def test_only_touched_buckets_are_read(spark, tmp_path, monkeypatch, schema):
    monkeypatch.setattr(store, "FAN", 4)
    root = str(tmp_path / "t")
    for batch in range(4):
        put(spark, root, schema, [f"{batch}-{i}" for i in range(50)], batch)
    seen = store.snapshot(spark, root)
    assert [(s.level, s.buckets, s.rows) for s in seen.segments] == [(1, 4, 200)]
    one = rows(spark, ["1-7"])
    found = store.known_ids(one, root, schema, KEY, seen)
    assert 20 < found.count() < 100
    assert found.where("instance_id = '1-7'").count() == 1
    assert all("_bucket=" in f for f in found.inputFiles())
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "ReadSchema: struct<instance_id:string>" in plan


STEPS = ["_store", "_commit", "remove", "compact", "tidy"]


@pytest.mark.parametrize("broken", STEPS)
def test_a_crash_between_any_two_steps(spark, tmp_path, monkeypatch, schema, broken):
    """The batch that crashed comes again and everything is there once."""
    monkeypatch.setattr(store, "FAN", 2)
    root = str(tmp_path / "t")
    put(spark, root, schema, ["a", "b"], 0)
    put(spark, root, schema, ["a"], 1)  # adds nothing: its empty segment is removed
    owner = store.Folder if broken == "remove" else store
    real = getattr(owner, broken)

    for after in (False, True):
        def fail(*args, **kwargs):
            if after:
                real(*args, **kwargs)
            raise OSError("lost")

        batch = 2 + after
        monkeypatch.setattr(owner, broken, fail)
        ids = ["a", f"c{after}"] if broken != "remove" else ["a"]
        with pytest.raises(OSError):
            put(spark, root, schema, ids, batch)
        monkeypatch.setattr(owner, broken, real)
        seen = ids_of(spark, root, schema)
        assert set(seen) >= {"a", "b"} and len(seen) == len(set(seen))
        put(spark, root, schema, ids, batch)
        assert set(ids) <= set(ids_of(spark, root, schema))
    put(spark, root, schema, ["z"], 9)
    got = ids_of(spark, root, schema)
    assert len(got) == len(set(got)) and {"a", "b", "z"} <= set(got)
    assert store.snapshot(spark, root).totals["rows"] == len(got)


def test_another_stream_commits_first(spark, tmp_path, monkeypatch, schema):
    root, real, met = str(tmp_path / "t"), store._commit, []

    def late(folder, now):
        if not met:
            met.append(1)
            put(spark, root, schema, ["a", "x"], 0, stream="other")
        return real(folder, now)

    monkeypatch.setattr(store, "_commit", late)
    put(spark, root, schema, ["a", "b"], 0)
    got = sorted((r[KEY], r[store.STREAM]) for r in store.read(spark, root, schema).collect())
    assert got == [("a", "other"), ("b", "s"), ("x", "other")]
    assert dict(store.snapshot(spark, root).streams) == {"s": 0, "other": 0}


def test_merge_beside_a_merge(spark, tmp_path, monkeypatch, schema):
    """Two writers merge the same segments: the slower one gives up its copy."""
    monkeypatch.setattr(store, "FAN", 2)
    root, real, met = str(tmp_path / "t"), store._commit, []
    put(spark, root, schema, ["a"], 0)

    def late(folder, now):
        if not met and any(s.level for s in now.segments):
            met.append(1)
            store.compact(spark, root, schema, KEY)
        return real(folder, now)

    monkeypatch.setattr(store, "_commit", late)
    put(spark, root, schema, ["b"], 1)
    assert met and ids_of(spark, root, schema) == ["a", "b"]
    assert [s.level for s in store.snapshot(spark, root).segments] == [1]


def test_state_of_an_endless_stream_stops_growing(spark, tmp_path, schema):
    source, root = tmp_path / "in", str(tmp_path / "t")
    source.mkdir()
    timed = schema.add("at", "timestamp")

    def line(i, minute):
        return json.dumps({KEY: i, "repo": "r", "resolve_rate": 1.0, "at": f"2024-01-01T{minute // 60:02d}:{minute % 60:02d}:00Z"})

    for minute in range(8):
        body = [line(f"{minute}-{k}", 10 * minute) for k in range(4)] + [line(f"{minute}-0", 10 * minute)]
        if minute == 7:
            body.append(line("0-1", 70))  # long after its id left the state
        (source / f"{minute}.json").write_text("\n".join(body))
        time.sleep(0.02)

    def run():
        stream = ledger.stream_results(spark, str(source), timed, files_per_trigger=1)
        query = ledger.run_ledger(
            stream, root, str(tmp_path / "cp"), schema, keep_ids=True, late="15 minutes", seen=F.col("at"),
            sums=ledger.progress_sums(),
        )
        query.awaitTermination()
        return [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]

    held = run()
    assert max(held) <= 20 and len(held) >= 8
    want = sorted(f"{m}-{k}" for m in range(8) for k in range(4))
    assert ids_of(spark, root, schema) == want
    # After a restart a repeat that the state has forgotten is still caught.
    (source / "9.json").write_text(line("3-3", 200) + "\n" + line("new", 200))
    run()
    assert ids_of(spark, root, schema) == sorted([*want, "new"])
    shown = ledger.ledger_progress(spark, root, 40).first()
    assert (shown.done, shown.total, shown.resolved_any, shown.avg_resolve_rate) == (33, 40, 33, 1.0)


def test_progress_of_an_absent_ledger(spark, tmp_path):
    shown = ledger.ledger_progress(spark, str(tmp_path / "none"), 3).first()
    assert tuple(shown) == (0, 3, 0, None)
