import random
from bisect import bisect_right

from pyspark.sql import functions as F

from rallyframe.operators.asof_snapshots import attributes_at, history
from rallyframe.operators.orphans import Reference, key_runs, orphans, orphans_by_period
from rallyframe.operators.snapshot_diff import chunk_digests, listed_keys, snapshot_changes, with_chunks
from rallyframe.util import discard, global_rank, materialize, purge, salted_join


def changes_of(rows, **options):
    return {
        (r.delivery, r.key): r.change
        for r in snapshot_changes(rows, F.col("d"), "k", ["seq"], ["a", "b"], **options).collect()
    }


def test_snapshot_changes_against_dictionaries(spark):
    rng = random.Random(3)
    rows, state = [], {}
    for day in range(6):
        for key in range(200):
            if rng.random() < 0.1:
                state.pop(key, None)
            elif rng.random() < 0.2:
                state[key] = (rng.choice(["x", None, "y"]), rng.choice([1, None]))
        for key, value in state.items():
            if rng.random() < 0.3:
                rows.append((str(day), f"k{key}", 0, "old", 9, "extra"))
            rows += [(str(day), f"k{key}", 1, *value, "extra")] * rng.choice([1, 2])
    frame = spark.createDataFrame(rows, "d string, k string, seq int, a string, b int, key string")
    last = {}
    for d, k, s, a, b, _ in rows:
        last[(d, k)] = (a, b) if s else last.get((d, k), (a, b))
    want = {}
    for day in range(1, 6):
        new, old = ({k: v for (d, k), v in last.items() if d == str(x)} for x in (day, day - 1))
        for k in new.keys() | old.keys():
            change = "added" if k not in old else "removed" if k not in new else "changed" if new[k] != old[k] else None
            if change:
                want[(str(day), k)] = change
    assert changes_of(frame, chunk_keys=4) == want
    assert changes_of(frame, chunk_keys=1000) == want
    assert changes_of(frame.where("false")) == {} and changes_of(frame.where("d = '0'")) == {}
    assert changes_of(frame.withColumn("k", F.lit(None).cast("string"))) == {}


def test_values_before_and_after(spark):
    rows = [("1", "a", 0, "x", 1), ("1", "b", 0, "y", None), ("2", "a", 0, "z", 1), ("2", "a", 1, "x", 2), ("2", "c", 0, None, None)]
    frame = spark.createDataFrame(rows, "d string, k string, seq int, a string, b int")
    got = {r.key: (r.change, r.before, r.after) for r in snapshot_changes(frame, F.col("d"), "k", ["seq"], ["a", "b"], values=True).collect()}
    assert got == {"a": ("changed", ("x", 1), ("x", 2)), "b": ("removed", ("y", None), None), "c": ("added", None, (None, None))}


def test_chunk_digests_stand_for_their_delivery_alone(spark):
    rows = spark.createDataFrame([(d, f"{k:04}", 0, k) for d in ("a", "b") for k in range(300) if d == "a" or k != 7], "d string, key string, seq int, v int")
    digests = lambda x: {(r.delivery, r.chunk): (r.n, r.a, r.b) for r in chunk_digests(with_chunks(listed_keys(x, F.col("d"), "key", ["seq"], ["v"]), 8)).collect()}
    both = digests(rows)
    assert both == digests(rows.where("d = 'a'")) | digests(rows.where("d = 'b'")) and len(both) > 16
    alike = [c for d, c in both if d == "a" and both.get(("b", c)) == both[("a", c)]]
    assert len(alike) >= sum(d == "a" for d, _ in both) - 2


def test_orphans_against_sets(spark):
    rng = random.Random(4)
    ids = [f"p:{n}" for n in [*range(1, 60), *range(16380, 16390), 10**17]] + ["p:007", "q:5", "t:00ff00ff00ff00ff", "t:ffffffffffffffff", "odd", "p:5 "]
    parents = [x for x in ids if rng.random() < 0.6] + [None]
    rows = [(f"m{n}", rng.choice([*ids, None, "p:3"]), "20240101" if n % 3 else None) for n in range(500)]
    child = spark.createDataFrame([*rows, (None, "p:999", "20240101")], "id string, ref string, date string")
    parent = spark.createDataFrame([(p, 1) for p in parents] * 2, "key string, ref int")
    refs = [Reference("c", child, "id", "ref", F.substring("date", 1, 4), parent, "key")]
    got = {(r.record_id, r.missing_id, r.period) for r in orphans(refs).collect()}
    assert got == {(i, r, d[:4] if d else "") for i, r, d in rows if r and r not in parents}
    total = orphans_by_period(refs).agg(F.sum("orphan_records")).first()[0]
    assert total == len(got)
    empty = [Reference("c", child, "id", "ref", F.lit("x"), parent.where("false"), "key")]
    assert orphans(empty).count() == len({i for i, r, _ in rows if r})
    assert orphans([Reference("c", child.where("false"), "id", "ref", F.lit("x"), parent, "key")]).count() == 0


def test_runs_are_contiguous(spark):
    keys = spark.createDataFrame([(f"p:{n}",) for n in (1, 2, 3, 7, 8, 3)], "key string")
    assert sorted((r["first"], r["last"]) for r in key_runs(keys).collect()) == [(1, 3), (7, 8)]


def test_attributes_at_against_bisection(spark):
    rng = random.Random(6)
    days = [f"20{y:02}{m:02}{d:02}" for y in (20, 21, 23) for m in (1, 2, 12) for d in (1, 15, 28)]
    log = [(rng.choice("abc"), rng.choice(days[:-4])) for _ in range(60)]
    log = [(e, d, f"{e}{d}", "x") for e, d in log]
    events = [(n, rng.choice(["a", "b", "c", "z", None]), rng.choice([*days, "20300101", "soon", None])) for n in range(300)]
    changes = spark.createDataFrame([*log, (None, days[0], "n", ""), ("a", None, "n", ""), ("a", days[0], None, "")], "ent string, d string, v string, n string")
    frame = spark.createDataFrame([(*e, "old") for e in events], "n int, ent string, day string, version string")
    known = history(changes, "ent", "d", "v")
    got = {r.n: r.version for r in attributes_at(frame, "ent", "day", known).collect()}
    for n, e, d in events:
        dates = sorted(x[1] for x in log if x[0] == e)
        k = bisect_right(dates, d) if d and d.isdigit() else 0
        assert got[n] == (f"{e}{dates[k - 1]}" if k else None)
    # a snapshot for every period from the one after the first change to the one after the last of all
    spans = {r.entity: (r.a, r.b, r.n) for r in known.snapshots.groupBy("entity").agg(F.min("period").alias("a"), F.max("period").alias("b"), F.count("period").alias("n")).collect()}
    assert all(b == known.last + 1 and n == b - a + 1 for a, b, n in spans.values()) and set(spans) == {x[0] for x in log}
    assert attributes_at(frame, "ent", "day", history(changes.where("false"), "ent", "d", "v")).where("version is not null").count() == 0
    assert attributes_at(frame.where("false"), "ent", "day", known).count() == 0


def test_global_rank_and_salted_join(spark):
    rows = spark.range(1000).withColumn("x", (F.col("id") * 7919) % 1000)
    ranked = global_rank(rows, [F.asc("x")], "place").collect()
    assert all(r.place == r.x + 1 for r in ranked)
    left = spark.createDataFrame([("hot", n) for n in range(100)] + [("cold", 0), (None, 1)], "k string, n int")
    right = spark.createDataFrame([("hot", "v")], "k string, v string")
    assert salted_join(left, right, ["k"], [F.col("n")]).count() == 100
    assert salted_join(left, right, ["k"], [F.col("n")], "left").count() == 102
    assert salted_join(left, right, ["k"], [F.col("n")], "left_anti").count() == 2


def test_written_tables_can_be_purged(spark):
    kept = materialize(spark.range(5))
    assert kept.count() == 5
    import os

    files = [f.removeprefix("file:") for f in kept.inputFiles()]
    other = materialize(spark.range(2))
    gone = [f.removeprefix("file:").removeprefix("//") for f in other.inputFiles()]
    discard(other)
    discard(spark.range(1))
    assert gone and not any(os.path.exists(f) for f in gone) and kept.count() == 5
    purge(spark)
    assert files and not any(os.path.exists(f.removeprefix("//")) for f in files)
