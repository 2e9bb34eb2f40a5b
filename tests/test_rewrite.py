"""What a rewrite of parts costs: rows are written once, and a merge shuffles the stored rows once."""

from pyspark.sql import functions as F

from pulseframe.operators import merge as G
from pulseframe.plans import ingest
from pulseframe.plans.ingest import Store
from pulseframe.sources import adapter as A, tables as T

SF = "/root/testdata/sf0.001"
ROWS = "k string, a int, b int, ordinal int"


def test_a_merge_of_whole_sides_gives_the_same(spark):
    base = spark.createDataFrame([("x", 1, 1, 0), ("y", 2, None, 0), ("z", 3, 3, 0), (None, 4, 4, 0), (None, 5, 5, 0)], ROWS).drop("ordinal")
    batch = spark.createDataFrame(
        [("x", None, 7, 1), ("x", 9, None, 2), ("y", None, None, 1), ("new", 1, None, 1), ("new", None, 2, 2), (None, 8, 8, 1), (None, 6, None, 3)], ROWS)
    merged = [sorted(map(tuple, G.merge_by_policy(base, batch, ["k"], ["a"], ["b"], whole=w).collect()), key=str) for w in (False, True)]
    assert merged[0] == merged[1]
    assert ("x", 9, 7) in merged[1] and ("y", None, None) in merged[1] and ("new", None, 2) in merged[1] and len(merged[1]) == 7
    none = batch.filter("false")
    assert sorted(map(tuple, G.merge_by_policy(base, none, ["k"], ["a"], ["b"], whole=True).collect()), key=str) == sorted(map(tuple, base.collect()), key=str)


def test_parts_without_rows_go_and_nothing_is_staged(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(f"u{i}", v) for i in range(8) for v in (1, 2)], "user_id string, v int").withColumn(
        "ts", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("v") * 86_400)).select("user_id", "ts", "v")
    T.replace_slice(rows, path, "ts", ("user_id",), 2)
    stored = lambda: T.read_table(spark, path, rows.schema)
    parts = T.parts_of(stored(), buckets=2)
    written, write = [], T.write_parts
    monkeypatch.setattr(T, "write_parts", lambda df, *more: (written.extend(df.inputFiles()), write(df, *more))[1])
    T.rewrite_parts(spark, path, rows.schema, parts, "ts", ("user_id",), lambda base: base.filter("v = 2").withColumn("v", F.lit(5)), buckets=2)
    assert sorted((r.user_id, r.v) for r in stored().collect()) == sorted((f"u{i}", 5) for i in range(8))
    assert len(list((tmp_path / "t").glob("day=*/user_bucket=*"))) == len(parts) // 2
    assert written and all(f"{path}/day=" in f for f in written)  # straight from the table, not from a copy
    T.rewrite_parts(spark, path, rows.schema, T.parts_of(stored(), buckets=2), "ts", ("user_id",), lambda base: base.filter("false"), buckets=2)
    assert not list((tmp_path / "t").glob("day=*/user_bucket=*"))


def test_what_has_nothing_to_do_joins_nothing(spark, tmp_path, monkeypatch):
    calls = []
    for name in ("prune", "tombstone"):
        monkeypatch.setattr(G, name, lambda *a, f=getattr(G, name), n=name, **k: (calls.append(n), f(*a, **k))[1])
    merge = lambda *a, **k: (calls.append("merge"), G.merge_samples(*a, **k))[1]
    store = Store(spark, str(tmp_path), 2)
    rows = A.samples(spark, SF).limit(60).withColumn("ordinal", F.lit(1)).withColumn("deleted_at", F.lit(None).cast("timestamp")).cache()
    none = rows.filter("false").select("user_id", "hk_uuid")
    first = rows.agg(F.date_trunc("day", F.min("ts"))).first()[0]
    cutoffs = rows.select("user_id").distinct().withColumn("cutoff", F.lit(first) - F.expr("interval 5 days"))
    at = F.lit("2024-03-01").cast("timestamp")
    ingest._merge_raw(store, "samples", rows, none, cutoffs, at, merge)
    assert calls == ["merge"] and store.read("samples").count() == 60
    some = rows.select("user_id", "hk_uuid").limit(7).cache()
    ingest._merge_raw(store, "samples", rows.filter("false"), some, cutoffs, at, merge)
    assert calls == ["merge", "tombstone"] and store.read("samples").filter("deleted_at IS NOT NULL").count() == 7
    late = cutoffs.withColumn("cutoff", F.lit(first) + F.expr("interval 3 days"))
    left = store.read("samples").join(late, "user_id").filter("ts >= cutoff").count()
    ingest._merge_raw(store, "samples", rows.filter("false"), none, late, at, merge)
    assert calls == ["merge", "tombstone", "prune"] and store.read("samples").count() == left < 60
