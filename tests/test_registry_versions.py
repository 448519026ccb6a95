import random

from pyspark.sql import functions as F

from cartloom.sources import registry as reg
from cartloom.sources import registry_versions as v


def test_asof_join_equals_a_scan(spark, monkeypatch):
    pick = random.Random(2)
    for most in (10, 1_000_000):  # with and without keys that are spread
        monkeypatch.setattr(v, "MERGED_ROWS", most)
        left = [(i, pick.choice(["a", "a", "a", "b", "c", None]), pick.choice([None, 5, 10, 15, pick.randint(0, 60)])) for i in range(300)] + [(7, "a", 5)] * 3
        right = [(k, t, None if t % 4 == 0 else f"{k}{t}") for k in ("a", "b", "d") for t in range(0, 60, 5)]
        got = v.asof_join(spark.createDataFrame(left, "id int, key string, t int"), spark.createDataFrame([*right, (None, 1, "no")], "key string, since int, value string"), ["key"], "t", "since", "value")
        assert got.columns == ["id", "key", "t", "value"]
        want = []
        for i, k, t in left:
            before = [r for r in right if r[0] == k and t is not None and r[1] <= t]
            want.append((i, k, t, max(before, key=lambda r: r[1])[2] if before else None))
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_versions_of_stores_that_change_go_and_come_again(spark, tmp_path):
    store = lambda rewrite, domain="x.com": ("1", domain, [r"/p/(\d+)"], [], {"rewrite": ("p", rewrite)})
    weeks = {"2024-01-01T00:00:00": [store("a"), ("2", "y.com", [], [], {})], "2024-01-08T00:00:00": [store("a"), ("3", "z.com", [], [], {})],
             "2024-01-15T00:00:00": [store("b", "w.com")], "2024-01-22T06:30:00": [store("b", "w.com"), ("2", "y.com", [], [], {})]}
    path = str(tmp_path)
    for time, rows in weeks.items():
        v.write_registry_snapshot(reg.registry_from_rows(spark, rows), path, time)
    v.write_registry_snapshot(reg.registry_from_rows(spark, weeks["2024-01-08T00:00:00"]), path, "2024-01-08T00:00:00")
    versions = v.registry_versions(v.read_registry_snapshots(spark, path))
    found = {(r.kind, r.key, f"{r.valid_from:%d}", r.valid_to and f"{r.valid_to:%d}", r.config and r.config.rewrite_to) for r in versions.collect()}
    assert {x for x in found if x[0] == "id"} == {("id", "1", "01", "15", "a"), ("id", "1", "15", None, "b"), ("id", "2", "01", "08", None), ("id", "2", "08", "22", None), ("id", "2", "22", None, None), ("id", "3", "08", "15", None), ("id", "3", "15", None, None)}
    assert {x[1:4] for x in found if x[0] == "domain"} == {("x.com", "01", "15"), ("x.com", "15", None), ("w.com", "15", None), ("y.com", "01", "08"), ("y.com", "08", "22"), ("y.com", "22", None), ("z.com", "08", "15"), ("z.com", "15", None)}
    gone = versions.filter("config IS NULL").select("key").collect()
    assert sorted(r.key for r in gone) == ["2", "3", "x.com", "y.com", "z.com"]
    events = [(1, "1", None, "2023-12-31 23:59:59"), (2, "1", "y.com", "2024-01-01 00:00:00"), (3, "1", None, "2024-01-15 00:00:00"), (4, "", "x.com", "2024-01-14 00:00:00"), (5, None, "x.com", "2024-01-16 00:00:00"),
              (6, "2", None, "2024-01-09 00:00:00"), (7, "2", None, "2024-03-01 00:00:00"), (8, None, None, "2024-01-09 00:00:00"), (9, "1", None, None)]
    df = spark.createDataFrame(events, "i int, store_id string, domain string, at string").withColumn("at", F.col("at").cast("timestamp"))
    got = {r.i: (r.primary_id, r.rewrite_to) for r in v.store_lookup_at(df, versions, "at").collect()}
    assert got == {1: (None, None), 2: ("1", "a"), 3: ("1", "b"), 4: ("1", "a"), 5: (None, None), 6: (None, None), 7: ("2", None), 8: (None, None), 9: (None, None)}
    assert v.store_lookup_at(df.limit(0), versions, "at").collect() == []
