import datetime as dt

from pyspark.sql import functions as F

from cartloom.streaming.corrections import session_revisions

SCHEMA = "session_id string, ts timestamp, line int"
START = dt.datetime(2024, 1, 1)


def minutes(session, *at):
    return [(session, START + dt.timedelta(minutes=m), m) for m in at]


def test_sessions_close_and_are_corrected_until_their_lines_expire(spark, tmp_path):
    steps = [
        [*minutes("a", 0, 10), *minutes("b", 5), (None, START, 1), ("n", None, 1)],
        minutes("x", 100),  # a and b close
        [*minutes("a", 4), *minutes("x", 101)],  # a late line of a, within its window
        minutes("b", 60),  # b goes on, so it ends later
        minutes("x", 300),  # all states but x's go
        [*minutes("a", 6), *minutes("y", 301)],  # too late: dropped
    ]
    seen, states = [], []
    for i, rows in enumerate(steps):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = session_revisions(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), "ts", "30 minutes", "15 minutes", "2 hours")
        query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        query.awaitTermination()
        states.append(query.recentProgress[-1].stateOperators[0].numRowsTotal)
        out = spark.read.schema(stream.schema).parquet(f"{tmp_path}/out")
        now = {(r.session_id, r.revision, int((r.session_start - START).total_seconds() / 60), int((r.session_end - START).total_seconds() / 60), r.lines) for r in out.collect()}
        seen.append(now - (set().union(*seen) if seen else set()))
    assert seen[1] == {("a", 0, 0, 10, 2), ("b", 0, 5, 5, 1)}
    assert seen[2] == {("a", 1, 0, 10, 3)}
    assert seen[0] == set() and seen[5] == set()
    assert seen[3] | seen[4] == {("b", 1, 5, 60, 2)}
    assert states[3] == 3 and states[4] == 1


def test_a_run_over_everything_at_once_equals_plain_sessions(spark, tmp_path):
    rows = [r for i in range(50) for r in minutes(f"s{i}", i, i + 7, i + 3)] + minutes("end", 10_000)
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{tmp_path}/in")
    stream = session_revisions(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), "ts", "30 minutes", "0 minutes", "1 hour")
    stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema(stream.schema).parquet(f"{tmp_path}/out")
    assert out.filter("revision = 0 AND lines = 3").count() == 50 == out.count()
    assert out.filter(F.unix_millis("session_end") - F.unix_millis("session_start") != 7 * 60_000).count() == 0
