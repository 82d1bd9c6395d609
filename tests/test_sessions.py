from pyspark.sql import functions as F

from factloom.streaming import sessions

SCHEMA = "session string, at timestamp"


def test_ordinals_go_on_over_batches_and_a_restart(spark, tmp_path):
    src, out, check = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check"
    rows = [(f"s{k % 3}", 60 * k + 60) for k in range(30)]
    write = lambda part: spark.createDataFrame(part, "session string, s long").select("session", F.timestamp_seconds("s").alias("at")).coalesce(1).write.mode("append").parquet(src)
    read = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    write(rows[:8][::-1])
    write(rows[8:15])
    sessions.stream_log(read(), out, check).awaitTermination()
    assert spark.read.parquet(out).count() == 15
    write(rows[15:])  # a new query on the same checkpoint
    sessions.stream_log(read(), out, check).awaitTermination()
    sessions.stream_log(read(), out, check).awaitTermination()  # nothing new: nothing twice
    got = sorted((r.session, r.ordinal, int(r.s)) for r in spark.read.parquet(out).select("session", "ordinal", F.unix_seconds("at").alias("s")).collect())
    wanted = []
    for s in range(3):
        wanted += [(f"s{s}", n + 1, 60 * k + 60) for n, k in enumerate(k for k in range(30) if k % 3 == s)]
    assert got == sorted(wanted)


def test_a_session_ends_a_while_after_its_last_command(spark, tmp_path):
    day = 86_400
    src, out, check = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check"
    for part in ([("a", 5), ("a", 10)], [("b", 5 * day)], [("b", 6 * day)], [("a", 7 * day)]):
        spark.createDataFrame(part, "session string, s long").select("session", F.timestamp_seconds("s").alias("at")).coalesce(1).write.mode("append").parquet(src)
        sessions.stream_log(spark.readStream.schema(SCHEMA).parquet(src), out, check).awaitTermination()
    got = sorted((r.session, r.ordinal) for r in spark.read.parquet(out).collect())
    assert got == [("a", 1), ("a", 1), ("a", 2), ("b", 1), ("b", 2)]
