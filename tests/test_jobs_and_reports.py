"""Jobs of a stream against the table's, after late and repeated rows; reports and the error of their sketches."""

import datetime

import pytest
from pyspark.sql import functions as F

from folioflux.operators import validation as val
from folioflux.streaming import jobs


def test_stream_of_jobs_equals_the_table(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where("user_id < 12").withColumn("ts", F.col("ts").cast("timestamp")).select("event_id", "user_id", "ts", "event_type")
    rows = sorted(events.collect(), key=lambda r: r.ts)
    assert len(rows) > 50
    late = [rows[i] for i in range(len(rows))]
    for i in range(0, len(rows) - 3, 7):  # out of order by less than the delay, if the events are that close
        if late[i + 1].ts - late[i].ts < datetime.timedelta(hours=2):
            late[i], late[i + 1] = late[i + 1], late[i]
    late = [x for i, r in enumerate(late) for x in ([r, r] if i % 5 == 0 else [r])]  # and repeated
    end = (10**9, 10**6, rows[-1].ts + datetime.timedelta(days=9), "view")
    source = tmp_path / "in"
    source.mkdir()
    parts = [late[i : i + 30] for i in range(0, len(late), 30)] + [[end]]
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    run = jobs.job_states(stream, timeout=240, delay="6 hours").writeStream.format("memory").queryName("jobs").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        for k, part in enumerate(parts):
            one = str(tmp_path / f"part{k}")
            spark.createDataFrame(part, events.schema).coalesce(1).write.parquet(one)
            file = next(p for p in (tmp_path / f"part{k}").iterdir() if p.name.endswith(".parquet"))
            file.rename(source / f"{k:04}.parquet")
            run.processAllAvailable()
        run.processAllAvailable()
    finally:
        run.stop()
    got = sorted(map(tuple, spark.sql("SELECT * FROM jobs WHERE user_id < 1000").collect()))
    want = sorted(map(tuple, jobs.job_states(events, timeout=240).collect()))
    assert got == want and {r[-1] for r in got} == {"succeeded", "failed"} and max(r[3] for r in got) > 1


def test_jobs_of_odd_rows(spark):
    at = lambda m: datetime.datetime(2024, 1, 1, 10, m)
    rows = [(1, 1, at(0), "view"), (2, 1, at(29), "purchase"), (2, 1, at(29), "purchase"), (3, 1, at(59), "click"), (4, None, at(0), "view"), (5, 1, None, "view"), (None, 1, at(1), "view"), (6, 2, at(0), None)]
    table = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, event_type string")
    got = sorted((r.user_id, r.n_stages, r.last_stage, r.longest_seconds, r.status) for r in jobs.job_states(table).collect())
    assert got == [(1, 1, "click", 0.0, "failed"), (1, 2, "purchase", 1740.0, "succeeded"), (2, 1, None, 0.0, "failed")]
    assert jobs.job_states(table.limit(0)).collect() == []


def test_report(spark):
    df = spark.createDataFrame([(1, 5.0), (2, -1.0), (None, None)], "k long, v double")
    checks = [val.violations("negative", "none", F.col("v") < 0), val.violations("key", "none", F.col("k").isNull()), val.between("mean", "2", F.avg("v"), 2, 2), val.violations("large", "none", F.col("v") > 100)]
    assert [(r.place, r.check, r.value, r.result) for r in val.report(df, checks).orderBy("place").collect()] == [(1, "negative", 1.0, "REVIEW"), (2, "key", 1.0, "REVIEW"), (3, "mean", 2.0, "PASS"), (4, "large", 0.0, "PASS")]
    assert [r.result for r in val.report(df.limit(0), checks).orderBy("place").collect()] == ["PASS", "PASS", "REVIEW", "PASS"]


@pytest.mark.parametrize("repeats", [1, 4])
def test_sketches_keep_their_error(spark, repeats):
    n = 40_000
    df = spark.range(n, numPartitions=16).select((F.col("id") % (n // repeats)).alias("k"), (F.col("id") * 7919 % n).cast("double").alias("v"))
    checks = [val.distinct_about("distinct", F.col("k")), val.quantile_between("median", F.col("v"), 0.5, 0.49 * n, 0.51 * n)]
    got = {r.check: r for r in val.report(df, checks).collect()}
    assert abs(got["distinct"].value * repeats - 1) < 0.03 and got["distinct"].result == ("PASS" if repeats == 1 else "REVIEW")
    assert abs(got["median"].value - n / 2) <= n / 500 and got["median"].result == "PASS"


def test_portfolio_of_odd_rows(spark):
    from folioflux.operators import portfolio as pf

    at = datetime.datetime(2024, 5, 1, 9)
    docs = spark.createDataFrame([(1, "completed", "Invoice", at, 3, 2.5, "a"), (2, None, None, at, None, None, "a"), (3, "failed", "", None, 1, 0.0, None), (4, "odd", "Lease", datetime.datetime(2023, 1, 1), 1, 1.0, "b")], "id int, status string, type string, uploaded_at timestamp, pages int, seconds double, checksum string")
    families = spark.createDataFrame([(1, "unknown", "x"), (2, "lease", ""), (4, "contract", "Contracts"), (4, "contract", "Contracts"), (None, "z", "z")], "id int, family string, label string")
    got = {(r.section, r.name): (r.n, r.total) for r in pf.bundle(docs, families, "2024-05-01").collect()}
    assert got == {
        ("mix", "Invoice"): (1, 0.0), ("mix", "lease"): (1, 0.0), ("mix", "Unclassified"): (1, 0.0), ("mix", "Contracts"): (1, 0.0), ("status", "processed"): (1, 0.0), ("status", "failed"): (1, 0.0), ("status", "not_processed"): (1, 0.0), ("status", "processing"): (1, 0.0),
        ("month", "2024-05"): (2, 0.0), ("month", "2023-01"): (1, 0.0), ("today", "uploads"): (2, 3.0), ("processing", "durations"): (2, 3.5), ("duplicates", "checksums"): (1, 2.0),
    }
    assert {(r.section, r.n) for r in pf.bundle(docs.limit(0), families, "2024-05-01").collect()} == {("status", 0), ("today", 0), ("processing", 0), ("duplicates", 0)}
