"""Parts that merge, windows by increments, and pairs across chunks."""

import random

from pyspark.sql import functions as F
from test_logs import PG_PIECES, pg_model

from dbgauge.operators.alerts import alert_parts, alerts, merge_alert_parts
from dbgauge.operators.digest import digest, digest_parts, merge_digest_parts
from dbgauge.operators.slowlog import chunk_order, log_series, pair_across_chunks
from dbgauge.schemas import ENTRIES, LINES
from dbgauge.streaming import ingest_pg_series, late_rows, read_growing_lines, read_increments, untimed_rows, write_increments


def entries_of(spark, seed=1):
    rng = random.Random(seed)
    seconds = [0.1, 0.2, 1.5, 3e-9, 1e30, float("inf"), float("nan"), -1.0]
    rows = [
        (f"f{k % 3}", k % 5, k, None, f"SELECT {rng.choice('abc')} FROM t WHERE x = {k}", rng.choice(seconds), 0.001, k, 1, rng.choice(["d1", "d2", None])) for k in range(400)
    ]
    return spark.createDataFrame(rows, f"{ENTRIES}, day string").repartition(5)


def text_rows(frame):
    return sorted(str(tuple(r)) for r in frame.collect())


def test_digest_parts_merge_to_the_digest(spark):
    entries = entries_of(spark)
    parts = digest_parts(entries, ["day"])
    assert text_rows(merge_digest_parts(parts)) == text_rows(digest(entries))
    assert text_rows(merge_digest_parts(parts, ["day"])) == text_rows(digest(entries, ["day"]))
    assert text_rows(merge_digest_parts(parts.filter("day = 'd1'"))) == text_rows(digest(entries.filter("day = 'd1'")))
    assert merge_digest_parts(parts.limit(0)).count() == 0


def test_alert_parts_merge_to_the_alerts(spark):
    rng = random.Random(4)
    rows = [(f"s{k % 3}", k % 7, k, rng.choice(["Deadlock x", "purge y", "replica purge", "fine"]) + f" {k}", 9, k % 4) for k in range(500)]
    lines = spark.createDataFrame(rows, f"{LINES}, hour int")
    parts = alert_parts(lines, ["hour"])
    assert text_rows(merge_alert_parts(parts)) == text_rows(alerts(lines))
    assert text_rows(merge_alert_parts(parts, ["hour"])) == text_rows(alerts(lines, ["hour"]))


def test_windows_by_increments(spark, tmp_path):
    """Three batches: what is behind the watermark is counted as late, the rest equals the batch result."""
    folder, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    schema = "ts timestamp, source string, block bigint, mid bigint, line string"
    rng = random.Random(2)

    def row(k, hour, minute):
        stamp = None if k % 11 == 0 else f"2026-01-01 {hour:02d}:{minute:02d}:00"
        return stamp, "s", 0, k, rng.choice(["deadlock", "purge", "vacuum replica"]) + f" {k}"

    batches = [[row(k, rng.randrange(0, 6), rng.randrange(60)) for k in range(100)], [row(k, rng.randrange(3, 9), rng.randrange(60)) for k in range(100, 200)], [row(300, 23, 0), row(301, 23, 1)]]
    latest, on_time, late = None, [], {}
    for batch in batches:
        made = spark.createDataFrame(batch, "t string, source string, block bigint, mid bigint, line string").select(F.col("t").cast("timestamp").alias("ts"), "source", "block", "mid", "line")
        made.coalesce(1).write.mode("append").parquet(str(folder))
        stream = spark.readStream.schema(schema).parquet(str(folder))
        write_increments(stream, out, mark, alert_parts, "1 hour", "0 00:30:00").awaitTermination()
        for stamp, *rest in batch:
            if stamp is None:
                continue
            hour = int(stamp[11:13])
            if latest is not None and (hour + 1) * 60 <= latest - 30:
                late[hour] = late.get(hour, 0) + 1
            else:
                on_time.append((stamp, *rest))
        latest = max([latest or 0, *[int(s[11:13]) * 60 + int(s[14:16]) for s, *_ in batch if s]])
    frame = spark.createDataFrame(on_time, "t string, source string, block bigint, mid bigint, line string").withColumn("hour", F.hour(F.col("t").cast("timestamp")))
    want = text_rows(alerts(frame.filter("hour < 23"), ["hour"]))
    got = read_increments(spark, out, merge_alert_parts)
    assert text_rows(got.select(F.hour("window_start").alias("hour"), "category", "count", "sample_lines")) == want
    assert read_increments(spark, out, merge_alert_parts, closed=False).count() > got.count()
    assert {r.window_start.hour: r.late_rows for r in late_rows(spark, out).collect()} == late and late
    assert tuple(untimed_rows(spark, out).first()) == (202, sum(r[0] is None for b in batches for r in b))


def test_log_series_and_order(spark):
    names = ["/l/pg.log", "/l/pg.log.1", "/l/pg.log.12", "/l/pg-2026-01-01.log", "/l/pg-2026-01-02.log", "/2025/x.log"]
    frame = spark.createDataFrame([(n,) for n in names], "source string")
    assert [r[0] for r in frame.select(log_series(F.col("source"))).collect()] == ["/l/pg.log"] * 5 + ["/2025/x.log"]
    assert [r[0] for r in frame.filter("source like '/l/pg.log%'").orderBy(chunk_order(F.col("source"))).collect()] == ["/l/pg.log.12", "/l/pg.log.1", "/l/pg.log"]


def test_pairs_across_chunks_random(spark):
    """Random lines cut into chunks and calls give what one file gives."""
    rng = random.Random(9)
    for rounds in range(3):
        lines = [rng.choice(PG_PIECES) for _ in range(400)]
        cuts = sorted(rng.sample(range(401), 12))
        chunks = [lines[a:b] for a, b in zip([0, *cuts], [*cuts, 400])]
        carried, found = spark.createDataFrame([("other.log", 5.0)], "series string, secs double"), []
        for at in range(0, len(chunks), 4):
            rows = [(f"pg-{k:03d}.log", i // 7 * 7, i, text, 1) for k in range(at, min(at + 4, len(chunks))) for i, text in enumerate(chunks[k])]
            entries, carried = pair_across_chunks(spark.createDataFrame(rows, LINES), carried)
            found += [(r.sql, r.query_time_secs) for r in entries.collect()]
            carried = spark.createDataFrame(carried.collect(), "series string, secs double")
        assert sorted(found) == sorted(pg_model(lines))
        assert ("other.log", 5.0) in [tuple(r) for r in carried.collect()]


def test_pair_over_a_growing_and_rotated_log(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    log = folder / "pg.log"

    def go(pending_secs=3600):
        lines = read_growing_lines(spark, str(folder))
        ingest_pg_series(spark, lines, str(tmp_path / "out"), str(tmp_path / "mark"), str(tmp_path / "pending"), pending_secs=pending_secs).awaitTermination()
        return sorted((r.sql, r.query_time_secs) for r in spark.read.schema("sql string, query_time_secs double").parquet(str(tmp_path / "out")).collect())

    log.write_text("2026-01-01 00:00:00 UTC LOG:  duration: 5 ms\n")
    assert go() == []
    with open(log, "a") as file:
        file.write("STATEMENT:  SELECT 1\nduration: 7 ms\n")
    assert go() == [("SELECT 1", 0.005)]
    log.rename(folder / "pg.log.1")
    log.write_text("STATEMENT:  SELECT 2\nduration: 9 ms\n")
    want = [("SELECT 1", 0.005), ("SELECT 2", 0.007)]
    assert go() == want
    with open(log, "a") as file:
        file.write("STATEMENT:  SELECT 3\n")
    assert go(pending_secs=-1) == want
