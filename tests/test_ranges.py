"""Byte ranges of files, and files that grow."""

import os
import random

import pytest
from pyspark.sql import functions as F

from dbgauge.operators.segments import appended_since, tail_lines
from dbgauge.sources import ranges
from dbgauge.sources.logs import read_log_lines
from dbgauge.sources.ranges import ByteRange, log_files, read_appended, read_ranges, read_tail
from dbgauge.streaming.growing import appended_between, read_growing_lines, same_file


def texts(seed=5):
    rng = random.Random(seed)
    pieces = [b"", b" \t", b"\xc2\xa0", b"short", "é日😀 wide".encode(), b"bad \xff\xfe bytes", b"cr\r", b"x" * 700, b"a\rb"]
    files = {f"f{k}__log": b"\n".join(rng.choices(pieces, k=rng.randrange(1, 60))) + rng.choice([b"", b"\n", b"\n\n"]) for k in range(12)}
    return {**files, "empty__log": b"", "blank__log": b"\n\n \n", "one__log": b"one line"}


def sorted_rows(frame, *names):
    return sorted(map(tuple, frame.select(*names).collect()))


@pytest.mark.parametrize("split", [1, 7, 100, 1 << 20])
def test_ranges_give_the_lines_of_a_scan(spark, write, split):
    path = write(**texts())
    whole = log_files(spark, path).withColumn("start", F.lit(0).cast("bigint"))
    assert sorted_rows(read_ranges(whole, split), "source", "line", "bytes", "file_size") == sorted_rows(
        read_log_lines(spark, path), "source", "line", "bytes", "file_size"
    )


def test_byte_range_with_small_reads(tmp_path, monkeypatch):
    rng = random.Random(8)
    for buffer in (1, 3, 50):
        monkeypatch.setattr(ranges, "BUFFER", buffer)
        monkeypatch.setattr(ranges, "_REST", buffer)
        for _ in range(60):
            data = b"".join(rng.choices([b"a", b"bc", b"\n", b"\n", b" "], k=rng.randrange(60)))
            (tmp_path / "f").write_bytes(data)
            lines, at = [], 0
            for line in data.split(b"\n"):
                lines.append((at, line))
                at += len(line) + 1
            if not lines[-1][1]:
                lines.pop()
            start, stop = sorted(rng.choices(range(len(data) + 2), k=2))
            got = list(ByteRange(str(tmp_path / "f"), start, stop, len(data), False).lines())
            assert got == [(p, line, len(line) + 1) for p, line in lines if start <= p < stop]
            count = rng.randrange(1, 5)
            last = ByteRange(str(tmp_path / "f"), start, len(data), len(data), False).last_lines(count)
            assert last == [(p, line) for p, line in lines[::-1] if start <= p and line.strip()][:count]
    with pytest.raises(OSError, match="was cut"):
        list(ByteRange(str(tmp_path / "f"), 0, 999, 999, True).lines())


@pytest.mark.parametrize("max_lines,max_bytes", [(3, None), (3, 40), (500, 1000), (1, 1), (2, 0)])
def test_tail_equals_scan(spark, write, max_lines, max_bytes):
    path = write(**texts(max_lines))
    got = sorted_rows(read_tail(spark, path, max_lines, max_bytes), "source", "back", "line")
    assert got == sorted_rows(tail_lines(read_log_lines(spark, path), max_lines, max_bytes), "source", "back", "line")


@pytest.mark.parametrize("split", [5, 1 << 20])
def test_appended_equals_scan(spark, write, split):
    path = write(**texts(9))
    listed = log_files(spark, path)
    n = F.regexp_extract("source", r"f(\d+)\.log", 1).try_cast("int")
    offset = F.when(n % 4 == 0, F.col("file_size") + 10).when(n % 4 == 1, F.floor(F.col("file_size") / 2)).when(n % 4 == 2, F.col("file_size"))
    known = listed.select("source", offset.alias("offset"))
    names = ["source", "offset", "line", "bytes"]
    got = sorted_rows(read_appended(spark, path, known, 300, split), *names)
    sizes = {r.source: r.file_size for r in listed.collect()}
    scan = sorted_rows(appended_since(read_log_lines(spark, path), known, 300), *names)
    # the scan counts a line break behind every line, so a checkpoint at the end of a file without one leaves it an empty rest
    assert got == [row for row in scan if row[1] < sizes[row[0]]] and got


def test_a_huge_file_is_not_read_to_give_its_end(spark, tmp_path):
    """Terabytes of hole before the last lines: the bytes read are counted."""
    path = tmp_path / "in" / "huge.log"
    path.parent.mkdir()
    size = 1 << 42
    with open(path, "wb") as file:
        file.truncate(size)
        file.seek(size)
        file.write(b"\n" + b"".join(b"line %d\n" % k for k in range(1000)))
    assert os.stat(path).st_blocks * 512 < 1 << 20
    counted = spark.sparkContext.accumulator(0)
    tail = read_tail(spark, str(path.parent), 3, 5000, counted).collect()
    assert [(r.back, r.line) for r in tail] == [(1, "line 999"), (2, "line 998"), (3, "line 997")] and counted.value <= 5001
    counted = spark.sparkContext.accumulator(0)
    assert read_tail(spark, str(path.parent), 3, counted=counted).count() == 3 and counted.value <= ranges.BUFFER
    known = log_files(spark, str(path.parent)).select("source", F.lit(size + 1).alias("offset"))
    counted = spark.sparkContext.accumulator(0)
    got = read_appended(spark, str(path.parent), known, 1 << 20, 4096, counted)
    assert got.count() == 1000 and counted.value <= 3 * 10_000
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "content" not in got._jdf.queryExecution().executedPlan().toString().split("Scan binaryFile")[1].split("ReadSchema")[1].split("\n")[0], plan


def test_what_was_appended():
    entry = lambda end, *heads: {"end": end, "heads": list(heads)}
    assert appended_between({}, {"a": entry(9)}) == [("a", 0, 9)]
    assert appended_between({"a": entry(9)}, {"a": entry(9)}) == []
    assert appended_between({"a": entry(70, 1)}, {"a": entry(300, 1, 2, 3)}) == [("a", 70, 300)]
    assert appended_between({"a": entry(300, 1, 2)}, {"a": entry(200, 1, 2)}) == [("a", 0, 200)]
    assert appended_between({"a": entry(300, 1, 2)}, {"a": entry(400, 1, 9)}) == [("a", 0, 400)]
    assert appended_between({"a": entry(300, 1, 2)}, {"a": entry(80, 5), "a.1": entry(350, 1, 2)}) == [("a", 0, 80), ("a.1", 300, 350)]
    assert appended_between({"a": entry(300, 1, 2)}, {"b": entry(300, 1, 2)}) == []
    assert not same_file(entry(5, 1), entry(4, 1))


def test_growing_files_give_each_line_once(spark, tmp_path):
    folder, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    folder.mkdir()
    want = []

    def go(expect, **options):
        stream = read_growing_lines(spark, str(folder), split_bytes=50, **options)
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start()
        query.awaitTermination()
        want.extend(expect)
        got = spark.read.parquet(out)
        assert sorted(r.line for r in got.collect()) == sorted(want)
        return got

    def append(name, text):
        with open(folder / name, "a") as file:
            file.write(text)

    first = [f"a line {k} {'é' * (k % 40)}" for k in range(60)]
    append("a.log", "\n".join(first) + "\ncut in the mid")
    append("b.log", "only\r\n")
    go([*first, "only"])
    go([])
    append("a.log", "dle\nnext\n")
    append("c.log", "new file\n")
    got = go(["cut in the middle", "next", "new file"])
    assert got.where("source like '%a.log'").orderBy("mid").collect()[-1].line == "next"
    os.rename(folder / "a.log", folder / "a.log.1")
    append("a.log.1", "written behind the rename\n")
    append("a.log", "rotated\n")
    go(["written behind the rename", "rotated"])
    (folder / "b.log").write_text("b\n")
    append("c.log", "no line break")
    go(["b"])
    go(["no line break"], idle_secs=0)
    append("c.log", " and on\n")
    go([" and on"], idle_secs=0)
    assert got.columns == ["source", "block", "mid", "line", "bytes", "file_size"]
