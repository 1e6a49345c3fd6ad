"""Host counters from landed /proc text, and normalized command samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dbgauge.functions.numbers import parse_double, parse_unsigned, unsigned_or_zero
from dbgauge.functions.text import WS, clip_output, null_if_empty, strip_ws

# The files read, the counters of the cpu line, and the memory keys.
CPU_PATH = "/proc/stat"
MEM_PATH = "/proc/meminfo"
LOAD_PATH = "/proc/loadavg"
CPU_NEEDED = ["user", "nice", "system", "idle"]
CPU_OPTIONAL = ["iowait", "irq", "softirq", "steal"]
MEM_NEEDED = {"mem_total_kb": "MemTotal", "mem_available_kb": "MemAvailable"}
MEM_OPTIONAL = {"swap_total_kb": "SwapTotal", "swap_free_kb": "SwapFree"}

_MEM_LINE = rf"\A[^:]*+:{WS}*+\+?(\d+)(?:{WS}|\z)"


def _tokens(text: Column) -> Column:
    return F.split(strip_ws(text), rf"{WS}+")


def _all_present(columns: Sequence[Column]) -> Column:
    present = columns[0].isNotNull()
    for column in columns[1:]:
        present = present & column.isNotNull()
    return present


def cpu_stat(words: Column) -> Column:
    """Counters of the first line's words if the first is ``cpu``; the first four must be numbers."""
    needed = [parse_unsigned(F.get(words, F.lit(i))) for i in range(1, 5)]
    optional = [unsigned_or_zero(F.get(words, F.lit(i))) for i in range(5, 9)]
    named = [c.alias(n) for c, n in zip([*needed, *optional], [*CPU_NEEDED, *CPU_OPTIONAL])]
    return F.when((F.get(words, F.lit(0)) == "cpu") & _all_present(needed), F.struct(*named))


def memory_values(content: Column) -> Column:
    """Array of ``key, kb`` of all ``key: number`` lines."""
    lines = F.split(content, "\n")
    number = F.transform(
        F.filter(lines, lambda line: line.rlike(_MEM_LINE)),
        lambda line: F.struct(
            strip_ws(F.substring_index(line, ":", 1)).alias("key"),
            F.regexp_extract(line, _MEM_LINE, 1).try_cast("bigint").alias("kb"),
        ),
    )
    return F.filter(number, lambda entry: entry["kb"].isNotNull())


def _mem_value(values: Column, key: str) -> Column:
    """Number behind the last line with this key."""
    return F.try_element_at(F.filter(values, lambda entry: entry["key"] == key), F.lit(-1))["kb"]


def mem_info(values: Column) -> Column:
    """Memory totals; total and available memory must be present, swap defaults to 0."""
    needed = [_mem_value(values, key) for key in MEM_NEEDED.values()]
    optional = [F.coalesce(_mem_value(values, key), F.lit(0).cast("bigint")) for key in MEM_OPTIONAL.values()]
    named = [c.alias(n) for c, n in zip([*needed, *optional], [*MEM_NEEDED, *MEM_OPTIONAL])]
    return F.when(_all_present(needed), F.struct(*named))


def load_average(words: Column) -> Column:
    """The five words of the load line; NULL if one is missing or not a number where one is due."""
    loads = [parse_double(F.get(words, F.lit(i))) for i in range(3)]
    pid = parse_unsigned(F.get(words, F.lit(4)))
    named = [c.alias(n) for c, n in zip(loads, ["one", "five", "fifteen"])]
    return F.when(
        _all_present([*loads, pid]),
        F.struct(*named, F.get(words, F.lit(3)).alias("running_tasks"), pid.alias("last_pid")),
    )


def parse_os_samples(samples: DataFrame, by: Sequence[str] = ("instance", "ts")) -> DataFrame:
    """``samples(<by>, path, content)`` to one row per sample time with three nullable structs."""
    path = F.col("path")
    content = F.col("content")
    split = samples.filter(path.isin(CPU_PATH, MEM_PATH, LOAD_PATH)).select(
        *by,
        "path",
        F.when(path == CPU_PATH, _tokens(F.substring_index(content, "\n", 1))).when(path == LOAD_PATH, _tokens(content)).alias("_words"),
        F.when(path == MEM_PATH, memory_values(content)).alias("_memory"),
    )
    words = F.col("_words")
    parsed = split.select(
        *by,
        F.when(path == CPU_PATH, cpu_stat(words)).alias("proc_cpu"),
        F.when(path == MEM_PATH, mem_info(F.col("_memory"))).alias("proc_mem"),
        F.when(path == LOAD_PATH, load_average(words)).alias("load_average"),
    )
    return parsed.groupBy(*by).agg(*[F.max(name).alias(name) for name in ("proc_cpu", "proc_mem", "load_average")])


# Error texts of command samples (the doubled words are the known output).
NOT_FOUND = "command not found"
EXIT_STATUS = "exit status: exit status: "
FAILED = " failed: "


def command_samples(raw: DataFrame) -> DataFrame:
    """Normalize command results.

    ``raw(..., command, args, found, status_code, stdout, stderr)``: ``found`` false means the command
    is not installed. A command that could not run for another reason has a NULL ``status_code`` and its
    error in ``stderr``; a signal leaves ``status_code`` NULL as well and ends the output the same way.
    """
    kept = [name for name in raw.columns if name not in {"found", "status_code", "stdout", "stderr"}]
    found = F.coalesce("found", F.lit(False))
    complaint = null_if_empty(strip_ws(F.coalesce("stderr", F.lit(""))))
    code = F.col("status_code")
    failure = F.coalesce(complaint, F.concat(F.lit(EXIT_STATUS), F.coalesce(code.cast("string"), F.lit("unknown"))))
    error = F.when(~found, F.lit(NOT_FOUND)).when(code.isNull() | (code != 0), failure)
    return raw.select(
        *kept,
        found.alias("available"),
        F.when(found, code).alias("status_code"),
        F.when(found, clip_output(F.col("stdout"))).alias("output"),
        error.alias("error"),
    ).withColumn(
        "warning",
        F.when(F.col("available") & F.col("error").isNotNull(), F.concat(F.col("command"), F.lit(FAILED), F.col("error"))),
    )
