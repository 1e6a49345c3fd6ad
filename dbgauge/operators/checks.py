"""Gates over landed records: summaries, golden comparison, budgets, assertions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dbgauge.session import scratch_path


def _flag(value: Column) -> Column:
    return F.coalesce(value, F.lit(False))


def summarize_records(records: DataFrame) -> DataFrame:
    """Identity fields, sorted source status and level 1 facts of typed records with ``file``."""
    level1 = F.col("payload.level1")
    capability = level1["capability"]
    none = F.array().cast("array<string>")
    categories = F.filter(F.transform(level1["error_log"]["alerts"], lambda alert: alert["category"]), lambda c: c.isNotNull())
    statuses = F.array_sort(F.transform("source_status", lambda s: F.struct(s["source"].alias("source"), s["ok"].alias("ok"))))
    return records.select(
        "file",
        "contract_version",
        "engine",
        "requested_level",
        "selected_level",
        "status",
        F.coalesce(statuses, F.array().cast("array<struct<source:string,ok:boolean>>")).alias("source_status"),
        F.struct(
            level1.isNotNull().alias("enabled"),
            _flag(capability["can_enable_slow_log_hot_switch"]).alias("hot_switch_ok"),
            _flag(capability["can_read_slow_log"]).alias("slow_log_ok"),
            _flag(capability["can_read_error_log"]).alias("error_log_ok"),
            _flag(level1["slow_log"]["digest_count"] >= 1).alias("digest_count_ge_1"),
            F.coalesce(F.array_sort(F.array_distinct(categories)), none).alias("alert_categories"),
        ).alias("level1"),
    )


def diff_summaries(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows only in ``expected`` (``missing``) or only in ``actual`` (``unexpected``); empty means equal.

    Each side is counted per distinct row, so a row that is there twice and expected once shows up once.
    """
    columns = expected.columns
    sides = expected.withColumn("_n", F.lit(-1)).unionByName(actual.select(*columns).withColumn("_n", F.lit(1)))
    net = sides.groupBy(*columns).agg(F.sum("_n").alias("_n")).filter(F.col("_n") != 0)
    kind = F.when(F.col("_n") < 0, "missing").otherwise("unexpected").alias("difference")
    return net.select(kind, *columns, F.explode(F.array_repeat(F.lit(0), F.abs("_n").cast("int"))).alias("_copy")).drop("_copy")


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Append ``position``: the zero-based place of each row in the order of the given columns.

    Tasks sort ranges of the order, and what they number is written once. A position is that in the range and the rows of all ranges
    before, which are one number a task. Equal values of the order come in any order, so name columns that tell rows apart.
    """
    path = scratch_path(rows.sparkSession, "numbered")
    rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    written = rows.sparkSession.read.parquet(path)
    # the task and its row number are the upper and lower bits of the id
    task = F.shiftright("_at", 33)
    sizes = written.groupBy(task.alias("_task")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_task", F.coalesce(before, F.lit(0)).alias("_before"))
    placed = written.withColumn("_task", task).join(offsets, "_task")
    return placed.withColumn("position", F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_task", "_at", "_before")


def diff_in_order(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Positions at which two lists differ: the row expected there (``missing``) and the one found (``unexpected``).

    Both sides have a ``position``; empty means that they are equal, row by row and in length. Unlike ``diff_summaries``,
    equal rows in another order differ.
    """
    columns = [name for name in expected.columns if name != "position"]
    sides = [frame.select("position", F.struct(*columns).alias(name)) for frame, name in ((actual, "_found"), (expected, "_wanted"))]
    unlike = sides[0].join(sides[1], "position", "full").where(~F.col("_found").eqNullSafe(F.col("_wanted")))
    both = F.array(F.struct(F.lit("missing").alias("difference"), F.col("_wanted").alias("row")), F.struct(F.lit("unexpected").alias("difference"), F.col("_found").alias("row")))
    each = unlike.select("position", F.explode(both).alias("_each")).where("_each.row is not null")
    return each.select("position", "_each.difference", "_each.row.*")


@dataclass(frozen=True)
class Budgets:
    """Limits of one record file."""

    level0_max_ms: int = 5_000
    level1_max_ms: int = 15_000
    max_bytes: int = 8_000_000
    level1_suffix: str = "_level1.json"


def check_budgets(records: DataFrame, limits: Budgets = Budgets()) -> DataFrame:
    """One row per file of typed records: passed, and the first broken limit in ``failure``."""
    duration = F.coalesce("window.duration_ms", F.lit(0).cast("bigint"))
    allowed = F.when(F.col("file").endswith(limits.level1_suffix), limits.level1_max_ms).otherwise(limits.level0_max_ms)
    status = F.coalesce("status", F.lit("null"))
    size = F.col("file_size")
    failure = (
        F.when(status != "ok", F.concat(F.lit("status="), status))
        .when(duration > allowed, F.concat_ws("", F.lit("duration_ms="), duration, F.lit(" > "), allowed))
        .when(size > limits.max_bytes, F.concat_ws("", F.lit("bytes="), size, F.lit(f" > {limits.max_bytes}")))
    )
    return records.select(
        "file",
        duration.alias("duration_ms"),
        size.alias("bytes"),
        failure.isNull().alias("passed"),
        failure.alias("failure"),
    )


def first_failure(checked: DataFrame) -> DataFrame:
    """The failed file that comes first by name; no row where all passed."""
    return checked.filter(~F.col("passed")).orderBy("file").limit(1)


@dataclass(frozen=True)
class Rule:
    """A predicate (Spark SQL over typed records) for files whose name matches ``files`` (a regex)."""

    files: str
    predicate: str
    message: str


def _capability(report: str, *flags: tuple[str, str]) -> list[tuple[str, str]]:
    return [(f"payload.{report}.capability.{flag}", message) for flag, message in flags]


def _rules(files: str, label: str, checks: Sequence[tuple[str, str]]) -> list[Rule]:
    return [Rule(files, predicate, f"{label} {message}") for predicate, message in checks]


_LEVEL0 = [("status = 'ok'", "record status"), ("selected_level = 'Level 0'", "selected level 0")]
_LEVEL1 = [
    ("status = 'ok'", "record status"),
    ("selected_level = 'Level 1'", "selected level 1"),
    ("payload.level1 IS NOT NULL", "level1 payload present"),
    *_capability(
        "level1",
        ("can_enable_slow_log_hot_switch", "hot-switch capability"),
        ("can_read_slow_log", "slow log readable"),
        ("can_read_error_log", "error log readable"),
    ),
    ("payload.level1.slow_log.digest_count >= 1", "slow log digest generated"),
    ("array_contains(transform(payload.level1.error_log.alerts, a -> a.category), 'deadlock')", "deadlock alert detected"),
]


def _says(text: str) -> str:
    return f"contains(array_join(payload.downgrade_reasons, ' '), '{text}')"


# What the records of a healthy fleet must satisfy.
MATRIX_RULES = [
    *_rules(
        r"^mysql_.*_level0\.json$",
        "mysql level0",
        [
            *_LEVEL0,
            *_capability(
                "level0",
                ("mysql_status_access", "status access"),
                ("mysql_variables_access", "variables access"),
                ("information_schema_access", "information_schema access"),
            ),
        ],
    ),
    *_rules(r"^mysql_.*_level1\.json$", "mysql level1", _LEVEL1),
    *_rules(
        r"^postgres_.*_level0\.json$",
        "postgres level0",
        [
            *_LEVEL0,
            *_capability(
                "postgres_level0",
                ("has_status_access", "status access"),
                ("has_settings_access", "settings access"),
                ("has_storage_access", "storage access"),
            ),
        ],
    ),
    *_rules(r"^postgres_.*_level1\.json$", "postgres level1", _LEVEL1),
]
# What records of timed-out and downgraded collections must satisfy.
RESILIENCE_RULES = [
    *_rules(
        r"^mysql_timeout_retry\.json$",
        "mysql timeout",
        [
            ("status = 'failed'", "status failed"),
            ("size(attempts) = 3", "retried 3 attempts"),
            ("forall(attempts, a -> a.status = 'failed')", "all attempts failed"),
            ("contains(error, 'timed out')", "error surfaced"),
        ],
    ),
    *_rules(
        r"^mysql_level1_downgrade\.json$",
        "mysql downgrade",
        [
            ("status = 'ok'", "record status"),
            ("selected_level = 'Level 0'", "downgraded to level 0"),
            (_says("cannot hot-enable slow log"), "reason hot switch"),
            (_says("cannot collect slow log for digest aggregation"), "reason slow log"),
            (_says("cannot collect error log"), "reason error log"),
        ],
    ),
    *_rules(
        r"^postgres_level1_downgrade\.json$",
        "postgres downgrade",
        [
            ("status = 'ok'", "record status"),
            ("selected_level = 'Level 0'", "downgraded to level 0"),
            (_says("cannot hot-enable log_min_duration_statement"), "reason hot switch"),
            (_says("cannot collect statement log for digest aggregation"), "reason statement log"),
            (_says("cannot collect PostgreSQL log alerts"), "reason error log"),
        ],
    ),
]


def assert_records(records: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``file, message, passed`` for every rule that applies to a file; NULL counts as not passed."""
    checks = [
        F.when(
            F.col("file").rlike(rule.files),
            F.struct(F.lit(rule.message).alias("message"), _flag(F.expr(rule.predicate)).alias("passed")),
        )
        for rule in rules
    ]
    return records.select("file", F.inline(F.array_compact(F.array(*checks))))

