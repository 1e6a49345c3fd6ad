"""Error-log alerts: lines classified by phrase, counted, with first samples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dbgauge.functions.text import ascii_lower
from dbgauge.operators.joins import join_groups
from dbgauge.operators.ranking import top_per_group
from dbgauge.schemas import POSITION

# Alert categories and the lowercase phrases that put a line into them.
ALERT_RULES: dict[str, list[str]] = {
    "deadlock": ["deadlock"],
    "crash_recovery": [
        "crash recovery",
        "starting crash recovery",
        "recovery completed",
        "database system is starting up",
        "redo starts at",
        "redo done at",
    ],
    "purge": ["purge", "vacuum"],
    "replication": [
        "replication",
        "replica",
        "slave",
        "relay log",
        "group replication",
        "binlog",
        "wal sender",
        "wal receiver",
    ],
}

SAMPLES = 3


def line_categories(lower: Column, rules: Mapping[str, Sequence[str]] = ALERT_RULES) -> Column:
    """Array with one place per category: its name where a lowercased line falls into it, else NULL."""
    hits = [F.when(reduce(or_, [lower.contains(phrase) for phrase in phrases]), F.lit(name)) for name, phrases in rules.items()]
    return F.array(*hits)


#: From so many phrases on, lines are first tried against one pattern of all of them.
MANY_PHRASES = 24


def any_phrase(phrases: Sequence[str]) -> str:
    """A pattern that finds any of the phrases: beginnings that phrases share are tried once, and a place with no phrase costs one look at its character."""
    tree: dict = {}
    for phrase in phrases:
        node = tree
        for letter in phrase:
            if None in node:
                break
            node = node.setdefault(letter, {})
        else:
            node.clear()  # what is longer is found with it
            node[None] = True

    def pattern(node: dict) -> str:
        if None in node:
            return ""
        ways = [_literal(letter) + pattern(below) for letter, below in sorted(node.items())]
        return ways[0] if len(ways) == 1 else f"(?:{'|'.join(ways)})"

    if None in tree:
        return ""
    return f"(?s)(?=[{''.join(map(_literal, sorted(tree)))}]){pattern(tree)}"


def _literal(letter: str) -> str:
    return f"\\x{{{ord(letter):x}}}"


def classify(lines: DataFrame, rules: Mapping[str, Sequence[str]] = ALERT_RULES) -> DataFrame:
    """One row per line and category; lines without a category are gone.

    Few lines fall into one. With many phrases, one pattern of all of them sorts out the others; each phrase is then looked for in what is left.
    """
    lowered = lines.withColumn("_lower", ascii_lower(F.col("line")))
    phrases = [phrase for of_category in rules.values() for phrase in of_category]
    if len(phrases) >= MANY_PHRASES:
        lowered = lowered.filter(F.col("_lower").rlike(any_phrase(phrases)))
    labelled = lowered.select(*lines.columns, F.explode(line_categories(F.col("_lower"), rules)).alias("category"))
    return labelled.filter(F.col("category").isNotNull())


def alert_order() -> list[Column]:
    return [F.col("count").desc(), F.col("category").asc()]


def alert_samples(classified: DataFrame, by: Sequence[str], samples: int = SAMPLES) -> DataFrame:
    """The first ``samples`` lines per group and category, in position order."""
    keys = [*by, "category"]
    first = top_per_group(
        classified.select(*dict.fromkeys([*keys, *POSITION, "line"])),
        keys,
        [F.col(name) for name in POSITION],
        samples,
        spread_on=["source", "block"],
    )
    ordered = F.array_sort(F.collect_list(F.struct("rank", "line")))
    return first.groupBy(*keys).agg(F.transform(ordered, lambda item: item["line"]).alias("sample_lines"))


def alerts(
    lines: DataFrame,
    by: Sequence[str] = (),
    rules: Mapping[str, Sequence[str]] = ALERT_RULES,
    samples: int = SAMPLES,
) -> DataFrame:
    """Alert count and first lines per category, ordered by count and category.

    Counting and sampling are separate branches: the count is a plain partial aggregation, and the
    sample keeps at most ``samples`` rows per category and task before any shuffle. One aggregate for
    both would send every matching line to one task per category.
    """
    keys = [*by, "category"]
    classified = classify(lines, rules)
    counts = classified.groupBy(*keys).agg(F.count("*").alias("count"))
    return join_groups(counts, alert_samples(classified, by, samples), keys).select(*keys, "count", "sample_lines").orderBy(
        *by, *alert_order()
    )


def alert_parts(
    lines: DataFrame, by: Sequence[str] = (), rules: Mapping[str, Sequence[str]] = ALERT_RULES, samples: int = SAMPLES, position: Sequence[str] = POSITION
) -> DataFrame:
    """Counts and first lines to keep, per ``by`` and category; they merge. ``first`` holds at most ``samples`` lines with their positions."""
    keys = [*by, "category"]
    classified = classify(lines, rules)
    counts = classified.groupBy(*keys).agg(F.count("*").alias("count"))
    first = _first_lines(classified.select(*dict.fromkeys([*keys, *position, "line"])), keys, samples, position)
    return join_groups(counts, first, keys).select(*keys, "count", "first")


def _first_lines(lines: DataFrame, keys: Sequence[str], samples: int, position: Sequence[str]) -> DataFrame:
    top = top_per_group(lines, keys, [F.col(name) for name in position], samples, spread_on=position)
    return top.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*position, "line"))).alias("first"))


def merge_alert_parts(parts: DataFrame, by: Sequence[str] = (), samples: int = SAMPLES, position: Sequence[str] = POSITION) -> DataFrame:
    """The alerts of all lines that the parts were made of, in groups ``by`` (some of the parts' own columns)."""
    keys = [*by, "category"]
    counts = parts.groupBy(*keys).agg(F.sum("count").alias("count"))
    held = parts.select(*keys, F.explode("first").alias("one")).select(*keys, "one.*")
    first = _first_lines(held, keys, samples, position)
    return join_groups(counts, first, keys).select(*keys, "count", F.transform("first", lambda one: one["line"]).alias("sample_lines"))
