"""Writers of tables and records."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from armspan.functions.identity import ARMS
from armspan.functions.rounding import fixed_text
from armspan.operators.comparison import win_tally
from armspan.session import kept

# Columns of the comparison file after benchmark and metric.
_SIDES = ("mean", "std")

# Records state UTC times with all their digits; the default would keep milliseconds.
_JSON_TIME = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timeZone": "UTC"}


def write_features(features: DataFrame, path: str) -> None:
    features.write.parquet(path)


def write_split(train: DataFrame, test: DataFrame, folder: str) -> None:
    """Both splits under the names that ``read_split`` expects."""
    write_features(train, f"{folder}/train.parquet")
    write_features(test, f"{folder}/test.parquet")


def as_json(rows: DataFrame, column: str = "value") -> DataFrame:
    return rows.select(F.to_json(F.struct("*"), _JSON_TIME).alias(column))


def _only_row(record: DataFrame) -> DataFrame:
    """Fails where ``record`` has several rows or none; at most two are looked at."""
    texts = as_json(record).limit(2).agg(F.collect_list("value").alias("texts"))
    problem = F.raise_error(F.lit("a document is one row")).cast("string")
    return texts.select(F.when(F.size("texts") == 1, F.get("texts", F.lit(0))).otherwise(problem).alias("value"))


def write_document(record: DataFrame, path: str) -> None:
    """A result of one row as JSON text, replacing an earlier one; fails with any other number of rows."""
    _only_row(record).write.mode("overwrite").text(path)


def write_new_document(record: DataFrame, path: str) -> None:
    """A result of one row as JSON text; fails if the path exists, or with any other number of rows."""
    _only_row(record).write.mode("errorifexists").text(path)


def write_run_records(records: DataFrame, path: str, arm: str = "provider") -> None:
    """Records as JSON lines, one folder per arm; the arm also stays inside each record."""
    records.withColumn("arm", F.col(arm)).write.options(**_JSON_TIME).partitionBy("arm").json(path)


def write_aggregates(aggregates: DataFrame, path: str) -> None:
    """Aggregated metrics, one JSON object per row."""
    aggregates.write.options(**_JSON_TIME).json(path)


def comparison_columns(rows: DataFrame, base: str = ARMS[0], candidate: str = ARMS[1]) -> DataFrame:
    """The eight columns of a comparison file, named after both arms."""
    named = [
        F.col(f"{side}_{figure}").alias(f"{arm}_{figure}")
        for side, arm in (("base", base), ("cand", candidate))
        for figure in _SIDES
    ]
    return rows.select("benchmark", "metric", *named, "difference_pct", "winner")


def write_comparison_csv(rows: DataFrame, path: str, base: str = ARMS[0], candidate: str = ARMS[1]) -> str | None:
    """Comparison rows as CSV with a header, sorted; without rows nothing is written.

    Adaptive execution makes one file of a small table.
    """
    with kept(rows):
        if rows.isEmpty():
            return None
        table = comparison_columns(rows, base, candidate)
        table.orderBy("benchmark", "metric").write.option("header", True).csv(path)
    return path


def report_lines(rows: DataFrame) -> DataFrame:
    """Each comparison row as a markdown table line."""
    is_cost = F.col("metric").contains("Cost")

    def side(name: str) -> Column:
        mean, std = F.col(f"{name}_mean"), F.col(f"{name}_std")
        money = F.concat(F.lit("$"), fixed_text(mean, 4), F.lit(" ± $"), fixed_text(std, 4))
        time = F.concat(fixed_text(mean, 2), F.lit(" ± "), fixed_text(std, 2), F.lit("s"))
        return F.when(is_cost, money).otherwise(time)

    difference = F.concat(fixed_text(F.col("difference_pct"), 1, signed=True), F.lit("%"))
    emphasised = F.concat(F.lit("**"), F.col("winner"), F.lit("**"))
    cells = F.concat_ws(" | ", "benchmark", "metric", side("base"), side("cand"), difference, emphasised)
    return rows.select("benchmark", "metric", F.concat(F.lit("| "), cells, F.lit(" |")).alias("line"))


# Columns that put the lines of a report in order.
REPORT_ORDER = ("section", "position", "benchmark", "metric")


def report_table(
    rows: DataFrame,
    base: str = ARMS[0],
    candidate: str = ARMS[1],
    benchmarks: Sequence[str] = (),
    runs: DataFrame | None = None,
) -> DataFrame:
    """The report as lines to sort by ``REPORT_ORDER``: table header, rows, tally of wins.

    Listed ``benchmarks`` come first and in that order; time precedes cost. With the
    statistics per benchmark and arm in ``runs`` it opens with the number of runs and
    their total time, and ends with notes.
    """
    names = (base.upper(), candidate.upper())
    heads = ["Benchmark", "Metric", *[f"{n} (Mean ± Std)" for n in names], "Difference", "Winner"]
    header = "| " + " | ".join(heads) + " |"
    rule = "|" + "|".join("-" * (len(head) + 2) for head in heads) + "|"
    listed = F.array_position(F.array(*[F.lit(b) for b in benchmarks]).cast("array<string>"), F.col("benchmark"))
    place = F.when(listed > 0, listed).otherwise(len(benchmarks) + 1) * 2
    body = report_lines(rows).select(
        F.lit(1).alias("section"),
        (place + F.col("metric").contains("Cost").cast("int")).cast("int").alias("position"),
        "benchmark",
        "metric",
        "line",
    )
    tally = win_tally(rows, base, candidate).select(
        F.array(
            F.lit(""),
            F.lit("## Summary"),
            F.lit(""),
            F.concat(F.lit(f"- {names[0]} Wins: "), "base_wins"),
            F.concat(F.lit(f"- {names[1]} Wins: "), "candidate_wins"),
            F.concat(F.lit("- Ties: "), "ties"),
        ).alias("lines")
    )
    opening = rows.sparkSession.range(1).select(F.array(F.lit(header), F.lit(rule)).alias("lines"))
    blank = F.lit("")
    for section, block in ((0, opening), (2, tally)):
        lines = block.select(F.posexplode("lines").alias("position", "line"))
        body = body.unionByName(
            lines.select(
                F.lit(section).alias("section"), "position", blank.alias("benchmark"), blank.alias("metric"), "line"
            )
        )
    return body if runs is None else body.unionByName(_report_frame(runs, names))


def _report_frame(runs: DataFrame, names: Sequence[str]) -> DataFrame:
    """The lines before and after the table: runs, their hours, notes."""
    spark, blank = runs.sparkSession, F.lit("")

    def block(section: int, *lines: Column) -> DataFrame:
        rows = spark.range(1).select(F.array(*lines).alias("lines"))
        return rows.select(F.lit(section).alias("section"), F.posexplode("lines").alias("position", "line"))

    hours = runs.agg(F.sum(F.col("time_n") * F.col("time_mean")) / 3600.0).toDF("hours")
    duration = F.concat(F.lit("**Total Benchmark Duration:** "), fixed_text(F.col("hours"), 2), F.lit(" hours"))
    total = hours.select(F.array(blank, duration, blank, F.lit("## Performance Comparison"), blank).alias("lines"))
    count = F.concat_ws(" ", F.lit("-"), "benchmark", F.concat(F.upper("provider"), F.lit(" runs:")), "time_n")
    parts = [
        block(-4, F.lit(f"# {names[0]} vs {names[1]} Comparison"), blank, F.lit("## Benchmark Configuration"), blank),
        runs.select(F.lit(-3).alias("section"), F.lit(0).alias("position"), "benchmark", count.alias("line")),
        total.select(F.lit(-2).alias("section"), F.posexplode("lines").alias("position", "line")),
        block(
            3,
            blank,
            F.lit("## Notes"),
            blank,
            F.lit(f"- A positive difference means that {names[1]} took longer or cost more than {names[0]}."),
            F.lit("- The lower mean wins, for time as for cost."),
            F.lit("- Means and deviations are taken over the runs of each arm."),
        ),
    ]
    framed = [
        part.select("section", "position", F.col("benchmark") if "benchmark" in part.columns else blank.alias("benchmark"), blank.alias("metric"), "line")
        for part in parts
    ]
    return reduce(DataFrame.unionByName, framed)


def write_report(
    rows: DataFrame,
    path: str,
    base: str = ARMS[0],
    candidate: str = ARMS[1],
    benchmarks: Sequence[str] = (),
    runs: DataFrame | None = None,
) -> str | None:
    """The comparison as markdown text; without rows nothing is written.

    A small report is one file, and the files of a long one continue each other by name.
    """
    with kept(rows):
        if rows.isEmpty():
            return None
        lines = report_table(rows, base, candidate, benchmarks, runs)
        lines.orderBy(*REPORT_ORDER).select("line").write.text(path)
    return path
