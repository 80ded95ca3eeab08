"""The operations of the transactions workload, over any fact table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armspan.functions.rounding import exact_sum


def filter_category(facts: DataFrame, values: Sequence[str], category: str = "EXP_TYPE") -> DataFrame:
    """Rows whose category is one of ``values``; a null category is dropped."""
    return facts.filter(F.col(category).isin(*values))


def filter_conjunctive(
    facts: DataFrame,
    value: str,
    above: float,
    years: Sequence[int],
    category: str = "EXP_TYPE",
    amount: str = "AMOUNT",
    year: str = "YEAR",
) -> DataFrame:
    return facts.filter(
        (F.col(category) == value) & (F.col(amount) > above) & F.col(year).isin(*years)
    )


def _summarise(
    facts: DataFrame,
    keys: Sequence[str],
    amount: str,
    total: str,
    count: str,
    average: str | None = None,
    digits: int | None = 2,
) -> DataFrame:
    sums = [exact_sum(F.col(amount), digits).alias(total), F.count(F.lit(1)).alias(count)]
    if average is None:
        return facts.groupBy(*keys).agg(*sums)
    filled = facts.groupBy(*keys).agg(*sums, F.nullif(F.count(amount), F.lit(0)).alias("_filled"))
    return filled.withColumn(average, F.col(total) / F.col("_filled")).drop("_filled")


def agg_by_customer(
    facts: DataFrame, key: str = "CUST_ID", amount: str = "AMOUNT", digits: int | None = 2
) -> DataFrame:
    """Sum, row count and mean per key. ``digits``: the decimals of the amounts, see ``exact_sum``."""
    return _summarise(facts, [key], amount, "total_spent", "transaction_count", "avg_transaction", digits)


def agg_by_category(
    facts: DataFrame, key: str = "EXP_TYPE", amount: str = "AMOUNT", digits: int | None = 2
) -> DataFrame:
    return _summarise(facts, [key], amount, "total_amount", "count", "avg_amount", digits)


def agg_monthly(
    facts: DataFrame,
    year: str = "YEAR",
    month: str = "MONTH",
    amount: str = "AMOUNT",
    digits: int | None = 2,
) -> DataFrame:
    """Totals per month, in calendar order."""
    totals = _summarise(facts, [year, month], amount, "monthly_total", "monthly_count", digits=digits)
    return totals.orderBy(year, month)


def count_rows(facts: DataFrame) -> DataFrame:
    return facts.agg(F.count(F.lit(1)).alias("row_count"))


def sort_by_amount(facts: DataFrame, amount: str = "AMOUNT", tie: str = "TRANS_ID") -> DataFrame:
    """All rows by amount, largest first.

    The tie-break also lets the range partitioner cut through a frequent amount.
    """
    return facts.orderBy(F.desc(amount), F.asc(tie))


def preview(facts: DataFrame, n: int = 5, amount: str = "AMOUNT", tie: str = "TRANS_ID") -> DataFrame:
    """The first ``n`` rows of ``sort_by_amount``, found without sorting the rest."""
    return sort_by_amount(facts, amount, tie).limit(n)


def join_customer_summary(
    facts: DataFrame, key: str = "CUST_ID", amount: str = "AMOUNT", digits: int | None = 2
) -> DataFrame:
    """Every row with the totals of its customer; rows without a customer are dropped.

    The join is on the key as a struct. It is the same condition, but the aggregate below is
    partitioned by the plain key, so both sides get exchanges of their own, and adaptive
    execution can split a partition that a frequent key makes too large, by its bytes, into as
    many tasks as it takes. With an aggregate right below the join it could not.
    """
    named = facts.filter(F.col(key).isNotNull())
    summary = _summarise(
        named,
        [key],
        amount,
        "total_spent",
        "total_transactions",
        "avg_transaction_amount",
        digits,
    )
    totals = summary.select(F.struct(key).alias("_key"), *summary.columns[1:])
    joined = named.join(totals, F.struct(named[key]) == totals["_key"])
    others = [named[column] for column in named.columns if column.lower() != key.lower()]
    return joined.select(named[key], *others, *summary.columns[1:])
