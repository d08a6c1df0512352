"""Snapshot reports from balances, and the walk over flat report nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstream.functions import scalars as S


def trial_balance(balances: DataFrame) -> DataFrame:
    """From ledger_name, parent_group, closing: a negative balance is a debit, net is its opposite; zeros are left out."""
    c = F.col("closing")
    return balances.filter((c != 0) & (S.text(F.col("ledger_name")) != "")).select("ledger_name", S.negative_part(c).alias("closing_debit"), S.positive_part(c).alias("closing_credit"), (-c).alias("net_amount"), "parent_group")


def or_else(first: DataFrame, second: DataFrame) -> DataFrame:
    """The first frame if it has any row, which one row read tells, else the second."""
    return second if first.isEmpty() else first


def group_report(groups: DataFrame, revenue: bool) -> DataFrame:
    """Balances of the revenue groups (profit and loss) or of the others (balance sheet); zeros are left out."""
    out = groups.filter((F.col("is_revenue") == revenue) & (F.col("amount") != 0)).select(F.col("group_name").alias("ledger_name"), "amount", F.lit("").alias("parent_group"))
    return out if revenue else out.withColumn("category", S.balance_side(F.col("amount")))


def outstanding(balances: DataFrame, group: str) -> DataFrame:
    """Parties of the groups that mention ``group`` with a balance."""
    return balances.filter(S.contains_any(F.col("parent_group"), group.lower()) & (F.col("closing") != 0)).select(F.col("ledger_name").alias("party_name"), "parent_group", F.col("closing").alias("amount"))


def stock_summary(items: DataFrame) -> DataFrame:
    """From the movement columns of each item; items on which nothing is left or moved are left out."""
    sums = ["opening_qty", "opening_value", "inward_qty", "inward_value", "outward_qty", "outward_value", "closing_qty"]
    closing = S.first_nonzero(F.col("closing_value"), F.col("closing_value_alt"))
    out = items.select("item_name", "stock_group", *sums, closing.alias("closing_value"))
    return out.filter(" or ".join(f"{c} != 0" for c in ("opening_qty", "closing_qty", "closing_value")))


def pair_walk(nodes: DataFrame) -> DataFrame:
    """Pairs each name node of a report with the node after it; of repeated names the first counts.

    ``nodes``: report, ord, tag (``name`` or ``amount``), value. A name that no
    amount follows is left out. Result: report, ord, name, amount.
    """
    w = Window.partitionBy("report").orderBy("ord")
    paired = nodes.withColumn("after_tag", F.lead("tag").over(w)).withColumn("after", F.lead("value").over(w)).filter("tag = 'name' and after_tag = 'amount'").filter(S.text(F.col("value")) != "")
    first = Window.partitionBy("report", F.lower(F.trim("value"))).orderBy("ord")
    return paired.withColumn("nr", F.row_number().over(first)).filter("nr = 1").select("report", "ord", F.trim("value").alias("name"), S.number(F.col("after")).alias("amount"))
