"""Gold daily marts.

Every mart aggregates before it joins: the joins meet at most one row per
key on each side, so a hot user or account is folded map-side first and
never turns into a skewed join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
# The calls to action that count toward the funnel.
FUNNEL_CTA_IDS = ("create-transaction", "quick-action-pay", "quick-action-deposit")


def _signed_amount() -> Column:
    # Anything that is not 'credit' -- NULL included -- is subtracted.
    return F.when(F.col("direction") == "credit", F.col("amount")).otherwise(-F.col("amount"))


def current_balances(accounts: DataFrame, transactions: DataFrame,
                     as_of: Column | None = None) -> DataFrame:
    """gold.current_balances (M6): opening balance + signed sum per account.

    Transactions are summed per account first (J1 rewritten as
    aggregate-then-join); accounts without transactions keep the opening
    balance and a count of 0.
    """
    per_account = transactions.groupBy("account_id").agg(
        F.sum(_signed_amount()).alias("_net"),
        F.count("transaction_id").alias("_n"),
    )
    a = accounts.select("user_id", "account_id", "currency", "opening_balance")
    return a.join(per_account, "account_id", "left").select(
        "user_id", "account_id", "currency",
        (F.coalesce("opening_balance", F.lit(0)) + F.coalesce("_net", F.lit(0))).try_cast(MONEY).alias("balance"),
        F.coalesce("_n", F.lit(0)).cast("bigint").alias("transactions_count"),
        (as_of if as_of is not None else F.current_timestamp()).alias("updated_at"),
    )


def transaction_volume_daily(transactions: DataFrame) -> DataFrame:
    """gold.transaction_volume_daily (M7); NULL direction in neither sum."""
    amt = F.col("amount")
    return transactions.groupBy("dt", "user_id", "currency").agg(
        F.sum(F.when(F.col("direction") == "credit", amt).otherwise(F.lit(0))).try_cast(MONEY).alias("credit_amount"),
        F.sum(F.when(F.col("direction") == "debit", amt).otherwise(F.lit(0))).try_cast(MONEY).alias("debit_amount"),
        F.count(F.lit(1)).alias("transaction_count"),
    )


def page_engagement_daily(events: DataFrame) -> DataFrame:
    """gold.page_engagement_daily (M8): NULL dwell counts as 0 in sum and mean."""
    dwell = F.coalesce("dwell_ms", F.lit(0))
    return events.groupBy("dt", "page").agg(
        F.count_distinct("analytics_session_id").alias("sessions"),
        F.count(F.lit(1)).alias("events"),
        F.sum(dwell).cast("bigint").alias("total_dwell_ms"),
        F.avg(dwell).alias("avg_dwell_ms"),
    )


def button_clicks_daily(events: DataFrame) -> DataFrame:
    """gold.button_clicks_daily (M9)."""
    return (
        events.filter((F.col("event_type") == "click") & F.col("element_id").isNotNull())
        .groupBy("dt", "page", "element_id")
        .agg(
            F.count(F.lit(1)).alias("clicks"),
            F.count_distinct("user_id").alias("users"),
            F.count_distinct("analytics_session_id").alias("sessions"),
        )
    )


def active_days(events: DataFrame, transactions: DataFrame) -> DataFrame:
    """Distinct days seen in events or transactions."""
    return events.select("dt").union(transactions.select("dt")).distinct()


def conversion_funnel_daily(events: DataFrame, transactions: DataFrame,
                            cta_ids: Sequence[str] = FUNNEL_CTA_IDS) -> DataFrame:
    """gold.conversion_funnel_daily.

    One pass over events gives views and CTA clicks for every event day;
    the per-day transaction counts join on ``dt`` null-safely, which yields
    the union of days (U1) without a separate distinct. Both sides hold one
    row per day. A NULL day matches nothing in the day-join of the
    definition, so its counts are 0.
    """
    per_day_events = events.groupBy("dt").agg(
        F.sum(F.when(F.col("event_type") == "page_enter", 1).otherwise(0)).alias("_views"),
        F.sum(F.when((F.col("event_type") == "click") & F.col("element_id").isin(*cta_ids), 1)
              .otherwise(0)).alias("_clicks"),
    )
    per_day_tx = transactions.groupBy(F.col("dt").alias("_tdt")).agg(F.count(F.lit(1)).alias("_tx"))
    joined = per_day_events.join(
        per_day_tx, per_day_events["dt"].eqNullSafe(per_day_tx["_tdt"]), "full")
    day = F.coalesce("dt", "_tdt")
    known = day.isNotNull()
    views = F.when(known, F.coalesce("_views", F.lit(0))).otherwise(0).cast("bigint")
    clicks = F.when(known, F.coalesce("_clicks", F.lit(0))).otherwise(0).cast("bigint")
    tx = F.when(known, F.coalesce("_tx", F.lit(0))).otherwise(0).cast("bigint")
    return joined.select(
        day.alias("dt"),
        views.alias("page_views"),
        clicks.alias("create_transaction_clicks"),
        tx.alias("transactions_created"),
        F.when(views == 0, F.lit(0.0)).otherwise(tx.cast("double") / views.cast("double"))
        .alias("conversion_rate"),
    )


def conversion_funnel_cta_daily(events: DataFrame,
                                cta_ids: Sequence[str] = FUNNEL_CTA_IDS) -> DataFrame:
    """gold.conversion_funnel_cta_daily."""
    return (
        events.filter((F.col("event_type") == "click") & F.col("element_id").isin(*cta_ids))
        .groupBy("dt", "element_id")
        .agg(
            F.count(F.lit(1)).alias("clicks"),
            F.count_distinct("user_id").alias("users"),
            F.count_distinct("analytics_session_id").alias("sessions"),
        )
    )


def user_engagement_daily(events: DataFrame, transactions: DataFrame) -> DataFrame:
    """gold.user_engagement_daily (M12, J3): behaviour FULL OUTER money on (dt, user)."""
    behavior = (
        events.filter(F.col("user_id").isNotNull())
        .groupBy("dt", "user_id")
        .agg(
            F.count_distinct("analytics_session_id").alias("b_sessions"),
            F.sum(F.coalesce("dwell_ms", F.lit(0))).cast("bigint").alias("b_dwell"),
            F.sum(F.when(F.col("event_type") == "page_enter", 1).otherwise(0)).cast("bigint").alias("b_views"),
            F.sum(F.when(F.col("event_type") == "click", 1).otherwise(0)).cast("bigint").alias("b_clicks"),
        )
        .withColumnRenamed("dt", "b_dt").withColumnRenamed("user_id", "b_user")
    )
    amt = F.col("amount")
    money = (
        transactions.filter(F.col("user_id").isNotNull())
        .groupBy("dt", "user_id")
        .agg(
            F.count(F.lit(1)).alias("m_n"),
            F.sum(F.when(F.col("direction") == "debit", amt).otherwise(F.lit(0))).try_cast(MONEY).alias("m_debit"),
            F.sum(F.when(F.col("direction") == "credit", amt).otherwise(F.lit(0))).try_cast(MONEY).alias("m_credit"),
        )
        .withColumnRenamed("dt", "m_dt").withColumnRenamed("user_id", "m_user")
    )
    cond = (F.col("b_dt") == F.col("m_dt")) & (F.col("b_user") == F.col("m_user"))
    zero = F.lit(0)
    return behavior.join(money, cond, "full").select(
        F.coalesce("b_dt", "m_dt").alias("dt"),
        F.coalesce("b_user", "m_user").alias("user_id"),
        F.coalesce("b_sessions", zero).cast("bigint").alias("sessions"),
        F.coalesce("b_dwell", zero).cast("bigint").alias("total_dwell_ms"),
        F.coalesce("b_views", zero).cast("bigint").alias("page_views"),
        F.coalesce("b_clicks", zero).cast("bigint").alias("clicks"),
        F.coalesce("m_n", zero).cast("bigint").alias("transactions_count"),
        F.coalesce("m_debit", zero).try_cast(MONEY).alias("debit_amount"),
        F.coalesce("m_credit", zero).try_cast(MONEY).alias("credit_amount"),
    )


def latest_days(engagement: DataFrame, k: int = 10) -> DataFrame:
    """Top-k serving read: newest days first, ties by user (L1)."""
    return engagement.orderBy(F.col("dt").desc_nulls_last(), F.col("user_id").asc_nulls_last()).limit(k)
