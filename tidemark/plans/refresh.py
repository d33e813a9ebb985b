"""Full refresh (M14): the thirteen silver and gold builds in dependency
order, each reading the table written by the previous step.

Writing each layer cuts lineage: a lost executor recomputes from the last
written table, not from the raw envelopes. Builds run one after another in
one session, like the reference; each is one distributed job.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import cdc, marts, sessions
from tidemark.plans.catalog import Lakehouse, overwrite_mode

Build = tuple[str, Callable[[Lakehouse], DataFrame]]


# Builds whose rows depend only on silver rows of the same ``dt``: they may be
# rebuilt for recent days only. Latest-per-key, sessions and balances need
# the full history and are always rebuilt whole.
DAILY_BUILDS = (
    "gold.transaction_volume_daily", "gold.page_engagement_daily", "gold.button_clicks_daily",
    "gold.conversion_funnel_daily", "gold.conversion_funnel_cta_daily",
    "gold.user_engagement_daily", "gold.sessions",
)


def builds(as_of: Column | None = None, apply_deletes: bool = False,
           since: _dt.date | None = None, days: set[_dt.date] | None = None) -> list[Build]:
    """The thirteen builds; with ``since`` the daily gold builds read only
    silver partitions ``dt >= since`` (partition pruning) and, written in
    dynamic mode, replace only those days; with ``days`` those of that set."""

    def t(lh: Lakehouse, logical: str, daily: bool = False) -> DataFrame:
        df = lh.table(logical)
        if daily and since is not None:
            df = df.filter(F.col("dt") >= F.lit(since))
        if daily and days is not None:
            df = df.filter(F.col("dt").isin(sorted(days)))
        return df

    return [
        ("silver.transactions", lambda lh: cdc.silver_transactions(t(lh, "bronze.pg_cdc_raw"), apply_deletes)),
        ("silver.users", lambda lh: cdc.silver_users(t(lh, "bronze.pg_cdc_raw"), apply_deletes)),
        ("silver.accounts", lambda lh: cdc.silver_accounts(t(lh, "bronze.pg_cdc_raw"), apply_deletes)),
        ("silver.clickstream_events", lambda lh: sessions.sessionize(t(lh, "bronze.clickstream_raw"))),
        ("silver.sessions", lambda lh: sessions.sessions(t(lh, "silver.clickstream_events"))),
        ("gold.current_balances", lambda lh: marts.current_balances(
            t(lh, "silver.accounts"), t(lh, "silver.transactions"), as_of)),
        ("gold.transaction_volume_daily", lambda lh: marts.transaction_volume_daily(t(lh, "silver.transactions", True))),
        ("gold.page_engagement_daily", lambda lh: marts.page_engagement_daily(t(lh, "silver.clickstream_events", True))),
        ("gold.button_clicks_daily", lambda lh: marts.button_clicks_daily(t(lh, "silver.clickstream_events", True))),
        ("gold.conversion_funnel_daily", lambda lh: marts.conversion_funnel_daily(
            t(lh, "silver.clickstream_events", True), t(lh, "silver.transactions", True))),
        ("gold.conversion_funnel_cta_daily", lambda lh: marts.conversion_funnel_cta_daily(
            t(lh, "silver.clickstream_events", True))),
        ("gold.user_engagement_daily", lambda lh: marts.user_engagement_daily(
            t(lh, "silver.clickstream_events", True), t(lh, "silver.transactions", True))),
        ("gold.sessions", lambda lh: sessions.gold_sessions(t(lh, "silver.sessions", days is None))),
    ]


# Dependency levels of the builds: each level reads only tables written by
# earlier levels, so the builds of one level may run as concurrent jobs.
LEVELS = (
    ("silver.transactions", "silver.users", "silver.accounts", "silver.clickstream_events"),
    ("silver.sessions", "gold.current_balances", "gold.transaction_volume_daily",
     "gold.page_engagement_daily", "gold.button_clicks_daily", "gold.conversion_funnel_daily",
     "gold.conversion_funnel_cta_daily", "gold.user_engagement_daily"),
    ("gold.sessions",),
)


def refresh_all(lakehouse: Lakehouse, mode: str | None = None, as_of: Column | None = None,
                apply_deletes: bool = False, on_build: Callable[[str, float], None] | None = None,
                since: _dt.date | None = None, parallel: int = 1) -> None:
    """Run the thirteen builds; ``on_build(table, seconds)`` is called after
    each one (the bench uses it for per-build timings). Tables are replaced
    whole, so that a row whose day has changed leaves its old day; ``since``
    limits the daily gold builds to recent days, which alone are then
    replaced. ``mode`` names one overwrite mode for all tables instead. ``parallel > 1`` runs
    the builds of one dependency level as concurrent Spark jobs (threads
    sharing the session); ``parallel = 1`` is the reference's serial order."""
    import time
    from concurrent.futures import ThreadPoolExecutor

    if since is not None and mode == "full":
        raise ValueError("an incremental refresh must use dynamic overwrite")

    def mode_of(table: str) -> str:
        return mode or ("dynamic" if since is not None and table in DAILY_BUILDS else "full")

    lakehouse.init()
    plan = dict(builds(as_of, apply_deletes, since))

    def run(table: str) -> None:
        start = time.perf_counter()
        lakehouse.overwrite(table, plan[table](lakehouse), mode=mode_of(table), set_mode=False)
        if on_build:
            on_build(table, time.perf_counter() - start)

    # Whole tables are published, which no session setting touches; the
    # setting for day partitions is made once for all concurrent writers.
    levels = LEVELS if parallel > 1 else tuple((table,) for table in plan)
    with ThreadPoolExecutor(max_workers=max(1, parallel)) as pool, overwrite_mode(lakehouse.spark, "dynamic"):
        for level in levels:
            list(pool.map(run, level))


def load_bronze_batch(lakehouse: Lakehouse, cdc_envelopes: DataFrame, click_envelopes: DataFrame,
                      load_id: str) -> None:
    """Batch form of the ingest: one envelope DataFrame per kind -> bronze.

    ``load_id`` names the load: the same id again replaces that load (a
    retry), a new id adds to the tables. The kinds share no table and are
    loaded at the same time: one's commits and last tasks leave cores to the other."""
    from concurrent.futures import ThreadPoolExecutor

    from tidemark.streaming.ingest import batch_writer

    lakehouse.init()
    # The setting is made once around both, as each writer puts back what it found.
    with ThreadPoolExecutor(max_workers=2) as pool, overwrite_mode(lakehouse.spark, "full"):
        loads = [pool.submit(batch_writer(lakehouse, kind, load_id), envelopes, 0)
                 for kind, envelopes in (("cdc", cdc_envelopes), ("clicks", click_envelopes))]
        for load in loads:
            load.result()
