"""Plan properties that keep the builds cheap at scale (checked on plans only)."""

from conftest import SF_SMALL
from tidemark.operators import cdc, clicks, ledger, marts
from tidemark.plans import queries, refresh
from tidemark.plans.layers import Layers
from tidemark.sources import testdata
from tidemark.streaming import ingest


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_silver_build_prunes_bronze_by_source_table(utc):
    lh = ingest.fresh_lakehouse(utc, "t-plan")
    refresh.load_bronze_batch(lh, testdata.cdc_envelopes(utc, SF_SMALL), testdata.click_envelopes(utc, SF_SMALL), "load1")
    utc.conf.set("spark.sql.maxMetadataStringLength", "2000")  # the batches shown are a filter too
    plan = _plan(cdc.silver_transactions(lh.table("bronze.pg_cdc_raw")))
    utc.conf.unset("spark.sql.maxMetadataStringLength")
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "source_table" in filters and "transactions" in filters


def test_top_k_views_limit_before_the_shuffle(utc):
    L = Layers(utc, SF_SMALL)
    for df in (clicks.recent_events(L.bronze_clicks), ledger.recent_transactions(L.transactions, 5)):
        plan = _plan(df)
        assert "WindowGroupLimit" in plan and "Partial" in plan


def test_marts_aggregate_partially_before_joining(utc):
    L = Layers(utc, SF_SMALL)
    plan = _plan(marts.current_balances(L.accounts, L.transactions))
    assert "partial_sum" in plan and "partial_count" in plan
    plan = _plan(marts.user_engagement_daily(L.events, L.transactions))
    assert plan.count("partial_") >= 2 and "FullOuter" in plan


def test_sessions_hash_their_events(utc):
    """The events meet fixed-width aggregates only; texts are compared on one row per session and user."""
    from helpers import EVENT_SCHEMA, frame
    from tidemark.operators import sessions
    plan = _plan(sessions.sessions(frame(utc, EVENT_SCHEMA, [])))
    lowest = [line for line in plan.splitlines() if "Aggregate" in line][-1]
    assert "HashAggregate" in lowest and "partial_count" in lowest


def test_page_dwell_sorts_enters_and_leaves_only(utc, monkeypatch):
    from tidemark.operators import scans
    seen = []
    monkeypatch.setattr(scans, "stored", lambda df, label: seen.append(df) or df)
    clicks.page_dwell(Layers(utc, SF_SMALL).bronze_clicks)
    lines = _plan(seen[0]).splitlines()
    sorts = [i for i, line in enumerate(lines) if "rangepartitioning(session_id" in line]
    filters = [i for i, line in enumerate(lines) if "Filter" in line and "page_enter" in line]
    assert sorts and filters and max(filters) > max(sorts)  # plans list the source last


def test_ingest_writes_without_a_shuffle(utc):
    from tidemark.operators import bronze as B
    envelope = utc.createDataFrame([], "topic string, partition_id int, offset_value bigint, key_json string, value_json string")
    for annotate, split in ((B.annotate_cdc, B.split_cdc), (B.annotate_clicks, B.split_clicks)):
        assert all("Exchange" not in _plan(df) for df in split(annotate(envelope)))


def test_replay_joins_ranges_not_rows(utc):
    """Beside the sort into ranges, the rows of the ledgers are shuffled for joins with one row per range only."""
    L = Layers(utc, SF_SMALL)
    plan = _plan(ledger.ledger_running_balance(L.transactions, L.accounts))
    assert "Window" in plan and "o_orderkey" not in plan  # the rows are read back, not built and parsed again


def test_a_filter_does_not_build_or_parse_json_again(utc):
    """One to_json and two parses (header, image) a record, whatever filters follow: none is pushed below them with the parse."""
    plan = Layers(utc, SF_SMALL).transactions._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("StructsToJsonEvaluator") == 1
    assert plan.count("from_json(") == 2
    plan = Layers(utc, SF_SMALL).bronze_clicks._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("StructsToJsonEvaluator") == 1
    assert plan.count("from_json(StructField(event_id") == 1


def test_marts_parse_a_change_once_and_shuffle_only_their_columns(spark):
    """one parse of a change; fields that a mart does not read are not carried along."""
    L = Layers(spark, SF_SMALL)
    whole = queries.silver_transactions_live(spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert whole.count("from_json") == 1
    assert "wallet.public.users" not in whole  # other topics are not built
    narrow = L.transactions_of("user_id", "direction", "amount", "dt")._jdf.queryExecution().optimizedPlan().toString()
    assert narrow.count("from_json") == 1
    aggregate = next(line for line in narrow.splitlines() if "Aggregate" in line)
    assert "amount" in aggregate and "merchant" not in aggregate and "description" not in aggregate


def test_test_tables_are_dealt_without_a_sort(spark):
    """A deal without a key sorts the rows of every task first."""
    plan = testdata.click_envelopes(spark, SF_SMALL)._jdf.queryExecution().toString()
    assert "RoundRobinPartitioning" not in plan
