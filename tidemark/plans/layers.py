"""The medallion layers of one source folder as lazy DataFrames.

``Layers(spark, sf_dir)`` wires the testdata adapter into the batch form of
the bronze ingest and then into every silver and gold build. Catalyst sees each
requested table as one plan (from parquet scan to mart), prunes the JSON fields
it does not need and pushes filters down to the scans. Only the click events,
which a scan over sessions reads in several branches, are written once in their
parsed form, when the first of its results is asked for.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import bronze as B
from tidemark.operators import cdc, marts, sessions
from tidemark.session import stored
from tidemark.sources import testdata


class Layers:
    def __init__(self, spark: SparkSession, sf_dir: str, ingest_ts: Column | None = None,
                 gap_seconds: int = sessions.SESSION_IDLE_GAP_SECONDS):
        self.spark = spark
        self.sf_dir = sf_dir
        self.ingest_ts = ingest_ts
        self.gap_seconds = gap_seconds

    # -- bronze ---------------------------------------------------------
    @cached_property
    def cdc_envelopes(self) -> DataFrame:
        return testdata.cdc_envelopes(self.spark, self.sf_dir)

    @cached_property
    def click_envelopes(self) -> DataFrame:
        return testdata.click_envelopes(self.spark, self.sf_dir)

    @cached_property
    def _cdc_split(self) -> tuple[DataFrame, DataFrame]:
        return B.split_cdc(B.annotate_cdc(self.cdc_envelopes, self.ingest_ts))

    @cached_property
    def _click_split(self) -> tuple[DataFrame, DataFrame]:
        return B.split_clicks(B.annotate_clicks(self.click_envelopes, self.ingest_ts))

    @property
    def bronze_cdc(self) -> DataFrame:
        return self._cdc_split[0]

    @property
    def dlq_cdc(self) -> DataFrame:
        return self._cdc_split[1]

    @property
    def bronze_clicks(self) -> DataFrame:
        return self._click_split[0]

    @property
    def dlq_clicks(self) -> DataFrame:
        return self._click_split[1]

    @cached_property
    def clicks(self) -> DataFrame:
        """The bronze click events without their JSON text, written and read back."""
        return stored(self.bronze_clicks.drop("value_json"), "clicks")

    def events_of(self, *payload: str) -> DataFrame:
        """``events`` with these payload columns only; the others are neither cast nor written."""
        left_out = [c for c in sessions.PAYLOAD_COLUMNS if c not in payload]
        clicks = stored(self.bronze_clicks.drop("value_json", *left_out), "clicks")
        return sessions.sessionize(clicks, gap_seconds=self.gap_seconds)

    def changes(self, table: str) -> DataFrame:
        """The bronze changes of one topic; the other topics' records are not even built."""
        return self.bronze_cdc.filter(F.col("topic") == f"wallet.public.{table}")

    def parsed_changes(self, table: str, columns: Sequence[str] | None = None) -> DataFrame:
        """``changes`` with their images, or the fields behind ``columns`` of the silver table, parsed along with the headers."""
        topic = self.cdc_envelopes.filter(F.col("topic") == f"wallet.public.{table}")
        return B.split_cdc(B.annotate_cdc(topic, self.ingest_ts, cdc.image_fields(table, columns)))[0]

    # -- silver ---------------------------------------------------------
    @cached_property
    def transactions(self) -> DataFrame:
        return cdc.silver_transactions(self.changes("transactions"))

    def transactions_of(self, *columns: str) -> DataFrame:
        """``transactions`` from one parse a record; of named columns only, the others' fields are neither parsed nor shuffled."""
        return cdc.silver_transactions(self.parsed_changes("transactions", columns or None), columns=columns or None)

    @cached_property
    def users(self) -> DataFrame:
        return cdc.silver_users(self.parsed_changes("users"))

    @cached_property
    def accounts(self) -> DataFrame:
        return cdc.silver_accounts(self.parsed_changes("accounts"))

    @cached_property
    def events(self) -> DataFrame:
        return sessions.sessionize(self.clicks, gap_seconds=self.gap_seconds)

    @cached_property
    def sessions(self) -> DataFrame:
        return sessions.sessions(self.events)

    # -- gold -----------------------------------------------------------
    def current_balances(self, as_of: Column | None = None) -> DataFrame:
        return marts.current_balances(
            self.accounts, self.transactions_of("transaction_id", "account_id", "direction", "amount"), as_of)

    @cached_property
    def transaction_volume_daily(self) -> DataFrame:
        return marts.transaction_volume_daily(
            self.transactions_of("user_id", "direction", "amount", "currency", "dt"))

    @cached_property
    def page_engagement_daily(self) -> DataFrame:
        return marts.page_engagement_daily(self.events_of("page", "dwell_ms"))

    @cached_property
    def button_clicks_daily(self) -> DataFrame:
        return marts.button_clicks_daily(self.events_of("user_id", "event_type", "page", "element_id"))

    @cached_property
    def conversion_funnel_daily(self) -> DataFrame:
        return marts.conversion_funnel_daily(self.events_of("event_type", "element_id"), self.transactions_of("dt"))

    @cached_property
    def conversion_funnel_cta_daily(self) -> DataFrame:
        return marts.conversion_funnel_cta_daily(self.events_of("user_id", "event_type", "element_id"))

    @cached_property
    def user_engagement_daily(self) -> DataFrame:
        return marts.user_engagement_daily(
            self.events_of("user_id", "event_type", "dwell_ms"),
            self.transactions_of("user_id", "direction", "amount", "dt"))

    @cached_property
    def gold_sessions(self) -> DataFrame:
        return sessions.gold_sessions(self.sessions)
