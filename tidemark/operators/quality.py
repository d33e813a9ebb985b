"""Record contracts re-aimed from the ingest APIs (V1, V3, V6).

The services reject a whole request when one record is bad; here every row
is checked on its own and carries the list of broken rules, so bad rows can
be routed to a dead-letter table with a reason instead of failing a batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ledger import TRANSACTION_TYPES

# Fixed values of the contracts.
EVENT_TYPES = ("page_enter", "page_leave", "route_change", "click", "mouse_move")
UUID_REGEX = r"^[0-9a-fA-F]{8}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{12}$"
CURRENCY_REGEX = r"^[A-Z]{3}$"
WHOLE_NUMBER = r"^\s*[+-]?[0-9]+(\.0*)?\s*$"
MAX_EVENT_ID, MAX_SESSION_ID, MAX_PAGE, MAX_ELEMENT_ID = 120, 120, 240, 160
MAX_DESCRIPTION, MAX_MERCHANT = 240, 120
BATCH_MIN, BATCH_MAX = 1, 200


def _length_between(c: Column, lo: int, hi: int) -> Column:
    return c.isNotNull() & F.length(c).between(lo, hi)


def _reasons(*rules: tuple[str, Column]) -> Column:
    """Names of the rules whose condition holds, comma-separated ('' = ok)."""
    return F.concat_ws(",", F.array_compact(F.array(
        *[F.when(broken, F.lit(name)) for name, broken in rules])))


def event_reasons(raw: str | None = None) -> Column:
    """V1 as one column over typed event columns: broken rule names, '' if ok.

    ``raw`` names a struct column with the record's own text of ``x``, ``y``
    and ``dwell_ms``; with it, text that is not a whole number in range breaks
    its rule, where the typed column alone only shows NULL or a cut value."""
    return _reasons(*_event_rules(raw))


def _not_whole(raw: str | None, field: str) -> Column:
    if raw is None:
        return F.lit(False)
    text = F.col(f"{raw}.{field}")
    return text.isNotNull() & (~text.rlike(WHOLE_NUMBER) | F.col(field).isNull())


def _event_rules(raw: str | None = None) -> tuple[tuple[str, Column], ...]:
    return (
        ("event_id", ~_length_between(F.col("event_id"), 1, MAX_EVENT_ID)),
        ("session_id", ~_length_between(F.col("session_id"), 1, MAX_SESSION_ID)),
        ("user_id", F.col("user_id").isNotNull() & ~F.col("user_id").rlike(UUID_REGEX)),
        ("event_type", ~F.coalesce(F.col("event_type").isin(*EVENT_TYPES), F.lit(False))),
        ("page", ~_length_between(F.col("page"), 1, MAX_PAGE)),
        ("element_id", F.coalesce(F.length("element_id") > MAX_ELEMENT_ID, F.lit(False))),
        ("x", _not_whole(raw, "x")),
        ("y", _not_whole(raw, "y")),
        ("dwell_ms", F.coalesce(F.col("dwell_ms") < 0, F.lit(False)) | _not_whole(raw, "dwell_ms")),
        ("ts", F.col("event_ts").isNull()),
    )


#: The text of the whole numbers of an event's JSON; the typed columns alone only show NULL where it is none.
RAW_NUMBERS = "x string, y string, dwell_ms string"


def event_violations(events: DataFrame) -> DataFrame:
    """V1 on bronze click events; types are checked on the record's own text where ``value_json`` is there."""
    raw = "_raw" if "value_json" in events.columns else None
    if raw:
        events = events.withColumn(raw, F.from_json("value_json", RAW_NUMBERS))
    reasons = event_reasons(raw)
    return events.select("event_id", "offset_value", reasons.alias("reasons"),
                         (reasons == "").alias("valid"))


# -- batches of events (V3) ---------------------------------------------

def _listed(batches: DataFrame) -> DataFrame:
    """Batch records ``{"events": [...]}`` with their events as texts, and what is wrong with them as a whole."""
    events = F.from_json("value_json", "events array<string>")["events"]
    listed = batches.withColumn("_events", events)
    reason = (F.when(F.col("_events").isNull(), F.lit("events"))
              .when(F.size("_events") < BATCH_MIN, F.lit("empty"))
              .when(F.size("_events") > BATCH_MAX, F.lit("too_long")).otherwise(F.lit("")))
    return listed.withColumn("_reason", reason)


def batch_violations(batches: DataFrame) -> DataFrame:
    """V3: per batch record the number of its events (NULL without a list) and the broken rule, '' if none."""
    return _listed(batches).select(
        "topic", "partition_id", "offset_value", F.when(F.col("_events").isNotNull(), F.size("_events").cast("bigint")).alias("events"),
        F.col("_reason").alias("reasons"), (F.col("_reason") == "").alias("valid"))


def split_batches(batches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, refused batches). Events are envelopes with their ``position`` in the batch, one row
    each; a batch that breaks V3 is refused as a whole, as a dead-letter row."""
    listed = _listed(batches)
    envelope = ["topic", "partition_id", "offset_value"]
    events = listed.filter(F.col("_reason") == "").select(*envelope, F.posexplode("_events").alias("position", "value_json"))
    refused = listed.filter(F.col("_reason") != "").select(
        *envelope, F.col("value_json").alias("raw_value"), F.concat(F.lit("batch:"), F.col("_reason")).alias("error"))
    return events, refused


def batch_sizes(events: DataFrame, batch_cols: list[Column | str]) -> DataFrame:
    """V3: events per batch and whether the size is within 1..200."""
    return events.groupBy(*batch_cols).agg(F.count(F.lit(1)).alias("events")).withColumn(
        "valid", F.col("events").between(BATCH_MIN, BATCH_MAX))


def _not_money(text: Column) -> Column:
    """Text of an amount with more than 2 decimals or 18 digits, zeros at the ends aside; an exponent shifts the point."""
    plain = text.rlike(r"^\s*[+-]?0*[0-9]{0,16}(\.[0-9]{0,2}0*)?\s*$")
    wide = text.try_cast("decimal(38,18)")
    shifted = text.rlike("[eE]") & (wide == F.round(wide, 2)) & (F.abs(wide) < 10 ** 16)
    return text.isNotNull() & ~F.coalesce(plain | shifted, F.lit(False))


def transaction_violations(transactions: DataFrame, raw_amount: str | None = None) -> DataFrame:
    """V6 on silver transactions (amount already DECIMAL(18,2) or NULL).

    ``raw_amount`` names a column with the amount's own text: digits and
    decimals that the cast has rounded away break the rule ``digits``."""
    rules = [
        ("type", ~F.coalesce(F.col("type").isin(*TRANSACTION_TYPES), F.lit(False))),
        ("amount", ~F.coalesce(F.col("amount") > 0, F.lit(False))),
        ("currency", ~F.coalesce(F.col("currency").rlike(CURRENCY_REGEX), F.lit(False))),
        ("description", F.coalesce(F.length("description") > MAX_DESCRIPTION, F.lit(False))),
        ("merchant", F.coalesce(F.length("merchant") > MAX_MERCHANT, F.lit(False))),
    ]
    if raw_amount is not None:
        rules.insert(2, ("digits", _not_money(F.col(raw_amount))))
    reasons = _reasons(*rules)
    return transactions.select("transaction_id", reasons.alias("reasons"),
                               (reasons == "").alias("valid"))
