"""CDC bronze -> silver current-state tables.

``latest_per_key`` keeps one row per key: the one with the greatest
``(event_ts, partition_id, offset_value)`` (NULL ``event_ts`` loses, S1).
It is an aggregation, not a window: ``max`` over a struct is computed
partially on the map side, so a hot key (one account updated millions of
times) is reduced before the shuffle instead of landing whole in one task.
Remaining struct fields break exact ties deterministically.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions.casts import to_money, with_fields
from tidemark.functions.timeparse import timestamp_from_text, utc_date
from tidemark.operators.bronze import IMAGE

# Operations that carry a current row image, and the fields
# of each table's ``after`` image.
UPSERT_OPS = ("c", "r", "u")
DELETE_OP = "d"
AFTER_FIELDS = {
    "transactions": ("id", "user_id", "account_id", "type", "direction", "amount", "currency",
                     "description", "merchant", "balance_after", "occurred_at", "created_at"),
    "users": ("id", "full_name", "email", "created_at"),
    "accounts": ("id", "user_id", "currency", "opening_balance", "current_balance",
                 "created_at", "updated_at"),
}
ORDER_COLUMNS = ("event_ts", "partition_id", "offset_value")
# The ``after`` fields of silver columns of another name.
SOURCE_FIELDS = {"transaction_id": "id", "dt": "occurred_at"}


def image_fields(table: str, columns: Sequence[str] | None = None) -> tuple[str, ...]:
    """The ``after`` fields behind ``columns`` of a silver table (None: all of the table), the key among them."""
    if columns is None:
        return AFTER_FIELDS[table]
    wanted = {"id", *(SOURCE_FIELDS.get(c, c) for c in columns)}
    return tuple(f for f in AFTER_FIELDS[table] if f in wanted)


def cdc_changes(bronze: DataFrame, table: str, include_deletes: bool = False,
                fields: Sequence[str] | None = None) -> DataFrame:
    """Rows of one source table with a usable key (F1), ``after`` parsed once.

    Output: ``key``, ``op``, the ``after`` fields (text), ``event_ts``,
    ``partition_id``, ``offset_value``, ``bronze_dt``. With ``include_deletes``
    the key of a delete comes from the record key. ``fields`` limits the
    ``after`` fields; an image parsed with the header (``annotate_cdc``) is taken as it is.
    """
    fields = fields or AFTER_FIELDS[table]
    ops = UPSERT_OPS + ((DELETE_OP,) if include_deletes else ())
    rows = bronze.filter((F.col("source_table") == table) & F.col("op").isin(*ops))
    if IMAGE in bronze.columns:
        parsed = rows.withColumns({f"a_{f}": F.col(IMAGE)[f] for f in fields})
    else:
        schema = f"{IMAGE} struct<" + ", ".join(f"{f} string" for f in fields) + ">"
        parsed = with_fields(rows, F.from_json("value_json", schema)[IMAGE], [f"a_{f}" for f in fields])
    key = F.col("a_id")
    if include_deletes:
        key = F.coalesce(key, F.get_json_object("key_json", "$.id"))
    return (
        parsed.select(
            key.alias("key"), "op",
            *[f"a_{f}" for f in fields],
            "event_ts", "partition_id", "offset_value", F.col("dt").alias("bronze_dt"),
        )
        .filter(F.col("key").isNotNull())
    )


def latest_per_key(df: DataFrame, key: str | Sequence[str],
                   order: Sequence[str] = ORDER_COLUMNS) -> DataFrame:
    """One row per key: the greatest ``order`` tuple (W1), skew-safe."""
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = F.max(F.struct(*[F.col(c) for c in order], *[F.col(c) for c in rest])).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_best.{c}").alias(c) for c in [*order, *rest]])


def latest_images(bronze: DataFrame, table: str, apply_deletes: bool = False,
                  fields: Sequence[str] | None = None) -> DataFrame:
    """Each key's latest change: key, op, position and ``after`` fields; a delete only with ``apply_deletes``.

    A position names one record of a topic, so ``fields`` changes the width of the rows and not their choice."""
    return latest_per_key(cdc_changes(bronze, table, include_deletes=apply_deletes, fields=fields), "key")


def silver_columns(table: str) -> list[Column]:
    """The silver columns of ``latest_images`` (M1-M3); the first is the key."""
    occurred = timestamp_from_text(F.col("a_occurred_at"))
    return {
        "transactions": lambda: [
            F.col("key").alias("transaction_id"),
            F.col("a_user_id").alias("user_id"),
            F.col("a_account_id").alias("account_id"),
            F.col("a_type").alias("type"),
            F.col("a_direction").alias("direction"),
            to_money(F.col("a_amount")).alias("amount"),
            F.col("a_currency").alias("currency"),
            F.col("a_description").alias("description"),
            F.col("a_merchant").alias("merchant"),
            to_money(F.col("a_balance_after")).alias("balance_after"),
            occurred.alias("occurred_at"),
            timestamp_from_text(F.col("a_created_at")).alias("created_at"),
            F.coalesce(utc_date(occurred), F.col("bronze_dt")).alias("dt"),
        ],
        "users": lambda: [
            F.col("key").alias("user_id"),
            F.col("a_full_name").alias("full_name"),
            F.col("a_email").alias("email"),
            timestamp_from_text(F.col("a_created_at")).alias("created_at"),
            F.col("event_ts"),
        ],
        "accounts": lambda: [
            F.col("key").alias("account_id"),
            F.col("a_user_id").alias("user_id"),
            F.col("a_currency").alias("currency"),
            to_money(F.col("a_opening_balance")).alias("opening_balance"),
            to_money(F.col("a_current_balance")).alias("current_balance"),
            timestamp_from_text(F.col("a_created_at")).alias("created_at"),
            timestamp_from_text(F.col("a_updated_at")).alias("updated_at"),
            F.col("event_ts"),
        ],
    }[table]()


def _silver(bronze: DataFrame, table: str, apply_deletes: bool, columns: Sequence[str] | None = None) -> DataFrame:
    latest = latest_images(bronze, table, apply_deletes, image_fields(table, columns))
    if apply_deletes:
        latest = latest.filter(F.col("op") != DELETE_OP)
    built = dict(zip(schemas.TABLES[f"silver.{table}"].columns, silver_columns(table), strict=True))
    return latest.select(*[built[c] for c in columns or built])


def silver_transactions(bronze: DataFrame, apply_deletes: bool = False, columns: Sequence[str] | None = None) -> DataFrame:
    """Current transactions (M1); ``dt`` is the business date (S3).

    ``columns`` builds only these: an aggregate over whole rows carries every field it was given
    through its sort and shuffle, whatever is read of the result."""
    return _silver(bronze, "transactions", apply_deletes, columns)


def silver_users(bronze: DataFrame, apply_deletes: bool = False) -> DataFrame:
    """Current users (M2)."""
    return _silver(bronze, "users", apply_deletes)


def silver_accounts(bronze: DataFrame, apply_deletes: bool = False) -> DataFrame:
    """Current accounts (M3)."""
    return _silver(bronze, "accounts", apply_deletes)


def latest_changes(bronze: DataFrame) -> DataFrame:
    """W1 over every CDC table at once, deletes included: the latest
    operation per (source_table, key) with its position."""
    key = F.coalesce(F.get_json_object("value_json", "$.after.id"),
                     F.get_json_object("key_json", "$.id"))
    changes = bronze.filter(
        F.col("source_table").isin(*AFTER_FIELDS) & F.col("op").isin(*UPSERT_OPS, DELETE_OP)
    ).select("source_table", key.alias("key"), "op", *ORDER_COLUMNS).filter(F.col("key").isNotNull())
    return latest_per_key(changes, ["source_table", "key"])


def change_counts(bronze: DataFrame) -> DataFrame:
    """Rows per (source_table, op) that pass the CDC filter (F1): upserts
    with an ``after.id``, deletes with a record key. One pass, map-side
    partial counts."""
    upsert_key = F.get_json_object("value_json", "$.after.id")
    delete_key = F.get_json_object("key_json", "$.id")
    usable = (
        F.col("source_table").isin(*AFTER_FIELDS)
        & ((F.col("op").isin(*UPSERT_OPS) & upsert_key.isNotNull())
           | ((F.col("op") == DELETE_OP) & delete_key.isNotNull()))
    )
    return bronze.filter(usable).groupBy("source_table", "op").agg(F.count(F.lit(1)).alias("rows"))
