"""Adapter from the driver's test tables to the domain's broker records.

``events`` becomes clickstream envelopes, ``customer`` becomes CDC snapshots
of users and accounts, ``orders`` becomes CDC versions of transactions. The
rules are spelled out in FIXTURES.md section 3 and repeated in the oracle SQL
from the base columns. Everything is a projection (plus one ``explode`` for
extra versions and one join for the account currency), so the adapter runs
as ordinary distributed stages and also works on streaming inputs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.timeparse import utc_wall_clock
from tidemark.sources.kafka import CLICKSTREAM_TOPIC

# Fixed values of the mapping (FIXTURES.md section 3).
EVENT_TYPES = {
    "view": "page_enter",
    "click": "click",
    "signup": "route_change",
    "error": "mouse_move",
    "purchase": "page_leave",
}
PAGES = ("/dashboard", "/payments", "/history", "/signals")
ELEMENTS = ("create-transaction", "quick-action-pay", "quick-action-deposit", "refresh-data")
PRIORITY_TYPES = {
    "1-URGENT": "deposit",
    "2-HIGH": "transfer_in",
    "3-MEDIUM": "payment",
    "4-NOT SPECIFIED": "withdrawal",
    "5-LOW": "transfer_out",
}
CREDIT_TYPES = ("deposit", "transfer_in")
SNAPSHOT_TS = "2023-12-01T00:00:00Z"
SNAPSHOT_MILLIS = 1_701_388_800_000
TX_EPOCH_MILLIS = 1_704_067_200_000  # 2024-01-01T00:00:00Z
ISO_MICROS_Z = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"
ISO_SECONDS_Z = "yyyy-MM-dd'T'HH:mm:ss'Z'"
ISO_MILLIS_Z = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
TABLE_NAMES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal a test table over ``spark.sql.shuffle.partitions`` tasks by its primary key.

    A broker topic arrives in many partitions; a test table is one file with
    one row group, i.e. one split. The adapter always deals its rows anew,
    whatever their number; real sources do not pass through it. Without a key
    Spark would sort every task's rows first, so that a retry deals them alike."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def _case(col: Column, mapping: dict[str, str]) -> Column:
    out = None
    for key, value in mapping.items():
        out = (F.when(col == key, F.lit(value)) if out is None
               else out.when(col == key, F.lit(value)))
    return out


def _pick(index: Column, values: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _variants(df: DataFrame, extra: list[Column]) -> DataFrame:
    """Each row as ``_v`` 0, and again as 1, 2, ... where the condition of that place holds.

    Numbers first, conditions after: both run as generated code, which a filter over an array would not."""
    wanted = F.col("_v") == 0
    for n, condition in enumerate(extra, 1):
        wanted = wanted | ((F.col("_v") == n) & condition)
    return df.select("*", F.explode(F.array(*[F.lit(n) for n in range(len(extra) + 1)])).alias("_v")).filter(wanted)


def _iso(ntz: Column, fmt: str) -> Column:
    return F.date_format(ntz, fmt)


def clickstream_envelopes(events: DataFrame) -> DataFrame:
    """events -> clickstream envelopes incl. the added bad records.

    variant 0: the event; 1: the same without ``event_id``; 2: null value.
    Works on batch and streaming DataFrames alike.
    """
    eid = F.col("event_id")
    etype = _case(F.col("event_type"), EVENT_TYPES)
    is_click = F.col("event_type") == "click"
    has_xy = F.col("event_type").isin("click", "error")
    body = F.struct(
        F.when(F.col("_v") != 1, F.concat(F.lit("evt-"), eid.cast("string"))).alias("event_id"),
        F.when(eid % 97 != 0, F.concat(F.lit("sess-"), F.col("user_id").cast("string"))).alias("session_id"),
        F.when(eid % 53 != 0, F.concat(F.lit("u-"), F.col("user_id").cast("string"))).alias("user_id"),
        etype.alias("event_type"),
        _pick(eid % 4, PAGES).alias("page"),
        F.when(is_click & (eid % 5 < 4), _pick(eid % 5, ELEMENTS)).alias("element_id"),
        F.when(has_xy, eid % 1024).alias("x"),
        F.when(has_xy, eid % 768).alias("y"),
        F.when(F.col("event_type") == "purchase",
               F.floor(F.col("value") * 1000).cast("bigint")).alias("dwell_ms"),
        _iso(F.col("ts"), ISO_MICROS_Z).alias("ts"),
        F.from_json(F.col("props"), "map<string,string>").alias("payload"),
    )
    return (
        _variants(events, [eid % 211 == 0, eid % 307 == 0])
        .select(
            F.lit(CLICKSTREAM_TOPIC).alias("topic"),
            (F.col("user_id") % 4).cast("int").alias("partition_id"),
            (eid * 3 + F.col("_v")).cast("bigint").alias("offset_value"),
            # The broker key is the raw session id (per-session ordering).
            F.when(eid % 97 != 0, F.concat(F.lit("sess-"), F.col("user_id").cast("string")))
            .alias("key_json"),
            F.when(F.col("_v") != 2, F.to_json(body)).alias("value_json"),
        )
    )


BATCH_TOPIC = "clickstream.batches"


def click_batches(events: DataFrame) -> DataFrame:
    """events -> batch records ``{"events": [...]}``: a batch for each 200 event ids, and beside it by
    the block's number modulo 5: 1 the batch with its first event again, 2 its first event alone, 3 no
    event, 4 no list."""
    one = clickstream_envelopes(events).filter(F.col("offset_value") % 3 == 0)
    block = F.floor(F.col("offset_value") / 600).cast("bigint")
    blocks = one.groupBy(block.alias("block")).agg(F.array_sort(F.collect_list(F.struct("offset_value", "value_json"))).alias("rows"))
    texts = F.col("rows.value_json")
    rest = F.col("block") % 5
    variants = F.array(
        F.struct(F.lit(0).alias("v"), texts.alias("events")),
        F.when(rest == 1, F.struct(F.lit(1).alias("v"), F.concat(texts, F.slice(texts, 1, 1)).alias("events"))),
        F.when(rest == 2, F.struct(F.lit(2).alias("v"), F.slice(texts, 1, 1).alias("events"))),
        F.when(rest == 3, F.struct(F.lit(3).alias("v"), F.slice(texts, 1, 0).alias("events"))),
        F.when(rest == 4, F.struct(F.lit(4).alias("v"), F.lit(None).cast("array<string>").alias("events"))))
    return blocks.select("block", F.explode(F.array_compact(variants)).alias("b")).select(
        F.lit(BATCH_TOPIC).alias("topic"), F.lit(0).alias("partition_id"), (F.col("block") * 8 + F.col("b.v")).alias("offset_value"),
        F.coalesce(F.concat(F.lit('{"events":['), F.array_join("b.events", ","), F.lit("]}")), F.lit("{}")).alias("value_json"))


def _snapshot_envelope(table: str, key: Column, after: Column, partition: Column,
                       offset: Column) -> list[Column]:
    value = F.struct(
        F.lit("r").alias("op"),
        F.lit(SNAPSHOT_MILLIS).alias("ts_ms"),
        F.struct(F.lit(table).alias("table")).alias("source"),
        after.alias("after"),
    )
    return [
        F.lit(f"wallet.public.{table}").alias("topic"),
        partition.cast("int").alias("partition_id"),
        offset.cast("bigint").alias("offset_value"),
        F.to_json(F.struct(key.alias("id"))).alias("key_json"),
        F.to_json(value).alias("value_json"),
    ]


def _currency(nationkey: Column) -> Column:
    return F.when(nationkey % 2 == 0, F.lit("USD")).otherwise(F.lit("EUR"))


def user_envelopes(customer: DataFrame) -> DataFrame:
    ck = F.col("c_custkey")
    uid = F.concat(F.lit("u-"), ck.cast("string"))
    after = F.struct(
        uid.alias("id"),
        F.col("c_name").alias("full_name"),
        F.concat(F.lower(F.col("c_name")), F.lit("@example.com")).alias("email"),
        F.lit(SNAPSHOT_TS).alias("created_at"),
    )
    return customer.select(*_snapshot_envelope("users", uid, after, ck % 4, ck * 8))


def account_envelopes(customer: DataFrame) -> DataFrame:
    ck = F.col("c_custkey")
    aid = F.concat(F.lit("a-"), ck.cast("string"))
    money = F.col("c_acctbal").cast("decimal(18,2)").cast("string")
    after = F.struct(
        aid.alias("id"),
        F.concat(F.lit("u-"), ck.cast("string")).alias("user_id"),
        _currency(F.col("c_nationkey")).alias("currency"),
        money.alias("opening_balance"),
        money.alias("current_balance"),
        F.lit(SNAPSHOT_TS).alias("created_at"),
        F.lit(SNAPSHOT_TS).alias("updated_at"),
    )
    return customer.select(*_snapshot_envelope("accounts", aid, after, ck % 4, ck * 8 + 1))


def transaction_envelopes(orders: DataFrame, customer: DataFrame) -> DataFrame:
    """orders (+ account currency from customer) -> CDC versions.

    variant 0 create, 1 update (every 7th key), 2 delete (every 101st),
    3 record without ``op`` (every 211th), 4 null value (every 307th).
    """
    ok = F.col("o_orderkey")
    currency = customer.select(
        F.col("c_custkey").alias("o_custkey"), _currency(F.col("c_nationkey")).alias("currency"))
    occurred_ms = (F.lit(TX_EPOCH_MILLIS) + (ok % 30) * 86_400_000 + (ok % 86_400) * 1000)
    occurred_ntz = utc_wall_clock(F.timestamp_millis(occurred_ms))
    occurred_text = F.when(ok % 2 == 0, occurred_ms.cast("string")).otherwise(
        _iso(occurred_ntz, ISO_SECONDS_Z))
    v = F.col("_v")
    tx_type = _case(F.col("o_orderpriority"), PRIORITY_TYPES)
    direction = F.when(ok % 503 == 0, F.lit(None).cast("string")).when(
        tx_type.isin(*CREDIT_TYPES), F.lit("credit")).otherwise(F.lit("debit"))
    price = F.col("o_totalprice").cast("decimal(18,2)")
    amount = F.when(v == 1, (price + F.lit(1).cast("decimal(18,2)")).cast("decimal(18,2)")).otherwise(price)
    description = F.concat(F.lit("order status "), F.col("o_orderstatus"),
                           F.when(v == 1, F.lit(" (amended)")).otherwise(F.lit("")))
    after = F.struct(
        F.concat(F.lit("t-"), ok.cast("string")).alias("id"),
        F.concat(F.lit("u-"), F.col("o_custkey").cast("string")).alias("user_id"),
        F.concat(F.lit("a-"), F.col("o_custkey").cast("string")).alias("account_id"),
        tx_type.alias("type"),
        direction.alias("direction"),
        amount.cast("string").alias("amount"),
        F.col("currency"),
        description.alias("description"),
        F.concat(F.lit("merchant-"), (F.col("o_custkey") % 50).cast("string")).alias("merchant"),
        occurred_text.alias("occurred_at"),
        _iso(occurred_ntz, ISO_MILLIS_Z).alias("created_at"),
    )
    ts_ms = occurred_ms + 1000 + F.when(v == 1, F.lit(60_000)).when(v == 2, F.lit(120_000)).otherwise(F.lit(0))
    value = F.struct(
        F.when(v <= 2, _pick(v, ("c", "u", "d"))).alias("op"),
        ts_ms.alias("ts_ms"),
        F.struct(F.lit("transactions").alias("table")).alias("source"),
        F.when(v != 2, after).alias("after"),
    )
    return (
        _variants(orders.join(currency, "o_custkey", "left"), [ok % n == 0 for n in (7, 101, 211, 307)])
        .select(
            F.lit("wallet.public.transactions").alias("topic"),
            (ok % 4).cast("int").alias("partition_id"),
            (ok * 8 + v).cast("bigint").alias("offset_value"),
            F.to_json(F.struct(F.concat(F.lit("t-"), ok.cast("string")).alias("id"))).alias("key_json"),
            F.when(v != 4, F.to_json(value)).alias("value_json"),
        )
    )


def cdc_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All CDC records of the three tables as one envelope DataFrame."""
    rows = read_table(spark, sf_dir, "customer")
    customer = spread(rows, "c_custkey")
    orders = spread(read_table(spark, sf_dir, "orders"), "o_orderkey")
    return (
        user_envelopes(customer)
        .unionByName(account_envelopes(customer))
        # The join deals the customers itself.
        .unionByName(transaction_envelopes(orders, rows))
    )


def click_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clickstream_envelopes(spread(read_table(spark, sf_dir, "events"), "event_id"))
