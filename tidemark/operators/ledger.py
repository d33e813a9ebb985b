"""Ledger rules re-aimed from the wallet service.

A ledger is the transactions of one (user, currency), which names an account,
in the order ``occurred_at, transaction_id``. Running balances (V10) and the
replay with overdraft rejection (V11) cut the sorted rows of all ledgers into
ranges, so that one hot ledger is many ranges; amounts are whole cents.

Whether the replay accepts a row depends on every earlier decision, but most
ranges of a ledger can be decided by two numbers, their total and their least
prefix sum. A balance that is not negative stays so, and a refused debit only
leaves it higher than a plain sum would. A lower bound of the balance before
each range is therefore the sum that is pushed back to zero wherever it would
fall below; it is a maximum of prefix sums, one small window per ledger. A
range whose least prefix sum stays above it refuses nothing and needs its
total only. The other ranges go row by row through a fold, between the totals
of the ranges around them, in one ordered pass per ledger with bounded memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.scans import ranged
from tidemark.session import stored

MONEY = "decimal(18,2)"
#: Sums of cents: exact for more rows than any ledger has.
CENTS = "decimal(30,0)"
# Transaction types by direction.
CREDIT_TYPES = ("deposit", "transfer_in")
DEBIT_TYPES = ("withdrawal", "payment", "transfer_out")
TRANSACTION_TYPES = CREDIT_TYPES + DEBIT_TYPES
# Why a row has no balance or was refused.
UNKNOWN_ACCOUNT, NO_FUNDS, NO_AMOUNT = "unknown_account", "insufficient_funds", "no_amount"
LEDGER = ["user_id", "currency"]


def direction_for_type(type_col: Column) -> Column:
    """deposit/transfer_in -> credit; withdrawal/payment/transfer_out -> debit;
    anything else -> NULL (V5)."""
    return (F.when(type_col.isin(*CREDIT_TYPES), F.lit("credit"))
            .when(type_col.isin(*DEBIT_TYPES), F.lit("debit")))


def tx_direction(transactions: DataFrame) -> DataFrame:
    derived = direction_for_type(F.col("type"))
    return transactions.select(
        "transaction_id", "type", "direction",
        derived.alias("derived_direction"),
        derived.isNull().alias("unknown_type"),
        F.col("direction").eqNullSafe(derived).alias("consistent"),
    )


def signed_amount() -> Column:
    """Credit adds, anything else subtracts (as in the balance mart)."""
    return F.when(F.col("direction") == "credit", F.col("amount")).otherwise(-F.col("amount"))


def opening_balance() -> Column:
    """A known account's opening balance; NULL or out of range counts as zero."""
    return F.coalesce(F.col("opening_balance").try_cast(MONEY), F.lit(0).cast(MONEY))


def signed_cents() -> Column:
    return (signed_amount().try_cast(MONEY) * 100).cast("bigint")


def owned_accounts(accounts: DataFrame) -> DataFrame:
    """The account of each (user, currency): the earliest created one, ties by account id, NULL creation times last."""
    first = F.min(F.struct(F.col("created_at").isNull(), "created_at", "account_id", opening_balance().alias("opening")))
    known = accounts.filter(F.col("account_id").isNotNull() & F.col("user_id").isNotNull() & F.col("currency").isNotNull())
    return known.groupBy("user_id", "currency").agg(first.alias("_first")).select(
        "user_id", "currency", "_first.account_id", (F.col("_first.opening") * 100).cast("bigint").alias("opening"))


def resolve_accounts(transactions: DataFrame, accounts: DataFrame) -> DataFrame:
    """The account that each transaction's (user, currency) names. ``reason`` is
    ``unknown_account`` where there is none, else empty; ``consistent`` tells
    whether the account recorded on the row is the one found. One row per
    (user, currency) takes part in the join."""
    owned = owned_accounts(accounts).select("user_id", "currency", F.col("account_id").alias("resolved_account_id"))
    return transactions.select("transaction_id", "account_id", "user_id", "currency").join(
        owned, ["user_id", "currency"], "left").select(
        "transaction_id", "account_id", "user_id", "currency", "resolved_account_id",
        F.when(F.col("resolved_account_id").isNull(), F.lit(UNKNOWN_ACCOUNT))
        .otherwise(F.lit("")).alias("reason"),
        F.col("account_id").eqNullSafe(F.col("resolved_account_id")).alias("consistent"))


def first_account(accounts: DataFrame) -> DataFrame:
    """Each user's first account by ``created_at`` (ties: account id) (V7).
    A min over a struct: partial aggregation, no window over the user."""
    best = F.min(F.struct(
        F.col("created_at").isNull().alias("_late"),  # NULL creation times last
        "created_at", "account_id", "currency", "opening_balance", "current_balance"))
    return accounts.groupBy("user_id").agg(best.alias("_b")).select(
        "user_id", "_b.account_id", "_b.currency", "_b.opening_balance",
        "_b.current_balance", "_b.created_at")


def recent_transactions(transactions: DataFrame, n: int = 50) -> DataFrame:
    """Latest ``n`` transactions per user, newest first (V8; n in 1..100).

    ``row_number() <= n`` lets Catalyst insert a partial WindowGroupLimit
    before the shuffle, so each map task ships at most ``n`` rows per user.
    """
    if not 1 <= n <= 100:
        raise ValueError("n must be between 1 and 100")
    w = Window.partitionBy("user_id").orderBy(
        F.col("created_at").desc_nulls_last(), F.col("transaction_id").desc())
    return (
        transactions.withColumn("rank", F.row_number().over(w).cast("bigint"))
        .filter(F.col("rank") <= n)
        .select("user_id", "transaction_id", "created_at", "amount", "direction", "rank")
    )


def list_users(users: DataFrame) -> DataFrame:
    """Users ordered by creation, ties by id (V9): a range-partitioned sort."""
    return users.select("user_id", "full_name", "email", "created_at").orderBy(
        F.col("created_at").asc_nulls_first(), F.col("user_id").asc_nulls_first())


def _ledger_rows(transactions: DataFrame, label: str) -> DataFrame:
    """The rows of all ledgers in ranges, with running sums of cents inside each; NULL keys are a ledger of no account."""
    rows = transactions.select("transaction_id", *LEDGER, "occurred_at", signed_cents().alias("cents"))
    # The cut into ranges reads its rows twice (a sample of the keys, then all): from a table, not from the plan behind it.
    rows = stored(rows, f"{label}_rows")
    order = [F.col("occurred_at").asc_nulls_first(), F.col("transaction_id").asc_nulls_first()]
    return ranged(rows, LEDGER, order, F.sum(F.col("cents").cast("decimal(20,0)")), label)


def _range_totals(rows: DataFrame, accounts: DataFrame) -> DataFrame:
    """One row per ledger and range: total, least prefix sum, greatest amount, account and opening balance,
    and ``before``, the total of the ledger's earlier ranges."""
    ranges = rows.groupBy(*LEDGER, "_part").agg(
        F.coalesce(F.sum(F.col("cents").cast("decimal(20,0)")), F.lit(0)).cast(CENTS).alias("total"),
        F.coalesce(F.min("_prefix"), F.lit(0)).cast(CENTS).alias("least"),
        F.max("cents").alias("most"))
    earlier = Window.partitionBy(*LEDGER).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return ranges.join(owned_accounts(accounts), LEDGER, "left").withColumn(
        "before", F.coalesce(F.sum("total").over(earlier), F.lit(0)).cast(CENTS))


def _same_range(a: DataFrame, b: DataFrame) -> Column:
    return (a["_part"] == b["_part"]) & a["user_id"].eqNullSafe(b["user_id"]) & a["currency"].eqNullSafe(b["currency"])


def _money(cents: Column) -> Column:
    return (cents.cast("decimal(38,2)") / 100).try_cast(MONEY)


def ledger_running_balance(transactions: DataFrame, accounts: DataFrame) -> DataFrame:
    """``balance_after`` = opening + running signed sum in ledger order (V10);
    NULL, with the reason ``unknown_account``, where (user, currency) names no account.

    The rows are sorted into ranges and written once; only one row per ledger
    and range takes part in the scan over a ledger and in the join."""
    rows = _ledger_rows(transactions, "running_balance")
    totals = _range_totals(rows, accounts).select(*LEDGER, "_part", "account_id", (F.col("opening") + F.col("before")).alias("start"))
    after = F.col("start") + F.coalesce("_prefix", F.lit(0))
    return rows.join(totals, _same_range(rows, totals)).select(
        "transaction_id", "account_id", "occurred_at", _money(after).alias("balance_after"),
        F.when(F.col("account_id").isNull(), F.lit(UNKNOWN_ACCOUNT)).otherwise(F.lit("")).alias("reason"))


REPLAY_SCHEMA = T.StructType([
    T.StructField("transaction_id", T.StringType()),
    T.StructField("account_id", T.StringType()),
    T.StructField("occurred_at", T.TimestampType()),
    T.StructField("signed", T.DecimalType(18, 2)),
    T.StructField("accepted", T.BooleanType()),
    T.StructField("balance_after", T.DecimalType(18, 2)),
    T.StructField("reason", T.StringType()),
])

# How a range is decided.
PLAIN, ASLEEP, ROWS, UNKNOWN = "plain", "asleep", "rows", "unknown"


def range_decisions(rows: DataFrame, accounts: DataFrame) -> DataFrame:
    """``_range_totals`` with ``how`` each range is decided.

    A ledger that opens below zero is asleep until an amount lifts it to zero
    or more: ranges before that one refuse everything."""
    w = Window.partitionBy(*LEDGER).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    lifted = F.coalesce(F.max("most").over(w) >= -F.col("opening"), F.lit(False))
    ranges = _range_totals(rows, accounts).withColumn("awake", (F.col("opening") >= 0) | lifted)
    ranges = ranges.withColumn("wakes", ~F.col("awake") & F.coalesce(F.col("most") >= -F.col("opening"), F.lit(False)))
    # After a range the bound is total + max(bound before it, its shortfall); less the totals so far, a running maximum.
    bound = (F.when(F.col("awake"), F.greatest(-F.col("least"), F.lit(0)) - F.col("before"))
             .when(F.col("wakes"), -(F.col("before") + F.col("total"))))
    floor = F.greatest(F.max(bound).over(w), F.when(F.col("opening") >= 0, F.col("opening").cast(CENTS)))
    how = (F.when(F.col("opening").isNull(), F.lit(UNKNOWN))
           .when(F.col("wakes"), F.lit(ROWS))
           .when(~F.col("awake"), F.lit(ASLEEP))
           .when(F.col("before") + F.col("floor") + F.col("least") >= 0, F.lit(PLAIN))
           .otherwise(F.lit(ROWS)))
    return ranges.withColumn("bound", bound).withColumn("floor", floor).withColumn("how", how).drop("awake", "wakes", "bound", "floor")


FOLDED = ("user_id string, currency string, _part int, transaction_id string, account_id string, occurred_at timestamp, "
          "cents bigint, accepted boolean, balance decimal(38,0)")


def _fold():
    """The fold over rows sorted by (ledger, range, place); a row without a place is a range's opening balance
    (the first) or total, and answers with the balance before it.

    Built inside a function so that it is shipped to the Python workers by
    value: the workers need pyarrow, not this package."""
    import decimal

    import pyarrow as pa

    def fold(batches):
        ledger, balance = None, 0
        for batch in batches:
            keep, accepted, after = [], [], []
            columns = (batch.column(batch.schema.get_field_index(c)).to_pylist()
                       for c in ("user_id", "currency", "_part", "_at", "cents", "total"))
            for row, (user, currency, part, at, cents, total) in enumerate(zip(*columns, strict=True)):
                if (user, currency) != ledger or part < 0:
                    ledger, balance = (user, currency), int(total)
                    continue
                keep.append(row)
                if at is None:
                    accepted.append(None)
                    after.append(balance)
                    balance += int(total)
                    continue
                ok = cents is not None and balance + cents >= 0
                if ok:
                    balance += cents
                accepted.append(ok)
                after.append(balance)
            kept = batch.take(pa.array(keep, pa.int64()))
            names = ["user_id", "currency", "_part", "transaction_id", "account_id", "occurred_at", "cents"]
            columns = [kept.column(kept.schema.get_field_index(c)) for c in names]
            columns += [pa.array(accepted, pa.bool_()), pa.array([decimal.Decimal(b) for b in after], pa.decimal128(38, 0))]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "accepted", "balance"])

    return fold


def ledger_replay(transactions: DataFrame, accounts: DataFrame) -> DataFrame:
    """Replay every ledger rejecting overdrafts (V11): a row is accepted when
    ``balance + signed >= 0``; a refused row leaves the balance unchanged and
    tells the ``reason``. The account is the one that (user, currency) names;
    rows that name none are refused with a NULL account and balance, rows
    without an amount are refused as well."""
    rows = _ledger_rows(transactions, "replay")
    ranges = stored(range_decisions(rows, accounts), "replay_ranges")

    # Ledgers of which every range is decided need no fold: the balance before a range is the plain sum.
    folded_ledgers = ranges.filter(F.col("how") == ROWS).select(*LEDGER).distinct()
    at, nothing = F.lit(None).cast("bigint"), F.lit(None)
    inside = ranges.join(folded_ledgers, LEDGER, "left_semi")
    marks = inside.filter(F.col("how") != ROWS).select(
        *LEDGER, "_part", at.alias("_at"), nothing.cast("string").alias("transaction_id"), "account_id",
        nothing.cast("timestamp").alias("occurred_at"), nothing.cast("bigint").alias("cents"),
        F.when(F.col("how") == PLAIN, F.col("total")).otherwise(F.lit(0)).cast(CENTS).alias("total"))
    openings = inside.groupBy(*LEDGER).agg(F.max("opening").alias("opening"), F.max("account_id").alias("account_id")).select(
        *LEDGER, F.lit(-1).alias("_part"), at.alias("_at"), nothing.cast("string").alias("transaction_id"), "account_id",
        nothing.cast("timestamp").alias("occurred_at"), nothing.cast("bigint").alias("cents"), F.col("opening").cast(CENTS).alias("total"))
    single = ranges.filter(F.col("how") == ROWS).select(*LEDGER, "_part", "account_id")
    each = rows.join(single, [*LEDGER, "_part"]).select(
        *LEDGER, "_part", "_at", "transaction_id", "account_id", "occurred_at", "cents", nothing.cast(CENTS).alias("total"))
    ordered = openings.unionByName(marks).unionByName(each).repartition(*LEDGER).sortWithinPartitions(*LEDGER, "_part", "_at")
    folded = stored(ordered.mapInArrow(_fold(), FOLDED), "replay_folded")

    starts = folded.filter(F.col("accepted").isNull()).select(*LEDGER, "_part", F.col("balance").alias("found"))
    plain = F.when(F.col("how") == PLAIN, F.col("opening") + F.col("before")).when(F.col("how") == ASLEEP, F.col("opening"))
    known = ranges.filter(F.col("how") != ROWS)
    known = known.join(starts, _same_range(known, starts), "left").select(
        known["user_id"], known["currency"], known["_part"], "account_id", "how",
        F.coalesce("found", plain).cast("decimal(38,0)").alias("start"))
    decided = rows.join(known, _same_range(rows, known)).select(
        "transaction_id", "account_id", "occurred_at", "cents",
        ((F.col("how") == PLAIN) & F.col("cents").isNotNull()).alias("accepted"),
        (F.col("start") + F.when(F.col("how") == PLAIN, F.coalesce("_prefix", F.lit(0))).otherwise(F.lit(0))).alias("balance"))
    both = decided.unionByName(folded.filter(F.col("accepted").isNotNull()).select(*decided.columns))
    reason = (F.when(F.col("accepted"), F.lit("")).when(F.col("account_id").isNull(), F.lit(UNKNOWN_ACCOUNT))
              .when(F.col("cents").isNull(), F.lit(NO_AMOUNT)).otherwise(F.lit(NO_FUNDS)))
    return both.select("transaction_id", "account_id", "occurred_at", _money(F.col("cents")).alias("signed"),
                       "accepted", _money(F.col("balance")).alias("balance_after"), reason.alias("reason"))


def income_spend(transactions: DataFrame) -> DataFrame:
    """Per user: income = credits, spend = everything else incl. NULL."""
    credit = F.col("direction") == "credit"
    return transactions.groupBy("user_id").agg(
        F.sum(F.when(credit, F.col("amount")).otherwise(F.lit(0))).try_cast(MONEY).alias("income"),
        F.sum(F.when(credit, F.lit(0)).otherwise(F.col("amount"))).try_cast(MONEY).alias("spend"),
        F.count(F.lit(1)).alias("transactions"),
    )
