"""Streaming ledger replay with overdraft rejection (V11, stream form).

Ledgers are dealt to groups by a digest. ``transformWithStateInPandas`` buffers
each group's rows in the state store (RocksDB) by buckets of event time and sets
a timer at every bucket's end. When the watermark passes it, the timer applies
the bucket's rows in ledger order (``occurred_at``, ``transaction_id``) to the
stored balances. The result therefore does not depend on how rows are dealt to
micro-batches, nor on their order, as long as no row is later than ``delay``: it
equals the batch replay (``operators.ledger.ledger_replay``). A row whose bucket
its account has applied is not: it comes out at once, refused with the reason
``late``, so that a caller can route it elsewhere. Rows without a time belong to
the first bucket.

A call of the processor and its few exchanges with the state store cost
milliseconds, whatever they carry: they are paid per group and bucket, not per
account and bucket. Memory holds the balances and one bucket of one group; a
stream with very many accounts or rows a bucket takes more groups. The watermark
moves with all rows of the source, also with heartbeats: rows that have a time
but neither transaction, user nor currency, which are dropped afterwards. Rows
that name no account are refused and leave no state, so an account that appears
later starts from its opening balance.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ledger import NO_AMOUNT, NO_FUNDS, REPLAY_SCHEMA, UNKNOWN_ACCOUNT, _money, owned_accounts, signed_cents

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LATE = "late"
#: Groups of ledgers: keys of the state store. A group has some thousand accounts where there are millions.
GROUPS = 1024
#: What the processor reads and writes: whole numbers travel as text, so that none becomes a float.
OUT = "transaction_id string, account_id string, occurred_us string, cents string, accepted boolean, balance string, reason string"


def _processor(bucket_ms: int):
    """Built inside a function so that workers receive it by value."""
    import json

    import pandas as pd
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    unknown, no_amount, no_funds, late = UNKNOWN_ACCOUNT, NO_AMOUNT, NO_FUNDS, LATE
    names = ["transaction_id", "account_id", "occurred_us", "cents", "accepted", "balance", "reason"]

    def text(value):
        return None if value is None or value != value else str(value)

    class LedgerFold(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            # Of each account that was seen: balance in cents and the last bucket applied.
            self.accounts = handle.getValueState("accounts", "known string")
            self.sizes = handle.getMapState("sizes", "bucket bigint", "n bigint")
            self.chunks = handle.getMapState("chunks", "bucket bigint, n bigint", "rows string")

        def handleInputRows(self, key, rows, timerValues):
            known = json.loads(self.accounts.get()[0]) if self.accounts.exists() else {}
            before = len(known)
            for pdf in rows:
                found, out = {}, []
                for row in zip(*(pdf[c] for c in ("occurred_us", "transaction_id", "cents", "account_id", "opening")), strict=True):
                    at, tid, cents, account, opening = map(text, row)
                    if account is None:
                        out.append((tid, None, at, cents, False, None, unknown))
                        continue
                    if account not in known:
                        known[account] = (int(opening), -1)
                    balance, released = known[account]
                    bucket = max(0, int(at) // (bucket_ms * 1000)) if at is not None else 0
                    if bucket <= released:
                        out.append((tid, account, at, cents, False, str(balance), late))
                    else:
                        found.setdefault(bucket, []).append((at, tid, cents, account))
                for bucket, chunk in found.items():
                    n = self.sizes.getValue((bucket,))[0] if self.sizes.containsKey((bucket,)) else 0
                    if not n:
                        self.handle.registerTimer((bucket + 1) * bucket_ms)
                    self.chunks.updateValue((bucket, n), (json.dumps(chunk),))
                    self.sizes.updateValue((bucket,), (n + 1,))
                if out:
                    yield pd.DataFrame(out, columns=names)
            if len(known) > before:
                self.accounts.update((json.dumps(known),))

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            bucket = expiredTimerInfo.getExpiryTimeInMs() // bucket_ms - 1
            rows = []
            for n in range(self.sizes.getValue((bucket,))[0]):
                rows += json.loads(self.chunks.getValue((bucket, n))[0])
                self.chunks.removeKey((bucket, n))
            self.sizes.removeKey((bucket,))
            rows.sort(key=lambda r: (r[0] is not None, int(r[0] or 0), r[1] is not None, r[1] or ""))
            known = json.loads(self.accounts.get()[0])
            out = []
            for at, tid, cents, account in rows:
                balance = known[account][0]
                ok = cents is not None and balance + int(cents) >= 0
                if ok:
                    balance += int(cents)
                known[account] = (balance, bucket)
                out.append((tid, account, at, cents, ok, str(balance), "" if ok else no_amount if cents is None else no_funds))
            self.accounts.update((json.dumps(known),))
            yield pd.DataFrame(out, columns=names)

        def close(self) -> None:
            pass

    return LedgerFold()


def ledger_replay_stream(transactions: DataFrame, accounts: DataFrame, delay: str = "1 hour",
                         bucket_seconds: int = 3600, groups: int = GROUPS) -> DataFrame:
    """Streaming transactions (silver columns) + static accounts -> replayed
    rows (``REPLAY_SCHEMA``), by ``groups`` of ledgers, a number that a
    checkpoint keeps. The state store must be RocksDB
    (``use_rocksdb_state(spark)``) before the query starts."""
    heartbeat = F.col("transaction_id").isNull() & F.col("user_id").isNull() & F.col("currency").isNull()
    # It names the time, so that the optimizer cannot drop the rows before they have moved the watermark.
    heartbeat = heartbeat & F.col("occurred_at").isNotNull()
    timed = transactions.withWatermark("occurred_at", delay).filter(~heartbeat)
    # Times as numbers: rows behind the watermark must reach the processor, which tells the late ones.
    rows = timed.select("transaction_id", "user_id", "currency", F.unix_micros("occurred_at").cast("string").alias("occurred_us"),
                        signed_cents().cast("string").alias("cents"))
    owned = owned_accounts(accounts).withColumn("opening", F.col("opening").cast("string"))
    # Rows without an account are spread over the groups by their own id.
    key = F.coalesce(F.concat(F.lit("a"), "account_id"), F.concat(F.lit("t"), "transaction_id"), F.lit("-"))
    keyed = rows.join(owned, ["user_id", "currency"], "left").withColumn("ledgers", F.pmod(F.xxhash64(key), F.lit(groups)).cast("int"))
    replayed = keyed.groupBy("ledgers").transformWithStateInPandas(_processor(bucket_seconds * 1000), OUT, "Append", "EventTime")
    return replayed.select(
        "transaction_id", "account_id", F.timestamp_micros(F.col("occurred_us").cast("bigint")).alias("occurred_at"),
        _money(F.col("cents").cast("decimal(38,0)")).alias("signed"), "accepted",
        _money(F.col("balance").cast("decimal(38,0)")).alias("balance_after"), "reason").to(REPLAY_SCHEMA)


STORE = "spark.sql.streaming.stateStore.providerClass"


def state_partitions(spark) -> int:
    """State stores for a new query: three per core, at most ``spark.sql.shuffle.partitions``.

    AQE does not join partitions of a stateful query, and each one opens, commits and uploads a RocksDB store
    in every micro-batch, however few rows it has. A checkpoint keeps the number it was started with."""
    return min(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)


def use_rocksdb_state(spark) -> str | None:
    """transformWithState needs the RocksDB state store provider while a query
    starts. Returns the one set before, for ``restore_state_store``."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKSDB)
    return before


def restore_state_store(spark, before: str | None) -> None:
    if before is None:
        spark.conf.unset(STORE)
    else:
        spark.conf.set(STORE, before)
