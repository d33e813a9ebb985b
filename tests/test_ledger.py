import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from helpers import ACCOUNT_SCHEMA, TX_SCHEMA, frame
from tidemark.operators import ledger


def test_direction_mapping(utc):
    df = utc.createDataFrame([("deposit",), ("payment",), ("transfer_in",), ("transfer_out",), ("withdrawal",), ("gift",)], "type string")
    got = [r.d for r in df.select(ledger.direction_for_type(F.col("type")).alias("d")).collect()]
    assert got == ["credit", "debit", "credit", "debit", "debit", None]


def _accounts(spark, opening):
    return frame(spark, ACCOUNT_SCHEMA, [{"account_id": a, "user_id": "u-" + a, "currency": "USD",
                                          "opening_balance": Decimal(v)} for a, v in opening.items()])


def _txs(spark, rows):
    t0 = datetime(2026, 5, 1)
    return frame(spark, TX_SCHEMA, [
        {"transaction_id": tid, "account_id": acc, "user_id": "u-" + acc, "currency": "USD", "direction": d,
         "amount": None if a is None else Decimal(a), "occurred_at": t0 + timedelta(hours=h), "created_at": t0 + timedelta(hours=h)}
        for tid, acc, d, a, h in rows])


def test_overdraft_rejected_and_balance_unchanged(utc):
    acc = _accounts(utc, {"A": "100.00"})
    tx = _txs(utc, [("t1", "A", "debit", "999999.00", 1), ("t2", "A", "credit", "25.00", 2),
                    ("t3", "A", "debit", "125.00", 3), ("t4", "A", "debit", "0.01", 4)])
    got = {r.transaction_id: (r.accepted, r.balance_after) for r in ledger.ledger_replay(tx, acc).collect()}
    assert got == {"t1": (False, Decimal("100.00")), "t2": (True, Decimal("125.00")),
                   "t3": (True, Decimal("0.00")), "t4": (False, Decimal("0.00"))}


def test_negative_opening_rejects_small_credit(utc):
    acc = _accounts(utc, {"A": "-50.00"})
    tx = _txs(utc, [("t1", "A", "credit", "20.00", 1), ("t2", "A", "credit", "60.00", 2)])
    got = {r.transaction_id: (r.accepted, r.balance_after) for r in ledger.ledger_replay(tx, acc).collect()}
    assert got == {"t1": (False, Decimal("-50.00")), "t2": (True, Decimal("10.00"))}


def test_unknown_account_is_refused(utc):
    acc = frame(utc, ACCOUNT_SCHEMA, [
        {"account_id": "A", "user_id": "u-A", "currency": "USD", "opening_balance": None}])
    tx = _txs(utc, [("t1", "A", "credit", "5.00", 1), ("t2", "X", "credit", "7.00", 1), ("t3", "X", "debit", "1.00", 2)])
    got = {r.transaction_id: (r.accepted, r.balance_after) for r in ledger.ledger_replay(tx, acc).collect()}
    assert got == {"t1": (True, Decimal("5.00")), "t2": (False, None), "t3": (False, None)}


def test_accounts_resolve_by_user_and_currency(utc):
    t = datetime(2026, 3, 1)
    acc = frame(utc, ACCOUNT_SCHEMA, [
        {"account_id": "late", "user_id": "u", "currency": "USD", "created_at": t + timedelta(days=1)},
        {"account_id": "first", "user_id": "u", "currency": "USD", "created_at": t},
        {"account_id": "undated", "user_id": "u", "currency": "USD", "created_at": None},
        {"account_id": "tie-b", "user_id": "v", "currency": "EUR", "created_at": t},
        {"account_id": "tie-a", "user_id": "v", "currency": "EUR", "created_at": t}])
    tx = frame(utc, TX_SCHEMA, [
        {"transaction_id": "1", "user_id": "u", "currency": "USD", "account_id": "late"},
        {"transaction_id": "2", "user_id": "u", "currency": "EUR", "account_id": "late"},
        {"transaction_id": "3", "user_id": "v", "currency": "EUR", "account_id": "tie-a"},
        {"transaction_id": "4", "user_id": None, "currency": "EUR", "account_id": None}])
    got = {r.transaction_id: (r.resolved_account_id, r.reason, r.consistent)
           for r in ledger.resolve_accounts(tx, acc).collect()}
    assert got == {"1": ("first", "", False), "2": (None, "unknown_account", False),
                   "3": ("tie-a", "", True), "4": (None, "unknown_account", True)}


def _brute_replay(opening, rows):
    out = {}
    for acc in sorted({r[1] for r in rows}):
        bal = Decimal(opening[acc]) if acc in opening else None
        for tid, _, d, a, h in sorted((r for r in rows if r[1] == acc), key=lambda r: (r[4], r[0])):
            signed = None if a is None else Decimal(a) if d == "credit" else -Decimal(a)
            ok = bal is not None and signed is not None and bal + signed >= 0
            bal = bal + signed if ok else bal
            out[tid] = (ok, bal)
    return out


def _random_ledger(seed, n, hours):
    rnd = random.Random(seed)
    opening = {a: f"{rnd.randint(-400, 900)}.00" for a in "ABCDEFG"}
    opening["H"], opening["I"] = "-30.00", "-100000.00"
    rows = [(f"t{i:05d}", rnd.choice("AAAAAABCDEFGHIX"), rnd.choice(["credit", "debit", "debit"]),
             None if rnd.random() < 0.02 else f"{rnd.randint(0, 90)}.{rnd.randint(0, 99):02d}", rnd.randint(0, hours)) for i in range(n)]
    return opening, rows


@pytest.fixture
def small_ranges(utc):
    """Ranges are not joined again, so that a ledger of a few hundred rows has many."""
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "24",
                "spark.sql.execution.arrow.maxRecordsPerBatch": "37"}
    old = {k: utc.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        utc.conf.set(k, v)
    yield utc
    for k, v in old.items():
        utc.conf.unset(k) if v is None else utc.conf.set(k, v)


@pytest.mark.parametrize("seed,hours", [(1, 500), (2, 0), (3, 40)])
def test_replay_over_many_ranges_matches_brute_force(small_ranges, seed, hours):
    opening, rows = _random_ledger(seed, 1500, hours)
    found = ledger.ledger_replay(_txs(small_ranges, rows), _accounts(small_ranges, opening)).collect()
    assert {r.transaction_id: (r.accepted, r.balance_after) for r in found} == _brute_replay(opening, rows)
    reasons = {r.reason for r in found}
    assert reasons == {"", "insufficient_funds", "unknown_account", "no_amount"}


def test_all_kinds_of_ranges_occur(small_ranges):
    opening, rows = _random_ledger(1, 1500, 500)
    rows += [(f"z{i}", "D", "credit", "5.00", 600 + i) for i in range(300)]
    decided = ledger.range_decisions(ledger._ledger_rows(_txs(small_ranges, rows), "kinds"), _accounts(small_ranges, opening))
    assert {r.how for r in decided.select("how").distinct().collect()} == {ledger.PLAIN, ledger.ASLEEP, ledger.ROWS, ledger.UNKNOWN}


def test_a_hot_ledger_without_refusals_is_spread_over_tasks(small_ranges):
    """Two thirds of all rows on one ledger, half of them at one instant: no range holds a quarter, and none is folded."""
    rows = [(f"t{i:05d}", "hot" if i % 3 else f"c{i % 50}", "credit" if i % 2 else "debit", f"{i % 7}.00", 0 if i % 2 else i)
            for i in range(6000)]
    opening = {acc: "100000.00" for acc in {r[1] for r in rows}}
    accounts = _accounts(small_ranges, opening)
    placed = ledger._ledger_rows(_txs(small_ranges, rows), "hot")
    sizes = [r["count"] for r in placed.groupBy("_part").count().collect()]
    assert max(sizes) < 0.25 * len(rows)
    assert {r.how for r in ledger.range_decisions(placed, accounts).collect()} == {ledger.PLAIN}
    got = {r.transaction_id: (r.accepted, r.balance_after) for r in ledger.ledger_replay(_txs(small_ranges, rows), accounts).collect()}
    assert got == _brute_replay(opening, rows)


def test_the_account_is_the_one_that_user_and_currency_name(utc):
    t = datetime(2026, 3, 1)
    acc = frame(utc, ACCOUNT_SCHEMA, [
        {"account_id": "late", "user_id": "u", "currency": "USD", "opening_balance": Decimal("900.00"), "created_at": t + timedelta(days=1)},
        {"account_id": "first", "user_id": "u", "currency": "USD", "opening_balance": Decimal("10.00"), "created_at": t}])
    tx = frame(utc, TX_SCHEMA, [
        {"transaction_id": i, "user_id": "u", "currency": c, "account_id": "late", "direction": "debit", "amount": Decimal("11.00"), "occurred_at": t}
        for i, c in (("1", "USD"), ("2", "EUR"), ("3", None))])
    got = {r.transaction_id: (r.account_id, r.accepted, r.balance_after, r.reason) for r in ledger.ledger_replay(tx, acc).collect()}
    assert got == {"1": ("first", False, Decimal("10.00"), "insufficient_funds"), "2": (None, False, None, "unknown_account"),
                   "3": (None, False, None, "unknown_account")}
    got = {r.transaction_id: (r.account_id, r.balance_after, r.reason) for r in ledger.ledger_running_balance(tx, acc).collect()}
    assert got == {"1": ("first", Decimal("-1.00"), ""), "2": (None, None, "unknown_account"), "3": (None, None, "unknown_account")}


def test_running_balance_matches_brute_force(utc):
    rnd = random.Random(5)
    opening = {a: f"{rnd.randint(0, 100)}.00" for a in "ABC"}
    rows = [(f"t{i:04d}", rnd.choice("AAAB"), rnd.choice(["credit", "debit"]),
             f"{rnd.randint(1, 50)}.00", rnd.randint(0, 24 * 20)) for i in range(600)]
    got = {r.transaction_id: r.balance_after
           for r in ledger.ledger_running_balance(_txs(utc, rows), _accounts(utc, opening)).collect()}
    expected = {}
    for acc in "ABC":
        bal = Decimal(opening[acc])
        for tid, _, d, a, h in sorted((r for r in rows if r[1] == acc), key=lambda r: (r[4], r[0])):
            bal += Decimal(a) if d == "credit" else -Decimal(a)
            expected[tid] = bal
    assert got == expected


def test_recent_transactions_limit_and_order(utc):
    tx = _txs(utc, [(f"t{i}", "A", "debit", "1.00", i) for i in range(10)])
    rows = ledger.recent_transactions(tx, 3).orderBy("rank").collect()
    assert [r.transaction_id for r in rows] == ["t9", "t8", "t7"]


def test_first_account_and_income_spend(utc):
    acc = frame(utc, ACCOUNT_SCHEMA, [
        {"account_id": "b", "user_id": "u", "currency": "EUR", "created_at": datetime(2026, 1, 2)},
        {"account_id": "a", "user_id": "u", "currency": "USD", "created_at": datetime(2026, 1, 3)},
        {"account_id": "c", "user_id": "u", "currency": "USD", "created_at": None},
    ])
    assert ledger.first_account(acc).first().account_id == "b"
    tx = frame(utc, TX_SCHEMA, [
        {"user_id": "u", "direction": "credit", "amount": Decimal("10.00")},
        {"user_id": "u", "direction": "debit", "amount": Decimal("3.00")},
        {"user_id": "u", "direction": None, "amount": Decimal("2.00")},
    ])
    r = ledger.income_spend(tx).first()
    assert (r.income, r.spend, r.transactions) == (Decimal("10.00"), Decimal("5.00"), 3)


def test_the_plan_behind_the_transactions_runs_once(spark):
    """the sample behind the ranges reads written rows and does not build the transactions again."""
    built = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            built.add(batch.num_rows)
            yield batch

    tx = spark.createDataFrame([(f"t{i}", f"u{i % 3}", "EUR", datetime(2026, 1, 1 + i % 9), "credit", Decimal(i)) for i in range(60)],
                               "transaction_id string, user_id string, currency string, occurred_at timestamp, direction string, amount decimal(18,2)")
    accounts = spark.createDataFrame([(f"a{i}", f"u{i}", "EUR", Decimal(0), datetime(2025, 1, 1)) for i in range(3)],
                                     "account_id string, user_id string, currency string, opening_balance decimal(18,2), created_at timestamp")
    assert ledger.ledger_replay(tx.mapInArrow(count, tx.schema), accounts).count() == 60
    assert built.value == 60
