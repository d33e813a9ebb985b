import random
from datetime import date
from decimal import Decimal

from helpers import ACCOUNT_SCHEMA, EVENT_SCHEMA, TX_SCHEMA, frame
from tidemark.operators import marts

D = date(2026, 5, 22)


def _events(spark, rows):
    return frame(spark, EVENT_SCHEMA, rows)


def _tx(spark, rows):
    return frame(spark, TX_SCHEMA, rows)


def _random_days(seed, n=300):
    """Events and transactions of a few users over a week, with NULLs in every column that may hold one."""
    rnd = random.Random(seed)
    days = [date(2025, 11, d) for d in range(3, 10)]
    events = [{"dt": rnd.choice(days), "user_id": rnd.choice(["ann", "bob", "cy", None]), "analytics_session_id": rnd.choice(["v1", "v2", "v3", None]),
               "event_type": rnd.choice(["page_enter", "page_leave", "click", None]), "page": rnd.choice(["/a", "/b"]),
               "element_id": rnd.choice([*marts.FUNNEL_CTA_IDS, "help", None]), "dwell_ms": rnd.choice([None, 0, 40, 1700])} for _ in range(n)]
    txs = [{"dt": rnd.choice([*days, date(2025, 12, 1)]), "user_id": rnd.choice(["ann", "dee", None]), "currency": rnd.choice(["EUR", None]),
            "account_id": rnd.choice(["A", "B", "Z", None]), "direction": rnd.choice(["credit", "debit", None]),
            "amount": rnd.choice([None, Decimal("0.10"), Decimal("75.05")]), "transaction_id": str(i)} for i in range(n // 2)]
    return events, txs


def _money(txs, **wanted):
    return sum((t["amount"] or Decimal(0) for t in txs if all(t[k] == v for k, v in wanted.items())), Decimal("0.00"))


def test_funnel_equals_plain_counts(utc):
    events, txs = _random_days(1)
    found = {r.dt: tuple(r)[1:] for r in marts.conversion_funnel_daily(_events(utc, events), _tx(utc, txs)).collect()}
    want = {}
    for day in {r["dt"] for r in events + txs}:
        own = [e for e in events if e["dt"] == day]
        views = sum(e["event_type"] == "page_enter" for e in own)
        wishes = sum(e["event_type"] == "click" and e["element_id"] in marts.FUNNEL_CTA_IDS for e in own)
        created = sum(t["dt"] == day for t in txs)
        want[day] = (views, wishes, created, created / views if views else 0.0)
    assert found == want
    per_cta = {(r.dt, r.element_id): (r.clicks, r.users) for r in marts.conversion_funnel_cta_daily(_events(utc, events)).collect()}
    clicks = [e for e in events if e["event_type"] == "click" and e["element_id"] in marts.FUNNEL_CTA_IDS]
    assert per_cta == {k: (sum((e["dt"], e["element_id"]) == k for e in clicks),
                           len({e["user_id"] for e in clicks if (e["dt"], e["element_id"]) == k} - {None}))
                       for k in {(e["dt"], e["element_id"]) for e in clicks}}


def test_funnel_day_with_transactions_only_has_rate_zero(utc):
    ev = _events(utc, [{"dt": D, "user_id": "u", "analytics_session_id": "s", "event_type": "page_enter"}])
    tx = _tx(utc, [{"dt": date(2026, 5, 23), "transaction_id": "t1"}, {"dt": None, "transaction_id": "t2"}])
    got = {r.dt: (r.page_views, r.transactions_created, r.conversion_rate)
           for r in marts.conversion_funnel_daily(ev, tx).collect()}
    assert got == {D: (1, 0, 0.0), date(2026, 5, 23): (0, 1, 0.0), None: (0, 0, 0.0)}


def test_balances_equal_plain_sums(utc):
    _, txs = _random_days(2)
    acc = frame(utc, ACCOUNT_SCHEMA, [
        {"account_id": a, "user_id": "u" + a, "currency": "EUR", "opening_balance": o}
        for a, o in (("A", Decimal("-3.00")), ("B", None), ("quiet", Decimal("8.00")))])
    found = {r.account_id: (r.balance, r.transactions_count) for r in marts.current_balances(acc, _tx(utc, txs)).collect()}
    want = {}
    for account, opening in (("A", Decimal("-3.00")), ("B", Decimal("0.00")), ("quiet", Decimal("8.00"))):
        plus, every = _money(txs, account_id=account, direction="credit"), _money(txs, account_id=account)
        want[account] = (opening + 2 * plus - every, sum(t["account_id"] == account for t in txs))
    assert found == want


def test_a_balance_beyond_the_type_is_null(utc):
    acc = frame(utc, ACCOUNT_SCHEMA, [{"account_id": "A", "user_id": "u", "currency": "EUR", "opening_balance": Decimal("9999999999999999.99")}])
    tx = _tx(utc, [{"transaction_id": "t", "account_id": "A", "direction": "credit", "amount": Decimal("0.01")}])
    assert marts.current_balances(acc, tx).first().balance is None


def test_null_direction_subtracted_in_balance_but_in_neither_volume_sum(utc):
    acc = frame(utc, ACCOUNT_SCHEMA, [{"account_id": "a", "user_id": "u", "currency": "USD",
                                       "opening_balance": Decimal("10.00")}])
    tx = _tx(utc, [{"transaction_id": "t", "account_id": "a", "user_id": "u", "currency": "USD",
                    "dt": D, "direction": None, "amount": Decimal("3.00")}])
    assert marts.current_balances(acc, tx).first().balance == Decimal("7.00")
    v = marts.transaction_volume_daily(tx).first()
    assert (v.credit_amount, v.debit_amount, v.transaction_count) == (Decimal("0.00"), Decimal("0.00"), 1)


def test_engagement_equals_plain_counts_of_both_sides(utc):
    events, txs = _random_days(3)
    found = {(r.dt, r.user_id): tuple(r)[2:] for r in marts.user_engagement_daily(_events(utc, events), _tx(utc, txs)).collect()}
    want = {}
    for day, user in {(r["dt"], r["user_id"]) for r in events + txs if r["user_id"]}:
        seen = [e for e in events if (e["dt"], e["user_id"]) == (day, user)]
        paid = [t for t in txs if (t["dt"], t["user_id"]) == (day, user)]
        want[day, user] = (
            len({e["analytics_session_id"] for e in seen} - {None}), sum(e["dwell_ms"] or 0 for e in seen),
            sum(e["event_type"] == "page_enter" for e in seen), sum(e["event_type"] == "click" for e in seen),
            len(paid), _money(paid, direction="debit"), _money(paid, direction="credit"))
    assert found == want
    assert any(v[0] and not v[4] for v in want.values()) and any(v[4] and not v[0] for v in want.values())


def test_page_engagement_counts_null_dwell_as_zero(utc):
    ev = _events(utc, [
        {"dt": D, "page": "/p", "analytics_session_id": "s1", "dwell_ms": 300},
        {"dt": D, "page": "/p", "analytics_session_id": "s1", "dwell_ms": None},
        {"dt": D, "page": "/p", "analytics_session_id": None, "dwell_ms": 0},
    ])
    r = marts.page_engagement_daily(ev).first()
    assert (r.sessions, r.events, r.total_dwell_ms, r.avg_dwell_ms) == (1, 3, 300, 100.0)


def test_button_clicks_skip_missing_element(utc):
    ev = _events(utc, [
        {"dt": D, "page": "/p", "event_type": "click", "element_id": "b", "user_id": "u1", "analytics_session_id": "s1"},
        {"dt": D, "page": "/p", "event_type": "click", "element_id": "b", "user_id": "u2", "analytics_session_id": "s1"},
        {"dt": D, "page": "/p", "event_type": "click", "element_id": None, "user_id": "u1", "analytics_session_id": "s1"},
        {"dt": D, "page": "/p", "event_type": "page_enter", "element_id": "b", "user_id": "u1", "analytics_session_id": "s1"},
    ])
    rows = marts.button_clicks_daily(ev).collect()
    assert [(r.element_id, r.clicks, r.users, r.sessions) for r in rows] == [("b", 2, 2, 1)]


def test_latest_days_is_top_k(utc):
    rows = [{"dt": date(2026, 5, d), "user_id": f"u{d}"} for d in range(1, 20)]
    from pyspark.sql import types as T
    df = utc.createDataFrame([(r["dt"], r["user_id"]) for r in rows], T.StructType([
        T.StructField("dt", T.DateType()), T.StructField("user_id", T.StringType())]))
    got = [r.dt.day for r in marts.latest_days(df, 3).collect()]
    assert got == [19, 18, 17]
