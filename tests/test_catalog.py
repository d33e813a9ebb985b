from datetime import date
from decimal import Decimal

from pyspark.sql import functions as F

from conftest import SF_SMALL
from tidemark import schemas
from tidemark.plans import refresh
from tidemark.plans.layers import Layers
from tidemark.sources import testdata
from tidemark.streaming import ingest


def _volume(spark, rows):
    rows = [(d, u, c, Decimal(cr), Decimal(db), n) for d, u, c, cr, db, n in rows]
    return spark.createDataFrame(rows, "dt date, user_id string, currency string, credit_amount decimal(18,2), "
                                       "debit_amount decimal(18,2), transaction_count bigint")


def test_dynamic_overwrite_keeps_stale_partitions_full_replaces(utc):
    lh = ingest.fresh_lakehouse(utc, "t-ow")
    out = lh.init(["gold.transaction_volume_daily"])
    assert out.count() == 1
    d1, d2 = date(2026, 5, 1), date(2026, 5, 2)
    lh.overwrite("gold.transaction_volume_daily", _volume(utc, [(d1, "u", "USD", 1, 0, 1), (d2, "u", "USD", 2, 0, 1)]))
    lh.overwrite("gold.transaction_volume_daily", _volume(utc, [(d2, "v", "USD", 9, 0, 1)]), mode="dynamic")
    rows = sorted((r.dt, r.user_id) for r in lh.table("gold.transaction_volume_daily").collect())
    assert rows == [(d1, "u"), (d2, "v")]  # d1 stale but kept, d2 replaced (S13)
    lh.overwrite("gold.transaction_volume_daily", _volume(utc, [(d2, "w", "USD", 9, 0, 1)]), mode="full")
    rows = sorted((r.dt, r.user_id) for r in lh.table("gold.transaction_volume_daily").collect())
    assert rows == [(d2, "w")]


def test_empty_result_empties_unpartitioned_table(utc):
    lh = ingest.fresh_lakehouse(utc, "t-empty")
    lh.init(["silver.users"])
    users = Layers(utc, SF_SMALL).users
    lh.overwrite("silver.users", users)
    assert lh.table("silver.users").count() == 150
    lh.overwrite("silver.users", users.limit(0))
    assert lh.table("silver.users").count() == 0


def test_full_refresh_and_checks(utc):
    lh = ingest.fresh_lakehouse(utc, "t-refresh")
    assert {r.status for r in lh.check_tables().collect()} == {"missing"}
    refresh.load_bronze_batch(lh, testdata.cdc_envelopes(utc, SF_SMALL), testdata.click_envelopes(utc, SF_SMALL), "load1")
    timings = {}
    refresh.refresh_all(lh, on_build=lambda t, s: timings.__setitem__(t, s))
    assert len(timings) == 13
    checks = {r.table.split("_", 1)[1]: (r.status, r.rows) for r in lh.check_tables().collect()}
    assert len(checks) == len(schemas.TABLES) and all(s == "ok" for s, _ in checks.values())
    assert checks["silver.users"][1] == 150 and checks["bronze.clickstream_raw"][1] == 1000
    assert lh.table("gold.sessions").count() == lh.table("silver.sessions").count()
    stats = lh.refresh(["gold.sessions", "gold.nope"]).collect()
    assert stats[0].refresh == "ok" and stats[1].refresh.startswith("failed")
    assert lh.preview("gold.sessions", 5).count() == 5
    nonempty = lh.check_nonempty(["silver.users"]).first()
    assert nonempty.nonempty is True


def test_incremental_refresh_rewrites_only_recent_days(utc):
    lh = ingest.fresh_lakehouse(utc, "t-incr")
    refresh.load_bronze_batch(lh, testdata.cdc_envelopes(utc, SF_SMALL), testdata.click_envelopes(utc, SF_SMALL), "load1")
    refresh.refresh_all(lh)
    before = {(r.dt, r.user_id): r for r in lh.table("gold.user_engagement_daily").collect()}
    refresh.refresh_all(lh, since=date(2024, 1, 20))
    after = {(r.dt, r.user_id): r for r in lh.table("gold.user_engagement_daily").collect()}
    assert before == after


def test_cli_init_and_check(utc, tmp_path):
    from tidemark import cli
    root = str(tmp_path / "lake")
    assert cli.main(["--root", root, "--prefix", "cli_", "init"]) == 0
    assert cli.main(["--root", root, "--prefix", "cli_", "check"]) == 0
    assert cli.main(["--root", root, "--prefix", "cli_", "check", "--nonempty"]) == 1


def test_file_envelope_ingest_via_cli(utc, tmp_path):
    from tidemark import cli
    src = tmp_path / "env"
    testdata.click_envelopes(utc, SF_SMALL).write.json(str(src))
    root = str(tmp_path / "lake")
    assert cli.main(["--root", root, "--prefix", "clif_", "ingest", "clicks", "--files", str(src)]) == 0
    assert utc.table("clif_bronze.clickstream_raw").count() == 1000


def test_use_namespace_and_append(utc):
    lh = ingest.fresh_lakehouse(utc, "t-use")
    lh.init(["silver.users"])
    users = Layers(utc, SF_SMALL).users
    lh.append("silver.users", users)
    lh.append("silver.users", users)
    lh.use("silver")
    try:
        assert utc.table("users").count() == 300
    finally:
        utc.catalog.setCurrentDatabase("default")


def test_parallel_refresh_equals_serial(utc):
    serial = ingest.fresh_lakehouse(utc, "t-serial")
    par = ingest.fresh_lakehouse(utc, "t-par")
    for lh in (serial, par):
        refresh.load_bronze_batch(lh, testdata.cdc_envelopes(utc, SF_SMALL), testdata.click_envelopes(utc, SF_SMALL), "load1")
    refresh.refresh_all(serial)
    refresh.refresh_all(par, parallel=4)
    for logical in schemas.TABLES:
        if logical.startswith("bronze."):
            continue
        cols = [c for c in serial.table(logical).columns if c != "updated_at"]
        a, b = serial.table(logical).select(*cols), par.table(logical).select(*cols)
        assert a.count() == b.count() and a.exceptAll(b).count() == 0, logical
