import shutil
import tempfile

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from tidemark.plans.catalog import Lakehouse
from tidemark.streaming import ingest
from tidemark.sources import testdata


def _lakehouse(spark, label):
    return ingest.fresh_lakehouse(spark, label)


def _stream_dir(n_rows: int | None = None) -> str:
    d = tempfile.mkdtemp(prefix="tm-stream-", dir="/tmp")
    table = pq.read_table(f"{SF_SMALL}/events.parquet")
    if n_rows is not None:
        table = table.slice(0, n_rows)
    pq.write_table(table, f"{d}/events.parquet")
    return d


def test_available_now_rerun_and_new_file(utc):
    src = _stream_dir()
    lh = _lakehouse(utc, "t-stream")
    cp = f"{lh.root}/_cp"
    q = ingest.start_bronze_ingest(ingest.click_envelope_stream(utc, src), "clicks", lh, cp)
    ingest.run_to_completion(q)
    first = lh.table("bronze.clickstream_raw").count()
    dlq = lh.table("bronze.dlq_clickstream").count()
    assert first == 1000 and dlq > 0
    batches_first = len(q.recentProgress)

    q2 = ingest.start_bronze_ingest(ingest.click_envelope_stream(utc, src), "clicks", lh, cp)
    ingest.run_to_completion(q2)
    assert lh.table("bronze.clickstream_raw").count() == first  # nothing new: no rows added
    assert all(p["numInputRows"] == 0 for p in q2.recentProgress)

    shutil.copy(f"{src}/events.parquet", f"{src}/more-events.parquet")  # same rows again, new file
    src_schema = testdata.read_table(utc, src, "events").schema
    stream = testdata.clickstream_envelopes(utc.readStream.schema(src_schema).parquet(src))
    q3 = ingest.start_bronze_ingest(stream, "clicks", lh, f"{lh.root}/_cp_all")
    ingest.run_to_completion(q3)
    assert batches_first >= 1
    assert lh.table("bronze.clickstream_raw").count() == first + 2 * 1000


def test_batch_retry_is_idempotent(utc):
    lh = _lakehouse(utc, "t-retry")
    lh.init(["bronze.clickstream_raw", "bronze.dlq_clickstream"])
    write = ingest.batch_writer(lh, "clicks", "writer1")
    env = testdata.click_envelopes(utc, SF_SMALL)
    write(env, 7)
    write(env, 7)  # the same micro-batch retried
    write(env.limit(10), 8)
    valid, dlq = lh.table("bronze.clickstream_raw"), lh.table("bronze.dlq_clickstream")
    assert valid.filter(F.col("batch_id") == 7).count() == 1000
    assert dlq.filter(F.col("batch_id") == 7).count() == 9  # ids % 211 == 0 or % 307 == 0 below 1000
    assert (valid.filter(F.col("batch_id") == 8).count() + dlq.filter(F.col("batch_id") == 8).count()) == 10


def test_micro_batches_do_not_change_silver(utc):
    """Metamorphic: ingesting in three batches gives the same silver events."""
    from tidemark.operators import sessions
    lh = _lakehouse(utc, "t-meta")
    lh.init(["bronze.clickstream_raw", "bronze.dlq_clickstream"])
    write = ingest.batch_writer(lh, "clicks", "writer1")
    env = testdata.click_envelopes(utc, SF_SMALL).withColumn("_b", F.col("offset_value") % 3)
    for b in range(3):
        write(env.filter(F.col("_b") == b).drop("_b"), b)
    one = ingest.fresh_lakehouse(utc, "t-meta-one")
    one.init(["bronze.clickstream_raw", "bronze.dlq_clickstream"])
    ingest.batch_writer(one, "clicks", "writer1")(testdata.click_envelopes(utc, SF_SMALL), 0)
    cols = ["event_id", "analytics_session_id", "dt"]
    a = sessions.sessionize(lh.table("bronze.clickstream_raw")).select(*cols)
    b = sessions.sessionize(one.table("bronze.clickstream_raw")).select(*cols)
    assert a.count() == 1000 and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_kafka_record_decode(utc):
    from tidemark.sources.kafka import decode_envelope
    rec = utc.createDataFrame([("t", 2, 5, bytearray(b'{"id":"x"}'), bytearray(b'{"op":"c"}'))],
                              "topic string, partition int, offset bigint, key binary, value binary")
    r = decode_envelope(rec).first()
    assert (r.topic, r.partition_id, r.offset_value, r.key_json, r.value_json) == ("t", 2, 5, '{"id":"x"}', '{"op":"c"}')
    assert decode_envelope(rec, with_key=False).columns == ["topic", "partition_id", "offset_value", "value_json"]


def _ledger_stream(spark, folder, parts, accounts, delay):
    """Replay the given frames, one per trigger, then a heartbeat far behind them; the sink's rows."""
    import time

    from tidemark.streaming import ledger as stream_ledger
    schema = parts[0].schema
    beat = parts[0].limit(1).select(*[
        F.lit("2030-01-01").cast("timestamp").alias(f.name) if f.name == "occurred_at" else F.lit(None).cast(f.dataType).alias(f.name)
        for f in schema.fields])
    for n, part in enumerate([*parts, beat]):
        part.coalesce(1).write.parquet(f"{folder}/in/{n:03d}")
        time.sleep(0.02)  # the file source orders new files by modification time
    before = stream_ledger.use_rocksdb_state(spark)
    try:
        stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", "1")
                  .option("recursiveFileLookup", "true").parquet(f"{folder}/in"))
        q = (stream_ledger.ledger_replay_stream(stream, accounts, delay, 6 * 3600).writeStream.format("parquet")
             .option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp")
             .trigger(availableNow=True).start())
        q.awaitTermination()
    finally:
        stream_ledger.restore_state_store(spark, before)
    assert len([p for p in q.recentProgress if p["numInputRows"] > 0]) == len(parts) + 1
    return spark.read.parquet(f"{folder}/out")


@pytest.fixture(scope="module")
def ledger_rows(spark):
    from test_ledger import _accounts, _random_ledger, _txs
    opening, rows = _random_ledger(6, 240, 90)
    tx = _txs(spark, rows).withColumn("occurred_at", F.when(F.col("transaction_id") != "t00007", F.col("occurred_at")))
    return tx.select("transaction_id", "user_id", "currency", "direction", "amount", "occurred_at"), _accounts(spark, opening)


@pytest.mark.parametrize("triggers", [1, 2, 12])
def test_stream_replay_does_not_depend_on_triggers_or_order(utc, tmp_path, ledger_rows, triggers):
    from tidemark.operators import ledger
    tx, accounts = ledger_rows
    dealt = tx.withColumn("_b", F.pmod(F.xxhash64("transaction_id", F.lit(triggers)), F.lit(triggers))).cache()
    parts = [dealt.filter(F.col("_b") == b).drop("_b").orderBy(F.rand(b)) for b in range(triggers)]
    got = _ledger_stream(utc, str(tmp_path), parts, accounts, "30 days")
    want = ledger.ledger_replay(tx, accounts)
    assert sorted(map(repr, got.select(want.columns).collect())) == sorted(map(repr, want.collect()))


def test_a_late_row_comes_out_by_itself(utc, tmp_path, ledger_rows):
    from test_ledger import _accounts, _txs
    columns = ["transaction_id", "user_id", "currency", "direction", "amount", "occurred_at"]
    rows = [("t1", "A", "credit", "5.00", 1), ("t2", "A", "debit", "5.00", 100),
            ("t2b", "A", "credit", "0.00", 100), ("t3", "A", "credit", "1.00", 2), ("t4", "A", "debit", "1.00", 101)]
    parts = [_txs(utc, [r]).select(*columns) for r in rows]
    got = {r.transaction_id: (r.accepted, r.reason) for r in _ledger_stream(utc, str(tmp_path), parts, _accounts(utc, {"A": "0.00"}), "1 hour").collect()}
    # The watermark of t2 takes effect with the next trigger, which applies the first bucket; t3 comes after that.
    assert got == {"t1": (True, ""), "t2": (True, ""), "t2b": (True, ""), "t3": (False, "late"), "t4": (False, "insufficient_funds")}


def test_dead_letters_are_written_as_envelopes_and_a_failing_sink_fails_the_batch(utc):
    import json
    lh = _lakehouse(utc, "t-sink")
    lh.init(["bronze.clickstream_raw", "bronze.dlq_clickstream"])
    rows = [("clickstream.events", 0, 1, None, '{"event_id":"a","session_id":"s"}'), ("clickstream.events", 0, 2, None, '{"session_id":"s2"}'),
            ("clickstream.events", 0, 3, None, None)]
    env = utc.createDataFrame(rows, "topic string, partition_id int, offset_value bigint, key_json string, value_json string")
    sent = []

    def keep(records, batch_id):
        sent.append((batch_id, [(r.key, json.loads(r.value)) for r in records.collect()]))

    ingest.batch_writer(lh, "clicks", "w", dlq_sink=keep)(env, 3)
    topic = "clickstream.events"
    assert sent[0][0] == 3 and sorted(sent[0][1], key=repr) == sorted([
        ("s2", {"original": {"session_id": "s2"}, "error": "missing_event_id", "source_topic": topic}),
        (None, {"original": None, "error": "null_value", "source_topic": topic})], key=repr)

    def fail(_records, _batch_id):
        raise OSError("broker gone")

    writer = ingest.batch_writer(lh, "clicks", "w", dlq_sink=fail)
    with pytest.raises(OSError, match="broker gone"):
        writer(env, 4)
    ingest.batch_writer(lh, "clicks", "w", dlq_sink=keep)(env, 4)  # the retry replaces what the failed try wrote
    assert lh.table("bronze.clickstream_raw").filter("batch_id = 4").count() == 1


def test_the_streaming_ledger_keeps_state_by_groups_of_accounts(utc, tmp_path):
    """300 accounts in two groups: the store holds a few rows a group and bucket, not some for every account."""
    from test_ledger import _accounts, _txs
    from tidemark.operators import ledger
    from tidemark.streaming import ledger as stream_ledger
    names = [f"a{i:03d}" for i in range(300)]
    accounts = _accounts(utc, {a: f"{i}.00" for i, a in enumerate(names)})
    rows = [(f"t{a}{n}", a, "debit", "90.00", n) for a in names for n in range(2)]
    tx = _txs(utc, rows).select("transaction_id", "user_id", "currency", "direction", "amount", "occurred_at")
    beat = tx.limit(1).select(*[F.lit("2030-01-01").cast("timestamp").alias(c) if c == "occurred_at" else F.lit(None).cast(t).alias(c)
                                for c, t in tx.dtypes])
    tx.unionByName(beat).coalesce(1).write.parquet(f"{tmp_path}/in")
    before = stream_ledger.use_rocksdb_state(utc)
    try:
        q = (stream_ledger.ledger_replay_stream(utc.readStream.schema(tx.schema).parquet(f"{tmp_path}/in"), accounts, "1 day", 86_400, groups=2)
             .writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp")
             .trigger(availableNow=True).start())
        q.awaitTermination()
    finally:
        stream_ledger.restore_state_store(utc, before)
    held = max(op["numRowsTotal"] for p in q.recentProgress for op in p["stateOperators"])
    assert 0 < held < 50
    want = ledger.ledger_replay(tx, accounts)
    got = utc.read.parquet(f"{tmp_path}/out").select(want.columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_state_partitions_follow_the_cores(utc):
    from tidemark.streaming import ledger as stream_ledger
    old = utc.conf.get("spark.sql.shuffle.partitions")
    try:
        utc.conf.set("spark.sql.shuffle.partitions", "2000")
        assert stream_ledger.state_partitions(utc) == 3 * utc.sparkContext.defaultParallelism
        utc.conf.set("spark.sql.shuffle.partitions", "2")
        assert stream_ledger.state_partitions(utc) == 2
    finally:
        utc.conf.set("spark.sql.shuffle.partitions", old)
