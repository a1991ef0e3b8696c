"""Landing ingest: dedupe, cleaning, orphan rules, first writer wins,
insert-if-absent, partition overwrite, streaming equals batch."""

import contextlib
import io

from pyspark.sql import functions as F

from routewise.sources import landing as L
from routewise.sources.keyed import KeyedTable, load_in_deliveries
from routewise.sources.standin import Entities
from routewise.streaming.incremental import run_trip_ingest
from tests.conftest import SF_SMALL


def _fixture(spark):
    rows = [("K1", "a", 1, "2024-01-02", 2), ("K1", "b", 2, "2024-01-01", 5),
            ("K1", "c", 3, "2024-01-01", 3), ("K2", " x ", 4, "2024-01-03", 1),
            ("K2", " x ", 4, "2024-01-03", 1)]
    return (spark.createDataFrame(rows, "trip_id string, time_period string, v int, d string, _chunk int")
                 .withColumn("_date", F.to_date("d")).drop("d"))


def test_first_writer_wins_by_date_then_chunk(spark):
    df = _fixture(spark)
    got = {r.trip_id: r.time_period for r in L.first_writer_wins(df, "trip_id", ["v"]).collect()}
    assert got == {"K1": "c", "K2": " x "}


def test_full_duplicates_and_trim(spark):
    df = L.clean_strings(L.drop_full_duplicates(_fixture(spark)))
    assert df.count() == 4
    assert df.filter("trip_id = 'K2'").first().time_period == "x"


def test_insert_if_absent_skips_loaded_keys(spark):
    df = _fixture(spark)
    target = spark.createDataFrame([("K1",)], "trip_id string")
    got = L.insert_if_absent(df, target, "trip_id", ["v"])
    assert [r.trip_id for r in got.collect()] == ["K2"]


def test_orphan_filter_null_rules(spark):
    parent = spark.createDataFrame([(1,), (2,)], "pid int")
    child = spark.createDataFrame([(1,), (3,), (None,)], "pid int")
    assert sorted(r.pid for r in L.drop_fk_orphans(child, "pid", parent, "pid").collect()) == [1]
    only_null = spark.createDataFrame([(None,), (None,)], "pid int")
    assert L.drop_fk_orphans(only_null, "pid", parent, "pid").count() == 2


def test_dynamic_partition_overwrite_replaces_only_batch_days(spark, tmp_path):
    root = str(tmp_path)
    df = _fixture(spark)
    L.write_landing(df, root, "t", mode="overwrite")
    L.write_landing(df.filter("_date = '2024-01-01'").limit(1), root, "t", mode="overwrite")
    back = spark.read.parquet(f"{root}/t")
    by_day = {str(r.date): r["count"] for r in back.groupBy("date").count().collect()}
    assert by_day == {"2024-01-01": 1, "2024-01-02": 1, "2024-01-03": 2}


def test_streaming_ingest_equals_batch(spark, tmp_path):
    E = Entities(spark, SF_SMALL)
    root = str(tmp_path)
    L.write_landing(L.landing_trips(E), root, "trips", mode="overwrite")
    landing = L.read_landing(spark, root, "trips", L.TRIP_SCHEMA).drop("_file")
    batch, _ = L.ingest_trips(landing)
    streamed = run_trip_ingest(spark, root, f"{root}/_target", f"{root}/_ckpt")
    cols = sorted(batch.columns)
    assert streamed.select(cols).exceptAll(batch.select(cols)).count() == 0
    assert batch.select(cols).exceptAll(streamed.select(cols)).count() == 0
    # a second run with no new files loads nothing new
    again = run_trip_ingest(spark, root, f"{root}/_target", f"{root}/_ckpt")
    assert again.count() == batch.count()


def test_hot_key_dedupe_is_an_aggregate(spark):
    """A key holding a third of all rows: first writer wins is computed by a
    partially-aggregated min_by (no window over the hot key)."""
    n = 3000
    rows = [("HOT" if i % 3 == 0 else f"K{i}", f"v{i}", i % 7, "2024-01-01", i % 5) for i in range(n)]
    df = (spark.createDataFrame(rows, "trip_id string, time_period string, v int, d string, _chunk int")
               .withColumn("_date", F.to_date("d")).drop("d").repartition(8))
    out = L.first_writer_wins(df, "trip_id", ["v", "time_period"])
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        out.explain()
    plan = buf.getvalue()
    # partial aggregation before the shuffle, no window over the key
    assert "partial_min_by" in plan and "Window" not in plan
    hot = out.filter("trip_id = 'HOT'").first()
    # earliest chunk, then smallest v, then smallest time_period among HOT rows
    cands = sorted((r[4], r[2], r[1]) for r in rows if r[0] == "HOT")
    assert (hot._chunk, hot.v, hot.time_period) == cands[0]
    assert out.count() == 1 + (n - n // 3)


def test_streaming_over_many_triggers_equals_batch(spark, tmp_path):
    """Files arrive delivery by delivery, in order of date: the table equals the batch
    load.  With triggers of some files each, which need not be in that order, each key is
    loaded once."""
    E = Entities(spark, SF_SMALL)
    root = str(tmp_path)
    trips = L.landing_trips(E)
    for lo, hi in (("1900-01-01", "1996-06-01"), ("1996-06-01", "1997-06-01"), ("1997-06-01", "2100-01-01")):
        L.write_landing(trips.where(f"_date >= date'{lo}' and _date < date'{hi}'"), root, "trips")
        streamed = run_trip_ingest(spark, root, f"{root}/_target", f"{root}/_ckpt")
    batch, _ = L.ingest_trips(L.read_landing(spark, root, "trips", L.TRIP_SCHEMA).drop("_file"))
    cols = sorted(batch.columns)
    assert spark.read.parquet(f"{root}/_target").select("epoch").distinct().count() == 3
    assert streamed.select(cols).exceptAll(batch.select(cols)).count() == 0
    assert batch.select(cols).exceptAll(streamed.select(cols)).count() == 0
    some = run_trip_ingest(spark, root, f"{root}/_target2", f"{root}/_ckpt2", max_files=40)
    assert spark.read.parquet(f"{root}/_target2").select("epoch").distinct().count() > 1
    keys, want = some.select("trip_id"), batch.select("trip_id")
    assert keys.exceptAll(want).count() == 0 and want.exceptAll(keys).count() == 0


def _trip(i, passengers, date, chunk=1):
    return (f"TRP-{i:07d}", "R01", "VHC-001", date, "midday", "Monday", passengers, 10.0, 30, 30, 0, True, False, 0.5, chunk, date)


def _land(spark, rows, root):
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in L.TRIP_SCHEMA.fields) + ", _date string"
    L.write_landing(spark.createDataFrame(rows, schema).withColumn("_date", F.to_date("_date")), root, "trips")


def test_late_and_repeated_files(spark, tmp_path):
    """A late file adds new keys only, a repeated one nothing; a key whose first rows were
    invalid is still free; rejected rows are quarantined by epoch."""
    root, out = str(tmp_path / "in"), str(tmp_path)
    run = lambda: run_trip_ingest(spark, root, f"{out}/t", f"{out}/c", quarantine=f"{out}/q")
    _land(spark, [_trip(1, 10, "2024-01-05"), _trip(1, 9, "2024-01-05", 0), _trip(2, 20, "2024-01-05"), _trip(3, 999, "2024-01-05")], root)
    got = {r.trip_id[-1]: r.passengers_boarded for r in run().collect()}
    assert got == {"1": 9, "2": 20}  # the earlier chunk; 999 is out of range
    _land(spark, [_trip(1, 5, "2024-01-01"), _trip(3, 33, "2024-01-01"), _trip(4, 40, "2024-01-01")], root)  # late: an earlier date
    _land(spark, [_trip(2, 20, "2024-01-05")], root)  # again
    got = {r.trip_id[-1]: r.passengers_boarded for r in run().collect()}
    assert got == {"1": 9, "2": 20, "3": 33, "4": 40}
    assert run().count() == 4
    rejected = spark.read.parquet(f"{out}/q").collect()
    assert [(r.trip_id[-1], r.failed_rules) for r in rejected] == [("3", ["passengers_range"])]


def _plan(df):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


def test_keyed_table_loads_each_key_once_and_stays_where_it_is(spark, tmp_path):
    batches = [[("K1", "a", 1), ("K1", "b", 0), ("K2", "c", 5)], [("K2", "late", 0), ("K3", "d", 1)], [("K1", "again", 0), ("K3", "again", 0)]]
    frames = [spark.createDataFrame([(k, v, n, 1) for k, v, n in b], "trip_id string, v string, n int, _chunk int").withColumn("_date", F.lit("2024-01-01").cast("date")) for b in batches]
    table = KeyedTable(spark, str(tmp_path), "trip_id", 8)
    assert table.frame() is None
    for f in frames:
        table.insert(f, ["n"])
    want = {"K1": "b", "K2": "c", "K3": "d"}
    assert {r.trip_id: r.v for r in table.frame().collect()} == want and table.frame().count() == 3
    table.close()
    # opened again by its path; the plan moves the batch only
    again = KeyedTable(spark, str(tmp_path), "trip_id", 8)
    assert {r.trip_id: r.v for r in again.frame().collect()} == want
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        absent = again.absent(frames[0].unionByName(frames[1].withColumn("trip_id", F.lit("K9"))), ["n"])
        plan = _plan(absent)
        assert [r.trip_id for r in absent.collect()] == ["K9"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    target = plan[plan.index("SortMergeJoin"):].split("Bucketed: true")[0]
    last = target[target.rindex("Exchange"):]
    assert "SelectedBucketsCount: 8 out of 8" in plan and "partial_min_by" in last  # the last exchange before the target's scan is the batch's
    again.close()


def test_orphan_report_first_missing_keys(spark):
    parent = spark.createDataFrame([(k,) for k in range(0, 100, 2)], "pid int")   # even ids exist
    child = spark.createDataFrame([(k,) for k in range(1, 60)] + [(7,), (7,), (None,)], "pid int")
    rep = L.orphan_report(child, "pid", parent, "pid", k=3).orderBy("pid").collect()
    assert [(r.pid, r.orphan_rows) for r in rep] == [(1, 1), (3, 1), (5, 1)]
    odd = sum(1 for k in range(1, 60) if k % 2) + 2
    assert {r.total_orphan_rows for r in rep} == {odd}


def test_deliveries_equal_one_load(spark, tmp_path):
    E = Entities(spark, SF_SMALL)
    trips = L.landing_trips(E)
    valid = lambda df: L.valid_trips(df)[0]
    got = load_in_deliveries(trips, str(tmp_path), "trip_id", L.TRIP_ORDER, valid, ["1996-06-01", "1997-06-01"], 8)
    want, _ = L.ingest_trips(trips)
    cols = sorted(want.columns)
    assert got.select(cols).exceptAll(want.select(cols)).count() == 0 and got.count() == want.count()


def test_streamed_first_writers_need_no_call_for_each_key(spark, tmp_path):
    """State is an aggregation of Spark's, combined before the shuffle."""
    from routewise.streaming.incremental import first_writers, landing_stream

    _land(spark, [_trip(1, 10, "2024-01-05")], str(tmp_path))
    plan = _plan(first_writers(landing_stream(spark, str(tmp_path), "trips", L.TRIP_SCHEMA), "trip_id", L.TRIP_ORDER))
    assert "Python" not in plan and "Pandas" not in plan and "partial_min" in plan
