"""Landing zone -> raw tables: the ingest path.

Landing layout: one Parquet dataset per entity, Hive-partitioned by
``date=YYYY-MM-DD``, many chunk files per day (``_chunk`` column).  The whole
ingest is one DataFrame plan per entity:

  scan (explicit schema, partition discovery) -> full-row dedupe (C01/U01)
  -> clean (C02-C05) -> rule validation (V*, quarantine) -> orphan filter
  (C06) -> first-writer-wins per key (W06) -> anti-join with the target (S05)
  -> append.

Key dedupe is a ``min_by`` aggregation, not a window: it aggregates
partially before the shuffle, so one key holding a third of all rows still
spreads over every map task instead of landing in one window partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from .standin import Entities

LINEAGE = ["_date", "_chunk"]

TRIP_SCHEMA = T.StructType([
    T.StructField("trip_id", T.StringType()),
    T.StructField("route_id", T.StringType()),
    T.StructField("vehicle_id", T.StringType()),
    T.StructField("trip_date", T.StringType()),
    T.StructField("time_period", T.StringType()),
    T.StructField("day_of_week", T.StringType()),
    T.StructField("passengers_boarded", T.IntegerType()),
    T.StructField("revenue_php", T.DoubleType()),
    T.StructField("travel_time_min", T.IntegerType()),
    T.StructField("scheduled_time_min", T.IntegerType()),
    T.StructField("delay_min", T.IntegerType()),
    T.StructField("is_on_time", T.BooleanType()),
    T.StructField("is_rainy_day", T.BooleanType()),
    T.StructField("load_factor", T.DoubleType()),
    T.StructField("_chunk", T.IntegerType()),
])

TRIP_ORDER = ["time_period", "day_of_week", "passengers_boarded", "revenue_php",
              "load_factor", "is_rainy_day", "route_id", "vehicle_id"]


# -- landing payloads derived from the driver tables ---------------------------
def landing_trips(E: Entities) -> DataFrame:
    """Trip payloads as they land: string codes, ISO date strings, padded
    text; chunk = line number (lineitem split by ``l_linenumber``), landing
    partition = month of the ship date (the batch that delivered the trip).  Duplicate (order, line) pairs in lineitem become duplicate
    trip keys, which the key rule must resolve."""
    li = E.t("lineitem")
    s = E._supplier_route
    ln = F.col("l_linenumber")
    rf, ls = F.col("l_returnflag"), F.col("l_linestatus")
    period = (F.when(rf == "A", " AM_peak").when((rf == "N") & (ls == "O"), "PM_peak ")
              .when(rf == "N", "off_peak").otherwise("midday"))
    return li.join(s, li.l_suppkey == s.s_suppkey).select(
        C.zero_pad("TRP-", F.col("l_orderkey") * 10 + ln, 7).alias("trip_id"),
        C.zero_pad("R", F.col("s_nationkey"), 2).alias("route_id"),
        C.zero_pad("VHC-", F.col("l_suppkey"), 3).alias("vehicle_id"),
        F.to_date("l_shipdate").cast("string").alias("trip_date"),
        period.alias("time_period"),
        C.weekday_name("l_shipdate").alias("day_of_week"),
        F.col("l_quantity").cast("int").alias("passengers_boarded"),
        F.col("l_extendedprice").alias("revenue_php"),
        (F.lit(30) + 2 * ln).alias("travel_time_min"),
        F.lit(30).alias("scheduled_time_min"),
        (2 * ln).alias("delay_min"),
        (2 * ln <= 5).alias("is_on_time"),
        (ls == "F").alias("is_rainy_day"),
        F.round(F.col("l_quantity") * 0.03, 4).alias("load_factor"),
        ln.alias("_chunk"),
        # landing partition = delivery month of the trips (one batch per month)
        F.to_date(F.date_trunc("month", "l_shipdate")).alias("_date"),
    )


# -- S01/S02/S03: landing files ------------------------------------------------
def write_landing(df: DataFrame, root: str, entity: str, mode: str = "append",
                  replace_days_only: bool = True) -> str:
    """Write a batch under ``root/entity/date=.../`` (snappy).  With
    ``mode='overwrite'`` and dynamic partition overwrite only the days in the
    batch are replaced, so a rerun leaves no stale chunk files.  A full
    reload (``replace_days_only=False``) overwrites statically: no per-day
    staging and rename, which dominates when thousands of days are written."""
    if df.isEmpty():
        raise ValueError(f"refusing to land an empty {entity} batch")
    path = f"{root.rstrip('/')}/{entity}"
    # Range-partition on (day, chunk, key) before the partitioned write: each
    # task covers a contiguous run of days, so a day lands in ~one file
    # instead of one file per task, and a hot day is split across several
    # balanced tasks (the key makes its rows divisible) rather than one.
    key = [c for c in df.columns if not c.startswith("_")][0]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df = df.repartitionByRange(n, "_date", "_chunk", key)
    (df.withColumnRenamed("_date", "date").write.mode(mode)
       .option("partitionOverwriteMode", "dynamic" if replace_days_only else "static")
       .option("compression", "snappy")
       .partitionBy("date").parquet(path))
    return path


def read_landing(spark: SparkSession, root: str, entity: str, schema: T.StructType) -> DataFrame:
    """Every Parquet object of an entity, explicit schema (no
    inference), ``date`` discovered from the partition path; file path kept
    for lineage."""
    path = f"{root.rstrip('/')}/{entity}"
    full = T.StructType(list(schema.fields) + [T.StructField("date", T.DateType())])
    return (spark.read.schema(full).parquet(path)
            .withColumn("_file", F.col("_metadata.file_path"))
            .withColumnRenamed("date", "_date"))


# -- C01-C05: cleaning ------------------------------------------------------------
def drop_full_duplicates(df: DataFrame, lineage=LINEAGE) -> DataFrame:
    """Drop fully identical data rows across chunks, keeping the
    earliest (date, chunk) copy's lineage."""
    data = [c for c in df.columns if c not in lineage and not c.startswith("_")]
    return df.groupBy(*data).agg(*[F.min(c).alias(c) for c in lineage if c in df.columns])


def clean_strings(df: DataFrame) -> DataFrame:
    """Trim every string column, empty -> NULL."""
    out = {f.name: F.nullif(F.trim(F.col(f.name)), F.lit(""))
           for f in df.schema.fields if isinstance(f.dataType, T.StringType) and not f.name.startswith("_")}
    return df.withColumns(out)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Float NaN -> NULL."""
    out = {f.name: F.when(~F.isnan(f.name), F.col(f.name))
           for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.withColumns(out)


def coerce(df: DataFrame, dates: list[str] = (), bools: list[str] = ()) -> DataFrame:
    """Typed dates (bad strings -> NULL via try_to_date) and
    booleans (strings parsed with try_cast; no Python truthiness)."""
    out = {c: F.try_to_date(F.col(c)) for c in dates}
    out.update({c: F.col(c).try_cast("boolean") for c in bools})
    return df.withColumns(out)


def clean_trips(df: DataFrame) -> DataFrame:
    return nan_to_null(coerce(clean_strings(df), dates=["trip_date"]))


# -- C06: referential filter --------------------------------------------------------
def drop_fk_orphans(df: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """Keep rows whose key exists in the parent (left-semi join).  NULL
    keys are dropped too, except that a frame without any non-NULL key is
    returned unchanged."""
    p = parent.select(F.col(pk).alias(fk))
    # decided inside the plan, by a scalar subquery, so that building it runs no job
    no_keys = df.agg(F.count(fk).alias("n")).select(F.col("n") == 0).scalar()
    marked = df.join(p.distinct().withColumn("_known", F.lit(True)), fk, "left")
    return marked.where(F.coalesce("_known", no_keys)).drop("_known").select(*df.columns)


def orphan_report(df: DataFrame, fk: str, parent: DataFrame, pk: str, k: int = 10) -> DataFrame:
    """C06 report: the first k missing keys (ascending) with their orphan row
    counts, plus the total orphan rows repeated on each line.  Counts are
    aggregated first; only k rows reach the result."""
    p = parent.select(F.col(pk).alias(fk))
    per_key = (df.filter(F.col(fk).isNotNull()).join(p, fk, "left_anti")
                 .groupBy(fk).agg(F.count(F.lit(1)).alias("orphan_rows")))
    total = per_key.agg(F.sum("orphan_rows")).scalar()
    return (per_key.orderBy(fk).limit(k)
            .withColumn("total_orphan_rows", total))


# -- W06/S05: first writer wins, insert-if-absent ------------------------------------
def first_writer_wins(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key, the first by (date, chunk, order...).  A
    ``min_by`` aggregate (partial aggregation map-side), not a window."""
    data = [c for c in df.columns if c != key]
    winner = F.min_by(F.struct(*[F.col(c) for c in data]),
                      F.struct(*[F.col(c) for c in LINEAGE + order]))
    return df.groupBy(key).agg(winner.alias("_w")).select(key, "_w.*")


def insert_if_absent(batch: DataFrame, target: DataFrame | None, key: str,
                     order: list[str]) -> DataFrame:
    """Rows of the batch to append: first writer per key, minus keys
    already in the target (anti-join; the target side is only its key
    column, shuffled once on the key)."""
    winners = first_writer_wins(batch, key, order)
    if target is None:
        return winners
    return winners.join(target.select(key), key, "left_anti")


# -- C12: whole-entity ingest ---------------------------------------------------------
def ingest_trips(landing: DataFrame, target: DataFrame | None = None,
                 rules=None) -> tuple[DataFrame, DataFrame]:
    """C12 for trips: (rows to append, quarantined rows with failed rules)."""
    valid, rejected = valid_trips(landing, rules)
    return insert_if_absent(valid, target, "trip_id", TRIP_ORDER), rejected


def valid_trips(landing: DataFrame, rules=None) -> tuple[DataFrame, DataFrame]:
    """Deduped, cleaned trips: (valid, rejected rows with failed rules)."""
    from ..operators.validation import split_valid, trip_rules
    return split_valid(clean_trips(drop_full_duplicates(landing)), rules or trip_rules())


def ingest_receipt(landing: DataFrame, entity: str) -> DataFrame:
    """Rows landed per partition date (entity, date, rows)."""
    return landing.groupBy(F.col("_date").alias("partition_date")).agg(
        F.count(F.lit(1)).alias("rows_written")).select(F.lit(entity).alias("entity"), "*")


def receipt_of_files(spark: SparkSession, root: str, entity: str) -> DataFrame:
    """What was landed, by partition date: path, files, bytes, rows and the newest
    change, as the store has them."""
    from .sinks import files_of
    path = f"{root.rstrip('/')}/{entity}"
    files = files_of(spark.read.parquet(path), F.col("date").cast("date").alias("partition_date"))
    return files.groupBy("partition_date").agg(F.min(F.regexp_replace("path", "/[^/]*$", "")).alias("path"), F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"),
                                               F.sum("rows").alias("rows_written"), F.max("modified").alias("modified")).select(F.lit(entity).alias("entity"), "*")


# -- other entities: passengers (parent) and experiment rows (child) -----------
PASSENGER_ORDER = ["survey_date", "origin_district", "satisfaction_score"]
EXPERIMENT_ORDER = ["test_week", "satisfaction_score", "simulated_travel_time_min"]


def landing_passengers(E: Entities) -> DataFrame:
    """Survey payloads: PAX codes (4 digits or more), ISO dates, padded district
    names; chunk = id mod 4, landing partition = survey month."""
    s = E.survey()
    return s.select(
        C.zero_pad("PAX-", F.col("passenger_id"), 4).alias("passenger_id"),
        F.col("survey_date").cast("string").alias("survey_date"),
        "origin_barangay",
        F.concat(F.lit(" "), F.col("origin_district")).alias("origin_district"),
        "destination_type", "trip_purpose",
        C.zero_pad("R", F.col("primary_route_used"), 2).alias("primary_route_used"),
        F.col("trips_per_week").cast("int").alias("trips_per_week"),
        F.col("avg_fare_paid_php").cast("double").alias("avg_fare_paid_php"),
        F.col("transfers_required").cast("int").alias("transfers_required"),
        F.col("wait_time_min").cast("int").alias("wait_time_min"),
        F.col("travel_time_min").cast("int").alias("travel_time_min"),
        F.col("satisfaction_score").cast("int").alias("satisfaction_score"),
        "income_bracket", "prefers_aircon",
        (F.col("passenger_id") % 4).cast("int").alias("_chunk"),
        F.to_date(F.date_trunc("month", F.col("survey_date"))).alias("_date"),
    )


def landing_experiment(E: Entities) -> DataFrame:
    """Experiment payloads from the events: record and passenger codes,
    chunk = week, landing partition = event month."""
    e = E.t("events")
    treat = F.col("user_id") % 2 != 0
    return e.select(
        C.zero_pad("ABR-", F.col("event_id"), 7).alias("experiment_record_id"),
        F.lit("EXP-001").alias("experiment_id"),
        C.zero_pad("PAX-", F.col("user_id"), 4).alias("passenger_id"),
        F.when(treat, "treatment").otherwise("control").alias("group"),
        F.when(treat, "B_express").otherwise("A_current").alias("route_variant"),
        (F.lit(1) + F.col("event_id") % 8).cast("int").alias("test_week"),
        F.col("value").alias("simulated_travel_time_min"),
        (F.lit(1) + F.col("event_id") % 5).cast("int").alias("satisfaction_score"),
        (F.col("event_id") % 4).cast("int").alias("transfers_needed"),
        F.col("event_type").isin("purchase", "click").alias("would_use_again"),
        (F.lit(1) + F.col("event_id") % 8).cast("int").alias("_chunk"),
        F.to_date(F.date_trunc("month", F.col("ts"))).alias("_date"),
    )


def ingest_entity(landing: DataFrame, key: str, order: list[str], rules,
                  target: DataFrame | None = None, dates=(),
                  parent: tuple[str, DataFrame, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """C12 for any entity: dedupe, clean, validate (quarantine), optional
    orphan filter against an already-loaded parent (C06), first writer per
    key, minus keys already in the target (S05)."""
    from ..operators.validation import split_valid
    cleaned = nan_to_null(coerce(clean_strings(drop_full_duplicates(landing)), dates=list(dates)))
    valid, rejected = split_valid(cleaned, rules)
    if parent is not None:
        fk, parent_df, pk = parent
        valid = drop_fk_orphans(valid, fk, parent_df, pk)
    return insert_if_absent(valid, target, key, order), rejected


def ingest_passengers(E: Entities) -> DataFrame:
    """C11, first phase: the parents."""
    from ..operators.validation import survey_rules
    rules = [("passenger_id_pattern", F.col("passenger_id").rlike(r"^PAX-\d{4,}$"))] + survey_rules()
    return ingest_entity(landing_passengers(E), "passenger_id", PASSENGER_ORDER, rules, dates=["survey_date"])[0]


def ingest_experiment(E: Entities, passengers: DataFrame) -> DataFrame:
    """C11, second phase: the orphan filter reads the passengers just loaded."""
    from ..operators.validation import ab_rules
    rules = [("record_id_pattern", F.col("experiment_record_id").rlike(r"^ABR-\d{7,}$")),
             ("passenger_id_pattern", F.col("passenger_id").rlike(r"^PAX-\d{4,}$"))] + ab_rules()
    return ingest_entity(landing_experiment(E), "experiment_record_id", EXPERIMENT_ORDER, rules,
                         parent=("passenger_id", passengers, "passenger_id"))[0]


def ingest_ordered(E: Entities) -> dict[str, DataFrame]:
    """C11: parents first, then the children that refer to them."""
    passengers = ingest_passengers(E)
    return {"passengers": passengers, "experiment": ingest_experiment(E, passengers)}
