"""The constraint graph of the landing entities.

An entity is declared once: its columns with their rules, its key, other unique columns,
row checks and parents.  From the declaration come the landing schema, the cleaning
(trim, NaN, typed dates and booleans, defaults), the named rules, the orphan filter and
the order of loading: parents before children, by topological order.

A row that breaks a rule is quarantined with the names of all rules it breaks; a rule on
a column is not asked of a NULL, which breaks only ``<column>_present``.  A child whose
parent was quarantined is an orphan, so faults run down the graph.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from graphlib import TopologicalSorter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as K
from ..operators.validation import split_valid
from . import landing as L

SPARK_TYPES = {"text": T.StringType(), "int": T.IntegerType(), "number": T.DoubleType(), "date": T.StringType(), "flag": T.StringType()}


@dataclass(frozen=True)
class Col:
    """A payload column.  Dates and flags land as text; lo and hi are inclusive, above is
    not; a default stands for a missing value."""
    name: str
    kind: str = "text"
    pattern: str | None = None
    length: tuple[int, int] | None = None
    values: tuple = ()
    lo: float | None = None
    hi: float | None = None
    above: float | None = None
    default: object = None

    def rules(self) -> list[tuple[str, Column]]:
        c, out = F.col(self.name), []
        asked = lambda ok: c.isNull() | ok
        if self.kind in ("date", "flag"):
            out.append((f"{self.name}_type", F.col(f"_read_{self.name}")))
            out.append((f"{self.name}_present", c.isNotNull() | ~F.col(f"_read_{self.name}")))
        else:
            out.append((f"{self.name}_present", c.isNotNull()))
        if self.pattern:
            out.append((f"{self.name}_pattern", asked(c.rlike(self.pattern))))
        if self.length:
            out.append((f"{self.name}_length", asked(F.length(c).between(*self.length))))
        if self.values:
            out.append((f"{self.name}_enum", asked(c.isin(list(self.values)))))
        bounds = [f(v) for v, f in ((self.lo, lambda v: c >= v), (self.hi, lambda v: c <= v), (self.above, lambda v: c > v)) if v is not None]
        if bounds:
            ok = bounds[0]
            for b in bounds[1:]:
                ok = ok & b
            out.append((f"{self.name}_range", asked(ok)))
        return out


@dataclass(frozen=True)
class Spec:
    name: str
    columns: tuple[Col, ...]
    parents: tuple[tuple[str, str, str], ...] = ()   # (column, parent entity, its key)
    unique: tuple[str, ...] = ()                     # besides the key
    checks: tuple[tuple[str, str], ...] = ()         # (name, SQL that a valid row satisfies)
    order: tuple[str, ...] = field(default=())       # ties of first writers

    @property
    def key(self) -> str:
        return self.columns[0].name

    def landing_schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, SPARK_TYPES[c.kind]) for c in self.columns] + [T.StructField("_chunk", T.IntegerType())])

    def clean(self, df: DataFrame) -> DataFrame:
        """Typed columns; _read_<column> tells whether a date's or flag's text could be read."""
        df = L.nan_to_null(L.clean_strings(df))
        out = {}
        for c in self.columns:
            col = F.col(c.name)
            typed = F.try_to_date(col) if c.kind == "date" else col.try_cast("boolean") if c.kind == "flag" else col
            if c.kind in ("date", "flag"):
                out[f"_read_{c.name}"] = col.isNull() | typed.isNotNull()
            if c.default is not None:
                typed = F.when(col.isNull(), F.lit(c.default)).otherwise(typed)
            out[c.name] = typed
        return df.withColumns(out)

    def rules(self) -> list[tuple[str, Column]]:
        out = [r for c in self.columns for r in c.rules()]
        # a check on a NULL is not broken, as in SQL
        out += [(name, F.coalesce(F.expr(sql), F.lit(True))) for name, sql in self.checks]
        return out + [(f"{fk}_known", F.col(fk).isNull() | F.col(f"_known_{fk}")) for fk, _, _ in self.parents]

    def checked(self, landing: DataFrame, parents: dict[str, DataFrame]) -> DataFrame:
        """Deduped, cleaned rows of one delivery, each with what its rules ask of it:
        _read_<column> and _known_<column>."""
        data = [c.name for c in self.columns]
        rows = self.clean(L.drop_full_duplicates(landing.select(*data, "_date", "_chunk")))
        for fk, parent, pk in self.parents:
            # loaded tables have one row a key, so no row is multiplied
            known = parents[parent].select(F.col(pk).alias(fk), F.lit(True).alias(f"_known_{fk}"))
            rows = rows.join(known, fk, "left").withColumn(f"_known_{fk}", F.coalesce(f"_known_{fk}", F.lit(False)))
        return rows

    def ingest(self, landing: DataFrame, parents: dict[str, DataFrame], target: DataFrame | None = None, at: str | None = None) -> tuple[DataFrame, DataFrame]:
        """(rows to append, quarantined rows with failed_rules) of one delivery; parents are
        the loaded tables by entity name.  One split decides row rules and parents.  With a
        path, the checked rows are written there first: both sides read them, and the rules
        are asked of columns.  In one plan, the optimizer asks them of each landed row, every
        column spelled out from the source's, in a method that is too long to be compiled."""
        data = [c.name for c in self.columns]
        rows = self.checked(landing, parents)
        if at:
            rows.write.mode("overwrite").parquet(at)
            rows = rows.sparkSession.read.schema(rows.schema).parquet(at)
        keep = [*data, *L.LINEAGE]
        valid, rejected = split_valid(rows, self.rules())
        rejected = rejected.select(*keep, "failed_rules")
        loaded = L.insert_if_absent(valid.select(*keep), target, self.key, list(self.order))
        for c in self.unique:
            # of rows that share the value the first written stays
            first = loaded.groupBy(c).agg(F.min_by(self.key, F.struct(*L.LINEAGE, self.key)).alias("_first"))
            marked = loaded.join(first, c)
            again = marked.where(F.col(self.key) != F.col("_first")).select(*keep, F.array(F.lit(f"{c}_unique")).alias("failed_rules"))
            rejected = rejected.unionByName(again)
            loaded = marked.where(F.col(self.key) == F.col("_first")).select(*keep)
        return loaded.select(*keep), rejected


def load_order(specs: dict[str, Spec]) -> list[str]:
    """Entity names, parents before children (C11); a cycle raises."""
    return list(TopologicalSorter({n: sorted({p for _, p, _ in s.parents}) for n, s in sorted(specs.items())}).static_order())


def ancestors(specs: dict[str, Spec], name: str) -> set[str]:
    out = {p for _, p, _ in specs[name].parents}
    return out.union(*(ancestors(specs, p) for p in out)) if out else out


def load(landings: dict[str, DataFrame], specs: dict[str, Spec] | None = None, root: str | None = None, checked: str | None = None) -> dict[str, tuple[DataFrame, DataFrame]]:
    """(loaded, quarantined) of each landed entity, in the order of loading; a landed
    entity's parents must be landed too.  With a root each entity's tables are written to
    root/raw and root/quarantine before its children read them, so a parent is computed
    once; without, they are plans.  The checked rows are written below checked (root/checked
    by default); without either, they are in the plan."""
    specs = specs or SPECS
    checked = checked or (root and f"{root}/checked")
    out: dict[str, tuple[DataFrame, DataFrame]] = {}
    for name in load_order(specs):
        if name not in landings:
            continue
        loaded, rejected = specs[name].ingest(landings[name], {p: out[p][0] for _, p, _ in specs[name].parents}, at=checked and f"{checked}/{name}")
        if root:
            loaded, rejected = _written(loaded, f"{root}/raw/{name}", specs[name].key), _written(rejected, f"{root}/quarantine/{name}", specs[name].key)
        out[name] = loaded, rejected
    return out


def _written(df: DataFrame, path: str, key: str) -> DataFrame:
    df.sortWithinPartitions(key).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_ROUTE, _VEHICLE, _OPERATOR, _PAX = r"^R\d{2,}$", r"^VHC-\d{3,}$", r"^OPR-\d{3,}$", r"^PAX-\d{4,}$"

# The payloads' columns, rules, defaults and parents.  Codes are padded to a
# least width; ids past it are longer, not invalid.
SPECS: dict[str, Spec] = {s.name: s for s in (
    Spec("routes", (
        Col("route_id", pattern=_ROUTE), Col("route_name", length=(3, 100)), Col("origin", length=(2, 100)), Col("destination", length=(2, 100)),
        Col("district_covered", length=(2, 50)), Col("route_length_km", "number", above=0, hi=200), Col("num_stops", "int", lo=1, hi=100),
        Col("base_fare_php", "number", lo=13.0, default=13.0), Col("peak_frequency_min", "int", lo=1, hi=120), Col("off_peak_frequency_min", "int", lo=1, hi=180),
        Col("is_active", "flag", default=True)),
        checks=(("headway_order", "off_peak_frequency_min >= peak_frequency_min"),), order=("route_name",)),
    Spec("operators", (
        Col("operator_id", pattern=_OPERATOR), Col("operator_name", length=(2, 150)), Col("contact_number", length=(7, 20)),
        Col("franchise_type", values=tuple(K.FRANCHISE_TYPES)), Col("num_units", "int", lo=1, hi=100), Col("base_district", length=(2, 50)),
        Col("is_compliant_puv", "flag", default=True)), order=("operator_name",)),
    Spec("stops", (
        Col("stop_id", pattern=r"^S\d{3,}$"), Col("stop_name", length=(2, 150)), Col("barangay", length=(2, 100)), Col("district", length=(2, 50)),
        Col("latitude", "number", lo=6.8, hi=7.5), Col("longitude", "number", lo=125.0, hi=126.0), Col("stop_type", values=tuple(K.STOP_TYPES)),
        Col("has_shelter", "flag", default=False), Col("avg_daily_boardings", "int", lo=0), Col("route_id", pattern=_ROUTE)),
        parents=(("route_id", "routes", "route_id"),), order=("stop_name",)),
    Spec("vehicles", (
        Col("vehicle_id", pattern=_VEHICLE), Col("plate_number", length=(5, 15)), Col("vehicle_type", values=tuple(K.VEHICLE_TYPES)), Col("capacity", "int", lo=10, hi=30),
        Col("fuel_type", values=tuple(K.FUEL_TYPES)), Col("year_manufactured", "int", lo=2000, hi=2025), Col("route_assigned", pattern=_ROUTE),
        Col("operator_id", pattern=_OPERATOR), Col("avg_fuel_cost_daily_php", "number", above=0), Col("is_active", "flag", default=True)),
        parents=(("route_assigned", "routes", "route_id"), ("operator_id", "operators", "operator_id")), unique=("plate_number",), order=("plate_number",)),
    Spec("trips", (
        Col("trip_id", pattern=r"^TRP-\d{7,}$"), Col("route_id", pattern=_ROUTE), Col("vehicle_id", pattern=_VEHICLE), Col("trip_date", "date"),
        Col("time_period", values=tuple(K.TIME_PERIODS)), Col("day_of_week", values=tuple(K.WEEKDAYS)), Col("passengers_boarded", "int", lo=1, hi=50),
        Col("revenue_php", "number", lo=0), Col("travel_time_min", "int", lo=1), Col("scheduled_time_min", "int", lo=1), Col("delay_min", "int", lo=0, default=0),
        Col("is_on_time", "flag"), Col("is_rainy_day", "flag", default=False), Col("load_factor", "number", lo=K.LOAD_FACTOR_RANGE[0], hi=K.LOAD_FACTOR_RANGE[1])),
        parents=(("route_id", "routes", "route_id"), ("vehicle_id", "vehicles", "vehicle_id")),
        checks=(("on_time_implies_small_delay", f"not is_on_time or delay_min <= {K.ON_TIME_MAX_DELAY_MIN}"),), order=tuple(L.TRIP_ORDER)),
    Spec("passengers", (
        Col("passenger_id", pattern=_PAX), Col("survey_date", "date"), Col("origin_barangay", length=(2, 100)), Col("origin_district", length=(2, 50)),
        Col("destination_type", values=tuple(K.DESTINATION_TYPES)), Col("trip_purpose", values=tuple(K.TRIP_PURPOSES)), Col("primary_route_used", pattern=_ROUTE),
        Col("trips_per_week", "int", lo=0, hi=14), Col("avg_fare_paid_php", "number", above=0), Col("transfers_required", "int", lo=0, hi=3),
        Col("wait_time_min", "int", lo=0), Col("travel_time_min", "int", lo=1), Col("satisfaction_score", "int", lo=1, hi=5), Col("income_bracket", values=tuple(K.INCOME_BRACKETS)),
        Col("prefers_aircon", "flag", default=False)),
        parents=(("primary_route_used", "routes", "route_id"),), order=tuple(L.PASSENGER_ORDER)),
    Spec("experiment", (
        Col("experiment_record_id", pattern=r"^ABR-\d{7,}$", length=(3, 20)), Col("experiment_id", length=(1, 10), default="EXP-001"), Col("passenger_id", pattern=_PAX),
        Col("cluster_id", "int", lo=3, hi=3), Col("group", values=tuple(K.AB_GROUPS)), Col("route_variant", values=("A_current", "B_express")),
        Col("test_week", "int", lo=1, hi=8), Col("simulated_travel_time_min", "number", above=0), Col("simulated_fare_php", "number", above=0),
        Col("transfers_needed", "int", lo=0, hi=3), Col("satisfaction_score", "int", lo=1, hi=5), Col("would_use_again", "flag")),
        parents=(("passenger_id", "passengers", "passenger_id"),),
        checks=(("group_variant_alignment", "(`group` = 'control') = (route_variant = 'A_current')"),), order=tuple(L.EXPERIMENT_ORDER)),
)}
