"""The constraint graph: rules, defaults, parents, order, quarantine."""

import pytest
from pyspark.sql import functions as F

from routewise.sources.constraints import SPECS, Col, Spec, ancestors, load, load_order

LINE = "_chunk int, _date string"


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, f"{schema}, {LINE}").withColumn("_date", F.to_date("_date"))


TINY = {s.name: s for s in (
    Spec("child", (Col("id", pattern=r"^C\d+$"), Col("parent_id"), Col("on", "date"), Col("ok", "flag", default=True), Col("x", "number", above=0, default=1.5), Col("tag", length=(2, 3), values=("aa", "bbb"))),
         parents=(("parent_id", "parent", "id"),), unique=("tag",), checks=(("x_below_nine", "x < 9"),), order=("tag",)),
    Spec("parent", (Col("id"), Col("n", "int", lo=0))),
)}


def tiny(spark):
    parents = frame(spark, [("P1", 1, 0, "2024-01-01"), ("P2", -1, 0, "2024-01-01"), (" P3 ", 3, 0, "2024-01-01"), ("P3", 4, 0, "2024-01-02")], "id string, n int")
    nan = float("nan")
    children = frame(spark, [
        ("C1", "P1", "2024-02-01", " TRUE ", 2.0, "aa", 0, "2024-01-01"), ("C1", "P1", "2024-02-01", "true", 3.0, "aa", 0, "2024-01-02"),  # a later writer
        ("C2", "P2", "2024-02-01", "no", 2.0, "bbb", 0, "2024-01-01"),      # its parent was quarantined
        ("C3", "P3", "2024-02-30", "perhaps", nan, "", 0, "2024-01-01"),    # unreadable, defaulted, missing
        ("X4", None, None, None, 9.0, "cccc", 0, "2024-01-01"),             # breaks nearly all
        ("C5", "P3", "2024-02-05", None, None, "bbb", 0, "2024-01-01"),     # defaults
        ("C6", "P1", "2024-02-05", "0", 1.0, "aa", 0, "2024-01-03"),        # repeats a unique value
    ], "id string, parent_id string, on string, ok string, x double, tag string")
    return {"child": children, "parent": parents}


@pytest.mark.parametrize("written", [False, True])
def test_rules_defaults_orphans_and_unique_values(spark, tmp_path, written):
    out = load(tiny(spark), TINY, str(tmp_path) if written else None)
    assert {r.id: r.n for r in out["parent"][0].collect()} == {"P1": 1, "P3": 3}
    rows = {r.id: (r.parent_id, str(r.on), r.ok, r.x, r.tag) for r in out["child"][0].collect()}
    assert rows == {"C1": ("P1", "2024-02-01", True, 2.0, "aa"), "C5": ("P3", "2024-02-05", True, 1.5, "bbb")}
    bad = {r.id: sorted(r.failed_rules) for r in out["child"][1].collect()}
    assert bad == {"C2": ["parent_id_known"], "C3": ["ok_type", "on_type", "tag_present"], "C6": ["tag_unique"],
                   "X4": sorted(["id_pattern", "parent_id_present", "on_present", "x_below_nine", "tag_length", "tag_enum"])}


def test_insert_into_a_target(spark):
    landings = tiny(spark)
    first = TINY["parent"].ingest(landings["parent"], {})[0]
    assert TINY["parent"].ingest(landings["parent"], {}, first)[0].collect() == []


def test_order_of_loading():
    order = load_order(SPECS)
    assert sorted(order) == sorted(SPECS) and len(order) == 7
    assert all(order.index(p) < order.index(n) for n, s in SPECS.items() for _, p, _ in s.parents)
    assert ancestors(SPECS, "trips") == {"routes", "operators", "vehicles"} and ancestors(SPECS, "experiment") == {"passengers", "routes"}
    loop = {"a": Spec("a", (Col("id"),), parents=(("id", "b", "id"),)), "b": Spec("b", (Col("id"),), parents=(("id", "a", "id"),))}
    with pytest.raises(ValueError):
        load_order(loop)


def test_landing_schema_holds_dates_and_flags_as_text():
    kinds = {f.name: f.dataType.simpleString() for f in SPECS["trips"].landing_schema().fields}
    assert kinds["trip_date"] == kinds["is_on_time"] == "string" and kinds["delay_min"] == "int" and kinds["_chunk"] == "int"


def test_checked_rows_written_first_give_the_same_tables(spark, tmp_path):
    plain, written = load(tiny(spark), TINY), load(tiny(spark), TINY, checked=str(tmp_path))
    for name in TINY:
        for a, b in zip(plain[name], written[name]):
            assert a.columns == b.columns and sorted(map(str, a.collect())) == sorted(map(str, b.collect())) != []


@pytest.mark.parametrize("name", ["trips", "vehicles", "experiment"])
def test_rules_are_asked_of_columns_by_methods_that_get_compiled(spark, tmp_path, name):
    """HotSpot compiles no method over 8000 bytes; rules spelled out from the source's
    columns made ones of over 20000, run for each landed row."""
    import re

    from routewise.sources.deliveries import landed
    from routewise.sources.standin import Entities

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        E = Entities(spark, "/root/testdata/sf0.001")
        for df in load(landed(E, ancestors(SPECS, name) | {name}), checked=str(tmp_path))[name]:
            mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
            sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", df._jdf.queryExecution().explainString(mode))]
            assert sizes and max(sizes) < 8000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
