"""The physical plans are the ones wanted at scale."""

from __future__ import annotations

import datetime as dt
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from closeline.operators import copies, extracts
from closeline.operators import kpis as k
from closeline.operators.extracts import latest_follow_ups
from closeline.operators.joins import left_join_hot_right, left_join_salted
from closeline.plans import closings, forecast, report
from closeline.sources.schemas import SCHEMAS
from closeline.sources.tables import from_catalog, from_files, from_frames

from .conftest import AS_OF, SF_DIR, frame

# The optional corpus queries choose their plans on their own.
QUERIES = {k: q for k, q in entry.queries().items() if not re.match(r"op\d+_|pipeline$", k)}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", QUERIES)
def test_no_nested_loops_no_python(spark, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "MapIn"):
        assert operator not in text


GLOBAL = {
    # Over a calendar, whose size is a number of days.
    "date_series",
    "business_days",
    "business_days_without_bank_holidays",
    "business_day_offsets",
}


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in GLOBAL])
def test_no_single_partition_outside_the_calendar(spark, name):
    """Only the as-of offsets, a scalar subquery over the calendar, are global."""
    text = plan(QUERIES[name](spark, SF_DIR)).split("Subquery", 1)[0]
    assert "SinglePartition" not in text


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Empty lending tables as parquet files, one directory each."""
    root = str(tmp_path_factory.mktemp("lending"))
    for name, ddl in SCHEMAS.items():
        table = frame(spark, name, []) if ddl else spark.range(0)
        table.write.parquet(f"{root}/{name}")
    return root


def scans(df) -> dict[str, list[str]]:
    """Scanned columns and pushed filters by table."""
    found: dict[str, list[str]] = {}
    for line in plan(df).splitlines():
        if "FileScan" in line:
            table = re.search(r"/(\w+)\]?, Part", line).group(1)
            found.setdefault(table, []).append(line)
    return found


def test_filters_and_columns_reach_the_files(spark, stored):
    found = scans(closings.coordinator_closings(from_files(spark, stored)))
    (line, *_) = found["applications"]
    assert "In(state, [" in line and "EqualTo(closing_status,confirmed)" in line
    read = re.search(r"ReadSchema: struct<([^>]*)>", line).group(1)
    names = {field.split(":")[0] for field in read.split(",")}
    assert names == {"id", "state", "closing_status", "project_coordinator_id"}


def test_forecast_prunes_before_it_shuffles(spark, stored):
    tables = from_files(spark, stored)
    found = scans(forecast.loan_officer_monthly_forecast(tables, AS_OF, unique_applications=True))
    assert len(found["projections"]) == 1
    assert "EqualTo(table_type,dynamic projections)" in found["projections"][0]
    (loans,) = found["loans"]
    assert "GreaterThanOrEqual(settlement_date,1998-06-01)" in loans


@pytest.mark.parametrize("kpi", [k.CLOSING, k.APPRAISAL_MISSING, k.CDA], ids=lambda kpi: kpi.name)
def test_gates_reach_the_files(spark, stored, clock, kpi):
    lines = scans(k.classify(from_files(spark, stored), clock(), kpi))["applications"]
    for line in lines:
        pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", line).group(1)
        assert ("type" if kpi is k.CDA else "Not(In(state") in pushed


@pytest.mark.parametrize(
    "kpi",
    [k.CLOSING, k.BORROWER_FOLLOW_UP, k.TITLE_ORDER_CONFIRMATION, k.TITLE_FOLLOW_UP],
    ids=lambda kpi: kpi.name,
)
def test_loans_are_counted_by_hash_before_they_are_joined(spark, stored, clock, kpi):
    """A row per set of facts of an application reaches the join, whoever is hot."""
    df = k.classify(from_files(spark, stored), clock(), kpi)
    text = plan(df)
    assert "SortAggregate" not in text
    assert re.search(r"keys=\[application_id#\w+, loan_facts#\w+\], functions=\[partial_count", text)
    found = scans(df)
    assert len(found["loans"]) == 1 and len(found["applications"]) == 1


def test_counted_rows_are_spelt_out(spark, monkeypatch):
    monkeypatch.setattr(copies, "COPY_BLOCK", 3)
    rows = spark.createDataFrame([(1, 7), (2, 3), (3, 1), (4, None)], "n int, copies long")
    found = Counter(r.n for r in copies.spelt_out(rows, "n").collect())
    assert found == {1: 7, 2: 3, 3: 1, 4: 1}


def test_reviews_scan_each_stage_table_once(spark, stored, clock):
    found = scans(k.classify(from_files(spark, stored), clock(), k.WELCOME_CALL))
    # The open reviews prune each stage table before its facts are combined.
    assert len(found["applications"]) <= 3
    assert len(found["deal_stage_dates"]) == len(found["deal_stage_time_stamps"]) == 1


def held_by_stage(spark, df) -> list[int]:
    """Sorts and aggregates of each stage, all of which one task of it holds."""
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {key: spark.conf.get(key) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        # Planned anew, under these settings.
        node = df.select("*")._jdf.queryExecution().executedPlan()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    stages, heads = [], [node]
    while heads:
        held, nodes = 0, [heads.pop()]
        while nodes:
            node = nodes.pop()
            held += node.nodeName() in ("Sort", "HashAggregate", "SortAggregate", "ObjectHashAggregate")
            for below in (node.children().apply(i) for i in range(node.children().size())):
                if below.nodeName() == "ReusedExchange":
                    continue
                if "Exchange" in below.nodeName():
                    heads.append(below.children().apply(0))
                else:
                    nodes.append(below)
        stages.append(held)
    return stages


def test_review_dates_are_not_all_joined_and_counted_by_one_task(spark, stored):
    df = extracts.prelim_review_date(from_files(spark, stored))
    # At most the applications' count and the three sides of two joins.
    assert max(held_by_stage(spark, df)) <= 4


def test_report_scans_each_table_once(spark, stored, clock):
    found = scans(report.application_report(from_files(spark, stored), clock()))
    counts = {table: len(lines) for table, lines in found.items()}
    # Applications also prune the loans; contacts are coordinators and borrowers.
    assert counts.pop("applications") == 2 and counts.pop("contacts") == 2
    assert set(counts.values()) == {1}
    assert {"loans", "loan_follow_ups", "property_valuations", "term_sheets"} <= set(counts)
    assert "In(state" in found["applications"][0] or "NOT" in found["applications"][0]
    assert not {"deal_stage_dates", "deal_product_channel"} & set(counts)


def test_report_rows_plan_the_loans_once(spark, stored, clock):
    """Blocks are summed up and joined from one shuffle by application and block."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = report.application_report_rows(from_files(spark, stored), clock())
        text, found = plan(df), scans(df)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert all(len(found[t]) == 1 for t in ("loans", "loan_follow_ups", "property_valuations"))
    dealt = r"hashpartitioning\(application_id#\w+, block#\w+, \d+\), REPARTITION_BY_COL"
    assert len(re.findall(rf"(?<!ReusedExchange )\+- Exchange {dealt}", text)) == 1
    assert re.search(rf"ReusedExchange \[.*Exchange {dealt}", text)
    # The last join is by application and block, so that a hot application is split.
    (join, *_) = re.findall(r"(?:SortMergeJoin|HashJoin) \[([^\]]*)\]", text)
    assert "application_id" in join and "block" in join


def input_rows(spark, df, aggregate: str) -> int:
    """Rows that came out of the child of the aggregate whose text holds `aggregate`."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        fresh = df.select("*")
        # Run once, so that its nodes have counted their rows.
        nodes = [fresh._jdf.queryExecution().executedPlan()]
        nodes[0].executeCollect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    while nodes:
        node = nodes.pop()
        nodes += [node.children().apply(i) for i in range(node.children().size())]
        if "Aggregate" in node.nodeName() and aggregate in node.simpleString(100):
            while True:
                node = node.children().apply(0)
                rows = node.metrics().get("numOutputRows")
                if rows.isDefined():
                    return rows.get().value()
    raise AssertionError(f"no aggregate of {aggregate}")


def test_costs_and_channels_are_thinned_before_they_are_counted(spark, lending):
    tables = lending(
        applications=[
            {"id": n, "state": "final_terms", "closing_status": "confirmed", "loan_officer_id": 1}
            for n in range(4)
        ],
        loans=[
            {
                "id": n,
                "application_id": n,
                "total_amount": 5,
                "appraisal_paid_at": dt.datetime(1998, 6, 1),
                "settlement_date": AS_OF if n == 2 else dt.date(1998, 1, 1),
            }
            for n in range(4)
        ],
        loan_closing_costs=[{"loan_id": n} for n in range(4) for _ in range(7)],
        contacts=[{"id": 1, "first_name": "Ann", "last_name": "Lee"}],
    )
    df = forecast.closing_calendar(tables, AS_OF)
    assert [r.closing_calendar_amount for r in df.collect()] == [35]
    assert input_rows(spark, df, "partial_sum(total_amount") == 7
    numbers = [{"id": n, "application_id": n, "internal_id": f"L{n}"} for n in range(9)]
    tables = lending(
        applications=[
            {"id": n, "state": "closed", "closing_status": "confirmed", "project_coordinator_id": 1}
            for n in (2, 5)
        ],
        loans=numbers,
        contacts=[{"id": 1, "first_name": "Ann", "last_name": "Lee"}],
        team_assignments=[{"team_member_name": "Ann Lee", "team": "PC"}],
        deal_product_channel=[{"internal_id": n["internal_id"]} for n in numbers for _ in range(3)],
    )
    df = closings.coordinator_closings(tables)
    assert len(df.collect()) == 6
    assert input_rows(spark, df, "keys=[internal_id") <= 6 < 27


def test_aggregates_combine_before_the_shuffle(spark, stored):
    text = plan(latest_follow_ups(from_files(spark, stored)["loan_follow_ups"]))
    before = text.split("Exchange hashpartitioning", 1)[1]
    assert "partial_max" in before


def test_catalog_tables(spark, stored):
    spark.read.parquet(f"{stored}/loans").createOrReplaceTempView("raw_loans")
    tables = from_catalog(spark, {"loans": "raw_loans"})
    assert closings.appraisal_payments(tables["loans"]).count() == 0


def test_missing_columns_are_reported(spark):
    tables = from_frames({"loans": spark.range(1)})
    with pytest.raises(ValueError, match="lacks columns"):
        tables["loans"]
    with pytest.raises(KeyError):
        tables["unknown"]


def test_other_types_are_reported(spark):
    costs = spark.createDataFrame([("1",)], "loan_id string")
    with pytest.raises(ValueError, match="loan_id string, not long"):
        from_frames({"loan_closing_costs": costs})["loan_closing_costs"]
    narrow = spark.createDataFrame([(1,)], "loan_id int")
    assert from_frames({"loan_closing_costs": narrow})["loan_closing_costs"].count() == 1


@pytest.fixture
def small_partitions(spark):
    """Thresholds under which a few megabytes count as a skewed partition."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key in settings:
        spark.conf.unset(key)


def hot_loans(spark, rows=200_000):
    """A third of all loans belong to application 1."""
    loans = spark.range(rows, numPartitions=8).selectExpr(
        "id",
        "IF(id % 3 = 0, 1, id) AS application_id",
        "uuid() AS internal_id",
        "DATE '1998-07-20' AS settlement_date",
        "CAST(1 AS decimal(18,2)) AS total_amount",
        "CAST(NULL AS timestamp_ntz) AS appraisal_paid_at",
        "'purchase' AS transaction_purpose",
        "1 AS properties_count",
    )
    apps = spark.range(0, rows, 1, 8).selectExpr(
        "id",
        "'initial_terms' AS state",
        "TIMESTAMP_NTZ '1998-06-01 12:00:00' AS submitted_to_initial_underwriting_at",
    )
    others = [
        f"CAST(NULL AS {kind}) AS {name}"
        for name, kind in (field.split() for field in SCHEMAS["applications"].split(", "))
        if name not in apps.columns
    ]
    return from_frames({"loans": loans, "applications": apps.selectExpr("*", *others)})


def test_a_hot_application_is_split(spark, clock, small_partitions):
    tables = hot_loans(spark)
    applications = tables["applications"].withColumnRenamed("id", "application_id")
    loans = tables["loans"].select("application_id", "internal_id")
    shown = ["application_id", F.hash("internal_id")]
    plain = applications.join(loans, "application_id", "left").select(shown)
    split = left_join_hot_right(applications, loans, "application_id")
    split = split.select(shown)
    found, expected = split.collect(), plain.collect()
    assert Counter(r[0] for r in found) == Counter(r[0] for r in expected)
    assert "skew=true" in plan(split) and "skew=true" not in plan(plain)


def test_left_join_keeps_rows_without_a_key(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, None)], "n int, k string")
    right = spark.createDataFrame([("b", 7), ("b", 8), (None, 9), ("x", 5)], "k string, v int")
    expected = left.join(right, "k", "left").select("n", "k", "v").collect()
    found = left_join_hot_right(left, right, "k")
    assert sorted(map(str, found.select("n", "k", "v").collect())) == sorted(map(str, expected))


@pytest.mark.parametrize("heavy", [1, 2, 100])
def test_salted_left_joins_are_plain_ones(spark, heavy):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, None), (5, "c")], "n int, k string")
    rows = [("b", v) for v in (7, 7, 8, None)] + [(None, 9), ("x", 5), ("c", 1)]
    right = spark.createDataFrame(rows, "k string, v int")
    below = spark.createDataFrame([(7, i) for i in range(5)] + [(1, 0), (None, 1)], "v int, w int")
    expected = left.join(right, "k", "left").join(below, "v", "left").select("n", "k", "v", "w")
    found = left_join_salted(
        left,
        (right, "k", F.monotonically_increasing_id()),
        (below, "v", F.col("w")),
        heavy=heavy,
    )
    assert found.columns == ["v", "k", "n", "w"]
    assert Counter(found.select("n", "k", "v", "w").collect()) == Counter(expected.collect())
    for empty in (left.limit(0), left):
        rights = right if empty.isEmpty() else right.limit(0)
        found = left_join_salted(empty, (rights, "k", F.col("v")), heavy=heavy)
        assert found.count() == empty.count()


def test_a_heavy_application_is_dealt_to_several_tasks(spark, small_partitions):
    tables = hot_loans(spark)
    applications = tables["applications"].selectExpr("id AS application_id")
    loans = tables["loans"].selectExpr("application_id", "id AS loan_id")
    step = (loans, "application_id", F.col("loan_id"))
    for heavy, tasks in ((1 << 20, 1), (1 << 12, 2)):
        joined = left_join_salted(applications, step, heavy=heavy).filter("application_id = 1")
        dealt = joined.groupBy(F.spark_partition_id()).count().collect()
        assert sum(r["count"] for r in dealt) == 66_668
        assert len(dealt) >= tasks
        if tasks > 1:
            assert max(r["count"] for r in dealt) < 66_668 / 2


def test_appraisal_rows_join_each_table_once(spark, stored, clock):
    df = k.classify(from_files(spark, stored), clock(), k.CDA)
    text = plan(df)
    joins = re.findall(r"(?:SortMerge|BroadcastHash|ShuffledHash)Join \[\w+#\d+L?, _part", text)
    assert len(joins) == 3


def test_a_hot_application_reaches_the_shuffle_combined(spark, clock):
    """Per application grain, no task sees more than a row per map task of it."""
    tables = hot_loans(spark, 30_000)
    df = k.classify(tables, clock(), k.CLOSING, "application")
    text = plan(df)
    assert re.search(r"partial_bit_or", text)
    found = df.groupBy("closing_kpi").agg(F.count("*")).collect()
    assert sum(r[1] for r in found) == 30_000
