"""Lending tables derived from the driver's star schema.

The driver's tables have no lending columns, so orders, line items, suppliers and
customers are read as applications, loans and so on.  Every table is a Spark plan
over the parquet files and grows with them.  The oracle derives the same tables
in SQL.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from closeline.constants import (
    BORROWER,
    BRIDGE_TYPE,
    COORDINATOR_TEAM,
    EXCLUDED_CHANNEL,
    INITIAL_TERMS_SHEET,
    NEW_CONSTRUCTION,
    PROJECTION_ROWS,
    RENTAL_TYPE,
    STATES,
    TITLE,
)
from closeline.operators.calendar import Clock, business_days, date_series
from closeline.sources.schemas import SCHEMAS
from closeline.sources.tables import LendingTables

ANCHOR = dt.date(1998, 6, 17)
AS_OF = ANCHOR
EVENTS_AS_OF = dt.datetime(2024, 1, 15, 12, 30)
CALENDAR_FROM, CALENDAR_LENGTH = dt.date(1990, 1, 1), 20_000

LOAN_ID_BASE = 500_000_000_000
SECOND_LOAN_BASE = 600_000_000_000
CUSTOMER_CONTACT_BASE = 1_000_000_000_000

# Columns used of the driver's files.
FILES = {
    "orders": (
        "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, "
        "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "customer": "c_custkey long, c_name string",
    "supplier": "s_suppkey long, s_name string",
    "events": "event_id long, ts timestamp_ntz",
}

STATE_ARRAY = "array({})".format(", ".join(f"'{state}'" for state in STATES))

APPLICATION_TYPE = f"""CASE WHEN priority IN ('1', '2') THEN '{BRIDGE_TYPE}'
    WHEN priority IN ('3', '4') THEN '{RENTAL_TYPE}' ELSE 'Application::Other' END"""

CLOSING_STATUS = """CASE WHEN u % 7 != 0 THEN
    CASE status WHEN 'F' THEN 'confirmed' WHEN 'O' THEN 'likely' WHEN 'P' THEN 'not_confirmed' END
    END"""

# Rows repeated where the condition holds.
REPEAT = "explode(sequence(1, IF({}, 2, 1))) AS copy"

PROPERTY_ID = "(k * 8 + line) * 1000000 + part % 1000 * 1000 + supplier % 1000"


def near_anchor(date: str, days: int) -> str:
    """Fold a date into the `days` days ending at the anchor."""
    return f"date_sub(DATE '{ANCHOR}', pmod(datediff(DATE '{ANCHOR}', {date}), {days}))"


def moment(date: str) -> str:
    return f"CAST({date} AS timestamp_ntz)"


def state_of(key: str) -> str:
    return f"element_at({STATE_ARRAY}, CAST({key} % {len(STATES)} + 1 AS INT))"


# --- named days ----------------------------------------------------------------


HOLIDAYS = """CASE
    WHEN month(d) = 1 AND day(d) = 1 THEN 'New Year\\'s Day'
    WHEN month(d) = 1 AND dayofweek(d) = 2 AND day(d) BETWEEN 15 AND 21
        THEN 'Martin Luther King Day'
    WHEN month(d) = 5 AND dayofweek(d) = 2 AND day(d) > 24 THEN 'Memorial Day'
    WHEN month(d) = 6 AND day(d) = 16 THEN 'Founders Day'
    WHEN month(d) = 6 AND day(d) = 19 THEN 'Juneteenth National Independence Day'
    WHEN month(d) = 7 AND day(d) = 4 THEN 'Independence Day'
    WHEN month(d) = 9 AND dayofweek(d) = 2 AND day(d) <= 7 THEN 'Labor Day'
    WHEN month(d) = 11 AND dayofweek(d) = 5 AND day(d) BETWEEN 22 AND 28 THEN 'Thanksgiving'
    WHEN month(d) = 11 AND dayofweek(d) = 6 AND day(d) BETWEEN 23 AND 29
        THEN 'Day after Thanksgiving (Black Friday)'
    WHEN month(d) = 12 AND day(d) = 24 THEN 'Christmas Eve'
    WHEN month(d) = 12 AND day(d) = 25 THEN 'Christmas Day' END"""

BANK_HOLIDAYS = """CASE WHEN month(d) = 11 AND day(d) = 11 THEN 'Veterans Day'
    WHEN month(d) = 10 AND dayofweek(d) = 2 AND day(d) BETWEEN 8 AND 14 THEN 'Columbus Day' END"""


def holidays_in(series: DataFrame) -> DataFrame:
    """Holidays among the days of a series; Founders Day is not a day off."""
    days = series.withColumnRenamed("date_value", "d")
    return days.selectExpr("d AS holiday_date", f"{HOLIDAYS} AS name").filter("name IS NOT NULL")


def bank_holidays_in(series: DataFrame) -> DataFrame:
    """Bank holidays among the days of a series, each listed twice."""
    days = series.withColumnRenamed("date_value", "d")
    named = days.selectExpr(
        "d AS holiday_date", f"{BANK_HOLIDAYS} AS holiday_name", REPEAT.format("true")
    )
    return named.filter("holiday_name IS NOT NULL").drop("copy")


# --- lending tables --------------------------------------------------------------


class StarSchema:
    """The driver's parquet files as lending tables.

    `second_loans` gives applications with many properties a second loan; `repeated`
    gives an application a projection row per line item; `repeated_records` gives some
    applications several legal records, stage dates and stage time stamps.
    """

    def __init__(
        self,
        spark: SparkSession,
        sf_dir: str,
        *,
        second_loans: bool = False,
        repeated: bool = False,
        repeated_records: bool = False,
    ) -> None:
        self.spark = spark
        self.sf_dir = sf_dir
        self.second_loans = second_loans
        self.repeated = repeated
        self.repeated_records = repeated_records
        self._files: dict[str, DataFrame] = {}

    def read(self, name: str) -> DataFrame:
        if name not in self._files:
            # The known schema saves a job that would open the files for it.
            reader = self.spark.read.schema(FILES[name])
            self._files[name] = reader.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._files[name]

    def tables(self) -> LendingTables:
        return LendingTables(lambda name: getattr(self, name)())

    def orders(self) -> DataFrame:
        return self.read("orders").selectExpr(
            "o_orderkey AS k",
            "o_custkey AS u",
            "to_date(o_orderdate) AS od",
            "o_orderstatus AS status",
            "left(o_orderpriority, 1) AS priority",
            "CAST(o_totalprice AS decimal(18,2)) AS total",
        )

    def lines(self) -> DataFrame:
        return self.read("lineitem").selectExpr(
            "l_orderkey AS k",
            "l_linenumber AS line",
            "l_partkey AS part",
            "l_suppkey AS supplier",
            "l_returnflag AS flag",
            "l_linestatus AS status",
            "to_date(l_shipdate) AS sd",
        )

    def applications(self) -> DataFrame:
        return self.orders().selectExpr(
            "k AS id",
            f"{state_of('k')} AS state",
            f"{APPLICATION_TYPE} AS type",
            f"{CLOSING_STATUS} AS closing_status",
            "IF(k % 17 = 0, 'rejected', NULL) AS rejection_status",
            f"IF(k % 17 = 0, {moment('od')}, NULL) AS rejected_at",
            f"IF(k % 13 = 0, {moment('od')}, NULL) AS withdrawn_at",
            f"IF(k % 19 = 0, {moment('od')}, NULL) AS long_termed_at",
            "u % 5 = 0 AS portfolio",
            "CASE WHEN k % 11 = 0 THEN 3L WHEN k % 2 = 0 THEN 1L ELSE 2L END AS product_id",
            "u % 10 AS loan_officer_id",
            "IF(k % 23 != 0, u % 10, NULL) AS project_coordinator_id",
            f"IF(k % 20 > 4 AND k % 29 != 0, {moment(near_anchor('od', 90))}, NULL) "
            "AS submitted_to_initial_underwriting_at",
            f"{moment('od')} AS created_at",
            f"IF(k % 4 = 1, {moment(near_anchor('od', 45))}, NULL) AS in_conditions_review_from",
            f"IF(k % 6 = 2, {moment(near_anchor('od', 33))}, NULL) AS requested_for_ctc",
        )

    def _settlements(self) -> DataFrame:
        return (
            self.lines()
            .groupBy("k")
            .agg(
                F.expr(f"max(date_add({near_anchor('sd', 60)}, 40)) AS settles"),
                F.expr(f"min({near_anchor('sd', 40)}) AS paid"),
                F.expr("CAST(count(*) AS INT) AS properties_count"),
            )
            .selectExpr(
                "k", "IF(k % 9 != 0, settles, NULL) AS settles", "paid", "properties_count"
            )
        )

    def loans(self) -> DataFrame:
        first = (
            self._settlements()
            .join(self.orders().select("k", "u", "total"), "k")
            .selectExpr(
                f"k + {LOAN_ID_BASE} AS id",
                "k AS application_id",
                "concat('L', k) AS internal_id",
                "settles AS settlement_date",
                "total AS total_amount",
                f"IF(k % 5 != 0, {moment('paid')}, NULL) AS appraisal_paid_at",
                "element_at(array('purchase', 'refinance', 'other'), CAST(u % 3 + 1 AS INT)) "
                "AS transaction_purpose",
                "properties_count",
            )
        )
        if not self.second_loans:
            return first
        second = first.filter("properties_count > 3").selectExpr(
            f"application_id + {SECOND_LOAN_BASE} AS id",
            "application_id",
            "concat(internal_id, 'B') AS internal_id",
            "date_sub(settlement_date, 9) AS settlement_date",
            "total_amount",
            "appraisal_paid_at",
            "IF(transaction_purpose = 'other', 'purchase', 'other') AS transaction_purpose",
            "1 AS properties_count",
        )
        return first.unionByName(second)

    def loan_closing_costs(self) -> DataFrame:
        return self.lines().selectExpr(f"k + {LOAN_ID_BASE} AS loan_id")

    def loan_follow_ups(self) -> DataFrame:
        return self.lines().selectExpr(
            f"k + {LOAN_ID_BASE} AS loan_id",
            f"IF(part % 97 != 0, {moment(near_anchor('sd', 20))}, NULL) AS date",
            "CASE flag WHEN 'R' THEN 'email' WHEN 'A' THEN 'PHONE' ELSE 'text' END AS via",
            f"IF(status = 'O', '{TITLE}', '{BORROWER}') AS type",
        )

    def term_sheets(self) -> DataFrame:
        kind = (
            f"CASE flag WHEN 'A' THEN '{INITIAL_TERMS_SHEET}' "
            "WHEN 'R' THEN 'TermSheet::Revised' ELSE 'TermSheet::FinalTerms' END"
        )
        return self.lines().selectExpr(
            "k AS application_id",
            f"{moment(near_anchor('sd', 10))} AS created_at",
            f"{kind} AS type",
        )

    def _records(self, copies: str) -> DataFrame:
        """Orders, `copies` times each where records are repeated; `copy` counts from 0.

        A copy's dates lie `copy` days earlier.  Where an order's date is left out follows
        from `r`, its key moved on by a copy, so that copies differ in that as well.
        """
        last = f"{copies} - 1" if self.repeated_records else "0"
        rows = self.orders().selectExpr("*", f"explode(sequence(0, CAST({last} AS int))) AS copy")
        return rows.selectExpr("k", "k + copy AS r", "date_sub(od, copy) AS od")

    def legal_closing_informations(self) -> DataFrame:
        dates = {
            "kickoff_call_with_borrower_date": ("r % 3 != 0", 15),
            "term_sheet_reviewed_with_borrower_date": ("r % 3 = 1", 12),
            "title_commitment_order_date": ("r % 7 >= 4", 9),
            "title_commitment_most_recent_order_date": ("r % 7 = 6", 6),
            "preliminary_commitment_received_date": ("r % 3 = 2", 8),
        }
        return self._records("k % 4 + 1").selectExpr(
            "k AS application_id",
            *[
                f"IF({present}, {near_anchor('od', days)}, NULL) AS {name}"
                for name, (present, days) in dates.items()
            ],
        )

    def properties(self) -> DataFrame:
        return self.lines().selectExpr(f"{PROPERTY_ID} AS id", f"k + {LOAN_ID_BASE} AS loan_id")

    def property_valuations(self) -> DataFrame:
        cda = f"IF(supplier % 2 != 0, {near_anchor('sd', 5)}, NULL)"
        return self.lines().selectExpr(
            f"{PROPERTY_ID} AS property_id",
            f"IF(part % 3 = 0, {near_anchor('sd', 30)}, NULL) AS appraisal_approved_date",
            f"IF(part % 4 != 0, {near_anchor('sd', 25)}, NULL) AS appraisal_received_date",
            f"{cda} AS cda_order_date",
            f"{cda} AS cda_received_date",
        )

    def products(self) -> DataFrame:
        return self.spark.sql(
            "SELECT * FROM VALUES (1L, 'Bridge Loan'), (2L, 'Rental Loan'), "
            f"(3L, '{NEW_CONSTRUCTION}') AS products(id, name)"
        )

    def calendar(self) -> DataFrame:
        return date_series(self.spark, CALENDAR_FROM, CALENDAR_LENGTH)

    def holidays(self) -> DataFrame:
        return holidays_in(self.calendar())

    def bank_holidays(self) -> DataFrame:
        return bank_holidays_in(self.calendar())

    def contacts(self) -> DataFrame:
        """Suppliers are staff, customers are borrowers."""
        staff = self.read("supplier").selectExpr(
            "s_suppkey AS id",
            "split_part(s_name, '#', 1) AS first_name",
            "IF(s_suppkey % 10 != 7, split_part(s_name, '#', 2), NULL) AS last_name",
        )
        borrowers = self.read("customer").selectExpr(
            f"c_custkey + {CUSTOMER_CONTACT_BASE} AS id",
            "split_part(c_name, '#', 1) AS first_name",
            "split_part(c_name, '#', 2) AS last_name",
        )
        return staff.unionByName(borrowers)

    def team_assignments(self) -> DataFrame:
        members = self.read("supplier").selectExpr(
            "replace(s_name, '#', ' ') AS team_member_name",
            f"IF(s_suppkey % 3 != 0, '{COORDINATOR_TEAM}', 'Ops') AS team",
            REPEAT.format("s_suppkey % 10 = 5"),
        )
        return members.drop("copy")

    def borrowers(self) -> DataFrame:
        second = f"greatest(u - 1, 0) + {CUSTOMER_CONTACT_BASE}"
        return (
            self.orders()
            .selectExpr("k", "u", REPEAT.format("k % 10 = 3"))
            .selectExpr(
                "k AS application_id",
                f"IF(copy = 2, {second}, u + {CUSTOMER_CONTACT_BASE}) AS contact_id",
            )
        )

    def deal_stage_dates(self) -> DataFrame:
        date = f"IF(r % 7 != 0, {moment(near_anchor('od', 10))}, NULL)"
        rows = self._records("(k + 1) % 3 + 1")
        return rows.selectExpr("k AS application_id", f"{date} AS preliminary_review_date")

    def deal_stage_time_stamps(self) -> DataFrame:
        date = moment(near_anchor("od", 8))
        rows = self._records("k % 5 % 3 + 1")
        return rows.selectExpr("k AS application_id", f"{date} AS preliminary_review_date")

    def deal_product_channel(self) -> DataFrame:
        channel = (
            f"CASE u % 9 WHEN 0 THEN '{EXCLUDED_CHANNEL}' WHEN 1 THEN NULL "
            "ELSE 'Retail Channel' END"
        )
        rows = self.orders().selectExpr(
            "k AS application_id",
            "concat('L', k) AS internal_id",
            f"{channel} AS ops_channel",
            REPEAT.format("k % 6 = 4"),
        )
        return rows.drop("copy")

    def projections(self) -> DataFrame:
        rows = self._projections()
        if not self.repeated:
            return rows
        lines = self.lines().selectExpr(
            "k AS application_id",
            f"{near_anchor('sd', 25)} AS status_date",
            "CAST(part % 4 AS INT) AS shift",
        )
        moved = "IF(shift != 1, date_add(dynamic_settlement_date, shift), NULL)"
        return (
            rows.join(lines, "application_id")
            .withColumns(
                {
                    "closing_status_date": F.col("status_date"),
                    "deal_stage_date": F.expr("date_sub(deal_stage_date, shift * 9)"),
                    "dynamic_settlement_date": F.expr(moved),
                    "total_amount": F.expr("CAST(total_amount + shift AS decimal(18,2))"),
                }
            )
            .drop("shift", "status_date")
        )

    def _projections(self) -> DataFrame:
        settlements = self._settlements().select("k", "settles")
        return (
            self.orders()
            .join(settlements, "k", "left")
            .selectExpr(
                f"IF(k % 6 = 5, 'static projections', '{PROJECTION_ROWS}') AS table_type",
                "k AS application_id",
                "IF(k % 31 != 0, concat('Officer ', u % 10), NULL) AS loan_officer_name",
                "total AS total_amount",
                f"{state_of('k')} AS state",
                "CAST(0.25 * (1 + k % 4) AS decimal(9,4)) AS percent_close",
                "CASE u % 4 WHEN 1 THEN 'retail' WHEN 2 THEN 'tpo' WHEN 3 THEN 'wholesale' END "
                "AS department",
                f"substring_index({APPLICATION_TYPE}, '::', -1) AS product",
                "u % 5 = 0 AS portfolio",
                f"{CLOSING_STATUS} AS closing_status",
                f"{near_anchor('od', 25)} AS closing_status_date",
                f"{near_anchor('od', 80)} AS deal_stage_date",
                "IF(k % 4 != 0, settles, NULL) AS dynamic_settlement_date",
                "u % 45 + 0.5D * (k % 2) AS median_days_to_close",
                "10D AS median_days_from_unconfirmed_to_confirmed_bridge",
                "14D AS median_days_from_unconfirmed_to_confirmed_rental",
                "15D AS median_days_to_close_after_final_terms_bridge",
                "8D AS median_days_to_close_after_final_terms_rental",
            )
        )

    def deal_stage_stats(self) -> DataFrame:
        return (
            self.projections()
            .groupBy("state", "product")
            .agg(
                F.expr("count(*) AS deals"),
                F.expr("CAST(sum(total_amount) AS double) AS total_amount"),
                F.expr("min(deal_stage_date) AS first_stage_date"),
                F.expr("max(deal_stage_date) AS last_stage_date"),
            )
        )

    def event_tables(self) -> LendingTables:
        """Applications and legal records with a time of day, from events."""
        events = self.read("events")

        def shaped(table: str, **columns: str) -> DataFrame:
            fields = [field.split() for field in SCHEMAS[table].split(", ")]
            values = [(columns.get(name, f"CAST(NULL AS {kind})"), name) for name, kind in fields]
            return events.selectExpr(*[f"{value} AS {name}" for value, name in values])

        frames = {
            "applications": shaped(
                "applications",
                id="event_id",
                state=state_of("event_id"),
                submitted_to_initial_underwriting_at="ts",
            ),
            "legal_closing_informations": shaped(
                "legal_closing_informations",
                application_id="event_id",
                title_commitment_order_date="IF(event_id % 3 != 0, to_date(ts), NULL)",
            ),
        }
        return LendingTables(frames.__getitem__)

    def all_dates(self) -> DataFrame:
        """Every order and shipping date."""
        orders = self.orders().selectExpr("od AS day")
        return orders.unionByName(self.lines().selectExpr("sd AS day"))

    def clock(self, as_of: dt.date = AS_OF, as_of_ts: dt.datetime | None = None) -> Clock:
        moment_of = as_of_ts or dt.datetime.combine(as_of, dt.time(12, 30))
        days = business_days(self.calendar(), self.holidays())
        return Clock(days, as_of, moment_of)
