"""Monthly loan-officer forecast.

Each flag is a condition on one projection row, so where an application has one
row the flags are one projection over the table.  Where an application may have
several rows, its flags are those of any of its rows; `unique_applications=False`
computes them that way, from per-application booleans instead of self-joins.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from closeline.constants import (
    BRIDGE,
    CLOSING_CALENDAR_STATES,
    CONFIRMED,
    EARLY_GATE_STATES,
    EARLY_STATE_WEIGHT,
    EARLY_WEIGHT_STATES,
    FORECAST_DEPARTMENTS,
    LIKELY,
    LONG_TERM_DAYS,
    NOT_CONFIRMED,
    PROJECTION_ROWS,
    RENTAL,
)
from closeline.functions.dates import MonthOf, whole_days
from closeline.functions.ladders import both, either, quoted
from closeline.functions.text import full_name
from closeline.operators.copies import COPIES, spelt_out

Tables = Mapping[str, DataFrame]

ROW_COLUMNS = (
    "loan_officer_name",
    "total_amount",
    "state",
    "percent_close",
    "department",
    "application_id",
)
FLAGS = ("date_range", "status_flag", "stage_flag")
FORECAST_COLUMNS = (
    "loan_officer_name",
    "closing_calendar_amount",
    "loan_officer_id",
    "forecast_amount",
)
UNDATED = "dynamic_settlement_date IS NULL"


def forecast_base(projections: DataFrame) -> DataFrame:
    """The projection rows the forecast is made of."""
    return projections.filter(F.col("table_type") == PROJECTION_ROWS)


OPEN_FOR_CLOSING = (
    f"state IN ({quoted(CLOSING_CALENDAR_STATES)}) "
    f"AND closing_status IN ({quoted((CONFIRMED, LIKELY, NOT_CONFIRMED))}) "
    "AND withdrawn_at IS NULL AND rejection_status IS NULL"
)


def settles_paid(as_of: dt.date) -> str:
    """SQL: a loan with a paid appraisal settles in the month.

    Settlement is a date: with a time of day, rows late on the last day of the month
    fall outside these bounds.
    """
    month = MonthOf(as_of)
    settles = f"settlement_date BETWEEN DATE '{month.start}' AND DATE '{month.end}'"
    return f"appraisal_paid_at IS NOT NULL AND {settles}"


def closing_calendar(
    tables: Tables, as_of: dt.date, *, dedupe_costs: bool = False
) -> DataFrame:
    """Amount settling in the as-of month per officer.

    A loan counts once per closing-cost row it has, or once if `dedupe_costs`.
    Amounts are summed per officer before the next join, so that a busy officer is no
    hot key.
    """
    applications = (
        tables["applications"]
        .filter(OPEN_FOR_CLOSING)
        .selectExpr("id AS application_id", "loan_officer_id")
    )
    loans = (
        tables["loans"]
        .filter(settles_paid(as_of))
        .selectExpr("id AS loan_id", "application_id", "total_amount")
    )
    # One month's loans thin the costs of all before anything is summed; the inner join
    # can be split where one loan has very many.
    settling = applications.join(loans, "application_id")
    counted = settling.join(
        tables["loan_closing_costs"], "loan_id", "left_semi" if dedupe_costs else "inner"
    )
    by_officer = counted.groupBy("loan_officer_id").agg(F.sum("total_amount").alias("amount"))
    contacts = tables["contacts"].selectExpr(
        "id AS loan_officer_id",
        f"{full_name('first_name', 'last_name')} AS loan_officer_name",
    )
    return (
        by_officer.join(contacts, "loan_officer_id")
        .groupBy("loan_officer_id", "loan_officer_name")
        .agg(F.sum("amount").alias("closing_calendar_amount"))
    )


# --- conditions on a projection row, as SQL ----------------------------------


def false_if_null(condition: str) -> str:
    return f"coalesce({condition}, false)"


def projected_to_close(as_of: dt.date) -> str:
    """Stage date plus the usual days to close falls in the month."""
    projected = f"date_add(to_date(deal_stage_date), {whole_days('median_days_to_close')})"
    return false_if_null(MonthOf(as_of).contains(projected))


def long_in_stage(as_of: dt.date) -> str:
    """Not a portfolio and LONG_TERM_DAYS or more in its stage."""
    age = f"datediff(DATE '{as_of}', deal_stage_date)"
    return false_if_null(both("NOT portfolio", f"{age} >= {LONG_TERM_DAYS}"))


def settles_in_month(as_of: dt.date) -> str:
    return false_if_null(MonthOf(as_of).contains("dynamic_settlement_date"))


def closes_in_month(as_of: dt.date) -> str:
    """Settles in the month, or undated but projected to and not long in stage."""
    hopeful = both(UNDATED, projected_to_close(as_of), f"NOT {long_in_stage(as_of)}")
    return either(settles_in_month(as_of), hopeful)


def likely_to_confirm(as_of: dt.date) -> str:
    """Confirmed enough for the days left.

    On the last day only confirmed deals are; before it likely ones too.  An
    unconfirmed deal is while its status is younger than it usually takes to be
    confirmed and the month is long enough for it.
    """
    left = MonthOf(as_of).days_left
    age = f"datediff(DATE '{as_of}', closing_status_date)"

    def in_time(product: str, median: str) -> str:
        return both(
            f"product = '{product}'", f"{age} <= {median}", f"{whole_days(median)} <= {left}"
        )

    pending = both(
        f"closing_status = '{NOT_CONFIRMED}'",
        either(
            in_time(BRIDGE, "median_days_from_unconfirmed_to_confirmed_bridge"),
            in_time(RENTAL, "median_days_from_unconfirmed_to_confirmed_rental"),
        ),
    )
    sure = (CONFIRMED, LIKELY) if left > 0 else (CONFIRMED,)
    return either(
        false_if_null(pending), false_if_null(f"closing_status IN ({quoted(sure)})")
    )


def stage_can_close(as_of: dt.date) -> str:
    """False for early stages whose usual time to close exceeds the days left.

    Late stages always can.
    """
    left = MonthOf(as_of).days_left

    def too_early(product: str, median: str) -> str:
        return both(f"product = '{product}'", f"{whole_days(median)} >= {left}")

    blocked = both(
        f"state IN ({quoted(EARLY_GATE_STATES)})",
        either(
            too_early(BRIDGE, "median_days_to_close_after_final_terms_bridge"),
            too_early(RENTAL, "median_days_to_close_after_final_terms_rental"),
        ),
    )
    return f"NOT {false_if_null(blocked)}"


# --- flags as operators ------------------------------------------------------


def _flag(base: DataFrame, name: str, condition: str) -> DataFrame:
    return base.selectExpr("application_id", f"{condition} AS {name}")


def null_settlement_flag(base: DataFrame, as_of: dt.date) -> DataFrame:
    return _flag(base, "null_settlement_date", projected_to_close(as_of))


def long_term_flag(base: DataFrame, as_of: dt.date) -> DataFrame:
    return _flag(base, "long_term_deals", long_in_stage(as_of))


def closing_status_flag(base: DataFrame, as_of: dt.date) -> DataFrame:
    return _flag(base, "status_flag", likely_to_confirm(as_of))


def deal_stage_flag(base: DataFrame, as_of: dt.date) -> DataFrame:
    return _flag(base, "stage_flag", stage_can_close(as_of))


def date_range_flag(
    base: DataFrame, as_of: dt.date, *, unique_applications: bool = False
) -> DataFrame:
    """Whether a projection row closes in the month.

    Every row meets the projection and the age in stage of every row of its application,
    itself included.  Rows, and rows that close by them, are counted per application,
    their numbers multiplied and spelt out.  `unique_applications=True` states that an
    application has one row, which needs no shuffle.  A row without an application id
    meets nothing: it closes in the month if it settles there.
    """
    if unique_applications:
        known = both("application_id IS NOT NULL", closes_in_month(as_of))
        return _flag(base, "date_range", either(settles_in_month(as_of), known))
    rows = {
        "settles": settles_in_month(as_of),
        "undated": UNDATED,
        "projected": projected_to_close(as_of),
        "short_term": f"NOT {long_in_stage(as_of)}",
    }
    counts = [F.expr(f"count_if({condition}) AS {name}") for name, condition in rows.items()]
    seen = base.groupBy("application_id").agg(F.count("*").alias("n"), *counts)
    closing = "settles * n * n + undated * projected * short_term"
    met = f"IF(application_id IS NULL, settles, {closing})"
    whole = "IF(application_id IS NULL, n, n * n * n)"
    values = f"inline(array(struct(true, {met}), struct(false, {whole} - {met})))"
    counted = seen.selectExpr("application_id", f"{values} AS (date_range, {COPIES})")
    return spelt_out(counted.filter(f"{COPIES} > 0"), "application_id")


# --- enrichment and the forecast ---------------------------------------------


def _flags_of_row(base: DataFrame, as_of: dt.date) -> DataFrame:
    """Flags of each row; NULL without an application id, as nothing matches it."""

    def known(condition: str) -> str:
        return f"IF(application_id IS NOT NULL, {condition}, NULL)"

    return base.selectExpr(
        *ROW_COLUMNS,
        f"{known(closes_in_month(as_of))} AS date_range",
        f"{known(likely_to_confirm(as_of))} AS status_flag",
        f"{known(stage_can_close(as_of))} AS stage_flag",
    ).distinct()


def _flag_rows(as_of: dt.date) -> list[str]:
    """SQL: conditions of a row that the flags of its application follow from."""
    return [
        "application_id",
        f"{UNDATED} AS undated",
        f"{settles_in_month(as_of)} AS settles",
        f"{projected_to_close(as_of)} AS projected",
        f"{long_in_stage(as_of)} AS long_term",
        f"{likely_to_confirm(as_of)} AS status",
        f"{stage_can_close(as_of)} AS stage",
    ]


SEEN_FLAGS = (
    "bool_or(settles) AS settles",
    "bool_or(undated) AS undated",
    "bool_or(NOT undated AND NOT settles) AS dated_elsewhere",
    "bool_or(projected) AS projected",
    "bool_or(NOT projected) AS unprojected",
    "bool_or(long_term) AS long_term",
    "bool_or(NOT long_term) AS short_term",
    "bool_or(status) AS status",
    "bool_or(NOT status) AS no_status",
    "bool_or(stage) AS stage",
    "bool_or(NOT stage) AS no_stage",
)
# Undated rows meet the projection of any row and the stage age of any row.
IN_RANGE = "settles OR (undated AND projected AND short_term)"
OUT_OF_RANGE = "dated_elsewhere OR (undated AND (unprojected OR long_term))"


def _flag_values(base: DataFrame, as_of: dt.date) -> DataFrame:
    """Per application the values each flag takes over its rows, at most two each."""
    rows = base.filter("application_id IS NOT NULL").selectExpr(*_flag_rows(as_of))
    seen = rows.groupBy("application_id").agg(*map(F.expr, SEEN_FLAGS))

    def values(true: str, false: str) -> str:
        return f"array_compact(array(IF({true}, true, NULL), IF({false}, false, NULL)))"

    return seen.selectExpr(
        "application_id",
        f"{values(IN_RANGE, OUT_OF_RANGE)} AS date_range",
        f"{values('status', 'no_status')} AS status_flag",
        f"{values('stage', 'no_stage')} AS stage_flag",
    )


def _with_officer(rows: DataFrame, applications: DataFrame) -> DataFrame:
    officers = applications.selectExpr("id AS application_id", "loan_officer_id")
    return rows.join(officers, "application_id", "left")


def forecast_enriched(
    base: DataFrame,
    applications: DataFrame,
    as_of: dt.date,
    *,
    unique_applications: bool = False,
) -> DataFrame:
    """Distinct projection rows with their flags and officer id."""
    if unique_applications:
        rows = _flags_of_row(base, as_of)
    else:
        rows = base.select(*ROW_COLUMNS).distinct()
        rows = rows.join(_flag_values(base, as_of), "application_id", "left")
        for flag in FLAGS:
            rows = rows.withColumn(flag, F.explode_outer(flag))
    return _with_officer(rows, applications).select("loan_officer_id", *ROW_COLUMNS, *FLAGS)


def counts_in_forecast(excluded_officers: Sequence[str]) -> str:
    """SQL: a projection row of an officer and department the forecast shows."""
    shown = (
        "application_id IS NOT NULL AND loan_officer_name IS NOT NULL AND "
        f"(department IS NULL OR department IN ({quoted(FORECAST_DEPARTMENTS)}))"
    )
    if not excluded_officers:
        return shown
    escaped = [name.replace("\\", "\\\\").replace("'", "\\'") for name in excluded_officers]
    return f"{shown} AND loan_officer_name NOT IN ({quoted(escaped)})"


WEIGHTED_AMOUNT = (
    f"IF(state IN ({quoted(EARLY_WEIGHT_STATES)}), "
    f"total_amount * {EARLY_STATE_WEIGHT}, total_amount * percent_close)"
)


def monthly_forecast_sql(
    names: Mapping[str, str],
    as_of: dt.date,
    *,
    excluded_officers: Sequence[str] = (),
    dedupe_costs: bool = False,
) -> str:
    """The forecast as SQL over catalog tables, for a view that outlives the session.

    `names` maps the lending tables to their qualified names.  The conditions are those of
    `loan_officer_monthly_forecast`, and so are the results.
    """
    costs = f"{names['loan_closing_costs']} c ON c.loan_id = s.loan_id"
    passing = f"({IN_RANGE}) AND status AND stage"
    return f"""
WITH base AS (SELECT * FROM {names["projections"]} WHERE table_type = '{PROJECTION_ROWS}'),
seen AS (
    SELECT application_id, {", ".join(SEEN_FLAGS)}
    FROM (SELECT {", ".join(_flag_rows(as_of))} FROM base WHERE application_id IS NOT NULL)
    GROUP BY application_id),
counted AS (
    SELECT DISTINCT {", ".join(ROW_COLUMNS)} FROM base
    WHERE {counts_in_forecast(excluded_officers)}
        AND application_id IN (SELECT application_id FROM seen WHERE {passing})),
settling AS (
    SELECT l.id AS loan_id, a.loan_officer_id, l.total_amount
    FROM (SELECT * FROM {names["loans"]} WHERE {settles_paid(as_of)}) l
        JOIN (SELECT * FROM {names["applications"]} WHERE {OPEN_FOR_CLOSING}) a
            ON a.id = l.application_id),
amounts AS (
    SELECT loan_officer_id, sum(total_amount) AS amount
    FROM settling s {"LEFT SEMI" if dedupe_costs else ""} JOIN {costs}
    GROUP BY loan_officer_id),
calendar AS (
    SELECT loan_officer_id, sum(amount) AS closing_calendar_amount
    FROM amounts JOIN {names["contacts"]} c ON c.id = loan_officer_id
    GROUP BY loan_officer_id, {full_name("c.first_name", "c.last_name")})
SELECT loan_officer_name, closing_calendar_amount, loan_officer_id,
    sum({WEIGHTED_AMOUNT}) AS forecast_amount
FROM (
    SELECT r.*, a.loan_officer_id FROM counted r
        LEFT JOIN {names["applications"]} a ON a.id = r.application_id) rows
    LEFT JOIN calendar USING (loan_officer_id)
GROUP BY loan_officer_name, closing_calendar_amount, loan_officer_id"""


def loan_officer_monthly_forecast(
    tables: Tables,
    as_of: dt.date,
    *,
    excluded_officers: Sequence[str] = (),
    unique_applications: bool = False,
    dedupe_costs: bool = False,
) -> DataFrame:
    """Closing-calendar amount and weighted forecast per officer.

    The filters sit in front of the distinct, so only rows that count are
    shuffled.  The officer sum is taken before the calendar is joined and again
    after it, because the calendar amount is a group key.
    """
    base = forecast_base(tables["projections"])
    counted = base.filter(counts_in_forecast(excluded_officers))
    if unique_applications:
        flags = both(
            closes_in_month(as_of), likely_to_confirm(as_of), stage_can_close(as_of)
        )
        rows = counted.filter(flags).select(*ROW_COLUMNS).distinct()
    else:
        passing = _flag_values(base, as_of).filter(
            " AND ".join(f"array_contains({flag}, true)" for flag in FLAGS)
        )
        rows = counted.select(*ROW_COLUMNS).distinct()
        rows = rows.join(passing.select("application_id"), "application_id", "left_semi")

    by_officer = (
        _with_officer(rows, tables["applications"])
        .groupBy("loan_officer_name", "loan_officer_id")
        .agg(F.expr(f"sum({WEIGHTED_AMOUNT}) AS amount"))
    )
    calendar = closing_calendar(tables, as_of, dedupe_costs=dedupe_costs).select(
        "loan_officer_id", "closing_calendar_amount"
    )
    return (
        by_officer.join(calendar, "loan_officer_id", "left")
        .groupBy("loan_officer_name", "closing_calendar_amount", "loan_officer_id")
        .agg(F.sum("amount").alias("forecast_amount"))
    )
