"""SQL per registered query."""

from __future__ import annotations

import datetime as dt
import re

from oracle.domain import STATE_LIST, business_calendar, domain

BACK = (1, 2, 3, 4, 5, 6, 9, 15, 20, 25, 30, 35, 50)
AHEAD = (1, 2, 5, 7, 10)

FIXED_DAYS = "SELECT CAST(DATE '1990-01-01' + i::INT AS DATE) AS d FROM range(20000) AS r(i)"
DATA_DAYS = """SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS d FROM (
        SELECT min(x) AS lo, max(x) AS hi FROM (
            SELECT o_orderdate AS x FROM orders UNION ALL SELECT l_shipdate FROM lineitem))"""

# Business-day counts relative to the as-of day.  NULL when it is no business day.
# Of a date x in the past:
#   age      business days in [x, as-of): at least k means x <= k-th day back
#   age_past business days in (x, as-of): at least k means x <  k-th day back
#   age_on   age of a business day:       equal to k means x  = k-th day back
# Of a date x in the future:
#   until    business days in (as-of, x): less than k means x <= k-th day ahead
#   until_on of a business day, counting x: k means x = k-th day ahead
COUNTS = """
    SELECT i.d,
        t.before - i.before AS age,
        t.before - i.upto AS age_past,
        CASE WHEN i.workday THEN t.before - i.before END AS age_on,
        i.before - t.upto AS until,
        CASE WHEN i.workday THEN i.upto - t.upto END AS until_on
    FROM day_index i CROSS JOIN today t"""

EARLY = "'application', 'quote', 'incomplete_app', 'lead'"
OUT = f"state NOT IN ({EARLY}, 'setup_servicing', 'closed', 'clear_to_close')"
OPEN_STATUS = "coalesce(closing_status, 'likely') IN ('likely', 'not_confirmed')"


def worst(kpi: str, column: str, labels: list[str], key: str = "application_number") -> str:
    """Per application the first of `labels` any of its rows carries."""
    listed = "[" + ", ".join(f"'{x}'" for x in labels) + "]"
    return f"""
    SELECT {key}, {listed}[min(list_position({listed}, {column}))] AS {column}
    FROM {kpi} GROUP BY {key}"""


LADDERS = {
    "closing_kpi": [
        "2 Business Days",
        "Next Business Day",
        "Today",
        "Past Due",
        "No Settlement Date",
        "Not Likely",
        "Future",
    ],
    "follow_up_kpi": ["Past Due", "Due Today", "Due Tomorrow"],
    "initial_terms_kpi": ["Past Due", "Due Today", "Due Tomorrow"],
    "title_order": ["Outstanding"],
    "title_order_confirmation": ["Outstanding"],
    "title_follow_up": ["Past Due", "Due Today", "Due Tomorrow", "Future"],
    "appraisal_kpi": [">20 days", ">15 days", ">9 days"],
    "processing_times_portfolio": [">50 Days", ">35 Days", ">25 Days"],
    "processing_times_new_construction": [">35 Days", ">30 Days", ">25 Days"],
    "processing_times_rental": [">50 Days", ">35 Days", ">25 Days"],
    "progressing_times_bridge": [">30 Days", ">25 Days", ">20 Days"],
    "cda_kpi": ["Past Due"],
}


def calendar_ctes() -> dict[str, str]:
    back = ",\n        ".join(
        f"max(o.d) FILTER (o.before = b.before - {k}) AS neg_{k}" for k in BACK
    )
    ahead = ",\n        ".join(
        f"max(o.d) FILTER (o.before = b.before + {k}) AS pos_{k}" for k in AHEAD
    )
    return {
        "working_days": "\n    SELECT d, before FROM day_index WHERE workday",
        "neighbours": f"""
    SELECT b.d AS dateframe,
        {back},
        {ahead}
    FROM working_days b JOIN working_days o ON o.before BETWEEN b.before - 50 AND b.before + 10
    GROUP BY b.d""",
    }


def extract_ctes() -> dict[str, str]:
    def newest(kind: str) -> str:
        return f"""
    SELECT loan_id, date, via, CAST(place AS INT) AS row_num FROM (
        SELECT *, row_number() OVER (PARTITION BY loan_id
            ORDER BY date DESC NULLS FIRST, via DESC NULLS LAST) AS place
        FROM loan_follow_ups WHERE type = '{kind}')
    WHERE place = 1"""

    return {
        "newest_title": newest("title"),
        "newest_borrower": newest("borrower"),
        "terms": """
    SELECT a.id AS application_number, min(s.created_at)::DATE AS initial_terms_date
    FROM applications a JOIN term_sheets s ON s.application_id = a.id
    WHERE s.type = 'TermSheet::InitialTerms'
    GROUP BY a.id""",
        "open_reviews": """
    SELECT id FROM applications a
    WHERE state = 'preliminary_review'
        AND coalesce(rejected_at, withdrawn_at, long_termed_at) IS NULL
        AND EXISTS (SELECT 1 FROM channels c WHERE c.application_id = a.id
            AND c.ops_channel <> 'Private Client Group')""",
        "review_primary": """
    SELECT id, reviewed_at AS preliminary_review_date
    FROM open_reviews LEFT JOIN stage_dates ON application_id = id""",
        "review_fallback": """
    SELECT p.id, s.reviewed_at AS preliminary_review_date
    FROM review_primary p LEFT JOIN stage_time_stamps s ON s.application_id = p.id
    WHERE p.preliminary_review_date IS NULL""",
        "review_date": """
    SELECT id, ifnull(p.preliminary_review_date, f.preliminary_review_date)
        AS preliminary_review_date
    FROM review_primary p LEFT JOIN review_fallback f USING (id)""",
    }


def kpi_ctes(as_of: str, as_of_ts: str) -> dict[str, str]:
    def banded(first: int, second: int, third: int, by: str, unit: str) -> str:
        return (
            f"CASE WHEN {by} >= {first} THEN '>{first} {unit}' "
            f"WHEN {by} >= {second} THEN '>{second} {unit}' "
            f"WHEN {by} >= {third} THEN '>{third} {unit}' END"
        )

    processing = f"""
    FROM submitted LEFT JOIN loans l ON l.application_id = submitted.id
        LEFT JOIN products p ON p.id = submitted.product_id
    WHERE {OPEN_STATUS} AND """
    return {
        "counts": COUNTS,
        # Applications past submission in a state the classifiers look at.
        "submitted": f"""
    SELECT a.*, c.age AS sub_age, c.age_past AS sub_age_past, c.age_on AS sub_age_on
    FROM applications a LEFT JOIN counts c ON c.d = a.submitted_at::DATE
    WHERE a.submitted_at IS NOT NULL AND {OUT}""",
        "dated_loans": """
    SELECT l.*, s.until, s.until_on, t.date AS title_date, b.date AS borrower_date,
        tc.age AS title_age, tc.age_past AS title_age_past, tc.age_on AS title_age_on,
        bc.age AS borrower_age, bc.age_past AS borrower_age_past, bc.age_on AS borrower_age_on
    FROM loans l
        LEFT JOIN counts s ON s.d = l.settlement_date
        LEFT JOIN newest_title t ON t.loan_id = l.id
        LEFT JOIN newest_borrower b ON b.loan_id = l.id
        LEFT JOIN counts tc ON tc.d = t.date::DATE
        LEFT JOIN counts bc ON bc.d = b.date::DATE""",
        "reviews": """
    SELECT r.id, r.preliminary_review_date::DATE AS reviewed, c.age, c.age_on
    FROM review_date r LEFT JOIN counts c ON c.d = r.preliminary_review_date::DATE""",
        "welcome_call": f"""
    SELECT a.id, CASE
            WHEN coalesce(r.reviewed, a.submitted_at::DATE) = {as_of} THEN 'Due Tomorrow'
            WHEN coalesce(r.age_on, c.age_on) = 1 THEN 'Due Today'
            WHEN r.age >= 2 OR (r.id IS NULL AND c.age_on = 2) THEN 'Past Due'
        END AS preliminary_review_welcome_call_kpi
    FROM applications a
        LEFT JOIN reviews r ON r.id = a.id AND a.state = 'preliminary_review'
        LEFT JOIN counts c ON c.d = a.submitted_at::DATE AND a.state = 'initial_underwriting'
        LEFT JOIN legal g ON g.application_id = a.id
    WHERE a.state IN ('initial_underwriting', 'preliminary_review') AND g.kickoff IS NULL
        AND coalesce(a.withdrawn_at, a.rejected_at, a.long_termed_at) IS NULL""",
        "call_1": """
    SELECT a.id, CASE WHEN g.kickoff IS NOT NULL AND a.submitted_at IS NULL AND r.age_on > 1
        THEN ['Due Tomorrow', 'Due Today', 'Past Due'][CAST(r.age_on AS INT) - 1] END
            AS preliminary_review_follow_up_call_1_kpi
    FROM applications a LEFT JOIN legal g ON g.application_id = a.id
        LEFT JOIN reviews r ON r.id = a.id
    WHERE a.state = 'preliminary_review'""",
        "call_2": """
    SELECT a.id, CASE
            WHEN g.kickoff IS NULL OR a.submitted_at IS NOT NULL THEN NULL
            WHEN r.age_on = 4 AND ifnull(f.preliminary_review_follow_up_call_1_kpi, '')
                <> 'Past Due' THEN 'Due Tomorrow'
            WHEN r.age_on = 5 THEN 'Due Today'
            WHEN r.age_on = 6 THEN 'Past Due'
        END AS preliminary_review_follow_up_call_2_kpi
    FROM applications a JOIN call_1 f USING (id)
        LEFT JOIN legal g ON g.application_id = a.id LEFT JOIN reviews r ON r.id = a.id""",
        "closing": f"""
    SELECT a.id AS application_number, CASE
            WHEN a.closing_status = 'confirmed' THEN 'Future'
            WHEN l.settlement_date IS NULL THEN 'No Settlement Date'
            WHEN l.settlement_date < {as_of} THEN 'Past Due'
            WHEN l.settlement_date = {as_of} THEN 'Today'
            WHEN l.until_on = 1 THEN 'Next Business Day'
            WHEN l.until_on = 2 THEN '2 Business Days'
            WHEN a.closing_status = 'not_confirmed' THEN 'Not Likely'
            ELSE 'Future' END AS closing_kpi
    FROM submitted a LEFT JOIN dated_loans l ON l.application_id = a.id""",
        # How many days later than usual a loan's borrower may be contacted: one
        # more when it closes beyond ten business days.
        "chased": f"""
    SELECT a.*, s.initial_terms_date, l.transaction_purpose, l.settlement_date, l.until,
        l.borrower_age, l.borrower_age_past, l.borrower_age_on,
        CASE WHEN l.transaction_purpose IN ('purchase', 'refinance')
            THEN CASE WHEN l.until < 10 THEN 0 WHEN l.until >= 10 THEN 1 END END AS slack
    FROM applications a JOIN terms s ON s.application_number = a.id
        LEFT JOIN dated_loans l ON l.application_id = a.id
    WHERE {OUT} AND state <> 'initial_underwriting' AND {OPEN_STATUS}
        AND s.initial_terms_date IS NOT NULL""",
        "borrower_follow_up": """
    SELECT id AS application_number, CASE
            WHEN settlement_date IS NULL THEN CASE
                WHEN borrower_age_past >= 5 THEN 'Past Due'
                WHEN borrower_age_on = 5 THEN 'Due Today'
                WHEN borrower_age_on = 4 THEN 'Due Tomorrow' END
            WHEN borrower_age - slack >= 3 THEN 'Past Due'
            WHEN borrower_age_on - slack = 2 THEN 'Due Today'
            WHEN borrower_age_on - slack = 1 THEN 'Due Tomorrow'
        END AS follow_up_kpi
    FROM chased""",
        # Business days since the terms went out, plus one on the days an early
        # settlement brings the call forward.
        "initial_terms": f"""
    SELECT id AS application_number, CASE
            WHEN state NOT IN ('initial_terms', 'initial_signed_term_sheet', 'final_terms',
                'final_signed_term_sheet') OR reviewed IS NOT NULL THEN NULL
            WHEN age >= 3 OR (soon AND age_on = 2) THEN 'Past Due'
            WHEN age >= 2 OR (soon AND age_on = 1) THEN 'Due Today'
            WHEN age >= 1 OR (soon AND initial_terms_date = {as_of}) THEN 'Due Tomorrow'
        END AS initial_terms_kpi
    FROM (
        SELECT h.id, h.state, h.initial_terms_date, g.reviewed, c.age, c.age_on,
            h.settlement_date >= {as_of} AND h.until < 7 AS soon
        FROM chased h LEFT JOIN legal g ON g.application_id = h.id
            LEFT JOIN counts c ON c.d = h.initial_terms_date
        WHERE h.transaction_purpose IN ('purchase', 'refinance'))""",
        "title_orders": f"""
    SELECT a.id AS application_number,
        CASE WHEN date_diff('hour', a.submitted_at, {as_of_ts}) >= 24
            AND coalesce(g.ordered, g.reordered) IS NULL THEN 'Outstanding' END AS title_order
    FROM applications a LEFT JOIN legal g ON g.application_id = a.id
    WHERE a.submitted_at IS NOT NULL AND {OUT}""",
        "title_confirmation": f"""
    SELECT a.id AS application_number,
        CASE WHEN least(g.ordered, g.reordered) < {as_of} AND l.title_date IS NULL
            THEN 'Outstanding' END AS title_order_confirmation
    FROM submitted a LEFT JOIN legal g ON g.application_id = a.id
        LEFT JOIN dated_loans l ON l.application_id = a.id""",
        "title_follow": f"""
    SELECT id AS application_number, CASE
            WHEN commitment IS NOT NULL THEN 'Future'
            WHEN title_age_past >= 5 OR (soon AND title_age >= 2) THEN 'Past Due'
            WHEN title_age_on = 5 OR (soon AND title_age_on = 1) THEN 'Due Today'
            WHEN title_age_on = 4 OR (soon AND title_date::DATE = {as_of}) THEN 'Due Tomorrow'
            ELSE 'Future' END AS title_follow_up
    FROM (
        SELECT a.id, g.commitment, l.title_date, l.title_age, l.title_age_past, l.title_age_on,
            l.settlement_date >= {as_of} AND l.until < 5 AS soon
        FROM applications a JOIN terms s ON s.application_number = a.id
            LEFT JOIN legal g ON g.application_id = a.id
            LEFT JOIN dated_loans l ON l.application_id = a.id
        WHERE {OUT} AND s.initial_terms_date IS NOT NULL)""",
        "valued": """
    SELECT l.application_id, v.*
    FROM loans l LEFT JOIN properties p ON p.loan_id = l.id
        LEFT JOIN property_valuations v ON v.property_id = p.id""",
        "appraisal": f"""
    SELECT a.id AS application_number,
        CASE WHEN v.approved IS NULL
            THEN {banded(20, 15, 9, "a.sub_age", "days")} END AS appraisal_kpi
    FROM submitted a LEFT JOIN valued v ON v.application_id = a.id
    WHERE a.closing_status IS NULL
        OR (a.closing_status <> 'confirmed' AND NOT a.portfolio)""",
        "processing_portfolio": f"""
    SELECT submitted.id AS application_number,
        {banded(50, 35, 25, "sub_age_past", "Days")} AS processing_times_portfolio
    {processing} (portfolio OR properties_count > 1)""",
        "processing_new": f"""
    SELECT submitted.id AS application_number,
        {banded(35, 30, 25, "sub_age_past", "Days")} AS processing_times_new_construction
    {processing} (NOT portfolio OR properties_count = 1) AND p.name = 'New Construction'""",
        "processing_rent": f"""
    SELECT submitted.id AS application_number,
        {banded(50, 35, 25, "sub_age_past", "Days")} AS processing_times_rental
    {processing} (NOT portfolio OR properties_count = 1) AND p.name <> 'New Construction'
        AND type = 'Application::Rental'""",
        "processing_brid": f"""
    SELECT submitted.id AS application_number,
        {banded(30, 25, 20, "sub_age_past", "Days")} AS progressing_times_bridge
    {processing} NOT portfolio AND p.name <> 'New Construction'
        AND type = 'Application::Bridge'""",
        "cda": f"""
    SELECT a.id AS application_number, {as_of} AS as_of, v.received AS appraisal_received_date,
        CASE WHEN c.age >= 2 AND coalesce(v.cda_ordered, v.cda_received) IS NULL
            THEN 'Past Due' END AS cda_kpi
    FROM applications a LEFT JOIN valued v ON v.application_id = a.id
        LEFT JOIN counts c ON c.d = v.received
    WHERE NOT a.portfolio AND a.type = 'Application::Rental' AND a.submitted_at IS NOT NULL""",
    }


KPI_SOURCES = {
    "closing_kpi": "closing",
    "follow_up_kpi": "borrower_follow_up",
    "initial_terms_kpi": "initial_terms",
    "title_order": "title_orders",
    "title_order_confirmation": "title_confirmation",
    "title_follow_up": "title_follow",
    "appraisal_kpi": "appraisal",
    "processing_times_rental": "processing_rent",
    "progressing_times_bridge": "processing_brid",
    "processing_times_new_construction": "processing_new",
    "processing_times_portfolio": "processing_portfolio",
    "cda_kpi": "cda",
}

CALLS = {
    "preliminary_review_welcome_call_kpi": "welcome_call",
    "preliminary_review_follow_up_call_1_kpi": "call_1",
    "preliminary_review_follow_up_call_2_kpi": "call_2",
}


def spoken(via: str) -> str:
    return f"upper({via}[1]) || lower({via}[2:])"


def report_ctes(as_of_ts: str) -> dict[str, str]:
    tops = {
        f"top_{column}": worst(source, column, LADDERS[column])
        for column, source in KPI_SOURCES.items()
    }
    labels = ", ".join(f"top_{column}.{column}" for column in KPI_SOURCES)
    joins = "\n        ".join(
        f"LEFT JOIN top_{c} ON top_{c}.application_number = a.id" for c in KPI_SOURCES
    )
    calls = "\n        ".join(f"LEFT JOIN top_{cte} ON top_{cte}.id = a.id" for cte in CALLS.values())
    dues = ["Due Tomorrow", "Due Today", "Past Due"]
    return {
        **tops,
        **{f"top_{cte}": worst(cte, column, dues, "id") for column, cte in CALLS.items()},
        # Every loan, borrower and team row of an application, ranked.
        "report_rows": f"""
    SELECT c.name AS project_coordinator, l.internal_id AS loan_number, l.appraisal_paid_at,
        g.kickoff AS kickoff_call_with_borrower_date, a.id AS application_number, a.created_at,
        a.closing_status, a.type, a.in_conditions_review_from, a.requested_for_ctc,
        {as_of_ts} AS as_of_ts, l.application_id,
        f.date::DATE AS borrower_follow_up_date, {spoken("f.via")} AS borrower_follow_up_type,
        t.date::DATE AS title_follow_up_date, {spoken("t.via")} AS title_follow_up_type,
        a.state, l.settlement_date AS closing_date, l.transaction_purpose,
        {labels},
        {", ".join(CALLS)},
        o.name AS borrower_name, l.id AS loan_id, b.contact_id
    FROM applications a
        JOIN people c ON c.id = a.project_coordinator_id
        JOIN team_assignments m ON m.team_member_name = c.name AND m.team = 'PC'
        LEFT JOIN loans l ON l.application_id = a.id
        LEFT JOIN newest_title t ON t.loan_id = l.id
        LEFT JOIN newest_borrower f ON f.loan_id = l.id
        LEFT JOIN legal g ON g.application_id = a.id
        LEFT JOIN borrowers b ON b.application_id = a.id
        LEFT JOIN people o ON o.id = b.contact_id
        {joins}
        {calls}
    WHERE a.rejected_at IS NULL AND a.withdrawn_at IS NULL
        AND a.type IN ('Application::Bridge', 'Application::Rental')
        AND a.state NOT IN ('application', 'quote', 'issued', 'incomplete_app',
            'preliminary_review', 'lead', 'setup_servicing', 'closed')""",
        "report": """
    SELECT * EXCLUDE (loan_id, contact_id, place), CAST(place AS INT) AS row_num FROM (
        SELECT *, row_number() OVER (PARTITION BY application_number
            ORDER BY loan_id NULLS LAST, contact_id NULLS LAST,
                kickoff_call_with_borrower_date NULLS LAST) AS place
        FROM report_rows)
    WHERE place = 1""",
        "report_by_loan": """
    SELECT * EXCLUDE (loan_id, contact_id, place), CAST(row_number() OVER (
            PARTITION BY application_number ORDER BY loan_id) AS INT) AS row_num
    FROM (
        SELECT *, row_number() OVER (PARTITION BY application_number, loan_id
            ORDER BY contact_id NULLS LAST, kickoff_call_with_borrower_date NULLS LAST) AS place
        FROM report_rows)
    WHERE place = 1""",
        "closings": """
    SELECT c.name AS project_coordinator_name, c.id, l.settlement_date, l.internal_id
    FROM applications a JOIN loans l ON l.application_id = a.id
        JOIN people c ON c.id = a.project_coordinator_id
        JOIN team_assignments m ON m.team_member_name = c.name
        LEFT JOIN channels h ON h.internal_id = l.internal_id
    WHERE a.closing_status = 'confirmed' AND m.team = 'PC'
        AND (a.state LIKE 'funding_%'
            OR a.state IN ('closed', 'clear_to_close', 'setup_servicing'))""",
    }


def forecast_ctes(as_of: str, month: str, left: int) -> dict[str, str]:
    """Flags looked up by application id, the way separate relations would be."""

    def in_month(day: str) -> str:
        return f"date_trunc('month', {day}) = {month}"

    def early(product: str, median: str) -> str:
        return f"(product = '{product}' AND round({median}) >= {left})"

    def pending(product: str) -> str:
        median = f"median_days_from_unconfirmed_to_confirmed_{product.lower()}"
        return (
            f"(product = '{product}' AND {as_of} - closing_status_date <= {median} "
            f"AND round({median}) <= {left})"
        )

    after_terms = "median_days_to_close_after_final_terms"
    sure = "('confirmed', 'likely')" if left else "('confirmed')"
    return {
        "base": "\n    SELECT * FROM projections WHERE table_type = 'dynamic projections'",
        "calendar_amounts": f"""
    SELECT a.loan_officer_id, c.name AS loan_officer_name,
        sum(l.total_amount) AS closing_calendar_amount
    FROM loan_closing_costs x JOIN loans l ON l.id = x.loan_id
        JOIN applications a ON a.id = l.application_id
        JOIN people c ON c.id = a.loan_officer_id
    WHERE {in_month("l.settlement_date")} AND l.appraisal_paid_at IS NOT NULL
        AND a.withdrawn_at IS NULL AND a.rejection_status IS NULL AND a.closing_status IS NOT NULL
        AND a.state NOT IN ({EARLY}, 'preliminary_review')
    GROUP BY ALL""",
        "projected": f"""
    SELECT application_id, ifnull({in_month(
        "(deal_stage_date + CAST(round(median_days_to_close) AS INT))")}, false)
        AS null_settlement_date
    FROM base""",
        "long_term": f"""
    SELECT application_id, ifnull(NOT portfolio AND {as_of} - deal_stage_date > 44, false)
        AS long_term_deals
    FROM base""",
        "in_range": f"""
    SELECT b.application_id, CASE WHEN b.dynamic_settlement_date IS NULL
            THEN ifnull(n.null_settlement_date AND NOT d.long_term_deals, false)
            ELSE {in_month("b.dynamic_settlement_date")} END AS date_range
    FROM base b LEFT JOIN projected n USING (application_id)
        LEFT JOIN long_term d USING (application_id)""",
        "status_flags": f"""
    SELECT application_id, ifnull(closing_status IN {sure}, false)
        OR ifnull(closing_status = 'not_confirmed' AND ({pending("Bridge")}
            OR {pending("Rental")}), false) AS status_flag
    FROM base""",
        "stage_flags": f"""
    SELECT application_id, NOT ifnull(
        state IN ({EARLY}, 'preliminary_review', 'initial_underwriting', 'pending_approval',
            'initial_terms', 'initial_signed_term_sheet')
        AND ({early("Bridge", after_terms + "_bridge")}
            OR {early("Rental", after_terms + "_rental")}), false) AS stage_flag
    FROM base""",
        "enriched": """
    SELECT DISTINCT a.loan_officer_id, b.loan_officer_name, b.total_amount, b.state,
        b.percent_close, b.department, b.application_id,
        r.date_range, s.status_flag, g.stage_flag
    FROM base b LEFT JOIN in_range r USING (application_id)
        LEFT JOIN status_flags s USING (application_id)
        LEFT JOIN stage_flags g USING (application_id)
        LEFT JOIN applications a ON a.id = b.application_id""",
        "forecast": f"""
    SELECT e.loan_officer_name, c.closing_calendar_amount, e.loan_officer_id,
        sum(e.total_amount * CASE
            WHEN e.state IN ({EARLY}, 'preliminary_review', 'initial_underwriting',
                'pending_approval') THEN CAST(0.1 AS DECIMAL(9,4))
            ELSE e.percent_close END) AS forecast_amount
    FROM enriched e LEFT JOIN calendar_amounts c USING (loan_officer_id)
    WHERE e.date_range AND e.status_flag AND e.stage_flag
        AND coalesce(e.department, 'retail') IN ('retail', 'tpo')
        AND e.loan_officer_name <> 'Officer 9'
    GROUP BY ALL""",
    }


def event_ctes() -> dict[str, str]:
    return {
        "event_orders": f"""
    SELECT event_id AS application_number,
        CASE WHEN event_id % 3 = 0
            AND date_diff('hour', ts, TIMESTAMP '2024-01-15 12:30:00') > 23
            THEN 'Outstanding' END AS title_order
    FROM (SELECT *, {STATE_LIST}[event_id % 20 + 1] AS state FROM events)
    WHERE {OUT}""",
    }


class Oracle:
    """The SQL of every query for one as-of day and one shape of the tables."""

    def __init__(
        self,
        as_of: dt.date,
        second_loans: bool = False,
        repeated: bool = False,
        repeated_records: bool = False,
        days: str = FIXED_DAYS,
    ) -> None:
        next_month = (as_of.replace(day=28) + dt.timedelta(days=4)).replace(day=1)
        left = (next_month - as_of).days - 1
        day, moment = f"DATE '{as_of}'", f"TIMESTAMP '{as_of} 12:30:00'"
        self.ctes = {
            **domain(second_loans, repeated, repeated_records),
            **business_calendar(days, day),
            **calendar_ctes(),
            **extract_ctes(),
            **kpi_ctes(day, moment),
            **report_ctes(moment),
            **forecast_ctes(day, f"DATE '{as_of.replace(day=1)}'", left),
            **event_ctes(),
        }

    def sql(self, query: str) -> str:
        """`query` with the relations it names in front."""
        needed: dict[str, str] = {}

        def need(body: str) -> None:
            for name in self.ctes:
                if name not in needed and re.search(rf"\b(FROM|JOIN) {name}\b", body):
                    need(self.ctes[name])
                    needed[name] = self.ctes[name]

        need(query)
        relations = ",\n".join(f"{name} AS ({body}\n)" for name, body in needed.items())
        return f"WITH {relations}\n{query}" if needed else query


def oracle_queries() -> dict[str, str]:
    day = dt.date(1998, 6, 17)
    base = Oracle(day)
    spanning = Oracle(day, days=DATA_DAYS)
    queries = {
        "date_series": spanning.sql("SELECT d AS date_value FROM day_names"),
        "business_days": spanning.sql("SELECT d AS dateframe FROM working_days"),
        "business_days_without_bank_holidays": spanning.sql(
            "SELECT d AS dateframe FROM working_days "
            "WHERE d NOT IN (SELECT holiday_date FROM bank_holidays)"
        ),
        "business_day_offsets": spanning.sql("SELECT * FROM neighbours"),
        "as_of_calendar": base.sql(
            "SELECT n.*, a.id AS application_id FROM applications a CROSS JOIN "
            "(SELECT * FROM neighbours WHERE dateframe = DATE '1998-06-17') n"
        ),
        "latest_title_follow_up": base.sql("SELECT * FROM newest_title"),
        "latest_borrower_follow_up": base.sql("SELECT * FROM newest_borrower"),
        "initial_terms_date": base.sql("SELECT * FROM terms"),
        "prelim_review_primary": base.sql("SELECT * FROM review_primary"),
        "prelim_review_fallback": base.sql("SELECT * FROM review_fallback"),
        "prelim_review_date": base.sql("SELECT * FROM review_date"),
        "coordinator_closings": base.sql("SELECT * FROM closings"),
        "appraisal_payments": base.sql(
            "SELECT internal_id, appraisal_paid_at::DATE AS paid_appraisal_date FROM loans"
        ),
        "stage_stats": base.sql(
            "SELECT state, product, count(*) AS deals, "
            "CAST(sum(total_amount) AS DOUBLE) AS total_amount, "
            "min(deal_stage_date) AS first_stage_date, max(deal_stage_date) AS last_stage_date "
            "FROM projections GROUP BY state, product"
        ),
        "projections": base.sql(
            "SELECT * REPLACE (CAST(total_amount AS DOUBLE) AS total_amount, "
            "CAST(percent_close AS DOUBLE) AS percent_close) FROM projections"
        ),
    }
    for key, relation in KPI_KEYS.items():
        queries[key] = base.sql(f"SELECT * FROM {relation}")
    queries["title_order_kpi"] = base.sql("SELECT * FROM event_orders")
    queries["title_order_kpi_by_date"] = base.sql("SELECT * FROM title_orders")

    report = "SELECT * FROM report"
    queries["application_report"] = base.sql(report)
    queries["application_report_weekend"] = Oracle(dt.date(1998, 6, 20)).sql(report)
    shared = Oracle(day, second_loans=True)
    queries["application_report_several_loans"] = shared.sql(report)
    queries["application_report_rows"] = shared.sql("SELECT * FROM report_by_loan")

    for key in ("closing_kpi", "title_follow_up_kpi", "cda_kpi", "application_report"):
        queries[f"{key}_reduced"] = queries[key]

    # Several legal records and stage dates of an application, joined as they are.
    recorded = Oracle(day, second_loans=True, repeated_records=True)
    for key, relation in RECORD_KEYS.items():
        queries[f"{key}_repeated_records"] = recorded.sql(f"SELECT * FROM {relation}")
    queries["application_report_repeated_records"] = recorded.sql(report)

    for key, relation in FORECAST_KEYS.items():
        queries[key] = base.sql(f"SELECT * FROM {relation}")
    queries["forecast_base"] = base.sql(MONEY.format("SELECT * FROM base", "percent_close"))
    queries["forecast_enriched"] = base.sql(
        MONEY.format("SELECT * FROM enriched", "percent_close")
    )
    queries["closing_calendar"] = base.sql(CALENDAR)
    queries["loan_officer_monthly_forecast"] = base.sql(FORECAST)
    queries["published_forecast_view"] = base.sql(FORECAST)
    month_end = Oracle(dt.date(1998, 6, 30))
    queries["loan_officer_monthly_forecast_month_end"] = month_end.sql(FORECAST)
    queries["closing_status_flag_month_end"] = month_end.sql("SELECT * FROM status_flags")
    early = Oracle(dt.date(1998, 6, 10))
    queries["closing_status_flag_early_month"] = early.sql("SELECT * FROM status_flags")
    december = Oracle(dt.date(1998, 12, 30))
    queries["deal_stage_flag_december"] = december.sql("SELECT * FROM stage_flags")
    repeated = Oracle(day, repeated=True)
    queries["forecast_enriched_repeated_applications"] = repeated.sql(
        MONEY.format("SELECT * FROM enriched", "percent_close")
    )
    queries["loan_officer_monthly_forecast_repeated_applications"] = repeated.sql(FORECAST)
    queries["date_range_flag_repeated_applications"] = repeated.sql("SELECT * FROM in_range")
    return queries


KPI_KEYS = {
    "welcome_call_kpi": "welcome_call",
    "follow_up_call_1_kpi": "call_1",
    "follow_up_call_2_kpi": "call_2",
    "closing_kpi": "closing",
    "borrower_follow_up_kpi": "borrower_follow_up",
    "initial_terms_kpi": "initial_terms",
    "title_order_confirmation_kpi": "title_confirmation",
    "title_follow_up_kpi": "title_follow",
    "appraisal_missing_kpi": "appraisal",
    "processing_portfolio": "processing_portfolio",
    "processing_new_construction": "processing_new",
    "processing_rental": "processing_rent",
    "processing_bridge": "processing_brid",
    "cda_kpi": "cda",
}

RECORD_KEYS = {
    "prelim_review_primary": "review_primary",
    "prelim_review_fallback": "review_fallback",
    "prelim_review_date": "review_date",
    "welcome_call_kpi": "welcome_call",
    "follow_up_call_1_kpi": "call_1",
    "follow_up_call_2_kpi": "call_2",
    "initial_terms_kpi": "initial_terms",
    "title_order_kpi": "title_orders",
    "title_order_confirmation_kpi": "title_confirmation",
    "title_follow_up_kpi": "title_follow",
}

FORECAST_KEYS = {
    "null_settlement_flag": "projected",
    "long_term_flag": "long_term",
    "date_range_flag": "in_range",
    "closing_status_flag": "status_flags",
    "deal_stage_flag": "stage_flags",
}

# Decimals leave as doubles, the same on both sides.
MONEY = (
    "SELECT * REPLACE (CAST(total_amount AS DOUBLE) AS total_amount, "
    "CAST({1} AS DOUBLE) AS {1}) FROM ({0})"
)
CALENDAR = (
    "SELECT loan_officer_id, loan_officer_name, "
    "CAST(closing_calendar_amount AS DOUBLE) AS closing_calendar_amount FROM calendar_amounts"
)
FORECAST = (
    "SELECT loan_officer_name, loan_officer_id, "
    "CAST(closing_calendar_amount AS DOUBLE) AS closing_calendar_amount, "
    "CAST(forecast_amount AS DOUBLE) AS forecast_amount FROM forecast"
)
