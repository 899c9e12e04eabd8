"""Lending tables as SQL over the driver's star schema."""

from __future__ import annotations


ANCHOR = "DATE '1998-06-17'"
LOAN_ID_BASE = 500_000_000_000
SECOND_LOAN_BASE = 600_000_000_000
# Application states, in lifecycle order (fixed values).
STATES = (
    "application",
    "lead",
    "incomplete_app",
    "quote",
    "preliminary_review",
    "initial_underwriting",
    "pending_approval",
    "initial_terms",
    "initial_signed_term_sheet",
    "final_terms",
    "final_signed_term_sheet",
    "clear_to_close",
    "funding_requested",
    "funding_reviewed",
    "funding_submitted",
    "funding_sent",
    "funding_authorized",
    "issued",
    "setup_servicing",
    "closed",
)

CONTACT_BASE = 1_000_000_000_000

STATE_LIST = "[" + ", ".join(f"'{s}'" for s in STATES) + "]"


def near(date: str, days: int) -> str:
    """Fold a date into the `days` days ending at the anchor."""
    gap = f"({ANCHOR} - {date}::DATE)"
    return f"({ANCHOR} - ((({gap} % {days}) + {days}) % {days})::INT)"


def ts(date: str) -> str:
    return f"CAST({date} AS TIMESTAMP)"


APP_TYPE = """CASE left(o_orderpriority, 1)
        WHEN '1' THEN 'Application::Bridge' WHEN '2' THEN 'Application::Bridge'
        WHEN '3' THEN 'Application::Rental' WHEN '4' THEN 'Application::Rental'
        ELSE 'Application::Other' END"""

CLOSING_STATUS = """CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE CASE o_orderstatus
        WHEN 'F' THEN 'confirmed' WHEN 'O' THEN 'likely' WHEN 'P' THEN 'not_confirmed' END END"""

PROPERTY_ID = """(l_orderkey * 8 + l_linenumber) * 1000000
        + l_partkey % 1000 * 1000 + l_suppkey % 1000"""


def records(copies: str) -> str:
    """Orders with copies, whose dates lie a day earlier each and whose `r` is one more."""
    return f"""
    (SELECT o_orderkey AS k, o_orderkey + i AS r, o_orderdate::DATE - i::INT AS od
    FROM orders, range({copies}) AS copies(i))"""


def domain(
    second_loans: bool = False, repeated: bool = False, repeated_records: bool = False
) -> dict[str, str]:
    """CTE bodies by table name."""
    legal, dates, stamps = (
        records(copies if repeated_records else "1")
        for copies in ("o_orderkey % 4 + 1", "(o_orderkey + 1) % 3 + 1", "o_orderkey % 5 % 3 + 1")
    )
    tables = {
        "applications": f"""
    SELECT o_orderkey AS id,
        {STATE_LIST}[o_orderkey % 20 + 1] AS state,
        {APP_TYPE} AS type,
        {CLOSING_STATUS} AS closing_status,
        CASE WHEN o_orderkey % 17 = 0 THEN 'rejected' END AS rejection_status,
        CASE WHEN o_orderkey % 17 = 0 THEN {ts("o_orderdate")} END AS rejected_at,
        CASE WHEN o_orderkey % 13 = 0 THEN {ts("o_orderdate")} END AS withdrawn_at,
        CASE WHEN o_orderkey % 19 = 0 THEN {ts("o_orderdate")} END AS long_termed_at,
        o_custkey % 5 = 0 AS portfolio,
        CASE WHEN o_orderkey % 11 = 0 THEN 3 WHEN o_orderkey % 2 = 0 THEN 1 ELSE 2 END
            AS product_id,
        o_custkey % 10 AS loan_officer_id,
        CASE WHEN o_orderkey % 23 <> 0 THEN o_custkey % 10 END AS project_coordinator_id,
        CASE WHEN o_orderkey % 20 > 4 AND o_orderkey % 29 <> 0
            THEN {ts(near("o_orderdate", 90))} END AS submitted_at,
        {ts("CAST(o_orderdate AS DATE)")} AS created_at,
        CASE WHEN o_orderkey % 4 = 1 THEN {ts(near("o_orderdate", 45))} END
            AS in_conditions_review_from,
        CASE WHEN o_orderkey % 6 = 2 THEN {ts(near("o_orderdate", 33))} END AS requested_for_ctc
    FROM orders""",
        "settlements": f"""
    SELECT l_orderkey AS k,
        CASE WHEN l_orderkey % 9 <> 0 THEN max({near("l_shipdate", 60)} + 40) END AS settles,
        min({near("l_shipdate", 40)}) AS paid,
        CAST(count(*) AS INT) AS properties_count
    FROM lineitem GROUP BY l_orderkey""",
        "first_loans": f"""
    SELECT k + {LOAN_ID_BASE} AS id, k AS application_id, 'L' || k AS internal_id,
        settles AS settlement_date,
        CAST(o_totalprice AS DECIMAL(18,2)) AS total_amount,
        CASE WHEN k % 5 <> 0 THEN {ts("paid")} END AS appraisal_paid_at,
        ['purchase', 'refinance', 'other'][o_custkey % 3 + 1] AS transaction_purpose,
        properties_count
    FROM settlements JOIN orders ON o_orderkey = k""",
        "loans": "\n    SELECT * FROM first_loans",
        "loan_closing_costs": f"""
    SELECT l_orderkey + {LOAN_ID_BASE} AS loan_id FROM lineitem""",
        "loan_follow_ups": f"""
    SELECT l_orderkey + {LOAN_ID_BASE} AS loan_id,
        CASE WHEN l_partkey % 97 <> 0 THEN {ts(near("l_shipdate", 20))} END AS date,
        CASE l_returnflag WHEN 'R' THEN 'email' WHEN 'A' THEN 'PHONE' ELSE 'text' END AS via,
        CASE l_linestatus WHEN 'O' THEN 'title' ELSE 'borrower' END AS type
    FROM lineitem""",
        "term_sheets": f"""
    SELECT l_orderkey AS application_id, {ts(near("l_shipdate", 10))} AS created_at,
        CASE l_returnflag WHEN 'A' THEN 'TermSheet::InitialTerms'
            WHEN 'R' THEN 'TermSheet::Revised' ELSE 'TermSheet::FinalTerms' END AS type
    FROM lineitem""",
        "legal": f"""
    SELECT k AS application_id,
        CASE WHEN r % 3 <> 0 THEN {near("od", 15)} END AS kickoff,
        CASE WHEN r % 3 = 1 THEN {near("od", 12)} END AS reviewed,
        CASE WHEN r % 7 >= 4 THEN {near("od", 9)} END AS ordered,
        CASE WHEN r % 7 = 6 THEN {near("od", 6)} END AS reordered,
        CASE WHEN r % 3 = 2 THEN {near("od", 8)} END AS commitment
    FROM {legal}""",
        "properties": f"""
    SELECT {PROPERTY_ID} AS id, l_orderkey + {LOAN_ID_BASE} AS loan_id FROM lineitem""",
        "property_valuations": f"""
    SELECT {PROPERTY_ID} AS property_id,
        CASE WHEN l_partkey % 3 = 0 THEN {near("l_shipdate", 30)} END AS approved,
        CASE WHEN l_partkey % 4 <> 0 THEN {near("l_shipdate", 25)} END AS received,
        CASE WHEN l_suppkey % 2 <> 0 THEN {near("l_shipdate", 5)} END AS cda_ordered,
        CASE WHEN l_suppkey % 2 <> 0 THEN {near("l_shipdate", 5)} END AS cda_received
    FROM lineitem""",
        "products": """
    SELECT * FROM (VALUES (1, 'Bridge Loan'), (2, 'Rental Loan'), (3, 'New Construction'))
        AS p(id, name)""",
        "contacts": f"""
    SELECT s_suppkey AS id, split_part(s_name, '#', 1) AS first_name,
        CASE WHEN s_suppkey % 10 <> 7 THEN split_part(s_name, '#', 2) END AS last_name
    FROM supplier
    UNION ALL
    SELECT c_custkey + {CONTACT_BASE}, split_part(c_name, '#', 1), split_part(c_name, '#', 2)
    FROM customer""",
        "people": """
    SELECT id, first_name || ' ' || last_name AS name FROM contacts""",
        "team_assignments": """
    SELECT replace(s_name, '#', ' ') AS team_member_name,
        CASE WHEN s_suppkey % 3 = 0 THEN 'Ops' ELSE 'PC' END AS team
    FROM supplier, range(CASE WHEN s_suppkey % 10 = 5 THEN 2 ELSE 1 END) AS copies""",
        "borrowers": f"""
    SELECT o_orderkey AS application_id, o_custkey + {CONTACT_BASE} AS contact_id FROM orders
    UNION ALL
    SELECT o_orderkey, greatest(o_custkey - 1, 0) + {CONTACT_BASE} FROM orders
    WHERE o_orderkey % 10 = 3""",
        "stage_dates": f"""
    SELECT k AS application_id, CASE WHEN r % 7 <> 0 THEN {ts(near("od", 10))} END AS reviewed_at
    FROM {dates}""",
        "stage_time_stamps": f"""
    SELECT k AS application_id, {ts(near("od", 8))} AS reviewed_at FROM {stamps}""",
        "channels": """
    SELECT o_orderkey AS application_id, 'L' || o_orderkey AS internal_id,
        CASE o_custkey % 9 WHEN 0 THEN 'Private Client Group' WHEN 1 THEN NULL
            ELSE 'Retail Channel' END AS ops_channel
    FROM orders, range(CASE WHEN o_orderkey % 6 = 4 THEN 2 ELSE 1 END) AS copies""",
        "order_projections": f"""
    SELECT CASE WHEN o_orderkey % 6 = 5 THEN 'static projections' ELSE 'dynamic projections' END
            AS table_type,
        o_orderkey AS application_id,
        CASE WHEN o_orderkey % 31 <> 0 THEN 'Officer ' || (o_custkey % 10) END
            AS loan_officer_name,
        CAST(o_totalprice AS DECIMAL(18,2)) AS total_amount,
        {STATE_LIST}[o_orderkey % 20 + 1] AS state,
        CAST(0.25 * (1 + o_orderkey % 4) AS DECIMAL(9,4)) AS percent_close,
        CASE o_custkey % 4 WHEN 1 THEN 'retail' WHEN 2 THEN 'tpo' WHEN 3 THEN 'wholesale' END
            AS department,
        split_part({APP_TYPE}, '::', 2) AS product,
        o_custkey % 5 = 0 AS portfolio,
        {CLOSING_STATUS} AS closing_status,
        {near("o_orderdate", 25)} AS closing_status_date,
        {near("o_orderdate", 80)} AS deal_stage_date,
        CASE WHEN o_orderkey % 4 <> 0 THEN settles END AS dynamic_settlement_date,
        CAST(o_custkey % 45 + 0.5 * (o_orderkey % 2) AS DOUBLE) AS median_days_to_close,
        CAST(10 AS DOUBLE) AS median_days_from_unconfirmed_to_confirmed_bridge,
        CAST(14 AS DOUBLE) AS median_days_from_unconfirmed_to_confirmed_rental,
        CAST(15 AS DOUBLE) AS median_days_to_close_after_final_terms_bridge,
        CAST(8 AS DOUBLE) AS median_days_to_close_after_final_terms_rental
    FROM orders LEFT JOIN settlements ON k = o_orderkey""",
        "projections": "\n    SELECT * FROM order_projections",
    }
    if second_loans:
        tables["loans"] = f"""
    SELECT * FROM first_loans
    UNION ALL
    SELECT application_id + {SECOND_LOAN_BASE}, application_id, internal_id || 'B',
        settlement_date - 9, total_amount, appraisal_paid_at,
        CASE transaction_purpose WHEN 'other' THEN 'purchase' ELSE 'other' END, 1
    FROM first_loans WHERE properties_count > 3"""
    if repeated:
        tables["projections"] = f"""
    SELECT p.* REPLACE (
        {near("l_shipdate", 25)} AS closing_status_date,
        deal_stage_date - CAST(l_partkey % 4 * 9 AS INT) AS deal_stage_date,
        CASE WHEN l_partkey % 4 <> 1
            THEN dynamic_settlement_date + CAST(l_partkey % 4 AS INT) END
            AS dynamic_settlement_date,
        CAST(total_amount + l_partkey % 4 AS DECIMAL(18,2)) AS total_amount)
    FROM order_projections p JOIN lineitem ON l_orderkey = application_id"""
    return tables


def business_calendar(days: str, as_of: str) -> dict[str, str]:
    """Calendar CTEs over a relation `days` of (d): working days and day counts."""
    return {
        "day_names": f"""
    SELECT d, month(d) AS m, day(d) AS n, isodow(d) AS w, (day(d) + 6) // 7 AS nth
    FROM ({days})""",
        "holidays": """
    SELECT d AS holiday_date, CASE
        WHEN m = 1 AND n = 1 THEN 'New Year''s Day'
        WHEN m = 1 AND w = 1 AND nth = 3 THEN 'Martin Luther King Day'
        WHEN m = 5 AND w = 1 AND n + 7 > 31 THEN 'Memorial Day'
        WHEN m = 6 AND n = 16 THEN 'Founders Day'
        WHEN m = 6 AND n = 19 THEN 'Juneteenth National Independence Day'
        WHEN m = 7 AND n = 4 THEN 'Independence Day'
        WHEN m = 9 AND w = 1 AND nth = 1 THEN 'Labor Day'
        WHEN m = 11 AND w = 4 AND nth = 4 THEN 'Thanksgiving'
        WHEN m = 11 AND w = 5 AND (n + 5) // 7 = 4 THEN 'Day after Thanksgiving (Black Friday)'
        WHEN m = 12 AND n = 24 THEN 'Christmas Eve'
        WHEN m = 12 AND n = 25 THEN 'Christmas Day' END AS name
    FROM day_names""",
        "bank_holidays": """
    SELECT d AS holiday_date FROM day_names
    WHERE (m = 11 AND n = 11) OR (m = 10 AND w = 1 AND nth = 2)""",
        "day_index": """
    SELECT d, workday,
        coalesce(sum(workday::INT) OVER (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING
            AND 1 PRECEDING), 0) AS before,
        sum(workday::INT) OVER (ORDER BY d) AS upto
    FROM (
        SELECT d, w < 6 AND d NOT IN (
            SELECT holiday_date FROM holidays WHERE name <> 'Founders Day') AS workday
        FROM day_names)""",
        "today": f"""
    SELECT d, before, upto FROM day_index WHERE d = {as_of} AND workday""",
    }
