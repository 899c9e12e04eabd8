"""Service-level classifiers: one label per application, or per child row.

A `Kpi` states which facts it needs, which applications it covers (`gate`) and
how the label follows.  `classify` evaluates one of them on its own; the report
evaluates all of them side by side on one frame.

Grains of `classify`:

* ``"row"``: a row per application and loan (per property valuation for the
  appraisal rules), the way the joins of the rule lay it out;
* ``"application"``: a row per application, labelled by the first rung of the
  ladder that any of its child rows satisfies.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from closeline.constants import (
    BRIDGE_TYPE,
    CLASSIFIER_EXCLUDED_STATES,
    DUE_TODAY,
    DUE_TOMORROW,
    FUTURE,
    INITIAL_UNDERWRITING,
    LIKELY,
    NEW_CONSTRUCTION,
    NOT_CONFIRMED,
    OUTSTANDING,
    PAST_DUE,
    PRELIMINARY_REVIEW,
    RENTAL_TYPE,
    TERM_SHEET_STATES,
    TERMS_EXCLUDED_STATES,
    TITLE_ORDER_HOURS,
)
from closeline.functions.dates import hour_boundaries
from closeline.functions.ladders import both, either, first_match, quoted
from closeline.operators.calendar import Clock
from closeline.operators.copies import COPIES, counted, spelt_out, with_copies
from closeline.operators.extracts import first_term_sheets
from closeline.operators.facts import (
    FOLLOW_UP_FACTS,
    LEGAL_MASK,
    LOAN_MASK,
    REVIEW_MASK,
    VALUATION_MASK,
    Facts,
    any_child,
    legal_facts,
    legal_facts_by_application,
    legal_rows,
    loan_facts,
    loan_rows,
    loans_with_valuations,
    review_facts,
    review_facts_by_application,
    review_rows_by_application,
    unpack,
    valuation_facts,
    with_valuation_rows,
)
from closeline.operators.reducers import reduced

Tables = Mapping[str, DataFrame]
Label = Callable[[Clock], str]


@dataclass(frozen=True)
class Kpi:
    """`scope` is the part of `gate` that looks at the application row alone.

    `follows` is a KPI whose rows, of the same tables, meet those of this one, which
    looks at their labels as `first_call_open`.
    """

    name: str
    scope: str
    gate: str
    label: Label
    loan_facts: tuple[str, ...] = ()
    valuations: bool = False
    legal: bool = False
    reviews: bool = False
    terms: bool = False
    product: bool = False
    follows: Kpi | None = None
    key: str = "application_number"

    def gated_label(self, clock: Clock) -> str:
        """SQL: the label where the gate holds, NULL elsewhere."""
        return f"CASE WHEN {self.gate} THEN {self.label(clock)} END"


# --- shared conditions on the application, as SQL ---------------------------
#
# Computed once per application, after the joins, as columns that are never NULL:
# the rules over them then compile to plain boolean code.

WAS_SUBMITTED = "submitted_to_initial_underwriting_at IS NOT NULL"
UNCONFIRMED_STATUS = f"closing_status IN ({quoted((LIKELY, NOT_CONFIRMED))})"
HAS_TERMS = "initial_terms_date IS NOT NULL"

CONDITIONS = {
    "classified": f"state NOT IN ({quoted(CLASSIFIER_EXCLUDED_STATES)})",
    "past_underwriting": f"state NOT IN ({quoted(TERMS_EXCLUDED_STATES)})",
    "in_terms": f"state IN ({quoted(TERM_SHEET_STATES)})",
    "in_review": f"state = '{PRELIMINARY_REVIEW}'",
    "in_underwriting": f"state = '{INITIAL_UNDERWRITING}'",
    "unconfirmed": f"closing_status IS NULL OR {UNCONFIRMED_STATUS}",
    "some_portfolio": "portfolio",
    "no_portfolio": "NOT portfolio",
    "rental": f"type = '{RENTAL_TYPE}'",
    "bridge": f"type = '{BRIDGE_TYPE}'",
}
PRODUCT_CONDITIONS = {
    "new_construction": f"product_name = '{NEW_CONSTRUCTION}'",
    "other_product": f"product_name != '{NEW_CONSTRUCTION}'",
}
IN_PROCESSING = both("classified", WAS_SUBMITTED)


def bare(scope: str) -> str:
    """SQL: a scope over the table's own columns, which a file scan can filter by."""
    names = re.compile(rf"\b({'|'.join(CONDITIONS)})\b")
    return names.sub(lambda m: f"({CONDITIONS[m.group()]})", scope)


def older(k: int) -> str:
    return f"older_than_{k}"


def at_least(k: int) -> str:
    return f"at_least_{k}"


def submission_ages(clock: Clock) -> dict[str, str]:
    """Age of the submission in business days."""
    submitted = "to_date(submitted_to_initial_underwriting_at)"
    return {
        **{older(k): f"{submitted} < {clock.back(k)}" for k in (20, 25, 30, 35, 50)},
        **{at_least(k): f"{submitted} <= {clock.back(k)}" for k in (9, 15, 20)},
        "submitted_today": f"{submitted} = {clock.as_of}",
        "submitted_1_back": f"{submitted} = {clock.back(1)}",
        "submitted_2_back": f"{submitted} = {clock.back(2)}",
    }


def with_conditions(df: DataFrame, conditions: dict[str, str]) -> DataFrame:
    """Add conditions as columns, false where they are NULL."""
    return df.selectExpr("*", *[f"coalesce({c}, false) AS {n}" for n, c in conditions.items()])


# --- preliminary review calls ------------------------------------------------

CALL_PENDING = f"kickoff_done AND NOT ({WAS_SUBMITTED})"

WELCOME_CALL_SCOPE = both(
    either("in_review", "in_underwriting"),
    "coalesce(withdrawn_at, rejected_at, long_termed_at) IS NULL",
)
WELCOME_CALL_GATE = both(WELCOME_CALL_SCOPE, "kickoff_missing")


def welcome_call_label(clock: Clock) -> str:
    def started(submission: str, review: str) -> str:
        return either(both("in_underwriting", submission), both("in_review", review))

    return first_match(
        [
            (DUE_TOMORROW, started("submitted_today", "reviewed_today")),
            (DUE_TODAY, started("submitted_1_back", "reviewed_1_back")),
            # Older reviews stay past due; older submissions drop out.
            (PAST_DUE, started("submitted_2_back", "reviewed_by_2_back")),
        ]
    )


def follow_up_call_1_label(clock: Clock) -> str:
    return first_match(
        [
            (DUE_TOMORROW, both(CALL_PENDING, "reviewed_2_back")),
            (DUE_TODAY, both(CALL_PENDING, "reviewed_3_back")),
            (PAST_DUE, both(CALL_PENDING, "reviewed_4_back")),
        ]
    )


def first_call_open(clock: Clock) -> str:
    """SQL: a row of the first call is not past due."""
    return f"coalesce({follow_up_call_1_label(clock)}, '') != '{PAST_DUE}'"


# Some row of the first call is not past due: that of a record without a kickoff, or
# of a review on another day than the one past due.
SOME_FIRST_CALL_OPEN = either(WAS_SUBMITTED, "kickoff_missing", "reviewed_on_other_day")


def follow_up_call_2_label(clock: Clock) -> str:
    return first_match(
        [
            # Four days back is past due for the first call, so this rung only
            # ever matches where several records or review dates meet on one application.
            (DUE_TOMORROW, both(CALL_PENDING, "reviewed_4_back", "first_call_open")),
            (DUE_TODAY, both(CALL_PENDING, "reviewed_5_back")),
            (PAST_DUE, both(CALL_PENDING, "reviewed_6_back")),
        ]
    )


# --- closing, borrower and terms ---------------------------------------------


def closing_label(clock: Clock) -> str:
    return first_match(
        [
            ("2 Business Days", both("unconfirmed", "settles_in_two")),
            ("Next Business Day", both("unconfirmed", "settles_next")),
            ("Today", both("unconfirmed", "settles_today")),
            (PAST_DUE, both("unconfirmed", "settlement_past")),
            ("No Settlement Date", both("unconfirmed", "settlement_missing")),
            ("Not Likely", both(f"closing_status = '{NOT_CONFIRMED}'", "settlement_set")),
        ],
        otherwise=FUTURE,
    )


IN_TERMS_SCOPE = both("past_underwriting", "unconfirmed")
BORROWER_FOLLOW_UP_GATE = both(IN_TERMS_SCOPE, HAS_TERMS)


def borrower_follow_up_label(clock: Clock) -> str:
    return first_match(
        [
            (PAST_DUE, "borrower_past_due"),
            (DUE_TODAY, "borrower_due_today"),
            (DUE_TOMORROW, "borrower_due_tomorrow"),
        ]
    )


INITIAL_TERMS_GATE = both(BORROWER_FOLLOW_UP_GATE, "purpose_tracked")


def initial_terms_label(clock: Clock) -> str:
    waiting = both("in_terms", "terms_unreviewed")

    def rung(by: str, soon_on: str) -> str:
        soon = both("purpose_tracked_soon", f"initial_terms_date = {soon_on}")
        return both(waiting, either(f"initial_terms_date <= {by}", soon))

    return first_match(
        [
            (PAST_DUE, rung(clock.back(3), clock.back(2))),
            (DUE_TODAY, rung(clock.back(2), clock.back(1))),
            (DUE_TOMORROW, rung(clock.back(1), clock.as_of)),
        ]
    )


# --- title ---------------------------------------------------------------------


def title_order_label(clock: Clock) -> str:
    waited = hour_boundaries("submitted_to_initial_underwriting_at", clock.as_of_ts)
    late = f"{waited} >= {TITLE_ORDER_HOURS}"
    return first_match([(OUTSTANDING, both(late, "title_unordered"))])


def title_order_confirmation_label(clock: Clock) -> str:
    return first_match([(OUTSTANDING, both("title_ordered_before", "title_silent"))])


def title_follow_up_label(clock: Clock) -> str:
    return first_match(
        [
            (PAST_DUE, both("commitment_missing", "title_past_due")),
            (DUE_TODAY, both("commitment_missing", "title_due_today")),
            (DUE_TOMORROW, both("commitment_missing", "title_due_tomorrow")),
        ],
        otherwise=FUTURE,
    )


# --- appraisal and processing times ---------------------------------------------

# The portfolio test belongs to the status list alone: applications without a
# closing status pass whether or not they are a portfolio.
APPRAISAL_GATE = both(
    IN_PROCESSING, "unconfirmed", either("closing_status IS NULL", "no_portfolio")
)
PROCESSED = both(IN_PROCESSING, "unconfirmed")
SINGLE_LOAN = either("no_portfolio", "single_property")
PORTFOLIO_GATE = both(PROCESSED, either("some_portfolio", "multi_property"))
NEW_CONSTRUCTION_GATE = both(PROCESSED, SINGLE_LOAN, "new_construction")
RENTAL_GATE = both(PROCESSED, SINGLE_LOAN, "rental", "other_product")
BRIDGE_GATE = both(PROCESSED, "no_portfolio", "bridge", "other_product")
CDA_GATE = both("no_portfolio", "rental", WAS_SUBMITTED)


def appraisal_label(clock: Clock) -> str:
    return first_match(
        [(f">{k} days", both(at_least(k), "appraisal_unapproved")) for k in (20, 15, 9)]
    )


def processing_label(*limits: int) -> Label:
    """Label by the longest limit, in business days, the submission is older than."""
    return lambda clock: first_match([(f">{k} Days", older(k)) for k in limits])


def cda_label(clock: Clock) -> str:
    return first_match([(PAST_DUE, "cda_overdue")])


# --- the fifteen ------------------------------------------------------------------

WELCOME_CALL = Kpi(
    "preliminary_review_welcome_call_kpi",
    WELCOME_CALL_SCOPE,
    WELCOME_CALL_GATE,
    welcome_call_label,
    legal=True,
    reviews=True,
    key="id",
)
FOLLOW_UP_CALL_1 = Kpi(
    "preliminary_review_follow_up_call_1_kpi",
    "in_review",
    "in_review",
    follow_up_call_1_label,
    legal=True,
    reviews=True,
    key="id",
)
FOLLOW_UP_CALL_2 = Kpi(
    "preliminary_review_follow_up_call_2_kpi",
    "in_review",
    "in_review",
    follow_up_call_2_label,
    legal=True,
    reviews=True,
    follows=FOLLOW_UP_CALL_1,
    key="id",
)
CLOSING = Kpi(
    "closing_kpi", IN_PROCESSING, IN_PROCESSING, closing_label, loan_facts=("settlement",)
)
BORROWER_FOLLOW_UP = Kpi(
    "follow_up_kpi",
    IN_TERMS_SCOPE,
    BORROWER_FOLLOW_UP_GATE,
    borrower_follow_up_label,
    loan_facts=("borrower",),
    terms=True,
)
INITIAL_TERMS = Kpi(
    "initial_terms_kpi",
    IN_TERMS_SCOPE,
    INITIAL_TERMS_GATE,
    initial_terms_label,
    loan_facts=("purpose",),
    legal=True,
    terms=True,
)
TITLE_ORDER = Kpi("title_order", IN_PROCESSING, IN_PROCESSING, title_order_label, legal=True)
TITLE_ORDER_CONFIRMATION = Kpi(
    "title_order_confirmation",
    IN_PROCESSING,
    IN_PROCESSING,
    title_order_confirmation_label,
    loan_facts=("title_silence",),
    legal=True,
)
TITLE_FOLLOW_UP = Kpi(
    "title_follow_up",
    "classified",
    both("classified", HAS_TERMS),
    title_follow_up_label,
    loan_facts=("title",),
    legal=True,
    terms=True,
)
APPRAISAL_MISSING = Kpi(
    "appraisal_kpi", APPRAISAL_GATE, APPRAISAL_GATE, appraisal_label, valuations=True
)
PROCESSING_PORTFOLIO = Kpi(
    "processing_times_portfolio",
    PROCESSED,
    PORTFOLIO_GATE,
    processing_label(50, 35, 25),
    loan_facts=("property_count",),
)
PROCESSING_NEW_CONSTRUCTION = Kpi(
    "processing_times_new_construction",
    PROCESSED,
    NEW_CONSTRUCTION_GATE,
    processing_label(35, 30, 25),
    loan_facts=("property_count",),
    product=True,
)
PROCESSING_RENTAL = Kpi(
    "processing_times_rental",
    both(PROCESSED, "rental"),
    RENTAL_GATE,
    processing_label(50, 35, 25),
    loan_facts=("property_count",),
    product=True,
)
PROCESSING_BRIDGE = Kpi(
    # Column name as reports know it.
    "progressing_times_bridge",
    both(PROCESSED, "no_portfolio", "bridge"),
    BRIDGE_GATE,
    processing_label(30, 25, 20),
    loan_facts=("property_count",),
    product=True,
)
CDA = Kpi("cda_kpi", CDA_GATE, CDA_GATE, cda_label, valuations=True)

KPIS = (
    WELCOME_CALL,
    FOLLOW_UP_CALL_1,
    FOLLOW_UP_CALL_2,
    CLOSING,
    BORROWER_FOLLOW_UP,
    INITIAL_TERMS,
    TITLE_ORDER,
    TITLE_ORDER_CONFIRMATION,
    TITLE_FOLLOW_UP,
    APPRAISAL_MISSING,
    PROCESSING_PORTFOLIO,
    PROCESSING_NEW_CONSTRUCTION,
    PROCESSING_RENTAL,
    PROCESSING_BRIDGE,
    CDA,
)


# --- frames ------------------------------------------------------------------------


def with_terms(tables: Tables, apps: DataFrame) -> DataFrame:
    return apps.join(first_term_sheets(tables["term_sheets"]), "application_id", "left")


def with_legal(tables: Tables, clock: Clock, apps: DataFrame, *also: str) -> DataFrame:
    legal = legal_facts_by_application(tables, clock, *also)
    return apps.join(legal, "application_id", "left")


def with_product(tables: Tables, apps: DataFrame) -> DataFrame:
    products = tables["products"].selectExpr("id AS product_id", "name AS product_name")
    return with_conditions(apps.join(products, "product_id", "left"), PRODUCT_CONDITIONS)


def at(clock: Clock, df: DataFrame) -> DataFrame:
    """Add what the labels need to know of the clock; after the last shuffle."""
    return with_conditions(clock.attach(df), submission_ages(clock))


def meeting_first_calls(df: DataFrame, clock: Clock) -> DataFrame:
    """Rows of the second call with those of the first, told apart by `first_call_open`.

    Both have the rows of `df`, counted by their facts, of which an application has few;
    each meets the number of open and of past due first calls of its application.
    """
    own = "OVER (PARTITION BY application_id)"
    calls = df.selectExpr(
        "*",
        f"sum(IF({first_call_open(clock)}, {COPIES}, 0)) {own} AS open_calls",
        f"sum({COPIES}) {own} AS calls",
    )
    met = "inline(array(struct(true, 0L + open_calls), struct(false, calls - open_calls)))"
    rows = calls.selectExpr("*", f"{met} AS (first_call_open, met)").filter("met > 0")
    return rows.withColumn(COPIES, F.col(COPIES) * F.col("met")).drop("open_calls", "calls", "met")


def children_of(kpi: Kpi) -> set[str]:
    """Tables hanging off an application that a KPI reads by its key."""
    found = {"legal_closing_informations"} if kpi.legal else set()
    if kpi.terms:
        found.add("term_sheets")
    if kpi.loan_facts or kpi.valuations:
        found.add("loans")
    if any(group in FOLLOW_UP_FACTS for group in kpi.loan_facts):
        found.add("loan_follow_ups")
    if kpi.valuations:
        found |= {"properties", "property_valuations"}
    return found


def classify(
    tables: Tables, clock: Clock, kpi: Kpi, grain: str = "row", *, reduce_up_to: int = 0
) -> DataFrame:
    """Label the applications one KPI covers: (key, label).

    Only the applications in the scope of the KPI are read.  Child tables are reduced
    to one row per application before they are joined; for a "row" grain, loans, legal
    records and review dates to one row per application and set of facts, with the
    number of rows it stands for.  Those numbers are multiplied where the tables meet
    and the rows spelt out at the end; valuations are not reduced at all.

    With `reduce_up_to`, the applications are counted first, and if they are at most that
    many their ids thin the child tables before these are shuffled.
    """
    if grain not in ("row", "application"):
        raise ValueError(f"unknown grain {grain!r}")
    by_row = grain == "row"
    df = tables["applications"].filter(bare(kpi.scope)).withColumnRenamed("id", "application_id")
    if reduce_up_to:
        tables = reduced(tables, df, reduce_up_to, *children_of(kpi))
    if kpi.terms:
        df = with_terms(tables, df)
    if kpi.product:
        df = with_product(tables, df)

    masks: dict[str, Facts] = {}
    children: dict[str, DataFrame] = {}
    if kpi.legal:
        masks[LEGAL_MASK] = legal_facts(clock)
        if by_row:
            children[LEGAL_MASK] = counted(legal_rows(tables, clock), "application_id", LEGAL_MASK)
        else:
            children[LEGAL_MASK] = legal_facts_by_application(tables, clock)
    if kpi.reviews:
        masks[REVIEW_MASK] = review_facts(clock)
        reviews = review_rows_by_application if by_row else review_facts_by_application
        children[REVIEW_MASK] = reviews(tables, clock)
    if kpi.loan_facts:
        masks[LOAN_MASK] = loan_facts(clock, kpi.loan_facts)
        loans = loan_rows(tables, clock, kpi.loan_facts)
        combined = counted if by_row else any_child
        children[LOAN_MASK] = combined(loans, "application_id", LOAN_MASK)
    for child in children.values():
        df = df.join(child, "application_id", "left")
    if by_row and children:
        df = with_copies(df, children)
    if kpi.valuations:
        masks[VALUATION_MASK] = valuation_facts(clock)
        if by_row:
            df = with_valuation_rows(tables, clock, df)
        else:
            loans = tables["loans"].selectExpr("application_id", "id AS loan_id")
            valued = loans_with_valuations(tables, clock, loans)
            valued = any_child(valued, "application_id", VALUATION_MASK)
            df = df.join(valued, "application_id", "left")
    for mask, facts in masks.items():
        df = unpack(df, mask, facts)
    if kpi.follows:
        some = with_conditions(df, {"first_call_open": SOME_FIRST_CALL_OPEN})
        df = meeting_first_calls(df, clock) if by_row else some

    shown = [f"application_id AS {kpi.key}", f"{kpi.label(clock)} AS {kpi.name}"]
    if kpi is CDA and by_row:
        shown += [
            f"{clock.as_of} AS as_of",
            "to_date(appraisal_received_date) AS appraisal_received_date",
        ]
    covered = with_conditions(df, CONDITIONS).filter(kpi.gate)
    labelled = at(clock, covered)
    if COPIES not in df.columns:
        return labelled.selectExpr(*shown)
    return spelt_out(labelled.selectExpr(*shown, COPIES), kpi.key)
