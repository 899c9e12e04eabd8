"""Facts: what a label rule needs to know of the tables hanging off an application.

A rule combines columns of the application with conditions on its loans, their
follow-ups and appraisals, its legal record and its review dates.  Each condition
on such a child row is a fact, and the facts of a row are the bits of one integer.
A rule may be evaluated per child row, or per application after the integers are
combined with `bit_or`: "some row satisfies this".  That aggregate has a
fixed-width buffer and combines map-side, so neither the number of children nor a
hot application matters, and a row carries eight bytes through a shuffle however
many facts there are.

A missing child is a row of NULLs; `TRUE_OF_MISSING` names the facts true of it.
A condition that is NULL is not satisfied.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from closeline.constants import BORROWER, TITLE, TRACKED_PURPOSES
from closeline.functions.ladders import both, either, quoted
from closeline.operators.calendar import Clock
from closeline.operators.copies import COPIES, copies_of
from closeline.operators.extracts import (
    REVIEW_TOTALS,
    latest_follow_ups,
    newest_dates,
    review_copies,
    served_reviews,
    stage_rows,
)
from closeline.operators.joins import left_join_salted

Tables = Mapping[str, DataFrame]
Facts = dict[str, str]

TRUE_OF_MISSING = frozenset(
    {
        "settlement_missing",
        "title_silent",
        "appraisal_unapproved",
        "kickoff_missing",
        "terms_unreviewed",
        "title_unordered",
        "commitment_missing",
        "reviewed_on_other_day",
    }
)

LOAN_MASK = "loan_facts"
VALUATION_MASK = "valuation_facts"
LEGAL_MASK = "legal_facts"
REVIEW_MASK = "review_facts"


def pack(facts: Facts, mask: str) -> str:
    """SQL: the facts of a row as bits of the integer `mask`."""
    bits = (f"IF({condition}, {1 << i}, 0)" for i, condition in enumerate(facts.values()))
    return f"{' | '.join(bits)} AS {mask}"


def filled(mask: str, facts: Iterable[str]) -> str:
    """SQL: `mask`, or that of a missing child where there is none."""
    missing = sum(1 << i for i, name in enumerate(facts) if name in TRUE_OF_MISSING)
    return f"coalesce({mask}, {missing})"


def unpack(df: DataFrame, mask: str, facts: Iterable[str]) -> DataFrame:
    """Add a boolean column per fact; rows without a child get those of none."""
    facts = list(facts)
    bits = [f"{mask} & {1 << i} != 0 AS {name}" for i, name in enumerate(facts)]
    return df.withColumn(mask, F.expr(filled(mask, facts))).selectExpr("*", *bits).drop(mask)


def any_child(df: DataFrame, key: str, mask: str, *also: str) -> DataFrame:
    """Per key the facts some child row satisfies."""
    return df.groupBy(key).agg(*map(F.expr, [*also, f"bit_or({mask}) AS {mask}"]))


# --- conditions per child row, as SQL ---------------------------------------

SETTLES = "to_date(settlement_date)"
TRACKED = f"transaction_purpose IN ({quoted(TRACKED_PURPOSES)})"


def settlement_facts(clock: Clock) -> Facts:
    return {
        "settles_in_two": f"{SETTLES} = {clock.ahead(2)}",
        "settles_next": f"{SETTLES} = {clock.ahead(1)}",
        "settles_today": f"{SETTLES} = {clock.as_of}",
        "settlement_past": f"{SETTLES} < {clock.as_of}",
        "settlement_missing": "settlement_date IS NULL",
        "settlement_set": "settlement_date IS NOT NULL",
    }


def borrower_facts(clock: Clock) -> Facts:
    """Age of the last borrower contact, by how near the closing is."""
    contact = "to_date(borrower_date)"
    near = both(TRACKED, f"{SETTLES} <= {clock.ahead(10)}")
    far = both(TRACKED, f"{SETTLES} > {clock.ahead(10)}")
    undated = "settlement_date IS NULL"

    def on(k: int) -> str:
        return f"{contact} = {clock.back(k)}"

    def by(near_age: str, far_age: str, undated_age: str) -> str:
        return either(both(near, near_age), both(far, far_age), both(undated, undated_age))

    overdue = by(
        f"{contact} <= {clock.back(3)}",
        f"{contact} <= {clock.back(4)}",
        f"{contact} < {clock.back(5)}",
    )
    return {
        "borrower_past_due": overdue,
        "borrower_due_today": by(on(2), on(3), on(5)),
        "borrower_due_tomorrow": by(on(1), on(2), on(4)),
    }


def purpose_facts(clock: Clock) -> Facts:
    soon = f"{SETTLES} BETWEEN {clock.as_of} AND {clock.ahead(7)}"
    return {"purpose_tracked": TRACKED, "purpose_tracked_soon": both(TRACKED, soon)}


def title_facts(clock: Clock) -> Facts:
    """Age of the last title contact, tighter when closing within five days."""
    contact = "to_date(title_date)"
    soon = f"{SETTLES} BETWEEN {clock.as_of} AND {clock.ahead(5)}"

    def by(usual: str, tight: str) -> str:
        return either(f"{contact} {usual}", both(soon, f"{contact} {tight}"))

    return {
        "title_past_due": by(f"< {clock.back(5)}", f"<= {clock.back(2)}"),
        "title_due_today": by(f"= {clock.back(5)}", f"= {clock.back(1)}"),
        "title_due_tomorrow": by(f"= {clock.back(4)}", f"= {clock.as_of}"),
    }


def title_silence_facts(clock: Clock) -> Facts:
    return {"title_silent": "title_date IS NULL"}


def property_count_facts(clock: Clock) -> Facts:
    return {"multi_property": "properties_count > 1", "single_property": "properties_count = 1"}


def valuation_facts(clock: Clock) -> Facts:
    received = f"to_date(appraisal_received_date) <= {clock.back(2)}"
    return {
        "appraisal_unapproved": "appraisal_approved_date IS NULL",
        "cda_overdue": both(received, "cda_order_date IS NULL", "cda_received_date IS NULL"),
    }


def legal_facts(clock: Clock) -> Facts:
    ordered = "to_date(title_commitment_order_date)"
    reordered = "to_date(title_commitment_most_recent_order_date)"
    return {
        "kickoff_missing": "kickoff_call_with_borrower_date IS NULL",
        "kickoff_done": "kickoff_call_with_borrower_date IS NOT NULL",
        "terms_unreviewed": "term_sheet_reviewed_with_borrower_date IS NULL",
        "title_unordered": f"coalesce({ordered}, {reordered}) IS NULL",
        "title_ordered_before": either(
            f"{ordered} < {clock.as_of}", f"{reordered} < {clock.as_of}"
        ),
        "commitment_missing": "preliminary_commitment_received_date IS NULL",
    }


def review_facts(clock: Clock) -> Facts:
    reviewed = "to_date(preliminary_review_date)"
    return {
        "reviewed_today": f"{reviewed} = {clock.as_of}",
        **{f"reviewed_{k}_back": f"{reviewed} = {clock.back(k)}" for k in range(1, 7)},
        "reviewed_by_2_back": f"{reviewed} <= {clock.back(2)}",
        "reviewed_on_other_day": f"NOT coalesce({reviewed} = {clock.back(4)}, false)",
    }


LOAN_FACTS = {
    "settlement": settlement_facts,
    "borrower": borrower_facts,
    "purpose": purpose_facts,
    "title": title_facts,
    "title_silence": title_silence_facts,
    "property_count": property_count_facts,
}
FOLLOW_UP_FACTS = {"title": TITLE, "title_silence": TITLE, "borrower": BORROWER}


# --- frames ------------------------------------------------------------------


def loans_with_follow_ups(
    loans: DataFrame, follow_ups: Callable[[], DataFrame], groups: Iterable[str]
) -> DataFrame:
    """Loans and the newest follow-ups the fact groups ask for."""
    loans = loans.withColumnRenamed("id", "loan_id")
    kinds = {FOLLOW_UP_FACTS[g] for g in groups if g in FOLLOW_UP_FACTS}
    if not kinds:
        return loans
    if len(kinds) == 2:
        newest = latest_follow_ups(follow_ups())
    else:
        (kind,) = kinds
        newest = newest_dates(follow_ups(), kind).withColumnRenamed("date", f"{kind}_date")
    return loans.join(newest, "loan_id", "left")


def loan_facts(clock: Clock, groups: Iterable[str]) -> Facts:
    return {name: c for group in groups for name, c in LOAN_FACTS[group](clock).items()}


def loan_rows(
    tables: Tables,
    clock: Clock,
    groups: Iterable[str],
    *also: str,
    loans: DataFrame | None = None,
) -> DataFrame:
    """One row per loan: its application and the facts of some groups."""
    loans = tables["loans"] if loans is None else loans
    rows = loans_with_follow_ups(loans, lambda: tables["loan_follow_ups"], groups)
    return clock.attach(rows).selectExpr(
        "application_id", *also, pack(loan_facts(clock, groups), LOAN_MASK)
    )


def with_valuation_rows(tables: Tables, clock: Clock, apps: DataFrame) -> DataFrame:
    """A row per application, loan, property and valuation, with valuation facts.

    Joined from the application down, so that a filter on it thins every step.  Hot
    applications, loans and properties are split by the children's ids; valuations have
    none and are numbered where they are read, which a second run of a task repeats.
    """
    loans = tables["loans"].selectExpr("application_id", "id AS loan_id")
    properties = tables["properties"].selectExpr("id AS property_id", "loan_id")
    valuations = clock.attach(tables["property_valuations"]).selectExpr(
        "property_id", "appraisal_received_date", pack(valuation_facts(clock), VALUATION_MASK)
    )
    return left_join_salted(
        apps,
        (loans, "application_id", F.col("loan_id")),
        (properties, "loan_id", F.col("property_id")),
        (valuations, "property_id", F.monotonically_increasing_id()),
    )


def valuation_facts_by_loan(tables: Tables, clock: Clock) -> DataFrame:
    """Valuation facts combined per property, then per loan."""
    facts = valuation_facts(clock)
    valuations = clock.attach(tables["property_valuations"]).selectExpr(
        "property_id", pack(facts, VALUATION_MASK)
    )
    by_property = any_child(valuations, "property_id", VALUATION_MASK)
    properties = tables["properties"].selectExpr("id AS property_id", "loan_id")
    appraised = properties.join(by_property, "property_id", "left").selectExpr(
        "loan_id", f"{filled(VALUATION_MASK, facts)} AS {VALUATION_MASK}"
    )
    return any_child(appraised, "loan_id", VALUATION_MASK)


def loans_with_valuations(tables: Tables, clock: Clock, loans: DataFrame) -> DataFrame:
    """Add to each loan the facts of its valuations, or those of none."""
    joined = loans.join(valuation_facts_by_loan(tables, clock), "loan_id", "left")
    value = filled(VALUATION_MASK, valuation_facts(clock))
    return joined.withColumn(VALUATION_MASK, F.expr(value))


def legal_rows(tables: Tables, clock: Clock) -> DataFrame:
    """Legal records with their facts."""
    records = tables["legal_closing_informations"]
    return records.selectExpr("*", pack(legal_facts(clock), LEGAL_MASK))


def legal_facts_by_application(tables: Tables, clock: Clock, *also: str) -> DataFrame:
    """Legal facts per application, next to other aggregates of its records."""
    return any_child(legal_rows(tables, clock), "application_id", LEGAL_MASK, *also)


def review_facts_by_application(tables: Tables, clock: Clock) -> DataFrame:
    """Facts of the review dates: primary ones, and fallbacks where one is NULL or none is.

    The facts of both stage tables are combined in one pass; which count is decided per
    application afterwards.
    """
    rows = clock.attach(stage_rows(tables)).selectExpr(
        "id",
        "fallback",
        "NOT fallback AND preliminary_review_date IS NULL AS undated",
        pack(review_facts(clock), REVIEW_MASK),
    )
    seen = rows.groupBy("id").agg(
        F.expr("bit_or(IF(fallback OR undated, 0, review_facts)) AS primary_facts"),
        F.expr("bit_or(IF(fallback, review_facts, 0)) AS fallback_facts"),
        F.expr("bool_or(undated) OR bool_and(fallback) AS looks_up"),
        F.expr("bool_or(fallback) AS has_fallback"),
    )
    reviews = seen.join(served_reviews(tables), "id", "left_semi")
    looked_up = f"IF(has_fallback, fallback_facts, {filled('NULL', review_facts(clock))})"
    return reviews.selectExpr(
        "id AS application_id",
        f"primary_facts | IF(looks_up, {looked_up}, 0) AS {REVIEW_MASK}",
    )


def review_rows_by_application(tables: Tables, clock: Clock) -> DataFrame:
    """Facts of the review dates, and how many rows of `prelim_review_date` have them.

    Rows of the stage tables with equal facts are counted first; `review_copies` then
    says how often a counted row stands, so no row meets another one.
    """
    rows = clock.attach(stage_rows(tables)).selectExpr(
        "id",
        "fallback",
        "NOT fallback AND preliminary_review_date IS NULL AS undated",
        pack(review_facts(clock), REVIEW_MASK),
    )
    groups = rows.groupBy("id", "fallback", "undated", REVIEW_MASK).agg(F.count("*").alias("n"))
    groups = groups.join(served_reviews(tables), "id", "left_semi")
    # An application has no more groups than there are sets of facts.
    own = [f"{total} OVER (PARTITION BY id) AS {c}" for c, total in REVIEW_TOTALS.items()]
    reviews = review_copies(groups.selectExpr("*", *own)).groupBy("id", REVIEW_MASK)
    reviews = reviews.agg(F.sum(COPIES).alias(copies_of(REVIEW_MASK)))
    return reviews.withColumnRenamed("id", "application_id")
