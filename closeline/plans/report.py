"""The wide application report.

Grain by construction: every table hanging off an application is reduced to one
row per application before it is joined, so the joins never multiply and the
final dedupe has nothing left to throw away.  Per application the report shows
the loan with the lowest id and the borrower with the lowest contact id, and each
classifier the first rung of its ladder that any child row satisfies.  Ids of
applications, loans and contacts are keys of their tables.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from closeline.constants import (
    BRIDGE_TYPE,
    COORDINATOR_TEAM,
    RENTAL_TYPE,
    REPORT_EXCLUDED_STATES,
)
from closeline.functions.ladders import quoted
from closeline.functions.text import sentence_case
from closeline.operators import kpis as k
from closeline.operators.calendar import Clock
from closeline.operators.facts import (
    LEGAL_MASK,
    LOAN_FACTS,
    LOAN_MASK,
    VALUATION_MASK,
    legal_facts,
    loan_facts,
    loan_rows,
    loans_with_valuations,
    review_facts,
    unpack,
    valuation_facts,
)
from closeline.operators.reducers import reduced
from closeline.plans.closings import named_contacts, on_team

Tables = Mapping[str, DataFrame]

# What the report shows of a loan, as SQL.
LOAN_DISPLAY = {
    "loan_number": "internal_id",
    "appraisal_paid_at": "appraisal_paid_at",
    "loan_application_id": "application_id",
    "borrower_follow_up_date": "to_date(borrower_date)",
    "borrower_follow_up_type": sentence_case("borrower_via"),
    "title_follow_up_date": "to_date(title_date)",
    "title_follow_up_type": sentence_case("title_via"),
    "closing_date": "to_date(settlement_date)",
    "transaction_purpose": "transaction_purpose",
}
DISPLAY = "named_struct({}) AS display".format(
    ", ".join(f"'{name}', {value}" for name, value in LOAN_DISPLAY.items())
)

REPORT_COLUMNS = (
    "project_coordinator",
    "loan_number",
    "appraisal_paid_at",
    "kickoff_call_with_borrower_date",
    "application_number",
    "created_at",
    "closing_status",
    "type",
    "in_conditions_review_from",
    "requested_for_ctc",
    "as_of_ts",
    "application_id",
    "borrower_follow_up_date",
    "borrower_follow_up_type",
    "title_follow_up_date",
    "title_follow_up_type",
    "state",
    "closing_date",
    "closing_kpi",
    "follow_up_kpi",
    "transaction_purpose",
    "initial_terms_kpi",
    "title_order",
    "title_order_confirmation",
    "title_follow_up",
    "appraisal_kpi",
    "processing_times_rental",
    "progressing_times_bridge",
    "processing_times_new_construction",
    "processing_times_portfolio",
    "cda_kpi",
    "preliminary_review_welcome_call_kpi",
    "preliminary_review_follow_up_call_1_kpi",
    "preliminary_review_follow_up_call_2_kpi",
    "borrower_name",
    "row_num",
)

# Loans of an application are numbered in blocks of this many loan ids, so no
# task numbers more than one block however many loans an application has.
LOAN_BLOCK = 1 << 20


def reportable(tables: Tables) -> DataFrame:
    """Applications the report covers, whoever coordinates them."""
    return (
        tables["applications"]
        .filter(
            "rejected_at IS NULL AND withdrawn_at IS NULL "
            "AND project_coordinator_id IS NOT NULL "
            f"AND type IN ({quoted((BRIDGE_TYPE, RENTAL_TYPE))}) "
            f"AND state NOT IN ({quoted(REPORT_EXCLUDED_STATES)})"
        )
        .withColumnRenamed("id", "application_id")
    )


def reported_applications(tables: Tables, team: str) -> DataFrame:
    """Applications on the report, with the coordinator's name."""
    coordinators = on_team(named_contacts(tables), tables, team, "left_semi").selectExpr(
        "contact_id AS project_coordinator_id", "contact_name AS project_coordinator"
    )
    return reportable(tables).join(coordinators, "project_coordinator_id")


def first_borrowers(tables: Tables) -> DataFrame:
    """Borrower with the lowest contact id: (application_id, borrower_name)."""
    first = (
        tables["borrowers"]
        .groupBy("application_id")
        .agg(F.min("contact_id").alias("contact_id"))
    )
    names = named_contacts(tables).withColumnRenamed("contact_name", "borrower_name")
    return first.join(names, "contact_id", "left").select("application_id", "borrower_name")


def loan_frame(tables: Tables, clock: Clock) -> DataFrame:
    """Loans of reportable applications: display columns and facts.

    Most applications are long closed; leaving their loans out first keeps them
    out of every later shuffle.
    """
    covered = reportable(tables).select("application_id")
    loans = tables["loans"].join(covered, "application_id", "left_semi")
    loans = loan_rows(tables, clock, LOAN_FACTS, "loan_id", DISPLAY, loans=loans)
    return loans_with_valuations(tables, clock, loans)


def labelled_applications(
    tables: Tables, clock: Clock, by_application: DataFrame, team: str
) -> DataFrame:
    """Reported applications with every label, one row each."""
    kickoff = "kickoff_call_with_borrower_date"
    df = reported_applications(tables, team)
    df = k.with_product(tables, df)
    df = k.with_terms(tables, df)
    df = k.with_legal(tables, clock, df, f"min({kickoff}) AS {kickoff}")
    df = df.join(first_borrowers(tables), "application_id", "left")
    df = df.join(by_application, "application_id", "left")
    df = unpack(df, LEGAL_MASK, legal_facts(clock))
    df = unpack(df, LOAN_MASK, loan_facts(clock, LOAN_FACTS))
    df = unpack(df, VALUATION_MASK, valuation_facts(clock))
    # The report leaves out the preliminary_review state, the only one whose
    # labels look at review dates; those rules stay, their facts are NULL.
    unknown = [
        f"CAST(NULL AS boolean) AS {name}" for name in (*review_facts(clock), "first_call_open")
    ]
    df = k.at(clock, k.with_conditions(df.selectExpr("*", *unknown), k.CONDITIONS))
    return df.selectExpr("*", *[f"{kpi.gated_label(clock)} AS {kpi.name}" for kpi in k.KPIS])


def with_display(df: DataFrame) -> DataFrame:
    return df.select("*", "display.*")


def _report(df: DataFrame, clock: Clock) -> DataFrame:
    df = df.withColumnsRenamed(
        {"application_id": "application_number", "loan_application_id": "application_id"}
    )
    return df.withColumn("as_of_ts", F.expr(clock.as_of_ts)).select(*REPORT_COLUMNS)


CHILDREN = (
    "loans",
    "loan_follow_ups",
    "properties",
    "property_valuations",
    "legal_closing_informations",
    "term_sheets",
    "borrowers",
)


def application_report(
    tables: Tables, clock: Clock, team: str = COORDINATOR_TEAM, *, reduce_up_to: int = 0
) -> DataFrame:
    """One row per reported application.

    With `reduce_up_to`, the reported applications are counted first, and if they are at
    most that many their ids thin the child tables before these are shuffled.
    """
    if reduce_up_to:
        tables = reduced(tables, reported_applications(tables, team), reduce_up_to, *CHILDREN)
    by_application = loan_frame(tables, clock).groupBy("application_id").agg(
        F.min_by("display", "loan_id").alias("display"),
        F.bit_or(LOAN_MASK).alias(LOAN_MASK),
        F.bit_or(VALUATION_MASK).alias(VALUATION_MASK),
    )
    df = labelled_applications(tables, clock, by_application, team)
    return _report(with_display(df).withColumn("row_num", F.lit(1)), clock)


def loan_blocks(loans: DataFrame) -> DataFrame:
    """`loans` numbered by loan id in blocks: (..., block, nth, block_loans and the block's facts).

    An application with very many loans is spread over tasks by its blocks of loan ids, of
    which none has more loans than ids.  All columns stand in the order, though ids alone
    decide it: so whoever reads only some of the columns still reads the same shuffle.
    """
    block = f"CAST(floor(loan_id / {LOAN_BLOCK}) AS bigint) AS block"
    order = f"PARTITION BY application_id, block ORDER BY loan_id, {LOAN_MASK}, {VALUATION_MASK}, display"
    whole = f"OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    keyed = loans.selectExpr("*", block).filter("application_id IS NOT NULL AND block IS NOT NULL")
    # Dealt by both, even where the loans already are by application alone.
    return keyed.repartition("application_id", "block").selectExpr(
        "application_id",
        "block",
        "display",
        f"row_number() OVER ({order}) AS nth",
        f"count(*) {whole} AS block_loans",
        f"bit_or({LOAN_MASK}) {whole} AS {LOAN_MASK}",
        f"bit_or({VALUATION_MASK}) {whole} AS {VALUATION_MASK}",
    )


def summed_blocks(blocks: DataFrame) -> DataFrame:
    """A row per application and block: loans in the blocks before, facts of all loans."""
    own = "PARTITION BY application_id"
    before = f"({own} ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return blocks.filter("nth = 1").selectExpr(
        "application_id",
        "block",
        f"coalesce(sum(block_loans) OVER {before}, 0L) AS earlier_loans",
        f"bit_or({LOAN_MASK}) OVER ({own}) AS {LOAN_MASK}",
        f"bit_or({VALUATION_MASK}) OVER ({own}) AS {VALUATION_MASK}",
    )


def application_report_rows(
    tables: Tables, clock: Clock, team: str = COORDINATOR_TEAM
) -> DataFrame:
    """The report before its dedupe: a row per reported application and loan.

    The loan frame is shuffled once, by application and block.  Blocks are summed up to
    label the applications, a row for each of their blocks, which then meet the loans of
    that block where these already are: a hot application is split by its blocks.
    """
    blocks = loan_blocks(loan_frame(tables, clock))
    df = labelled_applications(tables, clock, summed_blocks(blocks), team)
    shown = blocks.select("application_id", "block", "nth", "display")
    df = df.join(shown, ["application_id", "block"], "left")
    df = df.withColumn("row_num", F.expr("CAST(coalesce(nth + earlier_loans, 1) AS int)"))
    return _report(with_display(df), clock)
