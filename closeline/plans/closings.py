"""Short list queries: coordinator closings, appraisal payments, passthroughs."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from closeline.constants import CONFIRMED, COORDINATOR_TEAM, FUNDING_STATES
from closeline.functions.ladders import quoted
from closeline.functions.text import full_name
from closeline.operators.joins import left_join_hot_right

Tables = Mapping[str, DataFrame]


def named_contacts(tables: Tables) -> DataFrame:
    """(contact_id, contact_name); no name where a part of it is NULL."""
    return tables["contacts"].selectExpr(
        "id AS contact_id", f"{full_name('first_name', 'last_name')} AS contact_name"
    )


def on_team(contacts: DataFrame, tables: Tables, team: str, how: str = "inner") -> DataFrame:
    """Contacts whose display name is on the team, a row per membership if inner.

    People sharing a name all match, those without one never do.
    """
    members = tables["team_assignments"].filter(F.col("team") == team)
    return contacts.join(
        members.selectExpr("team_member_name AS contact_name"), "contact_name", how
    )


def coordinator_closings(tables: Tables, team: str = COORDINATOR_TEAM) -> DataFrame:
    """Confirmed loans in a funding state, for the coordinators of one team.

    Channel rows repeat a loan as often as they hold its number.
    """
    applications = (
        tables["applications"]
        .filter(f"state IN ({quoted(FUNDING_STATES)}) AND closing_status = '{CONFIRMED}'")
        .selectExpr("id AS application_id", "project_coordinator_id AS contact_id")
    )
    loans = tables["loans"].selectExpr(
        "application_id", "internal_id", "to_date(settlement_date) AS settlement_date"
    )
    coordinators = on_team(named_contacts(tables), tables, team)
    closings = loans.join(
        applications.join(coordinators, "contact_id"), "application_id"
    )
    # The numbers of one team's loans thin the channel rows of all.
    channels = tables["deal_product_channel"].select("internal_id")
    channels = channels.join(closings.select("internal_id"), "internal_id", "left_semi")
    listed = left_join_hot_right(closings, channels, "internal_id")
    return listed.selectExpr(
        "contact_name AS project_coordinator_name",
        "contact_id AS id",
        "settlement_date",
        "internal_id",
    )


def appraisal_payments(loans: DataFrame) -> DataFrame:
    """Loan number and the day its appraisal was paid."""
    return loans.selectExpr("internal_id", "to_date(appraisal_paid_at) AS paid_appraisal_date")


def stage_stats(tables: Tables) -> DataFrame:
    """All of the stage statistics table."""
    return tables["deal_stage_stats"]


def projections(tables: Tables) -> DataFrame:
    """All of the projections table, every row type."""
    return tables["projections"]
