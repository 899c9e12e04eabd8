"""Latest-record and first-date extracts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from closeline.constants import (
    BORROWER,
    EXCLUDED_CHANNEL,
    INITIAL_TERMS_SHEET,
    PRELIMINARY_REVIEW,
    TITLE,
)
from closeline.operators.copies import COPIES, spelt_out
from closeline.operators.joins import left_join_hot_right

Tables = Mapping[str, DataFrame]


def _newest(kind: str) -> Column:
    # A follow-up without a date counts as the newest; equal dates are settled by
    # the greatest `via`.  `max` combines map-side, so a loan with very many
    # follow-ups reaches the shuffle as one row per map task.
    rank = F.struct(F.col("date").isNull().alias("undated"), "date", "via")
    return F.max(F.when(F.col("type") == kind, rank))


# Most values of `via` that have a newest date of their own in `latest_follow_ups`.
MOST_VIAS = 8


def via_values(follow_ups: DataFrame) -> list[str] | None:
    """All values of `via` in order, if there are at most `MOST_VIAS`; reads that column."""
    vias = follow_ups.select("via").filter("via IS NOT NULL").distinct()
    found = [r.via for r in vias.limit(MOST_VIAS + 1).collect()]
    return sorted(found, key=str.encode) if len(found) <= MOST_VIAS else None


def _newest_by_via(follow_ups: DataFrame, kinds: Mapping[str, str], vias: list[str]) -> DataFrame:
    """(loan_id, <kind>_date, <kind>_via, ...): what `_newest` gives, from a newest date per via.

    Dates and a bit per via for follow-ups without one have buffers of fixed width, so the
    aggregate hashes where one of a text sorts.
    """
    place = F.when(F.col("via").isNull(), 0)
    for i, via in enumerate(vias, 1):
        place = place.when(F.col("via") == via, i)
    place = place.otherwise(F.raise_error(F.lit("via is not in vias"))).cast("int")
    rows = follow_ups.select("loan_id", "type", "date", place.alias("place"))
    places = range(len(vias), -1, -1)
    aggregates = []
    for name, kind in kinds.items():
        ours = F.col("type") == kind
        bit = F.when(ours & F.col("date").isNull(), F.expr("shiftleft(1, place)"))
        aggregates.append(F.bit_or(bit).alias(f"{name}_undated"))
        for i in places:
            aggregates.append(F.max(F.when(ours & (F.col("place") == i), F.col("date"))).alias(f"{name}_{i}"))
    newest = rows.groupBy("loan_id").agg(*aggregates)
    shown = []
    for name in kinds:
        undated = F.col(f"{name}_undated")
        dates = [F.col(f"{name}_{i}") for i in places]
        last = F.greatest(*dates) if len(dates) > 1 else dates[0]
        via = F.when(F.lit(False), F.lit(""))
        for i in places:
            value = F.lit(vias[i - 1] if i else None)
            via = via.when(undated.bitwiseAND(F.lit(1 << i)) != 0, value)
        for i, date in zip(places, dates):
            value = F.lit(vias[i - 1] if i else None)
            via = via.when(date == last, value)
        shown += [F.when(undated.isNull(), last).alias(f"{name}_date"), via.alias(f"{name}_via")]
    return newest.select("loan_id", *shown)


def latest_follow_up(
    follow_ups: DataFrame, kind: str, vias: list[str] | None = None
) -> DataFrame:
    """Newest follow-up of one kind per loan: (loan_id, date, via, row_num).

    With `vias`, all values of `via` in order (`via_values`), it need not sort.
    """
    rows = follow_ups.filter(F.col("type") == kind)
    if vias is not None:
        newest = _newest_by_via(rows, {"newest": kind}, vias)
        columns = ("newest_date AS date", "newest_via AS via")
    else:
        newest = rows.groupBy("loan_id").agg(_newest(kind).alias("newest"))
        columns = ("newest.date", "newest.via")
    return newest.selectExpr("loan_id", *columns, "1 AS row_num")


def latest_follow_ups(follow_ups: DataFrame, vias: list[str] | None = None) -> DataFrame:
    """Newest title and borrower follow-up per loan, in one pass; `vias` as above."""
    rows = follow_ups.filter(F.col("type").isin(TITLE, BORROWER))
    if vias is not None:
        return _newest_by_via(rows, {"title": TITLE, "borrower": BORROWER}, vias)
    newest = rows.groupBy("loan_id").agg(
        _newest(TITLE).alias("title"), _newest(BORROWER).alias("borrower")
    )
    return newest.select(
        "loan_id",
        F.col("title.date").alias("title_date"),
        F.col("title.via").alias("title_via"),
        F.col("borrower.date").alias("borrower_date"),
        F.col("borrower.via").alias("borrower_via"),
    )


def newest_dates(follow_ups: DataFrame, kind: str) -> DataFrame:
    """Date of the newest follow-up of one kind per loan: (loan_id, date).

    Fixed-width buffers, so it is a hash aggregate where `latest_follow_up`, which
    also tells `via`, has to sort.
    """
    return (
        follow_ups.filter(F.col("type") == kind)
        .groupBy("loan_id")
        .agg(F.expr("IF(bool_or(date IS NULL), NULL, max(date)) AS date"))
    )


def first_term_sheets(term_sheets: DataFrame) -> DataFrame:
    """Earliest initial-terms date: (application_id, initial_terms_date)."""
    return (
        term_sheets.filter(F.col("type") == INITIAL_TERMS_SHEET)
        .groupBy("application_id")
        .agg(F.min(F.to_date("created_at")).alias("initial_terms_date"))
    )


def initial_terms_date(applications: DataFrame, term_sheets: DataFrame) -> DataFrame:
    """Earliest initial-terms date of known applications."""
    ids = applications.select(F.col("id").alias("application_id"))
    return (
        first_term_sheets(term_sheets)
        .join(ids, "application_id", "left_semi")
        .withColumnRenamed("application_id", "application_number")
    )


def _stage_dates(table: DataFrame) -> DataFrame:
    return table.selectExpr("application_id AS id", "preliminary_review_date")


def _open_reviews(applications: DataFrame) -> DataFrame:
    return applications.filter(
        f"state = '{PRELIMINARY_REVIEW}' "
        "AND coalesce(rejected_at, withdrawn_at, long_termed_at) IS NULL"
    ).select("id")


def _served(channels: DataFrame) -> DataFrame:
    return channels.filter(F.col("ops_channel") != EXCLUDED_CHANNEL).selectExpr(
        "application_id AS id"
    )


def served_reviews(tables: Tables) -> DataFrame:
    """Open preliminary-review applications outside one channel: (id).

    One channel row outside the excluded channel is enough; further rows of the
    same application do not repeat it.
    """
    served = _served(tables["deal_product_channel"])
    return _open_reviews(tables["applications"]).join(served, "id", "left_semi")


def prelim_review_primary(tables: Tables) -> DataFrame:
    """Open preliminary-review applications outside one channel, with their date."""
    dates = _stage_dates(tables["deal_stage_dates"])
    return left_join_hot_right(served_reviews(tables), dates, "id")


def prelim_review_fallback(tables: Tables) -> DataFrame:
    """Fallback stage date of the applications whose primary date is NULL."""
    # A review is looked up once per primary row without a date, or once without rows.
    primary = _stage_dates(tables["deal_stage_dates"]).groupBy("id").agg(
        F.expr("count_if(preliminary_review_date IS NULL) AS undated")
    )
    lookups = (
        served_reviews(tables)
        .join(primary, "id", "left")
        .filter("coalesce(undated, 1) > 0")
        .selectExpr("id", "explode(sequence(1L, coalesce(undated, 1L))) AS lookup")
        .select("id")
    )
    dates = _stage_dates(tables["deal_stage_time_stamps"])
    return left_join_hot_right(lookups, dates, "id")


REVIEW_TOTALS = {
    "_primary": "sum(IF(fallback, 0, n))",
    "_undated": "sum(IF(undated, n, 0))",
    "_stamps": "sum(IF(fallback, n, 0))",
}


def review_copies(groups: DataFrame) -> DataFrame:
    """How often a counted row of the stage tables stands among the review dates.

    `groups` counts, as `n`, rows of one application (`id`) that agree in all other
    columns, `fallback` and `undated` among them, and has `REVIEW_TOTALS` of the
    application.  Every primary row meets every fallback, of which there are as many as
    primary rows without a date times the rows of the fallback table, and shows it where
    it has no date itself.  A primary row without a date is left out where a fallback
    stands for it.
    """
    # An application without a primary row has one without a date.
    undated = "IF(_primary = 0, 1, _undated)"
    copies = f"""CASE
        WHEN fallback THEN {undated} * {undated} * n
        WHEN NOT undated THEN n * greatest({undated} * greatest(_stamps, 1), 1)
        WHEN _stamps = 0 THEN n * {undated}
        ELSE 0 END"""
    counted = groups.withColumn(COPIES, F.expr(copies)).filter(f"{COPIES} > 0")
    return counted.drop("n", *REVIEW_TOTALS)


def prelim_review_date(tables: Tables) -> DataFrame:
    """Primary date where there is one, else the fallback.

    Equal dates of an application are counted, their numbers multiplied where the stage
    tables meet, and spelt out at the end.

    The rows that meet an application are dealt out again before they are counted, so no
    task holds the sorts of the joins and the counts together, and the totals meet the
    counted rows without a second look at the tables.
    """
    opened = _open_reviews(tables["applications"]).groupBy("id")
    opened = opened.agg(F.count("*").alias("applications"))
    served = opened.join(_served(tables["deal_product_channel"]), "id", "left_semi")
    # An application without rows counts as one with a primary row without a date.
    rows = served.join(stage_rows(tables), "id", "left").selectExpr(
        "*", "NOT coalesce(fallback, false) AND preliminary_review_date IS NULL AS undated"
    )
    keys = ["id", "applications", "fallback", "undated", "preliminary_review_date"]
    groups = rows.fillna({"fallback": False}).repartition(*keys).groupBy(*keys)
    groups = groups.agg(F.count("*").alias("n"))
    totals = groups.groupBy("id").agg(*[F.expr(e).alias(c) for c, e in REVIEW_TOTALS.items()])
    dates = review_copies(groups.join(totals, "id"))
    copies = F.expr(f"{COPIES} * applications").alias(COPIES)
    return spelt_out(dates.select("id", "preliminary_review_date", copies), "id")


def stage_rows(tables: Tables) -> DataFrame:
    """Rows of both stage tables: (id, preliminary_review_date, fallback)."""
    primary = _stage_dates(tables["deal_stage_dates"]).withColumn("fallback", F.lit(False))
    stamps = _stage_dates(tables["deal_stage_time_stamps"]).withColumn("fallback", F.lit(True))
    return primary.unionByName(stamps)
