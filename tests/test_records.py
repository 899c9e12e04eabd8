"""Applications with several legal records, review dates and loans, at row grain."""

from __future__ import annotations

import datetime as dt
from collections import Counter, defaultdict

from closeline.constants import EXCLUDED_CHANNEL, PRELIMINARY_REVIEW
from closeline.operators import copies, extracts
from closeline.operators import kpis as k

from .conftest import at_noon, day

DONE = dt.date(1998, 6, 1)


def reviews(lending, cases, **more):
    """Applications in preliminary review with the (kickoffs, stage dates, time stamps) of each case."""

    def dated(dates):
        return [
            {"application_id": n, "preliminary_review_date": d and at_noon(d)}
            for n, found in enumerate(dates)
            for d in found
        ]

    legal, primary, stamps = zip(*cases)
    ids = range(len(cases))
    channels = ("Retail", "Retail", EXCLUDED_CHANNEL)
    return lending(
        applications=[{"id": n, "state": PRELIMINARY_REVIEW, **more} for n in ids],
        legal_closing_informations=[
            {"application_id": n, "kickoff_call_with_borrower_date": d}
            for n, found in enumerate(legal)
            for d in found
        ],
        deal_stage_dates=dated(primary),
        deal_stage_time_stamps=dated(stamps),
        deal_product_channel=[{"application_id": n, "ops_channel": c} for n in ids for c in channels],
    )


def labelled(tables, clock, kpi, grain="row"):
    """Labels by application, each as often as it stands."""
    found = defaultdict(Counter)
    for row in k.classify(tables, clock, kpi, grain).collect():
        found[row[0]][row[1]] += 1
    return dict(found)


def review_dates(primary, stamps):
    """Every primary row with every fallback, of which a row without a date makes one each."""
    undated = sum(d is None for d in primary) or (0 if primary else 1)
    fallbacks = [s for _ in range(undated) for s in (stamps or [None])] or [None]
    return [p or f for p in (primary or [None]) for f in fallbacks]


CASES = [
    ([], []),
    ([], [day(-2), day(-3)]),
    ([day(-4)], [day(-2)]),
    ([None], []),
    ([None, None], []),
    ([None, None, day(-4)], [day(-2), day(-2), None]),
    ([day(-4), day(-4), day(-5), None], [day(-6)]),
    ([day(-4), None], []),
]


def test_review_dates_are_the_product_of_the_stage_tables(lending):
    tables = reviews(lending, [((), *case) for case in CASES])
    found = defaultdict(Counter)
    for r in extracts.prelim_review_date(tables).collect():
        found[r.id][r.preliminary_review_date and r.preliminary_review_date.date()] += 1
    assert found == {n: Counter(review_dates(*case)) for n, case in enumerate(CASES)}


def test_review_dates_of_repeated_applications_and_ids_of_none(lending):
    """An application's rows each show all its dates; rows without an id show none."""
    dates = [[], [None], [day(-4), None, day(-4)]]
    ids = [0, 0, 1, 2, 2, 2, None, 7]
    tables = lending(
        applications=[{"id": n, "state": PRELIMINARY_REVIEW} for n in ids],
        deal_stage_dates=[
            {"application_id": n, "preliminary_review_date": d and at_noon(d)}
            for n, found in [*enumerate(dates), (None, [day(-4)]), (7, [None]), (8, [None])]
            for d in found
        ],
        deal_stage_time_stamps=[
            {"application_id": n, "preliminary_review_date": at_noon(day(-2))} for n in (1, 2, None)
        ],
        deal_product_channel=[
            {"application_id": n, "ops_channel": "Retail"} for n in (0, 1, 2, 2, None, 8)
        ],
    )
    found = Counter(
        (r.id, r.preliminary_review_date and r.preliminary_review_date.date())
        for r in extracts.prelim_review_date(tables).collect()
    )
    cases = {0: review_dates(dates[0], []), **{n: review_dates(dates[n], [day(-2)]) for n in (1, 2)}}
    assert found == Counter((n, d) for n in ids if n in cases for d in cases[n])


FIRST = {-2: "Due Tomorrow", -3: "Due Today", -4: "Past Due"}
SECOND = {-5: "Due Today", -6: "Past Due"}


def calls(legal, primary, stamps):
    """Labels of all rows of both calls, joined as they are."""
    met = [(kickoff, d) for kickoff in legal or [None] for d in review_dates(primary, stamps)]

    def label(ladder, kickoff, date):
        return next((x for n, x in ladder.items() if kickoff and date == day(n)), None)

    first = [label(FIRST, *pair) for pair in met]
    second = [
        "Due Tomorrow" if label({-4: 1}, *pair) and other != "Past Due" else label(SECOND, *pair)
        for pair in met
        for other in first
    ]
    return Counter(first), Counter(second)


def test_follow_up_calls_of_every_record(lending, clock):
    records = [[], [None], [DONE], [DONE, None], [DONE, DONE, None]]
    cases = [(legal, *case) for legal in records for case in CASES]
    tables = reviews(lending, cases)
    ladder = ["Due Tomorrow", "Due Today", "Past Due"]
    for which, kpi in enumerate((k.FOLLOW_UP_CALL_1, k.FOLLOW_UP_CALL_2)):
        want = {n: calls(*case)[which] for n, case in enumerate(cases)}
        assert labelled(tables, clock(), kpi) == want
        tops = {n: {next((x for x in ladder if x in rows), None): 1} for n, rows in want.items()}
        assert labelled(tables, clock(), kpi, "application") == tops


def test_second_call_is_due_tomorrow_where_records_differ(lending, clock):
    """The rung that one record alone never reaches."""
    case = ([DONE, None], [day(-4)], [])
    tables = reviews(lending, [case])
    assert labelled(tables, clock(), k.FOLLOW_UP_CALL_2) == {0: {"Due Tomorrow": 1, None: 3}}
    assert labelled(tables, clock(), k.FOLLOW_UP_CALL_2, "application") == {0: {"Due Tomorrow": 1}}
    submitted = reviews(lending, [case], submitted_to_initial_underwriting_at=at_noon(day(-1)))
    assert labelled(submitted, clock(), k.FOLLOW_UP_CALL_2) == {0: {None: 4}}


def test_welcome_call_of_records_without_a_kickoff(lending, clock):
    tables = reviews(lending, [([None, DONE, None], [day(0), day(-1), None], [day(-9)])])
    # The date of the time stamp stands once, those of the stage table once each.
    want = {"Due Tomorrow": 2, "Due Today": 2, "Past Due": 2}
    assert labelled(tables, clock(), k.WELCOME_CALL) == {0: want}


def hot(lending, n_legal, n_loans):
    return lending(
        applications=[
            {"id": 1, "state": "final_terms", "submitted_to_initial_underwriting_at": at_noon(DONE)}
        ],
        legal_closing_informations=[
            {"application_id": 1, "title_commitment_order_date": DONE if i % 3 else None}
            for i in range(n_legal)
        ],
        loans=[{"id": i, "application_id": 1} for i in range(n_loans)],
        loan_follow_ups=[
            {"loan_id": i, "type": "title", "date": at_noon(DONE)} for i in range(0, n_loans, 4)
        ],
    )


def test_records_and_loans_of_a_hot_application_never_meet(lending, clock, monkeypatch):
    """A row per pair of facts is joined; their numbers are multiplied and spelt out."""
    tables = hot(lending, 90, 80)
    found = labelled(tables, clock(), k.TITLE_ORDER_CONFIRMATION)
    assert found == {1: {"Outstanding": 60 * 60, None: 90 * 80 - 60 * 60}}
    monkeypatch.setattr(k, "spelt_out", lambda df, key: df)
    rows = k.classify(tables, clock(), k.TITLE_ORDER_CONFIRMATION).collect()
    assert len(rows) == 4 and sum(r[copies.COPIES] for r in rows) == 90 * 80
