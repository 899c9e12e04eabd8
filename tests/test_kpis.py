"""Every rung of every classifier, on both grains."""

from __future__ import annotations

import datetime as dt

import pytest

from closeline.operators import kpis as k

from .conftest import AS_OF, at_noon, day, labels

D = dt.date
SHEET = "TermSheet::InitialTerms"
IN_TERMS = "initial_terms"


def loan(n, **columns):
    return {"id": 100 + n, "application_id": n, **columns}


def check(tables, clock, kpi, expected):
    assert labels(k.classify(tables, clock, kpi)) == expected
    assert labels(k.classify(tables, clock, kpi, "application")) == expected


def submitted(n, date, **columns):
    row = {"id": n, "state": IN_TERMS, "submitted_to_initial_underwriting_at": at_noon(date)}
    return {**row, **columns}


def review_case(lending, rows):
    """rows: id -> (state, review date, kickoff date, submission date, more)."""
    applications, stages, legal, channels = [], [], [], []
    for n, (state, reviewed, kickoff, submission, more) in rows.items():
        when = at_noon(submission) if submission else None
        applications.append(
            {"id": n, "state": state, "submitted_to_initial_underwriting_at": when, **more}
        )
        if reviewed:
            date = at_noon(reviewed)
            stages.append({"application_id": n, "preliminary_review_date": date})
        legal.append({"application_id": n, "kickoff_call_with_borrower_date": kickoff})
        channels.append({"application_id": n, "ops_channel": "Retail"})
    return lending(
        applications=applications,
        deal_stage_dates=stages,
        legal_closing_informations=legal,
        deal_product_channel=channels,
    )


REVIEW, UNDERWRITING = "preliminary_review", "initial_underwriting"


def test_welcome_call(lending, clock):
    tables = review_case(
        lending,
        {
            1: (REVIEW, AS_OF, None, None, {}),
            2: (REVIEW, day(-1), None, None, {}),
            3: (REVIEW, day(-2), None, None, {}),
            4: (REVIEW, day(-9), None, None, {}),
            5: (UNDERWRITING, None, None, AS_OF, {}),
            6: (UNDERWRITING, None, None, day(-1), {}),
            7: (UNDERWRITING, None, None, day(-2), {}),
            # Past due on the second day exactly.
            8: (UNDERWRITING, None, None, day(-3), {}),
            9: (REVIEW, AS_OF, AS_OF, None, {}),
            10: (REVIEW, AS_OF, None, None, {"rejected_at": at_noon(AS_OF)}),
            11: (UNDERWRITING, None, None, AS_OF, {"long_termed_at": at_noon(AS_OF)}),
            12: (IN_TERMS, None, None, AS_OF, {}),
            13: (REVIEW, None, None, None, {}),
        },
    )
    expected = {
        1: "Due Tomorrow", 2: "Due Today", 3: "Past Due", 4: "Past Due",
        5: "Due Tomorrow", 6: "Due Today", 7: "Past Due", 8: None, 13: None,
    }
    check(tables, clock(), k.WELCOME_CALL, expected)


def test_follow_up_calls(lending, clock):
    done = D(1998, 6, 1)
    rows = {n: (REVIEW, day(-n), done, None, {}) for n in range(1, 8)}
    rows[8] = (REVIEW, day(-3), None, None, {})
    rows[9] = (REVIEW, day(-3), done, AS_OF, {})
    rows[10] = (UNDERWRITING, day(-3), done, None, {})
    tables = review_case(lending, rows)
    first = {2: "Due Tomorrow", 3: "Due Today", 4: "Past Due"}
    second = {5: "Due Today", 6: "Past Due"}
    check(tables, clock(), k.FOLLOW_UP_CALL_1, {n: first.get(n) for n in range(1, 10)})
    check(tables, clock(), k.FOLLOW_UP_CALL_2, {n: second.get(n) for n in range(1, 10)})


CLOSINGS = {
    1: ("likely", day(2), "2 Business Days"),
    2: ("not_confirmed", day(1), "Next Business Day"),
    3: (None, AS_OF, "Today"),
    4: ("likely", D(1998, 6, 16), "Past Due"),
    5: (None, None, "No Settlement Date"),
    6: ("not_confirmed", D(1998, 6, 21), "Not Likely"),
    7: ("likely", D(1998, 6, 21), "Future"),
    8: ("confirmed", AS_OF, "Future"),
    9: ("confirmed", None, "Future"),
}


def closing_tables(lending):
    return lending(
        applications=[
            submitted(n, D(1998, 6, 1), closing_status=status)
            for n, (status, _, _) in CLOSINGS.items()
        ]
        + [
            submitted(10, D(1998, 6, 1)),
            # In preliminary_review, which the misspelt list keeps.
            submitted(11, D(1998, 6, 1), state=REVIEW),
            submitted(12, D(1998, 6, 1), state="closed"),
            {"id": 13, "state": IN_TERMS},
            submitted(14, D(1998, 6, 1), state=None),
        ],
        loans=[loan(n, settlement_date=date) for n, (_, date, _) in CLOSINGS.items()],
    )


def test_closing(lending, clock):
    expected = {n: label for n, (_, _, label) in CLOSINGS.items()}
    expected |= {10: "No Settlement Date", 11: "No Settlement Date"}
    check(closing_tables(lending), clock(), k.CLOSING, expected)


def test_closing_on_a_closed_day_knows_no_business_days(lending, clock):
    found = labels(k.classify(closing_tables(lending), clock(D(1998, 6, 20)), k.CLOSING))
    assert set(found.values()) == {"Past Due", "No Settlement Date", "Not Likely", "Future"}


def test_closing_takes_the_first_rung_of_any_loan(lending, clock):
    tables = lending(
        applications=[submitted(1, D(1998, 6, 1))],
        loans=[
            {"id": n, "application_id": 1, "settlement_date": date}
            for n, date in enumerate([D(1998, 8, 1), AS_OF, D(1998, 6, 1)])
        ],
    )
    rows = k.classify(tables, clock(), k.CLOSING).collect()
    assert sorted(r["closing_kpi"] for r in rows) == ["Future", "Past Due", "Today"]
    assert labels(k.classify(tables, clock(), k.CLOSING, "application")) == {1: "Today"}


NEAR, FAR = day(10), day(10) + dt.timedelta(days=1)

CONTACTS = {
    1: (day(-3), NEAR, "purchase", "Past Due"),
    2: (day(-9), AS_OF, "refinance", "Past Due"),
    3: (day(-2), NEAR, "purchase", "Due Today"),
    4: (day(-1), NEAR, "purchase", "Due Tomorrow"),
    5: (AS_OF, NEAR, "purchase", None),
    6: (day(-4), FAR, "purchase", "Past Due"),
    7: (day(-3), FAR, "refinance", "Due Today"),
    8: (day(-2), FAR, "purchase", "Due Tomorrow"),
    9: (day(-1), FAR, "purchase", None),
    10: (day(-6), None, "other", "Past Due"),
    11: (day(-5), None, "other", "Due Today"),
    12: (day(-4), None, None, "Due Tomorrow"),
    13: (day(-3), None, "purchase", None),
    14: (day(-9), NEAR, "other", None),
    15: (None, NEAR, "purchase", None),
}


def chased_tables(lending, sheet_date=D(1998, 6, 1)):
    numbers = list(CONTACTS)
    return lending(
        applications=[submitted(n, D(1998, 6, 1)) for n in numbers]
        + [
            submitted(20, D(1998, 6, 1), closing_status="confirmed"),
            submitted(21, D(1998, 6, 1), state=UNDERWRITING),
            submitted(22, D(1998, 6, 1)),
        ],
        term_sheets=[
            {"application_id": n, "created_at": at_noon(sheet_date), "type": SHEET}
            for n in [*numbers, 20, 21]
        ],
        loans=[
            loan(n, settlement_date=settles, transaction_purpose=purpose)
            for n, (_, settles, purpose, _) in CONTACTS.items()
        ],
        loan_follow_ups=[
            {"loan_id": 100 + n, "date": at_noon(date), "via": "text", "type": "borrower"}
            for n, (date, _, _, _) in CONTACTS.items()
            if date
        ],
    )


def test_borrower_follow_up(lending, clock):
    expected = {n: label for n, (_, _, _, label) in CONTACTS.items()}
    check(chased_tables(lending), clock(), k.BORROWER_FOLLOW_UP, expected)


def test_initial_terms(lending, clock):
    # (terms date, settlement, state, reviewed) -> label; the call comes a day
    # earlier when settling from today to the seventh business day.
    rows = {
        1: (day(-3), None, IN_TERMS, None, "Past Due"),
        2: (day(-2), None, IN_TERMS, None, "Due Today"),
        3: (day(-1), None, IN_TERMS, None, "Due Tomorrow"),
        4: (AS_OF, None, IN_TERMS, None, None),
        5: (day(-2), day(7), "final_terms", None, "Past Due"),
        6: (day(-1), AS_OF, "final_signed_term_sheet", None, "Due Today"),
        7: (AS_OF, day(7), IN_TERMS, None, "Due Tomorrow"),
        8: (day(-2), day(7) + dt.timedelta(days=1), IN_TERMS, None, "Due Today"),
        9: (day(-2), D(1998, 6, 16), IN_TERMS, None, "Due Today"),
        10: (day(-3), None, IN_TERMS, AS_OF, None),
        11: (day(-3), None, "pending_approval", None, None),
    }
    tables = lending(
        applications=[submitted(n, D(1998, 6, 1), state=r[2]) for n, r in rows.items()]
        + [submitted(20, D(1998, 6, 1)), submitted(21, D(1998, 6, 1))],
        term_sheets=[
            {"application_id": n, "created_at": at_noon(r[0]), "type": SHEET}
            for n, r in rows.items()
        ]
        + [{"application_id": n, "created_at": at_noon(AS_OF), "type": SHEET} for n in (20, 21)],
        loans=[
            loan(n, settlement_date=r[1], transaction_purpose="purchase")
            for n, r in rows.items()
        ]
        + [loan(20, transaction_purpose="other")],
        legal_closing_informations=[
            {"application_id": n, "term_sheet_reviewed_with_borrower_date": r[3]}
            for n, r in rows.items()
        ],
    )
    check(tables, clock(), k.INITIAL_TERMS, {n: r[4] for n, r in rows.items()})


def test_title_order_counts_hour_boundaries(lending, clock):
    yesterday = D(1998, 6, 16)
    at = dt.datetime.combine
    rows = {
        # 23 h 45 min, 24 boundaries.
        1: (at(yesterday, dt.time(12, 45)), None, None, "Outstanding"),
        2: (at(yesterday, dt.time(13, 0)), None, None, None),
        3: (at(yesterday, dt.time(12, 0)), AS_OF, None, None),
        4: (at(yesterday, dt.time(12, 0)), None, AS_OF, None),
    }
    tables = lending(
        applications=[
            {"id": n, "state": IN_TERMS, "submitted_to_initial_underwriting_at": r[0]}
            for n, r in rows.items()
        ]
        + [submitted(5, D(1998, 6, 1)), {"id": 6, "state": IN_TERMS}],
        legal_closing_informations=[
            {
                "application_id": n,
                "title_commitment_order_date": r[1],
                "title_commitment_most_recent_order_date": r[2],
            }
            for n, r in rows.items()
        ],
    )
    expected = {n: r[3] for n, r in rows.items()} | {5: "Outstanding"}
    check(tables, clock(), k.TITLE_ORDER, expected)


def test_title_order_confirmation(lending, clock):
    before, contact = D(1998, 6, 16), at_noon(D(1998, 6, 1))
    rows = {
        1: (before, None, "Outstanding"),
        2: (None, before, "Outstanding"),
        3: (AS_OF, None, None),
        4: (AS_OF, before, "Outstanding"),
        5: (None, None, None),
        6: (before, None, None),
        7: (before, None, "Outstanding"),
    }
    tables = lending(
        applications=[submitted(n, D(1998, 6, 1)) for n in rows],
        legal_closing_informations=[
            {
                "application_id": n,
                "title_commitment_order_date": r[0],
                "title_commitment_most_recent_order_date": r[1],
            }
            for n, r in rows.items()
        ],
        loans=[loan(n) for n in (1, 6, 7)],
        loan_follow_ups=[
            {"loan_id": 106, "date": contact, "via": "text", "type": "title"},
            # The undated one is the newest, so there is no date to go by.
            {"loan_id": 107, "date": contact, "via": "text", "type": "title"},
            {"loan_id": 107, "date": None, "via": "text", "type": "title"},
        ],
    )
    check(tables, clock(), k.TITLE_ORDER_CONFIRMATION, {n: r[2] for n, r in rows.items()})


def test_title_follow_up(lending, clock):
    soon, late = day(5), day(5) + dt.timedelta(days=1)
    rows = {
        1: (day(-6), late, None, "Past Due"),
        2: (day(-5), late, None, "Due Today"),
        3: (day(-4), None, None, "Due Tomorrow"),
        4: (day(-3), late, None, "Future"),
        5: (day(-2), soon, None, "Past Due"),
        6: (day(-1), soon, None, "Due Today"),
        7: (AS_OF, AS_OF, None, "Due Tomorrow"),
        8: (day(-6), late, AS_OF, "Future"),
        9: (day(-2), D(1998, 6, 16), None, "Future"),
        10: (None, soon, None, "Future"),
    }
    tables = lending(
        applications=[submitted(n, D(1998, 6, 1)) for n in [*rows, 20, 21]],
        term_sheets=[
            {"application_id": n, "created_at": at_noon(D(1998, 6, 1)), "type": SHEET}
            for n in [*rows, 20]
        ],
        loans=[loan(n, settlement_date=r[1]) for n, r in rows.items()],
        loan_follow_ups=[
            {"loan_id": 100 + n, "date": at_noon(r[0]), "via": "text", "type": "title"}
            for n, r in rows.items()
            if r[0]
        ],
        legal_closing_informations=[
            {"application_id": n, "preliminary_commitment_received_date": r[2]}
            for n, r in rows.items()
        ],
    )
    expected = {n: r[3] for n, r in rows.items()} | {20: "Future"}
    check(tables, clock(), k.TITLE_FOLLOW_UP, expected)


def around(limits, labels_, inclusive):
    """Submissions one day either side of each limit, and their labels."""
    rows, n = {}, 0
    for limit in limits:
        for shift in (-1, 0, 1):
            date = day(-limit) + dt.timedelta(days=shift)
            reached = [
                label
                for k_, label in zip(limits, labels_)
                if date < day(-k_) or (inclusive and date == day(-k_))
            ]
            n += 1
            rows[n] = (date, reached[0] if reached else None)
    return rows


def test_appraisal_missing(lending, clock):
    rows = around((20, 15, 9), (">20 days", ">15 days", ">9 days"), inclusive=True)
    old = day(-30)
    tables = lending(
        applications=[submitted(n, date) for n, (date, _) in rows.items()]
        + [
            # Without a closing status a portfolio passes, with one it does not.
            submitted(20, old, portfolio=True),
            submitted(21, old, portfolio=True, closing_status="likely"),
            submitted(22, old, portfolio=False, closing_status="likely"),
            submitted(23, old, portfolio=False, closing_status="confirmed"),
            submitted(24, old),
            submitted(25, old),
        ],
        loans=[loan(24), loan(25)],
        properties=[{"id": n, "loan_id": loan_id} for n, loan_id in ((1, 124), (2, 124), (3, 125))],
        property_valuations=[
            {"property_id": 1, "appraisal_approved_date": old},
            {"property_id": 2, "appraisal_approved_date": None},
            {"property_id": 3, "appraisal_approved_date": old},
        ],
    )
    found = k.classify(tables, clock(), k.APPRAISAL_MISSING).collect()
    of_24 = sorted(str(r["appraisal_kpi"]) for r in found if r["application_number"] == 24)
    assert of_24 == [">20 days", "None"]
    expected = {n: label for n, (_, label) in rows.items()}
    expected |= {20: ">20 days", 22: ">20 days", 24: ">20 days", 25: None}
    assert labels(k.classify(tables, clock(), k.APPRAISAL_MISSING, "application")) == expected


PROCESSING = [
    (k.PROCESSING_PORTFOLIO, (50, 35, 25), {"portfolio": True}, 2),
    (k.PROCESSING_NEW_CONSTRUCTION, (35, 30, 25), {"portfolio": False, "product_id": 3}, 1),
    (
        k.PROCESSING_RENTAL,
        (50, 35, 25),
        {"portfolio": False, "product_id": 2, "type": "Application::Rental"},
        1,
    ),
    (
        k.PROCESSING_BRIDGE,
        (30, 25, 20),
        {"portfolio": False, "product_id": 1, "type": "Application::Bridge"},
        1,
    ),
]


@pytest.mark.parametrize("kpi, limits, covered, properties", PROCESSING, ids=lambda v: "")
def test_processing_times(lending, clock, kpi, limits, covered, properties):
    rows = around(limits, [f">{n} Days" for n in limits], inclusive=False)
    old = day(-60)
    other = {"portfolio": False, "product_id": 9, "type": "Application::Other"}
    tables = lending(
        products=[
            {"id": 1, "name": "Bridge Loan"},
            {"id": 2, "name": "Rental Loan"},
            {"id": 3, "name": "New Construction"},
        ],
        applications=[submitted(n, date, **covered) for n, (date, _) in rows.items()]
        + [
            submitted(20, old, **other),
            submitted(21, old, **covered, closing_status="confirmed"),
            submitted(22, old, **(covered | {"portfolio": None})),
        ],
        loans=[loan(22, properties_count=properties)],
    )
    expected = {n: label for n, (_, label) in rows.items()}
    if kpi is not k.PROCESSING_BRIDGE:
        # Covered by the number of properties where the portfolio flag is unknown.
        expected[22] = f">{limits[0]} Days"
    check(tables, clock(), kpi, expected)


def test_cda(lending, clock):
    rental = {"type": "Application::Rental", "portfolio": False}
    valuations = {
        1: (day(-2), None, None, "Past Due"),
        2: (day(-1), None, None, None),
        3: (day(-2), AS_OF, None, None),
        4: (day(-2), None, AS_OF, None),
        5: (None, None, None, None),
    }
    tables = lending(
        applications=[submitted(n, D(1998, 6, 1), **rental) for n in [*valuations, 6]]
        + [
            submitted(7, D(1998, 6, 1), type="Application::Rental", portfolio=True),
            submitted(8, D(1998, 6, 1), type="Application::Bridge", portfolio=False),
            {"id": 9, **rental},
        ],
        loans=[loan(n) for n in valuations],
        properties=[{"id": n, "loan_id": 100 + n} for n in valuations],
        property_valuations=[
            {
                "property_id": n,
                "appraisal_received_date": v[0],
                "cda_order_date": v[1],
                "cda_received_date": v[2],
            }
            for n, v in valuations.items()
        ],
    )
    found = k.classify(tables, clock(), k.CDA)
    assert {(r["as_of"], r["application_number"], r["appraisal_received_date"], r["cda_kpi"])
            for r in found.collect()} == {
        (AS_OF, n, v[0], v[3]) for n, v in valuations.items()
    } | {(AS_OF, 6, None, None)}
    expected = {n: v[3] for n, v in valuations.items()} | {6: None}
    assert labels(k.classify(tables, clock(), k.CDA, "application")) == expected


def test_unknown_grain(lending, clock):
    with pytest.raises(ValueError):
        k.classify(lending(), clock(), k.CDA, "loan")
