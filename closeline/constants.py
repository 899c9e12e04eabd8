"""Fixed values.

Everything in this module is a value the results depend on: stored states,
labels, holiday names, day counts.  They are spelled as they occur in the data.
"""

from __future__ import annotations

from decimal import Decimal

# --- application states, in lifecycle order (fixed values) -----------------
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

# States a loan must be in to count in the closing calendar: everything from
# initial underwriting on.
CLOSING_CALENDAR_STATES = (
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

# States weighted at EARLY_STATE_WEIGHT in the forecast.
EARLY_WEIGHT_STATES = (
    "application",
    "lead",
    "incomplete_app",
    "quote",
    "preliminary_review",
    "initial_underwriting",
    "pending_approval",
)
EARLY_STATE_WEIGHT = Decimal("0.10")

# States too early to close near the end of the month.  Two more than above.
EARLY_GATE_STATES = (
    "application",
    "lead",
    "incomplete_app",
    "quote",
    "preliminary_review",
    "initial_underwriting",
    "pending_approval",
    "initial_terms",
    "initial_signed_term_sheet",
)

# States of the coordinator closings list.
FUNDING_STATES = (
    "clear_to_close",
    "funding_requested",
    "funding_reviewed",
    "funding_submitted",
    "funding_sent",
    "funding_authorized",
    "setup_servicing",
    "closed",
)

# States left out by most classifiers.  "prelminary_review" is spelled wrong in
# the rule itself, so applications in preliminary_review are *not* left out.
CLASSIFIER_EXCLUDED_STATES = (
    "application",
    "lead",
    "incomplete_app",
    "quote",
    "prelminary_review",
    "clear_to_close",
    "setup_servicing",
    "closed",
)
TERMS_EXCLUDED_STATES = CLASSIFIER_EXCLUDED_STATES + ("initial_underwriting",)

# States left out of the report; spelled right here.
REPORT_EXCLUDED_STATES = (
    "application",
    "lead",
    "incomplete_app",
    "quote",
    "preliminary_review",
    "issued",
    "setup_servicing",
    "closed",
)

# States in which an unreviewed term sheet is chased.
TERM_SHEET_STATES = (
    "initial_terms",
    "initial_signed_term_sheet",
    "final_terms",
    "final_signed_term_sheet",
)

PRELIMINARY_REVIEW = "preliminary_review"
INITIAL_UNDERWRITING = "initial_underwriting"

# --- other stored values (fixed values) ------------------------------------
CONFIRMED = "confirmed"
LIKELY = "likely"
NOT_CONFIRMED = "not_confirmed"

BRIDGE_TYPE = "Application::Bridge"
RENTAL_TYPE = "Application::Rental"
BRIDGE = "Bridge"
RENTAL = "Rental"
NEW_CONSTRUCTION = "New Construction"

INITIAL_TERMS_SHEET = "TermSheet::InitialTerms"
TITLE = "title"
BORROWER = "borrower"
TRACKED_PURPOSES = ("purchase", "refinance")

COORDINATOR_TEAM = "PC"
EXCLUDED_CHANNEL = "Private Client Group"

PROJECTION_ROWS = "dynamic projections"
FORECAST_DEPARTMENTS = ("retail", "tpo")
LONG_TERM_DAYS = 45
TITLE_ORDER_HOURS = 24

# --- business calendar (fixed values) --------------------------------------
HOLIDAY_NAMES = (
    "New Year's Day",
    "Martin Luther King Day",
    "Memorial Day",
    "Juneteenth National Independence Day",
    "Independence Day",
    "Labor Day",
    "Thanksgiving",
    "Day after Thanksgiving (Black Friday)",
    "Christmas Eve",
    "Christmas Day",
)
BANK_HOLIDAY_NAMES = ("Veterans Day", "Columbus Day")

CALENDAR_START = "2023-01-01"
CALENDAR_DAYS = 100_000
BACK_OFFSETS = (1, 2, 3, 4, 5, 6, 9, 15, 20, 25, 30, 35, 50)
AHEAD_OFFSETS = (1, 2, 5, 7, 10)

# --- labels (fixed values) -------------------------------------------------
PAST_DUE = "Past Due"
DUE_TODAY = "Due Today"
DUE_TOMORROW = "Due Tomorrow"
FUTURE = "Future"
OUTSTANDING = "Outstanding"
