"""Columns the queries read, per lending table."""

from __future__ import annotations

SCHEMAS: dict[str, str] = {
    "applications": (
        "id long, state string, type string, closing_status string, "
        "rejection_status string, rejected_at timestamp_ntz, withdrawn_at timestamp_ntz, "
        "long_termed_at timestamp_ntz, portfolio boolean, product_id long, "
        "loan_officer_id long, project_coordinator_id long, "
        "submitted_to_initial_underwriting_at timestamp_ntz, created_at timestamp_ntz, "
        "in_conditions_review_from timestamp_ntz, requested_for_ctc timestamp_ntz"
    ),
    "loans": (
        "id long, application_id long, internal_id string, settlement_date date, "
        "total_amount decimal(18,2), appraisal_paid_at timestamp_ntz, "
        "transaction_purpose string, properties_count int"
    ),
    "contacts": "id long, first_name string, last_name string",
    "loan_closing_costs": "loan_id long",
    "loan_follow_ups": "loan_id long, date timestamp_ntz, via string, type string",
    "term_sheets": "application_id long, created_at timestamp_ntz, type string",
    "legal_closing_informations": (
        "application_id long, kickoff_call_with_borrower_date date, "
        "term_sheet_reviewed_with_borrower_date date, title_commitment_order_date date, "
        "title_commitment_most_recent_order_date date, "
        "preliminary_commitment_received_date date"
    ),
    "properties": "id long, loan_id long",
    "property_valuations": (
        "property_id long, appraisal_approved_date date, appraisal_received_date date, "
        "cda_order_date date, cda_received_date date"
    ),
    "products": "id long, name string",
    "holidays": "holiday_date date, name string",
    "bank_holidays": "holiday_date date, holiday_name string",
    "borrowers": "application_id long, contact_id long",
    "deal_stage_dates": "application_id long, preliminary_review_date timestamp_ntz",
    "deal_stage_time_stamps": "application_id long, preliminary_review_date timestamp_ntz",
    "deal_product_channel": "application_id long, internal_id string, ops_channel string",
    "team_assignments": "team_member_name string, team string",
    "projections": (
        "table_type string, application_id long, loan_officer_name string, "
        "total_amount decimal(18,2), state string, percent_close decimal(9,4), "
        "department string, product string, portfolio boolean, closing_status string, "
        "closing_status_date date, deal_stage_date date, dynamic_settlement_date date, "
        "median_days_to_close double, "
        "median_days_from_unconfirmed_to_confirmed_bridge double, "
        "median_days_from_unconfirmed_to_confirmed_rental double, "
        "median_days_to_close_after_final_terms_bridge double, "
        "median_days_to_close_after_final_terms_rental double"
    ),
    # Read whole, whatever its columns.
    "deal_stage_stats": "",
}


def columns_of(table: str) -> list[str]:
    return [field.split()[0] for field in SCHEMAS[table].split(", ") if field]
