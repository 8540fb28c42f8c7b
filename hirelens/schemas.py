"""The model tables and their columns."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame

SCHEMAS = {
    "ingestion_runs": "id long, source string, status string, started_at timestamp, completed_at timestamp, parameters string, error_message string",
    "companies": "id long, name string, normalized_name string, industry string, created_at timestamp, updated_at timestamp",
    "jobs": "id long, company_id long, title string, normalized_title string, role_family_id string, canonical_url string, location string, workplace_type string, description_text string, content_hash string, first_seen_at timestamp, last_seen_at timestamp, closed_at timestamp, raw_payload string",
    "source_listings": "id long, ingestion_run_id long, job_id long, source string, source_job_id string, canonical_url string, source_url string, source_company_name string, source_title string, location string, workplace_type string, description_text string, text_quality string, salary_min double, salary_max double, salary_currency string, salary_interval string, content_hash string, raw_payload string, first_seen_at timestamp, last_seen_at timestamp, source_updated_at timestamp",
    "skills": "id long, name string, normalized_name string, category string, source_taxonomy string, taxonomy_version string, source_updated_at timestamp",
    "skill_aliases": "id long, skill_id long, alias string, normalized_alias string, match_type string, case_sensitive boolean",
    "job_skills": "job_id long, skill_id long, extraction_method string, confidence double, matched_text string",
    "posting_observations": "id long, source_listing_id long, ingestion_run_id long, observed_at timestamp, is_active boolean, source_updated_at timestamp, content_hash string, raw_payload string",
    "duplicate_job_candidates": "job_id long, candidate_job_id long, match_type string, score double, reason string, status string, created_at timestamp",
    "duplicate_audit_logs": "job_id long, candidate_job_id long, action string, actor string, reason string, previous_status string, new_status string, payload string, created_at timestamp",
    "deleted_listings": "source_listing_id long, deleted_at timestamp, payload string",
}

#: One posting as every source's normaliser gives it.
POSTING = "source string, source_job_id string, company_name string, title string, canonical_url string, source_url string, location string, workplace_type string, description_text string, salary_min double, salary_max double, salary_currency string, salary_interval string, content_hash string, raw_payload string, text_quality string, source_updated_at timestamp"


@dataclass
class Tables:
    """The model tables that reports read."""

    companies: DataFrame
    jobs: DataFrame
    listings: DataFrame
    observations: DataFrame
    skills: DataFrame
    job_skills: DataFrame

    def with_(self, **changed: DataFrame) -> Tables:
        return replace(self, **changed)

    def names(self) -> list[str]:
        return [f.name for f in fields(self)]
