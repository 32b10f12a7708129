"""Explicit schemas; nothing is inferred on the way in."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

# Integer and list fields are read as text because the missing-value mark can sit in
# any of them; the cleaning job guards the type.
RAW_POSTING = """
    url string, title string, company string, experience string, location string, salary string,
    key_skills string, tech_in_description string, preferred_key_skills string, company_badges string,
    employment_type string, working_type string, role_category string, listed_role string,
    industry_type string, department string, posted_date string, posted_raw string, openings string,
    applicant_count string, applicant_count_qualifier string, company_rating string, company_reviews string,
    education string, description string, source_search string
"""

RAW_FIELDS = [line.split()[0] for line in RAW_POSTING.replace("\n", " ").split(",")]

POSTING_KEYS = "job_id long, fingerprint string, first_seen_date date, last_seen_date date, times_seen int, last_batch_id long"

CLEAN_POSTING = """
    fingerprint string, url string, title string, company string, description string, description_hash string,
    experience_min int, experience_max int, salary_min decimal(12,2), salary_max decimal(12,2),
    city_ids array<int>, unmapped_locations array<string>, working_type string, employment_type string,
    contract_type string, role_family string, seniority_level string, role_category string, listed_role string,
    industry_type string, department string, posted_date date, posted_raw string, openings int,
    applicant_count int, applicant_count_qualifier string, company_rating decimal(3,1), company_reviews int,
    company_badges array<string>, source_search string, certifications array<string>,
    skills array<string>, preferred_skills array<string>,
    qualifications array<struct<level:string,field_of_study:string>>,
    qualification_degrees array<struct<degree:string,level:string,specializations:array<string>>>
"""

POSTING = """
    job_id long, fingerprint string, url string, title string, company string,
    accepted_degree_ids array<int>, accepted_degree_specialization_ids array<int>,
    skill_ids array<int>, preferred_skill_ids array<int>, certifications array<string>,
    experience_min int, experience_max int, salary_min decimal(12,2), salary_max decimal(12,2),
    city_ids array<int>, unmapped_locations array<string>, working_type string, employment_type string,
    contract_type string, role_family string, seniority_level string, role_category_id int, listed_role string,
    department_id int, industry_type_id int, description string, description_hash string, posted_date date,
    posted_raw string, openings int, applicant_count int, applicant_count_qualifier string,
    company_rating decimal(3,1), company_reviews int, company_badges array<string>, source_search string,
    first_seen_date date, last_seen_date date, times_seen int, last_batch_id long
"""

QUALIFICATION = "job_id long, level string, field_of_study string"
SKILL = "skill_id int, skill_name string, category string"
CITY = "city_id int, city_name string, state string"
STATE = "state_id int, state_name string"
DEGREE = "degree_id int, degree_name string, level string"
SPECIALIZATION = "specialization_id int, specialization_name string"
DEGREE_SPECIALIZATION = "degree_specialization_id int, degree_id int, specialization_id int"
ROLE_CATEGORY = "role_category_id int, name string"
DEPARTMENT = "department_id int, name string"
INDUSTRY_TYPE = "industry_type_id int, name string"
BLOCKLIST = "skill string"
DAILY_COUNT = "snapshot_date date, skill string, posting_count long"
RUN = """
    run_id long, search_url string, started_at timestamp_ntz, finished_at timestamp_ntz, postings_found int,
    postings_scraped int, postings_written int, field_found_counts map<string,int>, storage_ok boolean,
    error_message string
"""


@dataclass
class Tables:
    """The model's tables. A query needs only those it reads."""

    postings: DataFrame | None = None
    skills: DataFrame | None = None
    cities: DataFrame | None = None
    states: DataFrame | None = None
    qualifications: DataFrame | None = None
    degrees: DataFrame | None = None
    specializations: DataFrame | None = None
    degree_specializations: DataFrame | None = None
    role_categories: DataFrame | None = None
    departments: DataFrame | None = None
    industry_types: DataFrame | None = None
    blocklist: DataFrame | None = None
    daily_counts: DataFrame | None = None
    runs: DataFrame | None = None
