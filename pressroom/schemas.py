"""Table schemas as DDL. Empty text means NULL for optional fields; instants are TIMESTAMP in UTC."""

from __future__ import annotations

from .functions.dates import ARTICLE_TIME

FETCH_LOG = (
    "url string, hop int, status int, location string, content_type string, content_length bigint, body string, "
    "fetched_at timestamp"
)
DNS = "host string, ip string"
ROBOTS = "host string, status int, body string"
RESULT_PAGES = "search_id string, month int, offset int, status int, body string"

ARTICLE_COLUMNS = (
    "status", "source_url", "final_url", "canonical_url", "domain", "title", "author", "published_at", "modified_at",
    "publication_time", "modification_time", "source", "section", "description", "image_url", "content", "word_count",
    "content_hash", "robots_status", "fetched_at",
)
ARTICLE = (
    "status string, source_url string, final_url string, canonical_url string, domain string, title string, "
    f"author string, published_at string, modified_at string, publication_time {ARTICLE_TIME}, "
    f"modification_time {ARTICLE_TIME}, source string, section string, description string, image_url string, "
    "content string, word_count int, content_hash string, robots_status string, fetched_at timestamp"
)

COMMANDS = (
    "id string, type string, payload string, status string, lease_owner string, lease_until timestamp, attempts int, "
    "error_code string, error_detail string, created_at timestamp, started_at timestamp, finished_at timestamp"
)
JOBS = (
    "job_id string, command_id string, search_id string, status string, total int, error_code string, "
    "error_detail string, start_date date, end_date date, timezone string, created_at timestamp, started_at timestamp, "
    "finished_at timestamp"
)
JOB_ITEMS = (
    "job_id string, position int, url string, normalized_url string, domain string, status string, attempts int, "
    "lease_owner string, lease_until timestamp, error_code string, error_detail string, "
    f"article struct<{ARTICLE}>, date_status string, "
    "included boolean, date_basis string, started_at timestamp, finished_at timestamp"
)
HEARTBEATS = "worker_id string, heartbeat_at timestamp"
SEARCH_RUNS = (
    "search_id string, query string, status string, start_date date, end_date date, timezone string, max_articles int, "
    "max_pages int, month int, offset int, pending array<string>, fingerprints array<string>, pages int, skipped int, "
    "job_ids array<string>, warnings array<string>, last_command_id string, last_result "
    "struct<status:string,job_id:string,total:int,pages_fetched:int,skipped:int,urls:array<string>>, "
    "requests_attempted int, created_at timestamp, updated_at timestamp"
)
SEEN = "search_id string, url string"
