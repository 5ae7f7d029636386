from . import date_queries, fetch_queries, job_queries, page_queries, search_queries, source_queries, stream_queries, url_queries
from .catalog import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
