"""All registered queries."""

from . import change_plans, crawl_plans, extra_plans, page_plans, read_models, rule_more_plans, rule_plans, search_plans, site_plans, view_plans, whole_plans  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
