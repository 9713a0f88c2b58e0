"""Loads every query module so that the registry is complete."""

from spanwise.plans import queries_episodes, queries_intervals, queries_poses, queries_reports, queries_scoring, queries_streams, queries_tables, queries_windows  # noqa: F401
from spanwise.plans.registry import QUERIES, SQL  # noqa: F401
