"""Registered queries; importing the package fills the registry."""

from casemill.plans import knowledge, loads, measures, views  # noqa: F401
from casemill.plans.registry import CHECKS, QUERIES, SURVEY_IDS

__all__ = ["CHECKS", "QUERIES", "SURVEY_IDS"]
