"""All queries by name, and the SQL that gives the same rows in DuckDB."""

from wardspan.plans import activity, alerting, connectors, evaluation, history, ingesting, people, routes, scores, streams, texts  # noqa: F401
from wardspan.plans.named import ORACLES, QUERIES  # noqa: F401
