"""Composed pipelines and the registered queries."""

from inkmill.plans import built, queries  # noqa: F401  (both register queries)
