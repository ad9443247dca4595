"""All named queries, and SQL for those that SQL can express."""

from timberline.plans import parts, queries  # noqa: F401  (parts adds its own to queries')

QUERIES, SQL = queries.QUERIES, queries.SQL
