"""All registered queries of the library; importing the modules below registers them."""

from curbside.plans import analytics, intake, jobs, relational, scalars  # noqa: F401
from curbside.plans.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
