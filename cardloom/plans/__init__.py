"""Query plans: the operators bound to tables, each with the SQL that checks it."""

from cardloom.plans import catalogue, changes, lookups, state, streams  # noqa: E402, F401
from cardloom.plans.registry import QUERIES, SQL  # noqa: E402, F401
