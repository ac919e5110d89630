"""All queries of the core, by name, and their SQL counterparts."""

from . import problems, reference

QUERIES = {**problems.QUERIES, **reference.QUERIES}
ORACLE = {**problems.ORACLE, **reference.ORACLE}
