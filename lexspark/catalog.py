"""All queries of the library proper and the SQL that gives the same rows."""

from __future__ import annotations

from lexspark.plans import queries, round_trips  # noqa: F401

QUERIES, ORACLE_SQL, flagship = queries.Q, queries.SQL, queries.flagship
