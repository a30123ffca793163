"""Every query by name, and its SQL."""

from heliodor.queries import ORACLE_SQL, QUERIES, chunks, evaluation, plans, relational, reports, search, stored, strings, trajectories

__all__ = ["ORACLE_SQL", "QUERIES", "chunks", "evaluation", "plans", "relational", "reports", "search", "stored", "strings", "trajectories"]
