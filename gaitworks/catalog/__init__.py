"""The operators as queries over the given tables, each with its SQL where there is one."""

from gaitworks.catalog import documents, recordings, rollouts, snapshots
from gaitworks.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "documents", "recordings", "rollouts", "snapshots"]
