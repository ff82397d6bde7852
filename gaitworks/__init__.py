"""Training tables from recorded trajectories, and queries over cluster snapshots, on Spark."""

from gaitworks.spec import RolloutSpec

__all__ = ["RolloutSpec"]
