"""The registered queries: operators bound to the given tables, with their check SQL."""

from vouch.workload import life, places, score, snapshots, text  # noqa: F401
from vouch.workload.views import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
