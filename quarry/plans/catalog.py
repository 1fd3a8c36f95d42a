"""Import every plan module so the registry is complete."""

from quarry.plans import (  # noqa: F401
    eval_compare,
    eval_metrics,
    eval_stats,
    io_plans,
    eval_querylog,
    workload_aggs,
    workload_joins,
    workload_select,
    workload_time,
    workload_windows,
)
from quarry.plans.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
