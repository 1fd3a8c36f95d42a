"""quarry: a PySpark-native analytics and result-evaluation library.

Half A (``quarry.operators`` relational helpers + ``quarry.plans.workload_*``)
covers the analytical query shapes: filters, joins, aggregates, windows,
arrays/maps, time-series recipes.  Half B (``quarry.operators.compare``,
``querylog``, ``metrics``, ``stats``, ``profile``) scores query results,
mines query/text logs and tests differences — all as DataFrame jobs.
"""

from quarry.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
