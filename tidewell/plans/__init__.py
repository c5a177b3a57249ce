"""The query catalogue."""

from tidewell.plans import extensions, flows, lifecycle, logs, metrics, promql, retrieval, scalars, state, store, streams, text, traces  # noqa: F401
from tidewell.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
