"""cachescope: semantic-cache gateway analytics as Spark DataFrame operators.

Subpackages:
  functions  scalar column expressions (keys, previews, PII patterns, JSON text)
  sources    readers and parsers (tables, fixture views, chat requests, events)
  operators  DataFrame -> DataFrame operators (telemetry, vectors, cache, PII, ...)
  plans      composite flows, the query registry and the SQL cross-check
  streaming  Structured Streaming forms of the operators
"""

from .config import GatewayParams

__all__ = ["GatewayParams"]


def _pickle_by_value() -> None:
    """Ship this package's functions to Python workers inside the task closure,
    so executors need no copy of the package on their path."""
    import sys

    try:
        from pyspark import cloudpickle

        cloudpickle.register_pickle_by_value(sys.modules[__name__])
    except Exception:  # noqa: BLE001 - older cloudpickle: rely on the worker path
        pass


_pickle_by_value()
