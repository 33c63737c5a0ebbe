"""PII discovery and reversible pseudonymisation as Spark jobs."""

import sys

from pyspark import cloudpickle

# Helpers that run in Python workers travel with the task, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from velum.session import build_session, stage  # noqa: E402

__all__ = ["build_session", "stage"]
