"""Quality-control sample analytics expressed as Spark DataFrame jobs.

Layout: ``spec`` (fixed schema values), ``functions`` (column expressions),
``operators`` (DataFrame in, DataFrame out), ``sources`` (scans and sinks),
``streaming`` (Structured Streaming forms) and ``plans`` (registered queries).
"""

import sys

from pyspark import cloudpickle

from casemill.session import build_session, scratch_path

__all__ = ["build_session", "scratch_path"]

# The few Python helpers that run in tasks travel with them, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
