"""Sessions, and a runner that starts a failed task again on a fresh session."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable
from functools import wraps

from py4j.protocol import Py4JJavaError, Py4JNetworkError
from pyspark.sql import SparkSession

log = logging.getLogger(__name__)

#: Left to AQE: partition counts, skew and the choice of join follow the data.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def build_session(app: str = "pathloom", config: dict[str, str] | None = None, hive: bool = False) -> SparkSession:
    builder = SparkSession.builder.appName(app).config(map=DEFAULTS | (config or {}))
    return (builder.enableHiveSupport() if hive else builder).getOrCreate()


class ResilientRunner:
    """Run ``task(spark, ...)``; if Spark fails, rebuild the session and run it again.

    Failed jobs and lost connections count as failures of Spark.  Errors of the task
    itself (a wrong argument, a query that can't be analysed, a failing Python
    function) come out at once: they would fail again.
    """

    FAILURES = (Py4JJavaError, Py4JNetworkError, ConnectionError)

    def __init__(self, build: Callable[[], SparkSession] = build_session, max_restarts: int = 20, wait_s: float = 10.0):
        self.build, self.max_restarts, self.wait_s = build, max_restarts, wait_s
        self.restarts = 0

    def run(self, task: Callable, *args, **kwargs):
        while True:
            spark = self.build()
            try:
                return task(spark, *args, **kwargs)
            except self.FAILURES:
                self.restarts += 1
                if self.restarts > self.max_restarts:
                    raise
                log.exception("task failed, restart %d", self.restarts)
                spark.stop()
                time.sleep(self.wait_s)


def timed(f: Callable) -> Callable:
    """Log how long a call took (for lazy operators: the planning)."""

    @wraps(f)
    def run(*args, **kwargs):
        began = time.perf_counter()
        try:
            return f(*args, **kwargs)
        finally:
            log.info("%s took %.2f s", f.__name__, time.perf_counter() - began)

    return run
