"""Cutting lineage with files in the session's checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame

#: Bits of a size estimate that a later plan takes over.
ESTIMATE_BITS = 62


def durable(df: DataFrame) -> DataFrame:
    """df, checkpointed: spark.checkpoint.dir's folder; in local mode, where none is set, one of our own."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        path = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not path and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(path or tempfile.mkdtemp(prefix="pixelflow-"))
    out = _bounded(df.checkpoint())
    # the finished plans' garbage goes, and with their handles Spark's cleaner deletes shuffles and checkpoints
    context._jvm.System.gc()
    return out


def _bounded(df: DataFrame) -> DataFrame:
    """A checkpointed df without an absurd size estimate.

    A checkpoint keeps the estimate of the plan that it cuts. Joins multiply their sides' estimates, so along a chain of
    checkpoints the digits double again and again, until the driver's heap doesn't hold them.
    """
    plan = df._jdf.queryExecution().analyzed()
    try:
        if plan.stats().sizeInBytes().bit_length() <= ESTIMATE_BITS:
            return df
    except ValueError:  # the number has more digits than Python reads
        pass
    jvm = df.sparkSession.sparkContext._jvm
    none = jvm.scala.Option.empty()
    plain = jvm.org.apache.spark.sql.execution.LogicalRDD(plan.output(), plan.rdd(), plan.outputPartitioning(), plan.outputOrdering(), plan.isStreaming(), plan.stream(), df.sparkSession._jsparkSession, none, none)
    return DataFrame(jvm.org.apache.spark.sql.classic.Dataset.ofRows(df.sparkSession._jsparkSession, plain), df.sparkSession)
