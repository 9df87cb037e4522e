"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Runtime SQL settings the operators rely on. They can be set on a session that
# somebody else made; sizes (partitions, memory) belong to whoever starts it.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key even where the operator above would like to reuse
    # the join's partitioning: one extra shuffle is cheaper than one hot task.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Batches for Python are 10,000 rows else, which are many MB of whole texts: they stand in the
    # executor's and the worker's memory at once.
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def get_session(
    app_name: str = "firstdue",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Build a session; on a cluster leave ``master`` to spark-submit.

    ``shuffle_partitions`` is the number AQE starts from before it coalesces, so
    on a cluster err on the high side (about total shuffle bytes / 128 MB).
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in {**RUNTIME_CONF, **(extra or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one named in ``spark.checkpoint.dir``.

    Executors on other machines must see what is written, so a machine-local
    temporary folder is used only when the setting is absent in local mode.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="firstdue-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
