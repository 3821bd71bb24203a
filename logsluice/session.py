"""Session settings that the operators rely on."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Runtime SQL settings. All of them may be set on a live session.
SETTINGS = {
    # Event times are compared and printed in UTC.
    "spark.sql.session.timeZone": "UTC",
    # A key repeated on a line keeps its last value.
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.variant.allowDuplicateKeys": "true",
    # Shuffle partition counts and skewed joins are settled from measured sizes.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # The JVM does not compile methods above this size. Wide projections are then generated in
    # pieces, which runs about twice as fast as one huge interpreted method.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings above to a session and return it."""
    for name, value in SETTINGS.items():
        if spark.conf.get(name, None) != value:
            spark.conf.set(name, value)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder named by the cluster; a scratch one only in local mode, as in tests."""
    known = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if known is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir: progress must outlive this driver")
        known = tempfile.mkdtemp(prefix="logsluice-checkpoint-")
        spark.sparkContext.setCheckpointDir(known)
    return known
