"""verdigris: Spark-native analytics for sustainability telemetry.

Every operator is a plain ``DataFrame -> DataFrame`` function built from
``pyspark.sql.functions`` so Catalyst can prune, push down and fuse it.
Nothing in the library reads the wall clock: callers pass ``as_of``.
"""

from verdigris.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
