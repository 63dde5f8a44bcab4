"""Plant-telemetry analytics on Spark.

Every operator is a plain ``DataFrame -> DataFrame`` function keyed by
``device_id``; ordered operators run on (device, time-bucket) windows so a
single hot device is spread over many tasks (see ``operators.ordered``).
"""

from hydrospark.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
