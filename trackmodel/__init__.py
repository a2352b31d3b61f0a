"""trackmodel: mapping-driven ingestion of tracking data into a common document model, on Spark.

Every operator takes and returns lazy DataFrames built from the public ``pyspark.sql`` API; the only
driver-side work is turning a small mapping document into Column expressions.
"""

from trackmodel.session import get_spark, shared_dir, scratch_path

__all__ = ["get_spark", "shared_dir", "scratch_path"]
