"""Pick up result rows of newly finished runs, each file exactly once."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cumulo.sources.runs import RESULT_SCHEMA


def ingest_finished_runs(spark: SparkSession, source: str, target: str, checkpoint: str, schema: T.StructType = RESULT_SCHEMA):
    """Append JSON-line rows below ``source/seed_*`` to the partitioned results table.

    Files already taken are remembered in ``checkpoint``, so a repeated call only
    reads what is new and then stops. The seed in the path tags the rows.
    """
    rows = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").json(source)
    seed = F.regexp_extract(F.col("_metadata.file_path"), r"seed_(\d+)/", 1).try_cast("int")
    tagged = rows.select("*", seed.alias("_seed")).withColumn("model_seed", F.coalesce("_seed", "model_seed")).drop("_seed")
    query = tagged.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).partitionBy(
        "split", "method"
    ).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
