"""Result logs as streams: aggregates that follow a running experiment.

Runs append result files; the checkpoint remembers which files were read, so a
restarted follower continues where it stopped, like a resumed run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factloom import schemas as S


def follow_results(spark: SparkSession, path: str, *, files_per_batch: int = 100) -> DataFrame:
    """A stream of the result rows appended under ``path``."""
    return spark.readStream.schema(S.RESULTS).option("maxFilesPerTrigger", files_per_batch).json(path)


def running_counts(stream: DataFrame) -> DataFrame:
    """Examples and failures per variant and seed so far."""
    return stream.groupBy("variant", "seed").agg(
        F.count(F.lit(1)).alias("num_examples"), F.count_if("failed").alias("num_failed")
    )


def keep_up(counts: DataFrame, output: str, checkpoint: str) -> StreamingQuery:
    """Write the counts after every batch until the input is used up."""

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").json(output)

    return (
        counts.writeStream.outputMode("complete")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
