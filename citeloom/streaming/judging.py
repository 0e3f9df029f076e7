"""The resumable judging loop as a bounded stream: every record is kept, also neutral ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.operators.pools import TRIPLE


def judge_stream(spark: SparkSession, source: str, schema: str, records: str, checkpoint: str, judge: Callable[[DataFrame], DataFrame], files_per_batch: int = 10, max_cost: float | None = None):
    """Judge the triples that arrive as Parquet in `source`, appending records; rerunning resumes at the checkpoint.

    Triples with a finished record (of any label) aren't judged again; a batch is
    refused once the records' cost reaches max_cost.
    """

    def batch(df: DataFrame, batch_id: int) -> None:
        from pyspark.errors import AnalysisException

        try:
            done = spark.read.parquet(records)
            spent = done.agg(F.sum("cost_usd")).first()[0] or 0.0
            df = df.join(done.filter("label is not null").select(*TRIPLE), TRIPLE, "left_anti")
        except AnalysisException:  # no record yet
            spent = 0.0
        if max_cost is not None and spent >= max_cost:
            raise RuntimeError(f"cost cap reached: {spent}")
        judge(df.dropDuplicates(TRIPLE)).withColumn("batch", F.lit(batch_id)).write.mode("append").parquet(records)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
