"""Ledgers as streams: validated lines in, each message stored once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.operators import delivery

OUTCOME = T.StructType(
    [T.StructField(n, t) for n, t in [
        ("outcome_id", T.LongType()), ("schema", T.StringType()), ("timestamp", T.StringType()), ("report_id", T.StringType()), ("evidence_id", T.StringType()),
        ("lane", T.StringType()), ("rank", T.IntegerType()), ("score", T.IntegerType()), ("verdict", T.StringType()), ("files_opened", T.IntegerType()),
        ("tool_calls", T.IntegerType()), ("review_ms", T.IntegerType()), ("batch_id", T.StringType()), ("received_at", T.TimestampType()),
    ]]
)
VERDICTS = ["confirmed", "refuted", "unknown", "skipped"]


def read_lines(spark: SparkSession, folder: str, schema: T.StructType = OUTCOME) -> DataFrame:
    """Stream of JSON lines with ``_corrupt_record`` for those that are no record."""
    wide = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    return spark.readStream.schema(wide).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(folder)


def valid(records: DataFrame) -> DataFrame:
    """Records that parse, carry a known verdict and no negative count."""
    counts = [F.coalesce(F.col(c), F.lit(0)) >= 0 for c in ("files_opened", "tool_calls", "review_ms")]
    keep = F.col("_corrupt_record").isNull() & F.col("verdict").isin(VERDICTS)
    for c in counts:
        keep = keep & c
    return records.filter(keep).drop("_corrupt_record")


def store_once(target: str, message: tuple = (["report_id", "evidence_id"], "timestamp", "outcome_id", "received_at")):
    """A ``foreachBatch`` function that appends the batch's new messages to a parquet table.

    A batch is written to a folder named by its number, replaced if it comes
    again, and probed against the keys of the batches before it, so a restart
    stores nothing twice. The keys have a table of their own beside the target,
    so stored rows are not read again. A target that can't be read raises; only
    one that isn't there is empty.
    """
    ids, timestamp = message[0], message[1]
    keys = f"{target.rstrip('/')}_keys"

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        columns = [*ids, timestamp]
        kinds = T.StructType([*[batch.schema[c] for c in columns], T.StructField("batch_no", T.LongType())])
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(keys)
        known = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        stored = spark.read.schema(kinds).parquet(keys).filter(F.col("batch_no") < number).drop("batch_no") if known else batch.select(*columns).limit(0)
        fresh = delivery.admit(stored, batch, *message)
        fresh.write.mode("overwrite").parquet(f"{target}/batch_no={number}")
        spark.read.schema(batch.schema).parquet(f"{target}/batch_no={number}").select(*columns).write.mode("overwrite").parquet(f"{keys}/batch_no={number}")

    return write


def windowed_outcomes(records: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Outcomes per verdict and arrival window; rows later than the watermark are left out of closed windows."""
    return records.withWatermark("received_at", late).groupBy(F.window("received_at", width), "verdict").agg(F.count(F.lit(1)).alias("outcomes"))
