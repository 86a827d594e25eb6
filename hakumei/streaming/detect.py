"""Detection and masking of streams without state, since documents are independent; counts per window with state and a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import egress, mask
from ..plans.detector import Detector


def read_stream(spark: SparkSession, path: str, schema: str, kind: str = "parquet", files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(kind).load(path)


def redact_stream(
    source: DataFrame, doc_id: str, text: str, out: str, mapping: str, quarantine: str, checkpoint: str, detector: Detector | None = None
) -> StreamingQuery:
    """Writes masked texts, the mapping and blocked documents to three tables of files, exactly once per batch.

    A masked text that still contains an original goes to quarantine instead of out. Each
    batch overwrites its own folder, so a batch that is run again leaves no second copy.
    """
    redacted = (detector or Detector()).redact(source, text)

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("_f", mask.originals(F.col("mask_map"))).persist()
        to = lambda df, folder: df.write.mode("overwrite").parquet(f"{folder}/batch={number}")
        to(egress.clean(rows, "masked", "_f").select(doc_id, "masked"), out)
        to(mask.mapping_rows(rows, doc_id), mapping)
        to(egress.quarantined(rows, "masked", "_f").select(doc_id, "form", "preview"), quarantine)
        rows.unpersist()

    return redacted.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def span_counts(source: DataFrame, event_time: str, text: str, window: str = "1 hour", *, late: str, detector: Detector | None = None) -> DataFrame:
    """Counts of detected spans per label and window of event time.

    Rows later than `late` are dropped and not counted anywhere, so it has to be longer than any
    row of the source may be late; there is no default. The state grows with it.
    """
    rows = (detector or Detector()).detect(source.withWatermark(event_time, late), text)
    spans = rows.select(event_time, F.explode("spans").alias("s"))
    return spans.groupBy(F.window(event_time, window), F.col("s.label").alias("label")).count()
