"""Pages as they arrive: a file stream, each micro-batch extracted, checked by the page rules and appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.extraction import extract_records
from ..operators.page_rules import page_findings

ARRIVALS = "page_id long, url string, html string"
TRIGGER = "2 seconds"


def page_stream(spark: SparkSession, folder: str, files_at_once: int = 16) -> DataFrame:
    return spark.readStream.schema(ARRIVALS).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def _subjects(records: DataFrame) -> DataFrame:
    return records.withColumn("id", F.lit(None).cast("long"))


def start_ingest(stream: DataFrame, root: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Records and findings under root. A batch is written to folders named by its id, over what an earlier attempt left there, so a
    batch that is run again replaces its own rows and no others."""

    def write(batch: DataFrame, batch_id: int) -> None:
        path = f"{root}/records/batch={batch_id}"
        extract_records(batch).write.mode("overwrite").parquet(path)
        records = batch.sparkSession.read.parquet(path)
        page_findings(_subjects(records)).drop("page_id").write.mode("overwrite").parquet(f"{root}/issues/batch={batch_id}")

    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=TRIGGER)).start()
