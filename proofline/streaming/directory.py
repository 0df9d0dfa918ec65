"""Documents as they arrive in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.segment import chunks
from ..functions.text import normalize_all, word_count
from ..operators.blocks import drop_blank, paragraphs


def arriving(spark: SparkSession, path: str, schema: str = "doc_id long, text string") -> DataFrame:
    """New Parquet files of documents under the folder ``path``, or of one that is a single file."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    source = spark.readStream.schema(schema)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory():
        return source.parquet(path)
    return source.option("pathGlobFilter", p.getName()).parquet(p.getParent().toString())


def normalised(docs: DataFrame, max_words: int = 256) -> DataFrame:
    """Paragraphs of arriving documents, normalised, with their sentences and words: no state is kept."""
    p = drop_blank(paragraphs(docs)).withColumn("text", normalize_all("text"))
    return p.withColumn("sentences", F.size(chunks("text", max_words))).withColumn("words", word_count("text"))


def run_available(docs: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Process what is there and stop; a later run goes on from the checkpoint, each file once."""
    return docs.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
