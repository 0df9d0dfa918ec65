"""Word lists, the correction cache, feedback and review files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.hybrid import vocabulary
from ..schemas import CACHE, FEEDBACK, REVIEW


def accepted_uploads(paths: DataFrame, column: str = "path") -> DataFrame:
    return paths.where(F.endswith(column, F.lit(".docx")))


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """syllable; fails if the list is missing: with marks alone nothing would ever be corrected."""
    return vocabulary(spark.read.text(path))


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """corrector, source, corrected; empty if there is none yet."""
    return spark.read.schema(CACHE).parquet(path) if exists(spark, path) else spark.createDataFrame([], CACHE)


def append_cache(rows: DataFrame, path: str) -> None:
    """New keys only; nothing that is there is written again. ``rows`` is a table of its own, not
    computed from the cache."""
    key = ["corrector", "source"]
    there = read_cache(rows.sparkSession, path)
    rows.dropDuplicates(key).join(there.select(*key), key, "left_anti").write.mode("append").parquet(path)


def import_cache(spark: SparkSession, path: str, corrector: str) -> DataFrame:
    """A cache kept as one JSON object of source to corrected text."""
    whole = spark.read.option("wholetext", True).text(path)
    pairs = whole.select(F.explode(F.from_json("value", "map<string,string>")).alias("source", "corrected"))
    return pairs.select(F.lit(corrector).alias("corrector"), "source", "corrected")


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FEEDBACK).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def append_feedback(rows: DataFrame, path: str) -> None:
    names = [c.split()[0] for c in FEEDBACK.split(", ")]
    rows.select(*names).write.mode("append").option("header", True).option("escape", '"').csv(path)


def read_review(spark: SparkSession, path: str) -> DataFrame:
    """Review records, written by line or as one array."""
    return spark.read.schema(REVIEW).option("multiLine", True).json(path)


def write_review(rows: DataFrame, path: str) -> None:
    rows.withColumn("timestamp", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")).write.mode("overwrite").json(path)


def last_lines(log: DataFrame, n: int = 200) -> DataFrame:
    """The last ``n`` of numbered lines (line_no, line), in order."""
    return log.orderBy(F.desc("line_no")).limit(n).orderBy("line_no")
