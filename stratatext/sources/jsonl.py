"""JSON-lines scans with the three error policies, and record sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import text as T
from ..session import broadcast_if_small, stored

QUOTE_SCHEMA = (
    "quote_id string, edition_id string, type string, section_path array<string>, text string, "
    "char_span array<bigint>, start_line int, token_count int, sha256 string, quality_flags array<string>"
)
QUESTION_SCHEMA = (
    "id string, query string, query_type string, expected_edition string, expected_keywords array<string>, "
    "difficulty string, regression_checks array<struct<type:string,description:string,expected_first_year:int>>"
)
RESULT_SCHEMA = (
    "id string, query string, query_type string, passed boolean, judge_passed boolean, regression_passed boolean, "
    "scores map<string,double>, regression_failures array<string>"
)


def _schema(spark: SparkSession, ddl: str | StructType) -> StructType:
    if isinstance(ddl, StructType):
        return ddl
    return StructType.fromDDL(ddl)


def parse_lines(lines: DataFrame, schema: str | StructType, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows ``(line_num, value)`` to (records, errors); blank lines are ignored.

    Errors hold line_num, quote_id and a message: unreadable JSON or the list of
    missing required fields.
    """
    spark = lines.sparkSession
    base = _schema(spark, schema)
    full = StructType([*base.fields, StructField("_bad", StringType())])
    place = [c for c in ("file", "line_num") if c in lines.columns]
    rows = lines.filter(T.strip(F.col("value")) != "").select(
        *place, F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r")
    )
    missing = F.array_compact(F.array(*[F.when(F.col("r." + c).isNull(), F.lit(c)) for c in required]))
    tagged = rows.withColumn("missing", missing).withColumn("broken", F.col("r._bad").isNotNull())
    good = tagged.filter(~F.col("broken") & (F.size("missing") == 0)).select(*place, *[F.col(f"r.{f.name}").alias(f.name) for f in base.fields])
    id_field = F.coalesce(F.col("r." + required[0]), F.lit("")) if required else F.lit("")
    bad = tagged.filter(F.col("broken") | (F.size("missing") > 0)).select(
        *place, id_field.cast("string").alias("record_id"),
        F.when(F.col("broken"), F.lit("unreadable JSON")).otherwise(F.concat(F.lit("missing: "), F.array_join("missing", ","))).alias("message"),
    )
    return good, bad


def read_tolerant(spark: SparkSession, path: str, schema: str | StructType = QUOTE_SCHEMA, required: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Error-tolerant scan: (records, errors) with each line's file and 1-based number in it.

    A large file is read in blocks by several tasks: a first scan counts the lines of
    each block, and a block's lines are numbered from the sum over the blocks before it.
    Only those counts are written down; the lines themselves are read again, not copied.
    """
    # One relation for both scans, so that their tasks hold the same blocks.
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"), "value"
    )
    blocks = lines.groupBy("file", "_block").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = stored(blocks.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"), "blocks")
    lines = lines.join(broadcast_if_small(blocks), ["file", "_block"]).select("file", (F.col("_before") + F.col("_at") - F.col("_first") + 1).alias("line_num"), "value")
    return parse_lines(lines, schema, required or ["quote_id", "edition_id", "type", "text", "start_line", "char_span"])


def read_strict(spark: SparkSession, path: str, schema: str | StructType = QUOTE_SCHEMA) -> DataFrame:
    """Any unreadable line aborts the job."""
    return spark.read.schema(_schema(spark, schema)).option("mode", "FAILFAST").json(path)


def read_lenient(spark: SparkSession, path: str, schema: str | StructType, required: list[str], defaults: dict | None = None) -> DataFrame:
    """Unreadable lines and lines without a required field are skipped, defaults filled.

    A missing path gives an empty table.
    """
    st = _schema(spark, schema)
    if not _exists(spark, path):
        return spark.createDataFrame([], st)
    df = spark.read.schema(st).option("mode", "DROPMALFORMED").json(path)
    for c in required:
        df = df.filter(F.col(c).isNotNull())
    for c, value in (defaults or {}).items():
        df = df.withColumn(c, F.coalesce(c, value if isinstance(value, type(F.lit(1))) else F.lit(value)))
    return df


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    empty = F.array().cast("array<string>")
    return read_lenient(
        spark, path, QUESTION_SCHEMA, ["id", "query"],
        {"query_type": "unknown", "difficulty": "medium", "expected_keywords": empty,
         "regression_checks": F.array().cast("array<struct<type:string,description:string,expected_first_year:int>>")},
    )


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return read_lenient(
        spark, path, RESULT_SCHEMA, ["id"],
        {"query": "", "query_type": "unknown", "passed": False, "judge_passed": False, "regression_passed": True,
         "scores": F.create_map().cast("map<string,double>"), "regression_failures": F.array().cast("array<string>")},
    )


def _exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = jpath.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(jpath)
    return found is not None and len(found) > 0


def read_texts(spark: SparkSession, path: str, id_pattern: str | None = None) -> DataFrame:
    """Whole text files as a corpus ``(doc_id, text)``.

    The id is the file name, or what the first group of ``id_pattern`` finds in the
    file's path.
    """
    name = F.regexp_extract("_metadata.file_path", id_pattern, 1) if id_pattern else F.col("_metadata.file_name")
    return spark.read.text(path, wholetext=True).select(name.alias("doc_id"), F.col("value").alias("text"))


def write_records(df: DataFrame, path: str, partition_by: str | None = None, fmt: str = "json") -> None:
    """One record per line (or parquet rows), optionally one folder per edition.

    Rows of a hot edition stay in the tasks that hold them: partitioned writing
    does not gather an edition into one task.
    """
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.format(fmt).save(path)
