"""Reading tables of any format, nested documents out of archives, and writing for people."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from functools import reduce

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: The CSV dialect of the feeds.
CSV = {"header": True, "sep": ",", "quote": '"', "escape": '"', "multiLine": True, "mode": "PERMISSIVE"}
SKIPPED = "README.json"


def read_csv(spark: SparkSession, path: str | list[str], schema: StructType | str | None = None, **options) -> DataFrame:
    reader = spark.read.options(**{**CSV, **options})
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def read_any(spark: SparkSession, paths: str | list[str], columns: list[str] | None = None, **csv) -> DataFrame:
    """One table of all paths, by column name; what a path lacks is null there."""
    one = lambda p: spark.read.parquet(p) if p.rstrip("/").endswith(".parquet") else read_csv(spark, p, **csv) if ".csv" in p or ".txt" in p else spark.read.json(p) if ".json" in p else spark.read.parquet(p)
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), map(one, [paths] if isinstance(paths, str) else paths))
    return df.select(*columns) if columns else df


def probe(spark: SparkSession, path: str, least: int = 10) -> tuple[bool, str]:
    """Whether a feed can be read: ok, UNREADABLE, MISPARSED (under ``least`` columns) or EMPTY."""
    try:
        df = read_any(spark, path)
        some = df.limit(1).count()
    except Exception as e:  # whatever the reader says is the answer
        return False, f"UNREADABLE: {str(e).splitlines()[0][:200]}"
    if len(df.columns) < least:
        return False, f"MISPARSED: {len(df.columns)} columns"
    return (True, "ok") if some else (False, "EMPTY")


def documents(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(doc_id, body, error) of every JSON document in zip archives, folders and files.

    doc_id is the file's name without its ending.  Archives are read by tasks, each its own; one
    that can't be read is a row with an error.
    """

    def table(rows):
        return pd.DataFrame(rows, columns=["doc_id", "body", "error"])

    def unpack(frames):
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                name = path.rsplit("/", 1)[-1]
                if not name.endswith(".zip"):
                    rows.append((name.removesuffix(".json"), content.decode("utf-8", "replace"), None))
                    continue
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        for x in sorted(z.namelist()):
                            last = x.rsplit("/", 1)[-1]
                            if last.endswith(".json") and last != SKIPPED:
                                rows.append((last.removesuffix(".json"), z.read(x).decode("utf-8", "replace"), None))
                                if len(rows) >= 256:
                                    yield table(rows)
                                    rows = []
                except zipfile.BadZipFile as e:
                    rows.append((name, None, f"{type(e).__name__}: {e}"))
            yield table(rows)

    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    wanted = found.where((F.col("path").endswith(".zip") | F.col("path").endswith(".json")) & ~F.col("path").endswith(f"/{SKIPPED}"))
    return wanted.select("path", "content").mapInPandas(unpack, "doc_id string, body string, error string")


def parsed(docs: DataFrame, schema: StructType | str) -> DataFrame:
    """documents() with doc, the parsed body; what isn't JSON gets an error instead."""
    doc = F.from_json("body", schema, {"mode": "PERMISSIVE"})
    broken = F.col("body").isNotNull() & F.try_parse_json("body").isNull()
    return docs.select("doc_id", doc.alias("doc"), F.when(broken, "this is no JSON").otherwise(F.col("error")).alias("error"))


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_review(df: DataFrame, path: str, files: int = 1) -> None:
    """A CSV for people to read, all rows of it; one file unless more are asked for."""
    df.coalesce(files).write.mode("overwrite").options(header=True, quote='"', escape='"').csv(path)


def prepared(spark: SparkSession, path: str, build) -> DataFrame:
    """The table at path; built and written first if it isn't there whole."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        build().write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)


def year_of_file(df: DataFrame) -> DataFrame:
    """df with year, the first four digits in the name of the file a row is from."""
    return df.withColumn("year", F.regexp_extract(F.element_at(F.split(F.input_file_name(), "/"), -1), r"(\d{4})", 1).try_cast("int"))


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """df, written as a table under spark.checkpoint.dir and read again, so that what reads it several times makes it once.

    Where that setting is unset, a local master gets a folder of its own; any other master is an error,
    since executors could not read what the driver's machine holds.
    """
    spark = df.sparkSession
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not there:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        there = tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(there)
    path = f"{there.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
