"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boxline.sources.session import new_path

FOLDS = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    Freezes values that a second evaluation could give anew (row ids, file
    order) and cuts the lineage; the files survive lost executors.
    """
    path = new_path(df.sparkSession, f"llm-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(key: Column) -> Column:
    """Remainder of the CRC-32 of an id's text; 0 is held out of every fit. Null ids count as 0."""
    return F.coalesce(F.crc32(key.cast("string")) % FOLDS, F.lit(0)).cast("int")


def text_of(column: Column) -> Column:
    """Text without nulls."""
    return F.coalesce(column.cast("string"), F.lit(""))


def row_key(doc_id: Column, text: Column) -> Column:
    """Rows with equal keys are interchangeable: same id and same text."""
    return F.struct(doc_id.cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"))


def document_columns(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{name}`") for name in docs.columns]


def with_types(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


def discard(df: DataFrame) -> None:
    """Remove the files of a frame made by ``stored`` that nothing reads any more."""
    spark = df.sparkSession
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def crc32_sql(text: str) -> str:
    """DuckDB expression for the unsigned CRC-32 of a short ASCII text."""
    bit = "if(b & 1 = 1, xor(b >> 1, 3988292384), b >> 1)"
    byte = f"list_reduce(range(8), lambda b, j: {bit}, xor(a, x))"
    return f"xor(4294967295, list_reduce(list_transform(string_split({text}, ''), lambda ch: ascii(ch)::BIGINT), lambda a, x: {byte}, 4294967295::BIGINT))"
