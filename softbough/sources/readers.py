"""Inputs: Parquet, LibSVM, headerless CSV with the label last; rows from memory."""
from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_libsvm(spark: SparkSession, path: str, num_features: int) -> tuple[DataFrame, list[str]]:
    """(label, f0 .. fn-1) columns of a LibSVM file; absent entries are 0."""
    df = spark.read.format("libsvm").option("numFeatures", num_features).load(path)
    names = [f"f{i}" for i in range(num_features)]
    arr = vector_to_array("features")
    return df.select(F.col("label").cast("int").alias("label"), *(arr[i].alias(c) for i, c in enumerate(names))), names


def read_labelled_csv(spark: SparkSession, path: str, features: list[str], label: str = "label") -> DataFrame:
    """A headerless CSV with doubles and the label last."""
    schema = ", ".join(f"`{c}` double" for c in [*features, label])
    return spark.read.schema(schema).csv(path).withColumn(label, F.col(label).cast("int"))


def from_rows(spark: SparkSession, rows, features: list[str], label: str = "label") -> DataFrame:
    """rows of (label, features)."""
    schema = ", ".join([f"`{label}` int", *(f"`{c}` double" for c in features)])
    return spark.createDataFrame([(int(y), *map(float, x)) for y, x in rows], schema)


def split_by_hash(df: DataFrame, key: str, train_parts: int, parts: int) -> tuple[DataFrame, DataFrame]:
    """Deterministic train and test rows by a hash of a key column."""
    at = F.pmod(F.xxhash64(key), F.lit(parts))
    return df.where(at < train_parts), df.where(at >= train_parts)


def reservoir_sample(df: DataFrame, k: int, seed: int = 1, exclude: Column | None = None) -> DataFrame:
    """k rows at random, each equally likely; rows for which exclude is true are never chosen. A top-k, so no row is moved that is not among a partition's first k."""
    if exclude is not None:
        df = df.where(~F.coalesce(exclude, F.lit(False)))
    return df.withColumn("__r", F.rand(seed)).orderBy("__r").limit(k).drop("__r")
