"""The supplied tables read as an inventory: parts are master items, order lines purchases and adjustments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, sku, item_name, brand, category: a part type of ECONOMY stands for no category."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.concat_ws("-", "p_brand", F.col("p_partkey").cast("string")).alias("sku"),
        F.col("p_name").alias("item_name"),
        F.col("p_brand").alias("brand"),
        F.nullif(F.col("p_type"), F.lit("ECONOMY")).alias("category"),
        F.col("p_retailprice").alias("list_price"),
    )


def purchase_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).where(F.col("flag") == "N").drop("flag")


def adjustments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).where(F.col("flag") == "R").select("item_id", "quantity")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("purchase_id"),
        F.col("l_partkey").alias("item_id"),
        F.col("l_suppkey").alias("supplier_id"),
        F.col("l_linenumber").alias("line_no"),
        F.col("l_quantity").cast("decimal(14,2)").alias("quantity"),
        F.col("l_extendedprice").cast("decimal(14,2)").alias("amount"),
        F.col("l_returnflag").alias("flag"),
        F.col("l_shipdate").alias("day"),
    )
