"""Relational basics over the star schema: the join, aggregate, window and set forms that the other operators are made of (N)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..registry import query


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_extendedprice), 2) AS avg_price, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def n01_pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.to_timestamp(F.lit("1998-09-02")))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.avg("l_extendedprice"), 2).alias("avg_price"), F.count(F.lit(1)).alias("n"))


@query("SELECT n_name, count(*) AS customers, count(o_orderkey) AS orders FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN orders ON c_custkey = o_custkey GROUP BY n_name")
def n02_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, o = (_t(spark, sf_dir, x) for x in ("customer", "nation", "orders"))
    return c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(o, c["c_custkey"] == o["o_custkey"], "left").groupBy("n_name").agg(F.count(F.lit(1)).alias("customers"), F.count("o_orderkey").alias("orders"))


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50)")
def n03_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, l = _t(spark, sf_dir, "part"), _t(spark, sf_dir, "lineitem").where("l_quantity = 50")
    return p.join(l, p["p_partkey"] == l["l_partkey"], "left_anti").select("p_partkey")


@query("SELECT s_suppkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 45)")
def n04_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, li = _t(spark, sf_dir, "supplier"), _t(spark, sf_dir, "lineitem")
    return s.join(li.where("l_quantity > 45"), s["s_suppkey"] == li["l_suppkey"], "left_semi").select("s_suppkey")


@query("SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INTEGER AS rank FROM orders) WHERE rank <= 3")
def n05_top_k_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return _t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("rank")).where("rank <= 3")


@query("SELECT event_type, count(DISTINCT user_id) AS users, round(median(value), 6) AS mid FROM events GROUP BY event_type")
def n06_distinct_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "events").groupBy("event_type").agg(F.countDistinct("user_id").alias("users"), F.round(F.percentile("value", 0.5), 6).alias("mid"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def n07_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))
