"""Domain views over the provided tables, and the same views in SQL.

A line of an order is a price observation: the part is the product, the
supplier's nation (modulo 5) the store, two neighbouring stores are one retailer
family, the order date is the moment and the discounted price the price.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystone.operators.series import is_last, marked

KEY = ["store", "product_id"]
#: Columns that order observations of a product in a store; rows alike in all of them are alike.
ORDER = ["ts", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "price"]
#: Evaluation time of all registered queries, after the last observation.
AS_OF = "2001-08-02 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df dealt to all tasks: a small file is one split, also where each of its rows takes long."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """store, family, product_id, ts, price, price_normal, price_basis and the order columns, one row an observation."""
    t = lambda name: table(spark, sf_dir, name)
    store = F.col("s_nationkey") % 5
    lines = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag")
    return (
        lines.join(t("orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            F.concat(F.lit("s"), store.cast("string")).alias("store"),
            F.concat(F.lit("f"), F.floor(store / 2).cast("string")).alias("family"),
            F.col("l_partkey").alias("product_id"),
            F.col("o_orderdate").cast("timestamp").alias("ts"),
            F.round(F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("long").alias("price"),
            F.round("l_extendedprice").cast("long").alias("price_normal"),
            F.when((F.col("l_returnflag") == "A") & (F.col("l_partkey") % 7 == 0), F.lit("all_payment")).alias("price_basis"),
            "l_orderkey",
            "l_linenumber",
            "l_suppkey",
            "l_quantity",
            "l_extendedprice",
        )
    )


OBS = """obs AS MATERIALIZED (
  SELECT 's' || (s_nationkey % 5) AS store, 'f' || ((s_nationkey % 5) // 2) AS family, l_partkey AS product_id, o_orderdate AS ts,
    round(l_extendedprice * (1 - l_discount))::BIGINT AS price, round(l_extendedprice)::BIGINT AS price_normal,
    CASE WHEN l_returnflag = 'A' AND l_partkey % 7 = 0 THEN 'all_payment' END AS price_basis,
    l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey)"""
ORD = "ts, l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice, price"
#: The basis rule, without null and zero prices.
SER = f"""{OBS}, flagged AS (SELECT *, max(CASE WHEN price_basis = 'all_payment' THEN 1 ELSE 0 END) OVER (PARTITION BY store, product_id) AS only_all FROM obs),
ser AS MATERIALIZED (SELECT * FROM flagged WHERE price > 0 AND (only_all = 0 OR price_basis = 'all_payment'))"""
DAY = "timezone('America/Santiago', timezone('UTC', ts))::DATE"
NOW = f"TIMESTAMP '{AS_OF}'"
WIN = f"WINDOW w AS (PARTITION BY store, product_id ORDER BY {ORD})"


def of_parts(spark: SparkSession, sf_dir: str, latest: DataFrame, *more: str) -> DataFrame:
    """Observations as offers, with part data and derived columns, and further columns of theirs."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("category"), F.col("p_size").alias("size"))
    return latest.join(part, "product_id").select(
        *KEY, "family", "name", "brand", "category", "size", "ts", "price", "price_normal",
        F.when(F.col("product_id") % 11 == 0, F.lit(0)).otherwise(F.col("l_quantity").cast("long")).alias("stock"),
        (F.col("product_id") % 4 * 500).cast("long").alias("shipping_cost"),
        F.when(F.col("l_suppkey") % 9 == 0, F.col("price")).alias("price_card"),
        F.when(F.col("l_suppkey") % 9 != 0, F.col("price")).alias("price_all_payment"),
        *more,
    )


def marked_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All observations, with _kept on those of the series of prices."""
    return marked(observations(spark, sf_dir), KEY, ORDER)


def last_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest observation of each product in each store."""
    return observations(spark, sf_dir).withColumn("_last", is_last(KEY, ORDER)).filter("_last").drop("_last")


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest observation of each product in each store, with part data and derived columns."""
    return of_parts(spark, sf_dir, last_observations(spark, sf_dir))


OFF = f"""{OBS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY store, product_id ORDER BY ts DESC, l_orderkey DESC, l_linenumber DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC, price DESC) AS n FROM obs),
off AS MATERIALIZED (
  SELECT store, product_id, family, p_name AS name, p_brand AS brand, p_type AS category, p_size AS size, ts, price, price_normal,
    CASE WHEN product_id % 11 = 0 THEN 0 ELSE l_quantity::BIGINT END AS stock, (product_id % 4 * 500)::BIGINT AS shipping_cost,
    CASE WHEN l_suppkey % 9 = 0 THEN price END AS price_card, CASE WHEN l_suppkey % 9 <> 0 THEN price END AS price_all_payment
  FROM ranked JOIN part ON p_partkey = product_id WHERE n = 1)"""
