"""Sinks: recorded price points, merged snapshots, search results, normalized records, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallystone.functions.text import stable_id
from tallystone.operators.series import local_day

from .storage import stored


def first_of_key(batch: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in a batch: a batch is idempotent."""
    return batch.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_n = 1").drop("_n")


def new_points(batch: DataFrame, last: DataFrame, key: list[str]) -> DataFrame:
    """Rows of a batch worth recording: no last point, or another price, list price or local day. last: key, price, price_normal, ts."""
    old = last.select(*key, F.col("price").alias("_p"), F.col("price_normal").alias("_n"), local_day("ts").alias("_d"))
    x = batch.join(old, key, "left")
    same = F.col("price").eqNullSafe(F.col("_p")) & F.col("price_normal").eqNullSafe(F.col("_n")) & (local_day("ts") == F.col("_d"))
    return x.filter(F.col("_d").isNull() | ~same).drop("_p", "_n", "_d")


def merged_snapshot(old: DataFrame, batch: DataFrame, key: list[str], keep: list[str]) -> DataFrame:
    """The snapshot after a batch: new values win, but columns of ``keep`` are never emptied."""
    o, n = old.alias("o"), batch.alias("n")
    on = [F.col(f"o.{c}") == F.col(f"n.{c}") for c in key]
    out = o.join(n, on, "full_outer")
    new = F.col(f"n.{key[0]}").isNotNull()
    pick = lambda c: F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")) if c in keep or c in key else F.when(new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return out.select(*(pick(c).alias(c) for c in old.columns))


def write_classification(batch: DataFrame, last: DataFrame, key: list[str]) -> DataFrame:
    """key, price_updated, discount_updated of each row against the last one; null-aware, false on first sight."""
    old = last.select(*key, F.col("price").alias("_p"), F.col("price_normal").alias("_n"), F.lit(True).alias("_seen"))
    x = batch.join(old, key, "left")
    changed = lambda a, b: F.col("_seen").isNotNull() & ~F.col(a).eqNullSafe(F.col(b))
    return x.select(*key, changed("price", "_p").alias("price_updated"), changed("price_normal", "_n").alias("discount_updated"))


def search_results(groups: DataFrame) -> DataFrame:
    """Relations of a search from groups (search_id, group_index, offers array<struct<store, product_id>>): first place of each product, dense positions."""
    x = groups.select("search_id", "group_index", F.posexplode("offers").alias("offer_index", "o")).select("search_id", "group_index", "offer_index", "o.*")
    one = first_of_key(x, ["search_id", "store", "product_id"], ["group_index", "offer_index"])
    w = Window.partitionBy("search_id").orderBy("group_index", "offer_index")
    return one.withColumn("position", F.row_number().over(w) - 1)


def search_places(rows: DataFrame, within: list[str]) -> DataFrame:
    """search_results of flat rows (search_id, group_index, store, product_id), where a group's offers are in the order of ``within``, columns of the product.

    The first group of a product and its own columns tell its place, so no group is gathered.
    """
    # told apart by a sort, which can spill, as few rows are repeated; dealt apart first, so that no task holds two sorts
    one = first_of_key(rows.repartition("search_id", "store", "product_id"), ["search_id", "store", "product_id"], ["group_index"])
    w = Window.partitionBy("search_id").orderBy("group_index", *within)
    return one.withColumn("position", F.row_number().over(w) - 1)


def normalized(products: DataFrame) -> dict[str, DataFrame]:
    """catalog_products, sellers, offers, price_observations and shipping_quotes of wide product rows, ids by hashes of their keys. Rows are grouped by the keys, shorter than their hashes."""
    code = F.coalesce(F.col("compare_code").cast("string"), F.lit("")).alias("_code")
    pid = stable_id("prod", F.col("compare_code"))
    oid = stable_id("offer", F.col("store"), F.col("product_id"))
    sid = stable_id("seller", F.col("store"))
    return {
        "catalog_products": products.groupBy(code).agg(F.min("name").alias("name"), F.min("brand").alias("brand")).select(stable_id("prod", F.col("_code")).alias("canonical_id"), "name", "brand"),
        "sellers": products.select("store").distinct().select(sid.alias("seller_id"), "store"),
        "offers": products.select(oid.alias("offer_id"), pid.alias("canonical_id"), sid.alias("seller_id"), "price", "price_normal"),
        "price_observations": products.select(stable_id("obs", F.col("store"), F.col("product_id"), F.col("ts")).alias("observation_id"), oid.alias("offer_id"), "ts", "price", "price_normal"),
        "shipping_quotes": products.filter("shipping_cost is not null").select(oid.alias("offer_id"), "shipping_cost"),
    }


def export_csv(rows: DataFrame, path: str, columns: list[str]) -> None:
    """CSV files with a header, in order of the first column; one file a partition."""
    rows.select(*columns).orderBy(columns[0]).write.mode("overwrite").option("header", True).csv(path)


def export_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def renumbered(rows: DataFrame, order: list) -> DataFrame:
    """rows with n, 1 and up in this order: sorted by range and written once, numbered by partition offsets, so no task sees all rows."""
    x = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()))
    w = Window.partitionBy("_p").orderBy("_i")
    x = x.withColumn("_k", F.row_number().over(w))
    sizes = x.groupBy("_p").agg(F.count("*").alias("_c"))
    before = sizes.withColumn("_b", F.sum("_c").over(Window.orderBy("_p")) - F.col("_c")).select("_p", "_b")
    return x.join(before, "_p").withColumn("n", F.col("_b") + F.col("_k")).drop("_p", "_i", "_k", "_b")
