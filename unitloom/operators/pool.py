"""Pool selection, exclusions, repair and sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import address_number, case_name, family


def pick_order(*key: str):
    """A fixed pseudo-random order of rows by their key: the same on every engine and with any partitioning."""
    return F.md5(F.concat_ws("/", *key))


def capped(df: DataFrame, group: str, cap: int, *key: str) -> DataFrame:
    """At most cap rows of each group, by the fixed order (window group limits keep partial tops before the shuffle)."""
    w = Window.partitionBy(group).orderBy(pick_order(*key), *key)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= cap).drop("_n")


def sampled(df: DataFrame, n: int, *key: str) -> DataFrame:
    """n rows, uniform, by the fixed order: partial tops of each task, merged."""
    return df.orderBy(pick_order(*key), *key).limit(n)


def first_by_priority(df: DataFrame, keys: list[str], order: list, n: int = 1) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def long_enough(queries: DataFrame, inventory: DataFrame, min_lines: int = 8) -> DataFrame:
    """Queries but those whose truth has at most min_lines lines; a truth that the inventory lacks stays."""
    short = inventory.where(F.col("n_lines") <= min_lines).select(F.col("binary_name").alias("gt_binary"), F.col("func_addr").alias("gt_addr"))
    return queries.join(short, ["gt_binary", "gt_addr"], "left_anti").select(*queries.columns)


def exclusion_counts(parts: dict[str, DataFrame]) -> DataFrame:
    """One row: how many (binary_name, func_name) each rule excludes, all of them together, and each after the first alone, beyond those before it."""
    order = list(parts)
    tagged = None
    for i, name in enumerate(order):
        t = parts[name].select("binary_name", "func_name", F.lit(i).alias("rule"))
        tagged = t if tagged is None else tagged.unionByName(t)
    each = tagged.groupBy("binary_name", "func_name").agg(F.collect_set("rule").alias("rules"))
    has = lambda i: F.array_contains("rules", i)
    counts = [F.count_if(has(i)).alias(n) for i, n in enumerate(order)]
    return each.agg(*counts, F.count("*").alias("either"), *[F.count_if(F.array_min("rules") == i).alias(f"{n}_alone") for i, n in enumerate(order) if i])


def multi_target(queries: DataFrame) -> DataFrame:
    """(binary_name, func_name) of all targets of query functions that have more than one."""
    q = queries.where("func_name <> ''")
    many = q.groupBy("query_binary", "query_addr").agg(F.count_distinct("gt_binary", "gt_addr").alias("n")).where("n > 1")
    return q.join(many, ["query_binary", "query_addr"], "left_semi").select(F.col("gt_binary").alias("binary_name"), "func_name").distinct()


def siblings(truth: DataFrame, inventory: DataFrame) -> DataFrame:
    """(binary_name, func_name) of functions in a truth's family with the truth's name."""
    t = truth.where("func_name <> ''").select(family(F.col("binary_name")).alias("fam"), "func_name").distinct()
    return inventory.where("func_name <> ''").withColumn("fam", family(F.col("binary_name"))).join(t, ["fam", "func_name"], "left_semi").select("binary_name", "func_name").distinct()


def clones(truth: DataFrame, inventory: DataFrame) -> DataFrame:
    """(binary_name, func_name) to leave out of mirrored checkouts of one case: all but truths, or all but the first name."""
    e = inventory.where("func_name <> ''").withColumn("case", case_name(F.col("binary_name"))).where(F.col("case").isNotNull()).select("case", "binary_name", "func_name").distinct()
    t = truth.select("binary_name", "func_name").distinct().withColumn("gt", F.lit(True))
    w = Window.partitionBy("case", "func_name")
    e = e.join(t, ["binary_name", "func_name"], "left").withColumn("gt", F.coalesce("gt", F.lit(False)))
    e = e.withColumn("n", F.count("*").over(w)).withColumn("any", F.bool_or("gt").over(w)).withColumn("first", F.min("binary_name").over(w))
    return e.where((F.col("n") > 1) & F.when(F.col("any"), ~F.col("gt")).otherwise(F.col("binary_name") != F.col("first"))).select("binary_name", "func_name")


def select_pool(inventory: DataFrame, truth: DataFrame, excluded: DataFrame, size: int, min_lines: int = 8) -> DataFrame:
    """inventory rows in the pool, with is_gt: all truths, one filler of each binary without any, then passes over binaries by (pass, count, name)."""
    key = ["binary_name", "func_addr"]
    gt = inventory.join(truth.select(*key).distinct(), key, "left_semi").withColumn("is_gt", F.lit(True))
    fill = inventory.join(truth.select(*key).distinct(), key, "left_anti").where(F.col("n_lines") > min_lines).join(excluded.distinct(), ["binary_name", "func_name"], "left_anti")
    number = address_number(F.col("func_addr"))
    fill = fill.withColumn("k", F.row_number().over(Window.partitionBy("binary_name").orderBy(number.isNull(), number, "func_addr")))
    have = gt.groupBy("binary_name").agg(F.count("*").alias("c0"))
    fill = fill.join(have, "binary_name", "left").withColumn("c0", F.coalesce("c0", F.lit(0)))
    # the first filler of a binary without truths comes in a round of its own
    fill = fill.withColumn("turn", F.when(F.col("c0") == 0, F.col("k") - 1).otherwise(F.col("k"))).withColumn("c1", F.when(F.col("c0") == 0, 1).otherwise(F.col("c0")))
    room = size - gt.count()
    fill = fill.orderBy("turn", F.when(F.col("turn") == 0, 0).otherwise(F.col("c1")), "binary_name").limit(max(0, room))
    cols = inventory.columns
    return gt.select(*cols, "is_gt").unionByName(fill.select(*cols).withColumn("is_gt", F.lit(False)))


def dense_ids(functions: DataFrame) -> DataFrame:
    """func_id from 0 by (binary, address as a string, name), and the first place of each function's units."""
    order = ["binary_name", "func_addr", "func_name"]
    # ids by ranges: rows of earlier binaries, then the place within the binary, so that no task sees all rows
    per = functions.groupBy("binary_name").agg(F.count("*").alias("_c"), F.sum("n_units").alias("_u"))
    before = Window.orderBy("binary_name").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("binary_name", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_c0"), F.coalesce(F.sum("_u").over(before), F.lit(0)).alias("_u0"))
    w = Window.partitionBy("binary_name").orderBy(*order[1:])
    d = functions.join(per, "binary_name").withColumn("func_id", F.col("_c0") + F.row_number().over(w) - 1)
    return d.withColumn("first_unit", F.col("_u0") + F.coalesce(F.sum("n_units").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_c0", "_u0")


def patched(pool: DataFrame, cache: DataFrame, keys: list[str], column: str) -> DataFrame:
    """column replaced where the cache has a value; patched tells where."""
    c = cache.select(*keys, F.col(column).alias("_new"))
    return pool.join(c, keys, "left").withColumn("patched", F.col("_new").isNotNull()).withColumn(column, F.coalesce("_new", column)).drop("_new")


def substituted(broken: DataFrame, donors: DataFrame, wanted: DataFrame) -> DataFrame:
    """broken (key, func_name) with donor: of the same name if that name is wanted, else any; by the fixed order."""
    named = first_by_priority(broken.join(wanted, "func_name", "left_semi").join(donors.withColumnRenamed("key", "donor"), "func_name").withColumn("_o", pick_order("key", "donor")), ["key"], ["_o", "donor"]).select("key", "donor")
    # any donor: a fixed number of buckets spreads the keys, and the bucket's least donor serves
    buckets = donors.withColumn("b", F.pmod(F.conv(F.substring(F.md5("key"), 1, 8), 16, 10).cast("long"), F.lit(4))).groupBy("b").agg(F.min("key").alias("any_donor"))
    d = broken.join(named, "key", "left").withColumn("b", F.pmod(F.conv(F.substring(F.md5("key"), 1, 8), 16, 10).cast("long"), F.lit(4))).join(buckets, "b", "left")
    least = donors.agg(F.min("key")).first()[0]  # serves the buckets that have no donor
    return d.select("key", "func_name", F.coalesce("donor", "any_donor", F.lit(least)).alias("donor"))
