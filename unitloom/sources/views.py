"""The engine's tables as views over the tables at hand: units, functions, centroids, queries and lines."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scoring import KIND_WEIGHT
from ..functions.vectors import normalized

KINDS = (*KIND_WEIGHT, "bb")
TYPES = ("root", "internal", "leaf")

#: Literal lines for symbols that prose lacks: (function, line, text, address).
LINES = [
    ("fix_a", 0, "LABEL_1:", None), ("fix_a", 1, "x = 0x0001F + 0xFFu;", "10"), ("fix_a", 2, "if ( a ) {", "11"), ("fix_a", 3, "  };", None), ("fix_a", 4, "}", "12"),
    ("fix_a", 5, "y = *(_DWORD *)p + \"abcd\" + \"abc\";", "13"), ("fix_a", 6, "return sub_12(memcpy (a), fix_a(b), strlen2(57600LL));", "14"),
    ("fix_b", 0, "iffy = 4294967292 + 18446744073709551612 + 57600;", "20"), ("fix_b", 1, "", None), ("fix_b", 2, "LABEL_2:", None), ("fix_b", 3, "LABEL_3 :", None), ("fix_b", 4, "for ( i = 0xffff; ; ) break;", "21"),
    ("fix_b", 5, "z = \"a\\\"bcd\" * (QWORD *)q; w = 123456789012345678901234567890;", "22"), ("fix_b", 6, "while (1) continue;", "23"), ("fix_b", 7, "{", None),
]
#: Literal names, addresses and classifier answers.
NAMES = ["x86-gcc-9-O2-libz", "a-b-c-d-", "dnsmasq-8d729903c2", "plain", "", "p/q-0123456789"]
ADDRESSES = ["0x10", "10", "1f", "zz", "16", "0x9", "0xFF", " 12 "]
ANSWERS = ["reasoning ... ANSWER: HOST_MATCH", "ANSWER: I", "prose NO_MATCH then INLINE_MATCH", "", "answer: maybe", "ANSWER: NO_MATCH or HOST_MATCH", "nothing", "HOST_MATCH ANSWER: ", "ANSWER:\nI", "answer: \t\n host", "ANSWER:\n\nx INLINE_MATCH"]


class Views:
    """Lazy views of one directory of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def units(self) -> DataFrame:
        v = F.col("vec_id")
        kind = F.get(F.array(*map(F.lit, KINDS)), (v % len(KINDS)).cast("int"))
        return self.table("embeddings").select(
            F.floor(v / 5).cast("long").alias("func_id"), (v % 5).cast("int").alias("pos"), "vec_id", kind.alias("slice_kind"), (0.4 + (v % 12) / 10).alias("slice_quality"),
            F.when(v % 7 == 3, "secondary").otherwise("primary").alias("semantic_role"), ((v % 4) * 0.25).alias("generic_penalty"), F.transform("embedding", lambda x: x.cast("double")).alias("emb"),
        )

    def functions(self) -> DataFrame:
        f = F.col("func_id")
        addr = F.concat(F.lit("0x"), F.lower(F.hex(f * 16)))
        return self.units().select("func_id").distinct().select("func_id", F.concat(F.lit("bin"), f % 8).alias("binary_name"), addr.alias("func_addr"), F.concat(F.lit("f"), f % 90).alias("func_name"))

    def centroids(self) -> DataFrame:
        return self.units().where("vec_id % 16 = 0").select(F.floor(F.col("vec_id") / 16).cast("int").alias("bucket_id"), "emb")

    def globals(self) -> DataFrame:
        return mean_vectors(self.units(), ["func_id"])

    def query_rows(self) -> DataFrame:
        u = self.units()
        n = u.agg(F.max("vec_id") + 1).first()[0] or 1  # one number
        other = u.select(F.col("vec_id").alias("ov"), F.col("emb").alias("oemb"))
        q = u.where("func_id % 10 = 0").withColumn("ov", (F.col("vec_id") + 7) % n).join(other, "ov")
        mixed = F.zip_with("emb", "oemb", lambda a, b: 0.7 * a + 0.3 * b)
        return q.select((F.col("func_id") / 10).cast("long").alias("query_id"), F.col("pos").alias("r"), "slice_kind", "slice_quality", "semantic_role", "generic_penalty", mixed.alias("m")).withColumn("emb", normalized(F.col("m"))).drop("m")

    def queries(self) -> DataFrame:
        """query_id, gt_func, gt_type, gq: the ground truth is the function the rows came from."""
        g = mean_vectors(self.query_rows().withColumnRenamed("query_id", "func_id"), ["func_id"])
        return g.select(F.col("func_id").alias("query_id"), (F.col("func_id") * 10).alias("gt_func"), ((F.col("func_id") * 10) % 3).cast("int").alias("gt_type"), F.col("emb").alias("gq"))

    def lines(self) -> DataFrame:
        fixed = self.spark.createDataFrame(LINES, "func string, line_index int, line string, line_ea string")
        d = self.table("documents").select(F.col("doc_id").cast("string").alias("func"), F.posexplode(F.split("text", "\n", -1)).alias("line_index", "line"))
        return d.withColumn("line_ea", F.lit(None).cast("string")).unionByName(fixed)

    def texts(self, values: list[str], name: str) -> DataFrame:
        return self.spark.createDataFrame([(v,) for v in values], f"{name} string")


def mean_vectors(units: DataFrame, keys: list[str], weight: str | None = None) -> DataFrame:
    """Normalized mean vector per key, weighted if a column is named; where no weight is positive all vectors count alike.

    One partial vector per key and task is shuffled.
    """
    v = array_to_vector(F.col("emb").cast("array<double>"))
    plain = Summarizer.mean(v)
    if weight is None:
        return units.groupBy(*keys).agg(plain.alias("m")).select(*keys, normalized(vector_to_array("m")).alias("emb"))
    w = F.col(weight).cast("double")
    d = units.withColumn("_used", F.when(F.sum(w).over(Window.partitionBy(*keys)) > 0, w).otherwise(1.0))
    return d.groupBy(*keys).agg(Summarizer.mean(v, F.col("_used")).alias("m")).select(*keys, normalized(vector_to_array("m")).alias("emb"))


def bounded(df: DataFrame, rows: int) -> bool:
    """Whether a table has at most so many rows: a side is broadcast behind this check alone."""
    return df.limit(rows + 1).count() <= rows


def rank_over(order: list, partition: list[str]):
    return F.row_number().over(Window.partitionBy(*partition).orderBy(*order))
