"""Exact top-k search over binary codes by incremental multi-index hashing.

A vector's code is the sign of each dimension. Codes are cut into segments of about log2(codes) bits and indexed by
(segment, value). A search starts at radius 0 in every segment and grows: at radius r the values at
distance exactly r from the query's are probed, and candidates verified by full Hamming distance. If two codes are at most
segments * (r + 1) - 1 apart, some segment differs in r bits at most, so once the kth verified distance is within
that bound no other code can come before it, and the query is done. Each pair of codes is met once, in the round of its
nearest segment, and only if it can still enter the query's k best.

Equal codes collapse before the search, with their k smallest ids, so a vector held by a third of all rows is one
entry of the index; ties in distance go to the smaller id.

Nulls and edge cases: a row with a null vector or id neither searches nor is found; a null or NaN element, and one
missing from a shorter vector, counts as not positive. If fewer than k rows exist all are returned. Rows that
repeat an id count once. An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, read_table

K, MOST_BITS = 10, 16


def coded(rows: DataFrame) -> tuple[DataFrame, int]:
    """(id, bits) of ``rows(id, vector)``, bits a string of 0 and 1; and its length."""
    rows = rows.filter("id is not null and vector is not null")
    width = rows.agg(F.max(F.size("vector"))).first()[0] or 0
    bits = F.array_join(F.transform("vector", lambda x: F.when((x > 0) & ~F.isnan(x), "1").otherwise("0")), "")
    return rows.select(F.col("id").cast("long").alias("id"), F.rpad(bits, width, "0").alias("bits")), width


def top_k(rows: DataFrame, is_query: str, k: int = K) -> DataFrame:
    """(query_id, rank, neighbor_id, distance) for rows of ``rows(id, vector)`` where ``is_query``, against all rows."""
    spark = rows.sparkSession
    ids, width = coded(rows)
    ids = cut(ids.distinct(), "hamming-codes")
    few = ids.withColumn("r", F.row_number().over(Window.partitionBy("bits").orderBy("id"))).filter(F.col("r") <= k)
    codes = cut(few.groupBy("bits").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("code", F.col("ids")[0]), "hamming-distinct")
    n = codes.count()
    if not n or not width:
        return spark.createDataFrame([], "query_id long, rank int, neighbor_id long, distance int")
    each = max(4, min(MOST_BITS, n.bit_length() - 1))
    m = -(-width // each)
    each = -(-width // m)  # segments of one size: a short last one would be met by a large share of all codes
    value = [F.conv(F.substring("bits", a + 1, each), 2, 10).cast("int").alias(f"s{i}") for i, a in enumerate(range(0, width, each))]
    parts = [f"s{i}" for i in range(m)]
    by_segment = F.explode(F.array(*[F.struct(F.lit(i).alias("segment"), F.col(p).alias("value")) for i, p in enumerate(parts)])).alias("at")
    index = cut(codes.select("code", *value).select("code", *parts, by_segment).select("code", *parts, "at.segment", "at.value"), "hamming-index")
    asked = ids.filter(is_query).select(F.col("id").alias("query_id"), "bits").join(codes.select("bits", "code"), "bits")
    todo = asked.select(F.col("code").alias("query"), *value).distinct().withColumn("bound", F.lit(width))
    todo = cut(todo.select("query", "bound", *[F.col(p).alias(f"q_{p}") for p in parts]), "hamming-queries")
    apart = [F.bit_count(F.col(p).bitwiseXOR(F.col(f"q_{p}"))) for p in parts]
    best, done = None, []
    for radius in range(each + 1):
        masks = F.array(*[F.lit(sum(1 << b for b in c)) for c in combinations(range(each), radius)])
        at = F.explode(F.array(*[F.struct(F.lit(i).alias("segment"), F.col(f"q_{p}").alias("value")) for i, p in enumerate(parts)])).alias("at")
        probes = todo.select("*", at).select("*", F.explode(F.transform(masks, lambda x: F.col("at.value").bitwiseXOR(x))).alias("p_value")).withColumn("p_segment", F.col("at.segment")).drop("at")
        # each pair is met once: in the round of its nearest segment, through the first such segment
        first = F.lit(True)
        for i, d in enumerate(apart):
            first = first & (d >= F.when(F.col("segment") > i, radius + 1).otherwise(radius))
        found = probes.hint("merge").join(index, (F.col("p_segment") == F.col("segment")) & (F.col("p_value") == F.col("value")) & first & (sum(apart[1:], apart[0]) <= F.col("bound")))
        found = found.select("query", "code", sum(apart[1:], apart[0]).cast("int").alias("distance"))
        found = found if best is None else found.unionByName(best)
        order = Window.partitionBy("query").orderBy("distance", "code")
        best = cut(found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("rank"), "hamming-best")
        reach = m * (radius + 1) - 1
        so_far = best.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("far"))
        over = F.lit(True) if radius == each else (F.col("n") >= k) & (F.col("far") <= reach)
        sure = so_far.filter(over).select("query")
        done.append(best.join(sure, "query", "left_semi"))
        left = todo.join(so_far, "query", "left").filter(~F.coalesce(over, F.lit(False)))
        todo = cut(left.withColumn("bound", F.when(F.col("n") >= k, F.col("far")).otherwise(F.lit(width))).select(*todo.columns), "hamming-queries")
        best = best.join(sure, "query", "left_anti")
        if todo.isEmpty():
            break
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    ranked = every.join(codes.select("code", "ids"), "code").select("query", "distance", F.explode("ids").alias("neighbor_id"))
    nearest = Window.partitionBy("query").orderBy("distance", "neighbor_id")
    ranked = ranked.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k)
    return asked.join(ranked, asked["code"] == ranked["query"]).select("query_id", F.col("rank").cast("int").alias("rank"), "neighbor_id", "distance")


def op9_hamming_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return top_k(rows, "id % 50 = 0")


ORACLE = f"""
WITH c AS (SELECT vec_id, list_transform(embedding, lambda x: x > 0) AS b FROM embeddings),
d AS (SELECT q.vec_id AS query_id, c.vec_id AS neighbor_id,
             CAST(len(list_filter(list_zip(q.b, c.b), lambda p: p[1] <> p[2])) AS INTEGER) AS distance
      FROM c q, c WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS INTEGER) AS rank FROM d)
SELECT query_id, rank, neighbor_id, distance FROM r WHERE rank <= {K}
"""
