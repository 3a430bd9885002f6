"""Exact top-k search over binary codes by incremental multi-index hashing.

A code is cut into segments; a search looks up the segments of the query within a radius that grows
step by step. After radius r in the first j of m segments and r - 1 in the others, every code within
distance m * r + j - 1 has been met, so a query is done once its kth verified distance is covered.
All in DataFrame functions.

Contract for odd input: rows with a null id or null vector are neither indexed nor searched; a null or
NaN component counts as not positive; rows that repeat an id with the same vector count once; equal
distances are ordered by id; with fewer than k other rows all of them are returned; vectors of other lengths than
the code are folded onto it, component i onto bit i mod bits; an empty table gives no rows.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asnwatch.llm.common import checkpointed

BITS = 64
K = 10
#: Up to this radius all segments are searched in one step, beyond it one by one.
WHOLE_STEPS = 2


def sign_code(vector: Column, bits: int = BITS) -> Column:
    """Bit i is set if the sum of the components i, i + bits, ... is positive; one component each for vectors of that length."""
    real = lambda x: F.coalesce(F.nanvl(x.cast("double"), F.lit(0.0)), F.lit(0.0))
    number = F.transform(vector, lambda x, i: F.struct((i % bits).alias("bit"), real(x).alias("x")))
    sums = F.transform(
        F.sequence(F.lit(0), F.lit(bits - 1)),
        lambda i: F.aggregate(F.filter(number, lambda c: c["bit"] == i), F.lit(0.0), lambda total, c: total + c["x"]),
    )
    signs = F.transform(F.when(F.size(vector) == bits, F.transform(vector, real)).otherwise(sums), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(signs, F.lit(0).cast("long"), lambda code, bit: code.bitwiseOR(bit))


def segments(n_codes: int, bits: int = BITS) -> list[tuple[int, int]]:
    """(lowest bit, width) of each segment: about log2 of the number of codes wide, so that buckets hold a few codes."""
    m = max(1, min(bits, math.ceil(bits / max(math.log2(max(n_codes, 2)), 4))))
    cuts = [bits * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _value(code: str, segment: tuple[int, int]) -> Column:
    low, width = segment
    return F.shiftrightunsigned(F.col(code), low).bitwiseAND(F.lit((1 << width) - 1))


def _masks(width: int, radius: int) -> Column:
    """All numbers of ``width`` bits with ``radius`` bits set, as one constant array."""
    numbers = (sum(1 << i for i in places) for places in combinations(range(width), radius))
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<long>")


def _probed(codes: DataFrame, parts: list[tuple[int, tuple[int, int]]], radius: int, code: str) -> DataFrame:
    """Rows of ``codes`` once for each value within exactly ``radius`` of each of the segments ``parts``."""
    def near(number: int, part: tuple[int, int]) -> Column:
        value = _value(code, part)
        return F.transform(_masks(part[1], radius), lambda mask: F.struct(F.lit(number).alias("segment"), value.bitwiseXOR(mask).alias("value")))

    each = F.flatten(F.array(*[near(number, part) for number, part in parts if radius <= part[1]]))
    return codes.select("*", F.explode(each).alias("at")).select("*", "at.segment", "at.value").drop("at")


def _kth(found: DataFrame, k: int, bits: int) -> DataFrame:
    """For each query code, the distance within which k + 1 rows (its own among them) have been met."""
    running = Window.partitionBy("query_code").orderBy("dist").rangeBetween(Window.unboundedPreceding, 0)
    per_distance = found.groupBy("query_code", "dist").agg(F.sum("n").alias("n"))
    met = per_distance.withColumn("met", F.sum("n").over(running)).filter(F.col("met") > k)
    return met.groupBy("query_code").agg(F.min("dist").alias("bound"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, id_column: str = "vec_id", vector_column: str = "embedding", bits: int = BITS) -> DataFrame:
    """The k nearest rows of ``vectors`` by Hamming distance of sign codes for each row of ``queries``
    (same columns), the row itself left out: query_id, rank from 1, neighbour_id, distance.

    Equal codes are one index entry that keeps its k + 1 smallest ids, which is all that a result can need."""

    def coded(df: DataFrame) -> DataFrame:
        rows = df.filter(F.col(id_column).isNotNull() & F.col(vector_column).isNotNull())
        return rows.select(F.col(id_column).alias("id"), sign_code(F.col(vector_column), bits).alias("code")).distinct()

    smallest = Window.partitionBy("code").orderBy("id")
    members = checkpointed(coded(vectors).withColumn("place", F.row_number().over(smallest)).filter(F.col("place") <= k + 1).drop("place"))
    codes = checkpointed(members.groupBy("code").agg(F.count("*").alias("n")))
    asked = checkpointed(coded(queries).withColumnsRenamed({"id": "query_id", "code": "query_code"}))
    parts = list(enumerate(segments(codes.count(), bits)))
    m = len(parts)

    # A first bound for queries in crowded buckets: distances to k + 1 codes of each of their buckets.
    first = Window.partitionBy("segment", "value").orderBy("code")
    heads = _probed(codes, parts, 0, "code").withColumn("place", F.row_number().over(first)).filter(F.col("place") <= k + 1).drop("place")
    unique = asked.select("query_code").distinct()
    met = _probed(unique, parts, 0, "query_code").join(heads, ["segment", "value"]).select("query_code", "code", "n").distinct()
    bounds = _kth(met.withColumn("dist", distance("query_code", "code")), k, bits)
    open_queries = checkpointed(unique.join(bounds, "query_code", "left").select("query_code", F.coalesce("bound", F.lit(bits)).alias("bound")))

    found: DataFrame | None = None
    done: list[DataFrame] = []
    widest = max(width for _, (_, width) in parts)
    steps = [(r, parts) for r in range(min(WHOLE_STEPS, widest) + 1)] + [(r, [p]) for r in range(WHOLE_STEPS + 1, widest + 1) for p in parts]
    for radius, some in steps:
        if not any(radius <= width for _, (_, width) in some):
            continue
        probes = _probed(open_queries, some, radius, "query_code")
        index = _probed(codes, some, 0, "code")
        new = probes.join(index, ["segment", "value"]).withColumn("dist", distance("query_code", "code")).filter("dist <= bound").select("query_code", "code", "n", "dist")
        both = new if found is None else found.unionByName(new)
        found = checkpointed(both.groupBy("query_code", "code", "dist").agg(F.max("n").alias("n")))
        covered = m * radius + some[-1][0]
        state = open_queries.select("query_code").join(_kth(found, k, bits), "query_code", "left").withColumn("bound", F.coalesce("bound", F.lit(bits)))
        state = checkpointed(state)
        found = found.join(state, "query_code").filter("dist <= bound").drop("bound")
        done.append(found.join(state.filter(F.col("bound") <= covered).select("query_code"), "query_code", "left_semi"))
        open_queries = state.filter(F.col("bound") > covered)
        found = found.join(open_queries.select("query_code"), "query_code", "left_semi")
        if open_queries.isEmpty():
            break
    else:
        done.append(found)  # every code has been met: fewer than k others exist
    near = done[0]
    for x in done[1:]:
        near = near.unionByName(x)
    order = Window.partitionBy("query_code").orderBy("dist", "id")
    nearest = near.join(members, "code").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k + 1)
    ranked = Window.partitionBy("query_id").orderBy("dist", "id")
    return (
        asked.join(nearest.select("query_code", "id", "dist"), "query_code")
        .filter(F.col("id") != F.col("query_id"))
        .withColumn("rank", F.row_number().over(ranked))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", F.col("id").alias("neighbour_id"), F.col("dist").alias("distance"))
    )
