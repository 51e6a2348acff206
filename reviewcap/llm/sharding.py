"""Shards along a Hilbert curve through several metadata dimensions (DataFrame functions only).

Every dimension is quantised to 2**bits levels by the quantiles of all rows,
the levels of a row give its index on the curve, and the rows in the order of
the curve are cut into runs of equal numbers.  Rows that lie near each other
in all dimensions come into the same shard, so a file's minimum and maximum
of each dimension are close, and readers skip files by any of them.

Spark sorts by range partitions; the numbers of rows before each partition
turn a row's place in its partition into its rank.  Rows with the same index
are ordered by a hash of the text and the id, so that no value of the
metadata makes a large partition.

Defined results: a null text has no bytes and the checksum of the empty text;
null dimensions have level 0; rows that repeat an id and a text have slots
of their own; with fewer rows than shards the last shards are empty; an empty
table gives no row; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import col, stored

ROW_BYTES = 16  # what a row takes besides its text


def curve_table(dims: int) -> list[int]:
    """The steps of a Hilbert curve in ``dims`` dimensions.

    A state is the corner e at which the curve enters a cell and the axis d
    along which it leaves.  Entry ``state * 2**dims + corner`` holds
    ``next state * 2**dims + place``: the place of that corner's sub-cell on
    the curve, and the state inside it.
    """
    size = 1 << dims

    def turn(v: int, by: int) -> int:
        by %= dims
        return (v << by | v >> (dims - by)) & (size - 1)

    def gray(i: int) -> int:
        return i ^ i >> 1

    def ones(i: int) -> int:
        return (~i & i + 1).bit_length() - 1

    place = {gray(i): i for i in range(size)}
    out = []
    for state in range(size * dims):
        e, d = divmod(state, dims)
        for corner in range(size):
            w = place[turn(corner ^ e, dims - (d + 1))]
            entry = gray(2 * ((w - 1) // 2)) if w else 0
            axis = 0 if not w else ones(w - 1 if w % 2 == 0 else w) % dims
            out.append(((e ^ turn(entry, d + 1)) * dims + (d + axis + 1) % dims) * size + w)
    return out


def curve_index(levels: list[Column], bits: int) -> Column:
    """The place on the Hilbert curve of a point with these levels (0 to 2**bits - 1 each)."""
    dims = len(levels)
    size = 1 << dims
    table = F.array(*[F.lit(v).cast("long") for v in curve_table(dims)])
    point = F.array(*[v.cast("long") for v in levels])

    def corner(p: Column, bit: Column) -> Column:
        each = [F.floor(F.get(p, F.lit(j)) / F.pow(F.lit(2), bit)).cast("long") % 2 * (1 << j) for j in range(dims)]
        return sum(each[1:], each[0])

    start = F.struct(F.lit(0).cast("long").alias("index"), F.lit(0).cast("long").alias("state"), point.alias("point"))

    def step(acc: Column, bit: Column) -> Column:
        found = F.get(table, (acc["state"] * size + corner(acc["point"], bit)).cast("int"))
        return F.struct((acc["index"] * size + found % size).alias("index"), F.floor(found / size).cast("long").alias("state"), acc["point"].alias("point"))

    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), start, step, lambda acc: acc["index"])


def ordinal(value: Column, kind: T.DataType) -> Column:
    """What orders like the value: a number, or its whole text."""
    if isinstance(kind, T.NumericType):
        return value.cast("double")
    if isinstance(kind, (T.DateType, T.TimestampType)):
        return value.cast("timestamp").cast("double")
    return value.cast("string")


def text_borders(values: DataFrame, bits: int) -> list[str]:
    """The values of the only column (strings) at which the share of the rows up to them passes a multiple of 1 / 2**bits."""
    size = 1 << bits
    each = values.toDF("v").filter("v IS NOT NULL").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    each = stored(each.repartitionByRange("v").withColumn("part", F.spark_partition_id()), "text-values")
    whole = Window.orderBy("part")  # one row for each partition
    parts = each.groupBy("part").agg(F.sum("n").alias("own")).select(
        "part", F.coalesce(F.sum("own").over(whole.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("own").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))
    upto = F.sum("n").over(Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = each.join(F.broadcast(parts), "part").withColumn("end", F.col("before") + upto)
    passed = ranked.filter(F.expr(f"(end * {size}) div total > ((end - n) * {size}) div total AND end < total"))
    return sorted((r["v"] for r in passed.select("v").collect()), key=lambda v: v.encode())  # 2**bits rows at most


def hilbert_shards(docs: DataFrame, dims: list[str], shards: int, id_col: str = "doc_id", text_col: str = "text", bits: int = 6) -> DataFrame:
    """doc_id, size, text_crc32, curve, shard, slot: shards of the curve with row counts at most one apart."""
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    values = [ordinal(col(d), docs.schema[d].dataType).alias(f"d{i}") for i, d in enumerate(dims)]
    rows = docs.select(col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
                       F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64(text).alias("tie"), *values)
    steps = [i / (1 << bits) for i in range(1, 1 << bits)]
    plain = docs.select(*values)
    texts = {f.name: text_borders(plain.select(f.name), bits) for f in plain.schema if isinstance(f.dataType, T.StringType)}
    cuts = plain.agg(F.lit(0).alias("none"), *[F.percentile_approx(c, steps, 1000).alias(c) for c in plain.columns if c not in texts]).first()

    def level(i: int) -> Column:
        name = f"d{i}"
        borders = F.array(*[F.lit(c) for c in texts[name]]).cast("array<string>") if name in texts else F.array(*[F.lit(float(c)) for c in cuts[name] or [0.0]])
        return F.size(F.filter(borders, lambda c: c < F.col(name)))

    levels = [level(i) for i in range(len(dims))]
    order = ["curve", "tie", "doc_id"]
    placed = rows.withColumn("curve", curve_index(levels, bits)).select("doc_id", "size", "text_crc32", "curve", "tie")
    placed = placed.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({
        "part": F.spark_partition_id(), "at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    placed = stored(placed, "curve-order")
    whole = Window.orderBy("part")  # one row for each partition
    parts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select(
        "part", F.coalesce(F.sum("n").over(whole.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("n").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))
    ranked = placed.join(F.broadcast(parts), "part").withColumn("rank", F.col("before") + F.col("at"))
    least, more = F.expr(f"total div {shards}"), F.col("total") % shards  # the first ``more`` shards have one row more
    head = more * (least + 1)
    inside = F.col("rank") - head
    short = F.greatest(least, F.lit(1))
    first = F.col("rank") < head
    return ranked.select(
        "doc_id", "size", "text_crc32", "curve",
        F.when(first, F.floor(F.col("rank") / (least + 1))).otherwise(more + F.floor(inside / short)).cast("int").alias("shard"),
        F.when(first, F.col("rank") % (least + 1)).otherwise(inside % short).cast("long").alias("slot"))


def write_shards(docs: DataFrame, placed: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """The rows of ``docs``, one folder of Parquet a shard, in the order of the curve."""
    own = placed.select(F.col("doc_id").alias("_id"), "shard", "slot").dropDuplicates(["_id"])
    joined = docs.join(own, col(id_col).cast("long").eqNullSafe(F.col("_id"))).drop("_id")
    joined.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").drop("slot").write.partitionBy("shard").parquet(path)
