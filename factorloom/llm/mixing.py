"""Mixing sources to target weights by weighted fair queueing (operator 4). DataFrame functions only.

Every document is offered up to ``repeats`` times. Within a source, offers are put in a seeded random order, all
documents once before any comes again; an offer's virtual finish time is the source's words up to and with it,
divided by the source's target. All offers are dealt by ranges of that time and cut where the budget is full.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

WEIGHTS = (5, 2, 1)
SLICES = 512  # parts of a source's random order, and ranges of the finish time


def n_words(text: Column) -> Column:
    r"""Number of ``[^\x20\x09-\x0D]+`` in a text; 0 if null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = 3) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size`` (a row a source).

    Sources in code point order, null last, get the weights in turn and share the sum of all sizes; a target stops
    at ``repeats`` times its size and the excess goes to the others by weight until none is above. In order of
    cap / weight a prefix of the sources is at its cap; the rest share what is left. One window over the sources,
    which are aggregated rows, one a source.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    ordered = W.orderBy(F.col("cap") / F.col("weight"), F.col("rank"))
    whole, before = W.partitionBy(), ordered.rowsBetween(W.unboundedPreceding, -1)
    out = sizes.withColumn("rank", F.row_number().over(by_name) - 1)
    out = out.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("double"))
    out = out.withColumn("cap", F.col("source_size") * F.lit(float(repeats)))
    out = out.withColumn("left", F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    out = out.withColumn("share", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    # the first source that stays below its cap sets the level for itself and all after it
    open_ = F.col("left") * F.col("weight") < F.col("cap") * F.col("share")
    out = out.withColumn("level", F.first(F.when(open_, F.col("left") / F.col("share")), True).over(ordered.rowsBetween(W.unboundedPreceding, 0)))
    return out.select("source", "source_size", F.coalesce(F.least(F.col("level") * F.col("weight"), F.col("cap")), F.col("cap")).alias("target"))


def _running(df: DataFrame, group: list[str], order: list[str], slice_col: str, value: str, name: str) -> DataFrame:
    """Running sum of ``value`` within ``group`` by (slice_col, *order), in two levels: sums of slices first.

    No task holds a whole group: a group's rows are dealt by slice, and only the slices' sums are put in order.
    """
    keys = [*group, slice_col]
    sums = df.groupBy(*keys).agg(F.sum(value).alias("_s"))
    w = (W.partitionBy(*group) if group else W.partitionBy()).orderBy(slice_col).rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_s").over(w), F.lit(0))).drop("_s")
    for k in group:
        sums = sums.withColumnRenamed(k, f"_{k}")
    sums = sums.withColumnRenamed(slice_col, "_slice")
    on = [df[k].eqNullSafe(sums[f"_{k}"]) for k in group] + [df[slice_col] == sums["_slice"]]
    within = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = df.withColumn("_own", F.sum(value).over(within)).join(sums, on, "inner")
    return out.withColumn(name, F.col("_own") + F.col("_before")).drop("_own", "_before", "_slice", *(f"_{k}" for k in group))


def plan(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, repeats: int = 3, seed: int = 7, slices: int = SLICES, carry: tuple[Column, ...] = ()) -> DataFrame:
    """How often the mix takes each row: ``doc_id, source, size, source_size, target, taken, copies`` and the finish time.

    ``taken`` = size x copies; no row is taken more than ``repeats`` times. The order is by md5 of seed, id, size and source, so
    reruns agree; rows equal in all of these are interchangeable, or stand in the order of ``carry``, further columns
    that the result keeps.

    Cases: null text has size 0; rows of size 0 are taken no times; a null source is a source of its own, last in
    order; null ids are rows like others; repeated rows count each; an empty table gives no rows; a table whose sizes
    are all 0 has targets 0 and takes nothing. Other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), *carry)
    carried = rows.columns[3:]
    rows = rows.withColumn("order", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"), F.col("size").cast("string"), "source")))
    rows = rows.withColumn("slice", F.floor(F.conv(F.substring("order", 1, 4), 16, 10).cast("int") * slices / 65536).cast("int"))
    rows = materialize(spark, rows, "sizes")  # texts are read once; all below works on these few numbers a row
    quota = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, repeats).withColumnRenamed("source", "_source")
    ran = _running(rows, ["source"], ["order", "doc_id", *carried], "slice", "size", "ran")
    ran = ran.join(quota, ran["source"].eqNullSafe(quota["_source"])).drop("_source")
    finish = lambda e: (F.lit(e) * F.col("source_size") + F.col("ran")) / F.when(F.col("target") > 0, F.col("target"))
    ran = materialize(spark, ran.withColumn("finishes", F.array(*[finish(e) for e in range(repeats)])), "queues")
    offers = ran.select("doc_id", "size", "order", F.explode("finishes").alias("finish")).filter("size > 0")
    offers = offers.withColumn("range", F.floor(F.col("finish") / (1 + F.col("finish")) * slices).cast("int"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    queued = _running(offers, [], ["finish", "order", "doc_id"], "range", "size", "queued")
    last = queued.filter(F.col("queued") <= total).agg(F.max(F.struct("finish", "order")).alias("last")).first()["last"]  # one row
    fits = F.lit(False)
    if last is not None:
        fits = F.filter("finishes", lambda x: (x < last["finish"]) | ((x == last["finish"]) & (F.col("order") <= last["order"])))
    copies = F.when(F.col("size") > 0, F.size(fits)).otherwise(0) if last is not None else F.lit(0)
    out = ran.withColumn("copies", copies)
    return out.select("doc_id", "source", "size", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"), (F.col("size") * F.col("copies")).cast("long").alias("taken"), "copies", "finishes", *carried)


def row_key(docs: DataFrame) -> list[Column]:
    """128 bits ``__fl_a, __fl_b`` of all columns of a row: equal for equal rows only, whatever is null in them."""
    cells = []
    for f in docs.schema.fields:
        cell = F.col(f"`{f.name}`")
        nested = f.dataType.typeName() in ("array", "map", "struct")  # hashes skip the nulls within
        cells += [F.to_json(F.struct(cell), {"ignoreNullFields": "false"}) if nested else cell, cell.isNull()]
    return [F.xxhash64(F.lit(seed), *cells).alias(name) for seed, name in ((1, "__fl_a"), (2, "__fl_b"))]


def mix(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """The documents of the mix with their own columns, in as many copies as taken, globally sorted by finish time.

    Each row of the plan meets one row of ``docs``: they are joined by a key of all columns, and of equal rows (a
    repeated id, or null ids over one text) one stands for all on the side of the texts. Names from __fl_ on are reserved.

    Cases: as for ``plan``: texts without words are taken no times; null ids and sources are values like others; equal
    rows are taken up to ``repeats`` times each; an empty table gives no rows; all columns stay, whatever their names.
    """
    key = row_key(docs)
    taken = plan(spark, docs, id_col, carry=tuple(key), **how).filter("copies > 0")
    taken = taken.select("__fl_a", "__fl_b", F.slice("finishes", F.lit(1), F.col("copies")).alias("__fl_at"))
    texts = docs.select("*", *key).dropDuplicates(["__fl_a", "__fl_b"])
    out = texts.join(taken.hint("shuffle_hash"), ["__fl_a", "__fl_b"])
    out = out.withColumn("__fl_at", F.explode("__fl_at"))
    return out.repartitionByRange("__fl_at").sortWithinPartitions("__fl_at", id_col).select(*docs.columns)
