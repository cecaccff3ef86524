"""Embedding near-dedup: spherical k-means cells, blocked cosine products within them (operator 1).

Vectors are compared only under equal labels. A label with more vectors than a cell should hold gets centres from
spherical k-means on a bounded sample; a vector's home is the cell of its nearest centre. No link is lost at the
borders: if two vectors are at most an angle t apart and their homes a, b differ, one of the two is within t / 2 of
the plane between a and b, so a vector is also a guest of every cell whose plane is that near. Blocks of homes are
multiplied with each other and with blocks of guests; only counts and a spanning forest leave a task, never pairs.
The sample decides how the work is cut up, not what is found.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize
from .graph import components

CELL = 1024  # vectors a cell should hold
MOST_CELLS = 4096  # over all labels: bounds the centres that are broadcast (64 dimensions: 2 MB); beyond, cells grow
SAMPLE = 32  # vectors drawn for each centre
ROWS = 1024  # vectors that are placed at once
BLOCK = 2048  # vectors a side in one product


def _usable(v: Column) -> Column:
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def _unit(vectors: list) -> np.ndarray:
    x = np.array(vectors, np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _unit_rows(column: pa.Array) -> np.ndarray:
    """Unit vectors of a list column whose lists are of one length."""
    x = column.flatten().to_numpy().reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Unit centres of unit vectors; an empty cell keeps its centre."""
    centres = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        home = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, x)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 1e-12, sums / np.maximum(norms, 1e-12), centres)
    return centres


def _centres(spark: SparkSession, rows: DataFrame) -> dict[tuple, np.ndarray]:
    """Centres of each (label, dimension) that needs more than one cell."""
    sizes = rows.groupBy("label", "dim").count().filter(F.col("count") > CELL).orderBy(F.desc("count"), "label", "dim").limit(MOST_CELLS // 2).collect()
    want = {(r["label"], r["dim"]): r["count"] / CELL for r in sizes}
    scale = min(1.0, MOST_CELLS / max(1.0, sum(math.ceil(w) for w in want.values())))
    cells = {key: max(2, math.ceil(w * scale)) for key, w in want.items()}
    if not cells:
        return {}
    shares = spark.createDataFrame([(key[0], key[1], SAMPLE * k / (want[key] * CELL)) for key, k in cells.items()], f"label {rows.schema['label'].dataType.simpleString()}, dim int, share double")
    drawn = rows.join(F.broadcast(shares), ["label", "dim"]).filter(F.pmod(F.xxhash64("rep", F.lit(5)), F.lit(1 << 20)) < F.col("share") * (1 << 20))
    table = drawn.select("label", "dim", "rep", "vec").toArrow()  # about SAMPLE * MOST_CELLS rows at most
    keys, order = list(zip(table.column("label").to_pylist(), table.column("dim").to_pylist())), np.argsort(table.column("rep").to_numpy(), kind="stable")
    by: dict[tuple, list] = {}
    for i in order.tolist():
        by.setdefault(keys[i], []).append(i)
    vecs = table.column("vec").combine_chunks()
    return {key: spherical_kmeans(_unit_rows(vecs.take(pa.array(at))), cells[key]) for key, at in by.items() if len(at) > 1}


def _product(table: pa.Table, least: float) -> pa.Table:
    """Counts and star edges of one pair of blocks: rows ``rep, times, vec, side, home, guests, cell, kind``."""
    side, rep, times = (table.column(c).to_numpy() for c in ("side", "rep", "times"))
    kind, cell = table.column("kind")[0].as_py(), table.column("cell")[0].as_py()
    x = _unit(table.column("vec").to_pylist())
    left = np.flatnonzero(side == 0)
    right = left if kind == 0 else np.flatnonzero(side == 1)
    links, near = np.zeros(len(rep), np.int64), np.arange(len(rep))
    if len(left) and len(right):
        hit = x[left] @ x[right].T >= least
        if kind == 0:
            np.fill_diagonal(hit, False)
        if kind == 2:  # if both are guests of each other's home, the lower cell counts the pair
            home, guests = table.column("home").to_numpy(), table.column("guests").to_pylist()
            for b in np.unique(home[right]):
                if b < cell:
                    also = np.array([b in g for g in (guests[i] for i in left)], bool)
                    hit[np.ix_(also, home[right] == b)] = False
        links[left] += hit @ times[right]
        if kind != 0:
            links[right] += hit.T @ times[left]
        rows, cols = hit.any(axis=1), hit.any(axis=0)
        l, r, sub = left[rows], right[cols], hit[np.ix_(rows, cols)]
        label = rep.copy()
        while len(l):  # the smallest id reachable within the block
            lo = np.minimum(label[l], np.where(sub, label[r][None, :], np.iinfo(np.int64).max).min(axis=1))
            new = label.copy()
            new[l] = np.minimum(new[l], lo)
            ro = np.where(sub, new[l][:, None], np.iinfo(np.int64).max).min(axis=0)
            new[r] = np.minimum(new[r], ro)
            if (new == label).all():
                break
            label = new
        near = label
    else:
        near = rep
    keep = links > 0
    return pa.table({"rep": pa.array(rep[keep]), "links": pa.array(links[keep]), "near": pa.array(near[keep])})


def near_duplicates(spark: SparkSession, vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", least: float = 0.98) -> DataFrame:
    """``id_col, n_links, component_id, kept`` for each row of ``vectors``; all links with cosine >= ``least``.

    Rows with identical vectors and labels are compared once, with their number as weight, so a large group of
    copies costs no more than one.

    Cases: a null label, or a vector that is null, empty, zero or holds null, NaN or infinity, links with nothing;
    vectors of different lengths are never linked; a null id has a null class and is kept; rows of one id are one
    node of the graph but each counts as a link; an empty table gives no rows; other columns are ignored, whatever
    their names.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("vec"))
    usable = F.col("label").isNotNull() & F.col("id").isNotNull() & _usable(F.col("vec"))
    rows = rows.select("id", "label", F.when(usable, F.col("vec")).alias("vec"), F.xxhash64("vec").alias("k1"), F.hash("vec", F.lit(1)).alias("k2"))
    one = rows.filter("vec is not null").groupBy("label", "k1", "k2").agg(F.min("id").alias("rep"), F.count("*").alias("times"), F.any_value("vec").alias("vec"))
    one = materialize(spark, one.withColumn("dim", F.size("vec")), "vectors")
    centres = _centres(spark, one)
    shared = spark.sparkContext.broadcast(centres)
    reach = math.sin(math.acos(least) / 2) + 1e-9

    def place(batches):
        for batch in batches:
            vecs, keys = batch.column("vec"), list(zip(batch.column("label").to_pylist(), batch.column("dim").to_pylist()))
            home, guests = np.zeros(len(keys), np.int64), [[] for _ in keys]
            for key in set(keys) & set(shared.value):
                c, every = shared.value[key], [i for i, k in enumerate(keys) if k == key]
                for start in range(0, len(every), ROWS):
                    at = every[start : start + ROWS]
                    dots = _unit_rows(vecs.take(pa.array(at))) @ c.T
                    own = dots.argmax(axis=1)
                    gap = np.sqrt(np.maximum(2 - 2 * (c[own] @ c.T), 0))  # between unit centres
                    near = dots[np.arange(len(at)), own][:, None] - dots <= reach * gap + 1e-9
                    near[np.arange(len(at)), own] = False
                    home[at] = own
                    for i, row in zip(at, near):
                        guests[i] = np.flatnonzero(row).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("label", "dim", "rep", "times", "vec")] + [pa.array(home), pa.array(guests, pa.list_(pa.int64()))], ["label", "dim", "rep", "times", "vec", "home", "guests"])

    kind = one.schema["label"].dataType.simpleString()
    placed = one.select("label", "dim", "rep", "times", "vec").mapInArrow(place, f"label {kind}, dim int, rep long, times long, vec array<double>, home long, guests array<long>")
    placed = materialize(spark, placed, "placed")
    # every row's cells: its home, and those it is a guest of; a cell's rows fall into blocks
    stays = placed.select("*", F.explode(F.concat(F.array("home"), "guests")).alias("cell")).withColumn("guest", F.col("cell") != F.col("home"))
    blocks = stays.groupBy("label", "dim", "cell").agg(F.ceil(F.count_if(~F.col("guest")) / BLOCK).cast("int").alias("nh"), F.ceil(F.count_if("guest") / BLOCK).cast("int").alias("ng"))
    stays = stays.join(blocks, ["label", "dim", "cell"]).filter("nh > 0")
    own = F.pmod(F.xxhash64("rep"), F.when(F.col("guest"), F.col("ng")).otherwise(F.col("nh"))).cast("int")
    stays = stays.withColumn("own", own)
    task = lambda kind, x, y, side: F.struct(F.lit(kind).alias("kind"), x.alias("x"), y.alias("y"), side.alias("side"))
    mine = F.col("own")

    def meet(j: Column) -> Column:  # kind 0: a block with itself, 1: two blocks of homes, 2: homes and guests
        return F.struct(F.when(j == mine, 0).otherwise(1).alias("kind"), F.least(mine, j).alias("x"), F.greatest(mine, j).alias("y"), F.when(mine <= j, 0).otherwise(1).alias("side"))

    up_to = lambda n: F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: i < n)
    at_home = F.concat(F.transform(up_to(F.col("nh")), meet), F.transform(up_to(F.col("ng")), lambda j: task(2, mine, j, F.lit(0))))
    as_guest = F.transform(up_to(F.col("nh")), lambda j: task(2, j, mine, F.lit(1)))
    tasks = stays.select("label", "dim", "cell", "rep", "times", "vec", "home", "guests", F.inline(F.when(F.col("guest"), as_guest).otherwise(at_home)))
    found = tasks.groupBy("label", "dim", "cell", "kind", "x", "y").applyInArrow(lambda t: _product(t, least), "rep long, links long, near long")
    found = materialize(spark, found, "links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    linked = components(spark, found.select("rep", "near"))
    out = one.select("label", "k1", "k2", "rep", "times").join(links, "rep", "left").join(linked, F.col("rep") == F.col("node"), "left")
    out = out.select("label", "k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component", "rep").alias("class"))
    at = F.when(F.col("vec").isNotNull(), F.col("label"))
    out = rows.select("id", at.alias("label"), "k1", "k2").join(out, ["label", "k1", "k2"], "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("class", "id").alias("component_id"), F.coalesce(F.col("id") == F.coalesce("class", "id"), F.lit(True)).alias("kept"))
