"""Exact n-gram Jaccard join by signature trees (operator 10).

Texts become sets of word shingles. Three exact steps leave little for the trees:

1. All shingles are dealt by hash (as packed blobs, 6 bytes a shingle) and those of one text alone are found; a
   chance equality of their halves only keeps a text in for longer. A text with fewer than ``percent`` % of its shingles in some other text can't have a link, whatever it shares.
2. Texts with equal sets are one from here on. For those left, the share of every shingle is counted among them; in
   the order from rare to common, a linked pair has one of the first ``n - need + 1`` shingles of both in common.
   Texts that share such a shingle form groups; all links lie within groups.
3. Within a group a signature tree finds links that connect all that is connected. A group too large for one task
   is cut into blocks: each block first on its own, then the representatives of the blocks' components, and last
   only texts still apart from their group's largest component meet its blocks of like sizes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buckets, grams, hash_spans, lower_ascii, materialize, mix, pieces, text_view, words
from .graph import Forest, components
from .signature_tree import windowed_links

K, PERCENT = 5, 75
BLOCK_SHINGLES = 2_000_000  # shingles of a group that a task compares at once (16 MB); to cut smaller groups costs more rounds than it saves
SMALL_IDS = 1_000_000  # ids that may be broadcast (16 MB); more are joined by a shuffle


def shingle_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    raw, offsets = text_view(column)
    raw = lower_ascii(raw)
    starts, ends, first = words(raw, offsets)
    all_grams, at = grams(hash_spans(raw, starts, ends), first, k)
    return [np.unique(all_grams[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def _blocks(batches: Iterator[pa.RecordBatch], k: int, most: int = 1_000_000) -> Iterator[tuple[list, list[np.ndarray]]]:
    """(ids, sets) of some thousand texts at a time."""
    ids, sets, held = [], [], 0
    for piece in pieces(batches, "text"):
        ids += piece.column("id").to_pylist()
        sets += shingle_sets(piece.column("text"), k)
        held = held + sum(map(len, sets[-piece.num_rows :]))
        if held > most or len(ids) > 50_000:
            yield ids, sets
            ids, sets, held = [], [], 0
    if ids:
        yield ids, sets


def _dealt(sets: list[np.ndarray], n: int, kind: type = np.uint32) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(bucket, hashes or their low halves, owners' numbers), a bucket at a time."""
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets), dtype=np.uint16 if len(sets) < 65536 else np.uint32), [len(s) for s in sets])
    bucket = ((flat >> np.uint64(32)) % np.uint64(n)).astype(np.int64)
    order = np.lexsort((flat.astype(kind), bucket))
    flat, owner, bucket = flat[order].astype(kind), owner[order], bucket[order]
    bounds = np.searchsorted(bucket, np.arange(n + 1))
    for b in range(n):
        if bounds[b] < bounds[b + 1]:
            yield b, flat[bounds[b] : bounds[b + 1]], owner[bounds[b] : bounds[b + 1]]


def _shared(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, first of its run, length of its run) for values that occur more than once."""
    order = np.argsort(values, kind="stable")
    v = values[order]
    starts = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])) if len(v) else np.zeros(0, np.int64)
    runs = np.diff(np.concatenate([starts, [len(v)]]))
    first, length = np.repeat(starts, runs), np.repeat(runs, runs)
    keep = length > 1
    return order[keep], first[keep], length[keep]


_DEALT = "bucket long, block long, kind int, a binary, b binary"


def text_sets(docs: DataFrame, n: int, k: int, percent: int) -> DataFrame:
    """Step 1: ``id, n_shingles, may_link, f1, f2`` for each row; f1, f2: a 128-bit fingerprint of the set."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for number, (ids, sets) in enumerate(_blocks(batches, k)):
            block = (part << 24) + number
            rows: list[tuple] = [(n + block % n, block, 0, _ids_bytes(ids), _meta_bytes(sets))]
            rows += [(b, block, len(sets) >= 65536, v.tobytes(), o.tobytes()) for b, v, o in _dealt(sets, n)]
            yield _rows(rows)

    def count(table: pa.Table) -> pa.Table:
        if table.column("bucket")[0].as_py() >= n:  # the blocks' ids and sizes pass through
            return table.select(["block", "kind", "a", "b"])
        blocks, wide, values, owners = (table.column(c).to_pylist() for c in ("block", "kind", "a", "b"))
        owner = [np.frombuffer(o, np.uint32 if w else np.uint16) for o, w in zip(owners, wide)]
        sizes = [len(o) for o in owner]
        order, _, _ = _shared(np.concatenate([np.frombuffer(v, np.uint32) for v in values]))
        marked = np.zeros(sum(sizes), bool)
        marked[order] = True
        out, at = [], 0
        for block, o, size in zip(blocks, owner, sizes):
            who, times = np.unique(o[marked[at : at + size]], return_counts=True)
            at += size
            if len(who):
                out.append((block, 1, who.astype(np.uint32).tobytes(), times.astype(np.uint32).tobytes()))
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.binary(), pa.binary()))], ["block", "kind", "a", "b"])

    def judge(table: pa.Table) -> pa.Table:
        kinds, first, second = (table.column(c).to_pylist() for c in ("kind", "a", "b"))
        at = kinds.index(0)
        ids, meta = _ids_of(first[at]), np.frombuffer(second[at], _META)
        shared = np.zeros(len(meta), np.int64)
        for kind, who, times in zip(kinds, first, second):
            if kind:
                shared[np.frombuffer(who, np.uint32)] += np.frombuffer(times, np.uint32)
        may = (meta["n"] > 0) & (100 * shared >= percent * meta["n"])
        return pa.table([ids, pa.array(meta["n"]), pa.array(may), pa.array(meta["f1"]), pa.array(meta["f2"])], ["id", "n_shingles", "may_link", "f1", "f2"])

    counted = docs.mapInArrow(deal, _DEALT).groupBy("bucket").applyInArrow(count, "block long, kind int, a binary, b binary")
    return counted.groupBy("block").applyInArrow(judge, "id long, n_shingles long, may_link boolean, f1 long, f2 long")


_META = np.dtype([("n", "<i8"), ("f1", "<i8"), ("f2", "<i8")])


def _meta_bytes(sets: list[np.ndarray]) -> bytes:
    out = np.zeros(len(sets), _META)
    for i, s in enumerate(sets):
        out[i] = (len(s), int(mix(s).sum(dtype=np.uint64).view(np.int64)), int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)))
    return out.tobytes()


def _ids_bytes(ids: list) -> bytes:
    return np.array([x or 0 for x in ids], np.int64).tobytes() + np.array([x is not None for x in ids], np.uint8).tobytes()


def _ids_of(blob: bytes) -> pa.Array:
    n = len(blob) // 9
    return pa.array(np.frombuffer(blob, np.int64, n), mask=np.frombuffer(blob, np.uint8, n, 8 * n) == 0)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([int(r[i]) if i < 3 else r[i] for r in rows], t) for i, t in enumerate(kinds)], ["bucket", "block", "kind", "a", "b"])


def only(docs: DataFrame, ids: DataFrame, count: int) -> DataFrame:
    """Rows of ``docs`` whose id is in ``ids`` (distinct): a broadcast up to a checked size, else a shuffle."""
    ids = F.broadcast(ids) if count <= SMALL_IDS else ids.hint("shuffle_hash")
    return docs.join(ids, "id", "left_semi")


def saved_sets(docs: DataFrame, k: int) -> DataFrame:
    """``id, n, shingles`` (sorted 64-bit hashes as bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            sets = shingle_sets(piece.column("text"), k)
            yield pa.RecordBatch.from_arrays([piece.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "n", "shingles"])

    return docs.mapInArrow(run, "id long, n long, shingles binary")


def group_edges(sets: DataFrame, n: int, percent: int) -> DataFrame:
    """Step 2: edges (a, b) that hold the texts of each group together, from ``id, n, shingles``."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            all_ids, blobs = batch.column("id").to_pylist(), batch.column("shingles").to_pylist()
            for at in range(0, len(all_ids), 2000):
                ids, own = np.array(all_ids[at : at + 2000], np.int64), [np.frombuffer(x, np.uint64) for x in blobs[at : at + 2000]]
                block, number = (part << 24) + number, number + 1
                sizes = np.array([len(s) for s in own], np.int64)
                yield _rows([(n + block % n, block, 0, ids.tobytes(), sizes.tobytes())] + [(b, block, 1, v.tobytes(), ids[o].tobytes()) for b, v, o in _dealt(own, n, np.uint64)])

    def count(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        if bucket >= n:
            return table.select(["block", "kind", "a", "b"])
        blocks, values, owners = (table.column(c).to_pylist() for c in ("block", "a", "b"))
        value, owner = np.concatenate([np.frombuffer(v, np.uint64) for v in values]), np.concatenate([np.frombuffer(o, np.int64) for o in owners])
        block = np.repeat(np.array(blocks), [len(v) // 8 for v in values])
        order, first, length = _shared(value)
        least = np.minimum.reduceat(owner[order], np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]]))) if len(order) else np.zeros(0, np.int64)
        runs = np.cumsum(np.concatenate([[True], first[1:] != first[:-1]])) - 1 if len(order) else np.zeros(0, np.int64)
        marks = np.zeros(len(order), _MARK)
        marks["id"], marks["least"], marks["times"], marks["value"], marks["bucket"] = owner[order], least[runs], length, value[order], bucket
        home = block[order]
        by = np.argsort(home, kind="stable")
        marks, home = marks[by], home[by]
        cuts = np.flatnonzero(np.concatenate([[True], home[1:] != home[:-1]])) if len(home) else np.zeros(0, np.int64)
        out = [(int(home[a]), 1, marks[a:b].tobytes(), b"") for a, b in zip(cuts, [*cuts[1:], len(home)])]
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.binary(), pa.binary()))], ["block", "kind", "a", "b"])

    def prefixes(table: pa.Table) -> pa.Table:
        kinds, first, second = (table.column(c).to_pylist() for c in ("kind", "a", "b"))
        at = kinds.index(0)
        size = dict(zip(np.frombuffer(first[at], np.int64).tolist(), np.frombuffer(second[at], np.int64).tolist()))
        marks = np.frombuffer(b"".join(a for a, kind in zip(first, kinds) if kind), _MARK)
        marks = marks[np.lexsort((marks["value"], marks["bucket"], marks["times"], marks["id"]))]
        cuts = np.flatnonzero(np.concatenate([[True], marks["id"][1:] != marks["id"][:-1]])) if len(marks) else np.zeros(0, np.int64)
        edges = []
        for a, b in zip(cuts, [*cuts[1:], len(marks)]):
            key = int(marks["id"][a])
            total = size[key]
            need = -(-percent * total // 100)
            take = total - need + 1 - (total - (b - a))  # shingles of this text alone come first of all
            if take > 0:
                edges += [(key, x) for x in np.unique(marks["least"][a : a + take]).tolist() if x != key]
        return pa.table([pa.array([e[i] for e in edges], pa.int64()) for i in (0, 1)], ["a", "b"])

    counted = sets.mapInArrow(deal, _DEALT).groupBy("bucket").applyInArrow(count, "block long, kind int, a binary, b binary")
    return counted.groupBy("block").applyInArrow(prefixes, "a long, b long")


_MARK = np.dtype([("id", "<i8"), ("least", "<i8"), ("value", "<u8"), ("times", "<u4"), ("bucket", "<u4")])


def _tree_links(table: pa.Table, percent: int) -> pa.Table:
    """Links within each ``part`` of a task's rows ``part, id, label, shingles``; equal labels are connected already."""
    part, ids, label = (table.column(c).to_numpy() for c in ("part", "id", "label"))
    blobs = table.column("shingles").to_pylist()
    out = []
    for p in np.unique(part):
        at = np.flatnonzero(part == p)
        if len(at) > 1:
            links = windowed_links([np.frombuffer(blobs[i], np.uint64) for i in at], percent, label[at])
            out += [(int(ids[at[x]]), int(ids[at[y]])) for x, y in links]
    return pa.table([pa.array([e[i] for e in out], pa.int64()) for i in (0, 1)], ["a", "b"])


def set_links(spark: SparkSession, sets: DataFrame, groups: DataFrame, n: int, percent: int, block: int = BLOCK_SHINGLES) -> DataFrame:
    """Step 3: links (a, b) that connect what is connected, from ``id, n, shingles`` and ``node, component``."""
    rows = materialize(spark, sets.join(groups, sets["id"] == groups["node"]).select("id", "n", "shingles", F.col("component").alias("part")), "groups")
    volume = rows.groupBy("part").agg(F.sum("n").alias("volume"))
    links = lambda df: df.groupBy("task").applyInArrow(lambda t: _tree_links(t, percent), "a long, b long")
    large = volume.filter(F.col("volume") > block)
    sized = materialize(spark, large.withColumn("cuts", F.ceil(F.col("volume") / block).cast("long")), "large")
    if not sized.limit(1).count():
        return links(rows.select(F.pmod(F.xxhash64("part"), F.lit(n)).alias("task"), "part", "id", F.col("id").alias("label"), "shingles"))
    small = rows.join(sized, "part", "left_anti")
    found = [links(small.select(F.pmod(F.xxhash64("part"), F.lit(n)).alias("task"), "part", "id", F.col("id").alias("label"), "shingles"))]
    big = materialize(spark, rows.join(sized, "part"), "blocks")
    left = big
    while True:  # blocks on their own, then what represents their components, until a group's are one block or stay
        at = F.pmod(F.xxhash64("id"), F.col("cuts"))
        step = materialize(spark, links(left.select(F.xxhash64("part", at).alias("task"), "part", "id", F.col("id").alias("label"), "shingles")), "links")
        found.append(step)
        absorbed = components(spark, step).filter("node <> component").select(F.col("node").alias("id"))
        before = left.count()
        left = materialize(spark, left.join(absorbed, "id", "left_anti"), "kept")
        left = left.drop("cuts", "volume").join(left.groupBy("part").agg(F.sum("n").alias("volume")), "part").withColumn("cuts", F.ceil(F.col("volume") / block).cast("long"))
        if not left.filter("cuts > 1").limit(1).count() or left.count() > before / 2:
            break
    at = F.pmod(F.xxhash64("id"), F.col("cuts"))
    found.append(materialize(spark, links(left.select(F.xxhash64("part", at).alias("task"), "part", "id", F.col("id").alias("label"), "shingles")), "links"))
    union = found[1]
    for more in found[2:]:
        union = union.unionByName(more)
    labels = components(spark, union)
    big = big.join(labels, big["id"] == labels["node"], "left").withColumn("label", F.coalesce("component", "id")).drop("node", "component")
    main = big.groupBy("part", "label").count().groupBy("part").agg(F.max_by("label", "count").alias("main"))
    big = materialize(spark, big.join(main, "part"), "labelled")
    # a link's sizes are at most one class apart, so what is apart meets the blocks of three classes
    big = materialize(spark, big.withColumn("class", F.floor(F.log("n") / (1.0001 * max(math.log(100 / percent), 1e-6))).cast("long")), "classed")
    apart = big.filter(F.col("label") != F.col("main"))
    rest = big.filter(F.col("label") == F.col("main")).join(apart.select("part").distinct(), "part", "left_semi")
    sizes = big.groupBy("part", "class").agg(F.ceil(F.sum("n") / block).cast("long").alias("blocks"))
    sizes = materialize(spark, sizes, "classes")
    at_home = rest.join(sizes, ["part", "class"]).withColumn("at", F.pmod(F.xxhash64("id"), F.col("blocks")))
    goes = apart.withColumn("class", F.explode(F.sequence(F.col("class") - 1, F.col("class") + 1))).join(sizes, ["part", "class"])
    goes = goes.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    both = at_home.select("part", "class", "at", "id", "label", "shingles").unionByName(goes.select("part", "class", "at", "id", "label", "shingles"))
    found.append(links(both.select(F.xxhash64("part", "class", "at").alias("task"), "part", "id", "label", "shingles")))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def classes(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, percent: int = PERCENT) -> DataFrame:
    """``id_col, n_shingles, component_id`` for each row: the smallest id reachable by links, itself included.

    Two texts link when 100 * intersection >= percent * union of their shingle sets. A text of 1 to k-1 words has its
    whole sequence as one shingle.

    Cases: null, empty and blank texts have no shingles and link with nothing; rows of equal texts are linked; rows
    of one id are one node; a row with a null id has a null class and links with nothing; an empty table gives no
    rows; other columns are ignored, whatever their names; very long texts are whole sets like others.
    """
    n = 4 * buckets(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sized = materialize(spark, text_sets(rows, n, k, percent), "sizes")
    equal = sized.filter("may_link and id is not null").groupBy("n_shingles", "f1", "f2").agg(F.min("id").alias("rep"))
    equal = materialize(spark, equal, "equal")
    reps = equal.select(F.col("rep").alias("id")).distinct()
    sets = materialize(spark, saved_sets(only(rows, reps, equal.count()), k), "sets")
    groups = components(spark, group_edges(sets, n, percent))
    linked = components(spark, set_links(spark, sets, groups, n, percent))
    named = equal.join(linked, equal["rep"] == linked["node"], "left").select("n_shingles", "f1", "f2", F.coalesce("component", "rep").alias("class"))
    out = sized.join(named, ["n_shingles", "f1", "f2"], "left")
    own = F.when(F.col("may_link") & F.col("id").isNotNull(), F.col("class")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", own.alias("component_id"))


def representatives(docs: DataFrame, found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose id is their class's smallest, one row an id; rows of a null id all stay.

    ``found`` is what ``classes`` returned for ``docs``. Names from __fl_ on are reserved.
    """
    keep = found.filter(F.col(id_col) == F.col("component_id")).groupBy(id_col).agg(F.count("*").alias("__fl_rows"))
    keep = keep.withColumnRenamed(id_col, "__fl_id")
    out = docs.join(keep.hint("shuffle_hash"), F.col(id_col).cast("long") == F.col("__fl_id"))
    once = out.filter("__fl_rows = 1").select(*docs.columns)
    if keep.filter("__fl_rows > 1").limit(1).count():
        once = once.unionByName(out.filter("__fl_rows > 1").dropDuplicates([id_col]).select(*docs.columns))
    if docs.filter(F.col(id_col).isNull()).limit(1).count():
        once = once.unionByName(docs.filter(F.col(id_col).isNull()))
    return once
