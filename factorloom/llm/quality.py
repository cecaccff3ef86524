"""Quality classifier: naive Bayes support vectors (operator 6).

Features are indicators of hashed n-grams: runs of 1 to 3 bytes (case kept, so that shouting and sign noise show),
words and word pairs, and runs of one word repeated, whatever the word. Each is scaled by its class log-count ratio, rows are brought to unit length, and a linear
hinge-loss model is fitted by dual coordinate descent; a sigmoid on rows kept apart turns margins into scores.

Log-count ratios count all labelled training rows. The linear model is fitted on a bounded sample of them
(``FIT_ROWS``, ``FIT_FEATURES``), drawn by a hash of the id. Neither language, source, id nor labels are inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hash_spans, lower_ascii, mix, pieces, text_view, words

DIM = 1 << 18
FIT_ROWS, FIT_FEATURES = 8000, 12_000_000  # labelled rows, and features in them, that the linear model and the sigmoid are fitted on, at most, about
SMALL_LABELS = 2_000_000  # labels that may be broadcast (32 MB); more are joined by a shuffle
_CHUNK, _GROUPS = 1 << 12, 64


def features(column: pa.Array) -> Iterator[np.ndarray]:
    """The distinct feature numbers of each text, ascending; an empty text has none."""
    raw, offsets = text_view(column)
    n = len(raw)
    wide = raw.astype(np.uint64)
    byte_grams = [(mix(wide + np.uint64(1 << 40)) % np.uint64(DIM)).astype(np.int32)]
    for k in (2, 3):
        wide = (wide[:-1] << np.uint64(8) | raw[k - 1 :]) if n >= k else np.zeros(0, np.uint64)
        byte_grams.append((mix(wide + np.uint64(k << 40)) % np.uint64(DIM)).astype(np.int32))
    low = lower_ascii(raw)
    starts, ends, first = words(low, offsets)
    w = hash_spans(low, starts, ends)
    one = (w % np.uint64(DIM)).astype(np.int32)
    two = (mix(w[:-1] * np.uint64(0xD1342543DE82EF95) + w[1:]) % np.uint64(DIM)).astype(np.int32) if len(w) > 1 else np.zeros(0, np.int32)
    same = np.concatenate([[False], w[1:] == w[:-1]]) if len(w) else np.zeros(0, bool)
    same[first[:-1][first[:-1] < len(w)]] = False
    stutter, run = np.full(len(w), -1, np.int32), np.zeros(len(w), np.int64)
    if len(w):  # the n-gram "the same word k times", whatever the word
        at = np.arange(len(w))
        run = at - np.maximum.accumulate(np.where(same, 0, at))
        stutter = (mix(np.minimum(run, 4).astype(np.uint64) + np.uint64(7 << 40)) % np.uint64(DIM)).astype(np.int32)
    seen = np.zeros(DIM, bool)
    for a, b, f, g in zip(offsets[:-1], offsets[1:], first[:-1], first[1:]):
        if a == b:
            yield np.zeros(0, np.int32)
            continue
        for k, x in enumerate(byte_grams):
            seen[x[a : max(a, b - k)]] = True
        seen[one[f:g]] = True
        seen[stutter[f:g]] = True
        seen[two[f : max(f, g - 1)]] = True
        at = np.flatnonzero(seen).astype(np.int32)
        seen[at] = False
        yield at


def log_count_ratios(sums: np.ndarray) -> np.ndarray:
    """Of each feature: log of its share among class 1's features over that among class 0's, with one added to each count."""
    p, q = sums[1] + 1.0, sums[0] + 1.0
    return np.log(p / p.sum()) - np.log(q / q.sum())


def dual_coordinate_descent(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, cost: float = 1.0, rounds: int = 20, seed: int = 1) -> np.ndarray:
    """Weights of the L2-regularised hinge loss, by coordinate descent in the dual; rows: (columns, values)."""
    w, alpha = np.zeros(DIM + 1), np.zeros(len(rows))
    square = np.array([float(v @ v) + 1.0 for _, v in rows])  # the last column is the constant 1
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            at, v = rows[i]
            g = y[i] * (w[at] @ v + w[DIM]) - 1
            if alpha[i] == 0:
                pg = min(g, 0.0)
            elif alpha[i] == cost:
                pg = max(g, 0.0)
            else:
                pg = g
            if pg:
                worst = max(worst, abs(pg))
                new = min(max(alpha[i] - g / square[i], 0.0), cost)
                step = (new - alpha[i]) * y[i]
                w[at] += step * v
                w[DIM] += step
                alpha[i] = new
        if worst < 0.01:
            break
    return w


def sigmoid_fit(margin: np.ndarray, y: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """a, b of 1 / (1 + exp(-(a * margin + b))) by damped Newton steps on smoothed targets."""
    up, n = float((y > 0).sum()), len(y)
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (n - up + 2))
    x = np.stack([margin, np.ones(n)], axis=1)
    ab = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ ab, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (target - p) - 1e-3 * (ab - [1.0, 0.0]))
        ab = ab + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-7:
            break
    return float(ab[0]), float(ab[1])


def train(spark: SparkSession, labelled: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[np.ndarray, float]:
    """(weight and squared scale of each feature, constant) on the score's logit scale, from rows ``id long, text, y int`` (0 or 1).

    Returns the ratios folded into the weights. With rows of one class only, or none, the constant says it all.

    Cases: null text counts as empty and has no features; repeated rows count each; ties of equal rows stand in any
    order with the same result; texts of any length give their whole set of features; other columns are ignored.
    """

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, rows = np.zeros((2, DIM), np.int64), np.zeros(2, np.int64)
        for piece in pieces(batches, "text"):
            for y, at in zip(piece.column("y").to_pylist(), features(piece.column("text"))):
                sums[y, at] += 1
                rows[y] += 1
        if rows.sum():
            group = TaskContext.get().partitionId() % _GROUPS
            yield pa.RecordBatch.from_pydict({"chunk": list(range(DIM // _CHUNK)), "part": [group] * (DIM // _CHUNK), "sums": [sums[:, a : a + _CHUNK].tobytes() for a in range(0, DIM, _CHUNK)], "n0": [int(rows[0])] * (DIM // _CHUNK), "n1": [int(rows[1])] * (DIM // _CHUNK)})

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64) for x in table.column("sums").to_pylist())
        return pa.table({"chunk": [table.column("chunk")[0].as_py()], "part": [table.column("part")[0].as_py()], "sums": [total.tobytes()], "n0": [sum(table.column("n0").to_pylist())], "n1": [sum(table.column("n1").to_pylist())]})

    schema = "chunk long, part long, sums binary, n0 long, n1 long"
    # few tasks with much to count each; their sums are added up in two steps, so that no task gets them all
    few = labelled.coalesce(4 * spark.sparkContext.defaultParallelism)
    added = few.mapInArrow(counts, schema).groupBy("chunk", "part").applyInArrow(add, schema).groupBy("chunk").applyInArrow(add, schema)
    parts = added.orderBy("chunk").collect()  # DIM / _CHUNK rows
    if not parts or not parts[0].n0 or not parts[0].n1:
        return np.zeros((2, DIM)), 0.0 if not parts else (3.0 if parts[0].n1 else -3.0)
    sums = np.concatenate([np.frombuffer(p["sums"], np.int64).reshape(2, -1) for p in parts], axis=1)
    ratio = log_count_ratios(sums)
    share = min(1.0, fit_rows / (parts[0].n0 + parts[0].n1), FIT_FEATURES / max(1, int(sums.sum())))
    drawn = labelled.filter(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 24)) < int(share * (1 << 24)))

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            yield pa.RecordBatch.from_arrays([piece.column("id"), piece.column("y"), pa.array([x.tobytes() for x in features(piece.column("text"))], pa.binary())], ["id", "y", "at"])

    rows, ys = [], []
    for r in sorted(drawn.mapInArrow(sparse, "id long, y int, at binary").collect(), key=lambda r: (r.id, r.at)):
        at = np.frombuffer(r.at, np.int32)
        v = ratio[at]
        rows.append((at, (v / max(np.linalg.norm(v), 1e-12)).astype(np.float32)))
        ys.append(2 * r.y - 1)
    y = np.array(ys)
    apart = np.arange(len(y)) % 4 == 3
    fit = np.flatnonzero(~apart)
    if len({*y[fit]}) < 2 or len({*y[apart]}) < 2:  # too few rows to set some apart
        fit, apart = np.arange(len(y)), np.ones(len(y), bool)
    w = dual_coordinate_descent([rows[i] for i in fit], y[fit])
    margin = np.array([w[a] @ v + w[DIM] for (a, v), k in zip(rows, apart) if k])
    a, b = sigmoid_fit(margin, y[apart])
    return np.stack([a * w[:DIM] * ratio, ratio * ratio]), a * w[DIM] + b


def score(spark: SparkSession, docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7, keep: list[str] | None = None, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``id_col`` (and the columns in ``keep``) with score (0 to 1) and prediction, by ``names``, for each row; no shuffle.

    Cases: null counts as empty; an empty text has the score of the constant alone; repeated rows and null ids are
    rows like others; an empty table gives no rows; very long texts are scored whole; kept columns called like the results give way to them; other columns are ignored.
    """
    shared = spark.sparkContext.broadcast(model)  # two numbers for each of DIM features, whatever the input: 4 MB
    kept = [c for c in (keep or []) if c not in (id_col, text_col, *names)]
    rows = docs.select(F.col(id_col), *[F.col(c) for c in kept], F.col(text_col).cast("string").alias("__fl_text"))
    own = [id_col, *kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, constant = shared.value
        for piece in pieces(batches, "__fl_text"):
            logit = np.full(piece.num_rows, constant)
            for i, at in enumerate(features(piece.column("__fl_text"))):
                if len(at):
                    logit[i] += weights[0, at].sum() / max(np.sqrt(weights[1, at].sum()), 1e-12)
            p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
            out = {c: piece.column(c) for c in own} | {names[0]: pa.array(p), names[1]: pa.array((p >= threshold).astype(np.int32))}
            if keep is not None:
                out[text_col] = piece.column("__fl_text")
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in own)
    return rows.mapInArrow(run, f"{kinds}, `{names[0]}` double, `{names[1]}` int" + f", `{text_col}` string" * (keep is not None))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 4, held_out: int = 2) -> DataFrame:
    """``id, text, y`` of the documents with a label 0 or 1, but those whose crc32 of the id's text mod ``folds`` is ``held_out``.

    Cases: null ids and labels that are null or neither 0 nor 1 are left out; of several labels of one id the largest
    counts; repeated documents come out repeated; an empty table gives no rows; other columns are ignored, whatever
    their names.
    """
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).filter("id is not null and y in (0, 1)")
    known = known.filter(F.crc32(F.col("id").cast("string").cast("binary")) % folds != held_out).groupBy("id").agg(F.max("y").alias("y"))
    small = known.limit(SMALL_LABELS + 1).count() <= SMALL_LABELS
    known = F.broadcast(known) if small else known.hint("shuffle_hash")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.join(known, "id")


def is_held_out(id_col: str = "doc_id", folds: int = 4, held_out: int = 2):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == held_out, F.lit(False))


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Train on the rows that are not held out, then score every row: ``id_col, held_out, score, predicted``.

    Cases: as for ``score``; a null id is not held out; without labels every score is 0.5.
    """
    scored = score(spark, docs, train(spark, training_rows(docs, labels, id_col, text_col)), id_col, text_col)
    return scored.select(id_col, is_held_out(id_col).alias("held_out"), "score", "predicted")
