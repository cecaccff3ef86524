"""Document fingerprints by winnowing (operator 2). DataFrame functions only.

Grams are all runs of ``k`` code points of a text as it stands, each hashed to 64 bits as a rolling pass goes over the
text in four bytes a code point. Of each window of ``window`` consecutive grams the one of the smallest hash is
chosen, the rightmost one on ties, and kept with its position: a mark. Any run of ``k + window - 1`` code points that
two texts share puts a common hash into both fingerprints. The choice goes by the upper 51 bits of a hash, so that a
gram and its place within a stretch of the text fit one number; a mark has all 64 bits, and its position apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import buckets

K, WINDOW = 12, 8
STRETCH = 4096  # windows handled at once: bounds the working memory of very long texts
_PLACE = (1 << 13) - 1  # places within a stretch, window and all


def _bind(x: Column, f) -> Column:
    """``f(x)``, with x computed once."""
    return F.transform(F.array(x), lambda v: f(v))[0]


def _hash(units: Column, at: Column, k: int) -> Column:
    """Hash of the gram at ``at`` (from 0) of a text in four bytes a code point."""
    return F.xxhash64(F.substring(units, at * 4 + 1, F.lit(4 * k)))


def least_of_windows(grams: Column, window: int) -> Column:
    """The least of each window of consecutive numbers; of all, if they are fewer than a window."""
    # doubling: the least of 1, 2, 4 ... numbers from each on, then of the whole window by two that overlap
    later = lambda values, step: _bind(values, lambda v: F.zip_with(v, F.slice(v, F.lit(step + 1), F.size(v)), lambda a, b: F.least(a, b)))
    out, span = grams, 1
    while span * 2 <= window:
        out, span = later(out, span), span * 2
    if span < window:
        out = later(out, window - span)
    return _bind(out, lambda v: F.slice(v, F.lit(1), F.greatest(F.size(v) - window + 1, F.least(F.size(v), F.lit(1)))))


def marks(text: Column, k: int = K, window: int = WINDOW) -> Column:
    """``struct<hashes array<long>, positions array<int>>`` of a text, by position; a text of 1 to k - 1 code points is one gram."""

    def of(units: Column) -> Column:
        n = F.floor(F.length(units) / 4).cast("int")
        grams = F.greatest(n - k + 1, F.least(n, F.lit(1)))
        windows = F.greatest(grams - window + 1, F.least(grams, F.lit(1)))

        def stretch(s: Column) -> Column:
            here = F.substring(units, s * (4 * STRETCH) + 1, F.lit(4 * (STRETCH + window + k - 2)))
            count = F.least(grams - s * STRETCH, F.lit(STRETCH + window - 1))

            def chosen(u: Column) -> Column:
                # a reversed place makes the rightmost of equal hashes the least
                packed = F.transform(F.sequence(F.lit(0), count - 1), lambda i: _hash(u, i, k).bitwiseAND(F.lit(~_PLACE)).bitwiseOR((F.lit(_PLACE) - i).cast("long")))
                fresh = F.array_distinct(least_of_windows(packed, window))  # in order; several windows may choose one gram
                places = F.transform(fresh, lambda x: (F.lit(_PLACE) - x.bitwiseAND(F.lit(_PLACE))).cast("int"))
                return F.transform(places, lambda i: F.struct(_hash(u, i, k).alias("h"), (i + s * STRETCH).alias("p")))

            return _bind(here, chosen)

        every = F.flatten(F.transform(F.sequence(F.lit(0), F.floor((windows - 1) / STRETCH).cast("int")), stretch))
        every = _bind(every, lambda v: F.filter(v, lambda x, i: (i == 0) | (x["p"] != F.get(v, i - 1)["p"])))
        return _bind(every, lambda v: F.struct(F.transform(v, lambda x: x["h"]).alias("hashes"), F.transform(v, lambda x: x["p"]).alias("positions")))

    none = F.struct(F.array().cast("array<long>").alias("hashes"), F.array().cast("array<int>").alias("positions"))
    text = F.coalesce(text, F.lit(""))
    return F.when(text == "", none).otherwise(_bind(F.encode(text, "UTF-32"), of))


def fingerprint(text: Column, k: int = K, window: int = WINDOW) -> Column:
    """``array<struct<hash long, position int>>`` of a text, in order of position.

    Null and empty texts have none; equal texts have equal ones; a text of any length is taken whole.
    """
    return _bind(marks(text, k, window), lambda m: F.transform(m["hashes"], lambda h, i: F.struct(h.alias("hash"), F.get(m["positions"], i).alias("position"))))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard index of two arrays' sets; 1 if both are empty."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def _digest(m: Column) -> Column:
    """32 hex digits that stand for hashes and positions."""
    return F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(seed), m["hashes"], m["positions"])), 16, "0") for seed in (1, 2)])


def _spliced(own: Column, tail: Column, start: Column) -> Column:
    """Marks of an edited text: the text's own as long as its windows are unchanged, then those from ``start`` on.

    ``start`` is the last window that lies in the unchanged part; what ``tail`` chooses first is the last that may be in both.
    """

    def joined(moved: Column) -> Column:
        same = _bind(F.get(moved, F.lit(0)), lambda first: F.size(F.filter(own["positions"], lambda p: p < first)))
        same = F.when((start > 0) & (F.size(moved) > 0), same).otherwise(0)
        return _bind(same, lambda n: F.struct(*[F.concat(F.slice(own[c], F.lit(1), n), x).alias(c) for c, x in (("hashes", tail["hashes"]), ("positions", moved))]))

    return _bind(F.transform(tail["positions"], lambda p: p + start), joined)


def with_next(docs: DataFrame, id_col: str, carried: dict[str, str], parts: int, derived: dict[str, Column]) -> DataFrame:
    """``docs`` with ``derived`` columns, and ``next_<name>`` for each carried column: its value in the next row by descending id.

    After the last row comes the first. Rows are dealt by id ranges once; the highest row of a range also goes, as a
    guest, to the range above, whose lowest row needs it, and the highest of all to the lowest range. The bounds are
    ids that occur (quantiles), one for each of ``parts``, in one constant. Derived columns are computed after the
    exchange, so it doesn't move them. A null id counts as the lowest; rows of one id stand in the order of the
    carried columns that ``docs`` has.
    """
    key = F.coalesce(F.col(id_col), F.lit(-(2**63)))
    quantiles = [i / parts for i in range(1, parts)] or [0.5]
    found = docs.agg(F.percentile_approx(key, quantiles, max(10000, 4 * parts)).alias("at"), F.max(key).alias("top")).first()
    bounds = sorted({*(found.at or []), *([] if found.top is None else [found.top])}) or [0]  # at most one a part
    side = max(1, int(len(bounds) ** 0.5))
    longs = lambda x: (F.split(F.lit(",".join(map(str, x))), ",") if x else F.array()).cast("array<long>")
    below = lambda x: F.size(F.filter(x, lambda b: b < key))
    rows = docs.withColumn("_block", below(longs(bounds[side - 1 : len(bounds) - 1 : side])))  # in two levels: a block, a bound in it
    rows = rows.withColumn("_part", F.col("_block") * side + below(F.slice(longs(bounds), F.col("_block") * side + 1, F.lit(side))))
    guest_at = F.when(F.col("_part") == len(bounds) - 1, 0).otherwise(F.col("_part") + 1)
    goes = F.when(F.get(longs(bounds), F.col("_part")) == key, F.array("_part", guest_at)).otherwise(F.array("_part"))
    rows = rows.select(*docs.columns, F.posexplode(goes).alias("_guest", "_part"))
    rows = rows.repartition(parts, "_part").select("*", *[x.alias(c) for c, x in derived.items()])
    here = W.partitionBy("_part").orderBy("_guest", key.desc(), *[c for c in carried.values() if c in docs.columns])
    rows = rows.select("*", *[F.lead(c).over(here).alias(f"next_{name}") for name, c in carried.items()])
    return rows.filter("_guest = 0").drop("_guest", "_part")


def compare(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, window: int = WINDOW, parts: int | None = None) -> DataFrame:
    """Each text's fingerprint against that of its edited form and of the next text.

    Edited: the last floor(n/3) code points give way to the first as many (or all) of the next text. Returns a row
    for each row: ``id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint`` (digests of all hashes and
    positions), ``near_edited, near_next, n_marks``. ``fingerprint()`` has the hashes and positions themselves.
    Windows that the edit leaves alone are not computed again.

    Cases: null text is empty; an empty text has an empty fingerprint, and two empty ones are alike (1); a text of 1
    to k - 1 code points has one gram; null ids come last, repeated rows follow one another; one row alone is its own
    next; very long texts are taken whole, in stretches; an empty table gives no rows; other columns are ignored,
    whatever their names.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = with_next(rows, "id", {"text": "text", "hashes": "own.hashes"}, parts or buckets(spark), {"own": marks(F.col("text"), k, window)})
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    start = F.greatest(n - cut - k - window + 1, F.lit(0))
    edited = F.concat(F.substr("text", F.lit(1), n - cut), F.substr("next_text", F.lit(1), cut))
    rows = rows.select("id", "own", "next_hashes", n.cast("long").alias("n_chars"), edited.alias("edited"), start.alias("start"))
    tail = marks(F.substring("edited", F.col("start") + 1, F.length("edited")), k, window)
    rows = rows.select("id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.struct("own", "next_hashes", _bind(tail, lambda t: _spliced(F.col("own"), t, F.col("start"))).alias("edited")).alias("m"))

    def results(m: Column) -> Column:
        return F.struct(_digest(m["own"]).alias("fingerprint"), _digest(m["edited"]).alias("edited_fingerprint"), likeness(m["own"]["hashes"], m["edited"]["hashes"]).alias("near_edited"), likeness(m["own"]["hashes"], m["next_hashes"]).alias("near_next"), F.size(m["own"]["hashes"]).cast("long").alias("n_marks"))

    return rows.select(F.col("id").alias(id_col), "n_chars", "edited_sha256", F.inline(F.transform(F.array("m"), results)))
