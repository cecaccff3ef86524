r"""Line dedup by a log-template tree (operator 7). DataFrame functions only.

A line is cut into tokens at ``[\x20\x09-\x0D]+``; tokens with a digit are variable from the start. It goes down a
tree of fixed depth: by its number of tokens, then by its ``depth`` leading tokens. In the leaf the rest of the line
is cut into ``RUNS`` runs of tokens, equally long but for one. Lines of ``LONG`` tokens and more share one branch, as
a word more or less changes both their number and their places; their runs are the five tokens around the longest
token (of equally long ones the first) of each fifth of the line.

Lines of a leaf that have a run in common meet at the first of them, its head, in the order of an md5 of the masked
line. A line that meets one head by ``SHARE`` of its runs belongs to that head's template, where all that differs is
variable; of several heads it takes the first. So a line is compared with the heads of its runs, never with every
other, and the outcome doesn't depend on partitions. A template that recurs across ``min_docs`` documents (long ones:
``long_docs``) is boilerplate: its lines stay in the document of the smallest id that has it and go everywhere else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

MIN_DOCS, LONG_DOCS = 3, 2  # documents a template must be in; two are no chance for a long line
DEPTH = 1  # leading tokens on the way to a leaf
RUNS, SHARE = 5, 60  # runs of a line, and per cent of them at which a head must be met
LONG = 24  # tokens of a long line


def _bind(x: Column, f) -> Column:
    """``f(x)``, with x computed once."""
    return F.transform(F.array(x), lambda v: f(v))[0]


def masked(line: Column) -> Column:
    """Tokens of a line, those with a digit as ``<*>``."""
    tokens = F.array_remove(F.split(line, r"[\x20\x09-\x0D]+"), "")
    return F.when(line.rlike("[0-9]"), F.transform(tokens, lambda t: F.when(t.rlike("[0-9]"), "<*>").otherwise(t))).otherwise(tokens)


def place(tokens: Column, depth: int = DEPTH) -> Column:
    """``struct<n int, line long, need int, keys array<long>>`` of a line's masked tokens.

    ``line``: 60 bits of md5 that stand for the masked line; ``keys``: of leaf, number and content of each run;
    ``need``: runs by which a head must be met.
    """

    def of(t: Column) -> Column:
        n = F.size(t)
        rest = F.greatest(n - depth, F.lit(0))
        cut = lambda whole, j: F.floor(whole * j / RUNS).cast("int")
        line = F.conv(F.substring(F.md5(F.array_join(t, " ")), 1, 15), 16, 10).cast("long")
        path = F.xxhash64(n, F.slice(t, F.lit(1), F.lit(depth)))

        def short(j: Column) -> Column:
            a, b = cut(rest, j), cut(rest, j + 1)
            return F.when(a < b, F.xxhash64(path, j, F.slice(t, F.least(n, F.lit(depth)) + a + 1, b - a)))

        def long(lengths: Column) -> Column:
            def run(j: Column) -> Column:
                a, b = cut(n, j), cut(n, j + 1)
                best = _bind(F.slice(lengths, a + 1, b - a), lambda x: F.array_position(x, F.array_max(x)).cast("int"))
                return F.xxhash64(F.lit(-1), F.slice(t, F.greatest(a + best - 2, F.lit(1)), F.lit(5)))

            return F.transform(numbers, run)

        numbers = F.array(*map(F.lit, range(RUNS)))
        keys = F.when(n >= LONG, _bind(F.transform(t, lambda x: F.length(x)), long)).otherwise(F.filter(F.transform(numbers, short), lambda k: k.isNotNull()))
        return F.struct(n.alias("n"), line.alias("line"), F.ceil(F.when(n >= LONG, RUNS).otherwise(F.least(rest, F.lit(RUNS))) * SHARE / 100).cast("int").alias("need"), keys.alias("keys"))

    return _bind(tokens, of)


def grouped(spark: SparkSession, docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``id, text_hash, at, n, line, template`` of every line with tokens; a line that heads a template may be in a second one.

    ``docs``: ``id, text_hash, text``. ``template`` is the number of the head's masked line.
    """
    lines = docs.select("id", "text_hash", F.posexplode(F.split("text", "\n")).alias("at", "text"))
    lines = lines.select("id", "text_hash", "at", F.inline(F.array(place(masked(F.col("text")), depth)))).filter("n > 0")
    lines = materialize(spark, lines, "lines")
    runs = lines.select("line", "need", F.posexplode("keys").alias("run", "key"))
    # of each run's lines the first one, and whether there is another: sums that are combined before they are shuffled
    heads = runs.groupBy("key").agg(F.min("line").alias("head"), F.max("line").alias("last")).filter("head <> last").select("key", "head")
    met = runs.join(heads, "key").filter("line <> head")
    met = met.groupBy("line", "head").agg(F.bit_or(F.expr("shiftleft(1, run)")).alias("runs"), F.max("need").alias("need")).filter(F.bit_count("runs") >= F.col("need"))
    joins = materialize(spark, met.groupBy("line").agg(F.min("head").alias("head")), "templates")
    belongs = joins.select(F.col("line").alias("of"), F.col("head").alias("template")).unionByName(joins.select(F.col("head").alias("of"), F.col("head").alias("template")).distinct())
    out = lines.join(belongs, F.col("line") == F.col("of"), "left")
    return materialize(spark, out.select("id", "text_hash", "at", "n", "line", F.coalesce("template", "line").alias("template")), "grouped")


def common(lines: DataFrame, min_docs: int = MIN_DOCS, long_docs: int = LONG_DOCS) -> DataFrame:
    """``template, n_docs, first`` of the templates that recur, from ``grouped``; documents are counted in two steps."""
    per_doc = lines.filter("id is not null").groupBy("template", "id").agg(F.max("n").alias("n"))
    counts = per_doc.groupBy("template").agg(F.count("*").alias("n_docs"), F.min("id").alias("first"), F.max("n").alias("n"))
    return counts.filter(F.col("n_docs") >= F.when(F.col("n") >= LONG, long_docs).otherwise(min_docs)).drop("n")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))


def templates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, **how) -> DataFrame:
    """The recurring templates of ``docs``: ``template string, n_docs, first`` (the document that keeps it).

    Where lines of a template differ it has ``<*>``; of a long one, whose lines may differ in their number of tokens,
    those as long as its shortest count for this. Cases: as for ``dedup``.
    """
    rows = _rows(docs, id_col, text_col)
    lines = grouped(spark, rows, depth)
    found = lines.select("id", "text_hash", "at", "template", "n").join(common(lines, **how), "template")
    texts = rows.filter("id is not null").select("id", "text_hash", F.posexplode(F.split("text", "\n")).alias("at", "text"))
    words = found.join(texts, ["id", "text_hash", "at"])
    least = words.groupBy("template").agg(F.min("n").alias("least"))
    words = words.join(least, "template").filter("n = least").select("template", "n_docs", "first", F.posexplode(masked(F.col("text"))).alias("place", "token"))
    words = words.groupBy("template", "n_docs", "first", "place").agg(F.min("token").alias("a"), F.max("token").alias("b"))
    words = words.groupBy("template", "n_docs", "first").agg(F.array_sort(F.collect_list(F.struct("place", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise("<*>").alias("token")))).alias("tokens"))
    return words.select(F.array_join(F.col("tokens.token"), " ").alias("template"), "n_docs", "first")


def dedup(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, **how) -> DataFrame:
    """``docs`` with recurring lines dropped from the text, and ``n_lines, n_dropped`` (long).

    Lines are split at newlines and what is left is joined by them; nothing else of a text changes.

    Cases: null and empty texts stay as they are, with 0 and 1 lines; blank lines always stay; rows of one id are one
    document to the count; rows of a null id don't count and keep no first copy; an empty table gives no rows; texts
    and lines of any length are taken whole; other columns stay, but n_lines and n_dropped are replaced (names from
    __fl_ on are reserved); a document all of whose lines recur ends as "".
    """
    lines = grouped(spark, _rows(docs, id_col, text_col), depth)
    hits = lines.join(materialize(spark, common(lines, **how), "common"), "template").filter(F.col("id").isNull() | (F.col("id") != F.col("first")))
    drops = hits.groupBy("id", "text_hash").agg(F.array_sort(F.collect_set("at")).alias("at"))  # lines of one text
    drops = drops.select(F.col("id").alias("__fl_id"), F.col("text_hash").alias("__fl_hash"), F.col("at").alias("__fl_drop"))
    out = docs.join(drops.hint("shuffle_hash"), F.col(id_col).eqNullSafe(F.col("__fl_id")) & (F.xxhash64(text_col) == F.col("__fl_hash")), "left")
    lines = F.split(text_col, "\n")
    dropped = F.coalesce(F.size("__fl_drop"), F.lit(0)).cast("long")

    def kept(x: Column) -> Column:
        """What stands before, between and after the dropped lines."""
        drop = F.col("__fl_drop")
        before, after = lambda k: F.coalesce(F.get(drop, k - 1), F.lit(-1)), lambda k: F.coalesce(F.get(drop, k), F.size(x))
        return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(drop)), lambda k: F.slice(x, before(k) + 2, after(k) - before(k) - 1))), "\n")

    text = F.when(dropped > 0, _bind(lines, kept)).otherwise(F.col(text_col)).alias(text_col)
    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return out.select(*[text if c == text_col else F.col(c) for c in own], F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"), dropped.alias("n_dropped"))
