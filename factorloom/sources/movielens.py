"""MovieLens 100k and 1m folders as users, items and ratings."""

from __future__ import annotations

import os
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.stats import dense_ids
from ..schema import UNASSIGNED

# File names, separators and columns of the two published data sets.
FORMATS = {
    "100k": {
        "users": ("u.user", "|", "user_id int, age int, gender string, occupation string, zip_code string"),
        "items": ("u.item", "|", "movie_id int, movie_title string, release_date string, video_release_date string, url string, unknown int, " + ", ".join(f"genre_{i} int" for i in range(18))),
        "ratings": ("u.data", "\t", "user_id int, item_id int, rating int, ts long"),
    },
    "1m": {
        "users": ("users.dat", "::", "user_id int, gender string, age int, occupation int, zip_code string"),
        "items": ("movies.dat", "::", "movie_id int, movie_title string, genres string"),
        "ratings": ("ratings.dat", "::", "user_id int, item_id int, rating int, ts long"),
    },
}


def local_folder(path: str, kind: str) -> str:
    """The data set's folder under ``path``: as it is, or unpacked from ``ml-<kind>.zip`` there. Nothing is downloaded."""
    folder = os.path.join(path, f"ml-{kind}")
    if not os.path.isdir(folder) and os.path.isfile(f"{folder}.zip"):
        with zipfile.ZipFile(f"{folder}.zip") as z:
            z.extractall(path)
    return folder if os.path.isdir(folder) else path


def _cyrillic(text: Column) -> Column:
    """windows-1251 text that was read byte by byte, since the CSV reader knows no such encoding."""
    high = bytes(b for b in range(128, 256) if b != 0x98)  # 0x98 stands for nothing
    return F.translate(text, high.decode("iso-8859-1"), high.decode("windows-1251"))


def _table(spark: SparkSession, path: str, kind: str, name: str, mode: str, more: str = "") -> DataFrame:
    file, sep, schema = FORMATS[kind][name]
    return spark.read.option("columnPruning", False).csv(f"{path}/{file}", schema=schema + more, sep=sep, encoding="iso-8859-1", quote="", mode=mode, columnNameOfCorruptRecord="_damaged")


def _any_value(kind: str, name: str) -> Column:
    """True, but reads all columns: Spark looks only at those that are asked for when it judges a line."""
    return F.concat_ws("", *[F.col(c.split()[0]).cast("string") for c in FORMATS[kind][name][2].split(", ")]) != "\x00"


def damaged(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """One row: the number of lines of ``users``, ``items`` and ``ratings`` that don't fit their columns; ``read`` leaves them out."""
    parts = [_table(spark, path, kind, n, "PERMISSIVE", ", _damaged string").select(*[(F.col("_damaged").isNotNull() & _any_value(kind, n) & F.lit(k == j)).cast("int").alias(m) for j, m in enumerate(FORMATS[kind])]) for k, n in enumerate(FORMATS[kind])]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).agg(*[F.coalesce(F.sum(n), F.lit(0)).cast("long").alias(n) for n in FORMATS[kind]])


def read(spark: SparkSession, path: str, kind: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(users, items, ratings) with the engine's ids: ``id, login, list_id``; ``id, name``; ``user_id, item_id, rating, dataset_type``.

    A user's ``list_id`` is dense, in the order of first appearance among the ratings, and null without any; ratings
    carry it as ``user_id``. Of a pair rated twice in the files, the line that comes first counts.
    """
    table = lambda name: _table(spark, path, kind, name, "DROPMALFORMED")  # noqa: E731  damaged() counts what this leaves out

    # a line's place: files of one folder are read in order, partitions in the order of their bytes
    raw = table("ratings").select("user_id", "item_id", F.col("rating").cast("short").alias("rating"), F.monotonically_increasing_id().alias("pos"))
    raw = raw.groupBy("user_id", "item_id").agg(F.min_by("rating", "pos").alias("rating"), F.min("pos").alias("pos"))
    ids = dense_ids(raw.select(F.col("user_id").alias("id"), "pos"))
    users = table("users").select(F.col("user_id").alias("id"), F.col("user_id").cast("string").alias("login")).join(ids, "id", "left")
    items = table("items").select(F.col("movie_id").alias("id"), _cyrillic(F.rtrim("movie_title")).alias("name"))
    ratings = raw.join(ids.withColumnRenamed("id", "user_id"), "user_id").select(F.col("list_id").alias("user_id"), "item_id", "rating", F.lit(UNASSIGNED).cast("short").alias("dataset_type"))
    return users, items, ratings


def counts(users: DataFrame, items: DataFrame, ratings: DataFrame) -> DataFrame:
    """One row: numbers of users, items and ratings."""
    parts = [df.select(*[F.lit(int(k == j)).alias(n) for j, n in enumerate(("n_users", "n_items", "n_ratings"))]) for k, df in enumerate((users, items, ratings))]
    both = parts[0].unionAll(parts[1]).unionAll(parts[2])
    return both.agg(*[F.coalesce(F.sum(n), F.lit(0)).cast("long").alias(n) for n in ("n_users", "n_items", "n_ratings")])
