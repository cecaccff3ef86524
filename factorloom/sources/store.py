"""Tables and models as Parquet under one root, local or any file system that Spark reads."""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import TABLES

KEPT = 2  # versions that stay: readers of the one before go on undisturbed


class Store:
    """``<root>/tables/<name>`` and ``<root>/model`` hold versions, and pointer files that name them.

    A pointer file is ``pointer-<number>``, renamed into place once the version is whole; the largest number is valid.
    Nothing is removed before that, so a crash at any step leaves the old version or the new one. A table may be
    kept in parts by a key, each a folder of its own: then a pointer lists them, and a change writes the parts it touches.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, *parts: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def _fs(self):
        return self._path().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, *parts: str) -> list[str]:
        fs, path = self._fs(), self._path(*parts)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def _read_text(self, *parts: str) -> str | None:
        path = self._path(*parts)
        if not self._fs().exists(path):
            return None
        rows = self.spark.read.text(path.toString(), wholetext=True).collect()
        return rows[0][0] if rows else None

    def _write_text(self, text: str, *parts: str) -> None:
        fs, new = self._fs(), self._path(*parts[:-1], f".{parts[-1]}-{uuid.uuid4().hex}")
        out = fs.create(new, True)
        out.write(bytearray(text.encode()))
        out.close()
        if not fs.rename(new, self._path(*parts)):
            raise OSError(f"{'/'.join(parts)} was written by another session meanwhile")

    def _delete(self, *parts: str) -> None:
        self._fs().delete(self._path(*parts), True)

    # versions

    def _pointers(self, *place: str) -> list[str]:
        return [n for n in self._names(*place) if n.startswith("pointer-")]

    def _current(self, *place: str) -> dict[str, Any] | None:
        """What the valid pointer says, None if nothing was ever stored; versions without a pointer are an error."""
        pointers = self._pointers(*place)
        if pointers:
            return json.loads(self._read_text(*place, pointers[-1]))
        if [n for n in self._names(*place) if not n.startswith(".")]:
            raise OSError(f"{'/'.join((self.root, *place))} has data but no pointer to it")
        return None

    def _publish(self, content: dict[str, Any], *place: str) -> None:
        """Make a whole version the valid one, then remove what only older ones than the ``KEPT`` last use."""
        pointers = self._pointers(*place)
        number = int(pointers[-1].rpartition("-")[2]) + 1 if pointers else 0
        self._write_text(json.dumps(content), *place, f"pointer-{number:012d}")
        gone, used = [*pointers, None][:-KEPT], {f for p in self._pointers(*place)[-KEPT:] for f in json.loads(self._read_text(*place, p))["folders"]}
        for pointer in gone:
            for folder in set(json.loads(self._read_text(*place, pointer))["folders"]) - used:
                self._delete(*place, folder)
            self._delete(*place, pointer)

    # tables

    def save(self, name: str, df: DataFrame) -> DataFrame:
        """A new version of a table; the pointer moves once it is whole."""
        new = uuid.uuid4().hex
        df.write.parquet(f"{self.root}/tables/{name}/{new}")
        self._publish({"folders": [new]}, "tables", name)
        return self.load(name)

    def load(self, name: str) -> DataFrame:
        """The table, or an empty one of its schema if it was never stored."""
        now = self._current("tables", name)
        if now is None:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.parquet(*[f"{self.root}/tables/{name}/{f}" for f in now["folders"]])

    def change(self, name: str, by: str, news: DataFrame, apply, parts: int = 64) -> None:
        """Replace the table by ``apply(table, news)``, where rows of ``news`` concern only rows of equal ``by``.

        The table is kept in ``parts`` by a hash of ``by``; only the parts that ``news`` touches are read and written.
        A table that was stored whole is cut into parts first.
        """
        part = F.pmod(F.xxhash64(F.col(by).cast("long")), F.lit(parts)).cast("int")
        now = self._current("tables", name)
        if now is None:
            return
        folders = now["folders"]
        if now.get("by") != [by, parts]:
            folders = self._write_parts(name, self.load(name), part, range(parts))
        touched = sorted(r[0] for r in news.select(part.alias("p")).distinct().collect())  # numbers of parts
        if touched:
            old = self.spark.read.parquet(*[f"{self.root}/tables/{name}/{folders[p]}" for p in touched])
            for p, folder in zip(touched, self._write_parts(name, apply(old, news), part, touched)):
                folders = [*folders[:p], folder, *folders[p + 1 :]]
        self._publish({"folders": folders, "by": [by, parts]}, "tables", name)

    def _write_parts(self, name: str, df: DataFrame, part, numbers) -> list[str]:
        """One folder for each part: a single write, and empty ones for parts without rows."""
        new, columns = uuid.uuid4().hex, df.columns
        df.select("*", part.alias("_part")).repartition("_part").write.partitionBy("_part").parquet(f"{self.root}/tables/{name}/{new}")
        there, out = set(self._names("tables", name, new)), []
        empty = df.limit(0).select(*columns)
        for p in numbers:
            folder = f"{new}/_part={p}"
            if f"_part={p}" not in there:
                empty.write.parquet(f"{self.root}/tables/{name}/{folder}")
            out.append(folder)
        return out

    def wipe(self) -> None:
        self._delete("tables")
        self._delete("model")

    # models

    def save_model(self, users: DataFrame, items: DataFrame, info: dict[str, Any]) -> None:
        """Factors (``id, features`` and, for SGD, ``bias``) and what is known of them; readers see the old or the new model."""
        new = uuid.uuid4().hex
        for name, df in (("users", users), ("items", items)):
            df.repartitionByRange("id").sortWithinPartitions("id").write.parquet(f"{self.root}/model/{new}/{name}")
        self._publish({"folders": [new], "info": info}, "model")

    def model_info(self) -> dict[str, Any] | None:
        now = self._current("model")
        return now["info"] if now else None

    def load_model(self) -> tuple[DataFrame, DataFrame, dict[str, Any]] | None:
        now = self._current("model")
        if now is None:
            return None
        users, items = (self.spark.read.parquet(f"{self.root}/model/{now['folders'][0]}/{n}") for n in ("users", "items"))
        return users, items, now["info"]

    def delete_model(self) -> None:
        self._delete("model")


def can_reuse(info: dict[str, Any] | None, alg: str, db_type: str, rank: int, double: bool, training: bool = True) -> bool:
    """A stored model serves if algorithm and kind of database agree and, for training on, rank and precision too."""
    if not info or info.get("alg") != alg or info.get("db_type") != db_type:
        return False
    return not training or (info.get("rank") == rank and info.get("double_precision") == double)
