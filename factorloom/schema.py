"""Table schemas, dataset codes, rating scales and options of the engine."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import types as T


def _struct(*columns: tuple) -> T.StructType:
    return T.StructType([T.StructField(c[0], c[1], len(c) < 3 or c[2]) for c in columns])


_INT, _STR, _BOOL, _INTS = T.IntegerType(), T.StringType(), T.BooleanType(), T.ArrayType(T.IntegerType())

USERS = _struct(("id", _INT, False), ("login", _STR), ("list_id", _INT), ("ratings_count", _INT), ("avg_rating", T.DoubleType()), ("list_update_ts", T.TimestampNTZType()), ("most_rated_items_update_ts", T.TimestampNTZType()), ("list_check_ts", T.TimestampNTZType()), ("reg_date", T.DateType()), ("gender", _STR), ("are_ratings_modified", _BOOL), ("is_used_for_train", _BOOL), ("need_to_check_list", _BOOL), ("is_deleted", _BOOL))
ITEMS = _struct(("id", _INT, False), ("name", _STR), ("ratings_count", _INT), ("avg_rating", T.DoubleType()), ("genres", _INTS), ("franchise_id", _INT), ("type", _STR), ("recs_update_ts", T.TimestampNTZType()), ("recs_check_ts", T.TimestampNTZType()), ("are_ratings_modified", _BOOL), ("is_used_for_train", _BOOL), ("is_deleted", _BOOL))
RATINGS = _struct(("user_id", _INT, False), ("item_id", _INT, False), ("rating", T.ShortType()), ("dataset_type", T.ShortType()))
CHANGES = _struct(("user_id", _INT, False), ("item_id", _INT, False), ("rating", T.ShortType()))
USERS_EXTRA = _struct(("id", _INT, False), ("unrated_items", _INTS), ("fav_items", _INTS), ("most_rated_items", _INTS))
GENRES = _struct(("id", _INT, False), ("name", _STR))
ITEM_RELATIONS = _struct(("from_id", _INT, False), ("to_id", _INT, False), ("rel", _STR))
ITEM_RECOMMENDATIONS = _struct(("from_id", _INT, False), ("to_id", _INT, False), ("weight", _INT))
STATS = _struct(("key", _STR, False), ("val", _STR))
TABLES = {"users": USERS, "items": ITEMS, "ratings": RATINGS, "ratings_changes": CHANGES, "users_extra": USERS_EXTRA, "genres": GENRES, "items_rels": ITEM_RELATIONS, "items_recs": ITEM_RECOMMENDATIONS, "stats": STATS}

#: dataset_type of a rating: not assigned yet, the three sets, and ratings that came while a training was under way.
UNASSIGNED, TRAIN, VALIDATE, TEST, NEW = range(5)
ASSIGNED, FITTED = (TRAIN, VALIDATE, TEST), (TRAIN, VALIDATE)

#: Largest rating and least predicted rating worth recommending, by kind of database.
SCALES = {"ml": (5.0, 3.5), "mal": (10.0, 7.0)}


@dataclass(frozen=True)
class Options:
    """Everything that steers the engine; ``merged`` lays later settings over earlier ones."""

    db_type: str = "ml"
    max_rating: float | None = None
    min_recommend: float | None = None
    alg: str = "als"
    rank: int = 100
    iterations: int = 10
    split: tuple[int, int, int] = (85, 10, 5)
    user_reg: float = 0.05
    item_reg: float = 0.05
    first_factor_is_avg: bool = False
    learning_rate: float = 0.01
    sgd_regs: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0)  # user bias, item bias, user, item factors
    sgd_blocks: int | None = None  # by the number of ratings
    double_precision: bool = False
    train_all: bool = True
    train_sets: tuple[int, ...] = FITTED
    ratings_in_portion: int = 10_000
    threads: int = 8
    seed: int = 42
    limit: int = 20
    extra: dict[str, Any] = field(default_factory=dict)

    def merged(self, *layers: dict[str, Any]) -> Options:
        out = self
        for layer in layers:
            out = dataclasses.replace(out, **layer)
        return out

    @property
    def scale(self) -> tuple[float, float]:
        """(largest rating, least rating to recommend); an unknown kind of database needs ``max_rating``."""
        top, least = SCALES.get(self.db_type, (None, None))
        top = self.max_rating or top
        if top is None:
            raise ValueError(f"max_rating is needed for db_type {self.db_type!r}")
        return top, self.min_recommend or least or 0.7 * top
