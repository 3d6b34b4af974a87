"""Column names, table schemas and name checks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

IMPRESSION = "impression_id"
USER = "user_id"
TIME = "impression_time"
ARTICLE = "article_id"
INVIEW = "article_ids_inview"
CLICKED = "article_ids_clicked"
READ_TIME = "read_time"
SCROLL = "scroll_percentage"
LABELS = "labels"
POS = "pos"
LABEL = "label"
SCORE = "score"
KNOWN_USER = "is_known_user"
HISTORY_ARTICLES = "article_id_fixed"
HISTORY_TIMES = "impression_time_fixed"
HISTORY_READ_TIMES = "read_time_fixed"
HISTORY_SCROLLS = "scroll_percentage_fixed"


def require_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Return ``df`` unchanged, or raise ``ValueError`` naming the absent columns."""
    absent = sorted(set(names) - set(df.columns))
    if absent:
        raise ValueError(f"columns not found: {', '.join(absent)}")
    return df


def fresh_name(taken: Iterable[str], base: str = "new_column") -> str:
    """``base``, or ``base_1``, ``base_2``, ... - the first name not in ``taken``."""
    taken = set(taken)
    name, n = base, 0
    while name in taken:
        n += 1
        name = f"{base}_{n}"
    return name


def is_list_column(df: DataFrame, name: str) -> bool:
    """True when the column holds lists, decided from the schema alone."""
    return isinstance(df.schema[name].dataType, T.ArrayType)
