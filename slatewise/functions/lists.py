"""List-column expressions: every function takes and returns Columns, nothing is exploded."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def field(name: str):
    """Lambda picking a struct field, for ``transform``."""
    return lambda row: row[name]


def tagged(tag: str):
    """Lambda wrapping an element as (list, pos, id), for exploding several lists together."""
    return lambda x, i: F.struct(F.lit(tag).alias("list"), i.alias("pos"), x.alias("id"))


def contains(values: Column | str, item: Column) -> Column:
    """Two-valued membership: a null list, or a list holding nulls, is simply "not found"."""
    return F.coalesce(F.array_contains(_c(values), item), F.lit(False))


def click_labels(inview: Column | str, clicked: Column | str) -> Column:
    """1/0 per in-view element; null clicks give all zeros."""
    return F.transform(_c(inview), lambda x: contains(clicked, x).cast("int"))


def without(inview: Column | str, clicked: Column | str) -> Column:
    """In-view elements that were not clicked, order and duplicates kept."""
    return F.filter(_c(inview), lambda x: ~contains(clicked, x))


def tail(values: Column | str, n: int) -> Column:
    """Last ``n`` elements; shorter lists stay whole, null stays null."""
    c = _c(values)
    keep = F.least(F.lit(n), F.size(c))
    return F.when(F.size(c) > 0, F.slice(c, F.negate(keep), keep)).otherwise(c)


def truncate(values: Column | str, n: int, padding: Column | None = None) -> Column:
    """Last ``n`` elements, left-padded to exactly ``n`` when ``padding`` is given."""
    if padding is None:
        return tail(values, n)
    padded = F.concat(F.array_repeat(padding, n), _c(values))
    return F.slice(padded, -n, n)


def keep_in(values: Column | str, ids: Column) -> Column:
    """Elements found in the array ``ids``; an emptied list becomes null."""
    kept = F.filter(_c(values), lambda x: contains(ids, x))
    return F.when(F.size(kept) > 0, kept)


def drop_nulls(values: Column | str) -> Column:
    return F.array_compact(_c(values))


def distinct_sorted(values: Column | str) -> Column:
    return F.array_sort(F.array_distinct(_c(values)))


def stable_shuffle(values: Column | str, seed: int, key: Sequence[Column | str]) -> Column:
    """Permute each list by a hash of (seed, row key, slot): same result under any partitioning."""
    keys = [_c(k) for k in key]
    tagged = F.transform(
        _c(values),
        lambda x, i: F.struct(F.xxhash64(F.lit(seed), *keys, i).alias("h"), i.alias("i"), x.alias("v")),
    )
    return F.transform(F.array_sort(tagged), lambda s: s["v"])


def sample(values: Column | str, n: int, seed: int, key: Sequence[Column | str],
           replace: bool = False) -> Column:
    """``n`` random elements per list, repeatable per row key; an empty list gives nulls.

    Without replacement a list shorter than ``n`` (but not empty) raises.
    """
    c = _c(values)
    nulls = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.try_element_at(c, i + F.size(c)))
    if n == 0:
        return F.slice(c, 1, 0)
    if replace:
        keys = [_c(k) for k in key]
        drawn = F.transform(
            F.sequence(F.lit(1), F.lit(n)),
            lambda i: F.element_at(c, (F.pmod(F.xxhash64(F.lit(seed), *keys, i), F.size(c)) + 1).cast("int")),
        )
    else:
        short = F.raise_error(F.lit("sample size exceeds the list length without replacement"))
        drawn = F.when(F.size(c) >= n, F.slice(stable_shuffle(c, seed, key), 1, n)).otherwise(short)
    return F.when(F.size(c) == 0, nulls).otherwise(drawn)


def mean(values: Column | str) -> Column:
    """Mean of the non-null elements; null for empty or null lists."""
    kept = F.array_compact(_c(values))
    total = F.aggregate(kept, F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return F.try_divide(total, F.size(kept).cast("double"))


def length(values: Column | str) -> Column:
    """List length with null counted as 0."""
    return F.coalesce(F.size(_c(values)), F.lit(0))


def linear_decay(n: Column, ascending: bool = True) -> Column:
    """Weights 1/n, 2/n, ..., 1 (reversed when descending)."""
    steps = F.sequence(F.lit(1), n)
    weights = F.transform(steps, lambda i: i.cast("double") / n.cast("double"))
    weights = weights if ascending else F.reverse(weights)
    return F.when(n > 0, weights).otherwise(F.array().cast("array<double>"))


def exponential_decay(factor: float = 0.5):
    """Builder of weights factor^(n-1), ..., factor, 1 for a list length ``n``."""

    def build(n: Column, ascending: bool = True) -> Column:
        steps = F.sequence(F.lit(1), n)
        weights = F.transform(steps, lambda i: F.pow(F.lit(factor), (n - i).cast("double")))
        weights = weights if ascending else F.reverse(weights)
        return F.when(n > 0, weights).otherwise(F.array().cast("array<double>"))

    return build


def decay_weights(values: Column | str, decay=linear_decay, ascending: bool = True) -> Column:
    """One weight per element from a ``Column -> Column`` decay builder; a null list gives []."""
    return decay(length(values), ascending)


def weight_nested(values: Column | str, weights: Column | str, fill: float | None = None) -> Column:
    """Scale the i-th inner list by the i-th weight; a null inner list becomes ``[fill]``."""
    filled = F.array(F.lit(fill).cast("double"))

    def scaled(v, k):
        return F.transform(F.coalesce(v, filled), lambda x: F.coalesce(x.cast("double") * k, F.lit(fill)))

    return F.zip_with(_c(values), _c(weights), scaled)


def chunks(values: Column | str, n: int) -> Column:
    """Sublists of ``n`` elements, the last possibly shorter."""
    c = _c(values)
    starts = F.sequence(F.lit(0), F.size(c) - 1, F.lit(n))
    # slice bounds are safe for the last chunk: slice stops at the end of the list
    cut = F.transform(starts, lambda i: F.slice(c, i + 1, F.lit(n)))
    return F.when(F.size(c) > 0, cut).otherwise(F.slice(F.array(c), 1, 0))


def threshold(scores: Column | str, cut: float = 0.5) -> Column:
    """1 where the score reaches the cut, else 0."""
    return F.transform(_c(scores), lambda p: (p >= F.lit(cut)).cast("int"))


def rank_by_score(scores: Column | str) -> Column:
    """Rank per slot, 1 = highest; of equal scores the later slot ranks first."""
    c = _c(scores)
    tagged = F.transform(c, lambda s, i: F.struct(s.alias("s"), i.alias("i")))
    best_first = F.reverse(F.array_sort(tagged))
    placed = F.transform(best_first, lambda t, r: F.struct(t["i"].alias("i"), (r + 1).alias("r")))
    return F.transform(F.array_sort(placed), lambda t: t["r"])


def map_values(values: Column | str, lookup: Column, fill: Column | None = None,
               drop_unknown: bool = False) -> Column:
    """Replace ids through a small literal map; unknown ids become null, ``fill`` or vanish."""
    c = _c(values)
    if drop_unknown:
        kept = F.array_compact(F.transform(c, lambda x: F.try_element_at(lookup, x)))
        return F.when(F.size(kept) > 0, kept)
    found = F.coalesce(c, F.array(F.lit(None)).cast("array<long>"))
    mapped = F.transform(found, lambda x: F.when(x.isNotNull(), F.try_element_at(lookup, x)))
    return mapped if fill is None else F.transform(mapped, lambda v: F.coalesce(v, fill))


def text(values: Column | str, sep: str = ",", null: str | None = None) -> Column:
    """Elements cast to string and joined."""
    return F.array_join(_c(values).cast("array<string>"), sep, null)
