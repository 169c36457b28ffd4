"""Registry of aggregation primitives.

A primitive says which tags it takes, which it gives, and how it is computed.  Four kinds exist:
`column` builds one aggregate expression; `elements` builds one over each position of arrays; `histogram` is computed from (key, value) counts, which
combine map-side and keep a hot key's values apart; `rows` counts matched rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMERIC, CATEGORY, TEXT, ARRAY, ANY = "numeric", "category", "text", "array", "any"


@dataclass(frozen=True)
class Primitive:
    """build(value, time) -> aggregate; time is the child's time column or NULL.

    `window` marks those that running windows can compute under cutoffs; `share` is the share of a quantile, which is selected there by rank.
    """

    name: str
    takes: frozenset[str]
    gives: str
    build: Callable[[Column, Column], Column] | None = None
    kind: str = "column"
    window: bool = False
    numeric_cast: bool = True
    needs_time: bool = False
    share: float | None = None


_REGISTRY: dict[str, Primitive] = {}


def register_primitive(
    name: str, takes: str | set[str], gives: str, build: Callable[[Column, Column], Column] | None = None, **options
) -> Primitive:
    """Adds a primitive; `build` may return any aggregate Column, a grouped-aggregate pandas_udf included."""
    p = Primitive(name.lower(), frozenset({takes} if isinstance(takes, str) else takes), gives, build, **options)
    _REGISTRY[p.name] = p
    return p


def get_primitive(name: str) -> Primitive:
    """By name, any case; quantile_N for every N from 0 to 100 exists without registration."""
    key = name.lower()
    if key in _REGISTRY:
        return _REGISTRY[key]
    if key.startswith("quantile_") and key[9:].isdigit() and int(key[9:]) <= 100:
        share = int(key[9:]) / 100
        return register_primitive(key, NUMERIC, NUMERIC, lambda c, t: F.percentile(c, share), share=share)
    raise ValueError(f"unknown primitive {name!r}: there are {sorted(_REGISTRY)}")


def primitive_names() -> list[str]:
    return sorted(_REGISTRY)


def _last(c: Column, t: Column) -> Column:
    return F.max_by(c, F.struct(t, c))


def _first(c: Column, t: Column) -> Column:
    return F.min_by(c, F.struct(t, c))


register_primitive("count", ANY, NUMERIC, kind="rows", window=True)
register_primitive("mean", NUMERIC, NUMERIC, lambda c, t: F.avg(c), window=True)
register_primitive("sum", NUMERIC, NUMERIC, lambda c, t: F.sum(c), window=True)
register_primitive("max", NUMERIC, NUMERIC, lambda c, t: F.max(c), window=True, numeric_cast=False)
register_primitive("min", NUMERIC, NUMERIC, lambda c, t: F.min(c), window=True, numeric_cast=False)
register_primitive("std", NUMERIC, NUMERIC, lambda c, t: F.stddev_samp(c), window=True)
register_primitive("variance", NUMERIC, NUMERIC, lambda c, t: F.var_samp(c), window=True)
register_primitive("skewness", NUMERIC, NUMERIC, lambda c, t: F.skewness(c), window=True)
register_primitive("kurtosis", NUMERIC, NUMERIC, lambda c, t: F.kurtosis(c), window=True)
register_primitive("product", NUMERIC, NUMERIC, lambda c, t: F.product(c), window=True)
register_primitive("median", NUMERIC, NUMERIC, lambda c, t: F.median(c), share=0.5)
register_primitive("quantile_25", NUMERIC, NUMERIC, lambda c, t: F.percentile(c, 0.25), share=0.25)
register_primitive("quantile_75", NUMERIC, NUMERIC, lambda c, t: F.percentile(c, 0.75), share=0.75)
register_primitive("any_value", {NUMERIC, CATEGORY}, CATEGORY, lambda c, t: F.min(c), numeric_cast=False, window=True)
register_primitive("first", {NUMERIC, CATEGORY}, CATEGORY, _first, needs_time=True, numeric_cast=False, window=True)
register_primitive("last", {NUMERIC, CATEGORY}, CATEGORY, _last, needs_time=True, numeric_cast=False, window=True)
register_primitive("mode", CATEGORY, CATEGORY, kind="histogram", numeric_cast=False)
register_primitive("discrete_entropy", CATEGORY, NUMERIC, kind="histogram", numeric_cast=False)
register_primitive("nunique", {NUMERIC, CATEGORY}, NUMERIC, kind="histogram", numeric_cast=False)
register_primitive("num_unique", {NUMERIC, CATEGORY}, NUMERIC, kind="histogram", numeric_cast=False)
register_primitive("join", TEXT, TEXT, lambda c, t: F.array_join(F.array_sort(F.collect_list(c)), "\n"), numeric_cast=False)


# Arrays of one length, element by element: each position is aggregated by itself, so no task holds a group's arrays.
for _name, _how in {"arraymax": F.max, "arraymin": F.min, "arraymean": F.avg}.items():
    register_primitive(_name, ARRAY, ARRAY, lambda c, t, how=_how: how(c), kind="elements", numeric_cast=False)


def histogram_aggregate(name: str, value: Column, n: Column) -> Column:
    """Aggregates over the rows (value, n) of one key; rows whose value is NULL are of no account.

    mode: the most frequent value, the smallest among equals.  entropy in bits; NULL without values.
    """
    if name == "mode":
        return F.min_by(value, F.when(value.isNotNull(), F.struct(-n, value)))
    if name == "discrete_entropy":
        total = F.sum(n)
        h = F.log2(total) - F.sum(n * F.log2(n.cast("double"))) / total
        return F.when(F.count(value) > 0, F.when(F.count(value) == 1, F.lit(0.0)).otherwise(h))
    return F.count(value)
