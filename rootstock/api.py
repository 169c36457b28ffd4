"""Feature computation for a target DataFrame."""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, fields, replace
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rootstock.functions.keys import fresh, target_key_text
from rootstock.functions.primitives import Primitive, get_primitive
from rootstock.operators.transforms import RdbTransform
from rootstock.plans.compile import CUT, Compiler
from rootstock.plans.enumerate import Rules, target_features
from rootstock.plans.nodes import Aggregate, Direct, Feature, counts
from rootstock.rdb import Rdb, as_spark
from rootstock.schema import RESERVED, ColumnType

log = logging.getLogger(__name__)
# Default primitives.
DEFAULT_PRIMITIVES = ("max", "min", "mean", "std", "count", "mode")


@dataclass(frozen=True)
class FeatureConfig:
    """Settings of a computation.

    engine: range (cutoffs joined with all earlier rows), window (running aggregates wherever an aggregate allows
    it), auto (range, but window for keys with more than hot_rows children, which one job per edge counts) or a registered name.  include_entities / ignore_entities restrict the tables that paths may enter.
    max_features below 0 means all.  row_id names a column to be added that numbers the target's rows in their order, so that
    results can be put back in it.  engine_path, chunk_size, n_jobs and concat_chunk_size are accepted
    and have no use here, which a warning says: nothing is staged, and Spark sets the parallelism.
    """

    agg_primitives: Sequence[str | Primitive] = DEFAULT_PRIMITIVES
    max_depth: int = 2
    use_cutoff_time: bool = True
    engine: str = "auto"
    engine_path: str | None = None
    max_features: int = -1
    include_entities: Sequence[str] | None = None
    ignore_entities: Sequence[str] | None = None
    chunk_size: int | None = None
    n_jobs: int = 1
    concat_chunk_size: int = 512
    multi_hop: bool = False
    multi_hop_with_cutoff: bool = False
    zero_nested_counts: bool = False
    check_unique_keys: bool = False
    hot_rows: int = 10_000
    row_id: str | None = None

    def with_overrides(self, overrides: Mapping[str, Any] | None) -> FeatureConfig:
        known = {f.name for f in fields(self)}
        if unknown := set(overrides or {}) - known:
            raise ValueError(f"unknown settings {sorted(unknown)}: there are {sorted(known)}")
        return replace(self, **(overrides or {}))


Engine = Callable[[Rdb, FeatureConfig], Compiler]
_ENGINES: dict[str, Engine] = {}


def feature_engine(name: str) -> Callable[[Engine], Engine]:
    """Registers a physical strategy: a function of (rdb, config) that gives a Compiler."""

    def add(make: Engine) -> Engine:
        _ENGINES[name] = make
        return make

    return add


def get_engine(name: str) -> Engine:
    if name not in _ENGINES:
        raise ValueError(f"unknown engine {name!r}: there are {sorted(_ENGINES)}")
    return _ENGINES[name]


def _strategy(name: str) -> Engine:
    return lambda rdb, config: Compiler(rdb, name, config.zero_nested_counts, config.multi_hop_with_cutoff, hot_rows=config.hot_rows)


for _name in ("auto", "range", "window"):
    feature_engine(_name)(_strategy(_name))


def plan_features(rdb: Rdb, key_mappings: Mapping[str, str], config: FeatureConfig | None = None, cutoff: bool = False) -> dict[str, tuple[str, Feature]]:
    """Output name -> (target column, feature tree); no Spark job."""
    config = config or FeatureConfig()
    primitives = list(dict.fromkeys(p if isinstance(p, Primitive) else get_primitive(p) for p in config.agg_primitives))
    include = None if config.include_entities is None else frozenset(config.include_entities)
    rules = Rules(primitives, config.multi_hop, include, frozenset(config.ignore_entities or ()))
    arrays = {n: frozenset(f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)) for n, df in rdb.tables.items()}
    found = target_features(rdb.metadata, dict(key_mappings), config.max_depth, rules, config.max_features, arrays)
    if cutoff and not config.multi_hop_with_cutoff and (lost := [n for n, (_, f) in found.items() if _hops(f) > 1]):
        log.warning("multi-hop features are left out under cutoffs: %s", lost)
        found = {n: x for n, x in found.items() if n not in lost}
    return found


def _hops(f: Feature) -> int:
    most = 0
    while f is not None and isinstance(f, (Direct, Aggregate)):
        most = max(most, len(f.edges) if isinstance(f, Aggregate) else 0)
        f = f.base
    return most


def compute_features(
    rdb: Rdb,
    target: DataFrame | pd.DataFrame,
    key_mappings: Mapping[str, str],
    cutoff_time_column: str | None = None,
    config: FeatureConfig | None = None,
    config_overrides: Mapping[str, Any] | None = None,
) -> DataFrame:
    """The target with a column per feature; its own rows and columns stay as they are, complex types included.

    key_mappings: target column -> "table.primary_key".  With a cutoff column, every timed table on a path
    only shows rows strictly before the row's cutoff.  Target rows without key or cutoff get NULLs and counts of 0;
    so do those whose key isn't found.  Row order isn't defined; the setting row_id keeps it in a column.
    """
    config = (config or FeatureConfig()).with_overrides(config_overrides)
    if idle := [n for n in ("engine_path", "chunk_size", "n_jobs", "concat_chunk_size") if getattr(config, n) != getattr(FeatureConfig, n)]:
        log.warning("settings %s have no use here", idle)
    target = as_spark(target)
    if config.row_id:
        if config.row_id in target.columns:
            raise ValueError(f"column {config.row_id} exists in the target")
        target = target.withColumn(config.row_id, F.monotonically_increasing_id())
    _check(rdb, target, key_mappings, cutoff_time_column)
    rdb = rdb.canonicalize_key_types()
    rdb.validate_key_consistency()
    cut = bool(config.use_cutoff_time and cutoff_time_column)
    features = plan_features(rdb, key_mappings, config, cut)
    if not features:
        log.warning("no features for %s", dict(key_mappings))
        return target
    if clash := {c.lower() for c in target.columns} & {n.lower() for n in features}:
        raise ValueError(f"target columns {sorted(clash)} are named like features")
    compiler = get_engine(config.engine)(rdb, config)
    if config.check_unique_keys:
        _unique(rdb, key_mappings)
    out, names = target, {}
    for i, (column, mapped) in enumerate(key_mappings.items()):
        mine = {n: f for n, (c, f) in features.items() if c == column}
        if not mine:
            continue
        key, moment = fresh(f"__k{i}", target), fresh(f"__cut{i}", target)
        out = out.withColumn(key, target_key_text(F.col(f"`{column}`"), target.schema[column].dataType))
        if cut:
            out = out.withColumn(moment, _moment(cutoff_time_column, target))
        wanted = [key, moment] if cut else [key]
        keys = out.select(F.col(key).alias("k"), *([F.col(moment).alias(CUT)] if cut else [])).where(" and ".join(["k is not null", *([f"{CUT} is not null"] if cut else [])])).distinct()
        found, columns = compiler.for_keys(keys, mapped.rpartition(".")[0], list(mine.values()), cut)
        values = [F.col(c).alias(f"__f{i}_{j}") for j, c in enumerate(columns)]
        found = found.select(F.col("k").alias(key), *([F.col(CUT).alias(moment)] if cut else []), *values)
        out = out.join(found, wanted, "left").drop(*wanted)
        names |= {n: (f"__f{i}_{j}", counts(f)) for j, (n, f) in enumerate(mine.items())}
    result = [F.coalesce(F.col(c), F.lit(0)).alias(n) if zero else F.col(c).alias(n) for n, (c, zero) in ((n, names[n]) for n in features)]
    return out.select(*[F.col(f"`{c}`") for c in target.columns], *result)


def _moment(column: str, target: DataFrame):
    kind = target.schema[column].dataType
    c = F.col(f"`{column}`")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return c.cast("timestamp_ntz")
    if isinstance(kind, T.StringType):
        bad = F.raise_error(F.concat(F.lit("cutoff is no timestamp: "), c)).cast("timestamp_ntz")
        t = c.try_cast("timestamp_ntz")
        return F.when(c.isNull(), F.lit(None).cast("timestamp_ntz")).when(t.isNull(), bad).otherwise(t)
    raise ValueError(f"cutoff column {column} is {kind.simpleString()}, not a timestamp")


def _check(rdb: Rdb, target: DataFrame, mappings: Mapping[str, str], cutoff: str | None) -> None:
    if not mappings:
        raise ValueError("no key mappings")
    if taken := [c for c in target.columns if c in RESERVED]:
        raise ValueError(f"target columns {taken} have reserved names")
    for column, mapped in mappings.items():
        table, dot, key = mapped.rpartition(".")
        if not dot:
            raise ValueError(f"key mapping {mapped!r} must be table.primary_key")
        if column not in target.columns:
            raise ValueError(f"key column {column} not found in the target")
        if table not in rdb.table_names:
            raise ValueError(f"table {table} of key mapping {mapped} not found")
        if rdb.get_table_metadata(table).primary_key != key:
            raise ValueError(f"{mapped} is not the primary key of {table}")
    if cutoff is not None and cutoff not in target.columns:
        raise ValueError(f"cutoff column {cutoff} not found in the target")
    for t in rdb.metadata.tables:
        if bad := [c.name for c in t.columns if c.dtype in (ColumnType.PRIMARY_KEY, ColumnType.FOREIGN_KEY) and c.name not in rdb.get_table(t.name).columns]:
            raise ValueError(f"key columns {bad} are missing from table {t.name}")


def _unique(rdb: Rdb, mappings: Mapping[str, str]) -> None:
    """One counting job per parent table; off by default because it scans them."""
    parents = {m.rpartition(".")[0] for m in mappings.values()} | {r.parent_table for r in rdb.get_relationships() if r.parent_table in rdb.table_names}
    for t in sorted(parents):
        pk = rdb.get_table_metadata(t).primary_key
        if pk and rdb.get_table(t).where(F.col(f"`{pk}`").isNotNull()).groupBy(f"`{pk}`").count().where("count > 1").limit(1).count():
            raise ValueError(f"primary key {t}.{pk} repeats")


@dataclass(frozen=True)
class FeaturePipeline:
    """A transform of the tables followed by feature computation."""

    transform_pipeline: RdbTransform | None = None
    config: FeatureConfig = FeatureConfig()

    def compute_features(self, rdb: Rdb, target: DataFrame | pd.DataFrame, key_mappings: Mapping[str, str], cutoff_time_column: str | None = None, config_overrides: Mapping[str, Any] | None = None) -> DataFrame:
        changed = self.transform_pipeline(rdb) if self.transform_pipeline else rdb
        return compute_features(changed, target, key_mappings, cutoff_time_column, self.config, config_overrides)

    run = compute_features
