"""Per-entity feature table from events: counts, recency and totals for each of hundreds of event types.

1. Events are spread once, by entity block and salt.  A block is a hash range of entities; blocks
   with more than `rows_per_group` events get as many salts, by a hash of the whole row, so that rows
   delivered twice still meet and are counted once.
2. Each (block, salt) becomes a compact state: per type, bit-sliced counters and totals over entity
   ordinals and the latest times aligned with the ordinals that have the type.
3. The states of a block are added by compressed bitmap carry addition, `FAN_IN` of them in a task: the many of a hot block
   in rounds, as a tree, so that no task has more than FAN_IN of them.
4. Each block's state is decoded to one row per entity.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from rootstock.functions import bitmaps
from rootstock.functions.keys import fresh
from rootstock.functions.skew import measured, small
from rootstock.functions.storage import keep

MAX_TYPES = 20_000
FAN_IN = 8
_EXACT = 2.0**52


def event_types(events: DataFrame, kind: Column) -> list[str]:
    """Sorted distinct types; refused beyond MAX_TYPES. NULL isn't a type."""
    found = [r[0] for r in events.select(kind.cast("string").alias("t")).where("t is not null").distinct().limit(MAX_TYPES + 1).collect()]
    if len(found) > MAX_TYPES:
        raise ValueError(f"more than {MAX_TYPES} event types")
    return sorted(found)


def entity_features(events: DataFrame, *, entity: str, time: str, value: str, kind: Column, types: list[str] | None = None, scale: int = 4, rows_per_group: int = 120_000, entities_per_batch: int = 512) -> DataFrame:
    """One row per entity: (entity, counts, latest, totals), arrays aligned with the sorted `types`.

    counts: bigint, 0 for a type the entity never had; latest: timestamp, NULL there; totals: double, the
    sum of values rounded to `scale` decimals, added exactly, 0.0 without any value.  Rows equal in all columns
    count once.  NULL, NaN and infinite values count as events without value; events without entity
    belong to none and are left out; events without type make their entity appear but count for no type; a NULL time
    never is the latest.  No events give no rows.
    """
    blocks = max(1, -(-events.count() // rows_per_group))
    key = events.schema[entity].dataType
    key_type = _arrow_type(key)
    block = F.pmod(F.xxhash64(F.col(f"`{entity}`")), F.lit(blocks)).cast("int")
    known = events.where(F.col(f"`{entity}`").isNotNull())
    at, salt, salts = (fresh(n, events) for n in ("__block", "__salt", "__salts"))
    sized = known.select(block.alias(at)).groupBy(at).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 2 * rows_per_group)
    sized = sized.select(at, F.ceil(F.col("n") / rows_per_group).cast("int").alias(salts))
    hot, size, most = *measured(sized), 0
    rows = known.withColumn(at, block)
    if hot:
        most = sized.agg(F.max(salts)).first()[0]
        rows = rows.join(F.broadcast(sized) if small(hot, size) else sized, at, "left")
        spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in known.columns]), F.coalesce(salts, F.lit(1))).cast("int")
        rows = rows.withColumn(salt, spread).drop(salts)
    # One exchange by block and salt: removing repeated rows and grouping both find their rows in place.
    place = [at, salt] if hot else [at]
    once = rows.repartition(*place).dropDuplicates()
    slim = once.select(*[F.col(p).alias(a) for p, a in zip(place, ("__block", "__salt"), strict=False)], F.col(f"`{entity}`").alias("e"), kind.cast("string").alias("k"), F.col(f"`{time}`").cast("timestamp_ntz").alias("t"), F.col(f"`{value}`").cast("double").alias("v"))
    state = "__block int, __salt int, state binary, types array<string>"

    def encode(group: pa.Table) -> pa.Table:
        packed, names = _encode(group, scale)
        number = group["__salt"][0].as_py() if hot else 0
        return pa.table({"__block": pa.array([group["__block"][0].as_py()], pa.int32()), "__salt": pa.array([number], pa.int32()), "state": pa.array([packed], pa.binary()), "types": pa.array([names], pa.list_(pa.string()))})

    # Kept: the types are read from the states before these are decoded, so events are read for them only once.
    states = keep(slim.groupBy("__block", *["__salt"] * (hot > 0)).applyInArrow(encode, state))
    if types is None:
        types = types_of(states)

    def merge(group: pa.Table) -> pa.Table:
        return pa.table({"__block": group["__block"][:1], "__salt": pa.array([group["__salt"][0].as_py() // FAN_IN], pa.int32()), "state": pa.array([_merged(group["state"], key_type).dump()], pa.binary()), "types": group["types"][:1]})

    while most > FAN_IN:
        states = states.groupBy("__block", F.floor(F.col("__salt") / FAN_IN).alias("__part")).applyInArrow(merge, state)
        most = -(-most // FAN_IN)
    out = T.StructType([T.StructField(entity, key), T.StructField("counts", T.ArrayType(T.LongType())), T.StructField("latest", T.ArrayType(T.TimestampNTZType())), T.StructField("totals", T.ArrayType(T.DoubleType()))])
    codes = {t: i for i, t in enumerate(types)}

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _merged((s for b in batches for s in b.column("state")), key_type).rows(entity, scale, entities_per_batch, codes)

    return states.select("__block", "state").groupBy("__block").applyInArrow(decode, out)


def types_of(states: DataFrame) -> list[str]:
    """Sorted distinct types of all states; refused beyond MAX_TYPES."""
    found = [r[0] for r in states.select(F.explode("types").alias("t")).distinct().limit(MAX_TYPES + 1).collect()]
    if len(found) > MAX_TYPES:
        raise ValueError(f"more than {MAX_TYPES} event types")
    return sorted(found)


def _merged(packed: Iterable[pa.BinaryScalar], key_type: pa.DataType) -> _State:
    return reduce(_State.plus, (_State.load(s.as_py(), key_type) for s in packed))


def as_columns(features: DataFrame, types: list[str], entity: str) -> DataFrame:
    """Wide form: n_<type>, last_<type>, sum_<type> columns. Only a projection of the arrays."""
    named = [(f"{p}_{t}", F.get(F.col(c), F.lit(i))) for i, t in enumerate(types) for p, c in (("n", "counts"), ("last", "latest"), ("sum", "totals"))]
    return features.select(F.col(f"`{entity}`"), *[c.alias(n) for n, c in named])


def as_rows(features: DataFrame, types: list[str], entity: str) -> DataFrame:
    """Long form: one row per entity and type it had."""
    names = F.array(*[F.lit(t) for t in types])
    z = F.explode(F.arrays_zip(names.alias("event_type"), F.col("counts").alias("n"), F.col("latest").alias("latest"), F.col("totals").alias("total"))).alias("z")
    return features.select(F.col(f"`{entity}`"), z).select(F.col(f"`{entity}`"), F.col("z.event_type"), F.col("z.n"), F.col("z.latest"), F.col("z.total")).where("n > 0")


def _arrow_type(key: T.DataType) -> pa.DataType:
    if isinstance(key, (T.ArrayType, T.MapType, T.StructType, T.BooleanType)):
        raise ValueError(f"entities can't be {key.simpleString()}")
    return to_arrow_type(key)


_NEVER = np.iinfo(np.int64).min


def _encode(group: pa.Table, scale: int) -> tuple[bytes, list[str]]:
    """State of one group: sorted entity keys, then per type its slices and latest times; and its types."""
    entities = group["e"].combine_chunks()
    ordered = entities.unique().sort()
    ordinal = pa.compute.index_in(entities, value_set=ordered).to_numpy(zero_copy_only=False).astype(np.int64)
    size = len(ordered)
    kinds = group["k"].combine_chunks().dictionary_encode()
    names = kinds.dictionary.to_pylist()
    to_code = np.array([*range(len(names)), -1], np.int64)
    code = to_code[kinds.indices.fill_null(len(kinds.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)]
    t = group["t"].combine_chunks().cast(pa.int64()).fill_null(_NEVER).to_numpy(zero_copy_only=False)
    v = group["v"].combine_chunks().to_numpy(zero_copy_only=False).astype(np.float64)
    v = np.where(np.isfinite(v), v, 0.0)
    scaled = np.rint(v * 10.0**scale)
    far = np.abs(scaled) >= _EXACT / max(1, len(v))
    fixed = np.where(far, 0, scaled).astype(np.int64)

    cell = code * size + ordinal
    order = np.argsort(cell, kind="stable")
    order = order[code[order] >= 0]
    cell, t, fixed = cell[order], t[order], fixed[order]
    starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, np.int64)
    sums = lambda x: np.add.reduceat(x, starts) if len(starts) else np.zeros(0, np.int64)
    n, plus, minus = sums(np.ones(len(cell), np.int64)), sums(np.maximum(fixed, 0)), sums(np.maximum(-fixed, 0))
    last = np.maximum.reduceat(t, starts) if len(starts) else np.zeros(0, np.int64)
    cells = cell[starts]
    bounds = np.searchsorted(cells, np.arange(len(names) + 1) * size)
    state = _State(ordered, size, {}, [])
    for c, name in enumerate(names):
        a, b = bounds[c], bounds[c + 1]
        if a < b:
            o = cells[a:b] - c * size
            state.types[name] = _Type(bitmaps.slices(o, n[a:b], size), bitmaps.slices(o, plus[a:b], size), bitmaps.slices(o, minus[a:b], size), o.astype(np.uint32), last[a:b])
    state.far = [(names[c], int(o), float(x)) for c, o, x in zip(code[far], ordinal[far], v[far], strict=True) if c >= 0]
    return state.dump(), list(state.types)


class _Type:
    """Sliced counters and totals of one event type, and latest times aligned with the ordinals that have it."""

    __slots__ = ("at", "last", "minus", "n", "plus")

    def __init__(self, n, plus, minus, at, last):
        self.n, self.plus, self.minus, self.at, self.last = n, plus, minus, at, last

    def moved(self, to: np.ndarray, size: int) -> _Type:
        move = lambda s: [b.moved(to, size) for b in s]
        return _Type(move(self.n), move(self.plus), move(self.minus), to[self.at], self.last)

    def joined(self, other: _Type) -> _Type:
        at = np.union1d(self.at, other.at)
        last = np.full(len(at), _NEVER, np.int64)
        for x in (self, other):
            i = np.searchsorted(at, x.at)
            last[i] = np.maximum(last[i], x.last)
        return _Type(bitmaps.add(self.n, other.n), bitmaps.add(self.plus, other.plus), bitmaps.add(self.minus, other.minus), at, last)


class _State:
    """All types over one block's entities; `far` has values too large to be added as bits."""

    def __init__(self, keys: pa.Array, size: int, types: dict[str, _Type], far: list[tuple[str, int, float]]):
        self.keys, self.size, self.types, self.far = keys, size, types, far

    def dump(self) -> bytes:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, pa.schema([("k", self.keys.type)])) as w:
            w.write_batch(pa.record_batch([self.keys], names=["k"]))
        keys, names = sink.getvalue().to_pybytes(), list(self.types)
        told, number = json.dumps(names).encode(), {t: i for i, t in enumerate(names)}
        out = [struct.pack("<III", len(keys), len(told), len(self.far)), keys, told]
        out += [struct.pack("<IId", number[t], o, x) for t, o, x in self.far]
        for x in self.types.values():
            out += [struct.pack("<I", len(x.at)), x.at.astype(np.uint32).tobytes(), x.last.tobytes(), *[bitmaps.dump(s) for s in (x.n, x.plus, x.minus)]]
        return zlib.compress(b"".join(out), 1)

    @classmethod
    def load(cls, packed: bytes, key_type: pa.DataType) -> _State:
        data = memoryview(zlib.decompress(packed))
        length, told, far = struct.unpack_from("<III", data, 0)
        at = 12 + length
        keys = pa.ipc.open_stream(pa.py_buffer(data[12:at])).read_all()["k"].combine_chunks().cast(key_type)
        names = json.loads(bytes(data[at : at + told]))
        at += told
        outliers = [(names[n], o, x) for n, o, x in (struct.unpack_from("<IId", data, at + 16 * i) for i in range(far))]
        at += 16 * far
        types = {}
        for name in names:
            (m,) = struct.unpack_from("<I", data, at)
            at += 4
            ordinals, last = np.frombuffer(data, np.uint32, m, at), np.frombuffer(data, np.int64, m, at + 4 * m)
            at += 12 * m
            parts = []
            for _ in range(3):
                s, at = bitmaps.load(data, at)
                parts.append(s)
            types[name] = _Type(*parts, ordinals, last)
        return cls(keys, len(keys), types, outliers)

    def plus(self, other: _State) -> _State:
        keys = pa.concat_arrays([self.keys, other.keys]).unique().sort()
        mine, theirs = (pa.compute.index_in(s.keys, value_set=keys).to_numpy(zero_copy_only=False).astype(np.uint32) for s in (self, other))
        types = {c: x.moved(mine, len(keys)) for c, x in self.types.items()}
        for c, x in other.types.items():
            y = x.moved(theirs, len(keys))
            types[c] = types[c].joined(y) if c in types else y
        far = [(c, int(mine[o]), v) for c, o, v in self.far] + [(c, int(theirs[o]), v) for c, o, v in other.far]
        return _State(keys, len(keys), types, far)

    def rows(self, entity: str, scale: int, step: int, codes: dict[str, int]) -> Iterator[pa.RecordBatch]:
        """Decoded rows, `step` entities at a time; types without a code are left out."""
        m = len(codes)
        cells = []  # per type: ordinals, counts, totals, latest
        for c, x in ((codes[t], x) for t, x in self.types.items() if t in codes):
            n = bitmaps.numbers(x.n, self.size)[x.at]
            total = (bitmaps.numbers(x.plus, self.size)[x.at] - bitmaps.numbers(x.minus, self.size)[x.at]) / 10.0**scale
            cells.append((x.at.astype(np.int64) * m + c, n, total, x.last))
        where, n, total, last = (np.concatenate(z) for z in zip(*cells, strict=True)) if cells else (np.zeros(0, np.int64),) * 4
        order = np.argsort(where, kind="stable")
        where, n, total, last = where[order], n[order], total[order].astype(np.float64), last[order]
        for t, o, v in self.far:
            if t in codes:
                total[np.searchsorted(where, o * m + codes[t])] += v
        for a in range(0, self.size, step):
            b = min(a + step, self.size)
            i, j = np.searchsorted(where, [a * m, b * m])
            at = where[i:j] - a * m
            counts, totals, times = np.zeros((b - a) * m, np.int64), np.zeros((b - a) * m, np.float64), np.full((b - a) * m, _NEVER, np.int64)
            counts[at], totals[at], times[at] = n[i:j], total[i:j], last[i:j]
            offsets = pa.array(np.arange(b - a + 1, dtype=np.int32) * m)
            lists = [pa.ListArray.from_arrays(offsets, x) for x in (pa.array(counts), pa.array(times, mask=times == _NEVER).cast(pa.timestamp("us")), pa.array(totals))]
            yield pa.RecordBatch.from_arrays([self.keys[a:b], *lists], names=[entity, "counts", "latest", "totals"])
