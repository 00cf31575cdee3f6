"""Global row numbers and running totals without a one-task window.

Only narrow rows are put in order: the keys and the values to add up, with any columns of fixed
width. They are range-partitioned and sorted (one shuffle), and each partition is scanned once in
that order, carrying sums from batch to batch. Per-partition totals form a table of at most one row
per partition and group change; its running sums are the offsets. A group of any size may span any
number of partitions, so no key has to fit into one task. Texts and arrays stay where they are and
meet their numbers by a join on the keys.

Keys that are not unique can not tell rows apart in that join. Then, or with values or keys that
the scan does not know, whole rows are put in order instead."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import land, materialize, shuffle_width

_POS = "__pos"
_PID = "__pid"
_LOCAL_BITS = 33  # layout documented for monotonically_increasing_id
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_NUMBER = (*_WHOLE, T.FloatType, T.DoubleType)
_FIXED = (*_NUMBER, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
_KEY = (*_FIXED, T.StringType, T.BinaryType, T.DecimalType)
_NONE = np.iinfo(np.int64).min


def _earlier(pid_order: Window) -> Window:
    return pid_order.rowsBetween(Window.unboundedPreceding, -1)


# --- the scan ----------------------------------------------------------------------------


def _differs(column: pa.Array, last: pa.Array | None) -> np.ndarray:
    """For each row, whether its value differs from the one before; nulls and NaNs are alike."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    before = pa.concat_arrays([last if last is not None else column.slice(0, 1), column.slice(0, max(0, len(column) - 1))])
    other = pc.fill_null(pc.not_equal(column, before), False)
    if pa.types.is_floating(column.type):
        both = pc.and_(pc.is_nan(column), pc.is_nan(before))
        other = pc.and_not(other, pc.fill_null(both, False))
    return pc.or_(other, pc.xor(pc.is_null(column), pc.is_null(before))).to_numpy(zero_copy_only=False)


def _accumulate(values: np.ndarray, starts: np.ndarray, carry, combine) -> np.ndarray:
    """Running sums or maxima that begin anew at `starts`; the first stretch goes on from `carry`."""
    if combine is np.add:
        total = np.cumsum(values)
        before = np.concatenate([[values.dtype.type(0)], total[:-1]])
        lengths = np.diff(np.concatenate([[0], starts, [len(values)]]))
        shift = np.concatenate([[-carry], before[starts]])
        return total - np.repeat(shift, lengths)
    out = np.empty_like(values)
    edges = np.concatenate([[0], starts, [len(values)]])
    for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        if b > a:
            part = combine.accumulate(values[a:b])
            out[a:b] = combine(part, carry) if i == 0 else part
    return out


def _scan(batches: Iterator[pa.RecordBatch], groups: list[str], keys: list[str], sums: list[str], maxima: list[str], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Add running values, partition number, position, and whether all keys equal those before."""
    pid, at, rank = TaskContext.get().partitionId(), 0, 0
    last: dict[str, pa.Array] = {}
    carry: dict[str, object] = {}
    for batch in batches:
        n = len(batch)
        if not n:
            continue
        fresh = not last
        changed = {c: _differs(batch.column(c), last.get(c)) for c in {*groups, *keys}}
        new_group = reduce(np.logical_or, (changed[g] for g in groups), np.zeros(n, bool))
        repeat = ~reduce(np.logical_or, (changed[c] for c in changed), np.zeros(n, bool))
        if fresh:
            repeat[0] = False
        starts = np.flatnonzero(new_group)
        out = dict(zip(batch.schema.names, batch.columns, strict=True))
        for added, combine in ((sums, np.add), (maxima, np.maximum)):
            for name in added:
                column = out[name]
                whole = pa.types.is_integer(column.type)
                nothing = 0 if combine is np.add else _NONE if whole else -np.inf
                kind = np.int64 if whole else np.float64
                missing = column.is_null().to_numpy(zero_copy_only=False)
                values = np.where(missing, kind(nothing), pc.fill_null(column, 0).to_numpy(zero_copy_only=False).astype(kind))
                found = _accumulate(values, starts, carry.get(name, values.dtype.type(nothing)), combine)
                carry[name] = found[-1]
                mask = found == nothing if combine is np.maximum else None
                out[name] = pa.array(found, mask=mask)
        places = _accumulate(np.ones(n, np.int64), starts, np.int64(rank), np.add)
        rank = int(places[-1])
        out["__rank"], out[_PID], out[_POS] = pa.array(places - 1), pa.array(np.full(n, pid, np.int32)), pa.array(np.arange(at, at + n))
        out["__repeat"] = pa.array(repeat)
        at += n
        last = {c: batch.column(c).slice(n - 1, 1) for c in changed}
        yield pa.RecordBatch.from_arrays([out[name] for name in names], names=names)


def _kind(kind: T.DataType) -> T.DataType:
    return T.LongType() if isinstance(kind, _WHOLE) else T.DoubleType()


def _scanned(narrow: DataFrame, group: list[str], order: list[Column], keys: list[str], sums: list[str], maxima: list[str]) -> DataFrame:
    """Narrow rows in order, written with what the scan adds."""
    fields = [T.StructField(f.name, _kind(f.dataType)) if f.name in {*sums, *maxima} else f for f in narrow.schema.fields]
    schema = T.StructType([*fields, *(T.StructField(n, t()) for n, t in (("__rank", T.LongType), (_PID, T.IntegerType), (_POS, T.LongType), ("__repeat", T.BooleanType)))])
    by = [*[F.col(g) for g in group], *order]
    ordered = narrow.repartitionByRange(shuffle_width(narrow), *by).sortWithinPartitions(*by)
    return land(ordered.mapInArrow(lambda it: _scan(it, group, keys, sums, maxima, schema.names), schema), "ordered")


def _named_order(df: DataFrame, order: list) -> tuple[dict[str, Column], list[Column]] | None:
    """Order entries as named key columns, and the sort orders over these names; None for an
    entry that is no column name or plain expression and so can not be joined on."""
    keys, sorts = {}, []
    for i, entry in enumerate(order):
        if isinstance(entry, str):
            keys[f"__k{i}"] = F.col(entry)
            sorts.append(F.col(f"__k{i}"))
            continue
        node = entry._jc.node() if hasattr(entry, "_jc") else None
        if node is None or node.getClass().getSimpleName() == "SortOrder":
            return None
        keys[f"__k{i}"] = entry
        sorts.append(F.col(f"__k{i}"))
    return keys, sorts


def _narrow_running(df: DataFrame, order: list, group: list[str], sums: dict[str, Column], maxima: dict[str, Column], rank: str | None, total: str | None) -> DataFrame | None:
    """The narrow way, or None where it does not apply."""
    named = _named_order(df, order)
    if named is None:
        return None
    keys, sorts = named
    values = {f"__v_{n}": c for n, c in {**sums, **maxima}.items()}
    carried = [f.name for f in df.schema.fields if isinstance(f.dataType, _FIXED)]
    joined = len(carried) < len(df.columns)
    groups = {f"__g{i}": F.col(g) for i, g in enumerate(group)}
    narrow = df.select(*[c.alias(n) for n, c in {**groups, **keys, **values}.items()], *([] if joined else [F.col(c) for c in carried]))
    kinds = {f.name: f.dataType for f in narrow.schema.fields}
    if not all(isinstance(kinds[n], _NUMBER) for n in values) or not all(isinstance(kinds[n], _KEY) for n in {**groups, **keys}):
        return None
    if any(isinstance(kinds[n], T.FloatType) for n in values):
        return None
    own_values = [*values]
    sort = [*sorts, *[F.col(v) for v in own_values]]  # ties by value, so that equal rows are alike
    originals = {f"__o{i}": F.col(v) for i, v in enumerate(own_values)} if joined else {}
    narrow = narrow.withColumns(originals) if originals else narrow
    join_keys = [*keys, *originals]
    fixed = _scanned(narrow, [*groups], sort, join_keys, [f"__v_{n}" for n in sums], [f"__v_{n}" for n in maxima])
    if joined and not fixed.filter("__repeat").isEmpty():
        return None
    totals = fixed.groupBy(_PID, *groups).agg(
        F.count(F.lit(1)).alias("__rows"),
        *[F.max_by(f"__v_{n}", _POS).alias(f"__s_{n}") for n in sums],
        *[F.max(f"__v_{n}").alias(f"__m_{n}") for n in maxima],
    )
    totals = materialize(totals)  # one row per partition and group change
    earlier = _earlier(Window.partitionBy(*groups).orderBy(_PID))
    offsets = totals.select(
        F.col(_PID).alias("__opid"),
        *[F.col(g).alias(f"__o_{g}") for g in groups],
        F.sum("__rows").over(earlier).alias("__before"),
        *[F.sum(f"__s_{n}").over(earlier).alias(f"__s_{n}") for n in sums],
        *[F.max(f"__m_{n}").over(earlier).alias(f"__m_{n}") for n in maxima],
    ).filter(F.col("__before").isNotNull())  # only groups that go on from an earlier partition
    condition = reduce(lambda c, g: c & F.col(g).eqNullSafe(F.col(f"__o_{g}")), groups, F.col(_PID) == F.col("__opid"))
    placed = fixed.join(F.broadcast(offsets), condition, "left")
    added = {n: F.col(f"__v_{n}") + F.coalesce(F.col(f"__s_{n}"), F.lit(0)) for n in sums}
    added |= {n: F.greatest(F.col(f"__v_{n}"), F.col(f"__m_{n}")) for n in maxima}
    if rank:
        added[rank] = F.col("__rank") + F.coalesce(F.col("__before"), F.lit(0))
    if total:
        added[total] = F.lit(totals.agg(F.coalesce(F.sum("__rows"), F.lit(0))).first()[0])
    if not joined:
        return placed.select(*df.columns, *[c.alias(n) for n, c in added.items()])
    numbers = placed.select(*[F.col(k).alias(f"__j{k}") for k in [*groups, *join_keys]], *[c.alias(f"__a_{n}") for n, c in added.items()])
    asked = df.withColumns({**groups, **keys, **{o: c for o, c in zip(originals, [*sums.values(), *maxima.values()], strict=True)}})
    match = reduce(lambda a, b: a & b, [asked[k].eqNullSafe(numbers[f"__j{k}"]) for k in [*groups, *join_keys]])
    return asked.join(numbers, match).select(*[asked[c] for c in df.columns], *[F.col(f"__a_{n}").alias(n) for n in added])


# --- whole rows in order ---------------------------------------------------------------------


def _fix_order(df: DataFrame, order: list) -> DataFrame:
    """Sort globally; keep partition number and in-partition position as columns."""
    ordered = (
        df.repartitionByRange(shuffle_width(df), *order)
        .sortWithinPartitions(*order)
        .withColumn(_POS, F.monotonically_increasing_id())
    )
    return materialize(ordered).withColumn(_PID, F.shiftright(F.col(_POS), _LOCAL_BITS))


def _whole_running(df: DataFrame, order: list, group: list[str], sums: dict[str, Column], maxima: dict[str, Column], rank: str | None, total: str | None) -> DataFrame:
    fixed = _fix_order(df, [*group, *order])
    aggregates = (
        [F.count(F.lit(1)).alias("__rows")]
        + [F.sum(c).alias(f"__s_{n}") for n, c in sums.items()]
        + [F.max(c).alias(f"__m_{n}") for n, c in maxima.items()]
    )
    totals = fixed.groupBy(_PID, *group).agg(*aggregates)
    earlier = _earlier(Window.partitionBy(*group).orderBy(_PID))
    offsets = totals.select(
        F.col(_PID).alias("__opid"),
        *[F.col(g).alias(f"__o_{g}") for g in group],
        F.sum("__rows").over(earlier).alias("__rows"),
        *[F.sum(f"__s_{n}").over(earlier).alias(f"__s_{n}") for n in sums],
        *[F.max(f"__m_{n}").over(earlier).alias(f"__m_{n}") for n in maxima],
    ).filter(F.col("__rows").isNotNull())
    local = Window.partitionBy(_PID, *group).orderBy(_POS).rowsBetween(Window.unboundedPreceding, 0)
    condition = F.col(_PID) == F.col("__opid")
    for g in group:
        condition = condition & F.col(g).eqNullSafe(F.col(f"__o_{g}"))
    added = {n: F.sum(c).over(local) for n, c in sums.items()}
    added |= {n: F.max(c).over(local) for n, c in maxima.items()}
    if rank:
        added[rank] = F.row_number().over(local) - 1
    joined = fixed.withColumns(added).join(F.broadcast(offsets), condition, "left")
    final = {n: F.col(n) + F.coalesce(F.col(f"__s_{n}"), F.lit(0)) for n in sums}
    final |= {n: F.greatest(F.col(n), F.col(f"__m_{n}")) for n in maxima}
    if rank:
        final[rank] = F.col(rank) + F.coalesce(F.col("__rows"), F.lit(0))
    if total:
        final[total] = F.lit(fixed.count())
    return joined.withColumns(final).select(*df.columns, *final)


# --- interface -------------------------------------------------------------------------------


def with_running(
    df: DataFrame,
    order: list,
    group: list[str] | None = None,
    sums: dict[str, Column] | None = None,
    maxima: dict[str, Column] | None = None,
    rank: str | None = None,
    total: str | None = None,
) -> DataFrame:
    """Add inclusive running sums / maxima and a zero-based rank, per group if given, and the
    number of all rows. A null counts as nothing in a sum or maximum."""
    wanted = (df, order, group or [], sums or {}, maxima or {}, rank, total)
    found = _narrow_running(*wanted)
    return _whole_running(*wanted) if found is None else found


def with_row_index(df: DataFrame, order: list, name: str = "row_index", total: str | None = None) -> DataFrame:
    """Add the zero-based position of each row in the global order, and the number of rows."""
    return with_running(df, order, rank=name, total=total)


def with_group_rank(df: DataFrame, group: list[str], order: list, name: str = "rank") -> DataFrame:
    """Zero-based rank inside each group; a hot group is spread over many partitions."""
    return with_running(df, order, group=group, rank=name)
