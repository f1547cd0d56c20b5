"""Numpy kernels over whole groups, streamed: many small groups cost one Arrow batch, not one call each."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema


def _group_starts(t: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(t.num_rows, dtype=bool)
    for k in keys:
        column = t.column(k).to_numpy(zero_copy_only=False)
        new[1:] |= column[1:] != column[:-1]
    return np.append(0, np.nonzero(new)[0])


def _whole_groups(keys: list[str], work: Callable[[pa.Table, np.ndarray], Iterable[pa.RecordBatch]]):
    """Run ``work(table, starts of its groups)`` on batches sorted by ``keys``, whole groups at a time."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = (pa.concat_tables([held, t]) if held is not None else t).combine_chunks()
            starts = _group_starts(t, keys)
            if len(starts) > 1:  # the last group may go on in the next batch
                cut = int(starts[-1])
                yield from work(t.slice(0, cut), starts[:-1])
                t = t.slice(cut)
            held = t
        if held is not None and held.num_rows:
            yield from work(held, np.array([0]))

    return run


def _dealt(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """Rows by group, in ``order``: columns, or text such as ``score desc nulls last``."""
    by = [o if isinstance(o, Column) else _ordered(o) for o in order]
    return df.repartition(*keys).withColumn("_group", F.xxhash64(*keys)).sortWithinPartitions("_group", *keys, *by)


def _ordered(text: str) -> Column:
    name, _, how = text.partition(" ")
    return {"": F.col(name), "desc nulls last": F.desc_nulls_last(name)}[how]


def keep_by_group(df: DataFrame, keys: list[str], order: list[Column], columns: list[str], kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """The rows of ``df`` that ``kernel`` keeps of each group.

    Rows are dealt out by ``keys`` and sorted by keys and ``order``; the kernel gets the matrix of a
    group's numeric ``columns`` and returns the positions to keep. A group must fit in a task.
    """
    names = df.columns

    def kept(t: pa.Table, starts: np.ndarray) -> list[pa.RecordBatch]:
        values = np.column_stack([t.column(c).to_numpy().astype(float) for c in columns])
        ends = np.append(starts[1:], t.num_rows)
        rows = [a + kernel(values[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        return t.take(pa.array(np.sort(np.concatenate(rows)))).select(names).to_batches()

    return _dealt(df, keys, order).mapInArrow(_whole_groups(keys, kept), df.schema)


Rows = dict[str, np.ndarray]


def map_groups(
    df: DataFrame, keys: list[str], order: list[Column | str], kernel: Callable[..., Rows], schema: str, many: bool = False
) -> DataFrame:
    """The rows of ``schema`` that ``kernel`` makes of each group: arrays by column, in ``order``, to arrays by column.

    Integers with nulls come as floats, as in pandas, but many small groups cost one Arrow batch and no
    frames. A group must fit in a task. With ``many`` the kernel gets the rows of many whole groups and
    where each begins.
    """
    out, names = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema), df.columns

    def made(t: pa.Table, starts: np.ndarray) -> list[pa.RecordBatch]:
        columns = {c: t.column(c).to_numpy(zero_copy_only=False) for c in names}
        ends = np.append(starts[1:], t.num_rows)
        if many:
            parts = [kernel(columns, starts)]
        else:
            parts = [kernel({c: v[a:b] for c, v in columns.items()}) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        arrays = [pa.array(np.concatenate([p[f.name] for p in parts])).cast(f.type) for f in out]
        return [pa.RecordBatch.from_arrays(arrays, schema=out)]

    return _dealt(df, keys, order).mapInArrow(_whole_groups(keys, made), schema)


def fold_by_key(df: DataFrame, keys: list[str], order: list[str], start: Callable[[tuple], object], schema: str) -> DataFrame:
    """What a fold over the rows of each key, in order, gives: a batch of rows is in memory at a time, never a whole key.

    ``start(key)`` makes the state of a key; its method ``rows(frame)`` takes the next rows and ``end()``
    closes the key; both return a frame of ``schema``, or None.
    """
    laid = df.repartition(*keys).sortWithinPartitions(*keys, *order)

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, now = None, None
        for frame in frames:
            codes = frame.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
            cuts = [0, *(np.nonzero(np.diff(codes))[0] + 1).tolist(), len(frame)] if len(frame) else [0]
            for a, b in zip(cuts, cuts[1:], strict=False):
                key = tuple(None if pd.isna(v) else v for v in frame[keys].iloc[a])
                if state is None or key != now:
                    yield from _some(state.end() if state is not None else None)
                    state, now = start(key), key
                yield from _some(state.rows(frame.iloc[a:b]))
        yield from _some(state.end() if state is not None else None)

    return laid.mapInPandas(run, schema)


def _some(frame: pd.DataFrame | None) -> list[pd.DataFrame]:
    return [] if frame is None or frame.empty else [frame]
