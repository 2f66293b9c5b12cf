"""Per-key state machines in batch, exact also when one key is hot.

Some decisions depend on earlier decisions (an admitted request uses quota, a
denied one does not), so no window frame expresses them. Rows are shuffled by
key, sorted by time and fed to a small machine; only the machine's state is
held, never a key's history.

A key with more than ``rows_per_task`` rows is cut into segments, in three steps.
All segments are reduced at once to pages, which hold only what moves a state
across their rows. A chain carries each key's state over its pages and notes it
at the start of every segment. Then all segments are labelled at once from these
states. What a page holds is up to the machine: where transitions compose (a
token bucket is one clamped addition, a lock one table of successors) a page
stays small however many rows it stands for; the sliding windows' transitions do
not, so their pages hold the instants, packed, and the chain replays them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from fleetlens.operators.segments import ROWS_PER_TASK, SEG, Segmented, split
from fleetlens.session import written

PAGE_ROWS = 262_144


class Machine:
    """State and transition. ``page`` and ``carry`` together lead to the state that ``run`` leaves."""

    columns: list[str] = []  # input columns read by run
    output: T.StructType = T.StructType()

    def start(self):
        raise NotImplementedError

    def dump(self, state) -> str:
        raise NotImplementedError

    def load(self, text: str):
        raise NotImplementedError

    def run(self, state, chunk: dict[str, np.ndarray]) -> tuple[object, dict[str, np.ndarray]]:
        raise NotImplementedError

    def page(self, chunk: dict[str, np.ndarray]) -> bytes:
        """What moves a state across the rows of ``chunk``; must not depend on the state before."""
        raise NotImplementedError

    def carry(self, state, page: bytes):
        raise NotImplementedError


def pack_instants(times: np.ndarray) -> bytes:
    """Ascending instants as the first one and the smallest steps that hold them."""
    steps = np.diff(times)
    steps = steps.astype(np.min_scalar_type(int(steps.max()))) if len(steps) else steps.astype(np.uint8)
    return np.int64(times[0]).tobytes() + steps.dtype.char.encode() + steps.tobytes()


def unpack_instants(packed: bytes) -> np.ndarray:
    steps = np.frombuffer(packed, np.dtype(packed[8:9].decode()), offset=9).astype(np.int64)
    return np.cumsum(np.append(np.frombuffer(packed, np.int64, 1), steps))


def _slices(batch: pa.RecordBatch, keys: list[str]) -> Iterator[tuple[tuple, int, int]]:
    """Consecutive runs of equal keys (null equals null)."""
    ends = np.unique(np.concatenate([pc.run_end_encode(batch.column(k)).run_ends.to_numpy() for k in keys]))
    a = 0
    for b in ends.tolist():
        yield tuple(batch.column(k)[a].as_py() for k in keys), a, b
        a = b


def _chunk(machine: Machine, batch: pa.RecordBatch, a: int, b: int) -> dict[str, np.ndarray]:
    return {c: batch.column(c).slice(a, b - a).to_numpy(zero_copy_only=False) for c in machine.columns}


def _label_batches(machine: Machine, keys: list[str], columns: list[str], out_schema: pa.Schema):
    """Rows in, rows with the machine's columns out. Payload stays in Arrow."""

    def run(batches):
        key, state = object(), None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            entry = batch.column("_entry") if "_entry" in batch.schema.names else None
            made: dict[str, list] = {f.name: [] for f in out_schema}
            for k, a, b in _slices(batch, keys):
                if k != key:
                    key, state = k, machine.start()
                if entry is not None and entry[a].is_valid:
                    state, a = machine.load(entry[a].as_py()), a + 1
                if a < b:
                    state, part = machine.run(state, _chunk(machine, batch, a, b))
                    for name, values in part.items():
                        made[name].append(values)
            rows = batch if entry is None else batch.filter(pc.is_null(entry))
            if rows.num_rows:
                arrays = [rows.column(c) for c in columns] + [
                    pa.array(np.concatenate(made[f.name]), f.type) for f in out_schema
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=columns + out_schema.names)

    return run


def _page_batches(machine: Machine, keys: list[str], out_schema: pa.Schema):
    """Rows of segments in, their pages out: keys, number within the segment, page."""

    def close(key, number, parts):
        chunk = {c: np.concatenate([p[c] for p in parts]) for c in machine.columns}
        row = [*key, number, machine.page(chunk)]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, out_schema)], names=out_schema.names)

    def run(batches):
        key, number, parts, size = None, 0, [], 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            for k, a, b in _slices(batch, keys):
                if parts and (k != key or size >= PAGE_ROWS):
                    yield close(key, number, parts)
                    number, parts, size = number + 1, [], 0
                if k != key:
                    key, number = k, 0
                parts.append(_chunk(machine, batch, a, b))
                size += b - a
        if parts:
            yield close(key, number, parts)

    return run


def _chain_batches(machine: Machine, by: list[str], out_schema: pa.Schema):
    """Pages in order in, the state before each segment's first page out."""

    def run(batches):
        key, state = object(), None
        for batch in batches:
            made = []
            for i in range(batch.num_rows):
                k = tuple(batch.column(c)[i].as_py() for c in by)
                if k != key:
                    key, state = k, machine.start()
                if batch.column("_page")[i].as_py() == 0:
                    made.append((*k, batch.column(SEG)[i].as_py(), machine.dump(state)))
                state = machine.carry(state, batch.column("_moves")[i].as_py())
            if made:
                arrays = [pa.array(v, f.type) for v, f in zip(zip(*made), out_schema)]
                yield pa.RecordBatch.from_arrays(arrays, names=out_schema.names)

    return run


def _with_entries(rows: DataFrame, entries: DataFrame, keys: list[str]) -> DataFrame:
    """Put each segment's entry state before its rows."""
    return rows.withColumn("_entry", F.lit(None).cast("string")).unionByName(
        entries.select(*keys, "_entry"), allowMissingColumns=True
    )


def _feed(df: DataFrame, keys: list[str], order: list[str], header: bool, segments: int = 0) -> DataFrame:
    """Rows by key in order; with segments in so many partitions that few of these share one."""
    first = [F.col("_entry").isNull()] if header else []
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartition(max(usual, 2 * segments), *keys) if segments else df.repartition(*keys)
    return dealt.sortWithinPartitions(*keys, *first, *order)


def _settle(s: Segmented, machine: Machine) -> DataFrame:
    """Entry state of every segment of every hot key: pages of all segments at once, then a chain for each key."""
    keys = s.group
    hot = s.df.filter(F.col(SEG) > 0).select(*dict.fromkeys([*keys, *s.order, *machine.columns]))
    fields = [hot.schema[k] for k in keys]
    paged = T.StructType([*fields, T.StructField("_page", T.LongType()), T.StructField("_moves", T.BinaryType())])
    pages = _feed(hot, keys, s.order, False, s.segments).mapInArrow(
        _page_batches(machine, keys, to_arrow_schema(paged)), paged
    )
    entered = T.StructType([*fields, T.StructField("_entry", T.StringType())])
    chain = written(pages, "pages").repartition(*[F.col(k) for k in s.by]) if s.by else written(pages, "pages").coalesce(1)
    return written(
        chain.sortWithinPartitions(*s.by, SEG, "_page").mapInArrow(
            _chain_batches(machine, s.by, to_arrow_schema(entered)), entered
        ),
        "entries",
    )


def run_machine(
    df: DataFrame, by: list[str], order: list[str], machine: Machine, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Feed each key's rows in order to ``machine`` and append its output columns."""
    s = split(df, by, order, rows_per_task)
    made = to_arrow_schema(machine.output)
    schema = T.StructType(df.schema.fields + machine.output.fields)
    if not s.segments:
        fed = _feed(df, by, order, header=False)
        return fed.mapInArrow(_label_batches(machine, by, df.columns, made), schema)
    entries = _settle(s, machine)
    fed = _feed(_with_entries(s.df, entries, s.group), s.group, s.order, True, s.segments)
    return fed.mapInArrow(_label_batches(machine, s.group, df.columns, made), schema)
