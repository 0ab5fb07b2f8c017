"""Words of many texts at once: texts stay UTF-8 bytes in Arrow buffers, words become 64-bit hashes."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE_BYTES = 1 << 18
SEED = 20260
_powers: list[tuple[np.ndarray, np.ndarray]] = []


def byte_values(separators: bytes | set[int], fold_case: bool = True, seed: int = SEED) -> np.ndarray:
    """A random number per byte, 0 for separators; A-Z share the numbers of a-z if asked."""
    values = np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    if fold_case:
        values[65:91] = values[97:123]
    values[sorted(set(separators))] = 0
    return values


#: words are runs of anything but ASCII white space
SPACED = byte_values({0x20, *range(0x09, 0x0E)})
#: words are runs of digits, letters a-z in either case, and everything beyond ASCII
ALNUM = byte_values({*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)})


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    h = values ^ (values >> np.uint64(32))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _power_table(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64 and their inverses."""
    if _powers and len(_powers[0][0]) >= size:  # a shorter table is the beginning of a longer one
        return _powers[0]
    top = max(1 << 12, 1 << (size - 1).bit_length())
    factor = 0x5851F42D4C957F2D
    steps = [np.full(top, f % (1 << 64), np.uint64) for f in (factor, pow(factor, -1, 1 << 64))]
    for step in steps:
        step[0] = 1
    made = tuple(np.multiply.accumulate(step) for step in steps)
    if top <= 1 << 21:
        _powers[:] = [made]
    return made


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, byte bounds of the rows) of consecutive rows of about ``limit`` bytes.

    A text is never cut: one longer than the limit is a slice of its own. NULL counts as empty.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, places, content = column.buffers()
    bounds = np.frombuffer(places, np.int64 if wide else np.int32)[column.offset: column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(content, np.uint8) if content is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(bounds, bounds[row] + limit, "right")) - 1)
        yield row, end, data[bounds[row]: bounds[end]], bounds[row: end + 1] - bounds[row]
        row = end


def words(data: np.ndarray, bounds: np.ndarray, values: np.ndarray, kinds: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and the bounds of each text among the words. No hash is 0.

    With ``kinds`` (a number per byte) a word also ends where the kind of its bytes changes.
    """
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    value = values[data]
    inside = value != 0
    first = inside.copy()
    if kinds is None:
        first[1:] &= ~inside[:-1]
    else:
        kind = kinds[data]
        first[1:] &= ~inside[:-1] | (kind[1:] != kind[:-1])
    begins = bounds[:-1][bounds[:-1] < len(data)]
    first[begins] = inside[begins]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    power, inverse = _power_table(len(data))
    value *= power[: len(data)]
    hashes = mixed(np.add.reduceat(value, starts) * inverse[starts])
    hashes[hashes == 0] = 1
    return hashes, np.searchsorted(starts, bounds)


def owners(bounds: np.ndarray) -> np.ndarray:
    """The text that each word belongs to."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def set_aside(df: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, dict[str, str]]:
    """The table with the columns of these names under names that nothing uses, and the way back."""
    taken, back = {*df.columns, *names}, {}
    for name in names:
        if name in df.columns:
            new = f"_{name}"
            while new in taken:
                new = f"_{new}"
            taken.add(new)
            back[new] = name
    return df.withColumnsRenamed({name: new for new, name in back.items()}), back


#: bounds of an Arrow batch, so that whole texts and whole sets take little memory beside the heap
BATCH_SETTINGS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def small_batches(df: DataFrame) -> DataFrame:
    """Set the bounds of Arrow batches for the session; smaller ones that it already has stay."""
    conf = df.sparkSession.conf
    for name, most in BATCH_SETTINGS.items():
        now = str(conf.get(name, most))
        if not now.isdigit() or int(now) <= 0 or int(now) > int(most):
            conf.set(name, most)
    return df


_kept: dict[str, object] = {}
_asked: set[str] = set()


def kept(name: str, make: Callable[[], object]) -> object:
    """What a worker keeps from task to task, such as caches; it goes when the worker ends a task that did not ask for it."""
    _asked.add(name)
    if name not in _kept:
        _kept[name] = make()
    return _kept[name]


def give_back() -> None:
    """Return free memory to the system: Python workers stay for later tasks, and their memory counts as the executor's."""
    for name in _kept.keys() - _asked:
        del _kept[name]
    _asked.clear()
    gc.collect()
    if not gc.get_freeze_count():  # modules stay: no later task looks through their objects again
        gc.freeze()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library can
        ctypes.CDLL(None).malloc_trim(0)


def batch_map(df: DataFrame, schema: str | T.StructType, work: Callable[[pa.RecordBatch], pa.Table | pa.RecordBatch | dict]) -> DataFrame:
    """``mapInArrow`` by a function of one batch that returns columns in the order of ``schema``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = work(batch)
                yield made if isinstance(made, pa.RecordBatch) else pa.RecordBatch.from_pydict(made)
        give_back()

    return small_batches(df).mapInArrow(run, schema)


def lists(flat: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    """One Arrow list per text."""
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat, kind))


SUM_SLICES, SUM_FAN_IN = 16, 32


def summed(df: DataFrame, size: int, add: Callable[[pa.RecordBatch, np.ndarray], None]) -> np.ndarray:
    """The sum of one array of fixed size over all tasks, added up in two steps and in slices.

    ``add`` changes the task's array (double) for each batch. A task sends ``size`` numbers, compressed.
    """
    padded = -(-size // SUM_SLICES) * SUM_SLICES

    def sent(ways: list[int], slices: list[int], sums: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({
            "way": pa.array(ways, pa.int32()), "slice": pa.array(slices, pa.int32()),
            "sums": pa.array([zlib.compress(s.tobytes(), 1) for s in sums], pa.binary())})

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, rows = np.zeros(padded), 0
        for batch in batches:
            add(batch, sums)
            rows += batch.num_rows
        give_back()
        if rows:
            yield sent([zlib.crc32(sums.tobytes()) % SUM_FAN_IN] * SUM_SLICES, [*range(SUM_SLICES)], [*sums.reshape(SUM_SLICES, -1)])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for way, part, sums in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                value = np.frombuffer(zlib.decompress(sums))
                held[way, part] = held[way, part] + value if (way, part) in held else value
        if held:
            yield sent([w for w, _ in held], [p for _, p in held], [*held.values()])

    kind = "way int, slice int, sums binary"
    once = small_batches(df).mapInArrow(own, kind).repartition("way", "slice").mapInArrow(added, kind)
    out = np.zeros((SUM_SLICES, padded // SUM_SLICES))
    for row in once.select(F.lit(0).alias("way"), "slice", "sums").repartition("slice").mapInArrow(added, kind).collect():
        out[row["slice"]] += np.frombuffer(zlib.decompress(row["sums"]))
    return out.reshape(-1)[:size]
