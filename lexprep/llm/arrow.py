"""Arrow batches to numpy: whole texts as UTF-8 bytes, words as byte ranges.

Every function works on one batch inside a task. Texts come as the value
buffer of an Arrow string column, so nothing is copied or decoded; work
arrays are made for a few megabytes of text at a time, and a longer text is
cut at bytes that belong to no word. A null text is a text of no bytes.
"""

from __future__ import annotations

import ctypes
import io
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

CHUNK_BYTES = 4 << 20

# A multiplier that is odd has an inverse modulo 2**64.
_MUL = 0x9E3779B97F4A7C15
_INV = pow(_MUL, -1, 1 << 64)
_MIX = np.uint64(0xD6E8FEB86659FD93)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _class(*ranges: tuple[int, int]) -> np.ndarray:
    """The bytes outside the ranges."""
    out = np.ones(256, bool)
    for a, b in ranges:
        out[a:b + 1] = False
    return out


#: bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` once A-Z are lower-cased
ALNUM = _class((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
#: bytes of words `[^\x20\x09-\x0D]+`
NONSPACE = _class((0x20, 0x20), (0x09, 0x0D))


def release() -> None:
    """Hand freed memory back to the system: a worker, or the driver, stays for the stages after it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column: text i is bytes[offsets[i]:offsets[i+1]]."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if not (wide or pa.types.is_string(col.type) or pa.types.is_binary(col.type)):
        col, wide = col.cast(pa.large_string()), True
    if col.null_count and len(col):
        # a null may keep bytes in the buffer: write it as an empty text
        col = col.fill_null("" if not pa.types.is_binary(col.type) else b"")
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = col.buffers()
    kind = np.int64 if wide else np.int32
    o = np.frombuffer(offs, kind, n + 1, col.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[o[0]:o[-1]], o - o[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [i, j) of at most ``limit`` bytes, or of one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


_POW: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next call."""
    have = _POW.get(base)
    if have is None or len(have) < n:
        have = np.empty(max(n, 1 << 16), np.uint64)
        have[0] = 1
        k = 1
        with np.errstate(over="ignore"):
            while k < len(have):
                m = min(k, len(have) - k)
                have[k:k + m] = have[:m] * np.uint64(pow(base, k, 1 << 64))
                k += m
        _POW[base] = have
    return have[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums; ``range_hash`` takes the hash of any range from them."""
    out = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_MUL, len(data)), out=out[1:])
    return out


def range_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes starts[i]..ends[i], the same wherever they stand."""
    with np.errstate(over="ignore"):
        h = (prefix[ends] - prefix[starts]) * powers(_INV, len(prefix))[starts]
        return mix(h)


def gram_hash(prefix: np.ndarray, n: int) -> np.ndarray:
    """``range_hash`` of every range of n bytes."""
    m = len(prefix) - n
    if m <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        return mix((prefix[n:] - prefix[:m]) * powers(_INV, m))


def mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * _MIX
        return h ^ (h >> np.uint64(32))


def word_ranges(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges of maximal runs of ``member`` bytes; a run ends where its text ends."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    w = member[data]
    s, e = w.copy(), w.copy()
    s[1:] &= ~w[:-1]
    e[:-1] &= ~w[1:]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    s[first] = w[first]
    last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    e[last] = w[last]
    return np.flatnonzero(s), np.flatnonzero(e) + 1


def words(data: np.ndarray, offsets: np.ndarray, member: np.ndarray, fold: bool = True,
          piece: int = CHUNK_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes, bounds): words of all texts in order; those of text i are bounds[i]..bounds[i+1]."""
    starts, ends = word_ranges(data, offsets, member)
    hashes = np.empty(len(starts), np.uint64)
    k = 0
    while k < len(starts):
        a = int(starts[k])
        m = max(k + 1, int(np.searchsorted(ends, a + piece, "right")))
        part = data[a:int(ends[m - 1])]
        hashes[k:m] = range_hash(prefix_hash(LOWER[part] if fold else part), starts[k:m] - a, ends[k:m] - a)
        k = m
    return starts, ends, hashes, np.searchsorted(starts, offsets)


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values[bounds[i]:bounds[i+1]], zero where that is empty."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the table has not, whatever columns it brings."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


_TYPES = {"int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "string": T.StringType(),
          "binary": T.BinaryType()}


def struct(**fields: str) -> T.StructType:
    """A struct of plain fields; unlike a DDL string it needs no session."""
    return T.StructType([T.StructField(k, _TYPES[v]) for k, v in fields.items()])


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for each Spark context: they need not have it on their path."""
    sc = spark.sparkContext
    if getattr(sc, "_lexprep_shipped", False):
        return
    top = Path(__file__).resolve().parent.parent
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.writestr(f"{top.name}/{f.relative_to(top).as_posix()}", f.read_text(encoding="utf-8"))
    path = os.path.join(tempfile.mkdtemp(prefix="lexprep-"), "lexprep_llm.zip")
    Path(path).write_bytes(held.getvalue())
    sc.addPyFile(path)
    sc._lexprep_shipped = True


def map_arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``mapInArrow`` by a function of this package, which gets the columns in their order. Names that Spark would read
    as a path or could not tell apart are replaced on the way in."""
    ship(df.sparkSession)
    if any("." in c or "`" in c for c in df.columns) or len({c.lower() for c in df.columns}) < len(df.columns):
        df = df.toDF(*[f"c{k}" for k in range(len(df.columns))])
    return df.mapInArrow(run, schema)


def with_result(docs: DataFrame, text_col: str, name: str, schema: T.StructType,
                make: Callable[[], Callable[[pa.Array], dict[str, pa.Array]]]) -> DataFrame:
    """``docs`` and a struct column ``name``, which the function that ``make`` returns gets from the text column.

    ``make`` runs once in each task, so it may unpack broadcast values. Rows keep their order and number."""
    at = docs.columns.index(text_col)
    out = T.StructType(docs.schema.fields + [T.StructField(name, schema, False)])
    names = [f.name for f in out.fields]

    def run(batches):
        of = make()
        for b in batches:
            got = of(b.column(at))
            cols = [got[f.name] if isinstance(got[f.name], pa.Array) else pa.array(got[f.name]) for f in schema.fields]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.StructArray.from_arrays(cols, [f.name for f in schema.fields])], names)

    return map_arrow(docs, run, out)
