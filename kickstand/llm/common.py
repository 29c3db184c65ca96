"""Helpers shared by the operators: the shared folder, input sizes, words, and slices of Arrow batches."""

import math
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

#: The bytes that separate words, tab to carriage return and the space.
BLANKS = b"\x09\x0a\x0b\x0c\x0d\x20"
#: The same set for Java's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark, sf_dir, table):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark):
    """Folder that driver and executors share on any master: `spark.checkpoint.dir`, else the warehouse."""
    return (spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def new_path(spark, name):
    """A path in the shared folder that nothing else uses; the file system drops it when the application ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def written(df, name):
    """Write a frame to the shared folder once and read it back: a lost executor leads back to the files only."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(df, column="text"):
    """UTF-8 bytes in a column, as a number on the driver."""
    return df.agg(F.sum(F.octet_length(column)).alias("n")).first()["n"] or 0


def pieces_for(n_bytes, each):
    """Number of groups of about `each` bytes, at least one; it grows with the input."""
    return max(1, math.ceil(n_bytes / each))


def bucket(n, *columns, seed=0):
    """Group number below n from a hash of the columns."""
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(n)).cast("int")


def utf8(column):
    """Offsets and bytes of an Arrow text or binary column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary()
    values = column.cast(kind) if column.type in (pa.binary(), pa.large_binary()) else column.cast(pa.large_string()).cast(kind)
    if values.null_count:
        values = pc.fill_null(values, b"")
    _, offsets, data = values.buffers()
    ends = np.frombuffer(offsets, np.int64)[values.offset : values.offset + len(values) + 1]
    held = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return ends - ends[0], held[ends[0] : ends[-1]]


def slices(ends, most=1 << 21):
    """Row ranges of at most `most` bytes each, a longer row alone."""
    n, at = len(ends) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, side="right")) - 1)
        yield at, to
        at = to


def table_of(byte_set):
    held = np.zeros(256, bool)
    held[list(byte_set)] = True
    return held


#: Odd 64-bit constants for mixing, and one random word per byte value; any fixed values do.
_RANDOM = np.random.default_rng(20240607)
BYTE_WORDS = _RANDOM.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x):
    """Scatter 64-bit words (the finaliser of a common 64-bit generator)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n):
    """STEP to the powers 0 .. n-1, modulo 2**64."""
    out = np.full(max(n, 1), STEP, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def run_hashes(values, starts, lengths):
    """64-bit hash of each run values[start : start + length] of per-byte words; runs ascend and do not overlap."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    held = values[np.repeat(starts, lengths) + place]
    terms = held * powers(int(lengths.max()))[place]
    sums = np.zeros(len(starts), np.uint64)
    full = lengths > 0
    sums[full] = np.add.reduceat(terms, (np.cumsum(lengths) - lengths)[full])
    return mix(sums + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_runs(data, ends):
    """(start, length, row) of each word, for rows cut at `ends`; a word never crosses rows."""
    blank = table_of(BLANKS)[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[ends] = True
    inside = ~blank
    begin = inside.copy()
    begin[1:] &= blank[:-1] | cut[1:-1]
    stop = inside.copy()
    stop[:-1] &= blank[1:] | cut[1:-1]
    starts = np.flatnonzero(begin)
    lengths = np.flatnonzero(stop) + 1 - starts
    return starts, lengths, np.searchsorted(ends, starts, side="right") - 1


def per_row(mask, ends):
    """How many positions of each row are marked."""
    total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return total[ends[1:]] - total[ends[:-1]]
