"""Texts cut into slices of bounded size, each a list of word codes beside a dictionary of its own.

Statistics of words that need the whole corpus (counts, ids) travel by dictionary: a slice sends each distinct word
once, Spark brings equal words together, and the answer goes back to the slice by its number. So a word that every
text holds costs a row per slice, no vocabulary has to fit in one task, and words are compared as text, not by hash.
"""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext

from kickstand.llm import common

#: Text of a slice; parts of a slice's number and of a word's place (slice and code), in bits.
SLICE_BYTES = 8 << 20
SEQUENCE_BITS = 13
CODE_BITS = 24
#: ASCII capitals to small letters, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def slice_numbers():
    """Numbers that no other slice of the job bears: the task's partition, then a running number."""
    partition = TaskContext.get().partitionId()
    for i in range(1 << SEQUENCE_BITS):
        yield partition << SEQUENCE_BITS | i
    raise ValueError("a partition holds more slices than numbers; read the input in smaller partitions")


def word_runs(data, apart):
    """(start, length) of the runs of bytes that the table `apart` does not name."""
    edges = np.flatnonzero(np.diff(np.concatenate([[True], apart[data], [True]])))
    return edges[::2], edges[1::2] - edges[::2]


def dictionary(data, starts, lengths):
    """Code of each word data[start : start + length] (ascending, apart), and the distinct words in order of code."""
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] = 1
    inside[starts + lengths] -= 1
    letters = data[np.cumsum(inside[:-1], dtype=np.int8) > 0]
    offsets = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(letters))])
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int32), coded.dictionary.cast(pa.large_string()).cast(pa.string())


def packed(numbers):
    """Numbers as compressed bytes, in the narrowest width that holds them; the first byte tells the width."""
    top = int(numbers.max()) if len(numbers) else 0
    width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    body = numbers.astype(f"<u{width}").tobytes()
    return bytes([width]) + len(numbers).to_bytes(8, "little") + (pa.compress(body, "zstd", asbytes=True) if body else b"")


def unpacked(held):
    """What `packed` packed, as int64."""
    width, n = held[0], int.from_bytes(held[1:9], "little")
    body = pa.decompress(held[9:], n * width, "zstd", asbytes=True) if n else b""
    return np.frombuffer(body, f"<u{width}").astype(np.int64)


def list_of(values, ends):
    """Arrow lists values[ends[i] : ends[i + 1]]."""
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def texts(column):
    """Texts of an Arrow column as bytes, nulls empty."""
    ends, data = common.utf8(column)
    return [data[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
