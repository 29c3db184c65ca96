"""Token ids of documents in flat binary files with 64-bit document offsets.

Documents are placed by range of doc_id, so partition k holds smaller ids than partition k+1 and the files in
partition order are the corpus in doc_id order. A partition writes two files: `part-NNNNN.bin`, the ids of its
documents as unsigned little-endian integers (2 bytes if every id fits, else 4), and `part-NNNNN.idx`, 64-bit
little-endian integers: the doc_ids, then n + 1 offsets in ids. A manifest table names them with their counts;
the ids before a partition are the prefix sum of the counts of the partitions before it.

A task writes under a name of its own attempt and renames at the end, so a repeated attempt replaces a whole
file by an equal one. The manifest is itself written to the shared folder before anything reads the files.

Null text counts as empty (its only id is the end id); an empty table gives an empty manifest; equal doc_ids
stay separate documents, in no fixed order among themselves; a null doc_id sorts first and is read back as null.
"""

import zlib
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Window
from pyspark.sql import functions as F

from kickstand.llm import common, tokens

PARTITION_BYTES = 32 << 20
MANIFEST = "part int, n_docs long, n_tokens long, width int, bin string, idx string"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"
NO_ID = np.iinfo(np.int64).min


def _place(uri):
    return pyarrow.fs.FileSystem.from_uri(uri)


def _writer(folder, tokenizer, end_id):
    def write(batches):
        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is None:
            return
        encoder = tokens.encoder(tokenizer, end_id)
        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        store, root = _place(folder)
        store.create_dir(root, recursive=True)
        names = [f"{root}/part-{part:05d}.{kind}" for kind in ("bin", "idx")]
        drafts = [f"{name}.{attempt}" for name in names]
        doc_ids, sizes = [], [np.zeros(1, np.int64)]
        with store.open_output_stream(drafts[0]) as out:
            for batch in (b for bs in ([first], batches) for b in bs):
                doc_ids.append(batch["doc_id"].fill_null(NO_ID).to_numpy(zero_copy_only=False).astype("<i8"))
                held = [encoder.encode(t.as_py()) for t in batch["text"]]
                sizes.append(np.array([len(ids) for ids in held], np.int64) // encoder.width)
                for ids in held:
                    out.write(ids)
        offsets = np.cumsum(np.concatenate(sizes)).astype("<i8")
        with store.open_output_stream(drafts[1]) as out:
            out.write(np.concatenate(doc_ids).tobytes())
            out.write(offsets.tobytes())
        for draft, name in zip(drafts, names, strict=True):
            store.move(draft, name)
        row = [part, len(offsets) - 1, int(offsets[-1]), encoder.width] + [f"{folder}/part-{part:05d}.{kind}" for kind in ("bin", "idx")]
        yield pa.RecordBatch.from_pydict(
            {n: pa.array([v], t) for n, v, t in zip(("part", "n_docs", "n_tokens", "width", "bin", "idx"), row, (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string()), strict=True)}
        )

    return write


def write_tokens(docs, tokenizer, folder=None, end_id=2):
    """Write the files of `docs` (doc_id, text; other columns are not read) and return their manifest with `base`."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    folder = folder or common.new_path(spark, "tokens")
    n = max(common.pieces_for(common.text_bytes(docs), PARTITION_BYTES), spark.sparkContext.defaultParallelism)
    placed = docs.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id")
    manifest = common.written(placed.mapInArrow(_writer(folder, tokenizer, end_id), MANIFEST), "tokens-manifest")
    # one row per partition: the frame of the prefix sum is as small as the list of files
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def _open(uri, dtype):
    """Memory-mapped where the file is on a mounted file system, else read."""
    store, path = _place(uri)
    if urlparse(uri).scheme in ("", "file"):
        return np.memmap(path, dtype, "r")
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


def _reader(batches):
    for batch in batches:
        for row in batch.to_pylist():
            ids, index = _open(row["bin"], f"<u{row['width']}"), _open(row["idx"], "<i8")
            n = row["n_docs"]
            doc_ids, offsets = index[:n], index[n:]
            for at in range(0, n, 10_000):
                ends = offsets[at : at + 10_001]
                crcs = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                held = doc_ids[at : at + 10_000]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(held, pa.int64(), mask=held == NO_ID),
                        "start": pa.array(row["base"] + ends[:-1], pa.int64()),
                        "n_tokens": pa.array(np.diff(ends), pa.int64()),
                        "ids_crc32": pa.array(crcs, pa.int64()),
                    }
                )


def read_tokens(manifest):
    """One row per document from the files: where its ids start in the corpus, how many, and their checksum."""
    n = manifest.sparkSession.sparkContext.defaultParallelism * 4
    return manifest.repartition(n, "part").mapInArrow(_reader, READ)
