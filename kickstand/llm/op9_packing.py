"""Pack documents into sequences of bounded length by first-fit decreasing over a tournament tree.

Documents are dealt at random (by hash of doc_id) into groups of bounded size and each group is packed on its
own; `pack_in_order` takes groups that follow each other in the order of the documents' files instead, and its
sequence ids ascend with the groups. A document longer than a sequence fills whole sequences first; what is left of every document is placed,
longest first, in the first open sequence with room. A tournament tree over the room of the sequences finds
that sequence in logarithmic time: an inner node holds the larger room of its two children.

A sequence is padded to the full length unless its length is a power of two. So a sequence that the packing
leaves far from full (usually the last of a group) is cut into sequences of power-of-two lengths, largest
first, which need no padding at all.

Null text counts as empty: the document is its end id. Each row is a document of its own, also where doc_ids
repeat. An empty table gives no pieces. Extra columns are ignored.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Window
from pyspark.sql import functions as F

from kickstand.llm import common, tokens

LENGTH = 4096
GROUP_BYTES = 12 << 20
#: What a row counts beside its text where groups follow the order of files.
ROW_BYTES = 16
#: A sequence with at least so much room left is cut into powers of two.
LOOSE = 64
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Tournament:
    """Rooms of `n` open sequences of `length`; finds the first with enough room."""

    def __init__(self, n, length):
        self.leaves = 1 << max(0, n - 1).bit_length()
        self.room = [length] * (2 * self.leaves)

    def place(self, size):
        """First sequence with room for `size`, whose room shrinks by it; its room before is what the tree compares."""
        room, at = self.room, 1
        while at < self.leaves:
            at *= 2
            if room[at] < size:
                at += 1
        room[at] -= size
        leaf = at - self.leaves
        while at > 1:
            at //= 2
            larger = max(room[2 * at], room[2 * at + 1])
            if room[at] == larger:
                break
            room[at] = larger
        return leaf


def first_fit_decreasing(sizes, length):
    """Bin of each size (all at most `length`), longest first and earlier ones first among equals."""
    bins = [0] * len(sizes)
    if not len(sizes):
        return bins
    tree = Tournament(len(sizes), length)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        bins[i] = tree.place(sizes[i])
    return bins


def pack(sizes, length=LENGTH, loose=LOOSE):
    """Pieces (document, start, size, sequence, offset) that cover each document once; sequences count from 0."""
    pieces, rest, n_sequences = [], [], 0
    for doc, size in enumerate(sizes):
        full = size // length
        for k in range(full):
            pieces.append((doc, k * length, length, n_sequences, 0))
            n_sequences += 1
        if size > full * length:
            rest.append((doc, full * length, size - full * length))
    bins = {}
    for piece, b in zip(rest, first_fit_decreasing([r[2] for r in rest], length), strict=True):
        bins.setdefault(b, []).append(piece)
    for b in sorted(bins):
        held = bins[b]
        filled = sum(size for _, _, size in held)
        cuts = [filled]
        if length - filled >= loose:
            cuts = [1 << k for k in range(filled.bit_length() - 1, -1, -1) if filled >> k & 1]
        offset, room = 0, cuts.pop(0)
        for doc, start, size in held:
            while size:
                took = min(size, room)
                pieces.append((doc, start, took, n_sequences, offset))
                start, size, room, offset = start + took, size - took, room - took, offset + took
                if not room:
                    n_sequences += 1
                    offset, room = 0, cuts.pop(0) if cuts else 0
    return pieces


def _packer(tokenizer, end_id, length, with_ids):
    def run(key, table):
        encoder = tokens.encoder(tokenizer, end_id)
        doc_ids = table["doc_id"].to_pylist()
        # order of arrival differs between runs: ids settle it, then the text
        texts = table["text"].to_pylist()
        order = sorted(range(len(texts)), key=lambda i: (doc_ids[i] is None, doc_ids[i] or 0, texts[i] or ""))
        if "row" in table.column_names:
            places = list(zip(table["file"].to_pylist(), table["row"].to_pylist(), strict=True))
            order = sorted(range(len(texts)), key=lambda i: places[i])
        held = [encoder.encode(texts[i]) for i in order]
        del texts
        sizes = [len(ids) // encoder.width for ids in held]
        base = key[0].as_py() << 32
        rows = pack(sizes, length)

        def ids(row):
            return np.frombuffer(held[row[0]], encoder.dtype, row[2], row[1] * encoder.width).astype("<u4")

        columns = {
            "doc_id": pa.array([doc_ids[order[r[0]]] for r in rows], pa.int64()),
            "start": pa.array([r[1] for r in rows], pa.int64()),
            "length": pa.array([r[2] for r in rows], pa.int64()),
            "ids_crc32": pa.array([zlib.crc32(ids(r).tobytes()) for r in rows], pa.int64()),
            "doc_tokens": pa.array([sizes[r[0]] for r in rows], pa.int64()),
            "sequence_id": pa.array([base + r[3] for r in rows], pa.int64()),
            "offset": pa.array([r[4] for r in rows], pa.int64()),
        }
        if with_ids:
            columns["ids"] = pa.array([ids(r).astype(np.int32) for r in rows], pa.list_(pa.int32()))
        return pa.table(columns)

    return run


def pack_documents(docs, tokenizer, length=LENGTH, end_id=2, group_bytes=GROUP_BYTES, with_ids=False):
    """One row per piece of a document: its place in the document and in its sequence; `with_ids` adds its ids."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n = common.pieces_for(common.text_bytes(docs), group_bytes)
    grouped = docs.withColumn("group", common.bucket(n, "doc_id", seed=9)).groupBy("group")
    return grouped.applyInArrow(_packer(tokenizer, end_id, length, with_ids), PIECES + (", ids array<int>" if with_ids else ""))


def pack_in_order(docs, tokenizer, length=LENGTH, end_id=2, group_bytes=GROUP_BYTES, with_ids=False):
    """As pack_documents, but groups are ranges of the order in which the documents' Parquet files hold them (by file
    name, then row), each of about `group_bytes`; a group and its sequence ids ascend with that order."""
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:
        docs = common.written(docs, "packing-order")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    # a row without text counts too, so that a group's rows are bounded as its bytes are
    sizes = docs.select("file", "row", (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES).cast("long").alias("size"))
    # one number a file, which the driver lists anyhow: the bytes of the files before it
    offsets, total = [], 0
    for r in sizes.groupBy("file").agg(F.sum("size").alias("n")).orderBy("file").collect():
        offsets.append((r["file"], total))
        total += r["n"]
    files = docs.sparkSession.createDataFrame(offsets, "file string, before long")
    inside = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(F.broadcast(files), "file")
    starts = starts.groupBy("file", F.expr(f"(before + inside) div {group_bytes}").cast("int").alias("group")).agg(F.min("row").alias("from"))
    starts = starts.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("from", "group"))).alias("starts"))
    grouped = docs.join(F.broadcast(starts), "file")
    group = F.element_at(F.filter("starts", lambda s: s["from"] <= F.col("row")), -1)["group"]
    grouped = grouped.select("doc_id", "text", "file", "row", group.alias("group")).groupBy("group")
    return grouped.applyInArrow(_packer(tokenizer, end_id, length, with_ids), PIECES + (", ids array<int>" if with_ids else ""))
