"""Remove byte strings that an earlier document holds, by run-length indexes over the repeated parts of a corpus.

Every `length`-byte window of a document belongs to its minimizer, the smallest hash among the `k`-byte words in
it; equal windows have equal minimizers, so comparing windows with the same minimizer loses nothing. A maximal
run of windows with one minimizer is a segment: its bytes hold all its windows.

1. Documents are dealt into batches of bounded size. A batch sends each distinct minimizer once, with the number
   of segments that bear it; they are summed per minimizer, and the batch is told which are unique to one
   document (nothing to do), repeated, or frequent.
2. A batch sends each distinct segment of its repeated minimizers once, with the smallest doc_id that holds it,
   to the bucket of the minimizer. Segments of frequent minimizers go as single windows to the buckets of the
   windows, so no minimizer fills a bucket.
3. A bucket builds a run-length index of its distinct segments (Burrows-Wheeler runs, positions sampled at run
   ends, smallest document per interval of equal windows) and streams the segments through it as patterns that the
   index knows nothing of: matching statistics, which run-end samples carry over every jump, mark the windows that
   match in full, and the interval of a window's row gives its smallest document.
4. A batch marks the windows whose smallest document is smaller than their own, and cuts out the marked bytes.

What is shuffled grows with the text, not with how often a passage occurs, and no task holds more than one batch
or one bucket. Hashes of 64 bits stand for minimizers, and for segments inside a batch; a bucket compares their bytes.

Null text counts as empty; texts shorter than `length` are kept whole. Rows with one doc_id do not remove each
other's bytes; a null doc_id counts as larger than all others. Empty tables give no rows; extra columns are
ignored.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from kickstand.llm import common
from kickstand.llm.run_index import RunIndex

LENGTH = 50
WORD = 16
#: Bytes of text per batch and per bucket; longest segment in windows; segments of one minimizer that go together.
BATCH_BYTES = 6 << 20
BUCKET_BYTES = 1 << 19
SEGMENT = 64
FREQUENT = 1 << 15
#: Bytes of text that are hashed at once.
HASHED = 1 << 17
LAST = np.iinfo(np.int64).max
PART = "bucket int, batch int, kind int, numbers binary, counts binary, bytes binary"
KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
UNIQUE, REPEATED, HOT = 0, 1, 2


class Batch:
    """The texts of a batch in doc_id order, and their segments."""

    def __init__(self, table, length, word):
        ids = table["doc_id"].fill_null(LAST).to_numpy()
        ends, data = common.utf8(table["text"])
        order = np.argsort(ids, kind="stable")
        sizes = np.diff(ends)[order]
        self.ids, self.ends = ids[order], np.concatenate([[0], np.cumsum(sizes)])
        self.data = np.concatenate([data[ends[i] : ends[i + 1]] for i in order] or [data])
        self.null = np.array(table["doc_id"].is_null())[order]
        self.length = length
        parts = [self._segments(int(self.ends[a]), int(self.ends[b]), a, b, length, word) for a, b in common.slices(self.ends, 1 << 17)]
        self.minimizer, self.start, self.windows, self.doc = (np.concatenate([p[i] for p in parts] or [np.zeros(0, np.int64)]) for i in range(4))
        self.minimizer = self.minimizer.astype(np.uint64)

    def _segments(self, low, high, a, b, length, word):
        """Runs of windows with one minimizer in data[low:high], the texts of documents a .. b - 1."""
        data = self.data[low:high]
        n = len(data) - length + 1
        none = np.zeros(0, np.int64)
        if n < 1:
            return none.astype(np.uint64), none, none, none
        hashes, factor, done = common.BYTE_WORDS[data], common.STEP, 1
        with np.errstate(over="ignore"):
            while done < word:
                hashes = hashes[:-done] * factor + hashes[done:]
                factor, done = factor * factor, done * 2
        least, wide, done = common.mix(hashes), length - word + 1, 1
        while done * 2 <= wide:
            least, done = np.minimum(least[:-done], least[done:]), done * 2
        if wide > done:
            least = np.minimum(least[: n], least[wide - done :][:n])
        # windows that cross into the next document are none
        ends = self.ends[a : b + 1] - low
        begins = np.ones(n + 1, bool)
        begins[1:n] = least[1:] != least[:-1]
        begins[ends[:-1][ends[:-1] < n]] = True
        run = np.flatnonzero(begins)
        run, stop = run[:-1], run[1:]
        doc = np.searchsorted(ends, run, side="right") - 1
        # a run ends where the next begins or the document's windows end
        stop = np.minimum(stop, ends[doc + 1] - length + 1)
        run, stop, doc = run[run < stop], stop[run < stop], doc[run < stop]
        pieces = -(-(stop - run) // SEGMENT)
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = np.repeat(run, pieces) + nth * SEGMENT
        windows = np.minimum(np.repeat(stop, pieces) - start, SEGMENT)
        # minima crowd at the low end: mixed again they spread evenly over the buckets
        return common.mix(least[start]), start + low, windows, np.repeat(doc, pieces) + a

    def _by_minimizer(self):
        """Segments in order of their minimizers, and which of them are the first of theirs."""
        order = np.argsort(self.minimizer, kind="stable")
        m = self.minimizer[order]
        new = np.ones(len(m), bool)
        new[1:] = m[1:] != m[:-1]
        return order, new

    def minimizers(self):
        """Distinct minimizers in order, segments of each, and whether two documents of the batch bear it."""
        order, new = self._by_minimizer()
        first, doc = np.flatnonzero(new), self.ids[self.doc[order]]
        many = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first) if len(doc) else np.zeros(0, bool)
        return self.minimizer[order[first]], np.diff(np.append(first, len(doc))), many

    def strings(self, status, n_buckets):
        """Occurrences of repeated segments: bucket-ordered distinct strings with their owners, and which string
        each occurrence is. Frequent minimizers give their windows one by one."""
        by_minimizer, new = self._by_minimizer()
        state = np.empty(len(new), np.uint8)
        state[by_minimizer] = status[np.cumsum(new) - 1]
        whole, hot = np.flatnonzero(state == REPEATED), np.flatnonzero(state == HOT)
        count = self.windows[hot]
        nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        start = np.concatenate([self.start[whole], np.repeat(self.start[hot], count) + nth])
        windows = np.concatenate([self.windows[whole], np.ones(len(nth), np.int64)])
        doc = self.ids[np.concatenate([self.doc[whole], np.repeat(self.doc[hot], count)])]
        size = windows + self.length - 1
        hashes = np.concatenate([_string_hashes(self.data, x, n) for x, n in zip(np.split(start, [len(whole)]), np.split(size, [len(whole)]), strict=True)])
        key = np.concatenate([self.minimizer[whole], hashes[len(whole) :]])
        bucket = (common.mix(key) % np.uint64(n_buckets)).astype(np.int64)
        # equal strings have one bucket: bucket and the hash's leading bits order them in one word
        bits = np.uint64(max(1, int(n_buckets).bit_length()))
        order = np.argsort(bucket.astype(np.uint64) << (np.uint64(64) - bits) | hashes >> bits, kind="stable")
        b, h = bucket[order], hashes[order]
        new = np.ones(len(order), bool)
        new[1:] = (b[1:] != b[:-1]) | (h[1:] != h[:-1])
        first = np.flatnonzero(new)
        string = np.empty(len(order), np.int64)
        string[order] = np.cumsum(new) - 1
        at = order[first]
        owner = np.minimum.reduceat(doc[order], first) if len(first) else doc[:0]
        return {"bucket": b[first], "start": start[at], "size": size[at], "owner": owner}, start, doc, string


def _string_hashes(data, starts, sizes):
    """Hash of each data[start : start + size], from sums over the data: the strings may overlap. The starts ascend, so
    slices of the data that stay in the cache do, and the powers are those of one slice."""
    out = np.empty(len(starts), np.uint64)
    if not len(starts):
        return out
    wide = min(len(data), HASHED + int(sizes.max()))
    powers = common.powers(wide + 1)
    # dividing by a power of an odd number: the inverse of STEP to that power
    inverse = np.full(min(len(data), HASHED), np.uint64(pow(int(common.STEP), -1, 1 << 64)), np.uint64)
    inverse[0] = 1
    inverse = np.multiply.accumulate(inverse)
    sums = np.zeros(wide + 1, np.uint64)
    for low in range(0, len(data), HASHED):
        a, b = np.searchsorted(starts, [low, low + HASHED])
        part = data[low : low + wide]
        np.cumsum(common.BYTE_WORDS[part] * powers[: len(part)], out=sums[1 : len(part) + 1])
        at = starts[a:b] - low
        out[a:b] = (sums[at + sizes[a:b]] - sums[at]) * inverse[at]
    return common.mix(out + sizes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _gather(data, starts, sizes):
    at = np.cumsum(sizes) - sizes
    return data[np.repeat(starts - at, sizes) + np.arange(sizes.sum())]


def _parts(buckets, batch, kind, rows):
    """Rows of PART from (numbers, counts, bytes) per bucket."""
    return pa.table(
        {
            "bucket": pa.array(buckets, pa.int32()),
            "batch": pa.array([batch] * len(buckets), pa.int32()),
            "kind": pa.array([kind] * len(buckets), pa.int32()),
            "numbers": pa.array([r[0] for r in rows], pa.binary()),
            "counts": pa.array([r[1] for r in rows], pa.binary()),
            "bytes": pa.array([r[2] for r in rows], pa.binary()),
        }
    )


def _runs(buckets):
    """Begins and ends of the runs of equal buckets, none of none."""
    begins = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1]])) if len(buckets) else np.zeros(0, np.int64)
    return begins, np.append(begins[1:], len(buckets))[: len(begins)]


def _bucket_of(minimizers, n_buckets):
    """Buckets of minimizers in order are ranges, so each bucket's part of a sorted list is a slice."""
    return ((minimizers >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int64)


def _sketch(length, word, n_buckets):
    """Batch -> per bucket its distinct minimizers (48 bits, low and high parts apart), segment counts, document flags."""

    def run(key, table):
        distinct, counts, many = Batch(table, length, word).minimizers()
        bucket = _bucket_of(distinct, n_buckets)
        cuts, stops = _runs(bucket)
        rows = []
        for a, b in zip(cuts, stops, strict=True):
            m = distinct[a:b] >> np.uint64(16)
            low, high = (m & np.uint64(0xFFFFFFFF)).astype("<u4"), (m >> np.uint64(32)).astype("<u2")
            rows.append((high.tobytes() + low.tobytes(), np.minimum(counts[a:b], 65535).astype("<u2").tobytes(), many[a:b].astype(np.uint8).tobytes()))
        return _parts(bucket[cuts].tolist(), key[0].as_py(), 0, rows)

    return run


def _classify(frequent):
    """Bucket of minimizers -> per batch the state of each of its minimizers, in the batch's order."""

    def run(key, table):
        held, counts, many, sizes = [], [], [], []
        for row in table.to_pylist():
            n = len(row["bytes"])
            high, low = np.frombuffer(row["numbers"], "<u2", n), np.frombuffer(row["numbers"], "<u4", n, 2 * n)
            held.append(high.astype(np.uint64) << np.uint64(32) | low)
            counts.append(np.frombuffer(row["counts"], "<u2"))
            many.append(np.frombuffer(row["bytes"], np.uint8))
            sizes.append(n)
        held, counts, many = np.concatenate(held), np.concatenate(counts).astype(np.int64), np.concatenate(many).astype(np.int64)
        order = np.argsort(held, kind="stable")
        group = np.cumsum(np.concatenate([[0], held[order][1:] != held[order][:-1]]))
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        docs, total = np.add.reduceat(1 + many[order], first), np.add.reduceat(counts[order], first)
        state = np.where(docs < 2, UNIQUE, np.where(total < frequent, REPEATED, HOT)).astype(np.uint8)
        out = np.empty(len(held), np.uint8)
        out[order] = state[group]
        ends = np.cumsum(sizes)
        rows = [(b"", b"", out[e - n : e].tobytes()) for e, n in zip(ends, sizes, strict=True)]
        return pa.table(
            {
                "bucket": table["bucket"],
                "batch": table["batch"],
                "kind": pa.array([0] * len(rows), pa.int32()),
                "numbers": pa.array([r[0] for r in rows], pa.binary()),
                "counts": pa.array([r[1] for r in rows], pa.binary()),
                "bytes": pa.array([r[2] for r in rows], pa.binary()),
            }
        )

    return run


def _states(rows):
    """States of all of a batch's minimizers: its buckets' parts in order."""
    rows = sorted((r for r in rows if r["kind"] == 0), key=lambda r: r["bucket"])
    return np.frombuffer(b"".join(r["bytes"] for r in rows), np.uint8)


def _send(length, word, n_buckets):
    """Batch and its states -> its distinct repeated segments per bucket."""

    def run(key, table, told):
        rows = []
        batch = Batch(table, length, word)
        strings, *_ = batch.strings(_states(told.to_pylist()), n_buckets)
        cuts, stops = _runs(strings["bucket"])
        for a, b in zip(cuts, stops, strict=True):
            size = strings["size"][a:b]
            rows.append((strings["owner"][a:b].astype("<i8").tobytes(), size.astype("<u2").tobytes(), _gather(batch.data, strings["start"][a:b], size).tobytes()))
        return _parts(strings["bucket"][cuts].tolist(), key[0].as_py(), 1, rows)

    return run


def _same(data, starts, sizes, at, size, string):
    """Whether each string data[starts : starts + sizes] (one behind the other) equals its representative."""
    if (size[string] != sizes).any():
        return False
    return bool((_gather(data, at[string], sizes) == data).all())


def _match(length):
    """Bucket of segments -> per batch, the smallest document of each window of its segments, as runs."""

    def run(key, table):
        rows = table.to_pylist()
        owners = np.concatenate([np.frombuffer(r["numbers"], "<i8") for r in rows])
        sizes = np.concatenate([np.frombuffer(r["counts"], "<u2") for r in rows]).astype(np.int64)
        data = np.frombuffer(b"".join(r["bytes"] for r in rows), np.uint8)
        n_each = [len(r["numbers"]) // 8 for r in rows]
        starts = np.cumsum(sizes) - sizes
        hashes = common.run_hashes(common.BYTE_WORDS[data], starts, sizes)
        order = np.argsort(hashes, kind="stable")
        new = np.concatenate([[True], hashes[order][1:] != hashes[order][:-1]])
        first = np.flatnonzero(new)
        string = np.empty(len(order), np.int64)
        string[order] = np.cumsum(new) - 1
        at, size = starts[order[first]], sizes[order[first]]
        if not _same(data, starts, sizes, at, size, string):
            # two strings of one hash: told apart by their bytes
            held = [data[a : a + n].tobytes() for a, n in zip(starts, sizes, strict=True)]
            number = {s: i for i, s in enumerate(dict.fromkeys(held))}
            string = np.array([number[s] for s in held])
            order = np.argsort(string, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], string[order][1:] != string[order][:-1]]))
            at, size = starts[order[first]], sizes[order[first]]
        owner = np.minimum.reduceat(owners[order], first)
        ends = np.concatenate([[0], np.cumsum(size)])
        distinct = _gather(data, at, size)
        index = RunIndex(distinct, ends, owner, length)
        matched, found = index.matching_statistics(distinct, ends)
        windows = size - length + 1
        w_ends = np.concatenate([[0], np.cumsum(windows)])
        w_string = np.repeat(np.arange(len(size)), windows)
        w_at = ends[w_string] + np.arange(w_ends[-1]) - w_ends[w_string]
        least = np.where(matched[w_at] >= length, index.least_owner(found[w_at]), owner[w_string])
        # runs of equal documents inside a string
        begins = np.ones(len(least), bool)
        begins[1:] = (least[1:] != least[:-1]) | (w_string[1:] != w_string[:-1])
        run_at = np.flatnonzero(begins)
        run_size, run_doc = np.diff(np.append(run_at, len(least))), least[run_at]
        n_runs = np.bincount(w_string[run_at], minlength=len(size))
        run_first = np.cumsum(n_runs) - n_runs
        out, done = [], 0
        for n in n_each:
            s = string[done : done + n]
            done += n
            k = n_runs[s]
            pick = np.repeat(run_first[s] - (np.cumsum(k) - k), k) + np.arange(k.sum())
            out.append((run_doc[pick].astype("<i8").tobytes(), k.astype(np.uint8).tobytes(), run_size[pick].astype(np.uint8).tobytes()))
        return pa.table(
            {
                "bucket": table["bucket"],
                "batch": table["batch"],
                "kind": pa.array([1] * len(out), pa.int32()),
                "numbers": pa.array([r[0] for r in out], pa.binary()),
                "counts": pa.array([r[1] for r in out], pa.binary()),
                "bytes": pa.array([r[2] for r in out], pa.binary()),
            }
        )

    return run


def _cut_out(length, word, n_buckets):
    """Batch, its states and its matches -> its documents without the bytes that earlier documents hold."""

    def run(key, table, told):
        told = told.to_pylist()
        batch = Batch(table, length, word)
        strings, start, doc, string = batch.strings(_states(told), n_buckets)
        replies = sorted((r for r in told if r["kind"] == 1), key=lambda r: r["bucket"])
        run_doc = np.frombuffer(b"".join(r["numbers"] for r in replies), "<i8")
        n_runs = np.frombuffer(b"".join(r["counts"] for r in replies), np.uint8).astype(np.int64)
        run_size = np.frombuffer(b"".join(r["bytes"] for r in replies), np.uint8).astype(np.int64)
        edges = np.zeros(len(batch.data) + 1, np.int64)
        if len(string):
            offset = np.cumsum(run_size) - run_size
            first = np.cumsum(n_runs) - n_runs
            offset = offset - np.repeat(offset[first], n_runs)
            k = n_runs[string]
            pick = np.repeat(first[string] - (np.cumsum(k) - k), k) + np.arange(k.sum())
            own, at = np.repeat(doc, k), np.repeat(start, k) + offset[pick]
            held = run_doc[pick] < own
            edges += np.bincount(at[held], minlength=len(edges))
            edges -= np.bincount((at + run_size[pick] + length - 1)[held], minlength=len(edges))
        gone = np.cumsum(edges[:-1]) > 0
        opens = gone.copy()
        opens[1:] &= ~gone[:-1]
        opens[batch.ends[:-1][batch.ends[:-1] < len(gone)]] |= gone[batch.ends[:-1][batch.ends[:-1] < len(gone)]]
        kept = [batch.data[a:b][~gone[a:b]].tobytes() for a, b in zip(batch.ends[:-1], batch.ends[1:], strict=True)]
        return pa.table(
            {
                "doc_id": pa.array(batch.ids, pa.int64(), mask=batch.null),
                "n_bytes": pa.array(np.diff(batch.ends), pa.int64()),
                "n_removed": pa.array(common.per_row(gone, batch.ends), pa.int64()),
                "n_spans": pa.array(common.per_row(opens, batch.ends), pa.int64()),
                "kept": pa.array(kept, pa.binary()),
            }
        )

    return run


def remove_repeats(docs, length=LENGTH, word=WORD, batch_bytes=BATCH_BYTES, bucket_bytes=BUCKET_BYTES, frequent=FREQUENT):
    """doc_id, n_bytes, n_removed, n_spans and kept (the remaining bytes) of every row of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = common.text_bytes(docs)
    n_batches, n_buckets = common.pieces_for(total, batch_bytes), common.pieces_for(total, bucket_bytes)
    dealt = docs.withColumn("batch", common.bucket(n_batches, "doc_id", seed=1))
    batches = dealt.groupBy("batch")
    sketches = batches.applyInArrow(_sketch(length, word, n_buckets), PART)
    states = sketches.groupBy("bucket").applyInArrow(_classify(frequent), PART)
    sent = batches.cogroup(states.groupBy("batch")).applyInArrow(_send(length, word, n_buckets), PART)
    matches = sent.groupBy("bucket").applyInArrow(_match(length), PART)
    told = states.union(matches)
    return batches.cogroup(told.groupBy("batch")).applyInArrow(_cut_out(length, word, n_buckets), KEPT)
