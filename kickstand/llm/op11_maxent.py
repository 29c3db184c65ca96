"""Texts scored by a hashed maximum-entropy language model with a class-factored softmax.

A token's probability is `P(class | context) * P(bucket | class, context) * P(token | bucket)`. The `SINGLES` most
frequent tokens have a bucket each, all others share hashed buckets; `MEMBERS` buckets make a class, in order of
frequency. Class and bucket come from two softmaxes over the sum of a bias (from counts) and one weight row per
active feature: the token before, the two before (n-grams), and the one before the last (skip), all hashed into
`ROWS` rows, for the bucket together with its class. Inside a bucket a token counts by absolute discounting, which
leaves the discounted part to tokens that training never saw; so the probabilities of all known tokens and of "a token unseen
in this bucket" sum to one.

Training. Every task takes gradient steps (AdaGrad, in sparse batches: only rows that a batch touches) on the
training documents of its slices, starting from the shared weights. What the tasks changed is averaged row by row,
weighted by how many tokens touched the row in each task, in two steps of bounded groups; the averaged weights start
the next round. The model has a fixed size (`ROWS`, `CLASSES`, `MEMBERS`: 4 MB), so it may be broadcast.

Counts of all words travel by slice dictionaries (`wordslices`): exact, over all training documents, no vocabulary
in one place.

Documents whose id has crc32 (of its text form) modulo `FOLDS` equal to 1 are held out of training. A null id trains. Null or empty
text is the end token alone. Each row is a document of its own, also where ids repeat. An empty table gives no rows.
Extra columns are not read. Memory follows the longest document, which is never cut.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Window
from pyspark.sql import functions as F

from kickstand.llm import common
from kickstand.llm import wordslices as W

FOLDS, HELD_OUT = 5, 1
#: Size of the model: weight rows, classes, buckets of a class, and how many of all buckets hold one token alone.
ROWS, CLASSES, MEMBERS, SINGLES = 1 << 14, 32, 32, 512
BUCKETS = CLASSES * MEMBERS
ROUNDS, RATE, BATCH = 1, 0.1, 8192
#: Gradient steps that a slice is good for, and the tokens of one.
STEPS, LEAST_BATCH, MOST_BATCH = 40, 2048, 32768
#: What a row keeps of its change: as if so many more tokens had touched it and asked for none.
PRIOR = 50
#: Rows of a table that travel together when weights are averaged.
BLOCK = 256
#: Stands for the end of a text among its words, which hold no blank.
END = " "
_APART = common.table_of(common.BLANKS)
#: What stands before a text's first token: its end token.
EDGE = common.mix(np.array([0x5851F42D4C957F2D], np.uint64)) & np.uint64(0xFFFFFFFF)
SLICES = (
    "slice long, doc_ids array<long>, held array<boolean>, ends binary, codes binary, hashes binary, words array<string>, counts array<long>"
)
CODED = "doc_ids array<long>, held array<boolean>, ends binary, codes binary, hashes binary, counts binary, buckets binary"


# --- slices -----------------------------------------------------------------------


def _slice(number, docs):
    """One row of SLICES from (doc_id, held out, bytes of the text)."""
    ends = np.cumsum([0] + [len(t) + 1 for _, _, t in docs])
    data = W.LOWER[np.frombuffer(b"".join(t + b"\n" for _, _, t in docs), np.uint8)]
    starts, lengths = W.word_runs(data, _APART)
    codes, words = W.dictionary(data, starts, lengths)
    # where each word stands first: written from the back, the first place comes last
    first = np.empty(len(words), np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    hashes = common.run_hashes(common.BYTE_WORDS[data], starts[first], lengths[first]) if len(words) else np.zeros(0, np.uint64)
    # the end of each text goes behind its words, as code 0
    per_doc = np.diff(np.searchsorted(starts, ends))
    token_ends = np.cumsum(per_doc + 1)
    tokens = np.zeros(token_ends[-1], np.int64)
    inside = np.ones(len(tokens), bool)
    inside[token_ends - 1] = False
    tokens[inside] = codes + 1
    held = np.array([h for _, h, _ in docs])
    trained = np.repeat(~held, per_doc + 1)
    words = pa.concat_arrays([pa.array([END], pa.string()), words])
    counts = np.bincount(tokens[trained], minlength=len(words))
    hashes = np.concatenate([EDGE, hashes & np.uint64(0xFFFFFFFF)])
    columns = [
        pa.array([number], pa.int64()),
        W.list_of(pa.array([d for d, _, _ in docs], pa.int64()), [0, len(docs)]),
        W.list_of(pa.array(held, pa.bool_()), [0, len(docs)]),
        pa.array([W.packed(token_ends)], pa.binary()),
        pa.array([W.packed(tokens)], pa.binary()),
        pa.array([W.packed(hashes)], pa.binary()),
        W.list_of(words, [0, len(words)]),
        W.list_of(pa.array(counts, pa.int64()), [0, len(counts)]),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["slice", "doc_ids", "held", "ends", "codes", "hashes", "words", "counts"])


def _slicer(size):
    def run(batches):
        numbers = W.slice_numbers()
        docs, held = [], 0
        for batch in batches:
            for doc in zip(batch["doc_id"].to_pylist(), batch["held_out"].to_pylist(), W.texts(batch["text"]), strict=True):
                docs.append(doc)
                held += len(doc[2]) + 64
                if held >= size:
                    yield _slice(next(numbers), docs)
                    docs, held = [], 0
        if docs:
            yield _slice(next(numbers), docs)

    return run


def _code(key, slices, told):
    """A slice and what it was told of its words -> the slice in numbers alone."""
    names = ["doc_ids", "held", "ends", "codes", "hashes"]
    schema = pa.schema([slices.schema.field(n) for n in names] + [("counts", pa.binary()), ("buckets", pa.binary())])
    if not slices.num_rows:
        return schema.empty_table()
    order = np.argsort(told["code"].to_numpy())
    added = [pa.array([W.packed(told[c].to_numpy()[order].astype(np.int64))], pa.binary()) for c in ("c", "bucket")]
    return pa.Table.from_arrays([*(slices[n].combine_chunks() for n in names), *added], schema=schema)


class Coded:
    """The tokens of a slice: features of their contexts, buckets, counts, and where documents end."""

    def __init__(self, row):
        codes = W.unpacked(row["codes"])
        self.doc_ids, self.held, self.ends = row["doc_ids"], np.array(row["held"], bool), W.unpacked(row["ends"])
        self.counts, self.buckets = W.unpacked(row["counts"])[codes], W.unpacked(row["buckets"])[codes]
        self.doc = np.repeat(np.arange(len(self.ends)), np.diff(self.ends, prepend=0))
        hashes = W.unpacked(row["hashes"]).astype(np.uint64)[codes]
        start = np.concatenate([[0], self.ends[:-1]])
        one, two = np.concatenate([[0], hashes[:-1]]).astype(np.uint64), np.concatenate([[0, 0], hashes[:-2]])[: len(hashes)].astype(np.uint64)
        one[start] = two[start] = EDGE[0]
        second = start + 1
        two[second[second < self.ends]] = EDGE[0]
        with np.errstate(over="ignore"):
            self.features = np.stack(
                [common.mix(one * np.uint64(3) + np.uint64(1) << np.uint64(2)), common.mix((one * np.uint64(0x9E3779B1) + two) << np.uint64(2) | np.uint64(1)), common.mix(two << np.uint64(2) | np.uint64(2))]
            )


# --- the model --------------------------------------------------------------------


class Model:
    """Weights of both softmaxes, and what counts tell: biases and the discounted share of tokens in a bucket."""

    def __init__(self, bucket_counts, bucket_words, n1, n2, weights=None):
        # table, outcome, row: what is summed and compared lies in lines of one outcome
        self.weights = np.zeros((2, CLASSES, ROWS), np.float32) if weights is None else weights
        self.bucket_counts, self.bucket_words = bucket_counts, bucket_words
        self.discount = min(max(n1 / (n1 + 2 * n2) if n1 else 0.5, 0.05), 0.95)
        mass = (bucket_counts + 0.5).reshape(CLASSES, MEMBERS)
        self.class_bias = np.log(mass.sum(1)).astype(np.float32)[:, None]
        self.member_bias = np.log(mass).T.astype(np.float32)

    def rows(self, coded, at):
        """Weight rows of the tokens `at`: (features, tokens) for classes and for members, and their targets."""
        features, buckets = coded.features[:, at], coded.buckets[at]
        classes, members = buckets // MEMBERS, buckets % MEMBERS
        mask = np.uint64(ROWS - 1)
        with np.errstate(over="ignore"):
            inner = common.mix(features + (classes.astype(np.uint64) + np.uint64(1)) * common.STEP)
        return (features & mask).astype(np.int64), (inner & mask).astype(np.int64), classes, members

    def both(self, coded, at):
        """Per table: number, rows, targets and logits (outcome, token) of the tokens `at`."""
        outer, inner, classes, members = self.rows(coded, at)
        for table, rows, target, bias in ((0, outer, classes, self.class_bias), (1, inner, members, self.member_bias[:, classes])):
            z = bias + np.take(self.weights[table], rows[0], axis=1)
            for r in rows[1:]:
                z += np.take(self.weights[table], r, axis=1)
            z -= z.max(0)
            yield table, rows, target, z

    def log_probability(self, coded):
        """Natural logarithm of each token's probability."""
        out = np.zeros(len(coded.buckets))
        for a in range(0, len(out), BATCH):
            at = slice(a, min(a + BATCH, len(out)))
            for _, _, target, z in self.both(coded, at):
                out[at] += z[target, np.arange(len(target))] - np.log(np.exp(z).sum(0))
        return out + self.inside(coded.buckets, coded.counts)

    def inside(self, buckets, counts):
        """Logarithm of a token's share of its bucket, or of the share of all tokens unseen there."""
        total, words = self.bucket_counts[buckets], self.bucket_words[buckets]
        with np.errstate(divide="ignore", invalid="ignore"):
            share = np.where(counts > 0, counts - self.discount, self.discount * words) / total
        return np.where((buckets < SINGLES) & (counts > 0) | (total == 0), 0.0, np.log(share))


def train_step(model, squares, touched, coded, at, rate):
    """One AdaGrad step on the tokens `at`: a row's slope is the sum over the tokens whose features name it."""
    n = len(at)
    for table, rows, target, z in model.both(coded, at):
        p = np.exp(z, out=z)
        p /= p.sum(0)
        p[target, np.arange(n)] -= 1
        times = sum(np.bincount(r, minlength=ROWS) for r in rows)
        share = (1 / np.sqrt(np.maximum(times, 1))).astype(np.float32)
        for k in range(CLASSES):
            slope = sum(np.bincount(r, weights=p[k], minlength=ROWS) for r in rows).astype(np.float32) * share
            squares[table, k] += slope * slope
            model.weights[table, k] -= rate * slope / np.sqrt(squares[table, k])
        touched[table] += times


CHANGES = pa.schema([("part", pa.int64()), ("block", pa.int32()), ("touched", pa.binary()), ("changes", pa.binary())])
CHANGES_SQL = "part long, block int, touched binary, changes binary"


def _blocks(part, touched, changes):
    """Rows of CHANGES from arrays over all rows of both tables; blocks that nothing touched are left out."""
    touched, changes = touched.reshape(-1, BLOCK), changes.reshape(len(touched.reshape(-1)) // BLOCK, BLOCK, -1)
    for block in np.flatnonzero(touched.any(1)):
        yield {
            "part": part,
            "block": int(block),
            "touched": touched[block].astype("<f8").tobytes(),
            "changes": pa.compress(changes[block].astype("<f4").tobytes(), "zstd", asbytes=True),
        }


def _trainer(model, rate, parts):
    def run(batches):
        weights = model.weights
        local = Model(model.bucket_counts, model.bucket_words, 0, 0, weights.copy())
        squares = np.full(weights.shape, 1e-3, np.float32)
        touched = np.zeros((2, ROWS))
        for batch in batches:
            for row in batch.to_pylist():
                coded = Coded(row)
                at = np.flatnonzero(~coded.held[coded.doc])
                batch = min(max(len(at) // STEPS, LEAST_BATCH), MOST_BATCH)
                for a in range(0, len(at), batch):
                    train_step(local, squares, touched, coded, at[a : a + batch], rate)
        part = TaskContext.get().partitionId() % parts
        rows = list(_blocks(part, touched, ((local.weights - weights) * touched[:, None, :]).transpose(0, 2, 1)))
        if rows:
            yield pa.RecordBatch.from_pylist(rows, CHANGES)

    return run


def _summed(key, table):
    """Sum of the rows of one block, in an order that does not change."""
    rows = table.sort_by([("part", "ascending"), ("touched", "ascending")]).to_pylist()
    touched = np.sum([np.frombuffer(r["touched"], "<f8") for r in rows], axis=0)
    changes = np.zeros(BLOCK * CLASSES)
    for r in rows:
        changes += np.frombuffer(pa.decompress(r["changes"], BLOCK * CLASSES * 4, "zstd", asbytes=True), "<f4")
    out = _blocks(rows[0]["part"], touched, changes.reshape(BLOCK, CLASSES))
    return pa.Table.from_pylist([r | {"block": rows[0]["block"]} for r in out], CHANGES)


def _rounds(coded, model, n_slices, rounds, rate):
    """The model after `rounds` rounds of distributed steps and averaging."""
    parts = max(1, math.isqrt(n_slices))
    for _ in range(rounds):
        changes = coded.mapInArrow(_trainer(model, rate, parts), CHANGES_SQL)
        changes = changes.groupBy("block", "part").applyInArrow(_summed, CHANGES_SQL).groupBy("block").applyInArrow(_summed, CHANGES_SQL)
        weights = model.weights.transpose(0, 2, 1).reshape(-1, BLOCK, CLASSES).copy()
        # as many rows as the model has blocks
        for r in changes.collect():
            touched = np.frombuffer(r["touched"], "<f8")[:, None]
            change = np.frombuffer(pa.decompress(r["changes"], BLOCK * CLASSES * 4, "zstd", asbytes=True), "<f4").reshape(BLOCK, CLASSES)
            weights[r["block"]] += (change / (touched + PRIOR)).astype(np.float32)
        model.weights = np.ascontiguousarray(weights.reshape(2, ROWS, CLASSES).transpose(0, 2, 1))
    return model


# --- the operator -----------------------------------------------------------------

SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scorer(model, n, v):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                coded = Coded(row)
                first = np.concatenate([[0], coded.ends[:-1]])
                base = np.log10((coded.counts + 0.5) / (n + 0.5 * (v + 1)))
                score = model.log_probability(coded) / math.log(10)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(coded.doc_ids, pa.int64()),
                        pa.array(coded.held),
                        pa.array(np.diff(coded.ends, prepend=0)),
                        pa.array(np.add.reduceat((coded.counts > 0).astype(np.int64), first)),
                        pa.array(np.full(len(first), n, np.int64)),
                        pa.array(np.add.reduceat(base, first)),
                        pa.array(np.add.reduceat(score, first)),
                    ],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return run


def fit(docs, slice_bytes=W.SLICE_BYTES, rounds=ROUNDS, rate=RATE):
    """(slices in numbers, model, N, V) of docs (doc_id, text), trained on the documents that are not held out."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD_OUT, F.lit(False))
    slices = common.written(docs.withColumn("held_out", held).mapInArrow(_slicer(slice_bytes), SLICES), "maxent-slices")
    words = slices.select("slice", F.posexplode(F.arrays_zip("words", "counts")).alias("code", "held"))
    place = F.shiftleft("slice", W.CODE_BITS).bitwiseOR(F.col("code").cast("long"))
    words = words.select("slice", "code", F.col("held.words").alias("word"), F.col("held.counts").alias("count"), place.alias("place"))
    same = Window.partitionBy("word")
    words = words.withColumns({"c": F.sum("count").over(same), "first": F.min("place").over(same)})
    hashed = SINGLES + F.pmod(F.xxhash64("word"), F.lit(BUCKETS - SINGLES))
    words = words.select("slice", "code", "c", hashed.cast("int").alias("bucket"), F.when(F.col("place") == F.col("first"), F.col("word")).alias("word"), "first")
    words = common.written(words, "maxent-words")
    seen = words.where(F.col("word").isNotNull() & (F.col("c") > 0))
    # a bounded number of rows: the tokens with a bucket of their own
    singles = seen.orderBy(F.desc("c"), "word").limit(SINGLES).select("first", F.col("c").alias("f"))
    singles = [(r["first"], i) for i, r in enumerate(singles.collect())]
    spark = docs.sparkSession
    alone = F.broadcast(spark.createDataFrame(singles, "first long, single int"))
    words = words.join(alone, "first", "left").withColumn("bucket", F.coalesce("single", "bucket"))
    seen = words.where(F.col("word").isNotNull() & (F.col("c") > 0))
    stats = seen.groupBy("bucket").agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.sum((F.col("c") == 1).cast("long")).alias("n1"), F.sum((F.col("c") == 2).cast("long")).alias("n2")).collect()
    counts, kinds = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in stats:
        counts[r["bucket"]], kinds[r["bucket"]] = r["n"], r["v"]
    model = Model(counts, kinds, sum(r["n1"] for r in stats), sum(r["n2"] for r in stats))
    told = words.select("slice", "code", "c", "bucket").groupBy("slice")
    coded = slices.select("slice", "doc_ids", "held", "ends", "codes", "hashes").groupBy("slice").cogroup(told).applyInArrow(_code, CODED)
    coded = common.written(coded, "maxent-coded")
    return coded, _rounds(coded, model, slices.count(), rounds, rate), int(counts.sum()), int(kinds.sum())


def score(docs, **options):
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of docs."""
    coded, model, n, v = fit(docs, **options)
    return coded.mapInArrow(_scorer(model, n, v), SCORES)
