"""Near duplicates by min-max hashing: every permutation gives two signature values, its minimum and its maximum.

A document's set is its distinct shingles of `width` words (A-Z lower-cased; a shorter text is one shingle). The
signature holds minima and maxima of the set under `bands * rows / 2` permutations; runs of `rows` values form
bands. Documents with equal sets are one class from the start, named by the smallest doc_id, and only classes
are compared. Classes that agree on a band meet in a bucket, and links are confirmed on the full sets:

1. every class of a bucket is compared with the bucket's smallest class (its hub), which gives stars;
2. components of those links are found; a class still apart from a hub's component is compared with the classes
   of such buckets that are not in its own component and share a rare shingle with it: shingles are ordered from
   rare to frequent, and two sets of the similarity share one of the first n - ceil(similarity * n) + 1 of each.
   So no link is lost, and texts that share a template and little else do not meet. What meets is joined row by
   row; a shingle of many sets is cut on both sides into blocks of about `block` sets;
3. components of all links give the result.

Pairs inside one component need no comparison, so a group of thousands of near copies costs about its size and
not its square, and no link between different components is left out. Two sets of similarity 0.8 share no band
with a chance below 1e-6 (4 rows, 28 bands).

Null or empty text, or blanks alone: the set is empty and linked with nothing. Rows that share a doc_id are one
document whose texts are linked. A null doc_id is linked with nothing: its component is null and it is kept.
An empty table gives no rows. Extra columns are ignored.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from kickstand.llm import common
from kickstand.llm.components import components

WIDTH = 4
BANDS, ROWS = 28, 4
#: Links have 100 * intersection >= SIMILARITY * union.
SIMILARITY = 80
BLOCK = 1024
SIGNED = "doc_id long, n_shingles long, set_key binary, bands array<long>"
SETS = "doc_id long, shingles binary"
LINKS = "a long, b long"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RANDOM = np.random.default_rng(20240229)
FACTORS = _RANDOM.integers(0, 2**63, 512, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MASKS = _RANDOM.integers(0, 2**64, 512, dtype=np.uint64)


def shingle_sets(ends, data, width):
    """Distinct shingle hashes of each row: (hashes, n_rows + 1 ends); hashes ascend within a row."""
    n = len(ends) - 1
    starts, lengths, rows = common.word_runs(data, ends)
    words = common.run_hashes(common.BYTE_WORDS[_LOWER[data]], starts, lengths)
    counts = np.bincount(rows, minlength=n)
    firsts = np.cumsum(counts) - counts
    # position in the row decides which words start a shingle: all but the last width - 1, or the first of a short row
    place = np.arange(len(words)) - firsts[rows]
    whole = place + width <= counts[rows]
    short = (counts < width) & (counts > 0)
    hashes = np.zeros(len(words), np.uint64)
    for k in range(width):
        held = np.zeros(len(words), np.uint64)
        at = np.flatnonzero(place + k < counts[rows])
        held[at] = words[at + k]
        hashes = (hashes + held) * common.STEP
        hashes ^= hashes >> np.uint64(31)
    taken = whole | (short[rows] & (place == 0))
    hashes, rows = common.mix(hashes[taken] + np.minimum(counts, width)[rows[taken]].astype(np.uint64)), rows[taken]
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    first = np.ones(len(rows), bool)
    first[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    hashes, rows = hashes[first], rows[first]
    return hashes, np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))])


def signatures(hashes, ends, n_values):
    """Minima of n_values / 2 permutations, then their maxima, for each row with a shingle."""
    full = np.flatnonzero(np.diff(ends))
    begins = ends[:-1][full]
    out = np.zeros((len(full), n_values), np.uint64)
    for k in range(n_values // 2) if len(full) else ():
        values = (hashes ^ MASKS[k]) * FACTORS[k]
        out[:, k] = np.minimum.reduceat(values, begins)
        out[:, n_values // 2 + k] = np.maximum.reduceat(values, begins)
    return full, out


def _band_keys(values, bands, rows):
    keys = np.zeros((len(values), bands), np.uint64)
    for r in range(rows):
        keys = common.mix((keys + values[:, r::rows][:, :bands]) * common.STEP)
    return keys.astype(np.int64)


def _signer(width, bands, rows):
    def run(batches):
        for batch in batches:
            ends, data = common.utf8(batch["text"])
            for a, b in common.slices(ends):
                hashes, at = shingle_sets(ends[a : b + 1] - ends[a], data[ends[a] : ends[b]], width)
                full, values = signatures(hashes, at, bands * rows)
                sizes = np.diff(at)
                keys = np.zeros((b - a, 2), np.uint64)
                for c in range(2):
                    if len(full):
                        keys[full, c] = np.add.reduceat(common.mix(hashes + MASKS[-1 - c]), at[:-1][full])
                packed = np.column_stack([keys, sizes.astype(np.uint64)]).astype("<u8")
                banded = np.zeros((b - a, bands), np.int64)
                banded[full] = _band_keys(values, bands, rows)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(sizes > 0, bands, 0))]), pa.int32()), pa.array(banded[full].ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(a, b - a), pa.array(sizes, pa.int64()), pa.array([r.tobytes() for r in packed], pa.binary()), lists],
                    names=["doc_id", "n_shingles", "set_key", "bands"],
                )

    return run


def _setter(width):
    def run(batches):
        for batch in batches:
            ends, data = common.utf8(batch["text"])
            for a, b in common.slices(ends):
                hashes, at = shingle_sets(ends[a : b + 1] - ends[a], data[ends[a] : ends[b]], width)
                sets = [hashes[x:y].tobytes() for x, y in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(a, b - a), pa.array(sets, pa.binary())], names=["doc_id", "shingles"])

    return run


def _linked(both, n, m, similarity):
    return 100 * both >= similarity * (n + m - both)


def _confirm(similarity):
    """Keep the pairs (a, b, set_a, set_b) whose full sets are similar enough."""

    def run(batches):
        for batch in batches:
            kept = []
            for i, (x, y) in enumerate(zip(batch["set_a"], batch["set_b"], strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if _linked(min(len(x), len(y)), len(x), len(y), similarity):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if _linked(both, len(x), len(y), similarity):
                        kept.append(i)
            yield pa.RecordBatch.from_arrays([batch["a"].take(pa.array(kept, pa.int64())), batch["b"].take(pa.array(kept, pa.int64()))], names=["a", "b"])

    return run


def _unpacker(batches):
    """One row per shingle of a set, with the set's hash and size."""
    for batch in batches:
        for at in range(batch.num_rows):
            values = np.frombuffer(batch["shingles"][at].as_buffer(), np.int64)
            n = len(values)
            same = [pa.array([batch[c][at].as_py()]).take(pa.array(np.zeros(n, np.int32))) for c in ("doc_id", "component", "asks", "set")]
            yield pa.RecordBatch.from_arrays([*same, pa.array(np.full(n, n)), pa.array(values)], names=["doc_id", "component", "asks", "set", "n", "shingle"])


def _across(apart, sets, similarity, block):
    """Pairs (a, b) of an asking class and one of another component that may be similar enough: every such pair is there."""
    held = apart.join(sets, "doc_id").withColumn("set", F.xxhash64("shingles")).select("doc_id", "component", "asks", "set", "shingles")
    held = common.written(held.mapInArrow(_unpacker, "doc_id long, component long, asks boolean, set long, n long, shingle long"), "minmax-apart-shingles")
    # a shingle of one set meets nothing, but has its place in the order
    often = held.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    ordered = held.join(often, "shingle", "left").withColumn("df", F.coalesce("df", F.lit(1)))
    # equal texts of one doc_id share their places
    place = F.dense_rank().over(Window.partitionBy("doc_id", "set").orderBy("df", "shingle"))
    least = F.expr(f"({similarity} * n + 99) div 100")
    prefix = ordered.withColumn("place", place).where((F.col("place") <= F.col("n") - least + 1) & (F.col("df") > 1))
    prefix = common.written(prefix.select("doc_id", "component", "asks", "n", "shingle", "place", F.ceil(F.col("df") / block).cast("int").alias("blocks")), "minmax-prefixes")
    own, every = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    asking = prefix.where("asks").withColumn("p", own).withColumn("q", every)
    others = prefix.withColumn("q", own).withColumn("p", every)
    x = asking.select("shingle", "p", "q", *[F.col(c).alias(f"{c}_x") for c in ("doc_id", "component", "n", "place")])
    y = others.select("shingle", "p", "q", *[F.col(c).alias(f"{c}_y") for c in ("doc_id", "component", "n", "place")])
    # what the sets can share at most is this shingle and what comes after it in both, where it is their first common one
    most = 1 + F.least(F.expr("n_x - place_x"), F.expr("n_y - place_y"))
    fits = (100 + similarity) * most >= similarity * (F.col("n_x") + F.col("n_y"))
    near = 100 * F.least("n_x", "n_y") >= similarity * F.greatest("n_x", "n_y")
    met = x.join(y, ["shingle", "p", "q"]).where((F.col("component_x") != F.col("component_y")) & near & fits)
    return met.select(F.least("doc_id_x", "doc_id_y").alias("a"), F.greatest("doc_id_x", "doc_id_y").alias("b")).distinct()


def _confirmed(pairs, sets, similarity, name):
    a = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("set_a"))
    b = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("set_b"))
    return common.written(pairs.join(a, "a").join(b, "b").select("a", "b", "set_a", "set_b").mapInArrow(_confirm(similarity), LINKS), name)


def near_duplicates(docs, width=WIDTH, bands=BANDS, rows=ROWS, similarity=SIMILARITY, block=BLOCK):
    """doc_id, n_shingles, component_id (smallest doc_id of the component) and kept for every row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = common.written(docs.mapInArrow(_signer(width, bands, rows), SIGNED), "minmax-signatures")
    sound = signed.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = sound.groupBy("set_key").agg(F.min(F.struct("doc_id", "bands")).alias("first"))
    classes = common.written(classes.select("set_key", F.col("first.doc_id").alias("doc_id"), F.col("first.bands").alias("bands")), "minmax-classes")

    buckets = classes.select("doc_id", F.posexplode("bands").alias("band", "key"))
    hubs = buckets.groupBy("band", "key").agg(F.min("doc_id").alias("hub"), F.count(F.lit(1)).alias("members")).where(F.col("members") > 1)
    # all a class needs of its buckets, stored once for both passes; a bucket of one class is gone here
    met = common.written(buckets.join(hubs, ["band", "key"]), "minmax-buckets")
    stars = met.where(F.col("doc_id") != F.col("hub")).select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).distinct()
    named = met.select("doc_id").distinct()
    sets = common.written(docs.join(named, "doc_id", "left_semi").mapInArrow(_setter(width), SETS).where(F.octet_length("shingles") > 0), "minmax-sets")
    links = _confirmed(stars, sets, similarity, "minmax-stars")
    # texts that share a doc_id are one document
    shared = sound.groupBy("doc_id").agg(F.count_distinct("set_key").alias("n")).where(F.col("n") > 1).select("doc_id")
    same = sound.join(shared, "doc_id", "left_semi").join(classes.select("set_key", F.col("doc_id").alias("class")), "set_key")
    same = same.select(F.least("doc_id", "class").alias("a"), F.greatest("doc_id", "class").alias("b")).where("a <> b")
    links = links.union(same)
    roots = components(links, "minmax-components")

    of = roots.withColumnRenamed("node", "doc_id")
    rest = met.where((F.col("members") > 2) & (F.col("doc_id") != F.col("hub"))).join(of, "doc_id", "left").withColumn("component", F.coalesce("root", "doc_id")).drop("root")
    rest = rest.join(roots.select(F.col("node").alias("hub"), F.col("root").alias("hub_root")), "hub", "left")
    rest = rest.withColumn("asks", F.col("component") != F.coalesce("hub_root", "hub"))
    open_ = rest.where("asks").select("band", "key").distinct()
    rest = rest.join(open_, ["band", "key"], "left_semi")
    # a class takes part once, whatever the number of its buckets
    apart = common.written(rest.groupBy("doc_id", "component").agg(F.max("asks").alias("asks")), "minmax-apart")
    pairs = common.written(_across(apart, sets, similarity, block), "minmax-pairs")
    across = _confirmed(pairs, sets, similarity, "minmax-across")
    roots = components(roots.select(F.col("root").alias("a"), F.col("node").alias("b")).union(across), "minmax-components")

    final = classes.select("set_key", F.col("doc_id").alias("class")).join(roots.withColumnRenamed("node", "class"), "class", "left")
    final = final.select("set_key", F.coalesce("root", "class").alias("component_id"))
    out = signed.join(final, "set_key", "left")
    component = F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component_id"))).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
