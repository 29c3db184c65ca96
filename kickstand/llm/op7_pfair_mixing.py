"""Mix sources to target weights by Pfair scheduling of their blocks.

Every source's documents are cut into blocks of equal numbers of documents, in a fixed random order (by hash of
doc_id). With weight w, block j of a source (from 0) is released at slot floor(j / w) and due by slot
ceil((j + 1) / w); of the released blocks, the one with the earliest deadline takes each slot. In every prefix
of the schedule each source then has less than one block more or less than its weight times the length, as long
as no source has run out; after that the others keep their slots. All blocks are placed, none twice.

Weights are turned into whole numbers of slots in a period of `resolution` slots (largest remainders, one slot
at least), so the schedule repeats with that period. One period is a table whose size `resolution` bounds; it is
the only thing that is worked out on the driver, and more sources than `resolution` are refused.

Numbering a source's documents takes no pass of one task over a source: documents are counted per source and
hash chunk, chunks are summed, and ranks are taken inside chunks.

A null source is a source of its own. A source without a given weight, or with weight zero, is an error. Null
and repeated doc_ids are kept, ordered among themselves by nothing that shows in the result; an empty table
gives no rows. Other columns are kept, but those that bear a name of ADDED are replaced. Only DataFrame functions are used.
"""

import heapq
import json
import math

from pyspark.sql import Window
from pyspark.sql import functions as F

BLOCK_DOCS = 16
RESOLUTION = 10_000
CHUNK_DOCS = 200_000
ADDED = ["block", "release", "deadline", "slot", "place"]


def quotas(weights, resolution=RESOLUTION):
    """Whole slots per source that sum to `resolution`, nearest to the weights by largest remainders."""
    if len(weights) > resolution:
        raise ValueError(f"{len(weights)} sources are more than {resolution} slots")
    if any(not w > 0 for w in weights.values()):
        raise ValueError("every source needs a weight above zero")
    names = sorted(weights, key=lambda n: (n is not None, n or ""))
    total = sum(weights.values())
    share = {n: weights[n] / total * resolution for n in names}
    out = {n: max(1, math.floor(share[n])) for n in names}
    by_rest = sorted(names, key=lambda n: out[n] - share[n])
    for k in range(resolution - sum(out.values())):
        out[by_rest[k % len(by_rest)]] += 1
    while sum(out.values()) > resolution:
        largest = max(names, key=lambda n: (out[n] - share[n] if out[n] > 1 else -math.inf))
        out[largest] -= 1
    return out


def schedule(quota, resolution=RESOLUTION):
    """Slots of one period per source: earliest deadline first among released blocks, names settle ties."""
    names = sorted(quota, key=lambda n: (n is not None, n or ""))
    slots = {n: [] for n in names}
    waiting = [(0, i) for i in range(len(names))]  # (release, source)
    ready = []  # (deadline, source)
    for slot in range(resolution):
        while waiting and waiting[0][0] <= slot:
            _, i = heapq.heappop(waiting)
            done = len(slots[names[i]])
            heapq.heappush(ready, (-(-(done + 1) * resolution // quota[names[i]]), i))
        _, i = heapq.heappop(ready)
        slots[names[i]].append(slot)
        done = len(slots[names[i]])
        if done < quota[names[i]]:
            heapq.heappush(waiting, (done * resolution // quota[names[i]], i))
    return slots


def power_weights(docs, exponent=0.5, source="source"):
    """Target weight of each source: its number of documents to a power below one, which lifts small sources."""
    return {r[source]: r["n"] ** exponent for r in docs.groupBy(source).agg(F.count(F.lit(1)).alias("n")).limit(RESOLUTION + 1).collect()}


def _period_table(spark, slots, resolution):
    """key of a source, quota and its slots, as a table of one literal; `resolution` bounds its size."""
    rows = [{"key": "-" if name is None else f"+{name}", "quota": len(held), "slots": held} for name, held in slots.items()]
    kind = "array<struct<key string, quota long, slots array<long>>>"
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), kind)))


def mix(docs, weights, block_docs=BLOCK_DOCS, resolution=RESOLUTION, chunk_docs=CHUNK_DOCS):
    """All rows with block (of the source, from 0), release, deadline, slot and place (in the block, from 0)."""
    spark = docs.sparkSession
    slots = schedule(quotas(weights, resolution), resolution) if weights else {}
    n = docs.count()
    digits = 2
    while 16**digits * chunk_docs < n:
        digits += 1
    # the row travels as one value, so that no column of it can clash with a helper's name
    out = [c for c in docs.columns if c not in ADDED]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in out]).alias("row"), "source", "doc_id")
    # a key that is never null: window and join place rows by the same columns, so whole rows move once
    rows = rows.withColumn("key", F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), "source")))
    marked = rows.withColumn("at", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    marked = marked.withColumn("chunk", F.substring("at", 1, digits))
    counts = marked.groupBy("key", "chunk").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("key").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("key", "chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("key", "chunk").orderBy("at", "doc_id")
    ranked = marked.withColumn("rank", F.row_number().over(inside) - 1)
    ranked = ranked.join(before, ["key", "chunk"])
    period = F.broadcast(_period_table(spark, slots, resolution))
    placed = ranked.join(period, "key", "left")
    unknown = F.raise_error(F.concat(F.lit("no weight for source "), F.coalesce("source", F.lit("null")))).cast("long")
    known = placed.withColumn("quota", F.coalesce("quota", unknown)).withColumn("nth", F.col("before") + F.col("rank"))
    known = known.withColumn("block", F.expr(f"nth div {block_docs}"))
    return known.select(
        "row.*",
        "block",
        F.expr(f"block * {resolution} div quota").alias("release"),
        F.expr(f"((block + 1) * {resolution} + quota - 1) div quota").alias("deadline"),
        (F.expr("block div quota") * resolution + F.element_at("slots", (F.pmod("block", "quota") + 1).cast("int"))).alias("slot"),
        (F.col("nth") % block_docs).alias("place"),
    )
