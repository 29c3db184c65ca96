"""Conversations repaired at least cost, by bidirectional Dijkstra over the lattice of edits.

The lattice of a conversation has a node per number of rows read and state of the role pattern `(s?(ua)+)?`. An edit
is an edge: Keep (cost 0), Rerole to user or assistant (2), Delete (3, the only one for blank and repeated rows),
Insert a user's or assistant's empty turn (2); a truncated row that stays costs 1 more. One heap grows from the
start, one from the end; when their least costs together exceed the best meeting, every meeting of that cost is
known, and among the paths through them the least concatenated audit (the edits' initials in order) wins.

Long conversations. Rows lie in order over the whole table (range partitions by conversation and turn), and a
task cuts its rows into chunks of at most `chunk_rows` rows of one conversation. A chunk is solved for every pair of
states that its ends can have; chunks of a conversation are then joined in order, keeping the best audit per
state. Inserts belong to the row behind them, so two audits of a chunk are never one the beginning of the other,
and the least of each pair of states is enough. So no task holds a conversation: rows are folded and hashed as a
stream. What stays with one task is what one result row is: the audit and the hash of a whole conversation.

Rows go by turn (null first), then role, then text; equal rows count as one with a number of copies, whose copies
beyond the first are repeated rows. Null role or text is one space; a null conv_id is one conversation; null turns
leave no gap. A conversation without rows is repaired as it is: no edits, empty text. An empty table gives no rows.
Extra columns are not read.
"""

import functools
import hashlib
from heapq import heappop, heappush

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from kickstand.llm import common

#: Costs of the edits, and what counts as an end of speech.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
ENDS = ".!?"
CHUNK_ROWS, CHUNK_CHARS, RANGE_ROWS = 128, 1 << 20, 50_000
#: States of the pattern: nothing yet, after the system's turn, after a user's, after an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
STEPS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ACCEPTED = (START, ASSISTANT)
NAMES = {"u": "user", "a": "assistant"}


# --- one chunk --------------------------------------------------------------------


def row_edges(row, state):
    """Edits of a row from a state: (initial, cost, state behind). row: (initial of the role, removed, truncated)."""
    initial, removed, truncated = row
    yield "D", DELETE, state
    if not removed:
        if (state, initial) in STEPS:
            yield "K", truncated * TRUNCATED, STEPS[state, initial]
        for said in NAMES:
            if (state, said) in STEPS:
                yield "R", REROLE + truncated * TRUNCATED, STEPS[state, said]


def insert_edges(state):
    for said in NAMES:
        if (state, said) in STEPS:
            yield "I", INSERT, STEPS[state, said]


@functools.lru_cache(maxsize=1 << 14)
def solve(rows, begin, ends, last):
    """(cost, audit) of the least-cost edits that lead from state `begin` to one of `ends`, ties to the least audit;
    None if there are none. last: nothing follows, so inserts may stand behind the last row."""
    n = len(rows)

    def out_of(node):
        at, state = node
        if at < n or last:
            for edit, cost, to in insert_edges(state):
                yield edit, cost, (at, to)
        if at < n:
            for edit, cost, to in row_edges(rows[at], state):
                yield edit, cost, (at + 1, to)

    # the lattice is small and regular: the edges into a node are those out of its layer and the layer before
    def into(node):
        at, state = node
        for before in STATES:
            if at < n or last:
                for _, cost, to in insert_edges(before):
                    if to == state:
                        yield cost, (at, before)
            if at:
                for _, cost, to in row_edges(rows[at - 1], before):
                    if to == state:
                        yield cost, (at - 1, before)

    source, targets = (0, begin), [(n, e) for e in ends]
    forward, backward = {source: 0}, dict.fromkeys(targets, 0)
    done = set(), set()
    heaps = [(0, source)], [(0, t) for t in sorted(targets)]
    best = min((0 for t in targets if t == source), default=None)
    while heaps[0] and heaps[1] and (best is None or heaps[0][0][0] + heaps[1][0][0] <= best):
        side = 0 if heaps[0][0][0] <= heaps[1][0][0] else 1
        cost, node = heappop(heaps[side])
        if node in done[side]:
            continue
        done[side].add(node)
        mine, other = (forward, backward) if side == 0 else (backward, forward)
        for step, to in (((c, t) for _, c, t in out_of(node)) if side == 0 else into(node)):
            total = cost + step
            if total < mine.get(to, total + 1):
                mine[to] = total
                heappush(heaps[side], (total, to))
            if to in other and (best is None or total + other[to] < best):
                best = total + other[to]
    if best is None:
        return None
    return best, _least_audit(source, set(targets), out_of, forward, backward, done, best)


def _least_audit(source, targets, out_of, forward, backward, done, best):
    """The least audit over all paths of cost `best`. Every node of such a path was taken from one of the heaps: the
    path follows nodes that the forward heap settled and crosses to those that the backward heap did."""
    reached = {source: 0}

    @functools.cache
    def onward(node):
        """Least audit from a node on to the end, None if no path of cost `best` goes on from it."""
        audits = [""] if node in targets and reached[node] == best else []
        for edit, cost, to in out_of(node):
            total = reached[node] + cost
            if total + backward[to] == best if to in done[1] else to in done[0] and forward[to] == total:
                reached[to] = total
                tail = onward(to)
                if tail is not None:
                    audits.append(edit + tail)
        return min(audits, default=None)

    return onward(source)


# --- chunks of ordered rows -------------------------------------------------------

CHUNK = (
    "conv_id long, part int, chunk long, n long, blank long, duplicate long, truncated long, illegal long, first string, last string, "
    "low long, high long, turns long, first_turn long, last_turn long, whole boolean, costs array<long>, audits array<string>, roles array<string>, texts array<string>"
)
CHUNK_ARROW = pa.schema(
    [("conv_id", pa.int64()), ("part", pa.int32()), ("chunk", pa.int64())]
    + [(c, pa.int64()) for c in ("n", "blank", "duplicate", "truncated", "illegal")]
    + [("first", pa.string()), ("last", pa.string())]
    + [(c, pa.int64()) for c in ("low", "high", "turns", "first_turn", "last_turn")]
    + [("whole", pa.bool_()), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string())), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))]
)
LEGAL = ("su", "ua", "au")


def fault(text, repeated):
    """The first fault of a row: blank, duplicate, truncated or none."""
    said = text.rstrip(common.BLANKS.decode())
    if not said:
        return "blank"
    if repeated:
        return "duplicate"
    return None if said[-1] in ENDS else "truncated"


def _signature(rows):
    return tuple((role[:1], f in ("blank", "duplicate"), f == "truncated") for role, _, _, f in rows)


def _chunk(conv_id, part, number, rows, whole):
    """A row of CHUNK from rows (role, text, turn, fault) of one conversation."""
    initials = [r[0][:1] for r in rows]
    turns = [r[2] for r in rows if r[2] is not None]
    counts = {f: sum(r[3] == f for r in rows) for f in ("blank", "duplicate", "truncated")}
    signature = _signature(rows)
    if whole:
        solved = [solve(signature, START, ACCEPTED, True)]
    else:
        solved = [solve(signature, begin, (end,), False) for begin in STATES for end in STATES]
    return {
        "conv_id": conv_id,
        "part": part,
        "chunk": number,
        "n": len(rows),
        **counts,
        "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])),
        "first": initials[0],
        "last": initials[-1],
        "low": min(turns, default=None),
        "high": max(turns, default=None),
        "turns": len(set(turns)),
        "first_turn": rows[0][2],
        "last_turn": rows[-1][2],
        "whole": whole,
        "costs": [s and s[0] for s in solved],
        "audits": [s and s[1] for s in solved],
        "roles": [r[0] for r in rows],
        "texts": [r[1] for r in rows],
    }


def _conversations(rows, most_rows, most_chars):
    """Chunks of ordered rows: (conv_id, rows, is the first of its conversation here, is the last)."""
    held, size, now, first = [], 0, None, True
    for conv_id, turn, role, text, copies, repeated in rows:
        if held and conv_id != now:
            yield now, held, first, True
            held, size, first = [], 0, True
        now = conv_id
        for copy in range(copies):
            if held and (len(held) >= most_rows or size + len(text) > most_chars):
                yield now, held, first, False
                held, size, first = [], 0, False
            held.append((role, text, turn, fault(text, repeated or copy > 0)))
            size += len(text)
    if held:
        yield now, held, first, True


def _chunker(most_rows, most_chars):
    def run(batches):
        part = TaskContext.get().partitionId()
        columns = ("conv_id", "turn", "role", "text", "copies", "repeated")

        def rows():
            for batch in batches:
                yield from zip(*(batch[c].to_pylist() for c in columns), strict=True)

        out, held, number, begins = [], 0, 0, True
        waiting = None
        for conv_id, chunk, first, last in _conversations(rows(), most_rows, most_chars):
            if waiting:
                out.append(_chunk(*waiting))
            # the outermost conversations of a range may go on in the next one
            waiting = [conv_id, part, number, chunk, first and last and not begins]
            number += 1
            begins = begins and not last
            held += sum(len(r[1]) for r in chunk)
            if len(out) >= 2000 or held > 4 * most_chars:
                yield pa.RecordBatch.from_pylist(out, CHUNK_ARROW)
                out, held = [], 0
        if waiting:
            waiting[-1] = False
            out.append(_chunk(*waiting))
        if out:
            yield pa.RecordBatch.from_pylist(out, CHUNK_ARROW)

    return run


# --- chunks joined ----------------------------------------------------------------

CHOICE = "part int, chunk long, begin int, audit string, closes boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
CHOICE_ARROW = pa.schema(
    [("part", pa.int32()), ("chunk", pa.int64()), ("begin", pa.int32()), ("audit", pa.string()), ("closes", pa.bool_())]
    + [(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
)


def join_chunks(chunks):
    """Least cost of a conversation from its chunks in order, and per chunk (state before it, audit); the last audit
    takes in what has to follow the last row."""
    if len(chunks) == 1 and chunks[0]["whole"]:
        return chunks[0]["costs"][0], [(START, chunks[0]["audits"][0])]
    # state -> (cost, place of its audit so far among those of all states, way back)
    best = {START: (0, 0, None)}
    for chunk in chunks:
        found = {}
        for begin, (cost, place, way) in best.items():
            for end in STATES:
                more, audit = chunk["costs"][4 * begin + end], chunk["audits"][4 * begin + end]
                if more is None:
                    continue
                option = (cost + more, (place, audit))
                if end not in found or option < found[end][:2]:
                    found[end] = (*option, (way, begin, audit))
        places = {key: i for i, key in enumerate(sorted({f[1] for f in found.values()}))}
        best = {end: (cost, places[key], way) for end, (cost, key, way) in found.items()}
    closing = ((s, solve((), s, ACCEPTED, True)) for s in best)
    cost, (_, tail), way = min(((best[s][0] + c, (best[s][1], tail), best[s][2]) for s, (c, tail) in closing), key=lambda o: o[:2])
    out = []
    while way:
        way, begin, audit = way
        out.append((begin, audit))
    out.reverse()
    out[-1] = (out[-1][0], out[-1][1] + tail)
    return cost, out


def _by_conversation(batches):
    """Lists of the rows of one conversation, from ordered batches."""
    held, now = [], None
    for batch in batches:
        for row in batch.to_pylist():
            if held and row["conv_id"] != now:
                yield held
                held = []
            now = row["conv_id"]
            held.append(row)
    if held:
        yield held


def _fold(batches):
    out = []
    for chunks in _by_conversation(batches):
        cost, ways = join_chunks(chunks)
        edges = list(zip(chunks, chunks[1:]))
        low, high = [min((c["low"] for c in chunks if c["low"] is not None), default=None), max((c["high"] for c in chunks if c["high"] is not None), default=None)]
        turns = sum(c["turns"] for c in chunks) - sum(a["last_turn"] is not None and a["last_turn"] == b["first_turn"] for a, b in edges)
        for i, (chunk, (begin, audit)) in enumerate(zip(chunks, ways, strict=True)):
            row = {"part": chunk["part"], "chunk": chunk["chunk"], "begin": begin, "audit": audit, "closes": i == len(chunks) - 1}
            if row["closes"]:
                row |= {f: sum(c[f] for c in chunks) for f in ("blank", "duplicate", "truncated", "illegal")}
                row["illegal"] += sum(a["last"] + b["first"] not in LEGAL for a, b in edges)
                row |= {"gaps": high - low + 1 - turns if turns else 0, "cost": cost}
            out.append(row)
        if len(out) >= 5000:
            yield pa.RecordBatch.from_pylist(out, CHOICE_ARROW)
            out = []
    if out:
        yield pa.RecordBatch.from_pylist(out, CHOICE_ARROW)


def lines(roles, texts, begin, audit):
    """The repaired `role:text` lines of a chunk whose edits start from state `begin`."""
    out, row, state = [], 0, begin
    for edit in audit:
        if edit == "D":
            row += 1
            continue
        if edit == "K":
            role = roles[row]
        else:
            # the pattern leaves one turn to be rewritten or added: the user's, or the assistant's after it
            role = NAMES["a" if state == USER else "u"]
        out.append(f"{role}:{'' if edit == 'I' else texts[row]}")
        row += edit != "I"
        state = STEPS[state, role[:1]]
    return out


def _render(batches):
    for batch in batches:
        said = ["\n".join(found) if (found := lines(r["roles"], r["texts"], r["begin"], r["audit"])) else None for r in batch.to_pylist()]
        kept = [c for c in batch.schema.names if c not in ("roles", "texts", "begin")]
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), pa.array(said, pa.string())], names=[*kept, "lines"])


def _finisher(with_text):
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    schema = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in counts), ("audit", pa.string()), ("repaired_sha256", pa.string()), *([("repaired", pa.string())] if with_text else [])])

    def run(batches):
        digest, audits, texts, out, begun = hashlib.sha256(), [], [], [], False
        for batch in batches:
            for row in batch.to_pylist():
                audits.append(row["audit"])
                if row["lines"] is not None:
                    held = ("\n" if begun else "") + row["lines"]
                    digest.update(held.encode())
                    begun = True
                    if with_text:
                        texts.append(held)
                if row["closes"]:
                    done = {"conv_id": row["conv_id"], **{c: row[c] for c in counts}, "audit": "".join(audits), "repaired_sha256": digest.hexdigest()}
                    out.append(done | ({"repaired": "".join(texts)} if with_text else {}))
                    digest, audits, texts, begun = hashlib.sha256(), [], [], False
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []

    return run


# --- the operator -----------------------------------------------------------------


def damage(conversations):
    """The conversations with planted faults, chosen by the checksum of `conv_id:turn`: rows that are missing, empty,
    without end marks, repeated, or said by the user. Nulls become one space first."""
    named = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(named) % 20).alias("k")).where("k <> 0")
    said = F.when(F.col("k") == 1, F.lit("")).when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("k") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        said.alias("text"),
        F.explode(F.sequence(F.lit(1), F.when(F.col("k") == 3, F.lit(2)).otherwise(F.lit(1)))).alias("copy"),
    ).drop("copy")


def repair(conversations, chunk_rows=CHUNK_ROWS, chunk_chars=CHUNK_CHARS, range_rows=RANGE_ROWS, with_text=False):
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 (and repaired) per conv_id."""
    spark = conversations.sparkSession
    said = [F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")]
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *said)
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies"))
    # null turns come first
    turn = F.struct(F.col("turn").isNotNull().alias("given"), F.coalesce("turn", F.lit(0)).alias("turn"))
    earliest = rows.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("text").alias("t")).agg(F.min(turn).alias("earliest"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("text") == F.col("t"))
    rows = rows.join(earliest, same).select("conv_id", "turn", "role", "text", "copies", (turn != F.col("earliest")).alias("repeated"))
    rows = common.written(rows, "repair-rows")
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    n = max(common.pieces_for(size["n"], range_rows), common.pieces_for(size["chars"], 16 * chunk_chars), spark.sparkContext.defaultParallelism)
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text"]
    ordered = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    chunks = common.written(ordered.mapInArrow(_chunker(chunk_rows, chunk_chars), CHUNK), "repair-chunks")
    in_order = [F.col("conv_id").asc_nulls_first(), "part", "chunk"]
    choices = chunks.drop("roles", "texts").repartition(n, "conv_id").sortWithinPartitions(*in_order).mapInArrow(_fold, CHOICE)
    told = chunks.select("conv_id", "part", "chunk", "roles", "texts").join(choices, ["part", "chunk"])
    kept = [c for c in told.columns if c not in ("roles", "texts", "begin")]
    kinds = dict(told.dtypes)
    rendered = told.mapInArrow(_render, ", ".join(f"{c} {kinds[c]}" for c in kept) + ", lines string")
    schema = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    stream = rendered.repartition(n, "conv_id").sortWithinPartitions(*in_order)
    return stream.mapInArrow(_finisher(with_text), schema + (", repaired string" if with_text else ""))


def repair_damaged(conversations):
    """`repair` of the damaged conversations, with a row for every conv_id that there was before the damage."""
    found = repair(damage(conversations)).withColumnRenamed("conv_id", "_id")
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    out = ids.join(found, F.col("conv_id").eqNullSafe(F.col("_id")), "left").drop("_id")
    none = hashlib.sha256(b"").hexdigest()
    return out.fillna(0, ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]).fillna({"audit": "", "repaired_sha256": none})
