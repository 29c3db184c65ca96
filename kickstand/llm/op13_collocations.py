"""Phrase collocations per language by best-first branch-and-bound growth of prefixes.

A phrase is 2 to `most` words in a row inside a piece of text (texts are cut into pieces at marks and line ends). It
scores by its weakest cut: `floor(1000 * a * n / (l * r))`, with a its count, l and r those of the parts before and
behind the cut, and n the words of the language. A phrase whose every occurrence is part of one longer phrase of at
most `most` words is no result: exactly then all its occurrences have the same word before them, or all the same
word behind them, so the least and largest neighbour on either side, kept beside its count, decide it.

Growth. The part behind a cut is at least as frequent as the whole, so no phrase that starts with the word w scores
more than `floor(1000 * n / f(w))`: the count of a prefix bounds everything grown from it, and rare words are the
best nodes of the frontier. A round opens, for each language not settled yet, the best nodes: all words up to a
frequency (in powers of two). Their pairs are counted, and pairs that are frequent grow to `most` words where they
stand. Counts of parts behind a cut that start with a word not opened are asked for one by one, and only for
phrases whose known cuts leave them in reach. A language is settled when its `top`-th surviving score lies above
the bound of all unopened words, or none is left; ties at that score are then complete as well. The next round
opens exactly what the score found so far leaves in reach.

Layout. Texts are encoded once in slices (`wordslices`); words under `least` occurrences end a phrase like a mark.
Slices send their distinct pairs with counts, so a hot pair costs a row per slice, and read back which of them are
frequent; windows of five words are summed per slice before they are shuffled. Nothing of the size of a vocabulary,
a candidate list or a language passes through the driver, one task or a broadcast.

Null text is empty, a null language is `und`. An empty table, or one without frequent phrases, gives no rows. Each
row is a text of its own, also where ids repeat. Extra columns are not read. A piece longer than a slice is kept
whole, and memory follows its length.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from kickstand.llm import common
from kickstand.llm import wordslices as W

LEAST, MOST, TOP = 100, 5, 2000
UNKNOWN = "und"
#: Marks that end a piece, and blanks that part words inside one.
MARKS = b".,;:!?\x0a\x0b\x0c\x0d"
BLANKS = b"\x20\x09"
#: Powers of two that a round opens beyond the last one while a language has too few phrases to tell its bound.
STEP = 4
#: A word's id: its frequency's power of two, then the place (slice, code) where the word was first met.
PLACE_BITS = 57
_MARK, _APART = common.table_of(MARKS), common.table_of(MARKS + BLANKS)
SLICES = "slice long, lang string, n long, codes binary, words array<string>, counts array<long>"


# --- slices -----------------------------------------------------------------------


def _encode(data):
    """Words of a slice: codes from 1 with 0 between pieces, the distinct words, and how often each occurs."""
    data = W.LOWER[data]
    starts, lengths = W.word_runs(data, _APART)
    codes, words = W.dictionary(data, starts, lengths)
    marks = np.cumsum(_MARK[data], dtype=np.int32)
    parted = np.concatenate([[0], marks[starts[1:]] != marks[starts[:-1]]]) if len(starts) else np.zeros(0, np.int64)
    out = np.zeros(len(codes) + int(parted.sum()), np.int64)
    out[np.arange(len(codes)) + np.cumsum(parted)] = codes + 1
    return out, words, np.bincount(codes, minlength=len(words))


def _cut(data, size):
    """Parts of about `size` bytes, cut behind marks only."""
    while len(data) > 2 * size:
        marks = np.flatnonzero(_MARK[data[size:]])
        if not len(marks):
            break
        yield data[: size + marks[0] + 1]
        data = data[size + marks[0] + 1 :]
    yield data


def _slicer(size):
    def run(batches):
        numbers = W.slice_numbers()
        held, sizes = {}, {}

        def flush(lang):
            data = np.frombuffer(b"\n".join(held.pop(lang)), np.uint8)
            sizes.pop(lang)
            for part in _cut(data, size):
                codes, words, counts = _encode(part)
                if len(words):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([next(numbers)], pa.int64()),
                            pa.array([lang], pa.string()),
                            pa.array([int(counts.sum())], pa.int64()),
                            pa.array([W.packed(codes)], pa.binary()),
                            W.list_of(words, [0, len(words)]),
                            W.list_of(pa.array(counts, pa.int64()), [0, len(counts)]),
                        ],
                        names=["slice", "lang", "n", "codes", "words", "counts"],
                    )

        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), W.texts(batch["text"]), strict=True):
                held.setdefault(lang, []).append(text)
                sizes[lang] = sizes.get(lang, 0) + len(text) + 1
                if sizes[lang] >= size:
                    yield from flush(lang)
            # many languages at once: the largest go first
            while sum(sizes.values()) > 4 * size:
                yield from flush(max(sizes, key=sizes.get))
        for lang in list(held):
            yield from flush(lang)

    return run


def _recode(key, slices, told):
    """A slice in the numbering of its frequent words: their ids ascend with their codes, 0 stands for all else."""
    row = slices.to_pylist()[0] if slices.num_rows else None
    if row is None or not told.num_rows:
        return RECODED.empty_table()
    ids, codes = told["id"].to_numpy(), told["code"].to_numpy()
    order = np.argsort(ids)
    new = np.zeros(int(max(codes.max(), row["top"])) + 2, np.int64)
    new[codes[order] + 1] = np.arange(1, len(order) + 1)
    out = new[W.unpacked(row["codes"])]
    kept = out > 0
    kept[1:] |= out[:-1] > 0
    return pa.table([[row["slice"]], [row["lang"]], [ids[order].astype("<i8").tobytes()], [W.packed(out[kept])]], schema=RECODED)


RECODED = pa.schema([("slice", pa.int64()), ("lang", pa.string()), ("ids", pa.binary()), ("codes", pa.binary())])
RECODED_SQL = "slice long, lang string, ids binary, codes binary"


def _opened(row):
    """ids (0 first) and codes of a recoded slice."""
    return np.concatenate([[0], np.frombuffer(row["ids"], "<i8")]), W.unpacked(row["codes"])


# --- growth -----------------------------------------------------------------------


def _pairs(batches):
    """Pairs that start with a word of the opened powers of two, counted per slice."""
    for batch in batches:
        for row in batch.to_pylist():
            ids, codes = _opened(row)
            power = ids >> PLACE_BITS
            opens = (power >= row["lo"]) & (power < row["hi"])
            at = np.flatnonzero(opens[codes[:-1]] & (codes[1:] > 0))
            keys, counts = np.unique(codes[at] * len(ids) + codes[at + 1], return_counts=True)
            for a in range(0, len(keys), 1 << 16):
                k = keys[a : a + (1 << 16)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(k), row["slice"])), pa.array(ids[k // len(ids)]), pa.array(ids[k % len(ids)]), pa.array(counts[a : a + (1 << 16)])],
                    names=["slice", "w1", "w2", "c"],
                )


def _window(codes, at, most):
    """Per position the codes of `most` words from there, 0 from the end of the piece on."""
    padded = np.concatenate([codes, np.zeros(most, codes.dtype)])
    out = [codes[at]]
    for k in range(1, most):
        out.append(np.where(out[-1] > 0, padded[at + k], 0))
    return out


def _grower(most):
    """Slice and its frequent pairs -> the windows that start with one, with counts and neighbours before them."""
    names = [f"w{i}" for i in range(1, most + 1)]

    def run(key, slices, told):
        if not slices.num_rows or not told.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in [*names, "c", "before_min", "before_max"]})
        ids, codes = _opened(slices.to_pylist()[0])
        wanted = np.sort(np.searchsorted(ids, told["w1"].to_numpy()) * len(ids) + np.searchsorted(ids, told["w2"].to_numpy()))
        here = codes[:-1] * len(ids) + codes[1:]
        found = wanted[np.minimum(np.searchsorted(wanted, here), len(wanted) - 1)] == here
        at = np.flatnonzero(found & (codes[:-1] > 0) & (codes[1:] > 0))
        words = _window(codes, at, most)
        before = np.concatenate([[0], codes])[at]
        order = np.lexsort([before, *words[::-1]])
        words, before = [w[order] for w in words], before[order]
        new = np.concatenate([[True], np.logical_or.reduce([w[1:] != w[:-1] for w in words])]) if len(at) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(at)) - 1 if len(first) else first
        columns = {n: pa.array(ids[w[first]]) for n, w in zip(names, words, strict=True)}
        return pa.table(columns | {"c": pa.array(last - first + 1), "before_min": pa.array(ids[before[first]]), "before_max": pa.array(ids[before[last]])})

    return run


def _phrases(windows, least, most):
    """Frequent phrases of 2 to `most` words: ids, a (count), survives (part of no longer phrase as frequent)."""
    out = None
    for m in range(2, most + 1):
        words = [f"w{i}" for i in range(1, m + 1)]
        behind = F.col(f"w{m + 1}") if m < most else F.lit(0)
        found = windows.where(F.col(f"w{m}") != 0).groupBy(*words).agg(
            F.sum("c").alias("a"), F.min("before_min").alias("b0"), F.max("before_max").alias("b1"), F.min(behind).alias("n0"), F.max(behind).alias("n1")
        )
        part = (F.col("b0") == F.col("b1")) & (F.col("b0") != 0) | (F.col("n0") == F.col("n1")) & (F.col("n0") != 0)
        found = found.where(F.col("a") >= least).select(F.array(*words).alias("ids"), "a", (~part if m < most else F.lit(True)).alias("survives"))
        out = found if out is None else out.unionByName(found)
    return out


def _counter(key, slices, told):
    """Slice and phrases asked for -> how often the slice holds each."""
    schema = pa.schema([("ids", pa.list_(pa.int64())), ("c", pa.int64())])
    if not slices.num_rows or not told.num_rows:
        return schema.empty_table()
    ids, codes = _opened(slices.to_pylist()[0])
    asked = told["ids"].to_pylist()
    counts = []
    order = np.argsort(codes, kind="stable")
    begins = np.searchsorted(codes[order], np.arange(len(ids) + 1))
    padded = np.concatenate([codes, np.zeros(max(map(len, asked)), codes.dtype)])
    for phrase in asked:
        local = np.searchsorted(ids, phrase)
        if (local >= len(ids)).any() or (ids[np.minimum(local, len(ids) - 1)] != phrase).any():
            counts.append(0)
            continue
        # the rarest word of the phrase names the places to look at
        rarest = int(np.argmin(begins[local + 1] - begins[local]))
        at = order[begins[local[rarest]] : begins[local[rarest] + 1]] - rarest
        at = at[at >= 0]
        for k, c in enumerate(local):
            at = at[padded[at + k] == c]
        counts.append(len(at))
    return pa.table([asked, counts], schema=schema)


# --- scores -----------------------------------------------------------------------


def cut_score(a, n, left, right):
    """floor(1000 * a * n / (left * right)), exact: columns of counts below 10 ** 17, whole division of decimals."""
    a, n, left, right = (f"cast({c} as decimal(17,0))" for c in (a, n, left, right))
    return F.expr(f"(cast(1000 as decimal(4,0)) * {a} * {n}) div ({left} * {right})")


def _scored(survivors, known, langs):
    """Per phrase its weakest known cut (score, k, l, r), whether all cuts are known, and the parts that are not."""
    cuts = survivors.join(langs.select("lang", "n"), "lang").withColumn("k", F.explode(F.sequence(F.lit(1), F.size("ids") - 1)))
    cuts = cuts.withColumns({"first": F.slice("ids", F.lit(1), F.col("k")), "rest": F.slice("ids", F.col("k") + 1, F.size("ids") - F.col("k"))})
    cuts = cuts.join(known.select(F.col("ids").alias("first"), F.col("f").alias("l")), "first")
    cuts = cuts.join(known.select(F.col("ids").alias("rest"), F.col("f").alias("r")), "rest", "left")
    score = cut_score("a", "n", "l", "r")
    best = F.min(F.when(F.col("r").isNotNull(), F.struct(score.alias("score"), "k", "l", "r")))
    missing = F.collect_list(F.when(F.col("r").isNull(), F.col("rest")))
    return cuts.groupBy("lang", "n", "ids", "a").agg(best.alias("best"), missing.alias("missing"))


def _reached(scored, langs, top):
    """langs with `reached`: the top-th score of the phrases whose cuts are all known, 0 where there are fewer."""
    by_score = Window.partitionBy("lang").orderBy(F.desc("score"))
    whole = scored.where(F.size("missing") == 0).select("lang", F.col("best.score").alias("score"))
    nth = whole.withColumn("place", F.row_number().over(by_score)).where(F.col("place") <= top).where(F.col("place") == top)
    return langs.join(nth.select("lang", F.col("score").alias("reached")), "lang", "left").fillna(0, ["reached"])


# --- the operator -----------------------------------------------------------------


def collocations(docs, least=LEAST, most=MOST, top=TOP, slice_bytes=W.SLICE_BYTES, first_power=None):
    """lang, rank, phrase, a, l, r, n, score: the `top` best phrases of each language of docs (text, lang)."""
    spark = docs.sparkSession
    docs = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text").where(F.col("text").isNotNull())
    slices = common.written(docs.mapInArrow(_slicer(slice_bytes), SLICES), "collocations-slices")
    # every slice hears from its words: their counts over all slices, and one id a word
    words = slices.select("slice", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("code", "held"))
    place = F.shiftleft("slice", W.CODE_BITS).bitwiseOR(F.col("code").cast("long"))
    words = words.select("slice", "code", "lang", F.col("held.words").alias("word"), F.col("held.counts").alias("count"), place.alias("place"))
    same = Window.partitionBy("lang", "word")
    told = words.withColumns({"f": F.sum("count").over(same), "first": F.min("place").over(same)}).where(F.col("f") >= least)
    power = F.length(F.bin("f")) - 1
    told = told.select(
        "slice",
        "code",
        F.shiftleft(power.cast("long"), PLACE_BITS).bitwiseOR(F.col("first")).alias("id"),
        "f",
        "lang",
        F.when(F.col("place") == F.col("first"), F.col("word")).alias("word"),
    )
    told = common.written(told, "collocations-words")
    vocabulary = told.where(F.col("word").isNotNull()).select("id", "lang", "word", "f")
    top_code = slices.select("slice", "lang", "codes", F.size("words").alias("top"))
    recoded = top_code.groupBy("slice").cogroup(told.select("slice", "code", "id").groupBy("slice")).applyInArrow(_recode, RECODED_SQL)
    recoded = common.written(recoded, "collocations-recoded")
    powers = vocabulary.groupBy("lang").agg(F.max(F.length(F.bin("f")) - 1).alias("last"))
    langs = common.written(slices.groupBy("lang").agg(F.sum("n").alias("n")).join(powers, "lang"), "collocations-languages")

    low = least.bit_length() - 1
    control = langs.select("lang", F.lit(0).alias("lo"), F.lit(first_power or low + STEP + 1).alias("hi"))
    held, asked, scored = [], [], None
    while not control.isEmpty():
        slices_open = recoded.join(control, "lang")
        pairs = slices_open.mapInArrow(_pairs, "slice long, w1 long, w2 long, c long")
        frequent = pairs.withColumn("f", F.sum("c").over(Window.partitionBy("w1", "w2"))).where(F.col("f") >= least).select("slice", "w1", "w2")
        names = [f"w{i}" for i in range(1, most + 1)]
        windows = slices_open.select("slice", "ids", "codes").groupBy("slice").cogroup(frequent.groupBy("slice"))
        windows = windows.applyInArrow(_grower(most), ", ".join(f"{c} long" for c in [*names, "c", "before_min", "before_max"]))
        windows = windows.groupBy(*names).agg(F.sum("c").alias("c"), F.min("before_min").alias("before_min"), F.max("before_max").alias("before_max"))
        phrases = _phrases(common.written(windows, "collocations-windows"), least, most)
        phrases = phrases.join(vocabulary.select(F.col("id"), "lang"), F.col("ids")[0] == F.col("id")).drop("id")
        held.append(common.written(phrases, "collocations-phrases"))
        found = _union(held)
        words_known = vocabulary.select(F.array("id").alias("ids"), "f")

        def known(found=found):
            return _union([words_known, found.select("ids", F.col("a").alias("f")), *asked])

        survivors = found.where("survives").select("lang", "ids", "a")
        scored = common.written(_scored(survivors, known(), langs), "collocations-scores")
        # parts that start with unopened words, of phrases that their known cuts leave in reach
        reach = _reached(scored, langs, top).select("lang", "reached")
        open_parts = scored.where(F.size("missing") > 0).join(reach, "lang").where(F.coalesce(F.col("best.score"), F.col("reached")) >= F.col("reached"))
        parts = common.written(open_parts.select(F.explode("missing").alias("ids")).distinct(), "collocations-parts")
        if not parts.isEmpty():
            where = parts.join(told.select("slice", "id"), F.col("ids")[0] == F.col("id")).select("slice", "ids")
            counts = recoded.select("slice", "ids", "codes").groupBy("slice").cogroup(where.groupBy("slice")).applyInArrow(_counter, "ids array<long>, c long")
            asked.append(common.written(counts.groupBy("ids").agg(F.sum("c").alias("f")), "collocations-asked"))
            scored = common.written(_scored(survivors, known(), langs), "collocations-scores")
        control = common.written(_next(control, _reached(scored, langs, top), top), "collocations-control")
    if scored is None:
        return spark.createDataFrame([], RESULT)
    return _listed(scored, vocabulary, langs, top)


RESULT = "lang string, rank long, phrase string, a long, l long, r long, n long, score long"


def _union(frames):
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _next(control, reached, top):
    """What to open next: lang, lo, hi; no row for a language that is settled."""
    state = control.join(reached, "lang").where(F.col("last") >= F.col("hi"))
    # no unopened word is rarer than 2 ** hi
    bound = F.expr("cast(1000 as decimal(4,0)) * n div cast(shiftleft(1L, hi) as decimal(19,0))")
    state = state.withColumn("bound", bound).where((F.col("reached") == 0) | (F.col("bound") >= F.col("reached")))
    # a word can reach the score while 1000 * n / f does
    reach = F.expr("length(bin(cast(1000 as decimal(4,0)) * n div cast(reached as decimal(19,0))))")
    hi = F.when(F.col("reached") > 0, F.greatest(reach, F.col("hi") + 1)).otherwise(F.col("hi") + STEP)
    return state.select("lang", F.col("hi").alias("lo"), hi.cast("int").alias("hi"))


def _listed(scored, vocabulary, langs, top):
    """The best phrases of each language as text, ranked."""
    whole = scored.where(F.size("missing") == 0).select("lang", "n", "ids", "a", "best.*")
    near = whole.join(_reached(scored, langs, top).select("lang", "reached"), "lang").where(F.col("score") >= F.col("reached"))
    spelled = near.select("lang", "ids", F.posexplode("ids").alias("at", "id")).join(vocabulary.select("id", "word"), "id")
    phrase = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda w: w["word"]), " ")
    spelled = spelled.groupBy("lang", "ids").agg(phrase.alias("phrase"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = near.join(spelled, ["lang", "ids"]).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


#: The query's rows in DuckDB SQL, over the whole table.
SQL = f"""
WITH pieces AS (
  SELECT coalesce(lang, '{UNKNOWN}') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents
), worded AS (
  SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS words FROM pieces
), totals AS (
  SELECT lang, CAST(sum(len(words)) AS HUGEINT) AS n FROM worded GROUP BY lang
), starts AS (
  SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM worded
), grams AS (
  SELECT lang, words[i : i + m - 1] AS phrase FROM starts, (SELECT unnest(range(1, {MOST + 1})) AS m) WHERE i + m - 1 <= len(words)
), counts AS (
  SELECT lang, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= {LEAST}
), candidates AS (
  SELECT lang, phrase, f AS a FROM counts WHERE len(phrase) > 1
), parts AS (
  SELECT DISTINCT lang, phrase[i : i + m - 1] AS phrase, a
  FROM candidates, (SELECT unnest(range(2, {MOST})) AS m), (SELECT unnest(range(1, {MOST})) AS i)
  WHERE m < len(phrase) AND i + m - 1 <= len(phrase)
), survivors AS (
  SELECT * FROM candidates c
  WHERE NOT EXISTS (SELECT 1 FROM parts p WHERE p.lang = c.lang AND p.phrase = c.phrase AND 100 * p.a >= 100 * c.a)
), cuts AS (
  SELECT s.lang, s.phrase, s.a, k, x.f AS l, y.f AS r, n, CAST(1000 AS HUGEINT) * s.a * n // (CAST(x.f AS HUGEINT) * y.f) AS score
  FROM survivors s JOIN (SELECT unnest(range(1, {MOST})) AS k) ON k < len(s.phrase) JOIN totals USING (lang)
  JOIN counts x ON x.lang = s.lang AND x.phrase = s.phrase[1 : k]
  JOIN counts y ON y.lang = s.lang AND y.phrase = s.phrase[k + 1 : len(s.phrase)]
), weakest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), ranked AS (
  SELECT lang, array_to_string(phrase, ' ') AS text, a, l, r, n, score,
         row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(phrase, ' ')) AS rank
  FROM weakest
)
SELECT lang, rank, text AS phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= {TOP}
"""
