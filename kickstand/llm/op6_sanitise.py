"""Personal data in texts: patterns find entities, corpus co-occurrence finds the terms that give them away.

Base spans are e-mail addresses, IP addresses, payment cards and phone numbers by pattern and check. Each
checked value (lower-cased address, digits of a number) is a protected entity. Around every base span the words
of its context (outside base spans) are counted with the entity, both in documents: n(t, e) of them hold the word in a context of the
entity, n(t) hold it anywhere, and the disclosure of entity e by term t is P(e | t) = n(t, e) / n(t), however often
a text repeats the word or a passage is copied. P(e) being the share
of all documents that hold the entity, the term tells log2(P(e | t) / P(e)) bits, and gains
(P(e | t) - P(e)) / (1 - P(e)) of what was open. A term above `disclosure` gives the entity away wherever it stands

* if it tells `bits`, or gains `disclosure`: that one is in reach of every entity, however frequent,
* and if `support` *distinct* contexts hold it (copies of one passage count once there). For an entity that has fewer,
  two contexts do, with the lower bound of P(e | t) above `disclosure`. One context tells no name from other words.

It is generalised to its kind (name, number, word), or removed above `removal`. An entity that every document holds
is given away by no word.

Spans are found by splitting at a pattern and summing the lengths of gaps and matches. The patterns carry
possessive quantifiers and start only where a run starts or the last match ended; they match what the plain
patterns match, in time linear in the text. Positions are code points, ends exclusive.

Null and empty texts have no spans. Rows are independent but for the corpus counts; repeated rows give repeated
rows; equal or null doc_ids do not mix their texts. Extra columns stay, but those named base, spans or terms are replaced by `find`. Only DataFrame functions are used.
"""

from pyspark.sql import functions as F

from kickstand.llm import common

CONTEXT_CHARS = 100
SUPPORT = 5
#: Contexts with a term that an entity of fewer than SUPPORT contexts needs; one alone is no co-occurrence.
RARE_SUPPORT = 2
DISCLOSURE = 0.5
REMOVAL = 0.9
BITS = 6.0
KINDS = ["email", "ip", "card", "phone"]
TERM = "term"
#: The term that every context holds.
WHOLE = ""
#: The patterns of the kinds, as linear-time equals of their plain forms.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for the pattern to be tried.
NEEDS = {"email": "@", "ip": "[0-9]\\.[0-9]", "card": "[0-9][\\x20-]?[0-9]", "phone": "+"}
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
CHUNK = 256
SPAN = "struct<start:int,rank:int,end:int,kind:string>"


def _digits(hit):
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(digits):
    """Digits from the right, every second doubled and cast out by nines, sum to a multiple of ten."""
    places = F.split(F.reverse(digits), "")
    doubled = F.transform(places, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def _passes(kind, hit):
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return hit.rlike(rf"^{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}$")
    digits = _digits(hit)
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(False)
    return F.length(digits).between(9, 15)


def _in_chunks(items, at, kind, step, join):
    """Fold an array from the left into (at, out) where out is appended to: long arrays go in chunks, so that an
    append copies no more than a chunk. step gives the next (at, out); join makes one value of a chunk's out."""
    one, all_ = F.array().cast(f"array<{kind[0]}>"), F.array().cast(f"array<{kind[1]}>")
    begin = F.struct(at.alias("at"), all_.alias("out"))

    def chunk(acc, held):
        start = F.struct(acc["at"].alias("at"), one.alias("out"))
        return F.aggregate(held, start, step, lambda a: F.struct(a["at"].alias("at"), F.concat(acc["out"], F.array(join(a["out"]))).alias("out")))

    def fold(held):
        chunks = F.transform(F.sequence(F.lit(0), F.size(held) - 1, F.lit(CHUNK)), lambda k: F.slice(held, k + 1, F.lit(CHUNK)))
        return F.when(F.size(held) > 0, F.aggregate(chunks, begin, chunk)).otherwise(begin)

    # an expression named inside a function is worked out at every call: the array is bound once instead
    return F.element_at(F.transform(F.array(items), fold), 1)


def _spans(text, kind, pattern, rank, passes):
    """Spans of the matches that pass, in order. A match that fails is dropped, and is not tried again in part."""
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    pieces = F.arrays_zip(hits.alias("hit"), F.split(text, pattern, -1).alias("gap"))

    def step(acc, piece):
        begin = acc["at"] + F.length(piece["gap"])
        # the last gap has no match after it
        end = begin + F.coalesce(F.length(piece["hit"]), F.lit(0))
        span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"))
        good = piece["hit"].isNotNull() & passes(piece["hit"])
        return F.struct(end.alias("at"), F.when(good, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    return F.flatten(_in_chunks(pieces, F.lit(0), (SPAN, f"array<{SPAN}>"), step, lambda out: out)["out"])


def _base_spans(text):
    found = []
    for rank, kind in enumerate(KINDS):
        need = F.instr(text, NEEDS[kind]) > 0 if len(NEEDS[kind]) == 1 else text.rlike(NEEDS[kind])
        spans = _spans(text, kind, F.lit(PATTERNS[kind]), rank, lambda hit, kind=kind: _passes(kind, hit))
        found.append(F.coalesce(F.when(need, spans), F.array().cast(f"array<{SPAN}>")))
    return F.array_sort(F.concat(*found))


def find_base(docs):
    """Append `base`: the pattern spans of each text by start, then kind."""
    return docs.withColumn("base", _base_spans(F.coalesce("text", F.lit(""))))


def _folded(text):
    """Lower case of the same length, as the search without case takes letters: capital dotted I as i, both sigmas as one."""
    return F.translate(F.lower(F.translate(text, "\u0130", "I")), "\u03c2", "\u03c3")


def _terms(text):
    """Lower-cased words without the punctuation around them."""
    words = F.regexp_extract_all(_folded(text), F.lit(r"[\p{L}\p{N}][^\s]*[\p{L}\p{N}]|[\p{L}\p{N}]"), F.lit(0))
    return F.filter(words, lambda w: ~w.contains("@"))


def _plain(text):
    """A text with a blank in place of each base span: the digits and letters of protected values are no words."""

    def without(kind):
        def blanked(x):
            pattern = F.lit(PATTERNS[kind])
            pieces = F.arrays_zip(F.regexp_extract_all(x, pattern, F.lit(0)).alias("hit"), F.split(x, pattern, -1).alias("gap"))
            # the last gap has no match after it
            said = F.transform(pieces, lambda p: F.concat(p["gap"], F.when(p["hit"].isNull(), "").when(_passes(kind, p["hit"]), " ").otherwise(p["hit"])))
            need = F.instr(x, NEEDS[kind]) > 0 if len(NEEDS[kind]) == 1 else x.rlike(NEEDS[kind])
            return F.when(need, F.array_join(said, "")).otherwise(x)

        return blanked

    # an array binds each step's text, so that it is worked out once
    for kind in KINDS:
        text = F.element_at(F.transform(F.array(text), without(kind)), 1)
    return text


def _plain_text():
    """`_plain` of the rows' texts; a text without base spans is plain."""
    text = F.coalesce("text", F.lit(""))
    return F.when(F.size("base") > 0, _plain(text)).otherwise(text)


def contexts(found):
    """entity, doc, beside, rows: what stands beside each protected value of a text (base spans blank), the text's hash, and how many
    rows hold that text; a text that repeats a context gives it once."""
    text = F.col("text")

    def context(span):
        value = F.substring(text, span["start"] + 1, span["end"] - span["start"])
        entity = F.concat(span["kind"], F.lit(":"), F.when(span["kind"].isin("card", "phone"), _digits(value)).otherwise(F.lower(value)))
        # a word that the window cuts is left out: the text goes on with no blank beyond the window
        first = F.greatest(span["start"] - CONTEXT_CHARS, F.lit(0))
        left = F.substring(text, first + 1, span["start"] - first)
        left = F.when((first > 0) & F.substring(text, first, F.lit(1)).rlike(r"\S"), F.regexp_replace(left, r"^\S*", "")).otherwise(left)
        right = F.substring(text, span["end"] + 1, F.lit(CONTEXT_CHARS))
        right = F.when(F.substring(text, span["end"] + 1 + CONTEXT_CHARS, F.lit(1)).rlike(r"\S"), F.regexp_replace(right, r"\S*$", "")).otherwise(right)
        return F.concat(entity, F.lit("\n"), left, F.lit(" "), right)

    # no value of an entity holds a line's end; strings are told apart by hash, structs one by one
    entries = F.array_distinct(F.transform("base", context))
    held = found.where(F.size("base") > 0).select(F.xxhash64("text").alias("doc"), F.explode(entries).alias("entry"))
    held = held.groupBy("doc", "entry").agg(F.count(F.lit(1)).alias("rows"))
    beside = _plain(F.substring("entry", F.instr("entry", "\n") + 1, F.length("entry")))
    return held.select(F.substring_index("entry", "\n", 1).alias("entity"), "doc", beside.alias("beside"), "rows")


def term_pairs(held):
    """entity, term, n_te (rows that hold the term beside the entity), contexts (distinct ones that hold both)."""
    terms = F.array_union(F.array(F.lit(WHOLE)), _terms(F.col("beside")))
    # two units in one pass: a text counts with its rows, a context once
    units = F.array(F.struct(F.lit(True).alias("of_text"), F.col("doc").alias("key"), "rows"), F.struct(F.lit(False).alias("of_text"), F.xxhash64("beside").alias("key"), F.lit(1).cast("long").alias("rows")))
    each = held.select("entity", units.alias("units"), F.explode(terms).alias("term")).select("entity", "term", F.inline("units"))
    each = each.groupBy("entity", "term", "of_text", "key").agg(F.max("rows").alias("rows"))
    n_te, n_contexts = (F.sum(F.when(F.col("of_text") == side, F.col("rows")).otherwise(0)) for side in (True, False))
    return each.groupBy("entity", "term").agg(n_te.alias("n_te"), n_contexts.alias("contexts"))


def disclosing_terms(found, support=SUPPORT, disclosure=DISCLOSURE, bits=BITS):
    """term, share: the terms that give an entity away, with the largest P(e | t), from counts over all documents."""
    pairs = common.written(term_pairs(contexts(found)), "disclosure-pairs")
    likely = pairs.where((F.col("contexts") >= F.least(F.lit(support), F.lit(RARE_SUPPORT))) & (F.col("term") != WHOLE))
    # in rows, as n_te is
    words = found.select(F.explode(F.array_distinct(_terms(_plain_text()))).alias("term"))
    # counted before the join: words meet in sums of tasks, whatever their frequency
    occurs = words.groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    entities = pairs.where(F.col("term") == WHOLE).select("entity", F.col("n_te").alias("n_e"), F.col("contexts").alias("seen"))
    scored = likely.join(occurs, "term").join(entities, "entity")
    n, share, prior = F.col("n_t"), F.col("share"), F.col("n_e") / F.lit(float(max(found.count(), 1)))
    scored = scored.withColumn("share", F.col("n_te") / F.col("n_t"))
    # the lower end of the share's score interval, one deviation wide
    bound = (share + 0.5 / n - F.sqrt(share * (1 - share) / n + 0.25 / (n * n))) / (1 + 1 / n)
    known = (F.col("contexts") >= support) | ((F.col("seen") < support) & (bound >= disclosure))
    told = (F.log2(share / prior) >= bits) | (share - prior >= disclosure * (1 - prior)) & (prior < 1)
    kept = scored.where((share >= disclosure) & known & told)
    return kept.groupBy("term").agg(F.max("share").alias("share"))


def _with_terms(found, terms):
    """Append `terms` (array of term, share): the disclosing terms that each text holds, null for none."""
    key = F.xxhash64("doc_id", "text")
    held = found.select(key.alias("_key"), F.explode(F.array_distinct(_terms(_plain_text()))).alias("term"))
    held = held.join(terms, "term").groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("term", "share"))).alias("terms"))
    return found.withColumn("_key", key).join(held, "_key", "left").drop("_key")


def _term_spans(text, terms, rank):
    quoted = F.transform(terms, lambda t: F.concat(F.lit("\\Q"), F.replace(t["term"], F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")))
    longest_first = F.transform(F.reverse(F.array_sort(F.transform(quoted, lambda q: F.struct(F.length(q).alias("n"), q.alias("q"))))), lambda s: s["q"])
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), F.array_join(longest_first, "|"), F.lit(r")(?![\p{L}\p{N}])"))
    return _spans(text, TERM, pattern, rank, lambda hit: F.lit(True))


def _apart(spans):
    """Sorted spans without the terms that overlap a base span: one pass meets the base spans that end behind a term's
    start, one from the back those that start before its end."""

    def keep(clash, behind):
        def step(acc, s):
            term = s["kind"] == TERM
            at = F.when(term, acc["at"]).otherwise(behind(acc["at"], s))
            return F.struct(at.alias("at"), F.when(term & clash(acc["at"], s), acc["out"]).otherwise(F.concat(acc["out"], F.array(s))).alias("out"))

        return step

    kinds = (SPAN, f"array<{SPAN}>")
    ahead = keep(lambda at, s: at > s["start"], lambda at, s: F.greatest(at, s["end"]))
    back = keep(lambda at, s: at < s["end"], lambda at, s: F.least(at, s["start"]))
    spans = F.flatten(_in_chunks(spans, F.lit(0), kinds, ahead, lambda out: out)["out"])
    return F.reverse(F.flatten(_in_chunks(F.reverse(spans), F.lit((1 << 31) - 1), kinds, back, lambda out: out)["out"]))


def find(docs, **options):
    """Append `base` and `spans` (base spans and disclosing terms, by start and kind) to every row, and `terms`."""
    found = find_base(docs.drop("base", "spans", "terms"))
    terms = common.written(disclosing_terms(found, **options), "disclosing-terms")
    none = F.array().cast(f"array<{SPAN}>")
    if terms.isEmpty():
        return found.withColumn("terms", F.lit(None).cast("array<struct<term:string,share:double>>")).withColumn("spans", F.col("base"))
    marked = _with_terms(found, terms)
    text = F.coalesce("text", F.lit(""))
    own = F.coalesce(F.when(F.col("terms").isNotNull(), _term_spans(text, F.col("terms"), len(KINDS))), none)
    return marked.withColumn("spans", F.when(F.size(own) > 0, _apart(F.array_sort(F.concat("base", own)))).otherwise(F.col("base")))


def listed(spans):
    """Spans as text: kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_of(spans, kind):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def sanitise(docs, removal=REMOVAL, **options):
    """The rows of `docs` with base spans replaced by their kind and disclosing terms generalised or removed."""
    # the row travels as one value, so that no column of it can clash with a helper's name
    found = find(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text"), **options)
    text = F.coalesce("text", F.lit(""))

    # spans may overlap across kinds: what an earlier one covers is not replaced twice
    def step(acc, s):
        hit = F.substring(text, s["start"] + 1, s["end"] - s["start"])
        share = F.element_at(F.filter("terms", lambda t: t["term"] == _folded(hit)), 1)["share"]
        general = F.when(hit.rlike("[0-9]"), "[NUMBER]").when(hit.rlike(r"^\p{Lu}"), "[NAME]").otherwise("[WORD]")
        word = F.when(s["kind"] != TERM, F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).when(share >= removal, F.lit("")).otherwise(general)
        put = F.when(s["start"] >= acc["at"], F.concat(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), word)).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], F.array(put)).alias("out"))

    folded = found.withColumn("_fold", F.when(F.size("spans") > 0, _in_chunks(F.col("spans"), F.lit(0), ("string", "string"), step, lambda out: F.array_join(out, ""))))
    done = F.concat(F.array_join("_fold.out", ""), F.substring(text, F.col("_fold.at") + 1, F.length(text)))
    clean = F.when(F.size("spans") > 0, done).otherwise(F.col("text"))
    return folded.select(*[clean.alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])
