"""Quality rules learned as a decision list: an ordered list of threshold conjunctions that reject a document.

`text_statistics` measures every whole text in vectorised passes over Arrow batches. `learn` reads a bounded
sample of labelled documents and covers the bad ones sequentially: a conjunction grows by the threshold with
the largest information gain until it rejects no good document of the growing part, is pruned from its end
against the held-back part, and is kept while it is precise enough there; the documents it covers leave, and
the next rule is learned from the rest. The list becomes one Spark conditional expression, first match wins.

A rule rejects only if all its conditions hold; a document that no rule matches is kept. Null text has no words
and fails the base rule. Without labelled documents of both kinds the list is empty. Labels that disagree for
one doc_id all count; null labels do not. Extra columns stay as they are, unless they bear a name of STATISTICS.
"""

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kickstand.llm import common

#: Bound of the labelled sample that rules are fitted on, in documents.
MAX_LABELLED = 20_000
STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals", "n_marks", "n_digits", "n_lines"]
SYMBOLS = b"[#*$%&|<>]"
MARKS = b"!?"
#: Text measured at a time, for which a worker holds about 64 bytes a byte.
SLICE_BYTES = 1 << 19
WINDOW = 5
#: What rules may test: ratios that do not depend on the length of a text.
FEATURES = {
    "mean_word_chars": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "dup_lines_share": ("n_dup_lines", "n_lines"),
    "repeat_words_share": ("n_repeat_words", "n_words"),
    "capitals_share": ("n_capitals", "word_chars"),
    "marks_per_word": ("n_marks", "n_words"),
    "digits_share": ("n_digits", "word_chars"),
}


def _later_copies(keys, rows, n_rows):
    """Per row, how many keys equal an earlier key of the row."""
    order = np.lexsort((rows, keys))
    k, r = keys[order], rows[order]
    again = np.zeros(len(k), bool)
    again[1:] = (k[1:] == k[:-1]) & (r[1:] == r[:-1])
    return np.bincount(r[again], minlength=n_rows)


def _repeated_words(words, rows, n_rows):
    """Per row, words inside a window of WINDOW words that the row holds at least twice. words: a hash of each."""
    n = len(words) - WINDOW + 1
    if n < 1:
        return np.zeros(n_rows, np.int64)
    window = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        window = (window + words[k : k + n]) * common.STEP
        window ^= window >> np.uint64(29)
    whole = rows[:n] == rows[WINDOW - 1 :]
    at = np.flatnonzero(whole)
    keys = common.mix(window[at] + rows[at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edges = np.zeros(len(words) + 1, np.int64)
    edges[at[twice]] += 1
    edges[at[twice] + WINDOW] -= 1
    covered = np.cumsum(edges[:-1]) > 0
    return np.bincount(rows[covered], minlength=n_rows)


def measure(ends, data):
    """STATISTICS of texts whose UTF-8 bytes are data[ends[i]:ends[i + 1]], as one array each."""
    n = len(ends) - 1
    starts, lengths, rows = common.word_runs(data, ends)
    blank = common.table_of(common.BLANKS)[data]
    first_bytes = (data & 0xC0) != 0x80
    values = common.BYTE_WORDS[data]
    words = common.run_hashes(values, starts, lengths)
    # lines: cut after each \n and at the texts' ends
    breaks = data == 10
    line_starts = np.unique(np.concatenate([ends[:-1], np.flatnonzero(breaks) + 1]))
    line_starts = line_starts[line_starts < len(data)]
    line_ends = np.append(line_starts, len(data))[1:]
    line_ends = line_ends - breaks[line_ends - 1]
    line_rows = np.searchsorted(ends, line_starts, side="right") - 1
    inside = np.concatenate([[0], np.cumsum(~blank)])
    worded = inside[line_ends] > inside[line_starts]
    line_starts, line_ends, line_rows = line_starts[worded], line_ends[worded], line_rows[worded]
    lines = common.run_hashes(values, line_starts, line_ends - line_starts)

    def count(byte_set):
        return common.per_row(common.table_of(byte_set)[data], ends)

    return {
        "n_words": np.bincount(rows, minlength=n),
        "word_chars": common.per_row(first_bytes & ~blank, ends),
        "n_symbols": count(SYMBOLS[1:-1]),
        "n_dup_lines": _later_copies(lines, line_rows, n),
        "n_repeat_words": _repeated_words(words, rows, n),
        "n_capitals": count(range(65, 91)),
        "n_marks": count(MARKS),
        "n_digits": count(range(48, 58)),
        "n_lines": np.bincount(line_rows, minlength=n),
    }


def text_statistics(docs, column="text"):
    """Append STATISTICS (longs) to every row; same-named columns are replaced."""
    docs = docs.drop(*STATISTICS)
    schema = T.StructType(docs.schema.fields + [T.StructField(s, T.LongType()) for s in STATISTICS])

    def run(batches):
        for batch in batches:
            ends, data = common.utf8(batch[column])
            for a, b in common.slices(ends, SLICE_BYTES):
                found = measure(ends[a : b + 1] - ends[a], data[ends[a] : ends[b]])
                added = [pa.array(found[s].astype(np.int64)) for s in STATISTICS]
                yield pa.RecordBatch.from_arrays(batch.slice(a, b - a).columns + added, names=batch.schema.names + STATISTICS)

    return docs.mapInArrow(run, schema)


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x):
        return x[self.feature] >= self.threshold if self.above else x[self.feature] < self.threshold

    def column(self):
        top, bottom = FEATURES[self.feature]
        ratio = F.coalesce(F.col(top) / F.nullif(F.col(bottom), F.lit(0)), F.lit(0.0))
        return ratio >= self.threshold if self.above else ratio < self.threshold


@dataclass
class DecisionList:
    """Rules in order; a document that all conditions of one rule fit is rejected."""

    rules: list[list[Condition]] = field(default_factory=list)

    def rejects(self, x):
        out = np.zeros(len(next(iter(x.values()))), bool)
        for rule in self.rules:
            out |= np.logical_and.reduce([c.holds(x) for c in rule])
        return out

    def rule_number(self):
        """1-based number of the first rule that fits, null if none does."""
        out = None
        for i, rule in enumerate(self.rules, 1):
            fits = rule[0].column()
            for c in rule[1:]:
                fits = fits & c.column()
            out = F.when(fits, F.lit(i)) if out is None else out.when(fits, F.lit(i))
        return F.lit(None).cast("int") if out is None else out


def ratios(statistics):
    return {name: np.divide(statistics[top], statistics[bottom], out=np.zeros(len(statistics[top])), where=np.asarray(statistics[bottom]) != 0) for name, (top, bottom) in FEATURES.items()}


def _best_condition(x, bad, held):
    """The threshold with the largest information gain among the rows still held, or None."""
    p0, n0 = int(bad[held].sum()), int((~bad[held]).sum())
    base = math.log2(p0 / (p0 + n0))
    best, gain = None, 0.0
    for name in FEATURES:
        values = x[name][held]
        order = np.argsort(values, kind="stable")
        v, b = values[order], bad[held][order]
        cuts = np.flatnonzero(v[1:] > v[:-1]) + 1
        if not len(cuts):
            continue
        below = np.cumsum(b)[cuts - 1]
        for above, p, total in ((True, p0 - below, len(v) - cuts), (False, below, cuts)):
            with np.errstate(divide="ignore"):
                g = np.where(p > 0, p * (np.log2(np.maximum(p, 1) / total) - base), 0.0)
            i = int(np.argmax(g))
            if g[i] > gain + 1e-9:
                gain = float(g[i])
                best = Condition(name, above, float((v[cuts[i] - 1] + v[cuts[i]]) / 2))
    return best


def learn(x, bad, held_back, max_rules=20, max_conditions=4, least_precision=0.9, least_support=3):
    """Sequential covering. x: feature -> values; bad: labels; held_back: rows for pruning, not for growing."""
    found = DecisionList()
    bad = np.asarray(bad, bool)
    left = np.ones(len(bad), bool)
    while len(found.rules) < max_rules and (left & bad & ~held_back).any() and (left & ~bad & ~held_back).any():
        rule, held = [], left & ~held_back
        while len(rule) < max_conditions and (held & ~bad).any():
            condition = _best_condition(x, bad, held)
            if condition is None:
                break
            rule.append(condition)
            held = held & condition.holds(x)
        if not rule:
            break

        def worth(n, rule=rule):
            fits = np.logical_and.reduce([c.holds(x) for c in rule[:n]]) & left
            p, q = int((fits & held_back & bad).sum()), int((fits & held_back & ~bad).sum())
            return ((p - q) / (p + q) if p + q else -1.0, n)

        kept = rule[: max(range(1, len(rule) + 1), key=worth)]
        fits = np.logical_and.reduce([c.holds(x) for c in kept]) & left
        if fits.sum() < least_support or bad[fits].mean() < least_precision:
            break
        found.rules.append(kept)
        left &= ~fits
    return found


def learn_rules(docs, labels, label="quality", bad=0, max_labelled=MAX_LABELLED, **options):
    """Decision list from a bounded sample of `labels` (doc_id, label), joined with the documents it names.

    The sample is the `max_labelled` labelled ids with the smallest hashes, so it is the same at every run.
    """
    order = F.xxhash64("doc_id")
    sample = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).select("doc_id", F.col(label).alias("_label"))
    sample = sample.orderBy(order, "doc_id", "_label").limit(max_labelled)
    # at most max_labelled rows of two numbers
    named = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    rows = text_statistics(named).withColumn("_held_back", F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(3)) == 0)
    got = rows.select("doc_id", "_label", "_held_back", *STATISTICS).toPandas().sort_values(["doc_id", "_label", "n_words"])
    x = ratios({s: got[s].to_numpy(np.float64) for s in STATISTICS})
    return learn(x, (got["_label"] == bad).to_numpy(), got["_held_back"].to_numpy(bool), **options)


def base_failed():
    """Too few words, or over a fifth of them in repeated windows."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def keep_good(docs, rules):
    """The rows of `docs` that neither the base rule nor the list rejects, all columns as they are."""
    # under numbers, so that no column of `docs` meets a name that judging adds; each text goes to the worker once
    plain = [f"c{i}" for i in range(len(docs.columns))]
    judged = judge(docs.toDF(*plain), rules, column=plain[docs.columns.index("text")])
    return judged.where("kept").select(*[F.col(p).alias(c) for p, c in zip(plain, docs.columns, strict=True)])


def judge(docs, rules, column="text"):
    """All rows with their STATISTICS, `base_failed`, `rule` (first rule that rejects) and `kept`; same-named columns
    are replaced."""
    out = text_statistics(docs, column).withColumn("base_failed", base_failed()).withColumn("rule", rules.rule_number())
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
