"""Phrase collocations against a plain count of all phrases."""

import random
import re
from collections import Counter, defaultdict

import pytest

from kickstand.llm import op13_collocations as op13

ALL = "doc_id long, text string, lang string, score int, n int"


def plain(docs, least, most, top):
    """Every phrase counted, scored and filtered from the definition."""
    counts, totals = defaultdict(Counter), Counter()
    small = {c: c + 32 for c in range(65, 91)}
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(small)):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for m in range(1, most + 1):
                counts[lang].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, held in counts.items():
        candidates = {p: a for p, a in held.items() if len(p) > 1 and a >= least}
        inside = set()
        for p, a in candidates.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    part = p[i : i + m]
                    if 100 * a >= 100 * candidates.get(part, 0):
                        inside.add(part)
        rows = []
        for p, a in candidates.items():
            if p not in inside:
                score, k = min((1000 * a * totals[lang] // (held[p[:k]] * held[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), held[p[:k]], held[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def _docs(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)]
    weights = [1 / (i + 1) for i in range(40)]
    passages = [" ".join(rng.choices(vocabulary, k=9)) + " Rare%d hApax%d" % (i, i) for i in range(6)]
    docs = []
    for i in range(n):
        words = rng.choices(vocabulary, weights, k=rng.randrange(0, 60))
        words = [w + rng.choice(["", "", "", ",", ".", "\n", "!", "É", " x"]) for w in words]
        text = rng.choice([" ", "\t", "  "]).join(words)
        docs.append((rng.choice(["en", "en", "fr", None, "a a"]), text + rng.choice(["", " ", "\n"]) + rng.choice([*passages, "", "b b b b b b b"])))
    return docs + [("en", None), ("empty", ""), (None, "?!"), ("one", "word")]


def _run(spark, docs, **options):
    frame = spark.createDataFrame([(i % 7, t, lang, 1, 2) for i, (lang, t) in enumerate(docs)], ALL)
    return sorted(tuple(r) for r in op13.collocations(frame, **options).collect())


@pytest.mark.parametrize(
    ("top", "options"),
    [(10_000, {}), (12, {"first_power": 3}), (5, {"first_power": 3, "slice_bytes": 700}), (40, {"first_power": 4, "slice_bytes": 2000})],
)
def test_collocations_equal_a_plain_count(spark, top, options):
    docs = _docs(4, 400)
    assert _run(spark, docs, least=5, top=top, **options) == plain(docs, 5, 5, top)


def test_ties_at_the_last_place_are_settled_by_count_and_text(spark):
    docs = [("en", f"p{i} q{i}. " * (4 + i % 2) + "the of " * 3) for i in range(12)]
    assert _run(spark, docs, least=4, top=5, first_power=2) == plain(docs, 4, 5, 5)


def test_tables_without_phrases_give_no_rows(spark):
    assert _run(spark, [("en", "a b c"), (None, None)], least=2) == []
    assert spark is not None and op13.collocations(spark.createDataFrame([], ALL)).count() == 0


def test_scores_beyond_64_bits_are_exact(spark):
    a, n, left, right = 987_654_321_987_654, 9_876_543_210_123_456, 9_007_199_254_740_993, 9_007_199_254_740_991
    frame = spark.createDataFrame([(a, n, left, right)], "a long, n long, l long, r long")
    assert frame.select(op13.cut_score("a", "n", "l", "r")).first()[0] == 1000 * a * n // (left * right)


def test_a_text_longer_than_a_slice_is_cut_at_marks_only(spark):
    rng = random.Random(8)
    text = " ".join(rng.choice(["a", "b", "c d", "e.", "f,"]) for _ in range(20_000))
    assert _run(spark, [("en", text)], least=50, top=100, slice_bytes=4000) == plain([("en", text)], 50, 5, 100)
