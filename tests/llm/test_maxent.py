"""The language model against its definition, and held-out documents against unigrams."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kickstand.llm import op11_maxent as op11

DOCS = "doc_id long, text string, held_out int, score string"


def tokens(text):
    small = {c: c + 32 for c in range(65, 91)}
    return re.findall("[^ \t\n\x0b\x0c\r]+", (text or "").translate(small)) + [None]


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def _docs(n):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)] + ["É", "the", "Of"]
    follows = {w: rng.sample(words, 4) for w in words}
    docs = []
    for i in range(n):
        out, w = [], rng.choice(words)
        for _ in range(rng.randrange(0, 80)):
            w = rng.choice(follows[w]) if rng.random() < 0.9 else f"rare{rng.randrange(5000)}"
            out.append(w)
            w = w if w in follows else rng.choice(words)
        docs.append((i if rng.random() < 0.95 else 7, rng.choice([" ", "\n", " \t"]).join(out)))
    return docs + [(None, "the of"), (500_000, None), (500_001, ""), (500_002, " \n "), (500_003, "x" * 40_000 + " the " * 9000)]


def test_base_score_and_counts(spark):
    docs = _docs(400)
    count = Counter(t for d, text in docs if not held_out(d) for t in tokens(text))
    n, v = sum(count.values()), len(count)
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs], DOCS)
    got = op11.score(frame, slice_bytes=3000, rounds=1).collect()
    want = []
    for d, text in docs:
        held = tokens(text)
        base = sum(math.log10((count[t] + 0.5) / (n + 0.5 * (v + 1))) for t in held)
        want.append((str(d), held_out(d), len(held), sum(count[t] > 0 for t in held), n, round(base, 6)))
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == sorted(want)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)


def test_the_model_beats_unigrams_on_held_out_documents(spark):
    frame = spark.createDataFrame([(*d, 1, "x") for d in _docs(3000)], DOCS)
    means = {}
    for rounds in (0, 2):
        got = op11.score(frame, rounds=rounds).where("held_out").agg(F.sum("n_tokens"), F.sum("base_score"), F.sum("score")).first()
        means[rounds] = (got[1] / got[0], got[2] / got[0])
    assert means[2][1] > means[2][0] + 0.1
    # what counts alone give is less: the contexts were learned
    assert means[2][1] > means[0][1] + 0.1


def test_probabilities_sum_to_one(spark):
    docs = _docs(300)
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs], DOCS)
    coded, model, n, v = op11.fit(frame, rounds=1)
    row = next(r for r in map(lambda r: r.asDict(), coded.collect()) if len(r["doc_ids"]) > 5)
    held = op11.Coded(row)
    at = np.arange(3, 6)
    # per context: all buckets, and inside each its known tokens and the unseen one
    total = np.zeros(len(at))
    for bucket in range(op11.BUCKETS):
        held.buckets = held.buckets.copy()
        held.buckets[at] = bucket
        share = np.zeros(len(at))
        for table, _, target, z in model.both(held, at):
            share += z[target, np.arange(len(at))] - np.log(np.exp(z).sum(0))
        total += np.exp(share)
    assert total == pytest.approx(np.ones(len(at)), abs=1e-4)
    for bucket in np.flatnonzero((model.bucket_counts > 0) & (np.arange(op11.BUCKETS) >= op11.SINGLES))[:50]:
        n_b, v_b = model.bucket_counts[bucket], model.bucket_words[bucket]
        known = (n_b - model.discount * v_b) / n_b
        unseen = np.exp(model.inside(np.array([bucket]), np.array([0])))[0]
        assert known + unseen == pytest.approx(1)


def test_empty_tables_and_tables_without_training_documents(spark):
    frame = spark.createDataFrame([(*d, 1, "x") for d in _docs(30) if held_out(d[0])], DOCS)
    got = op11.score(frame).collect()
    assert got and all(r["held_out"] and r["train_tokens"] == 0 and r["n_known"] == 0 and r["base_score"] == 0.0 for r in got)
    assert op11.score(frame.limit(0)).count() == 0
