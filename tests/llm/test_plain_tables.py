"""Tables without anything in common, of one row, or of nulls and short texts alone."""

import hashlib
import random

import pytest

from kickstand.llm import op1_run_dedup as op1

DOCS = "doc_id long, text string"


def plain(rows, length=op1.LENGTH):
    """Brute force: bytes under a window that an earlier document also holds."""
    texts = [(d, (t or "").encode()) for d, t in rows]
    out = []
    for d, data in texts:
        gone = [False] * len(data)
        for i in range(len(data) - length + 1):
            if any(e is not None and (d is None or e < d) and data[i : i + length] in other for e, other in texts):
                gone[i : i + length] = [True] * length
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out.append((d, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def _noise(rng, n):
    return "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))


def _cases():
    rng = random.Random(11)
    shared = _noise(rng, 120)
    yield "unrelated", [(i, _noise(rng, 500)) for i in range(2)]
    yield "one document", [(7, _noise(rng, 900))]
    yield "all null", [(1, None), (None, None)]
    yield "all short", [(i, "x" * i) for i in range(49)]
    yield "batches without repeats among others", [(i, _noise(rng, 300) + (shared if i in (3, 40) else "") + _noise(rng, 50)) for i in range(60)]
    yield "null ids and repeats", [(None, shared), (4, shared), (4, shared), (9, shared + shared), (2, "é" * 60), (3, "é" * 60)]


@pytest.mark.parametrize(("name", "rows"), list(_cases()), ids=lambda v: v if isinstance(v, str) else "")
def test_run_dedup_equals_brute_force_on_plain_tables(spark, name, rows):
    docs = spark.createDataFrame(rows, DOCS)
    got = op1.remove_repeats(docs, batch_bytes=2000, bucket_bytes=1000).collect()
    found = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in got), key=str)
    assert found == plain(rows)
