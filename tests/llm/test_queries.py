"""Every registered query on small tables with nulls, repeats, ties and clashing columns, and on empty ones."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from kickstand.llm import catalog
from tests.llm.test_plain_tables import plain as removed

LONGS = dict.fromkeys
CONTRACT = {
    "op1_run_dedup": {**LONGS(["doc_id", "n_bytes", "n_removed", "n_spans"], "bigint"), "kept_sha256": "string"},
    "op2_minmax": {**LONGS(["doc_id", "n_shingles", "component_id"], "bigint"), "kept": "boolean"},
    "op3_decision_lists": {
        **LONGS(["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"], "bigint"),
        "base_failed": "boolean",
        "kept": "boolean",
    },
    "op4_perspectives": {"conv_id": "bigint", "perspective": "string", "text": "string", "mask": "string"},
    "op5_token_files": LONGS(["doc_id", "start", "n_tokens", "ids_crc32"], "bigint"),
    "op6_sanitise": {**LONGS(["doc_id", "n_email", "n_ip", "n_card", "n_phone"], "bigint"), "base_sha256": "string", "spans": "string"},
    "op7_pfair_mixing": {"doc_id": "bigint", "source": "string"},
    "op8_pivot_distance": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"},
    "op9_packing": LONGS(["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"], "bigint"),
    "op10_tag_paths": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    "op11_maxent": {
        "doc_id": "bigint",
        "held_out": "boolean",
        **LONGS(["n_tokens", "n_known", "train_tokens"], "bigint"),
        "base_score": "double",
        "score": "double",
    },
    "op12_repair": {
        **LONGS(["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost"], "bigint"),
        "audit": "string",
        "repaired_sha256": "string",
    },
    "op13_collocations": {"lang": "string", "phrase": "string", **LONGS(["rank", "a", "l", "r", "n", "score"], "bigint")},
}
#: Queries with a row per row of documents.
PER_DOCUMENT = ["op1_run_dedup", "op3_decision_lists", "op5_token_files", "op6_sanitise", "op7_pfair_mixing", "op11_maxent"]


def _documents():
    rng = random.Random(21)
    words = ["alpha", "Beta", "gamma,", "delta.", "É", "x#y", "mail a.b@c.org now", "10.0.0.1", "4111 1111 1111 1111", "+1 (555) 010-9999", "\n", "$$$"]
    docs = []
    for i in range(70):
        docs.append((rng.choice([i, i, 5, None]), " ".join(rng.choices(words, k=rng.randrange(0, 60)))))
    copy = " ".join(rng.choices(words, k=80))
    docs += [(200 + i, copy) for i in range(6)] + [(300, copy + " more"), (None, copy), (301, None), (302, ""), (303, " \n\t "), (304, "word " * 9000)]
    return [(d, t, rng.choice(["en", None, "fr"]), rng.choice(["hot", "hot", "rare", None]), None if t is None else len(t), True, "k", 1, 2) for d, t in docs]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    rng = random.Random(22)
    root = tmp_path_factory.mktemp("odd")
    clash = "kept boolean, row string, batch int, n_words int"
    docs = _documents()
    tables = {
        "documents": (docs, f"doc_id long, text string, lang string, source string, n_chars long, {clash}"),
        "labels": ([(d[0], rng.choice([0, 1, None]), 0, 1) for d in docs[:40]], "doc_id long, quality int, toxic int, kept int"),
        "conversations": (
            [(rng.choice([1, 2, None]), rng.choice([0, 1, 2, None]), rng.choice(["user", "assistant", None, ""]), rng.choice(["Yes.", None, "no", ""]), 1) for _ in range(40)],
            "conv_id long, turn long, role string, text string, part int",
        ),
        "embeddings": (
            [(rng.choice([i, 100, None]), rng.choice([[0.5, 1.0], [0.25, -1.0], None, [float("nan"), 1.0], []]), 1) for i in range(60)],
            "vec_id long, embedding array<double>, score int",
        ),
        "pages": (
            [(1, "u", "<article><p>One, two.</p></article>", "t"), (None, None, None, "t"), (2, "v", "", "t"), (2, "v", "<p>x", "t"), (2, "v", "<p>x", "t")],
            "page_id long, url string, html string, text string",
        ),
    }
    for name, (rows, layout) in tables.items():
        frame = spark.createDataFrame(rows, layout)
        frame.write.parquet(f"{root}/full/{name}.parquet")
        frame.limit(0).write.parquet(f"{root}/empty/{name}.parquet")
    return root, docs


@pytest.mark.parametrize("name", list(CONTRACT))
def test_columns_types_and_empty_tables(spark, odd, name):
    root, docs = odd
    got = catalog.queries()[name](spark, f"{root}/full")
    kinds = dict(got.dtypes)
    assert {c: kinds.get(c) for c in CONTRACT[name]} == CONTRACT[name]
    rows = got.collect()
    if name in PER_DOCUMENT:
        assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(d[0]) for d in docs)
    empty = catalog.queries()[name](spark, f"{root}/empty")
    assert dict(empty.dtypes) == kinds and empty.count() == 0


def test_every_registered_query_is_listed_here():
    assert list(catalog.queries()) == list(CONTRACT)


def test_removed_bytes_and_hashes(spark, odd):
    root, docs = odd
    got = catalog.op1_run_dedup(spark, f"{root}/full").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == removed([(d[0], d[1]) for d in docs])


def test_token_ids_and_places(spark, odd):
    root, docs = odd
    tokenizer = Tokenizer.from_file(catalog.BYTE_VOCABULARY)
    want = []
    for d in docs:
        ids = np.array(tokenizer.encode(d[1] or "", add_special_tokens=False).ids + [2], "<u4")
        want.append((d[0], len(ids), zlib.crc32(ids.tobytes())))
    got = [tuple(r) for r in catalog.op5_token_files(spark, f"{root}/full").select("doc_id", "n_tokens", "ids_crc32", "start").collect()]
    assert sorted((g[:3] for g in got), key=str) == sorted(want, key=str)
    got.sort(key=lambda g: g[3])
    assert [g[3] for g in got] == np.cumsum([0] + [g[1] for g in got])[:-1].tolist()


def _spans(text):
    """The base spans from the plain patterns, kind by kind."""
    found = []
    for rank, (kind, pattern) in enumerate(
        {
            "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
            "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+",
            "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
        }.items()
    ):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            luhn = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits))) % 10 == 0
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 12 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15}
            if good[kind]:
                found.append((m.start(), rank, m.end(), kind))
    return [f"{kind}:{start}:{end}" for start, _, end, kind in sorted(found)]


def test_base_spans_and_hashes(spark, odd):
    root, docs = odd
    want = [(d[0], *(sum(s.startswith(k) for s in _spans(d[1] or "")) for k in ("email", "ip", "card", "phone")), hashlib.sha256(",".join(_spans(d[1] or "")).encode()).hexdigest()) for d in docs]
    got = catalog.op6_sanitise(spark, f"{root}/full").collect()
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted(want, key=str)
    for r in got:
        base = set(s for s in r["spans"].split(",") if s and not s.startswith("term"))
        assert hashlib.sha256(",".join(s for s in r["spans"].split(",") if s in base).encode()).hexdigest() == r["base_sha256"]


def test_components_of_whole_texts(spark, odd):
    root, docs = odd

    def shingles(text):
        small = {c: c + 32 for c in range(65, 91)}
        words = re.findall("[^ \t\n\x0b\x0c\r]+", (text or "").translate(small))
        if not words:
            return frozenset()
        return frozenset([tuple(words)] if len(words) < 4 else [tuple(words[i : i + 4]) for i in range(len(words) - 3)])

    held = [(d[0], shingles(d[1])) for d in docs]
    got = catalog.op2_minmax(spark, f"{root}/full").collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"]) for r in got) == sorted((str(d), len(s)) for d, s in held)
    of = {}
    for r in got:
        of.setdefault(r["doc_id"], set()).add(r["component_id"])
    for i, (d, s) in enumerate(held):
        for e, t in held[:i]:
            if d is not None and e is not None and s and t and 100 * len(s & t) >= 80 * len(s | t):
                assert of[d] & of[e]
