"""Operators on texts against brute-force versions, on small rows with nulls, copies, ties and long texts."""

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from kickstand.llm import op1_run_dedup as op1
from kickstand.llm import op2_minmax as op2
from kickstand.llm import op3_decision_lists as op3
from kickstand.llm import op6_sanitise as op6
from kickstand.llm.components import components
from kickstand.llm.run_index import RunIndex

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, source string, base int, kept string, block int"


def frame(spark, rows):
    """doc_id and text with further columns, some of them named as results of operators are."""
    return spark.createDataFrame([(i, t, "s", 1, "x", 2) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    pool = ["".join(rng.choice("abcdé \n") for _ in range(rng.randrange(5, 60))) for _ in range(12)]
    rows = [(rng.randrange(300), "".join(rng.choice(pool) for _ in range(rng.randrange(0, 6)))) for _ in range(150)]
    return rows + [(None, pool[0] * 3), (None, pool[0] * 3), (7, None), (8, ""), (9, "a" * 500), (10, "a" * 300), (11, "a" * 19), (12, " \t\n")]


def without_repeats(rows, length):
    held = [(2**63 - 1 if k is None else k, (t or "").encode()) for k, t in rows]
    first = {}
    for k, b in held:
        for i in range(len(b) - length + 1):
            first[b[i : i + length]] = min(first.get(b[i : i + length], 2**63), k)
    out = []
    for (k, b), (doc_id, _) in zip(held, rows, strict=True):
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < k:
                gone[i : i + length] = b"\1" * length
        spans = sum(gone[i] and (i == 0 or not gone[i - 1]) for i in range(len(gone)))
        out.append((doc_id, len(b), sum(gone), spans, bytes(c for c, g in zip(b, gone, strict=True) if not g)))
    return sorted(out, key=str)


@pytest.mark.parametrize("sizes", [{}, {"batch_bytes": 3000, "bucket_bytes": 1000}, {"batch_bytes": 3000, "bucket_bytes": 1000, "frequent": 3}])
def test_repeats_are_removed(spark, texts, sizes):
    got = op1.remove_repeats(frame(spark, texts), length=20, word=8, **sizes).collect()
    assert sorted(((*r[:4], bytes(r[4])) for r in got), key=str) == without_repeats(texts, 20)
    assert op1.remove_repeats(frame(spark, texts).limit(0)).count() == 0


@pytest.mark.parametrize("depth", [3, 5, 8])
def test_run_index_finds_longest_matches_and_smallest_owners(depth):
    rng = random.Random(depth)

    def packed(strings):
        return np.frombuffer(b"".join(strings), np.uint8), np.cumsum([0] + [len(s) for s in strings]).astype(np.int64)

    for _ in range(60):
        alphabet = bytes(rng.sample(range(256), rng.choice([1, 2, 3, 5])))
        strings = list({bytes(rng.choice(alphabet) for _ in range(rng.randrange(1, 25))) for _ in range(rng.randrange(1, 12))})
        owners = np.array([rng.randrange(5) for _ in strings])
        data, ends = packed(strings)
        index = RunIndex(data, ends, owners, depth)
        assert index.runs() <= index.n
        others = [bytes(rng.choice(alphabet + b"zq") for _ in range(rng.randrange(1, 20))) for _ in range(5)]
        for patterns in (strings, others):
            p_data, p_ends = packed(patterns)
            found, rows = index.matching_statistics(p_data, p_ends)
            for i, p in enumerate(patterns):
                for j in range(len(p)):
                    best = max((n for n in range(1, depth + 1) if j + n <= len(p) and any(p[j : j + n] in s for s in strings)), default=0)
                    assert found[p_ends[i] + j] == best
                    if best == depth:
                        row = rows[p_ends[i] + j]
                        assert index.least_owner(np.array([row]))[0] == min(o for s, o in zip(strings, owners, strict=True) if p[j : j + depth] in s)


def test_the_index_sorts_only_ties_again(monkeypatch):
    rng = np.random.default_rng(7)
    data = rng.integers(97, 123, 40000).astype(np.uint8)
    data[30000:30100] = data[:100]
    real, sorted_ = np.sort, []
    monkeypatch.setattr(np, "sort", lambda x: sorted_.append(len(x)) or real(x))
    index = RunIndex(data, np.array([0, 20000, 40000]), np.array([1, 2]), 50)
    # symbols of a key tell most positions apart; the passage that comes twice is sorted until it ends
    assert sorted_[0] == index.n and len(sorted_) > 3 and sum(sorted_[1:]) < index.n
    found, rows = index.matching_statistics(data, np.array([0, 20000, 40000]))
    assert (found[30000:30051] == 50).all() and (index.least_owner(rows[30000:30051]) == 1).all()


def test_hashes_do_not_depend_on_where_a_string_lies(monkeypatch):
    rng = np.random.default_rng(8)
    passage = rng.integers(0, 256, 120).astype(np.uint8)
    starts = np.sort(rng.choice(np.arange(0, 9000, 130), 40, replace=False))
    data = rng.integers(0, 256, 9000).astype(np.uint8)
    for a in starts:
        data[a : a + 120] = passage[: len(data[a : a + 120])]
    sizes = np.minimum(120, len(data) - starts)
    whole = op1._string_hashes(data, starts, sizes)
    monkeypatch.setattr(op1, "HASHED", 64)
    assert (op1._string_hashes(data, starts, sizes) == whole).all() and len(set(whole[sizes == 120])) == 1
    other = op1._string_hashes(data, starts + 1, np.minimum(sizes, 100))
    assert not set(other) & set(whole) and len(op1._string_hashes(data, starts[:0], sizes[:0])) == 0


def _repetitive(n_copies):
    rng = random.Random(12)
    passage = bytes(rng.choice(b"abcdefgh ") for _ in range(3000))
    copies = []
    for _ in range(n_copies):
        held = bytearray(passage)
        held[rng.randrange(len(held))] = ord("X")
        copies.append(bytes(held))
    return np.frombuffer(b"".join(copies), np.uint8), np.arange(n_copies + 1) * len(passage), np.arange(n_copies)


def test_run_end_samples_carry_the_matches():
    data, ends, owners = _repetitive(12)
    index = RunIndex(data, ends, owners, 50)
    found, _ = index.matching_statistics(data, ends)
    places = np.arange(len(data)) - np.repeat(ends[:-1], np.diff(ends))
    assert (found == np.minimum(3000 - places, 50)).all()
    index.at_start, index.at_end = np.zeros_like(index.at_start), np.zeros_like(index.at_end)
    lost, _ = index.matching_statistics(data, ends)
    assert (lost >= 50).sum() < (found >= 50).sum()


def test_the_index_follows_runs_on_repetitive_text():
    few, many = (RunIndex(*_repetitive(n), 50) for n in (10, 80))

    def kept(index):
        return sum(v.nbytes for k, v in vars(index).items() if isinstance(v, np.ndarray) and k != "padded")

    assert many.n > 7 * few.n and many.padded.nbytes == many.n + 51
    assert many.runs() < 3 * few.runs() and kept(many) < 0.5 * many.n * 8
    # each copy adds what its one change adds, not its length
    assert (kept(many) - kept(few)) / (many.n - few.n) < kept(few) / few.n


def linked_components(rows, width=4):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets, parent = {}, {}
    for k, t in rows:
        w = WORDS.findall((t or "").translate(lower))
        sets[k] = frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()
        parent[k] = k

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return {k: (len(sets[k]), root(k)) for k in sets}


@pytest.fixture(scope="module")
def copies():
    """Groups of edited copies around the limit of 0.8, exact copies in other case and spacing, short and empty texts."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    rows, n = [], 0
    for _ in range(6):
        base = [rng.choice(vocabulary) for _ in range(120)]
        for edits in [0, 0, 1, 1, 2, 2, 3, 3, 4, 4, 5, 6, 7, 8, 9] * 2:
            words = list(base)
            for _ in range(edits):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((n, " ".join(words)))
            n += 1
    rows += [(n, rows[3][1].upper().replace(" ", "\t ")), (n + 1, "One two"), (n + 2, "one  TWO"), (n + 3, None), (n + 4, " \n"), (n + 5, "one two three")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [4, 1024])
def test_near_duplicates_equal_all_pairs(spark, copies, block):
    got = op2.near_duplicates(frame(spark, copies), block=block).collect()
    want = linked_components(copies)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_of_odd_rows(spark):
    rows = [(3, "a b c d e f"), (3, "q r s t u v"), (1, "Q R S T U V"), (None, "a b c d e f"), (5, None)]
    got = sorted((tuple(r) for r in op2.near_duplicates(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(3, 3, 1, False), (3, 3, 1, False), (1, 3, 1, True), (None, 3, None, True), (5, 0, 5, True)], key=str)
    assert op2.near_duplicates(frame(spark, rows).limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(100, 140)]
    star = [(0, i) for i in range(1, 30)]
    mixed = [(50, 60), (55, 60), (55, 61), (51, 61), (51, 60)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain + star + mixed, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(101, 141)}, **{i: 0 for i in range(1, 30)}, 55: 50, 60: 50, 61: 50, 51: 50}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def statistics(text):
    words = WORDS.findall(text or "")
    places = collections.defaultdict(list)
    for i in range(len(words) - 4):
        places[tuple(words[i : i + 5])].append(i)
    covered = {i + k for held in places.values() if len(held) > 1 for i in held for k in range(5)}
    seen, copies = set(), 0
    for line in (text or "").split("\n"):
        if WORDS.search(line):
            copies += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), copies, len(covered)


def test_text_statistics(spark, texts):
    rng = random.Random(3)
    more = [(1000 + i, " ".join(rng.choice(["a", "bé", "#c", "d\n", "e\n\n", "日", " "]) for _ in range(rng.randrange(60)))) for i in range(80)]
    rows = texts + more
    got = op3.text_statistics(frame(spark, [(i, t) for i, (_, t) in enumerate(rows)])).collect()
    for r in got:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == statistics(rows[r["doc_id"]][1])
    assert got[0]["kept"] == "x" and len(got) == len(rows)


def test_decision_list_learns_conjunctions():
    rng = np.random.default_rng(1)
    n = 3000
    x = {name: rng.random(n) for name in op3.FEATURES}
    bad = (x["symbols_per_word"] > 0.8) | ((x["capitals_share"] > 0.6) & (x["marks_per_word"] > 0.5))
    found = op3.learn(x, bad, np.arange(n) % 3 == 0)
    fresh = {name: rng.random(n) for name in op3.FEATURES}
    truth = (fresh["symbols_per_word"] > 0.8) | ((fresh["capitals_share"] > 0.6) & (fresh["marks_per_word"] > 0.5))
    assert (found.rejects(fresh) == truth).mean() > 0.97
    assert op3.learn(x, np.zeros(n, bool), np.arange(n) % 3 == 0).rules == []


def test_rules_as_columns_agree_and_keep_rows_whole(spark):
    rules = op3.DecisionList([[op3.Condition("symbols_per_word", True, 0.5)], [op3.Condition("mean_word_chars", False, 2.0), op3.Condition("capitals_share", True, 0.3)]])
    good = "the quick brown fox jumps over the lazy dog and goes home again"
    rows = [(1, good), (2, "#a " * 5 + good), (3, " ".join("ABCDEFGHIJKLMN")), (4, None), (5, "few words")]
    got = {r["doc_id"]: (r["rule"], r["kept"]) for r in op3.judge(frame(spark, rows).drop("kept"), rules).collect()}
    assert got == {1: (None, True), 2: (None, True), 3: (2, False), 4: (None, False), 5: (None, False)}
    kept = op3.keep_good(frame(spark, rows), rules).collect()
    assert [r["doc_id"] for r in kept] == [1, 2] and kept[0]["kept"] == "x"
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 0), (3, None)], "doc_id long, quality int")
    assert op3.learn_rules(frame(spark, rows), labels).rules == []


KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, hit):
    digits = [int(c) for c in hit if c in "0123456789"]
    if kind == "ip":
        return all(int(part) <= 255 for part in hit.split("."))
    if kind == "card":
        doubled = [d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits))]
        return 12 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def personal(text):
    found = []
    for rank, (kind, pattern) in enumerate(KINDS.items()):
        found += [(m.start(), rank, m.end(), kind) for m in re.finditer(pattern, text or "") if passes(kind, m[0])]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


def test_base_spans_equal_plain_patterns(spark):
    rng = random.Random(5)
    parts = ["a", "b.", "@", ".", "-", "_", "%", "1", "22", "4111 1111 1111 1111", "4111-1111-1111-1111", " ", "+1", "+49 (30) 123-4567", "255", ".256.", "0001.2.3.4", "\n", "é", "日😀", "x@y.z", "()", "5500005555555559", "10.0.0.1"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(0, 14)))) for i in range(1500)]
    rows += [(1500, None), (1501, "1." * 3000), (1502, "x" * 200_000), (1503, "a@b.co " * 900)]
    got = op6.find_base(frame(spark, rows).drop("base")).select("doc_id", op6.listed(F.col("base")).alias("spans")).collect()
    assert [r for r in got if r["spans"] != personal(rows[r["doc_id"]][1])] == []


def test_terms_that_give_an_entity_away(spark):
    rng = random.Random(3)
    rows = [(i, f"the quick {rng.choice('abcdefgh') * 3} rises Zorblax near bob@corp.example.com and {i} goes home") for i in range(20)]
    rows += [(100 + i, "the quick brown fox and home goes near rises") for i in range(40)]
    rows += [(400 + i, f"word{i} u{i}@x.org and the word{i + 1} is {i}") for i in range(300)]
    rows += [(900, "I saw zorblax, 4111 1111 1111 1111"), (901, None), (902, "")]
    texts = {r["doc_id"]: r["text"] for r in op6.sanitise(frame(spark, rows), bits=3.0).collect()}
    assert texts[900] == "I saw , [CARD]" and texts[901] is None and texts[902] == ""
    assert "Zorblax" not in texts[0] and "[EMAIL]" in texts[0] and "quick" in texts[0] and texts[100] == rows[20][1]
    general = op6.sanitise(frame(spark, rows), bits=3.0, removal=2.0).where("doc_id in (0, 900)").collect()
    assert {r["text"].count("[NAME]") + r["text"].count("[WORD]") for r in general} == {1}
    spans = op6.find(frame(spark, rows), bits=3.0).where("doc_id = 900").select(op6.listed(F.col("spans"))).first()[0]
    assert spans == "term:6:13,card:15:34"
    assert op6.sanitise(frame(spark, rows).limit(0)).columns == frame(spark, rows).columns


def test_copies_and_repeats_do_not_thin_a_disclosing_term(spark):
    """A name beside one address only, one of its contexts copied into many texts, the name twice in each text."""
    rows = [(i, f"the Zorblax of lot{i} wrote from bob@corp.example.com on day{i} signed zorblax then") for i in range(6)]
    rows += [(50 + i, f"page{i} " + "filler " * 30 + "the Zorblax of lot1 wrote from bob@corp.example.com on day1 signed zorblax then" + " filler" * 30) for i in range(200)]
    rows += [(300 + i, rows[0][1]) for i in range(50)]
    rows += [(400 + i, f"word{i} u{i}@x.org wrote from there on a day signed of the house {i}") for i in range(600)]
    terms = {r["term"]: r["share"] for r in op6.disclosing_terms(op6.find_base(frame(spark, rows)), bits=1.0).collect()}
    assert terms["zorblax"] == 1.0 and "wrote" not in terms and max(terms.values()) <= 1.0


def test_words_at_the_edges_of_a_text_are_context(spark):
    long = "a" * 60 + " " + "b" * 60
    rows = [(1, "Alice: alice@x.org"), (2, "write to alice@x.org Alice"), (3, f"{long} carol@x.org {long}"), (4, "x" + "y" * 99 + "dave@x.org"), (5, "lead " + "z" * 98 + " erin@x.org " + "z" * 98 + " tail")]
    held = {}
    for r in op6.contexts(op6.find_base(frame(spark, rows))).collect():
        held.setdefault(r["entity"].split(":")[1][0], []).append(r["beside"].split())
    assert sorted(held["a"]) == [["Alice:"], ["write", "to", "Alice"]]
    assert held["c"] == [["b" * 60, "a" * 60]] and held["e"] == [["z" * 98, "z" * 98]]


def test_hot_and_rare_entities_have_terms_too(spark):
    """A hot entity has half of all texts; a rare one two; words of many texts and words seen once stay."""
    rows = [(i, f"note {i} by Zorblax at boss@corp.example.com on a day") for i in range(60)]
    rows += [(100 + i, f"note {i} from mail{i} at u{i}@x.org on a day") for i in range(58)]
    rows += [(200, "call Quimby first rare@x.org please at once"), (201, "then Quimby again rare@x.org a day")]
    terms = {r["term"]: r["share"] for r in op6.disclosing_terms(op6.find_base(frame(spark, rows))).collect()}
    assert terms == {"by": 1.0, "zorblax": 1.0, "quimby": 1.0}
    few = [(i, f"{w} Zorblax is boss@corp.example.com {w}") for i, w in enumerate("abcdef")] + [(10 + i, f"{w} is there") for i, w in enumerate("abcdefgh")]
    assert [r["term"] for r in op6.disclosing_terms(op6.find_base(frame(spark, few))).collect()] == ["zorblax"]


def test_terms_are_found_in_any_case_beside_a_dotted_capital_i(spark):
    rows = [(i, f"the İlkay of lot{i} wrote from bob@corp.example.com on day{i} with Zorblax") for i in range(8)]
    rows += [(100 + i, f"note {i} of the day from here on with wrote lot{i} and day{i}") for i in range(300)]
    rows += [(900, "in İzmir ZORBLAX and zorblax met İLKAY, ilkay")]
    text = op6.sanitise(frame(spark, rows), removal=2.0).where("doc_id = 900").first()["text"]
    assert text == "in İzmir [NAME] and [WORD] met [NAME], [WORD]"


@pytest.mark.parametrize("block", [2, 1024])
def test_texts_of_one_template_do_not_meet_in_one_task(spark, block, monkeypatch):
    """Texts that share 70 % are in common buckets, apart, with few links: pairs that are compared stay few, links whole."""
    rng = random.Random(12)
    template = [f"t{i}" for i in range(90)]
    rows = [(i, " ".join(template + [f"w{rng.randrange(10**9)}" for _ in range(25)])) for i in range(150)]
    rows += [(200 + i, rows[i * 9][1] + f" z{i} y{i} x{i}") for i in range(15)]
    compared = []
    confirmed = op2._confirmed

    def counted(pairs, *args):
        compared.append(pairs.count())
        return confirmed(pairs, *args)

    monkeypatch.setattr(op2, "_confirmed", counted)
    got = op2.near_duplicates(frame(spark, rows), block=block).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == linked_components(rows)
    assert compared[1] < 200 and not hasattr(op2, "_crosser")
