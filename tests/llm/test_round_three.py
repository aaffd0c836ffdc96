"""Tensored MinHash, hard negatives and conversation repair against brute force and on odd tables."""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest

from riskweave.llm import conversation_repair as repair
from riskweave.llm import decontaminate, hard_negatives, license_scan, packing, tensor_minhash

UPPER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(np.array("the of and alpha beta gamma delta river stone light copper window".split())[rng.integers(0, 12, n)] + rng.integers(0, 30, n).astype(str).astype(object))


# --- tensored MinHash --------------------------------------------------------

def shingles(text, n=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    return {tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def components_of(rows):
    """(id, shingle count, smallest id) per row, by all pairs."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 80 * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    least = {}
    for i, (id_, _) in enumerate(rows):
        if id_ is not None:
            least[find(i)] = min(id_, least.get(find(i), id_))
    return sorted(((id_, len(sets[i]), least.get(find(i)), id_ == least.get(find(i))) for i, (id_, _) in enumerate(rows)), key=repr)


def found_components(spark, rows, schema="doc_id long, text string"):
    out = rows_of(tensor_minhash.near_duplicates(spark.createDataFrame(rows, schema)))
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in out), key=repr)


def family(seed, n, changes, words=120):
    """n copies of one text with up to so many words changed."""
    rng = np.random.default_rng(seed)
    base, out = prose(seed, words).split(), []
    for _ in range(n):
        own = list(base)
        for at in rng.integers(0, words, int(rng.integers(0, changes + 1))):
            own[at] = f"x{rng.integers(10**6)}"
        out.append(" ".join(own))
    return out


def test_components_against_brute_force(spark):
    texts = [t for seed in range(12) for t in family(seed, 12, 5)] + [prose(99, k) for k in (1, 2, 3, 4, 5)] * 2
    texts += [None, "", " \n\t", "One Two", "one  two", "ONE two three", "!!", "É é", "é É"]
    rows = [(1000 - i, t) for i, t in enumerate(texts)]
    assert found_components(spark, rows) == components_of(rows)


def test_repeated_null_and_string_ids(spark):
    rows = [(5, prose(1, 40)), (5, prose(1, 40)), (None, prose(1, 40)), (None, prose(2, 30)), (2, prose(3, 30)), (2, prose(4, 30)), (None, None), (7, None)]
    out = rows_of(tensor_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in out), key=repr)
    assert got == sorted([(5, 5, True), (5, 5, True), (None, 5, False), (None, None, True), (2, 2, True), (2, 2, True), (None, None, True), (7, 7, True)], key=repr)
    rows = [("b", prose(1, 40), 1), ("a", prose(1, 40).upper(), 2)]
    out = rows_of(tensor_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id string, text string, _set long")))
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in out} == {("a", "a", True), ("b", "a", False)}


def test_large_groups_keep_every_link(spark, monkeypatch):
    """Families whose members are at about the threshold, cut into small chunks: stragglers meet all others."""
    monkeypatch.setattr(tensor_minhash, "CHUNK_TEXTS", 7)
    rows = list(enumerate(t for seed in (3, 4) for t in family(seed, 60, 8)))
    expected = components_of(rows)
    assert len({x[2] for x in expected}) > 4  # some are apart
    assert found_components(spark, rows) == expected


def test_few_long_copies_are_compared(spark):
    long = prose(1, 250_000)
    rows = [(1, long), (2, long + " end"), (3, prose(2, 250_000))]
    assert [(x[0], x[2]) for x in found_components(spark, rows)] == [(1, 1), (2, 1), (3, 3)]


def test_no_documents(spark):
    assert found_components(spark, []) == []


def test_half_keys_join_into_tables_that_meet():
    sets = tensor_minhash.shingle_sets(family(1, 200, 4), 4)
    keys = tensor_minhash.half_keys(sets, 14, 3)
    assert keys.shape == (200, 28)
    close = [(i, j) for i, j in itertools.combinations(range(200), 2) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))]
    same = [(keys[i] == keys[j]) for i, j in close]
    assert len(close) > 1000 and np.mean([x[:14].any() and x[14:].any() for x in same]) > 0.999


# --- hard negatives ----------------------------------------------------------

def mined(rows, positives=5, negatives=3):
    """The contract by all pairs in plain integers."""
    good = {}
    for id_, label, vector in rows:
        if id_ is None or label is None or vector is None or any(x is None or not np.isfinite(x) for x in vector):
            continue
        good[id_] = min(good.get(id_, (label, vector)), (label, vector))
    whole = {i: (label, [int(np.floor(256.0 * x)) for x in v]) for i, (label, v) in good.items()}
    out = []
    for a, (label, v) in whole.items():
        if a % 50:
            continue
        scores = sorted((-max(-(2**63 - 1), min(2**63 - 1, sum(map(int.__mul__, v, w)))), i, other) for i, (other, w) in whole.items() if i != a)
        for p, positive, _ in [x for x in scores if x[2] == label][:positives]:
            inside = [(n, i) for n, i, other in scores if other != label and 50 * -p <= 100 * -n <= 95 * -p]
            out += [(a, positive, k + 1, i, -p, -n) for k, (n, i) in enumerate(inside[:negatives])]
    return sorted(out)


VECTORS = "vec_id long, label int, embedding array<double>"


def found_negatives(spark, rows):
    from pyspark.sql import functions as F
    out = hard_negatives.mine(spark.createDataFrame(rows, VECTORS).repartition(5), F.col("_id") % 50 == 0)
    return sorted(tuple(r) for r in out.collect())


@pytest.mark.parametrize("spread", [0.1, 0.004, 1e6])  # usual, many ties, beyond 24 and 53 bits
def test_negatives_against_brute_force(spark, spread, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ROWS", 37)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 3)
    rng = np.random.default_rng(5)
    rows = [(i, int(rng.integers(4)), (rng.normal(0.1, 1, 8) * spread).tolist()) for i in range(400)]
    rows[150:170] = [(i, 1, rows[150][2]) for i in range(150, 170)]  # equal vectors
    rows += rows[:60]  # repeated rows
    expected = mined(rows)
    assert len(expected) > 20 and found_negatives(spark, rows) == expected


def test_negatives_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 0.5]), (50, 2, None), (100, None, [1.0]), (150, 1, [nan, 1.0]), (200, 1, [inf]), (250, 1, [None, 1.0]), (None, 1, [1.0]),
            (1, 1, [1.0, 0.25]), (2, 2, [0.75, 0.25]), (3, 2, [0.75]), (4, 2, []), (300, 3, []), (5, 1, [-1.0, 0.0]), (0, 1, [2.0, 0.5]), (6, 2, [0.9, 0.1, 3.0])]
    assert found_negatives(spark, rows) == mined([r if r[2] is None else (*r[:2], r[2] + [0.0] * (3 - len(r[2]))) for r in rows])
    assert found_negatives(spark, []) == []
    huge = [(0, 1, [1e20, 1.0]), (1, 1, [1e20, 0.0]), (2, 2, [5e19, 1.0]), (3, 2, [1e-3, 1e-3])]
    assert found_negatives(spark, huge) == mined(huge)


# --- conversation repair -----------------------------------------------------

def cheapest(symbols):
    """Least (cost, edits) by trying every edit at every place."""
    def inserted(f):
        for _ in range(4):
            f = [min(f[s], (2 + f[t][0], "I" + f[t][1])) for s, t in enumerate((2, 2, 3, 2))]
        return f

    far = (10**9, "~")
    f = inserted([(0, ""), far, far, (0, "")])
    for role, must_go, extra in reversed(symbols):
        g = []
        for s in range(4):
            ways = [(3 + f[s][0], "D" + f[s][1])]
            if not must_go:
                for letter, cost, kind in (("K", 0, role), ("R", 2, "u"), ("R", 2, "a")):
                    to = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}.get((kind, s))
                    if to is not None:
                        ways.append((cost + extra + f[to][0], letter + f[to][1]))
            g.append(min(ways))
        f = inserted(g)
    return f[0]


def expected_repairs(rows):
    """The contract on (conv_id, turn, role, text) rows."""
    convs = {r[0]: [] for r in rows}
    for conv, turn, role, text in rows:
        def shown(x):
            return " " if x is None else str(x)

        case, role, text = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20, shown(role), shown(text)
        if case == 0:
            continue
        text = "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text
        role = "user" if case == 4 else role
        convs[conv] += [(turn, role, text)] * (2 if case == 3 else 1)
    out = {}
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
        seen, symbols, counts = set(), [], [0, 0, 0]
        for _, role, text in own:
            last = text.rstrip(" \t\n\x0b\x0c\r")[-1:]
            fault = 1 if not last else 2 if (role, text) in seen else 3 if last not in ".!?" else 0
            seen.add((role, text))
            if fault:
                counts[fault - 1] += 1
            symbols.append((role[:1], fault in (1, 2), int(fault == 3)))
        turns = [r[0] for r in own if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(symbols, symbols[1:]))
        cost, audit = cheapest(symbols) if own else (0, "")
        lines, at, left = [], 0, ""
        for edit in audit:
            given = "assistant" if left == "u" else "user"
            if edit == "I":
                lines.append(f"{given}:")
                left = given[0]
                continue
            _, role, text = own[at]
            at += 1
            if edit != "D":
                role = given if edit == "R" else role
                lines.append(f"{role}:{text}")
                left = role[:1]
        assert at == len(own) and re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines))
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


TURNS = "conv_id long, turn long, role string, text string"
DIGEST = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def reported(spark, rows, extra=""):
    from pyspark.sql import functions as F
    df = spark.createDataFrame(rows, TURNS)
    for name in extra.split():
        df = df.withColumn(name, F.lit(7))
    out = rows_of(repair.repair_report(repair.damaged(df.repartition(3)), dropped=F.col("_dropped")))
    assert len(out) == len({r["conv_id"] for r in out})
    return {r["conv_id"]: tuple(r[n] for n in DIGEST) for r in out}


def test_block_tables_give_the_ascii_least_edits():
    kinds = [("x", True, 0)] + [(r, False, e) for r in "sua?" for e in (0, 1)]
    for n in range(4):
        for symbols in itertools.product(range(1, 10), repeat=n):
            assert repair.cheapest_edits(bytes(symbols)) == cheapest([kinds[x - 1] for x in symbols])
    rng = np.random.default_rng(2)
    for _ in range(500):
        symbols = rng.integers(1, 10, int(rng.integers(4, 60))).tolist()
        assert repair.cheapest_edits(bytes(symbols)) == cheapest([kinds[x - 1] for x in symbols])


def test_repairs_of_the_given_conversations(spark, sf):
    given = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = {r["conv_id"]: tuple(r[n] for n in DIGEST) for r in rows_of(repair.op13_conversation_repair(spark, sf))}
    assert found == expected_repairs(given)


def test_repairs_of_odd_conversations(spark):
    rng = np.random.default_rng(8)
    roles = ["user", "assistant", "system", "tool", "", None, "User", "u", "agent"]
    texts = ["Yes.", "no", "", None, " \n", "Really?", "a" * 5000 + "!", "é…", "Yes. \t\n", " ", "漢字。", "1.5"]
    rows = [(int(rng.integers(40)), int(rng.integers(12)), roles[rng.integers(9)], texts[rng.integers(12)]) for _ in range(400)]
    rows += [(None, k, "user", f"t{k}.") for k in range(5)] + [(77, None, "user", "a."), (77, None, "assistant", "b."), (77, 3, "user", "a.")]
    rows += rows[:10]
    rows += [(500, k, "user" if k % 2 else "assistant", f"line {k}.") for k in range(3000)]  # a long one
    assert reported(spark, rows, extra="_conv _turn audit gaps _dropped _case") == expected_repairs(rows)
    dropped = [(c, t, "user", "x.") for c in range(200) for t in (1,) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert dropped and set(reported(spark, dropped).values()) == {empty}
    assert reported(spark, []) == {}


def test_repaired_rows(spark):
    rows = [(1, 1, "user", "Hi."), (1, 2, "user", "Hi."), (1, 3, "tool", "x."), (1, 4, "user", "Bye."), (2, 1, "assistant", "Eh.")]
    out = sorted(tuple(r) for r in repair.repair(spark.createDataFrame(rows, TURNS)).collect())
    assert out == [(1, 0, "K", "user", "Hi."), (1, 1, "R", "assistant", "x."), (1, 2, "K", "user", "Bye."), (1, 3, "I", "assistant", ""),
                   (2, 0, "I", "user", ""), (2, 1, "K", "assistant", "Eh.")]


# --- packing on the driver ---------------------------------------------------

def test_patterns_of_many_classes_after_a_session_started(spark):
    spark.range(10).count()
    demand = {size: 20_000 // size + 1 for size in range(1, 257)}
    got: dict = {}
    sequences = 0
    for pattern, times in packing.patterns_for(demand, 256):
        assert sum(size * n for size, n in pattern.items()) <= 256
        sequences += times
        for size, n in pattern.items():
            got[size] = got.get(size, 0) + n * times
    assert got == demand
    assert sequences <= 1.01 * sum(size * n for size, n in demand.items()) / 256
    basis = np.random.default_rng(1).integers(0, 4, (60, 60)) + np.eye(60) * 9
    assert np.allclose(packing.inverse_of(basis) @ basis, np.eye(60), atol=1e-8)


def test_words_by_pieces_have_the_tokenizers_ids(spark, sf):
    import public_tokenizers

    encoder = packing.WordEncoder(public_tokenizers.path(packing.TOKENIZER))
    odd = ("l'été 'sœur été, «été» Étion. ΣΑΣ don't DON'T x1y22 a'll's … 's ''s ét ﬁn İx <|endoftext|> a<|b \x1fa a\x7f 漢字, ¿qué? ǅabc ß ẞ été' (l' "
           "ªº ² x² Ⅷ 𝒳x 😀 a\u200bb e\u0301 -- 'é a—b 12,5 é1 --é--").split(" ")
    words = sorted({w for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect() for w in r.text.replace("\n", " ").split(" ")})
    found = [encoder.by_pieces(w) for w in odd + words]
    whole = encoder.tokenizer.encode_batch(odd + words, add_special_tokens=False)
    assert all(ids is None or ids == e.ids for ids, e in zip(found, whole))
    assert sum(ids is None for ids in found) < 0.05 * len(words)


def test_removed_spans_take_nothing_else(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    docs = spark.createDataFrame([(1, f"## [draft] {item.upper()} tail. End!"), (2, f"({item})"), (3, "## [draft] tail."), (4, f"Head, {item}; {item}? ok")], "doc_id long, text string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    out = {r["doc_id"]: r["text"] for r in rows_of(decontaminate.remove_contaminated(docs, items, remove="spans"))}
    assert out == {1: "## [draft] tail. End!", 2: "(", 3: "## [draft] tail.", 4: "Head, ok"}


def test_lists_of_licenses_equal_their_twin(spark):
    """Lists that repeat phrases, phrases with words put in or left out, and the base phrases between them."""
    rng = np.random.default_rng(6)
    phrases = [x[0] for x in license_scan.OWN + license_scan.BASE]
    texts = ["CC BY-NC, CC BY-SA, CC BY-ND", "Mozilla Public License Mozilla Public License", "cc by and more by nc", "", None, "word"]
    for _ in range(120):
        words = []
        for _ in range(int(rng.integers(1, 6))):
            own = phrases[rng.integers(len(phrases))].split()
            at = int(rng.integers(len(own)))
            own[at:at + int(rng.integers(2))] = ["extra"] * int(rng.integers(3))
            words += own + ["and"] * int(rng.integers(4))
        texts.append(" ".join(words))
    documents = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})
    db = duckdb.connect()
    db.register("documents", documents)
    result = db.execute(license_scan.ORACLE_SQL)
    names = [d[0] for d in result.description]
    theirs = sorted(repr(dict(zip(names, r))) for r in result.fetchall())
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert sorted(repr({n: r[n] for n in names}) for r in rows_of(license_scan.find_licenses(df))) == theirs
    assert sum("gpl" in x for x in theirs) > 20


def test_words_of_letters_skip_the_patterns(monkeypatch):
    encoder = packing.encoder_for(packing.TOKENIZER)
    words = ["Bonjour", "l", "été", "Straße", "ΑΒΓ", "ΣΑΣ", "İstanbul", "éte", "日本", "ﬁn", "ªº", "٣x", "ǅ", "K"]
    whole = [encoder.tokenizer.encode(word, add_special_tokens=False).ids for word in words]
    class Unused:
        def __getattr__(self, name):
            raise AssertionError("a pattern was tried")

    monkeypatch.setattr(packing, "PIECES_OF", Unused())
    monkeypatch.setattr(packing, "EDGES", Unused())
    for word, ids in zip(words, whole):
        if word.isalpha():
            assert encoder.by_pieces(word) in (ids, None), word
    assert encoder.by_pieces("Bonjour") == whole[0] and encoder.by_pieces("été") == whole[2]


def test_word_tables_grow_without_copies_of_all(monkeypatch):
    import public_tokenizers

    encoder = packing.WordEncoder(public_tokenizers.path(packing.TOKENIZER))
    words = [f"word{i}" for i in range(300)]
    first = encoder.encode(words)
    encoder.encode(["one more"])
    flat = encoder.flat
    assert len(flat) > encoder.filled
    encoder.encode(["another"])
    assert encoder.flat is flat  # it was written anew for every batch
    again = encoder.encode(words)
    assert all((a == b).all() for a, b in zip(first, again))
    # Words that could not be tokenised are not taken for known ones later.
    monkeypatch.setattr(encoder, "by_pieces", lambda word: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        encoder.encode(["fresh"])
    monkeypatch.undo()
    assert list(encoder.encode(["fresh"])[0]) == encoder.tokenizer.encode("fresh", add_special_tokens=False).ids
