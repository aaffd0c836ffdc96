"""Text operators against brute force, their SQL twins, and odd tables."""

from __future__ import annotations

import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from riskweave.llm import catalog, decontaminate, host_reputation, language_id, license_scan, line_dedup, lm_scoring, ngram_join, packing
from riskweave.llm import common as c
from riskweave.llm import quality_rules, sharding

UPPER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, _key string, _row int, words string"


def plain(text):
    return PLAIN.findall((text or "").translate(UPPER))


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(np.array("the of and alpha beta gamma delta river stone light copper window".split())[rng.integers(0, 12, n)] + rng.integers(0, 30, n).astype(str).astype(object))


@pytest.fixture(scope="module")
def odd(spark):
    """NULLs in any column, empty and long texts, repeated rows, ties, and columns named like working ones."""
    long = "\n".join(prose(i, 40) for i in range(400))
    texts = [
        (1, "The mit license is the one of choice.\n" + prose(1, 60)), (1, "The mit license is the one of choice.\n" + prose(1, 60)),
        (2, prose(1, 60) + "\n" + prose(2, 30)), (3, None), (3, None), (4, ""), (5, ""), (None, prose(3, 50)), (None, None), (None, prose(3, 50)),
        (6, long), (7, long + " end"), (8, "  \n \t"), (9, "Ünï Cödé ÀÀ 漢字 😀 𝒳 \x00 \x1f"), (10, prose(5, 11)), (11, prose(5, 11).upper()), (12, "one"), (13, "!!! ??? ###"),
    ]
    rows = [(i, t, "en" if k % 3 else None, None if k % 2 else "s", k, 7, "k", k, None) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, prose(2, 30)), (2, "alpha"), (None, prose(5, 11)), (3, None), (4, ""), (5, "?!"), (1, prose(2, 30))], "item_id long, text string")


def rows_of(df):
    return [r.asDict() for r in df.collect()]


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_sql_twin(spark, sf, name):
    db = duckdb.connect()
    for table in ("documents", "benchmark", "pages", "labels", "embeddings"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    result = db.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in result.description]
    theirs = sorted(map(repr, (dict(zip(names, r)) for r in result.fetchall())))
    df = catalog.queries()[name](spark, sf)
    assert theirs == sorted(repr({n: r[n] for n in names}) for r in rows_of(df))


# --- quality rules ---------------------------------------------------------

def test_quality_odd(odd, none):
    out = rows_of(quality_rules.measure(odd.select("doc_id", "text")))
    assert len(out) == odd.count()
    assert all(r["n_words"] == 0 and r["word_chars"] == 0 for r in out if r["doc_id"] in (3, 4, 5, 8))
    for r in out:
        words = re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")
        windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
        twice = {w for w, n in Counter(windows).items() if n > 1}
        assert r["n_repeat_words"] == len({i + j for i, w in enumerate(windows) if w in twice for j in range(5)})
        assert r["word_chars"] == sum(map(len, words))
    kept = quality_rules.keep_good(odd)
    assert kept.columns == odd.columns and all(r["text"] for r in rows_of(kept))
    assert quality_rules.keep_good(none).count() == 0


def test_quality_query_uses_no_python(spark, sf):
    plan = quality_rules.op8_quality_rules(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


# --- line dedup ------------------------------------------------------------

def one_word_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def test_lines_against_brute_force(spark):
    rng = np.random.default_rng(3)
    base = [plain(prose(100 + i, int(rng.integers(4, 25)))) for i in range(25)]
    lines = []
    for _ in range(300):
        words = list(base[rng.integers(25)])
        for _ in range(rng.integers(0, 3)):
            at, kind = int(rng.integers(len(words))), rng.integers(3)
            words[at:at + (kind != 0)] = [] if kind == 1 and len(words) > 4 else [f"w{rng.integers(6)}"]
        lines.append(words)
    docs = [(i, "\n".join(" ".join(x) for x in lines[i * 6:i * 6 + 6])) for i in range(50)]
    out = {r["doc_id"]: r["text"] for r in rows_of(line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), keep_empty=True))}
    for i in range(50):
        kept = []
        for j in range(6):
            own, earlier = lines[i * 6 + j], lines[:i * 6 + j]
            near = len(own) >= line_dedup.NEAR_WORDS and any(len(x) >= line_dedup.NEAR_WORDS and one_word_apart(own, x) for x in earlier)
            if len(own) < line_dedup.MIN_WORDS or not (near or own in earlier):
                kept.append(" ".join(own))
        assert out[i] == "\n".join(kept)


def test_lines_odd(odd, none):
    out = line_dedup.dedup_lines(odd, keep_empty=True)
    assert out.columns == odd.columns and out.count() == odd.count()
    texts = defaultdict(list)
    for r in rows_of(out):
        texts[r["doc_id"]].append(r["text"])
    assert texts[3] == [None, None] and texts[4] == [""] and texts[8] == ["  \n \t"]
    assert len(set(texts[1])) == 1  # repeated rows are one document
    left = line_dedup.dedup_lines(odd)
    ids = {r["doc_id"] for r in rows_of(left)}
    assert 7 not in ids and 11 not in ids and ids >= {1, 2, 3, 4, 6, 8, 10}  # 7: all lines stand in 6, one but for a word
    assert line_dedup.dedup_lines(none).count() == 0


def test_lines_of_one_template_make_no_pairs(spark):
    docs = spark.createDataFrame([(i, "one two three four five six seven eight nine ten number" + str(i)) for i in range(2000)], "doc_id long, text string")
    assert [r["doc_id"] for r in rows_of(line_dedup.dedup_lines(docs))] == [0]


# --- language --------------------------------------------------------------

def test_parse_is_the_longest_match():
    samples = {"a": "the cat sat on the mat the end", "b": "le chat est sur le tapis la fin"}
    model = language_id.Model(samples)
    points = model.code_points()

    def phrases(text, sample):
        text, at, n = language_id.normalise(text), 0, 0
        known = set(sample)
        text = "".join(x if x in known or x == " " else "\x01" for x in text)
        while at < len(text):
            size = 1
            while at + size < len(text) and text[at:at + size + 1] in sample:
                size += 1
            at, n = at + size, n + 1
        return n

    for text in ("the chat sat", "sur la fin", "mat", "zzz the end", "on the mat le chat"):
        costs = [phrases(text, samples[x]) * math.log2(len(samples[x])) for x in "ab"]
        assert model.predict([text], points)[0][0] == "ab"[costs.index(min(costs))]


def test_language_accuracy_and_odd_rows(spark, odd, none):
    docs = c.table(spark, "/root/testdata/sf0.01", "documents")
    out = language_id.op2_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id")
    held = [(r["lang"], r["lang_pred"]) for r in rows_of(out.where("held_out"))]
    assert held and sum(a == b for a, b in held) / len(held) > 0.97
    model = language_id.train(docs)
    got = rows_of(language_id.identify(odd, model))
    assert len(got) == odd.count()
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in got if r["doc_id"] in (3, 4, 5, 8, 13))
    assert all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert language_id.identify(none, model).count() == 0
    assert {r["lang_pred"] for r in rows_of(language_id.identify(odd, language_id.train(none)))} == {"und"}


# --- shards ----------------------------------------------------------------

def test_differencing_keeps_every_part():
    sizes = np.random.default_rng(0).integers(1, 1000, 500)
    sums = np.zeros((500, 8), np.int64)
    sums[:, 0] = sizes
    left, slots = sharding.difference(sums)
    assert sorted(np.bincount(slots[:, 0], weights=sizes, minlength=8).astype(int)) == sorted(left)
    assert left.max() - left.min() <= 3
    again, to = sharding.difference(np.stack([left, left[::-1], left + 5]))
    assert again.sum() == 3 * left.sum() + 40 and all(sorted(x) == list(range(8)) for x in to)


def test_shards_over_levels(spark):
    groups = spark.createDataFrame([(str(i).encode(), int(x)) for i, x in enumerate(np.random.default_rng(1).integers(1, 5000, 900))], "_item binary, _size long")
    placed = rows_of(sharding.assign(groups, 10, per_bucket=8).join(groups, "_item"))
    sums = Counter()
    for r in placed:
        sums[r["shard"]] += r["_size"]
    assert len(placed) == 900 and len(sums) == 10 and max(sums.values()) - min(sums.values()) < 0.01 * min(sums.values())


def test_shards_odd(odd, none):
    out = rows_of(sharding.shard_documents(odd))
    assert len(out) == odd.count()
    for shard in {r["shard"] for r in out}:
        assert sorted(r["slot"] for r in out if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in out)))
    by_text = defaultdict(set)
    for r in out:
        by_text[r["text_crc32"]].add(r["shard"]) if r["text_crc32"] is not None else None
    assert all(len(x) == 1 for x in by_text.values())
    assert all(r["size"] == 16 and r["text_crc32"] is None for r in out if r["doc_id"] == 3)
    assert sharding.shard_documents(none).count() == 0


# --- packing ---------------------------------------------------------------

def full_ids(text):
    import public_tokenizers
    from tokenizers import Tokenizer
    if not hasattr(full_ids, "t"):
        full_ids.t = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    return [*full_ids.t.encode(text or "", add_special_tokens=False).ids, 2]


def test_pieces_round_trip(spark, sf, odd, none):
    docs = c.table(spark, sf, "documents").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    out = rows_of(packing.pack_documents(docs))
    by = defaultdict(list)
    for r in out:
        by[r["doc_id"]].append(r)
    assert by.keys() == texts.keys()
    for id_, pieces in by.items():
        ids, at = np.array(full_ids(texts[id_]), "<u4"), 0
        for p in sorted(pieces, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            at += p["length"]
            assert p["ids_crc32"] == zlib.crc32(ids[p["start"]:at].tobytes())
        assert at == len(ids)
    odd_out = rows_of(packing.pack_documents(odd))
    assert sum(r["start"] == 0 for r in odd_out) == odd.count()
    assert all(r["doc_tokens"] == 1 for r in odd_out if r["doc_id"] in (3, 4, 5, 8))
    for rows in (out, odd_out):
        own = defaultdict(list)
        for r in rows:
            own[r["sequence_id"]].append((r["offset"], r["length"]))
        for pieces in own.values():
            ends = list(itertools.accumulate(n for _, n in sorted(pieces)))
            assert [o for o, _ in sorted(pieces)] == [0, *ends[:-1]] and ends[-1] <= 4096
    assert sum(r["length"] for r in out) / (4096 * len({r["sequence_id"] for r in out})) > 0.9
    assert packing.pack_documents(none).count() == 0


def test_patterns_hold_the_demand_in_few_sequences():
    rng = np.random.default_rng(2)
    demand = {int(s): int(n) for s, n in zip(range(1, 257), rng.integers(0, 400, 256) * np.exp(-np.arange(256) / 60)) if int(n)}
    found = packing.patterns_for(demand, 256)
    held = Counter()
    for pattern, times in found:
        assert sum(s * n for s, n in pattern.items()) <= 256
        for s, n in pattern.items():
            held[s] += n * times
    assert dict(held) == demand
    area = sum(s * n for s, n in demand.items())
    assert sum(t for _, t in found) <= 1.001 * math.ceil(area / 256) + 1
    assert packing.patterns_for({}, 256) == [] and packing.patterns_for({256: 3}, 256) == [({256: 1}, 3)]


def test_long_texts_are_encoded_in_parts(monkeypatch):
    import public_tokenizers
    monkeypatch.setattr(packing, "SEGMENT_CHARS", 50)
    text = prose(7, 200) + "\n<|endoftext|> it's İstanbul 'll\tx\u00a0y " + "e\u0301 " * 30
    encoder = packing.WordEncoder(public_tokenizers.path(packing.TOKENIZER), words_kept=40)
    assert [list(x) for x in packing.token_ids([text, "", "a b"], encoder)] == [full_ids(t) for t in (text, "", "a b")]


# --- n-gram join -----------------------------------------------------------

def brute_classes(rows, threshold=0.8):
    texts = {t for _, t in rows if t is not None}
    sets = {t: {tuple(w[i:i + min(5, len(w))]) for i in range(len(w) - min(5, len(w)) + 1)} if w else set() for t in texts for w in [plain(t)]}
    parent, links = {t: t for t in texts}, Counter()

    def find(t):
        while parent[t] != t:
            t = parent[t]
        return t
    for a, b in itertools.combinations(sorted(texts), 2):
        n = len(sets[a] & sets[b])
        if n and n >= threshold * len(sets[a] | sets[b]) - 1e-9:
            links[a] += 1
            links[b] += 1
            parent[find(a)] = find(b)
    first = {}
    for i, t in rows:
        if t is not None and i is not None:
            first[find(t)] = min(i, first.get(find(t), i))
    copies = Counter(t for _, t in rows)
    return sorted(((i, first.get(find(t)), links[t], copies[t]) if t is not None else (i, i, 0, 1) for i, t in rows), key=repr)


def near_copies(n, seed=4):
    rng, out = np.random.default_rng(seed), []
    for i in range(n):
        words = prose(1000 + i // 8, 60 + 10 * (i // 8 % 5)).split()
        for _ in range(rng.integers(0, 4)):
            words[rng.integers(len(words))] = f"x{rng.integers(50)}"
        out.append((i, " ".join(words)))
    return out


def test_join_against_brute_force(spark, odd, none):
    rows = near_copies(160) + [(500 + i, t) for i, t in near_copies(20)]
    got = rows_of(ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    assert sorted(((r["doc_id"], r["class_id"], r["n_links"], r["n_copies"]) for r in got), key=repr) == brute_classes(rows)
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = rows_of(ngram_join.near_duplicates(odd))
    assert sorted(((r["doc_id"], r["class_id"], r["n_links"], r["n_copies"]) for r in got), key=repr) == brute_classes(rows)
    assert ngram_join.near_duplicates(none).count() == 0


def test_large_groups_are_verified_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CHUNK_TEXTS", 9)
    rows = [(i, t) for i, t in enumerate(sorted({t for _, t in near_copies(300, 9)}))]
    got = rows_of(ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    assert sorted(((r["doc_id"], r["class_id"], r["n_links"], r["n_copies"]) for r in got), key=repr) == brute_classes(rows)


def test_few_long_texts_are_counted_once(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CHUNK_BYTES", 1000)
    rows = []
    for group in range(24):  # two or three near copies, each longer than half a chunk: many chunks are empty
        words = prose(3000 + group, 90).split()
        rows += [(len(rows) + i, " ".join([*words, f"end{i}"])) for i in range(2 + group % 2)]
    assert all(500 < len(t) < 1000 for _, t in rows)
    got = rows_of(ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    assert sorted(((r["doc_id"], r["class_id"], r["n_links"], r["n_copies"]) for r in got), key=repr) == brute_classes(rows)


def test_one_of_each_stays(spark, odd):
    out = ngram_join.keep_one_of_each(odd)
    assert out.columns == odd.columns
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    classes = {x[1] for x in brute_classes([r for r in rows if r[1] is not None])}
    kept = rows_of(out)
    assert sorted((r["doc_id"] for r in kept if r["text"] is not None), key=str) == sorted(classes, key=str)
    assert sum(r["text"] is None for r in kept) == sum(t is None for _, t in rows)


# --- host reputation -------------------------------------------------------

def test_hosts_and_rules(spark):
    urls = [None, "", "no scheme", "http://WWW.Example.com/en/x?q#f", "https://example.com/en", "https://a.example.com/en/?x", "x://net/es/a", "y://sub.net/fr/", "z://net/de/",
            "http://bad.org/1", "http://bad.org/2", "http://BAD.org?x", "http://", "a://b://c/d", "http://h.co.uk#x"]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)] + [(0, None, None)] + [(100 + i, "http://bad.org/x", "") for i in range(60)]
                                  + [(1000 + i, f"http://good{i % 9}.com/x", "") for i in range(300)], "page_id long, url string, html string")
    labels = spark.createDataFrame([(100 + i, 1, 1) for i in range(60)] + [(1000 + i, 1, 0) for i in range(300)] + [(3, 1, 0), (4, 1, 0), (5, None, None), (5, 1, 0), (None, 0, 1)] + [(i, 1, 0) for i in (6, 7, 8)], "doc_id long, quality int, toxic int")
    got = defaultdict(list)
    for r in rows_of(host_reputation.judge_urls(pages, labels)):
        got[r["page_id"]].append((r["host"], r["path"], r["rule"], r["verdict"]))
    assert got[0] == [("", "", None, "allow")] * 2 and got[2] == [("", "", None, "allow")]
    assert got[3] == [("www.example.com", "/en/x", "www.example.com/en/", "allow")]
    assert got[4] == [("example.com", "/en", "com/", "allow")] and got[5] == [("a.example.com", "/en/", "example.com/en/", "block")]
    assert got[6][0][2:] == ("net/es/", "block") and got[7][0][2:] == ("net/fr/", "block") and got[8][0][2] is None
    assert got[9] == [("bad.org", "/1", None, "block")] and got[11] == [("bad.org", "", None, "block")]
    assert got[13][0][:2] == ("b:", "//c/d") and got[14][0][0] == "h.co.uk"
    empty = spark.createDataFrame([], pages.schema), spark.createDataFrame([], labels.schema)
    assert host_reputation.judge_urls(empty[0], labels).count() == 0
    assert {r["verdict"] for r in rows_of(host_reputation.judge_urls(pages, empty[1])) if r["rule"] is None} == {"allow"}


# --- licenses --------------------------------------------------------------

def test_licenses(spark, odd, none):
    notice = "Permission is hereby granted, free of charge, to any person who is obtaining a copy of this software and associated documentation files"
    docs = spark.createDataFrame([(1, notice), (2, "CC BY cc by MIT License the Apache  License"), (3, "of the of the to any"), (4, None), (2, "CC BY cc by MIT License the Apache  License")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in rows_of(license_scan.find_licenses(docs))}
    assert (got[1]["labels"], got[1]["base_labels"], got[1]["n_base"], got[1]["first_word"]) == ("mit", "", 0, None) and 0.8 <= got[1]["score"] < 1
    assert (got[2]["labels"], got[2]["n_base"], got[2]["first_word"], got[2]["last_word"], got[2]["score"]) == ("apache,cc-by,mit", 4, 0, 7, 1.0)
    assert got[3]["labels"] == "" and got[4]["n_words"] == 0
    assert license_scan.find_licenses(odd).count() == odd.count() and license_scan.find_licenses(none).count() == 0


def test_lists_of_licenses(spark):
    texts = {1: "CC BY-NC, CC BY-SA, CC BY-ND", 2: "CC BY-SA, CC BY-NC", 3: "Mozilla Public License Mozilla Public License", 4: "cc by and more by nc",
             5: "GNU General Public License version 2, GNU General Public License version 3"}
    got = {r["doc_id"]: r["labels"] for r in rows_of(license_scan.find_licenses(spark.createDataFrame(list(texts.items()), "doc_id long, text string")))}
    assert got == {1: "cc-by,cc-by-nc,cc-by-nd,cc-by-sa", 2: "cc-by,cc-by-nc,cc-by-sa", 3: "mpl", 4: "cc-by", 5: "gpl,gpl-2.0,gpl-3.0"}


# --- language model --------------------------------------------------------

def test_scores(spark, odd, none):
    docs = spark.createDataFrame([(i, prose(i, 40)) for i in range(120)] + [(None, "x y"), (500, None), (501, ""), (7, prose(7, 40))], "doc_id long, text string")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    counts = Counter()
    for i, t in rows:
        if i is not None and zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(lm_scoring.tokens_of(t))
    total, distinct = sum(counts.values()), len(counts)
    model, tokens = lm_scoring.train(docs)
    small = lm_scoring.Model(model.mixer, dict(list(model.head.items())[:20]), model.total, model.distinct)
    for m in (model, small):  # with and without a tail of rarer tokens
        got = rows_of(lm_scoring.score(docs, m, tokens))
        assert len(got) == len(rows)
        want = sorted((str(i), sum(math.log10((counts[t] + 1) / (total + distinct + 1)) for t in lm_scoring.tokens_of(t))) for i, t in rows)
        have = sorted((str(r["doc_id"]), r["base_score"]) for r in got)
        assert all(a[0] == b[0] and math.isclose(a[1], b[1], rel_tol=1e-9) for a, b in zip(want, have))
        assert all(r["train_tokens"] == total and r["score"] < 0 for r in got)
        own = {r["doc_id"]: r for r in got}
        assert all(own[i]["n_known"] == sum(counts[t] > 0 for t in lm_scoring.tokens_of(x)) for i, x in rows)
    assert lm_scoring.score(odd, model, tokens).count() == odd.count()
    empty, nothing = lm_scoring.train(none)
    assert {r["base_score"] for r in rows_of(lm_scoring.score(docs, empty, nothing))} == {0.0}
    assert lm_scoring.score(none, model, tokens).count() == 0


def test_the_mixture_is_a_distribution_and_learns():
    names = [w.encode() for w in prose(11, 400).split()]
    counts = np.zeros((lm_scoring.PREDICTORS, 1 << lm_scoring.SLOT_BITS, 2), np.float32)
    kinds = np.full(len(names), 3)
    for bit, at in lm_scoring.Decisions(names, kinds):
        for i, slot in enumerate(at):
            np.add.at(counts[i], (slot, bit), 1)
    mixer = lm_scoring.Mixer(counts)
    new = [w.encode() for w in prose(12, 300).split()]
    before = mixer.log10(new, kinds[:300]).sum()
    for _ in range(3):
        mixer.learn(names, kinds)
    assert mixer.log10(new, kinds[:300]).sum() > before
    what = [bytes([b]) for b in range(256) if b != 10]
    first = np.zeros(255)
    for bit, at in lm_scoring.Decisions(what, np.zeros(255, int)):
        place = np.arange(2 * 255) % 2
        p = mixer._mix(*mixer._inputs(at, place), place)[2][::2]
        first += np.log2(np.where(bit[::2], p, 1 - p))
    assert 0.9 < np.exp2(first).sum() <= 1 + 1e-9  # all first bytes but the end


def test_contexts_are_counted_exactly_and_all_tokens_are_learned_from(spark):
    rng = np.random.default_rng(5)
    names = sorted({bytes(rng.integers(97, 123, 8).astype(np.uint8)) for _ in range(40_000)})  # more prefixes than slots
    words = spark.createDataFrame([(bytearray(t), 1, 0, 0, i % 3) for i, t in enumerate(names)], "token binary, n0 long, n1 long, n2 long, n3 long")
    nodes = lm_scoring.count_contexts(words)
    exact, last = Counter(), Counter()
    for i, t in enumerate(names):
        for k in range(9):
            exact[t[:k], (t + b" ")[k]] += 1 + i % 3
            last[t[max(0, k - 1):k], (t + b" ")[k]] += 1 + i % 3
    assert nodes.count() == len(exact) > 1 << 17
    rows = nodes.selectExpr("far[0] a", "far[8] b", "near[8] c").collect()
    before = Counter()
    for (t, _), n in exact.items():
        before[t] += n
    assert Counter((r["a"], r["b"]) for r in rows) == Counter((before[t], n) for (t, _), n in exact.items())
    assert Counter(r["c"] for r in rows) == Counter(last[t[-1:], b] for t, b in exact)
    mixture = lm_scoring.Mixture(words, nodes)
    assert mixture.loss < mixture.losses[0]
    met = lm_scoring._sums(nodes, mixture.weights)[3]
    assert met.sum() == 8 * sum(exact.values())  # every decision of every token


# --- decontamination -------------------------------------------------------

def test_decontamination_against_brute_force(spark, odd, items, none):
    windows = defaultdict(set)
    for r in items.collect():
        words = plain(r["text"])
        n = min(10, len(words))
        for i in range(len(words) - n + 1) if n else ():
            windows[tuple(words[i:i + n])].add(r["item_id"])
    want = []
    for r in odd.collect():
        words, hit, found = plain(r["text"]), set(), set()
        for w, ids in windows.items():
            for i in range(len(words) - len(w) + 1):
                if tuple(words[i:i + len(w)]) == w:
                    hit |= set(range(i, i + len(w)))
                    found |= ids - {None}
        want.append((r["doc_id"], len(words), len(hit), len(found)))
    for most in (0, 1000):  # by shuffle and by broadcast
        got = rows_of(decontaminate.contamination(odd, items, broadcast_windows=most))
        assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"]) for r in got), key=repr) == sorted(want, key=repr)
    assert {x[2] > 0 for x in want} == {True, False}
    kept = decontaminate.remove_contaminated(odd, items)
    assert kept.columns == odd.columns and sorted(map(repr, (r["doc_id"] for r in rows_of(kept)))) == sorted(repr(x[0]) for x in want if not x[2])
    cut = rows_of(decontaminate.contamination(decontaminate.remove_contaminated(odd, items.where("item_id = 1"), remove="spans"), items.where("item_id = 1")))
    assert len(cut) == odd.count() and not any(r["contaminated"] for r in cut)
    assert decontaminate.contamination(none, items).count() == 0
    assert not any(r["contaminated"] for r in rows_of(decontaminate.contamination(odd, items.where("false"))))


# --- pipeline --------------------------------------------------------------

def test_pipeline(spark, sf, none):
    import corpus_pipeline
    docs = c.table(spark, sf, "documents")
    sizes, before = [docs.count()], docs
    for name, stage in corpus_pipeline.STAGES:
        after = c.materialise(stage(spark, before, sf))
        if name != "packing":
            assert after.columns == docs.columns
            sizes.append(after.count())
        if name == "quality_rules":
            kept = {r["doc_id"] for r in rows_of(quality_rules.op8_quality_rules(spark, sf).where("kept"))}
            assert {r["doc_id"] for r in rows_of(after)} == kept
        if name == "ngram_join":
            rows = [(r["doc_id"], r["text"]) for r in before.collect()]
            assert {r["doc_id"] for r in rows_of(after)} == {x[1] for x in brute_classes(rows)}
        if name == "decontaminate":
            assert not any(r["contaminated"] for r in rows_of(decontaminate.contamination(after, c.table(spark, sf, "benchmark"))))
        if name == "packing":
            assert {r["doc_id"] for r in rows_of(after)} == {r["doc_id"] for r in rows_of(before)}
        before = after
    assert sizes == sorted(sizes, reverse=True)
    assert sorted(map(repr, rows_of(corpus_pipeline.run(spark, sf)))) == sorted(map(repr, rows_of(before)))
    empty = none.select(*docs.columns)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0
