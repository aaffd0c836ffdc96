"""The compact tables of contexts of the language model."""

import os
import random
from collections import Counter

import numpy as np
import pytest

from riskweave import storage
from riskweave.llm import lm_scoring

SCHEMA = "token binary, n0 long, n1 long, n2 long, n3 long"


def written(path: str) -> int:
    path = path.removeprefix("file://").removeprefix("file:")
    return sum(os.path.getsize(os.path.join(at, name)) for at, _, names in os.walk(path) for name in names)


def test_rare_words_take_little_disk(spark):
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choices("abcdefgh", k=60)) for _ in range(25)) for _ in range(100)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    before = set(storage._made.get(spark.sparkContext.applicationId, []))
    model, tokens = lm_scoring.train(docs)
    assert lm_scoring.score(docs, model, tokens, spelled=True).count() == 100
    made = set(storage._made[spark.sparkContext.applicationId]) - before
    assert sum(map(written, made)) < 8 * sum(map(len, texts))


@pytest.mark.parametrize("block, short", [(1 << 18, 300_000), (50, 300_000), (50, 0)])
def test_scores_of_tokens_by_hand(spark, monkeypatch, block, short):
    """However tokens are cut into blocks, and whether short contexts are sent or joined."""
    rng = np.random.default_rng(8)
    names = sorted({bytes(rng.choice([0x61, 0x62, 0x63, 0x7A, 0x01, 0xC3], rng.integers(1, 9)).astype(np.uint8)) for _ in range(150)} | {b"abcabcabc" * 9, lm_scoring.END})
    n = {t: [int(x) for x in rng.integers(0, 3, 4)] for t in names}
    monkeypatch.setattr(lm_scoring, "BLOCK_BYTES", block)
    words = spark.createDataFrame([(bytearray(t), *n[t]) for t in names], SCHEMA).repartition(3)
    found = lm_scoring.Contexts(words, short)
    assert (found.near is None) == (short == 0) and (found.blocks.count() > 5) == (block == 50)
    mixture = lm_scoring.Mixture(words, found)
    far, near = [Counter() for _ in range(5)], [Counter() for _ in range(3)]
    places = [(t, k, (t if t == lm_scoring.END else t + b" ")) for t in names for k in range(len(t) + (t != lm_scoring.END))]

    def bits(byte):
        return [(k, byte >> (8 - k)) for k in range(9)]

    for t, k, whole in places:
        for at in bits(whole[k]):
            for i, times in enumerate([sum(n[t]), *n[t]]):
                far[i][whole[:k], at] += times
            for i in range(3):
                near[i][(min(k, i + 1), whole[max(0, k - i - 1):k]), at] += sum(n[t])
    want = {t: np.zeros(4) for t in names}
    for t, k, whole in places:
        steps, place = bits(whole[k]), np.array([min(7, k)])
        for a, b in zip(steps, steps[1:]):
            bit = b[1] & 1
            x = [lm_scoring._toward(float(c[key, a]), float(c[key, b])) for i, c in enumerate(near) for key in [(min(k, i + 1), whole[max(0, k - i - 1):k])]]
            x.append(lm_scoring._toward(float(far[0][whole[:k], a]), float(far[0][whole[:k], b])))
            weights = mixture.weights[lm_scoring._gate(np.array([float(far[0][whole[:k], a])]), place)[0]]
            for kind in range(4):
                mixed = np.array([weights @ [*x, lm_scoring._toward(float(far[1 + kind][whole[:k], a]), float(far[1 + kind][whole[:k], b]))]])
                later = mixture.map[lm_scoring._cell(mixed if bit else -mixed, place)]
                want[t][kind] += np.log10(np.clip((lm_scoring._logistic(mixed) + (later if bit else 1 - later)) / 2, 1e-7, 1 - 1e-7))[0]
    got = {bytes(r["token"]): [r[f"p{k}"] for k in range(4)] for r in mixture.log10(found).collect()}
    assert got.keys() == want.keys()
    assert all(np.allclose(got[t], want[t], atol=1e-9) for t in names)
    met = lm_scoring._sums(found.contexts, mixture.weights, found.near)[3]
    assert met.sum() == 8 * sum(sum(n[t]) for t, _, _ in places)
