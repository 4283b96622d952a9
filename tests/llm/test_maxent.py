import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import maxent


def _texts(rng, n):
    kinds = [["the", "of", "and", "house", "thing", "THE"], ["le", "de", "maison", "chose", "et"]]
    return [" ".join(rng.choice(kinds[k % 2]) + (str(rng.randrange(9)) if rng.random() < 0.2 else "") for _ in range(rng.randrange(1, 60))) for k in range(n)]


def _base(rows):
    c = Counter()
    for d, t in rows:
        if not maxent.held_out(d):
            c.update([*maxent.tokens(t), maxent.END])
    n, v = sum(c.values()), len(c)
    out = []
    for d, t in rows:
        own = [*maxent.tokens(t), maxent.END]
        out.append((d, maxent.held_out(d), len(own), sum(c[w] > 0 for w in own), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)))
    return out


@pytest.mark.parametrize("head", [1 << 18, 8])
def test_base_and_model(spark, monkeypatch, head):
    monkeypatch.setattr(maxent, "HEAD", head)
    rng = random.Random(1)
    rows = list(enumerate(_texts(rng, 400))) + [(1000, None), (1001, ""), (None, "the of"), (1, "the never2"), (1002, "de " * 30_000)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, score string").repartition(3)
    got = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in maxent.lm_scores(docs).collect()), key=lambda r: (str(r[:4]), r[5]))
    want = sorted(_base(rows), key=lambda r: (str(r[:4]), r[5]))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert all(abs(g[5] - w[5]) < 1e-6 * abs(w[5]) + 1e-9 for g, w in zip(got, want, strict=True))
    if head > 8:
        held = [r for r in maxent.lm_scores(docs).collect() if r["held_out"]]
        assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_probabilities_sum_to_one(spark):
    rng = random.Random(2)
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(_texts(rng, 200))], "doc_id long, text string")
    head = maxent._head(maxent._counted(docs)).open()
    weights, bias = maxent.train(docs, head)
    history = maxent.Batch(["the of house never1 thing3 maison5 chose7 et2"], head)
    shares = np.exp(maxent.log_shares(weights, bias, history.features))
    assert abs(shares.sum(1) - 1).max() < 1e-5
    deep = np.exp(maxent.log_shares(weights, head.deep_bias[history.classes[history.deep]], history.deep_features))
    assert len(deep) and abs(deep.sum(1) - 1).max() < 1e-5
    rest = np.zeros(maxent.CLASSES)
    last = head.leaf == maxent.LEAVES - 1
    np.add.at(rest, head.cls[last], 10 ** head.inside[last])
    unseen = 0.1 / 10**head.scale
    assert (head.inside[~last] == 0).all() and abs(rest + unseen - 1)[maxent.ALONE :].max() < 1e-9
    pairs = list(zip(head.cls[~last].tolist(), head.leaf[~last].tolist(), strict=True))
    assert len(set(pairs)) == len(pairs)


def test_scores_and_steps_equal_the_definition(spark):
    """Softmaxes and an adaptive gradient step, written out token by token."""
    rng = random.Random(4)
    texts = _texts(rng, 60)
    head = maxent._head(maxent._counted(spark.createDataFrame([(t,) for t in texts], "text string"))).open()
    b = maxent.Batch(texts[:5], head)
    weights = np.random.default_rng(1).normal(size=((maxent.KINDS + maxent.DEEP) * maxent.ROWS, maxent.CLASSES)).astype(np.float32) / 9
    bias = np.log(np.arange(1, maxent.CLASSES + 1) / 528).astype(np.float32)
    for tokens, own_bias, features, classes in maxent._steps(b, head, bias):
        got, learner = maxent.log_share(weights, own_bias, features, classes), maxent.Learner(weights)
        total = {}
        for t in range(len(classes)):
            z = (own_bias if own_bias.ndim == 1 else own_bias[t]).astype(float) + sum(weights[f].astype(float) for f in features[:, t])
            share = np.exp(z - np.log(np.exp(z).sum()))
            assert abs(got[t] - math.log(share[classes[t]])) < 1e-4
            g = share - (np.arange(maxent.CLASSES) == classes[t])
            for f in features[:, t].tolist():
                total[f] = total.get(f, 0) + g
        learner.step(own_bias, features, classes)
        assert np.flatnonzero(learner.seen).tolist() == sorted(total)
        for f, g in total.items():
            want = weights[f] - maxent.RATE / math.sqrt(1e-3 + (g**2).sum() / maxent.CLASSES) * g
            assert abs(learner.weights[f] - want).max() < 1e-4
    assert len(b.deep) and set(b.classes[b.deep]) <= set(range(maxent.ALONE, maxent.CLASSES))


def test_a_head_smaller_than_its_first_step(spark, monkeypatch):
    monkeypatch.setattr(maxent, "HEAD", 200)
    docs = spark.createDataFrame([(" ".join(f"w{k}" for k in range(3000)),)] * 3, "text string")
    assert 100 < len(maxent._head(maxent._counted(docs)).words) < 300


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")
    got = maxent.lm_scores(docs).collect()
    assert [(r["n_known"], r["train_tokens"], r["base_score"]) for r in got] == [(0, 0, 0.0)] * 2
    assert maxent.lm_scores(docs.limit(0)).count() == 0


def test_segment_sums():
    rng = np.random.default_rng(0)
    counts = np.r_[rng.integers(1, 60, 200), 1, 1, 500]
    rows = rng.normal(size=(counts.sum(), 3))
    starts = np.cumsum(counts) - counts
    assert np.allclose(maxent.segment_sums(rows, starts, counts), np.add.reduceat(rows, starts, axis=0))


def _zipf(rng, n, vocabulary=900):
    """Texts of words of many classes, some more than once."""
    words = [f"{chr(97 + k % 26)}{k}{chr(97 + k * 7 % 26)}{chr(97 + k // 26 % 3)}" for k in range(vocabulary)]
    texts = [" ".join(words[int(vocabulary * rng.random() ** 2)] for _ in range(rng.randrange(1, 80))) for _ in range(n)]
    return texts + texts[: n // 5] + [texts[0] + " " + texts[1], "", None]


def test_pair_gains_sum_to_one_and_stand_still():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 30, 100)
    starts = np.cumsum(sizes) - sizes
    n, shares = rng.geometric(0.5, sizes.sum()), rng.dirichlet(np.full(60, 0.3), 100)[np.repeat(np.arange(100), sizes), np.arange(sizes.sum()) % 30]
    gain, other = maxent.pair_gains(starts, n, shares, 0.7)
    p = shares * 10**gain
    rest = (1 - np.add.reduceat(shares, starts)) * 10**other
    assert abs(np.add.reduceat(p, starts) + rest - 1).max() < 1e-9
    w = gain - np.repeat(other, sizes)
    gradient = n - 0.7 - p * np.repeat(np.add.reduceat(n, starts), sizes)
    assert (w >= -1e-12).all() and (w > 1e-9).sum() > 900
    whole = np.logical_and.reduceat(w > 1e-9, starts)  # contexts without a weight at zero are solved at once
    assert whole.sum() > 30 and abs(gradient[np.repeat(whole, sizes)]).max() < 1e-6


@pytest.mark.parametrize("rows_at_once", [1 << 19, 50])
def test_pairs_equal_a_count_of_each(spark, monkeypatch, rows_at_once):
    """The pairs' part of the score, written out with dicts over words instead of hashes."""
    monkeypatch.setattr(maxent, "HEAD", 1200)
    monkeypatch.setattr(maxent, "PAIR_FROM", 5)
    monkeypatch.setattr(maxent, "CONTEXT", 60)
    monkeypatch.setattr(maxent, "PAIR_ROWS", rows_at_once)
    rng = random.Random(7)
    rows = list(enumerate(_zipf(rng, 600, 1500)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    learned = [(d, t) for d, t in rows if not maxent.held_out(d)]
    head = maxent._head(maxent._counted(spark.createDataFrame([t for t in learned], "doc_id long, text string"))).open()

    def rest(text):
        own = [maxent.END, maxent.END, *maxent.tokens(text), maxent.END]
        for first, before, word in zip(own, own[1:], own[2:]):
            if 0 <= head.at[before] < 5:
                continue
            k, many = head.at[word], 1 << max(0, math.ceil(math.log2(max(head.counts[head.at[before]] / 60, 1)))) if head.at[before] >= 0 else 1
            before = before, int(maxent.hashes([first])[0, 0]) & (many - 1)
            cls = int(head.cls[k]) if k >= 0 else int(maxent.class_of(maxent.ending_of([word]))[0])
            if cls >= maxent.ALONE and (k < 0 or head.leaf[k] == maxent.LEAVES - 1):
                yield (before, cls), k

    count = {}
    for _, t in learned:
        for c, k in rest(t):
            if k >= 0:
                count.setdefault(c, Counter())[k] += 1
    gains = {}
    for c, own in count.items():
        gain, other = maxent.pair_gains(np.array([0]), np.array(list(own.values())), np.array([10 ** head.inside[k] for k in own]), maxent.DISCOUNT)
        gains[c] = dict(zip(own, gain, strict=True)), other[0]
    want = [sum(gains[c][0].get(k, gains[c][1]) if c in gains else 0.0 for c, k in rest(t)) for _, t in rows]
    numbered = docs.selectExpr("doc_id", "doc_id as uid", "crc32(cast(cast(doc_id as string) as binary)) % 10 = 0 as held_out", "text")
    sent_head, sent = (spark.sparkContext.broadcast(x) for x in (head, (np.zeros(((maxent.KINDS + maxent.DEEP) * maxent.ROWS, maxent.CLASSES), np.float32), np.zeros(maxent.CLASSES, np.float32))))
    schema = "doc_id long, uid long, held_out boolean, n_tokens long, n_known long, base double, score double, h long, g long, context long, word int, n int"
    pairs = numbered.mapInArrow(maxent._score(sent_head, sent), schema).where("context is not null")
    assert pairs.where("word < 0").count() and pairs.where("word >= 0").count() > 3000
    got = {r["uid"]: r["pairs"] for r in maxent.pair_scores(pairs, sent_head).collect()}
    assert all(abs(got.get(d, 0.0) - w) < 1e-6 for (d, _), w in zip(rows, want, strict=True))


def test_texts_that_repeat_score_apart(spark, monkeypatch):
    monkeypatch.setattr(maxent, "PAIR_FROM", 5)
    rng = random.Random(9)
    rows = [(d, t) for d, t in enumerate(_zipf(rng, 400)) if t and len(t.split()) > 20 and not maxent.held_out(d)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    times = Counter(t for _, t in rows)
    by = {r["doc_id"]: (r["score"] - r["base_score"]) / r["n_tokens"] for r in maxent.lm_scores(docs).collect()}
    twice, once = (np.mean([by[d] for d, t in rows if (times[t] > 1) == many]) for many in (True, False))
    assert twice > once + 0.05


def test_every_previous_word_makes_a_context(spark):
    """Also the commonest ones and the start of a text: no token of a last leaf is without a context."""
    texts = _zipf(random.Random(11), 300, 1500)
    head = maxent._head(maxent._counted(spark.createDataFrame([(t,) for t in texts], "text string"))).open()
    b = maxent.Batch([*texts, "never1 never2"], head)
    _, _, word, n = b.pairs(head, maxent.hashes(b.rare)[:, 0])
    assert n.sum() == (b.leaves == maxent.LEAVES - 1).sum() > 2000 and (word < 0).any()


def test_blocks_hold_all_rows(spark, monkeypatch):
    monkeypatch.setattr(maxent, "PACK", 50)
    monkeypatch.setattr(maxent, "SHARD", 100)
    head = maxent._head(maxent._counted(spark.createDataFrame([(t,) for t in _zipf(random.Random(12), 200, 1500)], "text string")))
    shards, _ = maxent._shards(head)
    rng = np.random.default_rng(5)
    n = 700
    rows = {"uid": rng.integers(1 << 33, (1 << 33) + 40, n), "held_out": rng.random(n) < 0.3, "n": rng.integers(1, 400, n)}
    pairs = rows | {"context": rng.integers(-(1 << 62), 1 << 62, 20)[rng.integers(0, 20, n)], "word": rng.integers(-1, 1 << 17, n)}
    names = rows | {"h": rng.integers(-(1 << 62), 1 << 62, 20)[rng.integers(0, 20, n)], "g": rng.integers(-3, 3, n)}
    batches = [pa.RecordBatch.from_pydict({k: v[at : at + 90] for k, v in x.items()}) for x in (pairs, names) for at in range(0, n, 90)]
    found = sorted(((k, d) for b in maxent._pack(batches, head) for k, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)), key=lambda r: r[0])
    got, homes = {"context": Counter(), "h": Counter()}, {}
    for shard, data in found:
        least, *keys, times, uid, held, count = (x.tolist() for x in maxent.unpacked(data)[: 6 if shard < shards else 7])
        keys = [np.repeat(np.array(k, np.uint64), times).view(np.int64).tolist() for k in keys]
        more = [] if shard >= shards else [[a + (b << 16) - 1 for a, b in zip(*(x.tolist() for x in maxent.unpacked(data)[6:]), strict=True)]]
        got["context" if more else "h"].update(zip(*keys, [least[0] + u for u in uid], map(bool, held), count, *more, strict=True))
        assert all(homes.setdefault((bool(more), k), shard) == shard for k in keys[0])
    assert got["context"] == Counter(zip(*(pairs[k].tolist() for k in ("context", "uid", "held_out", "n", "word")), strict=True))
    assert got["h"] == Counter(zip(*(names[k].tolist() for k in ("h", "g", "uid", "held_out", "n")), strict=True))
