"""The window network against plain statements of its rules, and against a unigram table on held-out rows."""

import random
from collections import Counter
from math import log

import numpy as np
import pytest
from pyspark.sql import functions as F
from roadloom.llm import masked_lm
from roadloom.llm.common import held_out

SCHEMA = "doc_id long, text string"


def texts(spark, rows, parts=3):
    return spark.createDataFrame(list(enumerate(rows)), SCHEMA).repartition(parts)


def cycles():
    cycle = " ".join(["der hund sieht die katze und"] * 40)
    mixed = cycle.split()
    random.Random(1).shuffle(mixed)
    return cycle, " ".join(mixed)


def zipf(n=60):
    r = random.Random(2)
    words = [f"w{i}" for i in range(3000)]
    return [" ".join(r.choices(words, weights=[1 / (i + 1) for i in range(3000)], k=300)) for _ in range(n)]


def test_prefers_the_corpus(spark):
    cycle, mixed = cycles()
    network = masked_lm.train(texts(spark, [cycle] * 200 + [None, ""]))
    got = {r.doc_id: r for r in masked_lm.score(texts(spark, [cycle, mixed, None, " "]), network).collect()}
    assert got[0].n_tokens == got[1].n_tokens == 240 and got[0].log_likelihood > 2 * got[1].log_likelihood
    assert all((got[i].n_tokens, got[i].log_likelihood, got[i].per_token) == (0, 0.0, None) for i in (2, 3))


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    network = masked_lm.train(none)
    assert masked_lm.score(none, network).count() == 0
    assert masked_lm.score(texts(spark, ["never seen"]), network).first().log_likelihood < 0


@pytest.mark.parametrize("held", [masked_lm.HELD, 100, 0])
def test_sums_the_log_probability_of_every_token(spark, held):
    """Brute force: classes from the counts, windows one by one, a plain forward pass, and each word's share of its class."""
    rows = zipf()
    network = masked_lm.train(texts(spark, rows), held=held)
    counts = Counter(w for t in rows for w in t.split())
    order = sorted(counts, key=lambda w: (-counts[w], w))[: len(network.words)]
    target = {w: 1 + i if i < masked_lm.OWN else None for i, w in enumerate(order)}
    near = {w: 1 + i for i, w in enumerate(order[: masked_lm.NEAR_OWN])}

    def classes(word):
        if word is None:
            return 0, 0, 0
        form = masked_lm.form_of(word)
        return target.get(word) or 1 + masked_lm.OWN + form, near.get(word, 1 + masked_lm.NEAR_OWN + form % 32), 1 + form % 3

    in_form = Counter()
    for w, n in counts.items():
        in_form[classes(w)[0]] += n
    e1, e2, e3, e4, w1, b1, w2, b2 = network.params

    def plain(text):
        words, total = [None, None, *(text or "").split(), None, None], 0.0
        for i in range(2, len(words) - 2):
            x = np.concatenate([e1[classes(words[i - 1])[1]], e2[classes(words[i + 1])[1]], e3[classes(words[i - 2])[2]], e4[classes(words[i + 2])[2]]])
            z = np.tanh(x @ w1 + b1) @ w2 + b2
            own = classes(words[i])[0]
            total += z[own] - log(np.exp(z[1:]).sum())
            if own > masked_lm.OWN:
                total += log(max(counts[words[i]], 1) / (in_form[own] + 1))
        return total

    test = [rows[0], rows[0], "w2999 never seen", "w1 w5 w700", "w3", None]
    got = {r.doc_id: r.log_likelihood for r in masked_lm.score(texts(spark, test), network).collect()}
    assert all(got[i] == pytest.approx(plain(t), rel=1e-5) for i, t in enumerate(test))


def test_words_add_up_to_one(spark):
    rows = zipf(20)
    network = masked_lm.train(texts(spark, rows))
    counts = Counter(w for t in rows for w in t.split())
    for before, after in ((["w1", "w2"], ["w3", "w4"]), ([], ["w9"]), (["new"], [])):
        at = len(before)
        total = sum(np.exp(_at(network, [*before, w, *after], at)) for w in counts)
        # what is left is a token for the unseen words of each form
        classes = network.log_probabilities.reshape(-1, masked_lm.TARGETS)[network.cells(network.indexes([*before, "w1", *after]))[at] // masked_lm.TARGETS]
        unseen = sum(np.exp(classes[1 + masked_lm.OWN + f]) / (network.tokens[f] + 1) for f in range(masked_lm.FORMS))
        unused = sum(np.exp(classes[1 + i]) for i in range(len(network.words), masked_lm.OWN))
        assert total + unseen + unused == pytest.approx(1, abs=1e-4)


def _at(network, tokens, at):
    indexes = network.indexes(tokens)
    return network.log_probabilities[network.cells(indexes)[at]] + network.rates[indexes[at]]


def test_same_scores_on_any_partitions(spark, monkeypatch):
    monkeypatch.setattr(masked_lm, "FAN", 3)
    rows, found = zipf(40), []
    for parts in (1, 4, 16):
        docs = texts(spark, rows, parts)
        found.append({r.doc_id: r.log_likelihood for r in masked_lm.score(docs, masked_lm.train(docs)).collect()})
    assert found[0] == pytest.approx(found[1], rel=1e-9) and found[0] == pytest.approx(found[2], rel=1e-9)


def test_slopes_by_differences():
    r = np.random.default_rng(3)
    context, counts = np.array([5, 70_00, 65_535]), r.integers(0, 4, (3, masked_lm.TARGETS)).astype(np.float64)
    counts[:, 0] = 0
    params = [p.astype(np.float64) for p in masked_lm.initial(counts.sum(axis=0))]

    def loss():
        logp = masked_lm._forward(params, context)[0][:, 1:]
        return -(logp * counts[:, 1:]).sum() / counts.sum()

    for p, slope in zip(params, masked_lm.slopes(params, context, counts), strict=True):
        for _ in range(4):
            at = tuple(r.integers(0, n) for n in p.shape)
            before = p[at]
            p[at] = before + 1e-5
            more = loss()
            p[at] = before - 1e-5
            less = loss()
            p[at] = before
            assert slope[at] == pytest.approx((more - less) / 2e-5, abs=1e-6)


def test_better_than_unigrams_on_held_out_documents(spark):
    """Both give the same words the same share of their class, so the classes' part decides."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    apart = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    network = masked_lm.train(docs.where(~apart))
    totals = np.zeros(masked_lm.TARGETS)
    for r in docs.where(~apart).collect():
        totals += np.bincount(network.cells(network.indexes(masked_lm.tokens_of(r.text))) % masked_lm.TARGETS, minlength=masked_lm.TARGETS)
    unigram = np.log((totals + 1) / (totals + 1).sum())
    own = plain = n = 0.0
    for r in docs.where(apart).collect():
        cells = network.cells(network.indexes(masked_lm.tokens_of(r.text)))
        own, plain, n = own + network.log_probabilities[cells].sum(dtype=float), plain + unigram[cells % masked_lm.TARGETS].sum(), n + len(cells)
    print(f"nats a token: network {own / n:.3f}, unigrams {plain / n:.3f}")
    assert own / n > plain / n + 0.2


def test_awkward_rows(spark):
    long = " ".join(f"w{i % 977}" for i in range(1_000_000))
    rows = [(1, long, "x", "y"), (1, long, "x", "y"), (None, "a b", None, None), (2, None, "x", "y"), (3, "", "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, _k1 string")
    got = masked_lm.score(docs.drop("_k1"), masked_lm.train(docs)).collect()
    assert sorted(r.n_tokens for r in got) == [0, 0, 2, 1_000_000, 1_000_000]
    assert len({r.log_likelihood for r in got if r.doc_id == 1}) == 1
    assert held_out(F.lit(1)) is not None


def test_the_words_that_tasks_hold_change_no_score(spark):
    rows = zipf(20)
    want = {r.doc_id: r.log_likelihood for r in masked_lm.score(texts(spark, rows), masked_lm.train(texts(spark, rows))).collect()}
    for held in (0, 50, 500):
        network = masked_lm.train(texts(spark, rows), held=held)
        assert len(network.words) >= masked_lm.OWN
        got = {r.doc_id: r.log_likelihood for r in masked_lm.score(texts(spark, rows), network).collect()}
        assert all(abs(got[i] - want[i]) < 1e-8 * abs(want[i]) for i in want)
