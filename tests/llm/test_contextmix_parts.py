"""op3: which words are sent and which are joined, and what its weights are learnt from."""

import math
import random

import numpy as np

from collatio.llm import contextmix

SMALL = {"cells": (10, 12, 12), "classes": 2, "seeds": 30, "sample": 300}


def corpus(n=80):
    rng = random.Random(11)
    return [(i, " ".join([*rng.choices([f"w{j}" for j in range(40)], k=100), *(f"r{rng.randrange(10**6)}" for _ in range(8))])) for i in range(n)]


def test_only_rare_words_are_joined(spark, monkeypatch):
    """Beyond the bound, the frequent words' costs are still sent: a token of theirs is no row of a join."""
    df = spark.createDataFrame(corpus(), "doc_id long, text string")
    whole = {r.doc_id: r for r in contextmix.score(df, settings=contextmix.Settings(**SMALL)).collect()}
    tables, stored = [], contextmix.stored
    monkeypatch.setattr(contextmix, "stored", lambda d: tables.append(stored(d)) or tables[-1])
    got = {r.doc_id: r for r in contextmix.score(df, settings=contextmix.Settings(**SMALL, broadcast_words=60)).collect()}
    for i, r in whole.items():
        assert math.isclose(got[i].score, r.score, rel_tol=1e-9) and math.isclose(got[i].base_score, r.base_score, rel_tol=1e-9)
        assert (got[i].n_known, got[i].n_tokens) == (r.n_known, r.n_tokens)
    joined = sum(sum(r.times) for t in tables if "times" in t.columns for r in t.select("times").collect())
    assert 80 * 7 < joined <= 80 * 8


def test_weights_and_classes_learn_from_all(spark, monkeypatch):
    """A sample of hardly any tokens and texts still leaves weights, map and classes to all of them."""
    df = spark.createDataFrame([(i, t) for i, t in corpus(200)], "doc_id long, text string")
    held = {}
    fit, learn = contextmix.fit_classes, contextmix.learn

    def first_fit(*a):
        held["classes"] = fit(*a)
        held["logs"] = held["classes"].logs.copy()
        return held["classes"]

    def first_learn(*a):
        held["mixer"] = learn(*a)
        held["weights"], held["map"] = held["mixer"].weights.copy(), held["mixer"].map.copy()
        return held["mixer"]

    monkeypatch.setattr(contextmix, "fit_classes", first_fit)
    monkeypatch.setattr(contextmix, "learn", first_learn)
    s = contextmix.Settings(**(SMALL | {"sample": 10, "seeds": 3}))
    got = contextmix.score(df, settings=s).collect()
    assert sum(r.n_tokens for r in got if not r.held_out) == got[0].train_tokens
    for now, first in ((held["mixer"].weights, held["weights"]), (held["mixer"].map, held["map"])):
        assert (np.abs(now - first) > 1e-3).any(axis=1).sum() >= 8  # gates
    # all buckets that the corpus uses are known to the classes, not only those of three texts
    assert (np.abs(held["classes"].logs - held["logs"]) > 1e-6).any(axis=0).mean() > 0.9


def test_sums_over_all_tokens():
    """The slope is the derivative of the coding cost of all tokens, each with its own count taken out."""
    rng = np.random.default_rng(2)
    s = contextmix.Settings(**SMALL)
    words = sorted({bytes(rng.integers(97, 100, rng.integers(1, 6)).astype(np.uint8)) + b" " for _ in range(60)} | {contextmix.END})
    counts = rng.integers(0, 4, (len(words), 2)).astype(float)
    table = contextmix.Ordered(words, counts, contextmix.Edge.none(2))
    tenths = rng.integers(-20, 20, sum(1 << b for b in s.cells)).astype(np.int8)
    weights = rng.normal(0.3, 0.1, (contextmix.GATES, contextmix.INPUTS)).astype(np.float32)
    mixer = contextmix.Mixer(tenths, weights, np.tile(np.linspace(0, contextmix.CLIP, contextmix.KNOTS + 1, dtype=np.float32), (contextmix.GATES, 1)))
    got = contextmix.whole_sums(table, mixer, s)
    at, k = np.nonzero(counts > 0)
    one = contextmix.sample_of(table, tenths, at, k, s)
    gate = contextmix.gate_of(one.own, one.total, one.own_k, one.total_k)
    x = np.concatenate([one.odds * np.float32(0.1), contextmix.odds_of(one.own, one.total)[None], contextmix.odds_of(one.own_k, one.total_k)[None]])
    times = np.repeat(counts[at, k], one.size)
    miss = 1 / (1 + np.exp(np.clip((weights[gate].T * x).sum(axis=0), -contextmix.CLIP, contextmix.CLIP)))
    want = np.stack([np.bincount(gate, times * miss * row, contextmix.GATES) for row in x], axis=1)
    assert np.allclose(got[:, : contextmix.INPUTS], want, rtol=1e-3, atol=1e-3)
    knots = contextmix.INPUTS + contextmix.INPUTS**2
    assert np.isclose(got[:, knots : knots + contextmix.KNOTS + 1].sum(), times.sum())
