"""Operator 12 against brute force, on small and awkward tables."""

import random
import re
import sys
from itertools import combinations
from pathlib import Path

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

import corpus  # noqa: E402
from dossier.llm import hamming_join as hj, ngram_join  # noqa: E402

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams_of(text, words):
    found = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if 0 < len(found) < words:
        return frozenset([tuple(found)])
    return frozenset(tuple(found[i:i + words]) for i in range(len(found) - words + 1))


def brute(rows, words, over, under):
    """id -> (size, component); ids are distinct."""
    sets = {i: grams_of(t, words) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, y in combinations(sorted(i for i in sets if sets[i]), 2):
        if under * len(sets[x] & sets[y]) >= over * len(sets[x] | sets[y]):
            a, b = sorted((find(x), find(y)))
            root[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)


def compared(spark, texts, words=4, over=4, under=5):
    got = {r[0]: (r[1], r[2]) for r in hj.near_duplicates(table(spark, texts), words=words, over=over, under=under).collect()}
    assert got == brute(list(enumerate(texts)), words, over, under)
    return got


@given(st.lists(st.integers(0, hj.SYMBOLS - 1), max_size=hj.DISTANCE, unique=True), st.randoms(use_true_random=False))
@settings(max_examples=200, deadline=None)
def test_pairs_within_the_distance_share_a_key(places, rng):
    x = np.array([[rng.randrange(1 << hj.BITS) for _ in range(hj.SYMBOLS)]])
    y = x.copy()
    for p in places:
        y[0, p] ^= rng.randrange(1, 1 << hj.BITS)
    assert set(hj.chunk_keys(x)[0].tolist()) & set(hj.chunk_keys(y)[0].tolist())


def test_keys_are_equal_only_for_equal_chunks():
    x = np.arange(2 * hj.SYMBOLS).reshape(2, hj.SYMBOLS)
    assert not set(hj.chunk_keys(x)[0].tolist()) & set(hj.chunk_keys(x)[1].tolist())
    assert len(set(hj.chunk_keys(x).reshape(-1).tolist())) == 2 * hj.SYMBOLS


def test_distance_follows_similarity():
    rng = np.random.default_rng(5)
    apart = []
    for _ in range(300):
        common, one, two = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (80, 10, 10))
        sets = [np.sort(np.concatenate([common, x])) for x in (one, two)]  # similarity 0.8
        values = hj.signatures(np.concatenate(sets), np.array([90, 90]))
        apart.append(int((values[0] != values[1]).sum()))
    assert 7 < np.mean(apart) < 9 and max(apart) <= hj.DISTANCE


def test_components_of_random_near_copies(spark):
    rng, texts = random.Random(4), []
    for family in range(12):
        base = corpus.words(family, rng.randrange(3, 120))
        for _ in range(rng.randrange(1, 9)):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + len(copy) // 30)):
                copy[rng.randrange(len(copy))] = f"new{rng.randrange(99)}"
            texts.append(" ".join(copy) if rng.random() < 0.8 else " ".join(copy).upper())
    texts += ["", None, "  \n", "one", "one two", "ONE", "one two three", "a b c d", "a b c d e"]
    got = compared(spark, texts)
    assert len({c for _, c in got.values()}) < len(texts) - 8


def test_a_large_group_with_a_chain_and_a_common_passage(spark, monkeypatch):
    """Small groups and blocks, so that salts, tiles and the pairs of different groups all take part."""
    monkeypatch.setattr(hj, "BLOCK", 8)
    monkeypatch.setattr(ngram_join, "GROUP", 600)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(60):  # copies that differ by some words each: many pairs of them do not link
        copy = list(base)
        for _ in range(rng.randrange(0, 4)):
            copy[rng.randrange(60)] = f"x{rng.randrange(1000)}"
        texts.append(" ".join(copy))
    chain = [f"c{i}" for i in range(160)]
    texts += [" ".join(chain[i:i + 80]) for i in range(0, 60, 6)]  # only neighbours link
    texts += [" ".join(base[:25] + [f"own{k}_{i}" for i in range(40)]) for k in range(30)]
    compared(spark, texts, 2)


def test_awkward_rows(spark):
    docs = corpus.awkward(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = brute({i: t for i, t in rows if i is not None}.items(), 5, 4, 5)
    got = hj.near_duplicates(docs).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"doc_id", "n_shingles", "component_id"}
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
    assert sorted((r["component_id"] or -1) for r in got if r["doc_id"] is None) == [-1, 4]
    kept = hj.one_per_component(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert set(ids) == {i for i, c in want.items() if c[1] == i} | {None}
    assert hj.one_per_component(docs.filter("false")).count() == 0


def test_keys_of_other_types_and_names(spark):
    docs = table(spark, [corpus.prose(1, 50), corpus.prose(1, 50) + " more", "x"]).select(
        F.concat(F.lit("k"), F.col("doc_id")).alias("n"), F.col("text").alias("set_key"))
    got = {r["n"]: r["component_id"] for r in hj.near_duplicates(docs, "n", "set_key").collect()}
    assert got == {"k0": "k0", "k1": "k0", "k2": "k2"}


def test_signatures_of_empty_and_long_sets():
    text = " ".join(f"w{i}" for i in range(200_000))
    of, grams = ngram_join.shingle_sets(pa.array(["", text, None, text]), 4)
    values = hj.signatures(grams, np.bincount(of, minlength=4))
    assert (values[1] == values[3]).all() and not values[0].any() and not values[2].any()
