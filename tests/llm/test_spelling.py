"""Operator 13 against brute force, on small and awkward tables."""

import random
import re
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

import corpus  # noqa: E402
from dossier.llm import spelling  # noqa: E402

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a, b):
    """Whether one inserted, deleted or replaced code point makes a into b."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long_ = sorted((a, b), key=len)
    return len(long_) == len(short) + 1 and any(long_[:i] + long_[i + 1:] == short for i in range(len(long_)))


def counted(rows):
    """Words by the definition: every occurrence by itself."""
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def related(counts):
    """(word, form, root, n, n_near, form_n) by comparing all words that share a letter deletion."""
    erased = defaultdict(set)
    for w in counts:
        for x in {w, *(w[:i] + w[i + 1:] for i in range(len(w)))}:
            erased[x].add(w)
    out = {}
    for w, n in counts.items():
        near = {v for x in {w, *(w[:i] + w[i + 1:] for i in range(len(w)))} for v in erased[x] if one_edit(w, v)}
        best = min(near, key=lambda v: (-counts[v], v), default=None)
        form = best if best and counts[best] >= 2 * n else None
        out[w] = (form, n, len(near), counts[form] if form else None)
    def root(w):
        while out[w][0]:
            w = out[w][0]
        return w
    return {(w, f, root(w), n, k, m) for w, (f, n, k, m) in out.items()}


def compared(spark, rows):
    got = [tuple(r) for r in spelling.variants(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).select(
        "word", "form", "root", "n", "n_near", "form_n").collect()]
    want = related(counted(rows))
    assert len(got) == len(set(got)) and set(got) == want
    return want


def typo(rng, word, letters):
    i, kind = rng.randrange(len(word)), rng.randrange(3)
    return word[:i] + ("" if kind == 0 else rng.choice(letters)) + word[i + (kind < 2):]


@given(st.lists(st.text(alphabet="abé", min_size=5, max_size=8), min_size=1, max_size=80, unique=True), st.data())
@settings(max_examples=200, deadline=None)
def test_index_answers_as_brute_force_does(words, data):
    counts = {w: data.draw(st.integers(3, 9)) for w in words}
    for length in {len(w) for w in words}:
        index = spelling.PositionIndex([(w, n) for w, n in counts.items() if len(w) == length])
        for query in data.draw(st.permutations(words)):
            bits = index.near(query)
            got = [index.words[i] for i in range(len(index.words)) if bits >> i & 1]
            want = sorted(((w, n) for w, n in counts.items() if len(w) == length and one_edit(query, w)), key=lambda x: (-x[1], x[0]))
            assert got == want


@given(st.text(alphabet="ab", min_size=5, max_size=11), st.text(alphabet="ab", min_size=5, max_size=12))
@settings(max_examples=500, deadline=None)
def test_near_words_share_a_half(a, b):
    if one_edit(a, b):
        for word, other in ((a, b), (b, a)):
            k = spelling.shared_letters(len(word))
            assert word[:k] == other[:k] or word[-k:] == other[-k:]


@pytest.mark.parametrize("block", [1 << 14, 16])
def test_variants_of_a_noisy_corpus(spark, monkeypatch, block):
    monkeypatch.setattr(spelling, "BLOCK", block)
    rng = random.Random(13)
    base = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(5, 10))) for _ in range(60)] + ["commonly", "Réunion", "×÷×÷×"]
    pool = base * 12 + [typo(rng, w, "abcdeéÀ") for w in base for _ in range(12)] * 3
    rows = [(i, " ".join(rng.choice(pool).upper() if rng.random() < 0.1 else rng.choice(pool) for _ in range(120))) for i in range(80)]
    want = compared(spark, rows)
    assert sum(r[1] is not None for r in want) > 20 and any(r[1] is not None and r[2] != r[1] for r in want)


def test_awkward_rows(spark):
    docs = corpus.awkward(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = {tuple(r) for r in spelling.variants(docs).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert got == related(counted(rows)) and got
    assert spelling.variants(docs.filter("false")).collect() == []
    named = docs.select(F.concat(F.lit("k"), F.col("doc_id")).alias("word"), F.col("text").alias("n"))
    assert {r["word"]: r["n"] for r in spelling.variants(named, "word", "n").collect()} == counted(
        [(None if i is None else f"k{i}", t) for i, t in rows])


def test_long_chain_and_long_words(spark):
    chain = ["aaaaa" + "b" * i for i in range(7)]  # each twice as frequent as the one before
    rows = [(i, " ".join([w] * (3 * 2 ** i))) for i, w in enumerate(chain)]
    long_ = "xy" * 3000
    rows += [(50, f"{long_} {long_} {long_} {long_[1:]} {long_[1:]} {long_[1:]}")]
    want = compared(spark, rows)
    assert {r[2] for r in want if r[0].startswith("aaaaa")} == {chain[-1]}
