"""Operator 11 against the definition, on small and awkward tables."""

import hashlib
import sys
from pathlib import Path

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

import corpus  # noqa: E402
from dossier.llm import fill_middle  # noqa: E402


def definition(key, text):
    """(n, form, prefix, middle, output) as the rule says, on the whole text."""
    text, n = text or "", len(text or "")
    h = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i:8 * i + 8], 16) for i in range(4))
    if n == 0 or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = min(h1 % (n + 1), h2 % (n + 1)), max(h1 % (n + 1), h2 % (n + 1))
    parts = {"P": text[:a], "M": text[a:b], "S": text[b:]}
    order = "SPM" if h4 % 100 < 20 else "PSM"
    return n, "spm" if order == "SPM" else "psm", a, b - a, "".join(f"<{x}>{parts[x]}" for x in order)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


@pytest.mark.parametrize("chunk", [1, 7, 1 << 13])
def test_every_row_is_cut_and_restored(spark, chunk):
    docs = corpus.awkward(spark)
    marked = spark.createDataFrame(
        [(100 + i, t) for i, t in enumerate(("a <P> b", "<S>", "x<M>", "<P", "a<<", "é<S", "🙂" * 9 + "<", "<<S", ">P>"))],
        "doc_id long, text string")
    if chunk == 1:
        docs = docs.filter("length(text) < 3000 OR text IS NULL")
    docs = docs.unionByName(marked, allowMissingColumns=True)
    got = rows_of(fill_middle.round_trip(docs, chunk=chunk))
    want = []
    for r in docs.collect():
        n, form, a, m, output = definition(r["doc_id"], r["text"])
        want.append((r["doc_id"], n, form, a, m, sha(output), sha(r["text"] or "")))
    assert got == sorted(want, key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_output_texts_are_real(spark):
    docs = corpus.awkward(spark)
    got = rows_of(fill_middle.output_texts(docs, chunk=11))
    want = [(r["doc_id"], *(lambda d: (d[1], d[4]))(definition(r["doc_id"], r["text"]))) for r in docs.collect()]
    assert got == sorted(want, key=repr)


def test_pieces_are_short_and_dealt_by_document(spark):
    docs = corpus.awkward(spark)
    parts = fill_middle.pieces(docs, chunk=100)
    assert parts.agg(F.max(F.length("body"))).first()[0] <= 4 * 100 + 3
    ordered = fill_middle.assembled(parts).withColumn("part", F.spark_partition_id())
    assert ordered.groupBy("row").agg(F.countDistinct("part").alias("n")).filter("n > 1").count() == 0
    plan = fill_middle.round_trip(docs)._jdf.queryExecution().toString()
    plan = plan.split("== Physical Plan ==")[1]
    assert plan.count("Exchange") == 1


def test_an_empty_table_and_other_key_types(spark):
    docs = corpus.awkward(spark)
    assert fill_middle.round_trip(docs.filter("false")).collect() == []
    texts = docs.select(F.concat(F.lit("k"), F.col("doc_id")).alias("name"), F.col("text").alias("body"), "id", "n_words")
    got = rows_of(fill_middle.round_trip(texts, "name", "body"))
    assert [r[6] for r in got] == [sha(r["body"] or "") for r in sorted(texts.collect(), key=lambda r: (
        repr((r["name"], len(r["body"] or ""), *definition(r["name"], r["body"])[1:4],
              sha(definition(r["name"], r["body"])[4]), sha(r["body"] or "")))))]


@given(st.text(alphabet="a<PSM>é", max_size=60), st.integers(0, 300), st.lists(st.integers(1, 5), min_size=1, max_size=8))
@settings(max_examples=300, deadline=None)
def test_marks_are_found_wherever_the_output_is_cut(text, key, sizes):
    n, form, a, m, output = definition(key, text)
    data, splitter, parts, at, i = output.encode(), fill_middle.Splitter(form), {0: b"", 1: b"", 2: b""}, 0, 0
    while at < len(data):
        size = sizes[i % len(sizes)]
        for place, part in splitter.feed(data[at:at + size]):
            parts[place] += part
        at, i = at + size, i + 1
    assert parts[0] + parts[1] + parts[2] == text.encode()
