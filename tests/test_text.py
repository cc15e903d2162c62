"""Cleaning, chunking and language on hand-written rows."""

import random
import re
import time
from html.parser import HTMLParser

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from dossier.functions import fixed, text as tx
from dossier.functions.markup import html_text
from dossier.operators import chunk, language


def one(spark, value, function):
    row = spark.createDataFrame([(value,)], "t string").select(function(F.col("t")).alias("r")).first()
    return row["r"]


@pytest.mark.parametrize("bad,good", fixed.ENCODING_FIXES)
def test_each_artefact_is_replaced(spark, bad, good):
    assert one(spark, f"a{bad}b", tx.fix_encoding) == f"a{good}b"


@pytest.mark.parametrize("line,kept", [
    ("Page 3 of 9", False), ("page 12", False), ("  PAGE 1 OF 2 ", False), ("Page x", True), ("42", False),
    ("CONFIDENTIAL", False), ("All Rights Reserved.", False), ("all rights reserved", False),
    ("www.example.org here", False), ("WWW.x", True), ("see www.x", True), ("confidential note", True),
])
def test_boilerplate_lines(spark, line, kept):
    assert one(spark, f"first\n{line}\nlast", tx.remove_boilerplate) == (
        f"first\n{line}\nlast" if kept else "first\nlast")


def test_whitespace(spark):
    assert one(spark, "  a\t\tb \r\n\r\n\r\n\r\nc  d   \re ", tx.normalize_whitespace) == "a b\n\nc d\ne"


def test_nfc(spark):
    assert one(spark, "Café", tx.normalize_unicode) == "Café"
    assert one(spark, "plain", tx.normalize_unicode) == "plain"


@pytest.mark.parametrize("html,text", [
    ("<p>a &amp; b</p><script>var x;</script><!-- gone --><b>c</b>", "a & b var x; c"),
    ("<p>one</p> 5 <a and the rest", "one  5 <a and the rest"), ("<script>var a=1; rest", "var a=1; rest"),
    ("<p>x</p> tail AT&T", "x  tail AT&T"), ("a<br>\n<br/>b", "a \n b"), ("&amp;lt;", "&lt;"), ("", ""), (None, None),
])
def test_html_text_keeps_tails(spark, html, text):
    assert one(spark, html, tx.strip_html) == text


class StandardParser(HTMLParser):
    """What the standard library's parser hands over as text."""

    def __init__(self):
        super().__init__()
        self.parts = []

    def handle_data(self, data):
        self.parts.append(data)


def standard_text(page):
    parser = StandardParser()
    parser.feed(page)
    parser.close()
    return " ".join(parser.parts)


@pytest.mark.parametrize("page,text", [
    ("a &middot; b&#8212;c&#x2014;d &copy 5 &notit; &am &#150;", "a \u00b7 b\u2014c\u2014d \u00a9 5 \u00acit; &am \u2013"),
    ("<a title=\"x>y\">link</a> <a title='p>q' b>r</a>", "link   r"), ("<p it's>q</p>", "q"),
    ("<script>var t='</p>'; a<b&amp;c</script><STYLE x='>'>p>a{}</STYLE >z", "var t='</p>'; a<b&amp;c p>a{} z"),
    ("x<!-- a > b -- c -->y<!DOCTYPE html><?php 1 ?><![CDATA[ k ]]>z", "x y z"),
    ("<!-- open <b>x</b> <!-- y", "<!-- open  x  <!-- y"), ("1 < 2 &lt;b&gt; <3", "1 < 2 <b> <3"), ("</ p>a</>b", "a b"),
])
def test_markup_and_references(spark, page, text):
    assert one(spark, page, tx.strip_html) == text


def test_pages_equal_the_standard_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html", tx.strip_html(F.col("html")).alias("text")).collect()
    assert len(pages) == 250
    for row in pages:
        assert row["text"] == standard_text(row["html"])


PIECES = st.sampled_from(["<p>", "</p>", "<br/>", "<a href='x>y'>", '<i a="1" b=">" c>', "<!-- c -->", "<!-- <b> > -->", "<!doctype x>",
                          "<script>if(a<b)'</p>'&amp;</script>", "<style a>q>r</style>", "&amp;", "&copy", "&#233;", "&nosuch;", "&", "é", " ",
                          "text", ">", "\n", "<?x y?>", "</b >", "\x00", "="])


@given(st.lists(PIECES, max_size=12).map("".join))
@settings(max_examples=500, deadline=None)
def test_text_equals_the_standard_parser(page):
    assert html_text(page) == standard_text(page)


@given(st.lists(PIECES | st.sampled_from(["<", "< ", "<1"]), max_size=12).map("".join))
@settings(max_examples=300, deadline=None)
def test_a_bare_bracket_stays_in_its_text_node(page):
    """The standard parser hands it over as a node of its own."""
    assert "".join(html_text(page).split()) == "".join(standard_text(page).split())


@pytest.mark.parametrize("unit", ["<a ", "<!--", "<script>", '<a b="', "<![ ", "</", "<x <!", "&", "<a b=", "<p>"])
def test_open_markup_takes_linear_time(unit):
    assert len(html_text(unit * 100_000)) <= len(unit) * 100_000 + 100_000


@pytest.mark.parametrize("end", ["\r\n", "\n", "\r", "\x0b", "\x0c", "\x1c", "\x85", "\u2028", "\u2029"])
def test_boilerplate_at_any_line_end(spark, end):
    assert one(spark, f"first{end}Page 3 of 9{end}last", tx.remove_boilerplate) == "first\nlast"


@pytest.mark.parametrize("space", [" ", "\t", "\u2003", "\u3000", "\u00a0", "\u2009", "\x1f"])
def test_words_end_at_any_white_space(spark, space):
    assert one(spark, f"{space}a{space}{space}b", tx.words) == ["a", "b"]
    assert one(spark, f"{space}a b{space}", tx.strip) == "a b"


def cleaned(spark, text, method):
    rows = spark.createDataFrame([(text, method)], "extracted_text string, extraction_method string")
    return chunk.clean_text(rows).first()["clean_text"]


def test_ocr_noise_needs_an_ocr_method(spark):
    noisy = "a||||b ____ c.....d"
    assert cleaned(spark, noisy, "tesseract_ocr") == "a b c d"
    assert cleaned(spark, noisy, "markitdown") == "a||||b ____ c.....d"


def test_html_needs_a_fitting_method(spark):
    assert cleaned(spark, "<p>hello</p>", "plain_text_read") == "hello"
    assert cleaned(spark, "<p>hello</p>", "markitdown") == "<p>hello</p>"


def test_empty_input(spark):
    assert cleaned(spark, None, "plain_text_read") == ""
    assert cleaned(spark, "", None) == ""


def words(n, start=0):
    return " ".join(f"w{i}" for i in range(start, start + n))


def sliding(text, size=500, overlap=50, least=20):
    ws = text.split()
    if len(ws) <= size:
        return [text] if ws else []
    out = []
    for at in range(0, len(ws), size - overlap):
        rest = len(ws) - at - (size - overlap)
        end = len(ws) if at + size < len(ws) and rest < least else at + size
        out.append(" ".join(ws[at:end]))
        if end >= len(ws):
            break
    return out


def packed(text, size=500, overlap=50, least=20):
    paragraphs = [p.split() for p in re.split(r"\n\s*\n", text) if p.strip()]
    out, now = [], []

    def tail(ws):
        return ws[max(0, len(ws) - overlap):] if overlap else []

    def close():
        if now:
            out.append(" ".join(now))

    def windows(p):
        starts = [a for a in range(0, len(p), size - overlap) if a == 0 or len(p) - a >= least]
        for a, after in zip(starts, [*starts[1:], None]):
            cut = after is None and len(p) - a - (size - overlap) > 0
            out.append(" ".join(p[a:] if cut else p[a:a + size]))

    for p in paragraphs:
        if 0 < len(now) < least and len(now) + len(p) > size:
            windows(now + p)
            now = tail(now + p)
        elif len(p) > size:
            close()
            windows(p)
            now = tail(p)
        elif len(now) + len(p) > size:
            close()
            now = tail(now) + p
        else:
            now = now + p
    if out and len(now) < least:
        whole = " ".join(w for p in paragraphs for w in p)
        out[-1] = whole[whole.rindex(out[-1]):]
    else:
        close()
    return out


def chunks_of(spark, text, **options):
    rows = spark.createDataFrame(
        [(1, 7, text, "markitdown", "SUCCESS", "en", "KEEP")],
        "id long, file_id long, extracted_text string, extraction_method string, extraction_status string, "
        "language_hint string, phase1_status string")
    return chunk.chunk_documents(rows, **options).orderBy("chunk_index").collect()


@pytest.mark.parametrize("n", [19, 20, 500, 501, 518, 519, 520, 949, 950, 951, 969, 970, 2000])
def test_sliding_sizes(spark, n):
    text = words(n)
    got = chunks_of(spark, text)
    assert [r["clean_text"] for r in got] == (sliding(text) or [text])
    assert all(r["chunk_total"] == len(got) for r in got)
    assert [r["chunk_id"] for r in got] == [f"1_{i}" for i in range(len(got))]


def test_sliding_chunks_cover_every_word(spark):
    text = words(3333)
    seen = [w for r in chunks_of(spark, text) for w in r["clean_text"].split()]
    assert set(seen) == set(text.split())


@pytest.mark.parametrize("sizes", [(300, 300), (480, 1200), (600,) * 3, (5,) * 50, (10, 495, 10), (1,) * 700])
@pytest.mark.parametrize("overlap", [0, 50])
def test_paragraphs(spark, sizes, overlap):
    parts, at = [], 0
    for n in sizes:
        parts.append(words(n, at))
        at += n
    text = "\n\n".join(parts)
    want = (packed(text, 500, overlap) or sliding(text, 500, overlap)) if at > 500 else [text]
    assert [r["clean_text"] for r in chunks_of(spark, text, overlap=overlap)] == want


def test_random_paragraphs(spark):
    rng = random.Random(5)
    rows = [(i, "\n \n".join(words(rng.choice([1, 3, 19, 20, 60, 300, 480, 500, 501, 951]), i)
                             for _ in range(rng.randint(2, 20)))) for i in range(100)]
    got = {}
    frame = spark.createDataFrame(rows, "file_id long, clean_text string")
    for r in chunk.chunk_paragraphs(frame).orderBy("file_id", "chunk_index").collect():
        got.setdefault(r["file_id"], []).append(r["chunk_text"])
    for i, text in rows:
        if len(text.split()) > 500:
            assert got.get(i, []) == packed(text)


def test_placeholder_rows(spark):
    rows = spark.createDataFrame(
        [(1, 1, "  ", "x", "SUCCESS", "", ""), (2, 2, "text", "x", "FAILED", "", ""), (3, 3, "12\n13", "x", "SUCCESS", "", "")],
        "id long, file_id long, extracted_text string, extraction_method string, extraction_status string, "
        "language_hint string, phase1_status string")
    got = {r["file_id"]: (r["chunk_id"], r["clean_status"], r["chunk_total"], r["clean_text"])
           for r in chunk.chunk_documents(rows).collect()}
    assert got == {1: ("1_0", "SKIPPED", 0, ""), 2: ("2_0", "SKIPPED", 0, ""), 3: ("3_0", "FAILED", 0, "")}


def test_whole_text_is_chunked_not_a_prefix(spark):
    text = words(60_000)
    assert chunks_of(spark, text)[-1]["clean_text"].endswith("w59999")


@pytest.mark.parametrize("text,code", [
    ("the cat and the dog went to the house that is on the hill by the sea", "en"),
    ("le chat et la souris sont dans une maison qui est sur la colline des anges", "fr"),
    ("der Hund und die Katze sind nicht auf dem Berg mit den Tieren im Haus", "de"),
    ("short the and of", ""), ("x" * 80, ""),
])
def test_language(spark, text, code):
    assert one(spark, text, tx.detect_language) == code


@pytest.fixture(scope="module")
def labelled(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").cache()


@pytest.fixture(scope="module")
def languages(labelled):
    """Fitted on every second document."""
    return language.fit(labelled.filter("doc_id % 2 = 0"))


def share_right(rows, detect):
    return rows.select(F.avg((detect(F.col("text")) == F.col("lang")).cast("double"))).first()[0]


def test_language_model_on_documents_outside_the_fit(spark, labelled, languages):
    held = labelled.filter("doc_id % 2 = 1")
    detect = language.detector(languages, spark)
    assert share_right(held.filter("length(text) >= 200"), detect) > 0.98
    for size, least in ((200, 0.98), (100, 0.95), (50, 0.9)):  # cuts out of the middle, without most of the punctuation
        cut = held.filter("length(text) >= 400").withColumn("text", F.regexp_replace(F.expr(f"substring(text, 150, {size})"), "[.,;:!?]", "x"))
        right = share_right(cut, detect)
        assert right > least and right >= share_right(cut, tx.detect_language), size


def test_language_model_equals_its_definition(spark, labelled, languages):
    counts = {}
    for r in labelled.filter("doc_id % 2 = 0").collect():
        for word in re.findall(r"[^\W\d_]+", r["text"].lower()):
            for i in range(len(word)):
                key = (r["lang"], f" {word} "[i:i + 3])
                counts[key] = counts.get(key, 0) + 1
    totals = {}
    for (_, gram), n in counts.items():
        totals[gram] = totals.get(gram, 0) + n
    kept = sorted(sorted(totals), key=lambda g: -totals[g])[:language.GRAMS]
    assert languages.grams == sorted(kept) and languages.languages == sorted({lang for lang, _ in counts})
    for j, lang in enumerate(languages.languages):
        n = np.array([counts.get((lang, g), 0) + 1 for g in languages.grams])
        assert np.allclose(languages.logp[:, j], np.log(n / n.sum()))
    assert languages.table(spark).count() == len(languages.grams) * len(languages.languages)


def test_language_of_awkward_texts(spark, languages):
    detect = language.detector(languages, spark)
    for text, code in ((None, ""), ("", ""), ("the and of", ""), ("1234 5678 " * 20, ""), ("\u4e2d" * 80, "")):
        assert one(spark, text, detect) == code
    long_ = "the house and the garden of the king " * 30_000
    assert one(spark, long_, detect) == "en"
    small = language.fit(spark.createDataFrame([("aaa bbb", "x"), ("ccc", None), (None, "y"), ("ddd", "")], "text string, lang string"), grams=2)
    assert small.grams == [" aa", " bb"] and small.languages == ["x"]
    nothing = language.fit(spark.createDataFrame([], "text string, lang string"))
    assert one(spark, "a text of more than fifty characters without any model", language.detector(nothing, spark)) == ""


def test_chunks_take_the_detector(spark, languages):
    rows = spark.createDataFrame([(1, 1, "la casa y el perro en la calle del pueblo donde vive mi hermana " * 3, "markitdown", "SUCCESS", "", "KEEP"),
                                  (2, 2, "the house " * 20, "markitdown", "SUCCESS", "fr", "KEEP")],
                                 "id long, file_id long, extracted_text string, extraction_method string, extraction_status string, "
                                 "language_hint string, phase1_status string")
    got = {r["file_id"]: r["language"] for r in chunk.chunk_documents(rows, detect=language.detector(languages, spark)).collect()}
    assert got == {1: "es", 2: "fr"}


@pytest.mark.parametrize("text,want", [
    ("  short ", "short"), ("a" * 241, "a" * 240 + "…"), ("word " * 60, ("word " * 48).strip() + "…"), (None, "")])
def test_snippet(spark, text, want):
    assert one(spark, text, tx.snippet) == want


def test_reuse_gives_the_first_rows_text_to_all_copies(spark):
    rows = spark.createDataFrame(
        [(1, "h", "a||||b", "markitdown", "REVIEW"), (2, "h", "a||||b", "tesseract_ocr", "KEEP"),
         (3, "error_x", "a||||b", "markitdown", "REVIEW"), (4, None, "c", "markitdown", "REVIEW")],
        "id long, hash string, extracted_text string, extraction_method string, phase1_status string")
    got = {r["id"]: r["clean_text"] for r in chunk.reuse_clean_by_hash(rows).collect()}
    assert got == {1: "a b", 2: "a b", 3: "a||||b", 4: "c"}


def test_long_runs_of_white_space_inside_a_text_take_linear_time(spark):
    run = "　" * 200_000
    row = spark.createDataFrame([(f" a{run}b ", f"a{run}b{run}\nPage 1\r\nc")], "one string, two string")
    begin = time.monotonic()
    got = row.select(
        tx.strip(F.col("one")), tx.normalize_whitespace(tx.remove_boilerplate(F.col("two"))), tx.is_blank(F.col("one"))).first()
    assert tuple(got) == (f"a{run}b", f"a{run}b\nc", False)
    assert time.monotonic() - begin < 15
