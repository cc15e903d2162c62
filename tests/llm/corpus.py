"""Small awkward tables for the operators, and brute-force versions of them."""

import random

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, n_words long, removed string, id string, start string"


def words(seed, n):
    pick = random.Random(seed)
    return [pick.choice("the of and lorem ipsum dolor sit amet été straße naïve DATA Rows 42 x-ray end.".split())
            + str(pick.randrange(60)) for _ in range(n)]


def prose(seed, n):
    body = words(seed, n)
    lines = [" ".join(body[i:i + 17]) for i in range(0, n, 17)]
    return "\n".join(lines)


def awkward(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, near copies, columns with clashing names."""
    long_ = prose(1, 30_000)
    near = prose(2, 400).split(" ")
    near[200] = "changed"
    texts = [None, "", "   \n\t ", "one", prose(3, 120), prose(3, 120), prose(2, 400), " ".join(near), long_,
             "HELLO " + prose(3, 120), "a\nb\nc\nd\na\nb\nc\nd", "\x00zero\x00", "### *** ||| " * 40, prose(9, 60) + "\n" + prose(2, 400)]
    rows = [(i, t, "en" if i % 3 else None, None if i % 2 else "s", len(t or ""), i, "r", "i", None) for i, t in enumerate(texts)]
    rows += [rows[4], rows[4], (None, prose(3, 120), None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, COLUMNS)


def texts_by_id(frame):
    return [(r["doc_id"], r["text"]) for r in frame.collect()]
