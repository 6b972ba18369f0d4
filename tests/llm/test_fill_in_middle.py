import hashlib

import numpy as np
import pytest
from helpers import EXTRA, LONG, docs
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F
from skyrank.llm import boundaries, fill_in_middle as fim

ROWS = ([(i, f"text {i} " + "äß漢𝄞 x" * (i % 7)) for i in range(400)]
        + [(1000, None), (1001, ""), (1002, "a"), (1003, "cut <M> here"), (1004, "<P>"), (1005, "<S"), (1006, "<<P"), (None, "no id"),
           (None, "no id"), (7, "same id"), (8, LONG), (9, "漢" * 70_000), (10, "a漢" * 50_000), (11, "<S" * 50), (12, "<P" * 51), (13, "M>" * 52)])


def expected(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (n, "plain", None, None, text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}")
    return (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_against_slices_of_strings(spark):
    done = fim.fill_in_middle(docs(spark, ROWS, extra=True).withColumn("form", F.lit(1)))
    assert {c for c in EXTRA if c != "n"} <= set(done.columns)
    rows = done.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    got = sorted([(r.doc_id is not None, r.doc_id or 0, r.text or "", r.n, r.form, r.prefix_chars or 0, r.middle_chars or 0, r.output) for r in rows])
    want = sorted([(i is not None, i or 0, t or "", e[0], e[1], e[2] or 0, e[3] or 0, e[4]) for i, t in ROWS for e in [expected(i, t)]])
    assert got == want
    assert {r.form for r in rows} == {"plain", "psm", "spm"}
    assert all(r.back == (r.text or "") for r in rows)
    assert all((r.prefix_chars is None) == (r.form == "plain") for r in rows)


def test_empty_table_and_other_sentinels(spark):
    assert fim.fill_in_middle(docs(spark, [])).count() == 0
    marks = ("[p]", "[s]", "[m]")
    rows = fim.fill_in_middle(docs(spark, [(i, "a <P> b") for i in range(50)]), transformed=100, suffix_first=0, sentinels=marks)
    rows = rows.withColumn("back", fim.restored(F.col("output"), F.col("form"), marks)).collect()
    assert {r.form for r in rows} == {"psm"} and {r.back for r in rows} == {"a <P> b"}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 300_000), st.integers(1, 9000)), max_size=12), st.lists(st.integers(0, 400_000), max_size=50))
def test_select_of_any_set(runs, singles):
    members = np.unique(np.concatenate([np.array(singles, np.int64)] + [np.arange(a, a + n) for a, n in runs]))
    found = boundaries.BoundarySet(members)
    assert found.size == len(members)
    ranks = np.random.default_rng(0).integers(0, max(1, len(members)), 200) if len(members) else np.zeros(0, np.int64)
    assert (found.select(ranks) == members[ranks]).all()


@pytest.mark.parametrize("members,kind", [
    (np.arange(10, 60_000), boundaries.RunContainer), (np.arange(0, 8000, 2), boundaries.ArrayContainer),
    (np.arange(0, 60_000, 3), boundaries.BitmapContainer)])
def test_containers_select(members, kind):
    c = boundaries.container(members)
    assert type(c) is kind
    assert (c.select(np.arange(len(members))) == members).all()
