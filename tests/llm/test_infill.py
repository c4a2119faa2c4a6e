import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helpers import CLASHING, corpus, frame
from tablescope.llm import infill
from tablescope.llm.wavelet import WaveletMatrix


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def drawn(doc):
    digest = sha("1:" + ("" if doc is None else str(doc)))
    return [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]


def brute(doc, text):
    text = text or ""
    n, (h1, h2, h3, h4) = len(text), drawn(doc)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(t in text for t in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc, n, "plain", None, None, sha(text), sha(text)
    p, m, s = text[:low], text[low:high], text[high:]
    form = "spm" if h4 % 100 < 20 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return doc, n, form, low, high - low, sha(out), sha(text)


ODD = ["<P> in the text", "a<S", "<<<P", "<M", "\U0001F600" * 50, "é", "é" * 9, "\x00\x01", "<S>", "x<", "\n\n", "日本語" * 400]


def test_matches_brute_force(spark):
    rows = corpus(n=150) + [(1000 + i, t) for i, t in enumerate(ODD * 4)]
    got = sorted((tuple(r) for r in infill.infill_report(frame(spark, rows, CLASHING)).collect()), key=repr)
    expected = [brute(d, t) for d, t in rows]
    assert got == sorted(expected, key=repr)
    assert {e[2] for e in expected} == {"plain", "psm", "spm"}


def units(text, unit):
    """Where each unit begins."""
    if unit == "character":
        return list(range(len(text)))
    if unit == "word":
        return [m.start() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    return [0] + [i + 1 for i, c in enumerate(text) if c == "\n" and i + 1 < len(text)] if text else []


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\té日\U0001F600", max_size=40), max_size=6), st.integers(0, 2 ** 32 - 1), st.integers(0, 2 ** 32 - 1))
def test_cuts_of_all_units(texts, one, two):
    for unit in infill.UNITS:
        got = infill.cut_places([t.encode() for t in texts], np.full(len(texts), one), np.full(len(texts), two), unit)
        for text, row in zip(texts, got.itertuples()):
            begins = units(text, unit)
            assert row.n == len(begins)
            low, high = sorted((one % (len(begins) + 1), two % (len(begins) + 1)))
            for k, at in ((low, row.low_byte), (high, row.high_byte)):
                place = 0 if k == 0 else len(text) if k == len(begins) else begins[k]
                assert at == len(text[:place].encode())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 7), max_size=300))
def test_wavelet_ranks(values):
    matrix = WaveletMatrix(np.array(values, np.uint8), 3)
    at = np.arange(len(values) + 1)
    for v in range(8):
        assert matrix.rank(v, at).tolist() == [values[:i].count(v) for i in at]
    ends = np.full(len(at), len(values))
    found = matrix.locate((1, 2), at, np.zeros(len(at), int), ends)
    assert found.tolist() == [max(i for i in at if sum(x in (1, 2) for x in values[:i]) <= k) for k in at]


def test_columns_parameters_and_restoring(spark):
    rows = corpus(n=60)
    docs = frame(spark, rows, [*CLASHING, "form", "n", "cuts", "draws"])
    for unit in ("word", "line"):
        out = infill.fill_in_middle(docs, seed=7, unit=unit, plain_from=100, spm_below=50, tokens=("[[pre]]", "[[suf]]", "[[mid]]"))
        assert out.columns == [c for c in docs.columns if c not in ("form", "n")] + ["n", "form", "prefix_units", "middle_units"]
        back = out.select("doc_id", infill.restored(F.col("text"), F.col("form"), ("[[pre]]", "[[suf]]", "[[mid]]")).alias("text"), "form")
        got = back.collect()
        assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted(rows, key=repr)
        assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_empty_table_and_no_shuffle(spark):
    assert infill.infill_report(frame(spark, [])).collect() == []
    plan = infill.infill_report(frame(spark, corpus()))._jdf.queryExecution().toString()
    assert "Exchange" not in plan.split("== Physical Plan ==")[1]


def test_long_text_has_its_own_matrix(spark, monkeypatch):
    monkeypatch.setattr(infill, "MATRIX_BYTES", 64)
    texts = ["a" * 10] * 20 + ["é" * 1000, "b"]
    data = [t.encode() for t in texts]
    assert [len(data[i:j]) for i, j in infill._groups(data)] == [6, 6, 6, 2, 1, 1]
