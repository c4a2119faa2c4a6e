import hashlib
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from helpers import CLASHING, corpus, frame
from tablescope.llm import lines

BLANK = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_chars=20, min_docs=3):
    """(doc, lines, dropped, kept text) for each row."""
    holders = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            key = line.strip(BLANK).translate(LOWER)
            if len(key) >= min_chars and doc is not None:
                holders[key].add(doc)
    out = []
    for doc, text in rows:
        whole = (text or "").split("\n")
        kept = []
        for line in whole:
            having = holders.get(line.strip(BLANK).translate(LOWER), ())
            if doc is None or len(having) < min_docs or doc == max(having):
                kept.append(line)
        out.append((doc, len(whole), len(whole) - len(kept), "\n".join(kept)))
    return out


def common(n=12):
    """Texts that share lines: by case, by white space, in ids at the end, in one document only, just too short."""
    texts = [f"Own line number {i} of document {i}\n  All RIGHTS of this page reserved\t\nend {i}" for i in range(n)]
    texts += ["all rights of THIS page reserved", "ÄÖÜ  are kept as they are in keys", "äöü  are kept as they are in keys",
              "nineteen characters\n" * 5, "repeated only within one document\n" * 9, "\n\n", "x\n" * 3000 + "All rights of this page reserved",
              None, "", " All rights of this page reserved", "twenty characters !!", "twenty characters !!\r", "Twenty Characters !!\n\n"]
    return texts


def rows_with_odd_ids():
    rows = list(enumerate(common())) + corpus(n=20)
    return rows + [rows[3], rows[3], (None, "All rights of this page reserved"), (None, None), (5, "all rights of this page reserved\nother text")]


def test_matches_brute_force(spark):
    rows = rows_with_odd_ids()
    got = sorted((tuple(r) for r in lines.line_report(frame(spark, rows, CLASHING)).collect()), key=repr)
    expected = [(d, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in brute(rows)]
    assert got == sorted(expected, key=repr)
    assert sum(k for _, _, k, _ in expected) > 10


def test_frequent_and_rare_hashes_meet_by_different_joins(spark, monkeypatch):
    monkeypatch.setattr(lines, "BROADCAST_KEYS", 1)  # only hashes of every dropped line's number are broadcast
    rows = rows_with_odd_ids()
    got = sorted((tuple(r)[:3] for r in lines.line_report(frame(spark, rows)).collect()), key=repr)
    assert got == sorted((r[:3] for r in brute(rows)), key=repr)


def test_other_columns_and_parameters(spark):
    docs = frame(spark, rows_with_odd_ids(), [*CLASHING, "gone", "n_lines", "h1", "last", "line"])
    out = lines.drop_common_lines(docs, min_chars=5, min_docs=2)
    assert out.columns == docs.columns
    expected = [(d, t) for d, _, _, t in brute(rows_with_odd_ids(), 5, 2)]
    got = [(r.doc_id, r.text or "") for r in out.collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert out.where("text IS NULL").count() == docs.where("text IS NULL").count()
    counted = lines.drop_common_lines(docs, counts=True)
    assert counted.columns[-2:] == ["n_lines", "n_dropped"] and counted.columns.count("n_lines") == 1


def test_empty_table(spark):
    assert lines.line_report(frame(spark, [])).collect() == []


def test_plan_is_native_and_broadcasts_only_bounded_hashes(spark):
    docs = frame(spark, rows_with_odd_ids())
    plan = lines.line_report(docs)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("ArrowEval", "BatchEvalPython", "MapInArrow", "MapInPandas", "CartesianProduct"))


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="ab \nÄ", max_size=30), min_size=1, max_size=8))
def test_any_texts(spark, texts):
    rows = list(enumerate(texts))
    out = lines.drop_common_lines(frame(spark, rows), min_chars=2, min_docs=2)
    assert sorted((r.doc_id, r.text) for r in out.collect()) == sorted((d, t) for d, _, _, t in brute(rows, 2, 2))
