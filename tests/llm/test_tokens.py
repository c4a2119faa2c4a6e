import random
import sys
import zlib

import numpy as np
import public_tokenizers
import pyspark
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from helpers import CLASHING, corpus, frame
from tablescope.llm import idcoder, idfile, packing, tokens
from tablescope.llm.tokens import Encoder
from tablescope.session import new_path

WORD_BPE, BYTE_BPE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))


@pytest.mark.parametrize("path", [WORD_BPE, BYTE_BPE])
def test_ids_are_the_librarys(path):
    rng = random.Random(2)
    parts = [" ", "  ", "\n", "\n \n", "a", "bc", "É", "1", ".", ",", "'s", "'", "\t", "\u00a0", "日本", "e\u0301", "Word", "-",
             "😀", "x,\ny|", "q&&", "<|endoftext|>", "İ"]
    texts = ["", " ", "it's I'm"] + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 20))) for _ in range(1500)]
    library = Tokenizer.from_file(path)
    for _ in range(2):  # learned, then remembered
        got = [np.frombuffer(x, "<u4").tolist() for x in Encoder.of(path).encode(texts)]
        assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("path", [WORD_BPE, BYTE_BPE])
def test_cuts_and_letters_are_the_librarys(path, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 40)  # words are forgotten all the time
    rng = random.Random(3)
    spaces = [" ", "  ", "\n", "\n\n", "\n ", " \n", "\t", "\r\n", "\x1c", "\x85", "\u2003", " \t "]
    letters = [chr(c) for c in range(0x250) if chr(c).isalpha()]
    words = ["".join(rng.choices(letters, k=rng.randint(1, 4))) + rng.choice(["", "", ".", "),", "'s", "7", "_"]) for _ in range(400)]
    texts = ["".join(rng.choice(words) + rng.choice(spaces if k % 2 else " \n") for _ in range(rng.randint(1, 15))) for k in range(1500)]
    texts += [t.strip() for t in texts] + [c + c.lower() + c for c in letters] + ["\n" + w for w in words]
    library = Tokenizer.from_file(path)
    encoder = Encoder(path)
    for _ in range(2):
        got = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)]
        assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]


class Counting:
    def __init__(self, library):
        self.library, self.n_chars = library, 0

    def encode(self, text, **options):
        self.n_chars += len(text)
        return self.library.encode(text, **options)


@pytest.mark.parametrize("path", [WORD_BPE, BYTE_BPE])
def test_plain_words_skip_what_the_library_would_not_change(path):
    encoder = Encoder(path)
    encoder.library = counting = Counting(encoder.library)
    text = "\n".join(" ".join(f"{a}{b}{c}{d}é," for d in "ghij") + " end." for a in "abcde" for b in "klmno" for c in "uvwxy")
    got = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode([text])]
    assert counting.n_chars < 20
    assert got == [counting.library.encode(text, add_special_tokens=False).ids]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 5), st.integers(0, 2 ** 18 - 1)), max_size=300), max_size=6))
def test_blocks_come_back(blocks):
    arrays = [np.array(b, np.int32) for b in blocks]
    units = idcoder.encode(arrays)
    assert [x.tolist() for x in idcoder.decode(units, [len(b) for b in blocks])] == blocks
    for a, u in zip(arrays, units):  # a block does not depend on what is coded beside it
        assert idcoder.encode([a]) == [u]


def test_ids_beyond_the_alphabet_are_refused():
    with pytest.raises(ValueError):
        idcoder.encode([np.array([2 ** 18])])


def brute_ids(text, path):
    return np.array(Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids + [2], "<u4")


def test_files_hold_every_document(spark, monkeypatch):
    monkeypatch.setattr(idfile, "RUN_IDS", 500)
    rows = corpus()
    got = idfile.id_report(frame(spark, rows, CLASHING), new_path(spark, "ids"), WORD_BPE).orderBy("start").collect()
    ids = {t: brute_ids(t, WORD_BPE) for _, t in rows}
    expected = sorted(((d, len(ids[t]), zlib.crc32(ids[t].tobytes())) for d, t in rows), key=repr)
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=repr) == expected
    keys = [(-1 if r.doc_id is None else r.doc_id) for r in got]
    assert keys == sorted(keys)
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()


def test_a_changed_block_is_found(spark):
    path, broken = new_path(spark, "ids"), new_path(spark, "broken")
    idfile.write(frame(spark, corpus()[:20]), path, WORD_BPE, 2)
    spark.read.parquet(path).selectExpr(
        "part", "run", "before", "keys", "lengths", "total",
        "transform(blocks, b -> named_struct('n', b.n, 'crc', b.crc + 1, 'units', b.units)) AS blocks").write.parquet(broken)
    with pytest.raises(pyspark.errors.PythonException, match="BrokenBlock"):
        idfile.read(spark, broken).collect()


def test_empty_tables(spark):
    none = frame(spark, [])
    assert idfile.id_report(none, new_path(spark, "ids"), WORD_BPE).collect() == []
    assert packing.packing_report(none, BYTE_BPE).collect() == []


def sequences(rows):
    out = {}
    for r in rows:
        out.setdefault(r.sequence_id, []).append(r)
    for part in out.values():
        part.sort(key=lambda r: r.offset)
        assert [r.offset for r in part] == np.cumsum([0] + [r.length for r in part])[:-1].tolist()
        assert sum(r.length for r in part) <= 1024
    return out


def test_packing_places_every_piece(spark):
    rows = corpus()
    got = packing.packing_report(frame(spark, rows, CLASHING), BYTE_BPE).collect()
    expected = []
    for doc, text in rows:
        ids, start = brute_ids(text, BYTE_BPE), 0
        for k, n in enumerate(packing.cut_lengths(len(ids), 1024)):
            expected.append((doc, k, start, n, zlib.crc32(ids[start:start + n].tobytes())))
            start += n
        assert start == len(ids)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr) == sorted(expected, key=repr)
    total = sum(e[3] for e in expected)
    assert len(sequences(got)) <= -(-total // 1024) + 1


def test_groups_are_packed_apart(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_PIECES", 50)
    rng = random.Random(4)
    sizes = [(i, rng.randint(1, 1024)) for i in range(400)]
    got = packing.packed(spark.createDataFrame(sizes, "doc_id long, length long")).collect()
    assert sorted((r.doc_id, r.length) for r in got) == sizes
    assert len(sequences(got)) <= 1.1 * sum(n for _, n in sizes) / 1024 + 1


def test_pieces_keep_other_columns(spark):
    docs = frame(spark, corpus()[:5], ["ids", "piece", "part", "lang"])
    out = packing.packed(packing.tokenized(docs, BYTE_BPE))
    assert out.columns == ["doc_id", "part", "lang", "piece", "start", "length", "ids", "sequence_id", "offset"]
    assert all(len(r.ids) == 4 * r.length for r in out.collect())


@pytest.mark.parametrize("sizes, bins", [
    ([6, 4, 6, 4], 2),          # fits at once
    ([5, 4, 4, 3, 2, 2], 2),    # longest first leaves three; an exchange of two for one empties one
    ([10], 1), ([], 0), ([7, 7, 7], 3),
])
def test_search(sizes, bins):
    packed = packing.pack(sizes, 10)
    assert len(packed) == bins
    assert sorted(i for b in packed for i in b) == list(range(len(sizes)))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_search_is_never_worse_than_best_fit(sizes):
    bins = packing._Bins(40)
    bins.best_fit(sorted(range(len(sizes)), key=lambda i: -sizes[i]), sizes)
    packed = packing.pack(sizes, 40)
    assert len(packed) <= len(bins.items)
    assert sorted(i for b in packed for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= 40 for b in packed)


def test_a_step_of_the_coder_does_not_go_through_its_blocks_one_by_one():
    """Carries into units already written were made in a loop over the blocks at every step."""
    rng = np.random.default_rng(3)
    blocks = [rng.integers(0, 50_000, 200) for _ in range(1000)]
    ran = [0]

    def count(frame, event, arg):
        if "idcoder" not in frame.f_code.co_filename:
            return None
        ran[0] += event == "line"
        return count

    sys.settrace(count)
    try:
        units = idcoder.encode(blocks)
    finally:
        sys.settrace(None)
    assert ran[0] < 200 * 110 + 1000 * 12
    assert all(np.array_equal(a, b) for a, b in zip(blocks, idcoder.decode(units, [200] * 1000)))
