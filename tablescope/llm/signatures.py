"""Bit-sliced Bloom signatures of documents.

Documents are put into blocks of like size. A block is a bit matrix: a column for each
document, a row (slice) for each place of the Bloom filter. A term is entered with the
level of its frequency, so the slices of (term, level), and-ed, give a bitmap of the
documents that may hold the term about so often. A bitmap never misses a document; it
may name too many.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.llm.frames import quoted, text_or_empty

#: Frequencies at which a level begins; the last level is open.
LEVELS = np.array([1, 2, 3, 5, 9, 17], np.int64)
PROBES = 8
BITS_PER_TERM = 24
BLOCK_ROWS = 1_024
#: A block's slices take about this many bytes at most, so that blocks of long texts have fewer rows.
BLOCK_BYTES = 2 << 20
#: Terms (and bytes of them) that a task counts before it hands its counts on.
LEXICON_TERMS, LEXICON_BYTES = 500_000, 32 << 20
_KNOWN_TERMS = 500_000

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of terms as they are (A-Z in lower case), all others as spaces.
_TERM_BYTES = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text, in order."""
    return text.translate(_TERM_BYTES).split()


def term_column(text: Column) -> Column:
    """The same terms by Spark, with a space between each two."""
    return F.translate(F.array_join(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), " "), UPPER, LOWER)


def places(hashes: np.ndarray, levels: np.ndarray, bits: int) -> np.ndarray:
    """(entries, PROBES): the slices of each pair of a term's hash and a level, in a filter of ``bits``."""
    with np.errstate(over="ignore"):
        x = hashes ^ (levels.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        a, b = x >> np.uint64(32), (x & np.uint64(0xFFFFFFFF)) | np.uint64(1)
        return ((a[:, None] + np.arange(PROBES, dtype=np.uint64) * b[:, None]) % np.uint64(bits)).astype(np.int64)


def term_hash(term: bytes) -> int:
    return xxhash.xxh3_64_intdigest(term)


def block_shape(terms: int) -> tuple[int, int]:
    """(bits, rows) of the blocks for documents of ``terms`` distinct terms: bits by powers of two of these."""
    bits = BITS_PER_TERM << max(3, (terms - 1).bit_length())
    return bits, max(8, min(BLOCK_ROWS, BLOCK_BYTES * 8 // bits)) // 8 * 8


class Block:
    """Rows of one size, filled one after the other."""

    def __init__(self, bits: int, rows: int):
        self.bits, self.rows, self.held, self.entries = bits, rows, [], []

    def add(self, row: tuple, hashes: np.ndarray, levels: np.ndarray) -> bool:
        self.held.append(row)
        self.entries.append((hashes, levels))
        return len(self.held) == self.rows

    def record(self) -> dict:
        width = -(-len(self.held) // 8)
        slices = np.zeros((self.bits, width), np.uint8)
        for row, (hashes, levels) in enumerate(self.entries):
            slices[places(hashes, levels, self.bits).ravel(), row >> 3] |= np.uint8(1 << (row & 7))
        ids, one, two, n, top = zip(*self.held)
        return {"rows": len(ids), "terms": sum(n), "bits": self.bits, "ids": ids, "one": one, "two": two, "n": n, "top": top,
                "slices": slices.tobytes()}


BLOCK_FIELDS = ("rows long, terms long, bits int, ids array<long>, one array<long>, two array<long>, "
                "n array<long>, top array<long>, slices binary")
_SCHEMA = f"term string, docs long, {BLOCK_FIELDS}"
_ARROW = pa.schema([
    ("term", pa.string()), ("docs", pa.int64()), ("rows", pa.int64()), ("terms", pa.int64()), ("bits", pa.int32()),
    *[(c, pa.list_(pa.int64())) for c in ("ids", "one", "two", "n", "top")], ("slices", pa.binary())])


class _Task:
    """What one task has read: open blocks by size, and the documents of each term so far."""

    def __init__(self):
        self.open: dict[int, Block] = {}
        self.lexicon: Counter = Counter()
        self.lexicon_bytes = 0
        self.known: dict[bytes, int] = {}

    def add(self, doc: int, one: int, two: int, text: bytes) -> Iterator[pa.RecordBatch]:
        counts = Counter(terms_of(text))
        if not counts:
            return
        before = len(self.lexicon)
        self.lexicon.update(counts.keys())
        self.lexicon_bytes += (len(self.lexicon) - before) * len(text) // max(1, counts.total())
        known, hashes = self.known, []
        if len(known) > _KNOWN_TERMS:
            known.clear()
        for term in counts:
            h = known.get(term)
            if h is None:
                h = term_hash(term)
                if len(term) < 64:
                    known[term] = h
            hashes.append(h)
        tf = np.fromiter(counts.values(), np.int64, len(counts))
        levels = (np.searchsorted(LEVELS, tf, "right") - 1).astype(np.uint8)
        bits, rows = block_shape(len(counts))
        block = self.open.setdefault(bits, Block(bits, rows))
        if block.add((doc, one, two, int(tf.sum()), int(tf.max())), np.array(hashes, np.uint64), levels):
            yield _blocks([self.open.pop(bits)])
        if len(self.lexicon) > LEXICON_TERMS or self.lexicon_bytes > LEXICON_BYTES:
            yield from self.counted()

    def counted(self) -> Iterator[pa.RecordBatch]:
        items = list(self.lexicon.items())
        for i in range(0, len(items), 50_000):
            some = items[i:i + 50_000]
            yield _batch({"term": [t.decode("utf-8", "replace") for t, _ in some], "docs": [n for _, n in some]}, len(some))
        self.lexicon, self.lexicon_bytes = Counter(), 0

    def rest(self) -> Iterator[pa.RecordBatch]:
        for block in self.open.values():
            yield _blocks([block])
        yield from self.counted()


def _batch(columns: dict, rows: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(rows, f.type) for f in _ARROW], schema=_ARROW)


def _blocks(blocks: list[Block]) -> pa.RecordBatch:
    records = [b.record() for b in blocks]
    return _batch({k: [r[k] for r in records] for k in records[0]}, len(records))


def indexed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Blocks of signatures and partial counts of the lexicon, in one table and from one pass over ``docs``.

    A row with ``slices`` is a block: for each of its documents the id, two hashes of the
    text, its number of terms and its highest frequency of a term. A row with ``term`` is the
    number of documents with it in a part of the input. Documents without terms are in neither.
    """
    whole = text_or_empty(text)
    light = docs.select(quoted(key).cast("long").alias("doc"), F.xxhash64(whole).alias("one"),
                        F.xxhash64(F.lit(1), whole).alias("two"), whole.alias("text"))

    def build(batches):
        task = _Task()
        for batch in batches:
            doc, one, two = (batch.column(i).to_pylist() for i in range(3))
            texts = batch.column(3).cast(pa.large_binary())
            for i in range(batch.num_rows):
                yield from task.add(doc[i], one[i], two[i], texts[i].as_py())
        yield from task.rest()

    return light.mapInArrow(build, T._parse_datatype_string(_SCHEMA))


def levels_of(slices: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """(terms, rows): the highest level, from 1, at which each document may hold each term; 0 where it does not."""
    width = slices.shape[1] * 8
    found = np.zeros((len(hashes), width), np.uint8)
    for level in range(len(LEVELS)):
        at = places(hashes, np.full(len(hashes), level), len(slices))
        bitmap = slices[at[:, 0]]
        for probe in range(1, PROBES):
            bitmap = bitmap & slices[at[:, probe]]
        found[np.unpackbits(bitmap, axis=1, bitorder="little").view(bool)] = level + 1
    return found
