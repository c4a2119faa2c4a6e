"""A small corpus with every odd case, and plain versions of the operators to compare with."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed=5, n=40):
    """(doc_id, text): prose, copies, near copies, shared passages, nulls, empty texts, repeated rows, a long text."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéiou") for _ in range(rng.randint(2, 7))) for _ in range(900)]

    def prose(k):
        return " ".join(rng.choice(words) for _ in range(k))

    passage = prose(60)
    texts = [prose(rng.randint(1, 120)) for _ in range(n)]
    texts += [prose(30) + "\n" + passage + " " + prose(20) for _ in range(6)]
    texts += [texts[3], texts[3], texts[8], texts[8].replace(" ", "  ", 1), texts[9] + " end"]
    texts += [None, "", " \n\t ", "a", "Ünï " * 40, "same line here\n" * 30, "a" * 5000, prose(6000), passage, "#$% " * 80]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    rows += [rows[2], rows[2], rows[30]]  # repeated rows
    rows += [(None, prose(40)), (None, None), (None, rows[5][1])]
    rng.shuffle(rows)
    return rows


def frame(spark, rows, extra=()):
    """The rows as a frame, with columns whose names the operators use themselves."""
    shape = "doc_id long, text string" + "".join(f", `{c}` string" for c in extra)
    return spark.createDataFrame([(*r, *["x"] * len(extra)) for r in rows], shape)


CLASHING = ["doc", "row", "fp", "rules", "kept", "key", "key2", "number", "group", "shard", "slot", "part", "piece",
            "ids", "sequence_id", "offset", "size", "anchors", "copied", "a.b"]


def by_first(rows, pieces_of):
    """For each row the positions that are covered by a piece which also starts in a row with a smaller id."""
    first = {}
    for doc, text in rows:
        if doc is not None:
            for _, piece in pieces_of(text or ""):
                first[piece] = min(first.get(piece, doc), doc)
    gone = []
    for doc, text in rows:
        covered = set()
        if doc is not None:
            for at, piece in pieces_of(text or ""):
                if first[piece] < doc:
                    covered.update(range(at, at + len(piece)))
        gone.append(covered)
    return gone
