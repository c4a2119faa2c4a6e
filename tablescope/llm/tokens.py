"""Token ids of whole texts by the tokenizers library, with a memory of words.

A text is cut at spaces and line ends where the tokenizer's own splitting cuts too, so
ids of the parts, side by side, are the ids of the text; a part met before is looked up.
A new part that is a word of plain letters goes to the library's model, which is all
that the library's other steps would do with it. Which cuts are safe follows from the
tokenizer's settings; with settings not known here, and for texts that hold a special
token's string, whole texts are encoded.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Callable, Iterator

#: Parts, and words, remembered by a worker; of these, half may be forgotten when they were not met for long.
REMEMBERED = 600_000
#: ASCII marks (but the apostrophe), which are split from letters.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Plain Latin letters; no step of the tokenizers but lower case changes them.
_LETTERS = re.compile(r"[A-Za-zÀ-ÖØ-öø-įı-ɏ]+")
#: A space that begins a part, or the place before a line end that is a token of its own.
_SAFE = re.compile(r"(?<!\s) (?=\S)|(?<!\s)(?=\n\S)")
#: In texts without these, a space or line end is one character between two others, if it is inside.
_ODD_SPACES = ["  ", " \n", "\n ", "\n\n", *(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")]


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level models know each byte by."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


_BYTE_LETTERS = _byte_letters()


class _Memory(dict):
    """What ``find`` says of each key; keys not met for long are forgotten."""

    def __init__(self, find: Callable[[str], bytes]):
        self.find = find
        self.older: dict[str, bytes] = {}

    def __missing__(self, key: str) -> bytes:
        found = self.older.get(key)
        if found is None:
            found = self.find(key)
        if len(self) >= REMEMBERED // 2:
            self.older = dict(self)
            self.clear()
        self[key] = found
        return found


class Encoder:
    """Little-endian 32-bit ids of texts; use ``Encoder.of(path)`` to share one in a worker."""

    _shared: dict[str, Encoder] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            settings = json.load(file)
        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.special = [t["content"] for t in settings.get("added_tokens") or []]
        before = settings.get("pre_tokenizer") or {}
        normal = settings.get("normalizer")
        steps = [s["type"] for s in (normal or {}).get("normalizers", [])]
        inner = [s["type"] for s in before.get("pretokenizers", [])]
        #: spaces begin a part / spaces vanish / no safe cut known
        self.rule = None
        if before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and normal is None:
            self.rule = "leading"
        elif inner == ["Split", "ByteLevel"] and steps == ["NFC", "Replace", "Lowercase"] and before["pretokenizers"][0].get("invert"):
            self.rule = "dropped"
        self.first = _Memory(lambda part: self._part("", part))
        self.rest = _Memory(self._after_cut)
        self.words = _Memory(self._word)
        self.marks = _Memory(self._whole)

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._shared:
            cls._shared[path] = cls(path)
        return cls._shared[path]

    def _whole(self, text: str) -> bytes:
        ids = self.library.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, word: str) -> bytes:
        """Of plain letters, already in the tokenizer's case, with no or one space in front."""
        if not (word.isascii() and word.isalpha()):
            word = word.encode().decode("latin-1").translate(_BYTE_LETTERS)
        ids = [t.id for t in self.model.tokenize(word)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _part(self, lead: str, part: str) -> bytes:
        word = part.rstrip(_MARKS)
        if word.isalpha() and (word.isascii() or _LETTERS.fullmatch(word)):
            mark = part[len(word):]
            if self.rule == "dropped":
                word = word.lower()
            ids = self.words[lead + word]
            return ids + self.marks[mark] if mark else ids
        return self._whole(lead + part)

    def _after_cut(self, part: str) -> bytes:
        if self.rule == "dropped":
            return self._part("", part)
        if part.startswith("\n"):  # the cut was before a line end
            return self.marks["\n"] + self._part("", part[1:])
        return self._part(" ", part)

    def _ids(self, text: str) -> bytes:
        if self.rule is None or any(s in text for s in self.special):
            return self._whole(text)
        if self.rule == "dropped":
            return b"".join(map(self.rest.__getitem__, text.replace("\n", " ").split(" ")))
        odd = text[:1].isspace() or text[-1:].isspace() or any(s in text for s in _ODD_SPACES)
        parts = _SAFE.split(text) if odd else text.replace("\n", " \n").split(" ")
        return b"".join([self.first[parts[0]], *map(self.rest.__getitem__, parts[1:])])

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text, in order."""
        return map(self._ids, texts)
