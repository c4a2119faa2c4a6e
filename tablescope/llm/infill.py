"""Fill-in-middle transformation: cuts located in a wavelet matrix over character classes.

The bytes of a batch of texts get classes by what starts at them: nothing (inside a
code point), a code point, a word, a line, or a line that is a word. Sums of class
ranks count the units before any byte; bisection on these sums finds the byte at which
the wanted unit begins. Python returns counts and byte places only; texts are cut and
joined by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.llm.frames import free_name, quoted, text_or_empty
from tablescope.llm.wavelet import WaveletMatrix

#: Classes of bytes, and those of them that begin a unit.
INSIDE, CHARACTER, WORD, LINE, LINE_AND_WORD = range(5)
CLASS_BITS = 3
UNITS = {"character": (CHARACTER, WORD, LINE, LINE_AND_WORD), "word": (WORD, LINE_AND_WORD), "line": (LINE, LINE_AND_WORD)}
#: Bytes that one matrix holds about; a longer text has one of its own.
MATRIX_BYTES = 4 << 20
PLAIN_FROM, SPM_BELOW = 90, 20
TOKENS = ("<P>", "<S>", "<M>")


def byte_classes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The class of every byte of texts that begin at ``starts`` (places in ``data``)."""
    lead = (data & 0xC0) != 0x80
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    line = np.zeros(len(data), bool)
    line[1:] = data[:-1] == 10
    line[starts] = True
    word = ~blank
    word[1:] &= blank[:-1]
    word[starts] = ~blank[starts]
    classes = lead.astype(np.uint8)
    classes[word & lead] = WORD
    classes[line & lead] = LINE
    classes[line & word & lead] = LINE_AND_WORD
    return classes


def cut_places(texts: list[bytes], first: np.ndarray, second: np.ndarray, unit: str) -> pd.DataFrame:
    """n (units), low and high (units before the cuts) and their bytes for each text.

    The cuts come after ``first % (n + 1)`` and ``second % (n + 1)`` units.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    data = np.frombuffer(b"".join(texts), np.uint8)
    matrix = WaveletMatrix(byte_classes(data, begins[sizes > 0]), CLASS_BITS)
    values = UNITS[unit]
    done = matrix.count(values, begins)
    n = matrix.count(values, ends) - done
    a, b = first % (n + 1), second % (n + 1)
    low, high = np.minimum(a, b), np.maximum(a, b)
    at = [np.where(k == n, ends, matrix.locate(values, done + k, begins, ends)) - begins for k in (low, high)]
    # units need not begin at the first byte: what stands before the first one belongs to it
    at = [np.where(k == 0, 0, x) for k, x in zip((low, high), at)]
    return pd.DataFrame({"n": n, "low": low, "high": high, "low_byte": at[0], "high_byte": at[1]})


def _groups(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    start, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text) > MATRIX_BYTES:
            yield start, i
            start, held = i, 0
        held += len(text)
    if start < len(texts):
        yield start, len(texts)


def cuts(text: Column, first: Column, second: Column, unit: str = "character") -> Column:
    """struct(n, low, high, low_byte, high_byte), all long: the units of ``text`` and two cuts among them."""
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {sorted(UNITS)}")

    @F.pandas_udf("n long, low long, high long, low_byte long, high_byte long")
    def find(texts: pd.Series, one: pd.Series, two: pd.Series) -> pd.DataFrame:
        data = pa.array(texts, pa.large_string()).cast(pa.large_binary()).to_pylist()
        a, b = one.to_numpy(np.int64), two.to_numpy(np.int64)
        parts = [cut_places(data[i:j], a[i:j], b[i:j], unit) for i, j in _groups(data)]
        return pd.concat(parts, ignore_index=True) if parts else cut_places([], a, b, unit)

    return find(text, first, second)


def draws(seed: int, key: Column) -> list[Column]:
    """Four whole numbers under 2^32 from the sha256 of ``seed:key``; a null key counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, seed: int = 1, unit: str = "character", plain_from: int = PLAIN_FROM,
                   spm_below: int = SPM_BELOW, tokens: tuple[str, str, str] = TOKENS,
                   key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with texts as prefix, suffix and middle, and n, form, prefix_units and middle_units.

    The four replace columns of these names. A text is left ``plain`` if it is empty or
    null, holds one of ``tokens``, or its draw says so (``plain_from`` of 100); else ``spm``
    (suffix first) for ``spm_below`` of 100, or ``psm``. Draws depend on ``key`` and ``seed``
    only, so rows of one key and text are cut alike. prefix_units and middle_units are null
    where plain; null texts stay null. No row moves: there is no shuffle.
    """
    made = ("n", "form", "prefix_units", "middle_units")
    docs = docs.select([quoted(c) for c in docs.columns if c.lower() not in made])
    names = [free_name(docs, c) for c in ("draws", "cuts", "bytes")]
    h1, h2, h3, h4 = draws(seed, quoted(key))
    whole = text_or_empty(text)
    both = docs.withColumn(names[0], F.array(h1, h2, h3, h4))
    drawn = [F.col(names[0])[i] for i in range(4)]
    both = both.withColumn(names[1], cuts(whole, drawn[0], drawn[1], unit))
    cut, data = F.col(names[1]), whole.cast("binary")
    low, high = cut["low_byte"].cast("int"), cut["high_byte"].cast("int")
    prefix = F.substring(data, F.lit(1), low).cast("string")
    middle = F.substring(data, low + 1, high - low).cast("string")
    suffix = F.substring(data, high + 1, F.octet_length(whole) - high).cast("string")
    holds = F.lit(False)
    for token in tokens:
        holds = holds | F.contains(whole, F.lit(token))
    form = (F.when((whole == "") | holds | (F.pmod(drawn[2], F.lit(100)) >= plain_from), "plain")
            .when(F.pmod(drawn[3], F.lit(100)) < spm_below, "spm").otherwise("psm"))
    p, s, m = map(F.lit, tokens)
    out = (F.when(F.col("form") == "plain", quoted(text))
           .when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle))
           .otherwise(F.concat(s, suffix, p, prefix, m, middle)))
    cut_up = F.col("form") != "plain"
    return both.withColumn("form", form).select(
        *[out.alias(text) if c == text else quoted(c) for c in docs.columns],
        cut["n"].alias("n"), "form", F.when(cut_up, cut["low"]).alias("prefix_units"),
        F.when(cut_up, cut["high"] - cut["low"]).alias("middle_units"))


def restored(output: Column, form: Column, tokens: tuple[str, str, str] = TOKENS) -> Column:
    """The text that ``fill_in_middle`` made ``output`` of: the tokens are where they first stand."""
    p, s, m = map(F.lit, tokens)

    def parts(first: Column, second: Column) -> tuple[Column, Column, Column]:
        body = F.substring(output, F.char_length(first) + 1, F.char_length(output))
        rest = F.split_part(body, second, F.lit(2))
        return F.split_part(body, second, F.lit(1)), F.split_part(rest, m, F.lit(1)), F.split_part(rest, m, F.lit(2))

    prefix, suffix, middle = parts(p, s)
    of_psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parts(s, p)
    return F.when(form == "plain", output).when(form == "psm", of_psm).otherwise(F.concat(prefix, middle, suffix))


def infill_report(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256 and restored_sha256 for every row; null texts count as empty."""
    done = fill_in_middle(docs.select("doc_id", text_or_empty().alias("text")))
    return done.select(
        "doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"),
        F.sha2("text", 256).alias("output_sha256"), F.sha2(restored(F.col("text"), F.col("form")), 256).alias("restored_sha256"))


def _draw(i: int) -> str:
    return f"CAST('0x' || substr(d, {8 * i + 1}, 8) AS BIGINT)"


ORACLE = f"""
WITH a AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
b AS (SELECT doc_id, t, length(t) AS n, {_draw(0)} AS h1, {_draw(1)} AS h2, {_draw(2)} AS h3, {_draw(3)} AS h4 FROM a),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= {PLAIN_FROM} THEN 'plain'
             WHEN h4 % 100 < {SPM_BELOW} THEN 'spm' ELSE 'psm' END AS form FROM b),
e AS (SELECT *, substring(t, 1, lo) AS p, substring(t, lo + 1, hi - lo) AS m, substring(t, hi + 1) AS s FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(lo AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(hi - lo AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
         ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM e
"""
