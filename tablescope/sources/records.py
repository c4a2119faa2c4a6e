"""CSV records whose quoted fields hold line ends, cut by many tasks.

Whether a line begins inside a quoted field depends on everything before it. Each part
of a file is therefore read twice: once to learn how it ends if it begins outside and
if it begins inside such a field, and once, with its beginning known, to cut records.
Only two bits for each part go to the driver; a record that crosses parts is put
together from its pieces.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WHOLE, TAIL, MIDDLE, HEAD = range(4)
_BLANK = b" \t\r\n\x0b\x0c"


def _transitions(separator: str):
    """A function (line, inside) that says whether a quoted field is open after the line."""
    s = re.escape(separator.encode())
    # all fields but the last, then a quote that nothing closes; a quote within a field is none
    opens = re.compile(rb'(?>(?>"(?>[^"]|"")*+"[^' + s + rb']*+|(?!")[^' + s + rb']*+)' + s + rb')*+"(?>[^"]|"")*+\Z', re.S)
    closes = re.compile(rb'(?>[^"]|"")*+"[^' + s + rb']*+(' + s + rb")?", re.S)

    def after(line: bytes, inside: bool) -> bool:
        if b'"' not in line:
            return inside
        at = 0
        if inside:
            closed = closes.match(line)
            if closed is None:
                return True
            if closed[1] is None:
                return False
            at = closed.end()
        return opens.match(line, at) is not None

    return after


def _lines(spark: SparkSession, files: list[str]) -> DataFrame:
    """The lines of ``files`` as bytes, with the file and the first byte of the part they are read in."""
    return spark.read.option("lineSep", "\n").text(files).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.col("value").cast("binary").alias("line"))


def _each(batches):
    """(file, start, line) in the order of the file."""
    for batch in batches:
        yield from zip(*(batch.column(i).to_pylist() for i in range(3)))


def parts_inside(lines: DataFrame, separator: str) -> set[tuple[str, int]]:
    """The parts (file, start) that begin inside a quoted field.

    The driver gets one row for each part, of which it also keeps a task.
    """
    def ends(batches):
        after, part, states = _transitions(separator), None, [False, True]
        for file, start, line in _each(batches):
            if (file, start) != part:
                if part:
                    yield _batch(_ENDS, [(*part, *states)])
                part, states = (file, start), [False, True]
            states = [after(line, s) for s in states]
        if part:
            yield _batch(_ENDS, [(*part, *states)])

    inside, last, now = set(), None, False
    for row in sorted(lines.mapInArrow(ends, "file string, start long, outside boolean, inside boolean").collect()):
        now = now if row["file"] == last else False
        last = row["file"]
        if now:
            inside.add((last, row["start"]))
        now = row["inside"] if now else row["outside"]
    return inside


_ENDS = pa.schema([("file", pa.string()), ("start", pa.int64()), ("outside", pa.bool_()), ("inside", pa.bool_())])
_PIECES = pa.schema([("file", pa.string()), ("start", pa.int64()), ("kind", pa.int32()), ("record", pa.string())])
_BATCH_BYTES = 4 << 20


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def csv_records(spark: SparkSession, files: list[str], separator: str, encoding: str = "UTF-8") -> DataFrame:
    """(record): the text of every record of ``files`` but their headers and blank lines, line ends within fields kept.

    A quote that is never closed makes one record of all that follows it.
    """
    lines = _lines(spark, files)
    inside = parts_inside(lines, separator)
    codec = "utf-8" if encoding == "UTF-8" else encoding

    def cut(batches):
        after, part, is_open, held, kind, header = _transitions(separator), None, False, [], WHOLE, False
        out, size = [], 0

        def piece(k: int) -> None:
            nonlocal size
            whole = b"\n".join(held)
            if k in (WHOLE, TAIL):
                whole = whole.removesuffix(b"\r")
            if k != WHOLE or whole.strip(_BLANK):
                out.append((*part, k, whole.decode(codec, "replace")))
                size += len(whole)

        def finish() -> None:  # what is open at a part's end goes on in the next part
            if held:
                piece(MIDDLE if kind == TAIL else HEAD)

        for file, start, line in _each(batches):
            if (file, start) != part:
                if part:
                    finish()
                part, held = (file, start), []
                is_open = part in inside
                kind, header = TAIL if is_open else WHOLE, start == 0
            if header and not held and line.strip(_BLANK):
                header = False
                continue
            held.append(line)
            is_open = after(line, is_open)
            if not is_open:
                piece(kind)
                held, kind = [], WHOLE
            if size > _BATCH_BYTES:
                yield _batch(_PIECES, out)
                out, size = [], 0
        if part:
            finish()
        if out:
            yield _batch(_PIECES, out)

    pieces = lines.mapInArrow(cut, "file string, start long, kind int, record string")
    whole = pieces.where(F.col("kind") == WHOLE).select("record")
    if not inside:  # then a piece can only be what an unclosed quote leaves at a file's end
        return whole.unionAll(pieces.where(F.col("kind") == HEAD).select("record"))
    # at most two pieces of a part cross its borders
    order = Window.partitionBy("file").orderBy("start", "kind")
    number = F.count_if(F.col("kind") == HEAD).over(order)
    joined = (pieces.where(F.col("kind") != WHOLE).withColumn("number", number).groupBy("file", "number")
              .agg(F.array_sort(F.collect_list(F.struct("start", "kind", "record"))).alias("parts")))
    return whole.unionAll(joined.select(F.array_join("parts.record", "\n").alias("record")))
