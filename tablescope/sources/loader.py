"""CSV with unknown dialect, and Parquet."""

from __future__ import annotations

import csv
import re
from collections import defaultdict
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope import fixed_values as fv
from tablescope.operators.distinct import quoted
from tablescope.sources.records import csv_records

SEPARATORS = (",", ";", "\t", "|")
# A field that begins with a quote which its line does not close; a quote inside a field is none.
_OPEN_FIELD = r'(?:^|[,;\t|])"[^"]*+(?:""[^"]*+)*+$'
# A pattern of that kind goes one call deeper for each doubled quote, so lines with more quotes
# count as open unseen. Such files are read by csv_records, which is right for closed fields too.
_MOST_QUOTES = 1000
MALFORMED = "__malformed"
_WHOLE = r"^[-+]?\d{1,18}$"
_REAL = r"^[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?$"
_BOOLEANS = ("True", "TRUE", "true", "False", "FALSE", "false")


# --- dialects ---------------------------------------------------------------

def _dialects(spark: SparkSession, path):
    """Files of one dialect and header: are they UTF-8, how often each separator occurs, the header line.

    Files are grouped where they are read; the driver sees one row for each group.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"),
        F.struct("_metadata.file_block_start", F.monotonically_increasing_id()).alias("place")
    ).filter(F.trim("value") != "")
    # Separators inside quotes do not count.
    bare = F.regexp_replace("value", '"[^"]*"', "")
    counted = lines.select(
        "*", *[(F.length(bare) - F.length(F.replace(bare, F.lit(s), F.lit("")))).alias(f"s{i}")
               for i, s in enumerate(SEPARATORS)],
        ((F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit(""))) > _MOST_QUOTES)
         | F.col("value").rlike(_OPEN_FIELD)).alias("open"))
    files = counted.groupBy("file").agg(
        F.bool_and(F.is_valid_utf8("value")).alias("utf8"),
        F.bool_or("open").alias("multiline"),
        F.min_by(F.col("value").cast("binary"), "place").alias("header"),
        F.min_by(F.struct(*[f"s{i}" for i in range(len(SEPARATORS))]), "place").alias("first"),
        *[F.min(f"s{i}").alias(f"min{i}") for i in range(len(SEPARATORS))],
        *[F.max(f"s{i}").alias(f"max{i}") for i in range(len(SEPARATORS))])
    alike = [c for c in files.columns if c != "file"]
    return files.groupBy(*alike).agg(F.collect_list("file").alias("files")).collect()


def _separator(row) -> str:
    """The separator no line has more of than the header; best the same in every line."""
    fitting = [(row[f"min{i}"] == row["first"][i], row["first"][i], -i, s)
               for i, s in enumerate(SEPARATORS)
               if row["first"][i] > 0 and (row[f"max{i}"] <= row["first"][i] or row["multiline"])]
    if not fitting:  # some line has more: rows are then counted as malformed, not cut
        fitting = [(True, row["first"][i], -i, s) for i, s in enumerate(SEPARATORS) if row["first"][i] > 0]
    return max(fitting)[3] if fitting else SEPARATORS[-1]


def _header_names(header: bytes, encoding: str, separator: str) -> tuple[str, ...]:
    text = header.decode("utf-8-sig" if encoding == "UTF-8" else encoding)
    names, seen = [], {}
    for i, name in enumerate(next(csv.reader([text], delimiter=separator))):
        name = name or f"Unnamed: {i}"
        seen[name] = seen.get(name, -1) + 1
        names.append(f"{name}.{seen[name]}" if seen[name] else name)
    return tuple(names)


def read_csv(spark: SparkSession, path, legacy_encoding: str = "windows-1256") -> DataFrame:
    """All columns as text, and MALFORMED: the whole line where it has more or fewer fields than the header.

    Files of one folder may differ in encoding, separator and header; they are
    combined by column name.
    """
    groups = defaultdict(list)
    for row in _dialects(spark, path):
        separator = _separator(row)
        encoding = "UTF-8" if row.utf8 else legacy_encoding
        names = _header_names(bytes(row.header), encoding, separator)
        groups[encoding, separator, row.multiline, names].extend(row.files)
    if not groups:
        raise ValueError(fv.ERRORS["no_rows"])
    out = None
    for (encoding, separator, multiline, names), files in sorted(groups.items()):
        schema = T.StructType([T.StructField(n, T.StringType()) for n in (*names, MALFORMED)])
        options = {"sep": separator, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": MALFORMED}
        if multiline:
            ddl = ", ".join("`" + n.replace("`", "``") + "` string" for n in schema.names)
            part = csv_records(spark, files, separator, encoding).select(F.from_csv("record", ddl, options).alias("row")).select("row.*")
        else:
            if encoding != "UTF-8":
                # Spark refuses charsets outside its short list without this, also when the rows
                # are read later, so it stays on.
                spark.conf.set("spark.sql.legacy.javaCharsets", "true")
            part = spark.read.csv(files, header=True, encoding=encoding, schema=schema, **options)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


# --- after reading ----------------------------------------------------------

def _missing_to_null(df: DataFrame) -> DataFrame:
    """NA spellings and NaN become NULL."""
    def fix(field):
        col = quoted(field.name)
        if isinstance(field.dataType, T.StringType):
            col = F.when(~col.isin(list(fv.NA_TOKENS)), col)
        elif isinstance(field.dataType, (T.FloatType, T.DoubleType)):
            col = F.nanvl(col, F.lit(None).cast(field.dataType))
        return col.alias(field.name)
    return df.select(*[fix(f) for f in df.schema.fields])


def prepare_loaded(df: DataFrame, typed: bool = False, typos=None, malformed: str = "raise") -> DataFrame:
    """Drop columns and rows without any value; repair known misspellings.

    With ``typed``, text columns that hold nothing but plain numbers or booleans
    get that type. All of it is decided by one aggregation, which also counts the
    malformed rows: ``malformed`` says whether they ``raise`` or are left out (``drop``).
    """
    if not df.columns:
        raise ValueError(fv.ERRORS["no_rows"])
    marked = MALFORMED in df.columns
    if marked and malformed == "drop":
        # Parsed once more, whole: the mark is known only when all fields are read.
        df = df.filter(quoted(MALFORMED).isNull())
    df = _missing_to_null(df)
    exprs = [F.count("*").alias("rows")]
    for i, field in enumerate(df.schema.fields):
        col = quoted(field.name)
        exprs.append(F.count(col).alias(f"n{i}"))
        if typed and isinstance(field.dataType, T.StringType):
            bare = F.trim(col)
            exprs += [F.count(F.when(bare.rlike(_WHOLE), 1)).alias(f"whole{i}"),
                      F.count(F.when(bare.rlike(_REAL), 1)).alias(f"real{i}"),
                      F.count(F.when(col.isin(*_BOOLEANS), 1)).alias(f"bool{i}")]
    row = df.agg(*exprs).first().asDict()
    if not row["rows"]:
        raise ValueError(fv.ERRORS["no_rows"])
    bad = row[f"n{df.columns.index(MALFORMED)}"] if marked else 0
    if bad and malformed == "raise":
        raise ValueError(f"{bad} rows have more or fewer fields than the header")
    kept = []
    for i, field in enumerate(df.schema.fields):
        n = row[f"n{i}"]
        if not n or field.name == MALFORMED:
            continue
        col = quoted(field.name)
        if row.get(f"whole{i}") == n:
            col = F.trim(col).cast("bigint")
        elif row.get(f"real{i}") == n:
            col = F.trim(col).cast("double")
        elif row.get(f"bool{i}") == n:
            col = col.cast("boolean")
        kept.append(col.alias(field.name))
    if not kept:
        raise ValueError(fv.ERRORS["no_usable_rows"])
    df = df.select(*kept)
    df = df.filter(reduce(lambda a, b: a | b, [quoted(c).isNotNull() for c in df.columns]))
    types = dict(df.dtypes)
    for name, repairs in (fv.COLUMN_TYPOS if typos is None else typos).items():
        if types.get(name) == "string":
            df = df.replace(repairs, subset=[f"`{name}`"])
    return df


def _extension(path) -> str:
    """The one extension of all paths, empty if they differ."""
    paths = [path] if isinstance(path, str) else path
    found = {m[1] if (m := re.search(r"\.([a-z0-9]+)$", str(p).strip().lower().rstrip("/"))) else "" for p in paths}
    return found.pop() if len(found) == 1 else ""


def load(spark: SparkSession, path, typos=None, malformed: str = "raise") -> DataFrame:
    """Read a CSV or Parquet file, folder or list of files, by its extension.

    CSV rows with more or fewer fields than the header are an error, or are left out
    with ``malformed="drop"``; ``read_csv`` shows them.
    """
    kind = _extension(path)
    if kind == "csv":
        return prepare_loaded(read_csv(spark, path), typed=True, typos=typos, malformed=malformed)
    if kind == "parquet":
        paths = [path] if isinstance(path, str) else list(path)
        return prepare_loaded(spark.read.parquet(*paths), typos=typos)
    raise ValueError(fv.ERRORS["format"])


load_file = load
