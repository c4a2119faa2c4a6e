import csv
import io
import random
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tablescope.sources import load, read_csv
from tablescope.sources.loader import MALFORMED
from tablescope.sources.records import _transitions, csv_records, parts_inside, _lines
from workload import catalog


@pytest.fixture
def small_parts(spark):
    """Files are read in parts of 300 bytes."""
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "300")
    yield
    spark.conf.set(key, before)


def table(n=400, seed=2, wide=900):
    rng = random.Random(seed)
    words = ["plain", "two\nlines", "a,comma", 'a "quote"', '"', "", "\n\n", ",\n,", "Ünï 日本", '5" pipe', "x" * rng.randint(1, wide)]
    return [[str(i), rng.choice(words), rng.choice(words) + "\n" * rng.randint(0, 2) + rng.choice(words), str(i * i)] for i in range(n)]


def written(path, rows, end="\n", separator=",", encoding="utf-8"):
    with open(path, "w", newline="", encoding=encoding) as out:
        csv.writer(out, lineterminator=end, delimiter=separator).writerows([["id", "one", "two", "square"], *rows])
    return str(path)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_records_over_many_parts(spark, tmp_path, small_parts, end):
    rows = table()
    path = written(tmp_path / "t.csv", rows, end)
    assert _lines(spark, [path]).rdd.getNumPartitions() > 50
    assert len(parts_inside(_lines(spark, [path]), ",")) > 20
    got = [next(csv.reader(io.StringIO(r.record, newline=""))) for r in csv_records(spark, [path], ",").collect()]
    assert sorted(got) == sorted(rows)
    back = read_csv(spark, path)
    assert back.columns == ["id", "one", "two", "square", MALFORMED]
    assert sorted([r.id, r.one or "", r.two or "", r.square] for r in back.collect()) == sorted(rows)
    assert back.where(f"{MALFORMED} IS NOT NULL").count() == 0
    assert dict(load(spark, path).dtypes)["square"] == "bigint"


def test_one_field_over_many_parts_and_several_files(spark, tmp_path, small_parts):
    folder = tmp_path / "many.csv"
    folder.mkdir()
    rows = [["1", "long\n" * 500, "b", "1"], ["2", "b", "c", "4"]]
    written(folder / "a.csv", rows)
    written(folder / "b.csv", [[str(int(r[0]) + 1000), *r[1:]] for r in table(60)])
    written(folder / "c.csv", [["3", "سلام", "خط\nدوم", "9"]], separator=";", encoding="windows-1256")
    got = {r.id: (r.one, r.two) for r in read_csv(spark, str(folder)).collect()}
    assert len(got) == 63 and got["1"] == ("long\n" * 500, "b") and got["3"] == ("سلام", "خط\nدوم")


def test_blank_lines_unclosed_quotes_and_wrong_counts(spark, tmp_path, small_parts):
    path = tmp_path / "odd.csv"
    path.write_bytes(b'\n\nid,one\n\n1,"a\nb"\n   \n2,b,c\n3\n4,d"e\n5,"never closed\nand on\n')
    rows = {r.id: (r.one, r[MALFORMED]) for r in read_csv(spark, str(path)).collect()}
    assert rows["1"] == ("a\nb", None) and rows["4"] == ('d"e', None)
    assert rows["2"][1] and rows["3"][1]
    assert len(rows) == 5


def test_very_long_lines_and_very_many_quotes(spark, tmp_path):
    rows = [["1", "x" * 300_000, '"' * 20_000, "1"], ["2", 'a "b" ' * 30_000, "line\nend", "4"]]
    got = sorted(tuple(r)[:4] for r in read_csv(spark, written(tmp_path / "long.csv", rows)).collect())
    assert got == [tuple(r) for r in rows]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.text(alphabet='ab",\n ', max_size=6), min_size=1, max_size=3), min_size=1, max_size=5))
def test_transitions_follow_the_writer(rows):
    """After each line of a written file a field is open exactly if the record goes on."""
    after = _transitions(",")
    for row in rows:
        out = io.StringIO()
        csv.writer(out, lineterminator="\n", quoting=csv.QUOTE_ALL).writerow(row)
        lines, inside = out.getvalue()[:-1].encode().split(b"\n"), False
        for i, line in enumerate(lines):
            inside = after(line, inside)
            assert inside == (i + 1 < len(lines))


def test_no_task_writes_all_documents(spark, tmp_path, small_parts):
    rows = [(i, f"line {i}\n\"two\", and\nthree" * (i % 9), "en", "web", i) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(6).write.parquet(str(tmp_path / "documents.parquet"))
    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(folder.glob("documents-*.csv"))
    got = catalog.csv_lines_in_quotes(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == [(i, t or None, *rest) for i, t, *rest in rows]
    (made,) = set(folder.glob("documents-*.csv")) - before
    assert len(list(made.glob("part-*.csv"))) >= 6
