"""Record cutting against pandas and the csv module, with blocks of a few bytes."""

import csv
import io
import random
import re

import pandas as pd
import pytest

from ticketlake.sources.csv_files import read_rows
from ticketlake.sources.csv_records import _described_lines, csv_records

CELLS = ["", "a", "plain text", 'say "hi"', "two\nlines", "\n\n", "a,b", '"', '""', "x\r\ny", " pad ", "ä😀", '",\n"', "\t"]


@pytest.fixture(params=[23, 64, 1 << 20])
def blocks(spark, request):
    """Input splits of this many bytes."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", request.param)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    yield request.param
    for k, v in before.items():
        spark.conf.set(k, v)


def _random_csv(seed, rows, end="\n", blanks=True):
    rng = random.Random(seed)
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=end)
    writer.writerow(["subject", "body", "language"])
    for i in range(rows):
        if blanks and rng.random() < 0.1:
            out.write(end)
        writer.writerow([f"row {i}", *rng.choices(CELLS, k=2)])
    return out.getvalue()


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_cells_match_pandas(spark, tmp_path, blocks, end):
    path = tmp_path / "a folder+100%" / "t.csv"
    path.parent.mkdir()
    path.write_bytes(_random_csv(blocks, 60, end).encode())
    want = pd.read_csv(path, dtype=str, keep_default_na=False).values.tolist()
    rows = read_rows(spark, str(path)).orderBy("row_index").collect()
    assert [r.row_index for r in rows] == list(range(60))
    assert not any(r._bad_row for r in rows)
    assert [[r.subject, r.body or "", r.language or ""] for r in rows] == want


def test_stray_quotes_do_not_shift_records(spark, tmp_path, blocks):
    pieces = ['5" disk', 'a"', '"ok"', '"x\ny"', '"done"trailing', '"q""q"', "", "plain", 'mid"dle"', '"a\n""b""\n"', '""']
    rng = random.Random(blocks)
    text = "h1,h2\n" + "".join(f"{i},{rng.choice(pieces)},{rng.choice(pieces)}\n" for i in range(120))
    path = tmp_path / "t.csv"
    path.write_text(text)
    want = [r[0] for r in csv.reader(io.StringIO(text, newline=""))]
    cut = csv_records(spark, [str(path)])
    got = [r.record.split(",")[0] for r in cut.records.orderBy("rec").collect()]
    assert got == want
    assert [r.records for r in cut.parts.collect()] == [121]
    assert [r.record for r in cut.headers.collect()] == ["h1,h2"]


def test_several_files_at_once(spark, tmp_path, blocks):
    texts = {}
    for i, n in enumerate([0, 1, 40]):
        texts[f"{i}.csv"] = _random_csv(i, n)
        (tmp_path / f"{i}.csv").write_text(texts[f"{i}.csv"], newline="")
    cut = csv_records(spark, [str(tmp_path)])
    counts = {r.part.rsplit("/", 1)[1]: r.records for r in cut.parts.collect()}
    assert counts == {"0.csv": 1, "1.csv": 2, "2.csv": 41}
    assert cut.records.count() == 44


def test_file_ending_inside_a_cell_is_an_error(spark, tmp_path, blocks):
    path = tmp_path / "t.csv"
    path.write_text('a,b\n1,"open\n2,3\n')
    with pytest.raises(ValueError, match="inside a quoted cell"):
        csv_records(spark, [str(path)])


def test_byte_order_mark_and_missing_last_newline(spark, tmp_path, blocks):
    path = tmp_path / "t.csv"
    path.write_bytes("﻿subject,body\nx,y\nlast,z".encode())
    rows = read_rows(spark, str(path)).orderBy("row_index").collect()
    assert [(r.subject, r.body) for r in rows] == [("x", "y"), ("last", "z")]


def test_parts_with_different_headers_are_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text("subject,body\nx,y\n")
    (tmp_path / "b.csv").write_text("body,subject\nx,y\n")
    with pytest.raises(ValueError, match="header"):
        read_rows(spark, str(tmp_path))


def test_a_long_line_needs_no_recursion(spark, tmp_path):
    cell = '""' * 30000 + "," * 30000
    (tmp_path / "t.csv").write_text(f'a,b\n1,"{cell}"\n2,{"x" * 50000}\n' + "," * 40000 + '"open\nclosed"\n')
    assert csv_records(spark, [str(tmp_path / "t.csv")]).records.count() == 4


def test_lines_are_described_without_a_shuffle(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text(_random_csv(3, 40))
    plan = _described_lines(spark, [str(path)])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
    records = csv_records(spark, [str(path)]).records
    records.collect()
    plan = records._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    # one exchange, of the lines that lie in records with line breaks; blocks are broadcast
    assert plan.count("Exchange hashpartitioning") == 1
    assert re.search(r"Exchange hashpartitioning(?s:.)*(?:THEN in_1#\d+L? ELSE in_0#\d+L? END OR)", plan)
