import csv
import os

import pytest
from pyspark.sql import functions as F

from ticketlake.operators import canonical as canon
from ticketlake.operators.dedup import dedup_by_version
from ticketlake.sources import csv_files, tables

V3 = "dataset-tickets-multi-lang3-4k.csv"
V4 = "dataset-tickets-multi-lang-4-20k.csv"
V5 = "aa_dataset-tickets-multi-lang-5-2-50-version.csv"
DE = "dataset-tickets-german_normalized.csv"
DE2 = "dataset-tickets-german_normalized_50_5_2.csv"


def _write(folder, name, rows):
    path = os.path.join(folder, name)
    with open(path, "w", newline="") as f:
        out = csv.DictWriter(f, list(rows[0]))
        out.writeheader()
        out.writerows(rows)
    return path


def _load(spark, folder, name, rows):
    path = _write(str(folder), name, rows)
    return csv_files.read_ticket_file(spark, path, name).orderBy("row_index").collect()


def test_text_column_is_the_body_of_v3(spark, tmp_path):
    (r,) = _load(spark, tmp_path, V3, [{"Subject": "Help", "text": "Account locked", "language": "en"}])
    assert (r.subject, r.body, r.version, r.error) == ("Help", "Account locked", "v3", None)


def test_header_case_and_spaces_do_not_matter(spark, tmp_path):
    (r,) = _load(spark, tmp_path, V4, [{" SUBJECT ": "Help", "BODY": "Locked", "Language": "en"}])
    assert (r.subject, r.body, r.language) == ("Help", "Locked", "en")


def test_header_with_text_and_body_is_refused(spark, tmp_path):
    path = _write(str(tmp_path), V4, [{"text": "a", "body": "b", "language": "en"}])
    with pytest.raises(ValueError, match="body"):
        csv_files.read_rows(spark, path)


def test_german_files_are_german(spark, tmp_path):
    (a,) = _load(spark, tmp_path, DE, [{"subject": "Hilfe", "body": "Konto gesperrt"}])
    (b,) = _load(spark, tmp_path, DE2, [{"subject": "x", "body": "y", "language": "en"}])
    assert (a.language, a.version) == ("de", "de_norm")
    assert (b.language, b.version) == ("de", "de_norm_50_5_2")


def test_defaults_rejects_and_language_codes(spark, tmp_path):
    base = {"subject": "s", "body": "b", "language": "en", "queue": "q", "priority": "p", "type": "t"}
    rows = [
        base,
        {**base, "subject": "", "body": " \t"},
        {**base, "subject": "Help me", "body": ""},
        {**base, "language": "EN-US"},
        {**base, "language": ""},
        {**base, "language": "  "},
        {**base, "language": " ", "subject": "", "body": ""},
        {**base, "queue": "", "priority": "", "type": ""},
        {**base, "queue": " NA ", "priority": "null"},
    ]
    got = _load(spark, tmp_path, V4, rows)
    assert [r.row_index for r in got] == list(range(9))
    assert [r.error for r in got] == [
        None, canon.EMPTY_TEXT, None, None, None, canon.EMPTY_LANGUAGE, canon.EMPTY_LANGUAGE, None, None,
    ]
    assert [got[i].language for i in (0, 3, 4)] == ["en", "en", "un"]
    assert (got[7].queue, got[7].priority, got[7].type) == (None, None, None)
    assert (got[8].queue, got[8].priority) == (" NA ", "null")


def test_quotes_line_breaks_blank_lines_and_ragged_rows(spark, tmp_path):
    path = tmp_path / V4
    path.write_text(
        'subject,body,language\n"say ""hi""","two\nlines, one cell",en\n\nshort,row\na,b,en,extra\nlast,x,de\n'
        'only\n"a, ""b"", c","d,\ne"\na,b,en,\n"x,y",b,en,"more, cells"\n'
    )
    got = csv_files.read_ticket_file(spark, str(path), V4).orderBy("row_index").collect()
    assert [(r.subject, r.error) for r in got] == [
        ('say "hi"', None), ("short", None), ("a", canon.BAD_ROW), ("last", None),
        ("only", None), ('a, "b", c', None), ("a", canon.BAD_ROW), ("x,y", canon.BAD_ROW),
    ]
    assert got[0].body == "two\nlines, one cell"
    assert (got[1].body, got[1].language, got[4].body, got[5].body) == ("row", "un", "", "d,\ne")
    assert [r.row_index for r in got] == list(range(8))


def test_missing_columns_get_defaults(spark, tmp_path):
    (r,) = _load(spark, tmp_path, V4, [{"body": "only"}])
    assert (r.subject, r.body, r.language, r.queue) == ("", "only", "un", None)


def test_folder_of_parts_counts_rows_through(spark, tmp_path):
    rows = spark.range(95).select(
        F.format_string("s\n%d", "id").alias("subject"), F.lit("b").alias("body"), F.lit("en").alias("language"), "id"
    )
    path = f"{tmp_path}/{V4}"
    rows.repartitionByRange(7, "id").sortWithinPartitions("id").drop("id").write.options(
        **csv_files.CSV_OPTIONS
    ).csv(path)
    got = csv_files.read_ticket_file(spark, path, V4).orderBy("row_index").collect()
    assert [r.row_index for r in got] == list(range(95))
    assert [r.subject for r in got] == [f"s\n{i}" for i in range(95)]


def test_folder_coverage_and_unknown_files(spark, tmp_path):
    _write(str(tmp_path), V3, [{"subject": "a", "text": "b", "language": "en"}])
    _write(str(tmp_path), DE, [{"subject": "c", "body": "d"}])
    _write(str(tmp_path), "other.csv", [{"subject": "x"}])
    status = {r.file: r.status for r in csv_files.file_coverage(spark, str(tmp_path)).collect()}
    assert status == {V3: "known", DE: "known", V4: "missing", V5: "missing", DE2: "missing", "other.csv": "unknown"}
    rows = csv_files.read_ticket_folder(spark, str(tmp_path))
    assert sorted(r.file for r in rows.collect()) == sorted([V3, DE])


def test_empty_folder(spark, tmp_path):
    assert csv_files.file_coverage(spark, str(tmp_path)).where("status = 'missing'").count() == 5
    with pytest.raises(ValueError):
        csv_files.read_ticket_folder(spark, str(tmp_path))


def test_counts_add_up_and_rejects_keep_their_header(spark, tmp_path):
    rows = [{"subject": "", "body": "", "language": "en"}, {"subject": "a", "body": "", "language": "en"}]
    path = _write(str(tmp_path), V4, rows)
    df = csv_files.read_ticket_file(spark, path, V4)
    counts = {r.file: (r.n_valid, r.n_rejected) for r in canon.load_counts(df, "file").collect()}
    assert counts == {V4: (1, 1), None: (1, 1)}
    tables.write_rejects(canon.rejected_rows(df), f"{tmp_path}/r1")
    (back,) = tables.read_rejects(spark, f"{tmp_path}/r1").collect()
    assert tuple(back) == (V4, 0, canon.EMPTY_TEXT)
    tables.write_rejects(canon.rejected_rows(df).where("false"), f"{tmp_path}/r2")
    parts = [p for p in os.listdir(tmp_path / "r2") if p.endswith(".csv")]
    assert [(tmp_path / "r2" / p).read_text().strip() for p in parts] == ["file,row_index,error"]


def _versions(spark, rows):
    return spark.createDataFrame(rows, "ticket_id long, subject string, body string, version string, language string")


def test_dedup_keeps_the_highest_version_and_settles_ties(spark):
    df = _versions(spark, [
        (1, "X", "Y", "v3", "en"), (2, "X", "Y", "v5", "en"), (3, "X", "Z", "v3", "en"),
        (4, "T", "T", "v4", "en"), (5, "T", "T", "v4", "de"), (6, "U", "U", "nope", "en"), (7, "U", "U", "de_norm", "en"),
    ])
    kept = sorted(r.ticket_id for r in dedup_by_version(df, ["ticket_id"]).collect())
    assert kept == [2, 3, 4, 7]
    assert dedup_by_version(df, ["ticket_id"]).columns == df.columns


def test_language_is_filtered_after_the_dedup(spark):
    df = _versions(spark, [(1, "X", "Y", "v4", "en"), (2, "X", "Y", "v5", "fr")])
    assert canon.filter_languages(dedup_by_version(df, ["ticket_id"])).count() == 0


def test_dedup_folds_hot_copies_before_the_shuffle(spark):
    df = spark.range(20000).select(
        F.col("id").alias("ticket_id"), F.lit("hot").alias("subject"), F.lit("copy").alias("body"),
        F.lit("v4").alias("version"), F.lit("en").alias("language"),
    )
    one = dedup_by_version(df, ["ticket_id"])
    assert [r.ticket_id for r in one.collect()] == [0]
    assert "partial_min_by" in one._jdf.queryExecution().executedPlan().toString()
