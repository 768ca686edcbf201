import json
import os
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from rubrica.config import IngestConfig
from rubrica.sources import sheets
from rubrica.sources.headers import detect_score_column, map_headers

ROW = "sheet_ordinal int, sheet_name string, row_ordinal long, stimulus string, transcription string, human_score string"


def rows(spark, *values):
    return spark.createDataFrame([(0, *v) for v in values], ROW)


def one(spark, expression, values):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.y for r in frame.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]


def test_participant_id(spark):
    names = ["Participant 1", "29_vA", " Group  A ", "   "]
    assert one(spark, sheets.participant_id, names) == ["P1", "P29", "Group_A", "unknown_participant"]


def test_sheet_filter(spark):
    names = ["Info", "Monkey", "P 3", "  RUBRIC ", "Participant Information", "S1"]
    assert one(spark, sheets.is_ignored_sheet, names) == [True, True, False, True, True, False]


def test_item_suffix(spark):
    texts = ["Quiero cortarme el pelo (7)", "a (1) (2)", "(7)", "a(3) ", "(7) a", None]
    want = ["Quiero cortarme el pelo", "a (1)", "", "a", "(7) a", ""]
    assert one(spark, sheets.strip_item_suffix, texts) == want


@pytest.mark.parametrize(
    "headers, want",
    [
        (["Target", "Student Response", "Student score"], {"stimulus": "Target", "transcription": "Student Response"}),
        ([" STIMULUS ", "Transcription", "Rubric notes", "Score"], {"stimulus": " STIMULUS ", "transcription": "Transcription", "human_score": "Rubric notes"}),
        (["Student ID", "Sentence", "Transcription", "Grade"], {"stimulus": "Sentence", "transcription": "Transcription", "human_score": "Grade"}),
        ([3, None, "prompt text", "my response"], {"stimulus": "prompt text", "transcription": "my response"}),
        (["a", "b"], {}),
    ],
)
def test_header_map(headers, want):
    assert map_headers(headers) == want


def test_score_column():
    assert detect_score_column(["id", "my score", "Human Grade "]) == "Human Grade "
    assert detect_score_column(["id", "my score x", "upgrade"]) == "my score x"
    assert detect_score_column(["id"]) is None


def test_range_blank_missing(spark):
    data = rows(
        spark,
        ("P1", 0, "s", "t0", "-1"), ("P1", 1, "s", "t1", "0"), ("P1", 2, "s", "t2", "4"), ("P1", 3, "s", "t3", "5"),
        ("P1", 4, "s", "t4", None), ("P1", 5, None, "t5", "1"), ("P1", 6, "s", "  ", "1"), ("P1", 7, "(7)", "t7", "x"),
    )
    kept = {r.transcription: r.human_score for r in sheets.standardize(data, "tuning").collect()}
    assert kept == {"t1": 0.0, "t2": 4.0, "t4": None, "t7": None}
    assert sheets.standardize(data, "holdout").count() == 6
    report = sheets.load_report(data, "tuning").first().asDict()
    assert report == {
        "sheet_name": "P1", "rows_read": 8, "dropped_missing": 1, "dropped_blank": 1, "invalid_scores": 2,
        "out_of_range": 2, "kept": 4, "deduplicated": 0, "missing_scores": 2, "final_rows": 2,
    }


def test_unscored_first_copy_removes_later_ones(spark):
    data = rows(spark, ("P1", 0, "k", "t", None), ("P1", 1, "k", "t", "4"), ("P2", 0, "k", "t", "3"), ("P2", 1, "k (7)", " t", "1"))
    assert [(r.sheet_name, r.human_score) for r in sheets.load_pairs(data, "tuning").collect()] == [("P2", 3.0)]
    assert sheets.load_pairs(data, "holdout").count() == 2


def test_dedup_does_not_depend_on_partitions(spark):
    data = rows(spark, *[("P1", i, "k", f"t{i % 7}", str(i % 5)) for i in range(500)])
    want = {(f"t{i}", float(i % 5), i) for i in range(7)}
    for n in (1, 5):
        got = sheets.load_pairs(data.repartition(n), "tuning").collect()
        assert {(r.transcription, r.human_score, r.row_ordinal) for r in got} == want


def test_read_parquet_sheets(spark, tmp_path):
    pd.DataFrame({"Target": ["a"], "Response": ["b"], "Grade": [3]}).to_parquet(tmp_path / "Participant 4.parquet")
    got = sheets.load_role(spark, str(tmp_path), "tuning").collect()
    assert [(r.participant_id, r.transcription, r.human_score) for r in got] == [("P4", "b", 3.0)]


def test_copies_collapse_before_the_shuffle(spark, plan_of):
    plan = plan_of(sheets.load_pairs(rows(spark, ("P1", 0, "k", "t", "1")), "tuning"))
    assert plan.count("HashAggregate") == 2 and plan.count("Exchange") == 1
    assert "SortAggregate" not in plan and "Window" not in plan and "Python" not in plan


def write_csv(folder, name, frame):
    frame.to_csv(os.path.join(folder, f"{name}.csv"), index=False)


def test_read_csv_sheets(spark, tmp_path):
    write_csv(tmp_path, "Participant 1", pd.DataFrame({"Target": ["a (3)", "b\nc"], "Response": ["a", "b, c"], "Score": [4, None]}))
    write_csv(tmp_path, "Participant 2", pd.DataFrame({"prompt": ["x"], "Student transcription": ["y"]}))
    write_csv(tmp_path, "Instructions", pd.DataFrame({"stimulus": ["x"], "response": ["y"]}))
    write_csv(tmp_path, "P3", pd.DataFrame({"foo": ["x"]}))
    (tmp_path / "P4.csv").write_bytes(b"\xff\xfe\xff,\n")
    got = sheets.read_sheets(spark, str(tmp_path)).collect()
    assert sorted((r.sheet_name, r.row_ordinal, r.stimulus, r.transcription, r.human_score) for r in got) == [
        ("Participant 1", 0, "a (3)", "a", "4.0"),
        ("Participant 1", 1, "b\nc", "b, c", None),
        ("Participant 2", 0, "x", "y", None),
    ]


def test_list_sheets_and_summary(spark, tmp_path):
    write_csv(tmp_path, "Participant 1", pd.DataFrame({"Target": ["a", "a", "b"], "Response": ["a", "a", "c"], "Score": [4, 3, None]}))
    write_csv(tmp_path, "Instructions", pd.DataFrame({"stimulus": ["x"], "response": ["y"]}))
    write_csv(tmp_path, "P3", pd.DataFrame({"foo": ["x"]}))
    (tmp_path / "P4.csv").write_bytes(b"\xff\xfe\xff,\n")
    listed = sheets.list_sheets(spark, str(tmp_path))
    assert {(r.sheet_name, r.status, r.n_rows) for r in listed.collect()} == {
        ("Participant 1", "read", 3), ("Instructions", "ignored", 1), ("P3", "no_text_columns", 1), ("P4", "no_text_columns", 0),
    }
    report = sheets.load_report(sheets.read_sheets(spark, str(tmp_path)), "tuning")
    assert sheets.load_summary(report, listed).first().asDict() == {
        "sheets_total": 4, "sheets_skipped": 3, "sheets_valid": 1, "kept": 3, "deduplicated": 1, "missing_scores": 1, "final_rows": 1,
    }
    assert sheets.list_sheets(spark, str(tmp_path / "none"), missing_ok=True).isEmpty()


def test_report_of_a_load_reads_the_rows_once(spark):
    data = rows(
        spark, ("P1", 0, "k", "t", None), ("P1", 1, "k", "t", "4"), ("P2", 0, "k", "t", "3"), ("P2", 1, "k", "t", "9"), ("P2", 2, None, "t", "1")
    )
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    counted = data.mapInPandas(count, data.schema)
    for role in ("tuning", "holdout"):
        before = seen.value
        pairs, report = sheets.load_with_report(counted, role)
        got = sorted(map(tuple, pairs.collect())), sorted(map(tuple, report.collect()))
        assert seen.value - before == 5
        assert got[0] == sorted(map(tuple, sheets.load_pairs(data, role).collect()))
        assert got[1] == sorted(map(tuple, sheets.load_report(data, role).collect()))
        assert report.schema.names == sheets.REPORT_SCHEMA.names


def test_tables_as_sources(spark):
    table = spark.createDataFrame(
        [("P1", 0, "a (2)", "a", 4), ("Key", 0, "b", "b", 4)], "sheet_name string, row_ordinal long, Target string, Response string, Grade int"
    )
    table.createOrReplaceTempView("answers_table")
    cfg = IngestConfig(tuning_table="answers_table", holdout_table="answers_table")
    tuning, holdout, report = sheets.load_data_with_reports(spark, cfg)
    assert [(r.participant_id, r.stimulus) for r in tuning.collect()] == [("P1", "a")] and holdout.count() == 1
    assert sorted((r.role, r.sheet_name, r.final_rows) for r in report.collect()) == [("holdout", "P1", 1), ("tuning", "P1", 1)]


def json_codec(path, content):
    return {name: pd.DataFrame(columns) for name, columns in json.loads(content).items()}


def test_workbook_with_many_sheets(spark, tmp_path):
    book = {
        "Rubric": {"stimulus": ["r"], "response": ["r"]},
        "B 7": {"Stimulus": ["s"], "Response": ["s"], "Score": [4]},
        "A 9": {"Target": ["u"], "Transcription": ["v"], "Grade": [1]},
    }
    (tmp_path / "book.json").write_text(json.dumps(book))
    got = sheets.load_role(spark, str(tmp_path / "book.json"), "tuning", codec=json_codec)
    assert [(r.participant_id, r.sheet_ordinal, r.stimulus) for r in got.orderBy("sheet_ordinal").collect()] == [
        ("P7", 1, "s"), ("P9", 2, "u"),
    ]


def test_missing_path_and_missing_scores(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        sheets.load_role(spark, str(tmp_path / "none.csv"), "tuning")
    empty_ok = IngestConfig(missing_ok=True)
    assert sheets.load_role(spark, str(tmp_path / "none.csv"), "tuning", empty_ok).isEmpty()
    write_csv(tmp_path, "P1", pd.DataFrame({"stimulus": ["a"], "response": ["b"]}))
    with pytest.raises(ValueError, match="score"):
        sheets.load_role(spark, str(tmp_path), "tuning")
    assert sheets.load_role(spark, str(tmp_path), "holdout").count() == 1


def test_cache(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    write_csv(source, "P1", pd.DataFrame({"stimulus": ["a"], "response": ["b"], "score": [2]}))
    cfg = IngestConfig(cache_dir=str(tmp_path / "cache"))
    assert sheets.load_role(spark, str(source), "tuning", cfg).count() == 1
    cache = sheets.cache_path(cfg, str(source), "tuning")
    assert sheets.is_cache_valid(spark, str(source), cache)
    assert not sheets.is_cache_valid(spark, str(source), cache, force_reload=True)
    assert not sheets.is_cache_valid(spark, str(source), str(tmp_path / "nowhere"))
    write_csv(source, "P2", pd.DataFrame({"stimulus": ["c"], "response": ["d"], "score": [3]}))
    later = time.time() + 60
    os.utime(source / "P2.csv", (later, later))
    assert not sheets.is_cache_valid(spark, str(source), cache)
    assert sheets.load_role(spark, str(source), "tuning", cfg).count() == 2


def test_table_with_sheet_column(spark):
    table = spark.createDataFrame(
        [("P1", 0, "a (2)", "a", 4), ("Key", 0, "b", "b", 4)], "sheet_name string, row_ordinal long, Target string, Response string, Grade int"
    )
    got = sheets.load_pairs(sheets.sheet_rows_from_table(table), "tuning").collect()
    assert [(r.participant_id, r.stimulus, r.human_score) for r in got] == [("P1", "a", 4.0)]
    with pytest.raises(ValueError, match="transcription"):
        sheets.sheet_rows_from_table(table.drop("Response"))


def test_cache_of_two_glob_sources(spark, tmp_path):
    cfg = IngestConfig(cache_dir=str(tmp_path / "cache"))
    for folder, text in (("a", "first"), ("b", "second")):
        (tmp_path / folder).mkdir()
        write_csv(tmp_path / folder, "P1", pd.DataFrame({"stimulus": [text], "response": ["x"], "score": [1]}))
        got = sheets.load_role(spark, str(tmp_path / folder / "*.csv"), "tuning", cfg).collect()
        assert [r.stimulus for r in got] == [text]


def test_equal_sheet_names_are_rejected(spark, tmp_path):
    for folder in ("a", "b"):
        (tmp_path / folder).mkdir()
        write_csv(tmp_path / folder, "Participant 1", pd.DataFrame({"stimulus": ["s"], "response": ["r"]}))
    with pytest.raises(ValueError, match="Participant 1"):
        sheets.read_sheets(spark, str(tmp_path / "*"))


def test_unreadable_workbook(spark, tmp_path):
    (tmp_path / "book.json").write_text("no json")
    with pytest.raises(Exception, match="JSONDecodeError"):
        sheets.read_sheets(spark, str(tmp_path), json_codec).collect()
    assert sheets.read_sheets(spark, str(tmp_path), json_codec, skip_unreadable=True).isEmpty()
    assert [r.status for r in sheets.list_sheets(spark, str(tmp_path), json_codec).collect()] == ["unreadable"]


def test_native_reader_prunes_and_runs_no_python(spark, tmp_path, plan_of):
    frame = pd.DataFrame({"Target": ["a", "b"], "Response": ["b", "c"], "Grade": [3, 4], "Notes": ["n", "m"]})
    frame.to_parquet(tmp_path / "P 4.parquet")
    read = sheets.read_sheets(spark, str(tmp_path))
    plan = plan_of(read.select("stimulus"))
    assert "Python" not in plan and "Pandas" not in plan
    assert "Notes" not in plan and "Response" not in plan.split("ReadSchema")[-1]
    got = read.orderBy("row_ordinal").collect()
    assert [(r.sheet_name, r.row_ordinal, r.stimulus, r.human_score) for r in got] == [("P 4", 0, "a", "3"), ("P 4", 1, "b", "4")]


def test_rows_of_a_split_file_keep_their_order(spark, tmp_path):
    n = 60_000
    write_csv(tmp_path, "P+1 %", pd.DataFrame({"stimulus": [f"s{i}" for i in range(n)], "response": ["r" * 40] * n}))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        read = sheets.read_sheets(spark, str(tmp_path), multi_line=False)
        assert read.rdd.getNumPartitions() > 1
        got = [r.stimulus for r in read.orderBy("row_ordinal").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [f"s{i}" for i in range(n)] and read.first().sheet_name == "P+1 %"


def test_parquet_files_of_different_headers(spark, tmp_path):
    pd.DataFrame({"Target": ["a"], "Response": ["b"], "Score": [3]}).to_parquet(tmp_path / "P1.parquet")
    pd.DataFrame({"Prompt": ["c"], "Transcription": ["d"], "Grade": ["4"], "Student ID": ["x"]}).to_parquet(tmp_path / "P2.parquet")
    pd.DataFrame({"foo": ["c"]}).to_parquet(tmp_path / "P3.parquet")
    got = sheets.read_sheets(spark, str(tmp_path)).collect()
    assert sorted((r.sheet_name, r.stimulus, r.transcription, r.human_score) for r in got) == [("P1", "a", "b", "3"), ("P2", "c", "d", "4")]
    listed = {(r.sheet_name, r.status) for r in sheets.list_sheets(spark, str(tmp_path)).collect()}
    assert listed == {("P1", "read"), ("P2", "read"), ("P3", "no_text_columns")}


def test_one_name_in_csv_and_parquet_is_rejected(spark, tmp_path):
    frame = pd.DataFrame({"Target": ["a"], "Response": ["b"], "Score": [3]})
    frame.to_parquet(tmp_path / "P1.parquet")
    write_csv(tmp_path, "P1", frame)
    with pytest.raises(ValueError, match="P1"):
        sheets.read_sheets(spark, str(tmp_path))


def test_sheet_column_and_file_of_one_name_are_rejected(spark, tmp_path):
    frame = pd.DataFrame({"sheet_name": ["P1"], "row_ordinal": [0], "Target": ["a"], "Response": ["b"], "Score": [3]})
    frame.to_parquet(tmp_path / "table.parquet")
    write_csv(tmp_path, "P1", frame[["Target", "Response"]])
    with pytest.raises(ValueError, match="P1"):
        sheets.read_sheets(spark, str(tmp_path))


def answers(folder, name, text, later=0):
    write_csv(folder, name, pd.DataFrame({"stimulus": [text], "response": ["r"], "score": [2]}))
    stamp = time.time() + later
    os.utime(folder / f"{name}.csv", (stamp, stamp))


def test_cache_follows_changed_added_and_deleted_files(spark, tmp_path, monkeypatch):
    source = tmp_path / "in"
    source.mkdir()
    for name in ("P1", "P2", "P3"):
        answers(source, name, f"{name} old")
    cfg = IngestConfig(cache_dir=str(tmp_path / "cache"))
    cache = sheets.cache_path(cfg, str(source), "tuning")
    load = lambda: {(r.sheet_name, r.stimulus) for r in sheets.load_role(spark, str(source), "tuning", cfg).collect()}
    assert load() == {(f"P{i}", f"P{i} old") for i in (1, 2, 3)}
    read, real = [], sheets.rows_with_source
    monkeypatch.setattr(sheets, "rows_with_source", lambda s, files, *a: read.append([os.path.basename(f) for f in files]) or real(s, files, *a))
    assert load() == {(f"P{i}", f"P{i} old") for i in (1, 2, 3)} and read == []
    answers(source, "P2", "P2 new", later=60)
    answers(source, "P4", "P4 new")
    os.remove(source / "P3.csv")
    assert not sheets.is_cache_valid(spark, str(source), cache)
    want = {("P1", "P1 old"), ("P2", "P2 new"), ("P4", "P4 new")}
    assert load() == want and read == [["P2.csv", "P4.csv"]]
    assert sheets.is_cache_valid(spark, str(source), cache)
    os.remove(source / "P4.csv")  # nothing is left to read, only to drop
    assert load() == want - {("P4", "P4 new")} and len(read) == 1
    assert {x for x in os.listdir(f"{cache}/pairs") if x.startswith("refresh=")} and len(os.listdir(f"{cache}/manifest")) <= 3
    report = sheets.load_role_with_report(spark, str(source), "tuning", cfg)[1]
    assert {(r.sheet_name, r.rows_read, r.final_rows) for r in report.collect()} == {("P1", 1, 1), ("P2", 1, 1)} and len(read) == 1


def test_a_failed_write_leaves_the_old_table(spark, tmp_path, monkeypatch):
    source = tmp_path / "in"
    source.mkdir()
    answers(source, "P1", "old")
    cfg = IngestConfig(cache_dir=str(tmp_path / "cache"))
    cache = sheets.cache_path(cfg, str(source), "tuning")
    sheets.load_role(spark, str(source), "tuning", cfg)
    answers(source, "P1", "new", later=60)
    with monkeypatch.context() as broken:
        broken.setattr(sheets.sheet_cache, "_write", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            sheets.load_role(spark, str(source), "tuning", cfg)
    kept = sheets.sheet_cache.current(spark, cache)
    assert [r.stimulus for r in sheets.sheet_cache.read(spark, cache, kept, "pairs", sheets.PAIR_SCHEMA).collect()] == ["old"]
    (tmp_path / "cache" / os.path.basename(cache) / "manifest" / "version=99").mkdir()  # a writer that never finished
    assert sheets.sheet_cache.current(spark, cache).number == kept.number
    assert [r.stimulus for r in sheets.load_role(spark, str(source), "tuning", cfg).collect()] == ["new"]


def test_cached_sheet_is_found_by_pushed_filters(spark, tmp_path, plan_of):
    source = tmp_path / "in"
    source.mkdir()
    for name in ("1", "001", "P1"):
        answers(source, name, name)
    cfg = IngestConfig(cache_dir=str(tmp_path / "cache"))
    got = sheets.load_role(spark, str(source), "tuning", cfg)
    assert {(r.sheet_name, r.stimulus) for r in got.collect()} == {("1", "1"), ("001", "001"), ("P1", "P1")}
    one_sheet = got.filter(F.col("sheet_name") == "P1")
    assert one_sheet.count() == 1 and "EqualTo(sheet_name,P1)" in plan_of(one_sheet)


def test_paths_are_worked_out_per_file_and_sheet(spark, tmp_path, plan_of):
    folder = tmp_path / "a +b%20c"
    columns = "sheet_name string, row_ordinal long, stimulus string, response string, score string"
    rows = [("P1", i, f"s{i}", "r", "2") for i in range(3)] + [("P2", 0, "s", "r", "1")]
    spark.createDataFrame(rows, columns).coalesce(1).write.parquet(str(folder / "table"))
    write_csv(folder, "P3 x+y", pd.DataFrame({"stimulus": ["a", "b"], "response": ["r", "r"], "score": [2, 3]}))
    files = sheets._files(spark, str(folder / "table"), False) + [f"file:{folder}/P3 x+y.csv"]
    table = sheets.rows_with_source(spark, files[:1])
    assert "decode" not in plan_of(table)
    found = [tuple(r) for r in sheets.sheet_files(sheets.rows_with_source(spark, files)).collect()]
    assert sorted(found) == [("P1", files[0]), ("P2", files[0]), ("P3 x+y", files[1])]
    codec = lambda path, content: {os.path.basename(path): pd.DataFrame({"stimulus": ["a"], "response": ["r"]})}
    book = sheets.sheet_files(sheets.rows_with_source(spark, files[1:], codec))
    assert [tuple(r) for r in book.collect()] == [("P3 x+y.csv", files[1])]


def test_the_participant_is_no_part_of_the_shuffle(spark, plan_of):
    rows = spark.createDataFrame([("P1", 0, i, "s", "r", "2") for i in range(2)], "sheet_name string, sheet_ordinal int, row_ordinal long, stimulus string, transcription string, human_score string")
    groups = sheets._copies(rows, "tuning", IngestConfig())
    exchange = next(line for line in plan_of(groups).splitlines() if "Exchange hashpartitioning" in line)
    assert "participant_id" not in exchange and [(r.participant_id, r.n) for r in groups.collect()] == [("P1", 2)]
