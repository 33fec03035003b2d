"""Report files: repair modes, names, deleted lists, a whole quarter, and the arrival stream."""

import pytest
from pyspark.sql import functions as F

from casewise import batch, cli
from casewise.operators import periods
from casewise.sources import census, sinks
from casewise.sources import quarter_files as q


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode("latin1"))
    return str(path)


def values(df, *names):
    return [tuple(r) for r in df.orderBy("file_row").select(*names).collect()]


def test_ordinary_file(spark, tmp_path):
    path = write(tmp_path / "REAC.txt", 'ISR$CASE$REAC_PT\n1$NA$"a$b"\n2$NONE$caf\xe9\n3$$\n')
    df = q.read_table(spark, path, "reac")
    assert values(df, "primaryid", "pt") == [("1", "a$b"), ("2", "café"), ("3", None)]
    assert values(df, "case") == [(None,), ("NONE",), (None,)]


def test_broken_lines_are_repaired(spark, tmp_path):
    path = write(tmp_path / "R.txt", "primaryid$caseid$pt\n1$2$A\n3$4$B$5$6$C\n7$8$D$9$10$E$\n11\n12$13$NA$$\n")
    df = q.read_table(spark, path, "reac")
    assert values(df, "primaryid", "caseid", "pt") == [
        ("1", "2", "A"), ("3", "4", "B"), ("5", "6", "C"), ("7", "8", "D"), ("9", "10", "E"), ("11", "", ""), ("12", "13", "NA")]


def test_surplus_merges_in_demo_and_fails_elsewhere(spark, tmp_path):
    names = [f"c{i}" for i in range(6)] + ["primaryid", "caseid", "age", "text", "age_cod"]
    path = write(tmp_path / "D.txt", "$".join(names) + "\n" + "$".join("abcdefghijk") + "\n" + "$".join("abcdefghi") + "$x$y$z\n")
    df = q.read_table(spark, path, "demo")
    assert values(df, "text", "age_cod") == [("j", "k"), ("x$y", "z")]
    path = write(tmp_path / "O.txt", "primaryid$caseid$outc_cod\n1$2$DE\n1$2$DE$x\n")
    with pytest.raises(Exception, match="more than 3 fields"):
        q.read_table(spark, path, "outc").collect()


def test_missing_columns(spark, tmp_path):
    with pytest.raises(ValueError, match="drugname"):
        q.read_table(spark, write(tmp_path / "D.txt", "primaryid$caseid\n1$2\n"), "drug")


def quarter(root, year=2024, name="Q1"):
    folder, tag = root / str(year) / name, f"{str(year)[-2:]}{name}"
    write(folder / "ascii" / f"demo{tag}.txt", "primaryid$caseid$caseversion$fda_dt$age$age_cod$sex\n" + "".join(f"{i}$c{i}$1$20240115${66 + i}$YR${'FM'[i % 2]}\n" for i in range(1, 25)) + "77$900$1$20240101$70$YR$F\n")
    write(folder / "ascii" / f"DRUG{tag}.txt", "primaryid$caseid$drugname$prod_ai$role_cod\n" + "".join(f"{i}$c{i}${['AMBIEN', 'SONATA', 'ASPIRIN'][i % 3]}$$PS\n" for i in range(1, 25)))
    write(folder / "ascii" / f"REAC{tag}.txt", "primaryid$caseid$pt\n" + "".join(f"{i}$c{i}${['Fall', 'Vertigo', 'Rash', 'Nausea'][i % 4]}\n" for i in range(1, 25)))
    write(folder / "ascii" / f"OUTC{tag}.txt", "primaryid$caseid$outc_cod\n" + "".join(f"{i}$c{i}${['DE', 'HO', 'OT'][i % 3]}\n" for i in range(1, 25, 2)))
    write(folder / "deleted" / "del.txt", "900$x\nabc\n\n")


def trend_rows(spark, out):
    return spark.read.option("header", True).csv(f"{out}/analysis/trend_2024_2024.csv").collect()


def test_year_and_period_end_to_end(spark, tmp_path):
    raw, out = tmp_path / "raw", str(tmp_path / "out")
    for name in ("Q1", "Q2", "Q3", "Q4"):
        quarter(raw, name=name)
    batch.process_years(spark, str(raw), out, 2024, 2024)
    dataset = sinks.read_dataset(spark, out, "case_dataset", 2024)
    assert dataset.count() == 96 and dataset.where("caseid = '900'").isEmpty() and len(dataset.columns) == 45
    result = spark.read.option("header", True).csv(f"{out}/analysis/2024/01_signal_analysis_results.csv")
    overall = {(r.analysis, r.outcome_name): int(r.n) for r in result.where("stratum = 'overall'").collect()}
    assert overall[("main_ps_ss", "strict_fall")] == 96
    assert batch.is_complete(spark, out, 2024, "Q1")
    again = batch.process_years(spark, str(tmp_path / "gone"), out, 2024, 2024)  # nothing is left to do, so the reports are not needed
    assert again.count() == len(trend_rows(spark, out)) and len(again.columns) == 28
    broken = next((tmp_path / "out" / "signal_dataset" / "year=2024" / "quarter=Q2").glob("*.parquet"))
    whole = broken.read_bytes()
    broken.write_bytes(whole[:-4])
    assert not batch.is_complete(spark, out, 2024, "Q2")
    broken.write_bytes(whole)
    cli.main(["period", "--output", out], spark)
    assert spark.read.parquet(f"{out}/period/signal_dataset_2004_2025").count() == 24
    cli.main(["analyse", "--output", out], spark)
    cli.main(["scan", "--raw-root", str(raw), "--output", out], spark)
    cli.main(["terms", "--raw-root", str(raw), "--output", out, "--year", "2024", "--quarter", "Q1"], spark)
    tables = batch.descriptive_report(dataset, f"{out}/report")
    assert len(tables) == 13
    files = census.scan_files(census.header_lines(spark, str(raw))).collect()
    assert len(files) == 20 and {f["dataset_family"] for f in files} == {"DEMO", "DRUG", "REAC", "OUTC", "OTHER"}
    trend = spark.read.option("header", True).csv(f"{out}/analysis/trend_2024_2024.csv")
    assert len(trend.columns) == 28 and {r.outcome_definition for r in trend.collect()} == {"Narrow fall definition", "Broad fall definition"}


def test_joins_of_written_relations_need_no_exchange(spark, tmp_path):
    raw, out = tmp_path / "raw", str(tmp_path / "out")
    for name in ("Q1", "Q2"):
        quarter(raw, name=name)
        batch.process_quarter(spark, str(raw), out, 2024, name)
        batch.process_quarter(spark, str(raw), out, 2024, name)  # the same partitions again
    base, features, signals = (sinks.read_bucketed(spark, out, n) for n in ("case_base", "drug_feature", "signal_dataset"))
    assert base.count() == 48 and signals.count() == 48
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with sinks.joined_by_bucket(spark):
            star = base.join(features, ["caseid", "year", "quarter"], "left").join(signals.select("caseid", "year", "quarter", "serious"), ["caseid", "year", "quarter"], "left")
            assert "Exchange" not in star._jdf.queryExecution().executedPlan().toString() and star.count() == 48
            index = periods.global_index(base, clean=False)
            period = periods.signal_of_period(index, signals, clean=False)
            assert "Exchange" not in period._jdf.queryExecution().executedPlan().toString() and period.count() == 24
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    quarter(raw, name="Q3")
    write(raw / "2024" / "Q3" / "ascii" / "OUTC24Q3.txt", "primaryid$caseid$outc_cod\n")  # a relation without rows
    batch.process_quarter(spark, str(raw), out, 2024, "Q3")
    assert sinks.read_bucketed(spark, out, "case_dataset").where("quarter = 'Q3' and not serious").count() == 24
    assert sinks.bucket_count(spark, out) == sinks.bucket_count(spark, out, 99) == 4


def test_pairs_of_datasets(tmp_path):
    for name in ("signal_dataset_2004_2025", "feature_dataset_2004_2025", "signal_dataset_2024_2025", "feature_dataset_2024_2025", "signal_dataset_2001_2002"):
        (tmp_path / name).mkdir()
    assert sorted(sinks.dataset_pairs(tmp_path)) == ["2004_2025", "2024_2025"]
    assert sinks.one_pair(tmp_path, widest=True)[0].endswith("2004_2025")
    with pytest.raises(ValueError):
        sinks.one_pair(tmp_path)


def test_quarters_arrive_by_stream(spark, tmp_path):
    from casewise.streaming.quarters import follow_quarters

    rows = spark.range(4).select(F.col("id").alias("x"), F.lit(2024).alias("year"), F.when(F.col("id") < 2, "Q1").otherwise("Q2").alias("quarter"))
    rows.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        follow_quarters(spark, str(tmp_path / "in"), rows.schema, str(tmp_path / "out"), "d", str(tmp_path / "state")).awaitTermination()
    assert sinks.read_dataset(spark, str(tmp_path / "out"), "d").count() == 4


def test_training_sample_follows_the_kind_of_model(monkeypatch):
    seen = []
    monkeypatch.setattr(cli, "run_model", lambda spark, a: seen.append(a.train_sample_n))
    for kind in ("logistic", "forest", "boosted"):
        cli.main(["model", "--kind", kind], object())
    cli.main(["model", "--kind", "boosted", "--train-sample-n", "7"], object())
    assert seen == [400_000, 200_000, 300_000, 7]


def test_deleted_cases_are_found_in_a_folder_of_any_case(spark, tmp_path):
    write(tmp_path / "2024" / "q1" / "Deleted" / "d.txt", "12\n")
    assert [r.caseid for r in q.deleted_cases(spark, tmp_path, 2024, "Q1").collect()] == ["12"]
    with pytest.raises(ValueError, match="2004"):
        q.quarter_file(spark, str(tmp_path), 1999, "Q1", "DEMO")


def test_reports_below_a_data_folder_and_by_uri(spark, tmp_path):
    quarter(tmp_path / "data", 2020, "q2")
    for root in (str(tmp_path), f"file://{tmp_path}"):
        found = q.raw_root(spark, root)
        assert found == f"{root}/data" and q.quarter_file(spark, found, 2020, "Q2", "DRUG").endswith("/2020/q2/ascii/DRUG20q2.txt")
        reports = q.quarter_reports(spark, found, 2020, "Q2")
        assert reports.demo.count() == 25 and [r.caseid for r in reports.deleted.collect()] == ["900"]
    assert q.raw_root(spark, f"{tmp_path}/data") == f"{tmp_path}/data" and q.raw_root(spark, "/absent") == "/absent"
    with pytest.raises(FileNotFoundError):
        q.quarter_reports(spark, str(tmp_path / "data"), 2021, "Q2")


def test_a_file_is_searched_for_broken_lines_once(spark, tmp_path, monkeypatch):
    path = write(tmp_path / "R.txt", "primaryid$caseid$pt\n1$2$A$x$y$z\n3$4$B\n5$6$C$7$8$D$9$10$E\n")
    first = values(q.read_table(spark, path, "reac"), "primaryid", "pt")
    monkeypatch.setattr(q, "needs_repair", lambda *_: pytest.fail("searched again"))
    assert values(q.read_table(spark, path, "reac"), "primaryid", "pt") == first and ("9", "E") in first
    write(tmp_path / "R.txt", "primaryid$caseid$pt\n1$2$A\n")
    with pytest.raises(BaseException, match="searched again"):
        q.read_table(spark, path, "reac")


def test_structure_of_odd_headers(spark, tmp_path):
    write(tmp_path / "2004" / "Q1" / "ascii" / "DEMO04Q1.txt", "\u00ef\u00bb\u00bfISR$Case$Age\n1$2$3\n")
    write(tmp_path / "2005" / "Q1" / "ascii" / "DEMO05Q1.TXT", "isr$age$sex\r\n")
    write(tmp_path / "2005" / "q2" / "Ascii" / "drug.txt", "a,b\tc\td,e\n")
    write(tmp_path / "2005" / "Q3" / "Deleted" / "x_deleted.txt", "123\n")
    write(tmp_path / "2005" / "Q4" / "note.txt", "")
    write(tmp_path / "2005" / "other" / "DEMO.txt", "a$b\n")
    write(tmp_path / "top.txt", "a$b\n")
    files = census.scan_files(census.header_lines(spark, str(tmp_path))).cache()
    got = {r.relative_path: (r.year, r.quarter, r.dataset_family, r.folder_variant, r.delimiter, r.column_count, r.header_issue, r.header_signature) for r in files.collect()}
    assert got == {
        "2004/Q1/ascii/DEMO04Q1.txt": (2004, "Q1", "DEMO", "ascii", "$", 3, "", "isr|case|age"), "2005/Q1/ascii/DEMO05Q1.TXT": (2005, "Q1", "DEMO", "ascii", "$", 3, "", "isr|age|sex"),
        "2005/q2/Ascii/drug.txt": (2005, "Q2", "DRUG", "Ascii", "\t", 3, "", "a,b|c|d,e"), "2005/Q3/Deleted/x_deleted.txt": (2005, "Q3", "DELETE", "Deleted", "", 0, "delimiter_not_detected", ""),
        "2005/Q4/note.txt": (2005, "Q4", "OTHER", "ROOT", "", 0, "empty_header", "")}
    columns = [(r.column_position, r.column_name, r.column_name_normalized) for r in census.column_rows(files).where("year = 2004").orderBy("column_position").collect()]
    assert columns == [(1, "ISR", "isr"), (2, "Case", "case"), (3, "Age", "age")]
    assert {(r.counter, r.value): r.n_files for r in census.counters(files).collect()} == {
        ("folder_variant", "ascii"): 2, ("folder_variant", "Ascii"): 1, ("folder_variant", "Deleted"): 1, ("folder_variant", "ROOT"): 1, ("delimiter", "$"): 2, ("delimiter", "\t"): 1,
        ("delimiter", "UNKNOWN"): 2, ("header_issue", "delimiter_not_detected"): 1, ("header_issue", "empty_header"): 1, ("total_files", ""): 5}
    assert {(r.dataset_family, tuple(r.years), tuple(r.quarters)) for r in census.variants(files).collect()} == {("DEMO", (2004,), ("2004Q1",)), ("DEMO", (2005,), ("2005Q1",)), ("DRUG", (2005,), ("2005Q2",))}
    assert [(r.added, r.removed) for r in census.changes(files).where("dataset_family = 'DEMO' and year = 2005").collect()] == [(["sex"], ["case"])]
