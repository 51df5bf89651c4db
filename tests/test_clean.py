"""Cleaning, time parsing, sources, sinks and streaming."""

import gzip
import zipfile

import pytest
from pyspark.sql import functions as F

from tapeloom.config import CleanSpec, SplitSpec
from tapeloom.functions.columns import to_number
from tapeloom.operators import clean, events
from tapeloom.sources import prints, store
from tapeloom.streaming import ingest

SPLIT = SplitSpec(seen=("AAPL",), heldout=("NVDA",), train=("2025-02-03",), val=("2025-02-04",), test=("2025-02-05",))
SPEC = CleanSpec(allowed_conditions=("@", ""), allowed_corrections=("00", "0"))
COLUMNS = "symbol string, timestamp string, price string, size string, tr_corr string, tr_scond string, seq bigint"


def rows(spark, *times, **changes):
    data = [("AAPL", t, "100", "10", "00", "@", i) for i, t in enumerate(times)]
    for i, change in changes.get("at", {}).items():
        data[i] = tuple(change.get(k, v) for k, v in zip(("symbol", "timestamp", "price", "size", "tr_corr", "tr_scond", "seq"), data[i]))
    return spark.createDataFrame(data, COLUMNS)


def counts(marked):
    return {r.step: r.n for r in clean.waterfall_counts(marked, clean.step_names(marked, SPEC)).collect()}


def test_waterfall_and_nanoseconds(spark):
    day = "2025-02-03T14:30:00.00000000"
    raw = rows(
        spark, day + "1Z", day + "3Z", day + "4Z", day + "5Z", "2025-02-03T21:00:00Z", "bad",
        at={2: {"tr_corr": "01"}, 3: {"tr_scond": "T"}},
    )
    marked = clean.annotate(raw, SPEC, SPLIT)
    got = counts(marked)
    assert got == {
        "input": 6, "invalid_timestamp": 1, "invalid_price_or_size": 0, "excluded_correction": 1, "excluded_condition": 1,
        "outside_session": 1, "outside_fixed_split": 0, "retained": 2,
    }
    kept = clean.retained(marked).orderBy("seq").collect()
    assert kept[1].ts_ns - kept[0].ts_ns == 2
    assert str(kept[0].date) == "2025-02-03" and kept[0].split == "train"


def test_share_classes_stay_apart(spark):
    raw = spark.createDataFrame(
        [("AAPL ", "", "2025-02-03", "10:00:00.1", 1.0, 1.0, "0.0", "@", 1), ("AAPL", "A", "2025-02-03", "10:00:00.1", 1.0, 1.0, None, "@", 2)],
        "SYM_ROOT string, sym_suffix string, date string, time_m string, price double, size double, tr_corr string, tr_scond string, seq bigint",
    )
    marked = clean.annotate(raw, SPEC, SPLIT)
    assert {(r.symbol, r.correction, r.first_fail) for r in marked.collect()} == {("AAPL", "0", None), ("AAPL.A", "", "excluded_correction")}


def test_condition_codes_keep_inner_blanks(spark):
    spec = CleanSpec(allowed_conditions=("@  I",))
    raw = rows(spark, "2025-02-03T15:00:00Z", "2025-02-03T15:00:00Z", at={0: {"tr_scond": " @  I "}, 1: {"tr_scond": "@ I"}})
    assert [r.first_fail for r in clean.annotate(raw, spec, SPLIT).orderBy("seq").collect()] == [None, "excluded_condition"]


def test_missing_quality_columns(spark):
    raw = rows(spark, "2025-02-03T15:00:00Z").drop("tr_corr", "tr_scond")
    with pytest.raises(ValueError, match="tr_corr"):
        clean.annotate(raw, SPEC, SPLIT)
    loose = CleanSpec(require_quality_fields=False)
    assert len(clean.check_columns(raw, loose)) == 2
    marked = clean.annotate(raw, loose, SPLIT)
    report = {(r.section, r.key): r.n for r in clean.audit(marked, clean.check_columns(raw, loose)).collect()}
    assert report["total", "retained_rows"] == 1 and sum(s == "warnings" for s, _ in report) == 2


@pytest.mark.parametrize("column", ["price", "symbol", "timestamp"])
def test_required_columns(spark, column):
    with pytest.raises(ValueError, match="Missing required"):
        clean.annotate(rows(spark, "2025-02-03T15:00:00Z").drop(column), SPEC, SPLIT)


def test_case_insensitive_duplicates(spark):
    assert clean.normalize_columns(spark.createDataFrame([(1, 2)], ["A", "b"])).columns == ["a", "b"]
    with pytest.raises(ValueError, match="case"):
        clean.normalize_columns(spark.range(1).select(F.lit(1).alias("Price"), F.lit(2).alias("price2")).toDF("Price", "price"))


def test_numeric_and_mixed_timestamps(spark):
    raw = rows(spark, "2025-02-03T15:00:00Z", "2025-02-03 15:00:00")
    with pytest.raises(ValueError, match="numeric"):
        clean.annotate(raw.withColumn("timestamp", F.lit(17)), SPEC, SPLIT)
    with pytest.raises(ValueError, match="zone"):
        clean.check_zone_mix(raw, SPEC)
    clean.check_zone_mix(raw.limit(1), SPEC)


def test_iso_spellings_and_daylight_saving(spark):
    cases = {
        "2025-02-03T14:30:00.123456789Z": 1738593000123456789,
        "2025-02-03 09:30:00.1234567": 1738593000123456700,
        "2025-02-03 09:30": 1738593000000000000,
        "20250203 9:30:00": 1738593000000000000,
        "2025-02-03T09:30:00-05:00": 1738593000000000000,
        "2025-02-03 16:30:00.5+0200": 1738593000500000000,
        "2025-02-03": 1738558800000000000,
        "2025-03-09 02:30:00": None,  # skipped by the clock
        "2025-03-09 03:30:00": 1741505400000000000,
        "2025-11-02 01:30:00": None,  # shown twice
        "2025-11-02 02:30:00": 1762068600000000000,
        "2025-11-02T01:30:00-04:00": 1762061400000000000,
        "2025-13-01 10:00:00": None, "2025-02-30 10:00:00": None, "2025-02-03 25:00:00": None, "9999-01-01 00:00:00": None,
        "17:00": None, "": None, "2025-02-03T10:00:00|x": None,
    }
    df = spark.createDataFrame(list(enumerate(cases)), "i int, timestamp string")
    got = [r.ts_ns for r in clean.parse_timestamps(df, CleanSpec()).orderBy("i").collect()]
    assert dict(zip(cases, got)) == cases


def test_numbers_and_half_open_session(spark):
    df = spark.createDataFrame([(t,) for t in ("1.5", " 2 ", "1d", "2F", "nan", "inf", "-1", "0", "x", "", None)], "t string")
    good = [r.ok for r in df.select(clean.positive(to_number(F.col("t"), True)).alias("ok")).collect()]
    assert [bool(v) for v in good] == [True, True] + [False] * 9
    raw = rows(spark, "2025-02-03 09:29:59.9", "2025-02-03 09:30:00", "2025-02-03 15:59:59.999999999", "2025-02-03 16:00:00")
    assert [r.first_fail for r in clean.annotate(raw, SPEC, SPLIT).orderBy("seq").collect()] == ["outside_session", None, None, "outside_session"]


def test_heldout_symbol_counts_on_test_dates_only(spark):
    raw = rows(spark, "2025-02-03 10:00:00", "2025-02-05 10:00:00", "2025-02-06 10:00:00", at={0: {"symbol": "NVDA"}, 1: {"symbol": "NVDA"}})
    assert [r.split for r in clean.annotate(raw, SPEC, SPLIT).orderBy("seq").collect()] == [None, "heldout", None]


LINES = ["sym_root,date,time_m,price,size,tr_corr,tr_scond,seq"] + [
    f"AAPL,2025-02-03,09:30:0{t},{100 + i},10,00,{c},{i}" for i, (t, c) in enumerate([(1, "@"), (2, "@"), (2, "@"), (3, "@"), (4, ""), (5, "T")])
]


def report_of(df):
    return {(r.section, r.key): r.n for r in df.collect()}


def test_zip_source_equals_csv(spark, tmp_path):
    path = str(tmp_path / "a.zip")
    with zipfile.ZipFile(path, "w") as archive:
        archive.writestr("b.csv", "\n".join([LINES[0], *LINES[4:]]))
        archive.writestr("a.csv", "\n".join(LINES[:4]))
        archive.writestr("__MACOSX/a.csv", "junk")
        archive.writestr("notes.txt", "junk")
    with gzip.open(tmp_path / "a.csv.gz", "wt") as out:
        out.write("\n".join(LINES))
    zipped, plain = prints.read_prints(spark, path), prints.read_prints(spark, str(tmp_path / "a.csv.gz"))
    assert zipped.rdd.getNumPartitions() == 2
    a, b = (clean.annotate(df, SPEC, SPLIT) for df in (zipped, plain))
    assert report_of(clean.audit(a)) == report_of(clean.audit(b))
    assert sorted(clean.retained(a).collect()) == sorted(clean.retained(b).collect())
    assert {r.source_row for r in zipped.collect()} == {0, 1, 2}
    empty = str(tmp_path / "none.zip")
    with zipfile.ZipFile(empty, "w") as archive:
        archive.writestr("notes.txt", "")
    with pytest.raises(Exception, match="holds no CSV file"):
        prints.read_prints(spark, empty).count()


def test_csv_keeps_text(spark, tmp_path):
    (tmp_path / "a.csv").write_text('symbol,Size,note\nNA,007,\n"x, y",1e3,null\n')
    df = prints.read_prints(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["symbol", "size", "note", "source_file", "source_block", "source_row", "source_place"]
    assert [(r.symbol, r["size"], r.note) for r in df.collect()] == [("NA", "007", ""), ("x, y", "1e3", "null")]
    with pytest.raises(ValueError, match="Unsupported"):
        prints.read_prints(spark, "a.txt")


def test_stream_equals_batch(spark, tmp_path):
    feed = tmp_path / "feed"
    feed.mkdir()
    for k in range(3):
        (feed / f"{k}.csv").write_text("\n".join([LINES[0], *LINES[1 + 2 * k : 3 + 2 * k]]))
    schema = prints.text_schema(LINES[0].split(","))
    raw = spark.readStream.schema(schema).option("header", True).option("maxFilesPerTrigger", 1).csv(str(feed))
    out = str(tmp_path / "out")
    for _ in range(2):  # the second run finds nothing new
        ingest.clean_stream(raw, SPEC, SPLIT, out, str(tmp_path / "progress"))
    batch = clean.annotate(spark.read.schema(schema).option("header", True).csv(str(feed)), SPEC, SPLIT)
    expected = report_of(clean.audit(batch))
    assert ("warnings", clean.TIES_WARNING) in expected
    assert report_of(ingest.landed_audit(spark, out)) == expected
    assert sorted(ingest.landed_prints(spark, out).collect()) == sorted(clean.retained(batch).collect())
    assert expected["total", "same_symbol_timestamp_ties"] == 1 and expected["raw_sessions", "AAPL 2025-02-03"] == 6
    with pytest.raises(ValueError, match="seq"):
        ingest.clean_stream(raw.drop("seq"), SPEC, SPLIT, out, str(tmp_path / "p2"))


def test_ties_keep_feed_order_and_copies_stay(spark):
    raw = rows(spark, *["2025-02-03 10:00:00"] * 3, at={0: {"seq": 9}, 2: {"price": "101"}})
    kept = clean.retained(clean.annotate(raw, SPEC, SPLIT))
    assert clean.repeats(kept).first().asDict() == {"same_symbol_timestamp_ties": 2, "identical_print_rows": 1}
    assert [r.seq for r in events.number_trades(kept).orderBy("r").collect()] == [1, 2, 9]


def test_extract(spark, tmp_path):
    df = spark.createDataFrame(
        [("AAPL", None, d, t, 1, 2, "x") for d in ("2025-02-03", "2025-02-04") for t in ("09:29:59", "09:30:00", "15:59:59.9", "16:00:00")]
        + [("AAPL", "A", "2025-02-03", "10:00:00", 1, 2, "x"), ("IBM", "", "2025-02-03", "10:00:00", 1, 2, "x")],
        "sym_root string, sym_suffix string, date string, time_m string, price int, size int, ex string",
    )
    out = str(tmp_path / "out")
    args = (["AAPL"], ["2025-02-03", "2025-02-04"], "09:30:00", "16:00:00", ["ex"], out)
    assert {r.date: r.n for r in store.extract_prints(df, *args).collect()} == {"2025-02-03": 2, "2025-02-04": 2}
    stored = spark.read.parquet(out)
    assert stored.schema["price"].dataType.typeName() == "double" and {r.sym_suffix for r in stored.collect()} == {""}
    with pytest.raises(Exception, match="exists"):
        store.extract_prints(df, *args)
    with pytest.raises(ValueError, match="No rows"):
        store.extract_prints(df, ["AAPL"], ["2025-02-03", "2025-02-09"], *args[2:], mode="overwrite")


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, [0.5, 0.5])], "a int, p array<double>")
    for name in ("t.parquet", "t"):
        path = str(tmp_path / name)
        store.write_table(df, path)
        with pytest.raises(Exception, match="exists"):
            store.write_table(df, path)
        store.write_table(df, path, "overwrite")
    assert spark.read.option("header", True).csv(str(tmp_path / "t")).first().p == "[0.5,0.5]"
    with pytest.raises(ValueError, match="mode"):
        store.write_table(df, str(tmp_path / "t"), "append")
