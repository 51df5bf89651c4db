"""Input order without a feed sequence, whole or no publishing, the store that reopens, and clock changes."""

import datetime
import json
import random
import zipfile
import zoneinfo

import pytest
from pyspark.sql import functions as F

from tapeloom.config import CleanSpec, SplitSpec, TokenSpec, settings
from tapeloom.functions import times
from tapeloom.operators import clean, events
from tapeloom.operators.tokens import Binner
from tapeloom.sources import files, prints, store

SPLIT = SplitSpec(seen=("AAPL",), heldout=("NVDA",), train=("2025-02-03",), val=("2025-02-04",), test=("2025-02-05",))
HEADER = "symbol,timestamp,price,size,tr_corr,tr_scond"


def _lines(start, n):
    """Prints of one instant, told apart by their price."""
    return [f"AAPL,2025-02-03 10:00:00,{start + i},1,0,@" for i in range(n)]


def _order(df):
    kept = clean.retained(clean.annotate(df, CleanSpec(), SPLIT))
    return [int(r.price) for r in events.number_trades(kept).orderBy("r").collect()]


def test_ties_keep_the_order_of_the_files(spark, tmp_path):
    """Files of unequal size, given in another order than their names, a folder among them, CSV files cut into small blocks."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        sizes = {"z.csv": 40, "a.csv": 1, "m.csv": 25}
        want, at, given = [], 100, []
        for name, n in sizes.items():
            (tmp_path / name).write_text("\n".join([HEADER, *_lines(at, n)]) + "\n")
            given.append(str(tmp_path / name))
            want += range(at, at + n)
            at += 1000
        folder = tmp_path / "deep.csv" / "more"
        folder.mkdir(parents=True)
        for name, n in (("1.csv", 3), ("2.csv", 2)):
            (folder / name).write_text("\n".join([HEADER, *_lines(at, n)]) + "\n")
            want += range(at, at + n)
            at += 1000
        df = prints.read_prints(spark, [*given, str(folder)])
        assert df.rdd.getNumPartitions() > 4 and _order(df) == want
        assert _order(prints.read_prints(spark, [str(folder), *given])) == want[66:] + want[:66]
        with pytest.raises(ValueError, match="twice"):
            prints.read_prints(spark, [given[0], given[0]])
        with pytest.raises(Exception, match="gone"):
            prints.read_prints(spark, [given[0], str(tmp_path / "gone.csv")])
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_ties_in_parquet_and_archives(spark, tmp_path):
    schema = "symbol string, timestamp string, price double, size int, tr_corr string, tr_scond string"
    for k, n in ((0, 30), (1, 7)):
        rows = [("AAPL", "2025-02-03 10:00:00", 1000.0 * k + i + 1, 1, "0", "@") for i in range(n)]
        spark.createDataFrame(rows, schema).coalesce(1).write.option("parquet.block.size", "1024").parquet(str(tmp_path / f"{k}.parquet"))
        with zipfile.ZipFile(tmp_path / f"{k}.zip", "w") as out:
            out.writestr("b.csv", "\n".join([HEADER, *_lines(1000 * k + 501, n)]))
            out.writestr("a.csv", "\n".join([HEADER, *_lines(1000 * k + 1, n)]))
    first, second = [*range(1001, 1008)], [*range(1, 31)]
    assert _order(prints.read_prints(spark, [str(tmp_path / "1.parquet"), str(tmp_path / "0.parquet")])) == first + second
    got = _order(prints.read_prints(spark, [str(tmp_path / "1.zip"), str(tmp_path / "0.zip")]))
    assert got == first + [*range(1501, 1508)] + second + [*range(501, 531)]


def test_publishing_is_whole_or_nothing(spark, tmp_path):
    target = str(tmp_path / "t")
    store.write_table(spark.range(3), f"{target}.parquet")
    bad = spark.range(3).select(F.when(F.col("id") < 2, F.col("id")).otherwise(F.raise_error(F.lit("broken"))).alias("id"))
    with pytest.raises(Exception, match="broken"):
        store.write_table(bad, f"{target}.parquet", "overwrite")
    assert spark.read.parquet(f"{target}.parquet").count() == 3
    store.write_table(spark.range(5), f"{target}.parquet", "overwrite")
    assert spark.read.parquet(f"{target}.parquet").count() == 5
    with pytest.raises(FileExistsError):
        store.write_table(spark.range(1), f"{target}.parquet")
    assert [p.name for p in tmp_path.iterdir()] == ["t.parquet"]  # nothing half done lies about


def test_failed_move_puts_the_old_result_back(spark, tmp_path, monkeypatch):
    target = str(tmp_path / "t.parquet")
    store.write_table(spark.range(3), target)
    real, moves = files.move, []

    def failing(spark, source, to):
        moves.append(to)
        if len(moves) == 2:  # the new result into place
            raise OSError("lost")
        real(spark, source, to)

    monkeypatch.setattr(files, "move", failing)
    with pytest.raises(OSError, match="lost"):
        store.write_table(spark.range(9), target, "overwrite")
    assert spark.read.parquet(target).count() == 3 and [p.name for p in tmp_path.iterdir()] == ["t.parquet"]


def test_refused_extract_leaves_the_old_one(spark, tmp_path):
    rows = [("AAPL", "", d, "10:00:00", 1, 2) for d in ("2025-02-03", "2025-02-03", "2025-02-04")]
    df = spark.createDataFrame(rows, "sym_root string, sym_suffix string, date string, time_m string, price int, size int")
    out = str(tmp_path / "out")
    shape = (["AAPL"], ["2025-02-03", "2025-02-04"], "09:30:00", "16:00:00", [], out)
    store.extract_prints(df, *shape)
    with pytest.raises(ValueError, match="2025-02-09"):
        store.extract_prints(df, ["AAPL"], ["2025-02-03", "2025-02-09"], *shape[2:], mode="overwrite")
    with pytest.raises(ValueError, match="mode"):
        store.extract_prints(df, *shape, mode="append")
    assert spark.read.parquet(out).count() == 3 and [p.name for p in tmp_path.iterdir()] == ["out"]
    store.extract_prints(df, ["AAPL"], ["2025-02-04"], *shape[2:], mode="overwrite")
    assert spark.read.parquet(out).count() == 1


BINNER = Binner(2, ((0.5,), (0.0,), (1.0,)), ((0.1, 0.9), (-1.0, 1.0), (0.5, 2.0)), (0.0, -2.0, 0.0), (1.0, 2.0, 3.0))
SETTINGS = settings(CleanSpec(), SPLIT, TokenSpec(bins=2, context=1))


def _coded(spark, n=40):
    rows = [("AAPL", "2025-02-03" if i % 2 else "2025-02-04", "train" if i % 2 else "val", i // 2, i % 8) for i in range(n)]
    return spark.createDataFrame(rows, "symbol string, date string, split string, e long, token int").withColumn("date", F.col("date").cast("date"))


def _write(spark, root, n=40, mode="errorifexists"):
    coded = _coded(spark, n)
    sessions = coded.groupBy("symbol", "date", "split").agg(F.count("*").alias("events"))
    audit = spark.createDataFrame([("total", "input_rows", n)], "section string, key string, n long")
    return store.write_prepared(coded, sessions, audit, BINNER, SETTINGS, root, mode)


def test_store_reopens(spark, tmp_path):
    root = str(tmp_path / "store")
    with pytest.raises(FileNotFoundError):
        store.open_prepared(spark, root, SETTINGS)
    _write(spark, root)
    opened = store.open_prepared(spark, root, SETTINGS)
    assert opened.binner == BINNER and opened.audit.first().n == 40 and opened.sessions.count() == 2
    assert sorted(opened.events.collect()) == sorted(_coded(spark).collect()) and opened.events.schema == _coded(spark).schema
    with pytest.raises(FileExistsError):
        _write(spark, root)
    for other in (settings(CleanSpec(timezone="UTC"), SPLIT, TokenSpec(bins=2, context=1)), settings(CleanSpec(), SPLIT, TokenSpec(bins=3, context=1))):
        with pytest.raises(ValueError, match="other settings"):
            store.open_prepared(spark, root, other)
    _write(spark, root, 48, "overwrite")
    assert store.open_prepared(spark, root, SETTINGS).events.count() == 48
    assert len([p for p in (tmp_path / "store").iterdir() if p.name.startswith("data-")]) == 1


@pytest.mark.parametrize("table", ["events", "sessions", "audit", "bins"])
def test_store_refuses_changed_tables(spark, tmp_path, table):
    root = str(tmp_path / "store")
    folder = f"{root}/{_write(spark, root)['data']}/{table}"
    column = {"events": "token", "sessions": "events", "audit": "n", "bins": "mx"}[table]
    df = spark.read.parquet(folder)
    changed = df.withColumn(column, F.when(F.monotonically_increasing_id() == 0, F.col(column) + 1).otherwise(F.col(column)).cast(df.schema[column].dataType))
    changed.coalesce(1).write.partitionBy(*(["split", "date"] if table == "events" else [])).parquet(f"{folder}-changed")
    files.remove(spark, folder)
    files.move(spark, f"{folder}-changed", folder)
    with pytest.raises(ValueError, match=table):
        store.open_prepared(spark, root, SETTINGS)


def test_interrupted_overwrite_leaves_the_old_store(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "store")
    _write(spark, root)
    monkeypatch.setattr(store, "_publish", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        _write(spark, root, 48, "overwrite")
    assert store.open_prepared(spark, root, SETTINGS).events.count() == 40
    manifest = store.read_manifest(spark, root) | {"layout": 99}
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(f"{root}/manifest-00000009")
    with pytest.raises(ValueError, match="layout"):
        store.open_prepared(spark, root, SETTINGS)


@pytest.mark.parametrize("timezone", ["America/New_York", "Australia/Lord_Howe", "Africa/Casablanca", "Asia/Kolkata"])
def test_zone_tables_against_zoneinfo(spark, timezone):
    """Readings round every change and at random, by a search of all moments that show a reading."""
    rng = random.Random(timezone)
    zone, epoch = zoneinfo.ZoneInfo(timezone), datetime.datetime(1970, 1, 1, tzinfo=datetime.UTC)
    offset = lambda s: int((epoch + datetime.timedelta(seconds=s)).astimezone(zone).utcoffset().total_seconds())
    _, changes = times.transitions(timezone)
    walls = {rng.randrange(-6_000_000_000, 9_000_000_000) for _ in range(300)}
    for at, a, b in rng.sample(changes, min(len(changes), 80)):
        walls |= {at + o + d for o in (a, b) for d in (-1, 0, 1, 900)}
    known = {o for _, a, b in changes for o in (a, b)} | {offset(0)}
    want = {}
    for wall in walls:
        shown = {wall - o for o in known if offset(wall - o) == o}
        want[wall] = shown.pop() if len(shown) == 1 else None
    df = spark.createDataFrame([(w,) for w in walls], "w long")
    got = times.with_local(times.with_utc(df, "w", timezone, "u"), "w", timezone, "l").select("w", "u", "l").collect()
    assert {r[0]: r[1] for r in got} == want and {r[0]: r[2] for r in got} == {w: w + offset(w) for w in walls}
    assert any(u is None for u in want.values()) or timezone == "Asia/Kolkata"


def test_mixed_reads(spark, tmp_path):
    """CSV of two column orders, gzip, Parquet and archives of two headers in one call equal the files one by one."""
    import gzip

    (tmp_path / "a.csv").write_text("\n".join([HEADER, *_lines(1, 5)]))
    with gzip.open(tmp_path / "b.csv.gz", "wt") as out:
        out.write("tr_scond,PRICE,size,symbol,timestamp,tr_corr,seq\n" + "\n".join(f"@,{20 + i},1,AAPL,2025-02-03 10:00:00,0,{i}" for i in range(4)))
    rows = [("AAPL", "2025-02-03 10:00:00", 30.5 + i, 1, "0", "@", "extra") for i in range(3)]
    schema = "symbol string, timestamp string, price double, size int, tr_corr string, tr_scond string, note string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "c.parquet"))
    with zipfile.ZipFile(tmp_path / "d.zip", "w") as out:
        out.writestr("2.csv", "\n".join([HEADER, *_lines(50, 2)]))
        out.writestr("1.csv", "size,symbol,timestamp,price,tr_corr,tr_scond\n" + "\n".join(f'1,AAPL,"2025-02-03 10:00:00",{40 + i},0,@' for i in range(2)))
    folder = tmp_path / "folder"
    (folder / "_hidden").mkdir(parents=True)
    (folder / "y.csv").write_text("\n".join([HEADER, *_lines(60, 2)]))
    (folder / "_hidden" / "no.csv").write_text("junk")
    spark.createDataFrame(rows[:1], schema).coalesce(1).write.parquet(str(folder / "x.parquet"))
    paths = [str(tmp_path / name) for name in ("d.zip", "b.csv.gz", "folder", "c.parquet", "a.csv")]
    df = prints.read_prints(spark, paths)
    assert set(df.columns) == {*HEADER.split(","), *clean.PROVENANCE}  # seq and note are not in all
    kept = clean.retained(clean.annotate(df, CleanSpec(), SPLIT))
    got = [r.price for r in events.number_trades(kept).orderBy("r").collect()]
    assert got == [40, 41, 50, 51, 20, 21, 22, 23, 30.5, 60, 61, 30.5, 31.5, 32.5, 1, 2, 3, 4, 5]
    one = lambda path: clean.annotate(prints.read_prints(spark, path), CleanSpec(), SPLIT).select("symbol", "ts_ns", "price", "size", "first_fail")
    single = [r for path in paths for r in one(path).collect()]
    assert sorted(clean.annotate(df, CleanSpec(), SPLIT).select("symbol", "ts_ns", "price", "size", "first_fail").collect()) == sorted(single)
    (folder / "z.txt").write_text("?")
    with pytest.raises(ValueError, match="Unsupported"):
        prints.read_prints(spark, str(folder))
    lacking = tmp_path / "lacking.csv"
    lacking.write_text("symbol,timestamp,price,size\nAAPL,2025-02-03 10:00:00,1,1")
    with pytest.raises(ValueError, match="tr_corr"):
        clean.annotate(prints.read_prints(spark, [paths[4], str(lacking)]), CleanSpec(), SPLIT)


def test_members_are_streamed(spark, tmp_path, monkeypatch):
    """A member far larger than a block comes in blocks; quotes, line breaks, a byte order mark and empty fields stay text."""
    from tapeloom.sources import zipcsv

    path = str(tmp_path / "big.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        out.writestr("a.csv", "﻿k,text\n" + "".join(f'{i},"line\nwith ""quotes"", {"x" * 200}"\n' for i in range(5000)) + "7,\nnull,NA\n")
    monkeypatch.setattr(zipcsv, "BLOCK_BYTES", 10_000)
    [member] = zipcsv.archive_members(spark, [(3, path)])
    batches = list(zipcsv.ZipCsvReader([member], ["k", "text", *zipcsv.ADDED]).read(zipcsv.Member(3, path, "a.csv")))
    assert len(batches) > 80 and max(b.nbytes for b in batches) < 40_000
    rows = [r for b in batches for r in b.to_pylist()]
    assert rows[17] == {"k": "17", "text": 'line\nwith "quotes", ' + "x" * 200, "source_place": 3, "source_file": f"{path}/a.csv", "source_row": 17}
    assert [(r["k"], r["text"], r["source_row"]) for r in rows[-2:]] == [("7", "", 5000), ("null", "NA", 5001)]
    assert prints.read_prints(spark, path).count() == 5002


def test_frozen_bundle(spark, tmp_path):
    """A bundle comes back as it was, tampering is refused, and scoring new prints numbers them once."""
    import test_tasks
    from tapeloom.config import ClockSpec
    from tapeloom.operators import clock, probes
    from tapeloom.plans import frozen

    head = probes.Probe((0.1,) * 13, (1.0 / 3,) * 13, tuple((k * 0.1,) * 13 for k in range(3)), (0.0, 0.5, -0.5), 0.1, 7, 0.9, 1e-7)
    bundle = frozen.Bundle(BINNER, {"T1": (0.5, 1.0), "T2": (0.1, 1 / 7), "T3": (-0.1, 0.1)}, {"T2": head}, tuple(clock.FEATURES), TokenSpec(2, test_tasks.CONTEXT), test_tasks.SPEC, test_tasks.CLEAN)
    path = str(tmp_path / "bundle")
    digest = frozen.write_bundle(spark, bundle, path)
    assert frozen.open_bundle(spark, path, digest) == bundle
    with pytest.raises(ValueError, match="digest"):
        frozen.open_bundle(spark, path, "0" * 64)
    with pytest.raises(FileExistsError):
        frozen.write_bundle(spark, bundle, path)
    stored = json.loads(spark.read.text(path).first().value)
    stored["content"]["thresholds"]["T2"][0] += 1e-9
    spark.createDataFrame([(json.dumps(stored),)], "value string").coalesce(1).write.text(f"{path}-changed")
    with pytest.raises(ValueError, match="digest"):
        frozen.open_bundle(spark, f"{path}-changed")
    with pytest.raises(FileNotFoundError):
        frozen.open_bundle(spark, f"{path}-none")
    kept = test_tasks.trade_frame(spark, *test_tasks.regular(1400)).select("symbol", "date", "split", "ts_ns", F.col("r").alias("seq"), "price", "size")
    applied = frozen.apply_frozen(kept, bundle)
    scored = applied.score("T2")
    assert isinstance(bundle.clock_spec, ClockSpec) and scored.count() > 0
    assert "RangePartitioning" not in scored._jdf.queryExecution().toString()  # the order was made once and landed
