"""Files to royalties: one hand-written report per layout, one case per rule."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from cadenza.functions import cleaning
from cadenza.operators.layouts import CDBABY, DISTROKID, LAYOUTS, TUNECORE, find_column, resolve
from cadenza.operators.history import dataset_status
from cadenza.operators.normalize import normalize, rejects
from cadenza.schema import ROYALTY_COLUMNS, ROYALTY_SCHEMA, STORED_SCHEMA, RequestError
from cadenza.sources import files, splitcsv
from cadenza.sources.detect import detect_files, source_by_name, source_of
from cadenza.sources.ingest import Workspace, committed_snapshot, ingest, read_catalog, read_ledger, tables_of
from cadenza.streaming.live import ingest_stream
from tests.conftest import by_name, rows

EPOCH = dt.date(1970, 1, 1)


def report(spark, header, *lines):
    names = header.split(",")
    schema = ", ".join(f"`{n}` string" for n in names)
    return spark.createDataFrame([tuple(line.split(",")) for line in lines], schema)


def test_distrokid_minimal(spark):
    raw = report(
        spark,
        "ISRC,Song Title,Store,Reporting Month,Earnings (USD),Currency",
        "US1234567890,My Song,Spotify,2026-06,12.345678,EUR",
    )
    assert by_name(normalize(raw, "DistroKid")) == [
        {
            "isrc": "US1234567890", "upc": "", "title": "My Song", "artist": "Unknown Artist",
            "album": "", "platform": "Spotify", "territory": "", "transaction_type": "",
            "reporting_date": dt.date(2026, 6, 1), "net_revenue": D("12.345678000"),
            "currency": "USD", "quantity": 1,
        }
    ]


def test_tunecore_minimal(spark):
    raw = report(
        spark,
        "ISRC,Track Title,Sales Type,Posting Date,Total Earned,Currency",
        "TC9876543210,Tune Song,Apple Music,2026-05-15,99.99,EUR",
    )
    row = by_name(normalize(raw, "TuneCore"))[0]
    assert row["platform"] == row["transaction_type"] == "Apple Music"
    assert (row["reporting_date"], row["net_revenue"]) == (dt.date(2026, 5, 15), D("99.990000000"))
    assert (row["currency"], row["quantity"]) == ("EUR", 1)


def test_symphonic_and_cdbaby(spark):
    cd = report(
        spark,
        "Period,Partner,Artist Name,Track Title,Album Title,UPC,ISRC,Country,Quantity,Payable",
        "06/2026,Deezer,Ann,Song,Disc,0012345,I1,NG,7,$1",
    )
    row = by_name(normalize(cd, "CDBaby"))[0]
    assert (row["upc"], row["title"], row["album"]) == ("0012345", "Song", "Disc")
    assert (row["quantity"], row["currency"], row["territory"]) == (7, "USD", "NG")
    sy = report(
        spark,
        "Reporting Month,DSP,Artist,Release,Track Title,ISRC,Units,Net Revenue,Currency",
        "2026/06/02,Tidal,Ann,Disc,Song,I1,12.0,-5,GBP",
    )
    row = by_name(normalize(sy, "Symphonic"))[0]
    assert (row["platform"], row["quantity"], row["net_revenue"]) == ("Tidal", 12, D("-5"))
    assert (row["album"], row["currency"]) == ("Disc", "GBP")


@pytest.mark.parametrize(
    "cell,want",
    [
        ("2026-06-01", dt.date(2026, 6, 1)),
        ("2026-6-1", dt.date(2026, 6, 1)),
        (" 2026/06/01 ", dt.date(2026, 6, 1)),
        ("02/03/2026", dt.date(2026, 2, 3)),
        ("13/06/2026", dt.date(2026, 6, 13)),
        ("2026-06", dt.date(2026, 6, 1)),
        ("06/2026", dt.date(2026, 6, 1)),
        ("2026-06-01 00:00:00", EPOCH),
        ("2026-02-30", EPOCH),
        ("junk", EPOCH),
        ("", EPOCH),
        (None, EPOCH),
    ],
)
def test_dates(spark, cell, want):
    frame = spark.createDataFrame([(cell,)], "c string")
    assert frame.select(cleaning.report_date(F.col("c"))).first()[0] == want


@pytest.mark.parametrize(
    "cell,want",
    [
        ("$1,234.56", "1234.56"), ("(12.34)", "12.34"), ("-5", "-5"), ("1.5e-5", "0"),
        ("1e5", "15"), ("12.3456789015", "12.345678902"), ("-0.0000000005", "-0.000000001"),
        ("", "0"), ("--5", "0"), ("1.2.3", "0"), (".5", "0.5"), (None, "0"),
    ],
)
def test_amounts(spark, cell, want):
    frame = spark.createDataFrame([(cell,)], "c string")
    assert frame.select(cleaning.amount(F.col("c"))).first()[0] == D(want)


@pytest.mark.parametrize(
    "cell,want", [("7", 7), ("", 1), ("abc", 1), ("1,234", 1), ("12.0", 12), (None, 1), ("-3", -3)]
)
def test_quantities(spark, cell, want):
    frame = spark.createDataFrame([(cell,)], "c string")
    assert frame.select(cleaning.quantity(F.col("c"))).first()[0] == want


def test_header_rules():
    assert find_column(["Country", "Quantity"], TUNECORE.aliases["quantity"]) == "Country"
    assert find_column(["Release Title", "Track Title"], TUNECORE.aliases["title"]) == "Release Title"
    assert find_column(["Sales Type"], ("type",)) == "Sales Type"
    assert find_column([" STORE "], DISTROKID.aliases["platform"]) == " STORE "
    with pytest.raises(RequestError, match="Missing Payable/Earnings column in CDBaby file"):
        resolve(["ISRC", "Title", "Partner", "Period"], CDBABY)
    for layout in LAYOUTS.values():
        with pytest.raises(RequestError, match=f"Missing ISRC column in {layout.name} file"):
            resolve(["Title"], layout)


def test_rejects(spark):
    raw = report(
        spark, "ISRC,Title,Store,Date,Earnings,Quantity",
        "I1,T,S,2026-01-01,1e5,2", "I2,T,S,soon,free,many", "I3,T,S,2026-01-01,1.00,3",
    )
    assert rows(rejects(raw, "DistroKid")) == [
        ("net_revenue", "amount misread", "1e5"),
        ("net_revenue", "no amount", "free"),
        ("quantity", "no quantity", "many"),
        ("reporting_date", "no date", "soon"),
    ]


def write(folder, name, text):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_bytes(text if isinstance(text, bytes) else text.encode())


def test_detection(spark, tmp_path):
    cases = {
        "a": ("x,Sales Type,y,partner", "TuneCore"),
        "b": ("TOTAL EARNED", "TuneCore"),
        "c": ("Payable,dsp", "CDBaby"),
        "d": ("isrc,Net Revenue", "Symphonic"),
        "e": ("isrc,earnings\n1,partner shop", "CDBaby"),
        "f": ("isrc,earnings", "DistroKid"),
        "g": ("x" * 1020 + "payable", "DistroKid"),
        "h": ("payable" + "x" * 1016 + "é", "DistroKid"),
        "i": ("payable" + "x" * 1015 + "é", "CDBaby"),
    }
    for name, (text, _) in cases.items():
        write(tmp_path, f"{name}.csv", text)
    found = {r["path"][-5]: r["source"] for r in detect_files(spark, str(tmp_path)).collect()}
    assert found == {name: want for name, (_, want) in cases.items()}


def test_declared_names(spark):
    frame = spark.createDataFrame(
        [(" Tune_Core ",), ("CDBABY",), ("distro_kid",), ("symphonic",), ("other",), (None,)], "n string"
    )
    got = [r[0] for r in frame.select(source_by_name(F.col("n"))).collect()]
    assert got == ["TuneCore", "CDBaby", "DistroKid", "Symphonic", None, None]
    content = F.encode(F.lit("partner"), "UTF-8")
    got = [r[0] for r in frame.select(source_of(F.col("n"), content)).collect()]
    assert got[-2:] == ["CDBaby", "CDBaby"]


def test_empty_workspace(spark, tmp_path):
    empty = files.read_royalties(spark, str(tmp_path / "none"))
    assert empty.columns == STORED_SCHEMA.fieldNames() and empty.count() == 0


def test_csv_export_and_json(spark, tmp_path):
    frame = spark.createDataFrame(
        [("a,b", 'say "hi"', 1, None), ("two\nlines", "", 2, D("1.5"))],
        "x string, y string, n int, d decimal(5,2)",
    )
    files.write_csv(frame.coalesce(1), str(tmp_path / "out"))
    text = next((tmp_path / "out").glob("*.csv")).read_text()
    assert text == 'x,y,n,d\n"a,b","say ""hi""",1,\n"two\nlines",,2,1.50\n'
    arrays = [r[0] for r in files.json_rows(frame).collect()]
    assert arrays == ['["a,b","say \\"hi\\"",1,null]', '["two\\nlines","",2,1.50]']
    objects = [r[0] for r in files.json_objects(frame).collect()]
    assert objects[0] == '{"x":"a,b","y":"say \\"hi\\"","n":1,"d":null}'


REPORTS = {
    "ds1.csv": 'Reporting Month,Store,Artist,Song Title,ISRC,UPC,Quantity,Earnings (USD)\n'
    '2026-06,Spotify,"Doe, Jane","A ""B""\nC",I1,0012345,5,1.25\n2026-06,Deezer,Jane,D,I2,,1,junk\n',
    "ds2.csv": "Period,Partner,Artist Name,Track Title,Album Title,UPC,ISRC,Quantity,Payable,Currency\n"
    "2026-05,Tidal,Ann,E,Disc,77,I3,2,3.5,EUR\n",
    "ds3.csv": "Sales Type,Title\nx,y\n",
}


def status(spark, workspace):
    log = dataset_status(read_ledger(spark, workspace))
    return {r["dataset_id"]: (r["status"], r["row_count"]) for r in log.collect()}


def names_in(spark, workspace, table, column):
    return sorted(r[0] for r in read_catalog(spark, workspace, table).select(column).collect())


def test_ingest_files(spark, tmp_path):
    workspace = Workspace(str(tmp_path), "w1", "u1")
    for name, text in REPORTS.items():
        write(tmp_path / "workspaces/w1/staging", name, text)
    ingest(spark, workspace, run="one")
    first = rows(read_catalog(spark, workspace, "tracks"))
    run = ingest(spark, workspace)
    assert rows(read_catalog(spark, workspace, "tracks")) == first and len(first) == 3
    stored = files.read_royalties(spark, workspace.processed)
    assert stored.select(*ROYALTY_COLUMNS).schema.fieldNames() == ROYALTY_SCHEMA.fieldNames()
    assert rows(stored.select("dataset_id", "isrc", "title", "upc", "net_revenue")) == [
        ("ds1", "I1", 'A "B"\nC', "0012345", D("1.250000000")),
        ("ds1", "I2", "D", "", D("0E-9")),
        ("ds2", "I3", "E", "77", D("3.500000000")),
    ]
    assert status(spark, workspace) == {"ds1": ("READY", 2), "ds2": ("READY", 1), "ds3": ("FAILED", 0)}
    ledger = read_ledger(spark, workspace)
    assert ledger.where("status = 'FAILED'").first()["error_message"].startswith("Missing ISRC")
    assert ledger.where("status = 'PROCESSING'").count() == 6
    assert spark.read.parquet(workspace.table("rejects")).where(F.col("batch") == run).count() == 1
    # The same run again changes nothing.
    entries = ledger.count()
    ingest(spark, workspace, run="one")
    assert committed_snapshot(spark, workspace)[0] == 2 and read_ledger(spark, workspace).count() == entries


def test_tables_of_an_empty_workspace(spark, tmp_path):
    listed = tables_of(spark, Workspace(str(tmp_path), "w1", "u1")).collect()
    assert {r["table_name"] for r in listed} == {"royalty_data", "datasets", "artists", "albums", "tracks"}
    assert ("tracks", "isrc", "string") in {tuple(r)[:3] for r in listed}


def test_second_batch_keeps_the_first(spark, tmp_path):
    """Other files, an empty, an emptied, a reordered and a declared one, in runs of their own."""
    workspace = Workspace(str(tmp_path), "w1", "u1")
    staging = tmp_path / "workspaces/w1/staging"
    write(staging, "ds1.csv", REPORTS["ds1.csv"])
    ingest(spark, workspace)
    (staging / "ds1.csv").unlink()
    header = REPORTS["ds1.csv"].split("\n")[0]
    write(staging, "empty.csv", header + "\n")
    write(staging, "ds2.csv", REPORTS["ds2.csv"])
    write(staging, "turned.csv", "ISRC,Earnings (USD),Song Title,Store,Reporting Month,Artist\nI8,2.5,T,Shop,2026-03,Bob\n")
    ingest(spark, workspace, declared={"ds2": "cd_baby"})
    assert names_in(spark, workspace, "artists", "name") == ["Ann", "Bob", "Doe, Jane", "Jane"]
    assert names_in(spark, workspace, "tracks", "isrc") == ["I1", "I2", "I3", "I8"]
    assert status(spark, workspace) == {
        "ds1": ("READY", 2), "ds2": ("READY", 1), "empty": ("READY", 0), "turned": ("READY", 1)
    }
    stored = files.read_royalties(spark, workspace.processed)
    assert stored.where("dataset_id = 'turned'").first()["reporting_date"] == dt.date(2026, 3, 1)
    write(staging, "ds2.csv", REPORTS["ds2.csv"].split("\n")[0] + "\n")
    ingest(spark, workspace)
    assert status(spark, workspace)["ds2"] == ("READY", 0)
    left = files.read_royalties(spark, workspace.processed).select("dataset_id").distinct()
    assert rows(left) == [("ds1",), ("turned",)]


def test_ingest_streams(spark, tmp_path):
    workspace = Workspace(str(tmp_path), "w1", "u1")

    def run(source):
        query = ingest_stream(spark, workspace, source, str(tmp_path / f"checkpoint-{source}"))
        assert query.awaitTermination(120)

    staging = tmp_path / "workspaces/w1/staging"
    write(staging / "DistroKid", "ds1.csv", REPORTS["ds1.csv"])
    run("DistroKid")
    write(staging / "CDBaby", "ds2.csv", REPORTS["ds2.csv"])
    run("CDBaby")
    # A file with other columns and one that lacks some do not stop the stream.
    write(staging / "DistroKid", "ds4.csv", "ISRC,Earnings (USD),Song Title,Store,Reporting Month\nI9,2.5,T,Shop,2026-02\n")
    write(staging / "DistroKid", "ds5.csv", "Title\nx\n")
    run("DistroKid")
    run("DistroKid")
    stored = files.read_royalties(spark, workspace.processed)
    assert rows(stored.groupBy("dataset_id").count()) == [("ds1", 2), ("ds2", 1), ("ds4", 1)]
    assert stored.where("isrc = 'I9'").first()["reporting_date"] == dt.date(2026, 2, 1)
    assert names_in(spark, workspace, "tracks", "isrc") == ["I1", "I2", "I3", "I9"]
    assert status(spark, workspace) == {
        "ds1": ("READY", 2), "ds2": ("READY", 1), "ds4": ("READY", 1), "ds5": ("FAILED", 0)
    }
    assert spark.read.parquet(workspace.table("rejects")).count() == 1


def untidy_csv(rng, line_end):
    """A report whose cells hold line breaks, doubled quotes, commas and quotes that open nothing."""
    cells = ["a", '12" mix', " lead", "née", "", '"one\ntwo"', '"say ""hi""\nnow"', '""', '"\n\n"', '"c,""d"', '",\"\",\n"', "0012"]
    lines = ["h1,h2,h 3"] + [",".join(rng.choice(cells) for _ in range(3)) for _ in range(25)]
    text = "\n".join(lines) + ("\n" if rng.random() < 0.5 else "")
    return text.replace("\n", line_end)


@pytest.mark.parametrize("seed,line_end", [(1, "\n"), (2, "\r\n")])
def test_large_csv_in_parts_equals_one_task(spark, tmp_path, seed, line_end, monkeypatch):
    import random

    rng = random.Random(seed)
    for n in range(2):
        (tmp_path / f"part {n}.csv").write_bytes(untidy_csv(rng, line_end).encode())
    whole = files.read_report(spark, str(tmp_path), "file")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "61")
    try:
        parts = files.read_report(spark, str(tmp_path), "file")
        assert parts.columns == whole.columns
        got, want = rows(parts), rows(whole)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == want and len(want) >= 40


def test_quotes_by_line():
    cases = [
        (b"a,b", False, False), (b'"a', False, True), (b'a,"b', False, True), (b'a,"b""', False, True), (b'a,"b"",', False, True),
        (b'a"b,c', False, False), (b'"a""b"', False, False), (b'b",c', True, False), (b'b"",c', True, True), (b'b","c', True, True), (b"", True, True),
    ]
    for line, inside, want in cases:
        assert splitcsv.open_after(line, inside) is want, line


def test_heads_are_read_in_tasks(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"x,y\r\n1,2\r\n")
    (tmp_path / "b c.csv").write_bytes(b"h" * 100_000 + b",i\n1,2\n")
    (tmp_path / "empty.csv").write_bytes(b"")
    (tmp_path / "old.csv").write_bytes(b"x,y\r1,2\r")
    found = {r["path"].rsplit("/", 1)[1]: r for r in files.heads(spark, str(tmp_path)).collect()}
    assert [found[n]["line_end"] for n in sorted(found)] == ["\r\n", "\n", "\n", "\r"]
    assert found["b c.csv"]["header"] == "h" * 100_000 + ",i" and len(found["b c.csv"]["snippet"]) == files.SNIPPET_BYTES
    assert found["empty.csv"]["header"] == "" and found["old.csv"]["header"] == "x,y"
    assert files.heads(spark, str(tmp_path / "none")).collect() == []
