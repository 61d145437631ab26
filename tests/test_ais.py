"""The CSV data source: any split gives the same records; quotes, line ends, bad bytes, reasons."""

from __future__ import annotations

import csv
import io

import pytest

from wakeline.sources import ais

HEADER = "MMSI,BaseDateTime,LAT,LON,SOG,COG,Name\n"


def content():
    rows = []
    for k in range(300):
        name = ['plain', '"two\nlines"', '"a ""b"" ,c"', '"\n\n"', "Ærø"][k % 5]
        rows.append(f"{k},2024-12-25T00:{k % 60:02d}:00,{k}.5,{-k},{'' if k % 7 == 0 else k},{' ' if k % 3 == 0 else k},{name}\n")
    return (HEADER + "".join(rows)).encode() + b"900,2024-12-25 01:00:00,1,2,3,4,\xff\xfe\n" + b"901,2024-12-25 01:00:00,1,2,3,4,last"


@pytest.mark.parametrize("split", [1 << 20, 1000, 307])
@pytest.mark.parametrize("mode", ["strict", "lenient"])
def test_any_split_gives_the_same_records(spark, tmp_path, split, mode):
    (tmp_path / "a.csv").write_bytes(content())
    (tmp_path / "b.csv").write_bytes(HEADER.encode() + b'5,2024-12-25 00:00:00,1,2,3,4,"unclosed\n')
    (tmp_path / "empty.csv").write_bytes(b"")
    got, bad = ais.read(spark, f"file://{tmp_path}", mode, split_bytes=split)
    text = content().decode("utf-8", "ignore" if mode == "lenient" else "replace")
    want = [r for r in csv.DictReader(io.StringIO(text, newline="")) if mode == "lenient" or "\ufffd" not in r["Name"]]
    rows = sorted(tuple(r)[:3] for r in got.collect())
    assert rows == sorted([(int(r["MMSI"]), 1735084800.0 + int(r["BaseDateTime"][11:13]) * 3600 + int(r["BaseDateTime"][14:16]) * 60, float(r["LAT"])) for r in want] + [(5, 1735084800.0, 1.0)])
    assert [(r["reason"], r["line"][:4]) for r in bad.collect()] == ([("not UTF-8", "900,")] if mode == "strict" else [])


def test_reasons_and_blanks(spark, tmp_path):
    lines = ["1,2024-12-25 00:00:00,1,2,,,x", "1,2024-12-25 00:00:00,1,2, ,3,x", "1,2024-12-25 00:00:00,1,2,3, ,x", "x,2024-12-25 00:00:00,1,2,3,4,x", "1,2024-13-25 00:00:00,1,2,3,4,x", "1,2024-12-25,1,2,3,4,x", "1,2024-12-25 00:00:00,,2,3,4,x", "1,2024-12-25 00:00:00,1", "1,2024-12-25 00:00:00,1,nan,3,4,x", "1,2024-12-25 00:00:00,1,2,3,east,x", "", "1,2024-12-25 00:00:00,1,2,3,4,x,more,fields"]
    (tmp_path / "c.csv").write_text("\ufeff" + HEADER + "\r\n".join(lines))
    got, bad = ais.read(spark, str(tmp_path / "c.csv"))
    assert sorted(tuple(r)[4:] for r in got.collect()) == [(0.0, 0.0), (3.0, 0.0), (3.0, 4.0)]
    reasons = [r["reason"] for r in bad.orderBy("place").collect()]
    assert reasons == ["SOG is no number", "MMSI is no number", "BaseDateTime is no time", "BaseDateTime is no time", "LAT is no number", "LON is no number", "LON is no number", "COG is no number"]
    assert ais.read(spark, str(tmp_path / "c.csv"), "lenient")[0].count() == 4
    with pytest.raises(Exception, match="mode must be one of"):
        ais.read(spark, str(tmp_path / "c.csv"), "odd")[0].count()
