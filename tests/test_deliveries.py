"""Workbooks made here and read back; delivered tables; the decision log with two writers."""

import os
import threading
import zipfile
from datetime import date
from xml.sax.saxutils import escape

import pytest

from tideglass.sources import decisions as dec
from tideglass.sources import intake
from tideglass.sources import workbook as wb

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def letters(n):
    out = ""
    while n >= 0:
        out, n = chr(65 + n % 26) + out, n // 26 - 1
    return out


def write(path, sheets, inline=False):
    """A minimal workbook; texts are shared or inline, None leaves a cell out."""
    shared = []

    def cell(r, c, v):
        at = f'r="{letters(c)}{r}"'
        if isinstance(v, str) and inline:
            return f'<c {at} t="inlineStr"><is><t>{escape(v)}</t></is></c>'
        if isinstance(v, str):
            shared.append(v)
            return f'<c {at} t="s"><v>{len(shared) - 1}</v></c>'
        return f"<c {at}><v>{v!r}</v></c>"

    with zipfile.ZipFile(path, "w") as z:
        names = list(sheets)
        z.writestr("xl/workbook.xml", f"<workbook {NS}><sheets>{''.join(f'<sheet name={chr(34)}{escape(n)}{chr(34)} sheetId={chr(34)}{i}{chr(34)} r:id={chr(34)}rId{i}{chr(34)}/>' for i, n in enumerate(names, 1))}</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f"<Relationships xmlns='http://schemas.openxmlformats.org/package/2006/relationships'>{''.join(f'<Relationship Id={chr(34)}rId{i}{chr(34)} Target={chr(34)}worksheets/sheet{i}.xml{chr(34)}/>' for i in range(1, len(names) + 1))}</Relationships>")
        for i, n in enumerate(names, 1):
            rows = "".join(f'<row r="{r}">{"".join(cell(r, c, v) for c, v in enumerate(row) if v is not None)}</row>' for r, row in enumerate(sheets[n], 1) if row)
            z.writestr(f"xl/worksheets/sheet{i}.xml", f"<worksheet {NS}><sheetData>{rows}</sheetData></worksheet>")
        if shared:
            z.writestr("xl/sharedStrings.xml", f"<sst {NS}>{''.join(f'<si><r><t>{escape(s[:2])}</t></r><r><t>{escape(s[2:])}</t></r></si>' for s in shared)}</sst>")


def serial(d):
    return (d - date(1899, 12, 30)).days


def monthly(extra=None):
    months = [date(2000 + k // 12, k % 12 + 1, 28) for k in range(40)]
    rows = [["Returns & more"], [], ["Date", None, "Excess return of all", "Spot return of all", *(extra or [])]]
    return rows + [[serial(m) if k % 2 else m.isoformat(), None, 0.01 * k, None if k == 5 else -0.5] for k, m in enumerate(months)] + [["note", None, "n/a", 1.0]]


@pytest.mark.parametrize("inline", [False, True])
def test_round_trip(spark, tmp_path, inline):
    os.makedirs(tmp_path / "deep")
    sheets = {"One <1>": [["a & b", 1, None, 2.5], [], [None] * 27 + ["far"]], "Two": [["x"]]}
    write(tmp_path / "a.xlsx", sheets, inline)
    write(tmp_path / "deep" / "b.xlsx", {"S": [[i, f"t{i}"] for i in range(500)]}, inline)
    (tmp_path / "c.csv").write_text("no workbook")
    (tmp_path / "~open.xlsx").write_text("no workbook")
    wb.register(spark)
    df = spark.read.format("xlsx").load(str(tmp_path))
    assert df.rdd.getNumPartitions() == 2
    got = {(os.path.basename(r.file), r.sheet, r.row): r.cells for r in df.collect()}
    assert got["a.xlsx", "One <1>", 1] == ["a & b", "1", None, "2.5"] and got["a.xlsx", "One <1>", 3][26:] == [None, "far"] and ("a.xlsx", "One <1>", 2) not in got
    assert len(got) == 503 and got["b.xlsx", "S", 500] == ["499", "t499"]
    assert spark.read.format("xlsx").option("sheet", "Two").load(str(tmp_path / "a.xlsx")).count() == 1
    os.remove(tmp_path / "~open.xlsx")
    same = wb.workbook_rows(spark, f"{tmp_path}/*")
    assert sorted(same.select("sheet", "row", "cells").where("sheet <> 'S'").collect(), key=repr) == sorted(df.select("sheet", "row", "cells").where("sheet <> 'S'").collect(), key=repr)


def test_series_by_header(spark, tmp_path):
    write(tmp_path / "m.xlsx", {"Monthly": monthly()})
    wb.register(spark)
    rows = spark.read.format("xlsx").load(str(tmp_path / "m.xlsx"))
    codes = {"excess": "Excess return of", "spot": "Spot return of"}
    got = {(r.code, r.date): r.value for r in wb.series_by_header(rows, codes).collect()}
    assert len(got) == 79 and got["excess", date(2000, 3, 1)] == 0.02 and ("spot", date(2000, 6, 1)) not in got and got["spot", date(2003, 4, 1)] == -0.5
    for extra, prefixes, said in ((["Spot return of all, twice"], codes, "2 headers begin with 'Spot return of'"), (None, {"x": "Volume"}, "0 headers"), (["Empty"], {**codes, "e": "Empty"}, "no numbers for e")):
        write(tmp_path / "bad.xlsx", {"Monthly": monthly(extra)})
        with pytest.raises(wb.LayoutError, match=said):
            wb.series_by_header(spark.read.format("xlsx").load(str(tmp_path / "bad.xlsx")), prefixes)


def test_deliveries(spark):
    vendor = [("2020-01-01", None), ("2020-02-15", 1.5), ("2020-03-31", -2.0)]
    frame = lambda rows: spark.createDataFrame(rows, "date string, total_return_pct double")
    assert sorted(map(tuple, intake.monthly_drop(frame(vendor)).collect())) == [("2020-02", 0.015), ("2020-03", -0.02)]
    for rows, said in (([*vendor, ("2020-02-01", 1.0)], "twice: 2020-02"), (vendor[:1], "no observations")):
        with pytest.raises(intake.IntakeError, match=said):
            intake.monthly_drop(frame(rows))
    with pytest.raises(intake.IntakeError, match="no column date"):
        intake.monthly_drop(frame(vendor).drop("date"))
    payload = lambda rows: spark.createDataFrame(rows, "indexId int, indexData array<struct<QUARTER:string,TWR:double>>")
    good = [(1, [("2019Q4", 0.1), ("2020Q1", None), ("2020Q2", 0.2)]), (2, [("2020Q1", 0.3)])]
    got = intake.indexed_drop(payload(good), {"1": "buyout", "2": "growth"}, {"buyout": "2020Q1"})
    assert sorted(map(tuple, got.collect())) == [("2020Q1", "growth", 0.3), ("2020Q2", "buyout", 0.2)]
    for rows, said in (([*good, (9, [])], "weren't asked for: 9"), ([(1, [(None, 0.1)])], "1 observations without a quarter"), ([(1, [("2020Q1", None)])], "no observations")):
        with pytest.raises(intake.IntakeError, match=said):
            intake.indexed_drop(payload(rows), {"1": "buyout", "2": "growth"}, {})
    drop = spark.createDataFrame([("2020Q3", "a", "0.5"), ("2020-11", "a", "1"), ("2021", "b", "x"), ("soon", "b", "1"), (None, "b", "1")], "period string, strategy string, ret string")
    assert sorted(map(tuple, intake.series_frames(drop, "desk", "strategy").collect())) == [("desk.a", date(2020, 7, 1), 0.5), ("desk.a", date(2020, 11, 1), 1.0)]
    assert {r.series_id for r in intake.series_frames(drop, "desk").collect()} == {"desk"} and intake.series_frames(drop.drop("ret"), "desk").collect() == []


def test_decision_log(spark, tmp_path):
    log = dec.DecisionLog(spark, f"file:{tmp_path}/log", ["hold", "sell"])
    log.start("s", [2, 5], 8, "t0")
    with pytest.raises(dec.DecisionError, match="not revealed"):
        log.decide("s", 2, "hold", "t1")
    log.reveal("s", 3, "t1")
    for args, said in (((5, "hold"), "out of order"), ((3, "hold"), "not a window"), ((2, "buy"), "unknown action")):
        with pytest.raises(dec.DecisionError, match=said):
            log.decide("s", *args, "t2")
    log.decide("s", 2, "sell", "t2", "because")
    with pytest.raises(dec.DecisionError, match="already decided"):
        log.decide("s", 2, "hold", "t3")
    for month, said in ((2, "revealed up to 3 already"), (7, "beyond 6")):
        with pytest.raises(dec.DecisionError, match=said):
            log.reveal("s", month, "t3")
    log.reveal("s", 6, "t3")
    log.decide("s", 5, "hold", "t4")
    assert log.state("s")["ceiling"] == 8 and log.state("s")["active"] and log.state("s")["decided"] == {2: "sell", 5: "hold"}
    log.reveal("s", 8, "t5")
    assert not log.state("s")["active"]
    rows = log.read().orderBy("seq").collect()
    assert [r.seq for r in rows] == list(range(6)) and {r.session for r in rows} == {"s"} and rows[2].note == "because" and rows[0].kind == "start"
    with pytest.raises(KeyError):
        log.state("nobody")
    with pytest.raises(dec.DecisionError, match="written by another"):
        log.start("s", [1], 2, "t6")
    os.remove(f"{tmp_path}/log/session=s/000000000001.json")
    with pytest.raises(dec.DecisionError, match="missing"):
        log.state("s")


def test_two_writers_of_one_entry(spark, tmp_path):
    log = dec.DecisionLog(spark, f"file:{tmp_path}/log", ["hold", "sell"])
    log.start("s", [0], 1, "t")
    log.reveal("s", 1, "t")
    gate, told = threading.Barrier(2), []

    def writer(action):
        own = dec.DecisionLog(spark, f"file:{tmp_path}/log", ["hold", "sell"])
        seq = own.state("s")["next"]
        gate.wait()
        try:
            own._place("s", seq, {"seq": seq, "kind": "decide", "month": 0, "action": action, "at": "t"})
            told.append(action)
        except dec.DecisionError as e:
            told.append(str(e))

    threads = [threading.Thread(target=writer, args=(a,)) for a in ("hold", "sell")]
    for th in threads:
        th.start()
    for th in threads:
        th.join(60)
    won = [t for t in told if t in ("hold", "sell")]
    assert len(told) == 2 and len(won) == 1 and "s: entry 2 was written by another" in told and log.state("s")["decided"] == {0: won[0]}
    assert not os.listdir(f"{tmp_path}/log/_aside")


def test_judged_logs(spark):
    windows = spark.createDataFrame([("a", [1, 3], 5), ("b", [0], 2), (None, [0], 1), ("idle", [4], 9)], "session string, windows array<long>, months long")
    asks = [("a", 1, 3, "hold"), ("a", 2, 1, "jump"), ("a", 3, 1, "hold"), ("a", 4, 1, "hold"), ("a", 5, 2, "hold"), ("a", 6, 3, "hold"), ("b", 1, None, "hold"), ("b", 2, 0, None), ("c", 1, 0, "hold"), (None, 1, 0, "hold")]
    got = dec.judged(spark.createDataFrame(asks, "session string, seq int, month long, action string"), windows, ["hold"])
    faults = {(r.session, r.seq): r.fault for r in got.collect()}
    assert faults == {("a", 1): "out of order", ("a", 2): "unknown action", ("a", 3): None, ("a", 4): "already decided", ("a", 5): "not a window", ("a", 6): None, ("b", 1): "not a window", ("b", 2): "unknown action", ("c", 1): "not a window", (None, 1): None}
    assert {r.session: tuple(r)[1:] for r in dec.ceilings(got, windows).collect()} == {"a": (2, None, 5), "b": (0, 0, 1), None: (1, None, 1), "idle": (0, 4, 5)}
