import math

import exports
import pytest
from pyspark.sql import functions as F

from aeroframe.model import Moment, Scale
from aeroframe.operators.series import Series1D
from aeroframe.operators.sizes import Series2D
from aeroframe.sources import sniff
from aeroframe.sources.files import list_files, load, load_folder, nested_files

CASES = {
    "aethalometer": ("aethalometer", exports.aethalometer, 5, "2024-03-01 10:00:00", Series1D),
    "cpc focused": ("cpc", exports.cpc_focused, 5, "2024-03-01 10:00:01", Series1D),
    "cpc full": ("cpc", exports.cpc_full, 5, "2024-03-01 10:00:00", Series1D),
    "discmini": ("discmini", exports.discmini, 5, "2024-03-01 10:00:00", Series1D),
    "elpi": ("elpi", exports.elpi, 5, "2024-03-01 10:00:00.5", Series2D),
    "elpi density": ("elpi", lambda: exports.elpi(1.4), 5, "2024-03-01 10:00:00.5", Series2D),
    "fmps danish": ("fmps", exports.fmps, 5, "2024-03-01 10:00:00", Series2D),
    "fmps english": ("fmps", lambda: exports.fmps(True), 5, "2024-03-01 10:00:00", Series2D),
    "fourtec": ("fourtec", exports.fourtec, 5, "2024-03-01 10:00:00", Series1D),
    "grimm software": ("grimm", exports.grimm_soft, 5, "2024-03-01 10:00:00", Series2D),
    "grimm instrument": ("grimm", exports.grimm_inst, 5, "2024-03-01 00:00:00", Series2D),
    "nanoscan": ("nanoscan", exports.nanoscan, 5, "2024-03-01 10:00:00", Series2D),
    "opcn3": ("opcn3", exports.opcn3, 4, "2024-03-01 10:00:01", Series2D),
    "ops direct": ("ops", exports.ops_direct, 5, "2024-03-01 10:00:00", Series2D),
    "ops software": ("ops", exports.ops_aim, 5, "2024-03-01 10:00:00", Series2D),
    "partector": ("partector", exports.partector, 8, "2024-03-01 10:00:00", Series1D),
    "smps": ("smps", exports.smps, 5, "2024-03-01 10:00:00", Series2D),
}


@pytest.fixture()
def write(tmp_path):
    def put(text, name="a.txt", encoding="utf-8"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text.encode(encoding))
        return f"file://{path}"

    return put


@pytest.mark.parametrize("case", CASES)
def test_dialect(spark, write, case):
    dialect, text, rows, first, kind = CASES[case]
    made = load(spark, write(text()), dialect, extra_data=True)
    assert isinstance(made, kind)
    assert made.df.count() == rows
    assert str(made.df.agg(F.min("ts").cast("string")).first()[0]) == first
    if kind is Series2D:
        assert made.meta.moment is Moment.NUMBER and made.meta.scale is Scale.NONE
        assert len(made.bin_edges) == len(made.bin_mids) + 1
        row = made.df.orderBy("ts").first()
        assert row.total_conc == pytest.approx(sum(row[c] or 0 for c in made.bins.columns))


def test_values_of_some_dialects(spark, write):
    a = load(spark, write(exports.aethalometer()), "aethalometer")
    assert a.df.orderBy("ts").first().asDict() | {"ts": None} == {"ts": None, "ir_bcc": 100.0, "biomass_bcc": 10.0, "fossil_fuel_bcc": 90.0, "aae": 1.0}
    assert (a.serial_number, a.meta.extra["optical_config"], a.unit) == ("MA-1", "DUAL", "ng/m³")
    c = load(spark, write(exports.cpc_focused()), "cpc")
    assert [r.total_conc for r in c.df.orderBy("ts").collect()] == [1000, 1001, 1003, 1004, 1005]
    n = load(spark, write(exports.nanoscan()), "nanoscan")
    width = math.log10(n.bin_edges[3]) - math.log10(n.bin_edges[2])
    assert n.df.orderBy("ts").first().bin_002 == pytest.approx(2 * width) and n.density == 1.2 and n.serial_number == "N55"
    o = load(spark, write(exports.opcn3()), "opcn3")
    assert o.df.orderBy("ts").first().bin_003 == pytest.approx(3 / (2 * 5))
    g = load(spark, write(exports.grimm_soft()), "grimm")
    assert g.df.orderBy("ts").first().bin_001 == pytest.approx(0.2)


def test_direct_counts_use_the_first_sixteen_bins(spark, write):  # T5, T6
    s = load(spark, write(exports.ops_direct()), "ops", extra_data=True)
    row = s.df.orderBy("ts").first()
    assert row.bin_000 == pytest.approx(100 / (16.67 * 58)) and row.bin_015 == pytest.approx(25 / (16.67 * 58))
    assert s.density == 1.5 and "Bin 17" in s.extra_data.columns
    assert s.df.where("total_conc = 0 and bin_000 is null").count() == 1  # no live time
    assert s.convert("dW").df.count() == 5


def test_elpi_edges_follow_density(spark, write):
    plain, dense = load(spark, write(exports.elpi(), "p.txt"), "elpi"), load(spark, write(exports.elpi(1.4), "d.txt"), "elpi")
    assert plain.bin_edges[0] == 8.0 and dense.bin_edges[1] == pytest.approx(math.sqrt(10 * 16), abs=0.06)
    assert dense.bin_edges[0] == pytest.approx(dense.bin_edges[1] ** 2 / dense.bin_edges[2], abs=0.1)


def test_mass_is_known_by_either_name(spark, write):  # T7
    text = exports.smps().replace("Weight,Number", "Weight,Mass")
    s = load(spark, write(text), "smps")
    assert s.meta.moment is Moment.NUMBER and s.df.where("total_conc > 0").count() == 5


def test_plain_distribution_is_not_scaled(spark, write):  # T2b
    text = exports.smps().replace("Units,dW/dlogDp", "Units,dW")
    assert load(spark, write(text), "smps").df.orderBy("ts").first().bin_001 == 10.0


def test_partector_sample(spark, write):
    s = load(spark, write(exports.partector()), "partector")
    (sample,) = s.meta.extra["tem_samples"]
    assert sample["sample_vol_ml"] == pytest.approx(0.5 * 1000 * 3) and sample["rising_edges"] == 1
    with pytest.raises(ValueError, match="fewer than two"):
        load(spark, write(exports.partector(False), "b.txt"), "partector")


def test_errors(spark, write):
    with pytest.raises(ValueError, match="neither export"):  # T18
        load(spark, write("a;b\n" + "1;2\n" * 30), "grimm")
    with pytest.raises(ValueError, match="raw"):
        load(spark, write("Raw data,a,b\n" + "1,2,3\n" * 30), "fmps")
    with pytest.raises(ValueError, match="no delimiter"):
        load(spark, write("abc\n" * 5), "ops")
    with pytest.raises(ValueError, match="not a workbook"):
        load(spark, write("x", "none.xlsx"), "fourtec")
    with pytest.raises(ValueError, match="no line"):
        load(spark, write("", "empty.csv"), "ops")
    with pytest.raises(FileNotFoundError):
        load(spark, "/no/such/file.csv", "ops")
    with pytest.raises(ValueError, match="unknown dialect"):
        load(spark, write("a,b\n1,2\n3,4\n5,6"), "abacus")


def test_folder(spark, tmp_path, write):  # T12, T13, J4
    write(exports.ops_direct("10:02:00"), "b.csv")
    write(exports.ops_direct("10:00:00"), "a.csv")
    write(exports.ops_direct("11:00:00", serial="other"), "c.csv")
    write("not,an,export\n" * 5, "d.csv")
    write(exports.ops_direct("12:00:00"), "sub/e.csv")
    s = load_folder(spark, f"file://{tmp_path}", "ops")
    assert s.df.count() == 7 and s.serial_number == "3330"
    at = s.df.where("ts = timestamp_ntz'2024-03-01 10:02:00'").first()
    assert at.bin_000 == pytest.approx(102 / (16.67 * 58))  # the earlier file's row
    assert load_folder(spark, f"file://{tmp_path}", "ops", max_subfolder=1).df.count() == 12
    assert load_folder(spark, f"file://{tmp_path}", "ops", check=()).df.count() == 12
    assert len(list_files(spark, f"file://{tmp_path}", "e.csv", 1)) == 1
    assert [len(g) for g in nested_files(spark, f"file://{tmp_path}", "", 1)] == [4, 1]
    with pytest.raises(ValueError, match="no file"):
        load_folder(spark, f"file://{tmp_path}", "smps", "d.csv")
    with pytest.raises(FileNotFoundError):
        list_files(spark, f"file://{tmp_path}/none")


def test_folder_can_keep_all_rows_of_one_time(spark, tmp_path, write):
    write(exports.ops_direct("10:00:00"), "a.csv")
    write(exports.ops_direct("10:02:00"), "b.csv")
    write(exports.ops_direct("10:03:00"), "c.csv", encoding="utf-16")  # read by a scan of its own
    s = load_folder(spark, f"file://{tmp_path}", "ops", extra_data=True, keep_all=True)
    rows = s.df.collect()
    assert [r.ts for r in rows] == sorted(r.ts for r in rows)
    assert [round(r.bin_000 * 16.67 * 58) for r in rows if r.ts.minute == 4] == [104, 102, 101]  # by files
    assert s.df.count() == s.extra_data.count() == s.original_data.count() == 15
    assert load_folder(spark, f"file://{tmp_path}", "ops", extra_data=True).extra_data.count() == 8


def test_folder_is_in_order_of_time(spark, tmp_path, write):
    write(exports.ops_direct("12:00:00"), "a 100%.csv")
    write(exports.ops_direct("10:00:00"), "b.csv", encoding="utf-16")
    write(exports.ops_direct("11:00:00").replace("note 9,x", "note 9,ä"), "c.csv", encoding="latin-1")
    s = load_folder(spark, f"file://{tmp_path}", "ops", extra_data=True)
    times = [r.ts for r in s.df.collect()]
    assert times == sorted(times) and len(times) == 15
    assert s.extra_data.count() == 15 and not {"file_seq", "row_seq"} & {*s.extra_data.columns, *s.df.columns}


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_places_of_lines_in_split_files(spark, write, end):
    """Small splits: the places of lines, the footer and times by place come out the same."""
    text = exports.cpc_focused()
    body = [f"t{i},{i},0,0" for i in range(3000)]
    lines = text.split("\n")
    path = write(end.join([*lines[:15], *body, *lines[-3:]]), "long.txt")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        got = load(spark, path, "cpc").df.orderBy("ts").collect()
        assert spark.read.text(path).rdd.getNumPartitions() > 4
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.total_conc for r in got] == list(range(3000))
    assert all((r.ts - got[0].ts).total_seconds() == i for i, r in enumerate(got))


def test_own_loader(spark, write):
    from aeroframe.model import SeriesMeta
    from aeroframe.sources.dialects import Layout

    def mine(head):
        return Layout(head.cells(0), 1, "try_to_timestamp(c0, 'yyyy-MM-dd')", SeriesMeta("Mine", head.cells(0)[1]), {"total_conc": "try_cast(c1 as double)"})

    path = write("day,S1\n2024-01-02,2\n2024-01-01,1\n2024-01-03,3\n")
    assert load(spark, path, mine).serial_number == "S1"
    assert [r.total_conc for r in load_folder(spark, path.rsplit("/", 1)[0], mine).df.collect()] == [1, 2, 3]


def test_samples_of_a_folder(spark, tmp_path, write):
    write(exports.partector(), "a.txt")
    write(exports.partector(False), "b.txt")
    write(exports.partector().replace("01.03.2024", "02.03.2024"), "c.txt")
    s = load_folder(spark, f"file://{tmp_path}", "partector")
    assert s.df.count() == 16 and [x["sample_vol_ml"] for x in s.meta.extra["tem_samples"]] == pytest.approx([1500, 1500])


def test_units_are_read_at_their_places(spark, write):
    g = load(spark, write(exports.grimm_soft()), "grimm")  # other lines say g/m and /l, too
    assert g.serial_number == "G12 particles/l" and g.meta.extra["location"] == "Hall /l"
    assert load(spark, write(exports.grimm_inst(), "b.txt"), "grimm").bin_edges[-2:] == (32_000.0, 34_000.0)
    mass = load(spark, write(exports.grimm_soft().replace(" particles/l", " µg/m3"), "c.txt"), "grimm").df.orderBy("ts").first()
    assert mass.bin_000 == pytest.approx(1000 / (math.pi / 6 * (375 / 1e7) ** 3 * 1e12))


def test_workbook_is_read_like_its_text(spark, tmp_path):
    """Dates and times of cells, gaps between rows and cells, and a serial number at its place."""
    import datetime as dt

    from aeroframe.sources.workbook import write_workbook

    rows = [[f"h{k}" for k in range(5)], ["a", "b", "F99", None, None], *([["x"] * 5] * 5), ["Date", "Time", "Temp", "Dew", "RH"]]
    rows += [[dt.date(2024, 3, 1), f"10:00:0{i}", 20.5 + i, 9, 40 + i] for i in range(4)]
    with open(tmp_path / "book.xlsx", "wb") as out:
        write_workbook(out, [f"h{k}" for k in range(5)], rows)
    s = load(spark, f"{tmp_path}/book.xlsx", "fourtec")
    assert s.serial_number == "F99" and [(str(r.ts), r.temperature, r.rh) for r in s.df.orderBy("ts").collect()] == [(f"2024-03-01 10:00:0{i}", 20.5 + i, 40.0 + i) for i in range(4)]
    with open(tmp_path / "more.xlsx", "wb") as out:
        write_workbook(out, [f"h{k}" for k in range(5)], [*rows[:8], [dt.date(2024, 3, 2), "10:00:00", 1.5, 9, 50]])
    both = load_folder(spark, str(tmp_path), "fourtec")
    assert both.df.count() == 5 and both.df.orderBy("ts").collect()[-1].rh == 50


FOREIGN = {
    "[Content_Types].xml": "<Types/>",
    "xl/workbook.xml": '<w:workbook xmlns:w="u" xmlns:r="v"><w:sheets><w:sheet name="B" sheetId="2" r:id="k2"/><w:sheet name="A" sheetId="1" r:id="k1"/></w:sheets></w:workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="k1" Target="worksheets/other.xml"/><Relationship Id="k2" Target="/xl/worksheets/one.xml"/></Relationships>',
    "xl/sharedStrings.xml": '<s:sst xmlns:s="u"><s:si><s:t>plain &amp; simple</s:t></s:si><s:si><s:r><s:t>two </s:t></s:r><s:r><s:t>runs</s:t></s:r><s:rPh><s:t>reading</s:t></s:rPh></s:si></s:sst>',
    "xl/styles.xml": '<s xmlns="u"><numFmts><numFmt numFmtId="170" formatCode="[Red]&quot;day&quot; 0.0"/><numFmt numFmtId="171" formatCode="hh:mm"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs></s>',
    "xl/worksheets/one.xml": '<x:worksheet xmlns:x="u"><x:sheetData><x:row r="2"><x:c r="B2" t="s"><x:v>1</x:v></x:c><x:c r="D2" s="1"><x:v>45352</x:v></x:c><x:c r="E2" s="2"><x:v>7.5</x:v></x:c><x:c r="AB2" s="3"><x:v>0.75</x:v></x:c></x:row><x:row r="4"><x:c t="s"><x:v>0</x:v></x:c><x:c t="b"><x:v>1</x:v></x:c><x:c t="str"><x:f>A1</x:f><x:v>said</x:v></x:c><x:c t="e"><x:v>#N/A</x:v></x:c><x:c s="1"><x:v>45352.5</x:v></x:c><x:c t="inlineStr"><x:is><x:t>in_x0041_line</x:t></x:is></x:c></x:row></x:sheetData></x:worksheet>',
    "xl/worksheets/other.xml": "<worksheet><sheetData/></worksheet>",
}


def test_workbook_as_other_programs_write_it(tmp_path):
    import datetime as dt
    import io
    import zipfile

    from aeroframe.sources.workbook import read_sheet, sheets

    made = io.BytesIO()
    with zipfile.ZipFile(made, "w") as book:
        for name, text in FOREIGN.items():
            book.writestr(name, text)
    rows = list(read_sheet(made.getvalue()))
    assert sheets(made.getvalue()) == ["B", "A"] and list(read_sheet(made.getvalue(), 1)) == []
    assert rows[0] == rows[2] == [] and rows[1][:5] == [None, "two runs", None, dt.datetime(2024, 3, 1), "7.5"] and rows[1][27] == dt.time(18) and len(rows[1]) == 28
    assert rows[3] == ["plain & simple", True, "said", None, dt.datetime(2024, 3, 1, 12), "inAline"]
    with pytest.raises(ValueError, match="not a workbook"):
        list(read_sheet(b"PK"))


def test_paths_in_any_spelling(spark, tmp_path, write, monkeypatch):
    """Relative, doubled and roundabout paths, and signs that patterns use, give the rows; nothing is lost without an error."""
    write(exports.ops_direct(), "sub/a [1] {x}*.csv")
    monkeypatch.chdir(tmp_path)
    spark.sparkContext._jvm.java.lang.System.setProperty("user.dir", str(tmp_path))
    for path in (f"{tmp_path}/sub/a [1] {{x}}*.csv", f"{tmp_path}//sub///a [1] {{x}}*.csv", f"{tmp_path}/none/../sub/a [1] {{x}}*.csv", f"file://{tmp_path}/sub/a [1] {{x}}*.csv"):
        assert load(spark, path, "ops").df.count() == 5
    assert load_folder(spark, f"{tmp_path}//sub/../sub/", "ops").df.count() == 5


@pytest.mark.parametrize("split", [None, 20_000])
def test_encoding_is_that_of_the_whole_file(spark, write, split):
    """The first byte that isn't UTF-8 comes long after the first lines."""
    rows = [f"2024-01-{1 + i // 1440:02d} {i // 60 % 24:02d}:{i % 60:02d}:00,{i},{'mål' if i == 19_990 else 'x'}" for i in range(20_000)]
    text = "\n".join(["t,v,note", *rows])

    def mine(head):
        from aeroframe.model import SeriesMeta
        from aeroframe.sources.dialects import Layout

        return Layout(head.cells(0), 1, "try_to_timestamp(c0, 'yyyy-MM-dd HH:mm:ss')", SeriesMeta("Mine"), {"total_conc": "try_cast(c1 as double)"}, extra={"note": "c2"})

    if split:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        for encoding in ("latin-1", "utf-8"):
            s = load(spark, write(text, f"{encoding}.csv", encoding), mine, extra_data=True)
            assert [r.note for r in s.extra_data.where("note <> 'x'").collect()] == ["mål"] and s.df.count() == 20_000
    finally:
        if split:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_bins_of_other_sizes_stay_apart(spark, tmp_path, write):
    text = exports.ops_direct("10:00:00")
    up = text
    for k in range(17):
        up = up.replace(f"Bin {k + 1} Cut Point (um),{0.3 * 1.25**k:.3f}", f"Bin {k + 1} Cut Point (um),{0.3 * 1.25 ** (k + 10):.3f}")
    write(text, "a.csv")
    write(up.replace("10:00:00", "12:00:00"), "b.csv")
    s = load_folder(spark, f"file://{tmp_path}", "ops")
    assert len(s.bin_mids) == 26 and s.df.count() == 10
    first, last = s.df.where("hour(ts) = 10").orderBy("ts").first(), s.df.where("hour(ts) = 12").orderBy("ts").first()
    assert first.bin_000 == last.bin_010 == pytest.approx(100 / (16.67 * 58)) and first.bin_015 == last.bin_025
    assert last.bin_000 is None and first.bin_025 is None and last.total_conc == pytest.approx(first.total_conc)
    assert s.convert("dV").df.where("hour(ts) = 12").orderBy("ts").first().bin_025 > 0 and s.psd().count() == 26

    far = text.replace("10:00:00", "13:00:00")
    for k in range(17):
        far = far.replace(f"Bin {k + 1} Cut Point (um),{0.3 * 1.25**k:.3f}", f"Bin {k + 1} Cut Point (um),{0.9 * 1.25**k:.3f}")
    write(far, "c.csv")
    with pytest.raises(ValueError, match="overlap"):
        load_folder(spark, f"file://{tmp_path}", "ops")
    assert load_folder(spark, f"file://{tmp_path}", "ops", overlapping=True).df.count() == 15


def test_bins_with_gaps():
    from aeroframe.functions.physics import share_below
    from aeroframe.model import Bins, common_bins

    low, high = Bins.arithmetic((100.0, 200.0, 400.0)), Bins.arithmetic((800.0, 1200.0))
    both = common_bins([high, low])
    assert both.spans == ((100.0, 200.0), (200.0, 400.0), (800.0, 1200.0)) and both.mids == (150.0, 300.0, 1000.0)
    assert share_below(both, 1000.0) == [1, 1, 0.5] and both.widths(Scale.LINEAR) == [100, 200, 400]
    assert common_bins([low, Bins.arithmetic((400.0, 800.0)), high]).pairs is None  # no gap is left
    with pytest.raises(ValueError, match="overlap"):
        common_bins([low, Bins.arithmetic((150.0, 250.0))])


def test_many_small_files_take_no_call_each(spark, tmp_path, monkeypatch):
    from py4j.java_gateway import GatewayClient

    for k in range(300):
        (tmp_path / f"f{k:03d}.csv").write_text(f"t,v\n2024-01-01 {k // 60:02d}:{k % 60:02d}:00,{k}\n2023-01-01 {k // 60:02d}:{k % 60:02d}:00,{k}\n2022-01-01 {k // 60:02d}:{k % 60:02d}:00,{k}\n")

    def mine(head):
        from aeroframe.model import SeriesMeta
        from aeroframe.sources.dialects import Layout

        return Layout(head.cells(0), 1, "try_to_timestamp(c0, 'yyyy-MM-dd HH:mm:ss')", SeriesMeta("Mine"), {"total_conc": "try_cast(c1 as double)"})

    calls = []
    send = GatewayClient.send_command

    def counted(self, command, *a, **k):
        if not command.startswith("m"):  # not what the collector of garbage sends
            calls.append(command)
        return send(self, command, *a, **k)

    monkeypatch.setattr(GatewayClient, "send_command", counted)
    load_folder(spark, str(tmp_path), mine, search_word="f00")
    few = len(calls)
    calls.clear()
    s = load_folder(spark, str(tmp_path), mine)
    assert len(calls) < few + 100 and s.df.count() == 900


def test_sniff():  # T14
    assert sniff.decode("ä,b".encode())[1] == "UTF-8"
    assert sniff.decode("ä,b".encode("latin-1")) == ("ä,b", "ISO-8859-1")
    assert sniff.decode(b"\xff\xfe" + "ä".encode("utf-16-le")) == ("ä", "UTF-16LE")
    assert sniff.delimiter("# x;y\na;b;c\n1;2;3\n4;5;6\n7;8;9") == ";"
    assert sniff.delimiter("x,y\na\tb\n1\t2\n3\t4") == "\t"
    with pytest.raises(ValueError):
        sniff.delimiter("a\nb")


def test_sinks(spark, tmp_path):
    from aeroframe.sources.sinks import save_table

    df = spark.createDataFrame([("a", 1.5), ("b", None)], "segment string, mean double")
    for name in ("s.csv", "s.json", "s.parquet"):
        save_table(df, f"file://{tmp_path}/{name}")
    assert spark.read.csv(f"file://{tmp_path}/s.csv", header=True, schema=df.schema).exceptAll(df).count() == 0
    assert spark.read.json(f"file://{tmp_path}/s.json", schema=df.schema).exceptAll(df).count() == 0
    assert spark.read.parquet(f"file://{tmp_path}/s.parquet").exceptAll(df).count() == 0
    with pytest.raises(ValueError, match="old binary"):
        save_table(df, "s.xls")


def test_workbook_sink(spark, tmp_path):
    """Further sheets where one is full, nothing cut off, and kinds of cells kept."""
    import datetime as dt

    from aeroframe.sources.sinks import save_table
    from aeroframe.sources.workbook import read_sheet, sheets

    rows = [(i, i / 7, f"a<&>\"{i}\x01_x0041_ ;", dt.datetime(2024, 3, 1, 10, 0, i % 60, 250_000), dt.date(1999, 12, 31), i % 2 == 0, None) for i in range(25)]
    df = spark.createDataFrame(rows, "n long, x double, said string, at timestamp_ntz, day date, even boolean, none string")
    path = f"{tmp_path}/s.xlsx"
    save_table(df.repartition(3).orderBy("n"), path, sheet_rows=11)
    content = open(path, "rb").read()
    assert sheets(content) == ["Sheet1", "Sheet2", "Sheet3"]
    got = []
    for k in range(3):
        top, *own = read_sheet(content, k)
        assert top == df.columns and len(own) == [10, 10, 5][k]
        got += own
    assert [(int(r[0]), float(r[1]), *r[2:4], r[4].date(), *r[5:]) for r in got] == rows
    with pytest.raises(FileExistsError):
        save_table(df, path)
    save_table(df.limit(0), path, mode="overwrite")
    assert list(read_sheet(open(path, "rb").read())) == [df.columns]


def test_workbook_of_more_rows_than_a_sheet_holds(spark, tmp_path):
    from aeroframe.sources.sinks import save_table
    from aeroframe.sources.workbook import SHEET_ROWS, read_sheet, sheets

    save_table(spark.range(SHEET_ROWS), f"{tmp_path}/s.xlsx")
    content = open(f"{tmp_path}/s.xlsx", "rb").read()
    assert len(sheets(content)) == 2 and sum(1 for _ in read_sheet(content)) == SHEET_ROWS and list(read_sheet(content, 1)) == [["id"], [str(SHEET_ROWS - 1)]]
