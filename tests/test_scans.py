"""XML, CSV and GPX readers against generated files."""

import random
from xml.sax.saxutils import quoteattr

import pytest
from pyspark.sql import functions as F

from vitals.operators.ecg import ecg_projection, route_projection, row_ordinal
from vitals.operators.records import map_record_type, project_record
from vitals.sources import gpx as gpx_source
from vitals.sources.archive import _Scrubber
from vitals.sources.ecg_csv import scan_ecg, scan_ecg_csv
from vitals.sources.gpx import scan_gpx, scan_gpx_routes
from vitals.sources.health_xml import ATTRIBUTES, scan_health_xml

PROLOGUE = """<?xml version="1.0" encoding="UTF-8"?>
<!DOCTYPE HealthData [
<!-- an export -->
<!ELEMENT HealthData (ExportDate,Me,(Record|Correlation|Workout)*)>
<!ATTLIST Record
  type CDATA #REQUIRED
  unit CDATA #IMPLIED
>
]>
<HealthData locale="en_US">
 <ExportDate value="2024-01-01"/>
 <RecordGroup type="not a record" value="1"/>
"""
COLUMNS = list(ATTRIBUTES.values())


def element(attributes, child=None):
    # quoteattr would pick single quotes for values with double ones
    quote = lambda v: quoteattr(v, {'"': "&quot;"})
    text = " ".join(f"{name}={quote(value)}" for name, value in attributes.items())
    return f"<Record {text}>{child}</Record>" if child else f"<Record {text}/>"


def write(folder, *lines, name="export.xml", prologue=PROLOGUE):
    folder.mkdir(exist_ok=True)
    text = prologue + "\n".join(lines) + "\n</HealthData>\n"
    (folder / name).write_text(text, encoding="utf-8")
    return str(folder)


def scanned(df):
    return [tuple(r) for r in df.orderBy("_blk", "_pos").select(*COLUMNS).collect()]


@pytest.fixture(params=[True, False], ids=["split", "whole"])
def splittable(request):
    return request.param


def test_records_at_any_depth_attributes_only(spark, tmp_path, splittable):
    path = write(
        tmp_path / "x",
        '<Record type="a" unit="u" value="1" startDate="s" creationDate="c"/>',
        '<Record type="b" value="2"><MetadataEntry key="k" value="9"/></Record>',
        '<Correlation type="group"><Record type="c" value="3"/></Correlation>',
        '<RecordX type="other" value="5"/>',
        '<Workout type="w" value="6"/>',
    )
    assert scanned(scan_health_xml(spark, path, splittable)) == [
        ("a", "u", "1", "s", "c"),
        ("b", "", "2", "", ""),
        ("c", "", "3", "", ""),
    ]


def test_quoting_and_entities(spark, tmp_path, splittable):
    path = write(
        tmp_path / "x",
        '<Record device="a > b type=" type="t1" value="x > y"/>',
        '<Record sourceName=" value=" type="t2" unit="a &amp; b" value="&lt;&#65;&#x42;&gt;&quot;"/>',
        '<Record type="t3"   value="1"  unit = "two spaces"/>',
        '<Record type="t4" value="a = b" unit="  "/>',
        '<Record type="t5"\n value="newline"\n\tunit="tab"/>',
        '<Record xtype="no" typex="no" type="t6" value=""/>',
        '<Record sourceName=" type=" value=" unit=" type="t7" unit="real"/>',
    )
    found = {row[0]: row[1:3] for row in scanned(scan_health_xml(spark, path, splittable))}
    assert found == {
        "t1": ("", "x > y"),
        "t2": ("a & b", '<AB>"'),
        "t3": ("two spaces", "1"),
        "t4": ("  ", "a = b"),
        "t5": ("tab", "newline"),
        "t6": ("", ""),
        "t7": ("real", " unit="),
    }


def test_generated_records_survive_any_split(spark, tmp_path):
    generator = random.Random(11)
    alphabet = "abc &<>\"'=/ é漢\t?!#;type= value= <Record"
    text = lambda: "".join(generator.choice(alphabet) for _ in range(generator.randint(0, 12)))
    records, lines = [], []
    for number in range(3000):
        attributes = {"type": f"t{number}", "sourceName": text(), "device": text()}
        for name in ["unit", "value", "startDate", "creationDate"]:
            if generator.random() < 0.8:
                attributes[name] = text()
        names = list(attributes)
        generator.shuffle(names)
        attributes = {name: attributes[name] for name in names}
        records.append(tuple(attributes.get(name, "") for name in ATTRIBUTES))
        child = '<MetadataEntry key="k" value="v"/>' if generator.random() < 0.3 else None
        lines.append(generator.choice(["", "  ", "\n"]) + element(attributes, child))
    path = write(tmp_path / "x", *lines)
    # quoteattr writes line breaks and tabs as character references
    saved = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        scan = scan_health_xml(spark, path)
        assert scan.rdd.getNumPartitions() > 10
        assert scanned(scan) == records
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", saved)


def test_no_records(spark, tmp_path, splittable):
    path = write(tmp_path / "x")
    assert scanned(scan_health_xml(spark, path, splittable)) == []


def test_record_rows(spark, tmp_path, rows):
    path = write(
        tmp_path / "x",
        '<Record type="HKQuantityTypeIdentifierHeartRate" value="72" startDate="s"/>',
        '<Record type="HKQuantityTypeIdentifierUnknown" value="1"/>',
        '<Record type="HKCategoryTypeIdentifierSleepAnalysis" value="Asleep" unit="n"/>',
        '<Record value="1"/>',
    )
    scan = scan_health_xml(spark, path).withColumns(
        {"user_id": F.lit("u"), "job_id": F.lit("1")}
    )
    found = project_record(map_record_type(scan))
    columns = ["record_type", "start_date", "value", "unit", "creation_date", "value_num"]
    assert rows(found, *columns) == [
        ("HeartRate", "s", "72", "", "", 72.0),
        ("SleepAnalysis", "", "Asleep", "n", "", None),
    ]


def test_all_spellings_of_a_start_tag(spark, tmp_path):
    (tmp_path / "x.xml").write_text(
        "<HealthData><Record type='a' value='say \"x\" > y' startDate='1'/><Record\n type=\"b\" value=\"2\"/>"
        '<Record\ttype="c" value="it\'s" startDate="3"><Record type="d" value="4"/></Record><Record/><Recorder type="e"/>'
        + "<Workout/>text " * 100_000
        + '<Record type="f" value="2" sta'
    )
    found = {row[0]: (row[2], row[3]) for row in scanned(scan_health_xml(spark, str(tmp_path / "x.xml")))}
    assert found == {"a": ('say "x" > y', "1"), "b": ("2", ""), "c": ("it's", "3"), "d": ("4", ""), "": ("", "")}


MEMBER = "user_id STRING, job_id STRING, member_ordinal INT, member STRING, content BINARY, staged_path STRING"


def members(spark, folder, inline):
    """The files of a folder as unpacked members, held as values or as files."""
    rows = [
        ("u", "1", n, path.name, path.read_bytes() if inline else None, None if inline else str(path))
        for n, path in enumerate(sorted(folder.iterdir()))
        if path.is_file()
    ]
    return spark.createDataFrame(rows, MEMBER)


@pytest.fixture(params=[True, False], ids=["values", "files"])
def inline(request):
    return request.param


def ecg(spark, folder, inline):
    columns = ["source_file", "row_in_file", "ecg_time", "classification", "average_heart_rate"]
    scan = scan_ecg_csv(members(spark, folder, inline))
    return sorted((tuple(r) for r in scan.select(*columns).collect()), key=repr)


def test_ecg_columns_by_header_name(spark, tmp_path, inline):
    head = "Date,Classification,Average Heart Rate (bpm)\n"
    (tmp_path / "a.csv").write_text(head + "d1,Sinus,60\n\nd2,\"AF, \"\"x\"\"\nmore\",70\n")
    (tmp_path / "b.csv").write_text("Classification,Extra,Date\r\nSinus,e,d3\r\n")
    (tmp_path / "c.csv").write_text("Classification\nSinus\n")
    (tmp_path / "d.csv").write_text(head + "d4\n")
    (tmp_path / "e.csv").write_bytes(head.encode() + b"d5,ok,1\n" + b"d6,\xff\xfe,2\n")
    (tmp_path / "f.csv").write_text("")
    assert ecg(spark, tmp_path, inline) == [
        ("a.csv", 0, "d1", "Sinus", "60"),
        ("a.csv", 1, "d2", 'AF, "x"\nmore', "70"),
        ("b.csv", 0, "d3", "Sinus", ""),
        ("c.csv", 0, None, "Sinus", ""),
        ("d.csv", 0, "d4", None, None),
    ]


def test_ecg_long_fields_and_unreadable_lines(spark, tmp_path, inline):
    long = "x" * 200_000
    (tmp_path / "a.csv").write_text(f"Date,Classification\nd1,a\nd2,{long}\nd3\rz,c\nd4,d\n")
    found = ecg(spark, tmp_path, inline)
    assert [row[2:4] for row in found] == [("d1", "a"), ("d2", long), ("d4", "d")]


def test_ecg_larger_than_one_batch(spark, tmp_path, inline):
    lines = "".join(f"t{n},c\n" for n in range(25_001))
    (tmp_path / "a.csv").write_text("Date,Classification\n" + lines)
    found = ecg(spark, tmp_path, inline)
    assert len(found) == 25_001 and max(row[1] for row in found) == 25_000


FILE = "user_id STRING, job_id STRING, member_ordinal INT, source_file STRING, "


def at():
    return F.timestamp_seconds(F.lit(1_700_000_000))


def test_ecg_projection_and_ordinals(spark, rows):
    scan = spark.createDataFrame(
        [
            ("u", "1", 7, "g", 0, "d1", "c", "60"),
            ("u", "1", 7, "g", 1, None, "c", "61"),
            ("u", "1", 3, "f", 0, "d2", None, ""),
            ("u", "2", 1, "e", 0, "d3", "c", ""),
        ],
        FILE + "row_in_file LONG, ecg_time STRING, classification STRING, average_heart_rate STRING",
    )
    found = row_ordinal(ecg_projection(scan, at()))
    assert rows(found, "job_id", "ordinal", "ecg_time", "created_at") == [
        ("1", 0, "d2", "1700000000"),
        ("1", 1, "d1", "1700000000"),
        ("1", 2, "1700000000", "1700000000"),
        ("2", 0, "d3", "1700000000"),
    ]


def gpx(body, namespace="http://www.topografix.com/GPX/1/1"):
    return f'<?xml version="1.0"?>\n<gpx version="1.1" xmlns="{namespace}">{body}</gpx>'


def test_gpx_tracks(spark, tmp_path, inline):
    point = '<trkpt lat="{0}" lon="-{0}"><ele>{0}</ele><time>t{0}</time></trkpt>'.format
    (tmp_path / "a.gpx").write_text(gpx(
        f"<metadata/><trk><name>n</name><trkseg>{point(1)}{point(2)}</trkseg>"
        f"<trkseg></trkseg><trkseg>{point(3)}</trkseg></trk><trk><trkseg/></trk>"
    ))
    (tmp_path / "b.gpx").write_text(gpx(
        '<trk><trkseg><trkpt lat="5"/><trkpt lat="6" lon="7"><ele/></trkpt></trkseg></trk>'
    ))
    (tmp_path / "c.gpx").write_text("<gpx><trk><trkseg><trkpt lat=")
    (tmp_path / "d.gpx").write_text(gpx("<wpt/>"))
    # one track whole, then broken off; bytes that are no UTF-8; a prefix; nested; another encoding
    (tmp_path / "e.gpx").write_text(gpx(f"<trk><trkseg>{point(8)}</trkseg></trk>")[:-3])
    (tmp_path / "f.gpx").write_bytes(gpx("<trk><name>NAME</name></trk>").encode().replace(b"NAME", b"\xff"))
    (tmp_path / "g.gpx").write_text(
        '<x:gpx xmlns:x="http://www.topografix.com/GPX/1/1"><x:trk><x:trkseg>'
        '<x:trkpt lat="9" lon="1"><x:time>t9</x:time></x:trkpt></x:trkseg></x:trk></x:gpx>'
    )
    (tmp_path / "h.gpx").write_text(gpx(f"<ext><trk><trkseg>{point(10)}</trkseg></trk></ext>"))
    latin = '<?xml version="1.0" encoding="ISO-8859-1"?><gpx><trk><trkseg><trkpt lat="é"/></trkseg></trk></gpx>'
    (tmp_path / "i.gpx").write_bytes(latin.encode("latin-1"))
    scan = scan_gpx_routes(members(spark, tmp_path, inline))
    found = sorted([tuple(p) for p in r["waypoints"]] for r in scan.collect())
    assert found == [
        [],
        [("1", "-1", "1", "t1"), ("2", "-2", "2", "t2"), ("3", "-3", "3", "t3")],
        [("10", "-10", "10", "t10")],
        [("5", "", "", ""), ("6", "7", "", "")],
        [("9", "1", "", "t9")],
        [("é", "", "", "")],
    ]


def test_route_projection(spark, rows):
    p = lambda n, time: (str(n), str(-n), "", time)
    scan = spark.createDataFrame(
        [
            ("u", "1", 4, "g", [p(1, "t1"), p(2, "t2")], 10),
            ("u", "1", 4, "g", [], 11),
            ("u", "1", 4, "g", [p(3, "")], 12),
            ("u", "1", 2, "f", [p(4, "t4")], 99),
        ],
        FILE + "waypoints ARRAY<STRUCT<lat: STRING, lon: STRING, ele: STRING, time: STRING>>, track LONG",
    )
    found = row_ordinal(route_projection(scan, at()))
    columns = ["ordinal", "route_time", "waypoint_count", "start_lat", "end_lon"]
    assert rows(found, *columns) == [
        (0, "t4", 1, "4", "-4"),
        (1, "t1", 2, "1", "-2"),
        (2, "", 1, "3", "-3"),
    ]


@pytest.mark.parametrize("inline", [True, False], ids=["values", "files"])
def test_what_cannot_be_read_has_a_reason(spark, tmp_path, rows, inline):
    point = '<trkpt lat="1" lon="2"><time>t</time></trkpt>'
    good = f"<gpx><trk><trkseg>{point * 2}</trkseg></trk><trk/></gpx>"
    texts = {
        "a.gpx": good.encode(),
        "b.gpx": good[:-3].encode(),
        "c.gpx": f"<gpx>&nothing;{good}</gpx>".encode(),
        "d.gpx": b'<?xml version="1.0" encoding="no-such"?><gpx/>',
        "e.gpx": b"",
    }
    folder = tmp_path / "g"
    folder.mkdir()
    for name, text in texts.items():
        (folder / name).write_bytes(text)
    found = scan_gpx(members(spark, folder, inline))
    assert rows(found.where("reason is null"), "source_file", "track") == [("a.gpx", 0), ("a.gpx", 1)]
    assert rows(found.where("reason is not null"), "source_file", "track", "waypoints", "reason") == [
        (name, None, None, "GPX is not well-formed") for name in ["b.gpx", "c.gpx", "d.gpx", "e.gpx"]
    ]

    lists = {"a.csv": b"Date,Classification\n1,x\nbro\rken\n\n2\n", "b.csv": b"Date\n\xff\n", "c.csv": b""}
    folder = tmp_path / "c"
    folder.mkdir()
    for name, text in lists.items():
        (folder / name).write_bytes(text)
    found = scan_ecg(members(spark, folder, inline))
    assert rows(found.where("reason is null"), "source_file", "row_in_file", "ecg_time", "classification") == [
        ("a.csv", 0, "1", "x"), ("a.csv", 1, "2", None),
    ]
    assert rows(found.where("reason is not null"), "source_file", "line", "reason") == [
        ("a.csv", 3, "line is no CSV"), ("b.csv", None, "CSV is not UTF-8"),
    ]


def test_many_tracks_go_out_in_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(gpx_source, "TRACKS", 3)
    monkeypatch.setattr(gpx_source, "WAYPOINTS", 5)
    track = '<trk><trkseg>{}</trkseg></trk>'
    (tmp_path / "a.gpx").write_text("<gpx>" + "".join(track.format(f'<trkpt lat="{i}" lon="{j}"/>' * (i % 4)) for i in range(20) for j in [0]) + "</gpx>")
    for inline in (True, False):
        got = scan_gpx_routes(members(spark, tmp_path, inline)).orderBy("track").collect()
        assert [(r["track"], [p["lat"] for p in r["waypoints"]]) for r in got] == [(i, [str(i)] * (i % 4)) for i in range(20)]


def test_only_elements_begin_with_a_bracket_once_unpacked(spark, tmp_path):
    unreal = '<Record type="no" value="0"/>'
    prologue = (
        '<?xml version="1.0"?>\n<!-- ' + unreal + " --><!DOCTYPE HealthData [\n"
        "<!ENTITY e '<!-- " + unreal + "'>\n<!ELEMENT HealthData ANY>]>\n<HealthData>\n"
    )
    generator = random.Random(4)
    body, real = [], []
    for number in range(200):
        body.append(generator.choice([
            f"<!-- {unreal} - ] ?> -->", f"<!--{unreal * 40}-->", f"<![CDATA[<!-- {unreal} ]] > ]]>",
            f"<?p {unreal} --> ]]?>", "<!---->", "<![CDATA[]]>",
        ]))
        body.append(f'<Record type="t{number}" value="--&gt; > ]]&gt;"/>')
        real.append((f"t{number}", "", "--> > ]]>", "", ""))
    text = (prologue + "\n".join(body) + "</HealthData>").encode()
    whole = None
    for size in (1, 2, 7, 9, 1000, len(text)):
        scrubber = _Scrubber()
        parts = [scrubber.feed(text[at : at + size]) for at in range(0, len(text), size)]
        got = b"".join([*parts, scrubber.feed(b"", last=True)])
        assert len(got) == len(text) and whole in (None, got)
        whole = got
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "export.xml").write_bytes(whole)
    saved = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        assert scanned(scan_health_xml(spark, str(tmp_path / "x"))) == real
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", saved)
    # a prologue whose comment goes on over blocks, the root in the last of them
    long = b"<!--" + b"x" * 500 + b"--><a><Record c='1'/></a>"
    scrubber = _Scrubber()
    got = b"".join([scrubber.feed(long[:400]), scrubber.feed(long[400:]), scrubber.feed(b"", last=True)])
    assert got == long
    plain = b'<?xml version="1.0"?><a><b c="1"/>text</a>'
    scrubber = _Scrubber()
    assert scrubber.feed(plain) + scrubber.feed(b"", last=True) == plain
