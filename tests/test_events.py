"""Event XML decoding, one row per shape."""

import random
from datetime import datetime

import pytest

from gainsay.functions.events import EVENT_NAMESPACE, decode, unusable
from gainsay.sources.case import events_from_xml, read_xml_export

SYSTEM = (
    '<System><Provider Name="P&amp;Q"/><EventID Qualifiers="1"> 4688 </EventID><Level>4</Level>'
    '<TimeCreated SystemTime="2024-01-01T00:00:00.1234567Z"/><Computer> H </Computer></System>'
)


def event(body, namespace=f'xmlns="{EVENT_NAMESPACE}"'):
    return f"<Event {namespace}>{body}</Event>"


@pytest.fixture(scope="module")
def decoded(spark):
    def run(texts):
        rows = [(str(i), "f", i, t) for i, t in enumerate(texts)]
        df = spark.createDataFrame(
            rows, "case_id string, source_path string, record_number bigint, raw_xml string"
        )
        return [r for r in decode(df).orderBy("record_number").collect()]

    return run


def test_unusable_rows_get_a_reason(decoded):
    whole = event(SYSTEM)
    rows = decoded(
        [whole[:-10], None, "", "text", whole + "junk", whole + whole, "junk" + whole,
         event(SYSTEM + "<EventData><Data>&foo;</Data></EventData>"),
         event(SYSTEM + "<EventData><Data>a\x01b</Data></EventData>"),
         event(SYSTEM + '<EventData><Data a="1" a="2"/></EventData>'),
         event("<EventData/>"), event(SYSTEM, "")]
    )
    assert [r.reason for r in rows[:10]] == ["malformed XML"] * 10
    assert [r.reason for r in rows[10:]] == ["no System element"] * 2


def test_system_fields(decoded):
    row = decoded(['<?xml version="1.0" encoding="utf-8"?>\n' + event(SYSTEM)])[0]
    assert row.reason is None
    assert (row.event_id, row.level, row.provider_name) == (4688, 4, "P&Q")
    assert row.timestamp == datetime(2024, 1, 1, 0, 0, 0, 123456)
    assert (row.computer_name, row.channel, row.message) == ("H", None, None)


@pytest.mark.parametrize(
    "text, expected",
    [("4688", 4688), (" 4688\u00a0", 4688), ("abc", None), ("4688.7", None), ("", None)],
)
def test_event_id(decoded, text, expected):
    row = decoded([event(f"<System><EventID>{text}</EventID></System>")])[0]
    assert row.reason is None and row.event_id == expected


@pytest.mark.parametrize(
    "text, expected",
    [
        ("2024-01-01T00:00:00.123456Z", datetime(2024, 1, 1, 0, 0, 0, 123456)),
        ("2024-01-01 00:00:00", datetime(2024, 1, 1)),
        ("2024-01-01T02:00:00+02:00", datetime(2024, 1, 1)),
        ("2024", None),
        ("soon", None),
        ("2024-13-01T00:00:00Z", None),
        ("2024-01-01T10", datetime(2024, 1, 1, 10)),
        ("20240101T101011", datetime(2024, 1, 1, 10, 10, 11)),
        ("20240101T101011.5Z", datetime(2024, 1, 1, 10, 10, 11, 500000)),
        ("2024-01-01T1010+0200", datetime(2024, 1, 1, 8, 10)),
        ("20240101", datetime(2024, 1, 1)),
        ("2024-01-01T10:11Z", datetime(2024, 1, 1, 10, 11)),
        ("20240101T256161", None),
    ],
)
def test_timestamp(decoded, text, expected):
    row = decoded([event(f'<System><TimeCreated SystemTime="{text}"/></System>')])[0]
    assert row.reason is None and row.timestamp == expected


def test_provider_keeps_the_empty_name(decoded):
    rows = decoded(
        [event(f"<System>{p}</System>") for p in ('<Provider Name=""/>', "<Provider/>", "")]
    )
    assert [r.provider_name for r in rows] == ["", None, None]


@pytest.mark.parametrize(
    "body, expected",
    [
        ("<EventData><Data>a</Data><Data> b </Data></EventData>", "a | b"),
        ("<EventData><Data> </Data><Data/></EventData>", None),
        ("<EventData><Data><N>in</N>tail</Data>tail</EventData>", "in"),
        ("<EventData>own<Data>x</Data></EventData>", "own | x"),
        ("<EventData/><UserData><A>1</A></UserData>", None),
        ('<UserData><e xmlns="q"><A>1</A><B>2</B></e></UserData>', "1 | 2"),
        ("", None),
        ("<EventData><Data>x &lt;y&gt; &amp; z</Data></EventData>", "x <y> & z"),
        ("<EventData><Data>p -> q</Data></EventData>", "p -> q"),
        ('<EventData><Data Name="a>b">x</Data></EventData>', "x"),
        ('<EventData><Data Name="a&gt;b">x</Data></EventData>', "x"),
        ("<EventData><Data Name='a&#62;b'>x</Data></EventData>", "x"),
        ("<EventData><Data><![CDATA[c<d>]]></Data><!-- n --></EventData>", "c<d>"),
        ("<EventData><Data>1 &#60; 2</Data></EventData>", "1 < 2"),
        ("<EventData><Data>l&#10;m</Data></EventData>", "l\nm"),
    ],
)
def test_message(decoded, body, expected):
    row = decoded([event(SYSTEM + body)])[0]
    assert row.reason is None and row.message == expected


def test_fields_are_first_children_and_their_leading_text(decoded):
    one = "<System><EventID>5</EventID><EventID>6</EventID><Level>a<b/>c</Level><Computer>x<!-- n -->y</Computer></System>"
    prefixed = (
        f'<e:Event xmlns:e="{EVENT_NAMESPACE}"><e:System><e:EventID>7</e:EventID><e:Provider Name="P"/></e:System>'
        "<EventData>not of the namespace</EventData><e:EventData><e:Data>d</e:Data></e:EventData></e:Event>"
    )
    other_root = f'<Record xmlns="{EVENT_NAMESPACE}"><System><EventID>8</EventID></System></Record>'
    twice = event("<System><EventID>1</EventID></System><System><EventID>2</EventID></System>")
    wrong = '<e:Event xmlns:e="urn:other"><e:System/></e:Event>'
    rows = decoded([event(one), prefixed, other_root, twice, wrong])
    assert [r.reason for r in rows] == [None] * 4 + ["no System element"]
    assert [r.event_id for r in rows[:4]] == [5, 7, 8, 1]
    assert rows[0].level is None and rows[0].computer_name == "xy"
    assert (rows[1].provider_name, rows[1].message) == ("P", "d")


NS = f'xmlns="{EVENT_NAMESPACE}"'
SHAPES = [
    event("<System><EventID>1</EventID><Computer> \n</Computer><Channel> </Channel></System>"),
    event("<System><Computer></Computer><Channel/></System>"),
    event('<System><EventID xmlns="urn:z">1</EventID><Level xmlns="urn:z">2</Level><Computer>c</Computer></System>'),
    event('<System><EventID xmlns="urn:z">1</EventID><EventID>5</EventID></System>'),
    event('<System><EventID/></System><EventData xmlns="urn:z"><Data>a</Data></EventData><UserData><b>u</b></UserData>'),
    event('<System/><EventData a="1"  xmlns = "urn:z"><Data>a</Data></EventData>'),
    f"<Event><System {NS}><EventID>3</EventID></System><EventData><Data>m</Data></EventData></Event>",
    f"<Event><System {NS}><EventID>3</EventID></System><EventData {NS}><Data>m</Data></EventData></Event>",
    f'<Event xmlns="urn:z"><System {NS}><Level>3</Level></System><UserData><Data>m</Data></UserData></Event>',
    f"<Event a='1' {NS} b='2'><System><EventID>9</EventID></System><EventData><Data xmlns='q'>deep</Data></EventData></Event>",
    f"<Event xmlns='{EVENT_NAMESPACE}'><System><EventID>9</EventID><Provider Name='p' xmlns='urn:z'/></System></Event>",
    f"<Event {NS}><System xmlns=''><EventID>9</EventID></System></Event>",
    "<Event><System><EventID>9</EventID></System></Event>",
    event("<System><EventID/><EventID>6</EventID><Computer></Computer><Computer>c</Computer><Level>1</Level><Level/></System>"),
    event('<System><Provider/><Provider Name="p"/></System><EventData/><EventData><Data>x</Data></EventData>'),
    event('<System/><System><EventID>4</EventID></System><EventData><Data>x</Data></EventData><EventData><Data>y</Data></EventData>'),
    event("<System><EventID>4</EventID></System><UserData><EventData><Data>in</Data></EventData></UserData>"),
]


def _tree_fields(text):
    """The same fields from a tree, as the rules say."""
    from xml.etree import ElementTree

    def own(of, tag):
        return of.find("{%s}%s" % (EVENT_NAMESPACE, tag))

    root = ElementTree.fromstring(text)
    system = own(root, "System")
    if system is None:
        return ("no System element",) + (None,) * 6

    def words(tag):
        found = own(system, tag)
        return None if found is None or found.text is None else found.text.strip()

    def number(tag):
        return int(words(tag)) if (words(tag) or "").lstrip("-").isdigit() else None

    provider, data = own(system, "Provider"), own(root, "EventData")
    data = own(root, "UserData") if data is None else data
    said = [] if data is None else [e.text.strip() for e in data.iter() if e.text and e.text.strip()]
    return (None, number("EventID"), number("Level"), words("Computer"), words("Channel"),
            None if provider is None else provider.get("Name"), " | ".join(said) or None)


def test_every_shape_reads_as_a_tree_does(decoded):
    rows = decoded(SHAPES)
    got = [(r.reason, r.event_id, r.level, r.computer_name, r.channel, r.provider_name, r.message) for r in rows]
    assert got == [_tree_fields(text) for text in SHAPES]


def test_times_without_a_zone_are_utc_in_any_session(spark, decoded):
    texts = [event(f'<System><TimeCreated SystemTime="{t}"/></System>') for t in ("2024-03-10T02:30:00", "2024-03-10", "2024-03-10T02:30:00+01:00")]
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        df = spark.createDataFrame([("c", "f", i, t) for i, t in enumerate(texts)], "case_id string, source_path string, record_number bigint, raw_xml string")
        found = decode(df).orderBy("record_number").selectExpr("unix_seconds(timestamp) s").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert [r.s for r in found] == [1710037800, 1710028800, 1710034200]


def test_export_files_split_at_the_end_tag(spark, tmp_path):
    body = "".join(
        event(f"<System><EventID>{i}</EventID><EventRecordID>{i}</EventRecordID></System>")
        for i in range(1, 6)
    )
    (tmp_path / "log.xml").write_text(f'<?xml version="1.0"?><Events>\n{body}\n</Events>')
    rows = read_xml_export(spark, str(tmp_path), case_id="c")
    records, failures = events_from_xml(rows)
    assert sorted(r.record_number for r in records.collect()) == [1, 2, 3, 4, 5]
    assert failures.count() == 0
    assert records.first().source_path.endswith("log.xml")


def test_a_cut_off_event_at_the_end_of_a_file_is_a_failure(spark, tmp_path):
    system = "<System><EventID>{0}</EventID><EventRecordID>{0}</EventRecordID></System>"
    whole = "".join(event(system.format(i)) for i in range(1, 4))
    (tmp_path / "cut log.xml").write_text(whole + event(system.format(9))[: -len("</Event>")])
    (tmp_path / "ends.xml").write_text(whole)
    (tmp_path / "tail.xml").write_text(f"<Events>{whole}\n</Events>\n")
    records, failures = events_from_xml(read_xml_export(spark, str(tmp_path)))
    assert sorted(r.record_number for r in records.collect()) == [1, 1, 1, 2, 2, 2, 3, 3, 3]
    (failure,) = failures.collect()
    assert failure.reason == "malformed XML" and failure.source_path == str(tmp_path / "cut log.xml")


def test_failures_need_no_fields_and_are_the_same(spark):
    """Damaged at random: the outline finds a text unusable just where the whole reading does."""
    rng = random.Random(5)
    whole = (
        f'<?xml version="1.0"?>\n<Event xmlns="{EVENT_NAMESPACE}"><System><Provider Name="p" Guid="g"/>'
        '<EventID Qualifiers="1">4688</EventID><Level>4</Level><TimeCreated SystemTime="2024-01-01T00:00:00Z"/>'
        "<EventRecordID>17</EventRecordID><Channel>c</Channel><Computer>h</Computer></System>"
        '<EventData><Data Name="p">a &amp; b</Data><Data><b>x</b>tail</Data></EventData><UserData><a>1</a></UserData></Event>'
    )
    texts = [whole, None, "", whole * 2]
    for _ in range(3000):
        text = whole
        for _ in range(rng.randrange(1, 3)):
            at, end = rng.randrange(len(text)), rng.randrange(1, 5)
            text = text[:at] + rng.choice(["", "<", ">", "&", '"', "/", "x", " ", "<q>", "</q>", "</System>", "<Data>", "&lt;", "<!--", "\x00"]) + text[at + rng.choice([0, 0, end]) :]
        texts.append(text)
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, raw_xml string").repartition(8)
    full = {r.n: (r.embedded_record_number, r.reason) for r in decode(rows).select("n", "embedded_record_number", "reason").collect()}
    found = {r.n: tuple(r)[1:] for r in unusable(rows).select("n", "embedded_record_number", "reason").collect()}
    wrong = [(texts[n], full[n], found[n]) for n in full if full[n] != found[n]]
    assert not wrong, (len(wrong), wrong[:3])
    assert len(found) == len(texts) and 500 < sum(reason is not None for _, reason in found.values()) < 2900
