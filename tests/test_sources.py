from __future__ import annotations

import pytest

from dayrunner import schemas
from dayrunner.sources import corpus, gtfs, manifest, sinks
from tests.conftest import rows

MANIFEST = """id,source,url,headers_json,params_json,license,active,write_stable,encoding,epsg,origin,stat_year,created_year,info_url
one,gtfs,u1,,,L,TRUE,TRUE,UTF-8,4326,o,1,1,
two,gtfs,u2,,,L, yes ,TRUE,UTF-8,4326,o,1,1,
off,gtfs,u3,,,L,FALSE,TRUE,UTF-8,4326,o,1,1,
box,sandbox,u4,,,L,TRUE,TRUE,UTF-8,4326,o,1,1,
,gtfs,u5,,,L,1,TRUE,UTF-8,4326,o,1,1,
three,gtfs,u6,,,L,1,TRUE,UTF-8,4326,o,1,1,
"""

MORE_MANIFEST = MANIFEST + """sp ace+50%25,gtfs,u7,,,L,1,TRUE,UTF-8,4326,o,1,1,
latin,gtfs,u8,,,L,1,TRUE,ISO-8859-1,4326,o,1,1,
long,gtfs,u9,,,L,1,TRUE,UTF-8,4326,o,1,1,
"""

FILES = {
    "gtfs/one/latest/_extracted/stops.txt": '﻿stop_id,stop_name,stop_lat,stop_lon,parent_station,location_type\r\n'
    'a,"A ""x"" B",35.5,139,p,0\r\nb,"line\nbreak",,bad,,1.0\r\nshort,row\r\nlong,x,1,2,,0,extra,extra2\r\n',
    "gtfs/two/latest/_extracted/stops.csv": "stop_lon,stop_lat,stop_id\n1.5,2.5,a\n",
    "gtfs/two/latest/_extracted/stops.txt": "stop_lon,stop_lat,stop_id\n7.5,8.5,z\n",
    "gtfs/off/latest/_extracted/stops.txt": "stop_id\nnever\n",
    "gtfs/one/latest/raw/stops.txt": "stop_id\nnot extracted\n",
    "sandbox/rail/stops.csv": "stop_id,stop_name\nr1,csv\n",
    "sandbox/rail/stops.txt": "stop_id,stop_name\nr1,txt\n",
    "gtfs/one/latest/_extracted/stop_times.txt": "trip_id,arrival_time,departure_time,stop_id,stop_sequence\n"
    "t1,25:35:00,25:36:00,a,1\nt1,ab:cd:ef,,b, 7 \nt1,8:05:00,8:05:00,b,1.5\n",
    "gtfs/sp ace+50%25/latest/_extracted/trips.txt": 'route_id,trip_headsign,trip_id\nr,"To\nTown, ""X""",t1\nr,plain,t2\n',
    "gtfs/sp ace+50%25/latest/_extracted/stop_times.txt": 'stop_headsign,trip_id,stop_sequence\n"a\r\nb",t1,2.5\n,t1,3\n',
    "gtfs/latin/latest/_extracted/stops.txt": "stop_id,stop_name\nü1,Zürich\n".encode("latin-1"),
    "gtfs/long/latest/_extracted/trips.txt": ",".join(f"extra_{k:08d}" for k in range(8000)) + ",trip_id,route_id,trip_id\n"
    + "," * 8000 + "t9,r9,other\n",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("feeds")
    (top / "manifest.csv").write_text(MANIFEST, encoding="utf-8")
    for name, text in FILES.items():
        path = top / "data" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text if isinstance(text, bytes) else text.encode())
    (top / "more.csv").write_text(MORE_MANIFEST, encoding="utf-8")
    return top


@pytest.fixture(scope="module")
def feed(spark, root):
    listed = manifest.read_manifest(spark, str(root / "manifest.csv"))
    return gtfs.read_feed(spark, str(root / "data"), listed, sandbox_ids=["rail"])


def test_manifest(spark, root):
    listed = manifest.read_manifest(spark, str(root / "manifest.csv"))
    assert rows(manifest.active_feeds(listed), "gtfs_id") == [("one",), ("three",), ("two",)]


def test_stops(feed):
    got = {r.stop_id: r for r in feed.stops.filter("not _missing").collect()}
    assert set(got) == {"onea", "oneb", "oneshort", "onelong", "twoa", "railr1"}
    assert got["onea"].stop_name == 'A "x" B'
    assert (got["onea"].stop_lat, got["onea"].parent_station) == (35.5, "onep")
    assert (got["oneb"].stop_name, got["oneb"].stop_lat, got["oneb"].stop_lon) == ("line\nbreak", None, None)
    assert got["oneb"].parent_station is None
    assert (got["oneshort"].stop_name, got["oneshort"].stop_lat) == ("row", None)
    assert got["onelong"].stop_lon == 2.0
    assert (got["twoa"].stop_lat, got["twoa"].stop_lon, got["twoa"].stop_name) == (2.5, 1.5, None)
    assert got["railr1"].stop_name == "txt"
    assert got["twoa"]._path == "gtfs/two/latest/_extracted/stops.csv"


@pytest.fixture(scope="module")
def more(spark, root):
    listed = manifest.read_manifest(spark, str(root / "more.csv"))
    return gtfs.read_feed(spark, str(root / "data"), listed, encoding={"latin": "ISO-8859-1"})


def test_odd_paths_and_line_breaks_lose_nothing(more):
    odd = "sp ace+50%25"
    got = rows(more.trips, "gtfs_id", "trip_id", "trip_headsign", "_path")
    assert (odd, f"{odd}t1", 'To\nTown, "X"', f"gtfs/{odd}/latest/_extracted/trips.txt") in got
    assert [g[1] for g in got if g[0] == odd] == [f"{odd}t1", f"{odd}t2"]
    events = rows(more.stop_times.filter(f"gtfs_id = '{odd}'"), "trip_id", "stop_headsign", "stop_sequence")
    assert len(events) == 2 and {(e[1] or "").replace("\r\n", "\n") for e in events} == {"", "a\nb"}
    assert {e[2] for e in events} == {3}


def test_long_headers_and_repeated_names(more):
    assert rows(more.trips.filter("gtfs_id = 'long'"), "trip_id", "route_id") == [("longt9", "longr9")]


def test_encoding_by_feed(more):
    assert rows(more.stops.filter("gtfs_id = 'latin'"), "stop_id", "stop_name") == [("latinü1", "Zürich")]


def test_analyses_see_no_placeholders(more):
    assert more.stop_times.filter("_missing or trip_id is null").count() == 0
    assert more.complete("stop_times").filter("_missing").count() == 4
    assert more.replace(trips=more.trips.limit(1)).complete("stop_times").filter("_missing").count() == 4


def test_placeholders(feed):
    missing = feed.complete("stops").filter("_missing").collect()
    assert [(r.gtfs_id, r.stop_id, r._path) for r in missing] == [("three", None, None)]
    assert feed.agency.count() == 0
    assert {r.gtfs_id for r in feed.complete("calendar").collect()} == {"one", "two", "three"}
    assert feed.calendar.count() == 0 and feed.calendar.schema == schemas.typed_schema("calendar")


def test_stop_times(feed):
    got = rows(feed.stop_times.filter("not _missing"), "trip_id", "arrival_time", "arrival_secs", "departure_secs", "stop_sequence")
    assert got == [
        ("onet1", "25:35:00", 92100, 92160, 1), ("onet1", "8:05:00", 29100, 29100, 2), ("onet1", "ab:cd:ef", None, None, 7),
    ]


def test_positional_binding_shifts_columns(spark, root):
    listed = manifest.active_feeds(manifest.read_manifest(spark, str(root / "manifest.csv")))
    found = manifest.table_files(manifest.list_files(spark, str(root / "data")), listed)
    two = gtfs.read_table(spark, "stops", found.filter("gtfs_id = 'two'"), positional=True)
    assert two.first().stop_id == "two1.5"


def test_fractions_can_be_null(spark, root):
    listed = manifest.active_feeds(manifest.read_manifest(spark, str(root / "manifest.csv")))
    found = manifest.table_files(manifest.list_files(spark, str(root / "data")), listed)
    got = gtfs.read_table(spark, "stop_times", found, round_fractions=False)
    assert rows(got.filter("arrival_time = '8:05:00'"), "stop_sequence") == [(None,)]


def listing(spark, folder, table):
    out = [(f"f{k}", table, str(path), path.name) for k, path in enumerate(sorted(folder.iterdir()))]
    return spark.createDataFrame(out, "gtfs_id string, table string, path string, relative string")


def test_headers_of_all_forms(spark, tmp_path):
    wide = ",".join(f"x{k}" for k in range(300))
    texts = {
        "a": 'stop_name,stop_id\nn,a\n'.encode(), "b": b'\n  \nstop_id,stop_name\nb,n\n', "c": b"",
        "d": 'stop_name,"odd\nname",stop_id\nn,x,d\n'.encode(), "e": "stop_name,stop_id\nn,e\n".encode("utf-16"),
        "f": '\ufeff"stop_id","stop_name"\nf,n\n'.encode(), "g": f'"odd\nname",{wide},stop_id,stop_name\n,{"," * 300}g,n\n'.encode(),
        "h": "stop_id,stop_name,größe\nh,n,1\n".encode("latin-1"), "i": b" stop_id , stop_name\ni,n\n",
    }
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text)
    got = gtfs.read_raw(spark, "stops", listing(spark, tmp_path, "stops"), encoding={"f4": "UTF-16", "f7": "ISO-8859-1"})
    assert rows(got, "stop_id", "stop_name") == [(name, "n") for name in "abdefghi"]


@pytest.mark.parametrize("first", ["stop_id,stop_name", 'stop_id,"stop\nname"'])
def test_headers_take_as_many_jobs_for_many_files_as_for_few(spark, tmp_path, first):
    def jobs(count):
        folder = tmp_path / str(count)
        folder.mkdir()
        for k in range(count):
            (folder / f"{k}.txt").write_text(f"{first}{',x' * (k % 3)}\n{k},n\n")
        files, group = listing(spark, folder, "stops"), f"headers of {count}"
        spark.sparkContext.setJobGroup(group, group)
        rows_read = gtfs.read_raw(spark, "stops", files)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert rows_read.count() == count
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs(30) == jobs(3)


def test_report_of_files(spark, root):
    feeds = manifest.active_feeds(manifest.read_manifest(spark, str(root / "manifest.csv")))
    found = manifest.table_files(manifest.list_files(spark, str(root / "data")), feeds)
    got = rows(manifest.file_report(found, feeds, ["stops", "stop_times"]).filter("found"), "gtfs_id", "table")
    assert got == [("one", "stop_times"), ("one", "stops"), ("two", "stops")]


def test_sink_prunes_feeds(spark, feed, tmp_path):
    sinks.write_feed(feed, str(tmp_path / "out"), ["stops"])
    back = sinks.load_feed(spark, str(tmp_path / "out"), ["stops"]).stops
    assert back.count() == feed.stops.count()
    assert sinks.load_feed(spark, str(tmp_path / "out"), ["stops"]).complete("stops").count() == feed.complete("stops").count()
    plan = back.filter("gtfs_id = 'one'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(gtfs_id" in plan


EXAMPLES = '''# head
example_1:
    feed: "SFO"
    question: How many trips?
    answer: |
        ```python
        x = 1
            y = 2
    z
        ```

example_12:
  question: Only a question
other:
example_x: no label
'''


def test_corpus(spark, tmp_path):
    (tmp_path / "e.yaml").write_text(EXAMPLES, encoding="utf-8")
    (tmp_path / "q.json").write_text('["  one ", "", "二つ", null, 7, {"a": "b"}, ["c"], "four"]', encoding="utf-8")
    (tmp_path / "bad.json").write_text("{not json", encoding="utf-8")
    docs = corpus.read_corpus(
        spark, examples={str(tmp_path / "e.yaml"): "few_shot"},
        questions={str(tmp_path / "q.json"): "sample_en", str(tmp_path / "absent.json"): "x", str(tmp_path / "bad.json"): "y"},
    ).orderBy("doc_id").collect()
    assert [d.text for d in docs] == [
        "feed: SFO\nquestion: How many trips?\nanswer:\n```python\nx = 1\n    y = 2\nz\n```",
        "question: Only a question", "one", "二つ", "four",
    ]
    assert docs[0].source.endswith("e.yaml#example_1") and docs[3].source.endswith("q.json[2]")
