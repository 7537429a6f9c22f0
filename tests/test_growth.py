"""Steps whose rows multiply are put off until the rest is worked out; results stay those of the plain join."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dayrunner.feed import Feed
from dayrunner.operators import joins as J
from dayrunner.operators import matching as N
from dayrunner.operators import retrieval as R
from dayrunner.operators import sequences as Q
from dayrunner.operators import spatial as P
from dayrunner.sources import gtfs
from tests.conftest import rows
from tests.feeds import small_feed


@pytest.fixture(scope="module")
def feed(spark):
    return small_feed(spark)


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_stops_at_intersections_are_attached_last(spark):
    """Each crossing meets each kind of stop once; nothing is grouped over pairs of crossings and stops."""
    stops = spark.createDataFrame(
        [("f", str(i), "Neil & Oak" if i % 2 else "Oak & Main St (MB)") for i in range(60)] + [(None, "x", "Neil & Oak"), ("f", None, "Neil & Oak")],
        "gtfs_id string, stop_id string, stop_name string")
    asked = spark.createDataFrame(
        [(f"c{i}", "Niel", "Oak") for i in range(30)] + [("d", "Oak", "Mian"), ("d", "Oak", "Main"), (None, "Neil", "Oak"), ("e", None, "Oak")],
        "crossing_id string, street_a string, street_b string")
    found = N.stops_at_intersection(stops, asked, 0.5)
    got = {(r.crossing_id, r.stop_id): round(r.score, 6) for r in found.collect()}
    assert {k for k in got if k[0] == "c3"} == {("c3", str(i)) for i in range(1, 60, 2)}
    assert {k: v for k, v in got.items() if k[0] == "d"} == {("d", str(i)): 2.0 for i in range(0, 60, 2)}
    assert {v for k, v in got.items() if k[0] is None} == {2.0} and len(got) == found.count() == 30 * 32
    assert plan_of(found).startswith("Project") and "Aggregate" not in plan_of(found).splitlines()[1]


def test_crossings_meet_stops_in_tasks_of_bounded_size(spark, monkeypatch):
    """More pairs give more tasks, however few rows go in; lots, hot ones too, lose and repeat no pair."""
    monkeypatch.setattr(N, "TASK_PAIRS", 500, raising=False)
    monkeypatch.setattr(N, "LOT", 7, raising=False)
    stops = spark.createDataFrame(
        [("f" if i % 3 else "g", str(i), "Neil & Oak" if i % 5 else "Oak & Main") for i in range(200)] + [("f", "1", "Neil & Green")],
        "gtfs_id string, stop_id string, stop_name string")
    asked = spark.createDataFrame([(f"c{i}" if i else None, "Neil", "Oak") for i in range(90)] + [("d", "Mains", "Oak")], "crossing_id string, street_a string, street_b string")
    found = N.stops_at_intersection(stops, asked, 0.75, places=6)
    want = {(f"c{c}" if c else None, "f" if i % 3 else "g", str(i), 2.0) for c in range(90) for i in range(200) if i % 5}
    want |= {("d", "f" if i % 3 else "g", str(i), 1.888889) for i in range(0, 200, 5)}
    got = [tuple(r) for r in found.collect()]
    assert set(got) == want and len(got) == len(want)
    assert found.rdd.getNumPartitions() >= len(want) / 500
    assert "round" not in plan_of(found)


def test_nearest_stops_are_chosen_by_place(spark, feed):
    """The points at a place share its nearest k; ids are attached to those alone, repeated rows included."""
    spots = [("f", f"s{i}", 35.0 + (i % 5) * 0.001, 139.0) for i in range(40)] + [("f", "s1", 35.001, 139.0), ("f", None, 35.0, 139.0)]
    stops = spark.createDataFrame(spots, "gtfs_id string, stop_id string, stop_lat double, stop_lon double")
    found = P.stops_near(feed.replace(stops=stops), P.stop_points(stops), 300, k=3)
    plain = P.G.top_per(
        P.stops_near(feed.replace(stops=stops), P.stop_points(stops), 300), ["gtfs_id", "point_id"], ["metres", "stop_id"], 3, rank="place")
    assert rows(found) == rows(plain) and found.count() > 100
    assert plan_of(found).count("Window ") >= 3 and plan_of(plain).count("Window ") == 1


def test_connections_put_bits_together(spark):
    """No route is paired with every other one at each stop; numbers run over several words."""
    served = [("f", f"r{i}", f"s{j}") for i in range(150) for j in range(40) if (i * 7 + j * 3) % 11 == 0] + [("f", None, "s1"), ("f", "r1", None)]
    df = spark.createDataFrame([*served, ("g", "r1", "s1"), ("g", "r2", "s1")], "gtfs_id string, route_id string, stop_id string")
    found = J.connections(df)
    plain = J.connections_from(df, df).select("gtfs_id", "from_route_id", "route_id")
    assert rows(found) == rows(plain) and found.count() > 1000
    assert "bit_or" in plan_of(found)


def test_terms_are_counted_in_parts_of_bounded_size(spark, monkeypatch):
    """More text gives more tasks, not larger ones, whatever the number of shuffle partitions."""
    docs = spark.createDataFrame([(i, f"word{i} stop stop") for i in range(40)] + [(40, None), (41, "word1 stop stop")], "doc_id long, text string")
    norms = lambda index: {r.text_id: round(r.norm, 9) for r in index.norms.collect()}
    plain = norms(R.Index(docs))
    monkeypatch.setattr(R, "TASK_SIGNS", 20)
    texts, _ = R.distinct_texts(docs)
    assert R.dealt(texts, docs).rdd.getNumPartitions() > 30
    index = R.Index(docs)
    assert norms(index) == plain and {r.term: round(r.idf, 6) for r in index.idf.collect()}["stop"] == 1.02353


def products(texts, asked):
    sums = {}
    for text, term, dw in texts:
        for question, t, qw in asked:
            if t == term:
                sums[question, text] = sums.get((question, text), 0.0) + dw * qw
    return sums


def test_pairs_of_questions_and_texts_stay_in_their_part(spark, monkeypatch):
    """Texts and questions meet in parts and blocks; all pairs that can rank come out, with whole sums."""
    draw = random.Random(3)
    texts = [(t, f"w{w}", draw.random()) for t in range(90) for w in range(12) if draw.random() < 0.4] + [(5, "w1", 0.25)]
    asked = [(q, f"w{w}", draw.random()) for q in range(20) for w in range(14) if draw.random() < 0.3]
    monkeypatch.setattr(R, "PART_ASKED", 20)
    postings = spark.createDataFrame(texts, "text_id long, term string, dw double")
    found = R.best_products(postings, spark.createDataFrame([(*a, 0.0, 0.0) for a in asked], "query_id long, term string, qw double, floor double, slack double"), 3)
    assert "Join" not in plan_of(found)
    got, want = {(r.query_id, r.text_id): r.found for r in found.collect()}, products(texts, asked)
    assert len(got) < len(want) and all(abs(v - want[k]) < 1e-9 for k, v in got.items())
    for q in {a[0] for a in asked}:
        best = sorted(((-v, t) for (x, t), v in want.items() if x == q))[:3]
        assert {(q, t) for _, t in best} <= set(got)


def test_matrices_of_a_part_are_cut_to_size(monkeypatch):
    """However few cells a step may hold, sums are whole; the slack keeps what it says, the floor drops the rest."""
    draw = random.Random(4)
    texts = [(t, f"w{w}", draw.random()) for t in range(40) for w in range(9) if draw.random() < 0.5]
    asked = [(q, f"w{w}", draw.random()) for q in range(12) for w in range(10) if draw.random() < 0.4]
    table = lambda rows, *names: pa.table(dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)))
    left = table(texts, "text_id", "term", "dw")
    right = table([(*a, 0.2, 0.1) for a in asked], "query_id", "term", "qw", "floor", "slack")
    got = lambda: {(r["query_id"], r["text_id"]): round(r["found"], 9) for r in R._best_of_part(4)(left, right).to_pylist()}
    plain = got()
    for name, size in (("CELLS", 8), ("STEP_ASKED", 3), ("STEP_QUESTIONS", 2)):
        monkeypatch.setattr(R, name, size)
    want = products(texts, asked)
    fourth = {q: sorted((v for (x, _), v in want.items() if x == q), reverse=True)[:4][-1] for q in {a[0] for a in asked}}
    assert got() == plain == {k: round(v, 9) for k, v in want.items() if v + 0.1 >= max(0.2, fourth[k[0]]) - R.MARGIN}


def test_stops_within_a_radius_are_put_out_by_many_tasks(spark, feed, monkeypatch):
    """Tasks are counted by the pairs they put out, however few places there are."""
    monkeypatch.setattr(P, "TASK_HITS", 100)
    spots = [("f", f"s{i}", 35.0 + (i % 9) * 0.001, 139.0) for i in range(90)] + [("f", "s1", 35.001, 139.0), ("f", None, None, 139.0)]
    stops = spark.createDataFrame(spots, "gtfs_id string, stop_id string, stop_lat double, stop_lon double")
    found = P.stops_near(feed.replace(stops=stops), P.stop_points(stops), 300)
    want = [(a, b) for _, a, x, _ in spots[:91] for _, b, y, _ in spots[:91] if abs(x - y) < 0.0025]
    assert sorted((r.point_id, r.stop_id) for r in found.collect()) == sorted(want)
    assert found.rdd.getNumPartitions() > 10


def test_shared_sequences_are_put_in_order_by_tasks_of_bounded_size(spark, monkeypatch):
    """More stop events give more tasks; sequences over the ends of slices and of several lengths stay whole."""
    walks = [("f", f"t{r}", f"r{r % 7}", i, f"s{(i * 3 + r) % 11}") for r in range(14) for i in (*range(1, 9), 4094, 4095, 4097, 9000)]
    events = spark.createDataFrame(walks, "gtfs_id string, trip_id string, route_id string, stop_sequence int, stop_id string")
    monkeypatch.setattr(Q, "_pattern_stops", lambda _: events)
    monkeypatch.setattr(Q, "TASK_STOPS", 5)
    for n in (2, 3):
        routes = {}
        for trip in {w[1] for w in walks}:
            stops = [w[4] for w in walks if w[1] == trip]
            for i in range(len(stops) - n + 1):
                routes.setdefault(" > ".join(stops[i:i + n]), set()).add(next(w[2] for w in walks if w[1] == trip))
        found = Q.shared_sequences(None, n)
        assert {r.gram: r.routes for r in found.collect()} == {g: len(s) for g, s in routes.items() if len(s) > 1}
        assert "RepartitionByExpression" in plan_of(found) and f", {-(-len(walks) // 5)}" in plan_of(found)


@pytest.mark.parametrize("numbers", [range(40), (*range(1, 30), 4094, 4095, 4096, 8200, *range(9000, 9010))])
def test_longest_shared_sequences_read_stop_events_once(spark, numbers):
    """Stop events are derived in one pass, also where numbers run over slices; results equal brute force."""
    rng = random.Random(len(numbers))
    walks, routes = {}, {}
    for i in range(24):
        key = (f"f{i % 2}", f"t{i}")
        walks[key] = [rng.choice([None, *"abcde"]) for _ in range(rng.randint(1, len(numbers)))]
        routes[key] = rng.choice([None, "r1", "r2", "r3"])
    walks["f0", "t24"], routes["f0", "t24"] = walks["f0", "t0"], routes["f0", "t0"]
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(stop):
        read.add(1)
        return stop

    events = [(*k, n, s) for k, stops in walks.items() for n, s in zip(numbers, stops)]
    feed = Feed({
        "stop_times": spark.createDataFrame(events, "gtfs_id string, trip_id string, stop_sequence int, stop_id string")
        .withColumn("stop_id", counted.asNondeterministic()("stop_id")),
        "trips": spark.createDataFrame([(*k, r) for k, r in routes.items()], "gtfs_id string, trip_id string, route_id string"),
    })
    got = {(r.gtfs_id, r.gram): (r.routes, r.n) for r in Q.longest_shared_sequences(feed).collect()}
    assert read.value == len(events)
    want = {}
    for n in range(len(numbers), 0, -1):
        found = {}
        for key, stops in walks.items():
            for i in range(len(stops) - n + 1):
                if None not in stops[i:i + n] and routes[key]:
                    found.setdefault((key[0], " > ".join(stops[i:i + n])), set()).add(routes[key])
        want = {k: (len(r), n) for k, r in found.items() if len(r) > 1}
        if want:
            break
    assert want and got == want


def test_single_stops_are_shared_where_no_step_is(spark):
    walks = {("t1", "r1"): "abc", ("t2", "r2"): "cxa", ("t3", "r2"): "y"}
    feed = Feed({
        "stop_times": spark.createDataFrame([("f", t, n, s) for (t, _), w in walks.items() for n, s in enumerate(w)],
                                            "gtfs_id string, trip_id string, stop_sequence int, stop_id string"),
        "trips": spark.createDataFrame([("f", *k) for k in walks], "gtfs_id string, trip_id string, route_id string"),
    })
    assert sorted((r.gram, r.routes, r.n) for r in Q.longest_shared_sequences(feed).collect()) == [("a", 2, 1), ("c", 2, 1)]


def physical_plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_first_lines_of_files_need_no_sort_of_all_lines(spark, tmp_path):
    """A line as an aggregate would have every line of a task sorted by its long path."""
    (tmp_path / "a.txt").write_text('\n  \nid,name\n1,"x\n2,y\n')
    (tmp_path / "b.txt").write_text("id\n1\n")
    (tmp_path / "c.txt").write_text("")
    paths = [str(tmp_path / f"{n}.txt") for n in "abc"]
    assert "Sort" not in physical_plan_of(gtfs.first_lines(spark, paths)).replace("ObjectHash", "")
    assert gtfs.looked_through(spark, paths) == {paths[0]: (b"id,name", True), paths[1]: (b"id", False)}
