"""Small hand-made feeds."""

from __future__ import annotations

import datetime

from dayrunner.feed import Feed
from dayrunner.functions.columns import DAYS

D = datetime.date


def small_feed(spark) -> Feed:
    """Two feeds with equal raw ids; odd spans, exceptions and times."""
    calendar = [
        ("x", "daily", *(1,) * 7, D(2024, 1, 1), D(2024, 1, 7)),
        ("x", "weekend", 0, 0, 0, 0, 0, 1, 1, D(2024, 1, 1), D(2024, 1, 14)),
        ("x", "reversed", *(1,) * 7, D(2024, 2, 1), D(2024, 1, 1)),
        ("x", "open", *(1,) * 7, None, D(2024, 1, 1)),
        ("y", "daily", *(1,) * 7, D(2024, 1, 1), D(2024, 1, 2)),
    ]
    dates = [
        ("x", "daily", D(2024, 1, 3), 2), ("x", "daily", D(2024, 1, 9), 1), ("x", "daily", D(2024, 1, 9), 1),
        ("x", "extra", D(2024, 1, 5), 1), ("x", "weekend", D(2024, 1, 6), 1), ("y", "daily", D(2024, 1, 30), 2),
    ]
    trips = [
        ("x", "t1", "r1", "daily", 0, "s1", "b1"), ("x", "t2", "r1", "weekend", 0, "s1", None),
        ("x", "t3", "r2", "daily", 1, None, "b1"), ("x", "t4", "r2", "reversed", 1, None, None),
        ("y", "t1", "r1", "daily", 0, "s1", None),
    ]
    stop_times = [
        ("x", "t1", "a", 5, 100, 110, 0.0), ("x", "t1", "b", 7, 400, 420, 1000.0), ("x", "t1", "c", 9, 90000, 90010, 5000.0),
        ("x", "t2", "c", 1, 200, 200, None), ("x", "t2", "a", 2, 500, 500, None),
        ("x", "t3", "d", 1, 300, 330, None), ("x", "t3", "d", 2, 300, 300, None),
        ("y", "t1", "a", 1, 60, 60, 0.0),
    ]
    stops = [
        ("x", "a", "Green & Main (NW Corner)", 35.0, 139.0, 0, "p", 1), ("x", "b", "Oak St & Neil Ave", 35.001, 139.0, 0, None, 0),
        ("x", "c", "Airport Terminal", 35.0, 139.001, 0, None, 1), ("x", "d", "Main", 36.0, 139.0, 0, None, 2),
        ("x", "p", "Central", 35.0, 139.0, 1, None, None), ("y", "a", "Other", 35.0, 139.0, 0, None, 1),
    ]
    routes = [
        ("x", "r1", "ag1", "1", "Green Express", 0, "n1"), ("x", "r2", "ag2", "2", None, 3, None),
        ("x", "r3", "ag1", "3", "Unused", 3, "n1"), ("y", "r1", "ag1", "1", "Y line", 3, None),
    ]
    shapes = [("x", "s1", 1, 35.0, 139.0, None), ("x", "s1", 2, 35.001, 139.0, None), ("x", "s1", 3, 35.0, 139.0, None)]
    make = spark.createDataFrame
    return Feed(dict(
        calendar=make(calendar, "gtfs_id string, service_id string, " + ", ".join(f"{d} int" for d in DAYS)
                      + ", start_date date, end_date date"),
        calendar_dates=make(dates, "gtfs_id string, service_id string, date date, exception_type int"),
        trips=make(trips, "gtfs_id string, trip_id string, route_id string, service_id string, direction_id int, "
                          "shape_id string, block_id string"),
        stop_times=make(stop_times, "gtfs_id string, trip_id string, stop_id string, stop_sequence int, "
                                    "arrival_secs int, departure_secs int, shape_dist_traveled double"),
        stops=make(stops, "gtfs_id string, stop_id string, stop_name string, stop_lat double, stop_lon double, "
                          "location_type int, parent_station string, wheelchair_boarding int"),
        routes=make(routes, "gtfs_id string, route_id string, agency_id string, route_short_name string, "
                            "route_long_name string, route_type int, network_id string"),
        shapes=make(shapes, "gtfs_id string, shape_id string, shape_pt_sequence int, shape_pt_lat double, "
                            "shape_pt_lon double, shape_dist_traveled double"),
    ))
