"""Schedule tables derived from the driver's parquet tables.

The same derivations are written twice: as Spark DataFrames (``schedule_feed``)
and as SQL text (``CTES``) for the side-by-side comparison. Trips are orders,
stop events are line items, stops are suppliers; order keys are dealt out to
five feeds, and every feed has all suppliers as stops.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dayrunner.feed import Feed

# Street names, zones and weekday rules of the derived tables.
STREETS = ("Green", "Main", "Oak", "Lincoln", "University", "Wright", "Springfield", "Neil")
ZONE_NAMES = ("Asia/Tokyo", "America/New_York", "America/Chicago", "Europe/Paris", "UTC")

_FEED = "concat('r', cast(pmod({0} div 7, 5) as string))"
_STREETS = ", ".join(f"'{s}'" for s in STREETS)
_ZONES = ", ".join(f"'{z}'" for z in ZONE_NAMES)
_FEEDS = "explode(array('r0', 'r1', 'r2', 'r3', 'r4')) as gtfs_id"


def tables(spark: SparkSession, sf_dir: str):
    """Reader of one parquet table by name."""
    return lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")


def schedule_feed(spark: SparkSession, sf_dir: str) -> Feed:
    read = tables(spark, sf_dir)

    def trips() -> DataFrame:
        feed = _FEED.format("o_orderkey")
        route = f"concat({feed}, cast(c_nationkey as string), '-', c_mktsegment)"
        customers = read("customer").select("c_custkey", "c_nationkey", "c_mktsegment")
        return (
            read("orders")
            .join(customers, F.col("o_custkey") == F.col("c_custkey"))
            .selectExpr(
                f"{feed} as gtfs_id",
                f"concat({feed}, cast(o_orderkey as string)) as trip_id",
                "o_orderkey as trip_no",
                f"{route} as route_id",
                f"concat({feed}, substr(o_orderpriority, 1, 1), o_orderstatus) as service_id",
                "cast(o_orderkey % 2 as int) as direction_id",
                f"concat({route}, '-', cast(o_orderkey % 2 as string)) as shape_id",
                f"case when o_orderkey % 13 <> 0 then concat({feed}, cast(o_custkey % 200 as string)) end as block_id",
                "cast(o_orderkey % 3 as int) as wheelchair_accessible",
                "cast(o_orderkey % 3 as int) as bikes_allowed",
                "concat('To ', c_mktsegment) as trip_headsign",
            )
        )

    def stop_times() -> DataFrame:
        # Fixture only: real stop_times arrive with stop_sequence in the file.
        in_trip = Window.partitionBy("l_orderkey").orderBy(
            "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate",
            "l_extendedprice", "l_quantity", "l_discount", "l_tax",
        )
        feed = _FEED.format("l_orderkey")
        return (
            read("lineitem")
            .select(
                "l_orderkey", "l_partkey", "l_suppkey",
                F.row_number().over(in_trip).alias("stop_sequence"),
                F.sum("l_quantity").over(in_trip.rowsBetween(Window.unboundedPreceding, 0)).alias("run"),
            )
            .selectExpr(
                f"{feed} as gtfs_id",
                f"concat({feed}, cast(l_orderkey as string)) as trip_id",
                f"concat({feed}, cast(l_suppkey as string)) as stop_id",
                "stop_sequence",
                "cast(l_orderkey * 137 % 90000 + stop_sequence * 240 + l_partkey % 60 as int) as arrival_secs",
                "cast(l_orderkey * 137 % 90000 + stop_sequence * 240 + l_partkey % 60"
                " + (l_suppkey % 4) * 15 as int) as departure_secs",
                "case when l_orderkey % 11 <> 0 then run * 20 end as shape_dist_traveled",
                "cast(l_partkey % 2 as int) as timepoint",
            )
        )

    def stops() -> DataFrame:
        return read("supplier").selectExpr("*", _FEEDS).selectExpr(
            "gtfs_id",
            "concat(gtfs_id, cast(s_suppkey as string)) as stop_id",
            "s_name as stop_code",
            f"case when s_suppkey % 25 = 24 then concat('Airport Terminal ', cast(s_suppkey % 7 as string)) "
            f"else concat(elt(cast(1 + s_suppkey % 8 as int), {_STREETS}), ' & ', "
            f"elt(cast(1 + (s_suppkey div 8) % 8 as int), {_STREETS}), "
            "case s_suppkey % 4 when 0 then ' (NW Corner)' when 1 then ' (SE Corner)' when 2 then ' MB' else '' end) "
            "end as stop_name",
            "35.0D + (s_suppkey * 37 % 1000) / 10000.0D as stop_lat",
            "139.0D + (s_suppkey * 91 % 1000) / 10000.0D as stop_lon",
            "concat(gtfs_id, cast(s_nationkey as string)) as zone_id",
            "case when s_suppkey % 5 = 0 then 1 else 0 end as location_type",
            "case when s_suppkey % 5 <> 0 and s_suppkey % 7 <> 3 then "
            "concat(gtfs_id, cast(s_suppkey - s_suppkey % 5 as string)) end as parent_station",
            "cast(s_suppkey % 3 as int) as wheelchair_boarding",
        )

    def routes() -> DataFrame:
        return (
            read("customer").select("c_nationkey", "c_mktsegment").distinct()
            .join(read("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .selectExpr("*", _FEEDS)
            .selectExpr(
                "gtfs_id",
                "concat(gtfs_id, cast(c_nationkey as string), '-', c_mktsegment) as route_id",
                "concat(gtfs_id, cast(n_regionkey as string)) as agency_id",
                "c_mktsegment as route_short_name",
                "case when n_nationkey % 10 <> 3 then concat(n_name, "
                "case when n_nationkey % 6 = 0 then ' Express' else '' end) end as route_long_name",
                "cast(n_nationkey % 4 as int) as route_type",
                "case when n_nationkey % 7 <> 0 then concat(gtfs_id, cast(n_nationkey % 4 as string)) end as network_id",
                "cast(n_nationkey as int) as nation_no",
            )
        )

    def calendar() -> DataFrame:
        p, status = "substr(o_orderpriority, 1, 1)", "o_orderstatus"
        day = lambda ones: f"case when p in ({ones}) then 1 else 0 end"
        return (
            read("orders")
            .selectExpr(f"{_FEED.format('o_orderkey')} as gtfs_id", f"{p} as p", f"{status} as s")
            .distinct()
            .selectExpr(
                "gtfs_id",
                "concat(gtfs_id, p, s) as service_id",
                f"{day('1, 2, 5')} as monday",
                f"{day('1, 2')} as tuesday",
                f"{day('1, 2, 5')} as wednesday",
                f"{day('1, 2')} as thursday",
                f"{day('1, 2, 5')} as friday",
                f"{day('1, 3')} as saturday",
                f"{day('1, 3, 4')} as sunday",
                "case s when 'F' then date'1995-01-02' when 'O' then date'1995-02-01' "
                "else date'1995-05-01' end as start_date",
                "case s when 'F' then date'1995-02-28' when 'O' then date'1995-04-30' "
                "else date'1995-04-01' end as end_date",
            )
        )

    def calendar_dates() -> DataFrame:
        feed = _FEED.format("o_orderkey")
        return (
            read("orders")
            .filter("o_orderdate < timestamp'1995-05-01' and o_orderkey % 7 = 0")
            .selectExpr(
                f"{feed} as gtfs_id",
                f"concat({feed}, substr(o_orderpriority, 1, 1), o_orderstatus) as service_id",
                "cast(o_orderdate as date) as date",
                "cast(1 + o_orderkey % 2 as int) as exception_type",
            )
            .groupBy("gtfs_id", "service_id", "date")
            .agg(F.max("exception_type").alias("exception_type"))
        )

    def agency() -> DataFrame:
        return read("region").selectExpr("*", _FEEDS).selectExpr(
            "gtfs_id",
            "concat(gtfs_id, cast(r_regionkey as string)) as agency_id",
            "r_name as agency_name",
            "concat('https://example.com/', cast(r_regionkey as string)) as agency_url",
            f"elt(cast(1 + r_regionkey as int), {_ZONES}) as agency_timezone",
            "case when r_regionkey <> 2 then concat('https://example.com/fares/', "
            "cast(r_regionkey as string)) end as agency_fare_url",
        )

    def feed_info() -> DataFrame:
        return read("region").selectExpr(
            "concat('r', cast(r_regionkey as string)) as gtfs_id",
            "r_name as feed_publisher_name",
            "'en' as feed_lang",
            "case when r_regionkey <> 3 then date'1995-01-01' end as feed_start_date",
            "case when r_regionkey <> 3 then date'1995-04-30' end as feed_end_date",
        )

    def shapes() -> DataFrame:
        samples = trips().groupBy("gtfs_id", "shape_id").agg(F.min_by("trip_id", "trip_no").alias("trip_id"))
        points = stops().select("gtfs_id", "stop_id", "stop_lat", "stop_lon")
        return (
            stop_times()
            .join(samples, ["gtfs_id", "trip_id"])
            .join(points, ["gtfs_id", "stop_id"])
            .selectExpr(
                "gtfs_id", "shape_id",
                "stop_lat as shape_pt_lat", "stop_lon as shape_pt_lon",
                "stop_sequence as shape_pt_sequence", "shape_dist_traveled",
            )
        )

    part_feed = "concat('r', cast(p_partkey % 5 as string))"

    def fare_attributes() -> DataFrame:
        return read("part").selectExpr(
            f"{part_feed} as gtfs_id",
            f"concat({part_feed}, cast(p_partkey as string)) as fare_id",
            "case when p_partkey % 8 <> 3 then p_retailprice end as price",
            "'USD' as currency_type",
            "cast(p_size % 2 as int) as payment_method",
            "cast(p_size % 3 as int) as transfers",
            "cast(p_size * 60 as int) as transfer_duration",
        )

    def fare_rules() -> DataFrame:
        base = routes().filter("nation_no % 9 <> 4").selectExpr("*", "cast(substr(gtfs_id, 2) as int) as f")
        return base.selectExpr(
            "gtfs_id", "route_id",
            "explode(filter(array(nation_no + 1, if(nation_no % 3 = 0, nation_no + 30, null)), "
            "x -> x is not null)) as k", "f",
        ).selectExpr("gtfs_id", "concat(gtfs_id, cast(5 * k + f as string)) as fare_id", "route_id")

    def fare_products() -> DataFrame:
        return read("part").selectExpr(
            f"{part_feed} as gtfs_id",
            f"concat({part_feed}, cast(p_partkey as string)) as fare_product_id",
            "p_name as fare_product_name",
            f"concat({part_feed}, cast(p_size % 6 as string)) as fare_media_id",
            "p_retailprice as amount",
            "'USD' as currency",
        )

    def fare_media() -> DataFrame:
        return (
            read("part").filter("p_size % 6 < 5")
            .selectExpr(f"{part_feed} as gtfs_id", "cast(p_size % 6 as int) as m").distinct()
            .selectExpr(
                "gtfs_id", "concat(gtfs_id, cast(m as string)) as fare_media_id",
                "concat('Media ', cast(m as string)) as fare_media_name",
                "m % 3 as fare_media_type",
            )
        )

    def fare_leg_rules() -> DataFrame:
        return read("part").filter("p_partkey % 20 < 5").selectExpr(
            f"{part_feed} as gtfs_id",
            f"concat({part_feed}, cast(p_size % 4 as string)) as network_id",
            f"concat({part_feed}, cast(p_partkey as string)) as fare_product_id",
        )

    def transfers() -> DataFrame:
        return read("supplier").filter("s_suppkey % 10 = 0").selectExpr("*", _FEEDS).selectExpr(
            "gtfs_id",
            "concat(gtfs_id, cast(s_suppkey as string)) as from_stop_id",
            "concat(gtfs_id, cast(s_suppkey + 1 as string)) as to_stop_id",
            "2 as transfer_type",
            "cast(60 + s_suppkey % 5 * 30 + s_suppkey % 3 * 10 as int) as min_transfer_time",
        )

    def frequencies() -> DataFrame:
        feed = _FEED.format("o_orderkey")
        return read("orders").filter("o_orderkey % 50 = 0").selectExpr(
            f"{feed} as gtfs_id",
            f"concat({feed}, cast(o_orderkey as string)) as trip_id",
            "cast(o_orderkey * 137 % 90000 as int) as start_secs",
            "cast(o_orderkey * 137 % 90000 + 7200 as int) as end_secs",
            "case when o_orderkey % 350 = 0 then 0 else 600 end as headway_secs",
            "cast(o_orderkey % 2 as int) as exact_times",
        )

    def translations() -> DataFrame:
        return (
            stops()
            .selectExpr("gtfs_id", "stop_id", "stop_code", "stop_name", "cast(substr(stop_id, 3) as bigint) as k")
            .filter("k % 3 < 2")
            .selectExpr(
                "gtfs_id", "'stops' as table_name", "if(k % 3 = 0, 'stop_name', 'stop_code') as field_name",
                "'ja' as language", "concat('駅 ', cast(k as string)) as translation",
                "if(k % 3 = 0, stop_id, null) as record_id",
                "if(k % 3 = 1, stop_code, null) as field_value",
            )
        )

    def attributions() -> DataFrame:
        return agency().selectExpr(
            "gtfs_id", "concat(agency_id, 'a') as attribution_id", "agency_id",
            "agency_name as organization_name", "'1' as is_operator",
        )

    built = dict(
        trips=trips, stop_times=stop_times, stops=stops, routes=routes, calendar=calendar,
        calendar_dates=calendar_dates, agency=agency, feed_info=feed_info, shapes=shapes,
        fare_attributes=fare_attributes, fare_rules=fare_rules, fare_products=fare_products,
        fare_media=fare_media, fare_leg_rules=fare_leg_rules, transfers=transfers,
        frequencies=frequencies, translations=translations, attributions=attributions,
    )
    raw = ("documents", "benchmark", "events", "region", "nation", "customer", "supplier",
           "part", "orders", "lineitem")
    return Feed({**built, **{t: (lambda t=t: read(t)) for t in raw}})


# --- the same tables as SQL text -------------------------------------------

_OF = "'r' || ((o_orderkey // 7) % 5)"
_LF = "'r' || ((l_orderkey // 7) % 5)"
_PF = "'r' || (p_partkey % 5)"
_ROUTE = f"{_OF} || c_nationkey || '-' || c_mktsegment"
_FIVE = "(values ('r0'), ('r1'), ('r2'), ('r3'), ('r4')) f(gtfs_id)"
_DAY = "(case when p in ({0}) then 1 else 0 end)"
_STREET_LIST = "[" + _STREETS + "]"
_ZONE_LIST = "[" + _ZONES + "]"

CTES: dict[str, str] = {
    "trips": f"""
        select {_OF} as gtfs_id, {_OF} || o_orderkey as trip_id, o_orderkey as trip_no,
          {_ROUTE} as route_id, {_OF} || substr(o_orderpriority, 1, 1) || o_orderstatus as service_id,
          cast(o_orderkey % 2 as integer) as direction_id,
          {_ROUTE} || '-' || (o_orderkey % 2) as shape_id,
          case when o_orderkey % 13 <> 0 then {_OF} || (o_custkey % 200) end as block_id,
          cast(o_orderkey % 3 as integer) as wheelchair_accessible,
          cast(o_orderkey % 3 as integer) as bikes_allowed,
          'To ' || c_mktsegment as trip_headsign
        from orders join customer on o_custkey = c_custkey""",
    "stop_times": f"""
        select {_LF} as gtfs_id, {_LF} || l_orderkey as trip_id, {_LF} || l_suppkey as stop_id,
          seq as stop_sequence,
          cast(l_orderkey * 137 % 90000 + seq * 240 + l_partkey % 60 as integer) as arrival_secs,
          cast(l_orderkey * 137 % 90000 + seq * 240 + l_partkey % 60 + (l_suppkey % 4) * 15 as integer) as departure_secs,
          case when l_orderkey % 11 <> 0 then run * 20 end as shape_dist_traveled,
          cast(l_partkey % 2 as integer) as timepoint
        from (select *, cast(row_number() over w as integer) as seq,
                sum(l_quantity) over (w rows between unbounded preceding and current row) as run
              from lineitem
              window w as (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_shipdate,
                           l_extendedprice, l_quantity, l_discount, l_tax))""",
    "stops": f"""
        select gtfs_id, gtfs_id || s_suppkey as stop_id, s_name as stop_code,
          case when s_suppkey % 25 = 24 then 'Airport Terminal ' || (s_suppkey % 7)
            else ({_STREET_LIST})[1 + s_suppkey % 8] || ' & ' || ({_STREET_LIST})[1 + (s_suppkey // 8) % 8] ||
              case s_suppkey % 4 when 0 then ' (NW Corner)' when 1 then ' (SE Corner)' when 2 then ' MB' else '' end
          end as stop_name,
          35.0::double + (s_suppkey * 37 % 1000) / 10000.0::double as stop_lat,
          139.0::double + (s_suppkey * 91 % 1000) / 10000.0::double as stop_lon,
          gtfs_id || s_nationkey as zone_id,
          case when s_suppkey % 5 = 0 then 1 else 0 end as location_type,
          case when s_suppkey % 5 <> 0 and s_suppkey % 7 <> 3 then gtfs_id || (s_suppkey - s_suppkey % 5) end as parent_station,
          cast(s_suppkey % 3 as integer) as wheelchair_boarding
        from supplier cross join {_FIVE}""",
    "routes": f"""
        select gtfs_id, gtfs_id || c_nationkey || '-' || c_mktsegment as route_id,
          gtfs_id || n_regionkey as agency_id, c_mktsegment as route_short_name,
          case when n_nationkey % 10 <> 3 then n_name || case when n_nationkey % 6 = 0 then ' Express' else '' end end as route_long_name,
          cast(n_nationkey % 4 as integer) as route_type,
          case when n_nationkey % 7 <> 0 then gtfs_id || (n_nationkey % 4) end as network_id,
          cast(n_nationkey as integer) as nation_no
        from (select distinct c_nationkey, c_mktsegment from customer)
          join nation on c_nationkey = n_nationkey cross join {_FIVE}""",
    "calendar": f"""
        select gtfs_id, gtfs_id || p || s as service_id,
          {_DAY.format("'1', '2', '5'")} as monday, {_DAY.format("'1', '2'")} as tuesday,
          {_DAY.format("'1', '2', '5'")} as wednesday, {_DAY.format("'1', '2'")} as thursday,
          {_DAY.format("'1', '2', '5'")} as friday, {_DAY.format("'1', '3'")} as saturday,
          {_DAY.format("'1', '3', '4'")} as sunday,
          case s when 'F' then date '1995-01-02' when 'O' then date '1995-02-01' else date '1995-05-01' end as start_date,
          case s when 'F' then date '1995-02-28' when 'O' then date '1995-04-30' else date '1995-04-01' end as end_date
        from (select distinct {_OF} as gtfs_id, substr(o_orderpriority, 1, 1) as p, o_orderstatus as s from orders)""",
    "calendar_dates": f"""
        select {_OF} as gtfs_id, {_OF} || substr(o_orderpriority, 1, 1) || o_orderstatus as service_id,
          cast(o_orderdate as date) as date, max(cast(1 + o_orderkey % 2 as integer)) as exception_type
        from orders where o_orderdate < timestamp '1995-05-01' and o_orderkey % 7 = 0 group by 1, 2, 3""",
    "agency": f"""
        select gtfs_id, gtfs_id || r_regionkey as agency_id, r_name as agency_name,
          'https://example.com/' || r_regionkey as agency_url, ({_ZONE_LIST})[1 + r_regionkey] as agency_timezone,
          case when r_regionkey <> 2 then 'https://example.com/fares/' || r_regionkey end as agency_fare_url
        from region cross join {_FIVE}""",
    "feed_info": """
        select 'r' || r_regionkey as gtfs_id, r_name as feed_publisher_name, 'en' as feed_lang,
          case when r_regionkey <> 3 then date '1995-01-01' end as feed_start_date,
          case when r_regionkey <> 3 then date '1995-04-30' end as feed_end_date
        from region""",
    "shapes": """
        select st.gtfs_id, shape_id, stop_lat as shape_pt_lat, stop_lon as shape_pt_lon,
          stop_sequence as shape_pt_sequence, shape_dist_traveled
        from stop_times st
          join (select gtfs_id, shape_id, arg_min(trip_id, trip_no) as trip_id from trips group by 1, 2) x
            on st.gtfs_id = x.gtfs_id and st.trip_id = x.trip_id
          join stops p on st.gtfs_id = p.gtfs_id and st.stop_id = p.stop_id""",
    "fare_attributes": f"""
        select {_PF} as gtfs_id, {_PF} || p_partkey as fare_id,
          case when p_partkey % 8 <> 3 then p_retailprice end as price, 'USD' as currency_type,
          cast(p_size % 2 as integer) as payment_method, cast(p_size % 3 as integer) as transfers,
          cast(p_size * 60 as integer) as transfer_duration
        from part""",
    "fare_rules": """
        select gtfs_id, gtfs_id || (5 * k + cast(substr(gtfs_id, 2) as integer)) as fare_id, route_id
        from (select gtfs_id, route_id, nation_no + 1 as k from routes where nation_no % 9 <> 4
              union all select gtfs_id, route_id, nation_no + 30 from routes where nation_no % 9 <> 4 and nation_no % 3 = 0)""",
    "fare_products": f"""
        select {_PF} as gtfs_id, {_PF} || p_partkey as fare_product_id, p_name as fare_product_name,
          {_PF} || (p_size % 6) as fare_media_id, p_retailprice as amount, 'USD' as currency
        from part""",
    "fare_media": f"""
        select gtfs_id, gtfs_id || m as fare_media_id, 'Media ' || m as fare_media_name, m % 3 as fare_media_type
        from (select distinct {_PF} as gtfs_id, cast(p_size % 6 as integer) as m from part where p_size % 6 < 5)""",
    "fare_leg_rules": f"""
        select {_PF} as gtfs_id, {_PF} || (p_size % 4) as network_id, {_PF} || p_partkey as fare_product_id
        from part where p_partkey % 20 < 5""",
    "transfers": f"""
        select gtfs_id, gtfs_id || s_suppkey as from_stop_id, gtfs_id || (s_suppkey + 1) as to_stop_id,
          2 as transfer_type, cast(60 + s_suppkey % 5 * 30 + s_suppkey % 3 * 10 as integer) as min_transfer_time
        from supplier cross join {_FIVE} where s_suppkey % 10 = 0""",
    "frequencies": f"""
        select {_OF} as gtfs_id, {_OF} || o_orderkey as trip_id, cast(o_orderkey * 137 % 90000 as integer) as start_secs,
          cast(o_orderkey * 137 % 90000 + 7200 as integer) as end_secs,
          case when o_orderkey % 350 = 0 then 0 else 600 end as headway_secs,
          cast(o_orderkey % 2 as integer) as exact_times
        from orders where o_orderkey % 50 = 0""",
    "translations": """
        select gtfs_id, 'stops' as table_name, case when k % 3 = 0 then 'stop_name' else 'stop_code' end as field_name,
          'ja' as language, '駅 ' || k as translation,
          case when k % 3 = 0 then stop_id end as record_id, case when k % 3 = 1 then stop_code end as field_value
        from (select *, cast(substr(stop_id, 3) as bigint) as k from stops) where k % 3 < 2""",
    "attributions": """
        select gtfs_id, agency_id || 'a' as attribution_id, agency_id, agency_name as organization_name,
          '1' as is_operator
        from agency""",
    # Shared steps of many comparisons.
    "service_days": """
        select distinct gtfs_id, service_id, service_date from (
          select w.gtfs_id, w.service_id, w.service_date
          from (select gtfs_id, service_id, cast(d as date) as service_date,
                  case extract('dow' from d) when 0 then sunday when 1 then monday when 2 then tuesday
                    when 3 then wednesday when 4 then thursday when 5 then friday else saturday end as flag
                from (select *, unnest(generate_series(start_date, end_date, interval 1 day)) as d from calendar)) w
          left join calendar_dates e on w.gtfs_id = e.gtfs_id and w.service_id = e.service_id and w.service_date = e.date
          where flag = 1 and coalesce(e.exception_type, 0) <> 2
          union all
          select gtfs_id, service_id, date from calendar_dates where exception_type = 1)""",
    "trip_spans": """
        select gtfs_id, trip_id, min(arrival_secs) as first_arrival, max(arrival_secs) as last_arrival,
          min(departure_secs) as first_departure, max(departure_secs) as last_departure,
          arg_min(stop_id, stop_sequence) as first_stop, arg_max(stop_id, stop_sequence) as last_stop,
          arg_min(departure_secs, stop_sequence) as start_secs, arg_max(arrival_secs, stop_sequence) as end_secs,
          count(*) as n_stops, max(shape_dist_traveled) - min(shape_dist_traveled) as dist
        from stop_times group by 1, 2""",
    "route_stops": """
        select distinct s.gtfs_id, t.route_id, s.stop_id
        from stop_times s join trips t on s.gtfs_id = t.gtfs_id and s.trip_id = t.trip_id""",
    "steps": """
        select *, lag(arrival_secs) over w as prev_arrival, lag(departure_secs) over w as prev_departure,
          lag(shape_dist_traveled) over w as prev_dist, lead(stop_id) over w as next_stop,
          lead(arrival_secs) over w as next_arrival
        from stop_times window w as (partition by gtfs_id, trip_id order by stop_sequence)""",
}


def with_ctes(body: str) -> str:
    """Put the derivations a statement uses in front of it."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, sql in CTES.items():
            if re.search(rf"\b{name}\b", text) and name not in needed:
                visit(sql)
                if name not in needed:
                    needed.append(name)

    visit(body)
    body = body.strip()
    head = ",\n".join(f"{name} as ({CTES[name]})" for name in needed)
    if not head:
        return body
    if body.lower().startswith("with "):
        return f"with {head},\n{body[5:]}"
    return f"with {head}\n{body}"
