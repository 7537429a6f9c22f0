"""Side-by-side queries: name matching, retrieval and feed checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from dayrunner.catalog.registry import check
from dayrunner.catalog.tools import rounded, texts
from dayrunner.operators import choose as G
from dayrunner.operators import matching as N
from dayrunner.operators import quality as V
from dayrunner.operators import retrieval as R
from dayrunner.schemas import CORE_TABLES


def norm_sql(c: str) -> str:
    return (
        f"array_to_string(list_sort(list_filter(string_split_regex(regexp_replace(lower({c}), '\\([^)]*\\)', ' ', 'g'), "
        "'[^\\p{L}\\p{N}]+'), lambda w: w <> '')), ' ')"
    )


def score_sql(a: str, b: str) -> str:
    """Token sort ratio of two normalized names of up to 120 signs: bit vectors over the first one."""
    full = f"((1::hugeint << length({a})::int) - 1)"
    places = f"list_sum(list_transform(range(1, length({a}) + 1), lambda i: case when substr({a}, i, 1) = c then 1::hugeint << (i - 1)::int else 0::hugeint end))"
    masks = f"list_transform(string_split({b}, ''), lambda c: {places}::hugeint)"
    vector = f"list_reduce(list_prepend({full}, {masks}), lambda v, m: ((v + (v & m)) | (v - (v & m))) & {full})"
    fits = f"2 * least(length({a}), length({b})) >= 0.7 * (length({a}) + length({b})) - 1e-9"
    return f"(case when {fits} then 2 * (length({a}) - bit_count({vector}))::double / (length({a}) + length({b})) else 0 end)"


ASKED_STOPS = "select distinct replace(replace(stop_name, 'Main', 'Mian'), 'Oak', 'Oaks') as query from stops where location_type = 1"


def asked_stops(feed):
    name = F.replace(F.replace("stop_name", F.lit("Main"), F.lit("Mian")), F.lit("Oak"), F.lit("Oaks"))
    return feed.stops.filter("location_type = 1").select(name.alias("query")).distinct()


MATCHED_STOPS = f"""asked as ({ASKED_STOPS}),
    named as (select distinct gtfs_id, stop_id, {norm_sql('name')} as x from (
      select gtfs_id, stop_id, stop_id as name from stops union all select gtfs_id, stop_id, substr(stop_id, length(gtfs_id) + 1) from stops
      union all select gtfs_id, stop_id, stop_name from stops)),
    matched as (select query, gtfs_id, stop_id, max({score_sql(norm_sql('query'), 'x')}) as score
      from asked, named where {score_sql(norm_sql('query'), 'x')} >= 0.8 - 1e-9 group by 1, 2, 3)"""


@check("n1_fuzzy_stops", "N1", f"""
    with {MATCHED_STOPS} select query, gtfs_id, stop_id, round(score, 6) as score from matched""")
def _(feed):
    return rounded(N.match_stops(feed.stops, asked_stops(feed), 0.8), "score")


@check("n1_best_stop", "N1 G4", f"""
    with {MATCHED_STOPS} select query, gtfs_id, stop_id, round(score, 6) as score from (
      select *, row_number() over (partition by query, gtfs_id order by score desc, stop_id) as k from matched) where k = 1""")
def _(feed):
    return rounded(N.best_match(N.match_stops(feed.stops, asked_stops(feed), 0.8), "stop_id"), "score")


@check("n1_fuzzy_routes", "N1", f"""
    with asked as (select distinct replace(n_name, 'NATION_', 'Nations ') || ' (loop)' as query from nation),
    named as (select distinct gtfs_id, route_id, {norm_sql('name')} as x from (
      select gtfs_id, route_id, route_id as name from routes
      union all select gtfs_id, route_id, substr(route_id, length(gtfs_id) + 1) from routes union all select gtfs_id, route_id, route_short_name from routes
      union all select gtfs_id, route_id, route_long_name from routes where route_long_name is not null))
    select query, gtfs_id, route_id, round(max({score_sql(norm_sql('query'), 'x')}), 6) as score
    from asked, named where {score_sql(norm_sql('query'), 'x')} >= 0.7 - 1e-9 group by 1, 2, 3""")
def _(feed):
    asked = feed.nation.select(
        F.concat(F.replace("n_name", F.lit("NATION_"), F.lit("Nations ")), F.lit(" (loop)")).alias("query")
    )
    return rounded(N.match_routes(feed.routes, asked, 0.7), "score")


STREETS_SQL = f"""streets as (select distinct gtfs_id, stop_id, name, {norm_sql('name')} as x from (
      select gtfs_id, stop_id, regexp_replace(trim(regexp_replace(part, '\\b(st|street|ave|avenue|rd|road|blvd|dr|drive|ln|lane|way|mb)\\b\\.?', ' ', 'g')), '\\s+', ' ', 'g') as name
      from (select gtfs_id, stop_id, unnest(string_split_regex(regexp_replace(lower(stop_name), '\\([^)]*\\)', ' ', 'g'), '&|/|@| and | at ')) as part from stops))
      where name <> '')"""
ASKED_STREETS = "select unnest(['Gren', 'Mian', 'Oak', 'Lincon', 'Universty', 'Wright St', 'Sprngfield', 'Neil']) as query"


@check("n3_stops_on_street", "N3 N2", f"""
    with {STREETS_SQL}, asked as (select distinct split_part(stop_name, ' & ', 1) || 's' as query from stops where stop_name like '%&%')
    select query, gtfs_id, stop_id, round(max({score_sql(norm_sql('query'), 'x')}), 6) as score
    from asked, streets where {score_sql(norm_sql('query'), 'x')} >= 0.8 - 1e-9 group by 1, 2, 3""")
def _(feed):
    first = F.split_part("stop_name", F.lit(" & "), F.lit(1))
    asked = feed.stops.filter(F.col("stop_name").contains("&")).select(F.concat(first, F.lit("s")).alias("query"))
    return rounded(N.stops_on_street(feed.stops, asked, 0.8), "score")


@check("n2_stops_at_intersection", "N2", f"""
    with {STREETS_SQL}, asked as (
      select distinct stop_code as crossing_id, split_part(stop_name, ' & ', 1) || 's' as a,
        regexp_replace(split_part(stop_name, ' & ', 2), ' (MB|\\(.*\\))$', '') as b
      from stops where stop_name like '%&%')
    select crossing_id, p.gtfs_id, p.stop_id, round(max({score_sql(norm_sql('a'), 'p.x')} + {score_sql(norm_sql('b'), 'q.x')}), 6) as score
    from asked join streets p on {score_sql(norm_sql('a'), 'p.x')} >= 0.75 - 1e-9
      join streets q on q.gtfs_id = p.gtfs_id and q.stop_id = p.stop_id and q.name <> p.name and {score_sql(norm_sql('b'), 'q.x')} >= 0.75 - 1e-9
    group by 1, 2, 3""")
def _(feed):
    second = F.regexp_replace(F.split_part("stop_name", F.lit(" & "), F.lit(2)), r" (MB|\(.*\))$", "")
    crossings = feed.stops.filter(F.col("stop_name").contains("&")).select(
        F.col("stop_code").alias("crossing_id"),
        F.concat(F.split_part("stop_name", F.lit(" & "), F.lit(1)), F.lit("s")).alias("street_a"),
        second.alias("street_b"),
    ).distinct()
    return N.stops_at_intersection(feed.stops, crossings, 0.75, places=6)


# --- retrieval -------------------------------------------------------------

TOKENS_SQL = """list_transform(regexp_extract_all(lower(text), '[0-9a-z_]+|[\\x{3040}-\\x{30ff}\\x{3400}-\\x{9fff}]+'), lambda tok:
      case when regexp_matches(tok, '[\\x{3040}-\\x{30ff}\\x{3400}-\\x{9fff}]') and length(tok) >= 3
        then list_concat([tok], list_transform(range(1, least(length(tok) - 1, 20) + 1), lambda i: substring(tok, i, 2)))
        else [tok] end)"""
INDEX_SQL = f"""doc_terms as (
      select doc_id, term, count(*) as tf from (select doc_id, unnest(flatten({TOKENS_SQL})) as term from documents) group by 1, 2),
    idf as (select term, ln(((select count(*) from documents) + 1)::double / (count(*) + 1)) + 1 as idf from doc_terms group by 1),
    doc_vec as (select doc_id, d.term, tf * idf as w from doc_terms d join idf on d.term = idf.term),
    doc_norm as (select doc_id, sqrt(sum(w * w)) as norm from doc_vec group by 1),
    q_vec as (select query_id, t.term, tf * idf as w from (
      select query_id, term, count(*) as tf from (select item_id as query_id, unnest(flatten({TOKENS_SQL})) as term from benchmark) group by 1, 2) t
      join idf on idf.term = t.term),
    q_norm as (select query_id, sqrt(sum(w * w)) as norm from q_vec group by 1),
    scored as (select q.query_id, d.doc_id, sum(q.w * d.w) / (any_value(qn.norm) * any_value(dn.norm)) as score
      from q_vec q join doc_vec d on q.term = d.term join q_norm qn on qn.query_id = q.query_id join doc_norm dn on dn.doc_id = d.doc_id
      group by 1, 2),
    hits as (select * from (select *, row_number() over (partition by query_id order by round(score, 10) desc, doc_id) as place from scored) where place <= 4)"""


def corpus(feed):
    return feed.documents.select("doc_id", "text")


def asked(feed):
    return feed.benchmark.select(F.col("item_id").alias("query_id"), "text")


@check("r1_tokens", "R1", f"""
    with d as (select doc_id, flatten({TOKENS_SQL}) as t from documents)
    select doc_id, len(t) as n_tokens, len(list_distinct(t)) as n_terms, list_min(t) as least_token, list_max(t) as most_token from d""")
def _(feed):
    t = corpus(feed).select("doc_id", R.tokens("text").alias("t"))
    return t.select(
        "doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.size(F.array_distinct("t")).cast("bigint").alias("n_terms"),
        F.array_min("t").alias("least_token"), F.array_max("t").alias("most_token"),
    )


@check("r2_smoothed_idf", "R2", f"""
    with {INDEX_SQL} select term, round(idf, 9) as idf from idf""")
def _(feed):
    return rounded(R.Index(corpus(feed)).idf, "idf", places=9)


@check("r3_document_norms", "R3", f"""
    with {INDEX_SQL} select doc_id, round(norm, 6) as norm from doc_norm""")
def _(feed):
    index = R.Index(corpus(feed))
    return rounded(index.members.join(index.norms, "text_id").select("doc_id", "norm"), "norm")


@check("r4_cosine_top_k", "R4 G4", f"""
    with {INDEX_SQL} select query_id, doc_id, round(score, 6) as score, cast(place as integer) as place from hits""")
def _(feed):
    return rounded(R.retrieve(corpus(feed), asked(feed)), "score")


@check("r4_cosine_top_k_skipping", "R4 G4", f"""
    with {INDEX_SQL} select query_id, doc_id, round(score, 6) as score, cast(place as integer) as place from hits""")
def _(feed):
    return rounded(R.retrieve_skipping(corpus(feed), asked(feed)), "score")


DOCS_SQL = """docs as (select doc_id, 'documents[' || doc_id || ']' as source,
      case when doc_id % 2 = 0 then 'few_shot' else 'sample_en' end as kind, text from documents)"""
SNIPPET_SQL = """case when length(text) <= cap then text
      else regexp_replace(substring(text, 1, cap - 20), '\\s+$', '') || chr(10) || '…(truncated)…' end"""


def sourced(feed):
    return feed.documents.select(
        "doc_id", F.concat(F.lit("documents["), F.col("doc_id").cast("string"), F.lit("]")).alias("source"),
        F.when(F.col("doc_id") % 2 == 0, F.lit("few_shot")).otherwise(F.lit("sample_en")).alias("kind"), "text",
    )


@check("r5_snippets", "R5", f"""
    with {DOCS_SQL}
    select doc_id, md5({SNIPPET_SQL}) as snippet_md5, length({SNIPPET_SQL}) as snippet_chars
    from (select *, case when kind = 'few_shot' then 1800 else 400 end as cap from docs)""")
def _(feed):
    cut = sourced(feed).select("doc_id", R.snippet("text", "kind").alias("s"))
    return cut.select("doc_id", F.md5("s").alias("snippet_md5"), F.length("s").cast("bigint").alias("snippet_chars"))


@check("r6_packed_messages", "R6", f"""
    with {INDEX_SQL}, {DOCS_SQL},
    blocks as (
      select query_id, place, chr(10) || chr(10) || '---' || chr(10) || 'source: ' || source || chr(10) || 'score: ' || printf('%.3f', score)
        || chr(10) || {SNIPPET_SQL} as block
      from (select h.query_id, h.place, h.score, d.*, case when kind = 'few_shot' then 1800 else 400 end as cap
            from hits h join docs d on d.doc_id = h.doc_id)),
    run as (select *, sum(length(block)) over (partition by query_id order by place) as used from blocks)
    select query_id, md5(trim('{R.HEADER}' || coalesce(string_agg(block, '' order by place) filter (where used <= 6000 - {len(R.HEADER)}), ''))) as message_md5,
      count(*) filter (where used <= 6000 - {len(R.HEADER)}) as blocks
    from run group by 1""")
def _(feed):
    message = R.packed_messages(R.retrieve(corpus(feed), asked(feed)), sourced(feed))
    return message.select("query_id", F.md5("message").alias("message_md5"), "blocks")


# --- quality ---------------------------------------------------------------


@check("v1_not_null", "V1", " union all ".join(
    f"select '{t}' as \"table\", unnest(['gtfs_id', '_missing']) as \"column\", unnest([count(*) filter (where gtfs_id is null), count(*) filter (where gtfs_id = 'r3')]) as failures from {t}"
    for t in CORE_TABLES
))
def _(feed):
    # Rows of one feed break the rule on _missing.
    marked = {t: feed[t].withColumn("_missing", F.when(F.col("gtfs_id") != "r3", False)) for t in CORE_TABLES}
    return V.not_null_report(feed.replace(**marked))


@check("v2_requirements", "V2", """
    select 'trips' as "table", 'block_id' as "column", true as present, count(*) as rows, count(*) filter (where block_id is null) as nulls from trips
    union all select 'trips', 'shape_id', true, count(*), count(*) filter (where shape_id is null) from trips
    union all select 'stop_times', 'shape_dist_traveled', true, count(*), count(*) filter (where shape_dist_traveled is null) from stop_times
    union all select 'stops', 'platform_code', false, 0, 0
    union all select 'pathways', 'pathway_id', false, 0, 0""")
def _(feed):
    return V.requirement_report(feed, {
        "trips": ["block_id", "shape_id"], "stop_times": ["shape_dist_traveled"],
        "stops": ["platform_code"], "pathways": ["pathway_id"],
    })


@check("v3_orphans", "V3 D4", """
    select 'stop_times.stop_id' as reference, s.gtfs_id, count(distinct s.stop_id) as ids, count(*) as rows from stop_times s
      where not exists (select 1 from stops p where p.gtfs_id = s.gtfs_id and p.stop_id = s.stop_id) group by 2
    union all select 'stop_times.trip_id', s.gtfs_id, count(distinct s.trip_id), count(*) from stop_times s
      where not exists (select 1 from trips p where p.gtfs_id = s.gtfs_id and p.trip_id = s.trip_id) group by 2
    union all select 'trips.route_id', s.gtfs_id, count(distinct s.route_id), count(*) from trips s
      where not exists (select 1 from routes p where p.gtfs_id = s.gtfs_id and p.route_id = s.route_id) group by 2
    union all select 'trips.service_id', s.gtfs_id, count(distinct s.service_id), count(*) from trips s
      where not exists (select 1 from calendar p where p.gtfs_id = s.gtfs_id and p.service_id = s.service_id) group by 2
    union all select 'trips.shape_id', s.gtfs_id, count(distinct s.shape_id), count(*) from trips s
      where not exists (select 1 from shapes p where p.gtfs_id = s.gtfs_id and p.shape_id = s.shape_id) group by 2
    union all select 'routes.agency_id', s.gtfs_id, count(distinct s.agency_id), count(*) from routes s
      where not exists (select 1 from agency p where p.gtfs_id = s.gtfs_id and p.agency_id = s.agency_id) group by 2
    union all select 'fare_rules.fare_id', s.gtfs_id, count(distinct s.fare_id), count(*) from fare_rules s
      where not exists (select 1 from fare_attributes p where p.gtfs_id = s.gtfs_id and p.fare_id = s.fare_id) group by 2""")
def _(feed):
    return V.orphans(feed)


@check("v3_duplicates", "V3", """
    with doubled as (select gtfs_id, stop_id, count(*) as n from (
      select gtfs_id, stop_id from stops union all select gtfs_id, stop_id from stops) group by 1, 2 having count(*) > 1)
    select 'stops' as "table", gtfs_id, count(*) as keys, cast(sum(n) as bigint) as rows from doubled group by 2
    union all select 'trips', gtfs_id, count(*), cast(sum(n) as bigint) from (
      select gtfs_id, trip_id, count(*) as n from trips group by 1, 2 having count(*) > 1) group by 2""")
def _(feed):
    doubled = feed.stops.unionByName(feed.stops)
    return V.duplicates(feed.replace(stops=doubled), ["stops", "trips"])


@check("v3_missing_values", "V3 B16", """
    select gtfs_id, count(*) as rows, count(*) filter (where route_long_name is null) as route_long_name,
      count(*) filter (where network_id is null) as network_id from routes group by 1""")
def _(feed):
    return V.missing_values(feed, "routes", ["route_long_name", "network_id"])


@check("v4_availability", "V4", """
    select gtfs_id, bool_or(t = 'trips') as trips, bool_or(t = 'shapes') as shapes, bool_or(t = 'frequencies') as frequencies, false as pathways
    from (select gtfs_id, 'trips' as t from trips union all select gtfs_id, 'shapes' from shapes
      union all select gtfs_id, 'frequencies' from frequencies) group by 1""")
def _(feed):
    tag = lambda df, t: df.select("gtfs_id", F.lit(t).alias("table"), F.lit(True).alias("found")).distinct()
    files = (
        tag(feed.trips, "trips").unionByName(tag(feed.shapes, "shapes")).unionByName(tag(feed.frequencies, "frequencies"))
    )
    return V.availability(files, ["trips", "shapes", "frequencies", "pathways"])


@check("v5_agency_lookup", "V5", """
    select t.gtfs_id, t.agency_id, a.agency_name, a.agency_url, a.agency_timezone, a.agency_fare_url,
      cast(f.feed_start_date as varchar) as feed_start_date, cast(f.feed_end_date as varchar) as feed_end_date, t.routes
    from (select gtfs_id, agency_id, count(*) as routes from routes group by 1, 2) t
      join agency a on a.gtfs_id = t.gtfs_id and a.agency_id = t.agency_id left join feed_info f on f.gtfs_id = t.gtfs_id""")
def _(feed):
    used = feed.routes.groupBy("gtfs_id", "agency_id").agg(F.count("*").alias("routes"))
    return texts(used.join(V.agency_lookup(feed), ["gtfs_id", "agency_id"]), "feed_start_date", "feed_end_date")


INSTANT = "2024-03-05 12:34:56"


@check("v6_local_time", "V6", f"""
    select gtfs_id, agency_id, agency_timezone, cast(at_home as varchar) as now,
      cast(date_part('epoch', at_home - date_trunc('day', at_home)) as integer) as now_secs, dayname(at_home) as weekday
    from (select distinct a.gtfs_id, a.agency_id, agency_timezone, timestamptz '{INSTANT}+00' at time zone agency_timezone as at_home
      from agency a join routes r on a.gtfs_id = r.gtfs_id and a.agency_id = r.agency_id)""")
def _(feed):
    used = feed.routes.select("gtfs_id", "agency_id").distinct()
    local = V.local_now(feed, F.lit(INSTANT).cast("timestamp"))
    return local.join(used, ["gtfs_id", "agency_id"]).withColumn("now", F.col("now").cast("string"))
