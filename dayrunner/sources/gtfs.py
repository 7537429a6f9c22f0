"""Schedule tables from CSV files: lenient, typed, with provenance and own keys."""

from __future__ import annotations

import codecs
import csv
import re
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dayrunner import schemas
from dayrunner.feed import Feed
from dayrunner.functions import columns as C
from dayrunner.sources import manifest as M

# Encodings in which a quote or a line break is more than one byte: such files
# are not looked through for quoted line breaks and never split.
WIDE_ENCODING = re.compile(r"(?i)utf-?(16|32)")
# Columns of a first record that are read at once where it has line breaks.
MOST_COLUMNS = 200
# Signs that mean something in a path pattern.
PATTERN_SIGNS = re.compile(r"([\\{}\[\]*?,])")


def empty_table(spark: SparkSession, table: str) -> DataFrame:
    """The typed relation without rows, for a table no feed has."""
    return spark.createDataFrame([], schemas.typed_schema(table))


def literal_path(path: str) -> str:
    """A path that Spark's readers take as it is, not as a pattern."""
    return PATTERN_SIGNS.sub(r"\\\1", path)


def scanned_path() -> Column:
    """The scanned file's path as listings spell it: the metadata column is URL-encoded."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def _csv_options(encoding: str) -> dict[str, object]:
    return {"header": True, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "encoding": encoding}


def first_records(spark: SparkSession, paths: Sequence[str], encoding: str) -> dict[str, tuple[str, ...]]:
    """The first record of every file in one read, however many lines it has.

    Records of over ``MOST_COLUMNS`` columns are asked for file by file.
    """
    names = [f"c{i}" for i in range(MOST_COLUMNS + 1)]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    options = {**_csv_options(encoding), "header": False, "multiLine": True}
    rows = spark.read.schema(schema).options(**options).csv([literal_path(p) for p in paths])
    firsts = rows.select(scanned_path().alias("path"), F.monotonically_increasing_id().alias("at"), F.array(*names).alias("record"))
    out = {}
    for row in firsts.groupBy("path").agg(F.min_by("record", "at").alias("record")).collect():
        record = row.record
        if record[-1] is not None:
            record = spark.read.options(**options).csv(literal_path(row.path)).first()
        filled = max((i + 1 for i, name in enumerate(record) if name is not None), default=0)
        out[_plain(row.path)] = _names(record[:filled])
    return out


def _known(encoding: str) -> bool:
    try:
        codecs.lookup(encoding)
    except LookupError:
        return False
    return True


def _names(record: Sequence[str | None]) -> tuple[str, ...]:
    return tuple((name or "").lstrip("\ufeff").strip() for name in record)


def _bound(header: Sequence[str], wanted: Sequence[str]) -> tuple[str, ...]:
    """The header with the first place of each wanted column under its name, others unused.

    A reader puts the place after names that occur more than once.
    """
    out = [f"_unused_{i}" for i in range(len(header))]
    for name in wanted:
        places = [i for i, h in enumerate(header) if h in (name, f"{name}{i}")]
        if places:
            out[places[0]] = name
    return tuple(out)


def first_lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Of every file, its first line that isn't blank and whether a line has unbalanced
    quotes, in one scan of all lines. A file's first split holds its first line, and rows
    are numbered in the order of reading. One row a file is returned.

    Only first blocks and unbalanced lines are aggregated, and ``collect_set`` (of one
    boolean) has them aggregated by hash: a line alone would have all lines sorted.
    """
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    heads = (F.col("_metadata.file_block_start") == 0) & (F.length(F.trim("value")) > 0)
    lines = spark.read.text([literal_path(p) for p in paths]).select(
        scanned_path().alias("path"), (quotes % 2 == 1).alias("odd"),
        F.when(heads, F.monotonically_increasing_id()).alias("at"), F.when(heads, F.col("value").cast("binary")).alias("line"))
    return lines.filter("odd or at is not null").groupBy("path").agg(
        F.array_contains(F.collect_set("odd"), True).alias("odd"), F.min_by("line", "at").alias("line"))


def looked_through(spark: SparkSession, paths: Sequence[str]) -> dict[str, tuple[bytes | None, bool]]:
    """``first_lines`` by plain path; files without one, and with balanced quotes, may lack."""
    found = first_lines(spark, paths)
    return {_plain(r.path): (None if r.line is None else bytes(r.line), r.odd) for r in found.collect()}


def headers_of(
    spark: SparkSession, encodings: Mapping[str, str], looked: Mapping[str, tuple[bytes | None, bool]]
) -> dict[str, tuple[str, ...]]:
    """Column names of every file; files without a line have none.

    First lines already looked at are split here; where the first record goes on after
    its first line, or in a wide encoding, one more read an encoding finds the rest.
    """
    headers: dict[str, tuple[str, ...]] = {}
    others: dict[str, list[str]] = {}
    for path, code in encodings.items():
        line, _ = looked.get(_plain(path), (None, False))
        if WIDE_ENCODING.match(code) or not _known(code) or (line is not None and line.count(b'"') % 2 == 1):
            others.setdefault(code, []).append(path)
        elif line is not None:
            headers[_plain(path)] = _names(next(csv.reader([line.decode(code, "replace").lstrip("\ufeff")])))
    for code, paths in others.items():
        headers |= first_records(spark, paths, code)
    return headers


def read_raw(
    spark: SparkSession, table: str, files: DataFrame, *, positional: bool = False, encoding: str | Mapping[str, str] = "UTF-8"
) -> DataFrame:
    """All-string rows of a table's files plus ``path``, spelled as in the listing.

    Columns are bound by header name, in any order, absent ones NULL; with
    ``positional`` by their place in the declared column list. Files with quoted
    line breaks are read whole, the others may be split. ``encoding`` holds for
    all files, or is given by feed (UTF-8 where it names none).
    """
    wanted = schemas.names(table)
    chosen = files.select("path", "gtfs_id").distinct().collect()
    encodings = {r.path: encoding if isinstance(encoding, str) else encoding.get(r.gtfs_id) or "UTF-8" for r in chosen}
    narrow = [p for p, e in encodings.items() if not WIDE_ENCODING.match(e)]
    looked = looked_through(spark, narrow) if narrow else {}
    headers = {} if positional else headers_of(spark, encodings, looked)
    layouts: dict[tuple, list[str]] = {}
    for path, code in encodings.items():
        names = tuple(wanted) if positional else _bound(headers.get(_plain(path), ()), wanted)
        _, odd = looked.get(_plain(path), (None, bool(WIDE_ENCODING.match(code))))
        layouts.setdefault((names, code, odd), []).append(path)
    parts = []
    for (names, code, multi_line), paths in layouts.items():
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
        rows = spark.read.schema(schema).options(**_csv_options(code)).option("multiLine", multi_line).csv([literal_path(p) for p in paths])
        columns = [F.col(c) if c in names else F.lit(None).cast("string").alias(c) for c in wanted]
        parts.append(rows.select(scanned_path().alias("path"), *columns))
    return reduce(DataFrame.unionByName, parts)


def _typed(name: str, kind: str, round_fractions: bool) -> Column:
    if kind == "int":
        return C.try_int(name, round_fractions=round_fractions)
    if kind == "double":
        return C.try_double(name)
    if kind == "date":
        return C.try_yyyymmdd(name)
    return F.col(name)


def typed(raw: DataFrame, table: str, *, round_fractions: bool = True) -> DataFrame:
    """Types, namespaced keys and parsed service times over all-string columns.

    ``raw`` carries gtfs_id, _path, _missing and the table's columns.
    """
    prefixed = schemas.PREFIXED[table]
    out = [F.col(n) for n, _ in schemas.PROVENANCE]
    for name, kind in schemas.fields(table):
        value = C.namespaced("gtfs_id", name) if name in prefixed else _typed(name, kind, round_fractions)
        out.append(value.alias(name))
    for text, secs in schemas.TIME_COLUMNS.get(table, {}).items():
        out.append(C.hms_to_seconds(text).alias(secs))
    return raw.select(*out)


def missing_rows(table: str, feeds: DataFrame) -> DataFrame:
    """One placeholder row per feed without the table: ids and values NULL,
    ``_missing`` true; an agency placeholder carries the feed id."""
    values = []
    for field in schemas.typed_schema(table):
        if field.name == "gtfs_id":
            value = F.col("gtfs_id")
        elif field.name == "_missing":
            value = F.lit(True)
        elif (table, field.name) == ("agency", "agency_id"):
            value = F.col("gtfs_id")
        else:
            value = F.lit(None).cast(field.dataType)
        values.append(value.alias(field.name))
    return feeds.select(*values)


def read_table(
    spark: SparkSession,
    table: str,
    found: DataFrame,
    feeds: DataFrame | None = None,
    *,
    emit_missing: bool | None = None,
    positional: bool = False,
    round_fractions: bool = True,
    encoding: str | Mapping[str, str] = "UTF-8",
) -> DataFrame:
    """One table over all feeds.

    ``found``: (gtfs_id, table, path, relative) from ``table_files``. Feed and
    relative path of a row come from its own file's path. Feeds without the table
    appear as placeholder rows where ``emit_missing`` says so (by default per
    table).
    """
    files = found.filter(F.col("table") == table)
    if files.isEmpty():
        out = empty_table(spark, table)
    else:
        raw = read_raw(spark, table, files, positional=positional, encoding=encoding)
        one = files.select("path", "relative").first()
        root = _plain(one.path.removesuffix(one.relative))
        relative = F.substring(_plain_path("path"), F.lit(len(root) + 1), F.length("path"))
        rows = raw.withColumn("_path", relative).withColumns({"gtfs_id": C.feed_id_from_path("_path"), "_missing": F.lit(False)})
        out = typed(rows, table, round_fractions=round_fractions)
    emit = table in schemas.PLACEHOLDER_TABLES if emit_missing is None else emit_missing
    if emit and feeds is not None:
        out = out.unionByName(missing_rows(table, M.missing_feeds(found, feeds, table)))
    return out


def _plain(path: str) -> str:
    """'file:/x', 'file:///x' and '/x' alike."""
    return re.sub(r"^file:/+", "/", path)


def _plain_path(c: str) -> Column:
    return F.regexp_replace(c, r"^file:/+", "/")


def read_feed(
    spark: SparkSession,
    root: str,
    manifest: DataFrame,
    *,
    tables: Iterable[str] = tuple(schemas.COLUMNS),
    sandbox_ids: Sequence[str] = (),
    **options,
) -> Feed:
    """All tables of all active feeds below ``root``, each read when first used.

    Analyses see real rows only; ``Feed.complete`` has the placeholder rows too.
    """
    feeds = M.active_feeds(manifest)
    found = M.table_files(M.list_files(spark, root), feeds, sandbox_ids)
    return Feed({}, {t: (lambda t=t: read_table(spark, t, found, feeds, **options)) for t in tables})
