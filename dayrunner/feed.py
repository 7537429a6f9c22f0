"""A feed set: table name -> DataFrame, resolved lazily.

Every table carries ``gtfs_id``; one ``Feed`` holds all operators' feeds at
once, so each analysis runs over every feed in a single job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession


class Feed(Mapping[str, DataFrame]):
    """Lazy, read-only mapping of table name to DataFrame.

    Tables given as ``complete`` hold placeholder rows (``_missing``) of feeds
    without the table. Those are left out of the tables that analyses see;
    ``complete()`` returns them with the rest.
    """

    def __init__(
        self,
        tables: Mapping[str, DataFrame | Callable[[], DataFrame]],
        complete: Mapping[str, DataFrame | Callable[[], DataFrame]] | None = None,
    ):
        self._complete = Feed(complete) if complete else {}
        real = {t: (lambda t=t: self._complete[t].filter("not _missing")) for t in self._complete}
        self._sources = {**real, **tables}
        self._frames: dict[str, DataFrame] = {}

    def complete(self, name: str) -> DataFrame:
        """The table with its placeholder rows, where it has any."""
        return self._complete[name] if name in self._complete else self[name]

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._frames:
            source = self._sources[name]
            self._frames[name] = source if isinstance(source, DataFrame) else source()
        return self._frames[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        try:
            return self[name]
        except KeyError as exc:
            raise AttributeError(f"feed has no table {name!r}") from exc

    def __iter__(self) -> Iterator[str]:
        return iter(self._sources)

    def __len__(self) -> int:
        return len(self._sources)

    def __contains__(self, name: object) -> bool:
        return name in self._sources

    def replace(self, **tables: DataFrame) -> Feed:
        """A new feed with some tables swapped, e.g. pre-filtered trips."""
        out = Feed({**self._sources, **self._frames, **tables})
        out._complete = {t: self._complete[t] for t in self._complete if t not in tables} if self._complete else {}
        return out

    def register(self, spark: SparkSession, prefix: str = "gtfs_") -> list[str]:
        """Expose every table as a temp view ``<prefix><table>``."""
        for name in self:
            self[name].createOrReplaceTempView(prefix + name)
        return [prefix + name for name in self]
