"""Result sources and document producers of a user's own, as data sources in Python.

A subclass says how one page of results, or one stretch of documents, is got; pages and stretches
are dealt to tasks. Register it with spark.dataSource.register() and read it by its name.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual


@dataclass
class Page(InputPartition):
    """A page of a query's results to be asked for."""

    search_id: int
    query: str
    start: int
    count: int


@dataclass
class Stretch(InputPartition):
    """Documents from first on, before end."""

    first: int
    end: int


class ResultSource(DataSource):
    """search_id, pos, title, url, summary of the results of queries.

    Options: queries (a JSON array of texts; search_id counts them from 0), start (first rank, 1 unless given), count
    (ranks of each query). Each page is a task; pages are aligned to the source's page size. A source may give
    other ranks than it was asked for; ranks outside the range are left out, and a page that it cannot give has no rows.
    With the option pushdown=true, which asks for spark.sql.python.filterPushdown.enabled, filters that compare search_id or
    pos with numbers choose the pages: no others are asked for.
    """

    #: Results that the source gives at once.
    page_size = 10

    @classmethod
    def name(cls) -> str:
        raise NotImplementedError("a source has a name")

    def schema(self) -> str:
        return "search_id long, pos int, title string, url string, summary string"

    def results(self, query: str, start: int, count: int) -> Iterator[tuple[int, str, str, str]]:
        """pos, title, url, summary of the results from rank start on."""
        raise NotImplementedError("a source gives results")

    def reader(self, schema) -> DataSourceReader:
        return (_ChosenPageReader if self.options.get("pushdown", "false").lower() == "true" else _PageReader)(self)


class _PageReader(DataSourceReader):
    def __init__(self, source: ResultSource):
        o = source.options
        self.source, self.queries = source, json.loads(o.get("queries", "[]"))
        self.start, self.count = int(o.get("start", 1)), int(o.get("count", source.page_size))
        if self.start < 1:
            raise ValueError("ranks start at 1")
        self.low, self.end = self.start, self.start + self.count
        self.ids: set[int] | None = None

    def partitions(self) -> Sequence[InputPartition]:
        size = self.source.page_size
        first = (self.low - 1) // size * size + 1
        wanted = [(i, q) for i, q in enumerate(self.queries) if q and (self.ids is None or i in self.ids)]
        return [Page(i, q, at, size) for i, q in wanted for at in range(first, self.end, size)] or [Page(0, "", 1, 0)]

    def read(self, partition: Page) -> Iterator[tuple]:
        if not partition.count:
            return
        low, end = max(partition.start, self.low), min(partition.start + partition.count, self.end)
        for pos, title, url, summary in self.source.results(partition.query, partition.start, partition.count):
            if low <= pos < end:
                yield partition.search_id, pos, title, url, summary


class _ChosenPageReader(_PageReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Take the comparisons of search_id and pos; the others are left to Spark."""
        for f in filters:
            name, value = getattr(f, "attribute", None), getattr(f, "value", None)
            whole = isinstance(value, int) and not isinstance(value, bool)
            if name == ("search_id",) and (isinstance(f, In) or isinstance(f, EqualTo) and whole):
                some = {v for v in f.value if v is not None} if isinstance(f, In) else {value}
                self.ids = some if self.ids is None else self.ids & some
            elif name == ("pos",) and whole and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, value + isinstance(f, GreaterThan))
                self.end = min(self.end, value + 1) if isinstance(f, EqualTo) else self.end
            elif name == ("pos",) and whole and isinstance(f, (LessThan, LessThanOrEqual)):
                self.end = min(self.end, value + isinstance(f, LessThanOrEqual))
            else:
                yield f


class DocumentProducer(DataSource):
    """number, doc_id, title, summary, url, date of a producer's documents, as a stream.

    The producer numbers its documents from 0 without gaps and must give the same ones again under
    the same numbers, since a stretch is read anew after a failure. Options: stretch (documents of
    a task, 1,000 unless given). As a batch it is what the producer has now.
    """

    @classmethod
    def name(cls) -> str:
        raise NotImplementedError("a producer has a name")

    def schema(self) -> str:
        return "number long, doc_id string, title string, summary string, url string, date timestamp"

    def produced(self) -> int:
        """How many documents there are so far."""
        raise NotImplementedError("a producer counts its documents")

    def documents(self, first: int, end: int) -> Iterator[tuple]:
        """doc_id, title, summary, url, date of the documents numbered from first on, before end."""
        raise NotImplementedError("a producer gives documents")

    def stretches(self, first: int, end: int) -> list[Stretch]:
        step = max(1, int(self.options.get("stretch", 1000)))
        return [Stretch(a, min(a + step, end)) for a in range(first, end, step)]

    def numbered(self, part: Stretch) -> Iterator[tuple]:
        for k, row in enumerate(self.documents(part.first, part.end), part.first):
            yield (k, *row)

    def reader(self, schema) -> DataSourceReader:
        return _ProducedReader(self)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _ProducerReader(self)


class _ProducedReader(DataSourceReader):
    def __init__(self, source: DocumentProducer):
        self.source = source

    def partitions(self) -> Sequence[InputPartition]:
        return self.source.stretches(0, self.source.produced()) or [Stretch(0, 0)]

    def read(self, partition: Stretch) -> Iterator[tuple]:
        return self.source.numbered(partition)


class _ProducerReader(DataSourceStreamReader):
    def __init__(self, source: DocumentProducer):
        self.source = source

    def initialOffset(self) -> dict:  # noqa: N802
        return {"next": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"next": self.source.produced()}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return self.source.stretches(start["next"], end["next"])

    def read(self, partition: Stretch) -> Iterator[tuple]:
        return self.source.numbered(partition)
