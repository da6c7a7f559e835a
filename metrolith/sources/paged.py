"""A batch source for services that list their ids and give records by id, a page at a time."""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class IdRange(InputPartition):
    def __init__(self, ids: list[int]):
        super().__init__(0)
        self.ids = ids


class PagedReader(DataSourceReader):
    """Partitions are ranges of the listed ids. A page that fails is halved, down to single ids, which have to come."""

    def __init__(self, options):
        self.fetcher = options["fetcher"]
        self.page, self.parts = int(options.get("page", "100")), int(options.get("partitions", "8"))

    def _load(self):
        module, _, name = self.fetcher.partition(":")
        return getattr(importlib.import_module(module), name)()

    def partitions(self) -> list[IdRange]:
        ids = sorted(set(self._load().ids()))
        size = max(1, -(-len(ids) // self.parts))
        return [IdRange(ids[i : i + size]) for i in range(0, len(ids), size)] or [IdRange([])]

    def read(self, partition: IdRange) -> Iterator[tuple]:
        service = self._load()

        def records(ids: list[int]) -> Iterator[tuple]:
            try:
                got = {int(r["id"]): r for r in service.records(ids)}
            except OSError:
                if len(ids) == 1:
                    raise
                half = len(ids) // 2
                yield from records(ids[:half])
                yield from records(ids[half:])
                return
            missing = [i for i in ids if i not in got]
            if missing and len(ids) > 1:
                for i in missing:  # repaired one by one
                    got |= {int(r["id"]): r for r in service.records([i])}
                missing = [i for i in ids if i not in got]
            if missing:
                raise ValueError(f"listed ids were not given: {missing[:5]}")
            for i in ids:
                yield i, json.dumps({k: v for k, v in got[i].items() if k != "id"}, sort_keys=True, separators=(",", ":"))

        for at in range(0, len(partition.ids), self.page):
            yield from records(partition.ids[at : at + self.page])


class PagedFeatures(DataSource):
    """spark.read.format("paged_features").option("fetcher", "module:factory"): every listed id exactly once, or an error.

    factory() gives an object with ids() -> list of ids and records(ids) -> list of dicts with an "id".
    """

    @classmethod
    def name(cls) -> str:
        return "paged_features"

    def schema(self) -> str:
        return "id long, payload string"

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options)
