"""A paged listing as a stream: the offset is the last modification time seen and the ids that had it, so a restart goes on there."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator

from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

#: Rows of a page, and pages that a listing shows from an anchor on.
PAGE, PAGES = 250, 20

Page = Callable[[str | None, int], list[dict]]


def step(page: Page, since: str | None, seen: set[str], size: int = PAGE, pages: int = PAGES) -> tuple[list[dict], str | None, set[str]]:
    """What a listing ordered by modification time shows from the anchor `since` on and isn't among `seen`, the ids that had that time;
    and the next anchor with its ids. `page(since, number)` gives rows with id and modified.

    An anchor shows `size` * `pages` rows at most, which bounds what is held. No rows: the listing has ended, or more rows than it shows
    have the anchor's time.
    """
    rows, here = [], set(seen)
    for number in range(1, pages + 1):
        found = page(since, number)
        for r in found:
            if r["id"] not in here:
                here.add(r["id"])
                rows.append(r)
        if len(found) < size:
            break
    if not rows:
        return [], since, seen
    last = max(r["modified"] for r in rows)
    return rows, last, {r["id"] for r in rows if r["modified"] == last} | (seen if last == since else set())


def cursor(page: Page, size: int = PAGE, pages: int = PAGES) -> Iterator[str]:
    """Every id of a listing, anchor after anchor."""
    since, seen = None, set()
    while True:
        rows, since, seen = step(page, since, seen, size, pages)
        if not rows:
            return
        yield from (r["id"] for r in rows)


def saved(folder: str, size: int) -> Page:
    """The pages of a listing that was saved as JSON files of rows with id and modified in a local or mounted folder."""

    def page(since: str | None, number: int) -> list[dict]:
        rows = {}
        for name in sorted(os.listdir(folder)):
            if name.endswith(".json"):
                with open(f"{folder}/{name}", encoding="utf-8") as f:
                    rows |= {(r["modified"], r["id"]): r for r in json.load(f)}
        shown = [r for k, r in sorted(rows.items()) if since is None or k[0] >= since]
        return shown[(number - 1) * size : number * size]

    return page


class ListingSource(DataSource):
    """`spark.readStream.format("listing").option("path", folder)`, with options `size` and `pages`: id, modified of each row of the listing.

    Subclasses answer for another listing in `pages_of`.
    """

    @classmethod
    def name(cls) -> str:
        return "listing"

    def schema(self) -> str:
        return "id string, modified string"

    def pages_of(self, size: int) -> Page:
        return saved(self.options["path"], size)

    def simpleStreamReader(self, schema: T.StructType) -> SimpleDataSourceStreamReader:
        size, pages = int(self.options.get("size", PAGE)), int(self.options.get("pages", PAGES))
        return _ListingReader(self.pages_of(size), size, pages)


class _ListingReader(SimpleDataSourceStreamReader):
    """A micro-batch is one anchor. It can be read again: it ends with the ids that its end offset names."""

    def __init__(self, page: Page, size: int, pages: int) -> None:
        self.page, self.size, self.pages = page, size, pages

    def initialOffset(self) -> dict:
        return {"since": None, "seen": []}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, since, seen = step(self.page, start["since"], set(start["seen"]), self.size, self.pages)
        return iter([(r["id"], r["modified"]) for r in rows]), {"since": since, "seen": sorted(seen)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        rows, _, _ = step(self.page, start["since"], set(start["seen"]), self.size, self.pages)
        named = set(end["seen"])
        return iter([(r["id"], r["modified"]) for r in rows if r["modified"] < end["since"] or (r["modified"] == end["since"] and r["id"] in named)])

    def commit(self, end: dict) -> None:
        pass
