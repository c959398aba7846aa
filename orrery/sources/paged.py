"""A paged HTTP source as a Spark data source: one input partition a page.

``options``: url, limit, order, select, and optionally pages and schema.  The order column is
mandatory, so pages do not overlap.  Without ``pages`` the number of rows is asked for first, and
without ``schema`` the fields of the first page are the columns, all strings.  The page after the
last must be empty and all before it full, else the read fails: no row is left out in silence.  A page is fetched again on 429, 5xx and transport errors, waiting
``backoff * 2 ** (n - 1)`` seconds; other 4xx answers fail at once.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .tables import fields


def page_params(limit: int, offset: int, order: str, select: str = "") -> dict[str, str]:
    """Query parameters of one page."""
    if not order:
        raise ValueError("paging needs an order column")
    if limit < 1 or offset < 0:
        raise ValueError("limit and offset are out of range")
    return {"$limit": str(limit), "$offset": str(offset), "$order": order} | ({"$select": select} if select else {})


def fetch(url: str, retries: int = 4, backoff: float = 1.0, get: Callable | None = None, sleep: Callable = time.sleep) -> bytes:
    """One answer's body, with retries."""
    get = get or (lambda u: urllib.request.urlopen(u, timeout=60).read())
    for n in range(1, retries + 2):
        try:
            return get(url)
        except urllib.error.HTTPError as e:
            if (e.code != 429 and e.code < 500) or n > retries:
                raise
        except (urllib.error.URLError, TimeoutError):
            if n > retries:
                raise
        sleep(backoff * 2 ** (n - 1))
    raise AssertionError("unreachable")


def page(options: dict, number: int) -> list[dict]:
    """The records of one page."""
    limit = int(options["limit"])
    params = page_params(limit, number * limit, options["order"], options.get("select", ""))
    return json.loads(fetch(f"{options['url']}?{urllib.parse.urlencode(params)}"))


def row_count(options: dict) -> int:
    """The number of rows, asked of the source."""
    (row,) = json.loads(fetch(f"{options['url']}?{urllib.parse.urlencode({'$select': 'count(*) as n'})}"))
    return int(row["n"])


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "orrery_pages"

    def schema(self) -> str:
        if "schema" in self.options:
            return self.options["schema"]
        return ", ".join(f"`{c}` string" for c in fields(page(self.options, 0)))

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options, schema)


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.options, self.columns = dict(options), schema.names

    def partitions(self) -> list[InputPartition]:
        """One partition a page, and one more that must find nothing."""
        limit = int(self.options["limit"])
        pages = int(self.options["pages"]) if "pages" in self.options else -(-row_count(self.options) // limit)
        return [InputPartition((i, pages)) for i in range(pages + 1)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        number, pages = partition.value
        records = page(self.options, number)
        if number == pages and records:
            raise RuntimeError(f"rows after page {pages}")
        if number < pages - 1 and len(records) < int(self.options["limit"]):
            raise RuntimeError(f"page {number} of {pages} is short")
        for record in records:
            values = (record.get(c) for c in self.columns)
            yield tuple(v if v is None or isinstance(v, str) else json.dumps(v, sort_keys=True, separators=(",", ":")) for v in values)
