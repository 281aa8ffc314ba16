"""Search results, title lists and page files over HTTP, as Python data sources with a transport that can be replaced.

A transport is a function from a URL to bytes; sources name it as ``module:function``, so that executors can import it. The default
tries four times and waits longer after each. The address of the service is an option; none is built in.
"""

from __future__ import annotations

import importlib
import json
import time
import urllib.error
import urllib.parse
import urllib.request
import uuid
from collections.abc import Callable, Iterator
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThanOrEqual, InputPartition, LessThanOrEqual

TRIES, TIMEOUT, BACKOFF, PAUSE = 4, 30, 1.5, 0.2
ROW = (
    "bindingId string, bindingTitle string, publicationId string, date string, issue string, generalType string, publisher string, "
    "pageNumber string, baseUrl string, pdfUrl string, url string, copyrightWarnings string, textHighlights string, terms array<string>, "
    "pageCount int, pageImageTemplate string, altoXmlTemplate string, altoTxtTemplate string"
)
TEMPLATES = {"pageImageTemplate": "/image/{{page}}", "altoXmlTemplate": "/page-{{page}}.xml", "altoTxtTemplate": "/page-{{page}}.txt"}


def get(url: str, tries: int = TRIES) -> bytes:
    """The body at a URL."""
    for k in range(tries):
        try:
            with urllib.request.urlopen(urllib.request.Request(url), timeout=TIMEOUT) as r:
                return r.read()
        except (urllib.error.URLError, TimeoutError, ConnectionError):
            if k + 1 == tries:
                raise
            time.sleep(BACKOFF * (k + 1))
    raise ValueError("no tries")


def transport_of(name: str | None) -> Callable[[str], bytes]:
    if not name:
        return get
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def pages_of(first: str, base: str, fetch: Callable[[str], bytes], most: int = 0, pause: float = 0.0) -> Iterator[dict]:
    """Rows of a search, following its cursor until a page is empty, a call fails, no cursor is given, or ``most`` rows are out."""
    url, cursor, templates, counts, out = first, None, dict(TEMPLATES), {}, 0
    seen: set[str] = set()
    while True:
        try:
            page = json.loads(fetch(url))
        except (OSError, ValueError):
            return
        if not out and not seen:
            templates |= {k: page[k] for k in TEMPLATES if page.get(k)}
        seen.add(url)
        rows = page.get("rows") or []
        counts |= page.get("bindingPageCounts") or {}
        for row in rows:
            shown = row.get("textHighlights")
            if isinstance(shown, dict):
                shown = " ### ".join(shown.get("text") or [])
            number = counts.get(str(row.get("bindingId", "")), 1)
            yield row | templates | {"pageCount": int(number), "textHighlights": shown if isinstance(shown, str) else ""}
            out += 1
            if out == most:
                return
        cursor = page.get("scrollId") or cursor
        if not rows or not cursor:
            return
        url = f"{base}/{cursor}"
        time.sleep(pause)


class _Range(InputPartition):
    def __init__(self, start: str, end: str):
        self.start, self.end = start, end


class SearchReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Dates narrow the search; the filter is applied again to what comes back only if it was not taken."""
        for f in filters:
            column = tuple(f.attribute) if hasattr(f, "attribute") else ()
            if column == ("date",) and isinstance(f, (GreaterThanOrEqual, EqualTo)):
                self.options["startDate"] = max(self.options["startDate"], str(f.value)[:10])
            if column == ("date",) and isinstance(f, (LessThanOrEqual, EqualTo)):
                self.options["endDate"] = min(self.options["endDate"], str(f.value)[:10])
            yield f

    def partitions(self) -> list[_Range]:
        start, end = date.fromisoformat(self.options["startDate"]), date.fromisoformat(self.options["endDate"])
        days = (end - start).days + 1
        if days <= 0:
            return [_Range("", "")]
        n = 1 if int(self.options.get("maxResults", 0)) else min(days, int(self.options.get("splits", 1)))  # a limit needs one cursor
        cuts = [start + timedelta(days * k // n) for k in range(n)] + [end + timedelta(1)]
        return [_Range(a.isoformat(), (b - timedelta(1)).isoformat()) for a, b in zip(cuts, cuts[1:])]

    def read(self, partition: _Range) -> Iterator[tuple]:
        if not partition.start:
            return
        o = self.options
        params = {"startDate": partition.start, "endDate": partition.end, "formats": "NEWSPAPER", "requireOnline": "true"}
        if o.get("query"):
            params["query"] = o["query"]
        if o.get("language", "fi") not in ("", "all"):
            params["language"] = o.get("language", "fi")
        base = o["url"].rstrip("/")
        names = [c.split(" ")[0] for c in ROW.split(", ")]
        rows = pages_of(f"{base}?{urllib.parse.urlencode(params)}", base, transport_of(o.get("transport")), int(o.get("maxResults", 0)), float(o.get("pause", PAUSE)))
        for row in rows:
            yield tuple(
                row.get(n) if n == "pageCount" else (list(map(str, row.get(n) or [])) if n == "terms" else None if row.get(n) is None else str(row[n]))
                for n in names
            )


class IssueSearch(DataSource):
    """``spark.read.format("issue_search")`` with ``url, startDate, endDate, query, language, maxResults, splits, transport``."""

    @classmethod
    def name(cls) -> str:
        return "issue_search"

    def schema(self) -> str:
        return ROW

    def reader(self, schema) -> SearchReader:
        return SearchReader({"startDate": "1820-01-01", "endDate": "1939-12-31"} | {k: self.options.get(k) for k in (
            "url", "startDate", "endDate", "query", "language", "maxResults", "splits", "transport", "pause") if self.options.get(k) is not None})


class _BodyReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def read(self, partition) -> Iterator[tuple]:
        o = self.options
        url = o["url"] + "?" + urllib.parse.urlencode({"language": o.get("language") or "fi"})
        yield (transport_of(o.get("transport"))(url).decode("utf-8"),)


class TitleList(DataSource):
    """``spark.read.format("title_list")`` with ``url, language, transport``: the body, for :func:`files.title_rows`."""

    @classmethod
    def name(cls) -> str:
        return "title_list"

    def schema(self) -> str:
        return "body string"

    def reader(self, schema) -> _BodyReader:
        return _BodyReader({k: self.options.get(k) for k in ("url", "language", "transport")})


def register(spark) -> None:
    """Makes the sources known; filters reach them only if the session lets Python sources take filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(IssueSearch)
    spark.dataSource.register(TitleList)


def sample_bindings(titles: DataFrame, url: str, year: int, transport: str | None = None) -> DataFrame:
    """``issn, sample_binding``: the first issue of each title in a year; titles without one are left out."""

    def one(issn: str, fetch: Callable[[str], bytes]) -> int | None:
        asked = {"query": "", "issn": issn, "startDate": f"{year}-01-01", "endDate": f"{year}-12-31", "requireOnline": "true", "maxResults": 1, "type": "NEWSPAPER"}
        try:
            body = json.loads(fetch(f"{url}?{urllib.parse.urlencode(asked)}"))
            rows = body.get("results") or body.get("bindings") or body.get("items") or []
            found = rows and (rows[0].get("bindingId") or rows[0].get("id") or rows[0].get("binding_id"))
            return int(found) if found else None
        except (OSError, ValueError, AttributeError):
            return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fetch = transport_of(transport)
        for b in batches:
            yield pd.DataFrame({"issn": b["issn"], "sample_binding": pd.array([one(x, fetch) for x in b["issn"]], dtype="Int64")}).dropna()

    return titles.select("issn").distinct().mapInPandas(run, "issn string, sample_binding bigint")


def bodies(rows: DataFrame, address: dict[str, str], transport: str | None = None) -> DataFrame:
    """``rows`` with a string column of the body at each address (column name: column of URLs), null if it can't be read."""

    def fetch_all(urls: pd.Series) -> pd.Series:
        fetch = transport_of(transport)

        def one(u: str | None) -> str | None:
            try:
                return None if u is None else fetch(u).decode("utf-8", errors="replace")
            except OSError:
                return None

        return urls.map(one)

    fetched = F.pandas_udf(fetch_all, "string")
    return rows.withColumns({name: fetched(F.col(url)) for name, url in address.items()})


def download(plan: DataFrame, folder: str, transport: str | None = None, workers: int = 5, pause: float = PAUSE) -> DataFrame:
    """Fetch ``url`` to ``folder/path`` for each row of ``plan``; returns ``bindingId, path, success, error``.

    ``folder`` is a URI that pyarrow opens and all executors share. A file is renamed when it is whole, and one that is there
    already is kept, so a repeated task does no harm.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.fs as fs

        fetch, (store, root) = transport_of(transport), fs.FileSystem.from_uri(folder)
        for b in batches:
            errors = []
            for path, url in zip(b["path"], b["url"]):
                goal, error = f"{root}/{path}", None
                if store.get_file_info(goal).type == fs.FileType.NotFound:
                    try:
                        body, part = fetch(url), f"{goal}.{uuid.uuid4().hex}"
                        store.create_dir(goal.rpartition("/")[0], recursive=True)
                        with store.open_output_stream(part) as f:
                            f.write(body)
                        store.move(part, goal)
                        time.sleep(pause)
                    except OSError as e:
                        error = str(e)
                errors.append(error)
            yield pd.DataFrame({"bindingId": b["bindingId"], "path": b["path"], "success": [e is None for e in errors], "error": errors})

    return plan.select("bindingId", "path", "url").repartition(workers).mapInPandas(run, "bindingId string, path string, success boolean, error string")
