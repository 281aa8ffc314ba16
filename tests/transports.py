"""A service that answers from memory."""

import json
from urllib.parse import parse_qs, urlparse

PAGES = {f"{y}": [{"bindingId": y * 10 + k, "bindingTitle": "Lehti", "publicationId": "ISSN-1", "date": f"{y}-0{k + 1}-01", "baseUrl": f"http://x/{y}", "textHighlights": {"text": ["a", "b"]}, "terms": ["jää"]} for k in range(3)] for y in range(1900, 1904)}


def search(url: str) -> bytes:
    parts = urlparse(url)
    if parts.path.startswith("/search/"):  # a cursor: range and place
        start, end, at = parts.path.split("/")[2].split("_")
    else:
        q = parse_qs(parts.query)
        start, end, at = q["startDate"][0], q["endDate"][0], "0"
        assert q["formats"] == ["NEWSPAPER"] and "language" in q
    rows = [r for y in PAGES.values() for r in y if start <= r["date"] <= end]
    page = rows[int(at) : int(at) + 2]
    return json.dumps({
        "rows": page, "scrollId": f"{start}_{end}_{int(at) + 2}", "totalResults": len(rows), "altoXmlTemplate": "/p-{{page}}.xml",
        "bindingPageCounts": {str(r["bindingId"]): 4 for r in page if r["bindingId"] % 2},
    }).encode()


def titles(url: str) -> bytes:
    assert url.endswith("language=sv")
    return json.dumps({"results": [{"issn": "1", "title": "A", "startYear": 1800, "endYear": 1850}, {"issn": "2", "name": "B", "firstIssueDate": "1880-03-12"}]}).encode()


def samples(url: str) -> bytes:
    q = parse_qs(urlparse(url).query)
    if q["issn"] == ["3"]:
        raise OSError("down")
    return json.dumps({"items": [{"id": "77"}] if q["issn"] == ["1"] else []}).encode()


def pages(url: str) -> bytes:
    if "bad" in url:
        raise OSError("404")
    return b"<alto/>" if url.endswith(".xml") else b"<mets>alto alto alto alto alto</mets>"
