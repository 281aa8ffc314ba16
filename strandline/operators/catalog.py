"""Search manifests, title catalogues and download plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.text import let

# The columns of a manifest file, in order.
MANIFEST_FIELDS = tuple("""
bindingId bindingTitle publicationId date year issue generalType publisher pageNumber pageCount baseUrl pdfUrl url copyrightWarnings
textHighlights terms searchQuery
""".split())  # fmt: skip
# The columns of a coverage file, in order.
COVERAGE_FIELDS = tuple("""
title issn language available_from available_to binding_found sample_binding alto_accessible mets_accessible est_pages sample_alto_url
""".split())  # fmt: skip
FORMATS = {"alto": ("xml",), "txt": ("txt",), "both": ("xml", "txt")}
FIRST_YEAR = 1700  # of a title that does not say


def search_url(start: Column, end: Column, query: Column | None = None, language: Column | None = None) -> Column:
    """The query string of a search; no keyword and the language ``all`` are left out."""
    encode = lambda c: F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    out = F.concat(F.lit("?startDate="), encode(start), F.lit("&endDate="), encode(end), F.lit("&formats=NEWSPAPER&requireOnline=true"))
    for name, c, none in (("query", query, ""), ("language", language, "all")):
        if c is not None:
            out = F.concat(out, F.when(F.coalesce(c, F.lit("")).isin("", none), "").otherwise(F.concat(F.lit(f"&{name}="), encode(c))))
    return out


def page_number(page: Column) -> Column:
    """Five digits, more where they are needed."""
    digits = page.cast("string")
    return F.when(F.length(digits) >= 5, digits).otherwise(F.lpad(digits, 5, "0"))


def page_url(base: Column, template: Column, page: Column) -> Column:
    return F.concat(base, F.replace(template, F.lit("{{page}}"), page_number(page)))


def page_plan(manifest: DataFrame, all_pages: bool = False, formats: str = "alto") -> DataFrame:
    """One row for each file to fetch: ``bindingId, publicationId, year, page, kind, path``."""
    first = lambda c: F.coalesce(F.try_to_number(F.nullif(c, F.lit("")), F.lit("999999999")).cast("int"), F.lit(1))
    pages = F.sequence(F.lit(1), F.greatest(first("pageCount"), F.lit(1))) if all_pages else F.array(first("pageNumber"))
    year = F.coalesce(F.nullif("year", F.lit("")), F.lit("unknown"))
    kinds = F.array(*[F.lit(k) for k in FORMATS[formats]])
    rows = manifest.select("*", F.explode(pages).alias("page")).select("*", F.explode(kinds).alias("kind"))
    path = F.concat_ws("/", "publicationId", year, F.concat("bindingId", F.lit("_page-"), page_number(F.col("page")), F.lit("."), F.col("kind")))
    return rows.withColumn("path", path)


def pending(plan: DataFrame, present: DataFrame) -> DataFrame:
    """The planned files that are not there yet (``present.path``)."""
    return plan.join(present.select("path").distinct(), "path", "left_anti")


def with_page_counts(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """``rows`` with ``pageCount`` from ``bindingId, pageCount``; one page where none is known."""
    known = counts.groupBy(F.col("bindingId").alias("__id")).agg(F.max("pageCount").alias("pageCount"))
    out = rows.join(known, rows["bindingId"].cast("string") == F.col("__id"), "left").drop("__id")
    return out.withColumn("pageCount", F.coalesce("pageCount", F.lit(1)))


def manifest(rows: DataFrame, query: str) -> DataFrame:
    """Search results as a manifest of seventeen string columns; what is missing is empty."""
    have = dict(rows.dtypes)

    def text(name: str, default: str = "") -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(default)) if name in have else F.lit(default)

    highlights = have.get("textHighlights", "")
    if highlights.startswith("struct"):
        shown = F.coalesce(F.array_join("textHighlights.text", " ### "), F.lit(""))
    else:
        shown = text("textHighlights")
    terms = F.coalesce(F.array_join("terms", ","), F.lit("")) if have.get("terms", "").startswith("array") else text("terms")
    made = {
        "year": F.substring(text("date"), 1, 4), "pageNumber": text("pageNumber", "1"), "pageCount": text("pageCount", "1"),
        "textHighlights": shown, "terms": terms, "searchQuery": F.lit(query),
    }
    return rows.select(*[made.get(c, text(c)).alias(c) for c in MANIFEST_FIELDS])


def first_then_issn(rows: DataFrame, most: int, issn: str | None, order: tuple[str, ...], column: str = "publicationId") -> DataFrame:
    """The first ``most`` rows, and of those the ones of a title: the limit comes before the filter."""
    out = rows.orderBy(*order).limit(most) if most > 0 else rows
    return out.where(F.col(column) == issn) if issn else out


def _year(names: tuple[str, ...], have: list[str]) -> Column:
    """The first field that says anything; of a date its year."""
    found = [F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in have]
    return F.substring(F.coalesce(*found, F.lit(None).cast("string")), 1, 4).try_cast("int")


def titles_overlapping(titles: DataFrame, start: int, end: int) -> DataFrame:
    """Titles that appeared between two years, with ``available_from`` and ``available_to`` cut to them; unknown years are open."""
    since = F.coalesce(_year(("startYear", "start_year", "firstIssueDate"), titles.columns), F.lit(FIRST_YEAR))
    until = F.coalesce(_year(("endYear", "end_year", "lastIssueDate"), titles.columns), F.year(F.current_date()))
    return (
        titles.withColumns({"__from": since, "__to": until}).where((F.col("__from") <= end) & (F.col("__to") >= start))
        .withColumns({"available_from": F.greatest("__from", F.lit(start)), "available_to": F.least("__to", F.lit(end))})
        .drop("__from", "__to")
    )


def estimated_pages(mets: Column) -> Column:
    """Half as many pages as a METS file speaks of ALTO, one at least; null if it is no METS file."""
    low = F.lower(mets)
    count = ((F.length(low) - F.length(F.replace(low, F.lit("alto"), F.lit("")))) / 4).cast("int")
    return F.when(F.contains(low, F.lit("<mets")), F.greatest(F.lit(1), F.floor(count / 2).cast("int")))


def has_alto(body: Column) -> Column:
    return let(F.lower(F.coalesce(body, F.lit(""))), lambda b: F.contains(b, F.lit("<alto")) | F.contains(b, F.lit("<layout")))


def coverage(titles: DataFrame, samples: DataFrame, access: DataFrame) -> DataFrame:
    """Eleven columns on each title: its sample binding, if any, and what could be read of it.

    ``samples``: ``issn, sample_binding``. ``access``: ``sample_binding, mets, alto, sample_alto_url``. Without a probe pass
    empty tables.
    """
    have = titles.columns
    name = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("title", "name") if c in have], F.lit("Unknown"))
    rows = titles.select(name.alias("title"), "issn", "language", "available_from", "available_to")
    out = rows.join(samples.select("issn", "sample_binding"), "issn", "left").join(access, "sample_binding", "left")
    return out.select(
        "title", "issn", "language", "available_from", "available_to", F.col("sample_binding").isNotNull().alias("binding_found"),
        "sample_binding", has_alto(F.col("alto")).alias("alto_accessible"), estimated_pages(F.col("mets")).isNotNull().alias("mets_accessible"),
        estimated_pages(F.col("mets")).alias("est_pages"), "sample_alto_url",
    )
