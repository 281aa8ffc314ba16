"""Command line: ``python -m strandline.cli COMMAND ...`` runs one step over a folder or table."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from strandline.functions import text as tx
from strandline.operators import catalog, extract, ocr, reports, segments
from strandline.sources import alto, files, sinks, web


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="strandline")
    sub = top.add_subparsers(dest="command", required=True)

    def add(name: str, text: str, *paths: str) -> argparse.ArgumentParser:
        p = sub.add_parser(name, help=text)
        for path in paths:
            p.add_argument(path)
        return p

    p = add("fetch", "search issues, write a manifest, download pages", "url", "out")
    p.add_argument("--query", default="")
    p.add_argument("--start", default="1820-01-01")
    p.add_argument("--end", default="1939-12-31")
    p.add_argument("--issn")
    p.add_argument("--language", default="fi", choices=("fi", "sv", "de", "all"))
    p.add_argument("--format", default="alto", choices=tuple(catalog.FORMATS))
    p.add_argument("--download", action="store_true")
    p.add_argument("--all-pages", action="store_true")
    p.add_argument("--workers", type=int, default=5)
    p.add_argument("--max-results", type=int, default=0)
    p.add_argument("--resume", action="store_true", help="read the manifest instead of searching")
    p.add_argument("--transport")
    p = add("titles", "titles of a span of years, with what can be read of them", "url", "out")
    p.add_argument("--start", type=int, default=1820)
    p.add_argument("--end", type=int, default=1940)
    p.add_argument("--language", default="fi")
    p.add_argument("--probe", help="address of the search that samples come from; without it nothing is probed")
    p.add_argument("--files", default="", help="address that binding ids are appended to")
    p.add_argument("--transport")
    p = add("parse", "texts, blocks or keywords in context of pages", "folder", "out")
    p.add_argument("--blocks", action="store_true")
    p.add_argument("--no-clean", action="store_true")
    p.add_argument("--keywords", nargs="*")
    p.add_argument("--window", type=int, default=200)
    for name, text in (("segment", "articles of pages, as they stand"), ("pipeline", "articles of pages, with normalised text")):
        p = add(name, text, "folder", "out")
        p.add_argument("--ice-only", action="store_true")
        p.add_argument("--n-columns", type=int, default=0)
        p.add_argument("--threshold", type=float, default=segments.DEPTH)
        p.add_argument("--window", type=int, default=segments.WINDOW)
        p.add_argument("--min-block-words", type=int, default=segments.LEAST_WORDS)
    p = add("normalize", "texts in modern spelling", "folder", "out")
    p.add_argument("--track-changes", action="store_true")
    p = add("correct", "flags and corrections of OCR errors", "folder", "out")
    p.add_argument("--detect-only", action="store_true")
    p.add_argument("--rules-only", action="store_true")
    p.add_argument("--auto-correct", action="store_true")
    p.add_argument("--threshold", type=float, default=ocr.THRESHOLD)
    p = add("extract", "sentences on river ice", "folder", "out")
    p.add_argument("--no-recursive", action="store_true")
    p.add_argument("--no-copy-txt", action="store_true")
    add("events", "events around keywords", "folder", "out")
    add("flatten", "results as one flat file", "folder", "out")
    add("analyse", "events per river and year", "file", "out")
    return top


def fetch(spark: SparkSession, a: argparse.Namespace) -> None:
    web.register(spark)
    manifest = f"{a.out}/manifest"
    templates = spark.createDataFrame([tuple(web.TEMPLATES.values())], list(web.TEMPLATES))
    if not a.resume:
        options = {"url": a.url, "query": a.query, "startDate": a.start, "endDate": a.end, "language": a.language, "maxResults": a.max_results, "transport": a.transport}
        found = spark.read.format("issue_search").options(**{k: v for k, v in options.items() if v is not None}).load()
        sinks.manifest(catalog.manifest(found, a.query), manifest)
    rows = files.manifest(spark, manifest)
    if a.issn:
        rows = rows.where(F.col("publicationId") == a.issn)
    reports.top_titles(rows, "bindingTitle").show(truncate=False)
    reports.decades(rows, F.col("year")).show(50, truncate=False)
    if a.download:
        plan = catalog.page_plan(rows, a.all_pages, a.format).join(F.broadcast(templates), F.lit(True))  # one row
        template = F.when(F.col("kind") == "xml", F.col("altoXmlTemplate")).otherwise(F.col("altoTxtTemplate"))
        plan = plan.withColumn("url", catalog.page_url(F.col("baseUrl"), template, F.col("page")))
        status = web.download(plan, a.out, a.transport, a.workers).withColumn("at", F.current_timestamp())
        status.write.mode("append").parquet(f"{a.out}/status")
        last = spark.read.parquet(f"{a.out}/status").groupBy("path").agg(F.max_by(F.struct("bindingId", "success"), "at").alias("s"))  # a good retry counts
        reports.download_tally(last.select("s.*")).show()


def titles(spark: SparkSession, a: argparse.Namespace) -> None:
    web.register(spark)
    body = spark.read.format("title_list").options(**{k: v for k, v in {"url": a.url, "language": a.language, "transport": a.transport}.items() if v}).load()
    of = catalog.titles_overlapping(files.title_rows(spark, body), a.start, a.end)
    samples = spark.createDataFrame([], "issn string, sample_binding bigint")
    if a.probe:
        samples = web.sample_bindings(of, a.probe, (a.start + a.end) // 2, a.transport)
    base = F.concat(F.lit(a.files.rstrip("/") + "/"), F.col("sample_binding").cast("string"))
    asked = samples.select("sample_binding", F.concat(base, F.lit("/mets")).alias("m"), F.concat(base, F.lit("/page-00001.xml")).alias("sample_alto_url"))
    access = web.bodies(asked, {"mets": "m", "alto": "sample_alto_url"}, a.transport).drop("m")
    sinks.coverage(catalog.coverage(of, samples, access), a.out)


def parse(spark: SparkSession, a: argparse.Namespace) -> None:
    pages = alto.read(spark, a.folder, clean=not a.no_clean)
    if a.keywords:
        extract.keyword_windows(pages, tuple(a.keywords), "path", "full_text", a.window).write.mode("overwrite").json(a.out)
    elif a.blocks:
        pages.select("path", F.inline("blocks")).write.mode("overwrite").json(a.out)
    else:
        sinks.texts(pages.where("error is null"), a.out, "filename", "full_text")


def articles(spark: SparkSession, a: argparse.Namespace) -> None:
    pages = alto.read(spark, a.folder, recursive=a.command == "segment").where("error is null").select("filename", "blocks", "page_width")
    options = {"window": a.window, "threshold": a.threshold, "columns": a.n_columns, "least_words": a.min_block_words}
    if a.command == "segment":
        of = segments.article_segments(pages, **options)
        (of.where("has_ice_keywords") if a.ice_only else of).write.mode("overwrite").json(a.out)
    else:
        of = segments.articles(pages, a.ice_only, **options)
        sinks.texts(segments.article_files(of, "filename", separator="\n\n"), a.out, "filename")


def normalize(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = files.texts(spark, a.folder, recursive=False, strict=True)
    plain = tx.rejoin_hyphens(tx.normalize_unicode(F.col("text")))
    if a.track_changes:
        of = rows.select("filename", tx.spelling_changes(plain).alias("changes"))
        of.select("filename", *reports.change_counts(F.col("changes"))).show(truncate=False)
        reports.change_sample(of, "filename").show(truncate=False)
    sinks.texts(rows.select("filename", tx.normalize(F.col("text")).alias("text")), a.out, "filename")


def correct(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = files.texts(spark, a.folder, recursive=False, strict=True)
    scorer = None if a.rules_only else ocr.NgramScorer.fit(rows)
    of = ocr.correct(rows, scorer, a.auto_correct and not a.detect_only, a.threshold, "path")
    if a.detect_only:
        of.select("path", F.inline("flags")).write.mode("overwrite").json(a.out)
    else:
        sinks.texts(of.withColumn("filename", F.regexp_extract("path", r"[^/]*$", 0)), a.out, "filename", "corrected_text")


def matches(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = files.texts(spark, a.folder, recursive=not a.no_recursive)
    found = extract.sentence_matches(rows, "filename", "path").cache()
    results = extract.file_results(rows, found, "path").withColumnRenamed("path", "source_path")
    sinks.results_json(results, f"{a.out}/results")
    sinks.summary_json(extract.run_summary(rows, found, "path"), f"{a.out}/_summary")
    if not a.no_copy_txt:
        sinks.texts(rows.join(found.select("path").distinct(), "path", "left_semi"), f"{a.out}/texts", "filename")
    reports.ranked(extract.count_by(found, "ice_categories")).show()
    reports.ranked(extract.count_by(found, "rivers")).show()


def events(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = files.texts(spark, a.folder).withColumn("published", tx.date_of_name(F.col("filename")))
    sinks.events_csv(extract.events(rows, "published", "path"), a.out)


def flatten(spark: SparkSession, a: argparse.Namespace) -> None:
    sinks.matches_csv(files.results(spark, a.folder, lines=True), a.out)


def analyse(spark: SparkSession, a: argparse.Namespace) -> None:
    of = files.events(spark, a.file)
    both = [extract.counts_per_river_year(of, kind).withColumn("event_type", F.lit(kind)) for kind in ("freeze", "breakup")]
    both[0].unionByName(both[1]).coalesce(1).write.mode("overwrite").csv(a.out, header=True)


COMMANDS = {
    "fetch": fetch, "titles": titles, "parse": parse, "segment": articles, "pipeline": articles, "normalize": normalize,
    "correct": correct, "extract": matches, "events": events, "flatten": flatten, "analyse": analyse,
}


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    COMMANDS[a.command](SparkSession.builder.appName(f"strandline {a.command}").getOrCreate(), a)


if __name__ == "__main__":
    main()
