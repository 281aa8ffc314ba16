"""Queries on categories, rivers, dates and events, over whole documents with an added sentence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import lexicons as lx
from strandline.functions import spans as sp
from strandline.functions import text as tx
from strandline.operators import extract, layout
from strandline.plans.corpus import LAYOUTS, N, PAGES, SENTENCES, layouts, pages
from strandline.plans.registry import WS, fold_sql, query, sentences_sql, strip_sql, table, text_sql

RULES = "(VALUES " + ", ".join(f"({i}, {text_sql(c)}, {text_sql(p)})" for i, (c, p) in enumerate(lx.CATEGORY_RULES)) + ") AS r(ord, category, pattern)"
SENTENCE_ROWS = f"""{PAGES}, s0 AS (SELECT doc_id, lang, filename, {sentences_sql("text")} AS s FROM pages),
sentences AS (SELECT doc_id, lang, filename, unnest(s) AS sentence, generate_subscripts(s, 1) - 1 AS i, len(s) AS n FROM s0),
hits AS (SELECT s.*, ord, category, pattern FROM (SELECT *, {fold_sql("sentence")} AS f FROM sentences) s JOIN {RULES} ON regexp_matches(f, pattern))"""
STEMS = "(VALUES " + ", ".join(f"({i}, {text_sql(r)}, {text_sql(s)})" for i, (r, s) in enumerate(lx.RIVER_STEMS)) + ") AS k(ord, river, stem)"
WORD = r"\p{L}\p{N}\p{M}_"
FOUND = f"""{SENTENCE_ROWS},
matched AS (SELECT DISTINCT doc_id, filename, sentence, i FROM hits),
starts AS (
    SELECT m.*, unnest(list_filter(generate_series(1, length(sentence)), lambda p: (p = 1 OR NOT regexp_matches(sentence[p - 1], '[{WORD}]')) AND regexp_matches(sentence[p], '[{WORD}]'))) AS p
    FROM matched m),
mentions AS (SELECT doc_id, i, p - 1 AS position, regexp_extract(substr(sentence, p), '^\\p{{L}}*') AS matched_text, arg_min(river, ord) AS river
    FROM starts JOIN {STEMS} ON starts_with(lower(substr(sentence, p)), stem) GROUP BY ALL)"""


@query(f"""
WITH {SENTENCE_ROWS}
SELECT lang, category, count(*) AS n FROM (SELECT DISTINCT doc_id, lang, i, category FROM hits) GROUP BY 1, 2""")
def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences that match each category, by language."""
    of = tx.exploded(pages(spark, sf_dir), ("lang",), tx.sentences(F.col("text")), "s")
    found = of.select("lang", F.array_distinct(F.transform(tx.categories(F.col("s")), lambda m: m["category"])).alias("c"))
    return extract.count_by(found, "c", "lang", name="category")


@query(f"WITH {SENTENCE_ROWS} SELECT doc_id, CAST(i AS INTEGER) AS sentence_index, category, pattern FROM hits")
def category_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = extract.sentence_rows(pages(spark, sf_dir).select("doc_id", "text"))
    return of.select("doc_id", "sentence_index", F.inline(tx.categories(F.col("sentence"))))


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.sentence_matches(pages(spark, sf_dir), "filename")


@query(f"""
WITH {FOUND},
r AS (SELECT doc_id, i, string_agg(river, ';' ORDER BY position) AS rivers FROM mentions GROUP BY 1, 2),
c AS (SELECT doc_id, i, string_agg(pattern, ';' ORDER BY ord) AS patterns FROM hits GROUP BY 1, 2),
g AS (SELECT doc_id, i, string_agg(category, ';' ORDER BY o) AS categories FROM (SELECT doc_id, i, category, min(ord) AS o FROM hits GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT m.doc_id, CAST(m.i AS INTEGER) AS sentence_index, sentence, {fold_sql("sentence")} AS normalized, categories AS ice_categories, patterns AS ice_patterns,
       coalesce(rivers, 'unknown') AS rivers, regexp_extract(filename, '\\d{{4}}-\\d{{2}}-\\d{{2}}') AS publishing_date
FROM matched m JOIN c ON c.doc_id = m.doc_id AND c.i = m.i JOIN g ON g.doc_id = m.doc_id AND g.i = m.i LEFT JOIN r ON r.doc_id = m.doc_id AND r.i = m.i""")
def sentence_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = lambda c: F.array_join(c, ";").alias(c)
    of = _matches(spark, sf_dir)
    return of.select("doc_id", "sentence_index", "sentence", "normalized", joined("ice_categories"), joined("ice_patterns"), joined("rivers"), "publishing_date")


@query()
def matches_flat_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten columns of the flat file; years come from a grammar of dates that has no SQL."""
    rows = pages(spark, sf_dir)
    return extract.flat_matches(extract.file_results(rows, _matches(spark, sf_dir)))


@query(f"""
WITH {SENTENCE_ROWS}, per AS (SELECT doc_id, count(DISTINCT i) AS m FROM hits GROUP BY 1), t AS (SELECT doc_id, len(s) AS n, m FROM s0 LEFT JOIN per USING (doc_id))
SELECT count(*) AS files_scanned, count(m) AS files_with_matches, count(*) - count(m) AS files_skipped, CAST(coalesce(sum(n) FILTER (m IS NOT NULL), 0) AS BIGINT) AS sentences_scanned,
       CAST(sum(n) AS BIGINT) AS sentences_in_all_files, CAST(coalesce(sum(m), 0) AS BIGINT) AS sentences_matched, round_even(count(m) / greatest(count(*), 1) * 100, 1) AS match_rate_pct FROM t""")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pages(spark, sf_dir)
    hits = extract.sentence_rows(rows.select("doc_id", "text")).where(F.size(tx.categories(F.col("sentence"))) > 0)
    return extract.run_summary(rows, hits)


@query(f"""
WITH {SENTENCE_ROWS}
SELECT category, doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i, category FROM hits) GROUP BY ROLLUP (category, doc_id)""")
def file_run_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matching sentences by category and file, by category, and in all; a sentence counts once for each of its categories."""
    of = extract.sentence_rows(pages(spark, sf_dir).select("doc_id", "text"))
    found = tx.exploded(of, ("doc_id",), F.array_distinct(F.transform(tx.categories(F.col("sentence")), lambda m: m["category"])), "category")
    return found.rollup("category", "doc_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {FOUND} SELECT doc_id, CAST(i AS INTEGER) AS sentence_index, river, matched_text, CAST(position AS INTEGER) AS position FROM mentions")
def river_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = extract.sentence_rows(pages(spark, sf_dir).select("doc_id", "text")).where(F.size(tx.categories(F.col("sentence"))) > 0)
    return of.select("doc_id", "sentence_index", F.inline(sp.rivers(F.col("sentence"))))


@query(f"""
WITH {FOUND}
SELECT river, count(*) AS n FROM (SELECT coalesce(river, 'unknown') AS river FROM matched m LEFT JOIN mentions k ON k.doc_id = m.doc_id AND k.i = m.i) GROUP BY 1""")
def river_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = extract.sentence_rows(pages(spark, sf_dir).select("doc_id", "text")).where(F.size(tx.categories(F.col("sentence"))) > 0)
    names = tx.let(F.transform(sp.rivers(F.col("sentence")), lambda r: r["river"]), lambda r: F.when(F.size(r) == 0, F.array(F.lit("unknown"))).otherwise(r))
    return extract.count_by(of.select(names.alias("r")), "r", name="river")


NUMERIC = r"(?:^|[^\p{L}\p{N}\p{M}_])(\d{1,2})[./](\d{1,2})[./](\d{4}|\d{2})(?:$|[^\p{L}\p{N}\p{M}_])"


@query(f"""
WITH s AS (SELECT * FROM (VALUES {", ".join(f"({i}, {text_sql(t)})" for i, t in enumerate(SENTENCES))}) AS s(k, t)),
x AS (SELECT k, regexp_extract(t, '{NUMERIC}', ['day', 'month', 'year']) AS d FROM s WHERE regexp_matches(t, '{NUMERIC}'))
SELECT doc_id, CAST(d.day AS INTEGER) AS day, CAST(d.month AS INTEGER) AS month, CAST(CASE WHEN length(d.year) = 2 THEN '19' || d.year ELSE d.year END AS INTEGER) AS year
FROM documents JOIN x ON k = doc_id % {N}""")
def dates_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole numeric dates of the added sentences."""
    last = F.element_at(F.array(*[F.lit(s) for s in SENTENCES]), (1 + F.col("doc_id") % N).cast("int"))
    of = table(spark, sf_dir, "documents").select("doc_id", F.explode(sp.dates(last)).alias("d"))
    return of.where("d.format = 'numeric' and d.year is not null").select("doc_id", "d.day", "d.month", "d.year")


@query()
def dates_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All dates of whole texts: numeric, long and bare years, none overlapping."""
    of = pages(spark, sf_dir).select("doc_id", F.posexplode(sp.dates("text")).alias("ord", "d"))
    return of.select("doc_id", "ord", "d.*")


@query()
def best_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pages(spark, sf_dir)
    return rows.select("doc_id", sp.best_year(sp.dates("text"), tx.year_of_name(F.col("filename"))).alias("year"))


@query(f"""
WITH {PAGES}
SELECT doc_id, regexp_extract(filename, '\\d{{4}}-\\d{{2}}-\\d{{2}}') AS publishing_date,
       CAST(nullif(regexp_extract(filename, '(?:^|[^\\p{{L}}\\p{{N}}_])(1[89]\\d{{2}}|20\\d{{2}})(?:$|[^\\p{{L}}\\p{{N}}_])', 1), '') AS INTEGER) AS file_year FROM pages""")
def filename_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("filename")
    return pages(spark, sf_dir).select("doc_id", tx.date_of_name(name).alias("publishing_date"), tx.year_of_name(name).alias("file_year"))


KEYWORDS = "(VALUES " + ", ".join(f"({i}, {text_sql(k)}, {text_sql(w)})" for i, (k, w) in enumerate(lx.EVENT_KEYWORDS)) + ") AS k(ord, event_type, keyword)"
RIVERS = "(VALUES " + ", ".join(f"({i}, {text_sql(r)})" for i, r in enumerate(lx.TARGET_RIVERS)) + ") AS r(rank, river)"


def _pattern_sql(pattern: str) -> str:
    """Word boundaries and blanks as SQL's regular expressions know them."""
    body = pattern.replace(r"\s", WS).replace(r"\w", r"[\p{L}\p{N}\p{M}_]").replace(f"[.{WS}]", r"[.\t-\r\x{85}\p{Z}]")
    start = body.startswith(r"\b")
    end = body.endswith(r"\b")
    body = body[2 if start else 0 : -2 if end else None]
    return "(?i)" + (r"(?:^|[^\p{L}\p{N}\p{M}_])" if start else "") + "(" + body + ")" + (r"(?:$|[^\p{L}\p{N}\p{M}_])" if end else "")


HITS = f"""{PAGES},
found AS (SELECT doc_id, text, regexp_extract(filename, '\\d{{4}}-\\d{{2}}-\\d{{2}}') AS pub_date, ord, event_type, keyword,
        unnest(list_transform(generate_series(1, len(string_split(lower(text), keyword)) - 1),
            lambda k: CAST(list_sum(list_transform(string_split(lower(text), keyword)[1 : k], lambda x: length(x))) AS BIGINT) + (k - 1) * length(keyword))) AS position
    FROM pages JOIN {KEYWORDS} ON contains(lower(text), keyword)),
snippets AS (SELECT *, {strip_sql("substr(text, greatest(0, position - 150) + 1, position + length(keyword) + 150 - greatest(0, position - 150))")} AS snippet FROM found),
gated AS (SELECT *, CASE WHEN regexp_matches(snippet, {text_sql(_pattern_sql(lx.ICE_WITH_FLOOD))}) THEN true WHEN regexp_matches(snippet, {text_sql(_pattern_sql(lx.SUMMER_FLOOD))}) THEN false
        ELSE CAST(substr(pub_date, 6, 2) AS INTEGER) IN {lx.ICE_MONTHS} END AS ice FROM snippets),
events AS (SELECT *, regexp_extract(snippet, {text_sql(_pattern_sql(lx.EXACT_DATE))}, 1) AS exact, regexp_matches(snippet, {text_sql(_pattern_sql(lx.RELATIVE_DATE))}) AS relative
    FROM gated WHERE ice OR event_type <> 'jam_flood' OR keyword NOT IN {lx.GATED})"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pages(spark, sf_dir).select("doc_id", "text", tx.date_of_name(F.col("filename")).alias("published"))
    return extract.events(rows, "published")


@query(f"""
WITH {HITS}
SELECT doc_id, CAST(ord AS INTEGER) AS ord, event_type, keyword, CAST(position AS INTEGER) AS position, snippet,
       coalesce((SELECT arg_min(river, rank) FROM {RIVERS} WHERE contains(lower(snippet), river)), '') AS river_hint, pub_date,
       CASE WHEN exact <> '' THEN {strip_sql("exact")} ELSE pub_date END AS event_date,
       CASE WHEN exact <> '' THEN 'exact' WHEN relative THEN 'inferred' ELSE 'publication' END AS date_confidence
FROM events""")
def ice_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hit of every event keyword, with snippet, flood gate, river and date."""
    return _events(spark, sf_dir).drop("event_date_iso")


@query(f"""
WITH {HITS}
SELECT doc_id, keyword, CAST(position AS INTEGER) AS position, ice FROM gated WHERE event_type = 'jam_flood' AND keyword IN {lx.GATED}""")
def flood_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pages(spark, sf_dir).select("doc_id", "text", tx.date_of_name(F.col("filename")).alias("published"))
    hits = sp.keyword_hits(rows, lx.GATED, ("doc_id", "published"))
    cut = tx.strip(sp.snippet(F.col("text"), F.col("position"), F.length("keyword"), extract.WINDOW))
    return hits.select("doc_id", "keyword", "position", tx.flood_is_ice(cut, F.col("published")).alias("ice"))


@query(f"WITH {HITS} SELECT CASE WHEN exact <> '' THEN 'exact' WHEN relative THEN 'inferred' ELSE 'publication' END AS date_confidence, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_date_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).groupBy("date_confidence", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH {PAGES}
SELECT doc_id, coalesce((SELECT arg_min(river, rank) FROM {RIVERS} WHERE contains(lower(text), river)), '') AS river_hint FROM pages""")
def river_hint_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("doc_id", tx.first_river(F.col("text")).alias("river_hint"))


@query()
def events_without_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event for each mention: overlapping hits of a type count once."""
    return extract.event_records(extract.without_repeats(_events(spark, sf_dir)))


CONTEXT = ("is", "the", "aa", "jää")


@query()
def keyword_windows_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords in context, over all texts; tested against plain Python."""
    return extract.keyword_windows(pages(spark, sf_dir), CONTEXT, window=40)


@query()
def keyword_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event keyword in its context, over all texts; overlapping hits too slow in SQL are tested on small texts."""
    return extract.keyword_windows(pages(spark, sf_dir), tuple(w for _, w in lx.EVENT_KEYWORDS))


@query(f"""
WITH {LAYOUTS}, p AS (SELECT doc_id, i, text, sum(length(text) + 2) OVER (PARTITION BY doc_id ORDER BY i) AS ends FROM blocks),
asked AS (SELECT doc_id, unnest([0, 100, 1000]) AS position FROM documents)
SELECT a.doc_id, CAST(a.position AS INTEGER) AS position, coalesce(arg_min(CAST(i AS VARCHAR), i) FILTER (ends >= a.position), '') AS block_id
FROM asked a LEFT JOIN p ON p.doc_id = a.doc_id GROUP BY 1, 2""")
def hit_to_block_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = layouts(spark, sf_dir).withColumn("position", F.explode(F.array(F.lit(0), F.lit(100), F.lit(1000))))
    return rows.select("doc_id", "position", layout.block_of(F.col("blocks"), F.col("position")).alias("block_id"))


def _dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream as events on rivers."""
    e = table(spark, sf_dir, "events")
    kind = F.element_at(F.array(F.lit("freeze"), F.lit("breakup"), F.lit("jam_flood")), (1 + F.col("event_id") % 3).cast("int"))
    river = F.when(F.col("user_id") % 9 != 8, F.concat(F.lit("river"), (F.col("user_id") % 9).cast("string")))
    return e.select("event_id", kind.alias("event_type"), river.alias("river_hint"), F.to_date(F.add_months("ts", -12 * (F.col("event_id") % 40).cast("int"))).alias("date"))


PER_YEAR = """SELECT 'river' || (user_id % 9) AS river_hint, CAST(year(ts) - event_id % 40 AS INTEGER) AS year, count(*) AS count
FROM events WHERE event_id % 3 = {0} AND user_id % 9 <> 8 GROUP BY 1, 2"""


@query(PER_YEAR.format(0))
def freeze_per_river_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.counts_per_river_year(_dated(spark, sf_dir), "freeze")


@query(PER_YEAR.format(1))
def breakup_per_river_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.counts_per_river_year(_dated(spark, sf_dir), "breakup")


@query("""
WITH e AS (SELECT event_id, user_id % 9 AS river, ts FROM events WHERE event_id % 2 = 0), r AS (SELECT user_id % 9 AS river, ts AS read_at, max(value) AS level FROM events WHERE event_id % 2 = 1 GROUP BY 1, 2)
SELECT e.event_id, e.river, r.read_at, r.level FROM e ASOF LEFT JOIN r ON e.river = r.river AND e.ts >= r.read_at""")
def nearest_record_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with the last reading of its river."""
    e = table(spark, sf_dir, "events").withColumn("river", F.col("user_id") % 9)
    readings = e.where("event_id % 2 = 1").groupBy("river", F.col("ts").alias("read_at")).agg(F.max("value").alias("level"))
    return extract.nearest_record(e.where("event_id % 2 = 0").select("event_id", "river", "ts"), readings, "river", "ts", "read_at").drop("ts")


@query("""SELECT toxic AS truth, n_chars > 2000 AS guess, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2""")
def label_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    guess = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") > 2000).alias("g"))
    return extract.confusion(guess, table(spark, sf_dir, "labels"), "doc_id", "g", "toxic")
