"""Sentences on river ice, and events around keywords."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import lexicons as lx
from strandline.functions import spans as sp
from strandline.functions import text as tx

WINDOW = 150
MATCH_COLUMNS = (
    "sentence_index", "sentence", "normalized", "ice_categories", "ice_patterns", "rivers", "publishing_date", "year",
)


def sentence_rows(rows: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and each sentence of its text with its place: ``sentence_index, sentence``."""
    others = [c for c in rows.columns if c != text]
    return tx.exploded(rows, others, tx.sentences(F.col(text)), "sentence", "sentence_index")


def sentence_matches(rows: DataFrame, filename: str, key: str = "doc_id", text: str = "text", fixed_months: bool = False) -> DataFrame:
    """Sentences that match a category, with their rivers, dates and best year. Only matching sentences are searched further.

    ``filename`` is the column that the publishing date and the year of last resort come from.
    """
    hits = sentence_rows(rows.select(key, F.col(filename).alias("source_file"), text), key, text)
    hits = hits.withColumn("found", tx.categories(F.col("sentence"))).where(F.size("found") > 0)
    hits = hits.withColumn("dates", (sp.dates_fixed if fixed_months else sp.dates)(F.col("sentence")))
    mentions = F.transform(sp.rivers(F.col("sentence")), lambda r: r["river"])
    file_year = tx.year_of_name(F.col("source_file"))
    return hits.select(
        key, "source_file", file_year.alias("file_year"), "sentence_index", "sentence",
        tx.historical_fold(F.col("sentence")).alias("normalized"),
        F.array_distinct(F.transform("found", lambda m: m["category"])).alias("ice_categories"),
        F.transform("found", lambda m: m["pattern"]).alias("ice_patterns"),
        tx.let(mentions, lambda r: F.when(F.size(r) == 0, F.array(F.lit("unknown"))).otherwise(r)).alias("rivers"),
        tx.date_of_name(F.col("source_file")).alias("publishing_date"),
        sp.best_year(F.col("dates"), file_year).alias("year"),
    )


def count_by(rows: DataFrame, values: str, *keys: str, name: str = "value") -> DataFrame:
    """How often each element of an array column occurs, by ``keys``; counted by task before it is shuffled."""
    return tx.exploded(rows, keys, F.col(values), name).groupBy(*keys, name).agg(F.count(F.lit(1)).alias("n"))


def file_results(rows: DataFrame, matches: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each file that has a match: totals, counts by category and river as maps, and the matches in order.

    Matches, a fraction of the sentences, are found and gathered by file once; a file is of bounded size, and so are its categories
    and rivers, which are counted in what is gathered.
    """
    def tally(c: str) -> Column:
        def counted(values: Column) -> Column:
            one = lambda v: F.struct(v.alias("value"), F.size(F.filter(values, lambda x: x == v)).cast("bigint").alias("n"))
            return F.map_from_entries(F.transform(F.array_sort(F.array_distinct(values)), one))

        return tx.let(F.flatten(F.transform("matches", lambda m: m[c])), counted)

    totals = rows.select(key, F.size(tx.sentences(F.col(text))).alias("sentences_total"))
    of = matches.groupBy(key, "source_file", "file_year").agg(
        F.count(F.lit(1)).alias("sentences_matched"),
        F.array_sort(F.collect_list(F.struct(*MATCH_COLUMNS))).alias("matches"),
    )
    out = of.join(totals, key).select("*", tally("ice_categories").alias("ice_categories_found"), tally("rivers").alias("rivers_found"))
    return out.select(
        key, "source_file", "file_year", "sentences_total", "sentences_matched",
        F.col("ice_categories_found").alias("categories_found"), F.col("rivers_found"), "matches",
    )


def run_summary(rows: DataFrame, matches: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row: files, matched files and their share, sentences scanned (of matched files, and of all), and matched."""
    per_file = matches.groupBy(key).agg(F.count(F.lit(1)).alias("m"))
    totals = rows.select(key, F.size(tx.sentences(F.col(text))).alias("s")).join(per_file, key, "left")
    return totals.agg(
        F.count(F.lit(1)).alias("files_scanned"),
        F.count("m").alias("files_with_matches"),
        F.count_if(F.col("m").isNull()).alias("files_skipped"),
        F.coalesce(F.sum(F.when(F.col("m").isNotNull(), F.col("s"))), F.lit(0)).alias("sentences_scanned"),
        F.coalesce(F.sum("s"), F.lit(0)).alias("sentences_in_all_files"),
        F.coalesce(F.sum("m"), F.lit(0)).alias("sentences_matched"),
    ).withColumn("match_rate_pct", match_rate(F.col("files_with_matches"), F.col("files_scanned")))


def match_rate(matched: Column, total: Column) -> Column:
    """Percent with one decimal, half to even."""
    return F.bround(matched / F.greatest(total, F.lit(1)) * 100, 1)


def flat_matches(results: DataFrame) -> DataFrame:
    """Ten columns, one row for each match, arrays joined by semicolons."""
    one = results.select("source_file", "file_year", F.explode("matches").alias("m"))
    many = lambda c: F.array_join(f"m.{c}", ";").alias(c)
    return one.select(
        "source_file", "file_year", "m.publishing_date", "m.sentence_index", "m.sentence", "m.normalized",
        many("ice_categories"), many("ice_patterns"), many("rivers"), "m.year",
    )


def events(rows: DataFrame, published: str, key: str = "doc_id", text: str = "text", window: int = WINDOW, keywords=lx.EVENT_KEYWORDS) -> DataFrame:
    """One row for each hit of a keyword, overlapping ones too, with its snippet, river and date.

    Floods in general words pass only if the snippet or the month of publication speaks of ice.
    """
    names = tuple(word for _, word in keywords)
    hits = sp.keyword_hits(rows.select(key, published, text), names, (key, published), text)
    kind = F.create_map(*[F.lit(x) for pair in enumerate(k for k, _ in keywords) for x in pair])
    cut = hits.select(
        key, published, "ord", kind[F.col("ord")].alias("event_type"), "keyword", "position",
        tx.strip(sp.snippet(F.col(text), F.col("position"), F.length("keyword"), window)).alias("snippet"),
    )
    gated = (F.col("event_type") == "jam_flood") & F.col("keyword").isin(*lx.GATED)
    passed = cut.where(~gated | tx.flood_is_ice(F.col("snippet"), F.col(published)))
    date = tx.event_date(F.col("snippet"), F.coalesce(F.col(published), F.lit("")))
    return passed.withColumn("when", date).select(
        key, "ord", "event_type", "keyword", "position", "snippet", tx.first_river(F.col("snippet")).alias("river_hint"),
        F.coalesce(F.col(published), F.lit("")).alias("pub_date"), F.col("when.event_date").alias("event_date"),
        F.col("when.confidence").alias("date_confidence"),
        F.when(F.col("when.confidence") != "exact", F.to_date(F.try_to_date("when.event_date"))).alias("event_date_iso"),
    )


def event_records(of: DataFrame) -> DataFrame:
    """The seven columns of an event file."""
    return of.select(
        "event_type", F.col("keyword").alias("keywords"), "river_hint", "pub_date", "event_date", "date_confidence", "snippet"
    )


def without_repeats(of: DataFrame, key: str = "doc_id") -> DataFrame:
    """Of the hits of one type at overlapping places of a text, the longest keyword's: one mention, one event."""
    end = F.col("position") + F.length("keyword")
    spans = F.array_sort(F.collect_list(F.struct("position", (-F.length("keyword")).alias("less"), end.alias("end"), F.struct(*of.columns).alias("row"))))
    # a text's hits are few: of one type, kept from the left unless they begin inside one kept before
    kept = F.aggregate(
        "s", F.struct(F.lit(-1).alias("end"), F.filter(F.transform("s", lambda x: x["row"]), lambda _: F.lit(False)).alias("out")),
        lambda acc, x: F.when(x["position"] >= acc["end"], F.struct(x["end"].alias("end"), F.array_append(acc["out"], x["row"]).alias("out"))).otherwise(acc),
        lambda acc: acc["out"],
    )
    return of.groupBy(key, "event_type").agg(spans.alias("s")).select(F.explode(kept).alias("r")).select("r.*")


def keyword_windows(pages: DataFrame, keywords: tuple[str, ...], key: str = "doc_id", text: str = "text", window: int = 200) -> DataFrame:
    """Every hit, also overlapping, of each keyword with ``window`` code points of context on either side."""
    hits = sp.keyword_hits(pages, tuple(k.lower() for k in keywords), (key,), text)
    cut = F.replace(sp.snippet(F.col(text), F.col("position"), F.length("keyword"), window), F.lit("\n"), F.lit(" "))
    return hits.select(key, "ord", "keyword", "position", tx.strip(cut).alias("snippet"))


def counts_per_river_year(events_of: DataFrame, kind: str) -> DataFrame:
    """``river_hint, year, count`` of events of one kind (``river_hint, date, event_type``); null keys are left out."""
    return (
        events_of.where((F.col("event_type") == kind) & F.col("river_hint").isNotNull() & (F.col("river_hint") != "") & F.col("date").isNotNull())
        .groupBy("river_hint", F.year("date").alias("year"))
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy("river_hint", "year")
    )


def analysis_view(of: DataFrame, binding: str) -> DataFrame:
    """Events with the columns that the analysis reads; the date is that of the text if it is a full one, else of publication."""
    date = F.coalesce("event_date_iso", F.try_to_date("pub_date"))
    return of.select(F.col(binding).cast("string").alias("binding_id"), date.alias("date"), F.nullif("river_hint", F.lit("")).alias("river_hint"), "event_type", "snippet")


def confusion(predicted: DataFrame, labels: DataFrame, key: str, guess: str, truth: str) -> DataFrame:
    """``truth, guess, n`` over the keys that both have."""
    both = predicted.select(key, F.col(guess).alias("guess")).join(labels.select(key, F.col(truth).alias("truth")), key)
    return both.groupBy("truth", "guess").agg(F.count(F.lit(1)).alias("n"))


def nearest_record(of: DataFrame, records: DataFrame, on: str, at: str, record_at: str) -> DataFrame:
    """Each event with the last instrumental record of its river at or before its date (as-of join).

    Both sides are dealt by river and merged in order of time; a running last value takes the place of a range join.
    """
    from pyspark.sql import Window

    theirs = [c for c in records.columns if c not in (on, record_at)]
    left = of.select(F.col(on).alias("__on"), F.col(at).alias("__at"), F.lit(1).alias("__kind"), F.struct(*of.columns).alias("__event"), F.lit(None).alias("__record"))
    right = records.select(F.col(on).alias("__on"), F.col(record_at).alias("__at"), F.lit(0).alias("__kind"), F.lit(None).alias("__event"), F.struct(record_at, *theirs).alias("__record"))
    # a river's years bound the rows that meet in one task; earlier years' last records are carried over
    year = F.year("__at").alias("__year")
    every = left.unionByName(right).withColumn("__year", year)
    inside = Window.partitionBy("__on", "__year").orderBy("__at", "__kind")
    near = every.withColumn("__near", F.last("__record", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    yearly = every.where("__kind = 0").groupBy("__on", "__year").agg(F.max_by("__record", "__at").alias("__last"))
    before = Window.partitionBy("__on").orderBy("__year").rowsBetween(Window.unboundedPreceding, -1)
    years = every.select("__on", "__year").distinct().join(yearly, ["__on", "__year"], "left")
    carried = years.select("__on", "__year", F.last("__last", ignorenulls=True).over(before).alias("__earlier"))
    out = near.where("__kind = 1").join(carried, ["__on", "__year"], "left").withColumn("__r", F.coalesce("__near", "__earlier"))
    return out.select("__event.*", *[F.col(f"__r.{c}").alias(c) for c in (record_at, *theirs)])
