"""Queries on text functions, over whole documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import lexicons as lx
from strandline.functions import spans as sp
from strandline.functions import text as tx
from strandline.functions import words
from strandline.operators import reports
from strandline.plans.corpus import PAGES, pages
from strandline.plans.registry import WS, fold_sql, list_sql, query, sentences_sql, strip_sql, table, tokens_sql

L = lx.LETTERS
SIGNS = "replace(replace(replace(replace(replace(replace({0}, '—', ' -- '), '–', ' - '), '“', '\"'), '”', '\"'), '‘', ''''), '’', '''')"
BREAKS = r"\r\n|[\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"


def _lines_sql(x: str) -> str:
    return f"string_split(regexp_replace({x}, '{BREAKS}', chr(10), 'g'), chr(10))"


@query(f"""
WITH kept AS (
    SELECT doc_id, array_to_string(list_filter({_lines_sql("text")}, lambda x: NOT regexp_matches({strip_sql("x")}, '^[-=_*~+]{{3,}}$')
        AND ({strip_sql("x")} = '' OR regexp_matches(x, '[{L}]'))), chr(10)) AS t FROM documents)
SELECT doc_id, {strip_sql("regexp_replace(regexp_replace(" + SIGNS.format("replace(replace(t, '„', '\"'), '‚', '''')") + r", '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\x{200b}\x{200c}\x{200d}\x{feff}]', '', 'g'), '[ \t]{2,}', ' ', 'g')")} AS text
FROM kept""")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.clean_text(F.col("text")).alias("text"))


@query(f"""
SELECT doc_id, {strip_sql(f"array_to_string(list_filter(string_split(regexp_replace(regexp_replace(text, '[-=_]{{3,}}', ' ', 'g'), '[ \t]{{2,}}', ' ', 'g'), chr(10)), lambda x: regexp_matches(x, '[{L}]')), chr(10))")} AS text
FROM documents""")
def clean_text_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.clean_text_basic(F.col("text")).alias("text"))


@query(f"WITH {PAGES} SELECT doc_id, {fold_sql('text')} AS text FROM pages")
def historical_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("doc_id", tx.historical_fold(F.col("text")).alias("text"))


SPELLED = "replace(replace(replace(replace(replace(text, 'W', 'V'), 'w', 'v'), 'dt', 'tt'), 'gh', 'g'), 'ck', 'kk')"
for _old, _new in (("hafv", "hav"), ("gifv", "giv"), ("blifv", "bliv")):
    SPELLED = f"regexp_replace({SPELLED}, '(^|[^\\p{{L}}\\p{{N}}_\\p{{M}}]){_old}', '\\1{_new}', 'g')"


@query(f"WITH {PAGES} SELECT doc_id, {SPELLED} AS text FROM pages")
def spelling_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("doc_id", tx.modern_spelling(F.col("text")).alias("text"))


@query(f"""
WITH {PAGES}, c AS (SELECT doc_id, len(regexp_extract_all(text, '[wW]')) AS w, replace(replace(text, 'W', 'V'), 'w', 'v') AS t FROM pages),
c2 AS (SELECT doc_id, w, (length(t) - length(replace(t, 'dt', ''))) // 2 AS dt, replace(t, 'dt', 'tt') AS t FROM c),
c3 AS (SELECT doc_id, w, dt, (length(t) - length(replace(t, 'gh', ''))) // 2 AS gh, replace(t, 'gh', 'g') AS t FROM c2)
SELECT doc_id, CAST(w + dt + gh + (length(t) - length(replace(t, 'ck', ''))) // 2 + len(regexp_extract_all(replace(t, 'ck', 'kk'), '(?:^|[^\\p{{L}}\\p{{N}}_\\p{{M}}])(?:hafv|gifv|blifv)')) AS INTEGER) AS n_changes,
       CAST(w AS INTEGER) AS w_replacements FROM c3""")
def change_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = pages(spark, sf_dir).select("doc_id", tx.spelling_changes(F.col("text")).alias("changes"))
    return of.select("doc_id", *reports.change_counts(F.col("changes")))


@query(f"""SELECT doc_id, regexp_replace(regexp_replace({SIGNS.format("replace(replace(replace(text, '‒', ' - '), '„', '\"'), '‚', '\"')")},
    '[\\x{{200b}}\\x{{200c}}\\x{{200d}}\\x{{feff}}\\x{{ad}}]', '', 'g'), '[ \\t]{{2,}}', ' ', 'g') AS text FROM documents""")
def unicode_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.straighten(F.col("text")).alias("text"))


@query(f"SELECT doc_id, regexp_replace(replace(text, '. ', '-' || chr(10) || ' '), '-{WS}*\\n{WS}*', '', 'g') AS text FROM documents")
def hyphen_rejoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.rejoin_hyphens(F.replace("text", F.lit(". "), F.lit("-\n "))).alias("text"))


@query()
def ocr_space_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookarounds have no SQL; tests compare with plain Python."""
    return pages(spark, sf_dir).select("doc_id", tx.merge_split_words(F.col("text")).alias("text"))


@query()
def normalized_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("doc_id", tx.normalize(F.col("text")).alias("text"))


@query(f"""
WITH {PAGES}, s AS (SELECT doc_id, {sentences_sql("text")} AS s FROM pages)
SELECT doc_id, CAST(generate_subscripts(s, 1) - 1 AS INTEGER) AS sentence_index, unnest(s) AS sentence FROM s""")
def sentences_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx.exploded(pages(spark, sf_dir), ("doc_id",), tx.sentences(F.col("text")), "sentence", "sentence_index")


@query(f"""
WITH {PAGES}, s AS (
    SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(replace(text, chr(10), ' '), '([.!?]){WS}+([A-ZÅÄÖ])', '\\1' || chr(1) || '\\2', 'g'), chr(1)),
        lambda x: {strip_sql("x")}), lambda x: length(x) > 10) AS s FROM pages)
SELECT doc_id, CAST(generate_subscripts(s, 1) - 1 AS INTEGER) AS sentence_index, unnest(s) AS sentence FROM s""")
def sentences_capital(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx.exploded(pages(spark, sf_dir), ("doc_id",), tx.sentences_before_capitals(F.col("text")), "sentence", "sentence_index")


@query(f"""
WITH s AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?]){WS}+', '\\1' || chr(1), 'g'), chr(1))) AS s,
                  generate_subscripts(string_split(regexp_replace(text, '([.!?]){WS}+', '\\1' || chr(1), 'g'), chr(1)), 1) AS i FROM documents),
w AS (SELECT doc_id, i, {tokens_sql("s")} AS w FROM s)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i, k) - 1 AS INTEGER) AS chunk, array_to_string(w[k + 1 : k + 60], ' ') AS text
FROM (SELECT doc_id, i, w, unnest(generate_series(0, greatest(len(w) - 1, 0), 60)) AS k FROM w) WHERE len(w) > 0""")
def word_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx.exploded(table(spark, sf_dir, "documents").withColumnRenamed("text", "t"), ("doc_id",), tx.word_chunks(F.col("t")), "text", "chunk")


@query(f"""
WITH {PAGES}
SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[{L}]{{3,}}')) AS word FROM pages)
WHERE NOT list_contains({list_sql(sorted(lx.STOPWORDS))}, word) GROUP BY 1""")
def tokenize_no_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tx.exploded(pages(spark, sf_dir), (), tx.word_list(F.col("text")), "word")
    return found.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH {PAGES}
SELECT doc_id, list_has_any(regexp_extract_all(lower(text), '[{L}]+'), {list_sql(sorted(lx.ICE_TOKENS))}) AS on_ice FROM pages""")
def ice_token_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("doc_id", tx.has_any_token(F.col("text")).alias("on_ice"))


HEADER = f"""
h AS (SELECT *, regexp_replace({strip_sql("text")}, '\\.+$', '') AS t FROM lines),
a AS (SELECT *, list_filter({tokens_sql("t")}, lambda w: regexp_matches(w, '[{L}]{{2,}}')) AS alpha FROM h),
headers AS (SELECT doc_id, i, text, CASE
    WHEN len(alpha) = 0 THEN false WHEN NOT list_bool_or(list_transform(alpha, lambda w: length(w) > 3)) THEN false WHEN len(alpha) > 7 THEN false
    WHEN regexp_matches(t, '(?i)^(n:o|s\\.|k\\.|p\\.){WS}*\\d') THEN false
    WHEN list_bool_and(list_transform(alpha, lambda w: upper(w) = w)) THEN true
    WHEN len(alpha) <= 4 AND regexp_matches(alpha[1], '^\\p{{Lu}}') THEN true
    ELSE len(list_filter(alpha, lambda w: regexp_matches(w, '^\\p{{Lu}}'))) / len(alpha) >= 0.6 END AS is_header FROM a)"""
LINES = "lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents)"


@query(f"WITH {LINES}, {HEADER} SELECT doc_id, CAST(i AS INTEGER) AS line, is_header FROM headers")
def header_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    return lines.select("doc_id", "line", tx.is_header(F.col("t")).alias("is_header"))


TOKENS = f"tokens AS (SELECT doc_id, unnest({tokens_sql('text')}) AS w FROM pages), distinct_words AS (SELECT w, count(*) AS n FROM tokens GROUP BY 1)"


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = tx.exploded(pages(spark, sf_dir), (), tx.tokens(F.col("text")), "w")
    return words.groupBy("w").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH {PAGES}, {TOKENS}
SELECT w, n, CASE WHEN len(regexp_extract_all(w, '\\p{{L}}')) >= 5
    THEN len(regexp_extract_all(w, '[aeiouåäöyAEIOUÅÄÖY]')) / len(regexp_extract_all(w, '\\p{{L}}')) END AS share FROM distinct_words""")
def vowel_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _words(spark, sf_dir).select("w", "n", tx.vowel_share(F.col("w")).alias("share"))


@query(f"WITH {PAGES}, {TOKENS} SELECT w, translate(w, '0135678', 'oissbtB') AS fixed, n FROM distinct_words WHERE translate(w, '0135678', 'oissbtB') <> w")
def digit_letter_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = tx.digits_to_letters(F.col("w"))
    return _words(spark, sf_dir).select("w", fixed.alias("fixed"), "n").where("fixed <> w")


REPEATED = "|".join(f"{chr(c)}{{4,}}" for c in range(0x30, 0x250) if chr(c).isalnum() or chr(c) == "_")  # no backreference in SQL
WORD = r"\p{L}\p{N}\p{M}_"
CONSONANTS = "bcdfghjklmnpqrstvwxzBCDFGHJKLMNPQRSTVWXZ"
BARE = "trim(w, '.,;:!?\"''()[]')"
#: Each rule on a bare word; a word boundary is a sign or an end, as the words hold no blanks.
RULES_SQL = f"""CASE
    WHEN regexp_matches(b, '(^|[^{WORD}])[{L}]+[0-9][{L}]+([^{WORD}]|$)') THEN 'digit_in_word'
    WHEN regexp_matches(b, '(^|[^{WORD}])[{WORD}]*({REPEATED})[{WORD}]*([^{WORD}]|$)') THEN 'repeated_chars'
    WHEN regexp_matches(b, '(^|[^{WORD}])[A-ZÅÄÖ]{{8,}}([^{WORD}]|$)') THEN 'long_allcaps'
    WHEN regexp_matches(b, '(^|[^{WORD}])(?:[a-zåäö][A-ZÅÄÖ]){{3,}}([^{WORD}]|$)') THEN 'mixed_case_chaos'
    WHEN regexp_matches(b, '(^|[^{WORD}])[{L}]+[|+\\\\#@$%^&*<>][{L}]+([^{WORD}]|$)') THEN 'embedded_symbols'
    WHEN regexp_matches(b, '(?i)[bcdfghjklmnpqrstvwxz]{{5,}}') THEN 'internal_cluster_5'
    WHEN regexp_matches(b, '(^|[^a-zA-Zåäöy])[{CONSONANTS}]{{3}}[{L}]+') THEN 'bad_consonant_start'
    WHEN regexp_matches(b, '[{L}]{{5,}}') AND len(regexp_extract_all(b, '\\p{{L}}')) >= 5
         AND len(regexp_extract_all(b, '[aeiouåäöyAEIOUÅÄÖY]')) / len(regexp_extract_all(b, '\\p{{L}}')) < 0.26 THEN 'low_vowel_ratio' END"""
ADMITTED = f"NOT list_contains({list_sql(sorted(lx.WHITELIST))}, lower(b)) AND regexp_matches(b, '[{L}]') AND length(b) >= 2"


@query(f"""
WITH {PAGES}, {TOKENS}, bare AS (SELECT {BARE} AS b, n FROM distinct_words)
SELECT b AS word, {RULES_SQL} AS rule_name, CAST(sum(n) AS BIGINT) AS n FROM bare WHERE {ADMITTED} AND {RULES_SQL} IS NOT NULL GROUP BY 1, 2""")
def ocr_rules_by_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule of each distinct word, so a rule is tried once a word, not once an occurrence."""
    kept = words.suspicious_counts(pages(spark, sf_dir), "text").where(sp.may_be_flagged(F.col("word")))
    judged = tx.exploded(kept, ("word", "n"), F.array(sp.ocr_rule(F.col("word"))), "rule_name")
    return judged.where("rule_name is not null").select("word", "rule_name", "n")


@query(f"""
WITH {PAGES}, t AS (SELECT doc_id, text, {tokens_sql("text")} AS ws FROM pages),
x AS (SELECT doc_id, text, ws, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i FROM t), y AS (SELECT *, {BARE} AS b FROM x), z AS (SELECT *, {RULES_SQL} AS rule FROM y WHERE {ADMITTED})
SELECT doc_id, CAST(i AS INTEGER) AS token, w AS original, CASE WHEN translate(b, '0135678', 'oissbtB') <> b THEN translate(b, '0135678', 'oissbtB') ELSE '' END AS suggestion,
       rule AS rule_name, CAST(instr(text, w) - 1 AS INTEGER) AS position, array_to_string(ws[greatest(1, i - 2) : i + 4], ' ') AS context
FROM z WHERE rule IS NOT NULL""")
def ocr_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every flagged token with its rule, suggestion, place and context of three words on either side."""
    return sp.ocr_flags(pages(spark, sf_dir))


@query(f"""
WITH {PAGES}, x AS (SELECT doc_id, unnest({tokens_sql("text")}) AS w FROM pages), y AS (SELECT doc_id, w, {BARE} AS b FROM x), z AS (SELECT *, {RULES_SQL} AS rule FROM y WHERE {ADMITTED})
SELECT rule AS rule_name, count(*) AS n_flagged, count(*) FILTER (translate(b, '0135678', 'oissbtB') <> b AND translate(b, '0135678', 'oissbtB') <> w) AS n_corrected
FROM z WHERE rule IS NOT NULL GROUP BY 1""")
def flag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.flag_counts(sp.ocr_flags(pages(spark, sf_dir)), "rule_name")


@query()
def apply_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with digits in words mended; a fold over each text's flags, which tests compare with plain Python."""
    from strandline.operators.ocr import correct

    return correct(pages(spark, sf_dir), auto_correct=True).select("doc_id", "corrected_text", "n_flagged", "n_corrected")


@query()
def corpus_scored_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a scorer trained on the corpus finds unlikely in their context, with its suggestion."""
    from strandline.operators.ocr import NgramScorer, model_flags

    rows = pages(spark, sf_dir)
    return model_flags(rows, NgramScorer.fit(rows))


@query()
def truncations(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = pages(spark, sf_dir).select("doc_id", F.explode(sp.truncations("text")).alias("t"))
    return of.select("doc_id", "t.fragment", "t.position")


@query(f"""
SELECT doc_id, {tokens_sql("text")} <> [] AND len(list_filter({tokens_sql("text")}, lambda t: regexp_matches(t, '^[^{L}]*$|[A-Z]{{8,}}|[|}}{{\\\\]{{2,}}')
    OR regexp_matches(t, '{REPEATED.replace("{4,}", "{5,}")}|\\.{{5,}}|-{{5,}}|={{5,}}|\\*{{5,}}|!{{5,}}|#{{5,}}'))) / greatest(len({tokens_sql("text")}), 1) > 0.3 AS has_ocr_issues FROM documents""")
def ocr_artefacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", (tx.noisy_share(F.col("text")) > 0.3).alias("has_ocr_issues"))


@query(f"SELECT unnest(list_distinct(list_concat({list_sql(sorted(lx.ICE_TOKENS_FI))}, {list_sql(sorted(lx.ICE_TOKENS_SV))}))) AS word")
def lexicon_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    fi, sv = (spark.createDataFrame([(w,) for w in sorted(x)], "word string") for x in (lx.ICE_TOKENS_FI, lx.ICE_TOKENS_SV))
    return fi.union(sv).distinct()


@query(f"""
WITH {PAGES}
SELECT DISTINCT word FROM (SELECT unnest(regexp_extract_all(lower(text), '[{L}]+')) AS word FROM pages) WHERE list_contains({list_sql(sorted(lx.ICE_TOKENS))}, word)""")
def lexicon_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = tx.exploded(pages(spark, sf_dir), (), F.regexp_extract_all(F.lower("text"), F.lit(f"([{L}]+)"), F.lit(1)), "word")
    return words.intersect(spark.createDataFrame([(w,) for w in sorted(lx.ICE_TOKENS)], "word string"))
