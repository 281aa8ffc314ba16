"""The functions under their SQL names."""

from pyspark.sql import functions as F

from strandline.functions import sql
from strandline.functions import text as tx
from tests.test_pages import ALTO


def test_sql_functions(spark):
    sql.register(spark)
    names = ["1903-03-15_page-001.txt", "1902_page-003.txt"]
    texts = ["Wesi PHoto ryck â. Toinen!  kolmas? 1n", "", "jäätyw1nen"]
    df = spark.createDataFrame([(t, names[i % 2]) for i, t in enumerate(texts)], "t string, f string")
    df.createOrReplaceTempView("sql_texts")
    got = spark.sql("SELECT historical_fold(t) AS a, text_sentences(t) AS b, digits_to_letters(t) AS c, year_of_name(f) AS d, date_of_name(f) AS e FROM sql_texts")
    c, f = F.col("t"), F.col("f")
    want = df.select(tx.historical_fold(c).alias("a"), tx.sentences(c).alias("b"), tx.digits_to_letters(c).alias("c"), tx.year_of_name(f).alias("d"), tx.date_of_name(f).alias("e"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert spark.sql("SELECT match_rate(1, 3), match_rate(0, 0)").collect()[0][:] == (33.3, 0.0)


def test_table_functions(spark):
    sql.register(spark)
    spark.createDataFrame([(1, "15.5.1912 ja v. 1899"), (2, None)], "k int, t string").createOrReplaceTempView("sql_dated")
    got = spark.sql("SELECT k, d.day, d.year, d.format FROM sql_dated, LATERAL text_dates(t) d ORDER BY d.year").collect()
    assert [tuple(r) for r in got] == [(1, None, 1899, "year_only"), (1, 15, 1912, "numeric")]
    spark.createDataFrame([(1, bytearray(ALTO.encode())), (2, bytearray(b"<alto>"))], "k int, content binary").createOrReplaceTempView("sql_pages")
    got = spark.sql("SELECT w.word FROM sql_pages, LATERAL alto_words(content) w WHERE w.block_id = 'b1' ORDER BY w.line, w.word").collect()
    assert [r[0] for r in got] == ["karja", "tuli"]
