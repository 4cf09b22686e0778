from pyspark.sql import functions as F

from scholarium.functions import scores
from scholarium.functions import text as tx
from scholarium.operators import papers


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()["x"]


def test_title_keys_ignore_case_and_punctuation(spark):
    a, b = (one(spark, tx.title_key(F.lit(t))) for t in ("Shear-Thickening Behaviour of Polyborosiloxane!", "shear thickening behaviour of polyborosiloxane"))
    assert a == b
    assert one(spark, tx.title_key(F.lit(None))) == ""
    assert one(spark, tx.title_key(F.lit("聚硼"))) == ""


def test_years(spark):
    rows = [("2022.0", 2022), ("2024", 2024), (None, None), ("", None), ("2022f", None), ("2_022", 2022), ("inf", None), ("-1.9", -1), ("1e3", 1000)]
    got = spark.createDataFrame([(r[0],) for r in rows], "v string").select(tx.year(F.col("v")).alias("y")).collect()
    assert [r.y for r in got] == [r[1] for r in rows]


def test_abstracts_are_restored(spark):
    m = F.create_map(F.lit("Boron"), F.array(F.lit(0)), F.lit("oxygen"), F.array(F.lit(2)), F.lit("bonds"), F.array(F.lit(3)), F.lit("are"), F.array(F.lit(1)))
    assert one(spark, tx.restore_abstract(m)) == "Boron are oxygen bonds"
    assert one(spark, tx.restore_abstract(F.lit(None).cast("map<string,array<int>>"))) == ""
    twice = F.create_map(F.lit("a"), F.array(F.lit(0), F.lit(1)), F.lit("b"), F.array(F.lit(1)))
    assert one(spark, tx.restore_abstract(twice)) == "a b"


def test_overlap_of_titles(spark):
    assert one(spark, tx.overlap(F.lit("abcdefghij"), F.lit("abcdefghij"))) > 0.99
    assert one(spark, tx.overlap(F.lit("abcdefg"), F.lit("xyzwvut"))) < 0.2
    assert one(spark, tx.overlap(F.lit("abc"), F.lit("abc"))) == 0.0


def test_chunks_are_cleaned(spark):
    got = one(spark, tx.clean_chunk(F.lit("![](a.jpg)x  \n\n\n\n  y ")))
    assert got == "x\n\ny"
    assert one(spark, tx.clean_chunk(F.lit(None))) == ""


def test_chinese_and_query_lines(spark):
    assert one(spark, tx.looks_chinese(F.lit("聚硼硅氧烷"))) and not one(spark, tx.looks_chinese(F.lit("polyborosiloxane")))
    assert one(spark, tx.query_line(F.lit("1. shear thickening gel"))) == "shear thickening gel"
    assert one(spark, tx.query_line(F.lit("3D “gel”"))) == "D gel"


def test_numbers_need_a_word_end_after_the_unit(spark):
    count = lambda s: one(spark, tx.report_metrics(F.lit(s))["numbers"])
    assert count("10 MPa and 3 h") == 2
    assert count("10 s⁻¹ now") == 1
    assert count("9 nmα") == 0
    assert count("5 % of") == 0


def test_lenient_json(spark):
    value = lambda s: one(spark, F.try_variant_get(tx.lenient_json(F.lit(s)), "$.a", "int"))
    assert value('```json\n{"a": 1}\n```') == 1
    assert value('well: {"a": 2} ok') == 2
    assert value("nothing") is None


def test_cosine_of_odd_vectors(spark):
    v = lambda *x: F.array(*[F.lit(float(i)) for i in x])
    assert one(spark, scores.cosine(v(1, 0), v(0, 1))) == 0.0
    assert one(spark, scores.cosine(v(0, 0), v(0, 1))) == 0.0
    assert abs(one(spark, scores.cosine(v(2, 0), v(5, 0))) - 1) < 1e-12


def test_rank_prefers_relevance_to_citations(spark):
    rows = spark.createDataFrame([(500, 2020, 0.30, "new"), (3, 2024, 0.95, "new"), (3, 2024, 0.95, "have")], "c int, y int, r double, s string")
    got = [r.x for r in rows.select(scores.rank_score(F.col("r"), F.col("c"), F.col("y"), F.col("s"), 2026).alias("x")).collect()]
    assert got[1] > got[0] > got[2]


# Fixed values: (year, citations, relevance) of a search's 80 results, all new, in the order that it gave them in 2026.
RANKED = [
    (2020, 162, 0.664), (2021, 228, 0.594), (2016, 354, 0.594), (2023, 140, 0.581), (2021, 133, 0.616), (2019, 29, 0.77), (2010, 392, 0.597), (2012, 572, 0.576), (2022, 79, 0.627), (1981, 11165, 0.578), (2019, 130, 0.617), (2016, 132, 0.655), (2023, 51, 0.626), (2023, 60, 0.613), (2022, 89, 0.593), (2021, 81, 0.616), (2016, 104, 0.67), (2022, 61, 0.612), (2024, 35, 0.613), (2026, 0, 0.698), (2026, 0, 0.698), (2024, 9, 0.665), (2024, 19, 0.631), (2018, 100, 0.602), (2022, 42, 0.606), (2022, 28, 0.627), (2020, 77, 0.583), (2017, 93, 0.61), (2025, 12, 0.605), (1997, 186, 0.617), (2024, 22, 0.585), (2010, 139, 0.651), (2025, 20, 0.567), (2025, 10, 0.585), (2025, 0, 0.646), (2016, 104, 0.582), (2014, 89, 0.626), (2025, 2, 0.605), (2026, 0, 0.613), (2019, 29, 0.613), (2024, 11, 0.571), (2026, 1, 0.583), (2022, 12, 0.594), (2025, 1, 0.593), (2024, 15, 0.548), (1977, 91, 0.642), (2025, 0, 0.607), (2021, 33, 0.554), (2026, 0, 0.571), (2026, 0, 0.564), (2011, 86, 0.607), (1987, 69, 0.627), (2008, 75, 0.614), (1988, 101, 0.585), (2012, 92, 0.572), (2026, 0, 0.537), (2020, 0, 0.634), (2020, 15, 0.549), (2015, 30, 0.596), (1984, 28, 0.659), (1988, 72, 0.586), (2011, 85, 0.561), (2026, 0, 0.499), (2009, 27, 0.623), (2020, 0, 0.579), (2019, 0, 0.589), (2019, 1, 0.568), (2015, 15, 0.569), (2014, 0, 0.64), (1986, 31, 0.569), (2014, 7, 0.579), (2003, 18, 0.555), (1986, 9, 0.571), (2005, 6, 0.581), (1975, 2, 0.58), (1974, 1, 0.582), (1999, 2, 0.568), (1991, 1, 0.569), (1991, 1, 0.552), (1972, 0, 0.527)
]


def test_the_order_of_a_saved_search(spark):
    rows = [(i, y, c, r, "new") for i, (y, c, r) in enumerate(RANKED)]
    shuffled = sorted(rows, key=lambda r: hash((r[1], r[2], r[3])))
    got = papers.ranked(spark.createDataFrame(shuffled, "pos int, year int, citations int, relevance double, status string"), 2026).orderBy(F.desc("score"), "pos")
    assert [r.pos for r in got.collect()] == list(range(80))


def test_relevance_with_a_topic(spark):
    assert one(spark, scores.relevance(F.lit(0.64), F.lit(0.25))) == 0.4
    assert one(spark, scores.relevance(F.lit(0.64), F.lit(-0.5))) == 0.0
    assert one(spark, scores.relevance(F.lit(0.64), F.lit(None).cast("double"))) == 0.64


def test_image_marks_go(spark):
    assert one(spark, tx.drop_image_marks(F.lit("a ![](images/x y.jpg) b ![](other.jpg)"))) == "a  b ![](other.jpg)"
