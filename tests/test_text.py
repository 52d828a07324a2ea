from pyspark.sql import functions as F

from quillspan.functions import text as T


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_tokens_keep_names_and_scripts(spark):
    assert one(spark, T.tokenize(F.lit("fetch_with_retries 서울특별시"))) == ["fetch_with_retries", "서울특별시"]
    assert one(spark, T.tokenize(F.lit("Straße, latency."))) == ["strasse", "latency."]
    assert one(spark, T.tokenize(F.lit(None).cast("string"))) == []


def test_jaccard_of_an_empty_side_is_zero(spark):
    a, e = F.array(F.lit("a"), F.lit("b")), F.array().cast("array<string>")
    assert one(spark, T.jaccard(a, e)) == 0.0
    assert one(spark, T.jaccard(a, F.array(F.lit("b"), F.lit("c")))) == 1 / 3


def test_support_needs_half_of_the_terms(spark):
    text = F.lit("the march report has an orange chart")
    assert one(spark, T.has_support(F.lit("The March report contains an orange chart"), text))
    assert not one(spark, T.has_support(F.lit("volcano astronomy"), text))
    assert not one(spark, T.has_support(F.lit("the of"), text))


def test_facts_ignore_case_and_space(spark):
    assert one(spark, T.contains_fact(F.lit("An  ORANGE\nchart."), F.lit("orange chart")))
    assert not one(spark, T.contains_fact(F.lit("anything"), F.lit("  ")))


def test_suffixes_and_paths(spark):
    for path, suffix in (("a/b.PDF", ".pdf"), (".git", ""), ("a.b/c", ""), ("x.", ""), ("c:\\d\\e.Py", ".py"), ("a.tar.gz/", ".gz")):
        assert one(spark, T.path_suffix(F.lit(path))) == suffix
    assert one(spark, T.safe_path(F.lit("/..\\a//./b.txt"))) == "a/b.txt"
    assert one(spark, T.safe_path(F.lit("../.."))) is None


def test_bytes_to_chars(spark):
    assert one(spark, T.bytes_to_chars(F.lit("äb"), F.lit(2))) == 1
