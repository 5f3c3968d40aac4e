"""Every label votes, however many there are."""

from quern.llm import quality


def test_all_labels_vote(spark):
    n = 30_000
    seen = spark.range(n).selectExpr("id", "id AS h", "'222222202' AS q", "'0022' AS t", "array(1) AS x")
    labels = spark.range(n).selectExpr("id AS doc_id", "int(id % 2) AS quality", "int(if(id % 3 = 0, null, id % 3 - 1)) AS toxic").union(spark.createDataFrame([(1, None, None), (None, 0, 1), (0, 1, None)], "doc_id long, quality int, toxic int"))
    got = {(r.q, r.t): r["count"] for r in quality._labelled(seen, labels).groupBy("q", "t").count().collect()}
    good, bad = "222222200", "222222201"
    third = n // 6
    assert got == {(good, "0022"): third + 1, (bad, "0022"): third - 1, (good, "0020"): third, (bad, "0020"): third, (good, "0021"): third, (bad, "0021"): third}
    silent = quality._labelled(seen, None).select("q", "t").distinct().collect()
    assert [tuple(r) for r in silent] == [("222222202", "0022")]


def test_votes_follow_the_labellers():
    s = quality.shape("some plain words of prose")
    assert quality.quality_votes(s)[-1] == quality.toxic_votes(*quality.terms("x"))[-1] == quality.NONE
    assert quality.quality_votes(s, 1)[:-1] == quality.quality_votes(s)[:-1]
