from pyspark.sql import functions as F

from gleanspark.functions import text as T
from gleanspark.functions import urls as U


def one(spark, make, *values):
    df = spark.createDataFrame([(v,) for v in values], "v string").withColumn("n", F.monotonically_increasing_id())
    return [r[0] for r in df.orderBy("n").select(make(F.col("v"))).collect()]


def test_tokens_and_white_space(spark):
    assert one(spark, T.estimate_tokens, "a b c", "", None, " ﻿ ", "a\u0085b") == [4, 0, 0, 0, 2]
    assert one(spark, T.js_trim, "﻿ a 　", None) == ["a", None]
    assert one(spark, lambda c: T.effective_overlap(c.try_cast("double"), F.lit(30)), "0.1", "NaN", "-1", "2", None) == [3, 3, 3, 29, 3]


def test_normal_forms(spark):
    a, b = U.crawl_key, U.dedup_key
    assert one(spark, a, "HTTPS://WWW.A.test:443/x/?b=2&a=1&utm_source=q#f", "http://a.test", "nonsense", None) == ["https://www.a.test/x?a=1&b=2", "http://a.test/", "nonsense", None]
    assert one(spark, b, "https://a.test/x/?b=2&a=1&_ga=3&ref=x", "http://a.test:8080/?flag&q=a%20b") == ["https://a.test/x?b=2&a=1&_ga=3", "http://a.test:8080/?flag=&q=a+b"]
    assert one(spark, lambda c: a(a(c)) == a(c), "https://a.test/x/?z=1&b#q", "x", "http://h.test//") == [True, True, True]


def test_scores(spark):
    assert one(spark, U.depth_score, "https://x.test/a/b", "https://x.test/a", "https://x.test/", "https://x.test/1/2/3/4/5/6/7") == [0.5, 0.333, 0.25, 0.2]
    assert one(spark, lambda c: U.freshness(c, 2026), "https://x.test/2024/a", "https://x.test/2016/a", "https://x.test/a", "https://x.test/120199", "https://x.test/2030") == [0.8, 0.1, 0.5, 0.5, 1.0]
    assert one(spark, lambda c: U.registrable(c), "a.b.c.sonar.com", "docs.shop.co.uk", "192.168.0.1", "localhost") == ["sonar.com", "shop.co.uk", "192.168.0.1", "localhost"]
