from urllib.parse import urljoin

from pyspark.sql import functions as F

from loomtext.functions import native as N


def test_dot_segments_of_any_depth(spark):
    base = "http://h.example/" + "/".join(f"d{i}" for i in range(12)) + "/page"
    hrefs = ["../" * n + "x?q=../a#../b" for n in (1, 6, 7, 9, 12, 15)] + ["../" * 8 + "a/./b/../c", "../..", "..", ".", "./", "a/..", "/../x", "../" * 30, "x.html", "?a=../b"]
    got = spark.createDataFrame([(h, base) for h in hrefs], "href string, base string").select("href", N.absolute_url("href", "base").alias("url")).collect()
    assert {r.href: r.url for r in got} == {h: urljoin(base, h) for h in hrefs}
