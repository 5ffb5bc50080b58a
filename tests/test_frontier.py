from loomtext.operators.frontier import reach


def test_chain_longer_than_fifty_links(spark):
    """A chain of 60 links with a way back and a page that no seed reaches."""
    edges = [(f"u{i}", f"u{i + 1}") for i in range(60)] + [("u60", "u0"), ("u3", "u1"), ("x", "y")]
    got = reach(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame([("u0",)], "url string")).collect()
    assert sorted(map(tuple, got)) == sorted((f"u{i}", i) for i in range(61))


def test_no_seeds(spark):
    assert reach(spark.createDataFrame([("a", "b")], "src string, dst string"), spark.createDataFrame([], "url string")).count() == 0
