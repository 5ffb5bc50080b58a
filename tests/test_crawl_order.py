"""The crawl's order against a queue in plain Python, on random graphs with filters."""

import random
from collections import deque


from loomtext.operators import frontier


def plain(links, seeds, follow, allowed, inline):
    out_of = {}
    for src, position, url in sorted(links, key=lambda x: (x[1], x[2])):
        if url not in [u for u, _ in out_of.setdefault(src, [])]:
            out_of[src].append((url, position))
    queue = deque((u, 0) for u, _ in sorted(seeds, key=lambda x: (x[1], x[0])))
    seen, pdfs, out = set(), {}, []
    while queue:
        url, depth = queue.popleft()
        if url in seen:
            continue
        seen.add(url)
        ok = allowed(url)
        out.append((url, depth, len(out), ok, False))
        if not ok:
            continue
        for u, _ in out_of.get(url, []):
            if inline and u.lower().endswith(".pdf"):
                pdfs.setdefault(u, (depth, out[-1][2]))
            elif follow(u) and u not in seen:
                queue.append((u, depth + 1))
    return sorted(out + [(u, d, v, True, True) for u, (d, v) in pdfs.items() if u not in seen])


def test_random_graphs(spark):
    rng = random.Random(2)
    for inline in (False, True):
        nodes = [f"u{i:02d}{rng.choice(['', '', '.pdf', '.PDF', 'x'])}" for i in range(60)]
        links = [(rng.choice(nodes), rng.randrange(30), rng.choice(nodes)) for _ in range(160)]
        links += [(f"c{i}", 0, f"c{i + 1}") for i in range(6)] + [("u00", 3, "c0"), (nodes[0], 2, "c0")]
        seeds = [(nodes[i], i % 4) for i in (0, 5, 7, 0, 9)]
        df = spark.createDataFrame([*links, (None, 1, "u01"), ("u01", 1, None)], "src string, position int, url string")
        got = frontier.crawl_order(df, spark.createDataFrame(seeds, "url string, position int"), lambda u: ~u.endswith("x"), lambda urls: urls.where("url not like '%3%'"), inline)
        first = {}
        for u, p in seeds:
            first[u] = min(p, first.get(u, 99))
        want = plain(links, list(first.items()), lambda u: not u.endswith("x"), lambda u: "3" not in u, inline)
        assert sorted((r.url, r.depth, r.visit, r.fetched, r.inline) for r in got.collect()) == want
    none = spark.createDataFrame([], "url string, position int")
    assert frontier.crawl_order(df, none).collect() == []
    assert [(r.url, r.visit) for r in frontier.crawl_order(df.limit(0), spark.createDataFrame([("a", 1)], "url string, position int"), inline_pdfs=True).collect()] == [("a", 0)]
