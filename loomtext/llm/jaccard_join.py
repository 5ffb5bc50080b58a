"""Components of documents whose shingle sets are alike: a size-aware heavy-light set join.

A document's set has its distinct k-word shingles (64-bit hashes). Sets of sizes a <= b link when they share at least
c(a, b) = ceil(t * (a + b) / (100 + t)) shingles, which is 100 * shared >= t * union. Equal sets collapse to one class
first, so copies cost nothing further.

Light: two sets of at most x shingles link exactly if they have a subset of c(a, b) shingles in common; each small set
enumerates its subsets of that fixed size for each partner size, and a common one is a proven link, no check needed.
Heavy: pairs with a larger set share one of the first n - ceil(t * n / 100) + 1 shingles of each set in a common order;
those shingles' inverted lists are scanned and candidates are verified on their whole sets. A pair counts in a list only
if both sets have enough shingles left from there on; in the list of the first one they share it then does. The order puts frequent
shingles last, by counts over all documents in a table of fixed size, so common passages make no lists.
x is the size with the least cost: subsets enumerated for sets up to x against lists scanned for the others.

Components need no list of all pairs. A list whose pairs across components are few names them all and is done. A longer
one takes the members with the most such pairs as pivots, names some of theirs with each component, the nearest, and drops
those that have no more; what remains, after parities too, goes on in the next round with more pivots and more pairs of each
with a component, unless it lies in one component by then. So a list of n near copies costs
about n checks and two rounds, however long it is: lists too long for a task's memory stream past the pivots, and those
in one component are left out before, by their least and largest component. Of named pairs, parities of 1024 places rule out most that differ too much; the others' whole sets
are compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import arrow_batches, cut, drop_path, partitions, released, shared_dir, text_rows, without
from .words import U64, Words, inside, mix, rolling, words_of

_BITS, _SLICES = 20, 16
PARITY = 1024
#: Sets up to this size may be light; their sizes are counted one by one.
MOST_LIGHT = 40
#: An entry of an inverted list costs this many times an enumerated subset, for the check that may follow.
SCAN_COST = 3
#: Lists of ids up to this length are broadcast (8 bytes each); longer ones are shuffled.
BROADCAST_IDS = 500_000
#: Components of up to so many links are found in one task (16 bytes each).
FEW_LINKS = 1_000_000
#: A list names all its pairs across components if they are at most so many for each member.
PAIRS_EACH = 8
#: Lists up to so many members weigh all their pairs in a matrix of bits (16 MB), TILE rows at a time; longer ones go past
#: their pivots one by one.
WHOLE, TILE = 4096, 128
#: Pairs and entries that a task gathers before it gives them out, and sets whose parities it counts at once.
GIVEN, COUNTED = 200_000, 2048
#: A pair whose whole sets are compared counts as so many rows where small cuts share files.
SET_ROWS = 8
#: Members of a list that a task holds at a time; longer lists stream past pivots from among the first ones held, so many at most.
HELD, PASSED = 50_000, 4096


def needed(a: int, b: int, t: int) -> int:
    return -(-t * (a + b) // (100 + t))


def prefix_size(n: int, t: int) -> int:
    return n - -(-t * n // 100) + 1


def subset_sizes(n: int, x: int, t: int) -> list[tuple[int, int, int]]:
    """(a, b, c) of all pairs of light sizes that a set of n shingles is one side of; equal sets are one class already."""
    pairs = [(n, b) for b in range(n, x + 1)] + [(a, n) for a in range(1, n)]
    return [(a, b, c) for a, b in pairs if 100 * a >= t * b and (c := needed(a, b, t)) <= a and not a == b == c]


def subsets(n: int, x: int, t: int) -> int:
    return sum(math.comb(n, c) for _, _, c in subset_sizes(n, x, t))


def boundary(sizes: dict[int, int], t: int) -> int:
    """The light-heavy boundary of least cost, from the number of sets of each size."""
    def cost(x: int) -> float:
        light = sum(k * subsets(n, x, t) for n, k in sizes.items() if n <= x)
        return light + SCAN_COST * sum(k * prefix_size(n, t) for n, k in sizes.items() if 100 * n >= t * (x + 1))

    limit = next((n for n in range(1, MOST_LIGHT + 1) if subsets(n, n, t) > 2000), MOST_LIGHT)
    return min(range(limit), key=cost)


def shingle_sets(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each document of a batch: (document, shingle) sorted by both. A text shorter than k words has one."""
    n = np.diff(w.first)
    ok = inside(w.first, k)
    h, d = rolling(w.hashes, k)[ok], w.doc[: len(ok)][ok]
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        one = np.array([_whole(w.hashes[w.first[i] : w.first[i + 1]]) for i in short], U64)
        h, d = np.concatenate([h, one]), np.concatenate([d, short])
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return d[new], h[new]


def _classes(d: np.ndarray, h: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Set sizes, where each set begins, and a hash of each set."""
    n = np.bincount(d, minlength=many)
    at = np.concatenate([[0], np.cumsum(n)])
    sums = np.concatenate([np.zeros(1, U64), np.cumsum(mix(h.copy()))])
    return n, at, mix((sums[at[1:]] - sums[at[:-1]]) * U64(3) + n.astype(U64)).view(np.int64)


def _parities(d: np.ndarray, h: np.ndarray, many: int) -> pa.Array:
    """PARITY bits for each set, each the parity of its shingles with that place; two sets differ in at least as many shingles as bits."""
    place, words = (h & U64(PARITY - 1)).astype(np.int64), np.empty(many * (PARITY // 64), np.int64)
    for a in range(0, many, COUNTED):
        e = min(many, a + COUNTED)
        i, j = np.searchsorted(d, [a, e])
        odd = (np.bincount((d[i:j] - a) * PARITY + place[i:j], minlength=(e - a) * PARITY) & 1).astype(np.uint8)
        words[a * (PARITY // 64) : e * (PARITY // 64)] = np.packbits(odd).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.arange(many + 1, dtype=np.int32) * (PARITY // 64)), pa.array(words))


def _whole(x: np.ndarray) -> int:
    return int(mix(rolling(x, len(x)) + U64(len(x)))[0])


def _counts(rows: DataFrame, k: int) -> tuple[np.ndarray, dict[int, int]]:
    """Frequency levels of shingles by their first bits, and the numbers of small sets by size; both cover all rows."""
    @released
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, sizes = np.zeros(1 << _BITS, np.int64), np.zeros(MOST_LIGHT + 1, np.int64)
        for b in batches:
            d, h = shingle_sets(words_of(b.column(1)), k)
            table += np.bincount((h >> U64(64 - _BITS)).astype(np.int64), minlength=1 << _BITS)
            n = np.bincount(d, minlength=b.num_rows)
            sizes += np.bincount(n[n <= MOST_LIGHT], minlength=MOST_LIGHT + 1)
        yield pa.RecordBatch.from_arrays([pa.array(range(_SLICES + 1)), pa.array([x.astype("<u4").tobytes() for x in [*np.split(table, _SLICES), sizes]], pa.binary())], ["slice", "counts"])

    @released
    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for s, c in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                x = np.frombuffer(c.as_buffer(), "<u4")
                sums[s] = sums[s] + x if s in sums else x.astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["slice", "counts"])

    schema = "slice long, counts binary"
    got = {r["slice"]: np.frombuffer(r["counts"], np.int64) for r in rows.mapInArrow(count, schema).repartition(_SLICES, "slice").mapInArrow(total, schema).collect()}
    if not got:
        return np.zeros(1 << _BITS, np.uint8), {}
    table = np.concatenate([got[s] for s in range(_SLICES)])
    return (2 * np.log2(1 + table)).astype(np.uint8), {n: int(c) for n, c in enumerate(got[_SLICES]) if n and c}


def components(links: DataFrame, path: str) -> DataFrame:
    """(id, comp) for each end of links (u, v): the smallest id that it is connected with. No link reaches the driver.

    Up to FEW_LINKS links meet in one task. More take the least label among neighbours and then the label of the label,
    round by round; written rounds keep plans short.
    """
    spark = links.sparkSession
    own = cut(links.select("u", "v").distinct(), f"{path}/links", links.count())
    if own.count() <= FEW_LINKS:
        return cut(own.coalesce(1).mapInArrow(_united, "id long, comp long"), f"{path}/labels")
    edges = cut(own.union(own.select(F.col("v"), F.col("u"))), f"{path}/edges")
    labels = cut(edges.groupBy(F.col("u").alias("id")).agg(F.least(F.min("v"), F.col("id")).alias("comp")), f"{path}/0")
    step = 0
    while True:
        step += 1
        heard = edges.join(labels.select(F.col("id").alias("v"), "comp"), "v").groupBy(F.col("u").alias("id")).agg(F.min("comp").alias("heard"))
        nearer = labels.join(heard, "id").select("id", "comp", F.least("comp", "heard").alias("near"))
        jump = labels.select(F.col("id").alias("near"), F.col("comp").alias("far"))
        new = cut(nearer.join(jump, "near", "left").select("id", F.least("near", F.coalesce("far", "near")).alias("comp"), (F.least("near", F.coalesce("far", "near")) < F.col("comp")).alias("moved")), f"{path}/{step}")
        drop_path(spark, f"{path}/{step - 1}")
        labels = new.select("id", "comp")
        if new.where("moved").isEmpty():
            return labels


@released
def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over one bounded partition of links."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = y
        return x

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            u, v = top(u), top(v)
            if u != v:
                up[max(u, v)] = min(u, v)
    ids = list(up)
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([top(x) for x in ids], pa.int64())], ["id", "comp"])


def alike(docs: DataFrame, t: int = 85, k: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row; component_id is the smallest id reachable by links.

    Null texts and texts without words have an empty set and link with nothing, not with one another either. Repeated
    rows and equal sets link. Null ids are never a component's id unless all its rows have none. Whole texts count,
    however long. An empty table gives no rows; other columns play no part. A set's class is known by a 64-bit hash.
    """
    return _alike(docs, t, k, id_col, text_col)[0]


def _alike(docs: DataFrame, t: int, k: int, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """alike(), and the number of its rows."""
    spark = docs.sparkSession
    arrow_batches(spark)
    base = shared_dir(spark)
    rows = text_rows(docs, id_col, text_col)
    levels, sizes = _counts(rows, k)
    x = boundary(sizes, t)

    @released
    def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d, h = shingle_sets(words_of(b.column(1)), k)
            many = b.num_rows
            n, at, cls = _classes(d, h, many)
            ordered = np.lexsort((h, levels[(h >> U64(64 - _BITS)).astype(np.int64)], d))
            place = np.arange(len(h)) - at[d]
            heavy = (place < prefix_size_of(n, t)[d]) & (100 * n[d] >= t * (x + 1))
            keys, owner, places = [h[ordered][heavy].view(np.int64)], [d[heavy]], [place[heavy].astype(np.int32)]
            smaller = [np.zeros(int(heavy.sum()), np.int32)]
            for i in np.flatnonzero((n > 0) & (n <= x)):
                own = h[at[i] : at[i + 1]]
                for a, bb, c in subset_sizes(int(n[i]), x, t):
                    sub = own[np.array(list(combinations(range(len(own)), c)))]
                    key = mix(mix(sub).sum(axis=1, dtype=U64) * U64(5) + U64(a * 4096 + bb))
                    keys.append(key.view(np.int64))
                    owner.append(np.full(len(key), i))
                    smaller.append(np.full(len(key), a, np.int32))
                    places.append(np.zeros(len(key), np.int32))
            owner = np.concatenate(owner)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([b.column(0), pa.nulls(len(owner), pa.int64())]),
                    pa.array(np.concatenate([n, n[owner]]).astype(np.int32)),
                    pa.array(np.concatenate([cls, cls[owner]])),
                    pa.concat_arrays([pa.nulls(many, pa.int64()), pa.array(np.concatenate(keys))]),
                    pa.concat_arrays([pa.nulls(many, pa.int32()), pa.array(np.concatenate(smaller))]),
                    pa.concat_arrays([_parities(d, h, many), pa.nulls(len(owner), pa.list_(pa.int64()))]),
                    pa.concat_arrays([pa.nulls(many, pa.int32()), pa.array(np.concatenate(places))]),
                ],
                ["doc_id", "n", "cls", "key", "smaller", "bits", "place"],
            )

    @released
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted entries in: of light keys, a link to the smallest set; of heavy keys with two members, all entries."""
        head: tuple | None = None  # first entry of the open key, and whether it has been passed on
        last = None
        for b in batches:
            key, small, n, cls, place = (b.column(i).to_numpy() for i in range(5))
            m = len(key)
            if not m:
                continue
            same = np.zeros(m, bool)
            same[1:] = key[1:] == key[:-1]
            if head is not None:
                same[0] = key[0] == head[0]
            repeat = np.zeros(m, bool)
            repeat[1:] = same[1:] & (cls[1:] == cls[:-1])
            if last is not None:
                repeat[0] = same[0] & (cls[0] == last)
            last = cls[-1]
            at = np.maximum.accumulate(np.where(~same, np.arange(m), -1))
            carried = at < 0
            first_cls = np.where(carried, head[3] if head else 0, cls[at])
            first_n = np.where(carried, head[2] if head else 0, n[at])
            follow = same & ~repeat & (cls != first_cls)
            link = follow & (small > 0) & (first_n == small)
            live = follow & (small == 0)
            firsts = np.unique(at[live & ~carried])
            again = head is not None and not head[4] and bool((live & carried).any())
            k2 = np.concatenate([key[link], key[firsts], key[live], [head[0]] if again else []]).astype(np.int64)
            u2 = np.concatenate([first_cls[link], np.zeros(len(firsts) + int(live.sum()) + again, np.int64)]).astype(np.int64)
            c2 = np.concatenate([cls[link], cls[firsts], cls[live], np.array([head[3]] if again else [], np.int64)]).astype(np.int64)
            n2 = np.concatenate([n[link], n[firsts], n[live], np.array([head[2]] if again else [], np.int32)]).astype(np.int32)
            p2 = np.concatenate([place[link], place[firsts], place[live], np.array([head[5]] if again else [], np.int32)]).astype(np.int32)
            l2 = np.arange(len(k2)) < int(link.sum())
            if same[-1] and at[-1] < 0:
                head = (*head[:4], head[4] or again, head[5])
            else:
                i = int(at[-1])
                head = (int(key[i]), int(small[i]), int(n[i]), int(cls[i]), i in firsts, int(place[i]))
            if len(k2):
                yield pa.RecordBatch.from_arrays([pa.array(l2), pa.array(k2), pa.array(u2), pa.array(c2), pa.array(n2), pa.array(p2)], ["link", "key", "u", "cls", "n", "place"])

    spread = partitions(spark)
    signed = rows.mapInArrow(signatures, "doc_id long, n int, cls long, key long, smaller int, bits array<long>, place int")
    written = cut(signed.withColumn("entry", F.col("key").isNotNull()), f"{base}/signed")
    members = cut(written.where(~F.col("entry")).select("doc_id", "n", "cls", "bits"), f"{base}/members")
    entries = written.where("entry").select("key", "smaller", "n", "cls", "place")
    met = cut(entries.repartition(spread, "key").sortWithinPartitions("key", "n", "cls").mapInArrow(scan, "link boolean, key long, u long, cls long, n int, place int"), f"{base}/met")
    drop_path(spark, f"{base}/signed")
    arrow_batches(spark)
    links = met.where("link").select("u", F.col("cls").alias("v")).distinct()
    lists = met.where(~F.col("link")).select("key", "cls", "n", "place").distinct()
    n, n_met = members.count(), met.count()
    found = _verified_rounds(lists, links, n_met, rows, members, n, t, k, base)
    labels = components(found, f"{base}/components")
    return _placed(members, n, labels, base), n


def _placed(members: DataFrame, n: int, labels: DataFrame, base: str) -> DataFrame:
    """Each row's component, settled for classes first: copies and components are as large as they like, classes are rows.

    Only classes with copies or links have an entry, which is broadcast or, beyond BROADCAST_IDS, joined; all others are
    their own component.
    """
    few = labels.count() <= BROADCAST_IDS
    ids = labels.withColumnRenamed("id", "cls")
    classes = cut(members.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")).where("copies > 1").unionByName(
        members.where("n > 0").join(F.broadcast(ids.select("cls")) if few else ids.select("cls"), "cls", "left_semi").groupBy("cls").agg(F.min("doc_id").alias("least"), F.lit(0).cast("long").alias("copies"))), f"{base}/classes", 2 * n)
    linked = classes.where("copies = 0").join(F.broadcast(ids) if few else ids, "cls")
    heads = linked.groupBy("comp").agg(F.min("least").alias("component"))
    of_links = linked.join(F.broadcast(heads) if few else heads, "comp").select("cls", "component")
    of_copies = classes.where("copies > 1").join(F.broadcast(ids.select("cls")) if few else ids.select("cls"), "cls", "left_anti").select("cls", F.col("least").alias("component"))
    entries = cut(of_links.unionByName(of_copies), f"{base}/entries", 2 * n)
    joined = members.join(F.broadcast(entries) if entries.count() <= BROADCAST_IDS else entries, "cls", "left")
    return joined.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def prefix_size_of(n: np.ndarray, t: int) -> np.ndarray:
    return n - -(-t * n // 100) + 1


def _verified(pairs: DataFrame, rows: DataFrame, members: DataFrame, n: int, bits: DataFrame, t: int, k: int, base: str) -> DataFrame:
    """Those of pairs (u, v) of classes that link; n members. Parities rule out most others before any set is compared."""
    sides = pairs.join(bits.select(F.col("cls").alias("u"), F.col("bits").alias("ub"), F.col("n").alias("un")), "u").join(bits.select(F.col("cls").alias("v"), F.col("bits").alias("vb"), F.col("n").alias("vn")), "v")
    differ = F.aggregate(F.zip_with("ub", "vb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    # 2 * shared = un + vn - differing, and differing >= differ
    able = cut(sides.where((100 + t) * (F.col("un") + F.col("vn") - differ) >= 2 * t * (F.col("un") + F.col("vn"))).select("u", "v"), f"{base}/able", pairs.count() + n)
    n_able = able.count()
    named = able.select(F.col("u").alias("cls")).union(able.select(F.col("v"))).distinct()
    chosen = cut(members.join(named, "cls", "left_semi").groupBy("cls").agg(F.min("doc_id").alias("doc_id")), f"{base}/chosen", n + 2 * n_able)

    @released
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d, h = shingle_sets(words_of(b.column(1)), k)
            _, at, cls = _classes(d, h, b.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(cls), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(h.view(np.int64)))], ["cls", "shingles"])

    few = chosen.count() <= BROADCAST_IDS
    ids, wanted = chosen.where("doc_id is not null").select("doc_id"), chosen.select("cls")
    picked = rows.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    if not chosen.where("doc_id is null").isEmpty():  # classes all of whose rows have null ids
        picked = picked.unionByName(rows.where("doc_id is null"))
    whole = cut(picked.mapInArrow(sets, "cls long, shingles array<long>").join(F.broadcast(wanted) if few else wanted, "cls", "left_semi"), f"{base}/sets")
    small = n_able <= BROADCAST_IDS
    left = whole.select(F.col("cls").alias("u"), F.col("shingles").alias("us"))
    both = left.join(F.broadcast(able) if small else able, "u").join(whole.select(F.col("cls").alias("v"), F.col("shingles").alias("vs")), "v")
    shared = F.size(F.array_intersect("us", "vs"))
    checked = cut(both.where((100 + t) * shared >= t * (F.size("us") + F.size("vs"))).select("u", "v").distinct(), f"{base}/checked", SET_ROWS * n_able)
    drop_path(rows.sparkSession, f"{base}/sets")
    return checked


def _name_pairs(t: int, pivots: int):
    """Of entries (key, n, cls, comp, place) sorted by key and n: pairs to verify, and entries of lists that go on, whose u is 1 where the list is longer than HELD."""

    def able(ni, ri, nj, rj):
        """Sizes that can link, and enough left from this shingle on, as if it were the first that the two share: where it is, that holds."""
        return (100 * np.minimum(ni, nj) >= t * np.maximum(ni, nj)) & ((100 + t) * np.minimum(ri, rj) >= t * (ni + nj))

    def matrix(n: np.ndarray, at: np.ndarray, rest: np.ndarray, bits: np.ndarray) -> np.ndarray:
        """Which pairs across components may link: sizes, shingles left, and parities where they are known."""
        out = np.empty((len(n), len(n)), bool)
        for a in range(0, len(n), TILE):
            i = slice(a, a + TILE)
            out[i] = (at[i, None] != at[None, :]) & able(n[i, None], rest[i, None], n[None, :], rest[None, :])
            if bits.shape[1]:
                for j in range(a, min(a + TILE, len(n)), 32):
                    differ = np.bitwise_count(bits[j : min(j + 32, a + TILE), None, :] ^ bits[None, :, :]).sum(axis=2, dtype=np.int64)
                    both = n[j : min(j + 32, a + TILE), None] + n[None, :]
                    out[j : min(j + 32, a + TILE)] &= (100 + t) * (both - differ) >= 2 * t * both
        return out

    def near(h: int, j: np.ndarray, n: np.ndarray, bits: np.ndarray) -> np.ndarray:
        """How far members j are from member h: by parities where they are known, else by size."""
        return np.bitwise_count(bits[j] ^ bits[h]).sum(axis=1, dtype=np.int64) if bits.shape[1] else np.abs(n[j] - n[h])

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        key, many, streaming = None, 0, None
        out: list[tuple[np.ndarray, ...]] = []
        recorded = 0

        def record(u: np.ndarray, v: np.ndarray, n: np.ndarray, cls: np.ndarray, rest: np.ndarray, long: int = 0) -> None:
            nonlocal recorded
            if not len(u) and not len(cls):
                return
            recorded += len(u) + len(cls)
            z = lambda x: np.zeros(x, np.int64)
            out.append((np.concatenate([u, z(len(cls)) + long]), np.concatenate([v, cls]), np.concatenate([z(len(u)), np.full(len(cls), key, np.int64)]), np.concatenate([z(len(u)), n]), np.concatenate([z(len(u)), n - rest]), np.arange(len(u) + len(cls)) < len(u)))

        def given(least: int) -> Iterator[pa.RecordBatch]:
            """What has been recorded, once it is so much."""
            nonlocal recorded
            if out and recorded >= least:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[x] for o in out])) for x in range(6)], ["u", "cls", "key", "n", "place", "pair"])
                out.clear()
                recorded = 0

        def weighed(n: np.ndarray, cls: np.ndarray, comp: np.ndarray, rest: np.ndarray, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
            """A list's pairs if they are few; else those of its best connected members, `pivots` with each component, and who has more goes on."""
            none = np.zeros(0, np.int64)
            kinds, at = np.unique(comp, return_inverse=True)
            if len(kinds) == 1:
                return
            may = matrix(n, at, rest, bits)
            most = may.sum(axis=1)
            if most.sum() <= 2 * PAIRS_EACH * len(n):
                i, j = np.nonzero(np.triu(may))
                record(np.minimum(cls[i], cls[j]), np.maximum(cls[i], cls[j]), none, none, none)
                return
            on = most > 0
            for h in np.argsort(-most, kind="stable")[:pivots]:
                j = np.flatnonzero(may[h])
                j = j[np.lexsort((near(h, j, n, bits), at[j]))]  # by component, the nearest first
                starts = np.flatnonzero(np.diff(at[j], prepend=-1))
                j = j[np.arange(len(j)) - np.repeat(starts, np.diff(starts, append=len(j))) < pivots]
                record(np.minimum(cls[h], cls[j]), np.maximum(cls[h], cls[j]), none, none, none)
                on[h] = len(j) < most[h]
                yield from given(GIVEN)
            record(none, none, n[on], cls[on], rest[on])

        def heads_of(first: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
            """Pivots: members of the smallest components."""
            _, one, sizes = np.unique(first[2], return_index=True, return_counts=True)
            heads = one[np.argsort(sizes, kind="stable")[: min(pivots, PASSED)]]
            return tuple(c[heads] for c in first)

        def past(n: np.ndarray, cls: np.ndarray, comp: np.ndarray, rest: np.ndarray, bits: np.ndarray, long: int = 1) -> Iterator[pa.RecordBatch]:
            none = np.zeros(0, np.int64)
            for pn, pc, pm, pr, pb in zip(*streaming, strict=True):
                may = (comp != pm) & able(pn, pr, n, rest)
                if len(pb):
                    differ = np.bitwise_count(bits[may] ^ pb).sum(axis=1, dtype=np.int64)
                    may[may] = (100 + t) * (pn + n[may] - differ) >= 2 * t * (pn + n[may])
                if may.any():
                    record(np.minimum(pc, cls[may]), np.maximum(pc, cls[may]), none, none, none)
                    yield from given(GIVEN)
            on = ~np.isin(cls, streaming[1])
            record(none, none, n[on], cls[on], rest[on], long)

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal held, many, streaming
            if held and streaming is None:
                whole = tuple(np.concatenate([h[i] for h in held]) for i in range(5))
                cls, comp = whole[1:3]
                if len(cls) <= WHOLE:
                    yield from weighed(*whole)
                elif (comp != comp[0]).any():
                    streaming = heads_of(whole)
                    yield from past(*whole, 0)
            held, many, streaming = [], 0, None

        for b in batches:
            keys = b.column(0).to_numpy()
            cols = [b.column(i).to_numpy() for i in (1, 2, 3)]
            cols.append(cols[0] - b.column(4).to_numpy())
            known = b.column(5).flatten().to_numpy() if b.num_columns > 5 else np.zeros(0, np.int64)
            cols.append(known.view(np.uint64).reshape(len(keys), -1) if len(known) else np.zeros((len(keys), 0), np.uint64))
            if not len(keys):
                continue
            edges = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                if keys[i] != key:
                    yield from close()
                    key = int(keys[i])
                    yield from given(GIVEN)
                part = tuple(c[i:j] for c in cols)
                if streaming is not None:
                    yield from past(*part)
                    continue
                held.append(part)
                many += j - i
                if many > HELD:
                    first = tuple(np.concatenate([h[x] for h in held]) for x in range(5))
                    streaming = heads_of(first)
                    yield from past(*first)
                    held = []
            yield from given(1)
        yield from close()
        yield from given(1)

    return run


def _verified_rounds(lists: DataFrame, links: DataFrame, n_met: int, rows: DataFrame, members: DataFrame, n: int, t: int, k: int, base: str) -> DataFrame:
    """All links that components need: proven ones and those that checks of named pairs find. n_met entries and links, n members."""
    spark = rows.sparkSession
    spread = partitions(spark)
    found, step = cut(links, f"{base}/links0", n_met), 0
    alive = cut(lists.withColumn("u", F.lit(0).cast("long")), f"{base}/alive0", n_met)
    bits = cut(members.groupBy("cls").agg(F.first("bits").alias("bits"), F.first("n").alias("n")), f"{base}/bits", n)
    while True:
        step += 1
        labels = components(found, f"{base}/comp{step}")
        small = labels.count() <= BROADCAST_IDS
        tag = labels.select(F.col("id").alias("cls"), "comp")
        tagged = alive.join(F.broadcast(tag) if small else tag, "cls", "left").select("key", F.col("n").cast("long").alias("n"), "cls", F.coalesce("comp", "cls").alias("comp"), F.col("place").cast("long").alias("place"), "u")
        long = tagged.where("u = 1")
        if step > 1 and not alive.where("u = 1").isEmpty():  # a task can't see all of these at once
            mixed = long.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
            tagged = tagged.where("u = 0").unionByName(long.join(mixed, "key", "left_semi"))
        tagged = tagged.drop("u")
        if step > 1:  # what goes on is little, and parities thin it out further
            tagged = tagged.join(bits.select("cls", "bits"), "cls").select("key", "n", "cls", "comp", "place", "bits")
        named = cut(tagged.repartition(spread, "key").sortWithinPartitions("key", "n", "cls").mapInArrow(_name_pairs(t, 8 ** (step - 1)), "u long, cls long, key long, n long, place long, pair boolean"), f"{base}/named{step}")
        arrow_batches(spark)
        pairs = cut(named.where("pair").select("u", F.col("cls").alias("v")).distinct(), f"{base}/pairs{step}", named.count())
        alive = named.where("not pair").select("key", "cls", "n", "place", "u")
        if not pairs.isEmpty():
            checked = _verified(pairs, rows, members, n, bits, t, k, f"{base}/verify{step}")
            found = cut(found.union(checked), f"{base}/links{step}")
        if alive.isEmpty():
            return found


def near_dedup_stage(docs: DataFrame, t: int = 80, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each component, the one with the smallest id; all columns.

    Of rows that share that id, all stay that belong to it: run exact deduplication first. Rows with null ids stay.
    """
    groups, n = _alike(docs, t, k, id_col, text_col)
    dropped = cut(groups.where("doc_id <> component_id").select(F.col("doc_id").alias("__dropped")).distinct(), f"{shared_dir(docs.sparkSession)}/near", n)
    return without(docs, dropped, docs[id_col].cast("long") == dropped["__dropped"], dropped.count())
