"""N-gram Jaccard join by signature trees.

Distinct texts whose shingle sets share a rare-first prefix token meet in blocks of bounded size. A block is a tree whose nodes
hold the OR and AND of their members' bitmaps and a size range; two trees are walked together, and a pair of nodes is
left as soon as no pair below it can reach the wanted overlap, or all below it is known to be connected.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonewheel.functions.lineage import checkpoint_dir, cut
from tonewheel.llm.heavy import attach
from tonewheel.llm.lean import lean, lean_batches

N = 3
BITS = 1024
#: A wider bitmap, kept once for each set, that leaves few pairs to be compared by their texts.
WIDE = 4096
#: Tokens by which a pair that met before is known.
EARLY = 32
BUCKETS = 1 << 18
BLOCK = 1024
LEAF = 16
#: Words are told apart by polynomials of their bytes: an odd base, its inverse, and a number for each byte, small for capitals A-Z.
BASE = 0xC2B2AE3D27D4EB4B
INVERSE = pow(BASE, -1, 1 << 64)
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
LETTERS = np.random.default_rng(2024).integers(1, 1 << 63, 256, dtype=np.uint64)[np.frombuffer(bytes(range(256)).lower(), np.uint8)]


class _Powers:
    """Powers of the base and of its inverse, as many as the longest text so far has bytes."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            step = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(BASE, step, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(INVERSE, step, 1 << 64))])
        return self.up, self.down


POWERS = _Powers()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word in order, capitals A-Z as small letters, with no Python object per word."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    inside = np.concatenate([[False], ~SPACE[data], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    first, last = edges[::2], edges[1::2]
    up, down = POWERS.upto(len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(LETTERS[data] * up[: len(data)], dtype=np.uint64)])
    return _mixed((sums[last] - sums[first]) * down[first])


def shingles(text: str, n: int = N) -> np.ndarray:
    """The distinct n-word shingles as sorted 64-bit hashes; two shingles of one hash count as equal (odds near 1e-18 a pair)."""
    h = word_hashes(text)
    if not len(h):
        return np.empty(0, np.int64)
    n = min(n, len(h))
    out = np.full(len(h) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        out = _mixed((out ^ h[i : len(h) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(i))
    return np.unique(out.view(np.int64))


def bitmap(h: np.ndarray, width: int = BITS) -> np.ndarray:
    bits = np.zeros(width, dtype=np.uint8)
    bits[h % width] = 1
    return np.packbits(bits).view(np.uint64)


class Tree:
    """Members in the given order, leaves of LEAF, then pairs of nodes up to one root."""

    def __init__(self, sizes: np.ndarray, maps: np.ndarray, groups: np.ndarray):
        self.sizes, self.maps, self.groups = sizes, maps, groups
        at = np.arange(0, len(sizes), LEAF)
        level = (np.minimum.reduceat(sizes, at), np.maximum.reduceat(sizes, at), np.bitwise_or.reduceat(maps, at),
                 np.bitwise_and.reduceat(maps, at), np.minimum.reduceat(groups, at), np.maximum.reduceat(groups, at))
        self.levels = [level]
        while len(level[0]) > 1:
            at = np.arange(0, len(level[0]), 2)
            folds = (np.minimum, np.maximum, np.bitwise_or, np.bitwise_and, np.minimum, np.maximum)
            level = tuple(f.reduceat(v, at) for f, v in zip(folds, level))
            self.levels.append(level)


def _missing(some: np.ndarray, other: np.ndarray) -> np.ndarray:
    return np.bitwise_count(some & ~other).sum(axis=-1, dtype=np.int64)


def walk(x: Tree, y: Tree, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index arrays of the member pairs that may link. A member of n tokens with d bits the other side lacks shares at
    most n - d tokens, and needs percent / (100 + percent) of both sizes."""
    a, b = 100, percent
    pairs = [(len(x.levels) - 1, 0, len(y.levels) - 1, 0)]
    while pairs:
        i, p, j, q = pairs.pop()
        u, v = [c[p] for c in x.levels[i]], [c[q] for c in y.levels[j]]
        if u[4] == u[5] == v[4] == v[5]:
            continue
        if a * u[1] < (a + b) * _missing(u[3], v[2]) + b * v[0] or a * v[1] < (a + b) * _missing(v[3], u[2]) + b * u[0]:
            continue
        if i == 0 and j == 0:
            s, t = slice(p * LEAF, (p + 1) * LEAF), slice(q * LEAF, (q + 1) * LEAF)
            m, n = x.sizes[s, None], y.sizes[None, t]
            d, e = _missing(x.maps[s, None], y.maps[None, t]), _missing(y.maps[None, t], x.maps[s, None])
            ok = (a * m >= (a + b) * d + b * n) & (a * n >= (a + b) * e + b * m) & (x.groups[s, None] != y.groups[None, t])
            r, c = np.nonzero(ok)
            yield r + p * LEAF, c + q * LEAF
        elif i >= j:
            pairs += [(i - 1, k, j, q) for k in (2 * p, 2 * p + 1) if k < len(x.levels[i - 1][0])]
        else:
            pairs += [(i, p, j - 1, k) for k in (2 * q, 2 * q + 1) if k < len(y.levels[j - 1][0])]


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def may_link(m: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of sets, of sizes m and n with bitmaps a and b, can share enough."""
    return (100 * m >= (100 + percent) * _missing(a, b) + percent * n) & (100 * n >= (100 + percent) * _missing(b, a) + percent * m)


def _whole(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """The rows of a sorted partition with every group whole, and where groups start and end. A group has a bounded number of rows."""
    held = None
    for batch in batches:
        rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
        if rows.empty:
            continue
        starts = _starts(rows, keys)
        if len(starts) > 1:
            yield rows.iloc[: starts[-1]], starts
        held = rows.iloc[starts[-1] :]
    if held is not None:
        yield held, np.array([0, len(held)])


def _starts(rows: pd.DataFrame, keys: list[str]) -> np.ndarray:
    new = np.zeros(len(rows), dtype=bool)
    for key in keys:
        v = rows[key].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    new[0] = True
    return np.flatnonzero(new)


def small_pairs(edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The member pairs of all groups no larger than a leaf, which are trees of one node, in one step."""
    sizes = np.diff(edges)
    left, right = [], []
    for size in range(2, LEAF + 1):
        at = edges[:-1][sizes == size]
        if len(at):
            i, j = np.triu_indices(size, 1)
            left.append((at[:, None] + i).ravel())
            right.append((at[:, None] + j).ravel())
    none = [np.empty(0, np.int64)]
    return np.concatenate(left or none), np.concatenate(right or none)


def _token_order(texts: DataFrame, n: int) -> np.ndarray:
    """How many tokens fall in each of BUCKETS hash buckets: a summary of fixed size that puts frequent tokens last."""

    @lean_batches
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for text in batch["text"]:
                np.add.at(total, shingles(text, n) % BUCKETS, 1)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at, "n": total[at]})

    counted = texts.select("text").mapInPandas(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(BUCKETS, dtype=np.int64)
    out[counted["bucket"]] = counted["n"]
    return out


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the smallest node reachable) for the nodes of `edges`. In each round every edge offers its lesser label to both the node and
    the node's label, and then every label is replaced by its own label, so a chain takes rounds by the logarithm of its length. Every round is stored."""
    both = cut(edges.select(F.col(a).alias("node"), F.col(b).alias("other")).unionByName(edges.select(F.col(b).alias("node"), F.col(a).alias("other"))).distinct())
    labels = cut(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("component")))
    while True:
        theirs = labels.select(F.col("node").alias("other"), F.col("component").alias("offer"))
        offers = both.join(theirs, "other").join(labels, "node").where("offer < component")
        to = F.explode(F.array("node", "component"))
        least = offers.select(to.alias("node"), "offer").groupBy("node").agg(F.min("offer").alias("offer"))
        hooked = cut(labels.join(least, "node", "left").select("node", F.least("component", "offer").alias("component"), F.col("offer").isNotNull().alias("moved")))
        if hooked.where("moved").isEmpty():
            return labels
        tops = hooked.select(F.col("node").alias("component"), F.col("component").alias("top"))
        labels = cut(hooked.join(tops, "component").select("node", F.col("top").alias("component")))


def join(docs: DataFrame, percent: int = 90, n: int = N) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of `docs`.

    Rows link where 100 * shared >= percent * all of their shingles. Null and empty texts have no shingles and stay
    alone. Rows with equal sets, repeated rows among them, share a component; component_id is the smallest doc_id that
    is not null. Other columns are ignored.
    """

    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.unhex(F.sha2(text, 256)).alias("digest"))
    named = docs.select("doc_id", text.alias("text"), F.unhex(F.sha2(text, 256)).alias("digest"))
    each = named.groupBy("digest").agg(F.first("text").alias("text"), F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    # texts move once and are stored by digest, so that joins on it leave them where they are; numbers stand for digests after this
    stored = f"texts_{uuid.uuid4().hex}"
    each = each.withColumn("node", F.monotonically_increasing_id())
    at = f"{checkpoint_dir(spark)}/{stored}"
    each.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "digest").option("path", at).saveAsTable(stored)
    texts = spark.table(stored)
    weight = _token_order(texts, n)

    @F.pandas_udf("n long, map binary, wide binary, prefix array<long>")
    @lean
    def describe(batch: pd.Series) -> pd.DataFrame:
        def of(t):
            h = shingles(t, n)
            most = len(h) - -(-percent * len(h) // 100) + 1 if len(h) else 0
            return len(h), bitmap(h).tobytes(), bitmap(h, WIDE).tobytes(), h[np.lexsort((h, weight[h % BUCKETS]))[:most]]

        return pd.DataFrame([of(t) for t in batch], columns=["n", "map", "wide", "prefix"])

    described = texts.select("node", "digest", "least", "copies", describe("text").alias("d"))
    sets = cut(described.select("node", "digest", "least", "copies", "d.*"))
    tokens = sets.select("node", F.explode("prefix").alias("token"))
    shared = cut(tokens.groupBy("token").agg(F.count("*").alias("members")).where("members > 1"))
    met = cut(tokens.join(shared, "token"))

    # first every set once, in a block of one shared token: finds most links while whole sets are at hand
    home = met.groupBy("node").agg(F.max(F.struct("members", "token")).alias("home")).select("node", "home.*")
    salt = F.pmod(F.xxhash64("node"), F.ceil(F.col("members") / BLOCK))
    # stored, so that Spark knows its size: a small list of homes is broadcast, a large one joins by shuffle
    home = cut(home.select("node", "token", salt.alias("part")).join(sets.select("node", "digest", "n"), "node"))
    blocks = texts.select("digest", "text").join(home, "digest").drop("digest").repartition("token", "part")

    @lean_batches
    def inside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, edges in _whole(batches, ["token", "part"]):
            hs, sizes, names = [shingles(t, n) for t in rows["text"]], rows["n"].to_numpy(), rows["node"].to_numpy()
            maps, root = np.stack([bitmap(h) for h in hs]), np.arange(len(rows))

            def find(i: int) -> int:
                while root[i] != i:
                    root[i] = root[root[i]]
                    i = root[i]
                return i

            def connect(left: np.ndarray, right: np.ndarray) -> None:
                for i, j in zip(left.tolist(), right.tolist()):
                    if find(i) != find(j) and linked(hs[i], hs[j], percent):
                        root[max(find(i), find(j))] = min(find(i), find(j))

            i, j = small_pairs(edges)
            ok = may_link(sizes[i], sizes[j], maps[i], maps[j], percent)
            connect(i[ok], j[ok])
            for start, end in zip(edges[:-1], edges[1:]):
                if end - start > LEAF:
                    at = start + np.lexsort((names[start:end], sizes[start:end]))
                    tree = Tree(sizes[at], maps[at], np.arange(len(at)))
                    for left, right in walk(tree, tree, percent):
                        connect(at[left[left < right]], at[right[left < right]])
            tops = np.array([find(i) for i in range(len(hs))])
            at = np.flatnonzero(tops != np.arange(len(hs)))
            if len(at):
                yield pd.DataFrame({"a": names[tops[at]], "b": names[at]})

    first = cut(blocks.sortWithinPartitions("token", "part").mapInPandas(inside, "a long, b long"))
    known = components(first)

    # then across blocks, only where a token still meets two components
    members = cut(met.join(known, "node", "left").withColumn("component", F.coalesce("component", "node")))
    mixed = members.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("token")
    open_rows = cut(members.join(mixed, "token"))
    early = open_rows.groupBy("node").agg(F.slice(F.array_sort(F.collect_list("token")), 1, EARLY).alias("early"))
    signed = cut(sets.select("node", "n", "map").join(cut(early), "node"))
    parts = F.ceil(F.col("members") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("node"), parts).cast("int")
    spread = open_rows.join(signed, "node").withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    spread = spread.withColumn("lo", F.least("mine", "other")).withColumn("hi", F.greatest("mine", "other")).drop("members", "other")

    def across(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, edges in _whole(batches, ["token", "lo", "hi"]):
            names, comps, sizes, mine, token, early = (rows[c].to_numpy() for c in ("node", "component", "n", "mine", "token", "early"))
            maps = np.frombuffer(b"".join(rows["map"]), np.uint64).reshape(len(rows), -1)
            one = (rows["lo"] == rows["hi"]).to_numpy()
            before: dict[int, frozenset] = {}

            def earlier(i: int) -> frozenset:
                if i not in before:
                    before[i] = frozenset(t for t in early[i].tolist() if t < token[i])
                return before[i]

            def pairs(i: np.ndarray, j: np.ndarray) -> Iterator[pd.DataFrame]:
                # a pair that shares an earlier token was given there
                first = np.array([earlier(a).isdisjoint(earlier(b)) for a, b in zip(i.tolist(), j.tolist())], dtype=bool)
                i, j = i[first], j[first]
                if len(i):
                    swap = names[i] > names[j]
                    i, j = np.where(swap, j, i), np.where(swap, i, j)
                    yield pd.DataFrame({"a": names[i], "b": names[j], "ca": comps[i], "cb": comps[j]})

            i, j = small_pairs(edges)
            apart = (comps[i] != comps[j]) & (one[i] | (mine[i] != mine[j]))
            i, j = i[apart], j[apart]
            ok = may_link(sizes[i], sizes[j], maps[i], maps[j], percent)
            yield from pairs(i[ok], j[ok])
            for start, end in zip(edges[:-1], edges[1:]):
                if end - start > LEAF:
                    at = start + np.lexsort((names[start:end], sizes[start:end], comps[start:end]))
                    group = np.unique(comps[at], return_inverse=True)[1]
                    sides = [np.flatnonzero(mine[at] == side) for side in np.unique([rows["lo"].iloc[start], rows["hi"].iloc[start]])]
                    if all(len(s) for s in sides):
                        trees = [Tree(sizes[at[s]], maps[at[s]], group[s]) for s in sides]
                        for left, right in walk(trees[0], trees[-1], percent):
                            i, j = at[sides[0][left]], at[sides[-1][right]]
                            keep = (names[i] < names[j]) if len(sides) == 1 else np.ones(len(i), bool)
                            yield from pairs(i[keep], j[keep])

    keys = ["token", "lo", "hi"]
    pairs = spread.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(across, "a long, b long, ca long, cb long")
    pairs = cut(pairs.distinct())

    @F.pandas_udf("boolean")
    @lean
    def alike(m: pd.Series, n: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        maps = [np.frombuffer(b"".join(x), np.uint64).reshape(len(x), WIDE // 64) for x in (a, b)]
        return pd.Series(may_link(m.to_numpy(), n.to_numpy(), *maps, percent), dtype=bool)

    for k in "ab":
        pairs = pairs.join(sets.select(F.col("node").alias(k), F.col("n").alias(f"n_{k}"), F.col("wide").alias(f"wide_{k}")), k)
    pairs = cut(pairs.where(alike("n_a", "n_b", "wide_a", "wide_b")).select("a", "b", "ca", "cb"))
    left, right = (texts.select(F.col("node").alias(k), F.col("text").alias(f"text_{k}")) for k in "ab")

    @F.pandas_udf("boolean")
    @lean
    def link(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([linked(shingles(x, n), shingles(y, n), percent) for x, y in zip(a, b)], dtype=bool)

    second = pairs.join(left, "a").join(right, "b").where(link("text_a", "text_b")).select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    merged = components(cut(second.distinct())).select(F.col("node").alias("component"), F.col("component").alias("top"))
    found = known.join(merged, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    alone = merged.join(known.select(F.col("node").alias("component")), "component", "left_anti").select(F.col("component").alias("node"), F.col("top").alias("component"))
    classes = sets.select("digest", "node", "n", "least", "copies").join(found.unionByName(alone), "node", "left")
    classes = cut(classes.withColumn("component", F.coalesce("component", "node")))
    spark.sql(f"DROP TABLE {stored}")
    tops = classes.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    counted = attach(classes, cut(tops), "component", "members").select("digest", "n", "copies", "component_id")
    together = attach(rows, cut(counted), "digest", "copies")
    # without words a row is linked with nothing, not even with its copies
    alone_id = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return together.select("doc_id", F.col("n").alias("n_shingles"), alone_id.alias("component_id"))
