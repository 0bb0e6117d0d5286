"""Exact top-k by inner product, by best-first search of M-trees.

A query stays at height 0 and each vector x is lifted to height sqrt(M^2 - |x|^2), M being the greatest norm. Then the squared distance of query and
vector is |q|^2 + M^2 - 2 q.x, so the nearest are those of highest inner product, and it comes from whole numbers exactly.
Vectors are dealt to regions by their nearest pivot, regions to shards of bounded size; each shard is one M-tree, stored as a table of pages. Every entry
of a page has its distance to the page's routing object, so most distances need not be computed: by the triangle inequality
the stored number already shows the entry to be too far.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonewheel.functions.lineage import cut

PAGE = 128
FAN = 32
SHARD = 16_384
PIVOTS = 256
#: Pivots come from at most so many vectors; whatever they are, results are exact.
SAMPLE = 4_096
#: Queries searched one after another over one shard.
TOGETHER = 16_384
#: A norm above this leaves inner products no room in 64 bits.
LONGEST = 2.0**58
PAGES = "page int, leaf boolean, center binary, vectors binary, to_parent binary, radius binary, children binary, ids binary, ends binary"
KEY = ["dim", "region", "shard"]


def whole_vectors(rows: DataFrame, id_col: str, vector: str, scale: int) -> DataFrame:
    """id, v, norm: each usable vector in whole numbers. Rows without an id or vector, with a null or non-finite component, or
    whose squared norm in whole numbers exceeds LONGEST, take no part; rows equal in id and vector count once."""
    usable = F.col(id_col).isNotNull() & F.col(vector).isNotNull()
    number = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    some = rows.where(usable).where(number).select(F.col(id_col).cast("long").alias("id"), F.transform(vector, lambda x: x.cast("double") * scale).alias("d"))
    fit = F.aggregate("d", F.lit(0.0), lambda s, x: s + x * x) + F.size("d") < LONGEST
    whole = some.where(fit).select("id", F.transform("d", lambda x: F.floor(x)).alias("v")).distinct()
    return whole.withColumn("norm", F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x * x))


class Space:
    """Distances of lifted vectors; `top` is the greatest squared norm."""

    def __init__(self, top: int):
        self.top = top
        # squared distances err by a few units in the last place of top, so near zero distances err by about its root
        self.slack = 1e-6 * (1.0 + float(top) ** 0.5)

    def between(self, one: np.ndarray, many: np.ndarray) -> np.ndarray:
        heights = [np.sqrt(np.maximum(self.top - (v * v).sum(axis=-1), 0).astype(float)) for v in (one, many)]
        return np.sqrt(np.maximum(2.0 * self.top - 2.0 * (many @ one) - 2.0 * heights[0] * heights[1], 0.0))

    def from_query(self, norm: int, scores: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(norm + self.top - 2 * scores, 0).astype(float))


def spread_out(some: np.ndarray, count: int, space: Space) -> np.ndarray:
    """`count` of `some`, each next one farthest from those before it."""
    chosen = [0]
    near = space.between(some[0], some)
    while len(chosen) < min(count, len(some)):
        chosen.append(int(near.argmax()))
        near = np.minimum(near, space.between(some[chosen[-1]], some))
    return some[chosen]


def _nearest(pivots: np.ndarray, some: np.ndarray, space: Space) -> tuple[np.ndarray, np.ndarray]:
    far = np.stack([space.between(p, some) for p in pivots])
    at = far.argmin(axis=0)
    return at, far[at, np.arange(len(some))]


def pages(v: np.ndarray, ids: list[np.ndarray], space: Space, size: int) -> pd.DataFrame:
    """The M-tree over `v` as pages of up to `size` entries, page 0 the root, whose routing object is its first vector. `ids` are those of each vector."""
    out, number = [], itertools.count()

    def settle(rows: np.ndarray, center: np.ndarray) -> tuple[int, float]:
        """Writes the page that holds `rows` about `center`; its number and covering radius."""
        page = next(number)
        away = space.between(center, v[rows])
        if len(rows) <= size:
            held = [ids[r] for r in rows]
            out.append((page, True, center.tobytes(), v[rows].tobytes(), away.tobytes(), b"", b"", np.concatenate(held).tobytes(),
                        np.cumsum([len(h) for h in held]).tobytes()))
            return page, float(away.max())
        centers = v[rows[:: -(-len(rows) // min(FAN, -(-2 * len(rows) // size)))]]
        owner, _ = _nearest(centers, v[rows], space)
        if (owner == owner[0]).all():
            # too close together to be told apart: any halves will do
            owner = np.arange(len(rows)) * 2 // len(rows)
            centers = v[rows[[0, len(rows) - 1]]]
        kept = np.unique(owner)
        below = [settle(rows[owner == c], centers[c]) for c in kept]
        routing = centers[kept]
        out.append((page, False, center.tobytes(), routing.tobytes(), space.between(center, routing).tobytes(),
                    np.array([r for _, r in below]).tobytes(), np.array([c for c, _ in below], dtype=np.int64).tobytes(), b"", b""))
        return page, float(away.max())

    settle(np.arange(len(v)), v[0])
    return pd.DataFrame(out, columns=[c.split()[0] for c in PAGES.split(", ")])


class Tree:
    """Pages read back, searched best first."""

    def __init__(self, rows: pd.DataFrame, dim: int, space: Space):
        self.space, self.pages, self.computed = space, {}, 0
        for r in rows.itertuples():
            v = np.frombuffer(r.vectors, np.int64)
            away = np.frombuffer(r.to_parent)
            rest = (np.frombuffer(r.ids, np.int64), np.concatenate([[0], np.frombuffer(r.ends, np.int64)])) if r.leaf else (
                np.frombuffer(r.children, np.int64), np.frombuffer(r.radius))
            self.pages[r.page] = (r.leaf, v.reshape(len(away), dim), away, *rest)
            if r.page == 0:
                self.center = np.frombuffer(r.center, np.int64)

    def search(self, own: int, q: np.ndarray, k: int, least: int | None) -> list[tuple[int, int]]:
        """The k best (score, id) of ids other than `own`, ties to smaller ids; only scores of at least `least`."""
        norm, best, order = int((q * q).sum()), [], itertools.count()

        def reach() -> float:
            """No vector farther than this can still be among the k best."""
            known = [s for s in (least, -best[k - 1][0] if len(best) >= k else None) if s is not None]
            return float(self.space.from_query(norm, np.array(max(known)))) + self.space.slack if known else np.inf

        limit = reach()
        queue = [(0.0, next(order), 0, float(self.space.from_query(norm, np.array(int(self.center @ q)))))]
        while queue:
            bound, _, page, away = heapq.heappop(queue)
            if bound > limit:
                break
            leaf, v, to_parent, more, rest = self.pages[page]
            radius = 0.0 if leaf else rest
            open_ = np.flatnonzero(np.abs(away - to_parent) - radius <= limit + self.space.slack)
            self.computed += len(open_)
            scores = v[open_] @ q
            far = self.space.from_query(norm, scores)
            if leaf:
                for i in np.flatnonzero(far <= limit):
                    s, e = int(scores[i]), int(open_[i])
                    best += [(-s, int(x)) for x in more[rest[e] : rest[e + 1]] if x != own and (least is None or s >= least)]
                best = sorted(best)[:k]
                limit = reach()
            else:
                low = far - radius[open_] - self.space.slack
                for i in np.flatnonzero(low <= limit):
                    heapq.heappush(queue, (max(bound, float(low[i])), next(order), int(more[open_[i]]), float(far[i])))
        return [(-s, i) for s, i in best]


def _shards(batches: Iterator[pd.DataFrame], key: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Consecutive rows of one key, in pieces as they come."""
    for batch in batches:
        names = list(zip(*(batch[c] for c in key)))
        at = 0
        for name, group in itertools.groupby(names):
            n = len(list(group))
            yield name, batch.iloc[at : at + n]
            at += n


class Index:
    """`tree`: the stored pages of every shard; `regions`: a row per region with its shards and covering radius, at most
    SAMPLE rows; `pivots`: the regions' routing objects by dimension."""

    def __init__(self, entries: DataFrame, k: int, shard: int, page: int):
        self.k = k
        counted = entries.agg(F.count("*").alias("n"), F.coalesce(F.max("norm"), F.lit(0)).alias("top")).first()
        space = self.space = Space(counted.top)
        sample: dict[int, list] = {}
        for r in entries.select("v").orderBy(F.xxhash64("v"), "v").limit(SAMPLE).collect():
            sample.setdefault(len(r.v), []).append(r.v)
        count = min(PIVOTS, -(-counted.n // shard))
        pivots = self.pivots = {d: spread_out(np.array(vs, dtype=np.int64).reshape(len(vs), d), count, space) for d, vs in sample.items()}

        @F.pandas_udf("region int, away double")
        def assign(v: pd.Series) -> pd.DataFrame:
            out = np.zeros((len(v), 2))
            dims = v.map(len).to_numpy()
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                if d in pivots:
                    out[at, 0], out[at, 1] = _nearest(pivots[d], np.stack(v.to_numpy()[at]).astype(np.int64).reshape(len(at), d), space)
                else:
                    out[at, 1] = np.inf
            return pd.DataFrame({"region": out[:, 0].astype(np.int32), "away": out[:, 1]})

        dealt = cut(entries.select(F.size("v").alias("dim"), "v", "ids", assign("v").alias("a")).select("dim", "v", "ids", "a.*"))
        regions = dealt.groupBy("dim", "region").agg(F.count("*").alias("n"), F.max("away").alias("radius"))
        self.regions = cut(regions.withColumn("shards", F.ceil(F.col("n") / shard).cast("int")))
        placed = dealt.join(self.regions.select("dim", "region", "shards"), ["dim", "region"])
        placed = placed.withColumn("shard", F.pmod(F.xxhash64("v"), F.col("shards")).cast("int")).select(*KEY, "v", "ids")

        def grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for name, pieces in itertools.groupby(_shards(batches, KEY), key=lambda p: p[0]):
                rows = pd.concat([p for _, p in pieces])
                v = np.stack(rows["v"].to_numpy()).astype(np.int64).reshape(len(rows), name[0])
                out = pages(v, [np.asarray(i, dtype=np.int64) for i in rows["ids"]], space, page)
                yield out.assign(dim=name[0], region=name[1], shard=name[2])[[*KEY, *out.columns]]

        placed = placed.repartition(*KEY).sortWithinPartitions(*KEY, "v")
        self.tree = cut(placed.mapInPandas(grow, f"dim int, region int, shard int, {PAGES}"))

    def search(self, queries: DataFrame, targets: DataFrame) -> DataFrame:
        """q, query_id, score, id: the best of each shard that `targets` (q, dim, region, shard) names for the rows of
        `queries` (q, query_id, v, least)."""
        space, k = self.space, self.k
        parts = -(-queries.count() // TOGETHER)
        asked = targets.join(queries, "q").withColumn("part", F.pmod(F.xxhash64("q"), F.lit(max(parts, 1))).cast("int"))
        wanted = asked.select(*KEY, "part").distinct()
        tree = self.tree.join(wanted, KEY)
        both = tree.unionByName(asked, allowMissingColumns=True).withColumn("asks", F.col("q").isNotNull())
        both = both.repartition(*KEY, "part").sortWithinPartitions(*KEY, "part", "asks", "page", "q")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for name, pieces in itertools.groupby(_shards(batches, [*KEY, "part"]), key=lambda p: p[0]):
                held, tree = [], None
                for _, piece in pieces:
                    held.append(piece[~piece["asks"]])
                    found = []
                    for r in piece[piece["asks"]].itertuples():
                        if tree is None:
                            tree = Tree(pd.concat(held), name[0], space)
                        least = None if r.least is None else int(r.least)
                        q = np.asarray(r.v, dtype=np.int64)
                        found += [(int(r.q), int(r.query_id), s, i) for s, i in tree.search(int(r.query_id), q, k, least)]
                    if found:
                        yield pd.DataFrame(found, columns=["q", "query_id", "score", "id"])

        # numbers that may be null travel as text, which keeps all their digits in pandas
        shown = both.withColumn("q", F.col("q").cast("string")).withColumn("query_id", F.col("query_id").cast("string"))
        shown = shown.withColumn("least", F.col("least").cast("string"))
        return shown.mapInPandas(run, "q long, query_id long, score long, id long")

    def homes(self, queries: DataFrame) -> DataFrame:
        """For each query one shard of the region of its nearest pivot."""
        return self._targets(queries, home=True)

    def open_shards(self, queries: DataFrame) -> DataFrame:
        """For each query all shards of the regions that may hold a score of at least its `least`."""
        return self._targets(queries, home=False)

    def _targets(self, queries: DataFrame, home: bool) -> DataFrame:
        space, pivots = self.space, self.pivots
        radii = {(r.dim, r.region): r.radius for r in self.regions.select("dim", "region", "radius").collect()}

        def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = []
                for r in batch.itertuples():
                    d = len(r.v)
                    q = np.asarray(r.v, dtype=np.int64)
                    if d not in pivots:
                        out.append((int(r.q), d, 0))
                        continue
                    norm = int((q * q).sum())
                    far = space.from_query(norm, pivots[d] @ q)
                    regions = [i for i in range(len(far)) if (d, i) in radii]
                    if home:
                        regions = sorted(regions, key=lambda i: far[i])[:1]
                    elif r.least is not None:
                        limit = float(space.from_query(norm, np.array(int(r.least)))) + 2 * space.slack
                        regions = [i for i in regions if far[i] - radii[d, i] <= limit]
                    out += [(int(r.q), d, i) for i in regions]
                yield pd.DataFrame(out, columns=["q", "dim", "region"])

        chosen = queries.select("q", "v", F.col("least").cast("string").alias("least")).mapInPandas(choose, "q long, dim int, region int")
        chosen = chosen.join(self.regions.select("dim", "region", "shards"), ["dim", "region"])
        one = F.array(F.pmod(F.xxhash64("q"), F.col("shards")).cast("int"))
        shards = one if home else F.sequence(F.lit(0), F.col("shards") - 1)
        return chosen.select("q", "dim", "region", F.explode(shards).alias("shard"))


def top_k(rows: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, id_col: str = "vec_id", vector: str = "embedding",
          shard: int = SHARD, page: int = PAGE) -> DataFrame:
    """query_id, rank, vec_id, score: for each vector whose id is divisible by `every`, the k other rows of highest inner product
    in whole numbers floor(scale * x), ties to the smaller id; all, if fewer.

    See `whole_vectors` for what takes no part. A query never meets rows with its own id. Only vectors of one length are compared. An id with several different vectors
    stands for each of them, as a candidate and as a query with results of its own. Other columns are ignored.
    """
    whole = cut(whole_vectors(rows, id_col, vector, scale))
    # of copies, only the k + 1 smallest ids can be in a result; the limit is applied before rows move
    nth = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    few = whole.withColumn("nth", nth).where(F.col("nth") <= k + 1)
    entries = cut(few.groupBy("v", "norm").agg(F.array_sort(F.collect_list("id")).alias("ids")))
    index = Index(entries, k, shard, page)
    asked = whole.where(F.col("id") % every == 0).select(F.monotonically_increasing_id().alias("q"), F.col("id").alias("query_id"), "v")
    asked = cut(asked.withColumn("least", F.lit(None).cast("long")))
    best = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    first = index.search(asked, index.homes(asked)).withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k)
    known = cut(asked.drop("least").join(first.select("q", F.col("score").alias("least")), "q", "left"))
    found = index.search(known, index.open_shards(known)).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


ORACLE = """
WITH whole AS (
  SELECT vec_id, CAST(list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS DOUBLE[]) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
