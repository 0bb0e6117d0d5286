"""Ranked lexical search over posting lists in geometric blocks.

Documents lie in chunks of similar ones. Within a chunk the posting list of every wanted term is clustered: each of its documents joins the most
similar of some members of the list, and the block so formed keeps the greatest impact of any member for every term that shares a query
with the list's own. A query's weights applied to these maxima bound the score of all members exactly from above. Blocks of highest bound are
scored first, which gives each query a score that its k-th best result reaches; then every block whose bound reaches it is scored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonewheel.functions.lineage import cut

#: In UTF-8: letters A-Z become small, every other byte outside terms becomes a space. Bytes of characters beyond ASCII are terms.
PLAIN = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()
#: A bit for each bucket of term hashes: what the queries need of a text, in a fixed size.
BUCKETS = 1 << 20
CHUNK = 1024
BLOCK = 64
#: Queries searched together over one chunk.
TOGETHER = 512
#: Cells of the table of documents by terms that a task fills at once.
CELLS = 1 << 23
WORDS_KEPT = 100_000


class _Hashes(dict):
    """The 64-bit hash of each term, kept for short terms up to a fixed number; 0 for terms outside the wanted buckets."""

    def __init__(self, wanted: np.ndarray | None = None):
        super().__init__()
        self.wanted = wanted

    def __missing__(self, term: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(term)
        value -= 1 << 64 if value >> 63 else 0
        if self.wanted is not None and not self.wanted[value % BUCKETS]:
            value = 0
        if len(term) <= 64:
            if len(self) >= WORDS_KEPT:
                self.clear()
            self[term] = value
        return value


def terms(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(PLAIN).split() if text else []


def counted(rows: DataFrame, id_col: str, wanted: np.ndarray | None) -> DataFrame:
    """id, n, terms, counts, signature of each row: the number of all its terms, hashes and counts of the wanted ones, and a hash that
    similar rows share for the greater part."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes(wanted)
        for batch in batches:
            # one text at a time, so that a batch of long ones is held once only
            for start in range(0, batch.num_rows, 500):
                part, out = batch.slice(start, 500), []
                for text in part.column(1):
                    words = terms(text.as_py())
                    found = {h: c for w, c in Counter(words).items() if (h := known[w])}
                    h = np.fromiter(found, np.int64, len(found))
                    c = np.fromiter(found.values(), np.int32, len(found))
                    out.append((len(words), h, c, similar(h, c)))
                n, h, c, signature = zip(*out)
                ends = pa.array(np.cumsum([0] + [len(x) for x in h]), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x))) for x in (h, c)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), *lists, pa.array(signature, pa.int64())],
                                                 names=["id", "n", "terms", "counts", "signature"])

    shown = rows.select(F.col(id_col).cast("long").alias("id"), "text")
    return shown.mapInArrow(count, "id long, n long, terms array<long>, counts array<int>, signature long")


def similar(h: np.ndarray, counts: np.ndarray) -> int:
    """64 signs of a sum over terms, each adding or taking its count at every bit of its hash."""
    bits = np.unpackbits(h.view(np.uint8).reshape(len(h), 8), axis=1).astype(np.int64)
    signs = (counts[:, None].astype(np.int64) * (2 * bits - 1)).sum(axis=0) > 0
    return int(np.packbits(signs).view(">i8")[0])


def _ends(lists: list) -> bytes:
    return np.cumsum([len(x) for x in lists], dtype=np.int64).tobytes()


def _all(lists: list, dtype) -> bytes:
    return np.concatenate([np.asarray(x, dtype=dtype).ravel() for x in lists] or [np.empty(0, dtype)]).astype(dtype).tobytes()


def _parts(values, ends, dtype) -> list[np.ndarray]:
    return np.split(np.frombuffer(values, dtype), np.frombuffer(ends, np.int64)[:-1])


def chunks(docs: DataFrame, total: int, length: int, chunk: int) -> DataFrame:
    """Rows of up to `chunk` similar documents each: ids, which of them are known, length norms, terms and counts."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def row(held: pd.DataFrame) -> pd.DataFrame:
            ids = [None if i is None else int(i) for i in held["id"]]
            norms = 75 + 25 * held["n"].to_numpy(np.int64) * total // length
            return pd.DataFrame([(np.array([i or 0 for i in ids], np.int64).tobytes(), np.array([i is not None for i in ids]).tobytes(),
                                  norms.tobytes(), _all(list(held["terms"]), np.int64), _all(list(held["counts"]), np.int32),
                                  _ends(list(held["terms"])))], columns=["ids", "known", "norms", "terms", "counts", "ends"])

        held = None
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch])
            while len(held) >= chunk:
                yield row(held.iloc[:chunk])
                held = held.iloc[chunk:]
        if held is not None and len(held):
            yield row(held)

    some = docs.where(F.size("terms") > 0).withColumn("salt", F.xxhash64("id", "n", "terms"))
    some = some.repartitionByRange("signature", "salt").sortWithinPartitions("signature", "salt")
    schema = "ids binary, known binary, norms binary, terms binary, counts binary, ends binary"
    return some.select(F.col("id").cast("string"), "n", "terms", "counts").mapInPandas(pack, schema)


class Queries:
    """A block of queries: for each its number, its terms as columns of a table and what an impact of 1 in each adds. Columns are numbered
    as queries first name their terms, so that those of one query lie together."""

    def __init__(self, items: bytes, item_ends: bytes, item_terms: bytes, item_weights: bytes):
        self.items = np.frombuffer(items, np.int64)
        self.hashes, first = np.unique(np.frombuffer(item_terms, np.int64), return_index=True)
        self.width = len(self.hashes)
        self.column_of = np.argsort(np.argsort(first))
        # each query's columns in rising order, its weights with them
        self.columns = [self.columns_of(t)[1] for t in _parts(item_terms, item_ends, np.int64)]
        self.weights = [w[np.argsort(c)] for c, w in zip(self.columns, _parts(item_weights, item_ends, np.int64))]
        self.columns = [np.sort(c) for c in self.columns]
        self.holders = defaultdict(list)
        for i, columns in enumerate(self.columns):
            for c in columns.tolist():
                self.holders[c].append(i)
        # terms that share a query with a term, itself included
        self.beside = {c: np.unique(np.concatenate([self.columns[i] for i in own])) for c, own in self.holders.items()}

    def columns_of(self, terms_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are terms of the queries, and the columns of these."""
        place = np.minimum(np.searchsorted(self.hashes, terms_), self.width - 1)
        mine = self.hashes[place] == terms_
        return mine, self.column_of[place[mine]]


def blocked(table: np.ndarray, queries: Queries, size: int) -> tuple:
    """Posting lists of a table of documents by terms, as blocks of about `size` documents: the term, the documents and the maxima of each block."""
    of, members, maxima = [], [], []
    columns, postings = np.nonzero(table.T)
    ends = np.searchsorted(columns, np.arange(queries.width + 1))
    for c, beside in queries.beside.items():
        rows = postings[ends[c] : ends[c + 1]]
        if not len(rows):
            continue
        part = table.take(rows[:, None] * table.shape[1] + beside)
        if len(rows) <= size:
            of.append(c)
            members.append(rows)
            maxima.append(part.max(axis=0))
            continue
        centers = part[::size].astype(np.float32)
        centers /= np.linalg.norm(centers, axis=1, keepdims=True)
        owner = (part.astype(np.float32) @ centers.T).argmax(axis=1)
        order = np.argsort(owner, kind="stable")
        starts = np.flatnonzero(np.diff(owner[order], prepend=-1))
        of += [c] * len(starts)
        members += np.split(rows[order], starts[1:])
        maxima += list(np.maximum.reduceat(part[order], starts, axis=0))
    return np.array(of, np.int64), members, maxima


def bounds(queries: Queries, of: np.ndarray, maxima: list[np.ndarray]) -> dict[int, list[tuple[int, int]]]:
    """For each query the blocks of its terms, each with the score that no member exceeds."""
    out = defaultdict(list)
    order = np.argsort(of, kind="stable")
    of = of[order]
    at = np.searchsorted(of, np.arange(queries.width + 1))
    for c, own in queries.holders.items():
        mine = order[at[c] : at[c + 1]]
        if not len(mine):
            continue
        tops = np.stack([maxima[b] for b in mine]).astype(np.int64)
        for i in own:
            reach = tops[:, np.searchsorted(queries.beside[c], queries.columns[i])] @ queries.weights[i]
            out[i] += zip(reach.tolist(), mine.tolist())
    return out


def best_of(table: np.ndarray, rows: np.ndarray, queries: Queries, i: int) -> np.ndarray:
    return table[np.ix_(rows, queries.columns[i])].astype(np.int64) @ queries.weights[i]


#: Schema of the stored index, for Spark and for its tasks: a chunk's arrays, compressed one after another, and how many bytes each has.
INDEX = "block int, chunk binary, sizes array<long>, hits array<struct<item: long, score: long>>"
ARROW_INDEX = pa.schema([("block", pa.int32()), ("chunk", pa.binary()), ("sizes", pa.list_(pa.int64())),
                         ("hits", pa.list_(pa.struct([("item", pa.int64()), ("score", pa.int64())])))])
#: A chunk's documents, their impacts by document and column, and its blocks.
FIELDS = {"ids": np.int64, "known": bool, "places": np.int32, "columns": np.int32, "impacts": np.int32, "of": np.int32, "members": np.int32,
          "member_ends": np.int64, "maxima": np.int32, "maxima_ends": np.int64}


def _stored(arrays: dict[str, np.ndarray]) -> tuple[bytes, list[int]]:
    parts = [np.asarray(arrays[name], dtype=kind).tobytes() for name, kind in FIELDS.items()]
    return pa.Codec("zstd", 1).compress(b"".join(parts), asbytes=True), [len(p) for p in parts]


def _loaded(row: dict) -> dict[str, np.ndarray]:
    whole = pa.Codec("zstd").decompress(row["chunk"], decompressed_size=sum(row["sizes"]))
    starts = np.cumsum([0, *row["sizes"]])
    return {name: np.frombuffer(whole, kind, count=size // np.dtype(kind).itemsize, offset=start)
            for (name, kind), size, start in zip(FIELDS.items(), row["sizes"], starts.tolist())}


def _read(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch, numbers as they are and binary values as buffers into the batch."""
    for i in range(batch.num_rows):
        yield {name: column[i].as_buffer() if pa.types.is_binary(column.type) else column[i].as_py()
               for name, column in zip(batch.schema.names, batch.columns)}


def _queries(row: dict) -> Queries:
    return Queries(*(row[c] for c in ("items", "item_ends", "item_terms", "item_weights")))


def index(packed: DataFrame, asked: DataFrame, blocks: int, k: int, size: int) -> DataFrame:
    """The posting blocks of every chunk for every block of queries, and `hits`: the k best scores each query finds in its blocks of
    highest bound."""
    pairs = packed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(asked, "block")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, number = None, None
        for batch in batches:
            for r in _read(batch):
                if r["block"] != number:
                    queries, number = _queries(r), r["block"]
                for row in _indexed(r, queries, k, size):
                    yield pa.RecordBatch.from_pylist([row], schema=ARROW_INDEX)

    return pairs.mapInArrow(build, INDEX)


def _indexed(r: dict, queries: Queries, k: int, size: int) -> Iterator[dict]:
    width = queries.width
    step = max(1, CELLS // width)
    terms_, ends = np.frombuffer(r["terms"], np.int64), np.frombuffer(r["ends"], np.int64)
    counts, norms = np.frombuffer(r["counts"], np.int32), np.frombuffer(r["norms"], np.int64)
    owner = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    mine, place = queries.columns_of(terms_)
    owner, tf = owner[mine], counts[mine].astype(np.int64)
    impact = 1_000_000_000 * tf // (1000 * tf + 12 * norms[owner])
    ids, known = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["known"], bool)
    for start in range(0, len(ids), step):
        s = slice(*np.searchsorted(owner, [start, start + step]))
        n = min(step, len(ids) - start)
        table = np.zeros((n, width), np.int32)
        table[owner[s] - start, place[s]] = impact[s]
        of, members, maxima = blocked(table, queries, size)
        hits = []
        for i, found in bounds(queries, of, maxima).items():
            rows = np.empty(0, np.int64)
            for _, b in sorted(found, reverse=True):
                rows = np.union1d(rows, members[b])
                if len(rows) >= k:
                    break
            scores = np.sort(best_of(table, rows, queries, i))[::-1][:k]
            hits += [{"item": int(queries.items[i]), "score": int(x)} for x in scores if x > 0]
        chunk, sizes = _stored({
            "ids": ids[start : start + n], "known": known[start : start + n], "places": owner[s] - start, "columns": place[s], "impacts": impact[s],
            "of": of, "members": np.concatenate(members) if members else [], "member_ends": np.cumsum([len(m) for m in members]),
            "maxima": np.concatenate(maxima) if maxima else [], "maxima_ends": np.cumsum([len(m) for m in maxima]),
        })
        yield {"block": r["block"], "chunk": chunk, "sizes": sizes, "hits": hits}


def scan(stored: DataFrame, asked: DataFrame, thresholds: DataFrame, k: int) -> DataFrame:
    """item, id, score: the k best of each chunk for each query. A document is scored unless one of its blocks stays below the
    query's threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, number = None, None
        for batch in batches:
            for r in _read(batch):
                if r["block"] != number:
                    queries, number = _queries(r), r["block"]
                found = _scanned(r, queries, k)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["item", "id", "score"])

    met = stored.drop("hits").join(asked, "block").join(thresholds, "block", "left")
    return met.mapInArrow(run, "item long, id long, score long")


def _scanned(r: dict, queries: Queries, k: int) -> list[tuple]:
    least = {x["item"]: x["score"] for x in r["least"] or []}
    chunk = _loaded(r)
    ids, known = chunk["ids"], chunk["known"]
    table = np.zeros((len(ids), queries.width), np.int32)
    table[chunk["places"], chunk["columns"]] = chunk["impacts"]
    members, maxima = np.split(chunk["members"], chunk["member_ends"][:-1]), np.split(chunk["maxima"], chunk["maxima_ends"][:-1])
    out = []
    for i, found in bounds(queries, chunk["of"], maxima).items():
        item = int(queries.items[i])
        floor = max(least.get(item, 1), 1)
        passed, failed = np.zeros(len(ids), bool), np.zeros(len(ids), bool)
        for reach, b in found:
            (passed if reach >= floor else failed)[members[b]] = True
        rows = np.flatnonzero(passed & ~failed)
        scores = best_of(table, rows, queries, i)
        rows, scores = rows[scores >= floor], scores[scores >= floor]
        first = np.lexsort((ids[rows], ~known[rows], -scores))[:k]
        out += [(item, int(ids[d]) if known[d] else None, int(s)) for d, s in zip(rows[first], scores[first])]
    return out


def search(docs: DataFrame, items: DataFrame, k: int = 20, chunk: int = CHUNK, size: int = BLOCK, together: int = TOGETHER) -> DataFrame:
    """item_id, rank, doc_id, score: for each row of `items` the k rows of `docs` with the highest score above 0, equal scores by doc_id.

    The score is that of the contract: floor(1000 ln((2N+2)/(2df+1))) for each term of the query times a share of its count in the document, damped by
    the document's length. Null and empty texts have no terms: such a document is not counted, such a query has no rows. Repeated documents count and rank
    apart, one without a doc_id last among equals. Items equal in id and text count once; different texts under one id each have their own ranks. Equality
    of terms is equality of 64-bit hashes (odds near 1e-19 a pair). Other columns are ignored.
    """
    spark = docs.sparkSession
    kept = items.select("item_id", "text").distinct()
    queries = cut(counted(kept, "item_id", None).where(F.size("terms") > 0).withColumn("item", F.monotonically_increasing_id()))
    each = queries.select("item", F.explode(F.arrays_zip("terms", "counts")).alias("t")).select("item", F.col("t.terms").alias("term"), F.col("t.counts").alias("c"))
    wanted = np.zeros(BUCKETS, dtype=bool)
    buckets = each.select(F.pmod("term", F.lit(BUCKETS)).alias("b")).distinct().toPandas()["b"].to_numpy(dtype=np.int64)
    wanted[buckets] = True
    rows = cut(counted(docs, "doc_id", wanted))
    totals = rows.agg(F.count(F.when(F.col("n") > 0, 1)).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()
    held = rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * totals.n + 2) / (2.0 * F.col("df") + 1)))
    weighted = each.join(held, "term").withColumn("weight", weight * F.col("c"))
    count = queries.count()
    blocks = max(1, -(-count // together))
    weighted = weighted.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int"))

    def pack(key: tuple[Any, ...], rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["item", "term"])
        items_, starts = np.unique(rows["item"].to_numpy(), return_index=True)
        ends = np.append(starts[1:], len(rows)).astype(np.int64)
        return pd.DataFrame([(key[0], items_.tobytes(), ends.tobytes(), rows["term"].to_numpy(np.int64).tobytes(), rows["weight"].to_numpy(np.int64).tobytes())],
                            columns=["block", "items", "item_ends", "item_terms", "item_weights"])

    asked = cut(weighted.select("block", "item", "term", "weight").groupBy("block").applyInPandas(
        pack, "block int, items binary, item_ends binary, item_terms binary, item_weights binary"))
    stored = cut(index(cut(chunks(rows, totals.n, max(totals.l, 1), chunk)), asked, blocks, k, size))
    hits = stored.select("block", F.explode("hits").alias("h")).select("block", "h.*")
    kth = hits.withColumn("nth", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score")))).where(F.col("nth") == k)
    thresholds = kth.groupBy("block").agg(F.collect_list(F.struct("item", "score")).alias("least"))
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    found = scan(stored, asked, cut(thresholds), k).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    named = found.join(queries.select("item", F.col("id").alias("item_id")), "item")
    return named.select("item_id", "rank", F.col("id").alias("doc_id"), "score")


ORACLE = r"""
WITH words AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents WHERE text IS NOT NULL
),
totals AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM words WHERE len(w) > 0),
counts AS (SELECT r, doc_id, len(w) AS n, term, count(*) AS tf FROM (SELECT r, doc_id, w, unnest(w) AS term FROM words) GROUP BY ALL),
held AS (SELECT term, count(*) AS df FROM counts GROUP BY term),
asked AS (
  SELECT item_id, term, count(*) AS c FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT DISTINCT item_id, text FROM benchmark) WHERE text IS NOT NULL) GROUP BY ALL
),
impacts AS (
  SELECT r, doc_id, counts.term, CAST(floor(1000 * ln((2.0 * n_docs + 2) / (2.0 * df + 1))) AS BIGINT)
    * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))) AS impact
  FROM counts JOIN held USING (term), totals
),
scored AS (
  SELECT item_id, r, doc_id, CAST(sum(c * impact) AS BIGINT) AS score FROM asked JOIN impacts USING (term) GROUP BY ALL
),
ranked AS (
  SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank
  FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""
