"""Nearest neighbours by inner product over randomly rotated one-bit codes.

A vector is its norm times a direction; the direction, randomly rotated, keeps its signs packed in 64-bit words and one
correction scalar, its inner product with its own code. From a query and a code an unbiased estimate of the inner product and
a bound of its error follow. The vectors whose upper bound reaches the k-th best exact score so far are reranked on the original
vectors in double precision. Queries are a stated set; they meet all rows in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.llm.common import materialised, table

K, EVERY, SEED = 20, 20, 20240521
#: Rows of one block of the index and of one block of queries.
BLOCK, QUERY_BLOCK = 4096, 2048
#: Width of the error bound in units of the estimate's typical error; a wider bound reranks more and misses less.
EPSILON = 1.9
#: Queries that one task holds; more queries take more groups.
QUERIES_PER_GROUP = 100_000
#: Above the length of any vector.
LENGTHS = 1 << 31


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix, the same everywhere."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs of the rotated directions, norms as multiples of scales (the largest components, so that nothing overflows),
    the scales, and inner products of the directions with their codes."""
    scale = np.abs(vectors).max(axis=1)
    vectors = vectors / scale[:, None]
    norm = np.linalg.norm(vectors, axis=1)
    turned = (vectors / norm[:, None]) @ turn.T
    return np.packbits(turned > 0, axis=1), norm, scale, np.abs(turned).sum(axis=1) / np.sqrt(vectors.shape[1])


def estimate(codes: np.ndarray, norm: np.ndarray, own: np.ndarray, queries: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each query (row) and code (column): the estimated inner product and the bound of its error, in the type of norm."""
    dim, kind = queries.shape[1], norm.dtype
    signs = np.unpackbits(codes, axis=1, count=dim).astype(kind) * kind.type(2 / np.sqrt(dim)) - kind.type(1 / np.sqrt(dim))
    turned = (queries @ turn.T).astype(kind)
    value = (turned @ signs.T) * (norm / own.astype(kind))
    spread = norm * (np.sqrt(np.maximum(1 - own**2, 0)) / own / np.sqrt(max(dim - 1, 1))).astype(kind)
    return value, EPSILON * np.outer(np.linalg.norm(queries, axis=1).astype(kind), spread)


class Best:
    """The k best (score descending, id ascending) of each query so far; here says which places are taken."""

    def __init__(self, n: int, k: int):
        self.k, self.score, self.id, self.here = k, np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max), np.zeros((n, k), bool)

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Candidates (rows, scores, ids of the same length) of any queries."""
        if not len(rows):
            return
        touched, at = np.unique(rows, return_inverse=True)
        row = np.r_[at, np.repeat(np.arange(len(touched)), self.k)]
        score, name = np.r_[scores, self.score[touched].ravel()], np.r_[ids, self.id[touched].ravel()]
        here = np.r_[np.ones(len(rows), bool), self.here[touched].ravel()]
        order = np.lexsort((name, -score, ~here, row))
        row = row[order]
        first = np.searchsorted(row, np.arange(len(touched)))
        place = first[:, None] + np.arange(self.k)[None, :]
        self.score[touched], self.id[touched], self.here[touched] = score[order][place], name[order][place], here[order][place]

    def floor(self, rows: slice | np.ndarray) -> np.ndarray:
        """What a score must reach to be among the best; everything does while places are free."""
        return np.where(self.here[rows, -1], self.score[rows, -1], -np.inf)


def search_block(best: Best, queries: np.ndarray, query_ids: np.ndarray, ids: np.ndarray, vectors: np.ndarray, turn: np.ndarray) -> int:
    """Adds a block of rows to best; returns how many pairs were reranked.

    Of equal vectors in the block only the k + 1 smallest ids can be among the k best of any query, so a large group of copies
    costs one comparison a query.
    """
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    _, first, group, size = np.unique(vectors, axis=0, return_index=True, return_inverse=True, return_counts=True)
    group = group.ravel()
    by_group = np.argsort(group, kind="stable")
    begin = np.cumsum(size) - size
    keep = np.minimum(size, best.k + 1)
    distinct = vectors[first]
    codes, norm, scale, own = encode(distinct, turn)
    # Estimates are of the queries over their largest components, and of the rows over the block's largest one; in single
    # precision unless the block's vectors differ too much in size for it.
    largest = scale.max()
    norm = norm * (scale / largest)
    norm = norm.astype(np.float32) if norm.min() > 1e-25 else norm
    reranked = 0
    for at in range(0, len(queries), QUERY_BLOCK):
        q = queries[at : at + QUERY_BLOCK]
        q_scale = np.abs(q).max(axis=1)
        value, error = estimate(codes, norm, own, q / q_scale[:, None], turn)

        def floor(at: int = at, q: np.ndarray = q, q_scale: np.ndarray = q_scale) -> np.ndarray:
            """The exact floors in the estimates' measure, lower by more than its rounding; none where they overflow."""
            with np.errstate(over="ignore", invalid="ignore"):
                low = best.floor(slice(at, at + len(q))) / q_scale / largest
                low = low - 1e-5 * np.abs(low) - 1e-30
            return np.where(np.isfinite(low), low, -np.inf).astype(norm.dtype)

        def rerank(i: np.ndarray, j: np.ndarray, at: int = at, q: np.ndarray = q) -> int:
            for part in range(0, len(i), 1 << 16):
                r, c = i[part : part + (1 << 16)], j[part : part + (1 << 16)]
                with np.errstate(over="ignore", invalid="ignore"):
                    score = np.einsum("nd,nd->n", q[r], distinct[c])
                score = np.where(np.isnan(score), -np.inf, score)
                good = score >= best.floor(at + r)
                r, c, score = r[good], c[good], score[good]
                n = keep[c]
                place = np.repeat(begin[c], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                name, row = ids[by_group[place]], np.repeat(r, n)
                other = name != query_ids[at + row]
                best.add(at + row[other], np.repeat(score, n)[other], name[other])
            return len(i)

        # The best estimates first: their exact scores raise the floor that all others must reach with their bounds.
        m = min(2 * best.k, len(distinct))
        top = np.argpartition(value, len(distinct) - m, axis=1)[:, len(distinct) - m :]
        row = np.arange(len(q))[:, None]
        reach = value + error  # finite, as nothing in either is above one but for the roots of the dimension
        first_ones = reach[row, top] >= floor()[:, None]
        reranked += rerank(*(x[first_ones] for x in np.broadcast_arrays(row, top)))
        rest = reach >= floor()[:, None]
        rest[row, top] = False
        reranked += rerank(*np.nonzero(rest))
    return reranked


def usable(df: DataFrame) -> DataFrame:
    """vec_id, embedding (array of double) of the rows that take part: with an id, and a vector that is neither null, empty nor
    zero and has no null or non-finite component."""
    v = F.col("embedding").cast("array<double>")
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("embedding")).where("vec_id is not null and embedding is not null and size(embedding) > 0")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.coalesce(finite, F.lit(False)) & F.exists("embedding", lambda x: x != 0))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.stack(column.to_numpy(zero_copy_only=False)).astype(np.float64)


def nearest(df: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id, score: of every row whose vec_id is divisible by every, the k rows with the largest inner
    product, nearest first, ties to smaller vec_id, never a row with the query's own id.

    Rows without a usable vector are neither queries nor candidates; a query's candidates are the rows whose vectors have its
    length. An inner product that overflows counts as the infinity that double precision gives; infinities that cancel count as
    the least. With fewer than k candidates all are returned. Repeated ids are candidates of their own; a repeated query id is one query, its first vector
    in order. Other columns aren't read.
    """
    rows = materialised(usable(df), "vectors")
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    counted = rows.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("vec_id") % every == 0, 1)).alias("q")).first()
    result = "query_id long, vec_id long, score double"
    if not counted.q:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # Cells of a grid: each group of queries meets each group of rows once; either side of a cell has a bounded size.
    query_groups = -(-counted.q // QUERIES_PER_GROUP)
    # Rows stream through their cell, so there need be no more groups of them than keep the executors busy: queries are copied
    # to each group, and the copies so grow with the executors, not with the rows.
    row_groups = max(1, min(-(-counted.n // (2 * BLOCK)), 4 * df.sparkSession.sparkContext.defaultParallelism))
    cell = lambda g, h: (F.col(g) * query_groups + F.col(h)) * LENGTHS + F.size("embedding")
    spread = F.sequence(F.lit(0), F.lit(query_groups - 1))
    left = rows.select(F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(row_groups)).alias("g"), F.explode(spread).alias("h"), "vec_id", "embedding")
    right = asked.select(F.explode(F.sequence(F.lit(0), F.lit(row_groups - 1))).alias("g"), F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(query_groups)).alias("h"), "vec_id", "embedding")
    tagged = left.select(cell("g", "h").alias("cell"), F.lit(1).alias("side"), "vec_id", "embedding").union(right.select(cell("g", "h").alias("cell"), F.lit(0).alias("side"), "vec_id", "embedding"))
    tagged = tagged.repartition(row_groups * query_groups, "cell").sortWithinPartitions("cell", "side", "vec_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, now, held, best, queries, names = None, None, [], None, np.zeros((0, 0)), np.zeros(0, np.int64)

        def flush() -> None:
            if held and best is not None:
                search_block(best, queries, names, np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]), turn)
            held.clear()

        def out() -> Iterator[pa.RecordBatch]:
            if best is not None:
                r, c = np.nonzero(best.here)
                yield pa.RecordBatch.from_pydict({"query_id": names[r], "vec_id": best.id[r, c], "score": best.score[r, c]})

        for batch in batches:
            cells, sides, ids = (batch.column(i).to_numpy() for i in range(3))
            cuts = np.flatnonzero(np.r_[True, (cells[1:] != cells[:-1]) | (sides[1:] != sides[:-1])])
            for a, b in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
                own = _matrix(batch.column(3).slice(a, b - a))
                if cells[a] != now:
                    flush()
                    yield from out()
                    now, best, queries, names = cells[a], None, np.zeros((0, own.shape[1])), np.zeros(0, np.int64)
                    turn = turn if turn is not None and len(turn) == own.shape[1] else rotation(own.shape[1])
                if sides[a] == 0:
                    queries, names = np.concatenate([queries, own]), np.concatenate([names, ids[a:b]])
                    continue
                if best is None:
                    best = Best(len(queries), k)
                held.append((ids[a:b], own))
                if sum(len(x[0]) for x in held) >= BLOCK:
                    flush()
        flush()
        yield from out()

    found = tagged.mapInArrow(run, result)
    pair = F.struct((-F.col("score")).alias("less"), "vec_id")
    top = found.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(pair)), 1, k).alias("best"))
    one = top.select("query_id", F.posexplode("best").alias("pos", "one"))
    return one.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("one.vec_id").alias("vec_id"), (0.0 - F.col("one.less")).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every twentieth row."""
    return nearest(table(spark, sf_dir, "embeddings"))
