"""Most similar vectors for every vector (problem 5).

An index of additive quantisation: a coarse codebook names the list of a vector, and the residual is
the sum of one full-dimensional codeword from each of several codebooks, chosen by beam search.  Codes and
the norm of the reconstruction are stored.  A query visits its nearest lists, scores their codes by
lookup tables, and the best are reranked with the exact cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rivulet.session import materialize

#: Codebooks, codewords of each, beam of the encoder.
CODEBOOKS, WORDS, BEAM = 6, 256, 4
#: Vectors the codebooks are fitted on, vectors drawn for each list centre, and most drawn in all; every vector is indexed.
TRAIN, TRAIN_LIST, TRAIN_MOST = 16_384, 16, 262_144
#: Most lists; below, there are as many as the square root of the vectors.  Up to FLAT centres are fitted in one go, more in two levels.
MAX_LISTS, FLAT = TRAIN_MOST // TRAIN_LIST, 2_048
#: Rows of a list, and queries of a list, that one task takes together.
LIST_BLOCK, QUERY_BLOCK = 4096, 8192


@dataclass
class Codec:
    """The trained model: list centroids and additive codebooks (codebooks x words x dimensions)."""

    centroids: np.ndarray
    books: np.ndarray

    def lists(self, x: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` nearest lists of each vector, nearest first."""
        n = min(n, len(self.centroids))
        square = (self.centroids**2).sum(1)
        out = np.empty((len(x), n), np.int64)
        step = max(1, (1 << 23) // len(self.centroids))  # distances held at a time
        for at in range(0, len(x), step):
            d = square - 2 * (x[at : at + step] @ self.centroids.T)
            near = np.argpartition(d, n - 1, axis=1)[:, :n] if n < len(self.centroids) else np.broadcast_to(np.arange(n), (len(d), n))
            order = np.argsort(np.take_along_axis(d, near, 1), axis=1, kind="stable")
            out[at : at + step] = np.take_along_axis(near, order, 1)
        return out

    def encode(self, r: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """Codes of residuals by beam search: after each codebook the ``beam`` sums nearest to the vector stay."""
        n, dim = r.shape
        left, codes = r[:, None, :], np.empty((n, 1, 0), np.uint8)
        for book in self.books:
            width = left.shape[1]
            cost = (left**2).sum(2)[:, :, None] + (book**2).sum(1) - 2 * (left.reshape(-1, dim) @ book.T).reshape(n, width, -1)
            flat = cost.reshape(n, -1)
            keep = min(beam, flat.shape[1])
            best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
            best = np.take_along_axis(best, np.argsort(np.take_along_axis(flat, best, 1), axis=1), 1)
            parent, word = best // len(book), best % len(book)
            rows = np.arange(n)[:, None]
            codes = np.concatenate((codes[rows, parent], word[:, :, None].astype(np.uint8)), axis=2)
            left = left[rows, parent] - book[word]
        return codes[:, 0]

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(book[codes[:, m]] for m, book in enumerate(self.books))


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    k = max(1, min(k, len(x)))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = ((c**2).sum(1) - 2 * (x @ c.T)).argmin(1)
        n = np.bincount(near, minlength=k)
        sums = np.stack([np.bincount(near, weights=x[:, j], minlength=k) for j in range(x.shape[1])], 1)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.choice(len(x), k)]).astype(np.float32)
    return c


def centres(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """``k`` list centres; many are fitted in two levels, each first-level group getting its share of them."""
    if k <= FLAT:
        return _kmeans(x, k, 8, rng)
    top = _kmeans(x, int(round(k**0.5)), 8, rng)
    near = ((top**2).sum(1) - 2 * (x @ top.T)).argmin(1)
    groups = [x[near == g] for g in range(len(top))]
    return np.concatenate([_kmeans(g, max(1, round(k * len(g) / len(x))), 8, rng) for g in groups if len(g)])


def train(x: np.ndarray, n_lists: int, codebooks: int = CODEBOOKS, words: int = WORDS, refits: int = 1) -> Codec:
    """Fit centroids and codebooks to unit vectors: residual k-means, then all codebooks together by least squares on beam-searched codes."""
    rng = np.random.default_rng(5)
    centroids = centres(x, n_lists, rng)
    x = x[:TRAIN]
    codec = Codec(centroids, np.empty((0, 1, x.shape[1]), np.float32))
    r = x - centroids[codec.lists(x, 1)[:, 0]]
    books, left = [], r
    for _ in range(codebooks):
        c = _kmeans(left, words, 8, rng)
        left = left - c[((c**2).sum(1) - 2 * (left @ c.T)).argmin(1)]
        books.append(np.concatenate((c, np.zeros((words - len(c), x.shape[1]), np.float32))))
    codec.books = np.stack(books)
    for _ in range(refits):
        flat = codec.encode(r).astype(np.int64) + np.arange(codebooks) * words
        size = codebooks * words
        gram, cross = np.zeros((size, size)), np.zeros((size, x.shape[1]))
        for m in range(codebooks):
            for n in range(codebooks):
                np.add.at(gram, (flat[:, m], flat[:, n]), 1.0)
            np.add.at(cross, flat[:, m], r)
        codec.books = np.linalg.solve(gram + 0.1 * np.eye(size), cross + 0.1 * codec.books.reshape(size, -1)).reshape(codebooks, words, -1).astype(np.float32)
    return codec


def usable(df: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """``(id, v)`` of vectors with ``dim`` finite numbers that are not all zero, once a key.

    Null vectors, wrong lengths, null elements, NaN and infinities take no part.
    """
    ok = (F.size(vector) == dim) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    return df.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & ok).select(F.col(key).cast("string").alias("id"), F.col(vector).cast("array<float>").alias("v")).dropDuplicates(["id"])


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    if pa.types.is_binary(column.type):
        return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dim)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)  # squares of very large or small numbers
    return (x / np.sqrt((x**2).sum(1, keepdims=True))).astype(np.float32)


def _bytes(x: np.ndarray) -> pa.Array:
    x = np.ascontiguousarray(x)
    width = x.shape[1] * x.itemsize
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(0, width * len(x) + 1, width, dtype=np.int32)), pa.py_buffer(x)])


class VectorIndex:
    """The index over ``(id, v)`` as ``usable`` gives them.

    Vectors of the same numbers are held once; of their ids the ``k + 1`` least can be
    neighbours at all, since ties go to the lesser id, so a group of copies of any size stays exact.
    """

    def __init__(self, vectors: DataFrame, dim: int, k: int = 10):
        self.dim, self.k = dim, k
        keyed = vectors.select("id", "v", F.xxhash64("v").alias("h1"), F.hash("v").alias("h2"))
        self.vectors = materialize(keyed, "vectors")
        spark = vectors.sparkSession
        rank = Window.partitionBy("h1", "h2").orderBy("id")
        self.named = self.vectors.select("id", "h1", "h2", F.row_number().over(rank).alias("rn")).where(F.col("rn") <= k + 1).drop("rn")
        ones = self.vectors.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.min_by("v", "id").alias("v"))
        n = self.vectors.count()
        self.n_lists = int(min(MAX_LISTS, max(1, round(n**0.5))))
        drawn = min(TRAIN_MOST, max(TRAIN, TRAIN_LIST * self.n_lists))
        share = min(1.0, 1.1 * drawn / max(1, n))
        sample = self.vectors.where(F.pmod("h1", F.lit(1_000_000)) < int(share * 1_000_000) + 1).limit(drawn).select("v").toArrow()
        self.codec = train(_unit(_matrix(sample.column("v"), dim)), self.n_lists) if sample.num_rows else Codec(np.zeros((1, dim), np.float32), np.zeros((CODEBOOKS, WORDS, dim), np.float32))
        model = spark.sparkContext.broadcast(self.codec)

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codec = model.value
            for whole in batches:
                for at in range(0, whole.num_rows, 2048):
                    batch = whole.slice(at, 2048)
                    x = _unit(_matrix(batch.column("v"), dim))
                    home = codec.lists(x, 1)[:, 0]
                    codes = codec.encode(x - codec.centroids[home])
                    norm = np.linalg.norm(codec.centroids[home] + codec.decode(codes), axis=1)
                    yield pa.RecordBatch.from_arrays([batch.column("h1"), batch.column("h2"), pa.array(home.astype(np.int32)), _bytes(codes), pa.array(norm.astype(np.float32)), _bytes(x)], ["h1", "h2", "list", "codes", "norm", "x"])

        self.coded = materialize(ones.select("h1", "h2", "v").mapInArrow(encode, "h1 bigint, h2 int, list int, codes binary, norm float, x binary"), "codes")

    def _probe(self, queries: DataFrame, probes: int) -> DataFrame:
        model, dim = queries.sparkSession.sparkContext.broadcast(self.codec), self.dim

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 2048):
                    batch = whole.slice(at, 2048)
                    lists = model.value.lists(_matrix(batch.column("x"), dim), probes).astype(np.int32)
                    offsets = np.arange(0, lists.size + 1, lists.shape[1], dtype=np.int32)
                    yield pa.RecordBatch.from_arrays([batch.column("h1"), batch.column("h2"), batch.column("x"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(lists.ravel()))], ["h1", "h2", "x", "lists"])

        return queries.select("h1", "h2", "x").mapInArrow(near, "h1 bigint, h2 int, x binary, lists array<int>").select("h1", "h2", "x", F.explode("lists").alias("list"))

    def search(self, queries: DataFrame | None = None, probes: int = 4, at_least: float = -2.0, slack: float = 0.3, rerank: int = 160) -> DataFrame:
        """``(id_a, id_b, similarity, rank)``: for each query id its ``k`` most similar other ids by (cosine, id).

        ``queries`` is ``(id)`` of indexed vectors, all of them when absent.  With ``at_least`` only neighbours
        of that cosine are sought: every code whose estimate is not more than ``slack`` below it is
        reranked; without, the ``rerank`` best estimates of each list.
        """
        spark = self.vectors.sparkSession
        asked = self.coded if queries is None else self.coded.join(self.vectors.join(queries.select("id").distinct(), "id").select("h1", "h2").distinct(), ["h1", "h2"], "left_semi")
        probed = self._probe(asked, probes)
        blocks = lambda df, size, name: df.groupBy("list").agg(F.ceil(F.count("*") / size).cast("int").alias(name))
        # one row a list, of which there are at most MAX_LISTS
        shape = F.broadcast(blocks(self.coded, LIST_BLOCK, "nd").join(blocks(probed.select("list"), QUERY_BLOCK, "nq"), "list"))
        ahead = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        rows = self.coded.join(shape, "list").select("list", F.pmod(F.col("h2"), "nd").alias("d"), ahead("nq").alias("q"), "h1", "h2", "codes", "norm", "x")
        wanted = probed.join(shape, "list").select("list", ahead("nd").alias("d"), F.pmod(F.col("h2"), "nq").alias("q"), "h1", "h2", "x")
        model, dim, k = spark.sparkContext.broadcast(self.codec), self.dim, self.k
        top = max(rerank, k)
        names = ["qa1", "qa2", "h1", "h2", "similarity"]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.float64()]

        def score(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or not right.num_rows:
                return pa.Table.from_arrays([pa.array([], t) for t in types], names)
            codec = model.value
            asked_x, held_x = _matrix(left.column("x"), dim), _matrix(right.column("x"), dim)
            codes = np.frombuffer(b"".join(right.column("codes").to_pylist()), np.uint8).reshape(right.num_rows, -1)
            inverse = 1 / np.maximum(right.column("norm").to_numpy(), 1e-9)
            ids = [left.column("h1").to_numpy(), left.column("h2").to_numpy(), right.column("h1").to_numpy(), right.column("h2").to_numpy()]
            centre = codec.centroids[right.column("list")[0].as_py()]
            out: list[list[np.ndarray]] = [[] for _ in names]
            for at in range(0, len(asked_x), 256):
                q = asked_x[at : at + 256]
                tables = np.ascontiguousarray(np.einsum("mwd,qd->mwq", codec.books, q, optimize=True))
                estimate = np.repeat((q @ centre)[None], len(codes), 0)
                for m in range(codes.shape[1]):
                    estimate += tables[m][codes[:, m]]
                estimate *= inverse[:, None]
                if at_least > -1:
                    d, i = np.nonzero(estimate >= at_least - slack)
                else:
                    keep = min(top, len(codes))
                    d = np.argpartition(-estimate, keep - 1, axis=0)[:keep].T.ravel()
                    i = np.repeat(np.arange(len(q)), keep)
                exact = np.einsum("nd,nd->n", q[i].astype(np.float64), held_x[d].astype(np.float64))
                good = exact >= at_least
                if at_least <= -1 and keep > k + 1:
                    # only the k + 1 best of a block, with ties, can be among the k + 1 best of all
                    table = exact.reshape(len(q), keep)
                    good &= (table >= np.partition(table, keep - k - 1, axis=1)[:, keep - k - 1 : keep - k]).ravel()
                for column, values in zip(out, (ids[0][at + i], ids[1][at + i], ids[2][d], ids[3][d], exact)):
                    column.append(values[good])
            return pa.Table.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(out, types)], names)

        scored = wanted.groupBy("list", "d", "q").cogroup(rows.groupBy("list", "d", "q")).applyInArrow(score, "qa1 bigint, qa2 int, h1 bigint, h2 int, similarity double")
        if queries is None and at_least > -1:
            # similarity goes both ways: a pair met from one side serves the other, so fewer lists need a visit
            other = scored.select(F.col("h1").alias("qa1"), F.col("h2").alias("qa2"), F.col("qa1").alias("h1"), F.col("qa2").alias("h2"), "similarity")
            scored = scored.unionByName(other).groupBy("qa1", "qa2", "h1", "h2").agg(F.max("similarity").alias("similarity"))
        # of each query the best k + 1 vectors (its own among them); a vector sits in one list only
        best = Window.partitionBy("qa1", "qa2").orderBy(F.desc("similarity"))
        limited = scored.withColumn("rn", F.rank().over(best)).where(F.col("rn") <= self.k + 1).drop("rn")
        ids = self.vectors.select("id", F.col("h1").alias("qa1"), F.col("h2").alias("qa2"))
        if queries is not None:
            ids = ids.join(queries.select("id").distinct(), "id")
        found = limited.join(ids.withColumnRenamed("id", "id_a"), ["qa1", "qa2"]).join(self.named.withColumnRenamed("id", "id_b"), ["h1", "h2"]).where("id_a != id_b")
        order = Window.partitionBy("id_a").orderBy(F.desc("similarity"), "id_b")
        return found.select("id_a", "id_b", "similarity", F.row_number().over(order).alias("rank")).where(F.col("rank") <= self.k)


def mutual(found: DataFrame, at_least: float) -> DataFrame:
    """``(id_a, id_b)``, id_a < id_b: pairs at or above a cosine that are each among the other's neighbours."""
    near = found.where(F.col("similarity") >= at_least).select(F.least("id_a", "id_b").alias("x"), F.greatest("id_a", "id_b").alias("y"))
    return near.groupBy("x", "y").agg(F.count("*").alias("n")).where("n = 2").select(F.col("x").alias("id_a"), F.col("y").alias("id_b"))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row ``(n_queries, n_true, recall)``: share of the true neighbours ``(id_a, id_b)`` that were found."""
    both = exact.select("id_a", "id_b", F.lit(1).alias("_true")).join(found.select("id_a", "id_b", F.lit(1).alias("_found")), ["id_a", "id_b"], "left")
    return both.agg(F.count_distinct("id_a").alias("n_queries"), F.count("*").alias("n_true"), F.round(F.count("_found") / F.count("*"), 4).alias("recall"))
