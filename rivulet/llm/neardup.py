"""Near-duplicate records with small edits (problem 3).

Texts become sets of word runs.  Texts of equal sets form a class; only one member a class goes on.
Signatures come from circulant MinHash: one permutation places the elements, a second one, shifted by
one place for each coordinate, gives all coordinates.  Bands of coordinates are the buckets of a join;
every pair that meets in a bucket is verified with the exact Jaccard similarity of the sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.llm.text import U64, mix, shingle_hashes
from rivulet.session import materialize, release

#: Word runs and similarity of near-duplicates where nothing else is stated.
SHINGLE, SIMILARITY = 5, 0.8
#: Bands times rows of the signature: at similarity 0.7, 32 x 4 misses 1.5 pairs of 10,000.
BANDS, ROWS = 32, 4
#: Places of the permutations.  Larger sets saturate it, which only adds candidates.
PLACES = 1 << 16
#: A group of more byte-equal texts is given as pairs of its least id and each other member; with None every pair is given.
EXPAND = 64
#: Members of a class, or of a bucket, that one task pairs with all others of it.
BLOCK = 4096
#: Texts hashed together in a Python worker.
GROUP = 512


def permutation(places: int, coordinates: int) -> np.ndarray:
    """The second permutation, continued past its end so that a shift is a slice."""
    pi = np.random.default_rng(20240229).permutation(places).astype(np.uint32)
    return np.concatenate((pi, pi[:coordinates]))


def signatures(hashes: np.ndarray, offsets: np.ndarray, coordinates: int, places: int = PLACES) -> np.ndarray:
    """Circulant MinHash of each non-empty text: array of texts x coordinates."""
    pi = permutation(places, coordinates)
    at = (mix(hashes) & U64(places - 1)).astype(np.int32)  # the first permutation
    out = np.empty((len(offsets) - 1, coordinates), np.uint32)
    for k in range(coordinates):
        out[:, k] = np.minimum.reduceat(np.take(pi[k:], at), offsets[:-1])
    return out


def _sets(h: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    return [np.unique(h[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]


def _by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, GROUP):
            yield batch.slice(at, GROUP)


def _sign(shingle: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _by_group(batches):
            texts = batch.column("text").to_pylist()
            h, offsets = shingle_hashes(texts, shingle)
            some = np.flatnonzero(np.diff(offsets))
            if not len(some):
                continue
            kept = _sets(h, offsets[np.concatenate((some, [len(offsets) - 1]))])
            sizes = np.array([len(s) for s in kept])
            flat = np.concatenate(kept)
            sig = signatures(flat, np.concatenate(([0], np.cumsum(sizes))), bands * rows).astype(U64)
            keys = np.empty((len(some), bands), np.int64)
            for b in range(bands):
                key = np.full(len(some), b, U64)
                for r in range(rows):
                    key = mix(key * U64(0x9E3779B97F4A7C15) + sig[:, b * rows + r])
                keys[:, b] = key.view(np.int64)
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in kept]
            exact = [hashlib.blake2b(texts[i].encode(), digest_size=16).digest() for i in some]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("item").take(pa.array(some)), batch.column("id").take(pa.array(some)), pa.array(exact, pa.binary()), pa.array(digests, pa.binary()),
                    pa.array(sizes.astype(np.int32)), pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, bands, dtype=np.int32)), pa.array(keys.ravel())),
                ],
                ["item", "id", "exact", "digest", "n", "bands"],
            )

    return run


def _sets_of(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _by_group(batches):
            h, offsets = shingle_hashes(batch.column("text").to_pylist(), shingle)
            kept = _sets(h, offsets)
            at = np.concatenate(([0], np.cumsum([len(s) for s in kept]))).astype(np.int32)
            flat = (np.concatenate(kept) if kept else np.empty(0, U64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("item"), batch.column("cls"), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], ["item", "cls", "shingles"])

    return run


def texts(df: DataFrame, item: str, key: str, text: str) -> DataFrame:
    """``(item, id, text)``: one row a key with a text that is not null; other columns are left out."""
    return df.where(F.col(text).isNotNull()).select(F.lit(item).alias("item"), F.col(key).cast("string").alias("id"), F.col(text).alias("text"))


def with_sets(rows: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """``(item, cls, shingles)`` of the wanted ``(item, id, cls)``; sets are made for these texts only."""
    found = rows.join(wanted, ["item", "id"]).select("item", "cls", "text").dropDuplicates(["item", "cls"])
    return found.mapInArrow(_sets_of(shingle), "item string, cls bigint, shingles array<bigint>")


def jaccard_pairs(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``(item, a, b)`` whose sets reach the similarity, with it."""
    left = sets.select("item", F.col("cls").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select("item", F.col("cls").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    shared = pairs.join(left, ["item", "a"]).join(right, ["item", "b"]).select("item", "a", "b", both.alias("both"), (F.size("sa") + F.size("sb")).alias("total"))
    return shared.select("item", "a", "b", (F.col("both") / (F.col("total") - F.col("both"))).alias("similarity")).where(F.col("similarity") >= similarity)


class NearDuplicates:
    """Near-duplicates among the rows of ``(item, id, text)``; different items are not compared.

    ``members``: ``(item, id, cls, exact)``, every text by its class of equal sets and a digest of its bytes.  ``links``: ``(item, a, b,
    similarity)``, verified pairs of classes with a < b.  Texts shorter than one run have no set and are in
    neither.  Repeated rows count once; empty input gives empty tables.  A class is named by 64 bits of
    a 128-bit digest of its set.
    """

    def __init__(self, rows: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, bands: int = BANDS, rows_per_band: int = ROWS):
        signed = materialize(rows.mapInArrow(_sign(shingle, bands, rows_per_band), "item string, id string, exact binary, digest binary, n int, bands array<bigint>"), "signatures")
        cls = F.xxhash64("digest").alias("cls")
        self.members = signed.groupBy("item", "id", cls).agg(F.min("exact").alias("exact"))
        firsts = signed.groupBy("item", cls).agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("bands").alias("bands"))
        self.firsts = materialize(firsts, "classes")
        buckets = self.firsts.select("item", "cls", "n", F.explode("bands").alias("band")).select(F.xxhash64("item", "band").alias("key"), "cls", "n")
        # most buckets hold one class and go no further; large ones are paired by several tasks, each with a part of the members on one side
        shared = buckets.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").select("key", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
        met = materialize(buckets.join(shared, "key"), "buckets")
        a = met.select("key", F.pmod("cls", "blocks").cast("int").alias("block"), F.col("cls").alias("a"), F.col("n").alias("na"))
        b = met.select("key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("cls").alias("b"), F.col("n").alias("nb"))
        near = (F.col("a") < F.col("b")) & (F.least("na", "nb") >= similarity * F.greatest("na", "nb"))
        pairs = a.join(b, ["key", "block"]).where(near).select("a", "b").distinct()
        # a set that both items have is a class of each; pairs are made within an item
        of = self.firsts.select("item", "cls")
        self.candidates = materialize(pairs.join(of.withColumnRenamed("cls", "a"), "a").join(of.withColumnRenamed("cls", "b"), ["item", "b"]).select("item", "a", "b"), "candidates")
        release(met)
        ends = self.candidates.select("item", F.col("a").alias("cls")).unionByName(self.candidates.select("item", F.col("b").alias("cls"))).distinct()
        wanted = self.firsts.select("item", "id", "cls").join(ends, ["item", "cls"])
        sets = materialize(with_sets(rows, wanted, shingle), "sets")
        self.links = materialize(jaccard_pairs(self.candidates, sets, similarity), "links")
        release(sets, self.candidates)

    def pairs(self, expand: int | None = EXPAND) -> DataFrame:
        """``(item, id_a, id_b)`` with id_a < id_b: all pairs of similar texts.

        Texts of one class may differ in case, punctuation or layout: all pairs between different texts are given,
        within a class and between linked ones, and those of up to ``expand`` byte-equal texts.  A larger group of
        byte-equal texts appears as its least id paired with every other member and stands in all other pairs by that id.
        With None no group is shortened.
        """
        most = F.lit((1 << 62) if expand is None else expand)
        copies = self.members.groupBy("item", "cls", "exact").agg(F.count("*").alias("copies"), F.min("id").alias("first"))
        members = self.members.join(copies.where("copies > 1"), ["item", "cls", "exact"], "left").withColumn("copies", F.coalesce("copies", F.lit(1)))
        shown = members.where((F.col("copies") <= most) | (F.col("id") == F.col("first"))).select("item", "cls", "id")
        size = shown.groupBy("item", "cls").agg(F.count("*").alias("size")).where("size > 1")
        grouped = shown.join(size, ["item", "cls"]).withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
        # a large class is paired by several tasks: each takes a part of its members on one side
        left = grouped.select("item", "cls", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block"), F.col("id").alias("x"))
        right = grouped.select("item", "cls", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("id").alias("y"))
        inside = left.join(right, ["item", "cls", "block"]).where("x < y").select("item", "x", "y")
        star = members.where((F.col("copies") > most) & (F.col("id") != F.col("first"))).select("item", F.col("first").alias("x"), F.col("id").alias("y"))
        across = self.links.join(shown.select("item", F.col("cls").alias("a"), F.col("id").alias("x")), ["item", "a"]).join(shown.select("item", F.col("cls").alias("b"), F.col("id").alias("y")), ["item", "b"]).select("item", "x", "y")
        every = inside.unionByName(star).unionByName(across)
        return every.select("item", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))

    def groups(self) -> DataFrame:
        """``(item, id, group_id, n_links)``, one row a text: its connected group and the links of its class to other classes.

        ``group_id`` is the least id of the group; texts without a partner are their own group.
        """
        ends = self.links.select("item", "a", "b").unionByName(self.links.select("item", F.col("b").alias("a"), F.col("a").alias("b")))
        labels = components(ends)
        degree = ends.groupBy("item", F.col("a").alias("cls")).agg(F.count("*").alias("n_links"))
        named = self.members.join(labels.withColumnRenamed("node", "cls"), ["item", "cls"], "left").withColumn("label", F.coalesce("label", "cls")).join(degree, ["item", "cls"], "left")
        least = named.groupBy("item", "label").agg(F.min("id").alias("group_id"))
        return named.join(least, ["item", "label"]).select("item", "id", "group_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def components(ends: DataFrame) -> DataFrame:
    """``(item, node, label)``: connected components of the symmetric edges ``(item, a, b)``, labelled by their least node.

    Each round takes the least label among the neighbours and then the label of that label; tables are
    written between rounds, and only a count comes to the driver.
    """
    ends = materialize(ends.distinct(), "edges")
    labels = materialize(ends.groupBy("item", F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = ends.join(labels.select("item", F.col("node").alias("b"), "label"), ["item", "b"]).groupBy("item", F.col("a").alias("node")).agg(F.min("label").alias("near"))
        hop = labels.join(near, ["item", "node"]).select("item", "node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = hop.join(labels.select("item", F.col("node").alias("label"), F.col("label").alias("top")), ["item", "label"], "left").select("item", "node", "old", F.least("label", F.coalesce("top", "label")).alias("label"))
        new = materialize(jump, "labels")
        if new.where("label < old").isEmpty():
            return new.select("item", "node", "label")
        labels = new.select("item", "node", "label")
