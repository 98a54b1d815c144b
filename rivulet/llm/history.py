r"""Deduplicating new batches against all history (problem 6).

Three kinds of earlier copies are told apart: the same text or content hash ('exact'), a text of high
shingle similarity ('near') and another text of the same file ('path').  Hashes, paths and digests are
keys of a table; near copies are sought in suffix arrays.

Every accepted batch leaves an immutable segment on the shared folder: its concatenated texts as word codes, and
the suffixes of these texts in lexicographic order of their words, cut into ranges of that order.  A suffix is
compared to a fixed depth.  The array is sparse: suffixes start at words chosen by content, so that two texts choose the
same ones within a passage they share.  A new batch is sorted into the same ranges, and in each range
binary search finds the suffixes that begin with the same words, and among them those of records of a possible size.
Each match covers the words up to the record's next chosen suffix, so a long match is a chain of these; the covered words
of each pair of records are summed, and pairs covered enough are verified with the exact similarity, on the stored
codes.  No text of the history is read again.  Segments of like size are merged, so there are logarithmically many.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm.text import U64, mix, word_hashes
from rivulet.session import drop_path, free_shuffles, materialize, release, scratch_path, write_text

#: Words a suffix is compared by, with eight bits of code each, and the window of which the least suffix is chosen.
DEPTH, WINDOW = 8, 8
#: Texts of fewer words are indexed at every word.
DENSE = 64
#: Records of fewer distinct runs of three words are sought by every run, 21 bits a word, in an array of small records.
SMALL = 32
#: Share of a record's words that must be covered before a pair is verified.
COVERED = 0.2
#: Hits of a suffix in one segment that are taken at once.  Records that stay unconfirmed while suffixes of theirs had more are searched in full.
AT_ONCE = 1024
#: Segments of like size that are merged to one, ids up to which a set of records is broadcast after counting it, and pairs a task holds at a time.
FANOUT, BROADCAST_IDS, BLOCK = 4, 500_000, 1 << 21
#: Suffixes of a range, at which the number of ranges is set, and suffixes drawn to place the ranges (only their bounds depend on it).
PARTITION, DRAWN = 1_000_000, 200_000
_RUN = 3
_ENCODED = "doc bigint, batch int, text_key binary, hash_key binary, path_key binary, version bigint, set_key binary, n_runs int, codes binary"
_SUFFIX = "part int, key bigint, n_runs int, doc bigint, words int"


def clean_hash(col: Column) -> Column:
    """The hash itself: lower case hex digits without prefix, blanks and separators; null if there are none."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(col), r"^\s*(sha-?\d+|md5|0x)\s*[:=]?\s*", ""), r"[^0-9a-f]", "")
    return F.when(bare != "", bare)


def clean_path(col: Column) -> Column:
    """The file a path means: no scheme, escapes decoded, '/' as separator, no empty, '.' or '..' parts, lower case."""
    decoded = F.coalesce(F.try_url_decode(F.replace(col, F.lit("+"), F.lit("%2B"))), col)
    path = F.regexp_replace(F.lower(F.regexp_replace(F.trim(decoded), r"\\", "/")), r"^[a-z][a-z0-9+.\-]*:/+", "")
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    resolved = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))))
    return F.when(F.size(resolved) > 0, F.array_join(resolved, "/"))


def run_hashes(codes: np.ndarray) -> np.ndarray:
    """Hashes of all runs of three words of one text, by its word codes."""
    c = codes.astype(U64)
    if len(c) < _RUN:
        return np.empty(0, U64)
    return mix(mix(c[:-2] << U64(32) | c[1:-1]) + c[2:] * U64(0x2545F4914F6CDD1D))


def _grouped(batches: Iterator[pa.RecordBatch], size: int = 512) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for start in range(0, whole.num_rows, size):
            yield whole.slice(start, size)


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _grouped(batches):
        texts = batch.column("text")
        words, offsets = word_hashes([t or "" for t in texts.to_pylist()])
        codes = (words >> U64(32)).astype(np.uint32)
        each = [codes[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
        sets = [np.unique(run_hashes(c)) for c in each]
        digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
        kept = [batch.column(c) for c in ("doc", "batch", "text_key", "hash_key", "path_key", "version")]
        yield pa.RecordBatch.from_arrays(
            [*kept, pa.array(digest, pa.binary()), pa.array([len(s) for s in sets], pa.int32()), pa.array([c.tobytes() for c in each], pa.binary())],
            ["doc", "batch", "text_key", "hash_key", "path_key", "version", "set_key", "n_runs", "codes"],
        )


def encode(rows: DataFrame) -> DataFrame:
    """What is kept of ``(doc, batch, text, hash, path)``: keys of text, hash and path, digest and number of the distinct runs, word codes.

    ``version`` tells texts apart; a null text differs from every other.  This is the only pass over the texts.
    """
    md5 = lambda c: F.unhex(F.md5(c))
    text_key = F.when(F.col("text").rlike(r"\S"), md5(F.col("text")))
    version = F.when(F.col("text").isNull(), F.xxhash64(F.lit("null"), "doc")).otherwise(F.xxhash64("text"))
    keyed = rows.select("doc", "batch", text_key.alias("text_key"), md5(clean_hash(F.col("hash"))).alias("hash_key"), md5(clean_path(F.col("path"))).alias("path_key"), version.alias("version"), "text")
    return keyed.mapInArrow(_encode, _ENCODED)


def chosen_suffixes(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the chosen suffixes, of which text each is, and the words up to the text's next one (at most the depth).

    Keys are whole numbers in the order of the suffixes: the words' codes, first word first.  Repeats within a text count
    once, with their words added up.  Suffixes shorter than the depth are none.
    """
    n = len(codes)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    if not n:
        return np.empty(0, np.int64), text, text
    left = offsets[1:][text] - np.arange(n)  # words from here to the end of the text
    code = (codes >> np.uint32(24)).astype(U64)
    padded = np.concatenate((code, np.zeros(DEPTH, U64)))
    key = np.zeros(n, U64)
    for k in range(DEPTH):
        key |= padded[k : k + n] << U64(8 * (DEPTH - 1 - k))
    full = left >= DEPTH
    most = U64(0xFFFFFFFFFFFFFFFF)
    order = np.where(full, mix(key), most)
    tail = np.concatenate((order, np.full(WINDOW, most, U64)))
    least = order.copy()
    for k in range(1, WINDOW):
        np.minimum(least, tail[k : k + n], out=least)
    chosen = np.zeros(n, bool)
    for k in range(WINDOW):
        chosen[k:] |= order[k:] == least[: n - k]
    at = np.flatnonzero(full & (chosen | (np.diff(offsets)[text] < DENSE)))
    owner = text[at]
    ahead = np.full(len(at), DEPTH, np.int64)
    ahead[:-1] = np.where(owner[1:] == owner[:-1], np.minimum(np.diff(at), DEPTH), DEPTH)
    return _once((key[at] ^ U64(1 << 63)).view(np.int64), owner, ahead)


def small_suffixes(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for small records: every suffix of three words, each covering one word."""
    n = len(codes)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    code = (codes >> np.uint32(11)).astype(np.int64)
    at = np.flatnonzero(offsets[1:][text] - np.arange(n) >= _RUN)
    key = code[at] << 42 | code[at + 1] << 21 | code[at + 2] if len(at) else np.empty(0, np.int64)
    return _once(key, text[at], np.ones(len(at), np.int64))


def _once(key: np.ndarray, owner: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = np.lexsort((key, owner))
    key, owner, words = key[at], owner[at], words[at]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    start = np.flatnonzero(new)
    return key[start], owner[start], np.add.reduceat(words, start) if len(start) else words


def _concatenated(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    each = column.to_pylist()
    offsets = np.concatenate(([0], np.cumsum([len(c) // 4 for c in each]))).astype(np.int64)
    return np.frombuffer(b"".join(each), np.uint32), offsets


def _suffix_rows(similarity: float, bounds: tuple[np.ndarray, np.ndarray] | None):
    """Rows of both arrays.  Ranges of the array of small records come first, then those of the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _grouped(batches):
            n_runs, doc = batch.column("n_runs").to_numpy(), batch.column("doc").to_numpy()
            codes, offsets = _concatenated(batch.column("codes"))
            # a record similar to one below SMALL may lie above it, and the other way round
            for array, wanted in enumerate((n_runs < SMALL / similarity + 1, n_runs >= SMALL * similarity - 1)):
                key, owner, words = (small_suffixes, chosen_suffixes)[array](codes, offsets)
                here = wanted[owner]
                key, owner, words = key[here], owner[here], words[here]
                part = np.full(len(key), array) if bounds is None else np.searchsorted(bounds[array], key, "right") + array * (len(bounds[0]) + 1)
                yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(key), pa.array(n_runs[owner].astype(np.int32)), pa.array(doc[owner]), pa.array(words.astype(np.int32))], ["part", "key", "n_runs", "doc", "words"])

    return run


def _read_part(folder: str, part: int) -> dict[str, np.ndarray]:
    """One range of a segment, in order; from whatever file system the shared folder is on."""
    import pyarrow.fs as pfs
    import pyarrow.parquet as pq

    for hadoop, plain in (("s3a://", "s3://"), ("s3n://", "s3://"), ("wasbs://", "abfss://")):
        folder = folder.replace(hadoop, plain, 1) if folder.startswith(hadoop) else folder
    fs, base = pfs.FileSystem.from_uri(folder if ":/" in folder else "file://" + folder)
    names = [f.path for f in fs.get_file_info(pfs.FileSelector(f"{base}/part={part}", allow_not_found=True)) if f.path.endswith(".parquet")]
    read = [pq.read_table(n, filesystem=fs, columns=["key", "n_runs", "doc", "words"], partitioning=None) for n in names]
    columns = {c: np.concatenate([t.column(c).to_numpy() for t in read]) if read else np.empty(0, np.int64) for c in ("key", "n_runs", "doc", "words")}
    if len(read) > 1:
        at = np.lexsort((columns["n_runs"], columns["key"]))
        columns = {c: v[at] for c, v in columns.items()}
    return columns


def matches(asked: dict[str, np.ndarray], held: dict[str, np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """For each asked suffix the interval of ``held`` that begins with the same words and belongs to records of a possible size.

    ``held`` is ordered by key, then by ``n_runs``: two binary searches find the suffixes, two more the sizes.
    """
    first = np.searchsorted(held["key"], asked["key"], "left")
    last = np.searchsorted(held["key"], asked["key"], "right")
    if not len(held["key"]):
        return first, last
    new = np.concatenate(([False], held["key"][1:] != held["key"][:-1]))
    rank = np.cumsum(new).astype(np.int64)
    place = rank << 32 | held["n_runs"]
    own = np.where(last > first, rank[np.minimum(first, len(rank) - 1)], rank[-1] + 1) << 32
    low = np.ceil(asked["n_runs"] * similarity - 1e-9).astype(np.int64)
    high = np.floor(asked["n_runs"] / similarity + 1e-9).astype(np.int64)
    return np.searchsorted(place, own | low, "left"), np.searchsorted(place, own | high, "right")


def _look_up(asked_in: str, segments: list[tuple[str, bool]], small_parts: int, similarity: float, at_once: int | None, shares: int):
    """Rows ``(doc, n_runs, other, words)`` of the ranges given; with a null ``other`` the words of suffixes that had too many hits."""
    names = ["doc", "n_runs", "other", "words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number in (x for b in batches for x in b.column("id").to_pylist()):
            part, share = divmod(number, shares)
            asked = _read_part(asked_in, part)
            # the array of small records is asked by these only, the other by the rest
            mine = (asked["n_runs"] < SMALL) == (part < small_parts)
            if shares > 1:
                mine &= (mix(asked["doc"].astype(np.int64).view(U64)) % U64(shares)).astype(np.int64) == share
            asked = {c: v[mine] for c, v in asked.items()}
            for folder, same in segments if len(asked["key"]) else []:
                held = _read_part(folder, part)
                start, stop = matches(asked, held, similarity)
                n = stop - start
                if at_once is not None and (n > at_once).any():
                    over = n > at_once
                    yield pa.RecordBatch.from_arrays([pa.array(asked["doc"][over]), pa.array(asked["n_runs"][over]), pa.nulls(int(over.sum()), pa.int64()), pa.array(asked["words"][over].astype(np.int32))], names)
                    n = np.minimum(n, at_once)
                row = np.flatnonzero(n)
                # intervals longer than a block are cut, so a task never holds more than two blocks of pairs
                cuts = -(-n[row] // BLOCK)
                row, nth = np.repeat(row, cuts), np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
                begin = start[row] + nth * BLOCK
                size = np.minimum(n[row] - nth * BLOCK, BLOCK)
                ends = np.cumsum(size)
                at = 0
                while at < len(row):
                    to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK, "right")))
                    r = np.repeat(row[at:to], size[at:to])
                    h = np.arange(len(r)) - np.repeat(ends[at:to] - size[at:to] - (ends[at - 1] if at else 0), size[at:to]) + np.repeat(begin[at:to], size[at:to])
                    doc, other = asked["doc"][r], held["doc"][h]
                    good = other < doc if same else other != doc
                    r = r[good]
                    yield pa.RecordBatch.from_arrays([pa.array(doc[good]), pa.array(asked["n_runs"][r]), pa.array(other[good]), pa.array(asked["words"][r].astype(np.int32))], names)
                    at = to

    return run


def _similar(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            good = np.zeros(batch.num_rows, bool)
            last, left = None, np.empty(0, U64)
            for i, (x, y) in enumerate(zip(a, b)):
                if x != last:
                    last, left = x, np.unique(run_hashes(np.frombuffer(x, np.uint32)))
                right = np.unique(run_hashes(np.frombuffer(y, np.uint32)))
                both = len(left) + len(right) - len(np.union1d(left, right))
                good[i] = both >= similarity * (len(left) + len(right) - both)
            yield batch.select(["doc", "other"]).filter(pa.array(good))

    return run


class SuffixStore:
    """Everything accepted so far, on the shared folder: word codes, key tables and suffix arrays, one immutable segment a batch.

    ``add`` takes the next batch and tells its duplicates.  A manifest, written last, names the segments, so a store that
    ``load`` opens later is that of the last batch which was added whole.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, similarity: float = 0.7):
        self.spark, self.folder, self.similarity = spark, folder or scratch_path(spark, "store"), similarity
        self.version, self.bounds = 0, None
        self.texts: list[str] = []
        self.keys: list[str] = []
        self.segments: list[tuple[str, int]] = []  # folder, words

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> SuffixStore:
        """The store that was last written to ``folder``."""
        rows = spark.read.text(f"{folder}/manifest/*")  # one row a batch
        last = max((json.loads(r.value) for r in rows.collect()), key=lambda m: m["version"])
        store = cls(spark, folder, last["similarity"])
        store.version, store.texts, store.keys = last["version"], last["texts"], last["keys"]
        store.bounds = tuple(np.array(b, np.int64) for b in last["bounds"])
        store.segments = [(p, n) for p, n in last["segments"]]
        return store

    def _publish(self) -> None:
        state = {"version": self.version, "similarity": self.similarity, "texts": self.texts, "keys": self.keys, "segments": self.segments, "bounds": [b.tolist() for b in self.bounds]}
        write_text(self.spark, f"{self.folder}/manifest/{self.version}", json.dumps(state))

    def drop(self) -> None:
        drop_path(self.spark, self.folder)

    def add(self, rows: DataFrame) -> DataFrame:
        """Accept the batch ``(doc, text, hash, path)``; ``(doc, dup_kind)`` of its records that an accepted or earlier one of the batch repeats."""
        path = f"{self.folder}/texts/{self.version}"
        encode(rows.withColumn("batch", F.lit(self.version))).write.option("compression", "zstd").parquet(path)
        return self.add_encoded(path)

    def add_encoded(self, path: str, tell: bool = True) -> DataFrame | None:
        """``add`` for a batch that ``encode`` has written to ``path``, which belongs to the store from now on.

        A batch that was accepted elsewhere (the history a store begins with) need not be told its duplicates.
        """
        spark = self.spark
        schema = ", ".join(c for c in _ENCODED.split(", ") if not c.startswith("batch "))
        batch = spark.read.schema(schema).parquet(path)
        size = batch.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.length("codes")) / 4, F.lit(0.0)).alias("words")).first()
        small = 4 * size["rows"] <= BROADCAST_IDS  # no set of records or keys of this batch is larger
        flags = self._repeated(batch, small)
        equal = flags.where("equal").select("doc")
        # of records with equal sets only the first goes into the arrays, so many copies of a text cost no pairs
        fresh = batch.where("n_runs > 0").select("doc", "n_runs", "codes").join(F.broadcast(equal) if small else equal, "doc", "left_anti")
        if self.bounds is None:
            self._place(fresh, size["words"])
        segment = self._write(fresh.mapInArrow(_suffix_rows(self.similarity, self.bounds), _SUFFIX), str(self.version))
        self.texts.append(path)
        near = self._near(segment, [*((p, False) for p, _ in self.segments), (segment, True)], small) if tell else None
        self.segments.append((segment, int(size["words"])))
        named = F.element_at(F.array(*[F.lit(x) for x in ("exact", "near", "path")]), F.col("k"))
        replaced = self._merge()
        self.version += 1
        self._publish()
        for old in replaced:
            drop_path(spark, old)
        free_shuffles(spark)
        if not tell:
            return release(flags)
        kinds = flags.select("doc", F.when(F.col("exact"), 1).when(F.col("equal"), 2).otherwise(3).alias("k")).unionByName(near.select("doc", F.lit(2).alias("k")))
        return kinds.groupBy("doc").agg(F.min("k").alias("k")).select("doc", named.alias("dup_kind"))

    def _repeated(self, batch: DataFrame, small: bool) -> DataFrame:
        """``(doc, exact, equal, moved)`` by keys alone; the batch's keys join the key tables.

        For each key the least earlier record is enough, and for a path also the least whose text is another one, so a key that
        many records hold is aggregated, never sorted in one task.
        """
        spark, path = self.spark, f"{self.folder}/keys/{self.version}"
        kinds = (("t", "text_key"), ("h", "hash_key"), ("s", "set_key"), ("p", "path_key"))
        entries = batch.select("doc", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("key"), (F.col("version") if k == "p" else F.lit(0).cast("bigint")).alias("version")) for k, c in kinds])).alias("e"))
        entries = entries.select("doc", "e.*").where("key IS NOT NULL")
        firsts = entries.groupBy("kind", "key", "version").agg(F.min("doc").alias("doc"))
        firsts.select("kind", "key", "version", "doc").write.option("compression", "zstd").parquet(path)
        schema = "kind string, key binary, version bigint, doc bigint"
        firsts = spark.read.schema(schema).parquet(path)
        # records of earlier batches come before all of this one
        known = firsts
        if self.keys:
            asked = firsts.select("kind", "key").distinct()
            old = spark.read.schema(schema).parquet(*self.keys).join(F.broadcast(asked) if small else asked, ["kind", "key"], "left_semi")
            known = known.unionByName(old.withColumn("doc", F.lit(-(1 << 63)).cast("bigint")))
        self.keys.append(path)
        least = known.groupBy("kind", "key").agg(F.min(F.struct("doc", "version")).alias("first"))
        second = known.where("kind = 'p'").join(least.where("kind = 'p'"), ["kind", "key"]).where("version != first.version").groupBy("kind", "key").agg(F.min("doc").alias("second"))
        seen = entries.join(least.join(second, ["kind", "key"], "left"), ["kind", "key"])
        before = F.col("first.doc") < F.col("doc")
        moved = (F.col("first.version") != F.col("version")) & before | F.coalesce(F.col("second") < F.col("doc"), F.lit(False))
        is_kind = lambda k: F.col("kind") == k
        flags = seen.groupBy("doc").agg(F.bool_or((is_kind("t") | is_kind("h")) & before).alias("exact"), F.bool_or(is_kind("s") & before).alias("equal"), F.bool_or(is_kind("p") & moved).alias("moved"))
        return materialize(flags.where("exact OR equal OR moved"), "flags")

    def _place(self, fresh: DataFrame, n: float) -> None:
        """Set the ranges, once, by the quantiles of a drawn part of the first batch; where they lie does not change any result."""
        drawn = fresh.sample(fraction=min(1.0, DRAWN / max(1.0, n * 0.3)), seed=6).select("doc", "n_runs", "codes").mapInArrow(_suffix_rows(self.similarity, None), _SUFFIX).select("part", "key").limit(2 * DRAWN).toArrow()
        part, key = drawn.column("part").to_numpy(), drawn.column("key").to_numpy()
        bounds = []
        for array in (0, 1):
            some = key[part == array]
            ranges = max(2, int(n * 0.3 * len(some) / max(1, len(key))) // PARTITION + 1) if array == 0 else max(6, int(n * 0.3) // PARTITION + 1)
            bounds.append(np.unique(np.quantile(some, np.arange(1, ranges) / ranges, method="nearest")) if len(some) else np.empty(0, np.int64))
        self.bounds = tuple(bounds)

    @property
    def parts(self) -> int:
        return len(self.bounds[0]) + len(self.bounds[1]) + 2

    def _write(self, rows: DataFrame, name: str) -> str:
        path = f"{self.folder}/segments/{name}"
        rows.repartition(self.parts, "part").sortWithinPartitions("part", "key", "n_runs", "doc").write.option("compression", "zstd").partitionBy("part").parquet(path)
        return path

    def _search(self, asked: str, segments: list[tuple[str, bool]], at_once: int | None, shares: int = 1) -> DataFrame:
        """``(doc, n_runs, other, words)``: words of the asked records covered by matches with others."""
        ranges = self.spark.range(0, self.parts * shares, 1, self.parts * shares)
        found = ranges.mapInArrow(_look_up(asked, segments, len(self.bounds[0]) + 1, self.similarity, at_once, shares), "doc bigint, n_runs int, other bigint, words int")
        return found.groupBy("doc", "n_runs", "other").agg(F.sum("words").alias("words"))

    def _near(self, segment: str, segments: list[tuple[str, bool]], small: bool) -> DataFrame:
        """``(doc)`` of the records of a segment that are similar to an earlier one."""
        spark = self.spark
        needed = F.when(F.col("n_runs") < SMALL, F.col("n_runs") * (self.similarity - 0.02)).otherwise(F.col("n_runs") * COVERED)
        hits = materialize(self._search(segment, segments, AT_ONCE), "hits")
        verified = self._verify(hits.where(F.col("other").isNotNull() & (F.col("words") >= needed)).select("doc", "other"))
        # a record may have a partner behind suffixes with too many hits, if these and its best match seen would cover enough
        seen = hits.groupBy("doc", "n_runs").agg(F.sum(F.when(F.col("other").isNull(), F.col("words"))).alias("behind"), F.max(F.when(F.col("other").isNotNull(), F.col("words"))).alias("best"))
        rest = seen.where(F.col("behind").isNotNull() & (F.col("behind") + F.coalesce("best", F.lit(0)) >= needed)).select("doc")
        rest = rest.join(verified, "doc", "left_anti")
        found = verified
        if not rest.isEmpty():
            rest = materialize(rest, "rest")
            again = self._write(spark.read.schema(_SUFFIX).parquet(segment).join(F.broadcast(rest) if small else rest, "doc", "left_semi"), f"rest-{self.version}")
            full = materialize(self._search(again, segments, None, shares=4), "hits")
            more = self._verify(full.where(F.col("words") >= needed).select("doc", "other"))
            found = materialize(verified.union(more).distinct(), "near")
            release(rest, full, more, verified)
            drop_path(spark, again)
        release(hits)
        return found

    def _verify(self, pairs: DataFrame) -> DataFrame:
        """``(doc)`` of the pairs ``(doc, other)`` that have the similarity, by the stored codes of these records only."""
        spark = self.spark
        pairs = materialize(pairs, "candidates")
        ends = pairs.select("doc").union(pairs.select("other")).distinct()
        codes = spark.read.schema("doc bigint, codes binary").parquet(*self.texts)
        codes = materialize(codes.join(F.broadcast(ends) if 2 * pairs.count() <= BROADCAST_IDS else ends, "doc", "left_semi").dropDuplicates(["doc"]), "codes")
        joined = pairs.join(codes.withColumnRenamed("codes", "a"), "doc").join(codes.select(F.col("doc").alias("other"), F.col("codes").alias("b")), "other")
        out = materialize(joined.select("doc", "other", "a", "b").mapInArrow(_similar(self.similarity), "doc bigint, other bigint").select("doc").distinct(), "near")
        release(pairs, codes)
        return out

    def _merge(self) -> list[str]:
        """Merge the last segments while they are of like size; the folders that are not needed any more."""
        level = lambda n: int(np.log(max(n, 1)) / np.log(FANOUT) + 0.5)
        gone: list[str] = []
        while len(self.segments) >= FANOUT and len({level(n) for _, n in self.segments[-FANOUT:]}) == 1:
            merged, self.segments = self.segments[-FANOUT:], self.segments[:-FANOUT]
            both = reduce(DataFrame.unionByName, [self.spark.read.schema(_SUFFIX).parquet(p) for p, _ in merged])
            self.segments.append((self._write(both, f"{self.version}-merged-{len(gone)}"), sum(n for _, n in merged)))
            gone += [p for p, _ in merged]
        return gone


def duplicates(df: DataFrame, key: str = "doc_id", batch: str = "batch_no", text: str = "text", content_hash: str = "content_hash", path: str = "source_path", similarity: float = 0.7) -> DataFrame:
    """``(doc, dup_kind)`` of every record of batch 1 or later that an earlier one repeats; batches are taken in order.

    Earlier means a lower batch, or the same and a lower key.  'exact': the same non-blank text or the
    same hash; 'near': similarity of the sets of three-word runs; 'path': the same file with another
    text (a null text differs from any text).  Null hashes, paths and texts match nothing; a record without batch belongs
    to the history.  Repeated rows of a key count once.  Of records with equal sets only the first goes into
    the suffix arrays, so many copies of a text cost no pairs.  The texts of all batches are encoded in one pass, then
    each batch is added to a store of its own, which is dropped at the end.
    """
    spark = df.sparkSession
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("doc"), F.coalesce(F.col(batch), F.lit(0)).cast("int").alias("batch"), F.col(text).alias("text"), F.col(content_hash).alias("hash"), F.col(path).alias("path"))
    store = SuffixStore(spark, similarity=similarity)
    staged = f"{store.folder}/texts"
    encode(rows).write.option("compression", "zstd").partitionBy("batch").parquet(staged)
    numbers = sorted(r["batch"] for r in spark.read.schema("batch int").parquet(staged).distinct().collect()) if not rows.isEmpty() else []  # one row a batch
    out = None
    for number in numbers:
        found = store.add_encoded(f"{staged}/batch={number}", tell=number >= 1)
        if found is not None:
            out = found if out is None else out.unionByName(found)
    store.drop()
    return out if out is not None else spark.createDataFrame([], "doc bigint, dup_kind string")
