"""Incremental ingestion as a stream: each micro-batch of documents is one write and one rebuild of the index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from rivulet.operators import chunking, ingest, lexical
from rivulet.session import write_text


class Catalogue:
    """Documents, chunks and index in one folder, in versions: ``apply`` makes the next one from a batch of documents.

    A batch is ``(document_id, source_path, text)``.  Documents whose digest is unchanged are skipped; the chunks of changed ones are replaced;
    whatever a batch writes, the index is rebuilt once, from the postings of the old version and the new texts alone.  A batch number
    that was applied already changes nothing, so a stream that repeats a batch after a failure stays exact.
    """

    def __init__(self, spark: SparkSession, folder: str, **how):
        self.spark, self.folder, self.how = spark, folder, how

    def version(self) -> int:
        return lexical._latest(self.spark, self.folder)

    def documents(self) -> DataFrame:
        n = self.version()
        return self.spark.read.parquet(f"{self.folder}/documents/{n}") if n >= 0 else self.spark.createDataFrame([], "document_id string, source_path string, digest string")

    def chunks(self) -> DataFrame:
        n = self.version()
        return self.spark.read.parquet(f"{self.folder}/chunks/{n}") if n >= 0 else self.spark.createDataFrame([], "chunk_id string, document_id string, chunk_index bigint, text string")

    def runs(self) -> DataFrame:
        """``(batch, document_id, status, chunks_added)``: what each batch did with each document."""
        return self.spark.read.schema("batch bigint, document_id string, status string, chunks_added bigint").parquet(f"{self.folder}/runs/*")

    def index(self) -> lexical.LexicalIndex:
        n = self.version()
        return lexical.LexicalIndex(*[self.spark.read.parquet(f"{self.folder}/index/{n}/{t}") for t in lexical._TABLES])

    def apply(self, batch: DataFrame, number: int) -> None:
        before = self.version()
        if number <= before:
            return
        old_documents, old_chunks = self.documents(), self.chunks()
        arriving = batch.where("source_path IS NOT NULL").select(F.col("document_id").cast("string").alias("document_id"), "source_path", "text", F.sha2("text", 256).alias("digest"))
        # of one file's rows in a batch, the last by id counts
        arriving = ingest.latest(arriving, ["source_path"], [F.desc("document_id")])
        judged = ingest.ingest_status(arriving, old_documents)
        fresh = judged.where("status != 'unchanged'")
        made = chunking.chunk_documents(fresh.select("document_id", "text"), **self.how)
        new_chunks = made.select(F.concat_ws("#", "document_id", "chunk_index").alias("chunk_id"), "document_id", "chunk_index", "text")
        # a changed file may have come under another id
        replaced = old_documents.join(fresh.select("source_path"), "source_path", "left_semi").select("document_id").distinct()
        kept = old_chunks.join(replaced, "document_id", "left_anti")
        path = f"{self.folder}/chunks/{number}"
        kept.unionByName(new_chunks).write.mode("overwrite").parquet(path)
        stored = self.spark.read.parquet(path)
        old_documents.join(fresh.select("source_path"), "source_path", "left_anti").unionByName(fresh.select("document_id", "source_path", "digest")).write.mode("overwrite").parquet(f"{self.folder}/documents/{number}")
        added = stored.join(fresh.select("document_id"), "document_id", "left_semi")
        if before < 0:
            index = lexical.build_index(stored)
        else:
            gone = old_chunks.join(replaced, "document_id", "left_semi").select("chunk_id")
            index = lexical.with_added(lexical.without(self.index(), gone), added)
        for name in lexical._TABLES:
            getattr(index, name).write.mode("overwrite").parquet(f"{self.folder}/index/{number}/{name}")
        counts = added.groupBy("document_id").agg(F.count("*").alias("n"))
        runs = judged.join(counts, "document_id", "left").select(F.lit(number).cast("bigint").alias("batch"), "document_id", "status", F.coalesce("n", F.lit(0)).alias("chunks_added"))
        runs.write.mode("overwrite").parquet(f"{self.folder}/runs/{number}")
        write_text(self.spark, f"{self.folder}/manifest-{number}", "")


def ingest_stream(documents: DataFrame, catalogue: Catalogue, checkpoint: str) -> DataStreamWriter:
    """A writer that applies each micro-batch of a stream ``(document_id, source_path, text)`` to the catalogue; start it with ``start()``."""
    return documents.writeStream.foreachBatch(catalogue.apply).option("checkpointLocation", checkpoint)
