"""Incremental ingest of new corpus files (J1) and embedding of only the new
chunks (J2).

``readStream.format("binaryFile")`` lists the folder; the file source's
checkpoint remembers which files were seen, so a rerun reads only new ones.
Each micro-batch routes, decodes and chunks its files.  All it writes -- new
chunks, files that give no text (``quarantine``), and with ``embed`` the document
frequencies of what was not counted yet, the names of those chunks, and the
vectors of all chunks without one -- is one epoch of the store: it counts when
its manifest is written, last.  A batch that stops anywhere before leaves nothing
that counts, and its rerun writes the same; a batch that is repeated after
its manifest writes nothing.  Vectors carry the epoch of the vocabulary that they
were made with; existing vectors are left as they are, like
``update_existing_embeddings=False``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgraph.operators.chunk import chunk_documents
from lexgraph.operators.embed import corpus_vocab, embed_text
from lexgraph.session import persist_step
from lexgraph.sources import store as ST
from lexgraph.sources.corpus import BINARY_SCHEMA, files_as_documents, route_files, to_text, with_filename


def _process(spark: SparkSession, batch: DataFrame, root: str, tag: str, length: int, embed: bool, dim: int,
             converters: dict | None, source: str, number: int):
    epoch = ST.Epoch(spark, root, tag, source, number)
    if epoch.done:
        return
    files = route_files(with_filename(batch))
    docs, quarantine = to_text(files, converters)
    fresh = ST.new_chunks(chunk_documents(files_as_documents(docs), length=length), root, tag)
    known = ST.open_store(spark, root, tag, "quarantine").select("path")
    epoch.write(quarantine.dropDuplicates(["path"]).join(known, "path", "left_anti"), "quarantine")
    epoch.write(fresh, "chunks")
    if embed:
        stored = ST.open_store(spark, root, tag, "chunks").drop("tag").unionByName(fresh.select(*[c.split()[0] for c in ST.SCHEMAS["chunks"].split(", ")]))
        counted = ST.open_store(spark, root, tag, "counted").select("chunk_id")
        uncounted = persist_step(stored.join(counted, "chunk_id", "left_anti"))
        more = persist_step(corpus_vocab(uncounted))
        epoch.write(more, "vocab")
        epoch.write(uncounted, "counted")
        vocab = ST.vocabulary(spark, root, tag).unionByName(more).groupBy("token").agg(F.sum("df").cast("long").alias("df"))
        have = ST.open_store(spark, root, tag, "embeddings").select(F.col("id").alias("chunk_id"))
        without = stored.join(have, "chunk_id", "left_anti")
        emb = embed_text(without, id_col="chunk_id", dim=dim, vocab=vocab, n_docs=stored.count())
        epoch.write(emb.withColumn("vocab_epoch", F.lit(epoch.number).cast("long")), "embeddings")
    epoch.commit()


def ingest_available(spark: SparkSession, source_dir: str, root: str, tag: str, checkpoint: str,
                     length: int = 250, embed: bool = False, dim: int = 64, converters: dict | None = None,
                     glob: str = "*"):
    """Process every file not seen before, then stop (trigger availableNow)."""
    stream = (spark.readStream.format("binaryFile").schema(BINARY_SCHEMA)
              .option("recursiveFileLookup", "false").option("pathGlobFilter", glob).load(source_dir))

    def batch(df, epoch_id):
        _process(spark, df, root, tag, length, embed, dim, converters, checkpoint, epoch_id)

    q = (stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q
