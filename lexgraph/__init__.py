"""lexgraph: text-corpus analytics as Spark DataFrame operators.

Every public operator is a function ``DataFrame -> DataFrame`` whose work runs
on executors.  Sub-packages:

* ``functions``  column expressions (text, vectors, deterministic hashing)
* ``sources``    corpus files, driver tables, the parquet store
* ``operators``  chunking, embedding, vector search, clustering, keywords,
                 text graph, keyword graph, HTML extraction
* ``plans``      end-to-end jobs built from the operators
* ``streaming``  incremental ingest with Structured Streaming
"""

from lexgraph.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
