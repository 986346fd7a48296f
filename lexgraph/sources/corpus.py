"""Corpus files: scan one directory level, route by type, decode to text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Extension -> file type (the converter branches).
FILE_TYPES = {"txt": "text", "pdf": "pdf", "md": "markdown", "docx": "docx"}
BINARY_SCHEMA = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()),
    T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])


def scan_corpus(spark: SparkSession, directory: str, glob: str = "*") -> DataFrame:
    """Every file directly in ``directory`` (not recursive): path, content, filename."""
    df = (spark.read.format("binaryFile").option("recursiveFileLookup", "false")
          .option("pathGlobFilter", glob).load(directory))
    return with_filename(df)


def with_filename(df: DataFrame, path_col: str = "path") -> DataFrame:
    return df.withColumn("filename", F.regexp_extract(F.col(path_col), r"[^/]+$", 0))


def route_files(df: DataFrame, path_col: str = "path") -> DataFrame:
    """+ file_type from the extension (NULL: unknown type)."""
    ext = F.lower(F.regexp_extract(F.col(path_col), r"\.([^./]+)$", 1))
    m = F.create_map(*[x for k, v in FILE_TYPES.items() for x in (F.lit(k), F.lit(v))])
    return df.withColumn("file_type", F.try_element_at(m, ext))


# a code span, a bare address, or text up to the next of these
_MARKDOWN_PIECES = r"(?s)`+[^`]*`+|https?://[^\s)>\]]+|.+?(?=`+[^`]*`+|https?://|\z)"


def _without_emphasis(c):
    """Paired marks go where a word border is outside and no blank inside; the
    signs of ``snake_case`` and ``2*3*4`` are no such marks.  Widest marks first."""
    for mark in (r"\*\*\*", r"___", r"\*\*", r"__", r"\*", r"_"):
        c = F.regexp_replace(c, rf"(?<![\w*_]){mark}(?=[^\s*_])((?:[^\n]|\n(?!\n))*?[^\s*_]){mark}(?![\w*_])", "$1")
    return c


def strip_markdown(col):
    """Markdown marks removed: headings, emphasis, code marks, links/images
    to their text, list bullets, block quotes.  What is inside code and addresses stays."""
    c = F.col(col) if isinstance(col, str) else col
    c = F.regexp_replace(c, r"!?\[([^\]]*)\]\([^)]*\)", "$1")
    c = F.regexp_replace(c, r"(?m)^\s{0,3}#{1,6}\s+", "")
    c = F.regexp_replace(c, r"(?m)^\s{0,3}>\s?", "")
    c = F.regexp_replace(c, r"(?m)^[ \t]*[-*+][ \t]+", "")
    pieces = F.regexp_extract_all(c, F.lit(_MARKDOWN_PIECES), 0)
    plain = F.transform(pieces, lambda p: F.when(p.startswith("`"), F.regexp_replace(p, "^`+|`+$", ""))
                        .when(p.rlike("^https?://"), p).otherwise(_without_emphasis(p)))
    return F.array_join(plain, "")


def to_text(df: DataFrame, converters: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, quarantine).  Text and markdown are decoded as UTF-8 on the
    JVM; other types need a converter hook (K4); anything left without text,
    files that are not valid UTF-8 among them, goes to quarantine."""
    # NULL where the bytes are not UTF-8: one bad file must not stop the job
    plain = F.try_validate_utf8(F.col("content").cast("string"))
    d = df.withColumn("text", F.when(F.col("file_type") == "text", plain)
                      .when(F.col("file_type") == "markdown", strip_markdown(plain)))
    if converters:
        from lexgraph.functions.hooks import convert_files
        d = convert_files(d, converters)
    ok = d.filter(F.col("text").isNotNull())
    bad = d.filter(F.col("text").isNull()).select("path", "filename", "file_type")
    return ok, bad


def files_as_documents(docs: DataFrame) -> DataFrame:
    """Give scanned files a stable numeric ``doc_id`` (xxhash64 of the path)."""
    return docs.withColumn("doc_id", F.xxhash64("path"))
