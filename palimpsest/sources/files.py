"""Sources: text files, labelled pairs, alignment corpora, vectors, sharded JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.operators.chunks import segmented

SUFFIXES = (".txt", ".md", ".markdown", ".pdf", ".docx")


def discover(spark: SparkSession, root: str, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """(path, suffix, content) of the files below ``root`` with one of the suffixes, in any letter case; sort by path for the listing order."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "content")
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    return files.withColumn("suffix", suffix).where(F.col("suffix").isin(*[s.lower() for s in suffixes]))


def _decoded(batches):
    """UTF-8 with undecodable bytes left out, which ``decode`` cannot do; segments of PDF and DOCX files."""
    import io

    for frame in batches:
        out = []
        for suffix, content in zip(frame["suffix"], frame["content"]):
            data = bytes(content)
            if suffix == ".pdf":
                try:
                    from pypdf import PdfReader
                except ImportError as exc:
                    raise RuntimeError("PDF files need the optional pypdf package") from exc
                out.append([page.extract_text() or "" for page in PdfReader(io.BytesIO(data)).pages])
            elif suffix == ".docx":
                try:
                    from docx import Document
                except ImportError as exc:
                    raise RuntimeError("DOCX files need the optional python-docx package") from exc
                out.append([p.text for p in Document(io.BytesIO(data)).paragraphs])
            else:
                out.append([data.decode("utf-8", "ignore")])
        yield frame[["path", "suffix"]].assign(parts=out)


def load(spark: SparkSession, root: str, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """(path, file_type, text, segments) of the documents below ``root``; an unsupported suffix in the list is an error."""
    for s in suffixes:
        if s.lower() not in SUFFIXES:
            raise ValueError(f"Unsupported document type: {s or 'none'}")
    parts = discover(spark, root, suffixes).select("path", "suffix", "content").mapInPandas(_decoded, "path string, suffix string, parts array<string>")
    kind = F.when(F.col("suffix") == ".pdf", "page").otherwise("paragraph")
    pages, paras = segmented(F.col("parts"), "page"), segmented(F.col("parts"), "paragraph")
    body = F.when(kind == "page", pages).otherwise(paras)
    return parts.select("path", F.ltrim("suffix", F.lit(".")).alias("file_type"), body.alias("b")).select("path", "file_type", "b.text", "b.segments")


def labelled_pairs_csv(spark: SparkSession, path: str, prefix: str = "plagbench", limit: int | None = None) -> DataFrame:
    """(id, left_text, right_text, label, label_value, metadata) from a CSV with source_doc, susp_doc and label; ids count rows from 0."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
    # one small file per data set: the reader keeps its order in one partition
    rows = raw.withColumn("_k", F.row_number().over(Window.orderBy(F.monotonically_increasing_id())) - 1)
    names = [c for c in ("plagiarism_type", "generation", "genre") if c in raw.columns]
    meta = F.map_filter(F.create_map(*(x for c in names for x in (F.lit(c), F.col(c)))), lambda k, v: v.isNotNull()) if names else F.create_map().cast("map<string,string>")
    out = rows.select("_k", F.concat(F.lit(f"{prefix}:"), F.col("_k").cast("string")).alias("id"), F.col("source_doc").alias("left_text"), F.col("susp_doc").alias("right_text"), (F.lower(F.trim("label")) == "yes").alias("label"), F.lit(None).cast("double").alias("label_value"), meta.alias("metadata"))
    return (out.where(F.col("_k") < limit) if limit is not None else out).drop("_k")


def pairs_from_rows(df: DataFrame, left: str, right: str, label: Column, prefix: str, order: str, scored: bool = False) -> DataFrame:
    """Any table of two texts as labelled pairs: a boolean label, or (``scored``) a value between 0 and 1."""
    k = F.row_number().over(Window.orderBy(order)) - 1
    truth = (F.lit(None).cast("boolean"), label.cast("double")) if scored else (label.cast("boolean"), F.lit(None).cast("double"))
    return df.select(F.concat(F.lit(f"{prefix}:"), k.cast("string")).alias("id"), F.col(left).alias("left_text"), F.col(right).alias("right_text"), truth[0].alias("label"), truth[1].alias("label_value"), F.create_map().cast("map<string,string>").alias("metadata"))


FEATURE = "_name string, _type string, _obfuscation string, _this_offset int, _this_length int, _source_reference string, _source_offset int, _source_length int"


def annotations(spark: SparkSession, glob: str) -> DataFrame:
    """(file, obfuscation, offsets, lengths, source_reference) of the plagiarism features in alignment XML files."""
    found = spark.read.format("xml").option("rowTag", "feature").schema(FEATURE).load(glob)
    named = found.withColumn("file", F.regexp_extract(F.input_file_name(), r"([^/]+)\.xml$", 1)).where(F.col("_name") == "plagiarism")
    return named.select("file", F.col("_obfuscation").alias("obfuscation"), F.col("_this_offset").alias("this_offset"), F.col("_this_length").alias("this_length"), F.col("_source_reference").alias("source_reference"), F.col("_source_offset").alias("source_offset"), F.col("_source_length").alias("source_length"))


def alignment_pairs(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(suspicious, source) from lines of two file names."""
    words = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.trim("value") != "").select(F.try_element_at(words, F.lit(1)).alias("suspicious"), F.try_element_at(words, F.lit(2)).alias("source")).where("source is not null")
    return rows.orderBy("suspicious", "source").limit(limit) if limit is not None else rows


def annotated_documents(spark: SparkSession, root: str) -> DataFrame:
    """(stem, path, text, annotations): suspicious documents with their sibling XML; without one the list is empty."""
    texts = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "suspicious-document*.txt").load(root)
    texts = texts.select(F.regexp_extract("path", r"([^/]+)\.txt$", 1).alias("file"), "path", F.col("content").cast("string").alias("text"))
    xml = annotations(spark, f"{root}/*/*.xml") if _has(spark, f"{root}/*/*.xml") else annotations(spark, f"{root}/*.xml")
    grouped = xml.groupBy("file").agg(F.collect_list(F.struct("this_offset", "this_length", "source_reference", "source_offset", "source_length", "obfuscation")).alias("annotations"))
    return texts.join(grouped, "file", "left").select("file", "path", "text", F.coalesce("annotations", F.array().cast(grouped.schema["annotations"].dataType)).alias("annotations"))


def _has(spark: SparkSession, glob: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(glob)
    return bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path))


def annotated_pairs(documents: DataFrame) -> DataFrame:
    """(file, source_reference, annotations): the annotations of each document by source."""
    rows = documents.select("file", F.explode("annotations").alias("a"))
    return rows.groupBy("file", F.col("a.source_reference").alias("source_reference")).agg(F.sort_array(F.collect_list("a")).alias("annotations"))


VECTOR = "id string, document_id string, chunk_id string, start int, end int, vector array<double>"


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(VECTOR).json(path)


def write_vectors(df: DataFrame, path: str) -> None:
    df.select("chunk_id", "document_id", "end", "id", "start", "vector").write.json(path)


SHARD_LINE = "text string, source string"


def sharded_lines(spark: SparkSession, folder: str, after: tuple[int, int] = (0, 0), prefix: str = "corpus-train") -> DataFrame:
    """(id, shard, line, text, source) of gzipped JSON lines from a cursor on; shards are numbered by sorted file name."""
    raw = spark.read.text(folder).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("k"))
    order = Window.partitionBy("file").orderBy("at", "k")
    lines = raw.withColumn("line", F.row_number().over(order) - 1)
    shards = lines.select("file").distinct().withColumn("shard", F.row_number().over(Window.orderBy("file")) - 1)  # one row for each file
    parsed = lines.join(F.broadcast(shards), "file").select("shard", "line", F.from_json("value", SHARD_LINE).alias("j"))
    wanted = parsed.where((F.col("shard") > after[0]) | ((F.col("shard") == after[0]) & (F.col("line") >= after[1])))
    return wanted.select(F.format_string(f"{prefix}-%05d-%09d", "shard", "line").alias("id"), "shard", "line", "j.text", "j.source")
