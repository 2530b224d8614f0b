"""From raw documents to token ids: five stages, each one operator over all rows that its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that run() writes and reads back
for the next one. All but the last return the columns of documents. Null and empty texts fail
the quality rules. Rows without an id stay as they are where a stage decides by id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwave.llm import bpe, mixing, quality, simhash, substrings
from slotwave.llm.shared import stored


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go, and lines that too many documents of a source hold.

    Copies count once and the first holder keeps a line, so that a group of copies, which the
    next stage thins out, does not lose all its members here. Rows without an id are judged too;
    of repeated rows all stay or none. Texts of any length are judged whole.
    """
    return quality.clean(docs, by_content=True, first_keeps=True).withColumn("n_chars", F.length("text").cast("long"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that with the smallest id. Shingles of five words, similarity 0.8.

    A similarity of 0.8 leaves some 13 of 64 bits different, where pivot coordinates rule out next
    to nothing: here the pivot tables are applied but discard few pairs. Min-hash bands name the candidates, and
    each link is verified by the exact Jaccard similarity of the two texts' sets of shingles, whatever their length.
    Rows with equal ids stay or go together; rows without an id stay, as do repeated rows of one id.
    """
    found = simhash.near_duplicates(docs, width=5, seeds=(42, 43), similarity=0.8)
    gone = stored(found.where("doc_id <> component_id").select("doc_id").distinct(), "pipeline-copies")
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows that occur earlier go; texts that lose nothing keep their layout, texts left without words go.

    Rows travel whole here, so buckets hold half the text that they hold by default. Of rows with
    equal texts the first keeps its words, in order of id (null last), and the others go; a long
    text is a bucket of its own.
    """
    out = substrings.deduplicate(docs, carry=True, layout=True, bucket_bytes=1 << 22).where("n_removed < n_words or n_words = 0")
    columns = {c: F.col("rest")[c] for c in docs.columns if c != "text"} | {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return out.select(*[columns[c].alias(c) for c in docs.columns])


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for.

    Rows without an id and repeated rows draw each for itself; a null source is one of its own.
    """
    return mixing.mix(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (unsigned 32-bit, little-endian) and the checksum of the bytes that they decode to.

    One row for each row, repeated or without an id; null texts have no tokens, long ones are encoded whole.
    """
    import public_tokenizers

    out = bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("substrings", substring_stage),
    ("mixing", mixing_stage),
    ("encoding", encoding_stage),
]

#: Fingerprints, sketches and token ids have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
