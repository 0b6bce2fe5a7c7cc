"""Token counts from a digest cache.

The cache is a Parquet table of (tokenizer digest, content digest, count).  A
run digests every text, finds the distinct digests that the cache lacks, encodes
one text for each of them (word by word where the tokenizer cuts words first, see
``tokens.Counter``), appends the counts, and joins the cache to the
documents.  The content is normalised by trimming ASCII blanks at both ends,
which a tokenizer that drops white space cannot see; pass ``trim=False`` for
others.  The tokenizer digest covers the file and the library's version.

One text per digest is picked by a partial aggregate before the shuffle, so
copies of a hot text fold together in their own tasks.  Readers take the largest
count per digest, so two runs that append the same miss do no harm, and a run
that fails before its commit appends nothing.

Edge cases: texts are counted whole, very long ones in pieces that end at blanks; a null text is empty (0 bytes, 0 tokens); repeated rows each get a
row; an empty table appends nothing; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casediff.session import scratch_path

from .common import digest128, table, text_or_empty
from .tokens import Counter, path_of

TOKENIZER, LIMIT = "word_bpe_49k.json", 2048
#: Parts into which the rows of one digest are split when counts are joined to them.
SALTS = 8
CACHE = "tokenizer binary, digest binary, n_tokens bigint"


def tokenizer_digest(tokenizer: str = TOKENIZER) -> bytes:
    import tokenizers
    with open(path_of(tokenizer), "rb") as f:
        return hashlib.sha256(f.read() + tokenizers.__version__.encode()).digest()[:16]


def open_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache at ``path``; an empty one is written where there is none yet."""
    try:
        return spark.read.schema(CACHE).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
    spark.createDataFrame([], CACHE).write.mode("append").parquet(path)
    return spark.read.schema(CACHE).parquet(path)


def add_misses(texts: DataFrame, cache_path: str, tokenizer: str = TOKENIZER) -> None:
    """Encode the texts ``t`` whose ``digest`` the cache lacks, once each, and append their counts."""
    spark, version = texts.sparkSession, tokenizer_digest(tokenizer)
    known = open_cache(spark, cache_path).where(F.col("tokenizer") == F.lit(version)).select("digest")

    def count(batches):
        counter = Counter(tokenizer)
        for b in batches:
            n = [counter(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([version] * len(n), pa.binary()), b.column(0), pa.array(n, pa.int64())],
                names=["tokenizer", "digest", "n_tokens"])

    once = texts.groupBy("digest").agg(F.first("t").alias("t")).join(known, "digest", "left_anti")
    once.select("digest", "t").mapInArrow(count, CACHE).write.mode("append").parquet(cache_path)


def count_tokens(docs: DataFrame, cache_path: str, tokenizer: str = TOKENIZER, limit: int = LIMIT,
                 id_col: str = "doc_id", text: str = "text", trim: bool = True) -> DataFrame:
    """One row per document: id, ``n_bytes``, ``n_tokens``, ``over_limit``."""
    t = text_or_empty(text)
    norm = F.trim(t, F.lit(" \t\n\r\x0b\x0c")) if trim else t
    add_misses(docs.select(norm.alias("t")).withColumn("digest", digest128(F.col("t"))).select("digest", "t"),
               cache_path, tokenizer)
    version = tokenizer_digest(tokenizer)
    known = (open_cache(docs.sparkSession, cache_path).where(F.col("tokenizer") == F.lit(version))
             .groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")))
    # Documents are salted, so copies of a hot text meet its one row in several tasks.
    known = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    d = docs.select(F.col(id_col).alias("id"), F.octet_length(t).cast("bigint").alias("n_bytes"),
                    digest128(norm).alias("digest"))
    d = d.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    return d.join(known, ["digest", "salt"], "left").select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op5(spark, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), scratch_path(spark, "token-cache"))
