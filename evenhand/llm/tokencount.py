"""Token counts through a digest cache.

The cache is a Parquet table (tokenizer digest, content digest, n_tokens). Documents join it on the
digest of their content and of the tokenizer file; only distinct misses are encoded, and their
counts are appended.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, scratch_dir, small_batches, sliced, table

CACHE_SCHEMA = "tokenizer binary, content binary, n_tokens long"
LIMIT = 2048
_LOADED: dict[str, object] = {}


def tokenizer_digest(path: str) -> bytes:
    """Digest of the tokenizer's kind and file: another version never meets stored counts."""
    return hashlib.sha256(Path(path).suffix.encode() + b"\0" + Path(path).read_bytes()).digest()


def counter(path: str):
    """list[str] -> token counts, without begin, end or added special tokens, truncation or padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _LOADED:
        if path.endswith(".model"):
            import sentencepiece

            _LOADED[path] = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.no_truncation()
            t.no_padding()
            _LOADED[path] = t
    t = _LOADED[path]
    if path.endswith(".model"):
        return lambda texts: [len(x) for x in t.encode(texts, num_threads=1)]
    return lambda texts: [len(e) for e in t.encode_batch_fast(texts, add_special_tokens=False)]


def token_counts(docs: DataFrame, path: str, cache_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens per row of docs; counts come from the cache at cache_dir.

    Content is the text itself (null: empty), which is what the tokenizer sees. Repeated rows and
    null ids each get their row; copies are encoded once. An empty table gives no rows and appends
    nothing. Extra columns are ignored. A lost append is only encoded again; two writers at once
    append equal rows, of which one is read.
    """
    spark = docs.sparkSession
    version = tokenizer_digest(path)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(cache_dir)
    known = None
    if jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path):
        known = spark.read.schema(CACHE_SCHEMA).parquet(cache_dir)
    is_ours = F.col("tokenizer") == F.lit(version)
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("content"), text.alias("text"))
    misses = keyed if known is None else keyed.join(known.filter(is_ours), "content", "left_anti")
    distinct = misses.groupBy("content").agg(F.first("text").alias("text"))

    def encode(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = counter(path)
        for pdf in it:
            texts = pdf["text"].tolist()
            n = [c for a, b in sliced(texts) for c in count(texts[a:b])]
            yield pd.DataFrame({"tokenizer": [version] * len(n), "content": pdf["content"], "n_tokens": n})

    distinct.mapInPandas(encode, CACHE_SCHEMA).write.mode("append").parquet(cache_dir)
    stored = spark.read.schema(CACHE_SCHEMA).parquet(cache_dir).filter(is_ours).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
    stored = materialize(stored, "token-counts")  # a written side lets Spark split a hot content in the join below
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("content"), F.octet_length(text).cast("long").alias("n_bytes"))
    return sizes.join(stored, "content").select("doc_id", "n_bytes", "n_tokens")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    cache = scratch_dir(spark, "token-cache")
    counted = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), cache)
    return counted.withColumn("over_limit", F.col("n_tokens") > LIMIT)
