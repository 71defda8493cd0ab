"""Token counts with a digest cache.

A text is known by the digest of its normalised content, and a tokenizer by the digest of its definition. The
cache is a Parquet table of (tokenizer, digest, n_tokens). Counting joins the texts' digests to it, encodes each
distinct text that it lacks once, appends these counts, and joins them back.

The tokenizer's file is read by the workers from `tokenizer_path`, the same place on every machine.
"""

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from noonward.llm.bpe import per_text_sums, split_batch
from noonward.llm.common import slices, unused, without

CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens long"


@lru_cache(maxsize=4)
def tokenizer_at(path: str) -> Tokenizer:
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def tokenizer_version(path: str) -> str:
    """The digest of a tokenizer's definition; another file, or another version of it, has counts of its own."""
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


def content_digest(text) -> F.Column:
    """The digest of a text, a missing one taken as empty.

    Byte-level vocabularies see every character, so that normalising may change none of them.
    """
    return F.unhex(F.sha2(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), 256))


def count_tokens(texts: list[str], path: str, pattern: str) -> np.ndarray:
    """Tokens of each whole text as the library counts them, without begin or end.

    The library cuts texts by `pattern` before it merges, so each distinct match of the batch is encoded once.
    A text that holds an added token's string (special ones included) goes to the library as it is.
    """
    tokenizer = tokenizer_at(path)
    added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    whole = [i for i, t in enumerate(texts) if any(a in t for a in added)]
    plain = [t for i, t in enumerate(texts) if i not in set(whole)] if whole else texts
    pieces, which, per_text = split_batch(plain, pattern)
    sizes = np.array([len(e) for e in tokenizer.encode_batch_fast(pieces, add_special_tokens=False)], np.int64)
    counts = np.zeros(len(texts), np.int64)
    is_plain = np.ones(len(texts), bool)
    is_plain[whole] = False
    counts[is_plain] = per_text_sums(sizes[which], per_text)
    for i in whole:
        counts[i] = len(tokenizer.encode(texts[i], add_special_tokens=False))
    return counts


def read_cache(spark, cache: str) -> DataFrame:
    """The cache; empty where nothing was written yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(cache)


def encode_misses(docs: DataFrame, known: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """(digest, n_tokens) of the distinct texts of `docs` whose digest is not in `known`."""
    digest = content_digest(text).alias("digest")
    texts = docs.select(digest, F.coalesce(F.col(text), F.lit("")).alias("text"))
    missing = texts.join(known.select("digest"), "digest", "left_anti").groupBy("digest").agg(F.first("text").alias("text"))

    def run(batches):
        for batch, part in slices(batches, "text"):
            counts = pa.array(count_tokens(part, path, pattern), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("digest"), counts], names=["digest", "n_tokens"])

    return missing.mapInArrow(run, "digest binary, n_tokens long")


def token_counts(docs: DataFrame, tokenizer_path: str, pattern: str, cache: str, text: str = "text") -> DataFrame:
    """`docs` with n_bytes (UTF-8) and n_tokens of each whole text, by way of the cache at `cache`.

    A missing text counts as empty (0 bytes, 0 tokens). Repeated texts are encoded once and each row keeps its
    place in the result. Columns called n_bytes or n_tokens are replaced. Counts are appended before they are
    used, so a second call finds all of them; if a writer is ended half-way, its files are not committed and the
    next call encodes the same misses again. Two calls at once may store a count twice, which is the same count.
    """
    spark, version = docs.sparkSession, tokenizer_version(tokenizer_path)

    def stored():
        own = read_cache(spark, cache).filter(F.col("tokenizer") == version)
        return own.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    misses = encode_misses(docs, stored(), tokenizer_path, pattern, text)
    misses.select(F.lit(version).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache)
    out = without(docs, "n_bytes", "n_tokens")
    key = unused(out, "_digest")
    counts = stored().select(F.col("digest").alias(key), "n_tokens")
    sized = out.withColumns({"n_bytes": F.coalesce(F.octet_length(text), F.lit(0)).cast("long"), key: content_digest(text)})
    return sized.join(counts, key, "left").select(*out.columns, "n_bytes", "n_tokens")
