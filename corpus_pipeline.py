"""From raw documents to token ids: quality rules, near copies, benchmark passages, personal data, encoding.

Every stage takes (spark, docs, sf_dir) and returns a table; `run` writes each to the shared folder and reads it
again for the next. All but the last return the columns of documents.
"""

import public_tokenizers
from pyspark.sql import functions as F

from noonward.llm import bpe, decontaminate, jaccard_join, pii, quality_rules
from noonward.llm.common import table
from noonward.session import discard, store

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: The detectors and the models they fit have no counterpart in SQL; the tests compare with brute force.
ORACLE_SQL = None


def quality(spark, docs, sf_dir):
    """Documents that the rules let pass.

    Missing and empty texts fail the rule on words and go; repeated rows are judged alike. Columns other than those of
    documents end here.
    """
    judged = quality_rules.judge(quality_rules.measure(docs.select(COLUMNS)))
    return judged.filter("kept").select(COLUMNS)


def near_copies(spark, docs, sf_dir):
    """One document of each group that is linked by five-word shingles at a similarity of 0.8: the least doc_id.

    Documents that no group has, those without words or doc_id, stay; so do different texts under one doc_id that are
    not linked. Of repeated rows one stays.
    """
    return jaccard_join.one_of_each(docs.select(COLUMNS))


def benchmark_passages(spark, docs, sf_dir):
    """Documents that hold no item of the benchmark; missing and empty texts hold none and stay, repeated rows too."""
    found = decontaminate.with_leaks(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"))
    return found.filter(F.size("leaks") == 0).select(COLUMNS)


def personal_data(spark, docs, sf_dir):
    """Documents with personal data replaced by its kind; n_chars follows the text.

    Every row stays: missing and empty texts as they are, repeated rows alike.
    """
    found = pii.find_spans(pii.detect(docs.select(COLUMNS)))
    clean = found.withColumn("text", pii.redacted("text"))
    changed = F.when(F.size("spans") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return clean.withColumn("n_chars", changed.cast("long")).select(COLUMNS)


def encoding(spark, docs, sf_dir):
    """Token ids of each document, and whether they decode to its text; a missing text counts as empty, without ids."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    made = bpe.encode_and_decode(docs, ranks, public_tokenizers.PATTERN)
    same = F.decode("decoded", "UTF-8") == F.coalesce("text", F.lit(""))
    return made.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), same.alias("decodes"))


STAGES = [
    ("quality_rules", quality),
    ("near_copies", near_copies),
    ("benchmark_decontamination", benchmark_passages),
    ("personal_data", personal_data),
    ("byte_bpe", encoding),
]


def run(spark, sf_dir):
    """The stages one after the other; what a stage has read is deleted when its own table is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir))
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
