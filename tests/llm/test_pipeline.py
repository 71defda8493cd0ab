import random

import public_tokenizers

import corpus_pipeline as cp
from noonward.llm import bpe, quality_rules
from noonward.llm.common import table

WORDS = "the quick brown fox jumps over a lazy dog and runs through wide green fields until night falls on old stone roofs".split()
ITEM = "Which of the old stone roofs fell down into the wide green river when the last night of rain was over and gone?"


def prose(rng, n=90):
    return " ".join(rng.choice(WORDS) + rng.choice("abcdefgh") + rng.choice("abcdefgh") for _ in range(n)) + "."


def test_stages_take_effect(spark, documents, tmp_path):
    rng = random.Random(1)
    texts = {i: prose(rng) for i in range(40)}
    texts |= {100: "BUY NOW!!! " * 60, 101: "too short"}
    texts |= {200: texts[0], 201: texts[1] + " More.", 202: texts[2].replace("the", "The")}
    texts |= {300: prose(rng) + " " + ITEM, 301: prose(rng) + " " + ITEM.upper().replace("DOWN", "DOWNN")}
    texts |= {400: prose(rng) + " Mail me@mail.com or 10.0.0.1 now."}
    docs = documents([*texts.items(), (None, None), (5, texts[5])])
    folder = str(tmp_path)
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs.write.parquet(f"{folder}/documents.parquet")
    rows = {r.doc_id: r for r in cp.run(spark, folder).collect()}
    assert sorted(rows) == [*range(40), 400]
    ranks = bpe.ranks_at(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    import numpy as np

    decoded = {i: ranks.decode_flat(np.array(r.ids, np.int64))[0].tobytes().decode() for i, r in rows.items()}
    assert decoded[3] == texts[3] and all(r.decodes and r.n_tokens == len(r.ids) for r in rows.values())
    assert decoded[400][-26:] == " Mail [EMAIL] or [IP] now."


def test_stages_return_the_columns_of_documents(spark, documents, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = documents([])
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, docs.withColumnRenamed("lang", "lang"), str(tmp_path))
        assert out.dtypes == docs.dtypes and out.count() == 0
    assert cp.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 0


def test_quality_keeps_what_the_rules_keep(spark, data_folder):
    docs = table(spark, data_folder, "documents")
    kept = {r[0] for r in cp.quality(spark, docs, data_folder).select("doc_id").collect()}
    judged = quality_rules.judge(quality_rules.measure(docs).drop("text")).collect()
    assert kept == {r.doc_id for r in judged if r.kept} and 0.7 * len(judged) < len(kept) < len(judged)
