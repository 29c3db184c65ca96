"""The registered query of each operator, with production parameters over its whole table, and its SQL."""

import public_tokenizers
from pyspark.sql import functions as F

from kickstand.llm import common
from kickstand.llm import op1_run_dedup as op1
from kickstand.llm import op2_minmax as op2
from kickstand.llm import op3_decision_lists as op3
from kickstand.llm import op4_perspectives as op4
from kickstand.llm import op5_token_files as op5
from kickstand.llm import op6_sanitise as op6
from kickstand.llm import op7_pfair_mixing as op7
from kickstand.llm import op8_pivot_distance as op8
from kickstand.llm import op9_packing as op9
from kickstand.llm import op10_tag_paths as op10
from kickstand.llm import op11_maxent as op11
from kickstand.llm import op12_repair as op12
from kickstand.llm import op13_collocations as op13

BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def op1_run_dedup(spark, sf_dir):
    out = op1.remove_repeats(common.read(spark, sf_dir, "documents"))
    return out.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


def op2_minmax(spark, sf_dir):
    return op2.near_duplicates(common.read(spark, sf_dir, "documents"))


def op3_decision_lists(spark, sf_dir):
    docs = common.read(spark, sf_dir, "documents")
    rules = op3.learn_rules(docs, common.read(spark, sf_dir, "labels"))
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
    return op3.judge(docs.select("doc_id", "text"), rules).select(*columns)


def op4_perspectives(spark, sf_dir):
    mask = F.transform("mask", lambda s: F.concat_ws(":", s["start"], s["end"]))
    return op4.rotate(common.read(spark, sf_dir, "conversations")).withColumn("mask", F.array_join(mask, ","))


def op5_token_files(spark, sf_dir):
    return op5.read_tokens(op5.write_tokens(common.read(spark, sf_dir, "documents"), BYTE_VOCABULARY))


def op6_sanitise(spark, sf_dir):
    found = op6.find(common.read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        *[op6.count_of("base", kind).alias(f"n_{kind}") for kind in op6.KINDS],
        F.sha2(op6.listed("base"), 256).alias("base_sha256"),
        op6.listed("spans").alias("spans"),
    )


def op7_pfair_mixing(spark, sf_dir):
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "source")
    return op7.mix(docs, op7.power_weights(docs))


def op8_pivot_distance(spark, sf_dir):
    return op8.search(common.read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op9_packing(spark, sf_dir):
    return op9.pack_documents(common.read(spark, sf_dir, "documents"), WORD_VOCABULARY)


def op10_tag_paths(spark, sf_dir):
    return op10.extract(common.read(spark, sf_dir, "pages"))


def op11_maxent(spark, sf_dir):
    return op11.score(common.read(spark, sf_dir, "documents"))


def op12_repair(spark, sf_dir):
    return op12.repair_damaged(common.read(spark, sf_dir, "conversations"))


def op13_collocations(spark, sf_dir):
    return op13.collocations(common.read(spark, sf_dir, "documents"))


QUERIES = (
    op1_run_dedup,
    op2_minmax,
    op3_decision_lists,
    op4_perspectives,
    op5_token_files,
    op6_sanitise,
    op7_pfair_mixing,
    op8_pivot_distance,
    op9_packing,
    op10_tag_paths,
    op11_maxent,
    op12_repair,
    op13_collocations,
)


def queries():
    return {q.__name__: q for q in QUERIES}


def oracle_sql():
    return {"op4_perspectives": op4.SQL, "op8_pivot_distance": op8.SQL, "op13_collocations": op13.SQL}
