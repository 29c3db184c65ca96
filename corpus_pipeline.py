"""Documents made ready for training: quality rules, near duplicates, personal data, mixing, packing.

Each stage takes what its predecessor kept. The first drops documents that the learned rules reject, the second
keeps one document of each group of near duplicates (five-word shingles, similarity 0.8), the third replaces
personal data in the texts, the fourth puts the documents in the order that mixes their sources to target
weights, and the last packs ranges of that order into sequences, whose ids ascend with it. The order lies in
the files of the fourth stage, by file name and row of the file.
"""

from pyspark.sql import functions as F

from kickstand.llm import catalog, common
from kickstand.llm import op2_minmax as op2
from kickstand.llm import op3_decision_lists as op3
from kickstand.llm import op6_sanitise as op6
from kickstand.llm import op7_pfair_mixing as op7
from kickstand.llm import op9_packing as op9

#: Text of the documents, next to each other in the order of the schedule, that are packed together.
GROUP_BYTES = op9.GROUP_BYTES


def quality_rules(spark, docs, sf_dir):
    """Documents that neither the base rule nor the rules learned from the labels reject."""
    return op3.keep_good(docs, op3.learn_rules(docs, common.read(spark, sf_dir, "labels")))


def near_dedup(spark, docs, sf_dir):
    """Documents that are the smallest of their component."""
    lost = op2.near_duplicates(docs, width=5).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(lost, "doc_id", "left_anti").select(*docs.columns)


def sanitise(spark, docs, sf_dir):
    """Texts without personal data and the terms that give it away."""
    return op6.sanitise(docs)


def mix_sources(spark, docs, sf_dir):
    """Documents in the order of the schedule that gives every source its target share."""
    return op7.mix(docs, op7.power_weights(docs)).orderBy("slot", "place").select(*docs.columns)


def pack(spark, docs, sf_dir):
    """Pieces of documents in sequences, group by group in the order of the files that the stage before wrote."""
    return op9.pack_in_order(docs, catalog.WORD_VOCABULARY, group_bytes=GROUP_BYTES)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("sanitise", sanitise),
    ("mix_sources", mix_sources),
    ("packing", pack),
]
#: SQL expresses neither the learned rules nor the tokens; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The last stage's rows over the whole documents table; every stage's rows are written once in between."""
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
