"""A training corpus from ``documents`` in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; a runner
writes it as Parquet and rereads it as the next one's ``docs``. All but the
last return the columns that they were given, in their order, whatever their names.

Every row is a document of its own, also if its doc_id is null or repeated. Stages
take texts of any length whole, and an empty table gives no rows. What each does with
null and empty texts, ties and equal rows is said beside it.
"""

from __future__ import annotations

import uuid

from peerloom.llm import decontam, mixture, ordinal, sharding, simhash
from peerloom.llm.common import shared_folder, table


def quality(spark, docs, sf_dir):
    """Operator 9: rows whose probability of the top grade is below one half go.

    Null and empty texts are rated by the thresholds alone; equal texts share their fate; a probability of one half stays.
    """
    model = ordinal.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return ordinal.keep_good(docs, model)


def near_dups(spark, docs, sf_dir):
    """Operator 4: of each group of texts linked by a cosine of 0.8 of their five-word shingles, one row stays.

    It is the one with the smallest doc_id (null last; ties: the smallest hash of the text); texts without words are one
    group; of rows equal in id and text one stays.
    """
    return simhash.dedup(docs)


def decontaminate(spark, docs, sf_dir):
    """Operator 8: rows in which a benchmark item is found go. Null and empty texts stay; equal texts share their fate."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark, docs, sf_dir):
    """Operator 2: rows are taken, and repeated, as the weight tree's budgets ask.

    Null languages and sources are one child each; null and empty texts have no tokens and come with the prefix in
    whose order they stand; rows equal in id and text are taken together.
    """
    return mixture.mix(docs)


def shard(spark, docs, sf_dir):
    """Operator 3: every row gets a shard and a slot; equal rows get places next to each other in their source's order."""
    return sharding.interleave(docs)


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_dups),
    ("benchmark decontamination", decontaminate),
    ("mixing to target weights", mix),
    ("sharding", shard),
]

#: Fitted weights and fingerprints have no SQL; tests/llm/test_pipeline.py holds the whole run against a plain version.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``; between stages the rows lie as Parquet in the shared checkpoint folder, the last of
    which is left for the result to read."""
    docs, before = table(spark, sf_dir, "documents"), None
    home = shared_folder(spark)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = f"{home}/stage-{k}-{uuid.uuid4().hex}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if before:
                _remove(spark, before)
            before = path
    return docs


def _remove(spark, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
