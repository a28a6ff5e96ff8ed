"""A training-data pipeline over the documents: five stages, each one operator of ``talata.llm``."""

from __future__ import annotations

import hashlib
import json
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talata.llm import decontaminate, langid, packing, shingles, surrogates
from talata.llm.common import materialize, read
from talata.sources.sinks import exists

#: The session's setting with the secret that surrogates are made with.
KEY_SETTING = "spark.talata.surrogates.key"
#: Part of what a kept stage is known by; raised when a stage's results change.
VERSION = 3


def surrogate_key(spark: SparkSession) -> str:
    """The secret of the session. Without one the key of the tests, which anyone can read here, so that is said."""
    key = spark.conf.get(KEY_SETTING, "")
    if not key:
        warnings.warn(f"{KEY_SETTING} is not set: surrogates are made with the tests' key, and anyone can recompute them", stacklevel=3)
    return key or surrogates.TEST_KEY


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: no letter, or no margin between two languages."""
    return langid.accepted(docs, langid.learn(langid.learnable(docs)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: 0.8 or more of their five-word shingles in common.

    SimHash and BK-trees find the candidates, which are then compared exactly.
    """
    return shingles.keep_one_similar(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold an item of ``benchmark``."""
    return decontaminate.clean_documents(docs, read(spark, sf_dir, "benchmark"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data and secrets by surrogates; n_chars follows the new text."""
    out = surrogates.replace_entities(docs, surrogate_key(spark))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of 4096 tokens."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", replace_personal_data),
    ("packing", pack_sequences),
]

#: SQL can't express the compression and packing stages; tests hold them against brute force.
ORACLE_SQL = None


def fingerprint(spark: SparkSession, *tables: DataFrame) -> str:
    """Names, sizes and times of the tables' files, the key, the stages and their version, hashed."""
    jvm, conf, files = spark._jvm, spark._jsc.hadoopConfiguration(), []
    for name in sorted(f for t in tables for f in t.inputFiles()):
        path = jvm.org.apache.hadoop.fs.Path(name)
        status = path.getFileSystem(conf).getFileStatus(path)
        files.append((name, status.getLen(), status.getModificationTime()))
    known = [files, hashlib.sha256(surrogate_key(spark).encode()).hexdigest(), [name for name, _ in STAGES], VERSION]
    return hashlib.sha256(json.dumps(known).encode()).hexdigest()[:24]


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """All stages over ``documents``, each one's result written as Parquet and read again.

    With ``folder``, on storage that driver and executors share, the stages' results are kept there,
    and a run that finds some goes on after the last whole one: a driver that was lost costs one stage.
    Results are known by a fingerprint of the input files, the key and VERSION: those of other inputs
    or keys are not taken.
    """
    docs = read(spark, sf_dir, "documents")
    known = folder and fingerprint(spark, docs, read(spark, sf_dir, "benchmark"))
    for i, (name, stage) in enumerate(STAGES[:-1]):
        if folder is None:
            docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
            continue
        path = f"{folder.rstrip('/')}/{known}/{i}-{name}"
        if not exists(spark, f"{path}/_SUCCESS"):
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.schema(docs.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
