"""Cleans, deduplicates, mixes and encodes a document table.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame that
is written and read again as the next one's docs. All but the last return the columns of documents.
"""

import public_tokenizers
from pyspark.sql import functions as F

from lidarlake.llm import bpe, jaccard_join, langid, line_dedup, mixing
from lidarlake.session import materialize, ship_package

#: Parity sketches, word counts and Python workers have no SQL form: tests hold run() against plain code.
ORACLE_SQL = None


def _counted(docs):
    """Bring n_chars up to date with the text."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def language_id(spark, docs, sf_dir):
    """Rejects documents without a recognisable language; fills in a missing language.

    Null, empty and letterless texts are rejected; repeated rows are judged alike; an empty table stays empty.
    """
    ship_package(spark)
    sample = langid.labelled_sample(docs)
    names = ("_stage_lang", "_stage_score")
    marked = langid.predict_language(docs, sample, names=names).where(F.col(names[0]) != langid.UNKNOWN)
    filled = F.coalesce("lang", names[0]).alias("lang")
    return marked.select(*[filled if c == "lang" else c for c in docs.columns])


def repeated_lines(spark, docs, sf_dir):
    """Drops lines that an earlier document holds; a document left without lines keeps an empty text.

    A null text counts as empty; rows of one doc_id are one holder and keep the same lines; a null doc_id comes last.
    """
    ship_package(spark)
    return _counted(line_dedup.drop_repeated_lines(docs).select(*docs.columns))


def near_duplicates(spark, docs, sf_dir):
    """Keeps the document with the least id of each group linked by similarity (all rows of that id).

    Texts without words are linked with nothing and stay; rows with a null doc_id are one document, after all others.
    """
    ship_package(spark)
    groups = jaccard_join.similarity_components(docs.select("doc_id", "text"))
    name = "first_" + max(docs.columns, key=len)  # longer than any column of the table
    first = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(first, F.col("doc_id").eqNullSafe(F.col(name)), "left_semi")


def source_mix(spark, docs, sf_dir):
    """Takes whole documents by finish time, some up to three times, each source ending nearest to its share of the words.

    Texts without words are not taken; null sources are one source; ties of an id are settled by size and a hash of the text.
    """
    ship_package(spark)
    return _counted(mixing.mixed_documents(docs, whole=True))


def token_ids(spark, docs, sf_dir):
    """Per document of the mix: doc_id, source, n_tokens, ids, and digests of the ids and the decoded text."""
    ship_package(spark)
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    rows = bpe.round_trip(docs.select("doc_id", "source", "text"), tokenizer)
    return rows.select("doc_id", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language ID", language_id),
    ("line dedup", repeated_lines),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", source_mix),
    ("BPE encoding and decoding", token_ids),
]


def run(spark, sf_dir):
    """The result of all stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
