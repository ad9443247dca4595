"""A corpus from documents: language, near-duplicates, personal data, mixture, packed sequences.

Stages take tables of any columns besides doc_id, text, lang and source (whose names may clash with nothing: a row travels as
one column), empty tables included, and give all of them back, but for the last.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from timberline.llm.common import materialize, read_table, whole_row
from timberline.llm.langid import UNKNOWN, identify, learnable, train
from timberline.llm.mixing import mixed_documents
from timberline.llm.packing import default_tokenizer, pack_documents
from timberline.llm.pii import redact
from timberline.llm.simhash import keep_one


def language(spark, docs, sf_dir):
    """Drops documents without a language: null texts, texts without letters, and texts that no language has at even odds.

    Decides by each whole text, however long; equal texts and repeated rows fare alike. Rows with a null doc_id or lang don't
    teach. Without any lang all rows go."""
    got = identify(docs.select("text", whole_row(docs)), train(docs, learnable(F.col("doc_id"))), ["text", "_doc"])
    return got.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= 0.5)).select("_doc.*")


def near_duplicates(spark, docs, sf_dir):
    """Keeps one document of each component of near-duplicates: that of the smallest doc_id (null first), of equal ids that of
    the smallest text hash, then of the smallest other columns.

    Repeated rows are one component. Texts that are null, empty or white space are one too, should any reach this stage."""
    return keep_one(docs)


def personal_data(spark, docs, sf_dir):
    """Replaces personal spans by their kinds. All rows stay, in their number; null and empty texts as they are; n_chars follows
    the text."""
    return redact(docs)


def mixture(spark, docs, sf_dir):
    """Repeats, drops and, at a source's end, cuts documents, so that sources have their target weights.

    A null source is a source, the last. Rows without words (null, empty) leave; a repeated row counts as often as it stands."""
    return mixed_documents(docs)


def packing(spark, docs, sf_dir):
    """Sequences of tokens: their pieces, with ids. A null or empty text is the end mark alone; rows that repeat a document are
    packed each; an empty table gives no pieces."""
    return pack_documents(docs, default_tokenizer(), with_ids=True)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixture", mixture), ("packing", packing)]
#: Hashes, trees and tokenizers are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The stages in turn, each written to the shared folder and read by the next."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
