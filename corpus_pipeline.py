"""The corpus pipeline: quality, exact copies, near copies, packing.

Each stage takes ``(spark, docs, sf_dir)``, works on all documents that the stage before kept, and returns those that
it keeps with the columns of ``documents``; the last returns where every piece of every document goes.  Every stage is
written to the shared folder and read again, so a lost executor costs no more than the running stage.

SQL cannot express a trained classifier and a tokenizer, so ORACLE_SQL is None; `tests/llm/test_pipeline.py`
holds every stage against brute force.
"""

import public_tokenizers

from demandlens.llm.common import read_table, written
from demandlens.llm.exact import keep_first
from demandlens.llm.ngrams import keep_smallest
from demandlens.llm.packing import pack
from demandlens.llm.quality import keep_good

#: Near copies: shingles of so many words, and the least Jaccard similarity in hundredths.
NEAR_WORDS, NEAR_HUNDREDTHS = 5, 80


def quality(spark, docs, sf_dir):
    """Documents that the quality classifier does not reject; nulls and empty texts score the share of good ones.

    Rows that repeat an id are each judged by their own text.  No documents give none.
    """
    return keep_good(docs, read_table(spark, sf_dir, "labels"))


def exact(spark, docs, sf_dir):
    """The document with the smallest id of each group of texts that are equal but for white space.

    A null text counts as empty, and a null id stays only where its group has no other.  No documents give none.
    """
    return keep_first(docs)


def near(spark, docs, sf_dir):
    """The document with the smallest id of each group that near copies connect.

    Texts without words are near to nothing and stay, and so do rows without an id.  No documents give none.
    """
    return keep_smallest(docs, words=NEAR_WORDS, num=NEAR_HUNDREDTHS, den=100)


def packing(spark, docs, sf_dir):
    """Where every piece of every document goes in sequences of 1024 tokens.

    A null or empty text is an end alone; rows that repeat an id are packed each.  No documents give no pieces.
    """
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end=2)


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("packing", packing)]
ORACLE_SQL = None


def run(spark, sf_dir):
    """The stages, one after the other, over the documents of ``sf_dir``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
