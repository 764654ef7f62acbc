"""A training-corpus pipeline over `documents`: each stage's rows are written and read by the next.

Rows whose text the network gives no language go, one row of each group of near copies stays, rows that hold a benchmark item
go, each row is taken as often as the mix of its source asks, and the tokens of what is left are written
and read back. The last stage returns (doc_id, start, n_tokens, ids_crc32), a row for each copy taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bytelode.llm.common import Scratch, cleared, table
from bytelode.llm.decontaminate import drop_contaminated
from bytelode.llm.language import drop_undetermined
from bytelode.llm.mixing import take_copies
from bytelode.llm.nearcopies import keep_one_of_each
from bytelode.llm.tokenfile import write_and_read

STAGES = [
    ("language", drop_undetermined),
    ("near_dedup", keep_one_of_each),
    ("decontaminate", drop_contaminated),
    ("mix", take_copies),
    ("tokens", write_and_read),
]

#: SQL has no network, no SimHash and no tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage has written is removed when the next one's rows are written."""
    results, docs, before = Scratch(spark), table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        with cleared():
            docs = results.write(stage(spark, docs, sf_dir))
        if before is not None:
            results.drop(before)
        before = docs
    return docs
