"""A corpus pipeline: five stages, each a function (spark, docs, sf_dir) that returns a DataFrame.

Every stage works on all rows that its predecessor kept; all but the last return the columns of documents, and the last
adds the token ids and the text that they decode to. A stage's result is written as Parquet and read again as the next
one's docs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.llm.bpe import round_trip, tokenizer_path
from stepweave.llm.common import checkpoint, checkpoint_dir, documents, fresh, small_batches, table, with_row_key
from stepweave.llm.decontamination import decontaminate
from stepweave.llm.jaccard import BROADCAST_IDS, near_duplicates
from stepweave.llm.passages import ADDED, passage_dedup
from stepweave.llm.recurring import BLOCK
from stepweave.llm.toxicity import fit, score

#: Shingles of five words; near copies share 80 of 100 of them at least.
NEAR = {"words": 5, "share": 80, "part": 100}


def _all(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the toxicity model rejects go. It learns from the labelled rows of sf_dir's documents outside the held-out fold, whatever docs holds.

    Null and empty texts stay; so does every row if labels of one kind are missing. Repeated rows share their fate. A text
    is scored as a whole, however long. A score of 0.5 goes. Other columns, whatever their names, pass. Empty in, empty out.
    """
    model = fit(documents(spark, sf_dir), table(spark, sf_dir, "labels"))
    mark = fresh("score", docs.columns)
    return score(docs, model, keep=docs.columns, named=mark).where(F.col(mark) < 0.5).select(*_all(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays, the one with the smallest doc_id.

    Where doc_ids repeat or are null, rows are told apart by their place in the table, and the first one stays: of equal rows one,
    of rows with one doc_id each unlike text. Null and empty texts are like no other and stay. Texts are compared as a whole.
    Other columns, whatever their names, pass. Empty in, empty out.
    """
    keyed, key = with_row_key(docs)
    found = near_duplicates(keyed.select(F.col(key).alias("doc_id"), "text"), **NEAR)
    gone = checkpoint(found.where("doc_id <> component_id").select(F.col("doc_id").alias(key)))
    few = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS  # else the join shuffles
    return keyed.join(F.broadcast(gone) if few else gone, key, "left_anti").select(*_all(docs))


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that a document with a smaller doc_id holds go, and n_chars follows; a document that loses none keeps its text as it is.

    A document of which nothing is left goes. Null and empty texts stay. Rows with one doc_id are one document for the
    comparison, each cut for itself; a null doc_id is larger than all. Columns named as the operator's own pass unharmed.
    Empty in, empty out.
    """
    own = [*(n for n, _, _ in ADDED), BLOCK]
    hidden = {c: fresh(f"{c}_of_caller", docs.columns) for c in docs.columns if c.lower() in own}
    cut = passage_dedup(docs.withColumnsRenamed(hidden))
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.char_length("kept")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    left = cut.where("n_removed = 0 OR n_removed < n_words").withColumns(new).drop(*own)
    return left.withColumnsRenamed({v: k for k, v in hidden.items()}).select(*_all(docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds an item of the benchmark go, each judged by itself, also where doc_ids repeat or are null.

    Null and empty texts, and all texts if there are no items, stay. Other columns, whatever their names, pass. Empty in, empty out.
    """
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).select(*_all(docs))


def encode_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the ids and the digest of the decoded text of every row that is left; other columns end here.

    A null text is encoded as ''. Repeated rows and null doc_ids give rows as they are. Empty in, empty out.
    """
    small_batches(spark)
    both = round_trip(docs, tokenizer_path())
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("substring dedup", cut_passages),
    ("benchmark decontamination", drop_contaminated),
    ("BPE encoding and decoding", encode_bpe),
]

#: Components, automata and tokens are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs.select("doc_id", "n_tokens", F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), "decoded_sha256")
