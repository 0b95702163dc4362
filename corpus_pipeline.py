"""The corpus pipeline: toxicity, line dedup, SimHash near-dedup, benchmark decontamination, SentencePiece encoding.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns
of documents. run() writes each stage's rows as Parquet under the shared folder, gives the next stage what it reads back, and deletes what
the stage after has read.

Nulls: a null text scores as an empty one, has no line, is a copy of empty texts, holds no passage and has no pieces. Ties and repeated
rows: of each group of copies the smallest doc_id stays, of repeated rows one. Very long texts are taken whole by every stage. Empty
tables give empty results. Extra columns of any name go along; n_chars follows the text where it is there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.common import discard, stash
from fieldloom.llm.decontam import clean_of
from fieldloom.llm.linededup import dedup_lines
from fieldloom.llm.pieces import encoder
from fieldloom.llm.similar import first_of_groups
from fieldloom.llm.toxicity import scorer, train
from fieldloom.shipping import ship


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go."""
    model = train(docs, ship(spark).read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.filter(scorer(model)("text") < 0.5)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten or more documents go; n_chars follows the text. A document stays even if no line is left of it."""
    ship(spark)
    new = {"text": F.col("kept.text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("kept.text").cast(docs.schema["n_chars"].dataType)
    return dedup_lines(docs).select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (0.8 or more of the five-word shingles in common) the document with the smallest id stays.

    Multi-index hashing of fingerprints finds and joins what is nearly alike; an exact prefix filter adds every other pair at 0.8.
    """
    ship(spark)
    return first_of_groups(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return clean_of(docs, ship(spark).read.parquet(f"{sf_dir}/benchmark.parquet"))


def piece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' columns with the best segmentation, its rivals and the round trip through decoding; where a name is taken, `pieces_` is put in front."""
    ship(spark)
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), encoder()("text").alias("encoded"))
    taken, new = {c.lower() for c in docs.columns}, []
    for field in out.schema["encoded"].dataType.fields:
        name = field.name
        while name in taken:
            name = f"pieces_{name}"
        new.append(F.col(f"encoded.{field.name}").alias(name))
    return out.select(*[F.col(f"row.`{c}`") for c in docs.columns], *new)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("decontamination", decontamination),
    ("piece_encoding", piece_encoding),
]

#: Trained and iterative stages are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = ship(spark).read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
