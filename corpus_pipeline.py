"""From raw documents to a tokenized training mix: quality, near duplicates, personal data, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet and reads it back
as the next stage's docs. All stages but the last return the columns of documents, with n_chars following the text.

Defined cases, in each stage: an empty table gives an empty result; null and empty texts count as empty; extra columns of any
name and type pass through the filters as they are: what a stage adds never meets them. Rows without an id take part in the
near-duplicate stage under a fingerprint of their text, above all ids, so one of several copies stays and a copy with an id goes
before one without. A document that occurs several times with one id stays once there; of different texts under one id,
which are one group, that of the smallest fingerprint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from depotspark.llm import byte_bpe, mixing, ngram_join, pii, quality_rules
from depotspark.llm.common import SPACES, materialize, release, ship

#: No SQL: the stages hold trained and iterated estimates; tests compare them with brute force.
ORACLE_SQL = None


#: Ids of rows without one start here.
UNNAMED = 1 << 62


def _aside(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with all columns but those that stages read under names that no stage makes, and the names: theirs -> ours."""
    names = {c: c if c in ("doc_id", "text", "lang", "source") else f"_column{i}_" for i, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), names


def _back(names: dict[str, str]) -> list[Column]:
    return [F.col(n).alias(c) for c, n in names.items()]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    ship(spark)
    rows, names = _aside(docs)
    return quality_rules.quality_rules(rows).where("kept").select(*_back(names))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked at Jaccard 0.8 or more over 5-word shingles."""
    ship(spark)
    rows, names = _aside(docs)
    own_id = F.lit(UNNAMED) + F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(UNNAMED >> 1))
    rows = rows.withColumn("_given_", F.col("doc_id")).withColumn("doc_id", F.coalesce("doc_id", own_id))
    found = materialize(ngram_join.components(rows.select("doc_id", "text")))
    stays = materialize(found.where("doc_id = component_id").select("doc_id").distinct())
    # texts move once, by id, and at every size in the same way
    left = rows.join(stays.hint("shuffle_hash"), "doc_id", "left_semi").select(*rows.columns)
    if not found.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").isEmpty():
        left = _one_for_each_id(left)
    release(found)
    return left.select(*_back(names | {"doc_id": "_given_"}))


def _one_for_each_id(docs: DataFrame) -> DataFrame:
    """Rows of one id with the same text are one document; of several texts under one id that of the smallest fingerprint stays, as they are one group."""
    order = F.struct(F.sha2(F.coalesce("text", F.lit("")), 256), F.xxhash64(*docs.columns))
    rows = docs.select(F.col("doc_id").alias("id_"), F.struct(*docs.columns).alias("row_"), order.alias("order_"))
    return rows.groupBy("id_").agg(F.min_by("row_", "order_").alias("row_")).select("row_.*")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with each span of personal data replaced by its kind in brackets."""
    ship(spark)
    rows, names = _aside(docs)
    new = {"text": F.col("redacted"), "n_chars": F.length("redacted").cast("long")}
    return pii.find(rows).select(*[new[c].alias(c) if c in new else F.col(n).alias(c) for c, n in names.items()])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: whole copies, and for the one at a source's cut the words still missing."""
    ship(spark)
    rows = mixing.mixed(docs).where("taken > 0")
    share = lambda k: F.least(F.col("size"), F.col("taken") - k * F.col("size"))
    rows = rows.withColumn("share", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("taken") / F.col("size")) - 1), share)))
    text = F.col("row_")["text"]
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    cut = F.concat(F.regexp_extract(text, rf"^[{SPACES}]*", 0), F.array_join(F.slice(words, 1, F.col("share").cast("int")), " "))
    text = F.when(F.col("share") == F.col("size"), text).otherwise(cut)
    made = {"text": text, "n_chars": F.length(text).cast("long")}
    return rows.select(*[made.get(c, F.col("row_")[c]).alias(c) for c in docs.columns])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded bytes, for each row of the mix."""
    ship(spark)
    return byte_bpe.digests(docs)


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("personal data", personal_data),
    ("mixing", mix),
    ("byte-level BPE", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
        if last is not None:
            release(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
