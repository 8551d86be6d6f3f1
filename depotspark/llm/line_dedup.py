"""Line deduplication with range-partitioned hashes and bitmaps of what each document keeps.

A line's key is the line without ASCII white space at both ends, A-Z lower-cased. Keys of at least `least_points` code points
that occur in at least `least_docs` documents lose all their lines except in the largest doc_id that holds them.

Method, with DataFrame functions alone: long lines become rows (document, position, 128 bits of hashes of the key). Rows are
range-partitioned by hash and sorted inside by hash, document (largest first) and position; windows stream over that order and
tell the first document of each key and how many documents it has. A key that holds more than a thousandth of all rows (at
most a thousand of those, found by a sketch over all rows) isn't sent to one range: its documents are counted in two steps with
map-side combining, and its rows meet the broadcast verdict where they are. The sketch only routes rows; both ways give the
same verdicts. What comes back is no text but, for each document that loses lines, 64-bit words of its keep bitmap; words that
keep all their lines are left out. Texts move once, by document, to meet their bitmap.

Defined cases: a null or empty text is one empty line and keeps it; an empty table gives no rows. Documents are told by doc_id:
rows of one doc_id count as one document, those without an id as one whose id is below all others. Equal rows get equal
results, one for each row; rows of one doc_id with different texts get a bitmap each. A document that loses all its lines
keeps the empty text. Extra columns of any name pass through `dedup`. Two keys meet with a chance near 2**-128.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from depotspark.llm.common import SPACES, materialize, release, table

LEAST_POINTS = 40
LEAST_DOCS = 5
#: A key with more than one row in HOT is hot: there are at most HOT of them.
HOT = 1000

SQL = """
with docs as (select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
l as (select r, doc_id, unnest(lines) as line, unnest(range(len(lines))) as pos from docs),
k as (select r, doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
often as (select key, max(doc_id) as last from k where length(key) >= 40 group by key having count(distinct doc_id) >= 5),
m as (select k.*, often.key is not null and k.doc_id <> often.last as dropped from k left join often on k.key = often.key)
select doc_id, count(*) as n_lines, cast(sum(dropped::int) as bigint) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not dropped), '')) as kept_sha256
from m group by r, doc_id
"""


def lower_az(c: Column) -> Column:
    """A-Z in lower case and nothing else; plain ASCII takes the short way."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, upper, upper.lower()))


def _text() -> Column:
    return F.coalesce("text", F.lit(""))


def _text_key() -> Column:
    """Tells rows of one doc_id apart whose texts differ."""
    return F.xxhash64(_text())


def line_keys(docs: DataFrame, least_points: int = LEAST_POINTS) -> DataFrame:
    """doc_id, text_key, pos, k1, k2 of every line whose key has at least `least_points` code points."""
    lines = docs.select("doc_id", _text_key().alias("text_key"), F.posexplode(F.split(_text(), "\n")).alias("pos", "line"))
    lines = lines.where(F.length("line") >= least_points).withColumn("line", F.trim("line", F.lit(SPACES))).where(F.length("line") >= least_points)
    lines = lines.withColumn("line", lower_az(F.col("line")))
    return lines.select("doc_id", "text_key", "pos", F.xxhash64("line").alias("k1"), F.xxhash64(F.lit(1), "line").alias("k2"))


def hot_keys(lines: DataFrame, hot: int = HOT) -> DataFrame:
    """k1 of the keys with more than one row in `hot`, from a sketch over all rows: at most `hot` rows."""
    top = lines.agg(F.expr(f"approx_top_k(k1, {hot}, {16 * hot})").alias("top"), F.count("*").alias("n"))
    return top.select("n", F.inline("top")).where(F.col("count") * hot > F.col("n")).select(F.col("item").alias("k1"))


def dropped_lines(lines: DataFrame, hot: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """doc_id, text_key, pos of the lines that go. lines: see line_keys; hot: see hot_keys, at most HOT rows."""
    key = ["k1", "k2"]
    few = F.broadcast(hot)  # at most HOT rows by its making
    # streams over the ranges: a key's documents come largest first
    by = Window.partitionBy(*key).orderBy(F.desc_nulls_last("doc_id"), "text_key", "pos")
    cold = lines.join(few, "k1", "left_anti").repartitionByRange(*key)
    cold = cold.withColumn("first_doc", F.first("doc_id").over(by)).withColumn("fresh", F.coalesce(F.lag(F.struct("doc_id")).over(by) != F.struct("doc_id"), F.lit(True)))
    cold = cold.withColumn("n_docs", F.sum(F.col("fresh").cast("int")).over(Window.partitionBy(*key)))
    going = (F.col("n_docs") >= least_docs) & ~F.col("doc_id").eqNullSafe(F.col("first_doc"))
    warm = lines.join(few, "k1", "left_semi")
    per_doc = warm.groupBy(*key, "doc_id").agg(F.lit(1).alias("one"))
    verdict = per_doc.groupBy(*key).agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("first_doc")).where(F.col("n_docs") >= least_docs)
    met = warm.join(F.broadcast(verdict), key)  # one row for each hot key
    columns = ["doc_id", "text_key", "pos"]
    return cold.where(going).select(*columns).unionByName(met.where(going).select(*columns))


def keep_bitmaps(dropped: DataFrame) -> DataFrame:
    """doc_id, text_key, words: the 64-bit words of the keep bitmap that aren't all ones, each with its place, in order."""
    word = F.floor(F.col("pos") / 64).cast("int")
    words = dropped.groupBy("doc_id", "text_key", word.alias("word")).agg(F.bitwise_not(F.bit_or(F.expr("shiftleft(1L, pos % 64)"))).alias("keep"))
    return words.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_list(F.struct("word", "keep"))).alias("words"))


def _gone(words: Column) -> Column:
    """Ascending positions of the lines that a keep bitmap drops."""
    bits = lambda w: F.transform(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: F.getbit(w["keep"], b) == 0), lambda b: w["word"] * 64 + b)
    return F.coalesce(F.flatten(F.transform(words, bits)), F.array().cast("array<int>"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """row_ (the document's row), kept_text, n_lines, n_dropped. Linear in a text's lines: runs between dropped lines are sliced out."""
    left = docs.select(F.struct(*docs.columns).alias("row_"), "doc_id", _text().alias("text_"), _text_key().alias("text_key"))
    maps = bitmaps.select(F.col("doc_id").alias("doc_"), F.col("text_key").alias("key_"), _gone(F.col("words")).alias("gone"))
    both = left.join(maps.hint("shuffle_hash"), left["doc_id"].eqNullSafe(maps["doc_"]) & (left["text_key"] == maps["key_"]), "left")
    both = both.select("row_", "text_", F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))
    lines = both.withColumn("lines", F.split("text_", "\n"))
    ends = lines.withColumn("ends", F.concat(F.array(F.lit(-1)), "gone", F.array(F.size("lines"))))
    runs = F.transform(F.sequence(F.lit(1), F.size("ends") - 1), lambda i: F.struct((F.get("ends", i - 1) + 1).alias("a"), (F.get("ends", i) - F.get("ends", i - 1) - 1).alias("n")))
    runs = F.filter(runs, lambda r: r["n"] > 0)
    joined = F.array_join(F.transform(runs, lambda r: F.array_join(F.slice("lines", r["a"] + 1, r["n"]), "\n")), "\n")
    text = F.when(F.size("gone") == 0, F.col("text_")).otherwise(joined)
    return ends.select("row_", text.alias("kept_text"), F.size("lines").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_dropped"))


def bitmaps(docs: DataFrame, least_points: int = LEAST_POINTS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """A table doc_id, text_key, words (see keep_bitmaps) of the documents that lose lines; release() deletes it."""
    lines = materialize(line_keys(docs, least_points))
    hot = materialize(hot_keys(lines))
    out = materialize(keep_bitmaps(dropped_lines(lines, hot, least_docs)))
    release(lines, hot)
    return out


def dedup(docs: DataFrame, least_points: int = LEAST_POINTS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """docs, under their own columns, with the texts that stay; a text that loses nothing is as it was, null too."""
    out = apply_bitmaps(docs, bitmaps(docs, least_points, least_docs))
    kept = F.when(F.col("n_dropped") == 0, F.col("row_")["text"]).otherwise(F.col("kept_text"))
    return out.select(*[kept.alias(c) if c == "text" else F.col("row_")[c].alias(c) for c in docs.columns])


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = apply_bitmaps(docs, bitmaps(docs))
    return out.select("row_.doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))
