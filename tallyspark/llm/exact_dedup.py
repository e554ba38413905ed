"""Exact de-duplication by deterministic block naming, with DataFrame functions only.

The normalised text (A-Z lower-cased, null as empty) is cut into blocks of BLOCK bytes. Distinct blocks are sorted and
numbered; then adjacent numbers of a text are paired and the distinct pairs are numbered, again and again, until each
text has one number. Two texts share (level, number) exactly when they are equal.

Block contents are moved once, to prove that every SHA-256 stands for one content only; from there on rows carry the
digest or the number. Should a digest ever have two contents, the job fails rather than merge different texts.

A number is made of a fixed bucket of the digest (or pair) and the place in that bucket's sorted order, so the numbering
has no global sort, no single partition, and doesn't depend on how rows are dealt out. Each level halves the rows; a
checkpoint ends each level.

Defined cases: null text is the empty text; a null doc_id is smaller than any other; of repeated rows (same doc_id and
text) one is kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, durable, join_groups, read, spare

BLOCK = 4096
BUCKETS = 1 << 16
ROOM = 1 << 40  # numbers in a bucket


def _number(distinct: DataFrame, bucket: Column, keys: list[str]) -> DataFrame:
    """Distinct keys with their integer names: bucket, then place among the bucket's sorted keys."""
    place = F.row_number().over(Window.partitionBy("bucket").orderBy(*keys))
    return distinct.withColumn("bucket", bucket).select(*keys, (F.col("bucket") * F.lit(ROOM) + place).alias("name"))


def text_blocks(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row for each block: doc_id, sha (of the normalised text), n (blocks of the text), pos, block, digest."""
    text = docs.select("doc_id", ascii_lower(F.coalesce("text", F.lit(""))).cast("binary").alias("bytes"))
    text = text.withColumn("n", F.greatest(F.lit(1), F.ceil(F.octet_length("bytes") / block)).cast("int"))
    cut = F.expr(f"transform(sequence(0, n - 1), i -> substring(bytes, i * {block} + 1, {block}))")
    rows = text.select("doc_id", F.unhex(F.sha2("bytes", 256)).alias("sha"), "n", F.posexplode(cut).alias("pos", "block"))
    return rows.withColumn("digest", F.unhex(F.sha2("block", 256)))


def identities(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, sha, mult (rows with this id and text), level and name: the collision-free identity of the text."""
    blocks = text_blocks(docs, block)
    seen = blocks.groupBy("digest").agg(F.min("block").alias("lo"), F.max("block").alias("hi"))
    one = F.assert_true(F.col("lo") == F.col("hi"), F.lit("two blocks have the same SHA-256"))
    seen = seen.select("digest", one.alias("proof")).where(F.col("proof").isNull()).select("digest")
    names = _number(seen, F.conv(F.substring(F.hex("digest"), 1, 4), 16, 10).cast("long"), ["digest"])
    state = blocks.select("doc_id", "sha", "n", "pos", "digest").join(names, "digest").select("doc_id", "sha", "n", "pos", "name", F.lit(1).cast("long").alias("mult"))
    state, level, done = durable(state), 0, []
    longest = state.agg(F.max("n")).first()[0] or 1
    while True:
        done.append(state.where("n = 1").select("doc_id", "sha", "mult", F.lit(level).alias("level"), "name"))
        if longest == 1:
            break
        even = F.col("pos") % 2 == 0
        pairs = (
            state.where("n > 1")
            .groupBy("doc_id", "sha", "n", F.floor(F.col("pos") / 2).cast("int").alias("pos"))
            .agg(F.max(F.when(even, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("b"), F.sum(F.when(even, F.col("mult"))).alias("mult"))
            .withColumn("n", F.ceil(F.col("n") / 2).cast("int"))
        )
        names = _number(pairs.select("a", "b").distinct(), F.pmod(F.xxhash64("a", "b"), F.lit(BUCKETS)), ["a", "b"])
        state = durable(pairs.join(names, ["a", "b"]).select("doc_id", "sha", "n", "pos", "name", "mult"))
        level, longest = level + 1, -(-longest // 2)
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.groupBy("doc_id", "sha", "level", "name").agg(F.sum("mult").alias("mult"))


def exact_dedup(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row for each document: doc_id, keep_id, group_size, kept, text_sha256. Of equal texts the largest doc_id stays."""
    ids = identities(docs, block)
    ids = durable(ids)
    several = ids.groupBy("level", "name").agg(F.max("doc_id").alias("keep_id"), F.sum("mult").alias("group_size")).where("group_size > 1")
    rows = join_groups(ids, durable(several), ["level", "name"], "group_size", "left").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("mult"))))
    rows = rows.withColumn("keep_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))).withColumn("group_size", F.coalesce("group_size", F.lit(1).cast("long")))
    return rows.select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The documents without exact copies, all columns as they were, whatever their names. One shuffle of the texts."""
    null, ident, sha, place = by = spare(docs.columns, "copy_null", "copy_id", "copy_sha", "copy_place")
    id_of = F.col("doc_id").cast("long")
    same = {null: id_of.isNull(), ident: F.coalesce(id_of, F.lit(0))}
    keep = exact_dedup(docs).where("kept").select(*(c.alias(n) for n, c in same.items()), F.col("text_sha256").alias(sha))
    mine = docs.withColumns(same | {sha: F.sha2(ascii_lower(F.coalesce("text", F.lit(""))).cast("binary"), 256)}).join(durable(keep), by[:3], "left_semi")
    first = F.row_number().over(Window.partitionBy(*by[:3]).orderBy("text"))  # rows that repeat an id and a text
    return mine.withColumn(place, first).where(F.col(place) == 1).select(*(F.col(f"`{c}`") for c in docs.columns))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"))


SQL = f"""
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), '{"ABCDEFGHIJKLMNOPQRSTUVWXYZ"}', '{"abcdefghijklmnopqrstuvwxyz"}')) AS h
  FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
  row_number() OVER (PARTITION BY h ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, h AS text_sha256
FROM d
"""
