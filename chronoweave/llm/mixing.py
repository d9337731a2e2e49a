"""Mixing sources to target weights, by DataFrame operations only.

Documents get hash-random keys. Within each source the keys' ranges are buckets of near equal counts;
a bucket's sum of sizes, summed over the buckets before it and then over the documents before it
inside its bucket, gives each document's position among its source's words. Whole epochs repeat a
source; the rest of its budget is cut at the exact word.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, drop_stored, free_name, materialize, row_hash

#: Bits of a document's random key.
KEY_BITS = 60
#: Copies of one row that are made in one place.
COPIES = 1_000
WEIGHTS = (3, 1, 2)
SHARE_PERCENT = 150
EPOCHS = 2


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT, epochs: int = EPOCHS) -> DataFrame:
    """Targets of sources, from rows ``(source, source_size)``.

    The sources, by code point with null last, weigh ``weights`` in turn and share ``share_percent`` of all
    sizes. A target stops at ``epochs`` times its source's size, and what is above goes to the others by
    weight until no target is above. That fixed point is ``least(weight * level, cap)`` for one level; a
    source is capped if its ``cap / weight`` is below the level, so one pass over the sources sorted by
    that ratio finds it. All steps run on one row per source.
    """
    everywhere = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.pmod(F.row_number().over(everywhere) - 1, F.lit(len(weights))) + 1).cast("int")).cast("long")
    sized = sizes.withColumn("weight", w).withColumn("cap", F.col("source_size") * epochs)
    by_ratio = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, onward, whole = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing), by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # With the sources before this one capped and the rest not, level = num / (100 * den).
    staged = (
        sized.withColumn("num", F.lit(share_percent) * F.sum("source_size").over(whole) - 100 * F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("den", F.sum("weight").over(onward))
        .withColumn("open", F.col("num") * F.col("weight") <= 100 * F.col("cap") * F.col("den"))
        .withColumn("first", F.min(F.when(F.col("open"), F.struct((F.col("cap") / F.col("weight")).alias("r"), F.struct(F.col("source").isNull(), F.col("source")).alias("s"), "num", "den"))).over(whole))
    )
    level = F.col("weight") * F.col("first.num") / (100 * F.col("first.den"))
    target = F.coalesce(F.least(level, F.col("cap").cast("double")), F.col("cap").cast("double"))
    return staged.select("source", "source_size", target.alias("target"))


def random_key(column: str, size: str, seed: int):
    """A key of KEY_BITS bits from the md5 of seed, id and size; any engine with md5 can repeat it. Rows that share an id, or have none, differ by size."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (column, size)]
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *parts).cast("binary")), 1, KEY_BITS // 4), 16, 10).cast("long")


def _with_sizes(docs: DataFrame, seed: int, *more) -> DataFrame:
    sized = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), *more)
    return sized.withColumn("mix_key", random_key("doc_id", "size", seed))


def _placed(sized: DataFrame, weights: tuple[int, ...], share_percent: int, epochs: int, buckets: int | None) -> DataFrame:
    """``sized`` rows, each as often as it is there, with source_size, target and taken.

    Equal rows are one row with a count while positions are summed. Buckets are about as many as each then
    holds rows, so that neither the rows of a bucket nor the buckets of a source are many for a task.
    """
    by = [c for c in sized.columns]
    rows = sized.groupBy(*by).agg(F.count(F.lit(1)).alias("copies"))
    if buckets is None:
        buckets = math.isqrt(sized.count())
    bits = max(0, buckets - 1).bit_length()
    dealt = rows.withColumn("bucket", F.shiftright("mix_key", KEY_BITS - bits).cast("int") if bits else F.lit(0))
    words = F.col("size") * F.col("copies")
    sums = dealt.groupBy("source", "bucket").agg(F.sum(words).alias("bucket_size"))
    totals = source_targets(sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, share_percent, epochs)
    starts = sums.withColumn("start", F.sum("bucket_size").over(Window.partitionBy("source").orderBy("bucket")) - F.col("bucket_size"))
    plan = starts.alias("b").join(totals.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source"))).select("b.source", "b.bucket", "b.start", "t.source_size", "t.target")
    inside = Window.partitionBy("source", "bucket").orderBy("mix_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = dealt.withColumn("upto", F.sum(words).over(inside) - words).alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.bucket") == F.col("p.bucket")))
    each = placed.select(*[F.col(f"d.{c}") for c in by], (F.col("p.start") + F.col("d.upto")).alias("before"), "p.source_size", "p.target", F.explode(F.sequence(F.lit(0), F.col("d.copies") - 1)).alias("copy"))
    budget = F.floor("target")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.greatest(F.col("source_size"), F.lit(1)))).otherwise(0)
    rest = budget - whole * F.col("source_size")
    extra = F.least(F.greatest(rest - (F.col("before") + F.col("copy") * F.col("size")), F.lit(0)), F.col("size"))
    return each.select(*by, "source_size", "target", (whole * F.col("size") + extra).cast("long").alias("taken"))


def mix_to_targets(docs: DataFrame, seed: int = 0, weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT, epochs: int = EPOCHS, buckets: int | None = None) -> DataFrame:
    """One row per row of ``docs(doc_id, text, source)``: size, source_size, target, taken and random key.

    ``size`` counts the words of the text, 0 if null. ``taken`` is the number of words that the mix takes:
    the size for each whole epoch, plus the part of the document before the source's cut. Each source's
    taken words are its target's integer part (a source of size 0 takes none).

    Ties (repeated ids, null ids) are ordered by a key of id and size, then id; equal rows share their words in any
    order, and the multiset of results is the same in every run. A null source is one of its own. Texts of any
    length count whole. An empty table gives an empty result. Further columns of ``docs`` are ignored.

    The hot source's documents are dealt over buckets like all others; only rows of one bucket meet in a
    task, equal rows as one, and only counts per source and bucket are summed in order.
    """
    sized = materialize(_with_sizes(docs, seed), "mix-sizes")
    return _placed(sized, weights, share_percent, epochs, buckets).select("doc_id", "source", "size", "source_size", "target", "taken", "mix_key")


def mixed_documents(docs: DataFrame, seed: int = 0, weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT, epochs: int = EPOCHS) -> DataFrame:
    """The mix itself: each row of ``docs``, repeated as often as the mix takes it.

    A document at its source's cut is kept whole. Documents without words take no budget and are dropped,
    as are those after the cut of a source that is not repeated. Columns are those of ``docs``, whatever their
    names. Rows are told apart by a hash of all their columns, so rows that share a doc_id, or have none, are taken
    each for itself; rows that are equal in all columns are copied as often as all of them together are
    taken. An empty table gives an empty result.
    """
    sized = materialize(_with_sizes(docs, seed, row_hash(docs).alias("row")), "mix-sizes")
    copies = F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.greatest(F.col("size"), F.lit(1)))).otherwise(0)
    taken = _placed(sized, weights, share_percent, epochs, None).groupBy("doc_id", "row").agg(F.sum(copies).alias("copies"), F.count(F.lit(1)).alias("rows"))
    taken = materialize(taken.where("copies > 0"), "mix-copies")
    drop_stored(sized)
    own = free_name(docs.columns, "mix_row")
    named = docs.withColumn(own, row_hash(docs)).alias("d")
    met = lambda t: named.join(t.alias("t"), F.col(f"d.{own}").eqNullSafe(F.col("t.row")) & F.col("d.doc_id").eqNullSafe(F.col("t.doc_id")))
    columns = [F.col(f"d.`{c}`") for c in docs.columns]
    once = met(taken.where("rows = 1")).select(*columns, F.explode(F.sequence(F.lit(1), F.col("t.copies"))).alias(own)).drop(own)
    if not taken.where("rows > 1").limit(1).count():
        return once
    # Rows that are there several times become one with their number of copies, dealt out again in parts.
    several = met(taken.where("rows > 1")).groupBy("t.row", "t.doc_id", "t.copies").agg(F.first(F.struct(*columns)).alias("all"))
    parts = several.select("all", "copies", F.explode(F.sequence(F.lit(0), F.col("copies") - 1, F.lit(COPIES))).alias("at"))
    parts = materialize(parts.repartition(F.col("at"), F.xxhash64("all.doc_id")), "mix-parts")
    number = F.explode(F.sequence(F.lit(1), F.least(F.lit(COPIES), F.col("copies") - F.col("at")))).alias("n")
    return once.unionByName(parts.select("all", number).select("all.*"))


OP9_SQL = """
WITH counted AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size
  FROM documents),
sized AS (SELECT *, ('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, '') || ':' || size), 1, 15))::BIGINT AS k FROM counted),
tot AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
w AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight, 2 * source_size AS cap FROM tot),
st AS (
  SELECT *, 150 * (SELECT sum(source_size) FROM w)::BIGINT - 100 * coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS num,
         sum(weight) OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS den,
         row_number() OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST) AS rn
  FROM w),
lev AS (SELECT num, den FROM st WHERE num * weight <= 100 * cap * den ORDER BY rn LIMIT 1),
tgt AS (
  SELECT source, source_size, CASE WHEN (SELECT count(*) FROM lev) = 0 THEN cap::DOUBLE
         ELSE least((weight * (SELECT num FROM lev))::DOUBLE / (100 * (SELECT den FROM lev))::DOUBLE, cap::DOUBLE) END AS target FROM st),
cum AS (
  SELECT d.*, t.source_size, t.target, sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS UNBOUNDED PRECEDING)::BIGINT AS upto
  FROM sized d JOIN tgt t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       ((CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END) * size
        + least(greatest(floor(target)::BIGINT - (CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END) * source_size - (upto - size), 0), size))::BIGINT AS taken
FROM cum
"""
