"""Mix sources to target weights by hash thresholds (DataFrame functions only).

Every row gets a 60-bit hash of its id. A source's share of the mix is the set of rows whose hash lies at or
below a threshold, so nothing is sorted: token sums by (source, hash bucket) locate the bucket in which the
budget runs out, and only that bucket is split further, 12 bits a level, until one hash value is left.

* Null texts have size 0; a null source is a source of its own, last in order; null ids hash as the empty text.
* Rows with the same id have the same hash and are taken or left together.
* A source of size 0 has target 0 and takes no words. An empty table gives an empty result.
* Only the named columns are read, so other columns, whatever their names, do not matter.
* The targets come from running sums over the sources in one task: a row of a few bytes for each source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treeweft.llm.common import stored, whole_text

WORD = r"[^\x20\x09-\x0D]+"
LEVEL_BITS = 12
LEVELS = 5
SALTS = 64
#: Bytes of the table of sources' limits up to which every task gets it.
BROADCAST_BYTES = 8 << 20


def hash60(col) -> F.Column:
    """The first 60 bits of the MD5 of the id's text."""
    text = F.coalesce(col.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint")


def source_targets(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """From (source, source_size), the target of each source.

    Sources in code point order, null last, take the weights in turn. ``share`` of all sizes is dealt by weight;
    no target exceeds ``cap`` times its source, and what is over is dealt among the others. With sources in
    ascending order of cap/weight the full ones come first, so running sums settle it in one pass.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    n = len(weights)
    weighted = sizes.withColumn("_turn", (F.row_number().over(order) - 1) % n).withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_turn") + 1).cast("int"))
    )
    limit = F.lit(float(cap)) * F.col("source_size").cast("double")
    by_ratio = Window.orderBy(limit / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everywhere = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everywhere).cast("double") * F.lit(float(share))
    level = weighted.withColumn("_limit", limit).withColumn(
        "_level",
        (total - F.lit(float(cap)) * F.coalesce(F.sum("source_size").over(before), F.lit(0)).cast("double"))
        / F.sum("weight").over(after),
    )
    # the level at the first source that its limit does not hold back; null if all are full
    return (
        level.withColumn("_free", F.when(F.col("_limit") > F.col("weight") * F.col("_level"), F.col("_level")))
        .withColumn("_level", F.first("_free", ignorenulls=True).over(everywhere))
        .withColumn("target", F.coalesce(F.least(F.col("_limit"), F.col("weight") * F.col("_level")), F.col("_limit")))
        .select("source", "source_size", "weight", "target")
    )


def thresholds(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """One row a source: how often all its rows are taken (``base``), and the hash up to which one more time.

    The first level sums all rows by (source, bucket). The rows in the buckets where budgets run out are then set
    apart, and each further level sums what the level above has left of them.
    """
    full = F.col("target") >= F.col("source_size")
    state = targets.select(
        F.col("source").alias("_s"),
        F.col("source_size"),
        F.col("target"),
        full.cast("long").alias("base"),
        F.when(full, F.col("target") - F.col("source_size")).otherwise(F.col("target")).alias("left"),
        F.lit(0).cast("long").alias("prefix"),
    )
    kept = ["source_size", "target", "base"]
    rows = sized.select("source", "size", "h")
    for level in range(LEVELS):
        down = LEVEL_BITS * (LEVELS - 1 - level)
        if level:
            here = state.select(F.col("_s").alias("_in"), F.col("prefix").alias("_at"))
            inside = rows["source"].eqNullSafe(here["_in"]) & (F.shiftright(rows["h"], down + LEVEL_BITS) == here["_at"])
            rows = rows.join(here, inside, "left_semi")
            if level == 1:
                rows = stored(rows, "mix-boundary")
        sums = rows.groupBy("source", F.shiftright("h", down).alias("_bucket")).agg(F.sum("size").alias("bucket_size"))
        sums = sums.join(state, sums["source"].eqNullSafe(state["_s"]))
        upto = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
        sums = sums.withColumn("_sum", F.sum("bucket_size").over(upto)).filter(F.col("_sum") >= F.col("left"))
        first = Window.partitionBy("source").orderBy("_bucket")
        state = sums.withColumn("_n", F.row_number().over(first)).filter("_n = 1")
        state = state.select(
            F.col("source").alias("_s"),
            *kept,
            (F.col("left") - (F.col("_sum") - F.col("bucket_size"))).alias("left"),
            F.col("_bucket").alias("prefix"),
            F.col("bucket_size"),
        )
        if level < LEVELS - 1:
            state = state.drop("bucket_size")
        if level == 0:
            state = stored(state, "mix-state")
    # the last hash is taken if that comes nearer to the budget than leaving it
    nearer = F.col("left") * 2 >= F.col("bucket_size")
    return state.select("_s", *kept, F.when(nearer, F.col("prefix")).otherwise(F.col("prefix") - 1).alias("upto"))


def sizes_of(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(_id, source, size, h) of every row, written once."""
    sized = docs.select(
        F.col(id_col).alias("_id"),
        F.col(source_col).cast("string").alias("source"),
        F.regexp_count(whole_text(text_col), F.lit(WORD)).cast("long").alias("size"),
        hash60(F.col(id_col)).alias("h"),
    )
    return stored(sized, "mix-sizes")


def limits_of(sized: DataFrame, weights, share: float, cap: float) -> DataFrame:
    """(_s, source_size, target, base, upto) of every source, written once."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    return stored(thresholds(sized, source_targets(sums, weights, share, cap)), "mix-limits")


def with_limits(rows: DataFrame, limits: DataFrame, source: F.Column, h: F.Column) -> DataFrame:
    """``rows`` beside the limits of their source. Few sources go to all tasks, so that no row moves; with more, as a
    source may hold most rows, each row meets one of SALTS copies of its source's limits."""
    size = limits.agg(F.count("*").alias("n"), F.sum(F.octet_length("_s")).alias("b")).head()
    if 64 * size["n"] + (size["b"] or 0) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(limits), source.eqNullSafe(limits["_s"]))
    limits = limits.withColumn("_salt", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")))
    return rows.join(limits, (F.pmod(h, F.lit(SALTS)) == limits["_salt"]) & source.eqNullSafe(limits["_s"]))


def copies_by(h: F.Column) -> F.Column:
    return F.col("base") + F.when(h <= F.col("upto"), 1).otherwise(0)


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=(5, 2, 1),
    share: float = 1.5,
    cap: float = 2.0,
) -> DataFrame:
    """(id, size, source_size, target, copies, taken) for every row of ``docs``.

    ``copies`` is how many times the mix holds the row: 0, 1 or 2.
    """
    sized = sizes_of(docs, id_col, text_col, source_col)
    both = with_limits(sized, limits_of(sized, weights, share, cap), sized["source"], sized["h"])
    found = both.withColumn("copies", copies_by(F.col("h")))
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return found.select(F.col("_id").alias(id_col), "size", "source_size", "target", "copies", taken)


def mixed(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=(5, 2, 1),
    share: float = 1.5,
    cap: float = 2.0,
) -> DataFrame:
    """The rows of ``docs``, all their columns as they were, each as often as the mix holds it."""
    limits = limits_of(sizes_of(docs, id_col, text_col, source_col), weights, share, cap)
    rows = docs.select(
        F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"),
        docs[source_col].cast("string").alias("_source"),
        hash60(docs[id_col]).alias("_h"),
    )
    both = with_limits(rows, limits, rows["_source"], rows["_h"])
    again = F.explode(F.expr("sequence(1L, copies)"))
    return both.withColumn("copies", copies_by(F.col("_h"))).filter("copies > 0").withColumn("_copy", again).select("_row.*")


MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         ([5.0, 2.0, 1.0])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight
  FROM sized GROUP BY source
), r AS (
  SELECT *, 2.0::DOUBLE * source_size::DOUBLE AS lim,
         (sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE
          - 2.0::DOUBLE * coalesce(sum(source_size) OVER (ORDER BY 2.0::DOUBLE * source_size::DOUBLE / weight, source NULLS LAST
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
         / sum(weight) OVER (ORDER BY 2.0::DOUBLE * source_size::DOUBLE / weight, source NULLS LAST
              ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl,
         row_number() OVER (ORDER BY 2.0::DOUBLE * source_size::DOUBLE / weight, source NULLS LAST) AS k
  FROM s
), f AS (
  SELECT arg_min(lvl, k) FILTER (WHERE lim > weight * lvl) AS lvl FROM r
), t AS (
  SELECT source, source_size, coalesce(least(lim, weight * f.lvl), lim) AS target FROM r, f
), g AS (
  SELECT *, CASE WHEN target >= source_size THEN 1 ELSE 0 END AS base,
         CASE WHEN target >= source_size THEN target - source_size ELSE target END AS budget
  FROM t
), h AS (
  SELECT source, h, sum(size) AS hs, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS cum
  FROM sized GROUP BY source, h
), l AS (
  SELECT h.source, max(h.h) AS upto
  FROM h JOIN g ON h.source IS NOT DISTINCT FROM g.source
  WHERE h.cum - h.hs < g.budget AND h.cum - h.hs + h.hs / 2.0::DOUBLE <= g.budget
  GROUP BY h.source
)
SELECT d.doc_id, d.size, g.source_size, g.target,
       (d.size * (g.base + CASE WHEN d.h <= coalesce(l.upto, -1) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sized d JOIN g ON d.source IS NOT DISTINCT FROM g.source
LEFT JOIN l ON d.source IS NOT DISTINCT FROM l.source
"""
