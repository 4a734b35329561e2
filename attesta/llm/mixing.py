"""Mixing sources to target weights by exponential-key (Efraimidis-Spirakis) sampling.

Every source gets a word budget; a budget of several times the source's own size first takes
complete epochs of it, and the remaining fraction is a weighted sample without replacement: each
document draws the exponential key ``-ln(u) / weight`` with ``u`` hashed from its id, the source is
ordered by key, and the prefix whose word counts reach the remainder is taken; of the document in
which the budget ends, the words up to it are taken, so that a source misses its target by less
than one word.

No task ever holds a source: keys fall into ``BUCKETS`` ordered buckets a source, bucket sizes are
summed map-side, and only the one bucket in which a source's budget ends is ordered row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.llm.common import WORD, sized, staged, table, unused

BUCKETS = 4096
WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_weight(text: Column) -> Column:
    """Quality weight in (0, 1]: a quarter, plus three quarters of the share of letters and white space."""
    kept = F.length(F.regexp_replace(text, r"[^\p{L}\s]+", ""))
    return F.coalesce(0.25 + 0.75 * kept / F.nullif(F.length(text), F.lit(0)), F.lit(0.25))


def uniform(doc_id: Column) -> Column:
    """In (0, 1), from the first 52 bits of the id's MD5, so that any engine can repeat the draw."""
    bits = F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 13), 16, 10)
    return (bits.cast("double") + 0.5) / F.lit(float(2**52))


def targets(sizes: DataFrame, weights=WEIGHTS, cap: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) -> with target: all words shared by weight, none above ``cap`` times its source.

    Sources by code point, null last, weigh ``weights`` in turn. Resharing the excess by weight until
    no source is above its cap gives ``min(cap_i, level * weight_i)``; the level follows from the
    order of ``cap_i / weight_i`` without iterating. One row a source, so one task suffices.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    nth = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), nth.cast("int") + 1)
    by_ratio = Window.orderBy((F.col("most") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (
        sizes.withColumn("w", weight)
        .withColumn("most", F.col("source_size").cast("double") * cap)
        .withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        .withColumn("w_left", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
        .withColumn("level", F.col("left") / F.col("w_left"))
        .withColumn("own", F.when(F.col("level") * F.col("w") <= F.col("most"), F.col("level")))
        .withColumn("level", F.max("own").over(everything))
        .withColumn("target", F.least(F.col("most"), F.coalesce(F.col("level") * F.col("w"), F.col("most"))))
        .select("source", "source_size", "target")
    )


def mix(documents: DataFrame, weights=WEIGHTS, weight: Column | None = None) -> DataFrame:
    """Return doc_id, source, size, source_size, target, taken for every row of ``documents``.

    Needs doc_id, text, source. ``taken`` is the words the mix takes of the row, repeats counted: at
    most three times ``size``, and a multiple of it but for the one row in which a budget ends. Null or blank text has size 0 and takes 0; a null source is a
    source of its own; repeated rows draw the same key and count each by itself; a null id draws the
    key of the empty string. An empty table gives an empty result. Other columns are ignored.
    """
    text = F.col("text")
    rows = documents.select(
        "doc_id",
        "source",
        words(text).alias("size"),
        (-F.log(uniform(F.col("doc_id"))) / (text_weight(text) if weight is None else weight)).alias("key"),
    ).withColumn("bucket", F.least(F.lit(BUCKETS - 1), F.floor((1 - F.exp(-F.col("key"))) * BUCKETS)).cast("int"))
    rows = staged(rows, "mix")  # narrow; the texts are read once
    buckets = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    budget = (
        targets(buckets.groupBy("source").agg(F.sum("words").alias("source_size")), weights)
        .withColumn("epochs", F.coalesce(F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0)))
        .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    )
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    edges = buckets.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0)))
    plan = edges.alias("e").join(budget.alias("b"), F.col("e.source").eqNullSafe(F.col("b.source"))).select(
        "e.source", "e.bucket", "b.source_size", "b.target", "b.epochs", (F.col("b.rest") - F.col("e.before")).alias("gap"), "e.words"
    )
    found = rows.alias("r").join(
        plan.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("r.bucket") == F.col("p.bucket"))
    ).select("r.doc_id", "r.source", "r.size", "r.key", "r.bucket", "p.source_size", "p.target", "p.epochs", "p.gap", "p.words")
    inside = (F.col("gap") > 0) & (F.col("gap") < F.col("words"))
    within = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.floor("gap") - F.coalesce(F.sum("size").over(within), F.lit(0))
    whole = found.where(~inside).withColumn("more", F.when(F.col("gap") >= F.col("words"), F.col("size")).otherwise(F.lit(0)))
    split = found.where(inside).withColumn("more", F.greatest(F.lit(0), F.least(F.col("size"), reach)))
    return whole.unionByName(split).select(
        "doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("epochs") + F.col("more")).cast("long").alias("taken")
    )


def apply(documents: DataFrame, weights=WEIGHTS) -> DataFrame:
    """``documents``, all columns, each row as often as the mix takes it; a row cut by its budget stays if half of it is within.

    Rows without words (null, empty or blank texts) take nothing and go; a null source is a source of its
    own; rows that repeat an id are taken as often as the one taken most; an empty table stays empty;
    columns pass through whatever their names.
    """
    taken = staged(mix(documents, weights), "taken")
    key, copies = unused(documents, "id_taken"), unused(documents, "copies_taken")
    often = taken.where("size > 0").groupBy(F.col("doc_id").alias(key)).agg(F.max(F.floor(F.col("taken") / F.col("size") + 0.5)).cast("int").alias(copies)).where(F.col(copies) > 0)
    joined = documents.join(sized(often, taken.count()), F.col("doc_id").eqNullSafe(F.col(key))).drop(key)
    return joined.withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies)))).drop(copies)


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("source")


SQL = """
WITH rows AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
      / CASE WHEN coalesce(text, '') = '' THEN 0.25
        ELSE 0.25 + 0.75 * length(regexp_replace(text, '[^\\p{L}\\s]+', '', 'g')) / length(text) END AS key
  FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM rows GROUP BY source),
weighted AS (
  SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w, 3.0 * source_size::DOUBLE AS most FROM sizes),
levels AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(most) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level
  FROM weighted WINDOW b AS (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
settled AS (SELECT max(level) AS level FROM levels WHERE level * w <= most),
budget AS (
  SELECT source, source_size, least(most, coalesce(settled.level * w, most)) AS target
  FROM weighted, settled),
ordered AS (
  SELECT r.doc_id, r.size, b.source_size, b.target, CASE WHEN b.source_size = 0 THEN 0 ELSE floor(b.target / b.source_size)::BIGINT END AS epochs,
    coalesce(sum(r.size) OVER (PARTITION BY r.source ORDER BY r.key, r.doc_id, r.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM rows r JOIN budget b ON r.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
  (size * epochs + greatest(0, least(size, floor(target - epochs * source_size)::BIGINT - before)))::BIGINT AS taken
FROM ordered
"""
