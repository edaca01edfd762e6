"""Mixing sources to target weights along a time-varying curriculum. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import WORD

#: Weights of the sources in code point order, null last, repeating.
WEIGHTS = (5, 2, 1)
#: Slopes of the weight schedules, in the same order: at time t in [0, 1] a source has its weight times
#: 1 + slope * (2 t - 1). A positive slope comes late in training, a negative one early.
SLOPES = (0.5, 0.0, -0.5)
#: Number of hash ranges over which a source's running total is taken in two steps.
RANGES = 4096


def n_words(text: str | Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _cycle(rank: Column, values: tuple) -> Column:
    at = F.pmod(rank - 1, F.lit(len(values)))
    out = F.lit(values[-1])
    for i in range(len(values) - 2, -1, -1):
        out = F.when(at == i, F.lit(values[i])).otherwise(out)
    return out


def source_targets(per_source: DataFrame, weights=WEIGHTS, slopes=SLOPES, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """per_source (source, has_source, source_size) with target, slope.

    Targets are the least of `most` times the size and a common level times the weight, the level such that
    they sum to `share` of all sizes: what is above a cap is reshared by weight until none is above. In order
    of cap over weight the level after the first k caps is the rest of the demand over the rest of the
    weights; the first source that this level does not fill has the final level. One row a source.
    """
    by_name = Window.orderBy(F.col("has_source").desc(), "source")
    per = per_source.withColumn("_rank", F.row_number().over(by_name))
    per = per.withColumn("weight", _cycle(F.col("_rank"), tuple(float(w) for w in weights))).withColumn("slope", _cycle(F.col("_rank"), slopes))
    per = per.withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("_cap") / F.col("weight"), "_rank")
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    per = per.withColumn("_demand", F.lit(float(share)) * F.sum("source_size").over(every))
    per = per.withColumn("_filled", F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
    per = per.withColumn("_rest", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    per = per.withColumn("_level", (F.col("_demand") - F.col("_filled")) / F.col("_rest"))
    open_ = F.col("_level") * F.col("weight") <= F.col("_cap")
    level = F.min_by(F.when(open_, F.col("_level")), F.when(open_, F.struct(F.col("_cap") / F.col("weight"), F.col("_rank")))).over(every)
    return per.withColumn("target", F.least("_cap", F.coalesce(level * F.col("weight"), F.col("_cap")))).select("source", "has_source", "source_size", "target", "slope")


def _place(u: Column, slope: Column) -> Column:
    """Training time at which a source has met the part u of its demand: the inverse of t + slope (t^2 - t)."""
    one = F.lit(1.0)
    return F.lit(2.0) * u / ((one - slope) + F.sqrt((one - slope) * (one - slope) + F.lit(4.0) * slope * u))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, slopes=SLOPES, share: float = 1.5, most: int = 2, ranges: int = RANGES, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, taken, position.

    A source's documents stand in the order of md5 of their id; the mix goes through them, again from the start at the
    end, until the whole number of words in the target is taken. The last document is taken in part, so a source
    meets its target to within a word. position: 10^9 times the training time at which the first words
    of the document are due; null if none are taken. Rows that share an id stand in the order of size and
    text digest; rows equal in these too are alike, so their order changes nothing. A null source is a
    source. A null id counts as empty text. Empty texts are taken with zero words. No row: no row.

    The running total is taken in two steps, so that a source with most of the rows is spread: over hash
    ranges of a source first (sources x `ranges` rows), then inside each range. keep: columns to carry along.
    """
    digest = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    has = F.col(source_col).isNotNull()
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
        has.alias("has_source"),
        n_words(F.col(text_col)).alias("size"),
        digest.alias("_digest"),
        F.xxhash64(F.col(text_col)).alias("_tie"),
        *keep,
    )
    rows = rows.withColumn("_range", F.floor(F.conv(F.substring("_digest", 1, 8), 16, 10).cast("long") * ranges / (1 << 32)).cast("int"))
    sums = rows.groupBy("source", "has_source", "_range").agg(F.sum("size").alias("_words"))
    targets = source_targets(sums.groupBy("source", "has_source").agg(F.sum("_words").alias("source_size")), weights, slopes, share, float(most))
    inside = Window.partitionBy("source", "has_source", "_range")
    upto = Window.partitionBy("source", "has_source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("_base", F.coalesce(F.sum("_words").over(upto), F.lit(0))).drop("_words")
    starts = starts.join(targets, ["source", "has_source"])
    local = inside.orderBy("_digest", "size", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_local", F.coalesce(F.sum("size").over(local), F.lit(0)))
    rows = rows.join(starts, ["source", "has_source", "_range"])
    start, size, total = F.col("_base") + F.col("_local"), F.col("size"), F.col("source_size")
    whole = F.floor(F.col("target") + F.lit(1e-6)).cast("long")
    taken = F.lit(0).cast("long")
    for lap in range(most):
        taken = taken + F.greatest(F.lit(0), F.least(size, whole - start - lap * total))
    place = _place(start.cast("double") / F.col("target"), F.col("slope"))
    return rows.select(
        "doc_id",
        F.when(F.col("has_source"), F.col("source")).alias("source"),
        "size",
        "source_size",
        "target",
        taken.cast("long").alias("taken"),
        F.when(taken > 0, F.floor(place * F.lit(1e9)).cast("long")).alias("position"),
        start.alias("_start"),
        "slope",
        *keep,
    )


def mixing_plan(docs: DataFrame, **kw) -> DataFrame:
    """The mix as one row per document, range-sorted by training position; documents not taken come last."""
    out = mix(docs, **kw).drop("_start", "slope", "source")
    return out.orderBy(F.col("position").asc_nulls_last(), "doc_id")


def mixed_documents(docs: DataFrame, most: int = 2, **kw) -> DataFrame:
    """The training text itself: documents in training order, with the columns of docs.

    A document that the mix takes more than once stands there once for each lap, each at its own position; one taken in part
    has the first words of its text, with the white space between them.
    """
    names = [c for c in ("doc_id", "text", "lang", "source", "n_chars")]
    picked = docs.select("doc_id", "source", "text", F.struct(*[F.col(c) for c in names]).alias("_row"))
    rows = mix(picked, most=most, keep=("_row",), **kw)
    whole = F.floor(F.col("target") + F.lit(1e-6)).cast("long")
    laps = F.sequence(F.lit(0), F.lit(most - 1))
    rows = rows.withColumn("lap", F.explode(laps))
    here = F.least(F.col("size"), whole - F.col("_start") - F.col("lap") * F.col("source_size"))
    rows = rows.withColumn("words", here).where((F.col("words") > 0) | ((F.col("size") == 0) & (F.col("lap") == 0)))
    u = F.when(F.col("target") > 0, (F.col("_start") + F.col("lap") * F.col("source_size")) / F.col("target")).otherwise(0.0)
    rows = rows.withColumn("at", _place(u, F.col("slope")))
    text = F.col("_row.text")
    ends = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), 1), 1, F.col("words").cast("int")), "")
    rows = rows.withColumn("text", F.when(F.col("words") < F.col("size"), ends).otherwise(text))
    out = rows.orderBy("at", "doc_id", "lap").select(
        "doc_id", "text", F.col("_row.lang").alias("lang"), F.col("_row.source").alias("source"), F.when(F.col("words") < F.col("size"), F.char_length("text").cast("long")).otherwise(F.col("_row.n_chars").cast("long")).alias("n_chars")
    )
    return out.withColumn("doc_id", F.col("doc_id").cast(T.LongType()))


MIX_SQL = r"""
WITH rows AS (
  SELECT doc_id, coalesce(source, '') AS source, source IS NOT NULL AS has_source, text,
         CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS digest
  FROM documents),
per AS (SELECT source, has_source, sum(size)::BIGINT AS source_size FROM rows GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (ORDER BY has_source DESC, source) AS rnk FROM per),
weighed AS (SELECT *, [5.0, 2.0, 1.0][((rnk - 1) % 3 + 1)::INT]::DOUBLE AS weight,
                   [0.5, 0.0, -0.5][((rnk - 1) % 3 + 1)::INT]::DOUBLE AS slope, source_size * 2.0::DOUBLE AS cap FROM ranked),
filled AS (SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS demand,
                  coalesce(sum(cap) OVER (ORDER BY cap / weight, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
                  sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest
           FROM weighed),
levels AS (SELECT *, (demand - before) / rest AS lvl FROM filled),
final AS (SELECT arg_min(lvl, (cap / weight, rnk)) AS lvl FROM levels WHERE lvl * weight <= cap),
targets AS (SELECT source, has_source, source_size, slope, least(cap, coalesce((SELECT lvl FROM final) * weight, cap)) AS target FROM levels),
run AS (SELECT r.*, coalesce(sum(size) OVER (PARTITION BY source, has_source ORDER BY digest, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM rows r),
took AS (SELECT doc_id, size, source_size, target, slope, start,
  (greatest(0, least(size, floor(target + 1e-6)::BIGINT - start)) + greatest(0, least(size, floor(target + 1e-6)::BIGINT - start - source_size)))::BIGINT AS taken
  FROM run JOIN targets USING (source, has_source))
SELECT doc_id, size, source_size, target, taken,
  CASE WHEN taken > 0 THEN floor(2.0::DOUBLE * (start::DOUBLE / target) / ((1.0::DOUBLE - slope) + sqrt((1.0::DOUBLE - slope) * (1.0::DOUBLE - slope) + 4.0::DOUBLE * slope * (start::DOUBLE / target))) * 1e9)::BIGINT END AS position
FROM took
"""
