"""Temperature mixing of sources to target weights, in DataFrame expressions only.

A source's share of all tokens is raised to an exponent and normalised.  The exponent, between 0
(equal weights) and 1 (as it is), is bisected to the largest value whose weights reach a target
entropy and whose sources repeat no more often than a limit allows.  Weights become token budgets of
whole numbers.  Each source's rows are dealt by hash into blocks of bounded size; within an epoch
blocks, and rows in blocks, are permuted by hash, and a row is drawn once per epoch until the budget
is met: the row that crosses it is the last.

Places in the permutation come from sums over blocks and then within a block, so a source that holds
a third of all rows is many small groups.

Defined results: tokens are words [^\\x20\\x09-\\x0D]+ plus one, so a null or empty text counts one; a
null source is a source of its own; repeated rows are drawn each for itself (equal rows are alike);
an empty table gives no rows; the columns of ``docs`` are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Rows that a block is meant to hold; sources that a broadcast may hold.
BLOCK_ROWS, BROADCAST_ROWS = 2_000, 100_000
STEPS = 40
#: Files of a table with a row for each source.
FEW = 4
#: Share of the greatest possible entropy that the weights must reach, and the most epochs of a source.
TARGET_ENTROPY, MOST_EPOCHS = 0.97, 4.0


def tokens(text: Column) -> Column:
    return (F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")) + 1).cast("long")


def _powers(shares: Column, exponent: Column) -> Column:
    return F.transform(shares, lambda p: F.pow(p, exponent))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _reaches(shares: Column, exponent: Column, entropy: float, epochs: float) -> Column:
    """Whether weights at this exponent are even enough and no source repeats too often."""
    raised = lambda: _powers(shares, exponent)
    # H(w) = ln Z - sum(p^a ln p^a) / Z, with Z the sum of p^a.
    z = _total(raised())
    mass = F.aggregate(shares, F.lit(0.0), lambda a, p: a + F.pow(p, exponent) * exponent * F.ln(p))
    even = F.ln(z) - mass / z >= entropy * F.ln(F.size(shares).cast("double"))
    often = F.array_max(F.transform(shares, lambda p: F.pow(p, exponent) / p)) / z
    return even, often <= epochs


def mixing_exponent(sizes: DataFrame, entropy: float = TARGET_ENTROPY, epochs: float = MOST_EPOCHS) -> DataFrame:
    """One row: the exponent for the sources' tokens (``sizes``: t)."""
    own = sizes.agg(F.sort_array(F.collect_list(F.col("t").cast("double"))).alias("t")).withColumn("all", _total(F.col("t")))
    own = own.select(F.transform("t", lambda x: x / F.col("all")).alias("shares"))

    def step(state: Column, _: Column) -> Column:
        middle = (state["low"] + state["high"]) / 2
        even, seldom = _reaches(F.col("shares"), middle, entropy, epochs)
        # A smaller exponent is more even and repeats more; the limit on repetition goes first.
        up = ~seldom | even
        return F.struct(F.when(up, middle).otherwise(state["low"]).alias("low"), F.when(up, state["high"]).otherwise(middle).alias("high"))

    start = F.struct(F.lit(0.0).alias("low"), F.lit(1.0).alias("high"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step)
    return own.select(F.round(found["low"], 9).alias("exponent"))


def budgets(rows: DataFrame, entropy: float = TARGET_ENTROPY, epochs: float = MOST_EPOCHS) -> DataFrame:
    """Per source of ``rows`` (s, w: tokens): s, t, blocks, exponent, weight, budget, whole (epochs) and rest (tokens of the last, partial epoch)."""
    sizes = stored(rows.groupBy("s").agg(F.sum("w").alias("t"), F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias("blocks")), "sizes", FEW)
    exponent = mixing_exponent(sizes, entropy, epochs).first()[0]
    raised = F.pow(F.col("t").cast("double"), F.lit(exponent))
    z, everything = sizes.agg(F.sum(raised), F.sum("t")).first()
    weighed = sizes.withColumn("exponent", F.lit(exponent)).withColumn("weight", raised / F.lit(z)).withColumn("budget", F.round(F.col("weight") * F.lit(everything)).cast("long"))
    return weighed.select("s", "t", "blocks", "exponent", "weight", "budget", F.expr("budget div t").alias("whole"), (F.col("budget") % F.col("t")).alias("rest"))


def _order(epoch: Column) -> Column:
    """A row's place in an epoch's permutation, as sixteen hexadecimal digits."""
    return F.substring(F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), epoch.cast("string")).cast("binary")), 1, 16)


def _block(blocks: Column) -> Column:
    name = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(name, 1, 8), 16, 10).cast("long") % blocks


def _block_order(block: Column, epoch: Column) -> Column:
    return F.substring(F.md5(F.concat_ws("/", block.cast("string"), epoch.cast("string")).cast("binary")), 1, 16)


def _marked(docs: DataFrame) -> DataFrame:
    return docs.withColumn("mix_tokens", tokens(F.col("text"))).withColumn("mix_source", F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("-")))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def mixing_plan(docs: DataFrame, entropy: float = TARGET_ENTROPY, epochs: float = MOST_EPOCHS) -> DataFrame:
    """Per source: its budget and where in the last epoch's permutation the budget is met (cut_block: order of the block, cut: order of the row)."""
    light = stored(_marked(docs).select("doc_id", F.col("mix_source").alias("s"), F.col("mix_tokens").alias("w")), "light")
    plan = stored(budgets(light, entropy, epochs), "budgets", FEW)
    placed = light.join(_small(plan.select("s", "blocks", "whole", "rest")), "s").where("rest > 0").withColumn("block", _block(F.col("blocks"))).withColumn("turn", _block_order(F.col("block"), F.col("whole")))
    blocks = placed.groupBy("s", "turn", "block", "rest", "whole").agg(F.sum("w").alias("b"))
    before = Window.partitionBy("s").orderBy("turn", "block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = stored(blocks.withColumn("had", F.sum("b").over(before) - F.col("b")).where("had < rest and rest <= had + b").select("s", "block", "turn", (F.col("rest") - F.col("had")).alias("left")), "cuts", FEW)
    inner = Window.partitionBy("s", "block").orderBy("place").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = placed.drop("turn").join(_small(cut.drop("turn")), ["s", "block"]).withColumn("place", _order(F.col("whole")))
    ends = rows.groupBy("s", "block", "place", "left").agg(F.sum("w").alias("w")).withColumn("had", F.sum("w").over(inner) - F.col("w")).where("had < left").groupBy("s").agg(F.max("place").alias("cut"))
    return stored(plan.join(cut.select("s", F.col("turn").alias("cut_turn"), F.col("block").alias("cut_block")), "s", "left").join(ends, "s", "left"), "plan", FEW)


#: What mix_sources adds; columns of that name in the input give way.
OWN = ("mix_epoch", "mix_turn", "mix_place", "mix_tokens", "mix_weight")


def mix_sources(docs: DataFrame, entropy: float = TARGET_ENTROPY, epochs: float = MOST_EPOCHS) -> DataFrame:
    """The rows drawn from ``docs``, with all its columns and mix_epoch, mix_turn, mix_place (sort by these three for the stream), mix_tokens, mix_weight."""
    plan = _small(mixing_plan(docs.select("doc_id", "text", "source"), entropy, epochs))
    rows = _marked(docs.select("doc_id", "text", "source", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")))
    rows = rows.withColumnRenamed("mix_source", "s").join(plan, "s").withColumn("mix_block", _block(F.col("blocks")))
    turn, place = _block_order(F.col("mix_block"), F.col("whole")), _order(F.col("whole"))
    ahead = (turn < F.col("cut_turn")) | ((turn == F.col("cut_turn")) & ((F.col("mix_block") < F.col("cut_block")) | ((F.col("mix_block") == F.col("cut_block")) & (place <= F.col("cut")))))
    draws = F.col("whole") + F.when(F.coalesce(ahead, F.lit(False)), 1).otherwise(0)
    drawn = rows.withColumn("mix_draws", draws).where("mix_draws > 0").withColumn("mix_epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("mix_draws") - 1)))
    kept = [F.col("_row").getField(c).alias(c) for c in docs.columns if c not in OWN]
    return drawn.select(*kept, "mix_epoch", _block_order(F.col("mix_block"), F.col("mix_epoch")).alias("mix_turn"), _order(F.col("mix_epoch")).alias("mix_place"), "mix_tokens", F.round("weight", 6).alias("mix_weight"))


#: The same in DuckDB's SQL over ``documents``.
SQL = rf"""
WITH RECURSIVE rows_ AS (
  SELECT doc_id, coalesce('s' || source, '-') AS s, len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) + 1 AS w FROM documents
), sizes AS (
  SELECT s, sum(w)::BIGINT AS t, ceil(count(*) / {BLOCK_ROWS}.0)::BIGINT AS blocks FROM rows_ GROUP BY s
), shares AS (
  SELECT t / (SELECT sum(t) FROM sizes) AS p FROM sizes
), steps(k, low, high) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT k + 1, CASE WHEN often > {MOST_EPOCHS} OR even THEN mid ELSE low END, CASE WHEN often > {MOST_EPOCHS} OR even THEN high ELSE mid END
  FROM (
    SELECT k, low, high, (low + high) / 2 AS mid,
      (SELECT max(pow(p, (low + high) / 2) / p) / sum(pow(p, (low + high) / 2)) FROM shares) AS often,
      (SELECT ln(sum(pow(p, (low + high) / 2))) - sum(pow(p, (low + high) / 2) * (low + high) / 2 * ln(p)) / sum(pow(p, (low + high) / 2)) >= {TARGET_ENTROPY} * ln(count(*)) FROM shares) AS even
    FROM steps WHERE k < {STEPS}
  )
), exponent AS (
  SELECT round(low, 9) AS e FROM steps WHERE k = {STEPS}
), weights AS (
  SELECT s, t, blocks, pow(t, e) / (SELECT sum(pow(t, e)) FROM sizes, exponent) AS weight FROM sizes, exponent
), plan AS (
  SELECT *, round(weight * (SELECT sum(t) FROM sizes))::BIGINT AS budget FROM weights
), placed AS (
  SELECT doc_id, s, w, weight, budget // t AS whole, budget % t AS rest, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % blocks AS block FROM rows_ JOIN plan USING (s)
), ordered AS (
  SELECT *, substr(md5(block || '/' || whole), 1, 16) AS turn, substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || whole), 1, 16) AS place FROM placed
), sums AS (
  SELECT *, sum(w) OVER (PARTITION BY s ORDER BY turn, block, place RANGE UNBOUNDED PRECEDING) - sum(w) OVER (PARTITION BY s, turn, block, place) AS had FROM ordered
), drawn AS (
  SELECT *, unnest(range((whole + (had < rest)::INT)::BIGINT)) AS epoch FROM sums
)
SELECT doc_id, epoch AS mix_epoch, substr(md5(block || '/' || epoch), 1, 16) AS mix_turn, substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || epoch), 1, 16) AS mix_place, w::BIGINT AS mix_tokens, round(weight, 6) AS mix_weight FROM drawn
"""
