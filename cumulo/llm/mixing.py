"""Mixing sources to target weights by Efraimidis-Spirakis keys, in DataFrame functions only.

Every document draws an exponential key, divided by its quality weight. Within a
source the documents in key order are taken until the source's budget is used
up; where the budget exceeds the source, every document is first taken in whole
epochs and only the fraction that is left is selected by key.

The prefix sums need no sort of a whole source: keys map onto 2^24 ordered
slots, two rounds of 4,096 sums each find the slot where a source's budget ends,
and only that slot's documents are ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cumulo.llm.common import OWN, WORD, attach_groups, stored

#: Each level of slots; two levels.
SLOTS = 4096
#: A target stops at so many times its source's size.
MOST_EPOCHS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """0.1 to 1: the share of characters that are neither ASCII digits nor punctuation; 0.1 for no text."""
    plain = F.length(F.regexp_replace(text, r"[!-@\[-`{-~]", ""))
    return F.lit(0.1) + F.lit(0.9) * F.coalesce(F.try_divide(plain, F.length(text)), F.lit(0.0))


def exponential_key(doc_id: Column, weight: Column, seed: int) -> Column:
    """-ln(u) / weight with u from 52 bits of SHA-256, the same in every run and engine."""
    name = F.concat(F.lit(f"mix:{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    bits = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 13), 16, 10).cast("double")
    return -F.ln((bits + 0.5) / F.lit(float(1 << 52))) / weight


def source_targets(sizes: DataFrame) -> DataFrame:
    """(key, source, source_size, ...) to targets: weights 1, 2, 3 by code point order, capped, excess shared.

    The level at which capped sources fill up is found in closed form: in order
    of cap / weight, a source is capped while the level that the rest would get
    is not below its own. One row per source.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    ranked = sizes.withColumn("weight", (F.row_number().over(by_name) - 1) % 3 + 1).withColumn(
        "cap", MOST_EPOCHS * F.col("source_size"))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), "key")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    leveled = ranked.withColumn("level", level).withColumn("capped", F.col("cap") <= F.col("level") * F.col("weight"))
    # The first source that is not capped fixes the level; what later rows compute is lower.
    final = F.max(F.when(~F.col("capped"), F.col("level"))).over(everything)
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(final * F.col("weight"))
    return leveled.withColumn("target", target).drop("weight", "cap", "level", "capped")


def _keyed(docs: DataFrame, seed: int, keep: list[str]) -> DataFrame:
    text = F.col("text")
    keyed = docs.select(
        *keep, F.col("doc_id").alias(OWN + "id"), F.col("source").alias(OWN + "source"),
        F.when(F.col("source").isNull(), "0").otherwise(F.concat(F.lit("1"), "source")).alias(OWN + "key"),
        word_count(text).alias(OWN + "size"), exponential_key(F.col("doc_id"), quality_weight(text), seed).alias(OWN + "e"),
        F.xxhash64("text").alias(OWN + "tie"))
    slot = F.floor(F.col(OWN + "e") / (1 + F.col(OWN + "e")) * F.lit(float(SLOTS * SLOTS)))
    return keyed.withColumn(OWN + "slot", F.least(slot, F.lit(SLOTS * SLOTS - 1)).cast("long"))


def _order() -> Column:
    return F.struct(OWN + "e", OWN + "id", OWN + "tie")


def _ending(sums: DataFrame, slot: str) -> DataFrame:
    """The slot of each source in which its budget ends, and the words before it."""
    window = Window.partitionBy(OWN + "key").orderBy(slot)
    through = F.sum("words").over(window)
    return (
        sums.withColumn("through", through + F.col("before")).withColumn("before", F.col("through") - F.col("words"))
        .where("before <= fraction AND through > fraction").drop("through", "words")
    )


def cuts(keyed: DataFrame) -> tuple[DataFrame, int]:
    """Per source: size, target, whole epochs, and the last document of the fraction. Also the row count."""
    key = OWN + "key"
    sizes = keyed.groupBy(F.col(key).alias("key"), F.col(OWN + "source").alias("source")).agg(
        F.sum(OWN + "size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = stored(
        source_targets(sizes).withColumn("epochs", epochs.cast("long"))
        .withColumn("fraction", F.col("target") - F.col("epochs") * F.col("source_size")).withColumnRenamed("key", key))
    total = plan.agg(F.sum("rows")).first()[0] or 0
    high = F.floor(F.col(OWN + "slot") / SLOTS)
    first = keyed.groupBy(key, high.alias("high")).agg(F.sum(OWN + "size").alias("words"))
    first = first.join(plan.select(key, "rows", "fraction"), key).withColumn("before", F.lit(0).cast("long"))
    first = stored(_ending(first, "high"))
    inside = attach_groups(keyed, first, [key], "rows", total).where(high == F.col("high"))
    second = inside.groupBy(key, OWN + "slot", "rows", "fraction", "before").agg(F.sum(OWN + "size").alias("words"))
    second = stored(_ending(second, OWN + "slot").withColumnRenamed(OWN + "slot", "end_slot"))
    # Rows alike in id and text share a key; they are taken together or not at all.
    slot = attach_groups(keyed, second, [key], "rows", total).where(F.col(OWN + "slot") == F.col("end_slot"))
    alike = slot.groupBy(key, "end_slot", "fraction", "before", _order().alias("last")).agg(F.sum(OWN + "size").alias("words"))
    through = F.sum("words").over(Window.partitionBy(key).orderBy("last"))
    taken = alike.withColumn("through", F.col("before") + through).where(
        F.col("through") - F.col("words") / 2 <= F.col("fraction"))
    last = taken.groupBy(key).agg(F.max("last").alias("last"))
    return stored(plan.join(second.select(key, "end_slot"), key, "left").join(last, key, "left")), total


def _times(prefix: str = "") -> Column:
    """Copies of a document that the mix takes: whole epochs, plus one if it comes before the end of the fraction."""
    slot, end = F.col(OWN + "slot"), F.col(prefix + "end_slot")
    selected = (slot < end) | ((slot == end) & (_order() <= F.col(prefix + "last")))
    return F.col(prefix + "epochs") + F.coalesce(selected, F.lit(False)).cast("long")


def mix_report(docs: DataFrame, seed: int = 0) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken (words, repeats counted).

    Size is the number of words, 0 for null. Sources weigh 1, 2, 3 in code point
    order, null last, and share all words; targets stop at 3 times the source. The
    last document of a fraction is taken if that brings the sum nearer to the
    target. Sources without words have target 0. An empty table gives no rows.
    """
    keyed = stored(_keyed(docs, seed, []))
    plan, total = cuts(keyed)
    return attach_groups(keyed, plan, [OWN + "key"], "rows", total).select(
        F.col(OWN + "id").alias("doc_id"), F.col(OWN + "size").alias("size"), "source_size", "target",
        (F.col(OWN + "size") * _times()).alias("taken"))


def mix(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The mixed corpus: each document as often as the mix takes it, with the columns of the input.

    Documents without words count nothing and stay in whole epochs only.
    """
    key, prefix = OWN + "key", OWN + "plan_"
    plan, total = cuts(stored(_keyed(docs, seed, [])))
    plan = plan.withColumnsRenamed({c: prefix + c for c in plan.columns if c != key})
    rows = _keyed(docs, seed, [F.struct(*docs.columns).alias(OWN + "row")])
    copies = attach_groups(rows, plan, [key], prefix + "rows", total).withColumn(OWN + "times", _times(prefix))
    return copies.where(F.col(OWN + "times") > 0).select(
        OWN + "row", F.explode(F.sequence(F.lit(1).cast("long"), OWN + "times")).alias(OWN + "copy")).select(OWN + "row.*")


SQL = r"""
WITH plain AS (
  SELECT doc_id, source, coalesce(text, '') AS text, length(text) AS chars,
         length(regexp_replace(text, '[!-@\[-`{-~]', '', 'g')) AS letters,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(sha256('mix:0:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT AS bits
  FROM documents),
keyed AS (
  SELECT doc_id, source, text, size,
         -ln((bits + 0.5::DOUBLE) / 4503599627370496::DOUBLE)
           / (0.1::DOUBLE + 0.9::DOUBLE * CASE WHEN chars > 0 THEN letters::DOUBLE / chars ELSE 0 END) AS e
  FROM plain),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM keyed GROUP BY source),
ranked AS (
  SELECT source, source_size, (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1 AS weight,
         3 * source_size AS cap
  FROM sizes),
leveled AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0))::DOUBLE
            / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM ranked
  WINDOW before AS (ORDER BY cap::DOUBLE / weight, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size, CASE WHEN cap <= level * weight THEN cap::DOUBLE
         ELSE max(CASE WHEN cap > level * weight THEN level END) OVER () * weight END AS target
  FROM leveled),
budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM targets),
alike AS (SELECT source, e, doc_id, text, sum(size) AS words FROM keyed GROUP BY ALL),
ordered AS (
  SELECT *, sum(words) OVER (PARTITION BY source ORDER BY e, doc_id NULLS FIRST, text) AS through FROM alike),
chosen AS (
  SELECT o.source, o.e, o.doc_id, o.text
  FROM ordered o JOIN budgets b ON o.source IS NOT DISTINCT FROM b.source
  WHERE o.through - o.words / 2 <= b.target - b.epochs * b.source_size)
SELECT k.doc_id, k.size, b.source_size, b.target,
       (k.size * (b.epochs + CASE WHEN c.e IS NULL THEN 0 ELSE 1 END))::BIGINT AS taken
FROM keyed k JOIN budgets b ON k.source IS NOT DISTINCT FROM b.source
LEFT JOIN chosen c ON k.source IS NOT DISTINCT FROM c.source AND k.e = c.e
  AND k.doc_id IS NOT DISTINCT FROM c.doc_id AND k.text = c.text
"""
