"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Every source has a weight and a size, the words of its documents. A share of all sizes (150 % in the query) is dealt to the
sources by weight. A source that would get more than `epochs` times its size is clamped there, and what it leaves is dealt to the
others by weight again, round after round, until none is above. Everything is whole numbers up to the last division, so a rerun
and an independent computation give the same doubles.

A target is w whole repetitions of the source, w = floor(target / size), and a rest of words. The rest is a fractional repetition:
documents in the order of a seeded hash of id and text are taken once more until the rest is used up; the document at the end of
it is taken in part, its first words. So a source's words meet its target to less than a word (to less than a word a copy, where
rows with equal id and text stand at the end).

The end is found without ordering a source: sizes are summed by the first three hexadecimal digits of the hash, the digits at
which the rest runs out are kept, their documents are summed by the next three, and only documents that share all of them with the
end (a 16-millionth of a source) are summed one by one. Whatever a source's share of the corpus is, no task holds it.

Defined cases: a null or empty text has size 0 and is taken 0 words of; a null source is a source, the last; a source of size 0 has
the target 0; rows with equal id and text are taken alike; extra columns are left alone; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranks import global_rank
from .common import fresh, join_lookup, materialise

#: Weights of the sources in the order of their names, repeating; share of all sizes in percent; most repetitions of a source.
WEIGHTS, PERCENT, EPOCHS, SEED = (5, 2, 1), 150, 2, "mix"
#: Digits of the hash by which sizes are summed at first and next.
DIGITS = (3, 3)


def word_count(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text (null: 0). One letter a word is left, so memory is the text's, however many words."""
    one = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "w")
    return F.length(F.translate(one, " \t\n\x0b\x0c\r", "")).cast("long")


def _place(docs: DataFrame, seed: str) -> Column:
    """Place of a document in the seeded order: 32 hexadecimal digits."""
    return F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(docs["doc_id"].cast("string"), F.lit("")), F.coalesce(docs["text"], F.lit(""))).cast("binary"))


def sizes(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, at: place of a document in its source's seeded order. One row a document, written once."""
    return docs.select("doc_id", "source", word_count(docs["text"]).alias("size"), _place(docs, seed).alias("at"))


def targets(per_source: DataFrame, percent: int = PERCENT, epochs: int = EPOCHS) -> DataFrame:
    """source, weight, source_size -> and num, den (the target is num / den), target.

    A round clamps all sources above the cap; the next deals what is left. One row of sums comes to the driver a round, and each round clamps a
    source at least, so there are no more rounds than weights times sizes differ by."""
    whole = lambda x: F.coalesce(F.sum(x.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
    free = F.lit(True)
    total = per_source.agg(whole(F.col("source_size")).alias("s")).first()["s"]
    clamped_before = -1
    while True:
        r = per_source.agg(whole(F.when(~free, F.col("source_size"))).alias("clamped"), whole(F.when(free, F.col("weight"))).alias("w"), F.count_if(~free).alias("n")).first()
        # what the free sources share is left / 100
        left, w = int(total) * percent - int(r["clamped"]) * epochs * 100, int(r["w"])
        if r["n"] == clamped_before or w == 0:
            break
        clamped_before = r["n"]
        free = F.lit(left).cast("decimal(38,0)") * F.col("weight") <= F.col("source_size").cast("decimal(38,0)") * (epochs * 100 * w)
    num = F.when(free, (F.lit(max(left, 0)).cast("decimal(38,0)") * F.col("weight")).cast("decimal(38,0)")).otherwise((F.col("source_size") * epochs).cast("decimal(38,0)"))
    den = F.when(free, F.lit(100 * max(w, 1)).cast("decimal(38,0)")).otherwise(F.lit(1).cast("decimal(38,0)"))
    return per_source.select("*", num.alias("num"), den.alias("den")).withColumn("target", F.col("num").cast("double") / F.col("den").cast("double"))


def ends(docs: DataFrame, plan: DataFrame, digits: tuple[int, ...] = DIGITS) -> DataFrame:
    """source, end (the place at which the rest runs out), part (words of each document there).

    plan: source, rest. docs: source, size, at."""
    left, found, start = plan.where("rest > 0"), docs.where("size > 0"), 1
    for n in digits:
        found = found.withColumn("digits", F.substring("at", start, n))
        reached = _reached(found.groupBy("source", "digits").agg(F.sum("size").alias("s"), F.count("*").alias("n")), left, "digits")
        reached = materialise(reached.select("source", F.col("digits").alias("_d"), "rest"), "mix-ends")
        found = join_lookup(found, reached.select("source", "_d"), ["source"]).where("digits = _d").drop("_d")
        left, start = reached.select("source", "rest"), start + n
    last = _reached(found.groupBy("source", "at").agg(F.sum("size").alias("s"), F.count("*").alias("n")), left, "at")
    return last.select("source", F.col("at").alias("end"), F.floor(F.col("rest") / F.col("n")).cast("long").alias("part"))


def _reached(summed: DataFrame, left: DataFrame, by: str) -> DataFrame:
    """The row of each source in whose words the rest runs out, and what of the rest is left before it."""
    w = Window.partitionBy("source").orderBy(by)
    upto = summed.withColumn("_upto", F.sum("s").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    joined = join_lookup(upto, left, ["source"])
    return joined.where("_upto >= rest AND _upto - s < rest").withColumn("rest", F.col("rest") - (F.col("_upto") - F.col("s"))).drop("_upto")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, whole (repetitions), part (words of one more)."""
    if percent > 100 * epochs:
        raise ValueError(f"{percent} % of all words cannot be had from at most {epochs} times each")
    d = materialise(sizes(docs, seed), "mix-sizes")
    per_source = d.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = global_rank(per_source, "source").withColumn("_r", F.col("rank") - 1).select("source", "_r")
    # nulls come last: their place is the number of the others
    named = per_source.where("source IS NOT NULL").count()
    place = F.coalesce("_r", F.lit(named))
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    weighted = per_source.join(order, "source", "left").select("source", "source_size", F.get(cycle, (place % len(weights)).cast("int")).alias("weight"))
    t = targets(materialise(weighted, "mix-sources"), percent, epochs)
    floor_target = F.expr("num div den")
    plan = t.select("source", "source_size", "target", F.when(F.col("source_size") > 0, F.floor(floor_target / F.col("source_size"))).otherwise(0).cast("long").alias("whole"), floor_target.cast("long").alias("_t"))
    plan = materialise(plan.select("source", "source_size", "target", "whole", (F.col("_t") - F.col("whole") * F.col("source_size")).alias("rest")), "mix-plan")
    end = ends(d, plan.select("source", "rest"))
    e = end.select(F.col("source").alias("_s"), F.col("end").alias("_end"), F.col("part").alias("_part"))
    full = materialise(plan.join(e, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s"), "mix-plan")
    part = F.when(F.col("at") < F.col("_end"), F.col("size")).when(F.col("at") == F.col("_end"), F.col("_part")).otherwise(F.lit(0))
    out = join_lookup(d, full, ["source"]).withColumn("part", part.cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("part")).alias("taken"), "whole", "part", "at")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """The mix itself: the rows of docs, repeated, and `repetition` from 1. The text of a fractional repetition is its first words, joined by spaces."""
    m = mix(docs, weights, percent, epochs, seed)
    at, source = fresh(docs, "_at"), fresh(docs, "_source")
    plan = m.select(F.col("source").alias(source), F.col("at").alias(at), F.col("whole").alias("_whole"), F.col("part").alias("_part"), F.col("size").alias("_size")).distinct()
    x = docs.join(plan, (_place(docs, seed) == F.col(at)) & docs["source"].eqNullSafe(F.col(source)))
    x = x.where("_size > 0").withColumn("repetition", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_whole") + 1))).where("repetition <= _whole OR _part > 0")
    words = F.array_join(F.slice(F.expr(r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)"), F.lit(1), F.col("_part").cast("int")), " ")
    cut = (F.col("repetition") > F.col("_whole")) & (F.col("_part") < F.col("_size"))
    return x.withColumn("text", F.when(cut, words).otherwise(F.col("text"))).select(*[F.col(f"`{c}`") for c in docs.columns], "repetition")


def mixing_query(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


#: The same independently: sources in the order of their caps over weights, one running sum, one window in the order of the hash.
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
  md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')) AS h FROM documents),
s AS (SELECT source, sum(size)::HUGEINT AS z, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)]::HUGEINT AS w FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY z / w, source NULLS LAST) AS i FROM s),
r AS (SELECT *, coalesce(sum(z) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS below, sum(w) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::HUGEINT AS rest_w, sum(z) OVER ()::HUGEINT AS total FROM o),
f AS (SELECT *, ({PERCENT} * total - {100 * EPOCHS} * below) * w > {100 * EPOCHS} * z * rest_w AS above FROM r),
level AS (SELECT below, rest_w FROM f WHERE NOT above ORDER BY i LIMIT 1),
t AS (SELECT f.source, z, CASE WHEN above THEN {EPOCHS} * z ELSE ({PERCENT} * total - {100 * EPOCHS} * level.below) * w END AS num, CASE WHEN above THEN 1 ELSE 100 * level.rest_w END AS den FROM f LEFT JOIN level ON true),
p AS (SELECT source, z, num::DOUBLE / den::DOUBLE AS target, CASE WHEN z > 0 THEN num // den // z ELSE 0 END AS whole, CASE WHEN z > 0 THEN (num // den) % z ELSE 0 END AS rest FROM t),
u AS (SELECT d.*, p.z, p.target, p.whole, p.rest, sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE UNBOUNDED PRECEDING) AS upto, count(*) FILTER (size > 0) OVER (PARTITION BY d.source, h) AS n FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, CAST(z AS BIGINT) AS source_size, target,
 CAST(whole * size + CASE WHEN size = 0 THEN 0 WHEN upto <= rest THEN size WHEN upto - n * size >= rest THEN 0 ELSE (rest - (upto - n * size)) // n END AS BIGINT) AS taken FROM u"""
