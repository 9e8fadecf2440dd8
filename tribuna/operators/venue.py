"""Venue types: lookup with fallback, phrase dictionary, consensus, taxonomy migration, governance of the lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import TAGS, normalize_venue, sub_phrases, with_text_features
from ..sources.scratch import materialise
from .ranks import quantiles, small


def venue_types(df: DataFrame, lookup: DataFrame, site: str = "site", order: str = "_ord") -> DataFrame:
    """Adds type_site and flag_site_desconocido by the normalised name. The last of repeated lookup names wins."""
    key = lookup.select(normalize_venue(F.col("site")).alias("_key"), "type_site", order).where("_key <> ''")
    key = key.groupBy("_key").agg(F.max_by("type_site", order).alias("_type"))
    out = df.withColumn("_key", normalize_venue(F.col(site))).join(small(key), "_key", "left").drop("_key")
    return out.withColumn("type_site", F.coalesce("_type", F.lit(rules.UNKNOWN_TYPE))).withColumn("flag_site_desconocido", F.when(F.col("_type").isNull(), 1).otherwise(0)).drop("_type")


def exact_types(df: DataFrame, lookup: DataFrame, site: str = "site", fallback: str = "otro") -> DataFrame:
    """Left join on the text as it stands."""
    return df.join(small(lookup.select(F.col("site").alias(site), F.col("type_site").alias("_t"))), site, "left").withColumn("type_site", F.coalesce("_t", F.lit(fallback))).drop("_t")


def dictionary_types(df: DataFrame, dictionary: DataFrame, site: str = "site") -> DataFrame:
    """Adds dictionary_type: an exact name, else the first entry (by _ord) of two words and eight characters or more that the
    name holds as a phrase. Names give their phrases, as long as the dictionary's longest, and join by equality, so there is no
    nested-loop join."""
    entries = dictionary.select(normalize_venue(F.col("site")).alias("phrase"), F.col("type_site").alias("_type"), "_ord").where("phrase <> ''")
    entries = entries.groupBy("phrase").agg(F.min_by("_type", "_ord").alias("_type"), F.min("_ord").alias("_ord"))
    names = df.select(normalize_venue(F.col(site)).alias("_name")).distinct()
    most = entries.agg(F.coalesce(F.max(F.size(F.split("phrase", " "))), F.lit(1))).first()[0]
    phrases = F.array_union(F.array("_name"), sub_phrases(F.split("_name", " "), most))
    found = names.select("_name", F.explode(phrases).alias("phrase")).join(small(entries), "phrase")
    found = found.where((F.col("phrase") == F.col("_name")) | (F.contains("phrase", F.lit(" ")) & (F.length("phrase") >= 8)))
    best = found.groupBy("_name").agg(F.min_by("_type", F.struct(F.col("phrase") != F.col("_name"), F.col("_ord"))).alias("dictionary_type"))
    return df.withColumn("_name", normalize_venue(F.col(site))).join(best, "_name", "left").drop("_name")


def classify_venues(df: DataFrame, site: str = "site", quota: str = "aforo_max") -> DataFrame:
    """Adds both passes and the consensus; `dictionary_type`, `external_type` and `external_confidence` are used if present."""
    dictionary = F.col("dictionary_type") if "dictionary_type" in df.columns else F.lit(None).cast("string")
    external = [F.col(c) if c in df.columns else F.lit(None).cast(t) for c, t in (("external_type", "string"), ("external_confidence", "double"))]
    df = df.withColumn("_name", normalize_venue(F.col(site)))
    df = df.withColumn("a", rules.classify_a(F.col("_name"), F.col(quota), dictionary)).withColumn("b", rules.classify_b(F.col("_name"), F.col(quota), dictionary)).drop("_name")
    return df.withColumn("verdict", rules.consensus(*external, F.col("a"), F.col("b"), dictionary))


def review_queue(classified: DataFrame) -> DataFrame:
    return classified.where("verdict.review")


def accepted(classified: DataFrame) -> DataFrame:
    return classified.where("NOT verdict.review")


def migrate_lookup(lookup: DataFrame) -> DataFrame:
    """Adds new_type in the present taxonomy."""
    dictionary = F.col("dictionary_type") if "dictionary_type" in lookup.columns else F.lit(None).cast("string")
    return lookup.withColumn("new_type", rules.migrate_type(normalize_venue(F.col("site")), F.col("type_site"), dictionary))


def merge_precedence(first: DataFrame, second: DataFrame, key: str = "site") -> DataFrame:
    """Union in which rows of `first` win over rows of `second` of the same key."""
    both = first.withColumn("_p", F.lit(0)).unionByName(second.withColumn("_p", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("_p")
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_p")


def consolidate_review(lookup: DataFrame, review: DataFrame) -> DataFrame:
    """Reviewed types (valid ones) with confidence 1 and their source over the automatic lookup."""
    done = review.where(F.trim("type_final").isin(*rules.VENUE_TYPES)).select("site", F.trim("type_final").alias("type_site"), F.lit(1.0).alias("confianza"), F.lit("revision_humana").alias("fuente"))
    return merge_precedence(done, lookup.select("site", "type_site", "confianza", "fuente"))


def coverage(lookup: DataFrame, sites: DataFrame, key: str = "site") -> DataFrame:
    """One row: lookup_rows, distinct sites, pct of the sites that the lookup's rows make up."""
    rows, names = lookup.agg(F.count("*").alias("lookup_rows")), sites.agg(F.count_distinct(key).alias("sites"))
    return rows.crossJoin(names).withColumn("pct", F.when(F.col("sites") > 0, 100 * F.col("lookup_rows") / F.when(F.col("sites") > 0, F.col("sites"))))  # single rows


def unprocessed(df: DataFrame, done: DataFrame, key: str = "site") -> DataFrame:
    """Rows whose key was not handled yet."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def type_frequencies(rows: DataFrame, cold: int = 50, dominant: float = 0.70) -> DataFrame:
    """Per type of the fixed domain: rows, share, distinct venues, and flags for empty, cold and dominant types."""
    domain = rows.sparkSession.createDataFrame([(t,) for t in (*rules.VENUE_TYPES, rules.UNKNOWN_TYPE)], "type_site string")
    counts = rows.groupBy("type_site").agg(F.count("*").alias("n"), F.count_distinct("site").alias("sites"))
    out = F.broadcast(domain).join(counts, "type_site", "left").fillna(0, ["n", "sites"])  # eleven rows
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))  # over the eleven rows of the domain
    share = F.when(total > 0, F.col("n") / F.when(total > 0, total)).otherwise(F.lit(0.0))
    out = out.withColumn("share", share)
    return out.withColumn("is_empty", F.col("n") == 0).withColumn("is_cold", (F.col("n") > 0) & (F.col("n") < cold)).withColumn("is_dominant", F.col("share") > dominant)


def tag_profile(df: DataFrame, price: str = "med_base_unit_amt_itx", name: str = "logical_seat_category") -> DataFrame:
    """tag, n, mean_price, std_price, mean_quota, median_price of the rows with each tag.

    Names alone are cleaned and tagged. Prices and quotas are written once by name; each measure but the median is a sum a name."""
    rows = materialise(df.select(F.col(name).alias("_name"), F.col(price).alias("_p"), F.col("dn_quota").alias("_q")), "priced")
    sums = [F.count("*").alias("n"), F.count("_p").alias("_m"), F.sum("_p").alias("_sp"), F.count("_q").alias("_mq"), F.sum("_q").alias("_sq")]
    per = materialise(rows.groupBy("_name").agg(*sums), "names")
    tags = F.filter(F.array(*[F.when(F.col(t) == 1, F.lit(t)) for t in TAGS]), lambda t: t.isNotNull())
    tagged = small(materialise(with_text_features(per.select("_name"), "_name").select("_name", F.explode(tags).alias("tag")), "tags"))
    mean = lambda s, m: F.sum(s) / F.when(F.sum(m) > 0, F.sum(m))
    one = per.join(tagged, per["_name"].eqNullSafe(tagged["_name"])).groupBy("tag").agg(F.sum("n").alias("n"), mean("_sp", "_m").alias("mean_price"), mean("_sq", "_mq").alias("mean_quota"), F.sum("_m").alias("_m"))
    one = small(materialise(one, "profile"))  # a row a tag
    long = rows.join(tagged, rows["_name"].eqNullSafe(tagged["_name"])).select("tag", "_p")
    off = F.col("_p") - F.col("mean_price")
    spread = long.join(one.select("tag", "mean_price", "_m"), "tag").groupBy("tag").agg(F.sqrt(F.sum(off * off) / F.when(F.any_value("_m") > 1, F.any_value("_m") - 1)).alias("std_price"))
    middle = quantiles(long, ["tag"], "_p", 2, (1,), stored=True).select("tag", F.col("q").alias("median_price"))
    return one.join(spread, "tag").join(middle, "tag", "left").select("tag", "n", "mean_price", "std_price", "mean_quota", "median_price")
