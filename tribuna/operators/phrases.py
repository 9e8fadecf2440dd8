"""Mining of marketing phrases: classes by pattern, n-grams, subsumption, tiers, review queue, consolidation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ngrams, normalize_text, sub_phrases
from ..sources.scratch import materialise
from .ranks import small

_MONTHS = r"\b(ENE|FEB|MAR|ABR|MAYO|JUN|JUL|AGO|SEP|OCT|NOV|DIC|ENERO|FEBRERO|MARZO|ABRIL|JUNIO|JULIO|AGOSTO|SEPTIEMBRE|OCTUBRE|NOVIEMBRE|DICIEMBRE)\b"
_CITIES = r"\b(BOGOTA|MEDELLIN|CALI|BARRANQUILLA|CARTAGENA|BUCARAMANGA|PEREIRA|MANIZALES|SANTA MARTA|IBAGUE|CUCUTA|VILLAVICENCIO|PASTO|POPAYAN|ARMENIA|MONTERIA|VALLEDUPAR)\b"
#: Class -> (pattern that finds, pattern that is proposed).
CLASSES = {
    "calendario": (_MONTHS, r"\b(ENE|FEB|MAR|ABR|MAYO|JUN|JUL|AGO|SEP|OCT|NOV|DIC)\b"),
    "credito": (r"\(DIR\.[^\)]*\)|\bDIR\.\s+[A-Z]+|\(DIR\.", r"\(DIR\.[^\)]*\)"),
    "duracion": (r"\b\d+\s*MIN\b", r"\b\d+\s*MIN\b"),
    "ciudad": (_CITIES, _CITIES),
    "venue_paren": (r"\([^\)]*(?:TEATRO|MUSEO|PARQUE|ARENA|COLISEO)[^\)]*\)", r"\([^\)]*(TEATRO|MUSEO|PARQUE|ARENA|COLISEO)[^\)]*\)"),
}
#: Words of the tags that no phrase may hold.
TAG_WORDS = """
PALCO PALCOS BOX BOXES SUITE SUITES MESA MESAS
VIP PLATINUM PLATINO PREMIUM GOLD DIAMANTE ORO PLATA
PLATEA SILLAS SILLERIA PISTA CANCHA
PREFERENCIAL PREFERENTE CENTRAL FRONTAL
GENERAL TIQUETE ENTRADA STANDARD NORMAL ADMISION
BALCON BALCONES MEZZANINE VOLADIZO
ALTA ALTAS PISO SEGUNDO TERCER CUARTO POSTERIOR ALTO
BAJA BAJAS PRIMER PLANTA DELANTERA FILA BAJO
OCCIDENTAL OCC OESTE ORIENTAL ORI ESTE NORTE NTE SUR
LATERAL LATERALES COSTADO ESQUINA
VISTA VISIBILIDAD PARCIAL RESTRINGIDA REDUCIDA OBSTRUIDA PILARES
FAMILIAR FAMILIA MENORES KIDS NINOS INFANTIL LIBRE ALCOHOL CERO
MOVILIDAD DISCAPACIDAD PMR RUEDAS ACCESIBLE
""".split()
#: Words that no phrase may hold besides those of the tags and classes, and words it may not begin or end with.
STRUCTURE = {"GENERAL", "PALCO", "PLATEA", "GRADA", "GRADAS", "BALCON", "VIP", "PREFERENCIAL", "FILA", "SILLA", "SILLAS", "MESA", "MESAS", "PISO", "OCCIDENTAL", "NORTE", "SUR", "ORIENTAL", "TRIBUNA", "SECTOR", "LOCALIDAD", "ASIENTO", "BOLETA", "ENTRADA", "NIVEL", "ZONA", "SECCION", "BLOQUE", "PUERTA", "ACCESO", "CORREDOR", "UBICACION"}
EDGES = ["DE", "LA", "EL", "EN", "Y", "A", "DEL", "LOS", "LAS", "POR", "CON", "PARA", "UN", "UNA", "AL", "O", "E", "ES", "SE", "SU", "SUS", "MAS", "LO", "LE", "LES"]


def forbidden_words(extra: Sequence[str] = ()) -> list[str]:
    """Words of tags, structure, classes and a model's vocabulary, upper case."""
    classes = {w for p in (_MONTHS, _CITIES) for part in p[3:-3].split("|") for w in part.split()}
    return sorted({*TAG_WORDS, *STRUCTURE, *classes, "DIR", *(w.upper() for w in extra)})


def _by_product(df: DataFrame, product: str, event: str) -> DataFrame:
    """raw, lone, e, n, k: distinct (product, event) pairs, counted by product where the event has no other product (lone; e is null);
    a pair of an event with several stays a row of its own. n is pairs, k is lone events. Words are cut once a row of this, not once a pair."""
    pairs = df.select(F.col(product).alias("raw"), F.col(event).alias("e")).where("raw IS NOT NULL").distinct()
    lone = F.col("e").isNotNull() & (F.count("*").over(Window.partitionBy("e")) == 1)
    rows = pairs.withColumn("lone", lone).withColumn("e", F.when(~F.col("lone"), F.col("e")))
    return rows.groupBy("raw", "lone", "e").agg(F.count("*").alias("n")).withColumn("k", F.when(F.col("lone"), F.col("n")).otherwise(0))


def phrase_classes(df: DataFrame, product: str = "product", event: str = "t_performance_id") -> DataFrame:
    """One row per class found: pattern, tipo, matches, distinct events, distinct variants, up to three examples (by text)."""
    rows = _by_product(df, product, event).groupBy(normalize_text(F.col("raw")).alias("p"), "lone", "e").agg(F.when(F.col("lone"), F.sum("n")).otherwise(1).alias("n"), F.sum("k").alias("k"))
    per = F.array(*[F.struct(F.lit(k).alias("tipo"), F.lit(out).alias("patron"), F.regexp_extract_all("p", F.lit(find), F.lit(0)).alias("m")) for k, (find, out) in CLASSES.items()])
    hits = materialise(rows.select("p", "e", "n", "k", F.explode(per).alias("c")).select("p", "e", "n", "k", "c.tipo", "c.patron", "c.m").where(F.size("m") > 0), "class-hits")  # read three times
    found = hits.groupBy("tipo", "patron").agg(F.sum(F.col("n") * F.size("m")).alias("frecuencia"), (F.sum("k") + F.count_distinct("e")).alias("n_eventos"))
    variants = hits.select("tipo", F.explode("m").alias("variant")).groupBy("tipo").agg(F.count_distinct("variant").alias("subsumidos"))
    ranked = hits.select("tipo", "p").distinct().withColumn("k", F.row_number().over(Window.partitionBy("tipo").orderBy("p"))).where("k <= 3")
    examples = ranked.groupBy("tipo").agg(F.array_join(F.array_sort(F.collect_list("p")), " | ").alias("ejemplo_producto"))
    return found.join(variants, "tipo").join(examples, "tipo")


def phrase_candidates(df: DataFrame, product: str = "product", event: str = "t_performance_id", known: Sequence[str] = (), extra: Sequence[str] = ()) -> DataFrame:
    """ngram, n_tokens, frecuencia, n_eventos, ejemplo_producto of phrases of one to three words that pass the word lists."""
    clean = F.regexp_replace(normalize_text(F.col("raw")), r"[^A-Z0-9\s]", " ")
    tokens = F.filter(F.split(clean, r"\s+"), lambda t: (F.length(t) > 1) & ~t.rlike("^[0-9]+$"))
    rows = _by_product(df, product, event).withColumn("t", tokens)
    sized = lambda n: F.transform(ngrams(F.col("t"), n), lambda g: F.struct(g.alias("ngram"), F.lit(n).alias("n_tokens")))
    rows = rows.withColumn("grams", F.flatten(F.array(*[sized(n) for n in (1, 2, 3)])))
    times = F.size(F.filter("grams", lambda x: x == F.col("g")))
    long = rows.select("raw", "e", "n", "k", "grams", F.explode(F.array_distinct("grams")).alias("g")).select("raw", "e", "k", (F.col("n") * times).alias("n"), "g.ngram", "g.n_tokens")
    bad, edges = F.array(*[F.lit(w) for w in forbidden_words(extra)]), F.array(*[F.lit(w) for w in EDGES])
    parts = F.split("ngram", " ")
    long = long.where(~F.arrays_overlap(parts, bad) & ~F.array_contains(edges, parts[0]) & ~F.array_contains(edges, F.element_at(parts, -1)) & (F.length("ngram") >= 3))
    if known:
        long = long.where(~F.col("ngram").isin(*known))
    return long.groupBy("ngram", "n_tokens").agg(F.sum("n").alias("frecuencia"), (F.sum("k") + F.count_distinct("e")).alias("n_eventos"), F.min("raw").alias("ejemplo_producto"))


def tiers(candidates: DataFrame, least_events: int = 20, seen: int = 3) -> DataFrame:
    """Adds tier: review, observe or drop."""
    return candidates.withColumn("tier", F.when(F.col("n_eventos") >= least_events, "review").when(F.col("n_eventos") >= seen, "observe").otherwise("drop"))


def subsume(candidates: DataFrame, text: str = "ngram") -> DataFrame:
    """Phrases that no higher-ranked phrase holds, with the number each absorbed. Order: frequency, events, words, length, text.

    A longer phrase gives its own sub-phrases and these join by equality, so the work is a few rows a phrase. Containment is
    transitive, so what holds a phrase is, at the top of the ranking, a survivor itself.
    """
    candidates = materialise(candidates, "candidates")  # read three times
    rank = F.struct(-F.col("frecuencia"), -F.col("n_eventos"), -F.col("n_tokens"), -F.length(text), F.col(text))
    c = candidates.withColumn("rank", rank)
    words = F.split(text, " ")
    subs = sub_phrases(words, F.size(words))
    holds = c.select(F.col(text).alias("holder"), F.col("rank").alias("holder_rank"), F.explode(subs).alias(text)).where(F.col(text) != F.col("holder"))
    parents = c.select(text, "rank").join(holds, text).where("holder_rank < rank").groupBy(text).agg(F.min_by("holder", "holder_rank").alias("holder"))
    absorbed = parents.groupBy(F.col("holder").alias(text)).agg(F.count("*").alias("subsumidos"))
    return c.drop("rank").join(parents.select(text), text, "left_anti").join(absorbed, text, "left").fillna(0, ["subsumidos"])


def compression(candidates: DataFrame, classes: DataFrame, least_events: int = 20, most: int = 100) -> DataFrame:
    """One row: brutos (phrases found), tras_subsumcion (those for review that no other holds), tras_clases (with classes of as many
    events), final (what the queue takes)."""
    candidates = materialise(candidates, "phrases")  # read twice
    kept = subsume(candidates.where(F.col("n_eventos") >= least_events)).agg(F.count("*").alias("tras_subsumcion"))
    systematic = classes.where(F.col("n_eventos") >= least_events).agg(F.count("*").alias("c"))
    one = candidates.agg(F.count("*").alias("brutos")).crossJoin(kept).crossJoin(systematic)  # single rows
    return one.withColumn("tras_clases", F.col("tras_subsumcion") + F.col("c")).withColumn("final", F.least("tras_clases", F.lit(most).cast("long"))).drop("c")


def review_queue(rows: DataFrame, most: int = 100, key: str = "ngram") -> DataFrame:
    """Adds position and queue: the first `most` rows for review, what is beyond for observation."""
    rows = materialise(rows, "phrases")  # read twice
    top = rows.orderBy(F.desc("frecuencia"), F.desc("n_eventos"), key).limit(most).select(key, F.lit("review").alias("queue"))
    return rows.join(small(top), key, "left").fillna("observe", ["queue"])  # `most` rows


def valid_decisions(review: DataFrame) -> DataFrame:
    """Rows with a decision of the two that count; others are left out."""
    return review.where(F.lower(F.trim("decision")).isin("aceptar", "rechazar"))


def consolidate(official: DataFrame, review: DataFrame, source: str = "revision_humana") -> DataFrame:
    """The official list with accepted phrases that it lacks, under the next version v<n>."""
    new = review.where(F.lower(F.trim("decision")) == "aceptar").select("patron", "tipo").dropDuplicates(["patron"]).join(official.select("patron"), "patron", "left_anti")
    last = official.agg(F.coalesce(F.max(F.expr("try_cast(nullif(regexp_extract(version_vocab, 'v([0-9]+)', 1), '') AS INT)")), F.lit(0)).alias("v"))
    new = new.crossJoin(last).select("patron", "tipo", F.current_date().cast("string").alias("fecha_agregado"), F.lit(source).alias("fuente"), F.concat(F.lit("v"), (F.col("v") + 1).cast("string")).alias("version_vocab"))  # one row
    return official.select(*new.columns).unionByName(new)


def not_proposed_again(candidates: DataFrame, history: DataFrame, text: str = "ngram") -> DataFrame:
    """Candidates without those that were accepted or rejected before."""
    gone = valid_decisions(history).select(F.trim(F.regexp_replace("patron", r"\\b|[\^$]", "")).alias(text))
    return candidates.join(gone.distinct(), text, "left_anti")
