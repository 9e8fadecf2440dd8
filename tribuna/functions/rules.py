"""Ordered pattern ladders: the first rule that fits gives type and confidence. Rules are data; the ladder is one expression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Venue types (the last is the fallback and not one of the ten), and types of the older taxonomy.
VENUE_TYPES = ["ARENA", "CINEMATECA", "ESTADIO", "COLISEO", "MUSEO", "OTROS_RECINTOS", "PARQUE", "PARQUEADERO", "RESTAURANTE", "TEATRO"]
UNKNOWN_TYPE = "desconocido"
OLD_TYPES = {
    "arena_cubierta": "ARENA",
    "cine_sala_cultural": "CINEMATECA",
    "estadio_abierto": "ESTADIO",
    "coliseo": "COLISEO",
    "teatro": "TEATRO",
    "parque_aire_libre": "PARQUE",
    "bar_club": "RESTAURANTE",
    "auditorio": "OTROS_RECINTOS",
    "centro_eventos_carpa": "OTROS_RECINTOS",
    "centro_convenciones": "OTROS_RECINTOS",
    "sala_conciertos": "OTROS_RECINTOS",
    "cabaret_comedia": "OTROS_RECINTOS",
}
#: Fixed values: (words, type, confidence) of the first and second rule list, in order.
RULES_A = [
    (r"PARQUEADERO|PARKING|ESTACIONAMIENTO", "PARQUEADERO", 0.95),
    (r"CAR\s*WASH|LAVADERO", "OTROS_RECINTOS", 0.90),
    (r"VIA\s*40|CARRERA\s*50", "PARQUE", 0.90),
    (r"ESTADIO|CAMPIN|ATANASIO|PASCUAL\s*GUERRERO|PALMASECA|PALOGRANDE|MURILLO\s*TORO|GIRARDOT|STADIUM", "ESTADIO", 0.95),
    (r"MOVISTAR\s*ARENA|ARENA\s+CANAVERALEJO|ARENA\s+BOGOTA|DAVIARENA", "ARENA", 0.95),
    (r"COLISEO|PALACIO\s+DE\s+LOS\s+DEPORTES", "COLISEO", 0.95),
    (r"TEATRO|TEATRINO|SALA\s+TEATRO|SALA\s+TEATRAL", "TEATRO", 0.95),
    (r"AUDITORIO|AULA\s+MAXIMA", "OTROS_RECINTOS", 0.92),
    (r"CINEMATECA|CINE\s+COLOMBO", "CINEMATECA", 0.94),
    (r"PLANETARIO|MALOKA|MUSEO|BIBLIOTECA", "MUSEO", 0.94),
    (r"CARPA|CORFERIAS|CHAMORRO|CENTRO\s+DE\s+EVENTOS|PABELLON|CONVENCIONES|EXPOFUTURO|CENFER|PUERTA\s+DE\s+ORO|CITY\s+HALL", "OTROS_RECINTOS", 0.93),
    (r"BAR|CLUB|RESTAURANTE|DISCOTECA|PUB|GASTROBAR|CANTA\s*BAR|FONDA|STAND\s*UP|RESTOBAR", "RESTAURANTE", 0.91),
    (r"PARQUE|MALECON|BOTANICO|AUTODROMO|PLAZA\s+DE\s+TOROS|CANCHA|DIAMANTE\s+DE\s+BEISBOL|POLIDEPORTIVO", "PARQUE", 0.90),
    (r"HOTEL", "OTROS_RECINTOS", 0.80),
    (r"TREN|TRANSPORTE|AEROPUERTO|FINAL\s+COPA|LABORATORIO", "OTROS_RECINTOS", 0.90),
    (r"SALA", "OTROS_RECINTOS", 0.60),
]
RULES_B = [
    (r"PARQUEADERO|PARKING|ESTACIONAMIENTO", "PARQUEADERO", 0.95),
    (r"CAR\s*WASH|LAVADERO", "OTROS_RECINTOS", 0.90),
    (r"VIA\s*40|CARRERA\s*50", "PARQUE", 0.90),
    (r"ESTADIO|STADIUM|BEISBOL|DIAMANTE", "ESTADIO", 0.95),
    (r"MOVISTAR\s*ARENA|ARENA\s+CANAVERALEJO|DAVIARENA", "ARENA", 0.95),
    (r"POLIDEPORTIVO", "PARQUE", 0.90),
    (r"COLISEO", "COLISEO", 0.90),
    (r"TEATRO|TEATRINO|SALA\s+TEATRAL", "TEATRO", 0.95),
    (r"AUDITORIO|AULA", "OTROS_RECINTOS", 0.94),
    (r"CINEMATECA|CINE", "CINEMATECA", 0.93),
    (r"MUSEO|PLANETARIO|BIBLIOTECA", "MUSEO", 0.93),
    (r"CARPA|EXPO|FERIA|CONVENCION|PABELLON|CENTRO\s+DE\s+EVENTOS|CITY\s+HALL", "OTROS_RECINTOS", 0.92),
    (r"BAR|CLUB|DISCO|LOUNGE|RESTAURANTE|PUB|GASTRO|TASCA|BARRIL|BEER|RESTOBAR", "RESTAURANTE", 0.92),
    (r"PARQUE|PLAZA|JARDIN|BOULEVARD|MALECON|PLAYA|BEACH|AVENIDA|CARRERA|AUTOPISTA|CALLE", "PARQUE", 0.89),
    (r"HOTEL|RESORT", "OTROS_RECINTOS", 0.78),
    (r"TREN|BUS|TRANSPORTE|AEROPUERTO|VIAJE", "OTROS_RECINTOS", 0.95),
    (r"SALA", "OTROS_RECINTOS", 0.60),
    (r"CAPILLA|IGLESIA|CATEDRAL", "OTROS_RECINTOS", 0.85),
    (r"COLEGIO|UNIVERSIDAD|CAMPUS", "OTROS_RECINTOS", 0.83),
]
#: Rules that come before the mapping of older types.
MIGRATION_RULES = [
    (r"PARQUEADERO|PARKING|ESTACIONAMIENTO", "PARQUEADERO", 1.0),
    (r"COLISEO|PALACIO\s+DE\s+LOS\s+DEPORTES", "COLISEO", 1.0),
    (r"MUSEO", "MUSEO", 1.0),
    (r"CINEMATECA|CINE\s+COLOMBO", "CINEMATECA", 1.0),
    (r"MOVISTAR\s*ARENA|ARENA\s+CANAVERALEJO|NECTAR\s+ARENA|INDIGO\s*MOVISTAR\s*ARENA|ARENA\s+LAS\s+MEJORES", "ARENA", 1.0),
    (r"RESTAURANTE|GASTROBAR|BAR|CLUB|DISCOTECA|PUB|FONDA|CANTINA|RESTOBAR", "RESTAURANTE", 1.0),
]
MUSEUM_NAMES = ["MALOKA", "PLANETARIO DE BOGOTA", "BIBLIOTECA NACIONAL DE COLOMBIA"]


def verdict(kind, confidence) -> Column:
    """struct(type, confidence)."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(lit(kind).alias("type"), lit(confidence).cast("double").alias("confidence"))


def ladder(name: Column, rules: Sequence[tuple[str, str, float]]) -> Column:
    """The first rule whose words stand in a normalised name; null if none does."""
    return F.coalesce(*[F.when(name.rlike(rf"\b({words})\b"), verdict(kind, confidence)) for words, kind, confidence in rules])


def classify_a(name: Column, quota: Column, dictionary: Column | None = None) -> Column:
    """First pass over a normalised venue name; dictionary: its type from the curated names, or null."""
    small = verdict(F.when(name.rlike(r"\b(CAFE|CASA)\b"), "RESTAURANTE").otherwise("OTROS_RECINTOS"), 0.72)
    by_quota = F.when(quota >= 15000, verdict("ESTADIO", 0.75)).when(quota >= 4000, verdict("OTROS_RECINTOS", 0.70)).when(quota < 300, small).otherwise(verdict("OTROS_RECINTOS", 0.60))
    known = [F.when(dictionary.isNotNull(), verdict(dictionary, 0.98))] if dictionary is not None else []
    return F.coalesce(*known, ladder(name, RULES_A), by_quota)


def classify_b(name: Column, quota: Column, dictionary: Column | None = None) -> Column:
    """Second pass, by use rather than by building."""
    by_quota = F.when(quota >= 20000, verdict("ESTADIO", 0.72)).when(quota >= 5000, verdict("OTROS_RECINTOS", 0.68)).when(quota <= 200, verdict("OTROS_RECINTOS", 0.65)).otherwise(verdict("OTROS_RECINTOS", 0.55))
    known = [F.when(dictionary.isNotNull(), verdict(dictionary, 0.99))] if dictionary is not None else []
    return F.coalesce(*known, ladder(name, RULES_B), by_quota)


def migrate_type(name: Column, old_type: Column, dictionary: Column | None = None) -> Column:
    """Type in the present taxonomy: curated names, special words, older type, then the first pass with a middling quota."""
    known = [dictionary] if dictionary is not None else []
    mapped = F.coalesce(*[F.when(old_type == k, F.lit(v)) for k, v in OLD_TYPES.items()])
    # museums by name come between the museum rule and the cinema rule; they exclude each other, so order does not matter
    return F.coalesce(*known, F.when(name.isin(MUSEUM_NAMES), F.lit("MUSEO")), ladder(name, MIGRATION_RULES)["type"], mapped, classify_a(name, F.lit(500))["type"])


def consensus(external_type: Column, external_confidence: Column, a: Column, b: Column, dictionary: Column | None = None) -> Column:
    """struct(type, confidence, source, review): curated name, then an outside verdict of 0.80 or more, then two passes that
    agree with a mean of 0.85 or more; otherwise the more confident pass is only suggested."""
    mean = (a["confidence"] + b["confidence"]) / 2
    pick = lambda kind, confidence, source, review: F.struct(kind.alias("type"), confidence.alias("confidence"), F.lit(source).alias("source"), F.lit(review).alias("review"))
    known = [F.when(dictionary.isNotNull(), pick(dictionary, F.lit(0.98), "dictionary", False))] if dictionary is not None else []
    better = F.when(a["confidence"] >= b["confidence"], a).otherwise(b)
    return F.coalesce(
        *known,
        F.when(external_type.isin(VENUE_TYPES) & (external_confidence >= 0.80), pick(external_type, external_confidence, "external", False)),
        F.when((a["type"] == b["type"]) & (mean >= 0.85), pick(a["type"], mean, "rules", False)),
        pick(better["type"], better["confidence"], "suggested", True),
    )
