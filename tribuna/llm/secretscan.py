"""Secret scans in DataFrame functions only: fixed patterns, and a battery of randomness tests on other dense strings.

Base kinds are the fixed patterns, leftmost and not overlapping per kind. Positions come from the texts between matches
(split) and the matches themselves, by prefix sums over array blocks, so a text with many matches costs n^1.5, not n^2.

The battery takes further strings of 20 or more characters of [A-Za-z0-9+/_-], with the padding "=" at their end, with a letter
and a digit that touch no base span; in NAME=value both sides are strings of their own, and a short word with _ or - before a run
of letters and digits (a vendor's prefix) is not tested with it. The narrowest encoding that holds a string's characters is
inferred (hex in either case, base 32, 36, 62, 64, both alphabets of base 64 mixed) and three tests of "drawn evenly from that
alphabet" are made: chi-squared over the alphabet, runs above and below its middle, and serial correlation. A string that one
of them rejects (UNEVEN, by Bonferroni) is no secret.

What is controlled is the rate of false secrets. The null hypothesis of a string is that it is ordinary text, and two tests speak
against it. Characters of words and numbers coincide at a rate of COINCIDENCE (COINCIDENCE_BOTH), not of 1 / alphabet: chi-squared is
non-central then, and its lower tail (Patnaik's scaled chi-squared, cube-root normal) is one p-value. Lower case, upper case,
digits and signs follow each other in runs, of which there are few: the upper tail of their number, with a change at a rate of
CHANGES, is the other. Both are combined by Fisher's rule; where the alphabet is too small for them to tell (hex), the p-value is the
chance that so much ordinary text has hexadecimal digits only; it is 1 where the battery rejects an even draw.

The step-up at ALPHA has one threshold for all strings of the table, so what else a text holds does not matter. P-values are weighed by
length (long strings carry more evidence), counted in a histogram of STEPS steps a power of two, and the threshold is the largest
step at which expected false secrets are at most ALPHA of those found; one aggregate gives it, a second pass applies it.

Base spans and strings are put together by sorting and running maxima over blocks, and redacted texts are joined from pieces,
so a text with many matches costs n^1.5, not n^2.

Defined cases: null and empty text have no spans (the hash of the empty string); equal spans of two kinds are both given; ids
of any type, repeated and null ones too, stay what they are; repeated rows and other columns do not matter; an empty table
gives no rows. Two passes over the texts, each a narrow projection, the first with an aggregate of some hundred rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

#: The patterns of the base kinds. A run is greedy, so its least length can stand in the pattern of the last two.
KEYWORDS = "(password|passwd|secret|token|api_?key)"
ASSIGN = r"""(?i:KEYWORDS)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""".replace("KEYWORDS", KEYWORDS)
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_LEAST = 6
#: Strings for the battery.
DENSE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+(?:={1,6}(?![A-Za-z0-9+/_=-]))?"
#: Rate of false secrets, and of random strings that the battery may reject.
ALPHA, UNEVEN = 0.01, 0.001
#: Chance that two characters of ordinary text are equal, of one letter case and of both; and, as an upper bound, that a
#: character is a hexadecimal digit.
COINCIDENCE, COINCIDENCE_BOTH, HEX_SHARE = 0.055, 0.042, 0.5
#: Rate at which ordinary text changes between lower case, upper case, digits and signs, as an upper bound.
CHANGES = 0.30
CLASSES = "[0-9]+|[a-z]+|[A-Z]+|[^0-9A-Za-z]+"
#: A vendor's prefix before a run of letters and digits.
PREFIX = r"^(?:[A-Za-z][A-Za-z0-9]{1,9}[_-]){1,2}(?=[A-Za-z0-9]{20,}$)"
#: Length that has the weight 1; steps of the histogram of p-values in a power of two, and the last of them.
USUAL, STEPS, LAST_STEP = 32, 8, 2000
#: Code points of a block when pieces are cut out of a text.
BLOCK = 4096
#: encoding: (characters it may have, its alphabet in order); hex is read in lower case
HEX_EITHER = "[0-9a-fA-F]*"
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = {
    "hex": (HEX_EITHER, _DIGITS + "abcdef"),
    "base32": ("[A-Z2-7]*", _UPPER + "234567"),
    "base36": ("[a-z0-9]*", _DIGITS + _LOWER),
    "BASE36": ("[A-Z0-9]*", _DIGITS + _UPPER),
    "base62": ("[A-Za-z0-9]*", _DIGITS + _UPPER + _LOWER),
    "base64": ("[A-Za-z0-9+/]*", _UPPER + _LOWER + _DIGITS + "+/"),
    "base64url": ("[A-Za-z0-9_-]*", _UPPER + _LOWER + _DIGITS + "-_"),
    "mixed": ("[A-Za-z0-9+/_-]*", _UPPER + _LOWER + _DIGITS + "+/-_"),
}
REDACTED = "<redacted>"


def _let(value: Column, use) -> Column:
    """use(value), with value computed once: an expression that stands in several places is else computed in each."""
    return F.transform(F.array(value), use)[0]


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)


def _blocks(xs: Column) -> Column:
    """An array in blocks of about the root of its size."""

    def cut(x: Column) -> Column:
        block = F.greatest(F.ceil(F.sqrt(F.size(x))), F.lit(1)).cast("int")
        return _let(block, lambda n: F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(x) - 1) / n), F.lit(0)).cast("int")), lambda b: F.slice(x, b * n + 1, n)))

    return _let(xs, cut)


def _running_max(xs: Column, least: int) -> Column:
    """For each item of an array of any length the greatest before it (`least` before the first), by blocks of about its root."""

    def scan(items: Column, first: Column) -> Column:
        zero = F.struct(F.array().cast("array<long>").alias("out"), first.alias("top"))
        return F.aggregate(items, zero, lambda a, x: F.struct(F.concat(a["out"], F.array(a["top"])).alias("out"), F.greatest(a["top"], x).alias("top")), lambda a: a["out"])

    low = F.lit(least).cast("long")
    tops = lambda blocks: scan(F.transform(blocks, lambda b: F.coalesce(F.array_max(b), low)), low)
    return _let(_blocks(xs), lambda blocks: F.flatten(F.zip_with(blocks, tops(blocks), scan)))


def _prefix(xs: Column) -> Column:
    """Exclusive prefix sums of a short array."""
    zero = F.struct(F.array().cast("array<long>").alias("out"), F.lit(0).cast("long").alias("sum"))
    return F.aggregate(xs, zero, lambda a, x: F.struct(F.concat(a["out"], F.array(a["sum"])).alias("out"), (a["sum"] + x).alias("sum")), lambda a: a["out"])


def _prefix_sums(xs: Column) -> Column:
    """Exclusive prefix sums of an array of any length (not empty), by blocks of about its root."""
    return _let(_blocks(xs), lambda blocks: F.flatten(F.zip_with(blocks, _prefix(F.transform(blocks, _sum)), lambda xs, at: F.transform(_prefix(xs), lambda x: x + at))))


def _found(df: DataFrame, name: str, pattern: str) -> DataFrame:
    """Adds `name`: array of (start, end, match) of all matches, in code points."""
    at = F.lit(pattern)
    df = df.withColumn(f"{name}_m", F.regexp_extract_all("text", at, F.lit(0)))
    m = F.col(f"{name}_m")
    n = F.size(m)
    df = df.withColumn(f"{name}_g", F.when(n > 0, F.transform(F.slice(F.split("text", pattern, -1), F.lit(1), n), lambda g: F.length(g).cast("long"))))
    g = F.col(f"{name}_g")
    df = df.withColumn(f"{name}_s", F.when(n > 0, _prefix_sums(F.zip_with(g, m, lambda a, b: a + F.length(b)))))
    starts = F.zip_with(F.col(f"{name}_s"), g, lambda s, a: s + a)
    made = F.zip_with(starts, m, lambda s, x: F.struct(s.alias("start"), (s + F.length(x)).alias("end"), x.alias("match")))
    return df.withColumn(name, F.coalesce(made, F.array().cast("array<struct<start:bigint,end:bigint,match:string>>"))).drop(f"{name}_m", f"{name}_g", f"{name}_s")


def _kind(column: str, order: int, kind: str) -> Column:
    return F.transform(column, lambda x: F.struct(x["start"].alias("start"), F.lit(order).alias("order"), x["end"].alias("end"), F.lit(kind).alias("kind")))


def _upper_tail(z: Column) -> Column:
    """1 - Phi(z)."""
    return F.exp(-_evidence(z))


def _evidence(z: Column) -> Column:
    """-ln(1 - Phi(z)): a logistic in z and its cube below 2, the continued fraction of the tail from there."""

    def fraction(z: Column) -> Column:
        f = z
        for i in range(8, 0, -1):
            f = z + i / f
        return z * z / 2 + 0.9189385332046727 + F.log(f)  # ln of the root of 2 pi

    return _let(F.least(F.greatest(z, F.lit(-20.0)), F.lit(20.0)), lambda z: F.when(z >= 2, fraction(z)).otherwise(F.log1p(F.exp(1.5976 * z + 0.07056 * z * z * z))))


def _fisher(a: Column, b: Column) -> Column:
    """Combined p-value of two tests from their -ln p."""
    return _let(a + b, lambda s: F.exp(-s) * (1 + s))


def _cube_root_normal(x: Column, df: Column) -> Column:
    """z of a chi-squared value with df degrees of freedom (Wilson and Hilferty)."""
    return (F.pow(x / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))


def _battery(token: Column) -> Column:
    """(n, p): length without padding, and the p-value of ordinary text (1 where an even draw is rejected); null without an encoding."""

    def encoded(body: Column) -> Column:
        encoding = F.coalesce(*[F.when(body.rlike(f"^{chars}$"), F.lit(letters)) for chars, letters in ENCODINGS.values()])
        runs = F.regexp_count(body, F.lit(CLASSES)).cast("double")
        return F.struct(F.when(body.rlike(f"^{HEX_EITHER}$"), F.lower(body)).otherwise(body).alias("body"), encoding.alias("alphabet"), runs.alias("classes"))

    def counted(x: Column) -> Column:
        k, n = F.length(x["alphabet"]).cast("double"), F.length(x["body"]).cast("double")
        values = F.transform(F.split(x["body"], ""), lambda c: (F.instr(x["alphabet"], c) - 1).cast("double"))
        squares = F.aggregate(F.split(x["alphabet"], ""), F.lit(0.0), lambda a, c: a + F.pow(n - F.length(F.replace(x["body"], c, F.lit(""))), F.lit(2.0)))
        return F.struct(k.alias("k"), n.alias("n"), values.alias("v"), (k * squares / n - n).alias("chi"), x["classes"].alias("classes"))

    def summed(x: Column) -> Column:
        k, n, v = x["k"], x["n"], x["v"]
        both = F.aggregate(v, F.struct(F.lit(0.0).alias("high"), F.lit(0.0).alias("sum")), lambda a, y: F.struct((a["high"] + F.when(y >= k / 2, 1.0).otherwise(0.0)).alias("high"), (a["sum"] + y).alias("sum")))
        return _let(both, lambda b: F.struct(k.alias("k"), n.alias("n"), v.alias("v"), x["chi"].alias("chi"), x["classes"].alias("classes"), (1 + 2 * b["high"] * (n - b["high"]) / n).alias("mu"), (b["sum"] / n).alias("mean")))

    def walked(x: Column) -> Column:
        half, mean = x["k"] / 2, x["mean"]
        start = F.struct(F.lit(-1.0).alias("last"), F.lit(0.0).alias("runs"), F.lit(0.0).alias("lag"), F.lit(0.0).alias("sq"))
        step = F.aggregate(
            x["v"], start,
            lambda a, y: F.struct(
                y.alias("last"),
                (a["runs"] + F.when((a["last"] < 0) | ((a["last"] >= half) != (y >= half)), 1.0).otherwise(0.0)).alias("runs"),
                (a["lag"] + F.when(a["last"] < 0, 0.0).otherwise((a["last"] - mean) * (y - mean))).alias("lag"),
                (a["sq"] + (y - mean) * (y - mean)).alias("sq"),
            ),
        )
        return _let(step, lambda t: judged(x, t))

    def judged(x: Column, step: Column) -> Column:
        n, mu, df, far = x["n"], x["mu"], x["k"] - 1, F.lit(20.0)
        var = (mu - 1) * (mu - 2) / (n - 1)
        z2 = F.when(var > 0, F.abs(step["runs"] - mu) / F.sqrt(F.when(var > 0, var))).otherwise(far)
        z3 = F.when(step["sq"] > 0, F.abs(step["lag"] / F.when(step["sq"] > 0, step["sq"]) + 1 / n) * F.sqrt(n)).otherwise(far)
        even = F.least(_upper_tail(_cube_root_normal(x["chi"], df)), 2 * _upper_tail(z2), 2 * _upper_tail(z3)) * 3 >= UNEVEN
        # non-central chi-squared of ordinary text as a scaled central one (Patnaik)
        away = n * F.greatest(F.when(x["k"] < 62, COINCIDENCE).otherwise(COINCIDENCE_BOTH) * x["k"] - 1, F.lit(0.05))
        scale, df2 = (df + 2 * away) / (df + away), (df + away) * (df + away) / (df + 2 * away)
        even_chi = _let(F.struct(scale.alias("s"), df2.alias("d")), lambda c: _evidence(-_cube_root_normal(x["chi"] / c["s"], c["d"])))
        changed = _evidence((x["classes"] - 1.5 - (n - 1) * CHANGES) / F.sqrt((n - 1) * (CHANGES * (1 - CHANGES))))
        ordinary = _fisher(even_chi, changed)
        ordinary = F.when(x["k"] == 16, F.pow(F.lit(HEX_SHARE), n)).otherwise(ordinary)
        return F.struct(n.alias("n"), F.when(even, ordinary).otherwise(F.lit(1.0)).alias("p"))

    found = lambda x: F.when(x["alphabet"].isNotNull(), _let(_let(_let(x, counted), summed), walked))
    return _let(_let(F.regexp_replace(F.regexp_replace(token, "=+$", ""), PREFIX, ""), encoded), found)


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, text, the columns of `keep` (prefixed "keep_"), assign, access, hex_, base and all spans as sorted arrays of (start, order, end, kind)."""
    df = docs.select(docs[id_col].alias("id"), text_or_empty(docs, text_col).alias("text"), *[docs[c].alias(f"keep_{c}") for c in keep])
    for name, pattern in (("assign", ASSIGN), ("access", ACCESS), ("hex_", HEX), ("dense", DENSE)):
        df = _found(df, name, pattern)
    df = df.withColumn("assign", F.filter("assign", lambda x: F.length(F.regexp_extract(x["match"], ASSIGN, 2)) >= ASSIGN_LEAST))
    df = df.withColumn("base", F.array_sort(F.concat(_kind("assign", 0, "assign"), _kind("access", 1, "access"), _kind("hex_", 2, "hex"))))
    # base spans and strings in one order: a string touches a base span that begins before it if one of these ends after its
    # start, and one that begins later if that begins before its end
    mixed = F.array_sort(F.concat(F.transform("base", lambda b: F.struct(b["start"].alias("start"), F.lit(0).alias("kind"), b["end"].alias("end"), F.lit("").alias("match"))), F.transform("dense", lambda x: F.struct(x["start"].alias("start"), F.lit(1).alias("kind"), x["end"].alias("end"), x["match"].alias("match")))))
    df = df.withColumn("mixed", F.when((F.size("base") > 0) & (F.size("dense") > 0), mixed))
    ends = F.transform("mixed", lambda x: F.when(x["kind"] == 0, x["end"]).otherwise(F.lit(-1).cast("long")))
    starts = F.transform(F.reverse("mixed"), lambda x: F.when(x["kind"] == 0, -x["start"]).otherwise(F.lit(-(1 << 40)).cast("long")))
    df = df.withColumn("past", F.when(F.col("mixed").isNotNull(), _running_max(ends, -1))).withColumn("next", F.when(F.col("mixed").isNotNull(), F.reverse(_running_max(starts, -(1 << 40)))))
    apart = F.filter(F.arrays_zip("mixed", "past", "next"), lambda x: (x["mixed"]["kind"] == 1) & (x["past"] <= x["mixed"]["start"]) & (-x["next"] >= x["mixed"]["end"]))
    apart = F.transform(apart, lambda x: F.struct(x["mixed"]["start"].alias("start"), x["mixed"]["end"].alias("end"), x["mixed"]["match"].alias("match")))
    df = df.withColumn("dense", F.filter(F.coalesce(F.when(F.col("mixed").isNotNull(), apart), F.col("dense")), lambda x: x["match"].rlike("[0-9]") & x["match"].rlike("[A-Za-z]")))
    df = df.withColumn("tested", F.filter(F.transform("dense", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), _battery(x["match"]).alias("t"))), lambda x: x["t"].isNotNull()))
    q = F.transform("tested", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), (x["t"]["p"] * USUAL / x["t"]["n"]).alias("q"), x["t"]["n"].alias("n")))
    df = df.withColumn("weighed", q)
    random = F.filter("weighed", lambda x: x["q"] <= F.lit(threshold(df)))
    df = df.withColumn("random", random)
    return df.withColumn("spans", F.when(F.size("random") > 0, F.array_sort(F.concat("base", _kind("random", 3, "random")))).otherwise(F.col("base")))


def threshold(weighed: DataFrame) -> float:
    """The largest weighted p-value at which at most ALPHA of the strings found are expected to be ordinary; -1 if there is none."""
    x = weighed.select(F.explode("weighed").alias("x"))
    step = F.when(F.col("x.q") <= 0, LAST_STEP).otherwise(F.least(F.floor(-F.log2("x.q") * STEPS), F.lit(LAST_STEP))).cast("int")
    counted = {r["step"]: (r["k"], r["n"]) for r in x.groupBy(step.alias("step")).agg(F.count("*").alias("k"), F.sum("x.n").alias("n")).collect()}  # a row a step
    weight, found, best = sum(n for _, n in counted.values()) / USUAL, 0, -1.0
    for step in sorted(counted, reverse=True):
        found += counted[step][0]
        at = 2.0 ** (-step / STEPS)  # the upper end of the step
        if at * weight <= ALPHA * found:
            best = at
    return best


def _listed(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The digest columns of the contract."""
    df = secret_spans(docs, id_col, text_col)
    size = lambda c: F.size(c).cast("long").alias(f"n_{c.rstrip('_')}")
    return df.select(F.col("id").alias(id_col), size("assign"), size("access"), size("hex_"), F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("spans").alias("spans"))


def redact_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = REDACTED) -> DataFrame:
    """docs with every span replaced by `mark` (overlapping spans by one); same columns, null text stays null."""
    others = tuple(c for c in docs.columns)
    df = secret_spans(docs, id_col, text_col, keep=others).withColumn("found", F.size("spans") > 0)
    # what stands before each span and after the last end so far; a span that begins within an earlier one adds nothing
    df = df.withColumn("past", F.when(F.col("found"), _running_max(F.transform("spans", lambda x: x["end"]), 0)))
    df = df.withColumn("blocks", F.when(F.col("found"), F.regexp_extract_all("text", F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))))

    def between(a: Column, b: Column) -> Column:
        """The text from a to b, out of the blocks that it touches."""
        first = F.floor(a / BLOCK).cast("int")
        some = F.slice("blocks", first + 1, F.floor((b - 1) / BLOCK).cast("int") - first + 1)
        piece = lambda x, i: F.substring(x, (F.greatest(a - (first + i) * BLOCK, F.lit(0)) + 1).cast("int"), (F.least(b - (first + i) * BLOCK, F.lit(BLOCK)) - F.greatest(a - (first + i) * BLOCK, F.lit(0))).cast("int"))
        return F.when(b > a, F.array_join(F.transform(some, piece), "")).otherwise(F.lit(""))

    pieces = F.zip_with("spans", "past", lambda x, p: F.when(x["start"] >= p, F.concat(between(p, x["start"]), F.lit(mark))).otherwise(F.lit("")))
    last = F.array_max(F.transform("spans", lambda x: x["end"]))
    clean = F.concat(F.array_join(pieces, ""), between(last, F.length("text").cast("long")))
    text = F.when(F.col("found"), clean).otherwise(F.col(f"keep_{text_col}"))
    return df.select(*[(text if c == text_col else F.col(f"keep_{c}")).alias(c) for c in others])


ORACLE_SQL = None
