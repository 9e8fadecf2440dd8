"""Near-duplicates by bottom-k sketches from one hash function.

1. Texts with equal word sequences are one node. A node has the set of its 64-bit shingle hashes and, as its sketch, the
   SKETCH smallest of them.
2. Inverted lists: retained values that several nodes share, with the nodes that have them. A pair that reaches the
   threshold shares at least `needed` retained values (certain where one sketch is the whole set, by counting what the other
   may have left out; all but one chance in 10^7 where neither is), so each node enters only the lists of its rarest values, all
   but needed - 1 of them. Passages that many texts share drop out.
3. In lists of up to NEAR + 1 nodes all are paired, in longer ones each with the list's first, that is most connected, node: a
   number of pairs in proportion to the lists. The union sketch estimates each pair's similarity; pairs that stay
   are verified on full shingle sets.
4. In longer lists, nodes that are not linked to the first one are open. Lists with the same first node are one unit. Units of
   more than REFINE nodes get inverted lists anew, over full sets: a node enters the lists of the rarest quarter (and one) of
   its shingles, which any partner at the threshold must meet, so texts that share a long template but are not near copies do
   not meet any more. Their pairs go through step 3 again; what is long then, and the smaller units, is swept: open nodes are
   compared with the unit's nodes on full sets, block against block; what each has in common with the first node bounds what two
   can reach. A block gives a spanning forest of its links, so no list is paired out.
5. Components are found by alternating large-star and small-star steps over the links; every step is a table in the
   shared folder. Nothing but counters comes to the driver.

Cost: steps 1 to 3 are in proportion to the texts. The sweep copies each open node once a block of its unit's nodes, and each of
these once a block of open ones, so it grows with (open nodes) x (unit's nodes) / BLOCK in rows; that is many only for thousands
of texts that pairwise nearly reach the threshold.

Defined cases: text without words (null, empty, white space) has 0 shingles and is linked with nothing; fewer words than a
shingle give one shingle of the whole sequence; equal texts are linked; ids of any type, repeated and null ones too: each row is
judged by its own text, a component is named by its smallest id that is not null, and has a null id only if all are;
kept is whether the row's id is that name (so repeated rows are all kept; `keep_one` keeps one of them); hot values, sources and
groups are never paired out or gathered in one task; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import add_columns, fresh, materialise, slices

#: Fixed values of the contract: words, shingle width, threshold.
WORD = r"[^\x20\x09-\x0D]+"
WIDTH, NUMERATOR, DENOMINATOR = 5, 75, 100
#: Retained values, those that a pair at the threshold shares at least, and one less than the nodes of a short list.
SKETCH, NEED, NEAR = 64, 30, 8
#: Rows and shingles of a block of a long list; units of more nodes get lists over full sets; buckets that rank shingles there.
BLOCK, BLOCK_SHINGLES, REFINE, RANKS = 512, 500_000, 8192, 1 << 16
#: Hashes of words that a worker keeps.
KEPT_WORDS = 300_000

_WORD = re.compile(WORD)
_UPPER = {ord("A") + i: ord("a") + i for i in range(26)}


def words_of(text: str | None) -> list[str]:
    """Words of a text after lower-casing A-Z only."""
    if not text:
        return []
    return _WORD.findall(text.lower() if text.isascii() else text.translate(_UPPER))


class Hasher:
    """64-bit hashes of shingles, from hashes of words that are kept."""

    def __init__(self):
        self.kept: dict[str, int] = {}

    def shingles(self, words: list[str], width: int = WIDTH) -> np.ndarray:
        """Sorted distinct shingle hashes as signed integers."""
        if not words:
            return np.empty(0, dtype=np.int64)
        h = np.fromiter(map(self.get, words), dtype=np.uint64, count=len(words))
        n = max(1, len(words) - width + 1)
        mixed = np.zeros(n, dtype=np.uint64)
        for j in range(min(width, len(words))):
            mixed = (mixed ^ h[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
        return np.unique(mixed.view(np.int64))

    def get(self, word: str) -> int:
        h = self.kept.get(word)
        if h is None:
            if len(self.kept) > KEPT_WORDS:
                self.kept.clear()
            self.kept[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))


def reaches(both: int, a: int, b: int) -> bool:
    """Whether the similarity of sets of sizes a and b with `both` in common is at the threshold or over it."""
    return DENOMINATOR * both >= NUMERATOR * (a + b - both)


def needed(n: int) -> int:
    """Retained values that a node of n shingles shares at least with any node at the threshold.

    A node of m shingles has at least NUMERATOR (n + m) / (NUMERATOR + DENOMINATOR) in common with it, of which it leaves
    m - SKETCH out of its sketch at most."""
    if n > SKETCH:
        return NEED
    sizes = range(-(-NUMERATOR * n // DENOMINATOR), DENOMINATOR * n // NUMERATOR + 1)
    return min(-(-NUMERATOR * (n + m) // (NUMERATOR + DENOMINATOR)) - max(0, m - SKETCH) for m in sizes)


def union_estimate(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """(values of the union's bottom sketch that both have, size of that sketch)."""
    union = np.union1d(a, b)[:SKETCH]
    both = np.intersect1d(a, b, assume_unique=True)
    return int(np.count_nonzero(both <= union[-1])) if len(both) else 0, len(union)


def text_key(column: str | Column) -> Column:
    """Tells the texts of rows with one id apart."""
    return F.xxhash64(column)


def nodes_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, key of the text, digest of the word sequence, n_shingles and sketch of each row."""
    source = docs.select(docs[id_col].alias("id"), text_key(docs[text_col]).alias("key"), docs[text_col].alias("text"))

    def make():
        hasher = Hasher()

        def sketch(text: str | None) -> tuple:
            words = words_of(text)
            own = hasher.shingles(words)
            return xxhash.xxh3_128_digest("\n".join(words)) if words else None, len(own), own[:SKETCH]

        return sketch

    return add_columns(source, "text", make, "digest binary, n long, sketch array<long>", drop=("text",))


def inverted_lists(nodes: DataFrame) -> DataFrame:
    """value, df, node, n, weight: lists of at least two nodes, each node in the lists of its rarest values only."""
    retained = nodes.select("node", "n", F.explode("sketch").alias("value"))
    shared = retained.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    hits = retained.join(shared, "value")
    per = hits.groupBy("node").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("df", "value"))).alias("hits"))  # SKETCH at most
    kept = F.least(F.col("n"), F.lit(SKETCH).cast("long"))
    small = F.array(*[F.lit(needed(n)) for n in range(1, SKETCH + 1)])
    need = F.when(F.col("n") <= SKETCH, F.element_at(small, F.col("n").cast("int"))).otherwise(F.lit(NEED))
    room = (kept - need + 1 - (kept - F.size("hits"))).cast("int")  # values that nothing shares are the rarest
    per = per.withColumn("room", room).where("room > 0").withColumn("weight", F.aggregate("hits", F.lit(0).cast("long"), lambda a, h: a + h["df"]))
    return per.select("node", "n", "weight", F.explode(F.slice("hits", F.lit(1), F.col("room"))).alias("hit")).select(F.col("hit.value").alias("value"), F.col("hit.df").alias("df"), "node", "n", "weight")


def near_pairs(lists: DataFrame, near: int = NEAR) -> tuple[DataFrame, DataFrame]:
    """(pairs a, b with a < b: all of short lists, each node with the first one of longer lists; value and first node of these)."""
    top = lists.groupBy("value").agg(F.max_by("node", F.struct("weight", -F.col("node"))).alias("first"), F.count("*").alias("m")).where("m > 1")

    def window(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, before = None, []  # the nodes of the present list
        for batch in batches:
            out = []
            for value, node in zip(*(batch.column(c).to_pylist() for c in ("value", "node"))):
                if value != at:
                    at, before = value, []
                out.extend((min(x, node), max(x, node)) for x in before)
                before.append(node)
            out = sorted(set(out))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.int64())], names=["a", "b"])

    spread = lists.join(top, "value").select("value", "first", "node", "m")
    short = spread.where(F.col("m") <= near + 1).select("value", "node").repartition("value").sortWithinPartitions("value", "node")
    # a longer list is swept besides, for what its first node leaves open
    long = spread.where((F.col("m") > near + 1) & (F.col("first") != F.col("node"))).select(F.least("first", "node").alias("a"), F.greatest("first", "node").alias("b"))
    return short.mapInArrow(window, "a long, b long").unionByName(long).distinct(), top.where(F.col("m") > near + 1)


def verify(pairs: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b, both (size of the intersection; null where the estimate rules the pair out), n_a, n_b of each pair."""

    @F.pandas_udf("boolean")
    def may(a: pd.Series, b: pd.Series, na: pd.Series, nb: pd.Series) -> pd.Series:
        out = []
        for x, y, n, m in zip(a, b, na, nb):
            if min(n, m) * DENOMINATOR < NUMERATOR * max(n, m):
                out.append(False)
                continue
            both, size = union_estimate(x, y)
            out.append(both * DENOMINATOR >= NUMERATOR * size if max(n, m) <= SKETCH else both >= NEED * size // SKETCH)
        return pd.Series(out, dtype=bool)

    side = lambda x: nodes.select(F.col("node").alias(x), F.col("sketch").alias(f"sketch_{x}"), F.col("n").alias(f"n_{x}"))
    likely = pairs.join(side("a"), "a").join(side("b"), "b").where(may("sketch_a", "sketch_b", "n_a", "n_b")).select("a", "b", "n_a", "n_b")
    likely = materialise(likely, "likely")
    texts = materialise(texts_of(likely.select(F.explode(F.array("a", "b")).alias("node")).distinct(), nodes, texts), "texts")
    text = lambda x: texts.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}"))
    both = likely.join(text("b"), "b").join(text("a"), "a").select("a", "b", "n_a", "n_b", F.struct("a", "b", "text_a", "text_b").alias("pair"))

    def make():
        hasher, kept = Hasher(), {}

        def set_of(node: int, t: str) -> np.ndarray:
            s = kept.get(node)
            if s is None:
                if len(kept) > 256:
                    kept.clear()
                kept[node] = s = hasher.shingles(words_of(t))
            return s

        return lambda p: (common(set_of(p["a"], p["text_a"]), set_of(p["b"], p["text_b"])),)

    return materialise(add_columns(both, "pair", make, "both long", drop=("pair",)), "verified")


def texts_of(wanted: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """node, text of the wanted nodes: the text of the row that stands for a node; rows that repeat it count once."""
    rows = wanted.join(nodes.select("node", F.col("at.id").alias("id"), F.col("at.key").alias("key")), "node")
    found = texts.alias("t").join(rows.alias("r"), F.col("t.id").eqNullSafe(F.col("r.id")) & (F.col("t.key") == F.col("r.key"))).select("node", "text")
    return found.dropDuplicates(["node"])  # equal texts, whichever stays


def shingle_sets(wanted: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """node, grams (its sorted shingle hashes as bytes) of the wanted nodes."""

    def make():
        hasher = Hasher()
        return lambda t: (hasher.shingles(words_of(t)).tobytes(),)

    return add_columns(texts_of(wanted, nodes, texts), "text", make, "grams binary", drop=("text",))


def members_of(lists: DataFrame, tops: DataFrame, nodes: DataFrame, verified: DataFrame) -> DataFrame:
    """first, node, n, both (with the first, -1 if unknown), linked, of units that have open nodes, and the unit's shape.

    Lists with the same first node are one unit, so a node is sent once a unit and not once a list."""
    known = verified.select("a", "b", "both").unionByName(verified.select(F.col("b").alias("a"), F.col("a").alias("b"), "both"))
    members = lists.join(tops, "value").select("first", "node", "n").distinct()
    sizes = nodes.select(F.col("node").alias("first"), F.col("n").alias("n_first"))
    rows = members.join(known.select(F.col("a").alias("first"), F.col("b").alias("node"), "both"), ["first", "node"], "left").join(sizes, "first")
    both = F.when(F.col("node") == F.col("first"), F.col("n")).otherwise(F.coalesce("both", F.lit(-1)))
    linked = (F.col("both") >= 0) & (F.col("both") * DENOMINATOR >= NUMERATOR * (F.col("n") + F.col("n_first") - F.col("both")))
    rows = materialise(rows.withColumn("both", both).withColumn("linked", linked).select("first", "node", "n", "both", "linked"), "members")
    is_open = ~F.col("linked")
    shape = rows.groupBy("first").agg(F.count("*").alias("m"), F.sum("n").alias("s"), F.count_if(is_open).alias("u"), F.sum(F.when(is_open, F.col("n")).otherwise(0)).alias("us")).where("u > 0")
    return rows.join(shape, "first")


def sweep_links(rows: DataFrame, sets: DataFrame, rows_a_block: int = BLOCK, shingles_a_block: int = BLOCK_SHINGLES) -> DataFrame:
    """a, b: further links of units, enough of them to connect what is connected.

    A unit's open nodes, those not linked to its first node, are compared with all its nodes on full sets, block against
    block; each block gives a spanning forest of the links it finds, so what comes out grows with the nodes and not with their pairs."""
    blocks = lambda count, shingles: F.greatest(F.lit(1), F.ceil(F.col(count) / rows_a_block), F.ceil(F.col(shingles) / shingles_a_block)).cast("int")
    rows = rows.withColumn("nb", blocks("m", "s")).withColumn("nu", blocks("u", "us"))
    is_open = ~F.col("linked")
    h = F.xxhash64("node")
    left = rows.where(is_open).withColumn("xb", F.pmod(h, F.col("nu")).cast("int")).withColumn("yb", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    right = rows.withColumn("yb", F.pmod(h, F.col("nb")).cast("int")).withColumn("xb", F.explode(F.sequence(F.lit(0), F.col("nu") - 1)))
    columns = ["first", "xb", "yb", "node", "n", "both", "linked"]
    units = left.select(*columns, F.lit(True).alias("open")).unionByName(right.select(*columns, F.lit(False).alias("open")))

    def compare(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        x, y = group[group["open"]], group[~group["open"]]
        return pd.DataFrame(_block_links(x, y, key[0]) if len(x) and len(y) else [], columns=["a", "b"], dtype="int64")

    return units.join(sets, "node").groupBy("first", "xb", "yb").applyInPandas(compare, "a long, b long")


def refined_lists(wanted: DataFrame, sets: DataFrame) -> DataFrame:
    """value, df, node, n, weight: lists over full sets of the wanted nodes, each in those of its rarest shingles only.

    A pair at the threshold has at least NUMERATOR / DENOMINATOR of the smaller and of the larger set in common, so under any
    one order of shingles it meets in the first n - ceil(that) + 1 of both. The order is by how often a shingle's bucket occurs."""
    sets = sets.join(wanted, "node")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(RANKS, dtype=np.int64)
        for batch in slices(batches):
            for g in batch.column("grams").to_pylist():
                sums += np.bincount(np.frombuffer(g, np.int64) & (RANKS - 1), minlength=RANKS)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(sums[at], pa.int64())], names=["bucket", "c"])

    often = np.zeros(RANKS, dtype=np.int64)
    counted = sets.mapInArrow(count, "bucket long, c long").groupBy("bucket").agg(F.sum("c").alias("c")).toPandas()  # RANKS rows at most
    often[counted["bucket"].to_numpy()] = counted["c"].to_numpy()
    shared = wanted.sparkSession.sparkContext.broadcast(often)

    def make():
        ranks = shared.value

        def first(grams: bytes) -> tuple:
            v = np.frombuffer(grams, np.int64)
            n = len(v)
            return n, v[np.lexsort((v, ranks[v & (RANKS - 1)]))][: n - -(-NUMERATOR * n // DENOMINATOR) + 1]

        return first

    rows = add_columns(sets, "grams", make, "n long, values array<long>", drop=("grams",)).select("node", "n", F.explode("values").alias("value"))
    rows = materialise(rows, "refined")
    shared_values = rows.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    hits = rows.join(shared_values, "value")
    weights = hits.groupBy("node").agg(F.sum("df").alias("weight"))
    return hits.join(weights, "node").select("value", "df", "node", "n", "weight")


def long_list_links(lists: DataFrame, tops: DataFrame, nodes: DataFrame, texts: DataFrame, verified: DataFrame, refine: int = REFINE, **blocks) -> DataFrame:
    """a, b: what `near_pairs` leaves open in long lists."""
    units = materialise(members_of(lists, tops, nodes, verified), "units")
    sets = materialise(shingle_sets(units.select("node").distinct(), nodes, texts), "sets")
    small, large = units.where(F.col("m") <= refine), units.where(F.col("m") > refine)
    links = sweep_links(small, sets, **blocks)
    if large.isEmpty():
        return links
    again = materialise(refined_lists(large.select("node").distinct(), sets), "lists")
    pairs, tops = near_pairs(again)
    verified = verify(pairs, nodes, texts)
    rest = sweep_links(materialise(members_of(again, tops, nodes, verified), "units"), sets, **blocks)
    return links.unionByName(linked_pairs(verified)).unionByName(rest)


def linked_pairs(verified: DataFrame) -> DataFrame:
    """a, b of the verified pairs that are links."""
    return verified.where(F.col("both") * DENOMINATOR >= NUMERATOR * (F.col("n_a") + F.col("n_b") - F.col("both"))).select("a", "b")


def _block_links(x: pd.DataFrame, y: pd.DataFrame, first: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between a block of open nodes and a block of their unit."""
    nx, ny = x["n"].to_numpy()[:, None], y["n"].to_numpy()[None, :]
    bx, by = x["both"].to_numpy()[:, None], y["both"].to_numpy()[None, :]
    # what two sets can have in common, from what each has in common with the first node; -1 is unknown
    bound = np.where((bx >= 0) & (by >= 0), np.minimum(bx, by) + np.minimum(nx - bx, ny - by), np.minimum(nx, ny))
    bound = np.minimum(bound, np.minimum(nx, ny))
    ids_x, ids_y = x["node"].to_numpy(), y["node"].to_numpy()
    in_y = y["linked"].to_numpy()
    may = (DENOMINATOR * bound >= NUMERATOR * (nx + ny - bound)) & (ids_x[:, None] != ids_y[None, :]) & (in_y[None, :] | (ids_x[:, None] < ids_y[None, :]))
    keep_x, keep_y = may.any(axis=1), may.any(axis=0)
    if not keep_x.any():
        return []
    may, ids_x, ids_y, in_y = may[keep_x][:, keep_y], ids_x[keep_x], ids_y[keep_y], in_y[keep_y]
    sides = []
    for frame, keep in ((x, keep_x), (y, keep_y)):
        sets = [np.frombuffer(g, np.int64) for g in frame["grams"].to_numpy()[keep]]
        sides.append((np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(g) for g in sets]), len(sets)))
    values = np.intersect1d(sides[0][0], sides[1][0])
    shared = np.zeros(may.shape, dtype=np.float32)
    for at in range(0, len(values), 4096):
        part, tables = values[at : at + 4096], []
        for v, r, n in sides:
            col = np.searchsorted(part, v)
            col[col == len(part)] = 0
            own = part[col] == v
            m = np.zeros((n, len(part)), dtype=np.float32)
            m[r[own], col[own]] = 1
            tables.append(m)
        shared += tables[0] @ tables[1].T
    shared = np.rint(shared).astype(np.int64)
    hit = may & (DENOMINATOR * shared >= NUMERATOR * (nx[keep_x] + ny[:, keep_y] - shared))
    root: dict[int, int] = {}

    def find(i: int) -> int:
        while root.setdefault(i, i) != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for i, j in zip(*np.nonzero(hit)):
        a, b = int(ids_x[i]), int(ids_y[j])
        ra, rb = find(a), find(int(first) if in_y[j] else b)  # all that is linked to the first node is one component
        if ra != rb:
            root[ra] = rb
            out.append((min(a, b), max(a, b)))
    return out


def components(links: DataFrame, most: int = 60) -> DataFrame:
    """node, component (the smallest node it reaches) for every node of a link; alternating star contraction."""
    edges = materialise(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    last = None
    for _ in range(most):
        # large star: each node's larger neighbours go to its smallest neighbour (itself included)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        # small star: a node and its smaller neighbours go to the smallest of these
        least = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("low").alias("v")).where("u <> v").distinct()
        edges = materialise(small, "edges")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last = state
    else:
        raise RuntimeError("components did not settle")
    return edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")


def judged(docs: DataFrame, id_col: str, text_col: str, refine: int = REFINE, **blocks) -> DataFrame:
    """id, key, digest, n_shingles, component (a number, null without words), component_id of each row."""
    rows = materialise(nodes_of(docs, id_col, text_col), "rows")
    # a node is numbered when its table is written; the numbers stay what they are, whatever is computed again later
    nodes = rows.where("digest IS NOT NULL").groupBy("digest").agg(F.min("id").alias("least"), F.min(F.struct("id", "key")).alias("at"), F.min("n").alias("n"), F.min("sketch").alias("sketch"))
    nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    lists = materialise(inverted_lists(nodes), "lists")
    texts = docs.select(docs[id_col].alias("id"), text_key(docs[text_col]).alias("key"), docs[text_col].alias("text"))
    pairs, tops = near_pairs(lists)
    first = verify(pairs, nodes, texts)
    found = components(linked_pairs(first).unionByName(long_list_links(lists, tops, nodes, texts, first, refine, **blocks)))
    named = nodes.join(found, "node", "left").select("digest", "least", F.coalesce("component", "node").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))  # null ids are passed over
    named = named.join(least, "component").select("digest", "component", "component_id")
    own = rows.select("id", "key", "digest", F.col("n").alias("n_shingles"))
    linked = own.where("digest IS NOT NULL").join(named, "digest").select("id", "key", "digest", "n_shingles", "component", "component_id")
    return linked.unionByName(own.where("digest IS NULL").withColumn("component", F.lit(None).cast("long")).withColumn("component_id", F.col("id")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", refine: int = REFINE, **blocks) -> DataFrame:
    """id, n_shingles, component_id, kept of each row."""
    out = judged(docs, id_col, text_col, refine, **blocks)
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that are near-duplicates of another: of each component the row with the smallest id stays, and of
    rows that repeat that id in the component one. Rows without words all stay. Same columns."""
    found = materialise(judged(docs, id_col, text_col), "judged")
    named = F.col("id").eqNullSafe(F.col("component_id"))
    key = fresh(docs, "__key")
    out = docs.withColumn(key, text_key(docs[text_col]))

    def among(rows: DataFrame, other: DataFrame, how: str) -> DataFrame:
        other = other.select(F.col("id").alias("i"), F.col("key").alias("k")).distinct().alias("g")
        return rows.join(other, rows[id_col].eqNullSafe(F.col("g.i")) & (rows[key] == F.col("g.k")), how)

    out = among(out, found.where(~named), "left_anti")
    heads = found.where(named & F.col("component").isNotNull())
    several = heads.groupBy("component").agg(F.count("*").alias("c"), F.min("key").alias("least")).where("c > 1")
    if several.isEmpty():  # ids do not repeat within a component
        return out.drop(key)
    heads = materialise(heads.join(several, "component"), "heads")
    out = among(out, heads.where(F.col("key") != F.col("least")), "left_anti")
    left = heads.where(F.col("key") == F.col("least"))
    return among(out, left, "left_anti").unionByName(among(out, left, "left_semi").dropDuplicates([id_col, key])).drop(key)
