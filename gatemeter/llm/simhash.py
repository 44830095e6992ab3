"""SimHash document fingerprints, in DataFrame functions only.

Terms are windows of five words (a shorter text is one term), hashed to 128 bits; a term
counts as often as it occurs. Every term adds its weight to a counter of each bit that it
sets, two counters to a 64-bit sum; a bit of the fingerprint is set if more than half of
the weight sets it. Equal texts have equal fingerprints; likeness is the share of equal
bits, about 1 - angle / pi of the term vectors, so unrelated texts are near 0.5.

``near`` finds all distinct fingerprints within a Hamming radius by permuted block tables:
with the bits in `radius + spare` blocks, two fingerprints in reach agree in `spare` blocks
at least, so one table for each choice of `spare` blocks, keyed by those, holds every pair.
Equal fingerprints stand once; ``near_pairs`` gives their documents in a membership table.

Defined results: null texts count as empty; a text without words has the zero fingerprint;
documents follow one another by id (null first), then text; the last is followed by the
first, a single one by itself; repeated rows stand each on its own; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gatemeter.llm.shared import Scratch

BITS = 128
WORDS = 5
#: Bits in which a fingerprint may differ from those that the query counts as near.
RADIUS = 3
#: Fingerprints of one block key that are held against its queries at once.
BLOCK_ROWS = 2_000
_LANES = "4294967297"  # 1 in each 32-bit half: counters hold 2**32 - 1 terms


def terms(text: Column, words: int = WORDS) -> Column:
    """64-bit hashes of the text's windows of so many words."""
    own = F.transform(F.array_remove(F.split(text, "[\\x20\\t-\\r]+"), ""), lambda w: F.xxhash64(w))
    made = lambda h: F.when(F.size(h) > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.size(h) - words, F.lit(0))), lambda i: F.xxhash64(F.slice(h, i + 1, words))))
    return F.flatten(F.transform(F.array(own), made))


def _sums() -> list[Column]:
    return [F.expr(f"sum(shiftrightunsigned({h}, {k}) & {_LANES}L)").alias(f"{h}{k}") for h in ("t1", "t2") for k in range(32)]


def _bits(h: str) -> Column:
    """The signs of the 64 votes, as a long."""
    half = [f"(CASE WHEN 2 * (({h}{k} >> {s}) & 4294967295L) > n_terms THEN shiftleft(1L, {k + s}) ELSE 0L END)" for s in (0, 32) for k in range(32)]
    return F.expr(" | ".join(half))


def fingerprints(texts: DataFrame, keys: list[str], text: str = "text", words: int = WORDS) -> DataFrame:
    """keys, hi, lo: the fingerprint of each group of texts (usually one) with equal keys."""
    at = texts.select(*keys, F.explode_outer(terms(F.coalesce(F.col(text), F.lit("")), words)).alias("t1"))
    votes = at.select(*keys, "t1", F.xxhash64("t1", F.lit(7)).alias("t2")).groupBy(*keys).agg(F.count("t1").alias("n_terms"), *_sums())
    return votes.select(*keys, F.when(F.col("n_terms") > 0, _bits("t1")).otherwise(0).alias("hi"), F.when(F.col("n_terms") > 0, _bits("t2")).otherwise(0).alias("lo"))


def shown(hi: str, lo: str) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(F.col(hi)), 16, "0"), F.lpad(F.hex(F.col(lo)), 16, "0")))


def distance(a: tuple[str, str], b: tuple[str, str]) -> Column:
    return F.expr(f"bit_count({a[0]} ^ {b[0]}) + bit_count({a[1]} ^ {b[1]})")


def likeness(a: tuple[str, str], b: tuple[str, str]) -> Column:
    return 1 - distance(a, b) / F.lit(float(BITS))


def near(queries: DataFrame, prints: DataFrame, radius: int = RADIUS, spare: int = 2, only: str = "true", most: int = BLOCK_ROWS) -> DataFrame:
    """(hi, lo, hi2, lo2, distance): of each fingerprint in queries, all of prints within the radius, itself included.

    Both are tables of hi, lo; equal fingerprints count once. A pair is given by the first
    table that holds it. A key with many fingerprints is cut into parts of about `most` of
    them, and its queries go to each part, so no task holds a whole key. `only` is a further
    condition on the pairs.
    """
    if not 0 <= radius < BITS or spare < 1 or radius + spare > BITS:
        raise ValueError("radius and spare blocks don't fit the fingerprint")
    blocks = radius + spare
    edges = [round(k * BITS / blocks) for k in range(blocks + 1)]
    chosen = list(combinations(range(blocks), spare))

    def masks(own: tuple[int, ...]) -> tuple[str, str]:
        bits = sum((1 << edges[k + 1]) - (1 << edges[k]) for k in own)
        signed = lambda x: str(x - (1 << 64) if x >> 63 else x)
        return tuple("(-9223372036854775807L - 1L)" if x == 1 << 63 else signed(x) + "L" for x in (bits >> 64, bits & ((1 << 64) - 1)))

    def keyed(rows: DataFrame) -> DataFrame:
        tables = [f"struct({t} AS t, hi & {m[0]} AS kh, lo & {m[1]} AS kl)" for t, m in enumerate(map(masks, chosen))]
        return rows.select("hi", "lo").distinct().select("hi", "lo", F.explode(F.array(*map(F.expr, tables))).alias("e")).select("hi", "lo", "e.*")

    key = ["t", "kh", "kl"]
    held = keyed(prints)
    parts = held.groupBy(*key).count().where(F.col("count") > most).select(*key, F.ceil(F.col("count") / most).cast("int").alias("parts"))
    left = keyed(queries).join(parts, key, "left").select(*key, "hi", "lo", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    right = held.join(parts, key, "left").select(*key, F.col("hi").alias("hi2"), F.col("lo").alias("lo2"), F.pmod(F.xxhash64("hi", "lo"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"))
    first = " ".join(f"WHEN ((hi ^ hi2) & {h}) = 0 AND ((lo ^ lo2) & {v}) = 0 THEN {t}" for t, (h, v) in enumerate(map(masks, chosen)))
    apart = distance(("hi", "lo"), ("hi2", "lo2"))
    met = left.join(right, [*key, "part"]).where((apart <= radius) & F.expr(only) & F.expr(f"t = CASE {first} END"))
    return met.select("hi", "lo", "hi2", "lo2", apart.alias("distance"))


def near_pairs(prints: DataFrame, radius: int = 6, spare: int = 2, most: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """(pairs of distinct fingerprints with their distance, membership) of doc_id, hi, lo.

    Every pair within the radius is found. A fingerprint is named by its hex digits; null
    fingerprints pair with nothing.
    """
    members = prints.select("doc_id", shown("hi", "lo").alias("fingerprint"))
    own = prints.where("hi IS NOT NULL AND lo IS NOT NULL")
    met = near(own, own, radius, spare, "(hi < hi2 OR (hi = hi2 AND lo < lo2))", most)
    return met.select(shown("hi", "lo").alias("a"), shown("hi2", "lo2").alias("b"), "distance"), members


def in_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row with the text of the next one by id: part, place, ghost, id, text, next_text.

    Rows are dealt by id ranges, so one shuffle puts neighbours together. Every range also
    gets the row that follows its last (a ghost), found from the ranges' first ids, of
    which there are as many as ranges.
    """
    spark = docs.sparkSession
    lowest = F.lit(-(1 << 63))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), lowest).alias("k"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    coarse = 32
    cuts = sorted({int(x) for x in rows.select("k").approxQuantile("k", [i / coarse for i in range(coarse + 1)], 0.002)}) or [0]
    fine = max(1, -(-4 * int(spark.conf.get("spark.sql.shuffle.partitions")) // coarse))
    part = F.lit(-1)
    for i, (a, b) in enumerate(zip(cuts, [*cuts[1:], cuts[-1] + 1], strict=True)):
        inside = F.least(F.floor((F.col("k").cast("double") - float(a)) / max(1.0, float(b - a)) * fine), F.lit(fine - 1))
        part = F.when(F.col("k") >= a, i * fine + inside).otherwise(part)
    rows = rows.withColumn("part", part.cast("int"))
    firsts = sorted((r["part"], r["k"]) for r in rows.groupBy("part").agg(F.min("k").alias("k")).collect())
    if not firsts:
        return rows.select("part", F.lit(1).alias("place"), F.lit(False).alias("ghost"), "doc_id", "text", F.lit("").alias("next_text"))
    before = {firsts[i][1]: firsts[i - 1][0] for i in range(len(firsts))}
    to = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])
    ghosts = rows.where(F.col("k").isin(list(before))).withColumn("part", to[F.col("k")])
    order = [F.col("ghost"), F.col("k"), F.col("text")]
    w = Window.partitionBy("part").orderBy(*order)
    both = rows.withColumn("ghost", F.lit(False)).unionByName(ghosts.withColumn("ghost", F.lit(True)))
    return both.select("part", F.row_number().over(w).alias("place"), "ghost", "doc_id", "text", F.lead("text").over(w).alias("next_text"))


def query(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likenesses.

    n_near counts, for every document whose id is divisible by 20, the other documents
    whose fingerprints differ in RADIUS bits at most; it is null for the rest.
    """
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.expr("substring(text, 1, length(text) - int(floor(length(text) / 4)))"), F.coalesce(F.substring("next_text", F.lit(1), cut), F.lit("")))
    rows = in_order(docs).select("part", "place", "ghost", "doc_id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    both = rows.select(
        "part", "place", "ghost", "doc_id", "n_chars",
        F.explode(F.array(F.struct(F.lit(0).alias("w"), F.lit("").alias("sha"), F.col("text").alias("t")), F.struct(F.lit(1).alias("w"), F.sha2("edited", 256).alias("sha"), F.col("edited").alias("t")))).alias("e"),
    ).select("part", "place", "ghost", "doc_id", "n_chars", "e.*")
    prints = fingerprints(both, ["part", "place", "ghost", "doc_id", "n_chars", "w", "sha"], "t")
    order = Window.partitionBy("part").orderBy("place", "w")
    # of each place come the text's row and the edited text's; the next text's is two rows on
    ahead = lambda c, by: F.lead(c, by).over(order)
    met = prints.select(
        "w", "ghost", "doc_id", "n_chars", "hi", "lo", ahead("sha", 1).alias("edited_sha256"),
        ahead("hi", 1).alias("edited_hi"), ahead("lo", 1).alias("edited_lo"), ahead("hi", 2).alias("next_hi"), ahead("lo", 2).alias("next_lo"),
    )
    made = met.where("w = 0 AND NOT ghost").select(
        "doc_id", "n_chars", "edited_sha256", "hi", "lo", shown("edited_hi", "edited_lo").alias("edited_fingerprint"),
        likeness(("hi", "lo"), ("edited_hi", "edited_lo")).alias("near_edited"), likeness(("hi", "lo"), ("next_hi", "next_lo")).alias("near_next"),
    )
    rows = Scratch(docs.sparkSession).cut(made)
    asks = rows.where("doc_id % 20 = 0")
    held = rows.groupBy("hi", "lo").agg(F.count("*").alias("n_docs")).select(F.col("hi").alias("hi2"), F.col("lo").alias("lo2"), "n_docs")
    found = near(asks, rows).join(held, ["hi2", "lo2"]).groupBy("hi", "lo").agg((F.sum("n_docs") - 1).alias("n_near"))
    names = ["doc_id", "n_chars", "edited_sha256", shown("hi", "lo").alias("fingerprint"), "edited_fingerprint", "near_edited", "near_next"]
    others = rows.where("doc_id % 20 <> 0 OR doc_id IS NULL").select(*names, F.lit(None).cast("long").alias("n_near"))
    return asks.join(found, ["hi", "lo"], "left").select(*names, "n_near").unionByName(others)
