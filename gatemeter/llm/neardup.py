"""Near-duplicates by MinHash signatures and a multi-index Hamming join.

A document's set holds the 64-bit hashes of its distinct word shingles. Documents with
equal sets are one *class*. Each class has a signature of 72 minima of 8 bits. Signatures
are split into 12 chunks of 6 values. Two signatures that differ in 23 values at most have,
by pigeonhole, a chunk that differs in one value at most; the allowed error is enumerated
by leaving out each value of each chunk in turn, 72 keys a class, so every pair under that
distance shares a key. (Beyond it most pairs still do: at similarity 0.8 a chunk matches
with probability 0.655, so a pair is missed with probability 3e-6.)

Classes that share a key are candidates; no group's pairs are enumerated. First each class
is compared with one pivot, the least class that it shares a key with; what passes is
linked and components are built. Only keys that still hold several components go on: each
of their classes is compared with a pivot of the key. In the end the classes of different
components that share a key are compared pair by pair, each pair under one of its keys and
the classes of a key dealt to parts of which each two meet in a task of their own, if
their sizes allow the similarity and wide signatures of 3072 one-bit minima, made for these
classes alone, are near enough: in the first 384 bits and in all, the differing bits are 5.5
standard deviations above the mean at similarity 0.8 at most (a pair at 0.8 is past these
with probability 3e-7 and 6e-8). Pivots are compared where the first signatures differ in 33
values at most (2e-7).
Every link is confirmed on the full sets. Components don't change by links inside them, so
none that matters is lost.

Defined results: words are runs of bytes other than 0x20 and 0x09-0x0D, with A-Z in lower
case; with fewer words than a shingle the whole sequence is one shingle; null or blank
texts have an empty set and link with nothing; rows with one id are one document; rows
with a null id are linked with nothing and keep a null component; an empty table gives an
empty result; other columns pass through ``dedup`` untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gatemeter.llm.components import components
from gatemeter.llm.shared import Scratch
from gatemeter.llm.textbatch import Slice, filled, grams, mix, slices


@dataclass(frozen=True)
class NearRules:
    words: int = 2
    percent: int = 80
    chunks: int = 12
    chunk_values: int = 6
    max_distance: int = 33
    #: one-bit minima of the wide signature that is made where many classes remain
    wide_bits: int = 3072
    #: of these the first that are looked at
    glance_bits: int = 384
    #: classes of one key that meet in one task
    block: int = 1_000
    #: ids that may be broadcast to pick texts; more are joined by shuffle
    broadcast_ids: int = 500_000

    def max_wide_distance(self, bits: int) -> int:
        """Differing ones of so many bits of the wide signature: 5.5 standard deviations above the mean at the similarity."""
        p = (100 - self.percent) / 200
        return int(bits * p + 5.5 * (bits * p * (1 - p)) ** 0.5)

    @property
    def values(self) -> int:
        return self.chunks * self.chunk_values


DEFAULT = NearRules()
#: bytes of sets whose wide signatures are made at once
SET_BYTES = 1 << 20
_rng = np.random.Generator(np.random.PCG64(977))
_MULTIPLY = _rng.integers(1, 1 << 63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, 4096, dtype=np.uint64)


def shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(all rows' sorted distinct shingle hashes one after another, how many each row has)."""
    s = Slice(texts, lower=True)
    w = s.words()
    first = np.concatenate([[0], np.cumsum(s.n_words)])
    at, h = grams(w, s.row, words)
    starts = np.searchsorted(at, first)
    parts, counts = [], np.zeros(s.n, np.int64)
    for i in range(s.n):
        n = s.n_words[i]
        if n >= words:
            own = np.sort(h[starts[i] : starts[i + 1]])
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        elif n:
            own = grams(w[first[i] : first[i] + n], np.zeros(n, np.int64), int(n))[1]
        else:
            continue
        counts[i] = len(own)
        parts.append(own)
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), counts


def signatures(hashes: np.ndarray, counts: np.ndarray, values: int) -> np.ndarray:
    """One row of 8-bit minima for each set that isn't empty."""
    full = counts[counts > 0]
    out = np.zeros((len(full), values), np.uint8)
    if len(full):
        at = np.concatenate([[0], np.cumsum(full)[:-1]])
        for k in range(values):
            out[:, k] = mix(np.minimum.reduceat(hashes * _MULTIPLY[k] + _ADD[k], at)).astype(np.uint8)
    return out


def wide_signatures(hashes: np.ndarray, counts: np.ndarray, bits: int) -> np.ndarray:
    """One row of packed one-bit minima for each set; no set is empty."""
    at = np.concatenate([[0], np.cumsum(counts)[:-1]])
    out = np.zeros((len(counts), bits), np.uint8)
    for k in range(bits):
        out[:, k] = mix(np.minimum.reduceat(hashes * _MULTIPLY[k] + _ADD[k], at)) & np.uint64(1)
    return np.packbits(out, axis=1)


def chunk_keys(sig: np.ndarray, rules: NearRules) -> np.ndarray:
    """For each signature, the keys of its chunks with one value left out each."""
    n, r = len(sig), rules.chunk_values
    wide = sig.reshape(n, rules.chunks, r).astype(np.uint64)
    keys = np.zeros((n, rules.chunks, r), np.uint64)
    for gone in range(r):
        for k in range(r):
            if k != gone:
                keys[:, :, gone] = keys[:, :, gone] * np.uint64(256) + wide[:, :, k]
    place = np.arange(rules.values, dtype=np.uint64).reshape(rules.chunks, r)
    return (keys * np.uint64(512) + place).reshape(n, rules.values).astype(np.int64)


def chunk_longs(sig: np.ndarray, rules: NearRules) -> np.ndarray:
    """The chunks of each signature as longs, the first value in the lowest byte."""
    wide = sig.reshape(len(sig), rules.chunks, rules.chunk_values).astype(np.int64)
    return (wide << (8 * np.arange(rules.chunk_values))).sum(2)


def chunk_values(longs: np.ndarray, rules: NearRules) -> np.ndarray:
    return ((longs.reshape(-1, rules.chunks, 1) >> (8 * np.arange(rules.chunk_values))) & 255).astype(np.uint8).reshape(-1, rules.values)


def _described(docs: DataFrame, rules: NearRules, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_shingles, set_key (16 bytes) and the signature as longs, of every row."""
    kind = docs.schema[id_col].dataType.simpleString()
    longs = rules.chunks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = filled(batch.column(1))
            for i, j in slices(texts):
                hashes, counts = shingle_sets(texts[i:j], rules.words)
                sig = np.zeros((j - i, rules.values), np.uint8)
                sig[counts > 0] = signatures(hashes, counts, rules.values)
                ends = np.cumsum(counts)
                keys = [hashlib.blake2b(hashes[e - c : e].tobytes(), digest_size=16).digest() if c else None for e, c in zip(ends, counts, strict=True)]
                flat = pa.array(chunk_longs(sig, rules).reshape(-1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[i:j], pa.array(counts), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(np.arange(0, (j - i) * longs + 1, longs, dtype=np.int32)), flat)],
                    names=["doc_id", "n_shingles", "set_key", "sig"],
                )

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_shingles bigint, set_key binary, sig array<bigint>")


def _keyed(classes: DataFrame, rules: NearRules) -> DataFrame:
    """(key, rep) rows of (rep, sig)."""
    kind = classes.schema["rep"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                keys = chunk_keys(chunk_values(part.column(1).flatten().to_numpy(), rules), rules)
                reps = part.column(0).take(pa.array(np.repeat(np.arange(part.num_rows), rules.values)))
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), reps], names=["key", "rep"])

    return classes.select("rep", "sig").mapInArrow(run, f"key bigint, rep {kind}")


def _unequal(a: str, b: str, chunk: int) -> str:
    """SQL for the high bits of the values of one chunk that differ."""
    x = f"({a}[{chunk}] ^ {b}[{chunk}])"
    return f"((({x} & 140185576636287L) + 140185576636287L | {x}) & 141289400074368L)"  # 7f and 80 in six bytes


def distance(a: str, b: str, rules: NearRules) -> Column:
    """In how many values two signatures differ."""
    return F.expr(" + ".join(f"bit_count({_unequal(a, b, k)})" for k in range(rules.chunks)))


def first_place(a: str, b: str, rules: NearRules) -> Column:
    """The one place whose key stands for a pair: its first chunk with an error at most."""
    cases = []
    for k in range(rules.chunks):
        u = _unequal(a, b, k)
        cases.append(f"WHEN bit_count({u}) <= 1 THEN {k * rules.chunk_values} + if({u} = 0, 0, (bit_count({u} - 1) - 7) div 8)")
    return F.expr("CASE " + " ".join(cases) + " END")


def _sets(docs: DataFrame, ids: DataFrame, how_many: int, rules: NearRules, id_col: str, text_col: str) -> DataFrame:
    """(rep, members): the sorted shingle hashes of the documents with these ids, as binary."""
    kind = docs.schema[id_col].dataType.simpleString()
    wanted = ids.select(F.col("rep").alias(id_col))
    own = docs.select(id_col, text_col).join(F.broadcast(wanted) if how_many <= rules.broadcast_ids else wanted, id_col, "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = filled(batch.column(1))
            for i, j in slices(texts):
                hashes, counts = shingle_sets(texts[i:j], rules.words)
                ends = np.cumsum(counts)
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array([hashes[e - c : e].tobytes() for e, c in zip(ends, counts, strict=True)], pa.binary())], names=["rep", "members"])

    return own.mapInArrow(run, f"rep {kind}, members binary").where("octet_length(members) > 0")


def _confirmed(pairs: DataFrame, sets: DataFrame, rules: NearRules) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    kind = pairs.schema["a"].dataType.simpleString()
    left = sets.select(F.col("rep").alias("a"), F.col("members").alias("x"))
    right = sets.select(F.col("rep").alias("b"), F.col("members").alias("y"))
    met = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, good = batch.column(2), batch.column(3), np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                p, q = np.frombuffer(x[i].as_buffer(), np.uint64), np.frombuffer(y[i].as_buffer(), np.uint64)
                if not len(p) or not len(q) or 100 * min(len(p), len(q)) < rules.percent * max(len(p), len(q)):
                    continue
                both = np.concatenate([p, q])
                both.sort(kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                good[i] = 100 * shared >= rules.percent * (len(both) - shared)
            kept = pa.array(good)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept), batch.column(1).filter(kept)], names=["a", "b"])

    return met.mapInArrow(run, f"a {kind}, b {kind}")


def _widened(left: DataFrame, sets: DataFrame, rules: NearRules) -> DataFrame:
    """(rep, n, wide): sizes and wide signatures of the classes in `left`."""
    kind, longs = left.schema["rep"].dataType.simpleString(), rules.wide_bits // 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in slices(batch.column(1), SET_BYTES):
                part = batch.slice(i, j - i)
                members = [np.frombuffer(x.as_buffer(), np.uint64) for x in part.column(1)]
                sizes = np.array([len(x) for x in members])
                flat = np.ascontiguousarray(wide_signatures(np.concatenate(members), sizes, rules.wide_bits)).view(np.int64).reshape(-1)
                rows = pa.ListArray.from_arrays(pa.array(np.arange(0, len(members) * longs + 1, longs, dtype=np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes), rows], names=["rep", "n", "wide"])

    return sets.join(left.select("rep").distinct(), "rep", "left_semi").select("rep", "members").mapInArrow(run, f"rep {kind}, n bigint, wide array<bigint>")


def linked(docs: DataFrame, rules: NearRules = DEFAULT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the least id reachable), kept, class_id, for every row."""
    scratch = Scratch(docs.sparkSession)
    rows = scratch.cut(_described(docs, rules, id_col, text_col))
    n = rows.count()
    named = scratch.cut(rows.where("n_shingles > 0").groupBy("set_key").agg(F.min("doc_id").alias("rep")).where("rep IS NOT NULL"), n)
    classes = scratch.cut(
        rows.where("n_shingles > 0").join(named.select(F.col("rep").alias("doc_id"), F.col("set_key").alias("of")), "doc_id").where("of = set_key")
        .select(F.col("doc_id").alias("rep"), "n_shingles", "sig", "set_key").dropDuplicates(["set_key"]),
        n,
    )
    keyed = scratch.cut(_keyed(classes, rules))
    shared_keys = scratch.cut(keyed.groupBy("key").agg(F.min("rep").alias("pivot"), F.max("rep").alias("most")).where("pivot < most").select("key", "pivot"), n * rules.values // 2)
    groups = scratch.cut(keyed.join(shared_keys, "key").select("key", "rep", "pivot"))
    scratch.drop(shared_keys, keyed)
    wanted = scratch.cut(groups.select("rep").distinct(), n)
    sets = scratch.cut(_sets(docs, wanted, wanted.count(), rules, id_col, text_col))
    light = scratch.cut(classes.join(wanted, "rep", "left_semi").select("rep", "n_shingles", "sig"), n)
    scratch.drop(wanted, classes)

    def close(pairs: DataFrame) -> DataFrame:
        a = light.select(F.col("rep").alias("a"), F.col("n_shingles").alias("na"), F.col("sig").alias("sa"))
        b = light.select(F.col("rep").alias("b"), F.col("n_shingles").alias("nb"), F.col("sig").alias("sb"))
        may = pairs.join(a, "a").join(b, "b").where(_sizes(rules)).where(distance("sa", "sb", rules) <= rules.max_distance)
        return may.select("a", "b")

    tried = scratch.cut(groups.where("rep <> pivot").groupBy(F.col("rep").alias("a")).agg(F.min("pivot").alias("b")), n)
    edges = scratch.cut(_confirmed(close(tried), sets, rules))
    labels = None
    for last in (False, True):
        if labels is not None:
            scratch.drop(labels)
        labels = components(edges, scratch)
        placed = scratch.cut(groups.select("key", "rep").join(labels.select(F.col("v").alias("rep"), "label"), "rep", "left").select("key", "rep", F.coalesce("label", "rep").alias("label")))
        open_keys = scratch.cut(placed.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min_by("rep", F.xxhash64("rep")).alias("pivot")).where("low < high").select("key", "pivot"))
        left = scratch.cut(placed.join(open_keys, "key").select("key", "rep", "label", "pivot"))
        scratch.drop(placed, open_keys, groups)
        groups = left
        if left.isEmpty():
            break
        if not last:
            of_pivot = left.select(F.col("rep").alias("pivot"), F.col("label").alias("pivot_label")).distinct()
            new = left.select("rep", "label", "pivot").distinct().join(of_pivot, "pivot").where("label <> pivot_label").select(F.greatest("rep", "pivot").alias("a"), F.least("rep", "pivot").alias("b"))
        else:
            wide = scratch.cut(_widened(left, sets, rules))
            parts = left.groupBy("key").count().where(F.col("count") > rules.block).select("key", F.ceil(F.col("count") / rules.block).cast("int").alias("parts"))
            cut = left.select("key", "rep", "label").join(parts, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
            info = scratch.cut(cut.join(light.select("rep", "sig"), "rep").join(wide, "rep").withColumn("own", F.pmod(F.xxhash64("rep"), "parts").cast("int")))
            # the classes of a key are dealt to parts, and each two parts meet in a task of their own
            one = info.select("key", F.col("own").alias("i"), F.explode(F.expr("sequence(own, parts - 1)")).alias("j"), F.col("rep").alias("a"), F.col("label").alias("la"), F.col("n").alias("na"), F.col("sig").alias("sa"), F.col("wide").alias("wa"))
            two = info.select("key", F.explode(F.expr("sequence(0, own)")).alias("i"), F.col("own").alias("j"), F.col("rep").alias("b"), F.col("label").alias("lb"), F.col("n").alias("nb"), F.col("sig").alias("sb"), F.col("wide").alias("wb"))
            once = F.col("key") % 512 == first_place("sa", "sb", rules)
            # cheap tests first: most pairs are far apart already in a few longs
            may = F.expr("la <> lb AND (i < j OR a < b)") & _sizes(rules) & _wide_near(rules.glance_bits, rules) & once & _wide_near(rules.wide_bits, rules)
            new = one.join(two, ["key", "i", "j"]).where(may).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        fresh = scratch.cut(new.distinct().join(tried, ["a", "b"], "left_anti"))
        both = scratch.cut(tried.unionByName(fresh))
        found = scratch.cut(edges.unionByName(_confirmed(fresh if last else close(fresh), sets, rules)))
        scratch.drop(tried, fresh, edges, *((wide, info) if last else ()))
        tried, edges = both, found
    else:
        scratch.drop(labels)
        labels = components(edges, scratch)
    scratch.drop(sets, light, tried, groups, edges)
    of_set = scratch.cut(named.join(labels, named["rep"] == labels["v"], "left").select(F.col("set_key").alias("of_key"), F.coalesce("label", "rep").alias("component"), F.col("rep").alias("class_id")), n)
    scratch.drop(named, labels)
    of_id = rows.join(of_set, rows["set_key"] == of_set["of_key"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return of_id.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"), F.coalesce("class_id", "doc_id").alias("class_id"))


def _wide_near(bits: int, rules: NearRules) -> Column:
    """Whether the first so many bits of two wide signatures differ no more than they may."""
    return F.expr(" + ".join(f"bit_count(wa[{k}] ^ wb[{k}])" for k in range(bits // 64)) + f" <= {rules.max_wide_distance(bits)}")


def _sizes(rules: NearRules) -> Column:
    return F.expr(f"100 * least(na, nb) >= {rules.percent} * greatest(na, nb)")


def dedup(docs: DataFrame, rules: NearRules = NearRules(words=5), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group, the one of least id, with all its columns; null ids stay.

    Where ids repeat, an id with a text is a document: each is judged by its own text, the
    order is by id and then by the text's digest, and of equal ids and texts the row of the
    least hash over all columns stays.
    """
    named = docs.where(F.col(id_col).isNotNull())
    if named.groupBy(id_col).count().where("count > 1").isEmpty():
        gone = linked(docs, rules, id_col, text_col).where("NOT kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias(id_col))
        rest = named.join(gone, id_col, "left_anti")
    else:
        key = F.struct(F.col(id_col).alias("id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("digest"))
        both = named.select(key.alias("key"), F.struct(*docs.columns).alias("row"))
        gone = linked(both.select("key", F.col(f"row.{text_col}").alias("text")), rules, "key", "text").where("NOT kept").select(F.col("doc_id").alias("key")).distinct()
        rest = both.join(gone, "key", "left_anti").groupBy("key").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row.*")
    return rest.select(docs.columns).unionByName(docs.where(F.col(id_col).isNull()))


def query(docs: DataFrame) -> DataFrame:
    return linked(docs)


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM d),
n AS (SELECT d.doc_id, count(s.g) AS n FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id),
m AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM m JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a AS v, a AS u FROM e UNION SELECT r.v, e.b FROM r JOIN e ON r.u = e.a),
k AS (SELECT v, min(u) AS c FROM r GROUP BY v),
i AS (SELECT s.doc_id, md5(string_agg(g, chr(10) ORDER BY g)) AS h FROM s GROUP BY 1),
f AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS class_id FROM i)
SELECT n.doc_id, n.n AS n_shingles, coalesce(k.c, n.doc_id) AS component_id, coalesce(k.c, n.doc_id) = n.doc_id AS kept, coalesce(f.class_id, n.doc_id) AS class_id
FROM n LEFT JOIN k ON k.v = n.doc_id LEFT JOIN f ON f.doc_id = n.doc_id"""
