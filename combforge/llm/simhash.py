"""SimHash near-duplicate groups by tiled exact comparison.

1. A row's fingerprint is made from its word shingles (numpy bit counts).
2. Equal fingerprints collapse to the smallest doc_id before anything is compared.
3. Fingerprints are dealt into tiles by population counts (of four quarters for
   a small radius, of the whole for a large one); a class with more than a tile's
   worth is split by hash.
4. Tile pairs whose population counts differ beyond the radius are never formed;
   the others are compared exactly with exclusive-or and bit counts. A tile pair
   gives a spanning forest of its links, at most as many edges as fingerprints.
5. Components come from alternating large-star and small-star rounds, each
   written to the shared folder.

Null text counts as empty: fingerprint zero, linked like any other. Rows with a
null doc_id get a fingerprint and a null component. Rows repeating a doc_id with
different texts put the document's component under each text.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from combforge.llm.common import delete, join_hot, shared_path, table, written

SEED = 42
BLOCK = 1 << 20  # comparisons held at once


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of every shingle of ``width`` words, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    whole = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-width].tolist()]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(whole[a:b], SEED) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)), np.uint64, len(words) - width + 1)


def _remix(h: np.ndarray, k: int) -> np.ndarray:
    """Further 64 bits from a hash (a splitmix finaliser)."""
    if k == 0:
        return h
    x = h + np.uint64((k * 0x9E3779B97F4A7C15) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(h: np.ndarray, words: int = 1) -> np.ndarray:
    """``words`` times 64 bits; a bit is set if in over half of the hashes."""
    out = np.zeros(words, np.uint64)
    if not len(h):
        return out
    for k in range(words):
        ones = np.zeros(64, np.int64)
        for at in range(0, len(h), 1 << 16):
            part = _remix(h[at : at + (1 << 16)], k)
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[k] = np.packbits((2 * ones > len(h)).astype(np.uint8), bitorder="little").view(np.uint64)[0]
    return out


def fingerprints(docs: DataFrame, width: int = 3, words: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and f0.. (BIGINT bit patterns) of every row."""
    names = [f"f{k}" for k in range(words)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = np.array([fingerprint(shingle_hashes(t.as_py(), width), words) for t in b.column(1)], np.uint64).reshape(-1, words)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.ascontiguousarray(f[:, k]).view(np.int64)) for k in range(words))], names=["doc_id", *names])

    rows = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, "doc_id BIGINT, " + ", ".join(f"{n} BIGINT" for n in names))


def _neighbours(parts: int, radius: int) -> list[tuple[int, ...]]:
    """Offsets of population-count classes within the radius, one of each +/- pair."""
    steps = [o for o in product(range(-radius, radius + 1), repeat=parts) if sum(map(abs, o)) <= radius]
    return [o for o in steps if o >= (0,) * parts]


def _class(names: list[str], parts: int):
    """Population counts as one number in base 512, and the powers used."""
    if parts == 1:
        total = F.bit_count(names[0])
        for n in names[1:]:
            total = total + F.bit_count(n)
        return total.cast("bigint")
    out = F.lit(0).cast("bigint")
    for q in range(4):
        out = out * 512 + F.bit_count(F.shiftrightunsigned(names[0], 16 * q).bitwiseAND(F.lit(0xFFFF).cast("bigint")))
    return out


def merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Component labels (the smallest node) once the links i-j are added."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        label = label.copy()
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := label[label], label):
            label = up


def compare(a: np.ndarray, b: np.ndarray | None, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks (i, j) of all pairs of fingerprints (n, words) within the radius; b
    None: within a."""
    own, b = b is None, a if b is None else b
    words, step = a.shape[1], max(1, BLOCK // max(1, len(b)))
    for at in range(0, len(a), step):
        right = b[at:] if own else b
        d = np.bitwise_count(a[at : at + step, None, 0] ^ right[None, :, 0])
        i, j = np.nonzero(d <= radius)
        d, i, j = d[i, j].astype(np.int32), i + at, j + (at if own else 0)
        if own:
            below = i < j
            d, i, j = d[below], i[below], j[below]
        for k in range(1, words):
            d = d + np.bitwise_count(a[i, k] ^ b[j, k])
        if words > 1:
            within = d <= radius
            i, j = i[within], j[within]
        if len(i):
            yield i, j


def links(unique: DataFrame, words: int, radius: int, tile: int, folder: str, band: int = 16, side: int = 16) -> DataFrame:
    """(u, v), u over v: edges that connect what lies within the radius.

    unique: rep and f0.., one row per different fingerprint. For a large radius,
    classes are bands of ``band`` population counts. A class of many tiles is cut
    into squares of ``side`` tiles a side, so no task gets all pairs of a class.
    """
    names = [f"f{k}" for k in range(words)]
    parts = 4 if words == 1 and radius <= 3 else 1
    offsets = _neighbours(parts, radius) if parts > 1 else [(x,) for x in range((radius - 1) // band + 2)]
    rows = unique.select("rep", *names, F.floor(_class(names, parts) / (1 if parts > 1 else band)).alias("c"))
    counts = rows.groupBy("c").agg(F.ceil(F.count(F.lit(1)) / tile).alias("n"))  # a row per class: 17^4 or 64 * words + 1 at most
    counts = written(counts, f"{folder}/classes")
    rows = rows.join(F.broadcast(counts), "c")
    rows = rows.withColumn("t", F.pmod(F.xxhash64(*names), "n"))
    tiles = rows.groupBy("c", "t").agg(F.collect_list(F.struct("rep", *names)).alias("items"), F.first("n").alias("n"))
    tiles = written(tiles, f"{folder}/tiles")
    shifts = [sum(x * 512 ** (parts - 1 - p) for p, x in enumerate(o)) for o in offsets]
    left = tiles.select("c", "t", "items", F.explode(F.array(*(F.lit(s).cast("bigint") for s in shifts))).alias("shift"))
    left = left.select(F.col("c").alias("c1"), F.col("t").alias("t1"), F.col("items").alias("a"), (F.col("c") + F.col("shift")).alias("c"))
    left = left.join(F.broadcast(counts), "c").withColumn("y", F.explode(_upto(F.ceil(F.col("n") / side)))).drop("n")
    left = left.withColumn("x", F.floor(F.col("t1") / side))
    # the left tiles of a square come from its class and from neighbours with more or fewer tiles
    most = counts.select(F.explode(F.array(*(F.col("c") + s for s in shifts))).alias("c"), F.ceil(F.col("n") / side).alias("m")).groupBy("c").agg(F.max("m").alias("m"))
    right = tiles.join(F.broadcast(most), "c").select("c", "t", F.col("items").alias("b"), F.floor(F.col("t") / side).alias("y"), F.explode(_upto(F.col("m"))).alias("x"))
    pairs = left.join(right, ["c", "x", "y"]).filter((F.col("c1") != F.col("c")) | (F.col("t1") <= F.col("t")))
    pairs = pairs.select(((F.col("c1") == F.col("c")) & (F.col("t1") == F.col("t"))).alias("own"), "a", "b")

    def arrays(items: pa.ListScalar) -> tuple[np.ndarray, np.ndarray]:
        s = items.values
        rep, *f = (c.to_numpy(zero_copy_only=False) for c in s.flatten())
        return rep, np.stack([np.ascontiguousarray(x).view(np.uint64) for x in f], 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for own, a, b in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                ra, fa = arrays(a)
                rb, fb = (ra, None) if own else arrays(b)
                reps = ra if own else np.concatenate([ra, rb])
                label = None
                for i, j in compare(fa, fb, radius):
                    label = merge(np.arange(len(reps)) if label is None else label, i, j if own else j + len(ra))
                if label is not None:
                    node = np.flatnonzero(label != np.arange(len(reps)))
                    out.append((np.maximum(reps[node], reps[label[node]]), np.minimum(reps[node], reps[label[node]])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["u", "v"])

    # large tiles are one task each; small ones are many to a task
    return pairs.mapInArrow(run, "u BIGINT, v BIGINT")


def _upto(n: Column) -> Column:
    return F.sequence(F.lit(0).cast("bigint"), n.cast("bigint") - 1)


def components(edges: DataFrame, folder: str) -> DataFrame:
    """(node, root) for every node but the roots, root the smallest of its component.

    Large-star and small-star rounds; a hot root is met by broadcast. The tables
    of the rounds go below ``folder``.
    """
    rounds = 0

    def kept(table: DataFrame) -> DataFrame:
        return written(table, f"{folder}/round-{rounds}-{uuid.uuid4().hex}")

    edges = kept(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    state = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state or now[0] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state, rounds = now, rounds + 1
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = kept(both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("degree")).select("u", F.least("u", "m").alias("m"), "degree"))
        large = join_hot(both, least, ["u"], "degree").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.withColumnRenamed("m", "v"))
        edges = kept(small.distinct())


def near_duplicates(docs: DataFrame, width: int = 3, words: int = 1, radius: int = 2, tile: int = 4096, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, f0.., component_id of every row."""
    names, folder = [f"f{k}" for k in range(words)], shared_path(docs.sparkSession)
    marks = written(fingerprints(docs, width, words, doc_id, text), f"{folder}/marks")
    known = marks.filter("doc_id IS NOT NULL")
    unique = written(known.groupBy(*names).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")), f"{folder}/unique")
    found = known.groupBy("doc_id").agg(F.min(F.struct(*names)).alias("f"), F.max(F.struct(*names)).alias("g")).filter("f <> g")
    twice = known.join(found.select("doc_id"), "doc_id", "left_semi").join(unique, names).groupBy("doc_id").agg(F.min("rep").alias("v"), F.collect_set("rep").alias("reps"))
    same = twice.select(F.explode("reps").alias("u"), "v").filter("u <> v")  # texts under one doc_id
    roots = components(links(unique.drop("n"), words, radius, tile, folder).unionByName(same), folder)
    named = unique.join(roots, F.col("rep") == F.col("node"), "left").select(*names, F.coalesce("root", "rep").alias("component_id"), "n")
    named = written(named, f"{folder}/named")
    rows = join_hot(known, named, names, "n").select("doc_id", *names, "component_id")
    rows = written(rows.unionByName(marks.filter("doc_id IS NULL").withColumn("component_id", F.lit(None).cast("bigint"))))
    delete(docs.sparkSession, folder)
    return rows


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op4_simhash": op4_simhash}
ORACLE_SQL: dict[str, str] = {}
