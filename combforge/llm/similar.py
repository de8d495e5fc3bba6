"""Groups of texts by exact Jaccard similarity over different shingles.

1. A text becomes the set of its different shingles; equal sets collapse to the
   smallest doc_id.
2. SimHash fingerprints of the sets are compared tile by tile (``simhash.links``);
   what lies within ``radius`` bits is a candidate.
3. A fingerprint is no bound on the similarity, so an exact way covers the rest.
   Prefix filter: in one order of all shingles (those of rare cells first) two
   sets of similarity s share one of their first n - ceil(s n) + 1. The order
   decides how many pairs meet, never which pairs are found. Each set is a
   candidate with the smallest doc_id that it may be similar to: linear.
4. Candidates are verified on the texts and merged.
5. Every pair under a shingle whose components still differ is then verified.

Parity bitmaps, a bit or more a shingle, spare texts: they differ in no more bits
than the sets in shingles, so no similar pair is lost by them. So the components
are those of all pairs. Null text counts as empty; empty texts are one group.
Texts under one doc_id belong together. Rows with a null doc_id are not compared
and not returned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from combforge.llm import simhash
from combforge.llm.common import delete, join_hot, shared_path, written
from combforge.llm.simhash import BLOCK, components, shingle_hashes

WORDS = 8  # of the smallest parity bitmap, 64 bits each
SLACK = 1e-9  # rounding must not lose a pair
BITMAP = [f"b{k}" for k in range(WORDS)]


def parity(shingles: np.ndarray, words: int = WORDS) -> np.ndarray:
    """A bit is the parity of the shingles that fall on it (words: a power of two)."""
    bits = np.bincount((shingles & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.uint64)


def folded(bitmap: np.ndarray, words: int) -> np.ndarray:
    """The bitmap of the same set in fewer words."""
    return np.bitwise_xor.reduce(bitmap.reshape(-1, words), axis=0)


def wide(shingles: np.ndarray) -> np.ndarray:
    """A parity bitmap of a bit a shingle at least."""
    return parity(shingles, max(WORDS, 1 << max(0, (len(shingles) - 1) // 64).bit_length()))


def prefix_length(n: int, similarity: float) -> int:
    return n - math.ceil(similarity * n - SLACK) + 1 if n else 0


def frequencies(docs: DataFrame, width: int, cells: int = 1 << 18) -> np.ndarray:
    """In how many texts, all of them counted, the shingles of a cell are found.

    A shingle falls on the cell of its low bits. A task adds up ``cells`` numbers
    and sends those that are not zero; ``cells`` rows reach the driver at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, np.int64)
        for b in batches:
            for t in b.column(0):
                np.add.at(total, (np.unique(shingle_hashes(t.as_py(), width)) & np.uint64(cells - 1)).astype(np.int64), 1)
        c = np.flatnonzero(total)
        for at in range(0, len(c), 1 << 16):
            part = c[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], names=["c", "n"])

    found = docs.select("text").mapInArrow(run, "c BIGINT, n BIGINT").groupBy("c").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(cells, np.int64)
    out[found.column("c").to_numpy()] = found.column("n").to_numpy()
    return out


def shingle_sets(docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """doc_id, k0 and k1 (128 bits of the set), n, the fingerprint f0, the small
    bitmap, the wide one m and the prefix p."""
    shared = docs.sparkSession.sparkContext.broadcast(frequencies(docs, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        mask = np.uint64(len(often) - 1)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                keys, sizes, prints, maps, wides, prefixes = [], [], [], [], [], []
                for t in part.column(1):
                    s = np.unique(shingle_hashes(t.as_py(), width))
                    weight = often[(s & mask).astype(np.int64)]
                    keys.append(np.frombuffer(xxhash.xxh128_digest(s.tobytes()), np.int64))
                    sizes.append(len(s))
                    prints.append(simhash.fingerprint(s)[0])
                    bitmap = wide(s)
                    maps.append(folded(bitmap, WORDS))
                    wides.append(bitmap.tobytes())
                    prefixes.append(s[np.argsort(weight, kind="stable")[: prefix_length(len(s), similarity)]].view(np.int64))
                k, m = np.array(keys), np.array(maps).view(np.int64)
                columns = [pa.array(np.ascontiguousarray(c)) for c in (*k.T, *m.T)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns[:2], pa.array(sizes, pa.int32()), pa.array(np.array(prints, np.uint64).view(np.int64)), *columns[2:], pa.array(wides, pa.binary()), pa.array(prefixes, pa.list_(pa.int64()))], names=["doc_id", "k0", "k1", "n", "f0", *BITMAP, "m", "p"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id BIGINT, k0 BIGINT, k1 BIGINT, n INT, f0 BIGINT, " + ", ".join(f"{b} BIGINT" for b in BITMAP) + ", m BINARY, p ARRAY<BIGINT>")


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups of the sorted first column, with their bounds."""

    def tables():
        held, last = [], None
        for b in batches:
            if not b.num_rows:
                continue
            t = b.column(0).to_numpy()
            cut = int(np.searchsorted(t, t[-1]))
            if cut:
                yield [*held, b.slice(0, cut)]
                held = []
            elif held and last != t[-1]:
                yield held
                held = []
            held, last = [*held, b.slice(cut)], t[-1]
        if held:
            yield held

    for x in tables():
        x = pa.Table.from_batches(x)
        t = x.column(0).to_numpy()
        yield x, np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1], [True]]))


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(t, id, least) of the groups of two or more."""
    for x, bounds in grouped(batches):
        t, ident = (c.to_numpy() for c in x.columns)
        sizes = np.diff(bounds)
        many = np.repeat(sizes > 1, sizes)
        if many.any():
            yield pa.RecordBatch.from_arrays([pa.array(c[many]) for c in (t, ident, np.repeat(ident[bounds[:-1]], sizes))], names=["t", "id", "least"])


def apart(similarity: float) -> float:
    """Part of |a| + |b| by which similar sets differ at most."""
    return (1 - similarity) / (1 + similarity)


def _pairs(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, bounds in grouped(batches):
            _, ident, comp, n, *b = (c.to_numpy() for c in x.columns)
            b = np.stack([c.view(np.uint64) for c in b], 1)
            out, held = [], 0
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                step = max(1, BLOCK // (hi - lo))
                for at in range(lo, hi, step):
                    end = min(at + step, hi)
                    i, j = np.nonzero(comp[at:end, None] < comp[None, lo:hi])
                    i, j = i + at, j + lo
                    size = n[i] + n[j]
                    fit = np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]) - SLACK
                    i, j, size = i[fit], j[fit], size[fit]
                    d = np.zeros(len(i), np.int64)
                    for k in range(WORDS):
                        d += np.bitwise_count(b[i, k] ^ b[j, k])
                    fit = d <= apart(similarity) * size + SLACK
                    if fit.any():
                        out.append((np.maximum(ident[i[fit]], ident[j[fit]]), np.minimum(ident[i[fit]], ident[j[fit]])))
                        held += int(fit.sum())
                    if held > BLOCK:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["u", "v"])
                        out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["u", "v"])

    return run


def possible(pairs: DataFrame, bits: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) that the wide bitmaps (id, n, m) do not rule out."""
    u, v = (bits.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("m").alias(f"m{x}")) for x in "uv")
    both = pairs.join(u, "u").join(v, "v").filter(F.least("nu", "nv") >= F.lit(similarity) * F.greatest("nu", "nv") - F.lit(SLACK))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            most = apart(similarity) * (b.column(2).to_numpy() + b.column(3).to_numpy()) + SLACK
            keep = np.zeros(b.num_rows, bool)
            for i, (x, y) in enumerate(zip(b.column(4), b.column(5), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                words = min(len(x), len(y))
                keep[i] = np.bitwise_count(folded(x, words) ^ folded(y, words)).sum() <= most[i]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in b.columns[:2]], names=["u", "v"])

    return both.select("u", "v", "nu", "nv", "mu", "mv").mapInArrow(run, "u BIGINT, v BIGINT")


def verified(pairs: DataFrame, docs: DataFrame, width: int, similarity: float, folder: str) -> DataFrame:
    """The pairs (u, v) whose texts are that similar; of several texts under one
    doc_id any two may be. Only texts that a pair names are read into shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                sets = [np.unique(shingle_hashes(t.as_py(), width)).view(np.int64) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["id", "s"])

    asked = pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    sets = docs.select(F.col("doc_id").alias("id"), "text").join(asked, "id", "left_semi").mapInArrow(run, "id BIGINT, s ARRAY<BIGINT>").dropDuplicates(["id", "s"])
    sets = written(sets, f"{folder}/sets")
    both = pairs.join(sets.select(F.col("id").alias("u"), F.col("s").alias("a")), "u").join(sets.select(F.col("id").alias("v"), F.col("s").alias("b")), "v")
    common = F.size(F.array_intersect("a", "b"))
    alike = common >= F.lit(similarity) * (F.size("a") + F.size("b") - common)
    return both.filter(alike).select("u", "v").distinct()


def groups(docs: DataFrame, width: int = 5, similarity: float = 0.8, radius: int = 2, tile: int = 4096) -> DataFrame:
    """doc_id and component_id of every row with a doc_id."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id IS NOT NULL")
    folder = shared_path(spark)

    def kept(table: DataFrame, name: str) -> DataFrame:
        return written(table, f"{folder}/{name}")

    full = kept(shingle_sets(docs, width, similarity), "full")
    marks = kept(full.drop("p"), "marks")
    keys = ["k0", "k1"]
    unique = kept(marks.groupBy(*keys).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("rows")), "unique")
    several = marks.groupBy("doc_id").agg(F.min(F.struct(*keys)).alias("f"), F.max(F.struct(*keys)).alias("g")).filter("f <> g").select("doc_id")
    same = marks.join(several, "doc_id", "left_semi").join(unique, keys).select(F.col("doc_id").alias("u"), F.col("rep").alias("v")).filter("u <> v")
    first = unique.select(*keys, F.col("rep").alias("doc_id"))
    tokens = full.select("doc_id", *keys, "p").join(first, [*keys, "doc_id"], "left_semi").select(F.explode("p").alias("t"), F.col("doc_id").alias("id"))
    members = kept(tokens.repartition("t").sortWithinPartitions("t", "id").mapInArrow(_members, "t BIGINT, id BIGINT, least BIGINT"), "members")
    delete(spark, f"{folder}/full")

    sets = kept(marks.join(first, [*keys, "doc_id"], "left_semi").select(F.col("doc_id").alias("id"), "n", "f0", *BITMAP, "m"), "bits")
    bits, small = sets.select("id", "n", "m"), sets.select("id", "n", *BITMAP)
    prints = kept(sets.groupBy("f0").agg(F.min("id").alias("rep")), "prints")
    close = simhash.links(prints, 1, radius, tile, f"{folder}/tiled")
    close = close.unionByName(sets.select(F.col("id").alias("u"), "f0").join(prints, "f0").select("u", F.col("rep").alias("v")).filter("u <> v"))
    stars = members.filter("id <> least").select(F.col("id").alias("u"), F.col("least").alias("v")).distinct()
    stars = possible(stars, bits, similarity).groupBy("u").agg(F.min("v").alias("v"))
    near = kept(possible(close, bits, similarity).unionByName(stars).distinct(), "near")
    links = kept(verified(near, docs, width, similarity, f"{folder}/near-texts").unionByName(same), "links")

    roots = components(links, f"{folder}/first")
    placed = members.select("t", "id").join(roots, F.col("id") == F.col("node"), "left").select("t", "id", F.coalesce("root", "id").alias("comp"))
    placed = kept(placed, "placed")
    mixed = placed.groupBy("t").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).filter("a <> b").select("t")
    left = placed.join(mixed, "t", "left_semi").join(small, "id").select("t", "id", "comp", "n", *BITMAP)
    pairs = left.repartition("t").sortWithinPartitions("t").mapInArrow(_pairs(similarity), "u BIGINT, v BIGINT")
    pairs = kept(possible(pairs.distinct(), bits, similarity), "pairs")
    roots = components(links.unionByName(verified(pairs, docs, width, similarity, f"{folder}/texts")), f"{folder}/second")
    named = kept(unique.join(roots, F.col("rep") == F.col("node"), "left").select(*keys, F.coalesce("root", "rep").alias("component_id"), "rows"), "named")
    out = written(join_hot(marks.select("doc_id", *keys), named, keys, "rows").select("doc_id", "component_id"))
    delete(spark, folder)
    return out
