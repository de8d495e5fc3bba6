"""Removal of repeated byte strings with column-wise suffix structures.

A byte goes if a ``width``-byte string that covers it also starts earlier (in a
smaller doc_id, or earlier in the same document), judged on the input.

The suffix structure of a collection is built column by column: every round
prepends one symbol to each string, and the stable order of those symbols (the
column of the Burrows-Wheeler transform) gives the new order of the suffixes.
The number of rounds is the length of the longest string, so whole documents (a
hundred thousand rounds over the corpus) are out of reach. They are therefore
cut where content says so, without losing a string:

1. The smallest 32-byte gram of each ``width``-byte string is its anchor; strings
   that follow each other with one anchor form a span of fewer than 2 * ``width``
   bytes. Equal strings have equal anchors at equal distance.
2. Spans whose gram occurs once hold nothing repeated. Of equal spans all but the
   first are repeated throughout, and only the first goes on; it does so only if
   its gram has different spans.
3. These short spans, aligned at their grams, make up the collections of the
   column-wise construction, a gram's spans together; a gram with very many is salted over collections, each
   of which reduces its strings to the first of each; the firsts meet by hash.
4. Neighbours in suffix order that share ``width`` bytes are equal strings.

Collections are bounded, so the transform of a round stays in memory instead of
external files. Grams and spans are compared by 64-bit hashes of each (128 bits
a span), strings in step 3 byte by byte.

Null text is empty. A null doc_id is smaller than all others. Rows that repeat a
doc_id with another text are documents of their own, ordered by a hash of the
text; equal rows are one document. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from combforge.llm.common import delete, shared_path, table, written

WIDTH, GRAM = 100, 32
BLOCK = 1 << 21  # string starts handled at once in a document
COLLECTION = 5_000  # spans after which a collection is closed
HOT = 5_000  # spans of a gram beyond which it is salted


def _grams(b: np.ndarray, size: int) -> np.ndarray:
    """Hash of every ``size``-byte gram (a power of two), by doubling."""
    h = (b.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    k, factor = 1, 0xBF58476D1CE4E5B9
    while k < size:
        h = h[:-k] * np.uint64(factor) + h[k:]
        h ^= h >> np.uint64(31)
        factor = (factor * factor) % 2**64
        k *= 2
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _least(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` values in a row."""
    k = 1
    while 2 * k <= w:
        v = np.minimum(v[:-k], v[k:])
        k *= 2
    return np.minimum(v[: len(v) - (w - k)], v[w - k :]) if w > k else v


def spans(data: bytes, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram hash, first string start, number of string starts, distance of the
    gram from the first start) of each span."""
    out = []
    whole = np.frombuffer(data, np.uint8)
    for at in range(0, len(data) - width + 1, BLOCK):
        h = _grams(whole[at : at + BLOCK + width - 1], gram)
        low = np.uint64((1 << 24) - 1)
        place = _least((h & ~low) | np.arange(len(h), dtype=np.uint64), width - gram + 1) & low
        first = np.concatenate([[0], np.flatnonzero(place[1:] != place[:-1]) + 1])
        out.append((h[place[first]], first + at, np.diff(np.append(first, len(place))), place[first].astype(np.int64) - first))
    if not out:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def equal_strings(strings: list[bytes], gram: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string number, start, class) of every ``width``-byte string.

    The strings stand aligned at their grams, as equal parts have them at equal
    distance. Columns are inserted from the last to the first: each round
    prepends one symbol to every string that reaches the column, and the stable
    order of the symbols turns the order of the suffixes behind them into the new
    one. Where strings start, neighbours that share ``width`` bytes are equal.
    """
    length = np.array([len(s) for s in strings], np.int64)
    text = np.frombuffer(b"".join(strings), np.uint8)
    origin = np.cumsum(length) - length
    left, right = -gram.astype(np.int64), length - gram  # columns from left to before right
    order = np.zeros(0, np.int64)
    numbers, starts, classes, made = [], [], [], 0
    enters = np.argsort(-right, kind="stable")
    ends = -right[enters]
    for column in range(int(right.max(initial=0)) - 1, int(left.min(initial=0)) - 1, -1):
        fresh = enters[np.searchsorted(ends, -(column + 1), "left") : np.searchsorted(ends, -(column + 1), "right")]
        order = np.concatenate([fresh, order])  # an empty suffix comes first
        order = order[left[order] <= column]
        at = origin[order] + (column - left[order])
        step = np.argsort(text[at], kind="stable")
        order, at = order[step], at[step]
        long = right[order] - column >= width
        own, place = order[long], at[long]
        if not len(own):
            continue
        same = np.ones(len(own) - 1, bool)
        for k in range(0, width, 10):
            live = np.flatnonzero(same)
            if not len(live):
                break
            cols = np.arange(k, min(k + 10, width))
            same[live] = (text[place[live, None] + cols] == text[place[live + 1, None] + cols]).all(1)
        numbers.append(own)
        starts.append(column - left[own])
        classes.append(made + np.concatenate([[0], np.cumsum(~same)]))
        made = int(classes[-1][-1]) + 1
    none = [np.zeros(0, np.int64)]
    return tuple(np.concatenate(x or none) for x in (numbers, starts, classes))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _grams_of(docs: DataFrame, width: int) -> DataFrame:
    """(g) of every span."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [spans(x.as_py(), width)[0] for x in b.column(0)]
            if found:
                yield pa.RecordBatch.from_arrays([_signed(np.concatenate(found))], names=["g"])

    return docs.select("body").mapInArrow(run, "g BIGINT")


def _occurrences(docs: DataFrame, width: int) -> DataFrame:
    """(g, s, d, th, at): every span with the hashes of its gram and content; at
    packs its first string's start, its number of strings and its gram's distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for b in batches:
            for i in range(b.num_rows):
                data = b.column(2)[i].as_py()
                if len(data) < width:
                    continue
                g, at, n, gram = spans(data, width)
                s = np.fromiter((digest(data[x : x + k]) for x, k in zip(at.tolist(), (n + (width - 1)).tolist(), strict=True)), np.uint64, len(at))
                yield pa.RecordBatch.from_arrays([_signed(g), _signed(s), pa.array(np.full(len(g), b.column(0)[i].as_py())), pa.array(np.full(len(g), b.column(1)[i].as_py())), pa.array((at.astype(np.int64) << 16) | (n << 8) | gram)], names=["g", "s", "d", "th", "at"])

    return docs.mapInArrow(run, "g BIGINT, s BIGINT, d BIGINT, th BIGINT, at BIGINT")


def _contents(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(g, salt, d, th, start, span, gram) of the wanted spans; gram: its distance."""
    per = wanted.groupBy("d", "th").agg(F.collect_list(F.struct("g", "salt", "at")).alias("w"))
    rows = docs.join(per, ["d", "th"]).select("d", "th", "body", "w")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i in range(b.num_rows):
                d, th, data = (b.column(k)[i].as_py() for k in range(3))
                for w in b.column(3)[i].as_py():
                    at, n, gram = w["at"] >> 16, w["at"] >> 8 & 255, w["at"] & 255
                    out.append((w["g"], w["salt"], d, th, at, data[at : at + n + width - 1], gram))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32()), strict=True)], names=["g", "salt", "d", "th", "start", "span", "gram"])

    return rows.mapInArrow(run, "g BIGINT, salt INT, d BIGINT, th BIGINT, start BIGINT, span BINARY, gram INT")


REPEATS = "d BIGINT, th BIGINT, lo BIGINT, hi BIGINT, w1 BIGINT, w2 BIGINT"


def _collection(rows: list[tuple], width: int) -> pa.RecordBatch:
    """Repeated strings of a collection as runs of starts lo..hi; for salted
    spans also the first string of each class, with its hash."""
    number, start, cls = equal_strings([r[5] for r in rows], np.array([r[6] for r in rows]), width)
    d, th, begin = (np.array([r[k] for r in rows], np.int64)[number] for k in (2, 3, 4))
    salted = np.array([r[1] >= 0 for r in rows])[number]
    begin = begin + start
    order = np.lexsort((begin, th, d, cls))
    head = np.ones(len(order), bool)
    head[1:] = cls[order[1:]] != cls[order[:-1]]
    again = np.zeros(len(order), bool)
    again[order] = ~head
    keep = np.flatnonzero(again)
    keep = keep[np.lexsort((begin[keep], th[keep], d[keep]))]
    cut = np.ones(len(keep), bool)
    cut[1:] = (d[keep[1:]] != d[keep[:-1]]) | (th[keep[1:]] != th[keep[:-1]]) | (begin[keep[1:]] - begin[keep[:-1]] > 1)
    a = keep[cut]
    z = keep[np.append(np.flatnonzero(cut)[1:] - 1, len(keep) - 1)] if len(keep) else keep
    firsts = np.flatnonzero(~again & salted)
    hashes = [xxhash.xxh3_128_intdigest(rows[number[i]][5][start[i] : start[i] + width]) for i in firsts.tolist()]
    w1 = np.array([h >> 64 for h in hashes], np.uint64).view(np.int64)
    w2 = np.array([h & (2**64 - 1) for h in hashes], np.uint64).view(np.int64)
    none = pa.nulls(len(a), pa.int64())
    both = lambda x, y: pa.array(np.concatenate([x, y]))
    return pa.RecordBatch.from_arrays([both(d[a], d[firsts]), both(th[a], th[firsts]), both(begin[a], begin[firsts]), both(begin[z], begin[firsts]), pa.concat_arrays([none, pa.array(w1)]), pa.concat_arrays([none, pa.array(w2)])], names=["d", "th", "lo", "hi", "w1", "w2"])


def _resolve(contents: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if len(held) >= COLLECTION and row[:2] != held[-1][:2]:
                    yield _collection(held, width)
                    held = []
                held.append(row)
        if held:
            yield _collection(held, width)

    return contents.repartition("g", "salt").sortWithinPartitions("g", "salt").mapInArrow(run, REPEATS)


def repeated_starts(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(d, th, runs): each document's runs lo..hi of starts of strings that also
    start earlier, as lo * 2**32 + hi.

    docs: d, th, body (binary). The tables on the way are deleted when the result
    is written. Grams that occur twice are a table of their own, so that adaptive
    execution can split the join on a very frequent gram.
    """
    spark = docs.sparkSession
    folder = shared_path(spark)
    common = written(_grams_of(docs, width).groupBy("g").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("g"), f"{folder}/common")
    rows = written(_occurrences(docs, width).join(common, "g"), f"{folder}/rows")
    classes = written(rows.groupBy("g", "s").agg(F.min(F.struct("d", "th", "at")).alias("first"), F.count(F.lit(1)).alias("k")), f"{folder}/classes")
    several = classes.groupBy("g").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    wanted = classes.select("g", "s", "first").join(several, "g")
    salt = F.when(F.col("k") > HOT, F.pmod("s", F.ceil(F.col("k") / HOT)).cast("int")).otherwise(F.lit(-1))
    wanted = wanted.select("g", salt.alias("salt"), "first.d", "first.th", "first.at")
    found = written(_resolve(_contents(docs, wanted, width), width), f"{folder}/found")
    copies = rows.join(classes.filter("k > 1").select("g", "s", "first"), ["g", "s"]).filter(F.struct("d", "th", "at") != F.col("first"))
    start, number = F.shiftright("at", 16), F.shiftright("at", 8).bitwiseAND(F.lit(255).cast("bigint"))
    copies = copies.select("d", "th", start.alias("lo"), (start + number - 1).alias("hi"))
    firsts = found.filter("w1 IS NOT NULL")
    least = firsts.groupBy("w1", "w2").agg(F.min(F.struct("d", "th", "lo")).alias("first"))
    late = firsts.join(least, ["w1", "w2"]).filter(F.struct("d", "th", "lo") != F.col("first")).select("d", "th", "lo", "hi")
    every = copies.unionByName(found.filter("w1 IS NULL").select("d", "th", "lo", "hi")).unionByName(late)
    packed = every.select("d", "th", (F.shiftleft("lo", 32) + F.col("hi")).alias("run"))
    runs = written(packed.groupBy("d", "th").agg(F.collect_list("run").alias("runs")))
    delete(spark, folder)
    return runs


def remove_repeats(docs: DataFrame, width: int = WIDTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, kept (binary), n_bytes, n_removed, n_spans."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    rows = docs.select(F.coalesce(F.col(f"`{doc_id}`").cast("bigint"), F.lit(-(2**63)).cast("bigint")).alias("d"), F.xxhash64(body).alias("th"), body.alias("body"), F.col(f"`{doc_id}`").alias("doc_id"))
    joined = rows.join(repeated_starts(rows.select("d", "th", "body"), width), ["d", "th"], "left").select("doc_id", "body", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, removed, cuts = [], [], []
            for i in range(b.num_rows):
                data, found = b.column(1)[i].as_py(), b.column(2)[i]
                edge = np.zeros(len(data) + 1, np.int64)
                if found.is_valid:
                    packed = found.values.to_numpy()
                    np.add.at(edge, packed >> 32, 1)
                    np.add.at(edge, (packed & 0xFFFFFFFF) + width, -1)
                gone = np.cumsum(edge[:-1]) > 0
                removed.append(int(gone.sum()))
                cuts.append(int(np.count_nonzero(gone[1:] & ~gone[:-1]) + (1 if len(gone) and gone[0] else 0)))
                kept.append(np.frombuffer(data, np.uint8)[~gone].tobytes() if removed[-1] else data)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kept, pa.binary()), pa.array([len(x) for x in b.column(1).to_pylist()], pa.int64()), pa.array(removed, pa.int64()), pa.array(cuts, pa.int64())], names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    kind = joined.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"doc_id {kind}, kept BINARY, n_bytes BIGINT, n_removed BIGINT, n_spans BIGINT")


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op8_repeats": op8_repeats}
ORACLE_SQL: dict[str, str] = {}
