"""Benchmark decontamination by template canonicalisation.

Words of documents and benchmark items become canonical tokens. A number, with
the unit after it if there is one, is one NUMBER; capitalised words that follow
each other inside a sentence are one NAME, also at sentence starts if the text
never has the word in lower case; all else is the lower-cased word without outer
punctuation. Windows of ``width`` canonical tokens are hash-joined, and windows
of plain lower-cased words besides, so exact copies count in any case. Windows
of placeholders alone say nothing about a template and are left out.

Hits of a document and an item are chained: places grow in both, and from one hit
to the next the relative position moves by ``SHIFT`` tokens at most, so slots of
another length and small insertions break a few windows only. In the best chain
slots are compared: a benchmark slot value must stand for one document value
throughout, windows over slots that break this do not count. An item is found
where ``coverage`` of its windows agree, or where plain windows of a chain cover
``RUN`` words one after the other.

A document window reaches the join only if a filter of fixed size, built from all
benchmark windows, lets it through. Both sides are tables: Spark chooses between
broadcast and shuffle by their size. Items shorter than the window match as a
whole. Items without tokens match nothing. Null texts match nothing. Repeated
item_ids with different texts are items of their own; rows that repeat a doc_id
with the same text count once.
"""

from __future__ import annotations

import string
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from combforge.llm.common import table, written

WIDTH, COVERAGE = 5, 0.5
SHIFT = 3  # tokens by which the relative position may move between hits
RUN = 20  # words of a verbatim passage that count whatever the item's length
WORDS_KEPT = 300_000  # different tokens remembered per task
FACTOR = 0x9E3779B97F4A7C15 | 1
FILTER_BITS = 24

# Units recognised after a number.
UNITS = frozenset("mm cm m km in ft mi g kg lb lbs oz mg l ml s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years meter meters metre metres kilometer kilometers kilometre kilometres inch inches foot feet mile miles gram grams kilogram kilograms pound pounds ounce ounces liter liters litre litres dollar dollars cent cents euro euros percent degrees".split())

NUMBER, NAME = (xxhash.xxh64_intdigest(x) for x in ("\0number", "\0name"))
_OUTER = string.punctuation + "¿¡«»“”„’‘…–—"
TEMPLATE, PLAIN = 0, 1


class Lexicon(dict):
    """Token to a number; per number the hash of the bare word and what it is."""

    def __init__(self):
        super().__init__()
        self.hash = np.zeros(WORDS_KEPT + 1, np.uint64)
        self.kind = np.zeros(WORDS_KEPT + 1, np.uint8)  # 1 digit, 2 capital, 4 unit, 8 ends a sentence

    def __missing__(self, token: str) -> int:
        i = len(self)
        bare = token.strip(_OUTER) or token
        low = bare.lower()
        self.hash[i] = xxhash.xxh64_intdigest(low.encode("utf-8", "surrogatepass"))
        self.kind[i] = (1 if any(c.isdigit() for c in bare) else 0) | (2 if bare[0].isupper() else 0) | (4 if low in UNITS else 0) | (8 if token[-1] in ".!?:…" else 0)
        self[token] = i
        return i

    def canonical(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Canonical tokens: hash, class (0 word, 1 number, 2 name) and first word
        of each; and the hashes of the plain lower-cased words."""
        out = []
        for at in range(0, len(tokens), WORDS_KEPT // 2):
            part = tokens[at : at + WORDS_KEPT // 2]
            if len(self) + len(part) > WORDS_KEPT:
                self.clear()
            ids = np.fromiter(map(self.__getitem__, part), np.int64, len(part))
            out.append((self.hash[ids], self.kind[ids]))
        plain, kind = np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])
        number = kind & 1 > 0
        after = np.zeros(len(plain), bool)
        after[1:] = number[:-1]
        inside = np.zeros(len(plain), bool)
        inside[1:] = kind[:-1] & 8 == 0
        unit = after & (kind & 4 > 0) & ~number
        capital = (kind & 2 > 0) & ~number & ~unit
        name = inside & capital
        start = np.flatnonzero(capital & ~inside)
        if len(start) and name.any():
            used, lower = np.unique(plain[name]), plain[kind & 2 == 0]
            start = start[np.isin(plain[start], used)]
            name[start[~np.isin(plain[start], lower)]] = True
        h = plain.copy()
        h[number], h[name] = NUMBER, NAME
        more = unit.copy()  # of the placeholder before
        more[1:] |= name[1:] & name[:-1] & inside[1:]
        first = np.flatnonzero(~more)
        return h[first], (number * 1 + name * 2)[first], first, plain


def bare(words: list[str]) -> str:
    return " ".join((w.strip(_OUTER) or w).lower() for w in words)


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """Rolling hash of every window of ``width`` tokens."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out * np.uint64(FACTOR) + h[k : k + n]
    return out ^ (out >> np.uint64(32))


def telling(kind: np.ndarray, width: int) -> np.ndarray:
    """Windows that hold a word."""
    words = np.concatenate([[0], np.cumsum(kind == 0)])
    return words[width:] > words[:-width] if len(kind) >= width else np.zeros(0, bool)


def item_windows(text: str, lexicon: Lexicon, width: int = WIDTH) -> list[tuple]:
    """(form, w, hash, at, n) of every window of an item; n: windows of the form."""
    tokens, out = text.split(), []
    if not tokens:
        return out
    h, kind, _, plain = lexicon.canonical(tokens)
    for form, own in ((TEMPLATE, h), (PLAIN, plain)):
        w = min(width, len(own))
        at = np.arange(len(own) - w + 1)
        if form == TEMPLATE:
            at = at[telling(kind, w)]
        out += [(form, w, x, a, len(at)) for x, a in zip(windows(own, w)[at].tolist(), at.tolist(), strict=True)]
    return out


def slots(tokens: list[str], kind: np.ndarray, first: np.ndarray) -> list[str]:
    """The value of each placeholder, empty for words; a number's without the unit."""
    ends = np.where(kind == 1, first + 1, np.append(first[1:], len(tokens)))
    return [bare(tokens[a:b]) if k else "" for k, a, b in zip(kind.tolist(), first.tolist(), ends.tolist(), strict=True)]


def best_chain(hits: list[tuple[int, int]], n_tokens: int) -> list[tuple[int, int]]:
    """The longest chain of (place in the document, place in the item); of equal
    ones that which ends first."""
    hits = sorted(set(hits))
    length, before, start, top = [], [], 0, -1
    for i, (p, at) in enumerate(hits):
        while hits[start][0] < p - n_tokens - SHIFT:  # too far back to be chained
            start += 1
        best, link = 1, -1
        for j in range(start, i):
            q, b = hits[j]
            if q < p and b < at and abs((p - at) - (q - b)) <= SHIFT and length[j] >= best:
                best, link = length[j] + 1, j
        length.append(best)
        before.append(link)
        if top < 0 or best > length[top]:
            top = i
    chain = []
    while top >= 0:
        chain.append(hits[top])
        top = before[top]
    return chain[::-1]


def consistent(chain: list[tuple[int, int]], mine: list[str], kind: list[int], theirs: dict[int, str], w: int) -> tuple[list[tuple[int, int]], int, bool]:
    """The windows left when each slot value stands for one document value, the
    number of slots, and whether a value differs."""
    pairs = {}
    for p, at in chain:
        for k in range(w):
            if kind[at + k]:
                pairs[at + k, p + k] = ((kind[at + k], mine[at + k]), theirs[p + k])
    seen: dict[tuple, Counter] = defaultdict(Counter)
    for key, value in pairs.values():
        seen[key][value] += 1
    chosen = {key: max(c.items(), key=lambda x: (x[1], x[0]))[0] for key, c in seen.items()}
    broken = {x for x, (key, value) in pairs.items() if chosen[key] != value}
    left = [(p, at) for p, at in chain if not any((at + k, p + k) in broken for k in range(w))] if broken else chain
    return left, len({x for x, _ in pairs}), any(key[1] != value for key, value in chosen.items())


def decide(item: str, hits: dict[int, list[tuple[int, int]]], values: dict[int, str], words: dict[int, int], lexicon: Lexicon, width: int, coverage: float) -> tuple | None:
    """(n_windows, n_matched, start_word, n_slots, reparameterised) if an item is found.

    hits: by form; values: document slot values by canonical place; words: first
    word by canonical place.
    """
    tokens = item.split()
    h, kind, first, plain = lexicon.canonical(tokens)
    found = []
    if hits.get(TEMPLATE):
        w = min(width, len(h))
        n = int(telling(kind, w).sum())
        chain, count, changed = consistent(best_chain(hits[TEMPLATE], len(h)), slots(tokens, kind, first), kind.tolist(), values, w)
        if chain and len(chain) >= coverage * n:
            found.append((n, len(chain), words[chain[0][0]], count, changed))
    if hits.get(PLAIN):
        w = min(width, len(plain))
        n = len(plain) - w + 1
        chain = best_chain(hits[PLAIN], len(plain))
        run = most = 1
        for (p, a), (q, b) in zip(chain, chain[1:], strict=False):
            run = run + 1 if (q - p, b - a) == (1, 1) else 1
            most = max(most, run)
        if len(chain) >= coverage * n or most + w - 1 >= RUN:
            found.append((n, len(chain), chain[0][0], 0, False))
    return max(found, key=lambda f: (f[1] / f[0], not f[4], f), default=None)


def _index(benchmark: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """(item, item_id, text) and (form, w, h, item, at)."""
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL").distinct()
    items = written(items.select(F.xxhash64("item_id", "text").alias("item"), "item_id", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon()
        for b in batches:
            rows = [(form, w, np.uint64(x).view(np.int64), i, at) for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True) for form, w, x, at, _ in item_windows(t.as_py(), lexicon, width)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32()), strict=True)], names=["form", "w", "h", "item", "at"])

    return items, written(items.select("item", "text").mapInArrow(run, "form INT, w INT, h BIGINT, item BIGINT, at INT"))


def _sieve(index: DataFrame) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """A filter of 2^FILTER_BITS bits over the hashes, and the (form, w) in use:
    at most one byte of the filter and 2 * width pairs a group reach the driver."""
    low = F.col("h").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    bytes_ = index.groupBy((low / 8).cast("int").alias("byte")).agg(F.bit_or(F.element_at(F.array(*(F.lit(1 << k) for k in range(8))), (low % 8).cast("int") + 1)).alias("bits")).toArrow()
    sieve = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    sieve[bytes_.column(0).to_numpy()] = bytes_.column(1).to_numpy().astype(np.uint8)
    return sieve, sorted((r.form, r.w) for r in index.select("form", "w").distinct().collect())


def _hits(docs: DataFrame, index: DataFrame, width: int) -> DataFrame:
    """(d, th, form, w, h, p, word, values): windows of documents that pass the
    filter; word: the first word; values: of the placeholders in the window."""
    shared = docs.sparkSession.sparkContext.broadcast(_sieve(index))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, (sieve, forms) = Lexicon(), shared.value
        for b in batches:
            rows = []
            for d, th, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                tokens = t.as_py().split()
                if not tokens:
                    continue
                h, kind, first, plain = lexicon.canonical(tokens)
                ends = np.where(kind == 1, first + 1, np.append(first[1:], len(tokens)))
                for form, w in forms:
                    x = windows(plain if form == PLAIN else h, w)
                    low = x & np.uint64((1 << FILTER_BITS) - 1)
                    for p in np.flatnonzero(sieve[low >> np.uint64(3)] >> (low & np.uint64(7)).astype(np.uint8) & 1).tolist():
                        values = [bare(tokens[first[q] : ends[q]]) if kind[q] else "" for q in range(p, p + w)] if form == TEMPLATE else []
                        rows.append((d, th, form, w, int(x[p].view(np.int64)), p, p if form == PLAIN else int(first[p]), values))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.string())), strict=True)], names=["d", "th", "form", "w", "h", "p", "word", "values"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("d"), F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    return rows.mapInArrow(run, "d BIGINT, th BIGINT, form INT, w INT, h BIGINT, p INT, word INT, values ARRAY<STRING>")


FOUND = "item_id BIGINT, n_windows INT, n_matched INT, start_word INT, n_slots INT, reparameterised BOOLEAN"


def _found(docs: DataFrame, benchmark: DataFrame, width: int, coverage: float) -> DataFrame:
    """doc_id, th (hash of the text) and the columns of FOUND."""
    items, index = _index(benchmark, width)
    sizes = index.groupBy("item", "form").agg(F.count(F.lit(1)).alias("n"))
    hits = written(_hits(docs, index, width).join(index, ["form", "w", "h"]).select("d", "th", "item", "form", "at", "p", "word", "values").distinct())
    # no chain is longer than the item places hit
    places = hits.groupBy("d", "th", "item", "form").agg(F.count_distinct("at").alias("k")).join(sizes, ["item", "form"])
    likely = places.filter((F.col("k") >= F.lit(coverage) * F.col("n")) | ((F.col("form") == PLAIN) & (F.col("k") >= RUN - width + 1))).select("d", "th", "item").distinct()
    on = F.col("hits.d").eqNullSafe(F.col("likely.d")) & (F.col("hits.th") == F.col("likely.th")) & (F.col("hits.item") == F.col("likely.item"))
    per = hits.alias("hits").join(likely.alias("likely"), on, "left_semi").groupBy("d", "th", "item").agg(F.collect_list(F.struct("form", "at", "p", "word", "values")).alias("hits"))
    rows = per.join(items, "item").select("d", "th", "item_id", "text", "hits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon()
        for b in batches:
            out = []
            for i in range(b.num_rows):
                d, th, item_id, text, hit = (b.column(k)[i].as_py() for k in range(5))
                by, values, words = defaultdict(list), {}, {}
                for x in hit:
                    by[x["form"]].append((x["p"], x["at"]))
                    if x["form"] == TEMPLATE:
                        words[x["p"]] = x["word"]
                        values.update((x["p"] + k, v) for k, v in enumerate(x["values"]))
                found = decide(text, by, values, words, lexicon, width, coverage)
                if found:
                    out.append((d, th, item_id, *found))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (*[pa.int64()] * 3, *[pa.int32()] * 4, pa.bool_()), strict=True)], names=["doc_id", "th", *(x.split()[0] for x in FOUND.split(", "))])

    return rows.mapInArrow(run, f"doc_id BIGINT, th BIGINT, {FOUND}")


def find_leaks(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, coverage: float = COVERAGE) -> DataFrame:
    """One row per (document, item found): doc_id and the columns of FOUND."""
    return _found(docs, benchmark, width, coverage).drop("th")


def clean(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, coverage: float = COVERAGE) -> DataFrame:
    """The rows in which no item is found."""
    found = written(_found(docs, benchmark, width, coverage).select(F.col("doc_id").alias("d"), "th").distinct())
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("h"))
    return rows.join(found, (F.col("h") == F.col("th")) & F.col("doc_id").eqNullSafe(F.col("d")), "left_anti").select("row.*")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op9_decontamination": op9_decontamination}
ORACLE_SQL: dict[str, str] = {}
