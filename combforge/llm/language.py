"""Language identification with segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary.
A word's probability is the sum over all its segmentations into pieces, by the
forward algorithm; a text's score is the product over its words. Pieces never
cross words, so each different word is computed once per task (in a bounded
memory) for all languages at a time.

Probabilities are fitted by expectation maximisation on a bounded sample:
``per_language`` training texts of each language, chosen by a hash of doc_id.

Words are maximal runs of letters of the whole lower-cased text, of any length
(alpha is rescaled on the way). Null text and texts without a letter get ``und``
and score 0, as does every text when nothing was learned. Of languages that tie,
the first in code point order is predicted. Repeated rows are scored alike; other
columns pass through; null doc_ids are neither held out nor trained on.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from combforge.llm.common import table

UNKNOWN = "und"
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MEMORY, LETTERS = 400_000, 8_000_000  # different words remembered per task, and their letters
RESCALE = 16  # letters after which alpha is rescaled
SIEVE_BITS = 20  # size of the filter before a piece is looked up
WORD = re.compile(r"[^\W\d_]+")


def read_pieces(path: str = VOCABULARY) -> list[str]:
    """Lower-case letter pieces of a sentencepiece vocabulary, of any length, with
    the word mark U+2581 where they start a word."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    every = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    return sorted({p for p in every if p and p == p.lower() and (p.lstrip("▁").isalpha() or p == "▁")})


def marked_words(text: str) -> list[str]:
    return ["▁" + w for w in WORD.findall(text.lower())]


def _codes(words: list[str]) -> np.ndarray:
    return np.array(words, f"U{len(words[0])}").view(np.uint32).reshape(len(words), -1).astype(np.uint64)


def _rolling(codes: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray]]:
    """(k, 64-bit hash of the k letters from each place), up to the longest piece."""
    mixed = (codes + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(32)
    h = mixed
    for k in range(1, min(codes.shape[1], longest) + 1):
        if k > 1:
            h = h[:, :-1] * np.uint64(0xBF58476D1CE4E5B9) + mixed[:, k - 1 :]
        yield k, h ^ (h >> np.uint64(29))


def _by_length(words: list[str], letters: int = 1 << 16) -> Iterator[tuple[int, list[int]]]:
    """(length, places) of words of one length, ``letters`` of them at most or one word."""
    by: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by.setdefault(len(w), []).append(i)
    for n, own in by.items():
        step = max(1, letters // n)
        for at in range(0, len(own), step):
            yield n, own[at : at + step]


@dataclass
class Model:
    """probability: (pieces + 2, languages); row 0 is impossible, row 1 a letter
    outside the vocabulary."""

    languages: list[str]
    pieces: dict[str, int]
    probability: np.ndarray
    prior: np.ndarray

    def __post_init__(self):
        found = np.empty(len(self.pieces), np.uint64)
        number = np.fromiter(self.pieces.values(), np.int32, len(self.pieces))
        names = list(self.pieces)
        self.longest = max(map(len, names), default=1)
        for k, own in _by_length(names):
            found[own] = next(h for n, h in _rolling(_codes([names[i] for i in own]), k) if n == k)[:, 0]
        order = np.argsort(found)
        self.found, self.number = found[order], number[order]
        self.sieve = np.zeros(1 << SIEVE_BITS, bool)
        self.sieve[found & np.uint64((1 << SIEVE_BITS) - 1)] = True

    def lattice(self, words: list[str]) -> np.ndarray:
        """(words, end, length) piece numbers, for words of one length."""
        n = len(words[0])
        ids = np.zeros((len(words), n, min(n, self.longest)), np.int32)
        ids[:, :, 0] = 1
        for k, h in _rolling(_codes(words), self.longest):
            w, i = np.nonzero(self.sieve[h & np.uint64((1 << SIEVE_BITS) - 1)])
            asked = h[w, i]
            at = np.minimum(np.searchsorted(self.found, asked), len(self.found) - 1)
            hit = self.found[at] == asked
            ids[w[hit], i[hit] + (k - 1), k - 1] = self.number[at[hit]]
        return ids

    def forward(self, words: list[str]) -> np.ndarray:
        """(words, languages) log probabilities, summed over segmentations."""
        out = np.empty((len(words), len(self.languages)))
        for n, own in _by_length(words):
            ids = self.lattice([words[i] for i in own])
            size = ids.shape[2]
            alpha = [np.ones((len(own), len(self.languages)))]  # the last ``size`` places
            scale = np.zeros_like(alpha[0])
            for j in range(n):
                new = np.zeros_like(scale)
                for k in range(1, len(alpha) + 1):
                    new += alpha[-k] * self.probability[ids[:, j, k - 1]]
                alpha = [*alpha, new][-size:]
                if j % RESCALE == RESCALE - 1:
                    scale += np.log(new)
                    alpha = [x / new for x in alpha]
            out[own] = np.log(alpha[-1]) + scale
        return out


def fit(samples: list[tuple[str, str]], pieces: list[str], rounds: int = 2, smoothing: float = 0.1) -> Model:
    """Expectation maximisation over (language, text) samples."""
    languages = sorted({lang for lang, _ in samples})
    number = {p: i + 2 for i, p in enumerate(pieces)}
    counts = {lang: Counter() for lang in languages}
    texts = Counter(lang for lang, _ in samples)
    for lang, text in samples:
        counts[lang].update(marked_words(text))
    size = len(pieces) + 2
    model = Model(languages, number, np.full((size, len(languages)), 1.0 / size), np.log(np.array([texts[x] for x in languages], float) / max(1, len(samples))))
    model.probability[0] = 0
    for _ in range(rounds):
        expected = np.zeros((size, len(languages)))
        for c, lang in enumerate(languages):
            p = model.probability[:, c]
            with np.errstate(divide="ignore"):
                logs = np.log(p)
            known = list(counts[lang])
            for n, own in _by_length(known):
                words = [known[i] for i in own]
                times = np.log(np.array([counts[lang][w] for w in words], float))
                ids = model.lattice(words)
                most = ids.shape[2]
                alpha, beta = np.full((2, n + 1, len(words)), -np.inf)
                alpha[0] = beta[n] = 0
                for j in range(1, n + 1):
                    for k in range(1, min(j, most) + 1):
                        alpha[j] = np.logaddexp(alpha[j], alpha[j - k] + logs[ids[:, j - 1, k - 1]])
                for j in range(n, 0, -1):
                    for k in range(1, min(j, most) + 1):
                        arc = ids[:, j - 1, k - 1]
                        beta[j - k] = np.logaddexp(beta[j - k], beta[j] + logs[arc])
                        np.add.at(expected[:, c], arc, np.exp(times + alpha[j - k] + logs[arc] + beta[j] - alpha[n]))
        expected[0] = 0
        total = expected.sum(0)
        model.probability = (expected + smoothing) / (total + smoothing * size)
        model.probability[0] = 0
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, per_language: int = 100, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> list[tuple[str, str]]:
    """At most ``per_language`` training texts of each language: the bound on
    what reaches the driver."""
    known = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).filter("id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL").filter(~held_out(F.col("id")))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    chosen = known.select("id", "lang", F.row_number().over(order).alias("r")).filter(F.col("r") <= per_language).select("id", "lang").distinct()
    rows = known.join(F.broadcast(chosen), ["id", "lang"]).groupBy("id", "lang").agg(F.min("text").alias("text"))
    return [(r.lang, r.text) for r in rows.orderBy("lang", "id").collect()]


def identify(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Adds lang_pred and score, the posterior of the prediction (clashing names
    of the input are replaced)."""
    names = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    rows = docs.select(*(F.col(f"`{c}`") for c in names))
    at = names.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        number: dict[str, int] = {}
        scores, letters = np.zeros((0, 0)), 0
        for b in batches:
            for start in range(0, b.num_rows, 1024):
                part = b.slice(start, 1024)
                found = [Counter(marked_words(t)) if t else {} for t in part.column(at).to_pylist()]
                langs, best = [], []
                if m is not None:
                    new = list({w for c in found for w in c if w not in number})
                    if len(number) + len(new) > MEMORY or letters > LETTERS:
                        number.clear()
                        letters = 0
                        new = list({w for c in found for w in c})
                    if not number:
                        scores = np.zeros((0, len(m.languages)))
                    letters += sum(map(len, new))
                    number.update(zip(new, range(len(number), len(number) + len(new)), strict=True))
                    if new:
                        grown = len(scores) + len(new)
                        scores = np.concatenate([scores[: grown - len(new)], m.forward(new)])
                for c in found:
                    if m is None or not any(x.isalpha() for w in c for x in w):
                        langs.append(UNKNOWN)
                        best.append(0.0)
                        continue
                    total = m.prior + np.fromiter(c.values(), float, len(c)) @ scores[[number[w] for w in c]]
                    k = int(total.argmax())
                    langs.append(m.languages[k])
                    best.append(float(1 / np.exp(total - total[k]).sum()))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(best, pa.float64())], names=[*names, "lang_pred", "score"])

    schema = T.StructType([*rows.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(run, schema)


def trained(docs: DataFrame, vocabulary: str = VOCABULARY, per_language: int = 100, **columns) -> Model | None:
    found = sample(docs, per_language, **columns)
    return fit(found, read_pieces(vocabulary)) if found else None


def op2_language(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), trained(docs, vocabulary))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame, model: Model | None, least: float = 0.5) -> DataFrame:
    """Documents with a language, none of which is more likely than not another."""
    keep = docs.columns
    packed = docs.select(F.struct("*").alias("row"), F.col("text"))
    return identify(packed, model).filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select("row.*").select(*keep)


QUERIES = {"op2_language": op2_language}
ORACLE_SQL: dict[str, str] = {}
