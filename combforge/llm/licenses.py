"""License scan by a positional rare-token index (DataFrame functions only).

1. Document frequencies of all licence words are counted over the whole corpus.
2. The index holds each template's highest-IDF words with their positions, and
   for each key phrase its own highest-IDF word.
3. A file's index words are looked up; postings are intersected by relative
   position: a template is a candidate at an offset on which at least ``votes``
   of the file's rare words agree.
4. Its mandatory key phrases are verified word by word at that offset.

Base phrases go the same way with one rare word each, so every place is found:
a phrase cannot stand where its rarest word does not.

Null or empty text: no words, no labels, score 0. Null doc_id, repeated rows and
other columns pass through unharmed; every input row gives one output row.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from combforge.llm.common import LOWER, UPPER, clash_free, table

# The base phrases and their labels.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Notices by label, and the phrases that each must contain.
TEMPLATES = {
    "apache-2.0": ("licensed under the apache license version 2 0", ("apache license version 2 0",)),
    "apache-2.0-notice": ("you may not use this file except in compliance with the license you may obtain a copy of the license at", ("except in compliance with the license",)),
    "mit": ("released under the mit license", ("the mit license",)),
    "mit-text": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge",)),
    "gpl-3.0": ("licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    "gpl-notice": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", ("this program is free software", "gnu general public license")),
    "cc-by-nc-4.0": ("licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    "cc-by-sa-4.0": ("licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    "mpl-2.0": ("this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2 0",)),
    "unlicense": ("this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
}

HASH_SEED = 42  # of xxhash64 in Spark
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def word_split(text: Column) -> Column:
    """Lower-cased text split at separators; the first and last piece may be empty.

    Only U+0130 and U+212A lower to ASCII letters; they are swapped for other
    word characters first, so ``lower`` acts on A-Z alone as far as ASCII goes.
    """
    safe = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("İ"), F.lit("ı")), F.lit("K"), F.lit("ĸ"))
    return F.split(F.lower(safe), SEPARATORS)


def with_words(df: DataFrame, text: str, to: str) -> DataFrame:
    raw = clash_free(df.columns, "raw")
    df = df.withColumn(raw, word_split(F.col(text)))
    lead = (F.element_at(raw, 1) == "").cast("int")
    tail = ((F.element_at(raw, -1) == "") & (F.size(raw) > 1)).cast("int")
    return df.withColumn(to, F.slice(raw, lead + 1, F.size(raw) - lead - tail)).drop(raw)


@dataclass(frozen=True)
class Entry:
    label: str
    postings: dict[str, list[int]]  # rare word: positions
    votes: int  # places of rare words that must agree
    must: tuple[tuple[int, tuple[str, ...]], ...]  # position and words of each key phrase


@dataclass(frozen=True)
class Index:
    base: tuple[Entry, ...]
    templates: tuple[Entry, ...]

    @property
    def words(self) -> list[str]:
        return sorted(set().union(*(e.postings for e in (*self.base, *self.templates))))


def licence_words(base=BASE_PHRASES, templates=TEMPLATES) -> list[str]:
    texts = [*base, *(t for t, _ in templates.values()), *(p for _, must in templates.values() for p in must)]
    return sorted({w for t in texts for w in t.split()})


def document_frequencies(docs: DataFrame, words: list[str], text: str = "text") -> tuple[int, dict[str, int]]:
    """Number of documents, and of those with each word; as many rows reach the
    driver as there are licence words."""
    found = with_words(docs.select(F.col(text).alias("text")), "text", "words")
    own = F.array_distinct(F.array_compact(F.transform("words", lambda w: F.when(w.isin(*words), w))))
    found = found.select(F.array_append(own, F.lit("")).alias("w"))
    counts = {r[0]: r[1] for r in found.select(F.explode_outer("w").alias("w")).groupBy("w").count().collect()}
    return counts.get("", 0), {w: counts.get(w, 0) for w in words}


def build_index(total: int, df: dict[str, int], base=BASE_PHRASES, templates=TEMPLATES, rare: int = 6, votes: int = 3) -> Index:
    """rare: highest-IDF words that stand for a template; votes: how many places
    of them must agree on an offset (fewer only for a shorter template)."""
    idf = lambda w: math.log((total + 1) / (df.get(w, 0) + 1))

    def entry(label: str, text: str, must: tuple[str, ...], rare: int, votes: int) -> Entry:
        words = text.split()
        best = sorted(set(words), key=lambda w: (-idf(w), w))[:rare]
        postings = {w: [i for i, x in enumerate(words) if x == w] for w in best}
        keys = [tuple(m.split()) for m in must]
        places = [next(i for i in range(len(words)) if tuple(words[i : i + len(k)]) == k) for k in keys]
        return Entry(label, postings, min(votes, sum(map(len, postings.values()))), tuple(zip(places, keys, strict=True)))

    return Index(tuple(entry(label, text, (text,), 1, 1) for text, label in base.items()), tuple(entry(label, text, must, rare, votes) for label, (text, must) in templates.items()))


SHIFT, ZERO = 33, 1 << 32  # an entry and an offset in one BIGINT


def _tables(entries: tuple[Entry, ...], slots: int) -> Column:
    """The index as one constant: postings hashed into slots, and a rule per entry."""
    postings: list[list[dict]] = [[] for _ in range(slots)]
    for t, e in enumerate(entries):
        for w, at in e.postings.items():
            postings[xxhash.xxh64_intdigest(w.encode(), HASH_SEED) % slots] += [{"word": w, "code": (t << SHIFT) + ZERO - r} for r in at]
    rules = [{"label": e.label, "votes": e.votes, "must": [{"at": at, "words": list(words)} for at, words in e.must]} for e in entries]
    schema = "postings ARRAY<ARRAY<STRUCT<word: STRING, code: BIGINT>>>, rules ARRAY<STRUCT<label: STRING, votes: INT, must: ARRAY<STRUCT<at: INT, words: ARRAY<STRING>>>>>"
    return F.from_json(F.lit(json.dumps({"postings": postings, "rules": rules})), schema)


def scan(docs: DataFrame, index: Index, text: str = "text") -> DataFrame:
    """Adds n_words, n_base, first_word, last_word, base_labels, labels, score
    to every row (a clashing name of the input is replaced).

    The index is data, not columns: the plan is the same for any number of templates.
    """
    out = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    keep = [c for c in docs.columns if c.lower() not in out]
    entries, slots = (*index.base, *index.templates), 1 << len(index.words).bit_length()
    tables = _tables(entries, slots)
    postings, rules, end = tables["postings"], tables["rules"], F.lit(len(index.base) << SHIFT)
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), F.col(f"`{text}`").alias("text"))
    df = with_words(packed, "text", "words").select("row", "words")
    df = df.select("row", "words", F.array_compact(F.transform("words", lambda w, i: F.when(w.isin(*index.words), i))).alias("hits"))

    def looked_up(h: Column) -> Column:
        word = F.get("words", h)
        return F.transform(F.filter(F.get(postings, F.pmod(F.xxhash64(word), F.lit(slots)).cast("int")), lambda p: p["word"] == word), lambda p: p["code"] + h)

    rule = lambda c: F.get(rules, F.shiftright(c, SHIFT).cast("int"))
    offset = lambda c: (c.bitwiseAND(F.lit((1 << SHIFT) - 1)) - ZERO).cast("int")
    df = df.select("row", "words", F.sort_array(F.flatten(F.transform("hits", looked_up))).alias("all"))

    def voted(c: Column, i: Column) -> Column:
        """The first of a run that is long enough."""
        return F.coalesce(F.get("all", i - 1) != c, F.lit(True)) & F.coalesce(F.get("all", i + rule(c)["votes"] - 1) == c, F.lit(False))

    def verified(c: Column) -> Column:
        return F.forall(rule(c)["must"], lambda m: (offset(c) + m["at"] >= 0) & (F.slice("words", F.greatest(offset(c) + m["at"], F.lit(0)) + 1, F.size(m["words"])) == m["words"]))

    df = df.select("row", F.size("words").cast("bigint").alias("n_words"), F.filter(F.filter("all", voted), verified).alias("found"))
    df = df.select("row", "n_words", "found", F.transform(F.filter("found", lambda c: c < end), offset).alias("starts"))
    names = lambda codes: F.sort_array(F.array_distinct(F.transform(codes, lambda c: rule(c)["label"])))
    df = df.select("*", names(F.filter("found", lambda c: c < end)).alias("own"), names("found").alias("both"))
    return df.select(
        "row.*",
        "n_words",
        F.size("starts").cast("bigint").alias("n_base"),
        F.array_min("starts").cast("bigint").alias("first_word"),
        F.array_max("starts").cast("bigint").alias("last_word"),
        F.array_join("own", ",").alias("base_labels"),
        F.array_join("both", ",").alias("labels"),
        (1 - 1 / (1 + F.size("both")).cast("double")).alias("score"),
    )


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = build_index(*document_frequencies(docs, licence_words()))
    return scan(docs, index).drop("text")


QUERIES = {"op1_licenses": op1_licenses}


def _values(rows: list[tuple]) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else f"'{x}'" for x in r) + ")" for r in rows)


def _sql(rare: int = 6, votes: int = 3) -> str:
    """The scan as joins of (document, place, word) with the words of phrases and templates."""
    phrases = sorted({*BASE_PHRASES, *(m for _, must in TEMPLATES.values() for m in must)})
    musts = [(label, m, len(f" {text} "[: f" {text} ".index(f" {m} ")].split()), len(must)) for label, (text, must) in TEMPLATES.items() for m in must]
    return rf"""
WITH pw(phrase, i, word, n) AS ({_values([(p, i, w, len(p.split())) for p in phrases for i, w in enumerate(p.split())])}),
base(phrase, label) AS ({_values([*BASE_PHRASES.items()])}),
tw(label, i, word) AS ({_values([(label, i, w) for label, (text, _) in TEMPLATES.items() for i, w in enumerate(text.split())])}),
must(label, phrase, i, n) AS ({_values(musts)}),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
w AS (SELECT r, unnest(range(len(words))) AS i, unnest(words) AS word FROM d),
df AS (SELECT word, count(DISTINCT r) AS n FROM w GROUP BY word),
place AS (SELECT r, phrase, w.i - pw.i AS pos FROM w JOIN pw USING (word) GROUP BY r, phrase, w.i - pw.i HAVING count(*) = any_value(n)),
best AS (SELECT label, word FROM (SELECT DISTINCT label, word FROM tw) LEFT JOIN df USING (word) QUALIFY row_number() OVER (PARTITION BY label ORDER BY coalesce(n, 0), word) <= {rare}),
post AS (SELECT *, least({votes}, count(*) OVER (PARTITION BY label)) AS votes FROM tw SEMI JOIN best USING (label, word)),
voted AS (SELECT r, label, w.i - post.i AS pos FROM w JOIN post USING (word) GROUP BY r, label, w.i - post.i HAVING count(*) >= any_value(votes)),
own AS (SELECT r, v.label FROM voted AS v JOIN must USING (label) JOIN place AS p USING (r, phrase) WHERE p.pos = v.pos + must.i
  GROUP BY r, v.label, v.pos HAVING count(*) = any_value(n)),
hits AS (SELECT r, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM place JOIN base USING (phrase) GROUP BY r),
named AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, count(DISTINCT label) AS n FROM (SELECT r, label FROM own UNION ALL SELECT r, label FROM place JOIN base USING (phrase)) GROUP BY r)
SELECT doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, 1 - 1 / CAST(1 + coalesce(n, 0) AS DOUBLE) AS score FROM d LEFT JOIN hits USING (r) LEFT JOIN named USING (r)"""


ORACLE_SQL = {"op1_licenses": _sql()}
