"""License scan, line dedup, mixing and sharding on small planted inputs."""

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import pytest

from combforge.llm import chat, licenses, lines, mixing, sharding

SCHEMA = "doc_id BIGINT, text STRING, source STRING, lang STRING, n_words STRING, size STRING, row STRING, `key` STRING"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "en", "x", "y", "z", "k") for r in rows], SCHEMA)


def test_licenses_against_brute_force(spark):
    texts = [
        "Licensed under the Apache License, Version 2.0.\nmore words. All Rights Reserved, all rights reserved",
        "CC BY-NC 4.0? Licensed under CC BY-NC 4.0. cc by",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License",
        "\x00licence Élan İK ccé by",
        "cc", "", None, "all rights all rights reserved", "word " * 20000 + "general public license",
    ]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(None, "cc by", None)]
    docs = frame(spark, rows)
    got = licenses.scan(docs, licenses.build_index(*licenses.document_frequencies(docs, licenses.licence_words()))).collect()
    assert len(got) == len(rows)
    for r in got:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text or ""))
        at = {p: [i for i in range(len(words)) if words[i : i + len(p.split())] == p.split()] for p in licenses.BASE_PHRASES}
        every = sorted(x for a in at.values() for x in a)
        assert (r.n_words, r.n_base) == (len(words), len(every))
        assert (r.first_word, r.last_word) == ((every[0], every[-1]) if every else (None, None))
        assert r.base_labels == ",".join(sorted({licenses.BASE_PHRASES[p] for p, a in at.items() if a}))
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
    labels = {r.doc_id: r.labels for r in got}
    assert labels[0] == "apache-2.0,reserved" and labels[1] == "cc-by,cc-by-nc-4.0" and labels[2] == "gpl,gpl-notice" and labels[6] == ""
    assert licenses.scan(docs.limit(0), licenses.build_index(0, {})).count() == 0


def test_lines(spark):
    long, hot = "This Line is long enough to count", "x" * 20
    texts = {0: f"{long}\nown\n  {long.lower()}\t", 1: long, 2: f"a\n{long}\n", 3: hot, 4: hot, 5: None, 6: "", 7: "É" * 20, 8: "é" * 20, 9: "É" * 20 + "\r", 10: "É" * 20}
    docs = frame(spark, [(k, v, "s") for k, v in texts.items()] + [(None, long, None), (0, texts[0], "again")])
    got = {(r.doc_id, r.source): (r.kept_text, r.n_lines, r.n_dropped) for r in lines.dedup_lines(docs).collect()}
    assert got[0, "s"] == got[0, "again"] == ("own", 3, 2)
    assert got[1, "s"] == ("", 1, 1) and got[2, "s"] == (texts[2], 3, 0) and got[None, None] == ("", 1, 1)
    assert got[3, "s"] == (hot, 1, 0) and got[5, "s"] == got[6, "s"] == ("", 1, 0)
    assert got[7, "s"] == ("", 1, 1) and got[8, "s"] == ("é" * 20, 1, 0) and got[10, "s"][2] == 0
    assert lines.dedup_lines(docs.limit(0)).count() == 0


def test_mixing(spark):
    rows = [(i, "w " * (1 + i % 37), f"s{i % 3}" if i % 2 else "hot") for i in range(3000)] + [(None, "a b", None), (7, None, "s1"), (8, "a b", "s2"), (8, "a b", "s2")]
    docs = frame(spark, rows)
    got = mixing.mix(docs, keep=["doc_id", "source"]).select("row.*", "size", "source_size", "target", "copies", "taken").collect()
    assert len(got) == len(rows) and got[0].copies is not None
    size, taken, target = Counter(), Counter(), {}
    for r in got:
        assert r.taken == r.size * r.copies <= 3 * r.size
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert sum(target.values()) == pytest.approx(sum(size.values()))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    left, capped = dict(weight), {}
    while True:
        level = (sum(size.values()) - sum(capped.values())) / sum(left.values())
        over = [s for s in left if level * left[s] > 3 * size[s]]
        if not over:
            break
        capped |= {s: 3 * size[s] for s in over}
        left = {s: w for s, w in left.items() if s not in over}
    for s in order:
        assert target[s] == pytest.approx(capped.get(s, level * weight[s]))
        assert abs(taken[s] - target[s]) <= 19
    assert all(r.source_size == size[r.source] for r in got)
    again = mixing.mix(docs.repartition(5), keep=["doc_id", "source"]).select("row.*", "copies", "size").collect()
    assert Counter((r.doc_id, r.source, r.size, r.copies) for r in again) == Counter((r.doc_id, r.source, r.size, r.copies) for r in got)
    assert mixing.mix(docs.limit(0)).count() == 0
    assert {r.taken for r in mixing.mix(frame(spark, [(1, None, "a"), (2, "", "b")])).collect()} == {0}


def test_sharding(spark):
    rows = [(i, str(i), "hot" if i % 3 else f"s{i % 7}") for i in range(5000)] + [(None, None, None), (3, "x", None), (3, "x", None)]
    got = sharding.interleave(frame(spark, rows)).select("row.*", "shard", "slot").collect()
    n = Counter(r.shard for r in got)
    assert len(got) == len(rows) and set(n) == set(range(24)) and max(n.values()) - min(n.values()) <= 1
    for s in n:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n[s]))
    hot = Counter(r.shard for r in got if r.source == "hot")
    assert max(hot.values()) - min(hot.values()) <= 2
    few = sharding.interleave(frame(spark, rows[:5])).collect()
    assert Counter(r.slot for r in few) == {0: 5} and len({r.shard for r in few}) == 5
    assert sharding.interleave(frame(spark, rows[:0] or [rows[0]]).limit(0)).count() == 0


def test_op10_columns(spark, tmp_path):
    frame(spark, [(1, "é", "a"), (2, None, "b")]).drop("size").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in sharding.op10_sharding(spark, str(tmp_path)).collect()}
    assert (got[1].size, got[1].text_crc32, got[2].size, got[2].text_crc32) == (10, zlib.crc32("é".encode()), 8, 0)


def test_op5_digest(spark, tmp_path):
    frame(spark, [(1, "a\nb", "a")]).write.parquet(str(tmp_path / "documents.parquet"))
    assert lines.op5_lines(spark, str(tmp_path)).first().kept_sha256 == hashlib.sha256(b"a\nb").hexdigest()


def test_the_mix_repeats_rows_as_often_as_decided(spark):
    rows = [(i % 40, f"s{i % 3}", "w " * (i % 7), 0) for i in range(90)] + [(None, None, "a b", 1)] * 5 + [(None, "s1", None, 1), (3, "s2", "q " * 300, 2)]
    df = spark.createDataFrame(rows, "doc_id BIGINT, source STRING, text STRING, size INT")
    out = mixing.repeated(df)
    assert out.columns == df.columns
    key = lambda r: (r.doc_id, r.source, len((r.text or "").split()))
    got, want = Counter(map(key, out.collect())), Counter()
    for r in mixing.mix(df).collect():
        want[key(r.row)] += r.copies
    assert got == +want
    assert mixing.repeated(df.limit(0)).count() == 0


@pytest.mark.parametrize("weight", [0.25, 0.5, 1.0])
def test_steps_of_the_mix_are_even(spark, weight):
    keys = spark.range(200_000).select((-mixing.F.log((mixing.unit_hash("t", mixing.F.col("id")) + 0.5) / float(2**52)) / weight).alias("key"))
    keys = keys.select(mixing.F.floor(mixing.F.log2("key") * mixing.CELLS).cast("int").alias("cell"), "key")
    steps = keys.join(mixing.even_steps(keys, 256), "cell").groupBy("step").agg(mixing.F.count("*").alias("n"), mixing.F.min("key").alias("a"), mixing.F.max("key").alias("z")).orderBy("step").collect()
    assert max(s.n for s in steps) <= 2 * 200_000 / 256 and all(x.z <= y.a for x, y in zip(steps, steps[1:]))


def test_order_of_the_shards_against_brute_force(spark):
    rows = [(i, str(i), None if i % 11 == 0 else f"s{i % 3 % 2}") for i in range(700)] + [(5, "5", "s0"), (5, "5", "s0"), (None, "n", "s1")]
    got = {}
    for r in sharding.interleave(frame(spark, rows), shards=7, steps=64).select("row.*", "shard", "slot").collect():
        got[r.shard, r.slot] = (r.doc_id, r.source)
    h = lambda i: int(hashlib.md5(f"{sharding.SEED}:{'' if i is None else i}".encode()).hexdigest()[:13], 16)
    none_first = lambda i: (i is not None, i or 0)
    placed = []
    for s in {r[2] for r in rows}:
        own = sorted((r[0] for r in rows if r[2] == s), key=lambda i: (h(i), none_first(i)))
        placed += [((2 * k + 1) / (2 * len(own)), s is None, s or "", h(i), none_first(i), (i, s)) for k, i in enumerate(own)]
    want = [p[-1] for p in sorted(placed, key=lambda p: p[:-1])]
    shards = [k * 7 // len(want) for k in range(len(want))]
    assert got == {(s, k - shards.index(s)): x for k, (s, x) in enumerate(zip(shards, want))}


def _equals_sql(spark, module, name, folder, source):
    """A query's rows are those of its SQL over one table."""
    got = module.QUERIES[name](spark, str(folder))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {source} AS SELECT * FROM '{folder}/{source}.parquet/*.parquet'")
    found = con.execute(module.ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(got.columns)
    want = Counter(map(str, found.fetchall()))
    assert Counter(str(tuple(r)) for r in got.select(*names).collect()) == want
    return want


def test_licenses_equal_their_sql(spark, tmp_path):
    texts = [None, "", "all rights reserved cc by", "CC BY cc by"]
    for label, (text, must) in licenses.TEMPLATES.items():
        words = text.split()
        texts += [text.upper(), "İK " + text.replace(" ", ", ") + " cc by", " ".join(words[len(words) // 2 :]), " ".join(words[2:]), *must, f"{text} {text}", " ".join(w for w in words if w != words[-2])]
    frame(spark, [(i, t, "s") for i, t in enumerate(texts)] + [(None, texts[4], None), (3, texts[3], "s")]).write.parquet(str(tmp_path / "documents.parquet"))
    _equals_sql(spark, licenses, "op1_licenses", tmp_path, "documents")
    named = {x for r in licenses.op1_licenses(spark, str(tmp_path)).collect() for x in r.labels.split(",")}
    assert named == {"", *licenses.TEMPLATES, *licenses.BASE_PHRASES.values()}


def test_hundreds_of_templates(spark):
    words = [f"w{i}" for i in range(900)]
    templates = {f"t{k}": (" ".join(words[(7 * k + 11 * i * (k + 1)) % 900] for i in range(12)), ()) for k in range(300)}
    templates = {k: (t, (" ".join(t.split()[3:7]),)) for k, (t, _) in templates.items()}
    docs = frame(spark, [(k, f"x {templates[f't{k}'][0]}. y", "s") for k in range(300)] + [(300, " ".join(words[::2]), "s")])
    index = licenses.build_index(*licenses.document_frequencies(docs, licenses.licence_words({}, templates)), templates=templates)
    got = {r.doc_id: set(r.labels.split(",")) for r in licenses.scan(docs, index).collect()}
    assert all(f"t{k}" in got[k] for k in range(300)) and sum(map(len, got.values())) < 600


def test_shards_equal_their_sql(spark, tmp_path):
    rows = [(i, None if i % 50 == 0 else "é€😀"[: i % 4] * (i % 9), None if i % 13 == 0 else f"s{i % 5 % 3}") for i in range(300)]
    frame(spark, [*rows, (7, "a", "s1"), (None, "n", "s2")]).drop("size").write.parquet(str(tmp_path / "documents.parquet"))
    _equals_sql(spark, sharding, "op10_sharding", tmp_path, "documents")


def test_chats_equal_their_sql(spark, tmp_path):
    texts = ["", None, "a\nb", "<|im_end|>\n", "<\\|", "<\\\\|x<||", "😀é", "\\n"]
    roles = ["assistant", "user", None, "a\\b\n<|", "system", "assistant"]
    rows = [(c if c < 9 else None, t, roles[(c + t * t) % 6], texts[(3 * c + t) % 8]) for c in range(10) for t in range(c + 1)]
    spark.createDataFrame(rows, "conv_id BIGINT, turn BIGINT, role STRING, text STRING").write.parquet(str(tmp_path / "conversations.parquet"))
    _equals_sql(spark, chat, "op3_chat", tmp_path, "conversations")
