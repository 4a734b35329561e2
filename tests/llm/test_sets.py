"""The Jaccard join, components and the pipeline against brute force."""

from __future__ import annotations

import collections
import random
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from attesta.llm import components, jaccard, mixing, packing, pii, quality
from attesta.llm.shingles import measured_sets, shingle_sets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_set(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute(rows):
    sets = {i: brute_set(t) for i, t in rows}
    parent, lists = {i: i for i in sets}, collections.defaultdict(list)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sorted(sets):
        for y, k in collections.Counter(y for t in sets[i] for y in lists[t]).items():
            if 100 * k >= 80 * (len(sets[i]) + len(sets[y]) - k) and root(i) != root(y):
                a, b = sorted((root(i), root(y)))
                parent[b] = a
        for t in sets[i]:
            lists[t].append(i)
    return {i: (len(s), root(i)) for i, s in sets.items()}


@pytest.fixture(scope="module")
def rows():
    rnd, out = random.Random(3), []
    words = [f"w{i}" for i in range(3000)]
    for _ in range(20):
        base = [rnd.choice(words) for _ in range(rnd.choice([3, 8, 40, 120, 400]))]
        for _ in range(rnd.choice([1, 2, 10, 40])):
            d = list(base)
            for _ in range(rnd.randint(0, max(1, len(d) // 18))):
                k = rnd.randrange(len(d))
                d[k] = rnd.choice(words) if rnd.random() < 0.7 else d[k].upper()
            if rnd.random() < 0.3:
                d += [rnd.choice(words) for _ in range(rnd.randint(0, len(d) // 5 + 1))]
            if rnd.random() < 0.3:
                d = [f"lic{i}" for i in range(60)] + d
            out.append((len(out) * 7, " ".join(d)))
    return [*out, (10**6, None), (10**6 + 1, ""), (10**6 + 2, " \n"), (10**6 + 3, "one"), (10**6 + 4, "ONE"), (10**6 + 5, "İstanbul ẞ"), (10**6 + 6, "i̇stanbul ß")]


@pytest.mark.parametrize("limits", [{}, {"UNIT_TOKENS": 2000, "SHORT": 3}])
def test_join(spark, rows, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(jaccard, name, value)
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, node int").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(df).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("bits", [4, 1])
def test_names_that_meet(spark, rows, bits):
    """Different sets that share their first name stay apart."""
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(df, bits).collect()} == brute(rows)


def test_token_in_every_text(spark):
    """A passage of all texts, among them linked ones, in lists that are split batch by batch."""
    rnd, rows = random.Random(11), []
    shared = " ".join(f"p{i}" for i in range(30))
    for i in range(1500):
        own = rows[-1][1].split(" ")[30:] if i % 5 == 4 else [f"w{rnd.randrange(10**6)}" for _ in range(rnd.choice([5, 9, 14, 40]))]
        rows.append((i, " ".join([shared, *own, *([f"t{i}"] if i % 10 == 9 else [])])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(df).collect()} == brute(rows)


def test_texts_without_ids_link(spark):
    a = " ".join(f"a{i}" for i in range(60))
    df = spark.createDataFrame([(1, a), (None, a + " b1 b2 b3"), (2, a + " b1 b2 b3 b4 b5 b6 b7 b8 b9 b10 b11")], "doc_id long, text string")
    assert {(r["doc_id"], r["component_id"]) for r in jaccard.join(df).collect()} == {(1, 1), (None, 1), (2, 1)} or brute([(1, a), (2, df.collect()[2]["text"])])[2][1] == 1


def test_columns_that_clash(spark):
    names = ["gone", "Nth", "id_taken", "copies_taken", "__gone", "__id", "found", "row"]
    df = spark.createDataFrame([(1, "a b c d e f", "s"), (2, "a b c d e f", "s"), (2, "x y", "s"), (None, None, None)], "doc_id long, text string, source string")
    for n in names:
        df = df.withColumn(n, F.lit(n))
    assert jaccard.deduplicate(df).columns == df.columns == mixing.apply(df).columns == pii.redact(df, ([], {})).columns == quality.keep(df, None).columns
    assert jaccard.deduplicate(df).count() == 3 and mixing.apply(df).count() > 0 and quality.keep(df, None).count() == 4


def test_join_edges(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (4, None), (None, None)], "doc_id long, text string")
    got = sorted(map(tuple, jaccard.join(df).collect()), key=str)
    assert got == sorted([(None, 2, 3), (3, 2, 3), (3, 2, 3), (4, 0, 4), (None, 0, None)], key=str)
    assert jaccard.join(df.limit(0)).count() == 0
    kept = jaccard.deduplicate(df.selectExpr("*", "1 as __x")).collect()
    assert sum(r["doc_id"] == 3 for r in kept) == 1 and sum(r["doc_id"] == 4 for r in kept) == 1


def test_shingles_do_not_depend_on_batches():
    texts = ["A b c d e f g", "", None, "x y", "a B c d e f g" + " z" * 50]
    assert [s.tolist() for s in shingle_sets(texts)] == [shingle_sets([t])[0].tolist() for t in texts]
    assert [len(s) for s in shingle_sets(texts)] == [len(brute_set(t)) for t in texts]


def test_components(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1200)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    assert got == {n: root(n) for n in parent}


def test_pipeline_stages(spark, tmp_path):
    """Every stage against a plain version of itself on its own input."""
    rnd = random.Random(5)
    words = [f"{a}{b}" for a in ("lo", "mi", "ta", "re") for b in ("na", "ve", "so", "du", "ki")]
    docs, labels = [], []
    for i in range(240):
        good = i % 4 != 3
        text = " ".join(rnd.choice(words) + rnd.choice(["", "", ",", "."]) for _ in range(80)) if good else " ".join(rnd.choice(words) + "###" for _ in range(80))
        if i % 20 == 1:
            text += " mail me@example.com"
        docs.append((i, docs[i - 1][1] if i % 40 == 2 else text, "en", f"s{i % 3}", len(text)))
        labels.append((i, int(good), 0))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    d, columns = str(tmp_path), ["doc_id", "text", "lang", "source", "n_chars"]
    current = spark.read.parquet(f"{d}/documents.parquet")
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r for r in current.collect()}
        out = stage(spark, current, d)
        out.write.parquet(f"{d}/out{n}")
        current = spark.read.parquet(f"{d}/out{n}")
        after = current.collect()
        if n < 4:
            assert current.columns == columns
        ids = {r["doc_id"] for r in after}
        if n == 0:
            assert ids == {i for i in range(240) if i % 4 != 3}
        elif n == 1:
            want = brute([(i, r["text"]) for i, r in before.items()])
            assert ids == {i for i, (_, c) in want.items() if c == i} and len(after) == len(ids)
        elif n == 2:
            plain = {i: re.sub(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "[EMAIL]", r["text"]) for i, r in before.items()}
            assert {r["doc_id"]: r["text"] for r in after} == plain and any(t != before[i]["text"] for i, t in plain.items()) and all(r["n_chars"] == len(r["text"]) for r in after)
        elif n == 3:
            taken = {r["doc_id"]: r for r in mixing.mix(spark.read.parquet(f"{d}/out2")).collect()}
            assert collections.Counter(r["doc_id"] for r in after) == collections.Counter({i: k for i, r in taken.items() if r["size"] and (k := int(r["taken"] / r["size"] + 0.5))})
        else:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(packing.tokenizer_path())
            rows_in = spark.read.parquet(f"{d}/out3").collect()
            tokens = {r["doc_id"]: [*tokenizer.encode(r["text"], add_special_tokens=False).ids, 1] for r in rows_in}
            want = collections.Counter({i: sum(r["doc_id"] == i for r in rows_in) * len(t) for i, t in tokens.items()})
            got = collections.Counter()
            for r in after:
                got[r["doc_id"]] += r["length"]
                part = tokens[r["doc_id"]][r["start"] : r["start"] + r["length"]]
                assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(part)}I", *part)) and r["doc_tokens"] == len(tokens[r["doc_id"]])
            assert got == want and sum(r["start"] == 0 for r in after) == len(rows_in)
    assert corpus_pipeline.run(spark, d).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert [f.__module__ for f in (quality.keep, jaccard.deduplicate, pii.redact, mixing.apply, packing.pack)]


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Nulls in every column, repeated rows, blank texts, further columns; then no rows at all."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, gone string, `a.b` int"
    rows = [(1, "one two three four five six", "en", "a", 27, "x", 1), (1, "one two three four five six", "en", "a", 27, "x", 1), (2, None, None, None, None, None, None), (3, "", "en", "a", 0, "", 0)]
    rows += [(None, "a text without an id, mail x@y.de", None, None, None, None, None), (4, "seven eight nine ten eleven", None, None, None, None, None), (5, " \n", "en", "b", 2, None, None)]
    for name, documents in (("some", rows), ("none", [])):
        d = f"{tmp_path}/{name}"
        spark.createDataFrame(documents, schema).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        current, columns = spark.read.parquet(f"{d}/documents.parquet"), schema.replace("`", "").replace(" long", "").replace(" string", "").replace(" int", "").split(", ")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            current = stage(spark, current, d)
            assert current.columns == columns
        assert {r["text"] for r in current.collect()} <= {"one two three four five six", "a text without an id, mail [EMAIL]", "seven eight nine ten eleven"}
        assert (corpus_pipeline.run(spark, d).count() > 0) == bool(documents)


def test_texts_that_share_common_words_are_no_candidates(spark):
    """Texts of their own that share a run of short words meet in no list: shingles of short words stand last."""
    r, short = random.Random(5), "of to in is it a".split()
    texts = [" ".join([f"ownword{i}number{j}" for j in range(20)] + r.choice([short, short[::-1], short[3:] + short[:3]])) for i in range(40)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(8)
    none = np.zeros(0, np.uint64)
    assert jaccard.candidate_edges(df, none, none, jaccard.Names()).count() == 0
    assert {row["component_id"] for row in jaccard.join(df).collect()} == set(range(40))


def test_measured_shingles():
    texts = ["A bb c d e ff g", "", None, "x yy", "à b  c\nd e", "of to in is it " * 40]
    for tokens, (same, sizes) in zip(shingle_sets(texts), measured_sets(texts), strict=True):
        assert tokens.tolist() == same.tolist() and len(sizes) == len(same)
    assert sorted(measured_sets(texts)[0][1].tolist()) == [6, 6, 7] and measured_sets(texts)[3][1].tolist() == [3] and measured_sets(texts)[4][1].tolist() == [6]
