"""The ten operators against brute force on small fixtures, and on nulls, ties, repeats and empty tables."""

import collections
import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from candor.llm import annsearch, bpe, eliasfano, licenses, lm, lookups, minhash, mixing, pii, quality, rangejoin, registry, sharedfiles, toxicity
from candor.llm.scratch import Scratch

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, class_id string, kept string, size string"
LONG = " ".join(f"w{i}" for i in range(30_000))
ODD = [
    (1, None, None, None, None), (2, "", "en", "", 0), (3, "one two three", "en", "a", 1), (3, "one two three", "en", "a", 1),
    (4, LONG, "en", "a", 1), (5, LONG + " more", "de", None, 1), (None, "no id here at all today", "fr", "b", 1), (None, None, None, None, None),
    (6, "mail a.b@c.org or 10.0.0.1, all rights reserved", "en", "b", 1), (7, "  \t\n ", "en", "b", 1), (8, "one two three", "en", "c", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in ODD], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def collected(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    got, want = registry.QUERIES[name](spark, SF), con.sql(registry.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(want.columns)
    assert collected(got, *columns) == sorted(want.select(*columns).fetchall(), key=repr)


def test_odd_rows_match_sql(spark, odd):
    con = duckdb.connect()
    documents = odd.toArrow()  # noqa: F841
    con.sql("create table documents as select * from documents")
    for df, sql in ((mixing.mix(odd), mixing.ORACLE), (licenses.scan(odd).drop("spans"), licenses.ORACLE)):
        columns = sorted(df.columns)
        assert collected(df, *columns) == sorted(con.sql(sql).select(*columns).fetchall(), key=repr)


def test_mix_comes_near_its_targets(docs):
    got = mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id").toPandas()
    assert (got.taken <= 3 * got["size"]).all() and (got.taken % got["size"].clip(lower=1) == 0).all()
    for _, g in got.groupby("source"):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= g["size"].max()
    assert got.groupby("source").target.first().sum() == pytest.approx(got["size"].sum())


def test_mix_splits_repeated_rows(spark, monkeypatch):
    rows = [(1, "x y z " * 5, "hot")] * 450 + [(i + 2000, "q w " * i, "hot") for i in range(50)] + [(i, "a b c " * (i % 7), "ab"[i % 2]) for i in range(100)]
    rows += [(3000, None, None)] * 3 + [(3001, "u v", None)] * 5
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    con = duckdb.connect()
    documents = df.toArrow()  # noqa: F841
    con.sql("create table documents as select * from documents")
    for bound in (lookups.BROADCAST_BYTES, 0):
        monkeypatch.setattr(lookups, "BROADCAST_BYTES", bound)
        got = mixing.mix(df)
        assert collected(got, *sorted(got.columns)) == sorted(con.sql(mixing.ORACLE).select(*sorted(got.columns)).fetchall(), key=repr)
    by = {r.target: r for r in got.groupBy("source_size", "target").agg(F.sum("taken").alias("taken"), F.max("size").alias("most")).collect()}
    assert all(abs(r.taken - t) <= r.most for t, r in by.items()) and len(by) == 4
    assert mixing.mixed_documents(df).count() == got.agg(F.sum("repeats")).first()[0]
    assert mixing.mix(df.limit(0)).count() == 0


def test_mix_reshares_what_capped_sources_leave(spark):
    sizes = [(f"s{i}", 10 ** (i % 5) * (i + 1)) for i in range(40)] + [(None, 7), ("", 5), ("empty", 0)]
    rows = mixing.targets(Scratch(spark, "t"), spark.createDataFrame(sizes, "source string, size bigint")).collect()
    names = sorted((n for n, _ in sizes if n is not None), key=lambda n: n.encode()) + [None]
    weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    size, total, capped = dict(sizes), sum(s for _, s in sizes), set()
    while True:
        level = (total - sum(3 * size[n] for n in capped)) / sum(w for n, w in weight.items() if n not in capped)
        over = {n for n in names if n not in capped and level * weight[n] > 3 * size[n]}
        if not over:
            break
        capped |= over
    for r in rows:
        assert r.target == pytest.approx(3 * size[r.source] if r.source in capped else level * weight[r.source], rel=1e-12)
    assert len(rows) == len(names) and sum(r.target for r in rows) == pytest.approx(total)


def test_mixed_documents_repeat_rows(odd):
    want = mixing.mix(odd).agg(F.sum("repeats")).first()[0]
    out = mixing.mixed_documents(odd)
    assert out.columns == odd.columns and out.count() == want


def test_licenses_tolerate_a_word_left_out_or_put_in(spark):
    notice = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"
    texts = [notice, notice.replace("hereby ", ""), notice.replace("charge", "any charge"), "permission is hereby", "CC-BY and Cc by", "Kind"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    assert [got[i].labels for i in range(6)] == ["mit", "mit", "mit", "", "cc-by", ""]
    assert (got[4].n_base, got[4].first_word, got[4].last_word) == (2, 0, 3)


def brute_email(text):
    return [(m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]


def test_pii_base_by_plain_patterns(docs):
    texts = [t or "" for (t,) in docs.select("text").collect()]
    texts += ["a@b.c@d.e x@y a@@b.c", "1.2.3.4.5.6 999.1.1.1 1.2.3.256 0001.2.3.004", "4111 1111 1111 1111-4111", "+1 (555) 123-4567 +12", "é4111111111111111", "a@" * 50]
    for t in texts:
        want = [("email", *s) for s in brute_email(t)]
        for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
            if all(int(x) <= 255 for x in m[0].split(".")):
                want.append(("ip", *m.span()))
        for kind, p, lo, hi in (("card", r"[0-9]([\x20-]?[0-9])+", 14, 19), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 10, 15)):
            for m in re.finditer(p, t):
                d = re.sub("[^0-9]", "", m[0])
                if lo <= len(d) <= hi and (kind != "card" or pii.luhn(d)):
                    want.append((kind, *m.span()))
        assert sorted(want) == sorted((pii.KINDS[k], i, j) for i, k, j in pii.plain_spans(t))


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("write john [at] example [dot] com now", "john [at] example [dot] com"),
        ("ask john at example dot com", "john at example dot com"),
        ("jоhn@exаmple.com", "jоhn@exаmple.com"),
        ("４１１１ １１１１ １１１１ １１１１", "４１１１ １１１１ １１１１ １１１１"),
        ("plus four nine one seven zero one two three four five six", "plus four nine one seven zero one two three four five six"),
        ("host 192 dot 168 dot 1 dot 20", "192 dot 168 dot 1 dot 20"),
        ("4O12 8888 8888 1881", "4O12 8888 8888 1881"),
    ],
)
def test_pii_disguises(text, found):
    base, every = pii.spans(text)
    assert not base and [text[i:j] for i, _, j in every] == [found]


@pytest.mark.parametrize(
    ("text", "out"),
    [
        ("call +1 415 five five five 2671 now", "call [PHONE] now"),
        ("call +1 415 555 26 one, please", "call [PHONE], please"),
        ("call +1 415-555-267-one", "call [PHONE]"),
        ("host 192.168.one.20 is up", "host [IP] is up"),
        ("host one.168.one.20 is up", "host [IP] is up"),
        ("host 192 dot 168 dot one dot 20 is up", "host [IP] is up"),
        ("host 192[.]168[.]one[.]20 is up", "host [IP] is up"),
        ("card 4111 1111 1111 11 one one ok", "card [CARD] ok"),
        ("call +49 170 1234567 eight nine", "call [PHONE]"),
        ("host 10.0.0.1 one day", "host [IP] one day"),
        ("call +1 415 555 2671 one day", "call [PHONE] one day"),
        ("one two three four@example.com", "one two three [EMAIL]"),
        ("in 2024 one of two, 3 or four", "in 2024 one of two, 3 or four"),
    ],
)
def test_pii_few_spelled_digits(text, out):
    assert pii.redact_text(text) == out


@pytest.mark.parametrize(
    ("text", "out"),
    [
        ("to jоhn@example.com now", "to [EMAIL] now"),
        ("to john@example.cоm now", "to [EMAIL] now"),
        ("to john@example.c\u200bom now", "to [EMAIL] now"),
        ("call +1415555267１ now", "call [PHONE] now"),
        ("call +49 170 1234567８ now", "call [PHONE] now"),
        ("to jоhn@example.com, ann@example.org", "to [EMAIL], [EMAIL]"),
    ],
)
def test_pii_disguised_ends_of_plain_fragments(text, out):
    base, every = pii.spans(text)
    assert set(base) <= set(every) and base == pii.plain_spans(text) and pii.redact_text(text) == out


@pytest.mark.parametrize("text", ["look at the site.com today", "he was at home", "one two three four five", "year 2024 at 10.30", "at noon. dot the i"])
def test_pii_leaves_clean_texts(text):
    assert pii.spans(text) == ([], []) and pii.redact_text(text) == text


def test_pii_rows(odd):
    got = pii.find_pii(odd).collect()
    assert len(got) == len(ODD)
    row = next(r for r in got if r.doc_id == 6)
    assert (row.n_email, row.n_ip, row.spans) == (1, 1, "email:5:14,ip:18:26")
    assert row.base_sha256 == hashlib.sha256(b"email:5:14,ip:18:26").hexdigest()
    assert pii.redacted(odd).filter("doc_id = 6").first().text.startswith("mail [EMAIL] or [IP],")


def test_bpe_equals_the_library(docs):
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(bpe.default_path()), bpe.load(bpe.default_path())
    rng = np.random.default_rng(5)
    odd = ["", "<|endoftext|> hi<|startoftext|>", "a" * 500, "ΣΑΣ İstanbul", "it's I'M", "１２½", "é 한국어 😀  x", "﻿x​y"]
    odd += ["".join(chr(c) for c in rng.choice([*range(32, 0x600), *range(0x2000, 0x2100), *range(0x1F600, 0x1F620)], 40)) for _ in range(300)]
    for t in [*odd, *(t for (t,) in docs.limit(60).select("text").collect())]:
        ids = library.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids and own.decode(ids) == library.decode(ids, skip_special_tokens=False)
        assert own.encoded(t)[1] == own.decode(ids)
    assert own._merge_long([own.byte_id[b] for b in b"thethethe" * 20]) == own._merge_short([own.byte_id[b] for b in b"thethethe" * 20])


def test_bpe_rows(odd):
    got = bpe.encode_documents(odd, with_ids=True).collect()
    assert len(got) == len(ODD) and all(r.n_tokens == len(r.ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest() for r in got)


def shingle_sets(texts):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        out.append(collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter())
    return out


def brute_similarity(a, b):
    both = [d for d in a if d in b]
    if not both:
        return 0.0
    plain = len(both) / len(a.keys() | b.keys())
    weighted = sum(1 / sum(max(a[i] / a[d], b[i] / b[d]) for i in a.keys() | b.keys()) for d in both)
    return max(plain, weighted)


def brute_classes(ids, sets):
    root = {i: i for i in ids}
    for x in range(len(ids)):
        for y in range(x):
            if ids[x] == ids[y] or brute_similarity(sets[x], sets[y]) >= 0.8:
                a, b = sorted((root[ids[x]], root[ids[y]]))
                root = {k: a if v == b else v for k, v in root.items()}
    return root


def test_near_duplicates_by_brute_force(spark):
    rng = np.random.default_rng(3)
    base = [[f"t{v}" for v in rng.integers(0, 400, 60)] for _ in range(12)]
    texts = []
    for b in base:
        for _ in range(12):
            w = list(b)
            for at in rng.integers(0, 60, rng.integers(0, 4)):
                w[at] = f"x{rng.integers(0, 9999)}"
            texts.append(" ".join(w))
    texts += ["same same same same same same same", "Same same same same same same", "a b", "A  b", "", None, "b a"]
    df = spark.createDataFrame([(i * 3 % 997, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    sets = shingle_sets(texts)
    want = brute_classes([i * 3 % 997 for i in range(len(texts))], sets)
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(df).collect()}
    assert got == want
    assert len(set(got.values())) == minhash.kept_documents(df).count()


def test_blockwise_comparison_finds_what_leaders_miss(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    words = [f"q{i}" for i in range(80)]
    texts = [" ".join(words[:k] + [f"z{k}"] + words[k:] + [f"y{j}" for j in range(k % 7 * 2)]) for k in range(0, 78)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want = brute_classes(list(range(len(texts))), shingle_sets(texts))
    assert {r.doc_id: r.class_id for r in minhash.near_duplicates(df).collect()} == want


def test_near_duplicates_of_texts_that_repeat_a_passage_differently(spark):
    texts = []
    for g in range(8):
        words = [f"g{g}w{i}" for i in range(100)]
        texts += [" ".join(words + words[:10] * times) for times in (0, 2, 20, 60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want = brute_classes(list(range(len(texts))), shingle_sets(texts))
    assert len(set(want.values())) == 8
    assert {r.doc_id: r.class_id for r in minhash.near_duplicates(df).collect()} == want
    assert minhash.kept_documents(df).count() == 8


def test_blockwise_comparison_sees_both_signatures(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    words = [f"q{i}" for i in range(80)]
    texts = [" ".join(words[:k] + [f"z{k}"] + words[k:] + [f"y{j}" for j in range(k % 7 * 2)] + words[:8] * (k % 4 * 12)) for k in range(0, 78, 2)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want = brute_classes(list(range(len(texts))), shingle_sets(texts))
    seen = []
    block = minhash._blockwise
    monkeypatch.setattr(minhash, "_blockwise", lambda *a: seen.append(1) or block(*a))
    assert {r.doc_id: r.class_id for r in minhash.near_duplicates(df).collect()} == want and seen


def test_near_duplicates_of_odd_rows(odd, spark):
    got = [tuple(r) for r in minhash.near_duplicates(odd).collect()]
    assert sorted(got, key=repr) == sorted(
        [(1, 1, True), (2, 2, True), (3, 3, True), (3, 3, True), (4, 4, True), (5, 4, False), (None, None, True), (None, None, True), (6, 6, True), (7, 7, True), (8, 3, False)],
        key=repr,
    )
    kept = minhash.kept_documents(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.filter("doc_id is not null").collect()) == [1, 2, 3, 4, 6, 7]
    assert minhash.near_duplicates(odd.limit(0)).count() == 0
    assert minhash.kept_documents(odd.limit(0)).count() == 0


def test_rows_that_only_share_an_id_stay(spark):
    words = [" ".join(f"t{k}w{i}" for i in range(40)) for k in range(5)]
    rows = [(7, words[0]), (7, words[1]), (7, words[0]), (12, words[1] + " more"), (-3, words[2]), (None, words[3]), (None, words[3]), (None, words[2]), (8, ""), (8, None), (9, "")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, key string")
    kept = sorted(((r.doc_id, (r.text or "")[:4]) for r in minhash.kept_documents(df).collect()), key=repr)
    assert kept == sorted([(7, "t0w0"), (7, "t1w0"), (-3, "t2w0"), (None, "t3w0"), (8, ""), (9, "")], key=repr)


def vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 8))
    x[100:200] = x[:100] + rng.normal(size=(100, 8)) * 0.3
    x[200:230] = x[0]
    rows = [(i, [float(v) for v in r], i % 3 if i < 200 else 0) for i, r in enumerate(x)]
    rows += [(300, None, 0), (301, [0.0] * 8, 0), (302, [float("nan")] + [1.0] * 7, 0), (303, [None] + [1.0] * 7, 0), (304, [1e200] * 8, 0), (305, [1.0] * 8, None), (None, [1.0] * 8, 0), (306, [1.0, 2.0], 0), (307, [2e200] * 8, 0)]
    return spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, embedding array<double>, label int, kept string")


def test_range_join_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(rangejoin, "CELL", 10)
    monkeypatch.setattr(rangejoin, "BLOCK", 16)
    monkeypatch.setattr(rangejoin, "STRIPE", 5)
    df = vectors(spark)
    rows = [r for r in df.collect() if r.vec_id is not None]
    good = {r.vec_id: r for r in rows if r.embedding and all(v is not None and math.isfinite(v) for v in r.embedding) and any(r.embedding) and r.label is not None}
    unit = {i: np.array(r.embedding) / max(np.abs(r.embedding)) for i, r in good.items()}
    unit = {i: v / np.sqrt(v @ v) for i, v in unit.items()}
    links = {i: [j for j in good if j != i and good[i].label == good[j].label and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.93] for i in good}
    got = {r.vec_id: r for r in rangejoin.range_join(df).collect()}
    assert len(got) == df.count()
    for r in rows:
        seen, todo = {r.vec_id}, [r.vec_id]
        while todo:
            new = set(links.get(todo.pop(), [])) - seen
            seen |= new
            todo += new
        g = got[r.vec_id]
        assert (g.n_links, g.component_id, g.kept) == (len(links.get(r.vec_id, [])), min(seen), min(seen) == r.vec_id), r.vec_id
    assert rangejoin.range_join(df.limit(0)).count() == 0


def test_search_ranks_exactly_and_recalls(spark, monkeypatch):
    df = vectors(spark)
    queries = df.filter("vec_id % 20 = 0")
    got = annsearch.search(df, queries, share=float(annsearch.TREES)).orderBy("query_id", "rank").collect()  # every entry
    rows = {r.vec_id: np.array(r.embedding) for r in df.collect() if r.vec_id is not None and r.vec_id < 300}
    rows |= {304: np.array([1e200] * 8), 305: np.ones(8), 307: np.array([2e200] * 8)}
    for q in range(0, 300, 20):
        want = sorted(((-(rows[v] @ rows[q]), v) for v in rows if v != q))[:20]
        mine = [r for r in got if r.query_id == q]
        assert [r.rank for r in mine] == list(range(1, 21))
        assert np.allclose([r.score for r in mine], [-s for s, _ in want], rtol=1e-9)
    assert annsearch.search(df.limit(0), queries).count() == 0
    monkeypatch.setattr(annsearch, "GROUP", 50)
    monkeypatch.setattr(annsearch, "QUERIES", 7)
    monkeypatch.setattr(annsearch, "LEAF", 32)
    assert recall(spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet"), 20) >= 0.9
    assert annsearch.search(df, df.limit(0)).count() == 0


def recall(vectors, every):
    """The share of the true 20 nearest that a search by default budget finds; every row it gives is checked."""
    rows = vectors.select("vec_id", "embedding").toPandas()
    found = annsearch.search(vectors, vectors.filter(f"vec_id % {every} = 0")).toPandas()
    x, ids = np.stack(rows.embedding).astype(np.float64), rows.vec_id.to_numpy()
    at = {v: i for i, v in enumerate(ids)}
    hits = asked = 0
    for q, mine in found.groupby("query_id"):
        score = x @ x[at[q]]
        mine = mine.sort_values("rank")
        assert list(mine["rank"]) == list(range(1, 21)) and q not in set(mine.vec_id) and mine.vec_id.is_unique
        assert np.allclose(mine.score, score[[at[v] for v in mine.vec_id]], rtol=1e-12) and list(mine.score) == sorted(mine.score, reverse=True)
        score[at[q]] = -np.inf
        hits += len(set(mine.vec_id) & set(ids[np.argsort(-score)[:20]]))
        asked += 1
    assert asked == (ids % every == 0).sum()
    return hits / asked / 20


@pytest.mark.parametrize("table", ["sf0.01", "sf0.1", "check_s"])
def test_search_recalls_with_the_default_budget(spark, table):
    vectors = spark.read.parquet(f"/root/testdata/{table}/embeddings.parquet").filter("embedding IS NOT NULL")
    assert annsearch._depth(vectors.count()) > 1
    assert recall(vectors, 20 if table == "sf0.01" else 100) >= 0.9


def test_trees_grow_with_the_table():
    assert [annsearch._depth(n) for n in (1, 500, 10_000, 1_000_000)] == [1, 2, 7, 12]
    first, cuts = annsearch._groups(np.array([[10, 200_000, 5, 60_000, 6_000]]))
    assert first.tolist() == [[0, 1, 5, 5, 6]] and cuts.tolist() == [[1, 4, 1, 1, 1]]


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, top in ((0, 5), (1, 0), (1, 10**12), (1000, 50), (5000, 10**6), (20000, 10**11), (300, 2**45)):
        v = np.sort(rng.integers(0, top + 1, n).astype(np.uint64))
        e = eliasfano.EliasFano(eliasfano.build(v))
        at = rng.permutation(n)
        assert (e.get(at) == v[at]).all()
        x = np.concatenate([v, rng.integers(0, top + 2, 500).astype(np.uint64)])
        assert (e.find(x) == np.searchsorted(v, x)).all()
        if n > 1:
            at = np.sort(rng.integers(0, n - 1, 400))
            first, second = e.ranges(at)
            assert (first == v[at]).all() and (second == v[at + 1]).all()
            d = eliasfano.EliasFano(eliasfano.build(np.unique(v)))
            lo = rng.integers(0, d.n, 400)
            hi = np.minimum(d.n, lo + rng.integers(0, 9, 400))
            x = np.where(rng.random(400) < 0.5, np.unique(v)[np.clip(lo + rng.integers(-1, 9, 400), 0, d.n - 1)], rng.integers(0, top + 1, 400).astype(np.uint64))
            want = [next((k for k in range(a, b) if np.unique(v)[k] == y), -1) for a, b, y in zip(lo, hi, x, strict=True)] if n <= 1000 else None
            assert want is None or d.find_between(x, lo, hi).tolist() == want


def test_elias_fano_reads_numbers_of_any_width():
    for n, top in ((3, 2**62), (5, 2**61 + 7), (40, 2**62)):
        v = np.sort(np.random.default_rng(n).integers(0, top, n).astype(np.uint64))
        e = eliasfano.EliasFano(eliasfano.build(v))
        assert (e.get(np.arange(n)) == v).all() and (e.find(v) == np.searchsorted(v, v)).all()


def followers(rng, sizes, vocabulary):
    """Of each parent its word ids, as a file of pointers and followers."""
    words = [np.sort(rng.choice(vocabulary, n, replace=False)) for n in sizes]
    base = np.concatenate([[0], np.cumsum([w[-1] if len(w) else 0 for w in words])])
    values = np.concatenate([w + b for w, b in zip(words, base, strict=False)]).astype(np.uint64)
    start = np.concatenate([[0], np.cumsum(sizes)]).astype(np.uint64)
    out = lm.Grams.__new__(lm.Grams)
    out.pointers, out.followers = (eliasfano.EliasFano(eliasfano.build(x)) for x in (start, values))
    return out, words


@pytest.mark.parametrize("sizes", [[0, 3, 1, 0, 900, 2, 4, 5, 0, 1] * 20, [1] * 500, [0, 0, 700, 0], [4] * 300])
def test_lm_places_in_short_and_long_ranges(sizes):
    rng = np.random.default_rng(7)
    grams, words = followers(rng, sizes, 1000)
    parents = np.sort(rng.integers(0, len(sizes), 20_000))
    wanted = rng.integers(0, 1000, len(parents))
    known = rng.random(len(parents)) < 0.5
    wanted[known] = [rng.choice(words[p]) if len(words[p]) else 0 for p in parents[known]]
    first = np.concatenate([[0], np.cumsum(sizes)])
    place = {(p, int(w)): int(first[p]) + i for p, ws in enumerate(words) for i, w in enumerate(ws)}
    assert grams.places(parents, wanted).tolist() == [place.get(key, -1) for key in zip(parents.tolist(), wanted.tolist(), strict=True)]


@pytest.mark.parametrize(("size", "most"), [(1, 2.2), (3, 2.6), (200, 2.3)])
def test_lm_selects_seldom(monkeypatch, size, most):
    """A look-up costs a selection for its parent's pointers, one for its base and, in long ranges, one for its run."""
    grams, words = followers(np.random.default_rng(8), [size] * 2000, 50_000)
    selected, select = [], eliasfano.EliasFano._select
    monkeypatch.setattr(eliasfano.EliasFano, "_select", lambda self, k, *more: selected.append(len(k)) or select(self, k, *more))
    parents = np.repeat(np.arange(2000), min(size, 4))
    assert (grams.places(parents, np.concatenate([w[: min(size, 4)] for w in words])) >= 0).all()
    assert sum(selected) <= most * len(parents)


def test_lm_tells_distinct_values_apart():
    rng = np.random.default_rng(9)
    near = np.uint64(2**64 - 4096) + rng.integers(0, 16, 5000).astype(np.uint64)  # alike but for bits that places take
    far = rng.integers(0, 2**63, 300).astype(np.uint64)[rng.integers(0, 300, 5000)] * np.uint64(2)
    for x in (near, far, np.sort(near), rng.integers(0, 50, 999), np.arange(9), np.zeros(0, np.int64), np.array([7])):
        value, at = lm._distinct(x)
        want, of = np.unique(x, return_inverse=True)
        assert value.dtype == x.dtype and value.tolist() == want.tolist() and at.tolist() == of.tolist()


def test_lm_tokens_of_texts_in_several_rounds(monkeypatch):
    texts = [b"", b"One two", b"two  ONE\tthree", b"x" * 50, b" "]
    whole, ends = lm._tokens(texts)
    monkeypatch.setattr(lm.tk.chunks, "__defaults__", (8,))
    assert len(list(lm.tk.chunks(texts))) > 2
    parts, same = lm._tokens(texts)
    assert parts.tolist() == whole.tolist() and same.tolist() == ends.tolist() == [0, 3, 7, 9, 10]
    assert [len(x) for x in lm._tokens([])] == [0, 0]


def brute_lm(texts, order, out):
    """(rows of score_documents by formula, tokens): n-grams in dictionaries, contexts no longer than the text so far."""
    count, after = collections.Counter(), collections.defaultdict(collections.Counter)

    def contexts(w):
        padded = [None, *w]
        for at in range(1, len(padded)):
            yield padded[at], [tuple(padded[at - k : at]) for k in range(1, order) if at >= k]

    for i, w in texts:
        if not out(i):
            count.update(w)
            for v, before in contexts(w):
                for u in before:
                    after[u][v] += 1
    n, size = sum(count.values()), len(count)
    off = {}
    for k in range(1, order):
        of = collections.Counter(c for u, m in after.items() if len(u) == k for c in m.values())
        y = of[1] / max(1, of[1] + 2 * of[2])
        d = [j - (j + 1) * y * of[j + 1] / max(1, of[j]) for j in (1, 2, 3)]
        off[k] = [min(max(x, 0.05 * j), 0.99 * j) for j, x in enumerate(d, 1)]
    want = []
    for i, w in texts:
        base = own = 0.0
        for v, before in contexts(w):
            p = (count[v] + 1) / (n + size + 1)
            base += math.log10(p)
            for u in before:
                if u in after:
                    m, d = after[u], off[len(u)]
                    total = sum(m.values())
                    p *= sum(d[min(c, 3) - 1] for c in m.values()) / total
                    p += (m[v] - d[min(m[v], 3) - 1]) / total if v in m else 0.0
            own += math.log10(p)
        want.append((i, out(i), len(w), sum(v in count for v in w), n, base, own))
    return want


@pytest.mark.parametrize(("order", "shard"), [(1, 5_000), (2, 5_000), (3, 5_000), (3, 500), (4, 2_000), (3, 2_000_000)])
def test_lm_by_brute_force(spark, docs, odd, monkeypatch, order, shard):
    monkeypatch.setattr(lm, "SHARD_TOKENS", shard)
    monkeypatch.setattr(lm, "BUFFER", 20_000)
    both = docs.select("doc_id", "text").unionByName(odd.select((F.col("doc_id") + 10**6).alias("doc_id"), "text"))
    # a context that dominates: its followers have to be cut into several pieces
    hot = [(2 * 10**6 + i, " ".join(f"hot f{i}x{j}" for j in range(100))) for i in range(60)]
    both = both.unionByName(spark.createDataFrame(hot, "doc_id bigint, text string"))
    low = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
    texts = [(i, [*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(low)), None]) for i, t in both.collect()]
    out = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 7 == 2
    want = brute_lm(texts, order, out)
    got = sorted((tuple(r) for r in lm.train_and_score(both, order=order).collect()), key=repr)
    for g, w in zip(got, sorted(want, key=repr), strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9) and abs(g[6] - w[6]) <= 0.05 * w[2]


def test_lm_of_nothing(docs):
    assert lm.train_and_score(docs.limit(0)).count() == 0
    nothing = lm.train(docs.limit(0))
    assert {r.n_known for r in lm.score_documents(docs.limit(5), nothing).collect()} == {0}


def test_lm_refuses_keys_beyond_64_bits(tmp_path):
    sharedfiles.write(str(tmp_path), "first-1", {"id": np.array([0, 1 << 40], np.int64)})
    sharedfiles.write(str(tmp_path), "cuts-2", {"piece": np.array([0, 4], np.int64)})
    with pytest.raises(ValueError, match="64 bits"):
        lm.keys_of(lm.Trie(str(tmp_path)), 2, np.array([1 << 30]), np.array([7]))


def halves(spark, sf):
    """(documents, labels of one half by text, labels of the other half): copies fall into one half."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    half = docs.select("doc_id", (F.crc32(F.coalesce("text", F.lit(""))) % 2).alias("half"))
    both = labels.join(half, "doc_id")
    return docs, *(both.filter(F.col("half") == h).drop("half") for h in (0, 1))


def test_quality_of_documents_it_was_not_fitted_on(spark, odd):
    docs, seen, unseen = halves(spark, "/root/testdata/sf0.01")
    got = quality.classify(docs, seen).join(unseen.select("doc_id", F.col("quality").alias("told")), "doc_id")
    n, good, kept, right = got.agg(F.count("*"), F.sum("told"), F.sum(F.when(F.col("kept"), F.col("told"))), F.sum(((F.col("kept").cast("int") == F.col("told")).cast("int")))).first()
    assert n > 100 and right >= 0.95 * n and kept >= 0.97 * good
    labels = seen.drop("text")
    assert quality.classify(odd, labels.limit(0)).filter("kept").count() == len(ODD)
    out = quality.kept_documents(odd, labels)
    assert out.columns == odd.columns and quality.kept_documents(odd.limit(0), labels).count() == 0
    assert quality.classify(odd.limit(0), labels).count() == 0


def test_quality_posteriors_by_brute_force(spark, docs, monkeypatch):
    """The hierarchy by loops over documents, from the evidence that the operator reports."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for bound in (lookups.BROADCAST_BYTES, 0):
        monkeypatch.setattr(lookups, "BROADCAST_BYTES", bound)
        rows = quality.classify(docs, labels).join(docs.select("doc_id", "source", "lang"), "doc_id").collect()
        p = [1 / (1 + math.exp(-r.evidence)) for r in rows]
        host, path = collections.defaultdict(list), collections.defaultdict(list)
        for r, x in zip(rows, p, strict=True):
            host[r.source].append(x)
            path[r.source, r.lang].append(x)
        n, mu = len(p), sum(p) / len(p)
        noise = max(sum(x * x for x in p) / n - mu * mu, 1e-6)
        between = sum(len(h) * (sum(h) / len(h) - mu) ** 2 for h in host.values()) / n - noise * (len(host) - 1) / n
        strength = min(max(noise / max(between, 1e-9), 1), 1e4)
        within = sum(len(v) * (sum(v) / len(v) - sum(host[k[0]]) / len(host[k[0]])) ** 2 for k, v in path.items()) / n - noise * (len(path) - len(host)) / n
        below = min(max(noise / max(within, 1e-9), 1), 1e4)
        for r, x in zip(rows, p, strict=True):
            above = (strength * mu + sum(host[r.source])) / (strength + len(host[r.source]))
            mine = path[r.source, r.lang]
            site = min(max((below * above + max(sum(mine) - x, 0)) / (below + len(mine) - 1), 1e-3), 1 - 1e-3)
            want = 1 / (1 + math.exp(-(r.evidence + math.log(site / (1 - site)))))
            assert r.site == pytest.approx(site, rel=1e-6) and r.quality == pytest.approx(want, rel=1e-6) and r.kept == (r.quality >= 0.5)


def test_training_rows_are_bounded(spark):
    docs = spark.createDataFrame([(1, f"copy {i}") for i in range(500)] + [(i, "x") for i in range(2, 40)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (1, 1), *((i, 1) for i in range(2, 40)), (None, 1)], "doc_id bigint, quality int")
    rows = quality.training_rows(docs, labels, ["quality"], 20, "doc_id", "text")
    assert rows.count() == 20
    rows = quality.training_rows(docs, labels, ["quality"], 100, "doc_id", "text").collect()
    assert len(rows) == 39 and ("copy 0", 0) in {tuple(r) for r in rows}


def test_sparse_sites_are_shrunk_to_the_prior(spark):
    rows = [("big", "p", 3.0)] * 200 + [("bad", "p", -3.0)] * 200 + [("one", "p", -3.0)]
    shares, mu = quality.site_shares(Scratch(spark, "t"), spark.createDataFrame(rows, "host string, path string, z double"), 0.5)
    above = {r.host: r.above for r in shares.collect()}
    assert above["bad"] < above["one"] < mu < above["big"]


def newton(x, y):
    """Weights and bias of the penalised fit, by scipy-free Newton steps on standardised columns with a line search."""
    mean, scale = x.mean(0), np.where(x.std(0) < 1e-9, 1.0, x.std(0))
    a = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    ridge = np.append(np.full(x.shape[1], 2.0), 1e-6)
    loss = lambda w: np.logaddexp(0, a @ w).sum() - y @ (a @ w) + (ridge * w * w).sum() / 2
    w = np.zeros(a.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -35, 35)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + np.diag(ridge + 1e-9), a.T @ (p - y) + ridge * w)
        t = 1.0
        while loss(w - t * step) > loss(w) and t > 1e-6:
            t /= 2
        w = w - t * step
    return a, w, mean, scale


def test_toxicity_links_by_an_independent_fit():
    """Each link is the penalised fit on the features and the out-of-fold log-odds of the links before it."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(600, 5))
    y = np.column_stack([x[:, 0] + rng.normal(size=600) > 0, x[:, 0] + x[:, 1] + rng.normal(size=600) > 0.5]).astype(float)
    fold = np.arange(600) % 4
    links, _ = toxicity.fit_links(x, y, fold)
    held, seen = np.zeros(600), x
    for c in range(2):
        _, w, mean, scale = newton(seen, y[:, c])
        assert np.allclose(links[c][0], w[:-1] / scale, atol=2e-3) and links[c][1] == pytest.approx(w[-1] - mean @ (w[:-1] / scale), abs=2e-3)
        for f in range(4):
            _, w, mean, scale = newton(seen[fold != f], y[fold != f, c])
            held[fold == f] = 1 / (1 + np.exp(-(((seen[fold == f] - mean) / scale) @ w[:-1] + w[-1])))
        seen = np.column_stack([x, np.log(np.clip(held, 1e-4, 1 - 1e-4) / (1 - np.clip(held, 1e-4, 1 - 1e-4)))])


def test_toxicity_of_documents_it_was_not_fitted_on(spark, odd):
    docs, seen, unseen = halves(spark, "/root/testdata/sf0.1")
    told = lambda df: df.select("doc_id", (1 - F.col("quality")).alias("low_quality"), F.col("toxic"))
    chain = toxicity.fit(docs, told(seen), ["low_quality", "toxic"])
    got = toxicity.classify(docs, chain).join(unseen.select("doc_id", F.col("toxic").alias("told")), "doc_id")
    both, true, said = (got.filter(c).count() for c in ("toxic AND told = 1", "told = 1", "toxic"))
    assert true > 30 and both >= 0.75 * true and both >= 0.75 * said
    none = toxicity.fit(odd, spark.createDataFrame([], "doc_id bigint, toxic int"), ["toxic"])
    assert toxicity.classify(odd, none).filter("NOT toxic").count() == len(ODD)
    assert toxicity.classify(odd.limit(0), chain).count() == 0


def test_toxicity_later_links_see_earlier_ones():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2000, 3))
    a = (x[:, 0] + x[:, 1] > 0).astype(float)
    b = np.where(rng.random(2000) < 0.1, 1 - a, a)
    links, cuts = toxicity.fit_links(x, np.column_stack([a, b]), np.arange(2000) % 4)
    assert len(links[1][0]) == 4 and links[1][0][3] > 0
    p = toxicity.Chain(["a", "b"], np.zeros(0, np.uint64), links, cuts).predict(x)
    assert ((p[:, 1] >= cuts[1]) == b).mean() > 0.8


def test_pipeline_by_its_stages(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = {r.doc_id for r in quality.classify(docs, labels).filter("kept").collect()}
    rows = sorted((r.doc_id, r.text, r.source) for r in docs.collect() if r.doc_id in good)
    root = brute_classes([i for i, _, _ in rows], shingle_sets([t for _, t, _ in rows]))
    rows = [(i, pii.redact_text(t), s) for i, t, s in rows if root[i] == i]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    own = bpe.load(bpe.default_path())
    times = {r.doc_id: r.repeats for r in mixing.mix(frame).collect()}
    want = sorted((i, hashlib.sha256(" ".join(map(str, own.encode(t))).encode()).hexdigest()) for i, t, _ in rows for _ in range(times[i]))
    want = sorted(want, key=repr)
    assert collected(corpus_pipeline.run(spark, SF), "doc_id", "ids_sha256") == want


def test_pipeline_of_odd_rows(spark, odd, tmp_path):
    """Nulls, empty and very long texts, repeated rows and clashing columns go through every stage; so does an empty table."""
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    ids = [r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert set(ids) <= {1, 2, 3, 4, 6, 7, None} and {4, 6} <= set(ids)
    odd.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_operators_of_empty_tables(odd):
    nothing = odd.limit(0)
    for df in (mixing.mix(nothing), mixing.mixed_documents(nothing), licenses.scan(nothing), pii.find_pii(nothing), pii.redacted(nothing), bpe.encode_documents(nothing)):
        assert df.count() == 0
