"""Vector codes, prefix tokens and ranked search against plain versions, their SQL, and odd rows."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import queries, search, tokens, vectors

SF = "/root/testdata/sf0.001"
CLASHES = ("ids", "n", "term", "item", "rank", "score", "whole", "part", "answer", "steps", "__asked", "__label")


def rows_of(df, *columns):
    return sorted(tuple(str(r[c]) for c in columns) for r in df.collect())


@pytest.mark.parametrize("name", ["op8_payload", "op11_vector_codes", "op13_ranked_search"])
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert rows_of(queries.queries()[name](spark, SF), *columns) == sorted(tuple(map(str, r)) for r in found.fetchall())


# Vector codes.


@pytest.mark.parametrize(("dims", "bits"), [(1, 5), (2, 4), (3, 3), (4, 2), (6, 1)])
def test_hilbert_curve_visits_neighbours(dims, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    at = vectors.hilbert(grid, bits)
    assert sorted(at.tolist()) == list(range(len(grid)))
    assert set(np.abs(np.diff(grid[np.argsort(at)], axis=0)).sum(axis=1).tolist()) == {1}


@pytest.mark.parametrize("scale", [3, 1000, 10**6])
def test_shortlists_keep_every_nearest_entry(scale):
    rng = np.random.default_rng(scale)
    centres = rng.integers(-scale, scale, (40, 32))
    x = centres[rng.integers(0, 40, 3000)] + rng.integers(-scale // 3, scale // 3 + 1, (3000, 32))
    x[::3] = x[0]  # a hot vector
    chunk, books = vectors.pack(x), [x[:64, 2 * p : 2 * p + 2] for p in range(16)]
    for p, index, error, _, _ in vectors.assign(chunk, books):
        distance = ((x[:, None, 2 * p : 2 * p + 2] - books[p]) ** 2).sum(axis=2)
        assert (distance.argmin(axis=1) == index).all() and (distance.min(axis=1) == error).all()
    for p, _, _, counts, sums in vectors.assign(chunk, books, errors=False):
        index = ((x[:, None, 2 * p : 2 * p + 2] - books[p]) ** 2).sum(axis=2).argmin(axis=1)
        assert (np.bincount(index, minlength=64) == counts).all()
        assert all((x[index == e, 2 * p : 2 * p + 2].sum(axis=0) == sums[e]).all() for e in range(64))


def plain_codes(rows, parts=16, entries=64, rounds=2):
    """rows: (vec_id, label, vector) in the order of codebooks."""
    x = [[math.floor(256 * c) for c in v] for _, _, v in rows]
    d = len(x[0]) // parts
    books = [[v[p * d : (p + 1) * d] for v in x[:entries]] for p in range(parts)]
    off = lambda a, b: sum((i - j) ** 2 for i, j in zip(a, b, strict=True))

    def nearest(p, v):
        return min((off(v[p * d : (p + 1) * d], c), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        at = [[nearest(p, v)[1] for v in x] for p in range(parts)]
        for p in range(parts):
            for e in set(at[p]):
                mine = [v[p * d : (p + 1) * d] for v, k in zip(x, at[p], strict=True) if k == e]
                books[p][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    got = [[nearest(p, v) for p in range(parts)] for v in x]
    label = Counter()
    for (_, y, _), g in zip(rows, got, strict=True):
        label[y] += sum(e for e, _ in g)
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted((str(i), "".join(f"{k:02x}" for _, k in g), str(sum(e for e, _ in g)), str(label[y]), sha) for (i, y, _), g in zip(rows, got, strict=True))


def test_codes_against_a_loop_and_odd_rows(spark):
    rng = random.Random(3)
    good = [(i, rng.choice([None, 1, 2]), [rng.gauss(0, 0.3) for _ in range(32)]) for i in range(150)]
    good += [good[5], good[5], (None, None, [0.25] * 32), (None, 1, [-0.25] * 32)]
    bad = [(900, 1, None), (901, 1, [None] * 32), (902, 1, [float("nan")] + [0.0] * 31), (903, 1, [float("-inf")] * 32), (904, 1, []), (905, 1, [0.1] * 31), (906, 1, [0.1] * 48)]
    df = spark.createDataFrame([*bad, *good[::-1]], "vec_id long, label int, embedding array<double>").select("*", *[F.lit("x").alias(c) for c in CLASHES]).repartition(5)
    order = sorted(good, key=lambda r: (r[0] is None, r[0], r[2]))
    columns = ("vec_id", "code", "error", "label_error", "codebooks_sha256")
    got = rows_of(vectors.report(df), *columns)
    assert got == plain_codes(order)
    assert vectors.report(df.limit(0)).collect() == []
    few = df.filter("vec_id < 7")
    assert rows_of(vectors.report(few), *columns) == plain_codes([r for r in order if r[0] is not None and r[0] < 7])


def test_chunks_do_not_matter(spark, monkeypatch):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    whole = rows_of(vectors.report(df), "vec_id", "code", "error")
    monkeypatch.setattr(vectors, "CHUNK", 70)
    assert rows_of(vectors.report(df.repartition(3)), "vec_id", "code", "error") == whole


def test_too_large_components_are_an_error(spark):
    df = spark.createDataFrame([(1, 1, [1e30] * 16)], "vec_id long, label int, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        vectors.report(df)


# Prefix tokens.


@pytest.fixture(scope="module")
def vocabulary():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library(vocabulary):
    return pytest.importorskip("tokenizers").Tokenizer.from_file(vocabulary)


PIECES = ["'re", "'ll", "'ve", "'s", "'", "<|endoftext|>", "<|endo", "  ", "\n", "\n\n", " ", "\t", "　", "hello", " world", "don't", "1234", "é", "日本語", "\U0001f642", "!!", "...", "aaaaaaa", "՘", "࢏", "\U000107bb", "ing", "the", " the", "\x00", "\x1c", "\x85", "'r", "'l", " '", "xy", "Q", "\r\n"]


def test_every_prefix_against_the_library(vocabulary, library):
    with open(vocabulary, encoding="utf-8") as f:
        text = f.read()
    held, classes, rng = tokens.Vocabulary(text), tokens.library_classes(text), random.Random(7)
    for k in range(700):
        if k % 3:
            s = "".join(rng.choices(PIECES, k=rng.randint(1, 14)))
        else:
            s = "".join(chr(rng.choice([rng.randint(97, 122), rng.randint(97, 101), rng.randint(0, 0x2FF), rng.randint(0x2000, 0x20FF), rng.randint(0x1F600, 0x1F640)])) for _ in range(40))
        held.learn(s, classes)
        got = np.cumsum(np.frombuffer(held.text_steps(s), np.int16), dtype=np.int64).tolist()
        wanted = [len(e.ids) for e in library.encode_batch([s[:i] for i in range(1, len(s) + 1)], add_special_tokens=False)]
        assert got == wanted, repr(s)


def test_token_table_answers_and_odd_rows(spark, vocabulary, library, monkeypatch):
    monkeypatch.setattr(tokens, "PIECE_CHARS", 5000)
    run = "".join(random.Random(2).choices("abcdefg", k=60_000))
    texts = [None, "", " ", "hello world", "hello world", "a <|endoftext|> b", "x\x00y", "naïve café \U0001f642", run, "some words that go on, and on.\n" * 40_000]
    df = spark.createDataFrame([(None if k == 6 else k, t) for k, t in enumerate(texts)] + [(3, texts[3])], "doc_id long, text string").select("*", *[F.lit("x").alias(c) for c in CLASHES])
    table = tokens.prefix_table(df, vocabulary, (3, 512))
    wanted = sorted((str(None if k == 6 else k), str(len((t or "").encode())), str(len(library.encode(t or "", add_special_tokens=False).ids))) for k, t in [*enumerate(texts), (3, texts[3])])
    assert rows_of(table, "doc_id", "n_bytes", "n_tokens") == wanted
    for r in tokens.fitting(tokens.counted(table, 4).withColumnRenamed("answer", "of_four"), F.col("doc_id") * 2).collect():
        text = texts[6 if r["doc_id"] is None else r["doc_id"]] or ""
        count = lambda n: len(library.encode(text[:n], add_special_tokens=False).ids)  # noqa: B023, E731
        assert r["of_four"] == count(4)
        assert r["chars_3"] == max(n for n in range(min(len(text), 60) + 1) if count(n) <= 3)
        if r["doc_id"] is None:
            assert r["answer"] is None
        elif r["doc_id"] < 8:
            assert r["answer"] == max(n for n in range(len(text) + 1) if count(n) <= 2 * r["doc_id"])
        else:
            assert count(r["answer"]) <= 2 * r["doc_id"] < count(r["answer"] + 1)
    assert tokens.report(df.limit(0), vocabulary).collect() == []


def test_counts_of_documents_against_the_library(spark, library):
    got = {r["doc_id"]: r for r in queries.op12_prefix_tokens(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode(d["text"] or "", add_special_tokens=False).ids
        r = got[d["doc_id"]]
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((d["text"] or "").encode()), len(ids), len(ids) > 512)


# Ranked search.

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_search(docs, items, k=10):
    lower = lambda t: TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(i, Counter(lower(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_docs, total = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in sorted(set(items), key=str):
        found = []
        for i, c, n in held:
            m = 10 + 90 * n * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in dict.fromkeys(lower(text)) if t in c)
            if s > 0:
                found.append((-s, i is None, i))
        out += [(str(item), str(r), str(f[2]), str(-f[0])) for r, f in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("part_bytes", [1 << 20, 400])
def test_search_against_a_loop_and_odd_rows(spark, monkeypatch, part_bytes):
    monkeypatch.setattr(search, "BLOCK_BYTES", 3000)
    rng = random.Random(11)
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(3000)] + ["Ünïcö", "ÉA", "漢字"]
    docs = [(k, " ".join(rng.choices(words, k=rng.choice([1, 5, 40, 200])))) for k in range(400)]
    docs += [(400, None), (401, ""), (402, ".;!"), (403, docs[3][1]), (404, docs[3][1]), docs[3], (None, docs[3][1]), (405, "w1 " * 300_000 + "tail")]
    items = [(k, " ".join(rng.choices(words, k=rng.choice([1, 2, 7, 30])))) for k in range(25)]
    items += [items[0], (0, "w1, W1 w2"), (None, "w3 w1"), (90, None), (91, ""), (92, "nowhere"), (93, docs[3][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").select("*", *[F.lit("x").alias(c) for c in CLASHES]).repartition(7)
    queries_ = spark.createDataFrame(items, "item_id long, text string").select("*", *[F.lit("x").alias(c) for c in CLASHES])
    got = rows_of(search.search(df, queries_, part_bytes=part_bytes), "item_id", "rank", "doc_id", "score")
    assert got == plain_search(docs, [i for i in items if i[1] is not None])


def test_search_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert search.search(docs, items).collect() == []
    assert search.search(items.toDF("doc_id", "text"), items.limit(0)).collect() == []
    assert [tuple(r) for r in search.search(items.toDF("doc_id", "text"), items).collect()][0][:3] == (1, 1, 1)


def test_words_of_one_hash_are_told_apart():
    terms = search.Terms([b"alpha", b"beta", b"gamma"])
    terms.hashes[:] = terms.hashes[0]
    terms.alike = 3
    values = search.ALNUM[np.frombuffer(b"beta gamma delta alpha", np.uint8)]
    s, e = search.word_spans(values, np.array([0, len(values)]))
    real = search.hash_spans
    try:
        search.hash_spans = lambda v, a, b: np.full(len(a), terms.hashes[0])
        where, what = search._found(terms, values, s, e)
    finally:
        search.hash_spans = real
    assert sorted(zip(where.tolist(), what.tolist(), strict=True)) == [(0, 1), (1, 2), (3, 0)]


def test_pair_bounds_skip_what_term_maxima_do_not():
    """Two terms that no document holds together: the block's pair bound is that of the larger one."""
    of = {0: (np.array([0, 2]), np.array([50, 40])), 1: (np.array([1, 3]), np.array([45, 44]))}
    docs, score = search.search_block([(50, (0, 1))], of, 4, 60)
    assert not len(docs)
    docs, score = search.search_block([(50, (0, 1))], of, 4, 45)
    assert dict(zip(docs.tolist(), score.tolist(), strict=True)) == {0: 50, 1: 45}
