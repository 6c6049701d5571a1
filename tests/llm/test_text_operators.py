"""The text operators against brute force, exact round trips and held-out accuracy, with the odd cases each must take."""

import base64
import gzip
import hashlib
import random
import re
import urllib.parse
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import chat, decontaminate, langid, linededup, media, mixing, neardup, quality, secrets, toxicity
from tessera.llm.components import components
from tests_plain import brute_components, brute_hits, brute_lines, brute_longest, lower

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __score string, note array<int>"
WORDS = [f"w{i}" for i in range(400)]


def docs_of(spark, texts, first=0):
    """Documents with extra columns, one of which has a name that operators use themselves."""
    rows = [(None if t == "NULL ID" else i, "null id text one two three" if t == "NULL ID" else t, None if i % 7 == 0 else "en", None if i % 5 == 0 else "s", None, "x", [i]) for i, t in enumerate(texts, first)]
    return spark.createDataFrame(rows, SCHEMA)


def odd_texts():
    rng = random.Random(4)
    base = [" ".join(rng.choices(WORDS, k=60)) for _ in range(12)]
    near = [" ".join(w if rng.random() > 0.02 else "zz" for w in b.split()) for b in base for _ in range(6)]
    long_ = " ".join(rng.choices(WORDS, k=30_000))
    return [None, "", " \n\t", "one", "one", "One two", "ONE TWO", "a b c d", *base, *near, *base[:3], long_, long_ + " tail", "NULL ID", "NULL ID"]


def test_near_duplicates_against_all_pairs(spark):
    texts = odd_texts()
    df = docs_of(spark, texts)
    df = df.unionByName(df.filter("doc_id < 12"))  # repeated rows
    got = neardup.near_duplicates(df).collect()
    want, sets = brute_components([(i, t) for i, t in enumerate(texts) if t != "NULL ID"])
    assert len(got) == df.count()
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["component_id"], r["n_shingles"]) == (want[r["doc_id"]], len(next(iter(sets[r["doc_id"]]))))
            assert r["kept"] == (r["doc_id"] == want[r["doc_id"]])


def test_near_duplicates_where_buckets_hold_several_components(spark):
    """Edits that pile up: neighbours are linked, the ends of the chain are not, and links skip the bucket's least member."""
    rng = random.Random(9)
    words = rng.choices(WORDS, k=200)
    texts = []
    for _ in range(60):
        words = [w if rng.random() > 0.012 else f"n{rng.random()}" for w in words]
        texts.append(" ".join(words))
    order = list(range(60))
    rng.shuffle(order)
    df = spark.createDataFrame([(d, t) for d, t in zip(order, texts, strict=True)], "doc_id long, text string")
    want, _ = brute_components(list(zip(order, texts, strict=True)))
    assert {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(df).collect()} == want


@pytest.mark.parametrize("large", [2, 40])
def test_large_buckets_are_split_by_finer_bands(spark, monkeypatch, large):
    """Pages that share half of their words, and near copies among them: all links, by few comparisons."""
    monkeypatch.setattr(neardup, "LARGE_BUCKET", large)
    monkeypatch.setattr(neardup, "BUCKET_BLOCK", 16)
    rng = random.Random(21)
    template = rng.choices(WORDS, k=60)
    pages = [" ".join([*template, *rng.choices([f"u{i}" for i in range(5000)], k=45)]) for _ in range(60)]
    near = [" ".join(w if rng.random() > 0.03 else "zz" for w in p.split()) for p in pages[:20] for _ in range(2)]
    texts = [*pages, *near, *odd_texts()]
    df = docs_of(spark, texts)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(df).collect() if r["doc_id"] is not None}
    wanted, _ = brute_components([(r["doc_id"], r["text"] or "") for r in df.collect() if r["doc_id"] is not None])
    assert got == wanted


def test_blocks_of_a_bucket_meet_once(spark):
    rows = spark.range(100).select(F.lit(1).alias("key"), F.col("id").alias("node"), F.lit(100).alias("m"))
    p, q = neardup._blocks(rows, ("node",), 9)
    met = p.join(q, ["key", "cell"]).filter((F.col("node_p") < F.col("node_q")) & ((F.col("cell.lo") == F.col("cell.hi")) | (F.col("block_p") != F.col("block_q"))))
    assert met.count() == met.distinct().count() == 100 * 99 // 2
    assert p.groupBy("cell").count().agg(F.max("count")).first()[0] < 50


def test_marks_by_bitmap_and_by_join(spark):
    from tessera.llm.bitmap import among

    rows = spark.range(1000).withColumn("h", F.xxhash64("id"))
    keys = rows.filter("id % 10 = 0").select("h").unionByName(rows.filter("id = 0").select("h"))
    for most in (0, 1000):
        assert {r["id"] for r in among(rows, F.col("h"), keys, most).collect()} == set(range(0, 1000, 10))


@pytest.mark.parametrize("most", [0, 1000])
def test_marks_write_the_bitmap_alone(spark, monkeypatch, most):
    """No table of the hashes themselves is written before it."""
    from tessera.llm import bitmap

    written, write = [], bitmap.materialize
    monkeypatch.setattr(bitmap, "materialize", lambda df, label="t": written.append(label) or write(df, label))
    rows = spark.range(1000).withColumn("h", F.xxhash64("id"))
    keys = rows.filter("id % 10 = 0").select("h")
    found = bitmap.marked(rows, F.col("h"), keys.unionByName(keys), most)
    assert written == ["bitmap"]
    assert {(r["id"], r["__set"]) for r in found.collect()} == {(i, i % 10 == 0) for i in range(1000)}
    assert not bitmap.marked(rows, F.col("h"), keys.limit(0), most).filter("__set").count()


def test_overlap_makes_the_set_of_a_text_in_turn_once(monkeypatch):
    made, sets = [], neardup.shingle_sets
    monkeypatch.setattr(neardup, "shingle_sets", lambda data, offs: made.append(1) or sets(data, offs))
    one, two, three = (" ".join(f"w{i}" for i in range(a, a + 24)) for a in (0, 1, 10))
    batch = pa.RecordBatch.from_pydict({"a": [1, 2, 3, 4, 5], "b": [7, 7, 7, 8, 9], "text_a": [one, two, three, three, "x"], "text_b": [one, one, one, two, None]})
    out = pa.Table.from_batches(neardup._overlap([batch])).to_pydict()
    assert out == {"a": [1, 2, 3, 4, 5], "b": [7, 7, 7, 8, 9], "inter": [20, 19, 10, 11, 0], "union": [20, 21, 30, 29, 1]}
    assert len(made) == 7  # of ten


def test_near_duplicates_of_nothing(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_components_of_a_long_path(spark):
    ids = list(range(300))
    random.Random(1).shuffle(ids)
    edges = spark.createDataFrame(list(zip(ids[:-1], ids[1:], strict=True)), "a long, b long")
    got = components(edges).collect()
    assert len(got) == 300 and {r["component"] for r in got} == {0}


@pytest.mark.parametrize("part_bytes", [1 << 20, 300])
def test_decontamination_against_all_windows(spark, part_bytes):
    rng = random.Random(8)
    item = lambda n: " ".join(rng.choices(WORDS[:80], k=n))
    items = [(1, item(30)), (2, item(12)), (3, "w1 W2"), (4, None), (5, "..."), (10, item(10)), (11, item(25))]
    items += [(12, items[0][1]), (None, "w300 w301")]
    texts = [None, "", "w1", "w1, w2 - w1 w2w1", *(item(40) + " " + items[k][1] + "! " + item(5) for k in (0, 1, 5, 6)), " ".join(items[0][1].split()[3:20]), items[1][1].upper(), item(9000)]
    bench = spark.createDataFrame([(i, t, "extra") for i, t in items], "item_id long, text string, __words string")
    got = decontaminate.report(docs_of(spark, texts), bench, part_bytes).orderBy("doc_id").collect()
    want = brute_hits(texts, [(("" if i is None else i), t) for i, t in items])
    assert [(r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got] == want
    assert [(r["longest_match"], r["longest_start"]) for r in got] == brute_longest(texts, items)
    assert [sum(int(b) - int(a) for a, b in (x.split("-") for x in r["hit_spans"].split(",") if x)) for r in got] == [w[1] for w in want]
    kept = decontaminate.clean(docs_of(spark, texts), bench, part_bytes)
    assert kept.columns == [c for c in docs_of(spark, []).columns if c != "__score"] and sorted(r["doc_id"] for r in kept.collect()) == [i for i, w in enumerate(want) if not w[4]]


def test_decontamination_with_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r["contaminated"] for r in decontaminate.report(docs_of(spark, ["a b"]), none).collect()] == [False]
    assert decontaminate.report(docs_of(spark, []), none).collect() == []


def test_longest_match_goes_beyond_the_window(spark):
    bench = spark.createDataFrame([(1, " ".join(WORDS[:40]))], "item_id long, text string")
    r = decontaminate.report(docs_of(spark, ["x " + " ".join(WORDS[5:30]) + " y"]), bench).first()
    assert (r["n_hit"], r["longest_match"], r["longest_start"], r["hit_spans"]) == (25, 25, 1, "1-26")
    r = decontaminate.report(docs_of(spark, ["x " + " ".join(WORDS[5:12]) + " y"]), bench).first()
    assert (r["n_hit"], r["longest_match"], r["longest_start"], r["hit_spans"]) == (0, 7, 1, "")


def test_long_items_and_hot_short_items(spark):
    rng = random.Random(12)
    item = " ".join(rng.choices(WORDS, k=100_000))
    bench = spark.createDataFrame([(1, item), (2, "w7"), (2, "w8 w9"), *((k, "w7") for k in range(10, 60))], "item_id long, text string")
    part = item.split()[50_000:90_000]
    texts = ["w7 " * 50_000, " ".join(["zz", *part, "zz"])]
    got = decontaminate.report(docs_of(spark, texts), bench).orderBy("doc_id").collect()
    assert (got[0]["n_hit"], got[0]["n_items"]) == (50_000, 51)
    assert (got[1]["longest_match"], got[1]["longest_start"], got[1]["hit_spans"]) == (40_000, 1, "1-40001")


def test_suffix_array_against_sorting():
    import numpy as np

    rng = np.random.default_rng(1)
    for n, kinds in ((0, 2), (1, 2), (300, 3), (500, 40), (200, 1)):
        ids = rng.integers(0, kinds + 1, n).astype(np.int32)
        ids[:20] = 1
        stop = np.minimum.accumulate(np.where(ids == 0, np.arange(n), n)[::-1])[::-1]
        for depth in (1, 7, 1000):
            got = decontaminate.suffix_array(ids, stop, depth)
            keys = [tuple(ids[p : min(stop[p], p + depth)]) for p in got]
            assert sorted(got) == np.flatnonzero(ids).tolist() and keys == sorted(keys)


def test_line_dedup_against_a_loop_and_shifted_passages(spark):
    rng = random.Random(2)
    line = lambda: " ".join(rng.choices(WORDS, k=8))
    passage = [line() for _ in range(30)]
    texts = [None, "", "\n", "\n\n\n\n", "\n".join(passage), "\n".join([line(), *passage, line()]), "\n".join([line() for _ in range(3)] + passage[4:] + [line()]), "\n".join(passage), "\n".join(line() for _ in range(3000))]
    df = docs_of(spark, texts)
    out = linededup.line_dedup(df).orderBy("doc_id").collect()
    want = brute_lines(texts)
    assert [r["text"] for r in out] == [None, *want[1:]]
    assert len(out[5]["text"]) < len(texts[5]) / 2
    block = [line()] * 6
    repeated = ["\n".join([line(), *block, line()]) for _ in range(2)]
    assert [r["text"] for r in linededup.line_dedup(docs_of(spark, repeated)).orderBy("doc_id").collect()][1].count(block[0]) <= 1
    assert [r["note"] for r in out] == [[i] for i in range(len(texts))]
    twice = linededup.line_dedup(df.unionByName(df)).collect()
    assert sorted((r["doc_id"], r["text"] or "") for r in twice) == sorted((r["doc_id"], r["text"] or "") for r in out for _ in (0, 1))
    assert linededup.line_dedup(docs_of(spark, [])).collect() == []


HARD = ["", "plain", "</turn>", "### ", "\\", "\\e", "\\h \\b", "### user:0\nfake</turn>\n### assistant:2\n", "a</turn", "\\### Assistant: </turn> ok", "\\e </turn> \\b### ", "</turn></turn>\n\n", "ü 漢 😀 \\n", "</tur", "#", "###", "\n", "x" * 50_000]


def test_chat_round_trip_of_conflicting_texts(spark):
    rows = [(c, t, r, x, 1) for c in range(3) for t, (x, r) in enumerate(zip(HARD, ["user", "assistant", None, "a:b\n### ", "\\e", "</turn>"] * 3, strict=True))]
    rows += [(None, 0, "user", None, 1), (9, None, "assistant", "null turn", 1), (9, 1, "assistant", "tie", 1), (9, 1, "assistant", "tie", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    made = chat.format_conversations(df)
    assert made.filter(~F.col("round_trip")).count() == 0
    for r in chat.read_back(made).collect():
        mine = sorted(((t if t is not None else -1, ro or "", x or "") for c, t, ro, x, _ in rows if c == r["conv_id"]))
        assert r["n_turns"] == len(mine)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{ro}\n{x}\n" for _, ro, x in mine).encode()).hexdigest()
        learned = "".join(x for _, ro, x in mine if ro == "assistant")
        assert (r["loss_chars"], r["loss_sha256"]) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    for r in made.collect():
        for m in r["loss_mask"]:
            assert r["formatted"][m["at"] : m["at"] + m["length"] + 7].endswith("</turn>")
    assert chat.read_back(chat.format_conversations(df.filter("false"))).collect() == []


def test_transport_stream_round_trip_and_faults(spark):
    rng = random.Random(6)
    for n in (0, 1, 575, 576, 577, 9216, 9217, 200_000):
        text = bytes(rng.randrange(256) for _ in range(min(n, 999))) * (n // 999 + 1)
        payload = media.padded(text[:n])
        stream = media.mux(payload)
        s = media.demux(stream)
        assert len(stream) % 188 == 0 and s.payload == payload and s.programs == {1: 0x1000} and s.streams == {0x100: 6}
        assert (s.bad_counters, s.bad_tables, s.repeated, s.lost_sync) == (0, 0, 0, 0)
        assert [u[0] for u in s.units] == [k * 2304 * 90000 // 8000 for k in range(len(s.units))] and [u[1] for u in s.units] == [k % 4 == 0 for k in range(len(s.units))]
    packets = [stream[i : i + 188] for i in range(0, len(stream), 188)]
    assert media.demux(b"".join(packets[:50] + packets[51:])).bad_counters == 1
    assert media.demux(b"".join(packets[:51] + packets[50:])).repeated == 1
    assert media.demux(b"junk" + stream).payload == payload
    broken = bytearray(stream)
    broken[12] ^= 1
    assert media.demux(bytes(broken)).bad_tables == 1
    assert media.demux(b"").payload == b""
    texts = [None, "", "abc", "abc", "é" * 4000]
    rows = media.report(docs_of(spark, texts)).orderBy("doc_id").collect()
    for r, t in zip(rows, texts, strict=True):
        p = media.padded((t or "").encode())
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
    assert rows[2][1:] == rows[3][1:] and media.report(docs_of(spark, [])).collect() == []


SECRET = 'api_key = "abcdEFGH1234"'


def b64(s):
    return base64.b64encode(s.encode() if isinstance(s, str) else s).decode()


@pytest.mark.parametrize(
    "inner",
    [
        urllib.parse.quote(SECRET, safe=""),
        "".join(f"\\u{ord(c):04x}" for c in SECRET),
        b64("look here: " + SECRET),
        b64(gzip.compress(SECRET.encode())),
        zlib.compress(SECRET.encode()).hex(),
        b64(b64(urllib.parse.quote(SECRET, safe=""))),
        b64("x " + "".join(f"\\u{ord(c):04x}" for c in SECRET)),
    ],
)
def test_secrets_in_layers(inner):
    text = f"before {inner} after"
    base, spans, layers = secrets.scan(text)
    hits = [s for s in spans if s[0] == "assign"]
    assert layers >= 1 and not any(s[0] == "assign" for s in base) and len(hits) >= 1
    assert all(7 <= s < e <= 7 + len(inner) for _, s, e in hits)


NOISE = bytes(range(128, 256)) + b"\x00\x01"


@pytest.mark.parametrize(
    "inner",
    [
        "password\\u003dabcdef123456",
        "pass\\u0077ord=abcdef123456",
        'password%3D"abcdef123456"',
        b64("token=abcdefgh"),
        *(glue + b64("here: " + SECRET) for glue in ("x", "xy", "xyz", "key_", "ab/")),
        "key_" + b64(gzip.compress(SECRET.encode())),
        base64.encodebytes(b"long text before it " * 5 + SECRET.encode() + b" and more of it after" * 5).decode().strip(),
        b64("\x01 " + SECRET),
        b64(NOISE + SECRET.encode() + NOISE),
        b64(gzip.compress(b"first member") + gzip.compress(SECRET.encode())),
        b64(gzip.compress(gzip.compress(SECRET.encode()))),
        b64(gzip.compress(NOISE + SECRET.encode())),
        zlib.compress(b"token=abcdefgh").hex(),
    ],
)
def test_secrets_in_odd_layers(inner):
    base, spans, layers = secrets.scan(f"before {inner} after")
    hits = [s for s in spans if s[0] == "assign"]
    assert layers >= 1 and not any(s[0] == "assign" for s in base) and hits
    assert all(7 <= s < e <= 7 + len(inner) for _, s, e in hits)


def test_secrets_in_big_packed_data(monkeypatch):
    monkeypatch.setattr(secrets, "LAYER_CHARS", 4000)
    monkeypatch.setattr(secrets, "OVERLAP", 1000)
    for before in range(2900, 3100, 7):
        packed = b64(gzip.compress(b"." * before + SECRET.encode() + b"." * 9000))
        assert any(s[0] == "assign" for s in secrets.scan(packed)[1])


def brute_base(text):
    assign = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    found = [("assign", m.start(), m.end()) for m in assign.finditer(text) if len(m[2]) >= 8]
    found += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 16]
    found += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if m.end() - m.start() >= 32]
    return sorted(found, key=lambda x: (x[1], secrets.KINDS.index(x[0]), x[2]))


def test_base_secrets_against_the_plain_patterns(spark):
    rng = random.Random(11)
    bits = ["password", "Passwd", "SECRET", "token", "api_key", "apikey", "passſword", "toKen", "=", " = ", ":", "'", '"', "abcd", "a/b.c-d_e", "AKIA", "ABCDEFGH1234", "0123456789abcdef", "deadbeef", " ", "\n", "é", "secret", "%41", "😀"]
    texts = ["".join(rng.choices(bits, k=rng.randrange(1, 40))) for _ in range(400)]
    texts += [None, "", 'token=secret = "abcdefghijk"', "AKIAAKIAAKIAAKIA", "f" * 100_000]
    for t in texts:
        base, spans, _ = secrets.scan(t or "")
        assert base == brute_base(t or "") and set(base) <= set(spans)
    rows = secrets.report(docs_of(spark, texts[-5:])).orderBy("doc_id").collect()
    for r, t in zip(rows, texts[-5:], strict=True):
        want = brute_base(t or "")
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in want).encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(w[0] == k for w in want) for k in secrets.KINDS)
    assert secrets.report(docs_of(spark, [])).collect() == []


def test_viterbi_against_a_loop():
    import numpy as np

    rng = np.random.default_rng(3)
    first = np.array([0, 0, 7, 8, 30])
    score = rng.normal(size=(30, 3)).astype(np.float32)
    got = langid.viterbi(score, first, 1.5)
    for a, b in zip(first[:-1], first[1:], strict=True):
        best = {k: (score[a, k], [k]) for k in range(3)} if b > a else {}
        for t in range(a + 1, b):
            best = {k: max(((s - (1.5 if j != k else 0) + score[t, k], [*path, k]) for j, (s, path) in best.items()), key=lambda x: x[0]) for k in range(3)}
        if b > a:
            value = lambda path: sum(score[a + i, k] for i, k in enumerate(path)) - 1.5 * sum(x != y for x, y in zip(path, path[1:], strict=False))
            assert value(got[a:b].tolist()) == pytest.approx(max(s for s, _ in best.values()), abs=1e-4)


def test_viterbi_with_many_labels():
    import numpy as np

    score = np.zeros((20, 200), np.float32)
    score[:10, 199] = score[10:, 150] = 9
    assert langid.viterbi(score, np.array([0, 20]), 3.0).tolist() == [199] * 10 + [150] * 10


@pytest.mark.parametrize("labels", [2, 5])
def test_shortcuts_of_viterbi_change_nothing(monkeypatch, labels):
    import numpy as np

    rng = np.random.default_rng(labels)
    size = rng.integers(0, 60, 200)
    size[:3] = 500, 0, 777
    first = np.concatenate([[0], np.cumsum(size)])
    score = rng.normal(size=(first[-1], labels)).astype(np.float32) - np.float32(1e4) * (rng.random((first[-1], labels)) < 0.01)
    score[:, 0] += np.repeat(rng.random(len(size)) * 3, size)
    value = lambda a, b, path: score[np.arange(a, b), path].astype(float).sum() - 4.0 * (np.diff(path) != 0).sum()
    plain = langid.lattice(score, first, 4.0)
    whole = langid.settled(score, first, 4.0)
    assert 0 < (whole >= 0).sum() < len(whole)
    for long_ in (20_000, 30):
        monkeypatch.setattr(langid, "LONG", long_)
        got = langid.viterbi(score, first, 4.0)
        for a, b in zip(first[:-1], first[1:], strict=True):
            assert value(a, b, got[a:b]) == pytest.approx(value(a, b, plain[a:b]), abs=1e-3)


def test_word_scores_against_counted_trigrams(spark):
    """Scores of words from a dictionary of trigrams, the word before and after it as a blank."""
    import math

    import numpy as np

    texts = {"aa": "abra kadabra bara ab", "bb": "zulu lulu zuzu b"}
    docs = spark.createDataFrame([(k, t, la) for k, (la, t) in enumerate(texts.items())], "doc_id long, text string, lang string")
    model = langid.train(docs)

    def trigrams(word):
        b = [0, 0, *(x + 1 for x in word.encode()), 0]
        m = 0xFFFFFFFF
        return [((((x * 31337 + y) * 40503 + z) & m) * 0x9E3779B1 & m) >> 16 for x, y, z in zip(b, b[1:], b[2:], strict=False)]

    counts = {la: [g for w in t.split() for g in trigrams(w)] for la, t in texts.items()}
    for word in ("abra", "zuzu", "kazu"):
        raw = np.frombuffer(word.encode(), np.uint8)
        s, e, inside, closing, _ = langid.word_tables(langid.ALNUM[raw], np.array([0, len(raw)]), raw, model.ranges)
        assert [*inside, *closing] == trigrams(word)
        for k, la in enumerate(model.names):
            plain = sum(math.log((counts[la].count(g) + 0.02) / (len(counts[la]) + 0.02 * 65536)) for g in trigrams(word))
            assert model.scores[[*inside, *closing], k].sum() == pytest.approx(plain, rel=1e-4)


def test_scripts_of_words():
    import numpy as np

    ranges = langid.script_ranges()
    words = ["Việt", "naïve", "שלום", "سلام", "मेरा", "日本", "ひらがな", "한국", "Привет", "—", "12", "ეს", "µm", "ＡＢ", "𝒳", "日本の"]
    text = " ".join(words)
    raw = np.frombuffer(text.encode(), np.uint8)
    s, e = langid.word_spans(langid.ALNUM[raw], np.array([0, len(raw)]))
    got = [ranges[2][k] for k in langid.word_scripts(raw, s, e, ranges)]
    assert got == ["LATIN", "LATIN", "HEBREW", "ARABIC", "DEVANAGARI", "CJK", "HIRAGANA", "HANGUL", "CYRILLIC", "", "", "GEORGIAN", "LATIN", "LATIN", "MATHEMATICAL", "CJK"]


def test_long_text_of_two_languages(spark):
    import time

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(docs.select("doc_id", "text", "lang"))
    en, de = (docs.filter(f"lang = '{x}' and n_chars > 400").first()["text"] for x in ("en", "de"))
    text = "\n".join([*[en] * (5_000_000 // len(en)), *[de] * (5_000_000 // len(de))])
    start = time.time()
    r = langid.identify(docs_of(spark, [text]), model).first()
    assert time.time() - start < 30 and [x["lang"] for x in r["spans"]] == ["en", "de"]


def test_two_hundred_languages(spark):
    name = lambda k: f"l{k:03d}"
    rows = [(k, " ".join(f"{chr(97 + k // 26)}{chr(97 + k % 26)}{c}{chr(97 + k % 26)}" for c in "abcdefgh"), name(k)) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["lang_pred"], [x["lang"] for x in r["spans"]]) for r in langid.identify(docs, langid.train(docs)).collect()}
    assert got == {k: (name(k), [name(k)]) for k in range(200)}


def test_language_held_out_and_odd_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = langid.predictions(docs).join(docs.select("doc_id", "lang"), "doc_id")
    held = out.filter("held_out")
    assert held.count() > 20 and held.filter("lang = lang_pred").count() >= 0.97 * held.count()
    model = langid.train(docs.select("doc_id", "text", "lang"))
    en, de = (docs.filter(f"lang = '{x}' and n_chars > 400").first()["text"][:300] for x in ("en", "de"))
    rows = langid.identify(docs_of(spark, [None, "", "12 34 --", "× ÷", "漢字", f"{en} {de}", "the"]), model).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in rows[:4]] == ["und"] * 4 and rows[4]["lang_pred"] != "und" and rows[0]["score"] == 0
    assert {s["lang"] for s in rows[5]["spans"]} == {"en", "de"}
    assert langid.predictions(docs_of(spark, [])).collect() == []
    assert {r["lang_pred"] for r in langid.predictions(docs_of(spark, ["a b", "c d"]).withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_quality_held_out_and_odd_texts(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.predictions(docs, labels)
    held = got.filter("held_out").join(labels, "doc_id")
    assert held.filter("quality = predicted").count() >= 0.95 * held.count()
    weights = quality.train(quality.labelled(docs, labels, "quality", quality.fold(5) != 0))
    odd = quality.scored(docs_of(spark, [None, "", " ", "NULL ID", "x" * 100_000]), weights).collect()
    assert len(odd) == 5 and all(0 <= r["__score"] <= 1 for r in odd)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality.predictions(docs_of(spark, ["a", None]), none).collect()} == {0.5}
    assert quality.predictions(docs_of(spark, []), none).collect() == []


def test_toxicity_held_out_and_order_of_grades(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.train(toxicity.labelled(docs, labels, "toxic", toxicity.fold(5) != 0))
    held = toxicity.severities(docs.select("doc_id", "text").filter(toxicity.fold(5) == 0), model).join(labels, "doc_id")
    bad, good = held.filter("toxic = 1"), held.filter("toxic = 0")
    assert bad.filter("__grade > 0").count() >= 0.85 * bad.count() and good.filter("__grade > 0").count() <= 0.01 * good.count()
    assert list(model.thresholds) == sorted(model.thresholds) and (model.weights >= 0).all()
    rows = toxicity.severities(docs_of(spark, [None, "", "fine words", "idiot clown trash scum moron"]), model).orderBy("doc_id").collect()
    assert rows[0]["__severity"] == rows[1]["__severity"] <= rows[2]["__severity"] < rows[3]["__severity"] <= 3
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["grade"] for r in toxicity.predictions(docs_of(spark, ["a", None]), none).collect()} == {0}


def test_quality_training_against_a_plain_loop(spark):
    import numpy as np

    rng = random.Random(3)
    texts = [" ".join(rng.choices(WORDS[:30] if k % 2 else WORDS[20:50], k=12)) for k in range(50)]
    df = spark.createDataFrame([(k, t, k % 2) for k, t in enumerate(texts)], "doc_id long, text string, y int")
    got = quality.train(df)

    data = "".join(texts).encode()
    offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    row, at, x = quality.vectors(np.frombuffer(data, np.uint8), offs)
    z, n, bias = {}, {}, 1 << quality.BITS
    alpha, beta, l1, l2 = 4.0, 1.0, 0.01, 0.02

    def weight(i):
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        return -(z[i] - np.sign(z[i]) * l1) / ((beta + n[i] ** 0.5) / alpha + l2)

    order = np.random.default_rng(6)
    for _ in range(-(-quality.UPDATES // 50)):
        for k in order.permutation(50):
            mine = [*((int(i), float(np.float32(v))) for i, v in zip(at[row == k], x[row == k], strict=True)), (bias, 1.0)]
            w = {i: weight(i) for i, _ in mine}
            p = 1 / (1 + np.exp(-sum(w[i] * v for i, v in mine)))
            for i, v in mine:
                g = (p - k % 2) * v
                z[i] = z.get(i, 0.0) + g - ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / alpha * w[i]
                n[i] = n.get(i, 0.0) + g * g
    assert all(got[i] == pytest.approx(weight(i), abs=1e-3) for i in z) and set(np.flatnonzero(got)) <= set(z)
    scores = [r["__score"] for r in quality.scored(df.select("doc_id", "text"), got).orderBy("doc_id").collect()]
    assert all((s > 0.5) == bool(k % 2) for k, s in enumerate(scores))


def test_training_is_bounded_in_bytes(spark, monkeypatch):
    from tessera.llm import linear

    df = spark.createDataFrame([(k, "a b c d " * 100, k % 2) for k in range(200)] + [(1000, "x " * 100_000, 1)], "doc_id long, text string, y int")
    seen = lambda data, offs, y: {"n": [len(y)], "size": [int(offs[-1] - offs[0])]}
    out = linear.fit_in_task(df, seen, "n long, size long", 40_000).iloc[0]
    assert 10 <= out["n"] < 100 and out["size"] <= 80_000
    assert linear.fit_in_task(df, seen, "n long, size long").iloc[0]["n"] == 201


def test_cumulative_link_likelihood_and_its_slopes():
    import numpy as np

    rng = np.random.default_rng(4)
    dot, theta = rng.normal(size=40), np.array([-0.5, 0.3, 1.1])
    lo = rng.integers(0, 4, 40)
    hi = np.maximum(lo, rng.integers(0, 4, 40))
    weight = rng.random(40)
    value, by_dot, by_theta = toxicity.likelihood(dot, theta, lo, hi, weight)
    p = lambda k, d, th: 1.0 if k == 0 else 0.0 if k == 4 else 1 / (1 + np.exp(th[k - 1] - d))
    plain = lambda d, th: sum(w * np.log(p(a, x, th) - p(b + 1, x, th)) for x, a, b, w in zip(d, lo, hi, weight, strict=True))
    assert value == pytest.approx(plain(dot, theta))
    for k in range(3):
        step = np.eye(3)[k] * 1e-6
        assert by_theta[k] == pytest.approx((plain(dot, theta + step) - plain(dot, theta - step)) / 2e-6, abs=1e-5)
    for k in range(0, 40, 7):
        step = np.eye(40)[k] * 1e-6
        assert by_dot[k] == pytest.approx((plain(dot + step, theta) - plain(dot - step, theta)) / 2e-6, abs=1e-5)


def test_graded_labels_give_their_grades_back(spark):
    rng = random.Random(2)
    steps = [[], ["ugh"], ["ugh", "vile"], ["ugh", "vile", "hateful"]]
    rows = [(k, " ".join(rng.choices(WORDS, k=20) + steps[k % 4] * 2), k % 4) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, y int")
    model = toxicity.train(df, graded=True)
    out = toxicity.severities(df, model).orderBy("doc_id").collect()
    mean = [sum(r["__severity"] for r in out[k::4]) / 100 for k in range(4)]
    assert mean == sorted(mean) and mean[0] < 0.5 and mean[3] > 2
    assert sum(r["__grade"] == r["y"] for r in out) > 300


def test_raking_meets_its_targets_in_memory_and_on_spark(spark):
    rng = random.Random(5)
    cells = {(s, la, t): float(rng.randrange(50, 500)) for s in "ab" for la in "xyz" for t in "pq"}
    targets = [{"a": 0.5, "b": 0.5}, {"x": 0.2, "y": 0.3, "z": 0.5}, {"p": 0.4, "q": 0.6}]
    got = mixing.rake_memory(cells, targets)
    total = sum(cells.values())
    for d, target in enumerate(targets):
        for name, share in target.items():
            assert sum(v * got[k] for k, v in cells.items() if k[d] == name) / total == pytest.approx(share, abs=1e-6)
    rows = spark.createDataFrame([(*k, v) for k, v in cells.items()], "source string, lang string, topic string, tokens double")
    frames = [spark.createDataFrame(list(t.items()), "value string, share double") for t in targets]
    far = {(r["source"], r["lang"], r["topic"]): r["factor"] for r in mixing.rake_spark(rows, frames, 12).collect()}
    assert all(far[k] == pytest.approx(v, rel=1e-4) for k, v in got.items())


def test_raking_meets_targets_that_need_large_factors(spark):
    rng = random.Random(6)
    cells = {(s, la, t): float(n * rng.randrange(50, 500)) for s, n in (("hot", 100_000), ("rare", 1)) for la in "xyz" for t in "pq"}
    targets = {"source": {"hot": 0.5, "rare": 0.5}, "lang": {"x": 0.1, "y": 0.15, "z": 0.75}, "topic": {"p": 0.4, "q": 0.6}}
    rows = spark.createDataFrame([(*k, v) for k, v in cells.items()], "source string, lang string, topic string, tokens double")
    for bound in (mixing.CELLS, 0):
        fitted = mixing.probabilities(rows, targets, bound=bound)
        got = {(r["dimension"], r["value"]): r["share"] for r in mixing.marginals(fitted, rows).collect()}
        assert got == {(d, v): pytest.approx(share, abs=1e-6) for d, t in targets.items() for v, share in t.items()}
        assert all(0 < r["probability"] <= 1 and r["residual"] < 1e-6 for r in fitted.collect())


def test_targets_that_no_weights_have_are_an_error(spark):
    rows = spark.createDataFrame([("a", "x", "p", 10.0), ("b", "y", "q", 30.0)], "source string, lang string, topic string, tokens double")
    targets = {"source": {"a": 0.2, "b": 0.8}, "lang": {"x": 0.6, "y": 0.4}}
    for bound in (mixing.CELLS, 0):
        with pytest.raises(ValueError, match="off by"):
            mixing.probabilities(rows, targets, bound=bound)
        got = mixing.probabilities(rows, bound=bound)
        assert all(r["residual"] < 1e-9 for r in got.collect())


def plain_raking(cells, targets, rounds=60_000):
    """Sweeps over one dimension after another until nothing moves."""
    factor, total = dict.fromkeys(cells, 1.0), sum(cells.values())
    for _ in range(rounds):
        moved = 0.0
        for d, target in enumerate(targets):
            now = {}
            for k, v in cells.items():
                now[k[d]] = now.get(k[d], 0.0) + v * factor[k]
            scale = {n: target[n] * total / v for n, v in now.items()}
            moved = max(moved, *(abs(s - 1) for s in scale.values()))
            factor = {k: f * scale[k[d]] for k, f in factor.items()}
        if moved < 1e-13:
            break
    return factor


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_raking_of_few_and_uneven_cells_is_the_same_everywhere(spark, seed):
    """Default targets over tables on which sweeps are slow: factors in memory, by Spark and by plain sweeps."""
    rng = random.Random(seed)
    cells = {}
    while len(cells) < 14:
        cells[rng.choice("abcde"), rng.choice("xyz"), rng.choice("pqr")] = float(10 ** rng.randrange(1, 6))
    rows = spark.createDataFrame([(*k, v) for k, v in cells.items()], "source string, lang string, topic string, tokens double")
    near, far = ({tuple(r[d] for d in mixing.DIMENSIONS): r["factor"] for r in mixing.probabilities(rows, bound=b).collect()} for b in (mixing.CELLS, 0))
    assert far == {k: pytest.approx(v, rel=1e-6) for k, v in near.items()}
    raised = {k: v**0.7 for k, v in cells.items()}
    targets = [{n: sum(v for k, v in raised.items() if k[d] == n) / sum(raised.values()) for n in {k[d] for k in cells}} for d in range(3)]
    assert near == {k: pytest.approx(v, rel=1e-4) for k, v in plain_raking(cells, targets).items()}


def test_close_targets_on_three_cells_have_one_answer(spark):
    rows = spark.createDataFrame([("a", "x", "p", 10.0), ("a", "y", "p", 20.0), ("b", "y", "p", 30.0)], "source string, lang string, topic string, tokens double")
    targets = {"source": {"a": 0.52, "b": 0.48}, "lang": {"x": 0.001, "y": 0.999}}
    near, far = ({tuple(r[d] for d in mixing.DIMENSIONS): r["factor"] for r in mixing.probabilities(rows, targets, bound=b).collect()} for b in (mixing.CELLS, 0))
    assert far == {k: pytest.approx(v, rel=1e-6) for k, v in near.items()}
    assert near["b", "y", "p"] == pytest.approx(0.48 * 60 / 30) and near["a", "x", "p"] == pytest.approx(0.001 * 60 / 10)


def test_unusable_targets_and_cells_without_words_are_treated_alike(spark):
    rows = spark.createDataFrame([("a", "x", "p", 10), ("a", "y", "p", 30), ("b", "y", "q", 20), ("b", "x", "q", 0), ("c", "x", "p", 0), ("d", "y", "q", 5)], "source string, lang string, topic string, tokens long")
    for targets in ({"lang": {"zz": 1.0}}, {"source": {"a": 0.5, "b": 0.5, "gone": 3.0}, "topic": {"p": 0.5, "q": 0.5}, "lang": {"x": 0.2, "y": 0.8}}, {"lang": {"x": 0.0, "y": 0.0}}):
        near, far = ({tuple(r[d] for d in mixing.DIMENSIONS): r["factor"] for r in mixing.probabilities(rows, targets, bound=b).collect()} for b in (mixing.CELLS, 0))
        assert len(near) == 6 and far == {k: pytest.approx(v, rel=1e-6) for k, v in near.items()}
        assert near["c", "x", "p"] == 1.0
        assert near["d", "y", "q"] == 0 if "source" in targets else near["d", "y", "q"] > 0


def test_raking_in_one_round_by_hand(spark):
    """Two cells a dimension value each: shares over tokens, as fractions."""
    cells = {("a", "x", "p"): 10.0, ("b", "x", "p"): 30.0}
    got = mixing.rake_memory(cells, [{"a": 0.5, "b": 0.5}, {"x": 1.0}, {"p": 1.0}])
    assert got == {("a", "x", "p"): pytest.approx(2.0), ("b", "x", "p"): pytest.approx(2 / 3)}


def test_topics_are_fitted_on_all_documents_and_rare_ones_stay(spark):
    rng = random.Random(7)
    kinds = [[f"{k}{i}" for i in range(12)] for k in "abc"]
    texts = [" ".join(rng.choices(kinds[k], k=40)) for k in [0] * 500 + [1] * 490 + [2] * 10]
    seen = mixing.sketched(docs_of(spark, texts))
    centroids = mixing.fit_topics(seen, 60)
    assert sorted(tuple(r) for r in mixing.topic_rows(seen, centroids).groupBy("topic").agg({"tokens": "sum"}).collect()) == sorted(tuple(r) for r in mixing.with_topics(docs_of(spark, texts), centroids).groupBy("__topic").agg({"__tokens": "sum"}).collect())
    topics = [r["__topic"] for r in mixing.with_topics(docs_of(spark, texts), centroids).orderBy("doc_id").collect()]
    assert not set(topics[990:]) & set(topics[:990]) and len(centroids) == 60


def test_copies_and_topics_by_plain_arithmetic(spark):
    """Copies from the cell's expectation and XXH64 of the id; topics and tokens from word counts by hash."""
    import numpy as np
    import xxhash

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r for r in mixing.mix(docs).collect()}
    for d, r in rows.items():
        h = xxhash.xxh64((1).to_bytes(4, "little"), seed=xxhash.xxh64(int(d).to_bytes(8, "little"), seed=42).intdigest()).intdigest()
        draw = (h - (1 << 64) if h >> 63 else h) % (1 << 52) / (1 << 52)
        whole = int(r["__expected"] // 1)
        assert r["__copies"] == whole + (draw < r["__expected"] - whole)
        assert r["__expected"] == pytest.approx(mixing.RATE * r["__factor"]) and r["__probability"] == min(1.0, r["__expected"])
        assert r["__tokens"] == len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(r["text"])))
    # The fitted cells, summed by hand, have the tempered marginals.
    cells = {}
    for r in rows.values():
        cells.setdefault((r["source"], r["lang"], r["__topic"]), [0, r["__factor"]])[0] += r["__tokens"]
    total, raised = sum(n for n, _ in cells.values()), {k: n**0.7 for k, (n, _) in cells.items() if n}
    for d in range(3):
        for name in {k[d] for k in cells}:
            want = sum(v for k, v in raised.items() if k[d] == name) / sum(raised.values())
            assert sum(n * f for k, (n, f) in cells.items() if k[d] == name) / total == pytest.approx(want, abs=1e-6)
    centroids = mixing.fit_topics(mixing.sketched(docs))
    for r in list(rows.values())[:20]:
        count = np.zeros(256)
        for w in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(r["text"]).encode()):
            (h,), _ = mixing.words(np.frombuffer(w, np.uint8), np.array([0, len(w)]), mixing.ALNUM)
            count[int(h) >> 56] += 1
        v = np.log1p(count)
        near = (centroids @ v) / max(1e-12, np.linalg.norm(v))
        assert near[int(r["__topic"][5:])] >= near.max() - 0.02  # sketches have 256 steps


def test_mixture_is_deterministic_and_calibrated(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    a, b = (mixing.report(docs).orderBy("doc_id").collect() for _ in (0, 1))
    assert a == b and len(a) == docs.count()
    expected = sum(r["probability"] for r in a)
    assert abs(sum(r["sampled"] for r in a) - expected) < 5 * expected**0.5
    assert all(r["sampled"] == (r["copies"] > 0) for r in a)
    tokens = sum(r["n_tokens"] for r in a)
    assert abs(sum(r["copies"] * r["n_tokens"] for r in a) / tokens - mixing.RATE) < 0.1 and {round(r["residual"], 6) for r in a} == {0.0}
    odd = mixing.report(docs_of(spark, [None, "", "a b", "NULL ID", "NULL ID"])).collect()
    assert len(odd) == 5 and all(0 < r["probability"] <= 1 for r in odd if r["n_tokens"])
    assert mixing.report(docs_of(spark, [])).collect() == []


def test_many_items_that_share_a_prompt(spark, monkeypatch):
    """Items under one prompt, equal items under many ids, and rows that hold prompt and item: against all windows, in ranges of a few names."""
    monkeypatch.setattr(decontaminate, "NAMES", 50)
    rng = random.Random(12)
    prompt = " ".join(rng.choices(WORDS, k=13))
    own = [" ".join(rng.choices(WORDS, k=12)) for _ in range(40)]
    items = [(k, f"{prompt} {o}") for k, o in enumerate(own)] + [(100 + k, f"{prompt} {own[0]}") for k in range(30)] + [(200, own[1])]
    texts = [prompt, f"x {prompt} {own[0]} y", own[1], f"{own[2]} {prompt}", "nothing of that", None, *[f"{k} {prompt}" for k in range(20)]]
    docs, bench = docs_of(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    wanted = {}
    for k, t in enumerate(texts):
        words, spots, found = (lower(t or "")).split(), set(), set()
        for item, text in items:
            goal = lower(text).split()
            windows = [goal[i : i + 10] for i in range(len(goal) - 9)]
            for p in range(len(words)):
                if words[p : p + 10] in windows:
                    spots |= set(range(p, p + 10))
                    found.add(str(item))
        wanted[k] = (len(spots), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest())
    for part_bytes in (1 << 20, 600):
        got = {r["doc_id"]: (r["n_hit"], r["n_items"], r["items_sha256"]) for r in decontaminate.report(docs, bench, part_bytes).collect()}
        assert got == wanted
    assert {r["doc_id"] for r in decontaminate.clean(docs, bench).collect()} == {4, 5}
