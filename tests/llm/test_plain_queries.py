"""The language and toxicity queries, whole, against plain loops over words and letters."""

import math
import re
import unicodedata
import zlib
from collections import Counter

import pytest

from tessera.llm import langid, queries, toxicity

SF = "/root/testdata/sf0.001"
MASK = (1 << 64) - 1
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


def folded(word):
    return bytes(b + 32 if 65 <= b <= 90 else b for b in word)


# Language.


def trigrams(word):
    b = [0, 0, *(x + 1 for x in word), 0]
    m = 0xFFFFFFFF
    return [((((x * 31337 + y) * 40503 + z) & m) * 0x9E3779B1 & m) >> 16 for x, y, z in zip(b, b[1:], b[2:], strict=False)]


def script(word):
    """Name of the script of most of a word's letters (here no word has two as often); None without one."""
    count = Counter()
    for c in word.decode():
        if c.isalpha():
            name = unicodedata.name(c, "OTHER").split()
            count[(name[1] if name[0] in ("HALFWIDTH", "FULLWIDTH") else name[0]).split("-")[0]] += 1
    return count.most_common(1)[0][0] if count else None


def plain_languages(docs):
    grams, scripts = {}, {}
    for d in docs:
        if crc(d["doc_id"]) % 4 != 2 and d["lang"] is not None and d["text"] is not None:
            for w in WORD.findall(d["text"].encode()):
                grams.setdefault(d["lang"], Counter()).update(trigrams(folded(w)))
                scripts.setdefault(d["lang"], Counter())[script(w)] += 1
    names = sorted(grams)
    size = {n: sum(grams[n].values()) for n in names}
    allowed = {n: {s for s, k in scripts[n].items() if s is not None and k >= 0.01 * sum(scripts[n].values())} for n in names}
    log = {n: {g: math.log((k + 0.02) / (size[n] + 0.02 * 65536)) for g, k in grams[n].items()} for n in names}
    none = {n: math.log(0.02 / (size[n] + 0.02 * 65536)) for n in names}
    out = {}
    for d in docs:
        best, weights = {n: 0.0 for n in names}, None
        found = WORD.findall((d["text"] or "").encode())
        back = []
        for w in found:
            kind = script(w)
            score = {}
            for n in names:
                s = sum(log[n].get(g, none[n]) for g in trigrams(folded(w))) if kind is not None else 0.0
                if kind is not None and kind not in allowed[n] and any(kind in a for a in allowed.values()):
                    s -= 1e4
                score[n] = s
            top = max(names, key=lambda n: best[n])
            came, new = {}, {}
            for n in names:
                switch = back and best[top] - langid.SWITCH > best[n]
                came[n], new[n] = (top if switch else n), (best[top] - langid.SWITCH if switch else best[n]) + score[n]
            back.append(came)
            best = new
        if found:
            now, weights = max(names, key=lambda n: best[n]), Counter()
            for w, came in zip(reversed(found), reversed(back), strict=True):
                if script(w) is not None:
                    weights[now] += len(w)
                now = came[now]
        if not weights:
            out[d["doc_id"]] = ("und", 0.0)
        else:
            top = max(names, key=lambda n: weights[n])
            out[d["doc_id"]] = (top, weights[top] / sum(weights.values()))
    return out


def test_language_query_against_a_plain_loop(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    wanted = plain_languages(docs)
    got = {r["doc_id"]: r for r in queries.op7_language(spark, SF).collect()}
    assert len(got) == len(docs)
    unlike = []
    for d in docs:
        r, (lang, share) = got[d["doc_id"]], wanted[d["doc_id"]]
        assert r["held_out"] == (crc(d["doc_id"]) % 4 == 2)
        # Scores are held in single precision, so that words with two nearly equal paths may go either way.
        if r["lang_pred"] != lang or abs(r["score"] - share) > 0.02:
            unlike.append((d["doc_id"], r["lang_pred"], lang, r["score"], share))
    assert len(unlike) <= 1, unlike


# Toxicity.


def mixed(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def word_hash(values):
    total, power = 0, 1
    for v in values:
        total = (total + v * power) & MASK
        power = power * 0x9E3779B97F4A7C15 & MASK
    return mixed(total)


def plain_features(text):
    raw, out = (text or "").encode(), Counter()
    for m in WORD.finditer(raw):
        v = [b + 1 for b in folded(m[0])]
        for i in range(1, len(v)):
            if m[0][i - 1] == 0xC3 and 0x80 <= m[0][i] <= 0x9E and m[0][i] != 0x97:
                v[i] += 0x20
        out[mixed(word_hash(v)) >> 44] += 1
        for n in toxicity.STEMS:
            if len(v) > n:
                out[mixed((word_hash(v[:n]) + n) & MASK) >> 44] += 1
    return out


def test_toxicity_query_against_a_plain_loop(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(toxicity.labelled(docs, labels, "toxic", toxicity.fold(5) != 0))
    got = {r["doc_id"]: r for r in queries.op10_toxicity(spark, SF).collect()}
    rows = docs.collect()
    assert len(got) == len(rows) and any(r["toxic"] for r in got.values())
    # Which features the screen may let in: those of documents that are toxic more often than not.
    labelled = {r["doc_id"]: r["toxic"] for r in labels.collect() if r["doc_id"] is not None and r["toxic"] is not None}
    held = [(plain_features(d["text"]), labelled[d["doc_id"]]) for d in rows if d["doc_id"] in labelled and crc(d["doc_id"]) % 5 != 0]
    toxic = Counter(f for x, y in held for f in x if y)
    assert {int(f) for f in model.weights.nonzero()[0]} <= set(toxic)
    for d in rows:
        r = got[d["doc_id"]]
        dot = sum(float(model.weights[f]) * math.log1p(n) for f, n in plain_features(d["text"]).items())
        p = [1 / (1 + math.exp(-min(30, max(-30, dot - t)))) for t in model.thresholds]
        assert r["held_out"] == (crc(d["doc_id"]) % 5 == 0)
        assert r["p_toxic"] == pytest.approx(p[0], rel=1e-5) and r["severity"] == pytest.approx(sum(p), rel=1e-5)
        assert r["grade"] == (1 + sum(q >= 0.5 for q in p[1:]) if p[0] >= model.cut else 0) and r["toxic"] == (r["grade"] >= 1)


def test_the_mixing_stage_against_plain_arithmetic(spark):
    """The pipeline's last stage on its own input: kept rows, copies and probabilities by hand from the cells' factors."""
    import xxhash

    import corpus_pipeline as cp
    from tessera.llm import mixing

    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id % 3 <> 1")
    out = {r["doc_id"]: r for r in cp.mixing_stage(spark, docs.select(*cp.COLUMNS), SF).collect()}
    every = {r["doc_id"]: r for r in mixing.mix(docs.select(*cp.COLUMNS)).collect()}
    cells = Counter()
    for r in every.values():
        cells[r["source"], r["lang"], r["__topic"]] += r["__tokens"]
    total, raised = sum(cells.values()), {k: n**0.7 for k, n in cells.items() if n}
    factor = {(r["source"], r["lang"], r["__topic"]): r["__factor"] for r in every.values()}
    for d in range(3):
        for name in {k[d] for k in raised}:
            wanted = sum(v for k, v in raised.items() if k[d] == name) / sum(raised.values())
            assert sum(n * factor[k] for k, n in cells.items() if k[d] == name) / total == pytest.approx(wanted, abs=1e-8)
    kept = set()
    for i, r in every.items():
        expected = factor[r["source"], r["lang"], r["__topic"]] * mixing.RATE
        h = xxhash.xxh64((1).to_bytes(4, "little"), seed=xxhash.xxh64(int(i).to_bytes(8, "little"), seed=42).intdigest()).intdigest()
        draw = (h - (1 << 64) if h >> 63 else h) % (1 << 52) / (1 << 52)
        copies = int(expected) + (draw < expected - int(expected))
        if copies:
            kept.add(i)
            assert (out[i]["copies"], out[i]["n_tokens"], out[i]["topic"]) == (copies, r["__tokens"], r["__topic"])
            assert out[i]["probability"] == pytest.approx(min(1.0, expected)) and out[i]["text"] == r["text"]
    assert set(out) == kept
