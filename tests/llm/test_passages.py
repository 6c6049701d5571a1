"""Repeated passages of lines against a plain loop over all runs."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import linededup

WORDS = [f"w{i}" for i in range(400)]


def brute_passages(texts, least=50):
    """Every run of worded lines with more than ``least`` words that stands earlier goes; texts in the order of their ids."""
    docs = [(t or "").split("\n") for t in texts]
    worded = [[i for i, x in enumerate(d) if re.search(r"[^\x20\x09-\x0D]", x)] for d in docs]
    seen, out = {}, []
    for step in (0, 1):
        for d, (lines, at) in enumerate(zip(docs, worded, strict=True)):
            gone = set()
            for a in range(len(at)):
                for b in range(a, min(len(at), a + 60)):
                    run = tuple(lines[i] for i in at[a : b + 1])
                    if sum(len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in run) <= least:
                        continue
                    if not step:
                        seen.setdefault(run, (d, a))
                    elif seen[run] != (d, a):
                        gone |= set(range(at[a], at[b] + 1))
            if step:
                out.append("\n".join(x for i, x in enumerate(lines) if i not in gone))
    return out


@pytest.mark.parametrize("size", [1, 2, 3, 4, 5])
def test_planted_passages_of_one_to_five_lines_go(spark, size):
    rng = random.Random(size)
    line = lambda n: " ".join(rng.choices(WORDS, k=n))
    passages_ = [[line(60 // size + 1) for _ in range(size)] for _ in range(20)]
    texts = [None, "", "\n\n", *("\n".join([line(40), *p, line(40), line(3)]) for p in passages_ for _ in range(2))]
    texts += ["\n".join([line(20)] * 5), "\n".join([line(30), *[f"{line(5)}"] * 30]), "\n".join([*passages_[0][:1], "", *passages_[0][1:], "short"]), "\n".join(passages_[1][:-1] + [line(9)])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = linededup.line_dedup(df, chunks=False).orderBy("doc_id").collect()
    assert [r["text"] for r in out] == [None, *brute_passages(texts)[1:]]
    assert all(r["__removed"] >= size for r in out[4:43:2]) and not any(r["__removed"] for r in out[3:43:2])


def test_rows_that_share_an_id(spark):
    p = "\n".join(" ".join(WORDS[k : k + 30]) for k in (0, 50, 90))
    df = spark.createDataFrame([(1, p), (1, p), (2, "a\n" + p), (None, "b\n" + p)], "doc_id long, text string")
    got = {(r["doc_id"], r["n_removed"], r["text_sha256"]) for r in linededup.report(df, chunks=False).collect()}
    empty, a = hashlib.sha256(b"").hexdigest(), hashlib.sha256(b"a").hexdigest()
    assert got == {(None, 0, hashlib.sha256(("b\n" + p).encode()).hexdigest()), (1, 3, empty), (2, 3, a)}
    assert linededup.report(df.filter(F.lit(False)), chunks=False).collect() == []
