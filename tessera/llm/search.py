"""Ranked lexical search by MaxScore with bounds of term pairs (operator 13).

The best documents of each of many items, by a sum of term impacts in whole numbers.
Documents are indexed in blocks of some megabytes, and blocks stay where they are
written; all passes go over blocks within tasks, and only statistics, bounds and the
best few of each task are shuffled.

1. Index: of every text its length in terms and, for the items' terms, who holds
   them how often. Sums of these are the statistics that the weights need.
2. Pairs: an item's terms, by falling weight, are taken two at a time. Each block
   gets the impact of every posting and, for every pair, the list of the documents
   that hold both and the largest impact that one document has of the two together,
   which is less than the sum of the two terms' maxima unless one document has both.
3. Thresholds: the impacts in an item's pair lists, added up for each document, are
   scores that documents have at least; the k-th best over all blocks bounds the
   item's results from below before any block is searched.
4. Search: a block whose pair bounds do not add up to the threshold is skipped.
   Else pairs are taken from the largest bound down: documents are gathered from the
   lists until what is left can't reach the threshold alone; after that only those
   are looked up that still can. Ties with the threshold are kept, as a lower doc_id
   wins. A task carries its best results, and so its threshold, from block to block.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.words import ALNUM, BLOCK, blocks, column, hash_spans, lean, share, shared, small_batches, word_spans
from tessera.scratch import materialize, release

BEST = 10
#: Bytes of text in a block of the index, and of item texts in a pass.
BLOCK_BYTES, PART_BYTES = 8 << 20, 8 << 20
INDEX = "n array<long>, terms array<int>, ends array<int>, places binary, tf binary"


class Terms:
    """The items' terms, by the hashes of their words, with their letters for a comparison."""

    def __init__(self, words: list[bytes]):
        found = []
        for w in words:
            values = ALNUM[np.frombuffer(w, np.uint8)]
            found.append((int(hash_spans(values, np.array([0]), np.array([len(values)]))[0]), w))
        order = sorted(range(len(found)), key=lambda k: found[k])
        self.hashes = np.array([found[k][0] for k in order], np.uint64)
        self.number = np.array(order, np.int64)
        self.size = np.array([len(found[k][1]) for k in order], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)])[:-1].astype(np.int64)
        self.letters = ALNUM[np.frombuffer(b"".join(found[k][1] for k in order), np.uint8)]
        _, alike = np.unique(self.hashes, return_counts=True)
        self.alike = int(alike.max(initial=1))


def _found(terms, values: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the words values[s:e]: which are terms, and their numbers; words of one hash are told apart by their letters."""
    h, where, what = hash_spans(values, s, e), [], []
    first = np.searchsorted(terms.hashes, h)
    for k in range(terms.alike):
        at = np.minimum(first + k, len(terms.hashes) - 1)
        same = np.flatnonzero((terms.hashes[at] == h) & (terms.size[at] == e - s))
        at = at[same]
        size = terms.size[at]
        total = int(size.sum())
        step = np.arange(total) - np.repeat(np.cumsum(size) - size, size)
        unlike = values[np.repeat(s[same], size) + step] != terms.letters[np.repeat(terms.start[at], size) + step]
        good = np.bincount(np.repeat(np.arange(len(size)), size)[unlike], minlength=len(size)) == 0
        where.append(same[good])
        what.append(terms.number[at[good]])
    return np.concatenate(where), np.concatenate(what)


def postings(data: np.ndarray, offs: np.ndarray, terms) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the rows between ``offs``: terms in each, and the (term, row, occurrences) of known terms, by term and row."""
    raw, rel, rows = data[offs[0] : offs[-1]], offs - offs[0], len(offs) - 1
    n, keys, counts, at = np.zeros(rows, np.int64), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    while at < len(raw):
        to = min(at + BLOCK, len(raw))
        while to < len(raw):
            apart = np.flatnonzero(ALNUM[raw[to : to + 4096]] == 0)
            to += int(apart[0]) if len(apart) else min(4096, len(raw) - to)
            if len(apart):
                break
        values = ALNUM[raw[at:to]]
        a, b = np.searchsorted(rel, (at, to + 1))
        s, e = word_spans(values, rel[a:b] - at)
        row = np.searchsorted(rel, s + at, "right") - 1
        n += np.bincount(row, minlength=rows)
        if len(s) and len(terms.hashes):
            which, term = _found(terms, values, s, e)
            key, count = np.unique(term * rows + row[which], return_counts=True)
            keys.append(key)
            counts.append(count)
        at = to
    keys, back = np.unique(np.concatenate(keys), return_inverse=True)
    tf = np.bincount(back, weights=np.concatenate(counts), minlength=len(keys)).astype(np.int64)
    return n, keys // max(1, rows), keys % max(1, rows), tf


def _index(held):
    def work(batches):
        terms = shared(held)
        for batch in batches:
            data, offs = column(batch, "text")
            for a, b in blocks(offs, BLOCK_BYTES):
                n, term, row, tf = postings(data, offs[a : b + 1], terms)
                there, ends = np.unique(term, return_index=True)
                ends = np.append(ends[1:], len(term)) if len(there) else ends
                ids = batch.column(0).slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), ids), pa.array([n.tolist()], pa.list_(pa.int64())), pa.array([there.tolist()], pa.list_(pa.int32())), pa.array([ends.tolist()], pa.list_(pa.int32())), pa.array([row.astype(np.int32).tobytes()]), pa.array([tf.astype(np.int32).tobytes()])],
                    names=["ids", "n", "terms", "ends", "places", "tf"],
                )

    return work


def impacts(weight: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The part of a score that an occurring term adds."""
    return weight * (1_000_000_000 * tf // (1000 * tf + 8 * m))


def _impact_index(held):
    """Impacts of all postings of a block, and of every pair its list of documents and largest joint impact."""

    def work(batches):
        q = shared(held)
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(k)[i] for k, c in enumerate(batch.schema.names)}
                n = row["n"].values.to_numpy()
                m = 10 + 90 * n * q.documents // max(1, q.words)
                terms, ends = row["terms"].values.to_numpy(), row["ends"].values.to_numpy()
                places, tf = (np.frombuffer(row[c].as_py(), np.int32) for c in ("places", "tf"))
                starts = np.append(0, ends)[:-1]
                impact = impacts(np.repeat(q.weights[terms], ends - starts), tf.astype(np.int64), m[places]) if len(terms) else np.zeros(0, np.int64)
                at = np.full(len(q.weights), -1)
                at[terms] = np.arange(len(terms))
                lists, joint, bounds = [], [], np.zeros(len(q.pairs), np.int64)
                both, ones = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
                for p, pair in enumerate(q.pairs):
                    seen = [slice(starts[at[t]], ends[at[t]]) for t in pair if t >= 0 and at[t] >= 0]
                    for s in seen:
                        both[places[s]] += impact[s]
                        ones[places[s]] += 1
                    bounds[p] = max((int(both[places[s]].max()) for s in seen), default=0)
                    docs = places[seen[0]][ones[places[seen[0]]] == 2] if len(seen) == 2 else places[:0]
                    lists.append(docs)
                    joint.append(both[docs])
                    for s in seen:
                        both[places[s]] = 0
                        ones[places[s]] = 0
                # Scores that documents have at least, by item: of the best ones.
                least = []
                for k, pairs in enumerate(q.items):
                    for p in pairs:
                        both[lists[p]] += joint[p]
                    some = np.concatenate([lists[p] for p in pairs]) if pairs else places[:0]
                    some = np.unique(some)
                    best = np.sort(both[some])[-q.best :]
                    least += [{"item": k, "score": int(s)} for s in best if s > 0]
                    both[some] = 0
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays(pa.array([0, len(n)], pa.int32()), row["ids"].values), pa.array([terms]), pa.array([ends]), pa.array([places.tobytes()]), pa.array([impact.tobytes()]), pa.array([bounds.tobytes()]), pa.array([least], pa.list_(pa.struct([("item", pa.int32()), ("score", pa.int64())])))],
                    names=["ids", "terms", "ends", "places", "impacts", "bounds", "least"],
                )

    return work


def _top(rows: list, k: int) -> list:
    """The k best of (score, doc_id): highest first, equal ones by doc_id, null last."""
    return sorted(rows, key=lambda r: (-r[0], r[1] is None, r[1]))[:k]


def search_block(units: list[tuple[int, tuple[int, ...]]], of: dict, size: int, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of one item in one block: all with a score of at least ``threshold``, above 0, and maybe others.

    ``units`` are (bound, terms), the largest bound first; ``of`` gives a term's (places, impacts).
    """
    left = np.append(np.cumsum([u[0] for u in units][::-1])[::-1], 0)
    score, k = np.zeros(size, np.int64), 0
    # What any document can have of the units from k on is left[k]: until it is below the threshold, a new document may matter.
    while k < len(units) and left[k] >= max(1, threshold):
        for t in units[k][1]:
            if t in of:
                places, impact = of[t]
                score[places] += impact
        k += 1
    docs = np.flatnonzero(score)
    for j in range(k, len(units)):
        docs = docs[score[docs] + left[j] >= threshold]
        if not len(docs):
            break
        for t in units[j][1]:
            if t in of:
                places, impact = of[t]
                spot = np.minimum(np.searchsorted(places, docs), len(places) - 1)
                score[docs] += np.where(places[spot] == docs, impact[spot], 0)
    docs = docs[score[docs] >= max(1, threshold)]
    return docs, score[docs]


def _search(held):
    def work(batches):
        q = shared(held)
        best: list[list] = [[] for _ in q.items]
        kind = None
        for batch in batches:
            for i in range(batch.num_rows):
                ids, terms, ends, places, impact, bounds = (batch.column(k)[i] for k in range(6))
                kind, ids = batch.column(0).type.value_type, ids.values
                terms, ends = terms.values.to_numpy(), ends.values.to_numpy()
                places, impact, bounds = np.frombuffer(places.as_py(), np.int32), np.frombuffer(impact.as_py(), np.int64), np.frombuffer(bounds.as_py(), np.int64)
                starts = np.append(0, ends)[:-1]
                of = {t: (places[a:z], impact[a:z]) for t, a, z in zip(terms.tolist(), starts.tolist(), ends.tolist(), strict=True)}
                for k, pairs in enumerate(q.items):
                    units = sorted(((int(bounds[p]), tuple(t for t in q.pairs[p] if t >= 0)) for p in pairs if bounds[p]), reverse=True)
                    threshold = max(q.least[k], best[k][-1][0] if len(best[k]) == q.best else 0)
                    if sum(u[0] for u in units) < max(1, threshold):
                        continue
                    docs, score = search_block(units, of, len(ids), threshold)
                    if len(docs) > q.best:  # the k-th highest score, with its ties
                        some = score >= np.partition(score, -q.best)[-q.best]
                        docs, score = docs[some], score[some]
                    if len(docs):
                        names = ids.take(pa.array(docs)).to_pylist()
                        best[k] = _top([*best[k], *zip(score.tolist(), names, strict=True)], q.best)
        if kind is not None:
            flat = [(k, d, s) for k, rows in enumerate(best) for s, d in rows]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in flat], pa.int32()), pa.array([f[1] for f in flat], kind), pa.array([f[2] for f in flat], pa.int64())], names=["item", "doc_id", "score"])

    return work


class _Held:
    """What the tasks of a pass need; see ``share``."""

    def __init__(self, **parts):
        vars(self).update(parts)


def item_terms(text: str | None) -> list[bytes]:
    """The different terms of an item, in order of first occurrence."""
    values = ALNUM[np.frombuffer((text or "").encode(), np.uint8)]
    s, e = word_spans(values, np.array([0, len(values)]))
    letters = (values - 1).astype(np.uint8).tobytes()
    return list(dict.fromkeys(letters[a:b] for a, b in zip(s.tolist(), e.tolist(), strict=True)))


def _pass(docs: DataFrame, rows: list, k: int, item_type: str) -> DataFrame:
    """Results of some items, ``rows`` of (item_id, text)."""
    spark, id_type = docs.sparkSession, dict(docs.dtypes)["doc_id"]
    wanted = [item_terms(r[1]) for r in rows]
    number = {t: i for i, t in enumerate(dict.fromkeys(t for ts in wanted for t in ts))}
    held = share(spark, Terms(list(number)))
    index = materialize(small_batches(docs).select("doc_id", "text").mapInArrow(lean(_index(held)), f"ids array<{id_type}>, {INDEX}"), "postings")
    total = index.agg(F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)), F.sum(F.size(F.filter("n", lambda x: x > 0)))).first()
    words, documents = total[0] or 0, total[1] or 0
    # One number per term of the items.
    sizes = F.transform("ends", lambda x, i: x - F.when(i > 0, F.element_at("ends", F.greatest(i, F.lit(1)))).otherwise(0))
    df = np.zeros(len(number), np.int64)
    for r in index.select(F.inline(F.arrays_zip("terms", sizes.alias("df")))).toDF("term", "df").groupBy("term").agg(F.sum("df").alias("df")).collect():
        df[r["term"]] = r["df"]
    weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    pairs: dict[tuple[int, int], int] = {}
    items = []
    for ts in wanted:
        order = sorted((number[t] for t in ts if df[number[t]]), key=lambda t: (-weights[t], t))
        order += [-1] * (len(order) % 2)
        items.append([pairs.setdefault(p, len(pairs)) for p in zip(order[::2], order[1::2], strict=True)])
    parts = {"pairs": list(pairs), "items": items, "best": k}
    held = share(spark, _Held(weights=weights, documents=documents, words=words, **parts))
    made = f"ids array<{id_type}>, terms array<int>, ends array<int>, places binary, impacts binary, bounds binary, least array<struct<item: int, score: long>>"
    impact = materialize(small_batches(index).select("ids", *(c.split()[0] for c in INDEX.split(", "))).mapInArrow(lean(_impact_index(held)), made), "impacts")
    release(index)
    ranked = impact.select(F.inline("least")).withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(F.desc("score")))).filter(F.col("rank") <= k)
    least = [0] * len(rows)
    for r in ranked.groupBy("item").agg(F.min("score").alias("score"), F.count("*").alias("n")).collect():
        least[r["item"]] = r["score"] if r["n"] == k else 0
    held = share(spark, _Held(least=least, **parts))
    found = small_batches(impact).drop("least").mapInArrow(lean(_search(held)), f"item int, doc_id {id_type}, score long")
    by = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    out = materialize(found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k), "ranked")
    release(impact)
    names = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], f"item int, item_id {item_type}")
    return out.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = BEST, part_bytes: int = PART_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: for each item (item_id, text) the k best of all ``docs`` (doc_id, text) with a score above 0.

    Terms are runs of ASCII letters, digits and of all beyond ASCII, A-Z lower-cased.
    Null, empty and blank texts have none, are found by nothing and find nothing. Rows
    of items that are alike are one item; texts of one item_id that differ are ranked
    one by one. Equal documents are found beside each other, by doc_id, null last.
    Other columns of either table are left out, whatever their names. Texts are taken
    whole, whatever their length. Items go out in passes of ``part_bytes`` of text,
    each over all documents.
    """
    spark = docs.sparkSession
    item_type = dict(items.dtypes)["item_id"]
    wanted = items.select("item_id", "text").filter("text is not null").distinct()
    size = wanted.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    parts = -(-size // part_bytes)
    out = None
    for p in range(parts):
        rows = wanted.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == p).collect()
        if rows:
            found = _pass(docs, [tuple(r) for r in rows], k, item_type)
            out = found if out is None else out.unionByName(found)
    kind = dict(docs.dtypes)["doc_id"]
    return out if out is not None else spark.createDataFrame([], f"item_id {item_type}, rank int, doc_id {kind}, score long")
