"""Compression of vectors to codes, with codebooks refined over Hilbert-sorted blocks (operator 11).

A vector is cut into parts, and each part position has a codebook of its own; a
part's code is its nearest entry's index. Rows are kept in chunks of some thousand
vectors, as whole numbers in the narrowest type that holds them. Within a chunk the
parts of each position are sorted along a Hilbert curve and cut into flat blocks of
neighbours, and each block has its box (least and largest components) and its sums.

A round compares codebooks with boxes first: an entry that is farther off than
another one from every place in a box is nearest to none of the block's parts, so
the block is left with a shortlist. A shortlist of one entry takes the whole block
by its sums; else the block's parts are compared with the shortlist alone, in exact
whole-number arithmetic. Chunks stay where they were written, so no round moves
vectors: it sends codebooks out (parts x entries, whatever the data) and gets back
sums per entry, added up within each task first. A hot vector costs no more than
another.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import lean, small_batches
from tessera.scratch import materialize, release

PARTS, ENTRIES, ROUNDS, STEPS = 16, 64, 2, 256
#: Vectors of a chunk at most, and components; parts of a block.
CHUNK, CHUNK_VALUES, BLOCK = 1 << 15, 1 << 21, 64
#: Bits of a component's place on the Hilbert curve, and the most dimensions that the curve takes in.
BITS, CURVE = 10, 6
CODEBOOK = "part int, entry int, n long, sums array<long>"


def hilbert(places: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position on the Hilbert curve of each row of ``places`` (rows x dimensions, whole numbers below 2**bits; bits * dimensions at most 63).

    Gray code arithmetic from the top bit down: each level reflects or swaps the
    axes of those below, so that neighbours on the curve are neighbours in space.
    """
    x = [places[:, k].astype(np.int64) for k in range(places.shape[1])]
    n = len(x)
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for k in range(n):
            high = (x[k] >> level & 1).astype(bool)
            swap = np.where(high, 0, (x[0] ^ x[k]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0]) ^ swap
            if k:
                x[k] = x[k] ^ swap
    for k in range(1, n):
        x[k] = x[k] ^ x[k - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[n - 1] >> level & 1, (1 << level) - 1, 0)
    out = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for k in range(n):
            out = out << 1 | (x[k] ^ turn) >> level & 1
    return out


def curve_order(part: np.ndarray) -> np.ndarray:
    """The order of a chunk's parts (rows x dimensions) along the curve; of many dimensions those with the widest range."""
    low, high = part.min(axis=0), part.max(axis=0)
    wide = np.sort(np.argsort(-(high - low), kind="stable")[:CURVE])
    span = np.maximum(high - low, 1)[wide]
    places = (part[:, wide] - low[wide]) * ((1 << BITS) - 1) // span
    return np.argsort(hilbert(places), kind="stable")


def pack(whole: np.ndarray, parts: int = PARTS, block: int = BLOCK) -> dict:
    """The chunk of whole-number vectors (rows x dimensions): values, and per part the order, boxes and sums of its blocks."""
    n, dims = whole.shape
    d = dims // parts
    peak = int(np.abs(whole).max(initial=0))
    kind = next(k for k in (np.int8, np.int16, np.int32, np.int64) if peak <= np.iinfo(k).max)
    edges = np.arange(0, n, block)
    order, low, high, sums = [], [], [], []
    for p in range(parts):
        part = whole[:, p * d : (p + 1) * d]
        at = curve_order(part)
        order.append(at.astype(np.uint16))
        low.append(np.minimum.reduceat(part[at], edges, axis=0))
        high.append(np.maximum.reduceat(part[at], edges, axis=0))
        sums.append(np.add.reduceat(part[at], edges, axis=0))
    stack = lambda x, t: np.ascontiguousarray(np.stack(x), t).tobytes()
    return {"n": n, "width": np.dtype(kind).itemsize, "whole": np.ascontiguousarray(whole, kind).tobytes(), "orders": stack(order, np.uint16), "low": stack(low, kind), "high": stack(high, kind), "sums": stack(sums, np.int64)}


def shortlists(low: np.ndarray, high: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Which entries may be nearest to a part within each box: boxes x entries.

    Each is set against the entry nearest to the box's middle, the favourite, by the
    largest lead over it that any place in the box can have; that place is a corner,
    since a difference of two squared distances is linear.
    """
    off = low[:, None, :] + high[:, None, :] - 2 * book
    favourite = book[(off * off).sum(axis=2).argmin(axis=1)][:, None, :]
    turn = book - favourite
    corner = np.where(turn > 0, high[:, None, :], low[:, None, :])
    lead = ((corner - favourite) ** 2 - (corner - book) ** 2).sum(axis=2)
    return lead >= 0


def assign(chunk: dict, books: list[np.ndarray], block: int = BLOCK, errors: bool = True):
    """For each part of a chunk: (part, index of each row's nearest entry, squared distance of each row or None, counts, sums per entry).

    Without ``errors``, blocks with one entry in their shortlist are not looked into.
    """
    n, parts = chunk["n"], len(books)
    d = books[0].shape[1]
    kind = np.dtype(f"i{chunk['width']}")
    blocks = -(-n // block)
    whole = np.frombuffer(chunk["whole"], kind).reshape(n, parts, d)
    orders = np.frombuffer(chunk["orders"], np.uint16).reshape(parts, n)
    low, high = (np.frombuffer(chunk[k], kind).reshape(parts, blocks, d).astype(np.int64) for k in ("low", "high"))
    held = np.frombuffer(chunk["sums"], np.int64).reshape(parts, blocks, d)
    for p, book in enumerate(books):
        order, short = orders[p], shortlists(low[p], high[p], book)
        sorted_part = whole[order, p].astype(np.int64)
        index, best = np.zeros(n, np.int64), np.zeros(n, np.int64)
        single = short.sum(axis=1) == 1
        sole = short.argmax(axis=1)
        for b in range(blocks):
            a, z = b * block, min(n, (b + 1) * block)
            if single[b]:
                index[a:z] = sole[b]
                if errors:
                    off = sorted_part[a:z] - book[sole[b]]
                    best[a:z] = (off * off).sum(axis=1)
                continue
            entries = np.flatnonzero(short[b])
            distance = np.zeros((z - a, len(entries)), np.int64)
            for k in range(d):
                off = sorted_part[a:z, k, None] - book[entries, k]
                distance += off * off
            near = distance.argmin(axis=1)
            index[a:z] = entries[near]
            if errors:
                best[a:z] = distance[np.arange(z - a), near]
        if errors:
            back = np.empty(n, np.int64)
            back[order] = index
            error = np.empty(n, np.int64)
            error[order] = best
            yield p, back, error, None, None
            continue
        counts, sums = np.bincount(index, minlength=len(book)), np.zeros(book.shape, np.int64)
        mixed = np.repeat(~single, block)[:n]
        np.add.at(sums, index[mixed], sorted_part[mixed])
        np.add.at(sums, sole[single], held[p][single])
        yield p, None, None, counts, sums


def _chunks(dims: int, parts: int):
    names = ["n", "width", "whole", "orders", "low", "high", "sums"]
    most = max(1, min(CHUNK, CHUNK_VALUES // dims))
    bound = (1 << 60) // (4 * dims)

    def packed(ids, labels, values):
        whole = np.floor(np.concatenate(values).astype(np.float64) * STEPS)
        if float(np.abs(whole).max(initial=0)) ** 2 >= bound:
            raise ValueError("vectors: components are too large for exact 64-bit distances")
        chunk = pack(whole.astype(np.int64), parts)
        return pa.RecordBatch.from_arrays([pa.array([ids.to_pylist()], pa.list_(ids.type)), pa.array([labels.to_pylist()], pa.list_(labels.type)), *(pa.array([chunk[k]]) for k in names)], names=["ids", "labels", *names])

    def work(batches):
        held, n = [], 0

        def flush():
            nonlocal held, n
            ids, labels = (pa.chunked_array([h[i] for h in held]).combine_chunks() for i in (0, 1))
            out, held, n = packed(ids, labels, [h[2] for h in held]), [], 0
            return out

        for batch in batches:
            values = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            at = 0
            while at < batch.num_rows:
                some = min(most - n, batch.num_rows - at)
                held.append((batch.column(0).slice(at, some), batch.column(1).slice(at, some), values[at : at + some].copy()))
                at, n = at + some, n + some
                if n == most:
                    yield flush()
        if n:
            yield flush()

    return work


def _read(row: dict) -> dict:
    return {k: row[k] for k in ("n", "width", "whole", "orders", "low", "high", "sums")}


def _round(shared):
    def work(batches):
        books = [np.array(b, np.int64) for b in shared.value]
        counts = [np.zeros(len(b), np.int64) for b in books]
        sums = [np.zeros(b.shape, np.int64) for b in books]
        for batch in batches:
            for row in batch.to_pylist():
                for p, _, _, c, s in assign(_read(row), books, errors=False):
                    counts[p] += c
                    sums[p] += s
        found = [(p, e, int(counts[p][e]), sums[p][e].tolist()) for p in range(len(books)) for e in np.flatnonzero(counts[p])]
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int32()), pa.array([int(f[1]) for f in found], pa.int32()), pa.array([f[2] for f in found], pa.int64()), pa.array([f[3] for f in found], pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])

    return work


def _codes(shared):
    def work(batches):
        books = [np.array(b, np.int64) for b in shared.value]
        digits = np.array([f"{k:02x}" for k in range(256)])
        for batch in batches:
            for row, ids, labels in zip(batch.drop_columns(["ids", "labels"]).to_pylist(), batch.column(0), batch.column(1), strict=True):
                index = np.zeros((row["n"], len(books)), np.int64)
                error = np.zeros(row["n"], np.int64)
                for p, at, e, _, _ in assign(_read(row), books):
                    index[:, p] = at
                    error += e
                code = ["".join(r) for r in digits[index]]
                yield pa.RecordBatch.from_arrays([ids.values, labels.values, pa.array(code, pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return work


class Compressed:
    """codes: vec_id, label, code, error of every kept row; codebooks: one list of entries per part."""

    def __init__(self, codes: DataFrame, codebooks: list[list[list[int]]]):
        self.codes, self.codebooks = codes, codebooks

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(x) for part in self.codebooks for entry in part for x in entry).encode()).hexdigest()


def kept_rows(vectors: DataFrame, parts: int = PARTS) -> DataFrame:
    """vec_id, label, embedding of the rows whose vector has finite components alone and a length of a positive multiple of ``parts``."""
    x = F.col("embedding")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vectors.select("vec_id", "label", "embedding").filter(x.isNotNull() & (F.size(x) > 0) & (F.size(x) % parts == 0) & ~F.coalesce(bad, F.lit(True)))


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Compressed:
    """Codes and codebooks of ``vectors`` (vec_id, embedding, label; other columns are left out, whatever their names).

    Rows whose vector is null, empty, or holds a null or non-finite component are
    left out, and so are those whose length is no multiple of ``parts`` or not that
    of the row with the least vec_id. Codebooks start as the parts of the rows with
    the ``entries`` (256 at most) smallest vec_ids, null ids last, repeated rows taken
    as rows; with fewer rows they are shorter. No row at all gives no codes and empty
    codebooks. Components whose squared distances do not fit 64 bits (beyond some
    350,000 at 64 dimensions) are an error.
    """
    rows = kept_rows(vectors, parts)
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(entries)
    start = first.collect()
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"
    if not start:
        return Compressed(rows.sparkSession.createDataFrame([], schema), [[] for _ in range(parts)])
    dims = len(start[0]["embedding"])
    if any(len(r["embedding"]) != dims for r in start):
        rows = rows.filter(F.size("embedding") == dims)
        start = rows.orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(entries).collect()
    d = dims // parts
    seeds = np.floor(np.array([r["embedding"] for r in start], np.float64) * STEPS).astype(np.int64)
    books = [seeds[:, p * d : (p + 1) * d].tolist() for p in range(parts)]
    packed = f"ids array<{kinds['vec_id']}>, labels array<{kinds['label']}>, n long, width long, whole binary, orders binary, low binary, high binary, sums binary"
    same = small_batches(rows.filter(F.size("embedding") == dims))
    chunks = materialize(same.mapInArrow(lean(_chunks(dims, parts)), packed), "chunks")
    spark = vectors.sparkSession
    for _ in range(rounds):
        held = spark.sparkContext.broadcast(books)
        # Codebooks are parts x entries rows, however many vectors there are.
        found = chunks.drop("ids", "labels").mapInArrow(lean(_round(held)), CODEBOOK).groupBy("part", "entry")
        for r in found.agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[k]) for k in range(d)]).alias("sums")).collect():
            books[r["part"]][r["entry"]] = [s // r["n"] for s in r["sums"]]
        held.destroy()
    held = spark.sparkContext.broadcast(books)
    codes = materialize(chunks.mapInArrow(lean(_codes(held)), schema), "codes")
    release(chunks)
    return Compressed(codes, books)


def report(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every kept row; label_error is the error summed over equal labels, nulls together."""
    out = compress(vectors)
    per_label = out.codes.groupBy(F.col("label").alias("__label")).agg(F.sum("error").alias("label_error"))
    joined = out.codes.join(per_label, F.col("label").eqNullSafe(F.col("__label")), "left")
    return joined.select("vec_id", "code", "error", "label_error", F.lit(out.digest()).alias("codebooks_sha256"))
