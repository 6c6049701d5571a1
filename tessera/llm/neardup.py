"""MinHash near-duplicates (operator 2).

b-bit MinHash: of 256 minima per document only the low 2 bits stay, packed in
eight longs; 51 bands of 5 whole minima give candidates; XOR and bit counts over
the packed longs estimate the similarity, corrected for chance collisions; the
candidates that remain are confirmed on full shingle sets.

Scale. Texts with equal sets collapse to one class first. A bucket links its
members to its least class only (a star), so a group of n near copies costs n
rows and not n * n. Where the links confirmed so far leave a bucket with more
than one component, members of different components are compared by their
packed bits within the join: by set size, by the coarse signature, and by a fine
one of 2048 minima that only the documents of such buckets get. No link between
different components is thus left out, and links within one component cannot
change it. A large bucket is dealt into blocks and each two of them are a task's
work, so that the comparisons of a hot bucket spread over the cluster.

A pair at similarity 0.75 shares no band with probability (1 - 0.75**5)**51,
1e-6. Estimates are compared with a bound SIGMAS standard deviations below the
similarity asked for, which a true link misses with probability 3e-7.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bitmap import among
from tessera.llm.components import components
from tessera.llm.words import SPACED, blocks, column, grams, lean, list_column, mix, small_batches, words
from tessera.scratch import materialize, release

WORDS, PERMS, FINE, ROWS, BITS = 5, 256, 2048, 5, 2
BANDS = PERMS // ROWS
SIGMAS = 5
#: Rows of a fine band, and the members from which on a bucket is split by these bands.
FINE_ROWS, LARGE_BUCKET = 10, 2048
#: A larger bucket's members are compared in blocks of about this size, apart from each other.
BUCKET_BLOCK = 4096


def shingle_sets(data: np.ndarray, offs: np.ndarray):
    """For each row of the block its sorted distinct shingle hashes."""
    w, first = words(data, offs, SPACED)
    five = grams(w, WORDS)
    for i in range(len(first) - 1):
        a, b = first[i], first[i + 1]
        yield np.unique(five[a : b - WORDS + 1]) if b - a >= WORDS else grams(w[a:b], int(b - a) or 1)


def minima(shingles: np.ndarray, mul: np.ndarray, add: np.ndarray) -> np.ndarray:
    x, out = (shingles >> np.uint64(32)).astype(np.uint32), np.full(len(mul), 0xFFFFFFFF, np.uint32)
    step = max(1, (1 << 17) // len(mul))
    for i in range(0, len(x), step):
        t = x[i : i + step, None] * mul
        t += add
        np.minimum(out, t.min(axis=0), out=out)
    return out


def permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229 + n)
    return rng.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def pack(m: np.ndarray) -> np.ndarray:
    """The low BITS bits of each row's minima, in longs."""
    per_long = 64 // BITS
    shift = (BITS * np.arange(per_long)).astype(np.uint64)
    return ((m & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(len(m), -1, per_long) << shift).sum(axis=2, dtype=np.uint64)


def _sign(batches):
    mul, add = permutations(PERMS)
    spread = mix(np.arange(1, ROWS + 1, dtype=np.uint64)) | np.uint64(1)
    salt = mix(np.arange(1000, 1000 + BANDS, dtype=np.uint64))
    for batch in batches:
        data, offs = column(batch, "text")
        for a, b in blocks(offs):
            n, k1, k2 = (np.zeros(b - a, t) for t in (np.int64, np.uint64, np.uint64))
            m = np.zeros((b - a, PERMS), np.uint32)
            for i, s in enumerate(shingle_sets(data, offs[a : b + 1])):
                n[i] = len(s)
                if len(s):
                    k1[i], k2[i] = mix(s).sum(), mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum()
                    m[i] = minima(s, mul, add)
            full = n > 0
            keys = mix((m[full, : BANDS * ROWS].reshape(-1, BANDS, ROWS).astype(np.uint64) * spread).sum(axis=2, dtype=np.uint64) ^ salt)
            packed = pack(m[full])
            ends = np.cumsum(full)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), pa.array(n), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), list_column(keys.ravel().view(np.int64), ends * BANDS), list_column(packed.ravel().view(np.int64), ends * packed.shape[1])],
                names=["doc_id", "n_shingles", "k1", "k2", "bands", "sig"],
            )


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, (k1, k2) naming the set, band keys, packed low bits; nothing for empty sets."""
    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(_sign), "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>, sig array<long>")


def _refine(batches):
    mul, add = permutations(FINE)
    bands = FINE // FINE_ROWS
    spread = mix(np.arange(1, FINE_ROWS + 1, dtype=np.uint64)) | np.uint64(1)
    salt = mix(np.arange(5000, 5000 + bands, dtype=np.uint64))
    for batch in batches:
        data, offs = column(batch, "text")
        for a, b in blocks(offs):
            m = np.stack([minima(s, mul, add) for s in shingle_sets(data, offs[a : b + 1])])
            packed = pack(m)
            keys = mix((m[:, : bands * FINE_ROWS].reshape(-1, bands, FINE_ROWS).astype(np.uint64) * spread).sum(axis=2, dtype=np.uint64) ^ salt)
            ends = np.arange(1, b - a + 1)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), list_column(packed.ravel().view(np.int64), ends * packed.shape[1]), list_column(keys.ravel().view(np.int64), ends * bands)], names=["node", "fine", "keys"])


def likely_at(x: str, y: str, perms: int, percent: int):
    """Whether two packed signatures may belong to a pair at ``percent``.

    The estimate R corrects for chance collisions: E = C + (1 - C) R, C = 2**-BITS,
    where E is the share of equal minima by their low bits.
    """
    low = sum(1 << i for i in range(0, 64, BITS))
    low -= (low >> 63) << 64
    c = 2.0**-BITS
    e = c + (1 - c) * percent / 100
    least = e - SIGMAS * (e * (1 - e) / perms) ** 0.5  # as E; the corrected estimate is (E - C) / (1 - C)
    most = F.lit(int((1 - least) * perms))

    def unequal(p, q):
        d = any_bit = p.bitwiseXOR(q)
        for k in range(1, BITS):
            any_bit = any_bit.bitwiseOR(F.shiftrightunsigned(d, k))
        return F.bit_count(any_bit.bitwiseAND(F.lit(low)))

    if perms > PERMS:  # too many longs for one compiled method
        return F.aggregate(F.zip_with(x, y, unequal), F.lit(0), lambda a, b: a + b) <= most
    # The first ``perms`` of perhaps more.
    parts = [unequal(F.get(F.col(x), F.lit(i)), F.get(F.col(y), F.lit(i))) for i in range(perms * BITS // 64)]
    return sum(parts[1:], parts[0]) <= most


def _overlap(batches):
    for batch in batches:
        sides = [[batch.column(batch.schema.get_field_index(f"text_{side}")), *column(batch, f"text_{side}"), None, None] for side in "ab"]
        inter, union = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
        for i in range(batch.num_rows):
            for s in sides:  # a text that comes again in the next row has its set already
                if s[3] is None or s[0][i] != s[3]:
                    (s[4],), s[3] = shingle_sets(s[1], s[2][i : i + 2]), s[0][i]
            x, y = sides[0][4], sides[1][4]
            inter[i] = len(np.intersect1d(x, y, assume_unique=True))
            union[i] = len(x) + len(y) - inter[i]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(inter), pa.array(union)], names=["a", "b", "inter", "union"])


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, text of about the documents that ``ids`` (id) names; the rest is not shuffled."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return among(plain, F.xxhash64("doc_id"), ids.select(F.xxhash64("id").alias("h")))


def confirm(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= percent * union; where rows share a doc_id, one may come repeatedly."""
    texts = _texts(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")))
    one, two = texts.toDF("a", "text_a"), texts.toDF("b", "text_b")
    both = pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(lean(_overlap), "a long, b long, inter long, union long").filter(F.col("inter") * 100 >= F.col("union") * percent).select("a", "b")


def _blocks(rest: DataFrame, held: tuple[str, ...], block: int = BUCKET_BLOCK) -> tuple[DataFrame, DataFrame]:
    """Two sides of a join on (key, cell), in which every two of a bucket's m rows meet, and no cell has more than about 2 ``block`` rows.

    A bucket is dealt into blocks by a hash; a row goes to the cells of its block with
    each block. Rows of one block meet in the cell of that block with itself, others
    in that of their two blocks: where block_p is block_q and lo is not hi they have
    met already.
    """
    n = F.ceil(F.col("m") / block).cast("int")
    dealt = rest.withColumn("block", F.pmod(F.xxhash64("node", "key"), n).cast("int"))
    cells = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
    cells = cells.withColumn("cell", F.struct(F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")))
    return tuple(cells.select("key", "cell", F.col("block").alias(f"block_{side}"), *(F.col(c).alias(f"{c}_{side}") for c in held)) for side in "pq")


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs`` (doc_id, text, any others).

    A null or empty text, or one of white space, has an empty set: it is linked
    with nothing and kept. Rows that share a doc_id count as one document. A row
    with a null doc_id takes part in no link; its component_id is null and it is
    kept. Fewer than five words are one shingle.
    """
    signed = materialize(signatures(docs), "signed")
    held = signed.filter("n_shingles > 0 and doc_id is not null")
    classes = materialize(held.groupBy("k1", "k2").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig")), "classes")
    sigs = classes.select("node", "n", "sig")

    keys = classes.select("node", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.min("node").alias("rep"), F.count("*").alias("n")).filter("n > 1").select("key", "rep")
    buckets = materialize(keys.join(shared, "key").select("key", "rep", "node"), "buckets")

    star = buckets.filter("rep <> node").select(F.col("rep").alias("a"), F.col("node").alias("b")).distinct()
    star = star.join(sigs.toDF("a", "n_p", "sig_p"), "a").join(sigs.toDF("b", "n_q", "sig_q"), "b")
    sizes = F.least("n_p", "n_q") * 100 >= F.greatest("n_p", "n_q") * percent
    likely = materialize(star.filter(sizes & likely_at("sig_p", "sig_q", PERMS, percent)).select("a", "b").distinct(), "likely")
    links = materialize(confirm(likely, docs, percent), "links")
    found = components(links)

    # What is left: buckets that still hold more than one component.
    named = buckets.select("key", "node").join(found, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    split = named.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("m")).filter("lo < hi").select("key", "m")
    rest = materialize(named.join(split, "key"), "rest")
    texts = _texts(docs, rest.select(F.col("node").alias("id")))
    refined = texts.mapInArrow(lean(_refine), "node long, fine array<long>, keys array<long>")
    apart = (F.col("node_p") < F.col("node_q")) & (F.col("component_p") != F.col("component_q"))
    in_one_cell = (F.col("cell.lo") == F.col("cell.hi")) | (F.col("block_p") != F.col("block_q"))
    coarse, close = (likely_at("fine_p", "fine_q", perms, percent) for perms in (PERMS, FINE))  # the first few longs cost least, so they come before what goes through whole arrays
    large = F.col("m") > LARGE_BUCKET
    few = rest.filter(~large)
    if rest.filter(large).isEmpty():
        fine, many = refined.drop("keys"), None
    else:
        fine = many = materialize(refined, "fine")
    p, q = _blocks(few.join(classes.select("node", "n", "bands"), "node").join(fine.select("node", "fine"), "node"), ("node", "component", "n", "fine", "bands"))
    common = F.filter(F.zip_with("bands_p", "bands_q", lambda x, y: F.when(x == y, x)), lambda x: x.isNotNull())
    # In their first common bucket, and there in one cell; that bucket may be a large one, where they meet by other bands.
    of_few = F.col("key") == F.get(common, F.lit(0))
    if many is not None:
        of_few = F.lit(True)
    more = p.join(q, ["key", "cell"]).filter(apart & in_one_cell & sizes & coarse & of_few & close).select(F.col("node_p").alias("a"), F.col("node_q").alias("b"))
    if many is not None:
        members = rest.filter(large).select("node", "component").distinct().join(classes.select("node", "n"), "node")
        anew = members.join(many.select("node", F.explode("keys").alias("key")), "node")
        open_ = anew.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("m")).filter("lo < hi").select("key", "m")
        p, q = _blocks(anew.join(open_, "key"), ("node", "component", "n"))
        pairs = p.join(q, ["key", "cell"]).filter(apart & sizes & in_one_cell).select("node_p", "node_q").distinct()
        held_p, held_q = (many.select(F.col("node").alias(f"node_{side}"), F.col("fine").alias(f"fine_{side}")) for side in "pq")
        more = more.unionByName(pairs.join(held_p, "node_p").join(held_q, "node_q").filter(coarse & close).select(F.col("node_p").alias("a"), F.col("node_q").alias("b")))
    more = materialize(more.distinct().join(likely, ["a", "b"], "left_anti"), "more")
    later = materialize(confirm(more, docs, percent), "links")
    if later.isEmpty():
        final = found
    else:
        # Only components meet anew.
        to = lambda side: F.coalesce(f"component_{side}", side)
        named = later.join(found.toDF("a", "component_a"), "a", "left").join(found.toDF("b", "component_b"), "b", "left")
        joined = components(named.select(to("a").alias("a"), to("b").alias("b"))).toDF("component", "top")
        nodes = found.unionByName(later.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(found, "node", "left_anti").select("node", F.col("node").alias("component")))
        final = materialize(nodes.join(joined, "component", "left").select("node", F.coalesce("top", "component").alias("component")), "final")
    for done in (buckets, likely, rest, more, many):
        release(done)

    # A class's documents share its node; its node's component is theirs.
    whole = classes.select("k1", "k2", "node").join(final, "node", "left").select("k1", "k2", F.coalesce("component", "node").alias("found"))
    out = signed.select("doc_id", "n_shingles", "k1", "k2").join(whole, ["k1", "k2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("found"))).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
