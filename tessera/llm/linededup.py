"""Content-defined line chunks (operator 5), in DataFrame functions only.

Lines with a word are hashed. What they form is chosen by their content alone, so
that a passage at another place is taken apart alike, in two ways:

- chunks: a rolling hash over WINDOW line hashes ends a chunk where its high bits
  are 0; a run of equal lines is a chunk of its own;
- windows: from each line forward, and from each line back, as many lines as give
  more than WORDS words. They are the shortest passages that count as long; every
  longer one is the union of its windows. A chunk goes only where both its ends
  fall inside the repeated passage, windows take the passage whatever lies around.

Chunks of LEAST_LINES lines or more, and windows, that stand at an earlier place
too (the least doc_id, then text's hash, then line) are taken out, with the blank
lines between their lines. A line that goes stands at an earlier place that stays.

Comparison is by bytes: the texts of all lines that repeat are compared where their
64-bit hashes agree, and chunks and windows by the sequence of their lines. A line
whose hash another text shares (one in 10**8 among 10**11 lines) stays.

Scale. Each text is taken apart once, into a written table with a row per line and
no text. Lines that stand once, by a shuffle of hashes, drop out of it; what repeats
is gathered per document. Documents that lose nothing pass through without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.bitmap import among, marked
from tessera.llm.words import plain
from tessera.scratch import materialize, release

WINDOW, BASE, MODULUS, DIVISOR, LEAST_LINES = 4, 1_000_003, (1 << 31) - 1, 4, 2
WORDS = 50
BLANKS = "\t\x0b\x0c\r"


def n_words(line: Column) -> Column:
    """Words between white space (the space and bytes 9 to 13)."""
    return F.size(F.array_remove(F.split(F.translate(line, BLANKS, " " * len(BLANKS)), " "), ""))


def line_table(docs: DataFrame) -> DataFrame:
    """doc_id, v (hash of the text), k (place among the lines with words), i (line), n (words), a (hash), s and m (first place of its chunk, and its lines)."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("v"), F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("ls"))
    worded = lines.select("doc_id", "v", F.filter(F.transform("ls", lambda x, i: F.struct(i.alias("i"), n_words(x).alias("n"), x.alias("t"))), lambda x: x["n"] > 0).alias("w"))
    hashed = worded.withColumn("h", F.transform("w", lambda x: F.conv(F.substring(F.md5(x["t"]), 1, 8), 16, 10).cast("long")))

    def cut(x, i):
        rolled = F.lit(0).cast("long")
        for back in range(WINDOW - 1, -1, -1):
            rolled = (rolled * BASE + F.coalesce(F.get("h", i - back), F.lit(0))) % MODULUS
        after = F.get("h", i + 1)
        run = F.coalesce((x == F.get("h", i - 1)) | (after == F.get("h", i + 2)), F.lit(False))
        return F.when(((rolled < MODULUS // DIVISOR) | run) & (x != F.coalesce(after, F.lit(-1))), i + 1)

    ended = hashed.withColumn("ends", F.array_distinct(F.concat(F.filter(F.transform("h", cut), lambda x: x.isNotNull()), F.array(F.size("h")))))
    spans = F.zip_with(F.concat(F.array(F.lit(0)), F.slice("ends", 1, F.size("ends") - 1)), "ends", lambda s, e: F.array_repeat(F.struct(s.alias("s"), (e - s).alias("m")), e - s))
    rows = F.zip_with("w", F.flatten(spans), lambda x, y: F.struct(x["i"].alias("i"), x["n"].alias("n"), F.xxhash64(x["t"]).alias("a"), y["s"].alias("s"), y["m"].alias("m")))
    # The outer form: a plain one adds a filter on the array's size, which would build the array again for it.
    return ended.select("doc_id", "v", F.posexplode_outer(rows).alias("k", "x")).filter("x is not null").select("doc_id", "v", "k", "x.*")


def units(lines: DataFrame, chunks: bool = True) -> DataFrame:
    """doc_id, v, kind, key (line hashes), s, e (first and last line) of the chunks and windows that ``lines`` hold without a gap."""
    held = lines.groupBy("doc_id", "v").agg(F.array_sort(F.collect_set(F.struct("k", "i", "n", "a", "s", "m"))).alias("l"))
    parts = held.select("doc_id", "v", "l", F.col("l.n").alias("n"))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("k"))
    # How many numbers of the array give more than WORDS; 0 where all of them don't.
    taken = lambda some: F.aggregate(some, start, lambda a, n: F.when(a["n"] > WORDS, a).otherwise(F.struct((a["n"] + n).alias("n"), (a["k"] + 1).alias("k"))), lambda a: F.when(a["n"] > WORDS, a["k"]).otherwise(0))
    # A window as one number, first * 64 + size, with 0 for none.
    ahead = F.transform("n", lambda n, j: (lambda k: F.when(k > 0, j.cast("long") * 64 + k).otherwise(F.lit(0).cast("long")))(taken(F.slice("n", j + 1, WORDS + 1))))
    back = F.transform("n", lambda n, j: (lambda k: F.when(k > 0, (j - k + 1).cast("long") * 64 + k).otherwise(F.lit(0).cast("long")))(taken(F.reverse(F.slice("n", F.greatest(j + 1 - WORDS, F.lit(1)), F.least(j + 1, F.lit(WORDS + 1)))))))
    windows = F.transform(F.filter(F.array_distinct(F.concat(ahead, back)), lambda c: c > 0), lambda c: F.struct(F.lit(1).alias("kind"), F.shiftright(c, 6).cast("int").alias("at"), c.bitwiseAND(63).cast("int").alias("size")))
    first = F.filter(F.transform("l", lambda x, j: F.when((x["k"] == x["s"]) & (x["m"] >= LEAST_LINES), F.struct(F.lit(0).alias("kind"), j.alias("at"), x["m"].alias("size")))), lambda x: x.isNotNull())
    wanted = parts.withColumn("u", F.concat(first, windows) if chunks else windows)
    unit = F.transform(
        "u",
        lambda u: F.struct(
            u["kind"].alias("kind"),
            F.transform(F.slice("l", u["at"] + 1, u["size"]), lambda x: x["a"]).alias("key"),
            F.get("l", u["at"])["i"].alias("s"),
            F.get("l", u["at"] + u["size"] - 1)["i"].alias("e"),
            (F.get("l", u["at"] + u["size"] - 1)["k"] - F.get("l", u["at"])["k"] + 1 == u["size"]).alias("whole"),
        ),
    )
    out = wanted.select("doc_id", "v", F.explode_outer(unit).alias("x")).filter("x.whole")
    return out.select("doc_id", "v", "x.kind", "x.key", "x.s", "x.e")


def _differing(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """The hashes ``a`` of ``lines`` under which the documents have more than one text, byte for byte."""
    mine = among(docs.select("doc_id", F.xxhash64("text").alias("v"), "text"), F.xxhash64("doc_id", "v"), lines.select(F.xxhash64("doc_id", "v").alias("h")))
    texts = mine.select(F.explode_outer(F.split("text", "\n", -1)).alias("t")).filter("t is not null")
    texts = among(texts.withColumn("a", F.xxhash64("t")), F.col("a"), lines.select(F.col("a").alias("h")))
    return texts.select("a", "t").distinct().groupBy("a").agg(F.count("*").alias("n")).filter("n > 1").select("a")


def repeats(docs: DataFrame, chunks: bool = True) -> DataFrame:
    """doc_id, v, s, e (lines) of every chunk and window that stands, byte for byte, at an earlier place too."""
    lines = materialize(line_table(docs), "lines")
    again = lines.groupBy("a").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("a").alias("h"))
    twice = materialize(among(lines, F.col("a"), again), "lines")
    release(lines)
    differing = materialize(_differing(docs, twice), "differing")
    same = twice if differing.isEmpty() else twice.join(differing, "a", "left_anti")
    found = materialize(units(same, chunks), "units")
    spot = F.struct("doc_id", "v", "s")
    first = found.groupBy("kind", "key").agg(F.min(spot).alias("first"), F.max(spot).alias("last")).filter(~F.col("first").eqNullSafe(F.col("last"))).drop("last")
    first = materialize(first, "first")  # so that the join below has a plain shuffle on both sides, which Spark splits where one unit is hot
    gone = found.join(first, ["kind", "key"]).filter(~F.col("first").eqNullSafe(spot)).select("doc_id", "v", "s", "e").distinct()
    gone = materialize(gone, "repeats")
    for done in (twice, found, first):
        release(done)
    return gone


def line_dedup(docs: DataFrame, chunks: bool = True) -> DataFrame:
    """``docs``, all its columns, without repeated chunks and passages in text, plus __removed: the number of lines taken out.

    A null text stays null, an empty one empty; a text of which nothing is left
    becomes empty, its row stays. Rows that repeat a doc_id and a text are one
    place and are treated alike. A null doc_id comes first. n_chars, where it is
    there, is not touched. Columns that begin with two underscores are left out.
    Without ``chunks`` only passages of more than WORDS words go.
    """
    docs = plain(docs)
    gone = repeats(docs.select("doc_id", "text"), chunks)
    at = F.flatten(F.collect_set(F.sequence("s", "e")))
    by_doc = gone.groupBy(F.col("doc_id").alias("__id"), F.col("v").alias("__v")).agg(at.alias("__gone"))
    split = marked(docs, F.xxhash64("doc_id", F.xxhash64("text")), gone.select(F.xxhash64("doc_id", "v").alias("h")))
    same = split.filter(~F.col("__set")).drop("__set").withColumn("__removed", F.lit(0))
    hit = split.filter("__set").drop("__set").join(by_doc, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__v")), "left").drop("__id", "__v")
    lines = hit.withColumn("__lines", F.split("text", "\n", -1))
    kept = lines.withColumn("__kept", F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.coalesce("__gone", F.array().cast("array<int>"))))
    text = F.array_join(F.transform("__kept", lambda i: F.element_at("__lines", i + 1)), "\n")
    rebuilt = kept.withColumn("__removed", F.when(F.col("text").isNull(), 0).otherwise(F.size("__lines") - F.size("__kept"))).withColumn("text", F.when(F.col("text").isNotNull(), text))
    return same.unionByName(rebuilt.select(*[F.col(f"`{c}`") for c in same.columns]))


def report(docs: DataFrame, chunks: bool = True) -> DataFrame:
    """doc_id, n_removed (lines), n_chars, text_sha256 after the removal, for every row of ``docs``."""
    out = line_dedup(docs.select("doc_id", "text"), chunks)
    return out.select("doc_id", F.col("__removed").cast("long").alias("n_removed"), F.length("text").cast("long").alias("n_chars"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
