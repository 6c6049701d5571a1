"""Keyword text: lines of cards and their data, as a DataFrame of lines.

A deck is (deck, line, value). Comment lines start with **, a card with one *.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.lookup import as_of
from tessera.scratch import materialize, release

# Parameters whose value keeps its case; the classes in the order in which their cards are taken, and the beginnings of their cards, the rest coming last.
KEEP_CASE = ("FILE", "INPUT", "OUTPUT", "FILENAME", "MASSFILE", "STIFFNESSFILE")
CARD_CLASSES = (
    ("RESTART,READ", ("*RESTART",)),
    ("NODE", ("*NODE",)),
    ("USERELEMENT", ("*USERELEMENT",)),
    ("ELEMENT", ("*ELEMENT",)),
    ("MATRIXASSEMBLE", ("*MATRIXASSEMBLE",)),
    ("NSET", ("*NSET",)),
    ("ELSET", ("*ELSET",)),
    ("SURFACE", ("*SURFACE",)),
    ("TRANSFORM", ("*TRANSFORM",)),
    (
        "MATERIAL",
        (
            "*CONDUCTIVITY",
            "*CREEP",
            "*CYCLICHARDENING",
            "*DAMPING",
            "*DEFORMATIONPLASTICITY",
            "*DENSITY",
            "*DEPVAR",
            "*ELASTIC",
            "*ELECTRICALCONDUCTIVITY",
            "*EXPANSION",
            "*FLUIDCONSTANTS",
            "*HYPERELASTIC",
            "*HYPERFOAM",
            "*MAGNETICPERMEABILITY",
            "*MATERIAL",
            "*PLASTIC",
            "*RATEDEPENDENT",
            "*SPECIFICGASCONSTANT",
            "*SPECIFICHEAT",
            "*USERMATERIAL",
        ),
    ),
    ("DISTRIBUTION", ("*DISTRIBUTION",)),
    ("ORIENTATION", ("*ORIENTATION",)),
    ("TIE", ("*TIE",)),
    ("INTERACTION", ("*CONTACTDAMPING", "*FRICTION", "*GAPCONDUCTANCE", "*GAPHEATGENERATION", "*SURFACEINTERACTION", "*SURFACEBEHAVIOR")),
    ("INITIALCONDITIONS", ("*INITIALCONDITIONS",)),
    ("AMPLITUDE", ("*AMPLITUDE",)),
    ("CONTACTPAIR", ("*CONTACTPAIR",)),
    ("COUPLING", ("*COUPLING",)),
    ("REST", ("*",)),
)
#: Cards that begin like one of a class but are of the rest.
NOT_THESE = ("*ELEMENTOUTPUT", "*NODEPRINT", "*NODEOUTPUT", "*NODEFILE")
#: Cards of the rest once the deck has had the other one.
CHANGED = {"*FRICTION": "*CHANGEFRICTION", "*SURFACEBEHAVIOR": "*CHANGESURFACEBEHAVIOR"}
FIELDS, FIELD_CHARS = 16, 132
#: Levels of included files.
DEEPEST = 9


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per line of the text files at ``path``; line numbers are per file.

    Files are split: each block numbers its own lines and adds those of the blocks
    before it, so that a long deck is many tasks' work.
    """
    at = spark.read.text(path).select(F.col("_metadata.file_path").alias("deck"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__id"), "value")
    held = materialize(at, "deck")
    size = held.groupBy("deck", "__block").agg(F.count("*").alias("n"))
    base = size.select(F.col("deck").alias("__deck"), F.col("__block").alias("__b"), F.coalesce(F.sum("n").over(W.partitionBy("deck").orderBy("__block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    within = held.withColumn("__r", F.row_number().over(W.partitionBy("deck", "__block").orderBy("__id")))
    return within.join(base, (F.col("deck") == F.col("__deck")) & (F.col("__block") == F.col("__b"))).select("deck", (F.col("__r") + F.col("__base")).alias("line"), F.rtrim("value", F.lit("\r")).alias("value"))


def include_all(lines: DataFrame, files: DataFrame) -> DataFrame:
    """(deck, path, value) with each ``*INCLUDE, INPUT=name`` replaced by the lines (name, line, value) of that file, down to DEEPEST levels.

    path is an array of line numbers, one per level; ``lines`` may have a plain line
    instead. Deeper files are an error; a file that isn't there gives no lines.
    """
    name = F.regexp_extract("value", r"(?i)^\s*\*include\s*,\s*input\s*=\s*(\S+)", 1)
    out = lines.select("deck", (F.col("path") if "path" in lines.columns else F.array(F.col("line").cast("long"))).alias("path"), "value")
    inner = files.select(F.col("name").alias("__name"), F.col("line").cast("long").alias("__sub"), F.col("value").alias("__value"))
    for _ in range(DEEPEST + 1):
        marked = out.withColumn("__name", name)
        open_ = marked.filter(F.col("__name") != "")
        if open_.isEmpty():
            return out
        spliced = open_.join(inner, "__name").select("deck", F.concat("path", F.array("__sub")).alias("path"), F.col("__value").alias("value"))
        new = materialize(marked.filter(F.col("__name") == "").drop("__name").unionByName(spliced), "included")
        release(out)
        out = new
    raise ValueError(f"deck: files are included in more than {DEEPEST} levels")


def normal(value: Column) -> Column:
    """Without blanks, in upper case but for the values of file parameters."""
    bare = F.regexp_replace(value, r"\s+", "")
    kept = F.regexp_extract(bare, r"(?i)(?:" + "|".join(KEEP_CASE) + r")=([^,]*)", 1)
    return F.when(kept != "", F.concat(F.upper(F.substring(bare, F.lit(1), F.instr(bare, kept) - 1)), kept, F.upper(F.substring(bare, F.instr(bare, kept) + F.length(kept), F.length(bare))))).otherwise(F.upper(bare))


def parse(lines: DataFrame) -> DataFrame:
    """(deck, line, value) -> (deck, line, card, is_card, fields): comments and blank lines go; fields are cut at commas, 16 at most, a trailing empty one dropped.

    A data line's card is carried to it from the card line before, over as many tasks
    as a long deck has.
    """
    text = lines.withColumn("value", normal(F.col("value"))).filter((F.col("value") != "") & ~F.col("value").startswith("**"))
    cards = text.filter(F.col("value").startswith("*")).select("deck", "line", F.substring_index("value", ",", 1).alias("card"))
    fields = F.transform(F.slice(F.split(F.regexp_replace("value", ",$", ""), ","), 1, FIELDS), lambda x: F.substring(x, 1, FIELD_CHARS))
    carried = as_of(text.select("deck", "line", "value"), cards, ["deck"], "line", ["card"])
    return carried.select("deck", "line", F.col("card_at").alias("card"), F.col("value").startswith("*").alias("is_card"), fields.alias("fields"))


def card_rank(card: Column, fields: Column | None = None, changed: dict[str, Column] | None = None) -> Column:
    """Place of a card's class in the order, from 0 on, by the longest beginning that fits.

    A restart counts only with READ among its fields. changed: for the cards of
    CHANGED whether the deck has had the other one before.
    """
    found = sorted(((name, i) for i, (_, names) in enumerate(CARD_CLASSES) for name in names), key=lambda x: (-len(x[0]), x[0]))
    rest = len(CARD_CLASSES) - 1
    rank = F.lit(rest)
    for name, i in reversed(found):
        here = card.startswith(name)
        if name == "*RESTART" and fields is not None:
            here = here & F.exists(fields, lambda f: f.startswith("READ"))
        if name in CHANGED and changed:
            here = here & ~changed[name]
        rank = F.when(here, i).otherwise(rank)
    return F.when(F.coalesce(F.regexp_like(card, F.lit("^(" + "|".join(n.replace("*", "\\*") for n in NOT_THESE) + ")")), F.lit(False)), rest).otherwise(rank)


def blocks(parsed: DataFrame) -> DataFrame:
    """Blocks in the order they are taken: (deck, card, rank, first line, number of data lines)."""
    heads = parsed.filter("is_card").select("deck", "line", F.col("line").alias("first"), F.col("fields").alias("head"))
    carried = as_of(parsed.select("deck", "line", "card", "is_card"), heads, ["deck"], "line", ["first", "head"])
    # Where each deck first has the cards after which others are changes.
    since = parsed.groupBy(F.col("deck").alias("__deck")).agg(*[F.min(F.when(F.col("card").startswith(other), F.col("line"))).alias(f"__{i}") for i, other in enumerate(CHANGED.values())])
    known = carried.join(since, F.col("deck").eqNullSafe(F.col("__deck")), "left")
    had = {name: F.coalesce(F.col("line") >= F.col(f"__{i}"), F.lit(False)) for i, name in enumerate(CHANGED)}
    ranked = known.withColumn("rank", card_rank(F.col("card"), F.col("head_at"), had))
    return ranked.groupBy("deck", "card", "rank", F.col("first_at").alias("first")).agg(F.sum((~F.col("is_card")).cast("long")).alias("n_data"))


#: What cards may look like: parameters that are known, those that must be there, and what the fields of data lines are, the last one again and again. int: a whole number; real: a number or nothing; name: anything; item: a number or a name; ids: whole numbers above 0.
RULES = {
    "*NODE": (("NSET", "SYSTEM"), (), ("ids", "real", "real", "real")),
    "*ELEMENT": (("ELSET", "TYPE"), ("TYPE",), ("ids",)),
    "*NSET": (("GENERATE", "NSET"), ("NSET",), ("item",)),
    "*ELSET": (("ELSET", "GENERATE"), ("ELSET",), ("item",)),
    "*AMPLITUDE": (("NAME", "SHIFTX", "SHIFTY", "TIME", "USER"), ("NAME",), ("real",)),
    "*BOUNDARY": (("AMPLITUDE", "FIXED", "LOADCASE", "OP", "SUBMODEL", "STEP", "DATASET", "TIMEDELAY", "USER", "MASSFLOW"), (), ("item", "int", "int", "real")),
    "*CLOAD": (("AMPLITUDE", "DATASET", "LOADCASE", "OMEGA0", "OP", "SECTOR", "SUBMODEL", "STEP", "TIMEDELAY", "USER"), (), ("item", "int", "real")),
    "*MATERIAL": (("NAME",), ("NAME",), ("name",)),
    "*ELASTIC": (("TYPE",), (), ("real",)),
    "*DENSITY": ((), (), ("real",)),
}
NAME_CHARS = 80


@dataclass
class Checked:
    """rows: the parsed lines without errors; issues: (deck, line, card, severity, reason, field) of all that is wrong or odd; counts: an observation of lines, errors and warnings, filled in when ``rows`` are first computed."""

    rows: DataFrame
    issues: DataFrame
    counts: Observation


def check(parsed: DataFrame, rules: dict = RULES) -> Checked:
    """What of parsed lines breaks the rules of their cards; nothing goes without a reason beside it.

    Parameters that a card does not know are warnings; a missing parameter, a name of
    more than NAME_CHARS, a malformed field and a data line before any card are errors,
    and so is each data line of a card that itself has an error. Cards without rules
    are taken as they are, with a note in ``counts``.
    """
    names = lambda values: F.array(*map(F.lit, values)).cast("array<string>")
    table = F.create_map(*[c for card, (may, must, data) in sorted(rules.items()) for c in (F.lit(card), F.struct(names(may).alias("may"), names(must).alias("must"), names(data).alias("data")))])
    rule = F.try_element_at(table, F.coalesce("card", F.lit("")))
    held = parsed.withColumn("__rule", rule)
    may, must, data = (F.col(f"__rule.{n}") for n in ("may", "must", "data"))
    issue = lambda severity, reason, field: F.struct(F.lit(severity).alias("severity"), reason.alias("reason"), field.cast("int").alias("field"))
    given = F.filter(F.transform(F.slice("fields", 2, FIELDS), lambda x, i: F.struct(F.substring_index(x, "=", 1).alias("name"), F.when(F.contains(x, F.lit("=")), F.substring_index(x, "=", -1)).alias("value"), (i + 2).alias("field"))), lambda x: x["name"] != "")
    unknown = F.transform(F.filter(given, lambda x: ~F.array_contains(may, x["name"])), lambda x: issue("warning", F.concat(F.lit("parameter not recognized: "), x["name"]), x["field"]))
    missing = F.transform(F.filter(must, lambda m: ~F.exists(given, lambda x: x["name"] == m)), lambda m: issue("error", F.concat(F.lit("parameter missing: "), m), F.lit(None)))
    long = F.transform(F.filter(given, lambda x: F.coalesce(F.length(x["value"]), F.lit(0)) > NAME_CHARS), lambda x: issue("error", F.concat(F.lit("name too long: "), x["name"]), x["field"]))
    kind = lambda i: F.element_at(data, F.least(i + 1, F.size(data)))
    whole = lambda x: x.rlike(r"^[+-]?\d+$")

    def wrong(x: Column, i: Column) -> Column:
        k = kind(i)
        bad = F.when(k == "int", (x != "") & ~whole(x)).when(k == "ids", ~whole(x) | (F.coalesce(x.try_cast("long"), F.lit(0)) <= 0)).when(k == "real", (x != "") & number(x).isNull()).when(k == "item", x == "")
        return F.when(F.coalesce(bad, F.lit(False)), issue("error", F.concat(F.lit("not a "), F.when(k == "ids", "positive whole number").when(k == "int", "whole number").when(k == "real", "number").otherwise("number or name"), F.lit(": "), x), i + 1))

    malformed = F.filter(F.transform("fields", wrong), lambda x: x.isNotNull())
    none = F.array().cast("array<struct<severity: string, reason: string, field: int>>")
    own = F.when(F.col("card").isNull(), F.array(issue("error", F.lit("data before any card"), F.lit(None)))).when(F.col("__rule").isNull(), none).when(F.col("is_card"), F.concat(unknown, missing, long)).otherwise(malformed)
    found = held.withColumn("__found", own).drop("__rule")
    broken = found.filter(F.col("is_card")).select("deck", "line", F.exists("__found", lambda x: x["severity"] == "error").alias("broken"))
    carried = materialize(as_of(found, broken, ["deck"], "line", ["broken"]), "checked")
    under = F.when(~F.col("is_card") & F.coalesce("broken_at", F.lit(False)), F.array(issue("error", F.lit("its card has an error"), F.lit(None)))).otherwise(none)
    every = carried.withColumn("__all", F.concat("__found", under))
    issues = every.select("deck", "line", "card", F.explode("__all").alias("x")).select("deck", "line", "card", "x.*")
    counts = Observation()
    errors = F.exists("__all", lambda x: x["severity"] == "error")
    seen = every.observe(counts, F.count("*").alias("lines"), F.count_if(errors).alias("errors"), F.count_if(F.exists("__all", lambda x: x["severity"] == "warning")).alias("warnings"), F.count_if(~F.col("card").isin(*rules)).alias("unchecked"))
    return Checked(seen.filter(~errors).select(*parsed.columns), issues, counts)


def number(field: Column) -> Column:
    """A real from its first 20 characters, with Fortran's D exponents; null where it is none."""
    return F.regexp_replace(F.substring(field, 1, 20), "[dD]", "E").try_cast("double")
