"""Queries of the diagnostics of decks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.plans.catalog import query
from tessera.plans.relational import table
from tessera.sources import deck


def _lines(spark, sf_dir):
    """A deck per customer segment: a card and three data lines per customer, of which some are wrong."""
    k = F.col("c_custkey")
    key = (k + 1).cast("string")
    card = F.when(k % 4 == 0, F.concat(F.lit("*NODE, NSET=N"), key)).when(k % 4 == 1, F.lit("*NODE, NSTE=ALL")).when(k % 4 == 2, F.lit("*Element, elset=E")).otherwise(F.concat(F.lit("*AMPLITUDE, NAME="), F.when(k % 12 == 3, F.repeat(F.lit("A"), 81)).otherwise("A1")))
    value = F.when(F.col("j") == 0, card).when(F.col("j") == 1, F.concat(key, F.lit(", 1.5, 2.5D0, 3."))).when(F.col("j") == 2, F.concat(F.when(k % 5 == 0, F.lit("-")).otherwise(F.lit("")), key, F.lit(", , 1e3"))).otherwise(F.concat(key, F.when(k % 3 == 0, F.lit(", x1")).otherwise(F.lit(", 7")), F.lit(", 2,")))
    c = table(spark, sf_dir, "customer").withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(3))))
    return c.select(F.col("c_mktsegment").alias("deck"), (k * 4 + F.col("j")).alias("line"), value.alias("value"))


_ISSUES = """
c AS (SELECT c_mktsegment AS deck, c_custkey AS k, c_custkey % 4 AS m FROM customer),
card AS (SELECT deck, k * 4 AS line, '*NODE' AS card, 'warning' AS severity, 'parameter not recognized: NSTE' AS reason, 2 AS field FROM c WHERE m = 1
  UNION ALL SELECT deck, k * 4, '*ELEMENT', 'error', 'parameter missing: TYPE', NULL FROM c WHERE m = 2
  UNION ALL SELECT deck, k * 4, '*AMPLITUDE', 'error', 'name too long: NAME', 2 FROM c WHERE m = 3 AND k % 12 = 3),
name AS (SELECT *, ['*NODE', '*NODE', '*ELEMENT', '*AMPLITUDE'][m + 1] AS card FROM c),
data AS (SELECT deck, k * 4 + 2 AS line, card, 'error' AS severity, 'not a positive whole number: -' || (k + 1) AS reason, 1 AS field FROM name WHERE k % 5 = 0 AND m <> 3
  UNION ALL SELECT deck, k * 4 + 1, card, 'error', 'not a positive whole number: ' || f, i FROM (SELECT *, unnest(['1.5', '2.5D0', '3.']) AS f, unnest([2, 3, 4]) AS i FROM name WHERE m = 2)
  UNION ALL SELECT deck, k * 4 + 2, card, 'error', 'not a positive whole number: ' || f, i FROM (SELECT *, unnest(['', '1E3']) AS f, unnest([2, 3]) AS i FROM name WHERE m = 2)
  UNION ALL SELECT deck, k * 4 + 3, card, 'error', CASE WHEN m = 2 THEN 'not a positive whole number: X1' ELSE 'not a number: X1' END, 2 FROM name WHERE k % 3 = 0),
under AS (SELECT deck, k * 4 + unnest([1, 2, 3]) AS line, card, 'error' AS severity, 'its card has an error' AS reason, NULL AS field FROM name WHERE m = 2 OR (m = 3 AND k % 12 = 3)),
issues AS (SELECT * FROM card UNION ALL SELECT * FROM data UNION ALL SELECT * FROM under)
"""


@query(f"WITH {_ISSUES} SELECT deck, line, card, severity, reason, field FROM issues")
def deck_issues(spark, sf_dir):
    """All that is wrong or odd in decks, line by line."""
    return deck.check(deck.parse(_lines(spark, sf_dir))).issues


@query(f"""
WITH {_ISSUES}
SELECT deck, count(*) AS n FROM (SELECT c_mktsegment AS deck, c_custkey * 4 + unnest([0, 1, 2, 3]) AS line FROM customer) l WHERE NOT EXISTS (SELECT 1 FROM issues i WHERE i.deck = l.deck AND i.line = l.line AND severity = 'error') GROUP BY deck
""")
def deck_accepted(spark, sf_dir):
    """Lines without errors, per deck."""
    return deck.check(deck.parse(_lines(spark, sf_dir))).rows.groupBy("deck").agg(F.count("*").alias("n"))
