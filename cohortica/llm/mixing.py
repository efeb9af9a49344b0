"""Mixing sources to target weights by hierarchical budgeting (operator 9); built-in functions only.

Leaves are paths of the levels (domain, language, source). A leaf can supply its tokens
``max_epochs`` times over. Budgets go down the tree by weight: a child never gets more than
its subtree can supply, and what it leaves is shared among its siblings by weight, so only
what a whole family lacks reaches the family's own siblings. Each leaf then takes whole
epochs and, of the last one, the longest prefix within its budget, in a seeded order of its
documents drawn anew for each epoch.

A prefix is a cut of the draw: it is found from the totals of ``CELLS`` cells of the draw and
from the rows of the one cell that holds the cut, so no leaf is ever sorted in one task, and
rows with their text are only filtered, never moved.

Null levels are one value (''); null texts have the one end token. Rows with the same id share
one draw and are taken or left together. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortica.functions.hashing import hash_int
from cohortica.llm.common import kept

CELLS = 4096
CELL_WIDTH = 2**48 // CELLS


def default_tokens(text: Column) -> Column:
    """White-space separated words plus one end token."""
    return (F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")) + 1).cast("long")


def _weight(level: str, weights: Mapping[str, float]) -> Column:
    out = F.lit(1.0)
    for value, weight in weights.items():
        out = F.when(F.col(level) == value, F.lit(float(weight))).otherwise(out)
    return out


def share_budget(children: DataFrame, family: Sequence[str]) -> DataFrame:
    """Share ``budget`` among the rows of a family by ``weight``, none above ``supply``; adds ``given``.

    Children are filled in the order of supply per weight. Up to the first one whose supply
    exceeds its share of what is left, supplies are used up; from there on shares hold.
    """
    by = [F.col(c) for c in family]
    order = Window.partitionBy(*by).orderBy("_ratio", *[c for c in children.columns if c not in family])
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = children.withColumn("_ratio", F.col("supply") / F.col("weight"))
    rows = rows.withColumn("_rate", (F.col("budget") - F.coalesce(F.sum("supply").over(before), F.lit(0.0)))
                           / F.sum("weight").over(rest)).withColumn("_place", F.row_number().over(order))
    short = F.min(F.when(F.col("_ratio") > F.col("_rate"), F.struct("_place", "_rate"))).over(Window.partitionBy(*by))
    rows = rows.withColumn("_cut", short)
    given = F.when(F.col("_cut").isNull() | (F.col("_place") < F.col("_cut._place")), F.col("supply")).otherwise(
        F.col("_cut._rate") * F.col("weight"))
    return rows.withColumn("given", given).drop("_ratio", "_rate", "_place", "_cut")


def leaf_budgets(leaves: DataFrame, levels: Sequence[str], weights: Mapping[str, Mapping[str, float]],
                 budget: float, max_epochs: int) -> DataFrame:
    """``levels, tokens, budget`` of every leaf, from ``levels, tokens``."""
    levels = list(levels)
    given: DataFrame | None = None
    for depth, level in enumerate(levels, 1):
        nodes = leaves.groupBy(*levels[:depth]).agg((F.sum("tokens") * F.lit(float(max_epochs))).alias("supply"))
        nodes = nodes.withColumn("weight", _weight(level, weights.get(level, {})))
        if given is None:
            whole = F.sum("supply").over(Window.partitionBy())
            nodes = nodes.withColumn("budget", F.least(F.lit(float(budget)), whole))
        else:
            nodes = nodes.join(given, levels[:depth - 1])
        given = share_budget(nodes, levels[:depth - 1]).select(*levels[:depth], F.col("given").alias("budget"))
    return leaves.join(given, levels).select(*levels, "tokens", F.floor("budget").cast("long").alias("budget"))


def plan_epochs(rows: DataFrame, levels: Sequence[str], weights: Mapping[str, Mapping[str, float]],
                budget: float, max_epochs: int, seed: int) -> DataFrame:
    """``levels, full, cut, budget``: whole epochs of each leaf, and the largest draw taken of the next one.

    ``rows`` holds ``levels, doc_id, tokens``.
    """
    levels = list(levels)
    leaves = kept(leaf_budgets(rows.groupBy(*levels).agg(F.sum("tokens").alias("tokens")), levels, weights,
                               budget, max_epochs), "leaves")
    leaves = leaves.select(*levels, "budget", F.floor(F.col("budget") / F.col("tokens")).cast("long").alias("full"),
                           (F.col("budget") % F.col("tokens")).alias("rest"))
    drawn = rows.join(leaves, levels).withColumn("draw", draw(seed, F.col("full"), F.col("doc_id")))
    cell = F.floor(F.col("draw") / CELL_WIDTH).cast("long")
    cells = drawn.withColumn("cell", cell).groupBy(*levels, "rest", "cell").agg(F.sum("tokens").alias("tokens"))
    upto = Window.partitionBy(*levels).orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    over = cells.withColumn("upto", F.sum("tokens").over(upto)).where("upto > rest").groupBy(*levels).agg(
        F.min(F.struct("cell", F.col("upto") - F.col("tokens"))).alias("at"))
    over = kept(over.select(*levels, F.col("at.cell").alias("cell"), F.col("at.col2").alias("before")), "cells")
    inside = drawn.join(over, levels).where(cell == F.col("cell"))
    running = F.sum("tokens").over(Window.partitionBy(*levels).orderBy("draw"))      # equal draws together
    fits = inside.withColumn("upto", F.col("before") + running).where("upto <= rest").groupBy(*levels).agg(
        F.max("draw").alias("last"))
    return leaves.join(over, levels, "left").join(fits, levels, "left").select(
        *levels, "full", "budget", F.coalesce("last", F.col("cell") * CELL_WIDTH - 1, F.lit(-1)).alias("cut"))


def draw(seed: int, epoch: Column, doc_id: Column) -> Column:
    return hash_int(seed, epoch, F.coalesce(doc_id.cast("string"), F.lit("")))


def mix(docs: DataFrame, levels: Mapping[str, Column], weights: Mapping[str, Mapping[str, float]], share: float,
        max_epochs: int = 4, seed: int = 29, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` as one column ``doc``, once for every epoch that takes them; ``levels``, ``tokens``, ``epoch``.

    The budget is ``share`` of all tokens.
    """
    names = list(levels)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
                       *[F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, c in levels.items()],
                       F.col(id_col).alias("_id"), default_tokens(F.col(text_col)).alias("tokens"))
    thin = kept(rows.select(*names, F.col("_id").alias("doc_id"), "tokens"), "mixture")
    total = thin.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    plan = kept(plan_epochs(thin, names, weights, float(int(total * share)), max_epochs, seed), "epochs")
    taken = rows.join(plan, names).withColumn(
        "n", F.col("full") + F.when(draw(seed, F.col("full"), F.col("_id")) <= F.col("cut"), 1).otherwise(0))
    return taken.where("n > 0").select("doc", *names, "tokens", F.explode(
        F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("epoch"))


def document_levels() -> dict[str, Column]:
    """Domain (four groups of source numbers), language and source of the documents table."""
    number = F.nullif(F.regexp_extract(F.coalesce(F.col("source"), F.lit("")), "([0-9]+)", 1), F.lit(""))
    domain = F.coalesce(F.concat(F.lit("d"), F.pmod(number.cast("long"), F.lit(4)).cast("string")), F.lit("other"))
    return {"domain": domain, "language": F.col("lang"), "source": F.col("source")}


#: Target weights of the query and of the pipeline stage; what is not named has weight 1.
WEIGHTS = {"domain": {"d0": 2.0}, "language": {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 2.0}}
SHARE = 0.8
MAX_EPOCHS = 4
SEED = 29


def op9_hierarchical_mixture(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = mix(docs, document_levels(), WEIGHTS, SHARE, MAX_EPOCHS, SEED)
    return out.select(F.col("doc.doc_id").alias("doc_id"), "epoch", "domain", "language", "source", "tokens")


def _family_sql(depth: int) -> str:
    names = ["domain", "language", "source"]
    weight = ["CASE domain WHEN 'd0' THEN 2.0 ELSE 1.0 END",
              "CASE language WHEN 'en' THEN 4.0 WHEN 'de' THEN 2.0 WHEN 'fr' THEN 2.0 WHEN 'es' THEN 2.0 ELSE 1.0 END",
              "1.0"][depth - 1]
    own, up = ", ".join(names[:depth]), ", ".join(names[:depth - 1])
    budget = "p.budget"
    if depth == 1:
        budget = f"LEAST(trunc((SELECT sum(tokens) FROM t)::DOUBLE * {SHARE}::DOUBLE), sum(supply) OVER ())"
    source = f"n{depth} n" + (f" JOIN b{depth - 1} p USING ({up})" if depth > 1 else "")
    part = f"PARTITION BY {up}" if up else ""
    return f"""
n{depth} AS (SELECT {own}, (sum(tokens) * {MAX_EPOCHS})::DOUBLE AS supply, ({weight})::DOUBLE AS weight FROM t GROUP BY {own}),
f{depth} AS (SELECT {own}, supply, weight, {budget} AS budget FROM {source}),
g{depth} AS (SELECT *, row_number() OVER w AS place,
  (budget - coalesce(sum(supply) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate
  FROM f{depth} WINDOW w AS ({part} ORDER BY supply / weight, {own})),
b{depth} AS (SELECT {own}, CASE WHEN c IS NULL OR place < c.place THEN supply ELSE c.rate * weight END AS budget
  FROM (SELECT *, min(CASE WHEN supply / weight > rate THEN {{'place': place, 'rate': rate}} END) OVER ({part}) AS c FROM g{depth}))"""


OP9_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS language, coalesce(source, '') AS source,
  coalesce('d' || (nullif(regexp_extract(coalesce(source, ''), '([0-9]+)', 1), '')::BIGINT % 4), 'other') AS domain,
  len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) + 1 AS tokens FROM documents),
{_family_sql(1)},{_family_sql(2)},{_family_sql(3)},
s AS (SELECT domain, language, source, sum(tokens) AS supply FROM t GROUP BY ALL),
l AS (SELECT domain, language, source, floor(budget)::BIGINT // supply AS whole, floor(budget)::BIGINT % supply AS rest
  FROM s JOIN b3 USING (domain, language, source)),
r AS (SELECT t.*, whole, rest, ('0x' || substr(md5('{SEED}|' || whole || '|' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT AS draw
  FROM t JOIN l USING (domain, language, source)),
k AS (SELECT *, whole + CASE WHEN sum(tokens) OVER (PARTITION BY domain, language, source ORDER BY draw) <= rest THEN 1 ELSE 0 END AS n FROM r)
SELECT doc_id, unnest(range(0, n::BIGINT))::BIGINT AS epoch, domain, language, source, tokens::BIGINT AS tokens FROM k WHERE n > 0
"""
