"""Mixing sources to target weights by hierarchical budgeting.

The budget goes down a tree of domains, languages and sources. At every node it
is divided among the children by weight; a child gets no more than its subtree
can supply, and what it lacks goes to its siblings before anything is left to
the ancestors' other branches. A leaf then takes whole epochs of its documents
and a prefix, in seeded order, of one more.

Edge cases: null lang, source and text count as empty. A document without text
has no tokens; it is taken where the prefix has not been used up. Rows with one
doc_id in one leaf share their place and come or go together. Where the budget
exceeds all supply, every document is taken in every epoch. An empty table
gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelloom.llm.common import HOT_SHARE, cut_lineage, read, ready, whole_text

PARTS = 3  # hex digits that cut a leaf into 4,096 even parts


@dataclass(frozen=True)
class Mixture:
    """Production parameters. Names without a weight of their own have weight 1."""

    budget_share: float = 0.5  # of all tokens
    epochs: int = 2  # at most, of any document
    seed: int = 11
    domains: int = 3
    lang_weights: tuple[tuple[str, float], ...] = (("en", 4.0), ("de", 2.0), ("fr", 2.0))


def tokens_of() -> Column:
    """Size of a text in tokens of four bytes, a stand-in that needs no encoder."""
    return F.ceil(F.octet_length(whole_text()) / 4).cast("bigint")


def _name(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def leaf_columns(mixture: Mixture) -> list[Column]:
    """(domain, lang, source); sources belong to domains by a digest of their name."""
    number = F.conv(F.substring(F.md5(_name("source").cast("binary")), 1, 4), 16, 10).cast("int") % mixture.domains
    domain = F.concat(F.lit("domain"), number.cast("string"))
    return [domain.alias("domain"), _name("lang").alias("lang"), _name("source").alias("source")]


def _divide(nodes: DataFrame, by: list[str]) -> DataFrame:
    """Budget of each child (column ``budget``) from the parent's (``given``).

    Children in order of supply per weight: the first ones that cannot use
    their part are given all they have, the rest share what is left by weight.
    """
    order = Window.partitionBy(*by).orderBy(F.col("supply") / F.col("weight"), "child")
    before = F.coalesce(F.sum("supply").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    weights = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = (F.col("given") - F.col("_before")) / F.col("_weights")
    lacking = level * F.col("weight") >= F.col("supply")
    rest = Window.partitionBy(*by)
    left = F.col("given") - F.coalesce(F.sum(F.when(F.col("_lacking"), F.col("supply"))).over(rest), F.lit(0))
    open_weight = F.sum(F.when(~F.col("_lacking"), F.col("weight"))).over(rest)
    return (
        nodes.withColumns({"_before": before, "_weights": weights})
        .withColumn("_lacking", lacking)
        .withColumn(
            "budget",
            F.when(F.col("_lacking"), F.col("supply").cast("double")).otherwise(left * F.col("weight") / open_weight),
        )
        .drop("_before", "_weights", "_lacking", "given")
    )


def leaf_budgets(docs: DataFrame, mixture: Mixture) -> DataFrame:
    """(domain, lang, source, docs, tokens, full, rest): epochs taken whole, tokens of the next."""
    leaves = (
        docs.select(*leaf_columns(mixture), tokens_of().alias("tokens"))
        .groupBy("domain", "lang", "source")
        .agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs"))
        .withColumn("supply", F.col("tokens") * mixture.epochs)
    )
    supply = F.sum("supply").alias("supply")
    total = leaves.agg((F.floor(F.coalesce(F.sum("tokens"), F.lit(0)) * mixture.budget_share)).cast("double")).scalar()
    weights = dict(mixture.lang_weights)
    lang_weight = F.lit(1.0)
    for name, value in weights.items():
        lang_weight = F.when(F.col("lang") == name, value).otherwise(lang_weight)
    one = F.lit(1.0)
    domains = leaves.groupBy("domain").agg(supply).withColumns({"child": F.col("domain"), "weight": one, "given": total})
    domains = _divide(domains, []).select("domain", F.col("budget").alias("given"))
    langs = leaves.groupBy("domain", "lang").agg(supply).withColumns({"child": F.col("lang"), "weight": lang_weight})
    langs = _divide(langs.join(domains, "domain"), ["domain"]).select("domain", "lang", F.col("budget").alias("given"))
    sources = leaves.withColumns({"child": F.col("source"), "weight": one}).join(langs, ["domain", "lang"])
    got = F.round("budget").cast("bigint")
    divided = _divide(sources, ["domain", "lang"]).withColumn("budget", got)
    full = F.when(F.col("tokens") > 0, F.least(F.lit(mixture.epochs), F.floor(F.try_divide(F.col("budget"), F.col("tokens")))))
    return divided.withColumn("full", F.coalesce(full, F.lit(0)).cast("int")).select(
        "domain", "lang", "source", "docs", "tokens", "full", (F.col("budget") - F.col("full") * F.col("tokens")).alias("rest")
    )


def _order(epoch: Column, doc_id: Column, seed: int) -> Column:
    """Text whose order is the epoch's order of the documents."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def leaf_cuts(docs: DataFrame, mixture: Mixture) -> DataFrame:
    """(domain, lang, source, docs, full, last): the last place in the order that the prefix takes.

    Tokens are summed by part of the order first; only the part in which the
    prefix ends is looked at row by row, a few thousandths of a leaf.
    """
    keys = ["domain", "lang", "source"]
    budgets = cut_lineage(leaf_budgets(docs, mixture))
    total = budgets.agg(F.sum("docs")).first()[0] or 0
    open_leaves = budgets.where((F.col("rest") > 0) & (F.col("full") < mixture.epochs))
    large = F.col("docs") * HOT_SHARE > total
    hot, cold = (open_leaves.where(x).select(*keys, "full", "rest") for x in (large, ~large))
    narrow = docs.select(*leaf_columns(mixture), F.col("doc_id"), tokens_of().alias("tokens"))
    apart = narrow.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    placed = (
        narrow.join(F.broadcast(hot), keys)
        .unionByName(apart.join(cold, keys))
        .withColumn("place", _order(F.col("full"), F.col("doc_id"), mixture.seed))
        .withColumn("part", F.substring("place", 1, PARTS))
    )
    ahead = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        placed.groupBy(*keys, "part")
        .agg(F.sum("tokens").alias("n"), F.first("rest").alias("rest"))
        .withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
        .where("before < rest")
    )
    cut = parts.groupBy(*keys).agg(F.max_by(F.struct("part", "before"), "part").alias("c")).select(*keys, "c.*")
    inside = (
        placed.join(cut, [*keys, "part"])
        .groupBy(*keys, "place", "before", "rest")
        .agg(F.sum("tokens").alias("n"))
        .withColumn(
            "sofar",
            F.coalesce(
                F.sum("n").over(Window.partitionBy(*keys).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)),
                F.lit(0),
            ),
        )
        .where(F.col("before") + F.col("sofar") < F.col("rest"))
    )
    last = inside.groupBy(*keys).agg(F.max("place").alias("last"))
    return budgets.select(*keys, "docs", "full").join(last, keys, "left")


def free_name(docs: DataFrame, wanted: str) -> str:
    """A name that no column of the documents has, upper and lower case alike."""
    taken = {c.lower() for c in docs.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def mix(docs: DataFrame, mixture: Mixture, epoch: str = "_epoch") -> DataFrame:
    """Rows of ``docs`` once per epoch in which they are taken, with the epoch as one more column.

    Whether a row is taken depends on its leaf's row alone. Leaves with more
    than 1/HOT_SHARE of the documents, at most HOT_SHARE, reach their rows by
    broadcast, so that these rows stay where they are; the others are joined.
    Leaves travel as one struct of a free name, so that no column clashes.
    """
    name = free_name(docs, "_leaf")
    cuts = cut_lineage(leaf_cuts(docs, mixture))
    total = cuts.agg(F.sum("docs")).first()[0] or 0
    large = F.col("docs") * HOT_SHARE > total
    hot, cold = (cuts.where(x).select(F.struct(*cuts.columns).alias(name)) for x in (large, ~large))
    leaf = {c: F.col(f"{name}.{c}") for c in cuts.columns}
    domain, lang, source = leaf_columns(mixture)
    same = (leaf["domain"] == domain) & (leaf["lang"] == lang) & (leaf["source"] == source)
    next_one = F.coalesce(_order(leaf["full"], F.col("doc_id"), mixture.seed) <= leaf["last"], F.lit(False))
    far = docs.join(F.broadcast(hot), same, "left_anti").join(cold, same)
    rows = docs.join(F.broadcast(hot), same).unionByName(far).withColumn(name, leaf["full"] + next_one.cast("int"))
    return rows.where(F.col(name) > 0).withColumn(epoch, F.explode(F.sequence(F.lit(0), F.col(name) - 1))).drop(name)


def op2_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, epoch, domain, lang, source, tokens) of every document taken."""
    mixture = Mixture()
    docs = read(spark, folder, "documents")
    return mix(docs, mixture).select(
        "doc_id", F.col("_epoch").alias("epoch"), *leaf_columns(mixture), tokens_of().alias("tokens")
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mixture, a document once per epoch in which it is taken."""
    ready(spark)
    epoch = free_name(docs, "_epoch")
    return mix(docs, Mixture(), epoch).drop(epoch)


def _sql_divide(name: str, source: str, by: str) -> str:
    part = f"PARTITION BY {by}" if by else ""
    order = f"({part} ORDER BY supply / weight, child"
    return f"""
{name}_a AS (
  SELECT *, coalesce(sum(supply) OVER {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior,
         sum(weight) OVER {order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights
  FROM {source}
),
{name}_b AS (SELECT *, (given - prior) / weights * weight >= supply AS lacking FROM {name}_a),
{name} AS (
  SELECT * EXCLUDE (given), CASE WHEN lacking THEN CAST(supply AS DOUBLE) ELSE
    (given - coalesce(sum(CASE WHEN lacking THEN supply END) OVER ({part}), 0)) * weight
    / sum(CASE WHEN NOT lacking THEN weight END) OVER ({part}) END AS budget
  FROM {name}_b
)"""


def oracle(m: Mixture = Mixture()) -> str:
    weight = "CASE lang " + " ".join(f"WHEN '{n}' THEN {w}" for n, w in m.lang_weights) + " ELSE 1.0 END"
    return f"""
WITH rows AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, 'domain' || (CAST('0x' || substr(md5(coalesce(source, '')), 1, 4) AS INTEGER) % {m.domains}) AS domain,
         CAST(ceil(octet_length(encode(coalesce(text, ''))) / 4) AS BIGINT) AS tokens
  FROM documents
),
leaves AS (
  SELECT domain, lang, source, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(tokens) AS BIGINT) * {m.epochs} AS supply
  FROM rows GROUP BY ALL
),
d AS (
  SELECT domain, sum(supply) AS supply, domain AS child, 1.0::DOUBLE AS weight,
         (SELECT CAST(floor(sum(tokens) * {m.budget_share}::DOUBLE) AS DOUBLE) FROM leaves) AS given
  FROM leaves GROUP BY domain
),{_sql_divide('dd', 'd', '')},
l AS (
  SELECT domain, lang, sum(supply) AS supply, lang AS child, ({weight})::DOUBLE AS weight, any_value(budget) AS given
  FROM leaves JOIN (SELECT domain, budget FROM dd) USING (domain) GROUP BY domain, lang
),{_sql_divide('ll', 'l', 'domain')},
s AS (
  SELECT leaves.*, source AS child, 1.0::DOUBLE AS weight, budget AS given
  FROM leaves JOIN (SELECT domain, lang, budget FROM ll) USING (domain, lang)
),{_sql_divide('ss', 's', 'domain, lang')},
got AS (
  SELECT domain, lang, source, tokens, CAST(round(budget) AS BIGINT) AS whole,
         CASE WHEN tokens > 0 THEN least({m.epochs}, CAST(round(budget) AS BIGINT) // tokens) ELSE 0 END AS taken
  FROM ss
),
orders AS (
  SELECT rows.*, taken, whole - taken * got.tokens AS rest,
         md5('{m.seed}:' || taken || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS place
  FROM rows JOIN got USING (domain, lang, source)
),
cuts AS (
  SELECT *, coalesce(sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY place
                     RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE TIES), 0) - tokens AS sofar
  FROM orders
),
counted AS (
  SELECT *, taken + CASE WHEN taken < {m.epochs} AND rest > 0 AND sofar < rest THEN 1 ELSE 0 END AS times FROM cuts
)
SELECT doc_id, CAST(unnest(range(times)) AS INTEGER) AS epoch, domain, lang, source, tokens FROM counted WHERE times > 0
"""
