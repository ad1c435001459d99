"""Mixing sources to target weights by iterative proportional fitting, with DataFrame
functions alone.

Tokens are summed per cell (one value of each margin). The cells' weights are scaled, one
margin after the other, until every margin has its target shares; the result is the closest
mixture to the given one that has them. A document's probability is its cell's weight by
its cell's tokens, scaled until the sample has the asked part of all tokens. Cells that would
need more than all their documents are taken whole and the others make up for them, so a value
of a single document changes the sample by no more than that document's weight.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from likeness.llm.common import key, spare
from likeness.session import cut

MARGINS = ("source", "lang", "topic")
# Targets of the registered query: each share is raised to this power, so that large
# sources, languages and topics give way to small ones.
TEMPERS = {"source": 0.7, "lang": 0.8, "topic": 0.9}
SWEEPS = 6
# The part of all tokens that a sample has.
KEEP = 0.5
# How far off a margin's share may be after the last sweep, as a part of the share.
TOLERANCE = 0.01
# What tells a topic, the first that is found.
TOPICS = (
    ("legal", r"(?i)\blicen[cs]ed? |copyright"),
    ("contact", r"[A-Za-z0-9.]+@[A-Za-z0-9]+\.[a-z]"),
    ("table", r" \| "),
    ("markup", r"[#*$%&]{3}"),
    ("shout", r"!! [A-Z]"),
)
NO_VALUE = "(none)"


def topic_of(text: Column) -> Column:
    found = F.lit(None).cast("string")
    for topic, regex in reversed(TOPICS):
        found = F.when(F.coalesce(text, F.lit("")).rlike(regex), topic).otherwise(found)
    return F.coalesce(found, F.lit("prose"))


def tokens_of(text: Column) -> Column:
    """Tokens as a quarter of the UTF-8 bytes, at least 1; null texts have 1."""
    return F.greatest(F.lit(1), F.ceil(F.octet_length(F.coalesce(text, F.lit(""))) / 4)).cast("long")


def value(column: str) -> Column:
    """A margin's value as text; null is a value of its own."""
    return F.coalesce(F.col(key(column)).cast("string"), F.lit(NO_VALUE))


def shares(cells: DataFrame, margin: str, target: float | Mapping[str, float]) -> DataFrame:
    """(value, share): the target shares of a margin over the values that occur, in any
    unit; a common factor of one margin's shares is a common factor of all weights."""
    found = cells.groupBy(F.col(margin).alias("value")).agg(F.sum("tokens").alias("n"))
    if isinstance(target, Mapping):
        wanted = F.create_map(*[F.lit(x) for pair in target.items() for x in pair])
        return found.select("value", F.coalesce(wanted[F.col("value")], F.lit(0.0)).alias("share"))
    return found.select("value", F.pow(F.col("n").cast("double"), F.lit(target)).alias("share"))


def raked(cells: DataFrame, targets: Mapping, sweeps: int = SWEEPS) -> DataFrame:
    """``cells`` (margins, tokens) with ``weight``. The number of cells is the product of
    the margins' values at most; every scaling is a grouped sum and a join on it."""
    columns, now = cells.columns, cells.withColumn("weight", F.col("tokens").cast("double"))
    for margin, target in targets.items():
        shared = shares(cells, margin, target).withColumnRenamed("share", f"share_{margin}")
        now = now.join(shared, now[margin] == shared["value"]).drop("value")
    wanted = [F.col(f"share_{margin}") for margin in targets]
    now = cut(now)
    for _ in range(sweeps):
        for margin in targets:
            held = now.groupBy(F.col(margin).alias("of")).agg(F.sum("weight").alias("held"))
            scale = F.when(F.col("held") > 0, F.col(f"share_{margin}") / F.col("held"))
            now = now.join(held, now[margin] == held["of"]).select(
                *columns, *wanted, (F.col("weight") * F.coalesce(scale, F.lit(0.0))).alias("weight")
            )
        now = cut(now)
    return now.select(*columns, "weight")


def gap(weighed: DataFrame, targets: Mapping) -> float:
    """By how much a margin's share is off its target at most, as a part of the target."""
    worst = 0.0
    for margin, target in targets.items():
        wanted = shares(weighed, margin, target).filter("share > 0")
        held = weighed.groupBy(F.col(margin).alias("value")).agg(F.sum("weight").alias("held"))
        both = wanted.join(held, "value")
        whole = both.agg(F.sum("share").alias("shares"), F.sum("held").alias("weights")).first()
        if whole["shares"] and not whole["weights"]:
            return 1.0
        if whole["shares"]:
            part = F.col("held") / whole["weights"] / (F.col("share") / whole["shares"])
            worst = max(worst, both.agg(F.max(F.abs(part - 1))).first()[0])
    return worst


def scale_for(weighed: DataFrame, keep: float) -> float:
    """The factor of all weights at which the cells, none with more than its tokens, have the
    part ``keep`` of all tokens together. Each step takes those that are full as full; there
    are no more steps than cells, and mostly a few."""
    full = F.col("weight") * F.lit(0.0) >= F.col("tokens")
    whole = weighed.agg(F.sum("tokens").alias("tokens")).first()["tokens"] or 0
    seen = -1
    while True:
        facts = weighed.filter("weight > 0").agg(
            F.count_if(full).alias("n"),
            F.sum(F.when(full, F.col("tokens")).otherwise(0)).alias("taken"),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("rest"),
        ).first()
        if not facts["rest"]:
            return math.inf
        scale = (keep * whole - facts["taken"]) / facts["rest"]
        if facts["n"] == seen:
            return scale
        seen = facts["n"]
        full = F.col("weight") * F.lit(scale) >= F.col("tokens")


def uniform(id: Column, seed: int) -> Column:
    """A number from 0 to 1 that depends on the id alone."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(id.cast("string"), F.lit(NO_VALUE))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def with_mixture(
    docs: DataFrame,
    targets: Mapping[str, float | Mapping[str, float]],
    tokens: str,
    id: str = "doc_id",
    seed: int = 17,
    sweeps: int = SWEEPS,
    names: tuple[str, str] = ("probability", "sampled"),
    keep: float | None = None,
    strict: bool = False,
) -> DataFrame:
    """``docs`` with the probability of each and whether it is in the sample.

    The sample is expected to have the part ``keep`` of all tokens; by default it is as large
    as it can be with no cell short of its share. If a margin is more than TOLERANCE off its
    shares after the last sweep, as it is where the targets contradict each other, that is a
    warning that tells the gap, or with ``strict`` an error.

    ``targets`` names the margin columns, each with a power that tempers its shares or with
    the shares themselves; shares of values that do not occur go to the others, and values
    without a share get probability 0. A null value is a value of its own. Rows with one id
    share their fate, and so do rows without id. A null, zero or negative token count adds
    nothing to its cell. An empty table gives an empty one. The cells are a small table,
    one row for each combination of values, so documents of a source that holds a third of
    all rows are not brought together.
    """
    for name in names:
        if spare(docs, name) != name:
            raise ValueError(f"documents have a column {name!r} already")
    margins = {margin: f"margin{i}" for i, margin in enumerate(targets)}
    cells = docs.groupBy(*[value(m).alias(c) for m, c in margins.items()]).agg(
        F.sum(F.greatest(F.col(key(tokens)), F.lit(0))).alias("tokens")
    )
    own_targets = {margins[m]: target for m, target in targets.items()}
    weighed = raked(cut(cells), own_targets, sweeps)
    missed = gap(weighed, own_targets)
    if missed > TOLERANCE:
        told = f"a share is off its target by {missed:.1%} of it after {sweeps} sweeps"
        if strict:
            raise ValueError(told)
        warnings.warn(told, stacklevel=2)
    rate = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(0.0)
    if keep is None:
        (top,) = weighed.agg(F.max(rate)).first()
        rate = rate / F.lit(top or 1.0)
    elif (scale := scale_for(weighed, keep)) == math.inf:
        rate = (rate > 0).cast("double")
    else:
        full = (rate > 0) & (F.col("weight") * F.lit(scale) >= F.col("tokens"))
        rate = F.when(full, 1.0).otherwise(F.lit(scale) * rate)
    rates = weighed.select(*margins.values(), rate.alias("rate"))
    own = {c: spare(docs, c) for c in margins.values()}
    rate = spare(docs, "rate")
    rates = rates.select(*[F.col(c).alias(own[c]) for c in own], F.col("rate").alias(rate))
    met = [value(m).eqNullSafe(F.col(key(own[c]))) for m, c in margins.items()]
    joined = docs.join(rates, [*met[:-1], met[-1]], "left")
    chance = F.round(F.coalesce(F.col(key(rate)), F.lit(0.0)), 9)
    probability, sampled = names
    found = joined.select(*[docs[key(c)] for c in docs.columns], chance.alias(probability))
    return found.withColumn(sampled, uniform(F.col(key(id)), seed) < F.col(probability))


def documents_with_margins(docs: DataFrame, topic: str = "topic", tokens: str = "tokens") -> DataFrame:
    text = F.col("text")
    return docs.withColumn(topic, topic_of(text)).withColumn(tokens, tokens_of(text))


def sample(
    docs: DataFrame, tempers: Mapping[str, float] = TEMPERS, keep: float | None = KEEP
) -> DataFrame:
    """The documents in the sample, with their columns."""
    topic, tokens, probability, sampled = (
        spare(docs, n) for n in ("topic", "tokens", "probability", "sampled")
    )
    ready = documents_with_margins(docs, topic, tokens)
    targets = {topic if m == "topic" else m: t for m, t in tempers.items()}
    mixed = with_mixture(ready, targets, tokens, names=(probability, sampled), keep=keep)
    return mixed.filter(F.col(sampled)).select(*[key(c) for c in docs.columns])


def sql_mixture(
    tempers: Mapping[str, float] = TEMPERS, sweeps: int = SWEEPS, seed: int = 17, keep: float = KEEP
) -> str:
    """The registered query in DuckDB SQL: one common table for each scaling. By falling rate,
    the first cell that is not full when all before it are gives the factor of all weights."""
    cases = " ".join(
        f"WHEN regexp_matches(coalesce(text, ''), '{regex}') THEN '{topic}'" for topic, regex in TOPICS
    )
    steps = [
        f"""docs AS MATERIALIZED (
        SELECT doc_id, coalesce(source, '{NO_VALUE}') AS source, coalesce(lang, '{NO_VALUE}') AS lang,
               CASE {cases} ELSE 'prose' END AS topic,
               greatest(1, CAST(ceil(strlen(coalesce(text, '')) / 4.0) AS BIGINT)) AS tokens
        FROM documents)""",
        """w0 AS MATERIALIZED (
        SELECT source, lang, topic, sum(tokens) AS tokens, CAST(sum(tokens) AS DOUBLE) AS weight
        FROM docs GROUP BY ALL)""",
    ]
    for margin, power in tempers.items():
        steps.append(
            f"""t_{margin} AS MATERIALIZED (
        SELECT {margin}, n / sum(n) OVER () AS share FROM (
            SELECT {margin}, pow(CAST(sum(tokens) AS DOUBLE), {power}) AS n FROM w0 GROUP BY 1))"""
        )
    turn = 0
    for _ in range(sweeps):
        for margin in tempers:
            steps.append(
                f"""w{turn + 1} AS MATERIALIZED (
        SELECT source, lang, topic, tokens,
               weight * (share / sum(weight) OVER (PARTITION BY {margin})) AS weight
        FROM w{turn} JOIN t_{margin} USING ({margin}))"""
            )
            turn += 1
    order = "ORDER BY weight / tokens DESC, source, lang, topic ROWS BETWEEN"
    steps.append(
        f"""taken AS (
        SELECT weight, tokens, sum(tokens) OVER () AS whole,
               sum(tokens) OVER ({order} UNBOUNDED PRECEDING AND CURRENT ROW) - tokens AS before,
               sum(weight) OVER ({order} CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
        FROM w{turn} WHERE weight > 0)"""
    )
    steps.append(
        f"""factor AS (
        SELECT arg_max(({keep} * whole - before) / rest, weight / tokens) AS s FROM taken
        WHERE weight * (({keep} * whole - before) / rest) < tokens)"""
    )
    steps.append(
        f"""rates AS (
        SELECT *, round(CASE WHEN weight = 0 THEN 0 WHEN s IS NULL OR weight * s >= tokens THEN 1
          ELSE s * (weight / tokens) END, 9) AS chance FROM w{turn}, factor)"""
    )
    digest = f"('0x' || substr(md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '{NO_VALUE}')), 1, 8))"
    return f"""WITH {", ".join(steps)}
    SELECT doc_id, topic, d.tokens, chance AS probability,
           CAST({digest} AS BIGINT) / 4294967296.0 < chance AS sampled
    FROM docs d JOIN rates USING (source, lang, topic)"""
