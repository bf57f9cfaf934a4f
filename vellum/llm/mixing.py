"""Mixing to target weights by iterative proportional fitting, in DataFrame operations only.

Documents fall into cells by source, language and topic.  The cells' token counts are raked: in
turn each marginal is scaled to its target until all three agree.  A cell's ratio is its
raked share over its own share; a document is drawn with probability min(1, KEEP * ratio),
by a hash of its doc_id, so reruns draw the same.  Its weight is ratio over probability, so weighted token counts of
the drawn documents meet the targets in expectation even where a probability is cut at one.
``sampled`` gives no weights: there a document of KEEP * ratio above one is repeated instead.

Targets are the corpus' own shares raised to TEMPER and normalised (below one flattens), or
given shares; values that are not named share what the named ones leave, by their own shares.

Counting combines before the shuffle, so a hot source costs one row a task; all later steps
work on the cells, and only the last join meets the documents, with the cell table broadcast
where Spark finds it small and split at hot cells where not.

Defined cases: null source, language and topic are categories of their own; a null or empty text has no tokens
and gets its cell's probability (1 where the cell has no tokens at all); rows without doc_id draw by
their text; repeated rows are drawn alike; other columns stay; an empty table gives an empty result.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, staged

#: Sweeps at most, and the relative change of a factor under which they end.
SWEEPS, TOLERANCE = 100, 1e-4
KEEP = 0.9
TEMPER = 0.7
DIMENSIONS = ("source", "lang", "topic")

#: The topic of a text by its form, in order of precedence; the same text is SQL for both engines.
TOPIC = """case when text is null or text = '' then 'empty'
 when contains(text, 'icense') or contains(text, 'opyright') then 'legal'
 when contains(text, '@') or contains(text, '+1 (') then 'contact'
 when contains(text, ' | ') then 'table'
 when length(text) < 600 then 'brief'
 when length(text) >= 6000 then 'longform'
 else 'general' end"""

#: Tokens of a text for weighing: one and one more for each blank.
TOKENS = "case when text is null or text = '' then 0 else 1 + length(text) - length(replace(replace(text, ' ', ''), '\n', '')) end"


def cells(docs: DataFrame) -> DataFrame:
    """Rows (source, lang, topic, tokens) with the token count of each cell."""
    return docs.groupBy(*DIMENSIONS).agg(F.sum(F.expr(TOKENS)).cast("double").alias("tokens"))


def _goals(own: DataFrame, dimension: str, given: dict[str, float] | None) -> DataFrame:
    """Rows (dimension, goal, factor): each category's target share, and one as its first factor."""
    mine = own.groupBy(dimension).agg(F.sum("own").alias("own"))
    if given:
        named = F.coalesce(*[F.when(F.col(dimension) == k, F.lit(float(v))) for k, v in given.items()])
        goal = F.coalesce(named, F.col("own") * F.lit(max(0.0, 1.0 - sum(given.values()))))
    else:
        goal = F.pow("own", F.lit(TEMPER))
    told = mine.select(dimension, goal.alias("goal"))
    total = told.agg(F.sum("goal")).first()[0] or 1.0
    return staged(told.select(dimension, (F.col("goal") / total).alias("goal"), F.lit(1.0).alias("factor")), f"mixing-{dimension}")


def _with_factors(own: DataFrame, goals: dict[str, DataFrame], dimensions: list[str]) -> DataFrame:
    """``own`` with the product of the dimensions' factors as ``share``."""
    share = F.col("own")
    for d in dimensions:
        other = goals[d].select(F.col(d).alias(f"_{d}"), F.col("factor").alias(f"_f_{d}"))
        own = own.join(other, F.col(d).eqNullSafe(F.col(f"_{d}")))
        share = share * F.col(f"_f_{d}")
    return own.withColumn("share", share)


def raked(table: DataFrame, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """``table`` of ``cells`` with each cell's ratio of raked to own share.

    A cell's share is its own times one factor for each dimension; in turn each dimension's factors are set so that
    its marginal is its target.  Marginals are sums that combine before the shuffle, joined back by category, so neither
    the cells nor a category ever meet in one task.  Sweeps end when no marginal that a whole sweep left
    behind is off its target by more than TOLERANCE of it, at the latest after SWEEPS; one number a sweep reaches the driver.
    Targets are normalised over the categories present, so a named category without tokens gives its share to the others.
    """
    cell = staged(table.where("tokens > 0"), "mixing-cells")
    total = cell.agg(F.sum("tokens")).first()[0] or 1.0
    own = cell.withColumn("own", F.col("tokens") / F.lit(total))
    goals = {d: _goals(own, d, (targets or {}).get(d)) for d in DIMENSIONS}
    for _ in range(SWEEPS):
        for d in DIMENSIONS:
            others = _with_factors(own, goals, [x for x in DIMENSIONS if x != d]).groupBy(F.col(d).alias("_c")).agg(F.sum("share").alias("_now"))
            told = goals[d].join(others, F.col(d).eqNullSafe(F.col("_c")))
            new = staged(told.select(d, "goal", F.expr("coalesce(try_divide(goal, _now), 0D) as factor"), F.expr("try_divide(goal, _now * factor) - 1 as off")), f"mixing-{d}")
            discard(goals[d])
            goals[d] = new
        moved = functools.reduce(DataFrame.union, (g.select("off") for g in goals.values()))
        if (moved.agg(F.max(F.abs("off"))).first()[0] or 0.0) <= TOLERANCE:
            break
    return _with_factors(own, goals, list(DIMENSIONS)).select(*DIMENSIONS, "tokens", "own", "share", (F.col("share") / F.col("own")).alias("ratio"))


def draw() -> Column:
    """A number in [0, 1) from the document's id, or its text where it has none."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.coalesce("text", F.lit(""))))
    digest = F.substring(F.md5(F.concat(F.lit("mix:"), key).cast("binary")), 1, 12)
    return F.conv(digest, 16, 10).cast("double") / F.lit(float(16**12))


def weighed(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, topic: str = TOPIC) -> DataFrame:
    """``docs`` with mix_topic, mix_ratio, mix_p (probability), mix_weight and mix_kept."""
    lost = [c for c in ("mix_topic", "mix_ratio", "mix_p", "mix_weight", "mix_kept") if c in docs.columns]
    rows = docs.drop(*lost).withColumn("mix_topic", F.expr(topic))
    named = rows.select("text", "source", "lang", F.col("mix_topic").alias("topic"))
    ratios = raked(cells(named), targets).selectExpr("source as _s", "lang as _l", "topic as _t", "ratio as mix_ratio")
    ratios = staged(ratios, "mixing-ratios")  # its size is known when the join is planned, so texts move only where it is large
    same = F.col("source").eqNullSafe(F.col("_s")) & F.col("lang").eqNullSafe(F.col("_l")) & F.col("mix_topic").eqNullSafe(F.col("_t"))
    found = rows.join(ratios, same, "left").drop("_s", "_l", "_t").withColumn("mix_ratio", F.coalesce("mix_ratio", F.lit(1 / KEEP)))
    found = found.withColumn("mix_p", F.least(F.lit(1.0), F.col("mix_ratio") * KEEP))
    return found.withColumn("mix_weight", F.col("mix_ratio") / F.col("mix_p")).withColumn("mix_kept", draw() < F.col("mix_p"))


def sampled(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """The drawn documents, with the columns of ``docs``: their plain token counts meet the targets in expectation.

    A document of expected count KEEP * ratio comes as often as the whole part says, and once more
    with the rest as its probability; so what a probability of one cannot give comes as repeated rows.
    """
    found = weighed(docs, targets).withColumn("_expected", F.col("mix_ratio") * KEEP).withColumn("_whole", F.floor("_expected"))
    times = (F.col("_whole") + (draw() < F.col("_expected") - F.col("_whole")).cast("long")).cast("int")
    return found.withColumn("_times", times).where("_times > 0").withColumn("_time", F.explode(F.sequence(F.lit(1), "_times"))).select(*docs.columns)


def sql(documents: str = "documents") -> str:
    """The same as ``weighed`` with the default targets, as DuckDB SQL over a table of documents."""
    kept = f"source, lang, topic, own, {', '.join(f'goal_{d}' for d in DIMENSIONS)}"
    turn = [f"case step % 3 when 0 then {a} when 1 then {b} else {c} end" for a, b, c in (tuple(DIMENSIONS), tuple(f"goal_{d}" for d in DIMENSIONS))]
    steps = [
        f"named as (select *, {TOPIC} as topic from {documents})",
        f"cells as (select source, lang, topic, cast(sum({TOKENS}) as double) as tokens from named group by all)",
        "s0 as (select *, tokens / sum(tokens) over () as own from cells where tokens > 0)",
        "s1 as (select *, " + ", ".join(f"sum(own) over (partition by {d}) as own_{d}, count(*) over (partition by {d}) as size_{d}" for d in DIMENSIONS) + " from s0)",
        "s2 as (select *, " + ", ".join(f"power(own_{d}, {TEMPER}) / sum(power(own_{d}, {TEMPER}) / size_{d}) over () as goal_{d}" for d in DIMENSIONS) + " from s1)",
        f"r as (select 0 as step, {kept}, own as share, 0.0::double as off from s2 union all"
        f" select step + 1, {kept}, share * told, greatest(if(step % 3 = 0, 0, off), max(abs(told - 1)) over ()) from (select *, ({turn[1]}) / sum(share) over (partition by {turn[0]}) as told from r)"
        f" where step < {3 * SWEEPS} and (step = 0 or step % 3 > 0 or off > {TOLERANCE}))",
        "last as (select * from r where step = (select max(step) from r))",
    ]
    steps.append(
        f"w as (select n.*, coalesce(r.share / r.own, 1 / {KEEP}) as mix_ratio from named n left join last r"
        " on n.source is not distinct from r.source and n.lang is not distinct from r.lang and n.topic is not distinct from r.topic)"
    )
    steps.append(
        f"m as (select *, least(1.0, mix_ratio * {KEEP}) as mix_p, cast(('0x' || substr(md5('mix:' || coalesce(cast(doc_id as varchar), 'text:' || coalesce(text, ''))), 1, 12)) as bigint) / {float(16**12)} as mix_u from w)"
    )
    return "with recursive " + ",\n".join(steps)
