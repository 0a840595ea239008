"""Mixing sources to target weights by iterative proportional fitting; DataFrame functions alone.

Documents are counted in tokens by cell (source, language, topic). The mixture is to have `keep` of all tokens, and of those
every source, language and topic its target share. Each group of a margin has a factor; a cell's weight is its tokens times
its groups' factors, at most its tokens (a document cannot be drawn twice). Margin after margin, every group's factor is
multiplied so that its cells meet its goal: by what cells that are taken whole leave of the goal over what the others give;
until no sum moves by more than SETTLED of its goal (ROUNDS rounds at most). A document is sampled with the probability weight / tokens of its cell. Where targets ask for more tokens
than a group has, or contradict each other, the group's tokens are all taken, or the margins are met as nearly as the
raking gets; shares() gives the goals beside what is expected.

Sums are partial aggregates by group and go back by joins, so no group's cells ever meet in one task. A round is one job
over the cells with their factors, which are written; joins broadcast sums only where their measured size allows it. The draw is a hash of doc_id, so it repeats.

Targets default to tempered shares, share ** ALPHA, which lift small groups and hold hot ones down.

Defined results: null source, language or topic is a group of its own ("(none)"); a null or empty text has no tokens,
and counts as one so that it can be sampled; a null doc_id draws by the text "null"; rows that repeat draw alike; a
target for a group that has no tokens is left out, a group without a target is not sampled; an empty table gives an empty
table; of the columns, the operator adds topic, tokens, probability and sampled, and replaces columns of those names.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused, written

ALPHA, KEEP, ROUNDS, SETTLED, MARGINS = 0.8, 0.7, 40, 1e-9, ("source", "lang", "topic")
WORD = "[^\\x20\\x09-\\x0D]+"
MOST = 1e12  # of a factor: all tokens of its cells are taken long before


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def form_topic(text: Column, tokens: Column) -> Column:
    """A stand-in topic where documents have none: what the text consists of, by signs per token."""
    bars = F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit("")))
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    digits = F.length(text) - F.length(F.translate(text, "0123456789", ""))
    return F.when(bars * 10 >= tokens, "table").when(digits * 2 >= tokens, "figures").when(lines * 20 >= tokens, "lines").otherwise("prose")


def goals(cells: DataFrame, margin: str, alpha: float, target: dict[str, float] | None, keep: float) -> DataFrame:
    """Rows (margin, goal): the tokens that the mixture is to have of each group that has tokens."""
    sums = cells.groupBy(margin).agg(F.sum("tokens").cast("double").alias("held"))
    total, groups = sums.agg(F.sum("held"), F.count("*")).first()
    if target is None:
        aim = F.pow(F.col("held") / (total or 1.0), F.lit(alpha))
    elif target:
        aim = F.coalesce(F.create_map(*[F.lit(x) for kv in target.items() for x in kv])[F.col(margin)], F.lit(0.0))
    else:
        aim = F.lit(0.0)
    aimed = written(sums.select(margin, aim.alias("aim")), "goals")
    whole = aimed.agg(F.sum("aim")).first()[0] or 1.0
    return aimed.select(margin, (F.col("aim") / whole * keep * (total or 0.0)).alias("goal"))


def rake(cells: DataFrame, margins: tuple[str, ...] = MARGINS, alpha: float = ALPHA, targets: dict[str, dict[str, float]] | None = None, keep: float = KEEP, rounds: int = ROUNDS) -> DataFrame:
    """cells (margins..., tokens), a table that is cheap to read again, with a column weight: expected tokens."""
    state = cells.select(*margins, "tokens")
    for m in margins:
        state = state.join(goals(cells, m, alpha, (targets or {}).get(m), keep), m)
        state = state.withColumnsRenamed({"goal": f"goal_{m}"}).withColumns({f"factor_{m}": F.lit(1.0), f"got_{m}": F.lit(-1.0)})
    state = written(state.withColumn("moved", F.lit(1.0)), "raking")
    tokens = F.col("tokens").cast("double")
    part = F.col(f"factor_{margins[0]}")
    for m in margins[1:]:
        part = part * F.col(f"factor_{m}")
    for _ in range(rounds):
        moved = F.lit(0.0)
        for m in margins:
            goal, full = F.col(f"goal_{m}"), F.coalesce(F.sum(F.when(part >= 1, tokens)), F.lit(0.0))
            sums = state.groupBy(m).agg(full.alias("full"), F.coalesce(F.sum(F.when(part < 1, tokens * part)), F.lit(0.0)).alias("open"))
            # What cells that are taken whole do not give, the others have to; if those are too much, all factors fall.
            ratio = F.when(goal > F.col("full"), F.coalesce(F.try_divide(goal - F.col("full"), F.col("open")), F.lit(1.0))).otherwise(F.coalesce(F.try_divide(goal, F.col("full") + F.col("open")), F.lit(0.0)))
            now = F.col("full") + F.col("open")
            moved = F.greatest(moved, F.coalesce(F.try_divide(F.abs(now - F.col(f"got_{m}")), goal), F.lit(0.0)))
            state = state.join(sums, m).withColumns({f"factor_{m}": F.least(F.col(f"factor_{m}") * ratio, F.lit(MOST)), f"_got_{m}": now, f"_moved_{m}": moved})
            state = state.drop("full", "open", f"got_{m}").withColumnRenamed(f"_got_{m}", f"got_{m}")
            moved = F.col(f"_moved_{m}")
        state = written(state.withColumn("moved", moved).drop(*[f"_moved_{m}" for m in margins]), "raking")
        last = state.agg(F.max("moved")).first()[0] or 0.0
        if last <= SETTLED:
            break
    else:
        warnings.warn(f"raking still moved a margin by {last:.2g} of its goal after {rounds} rounds", stacklevel=2)
    return state.select(*margins, "tokens", F.least(tokens, tokens * part).alias("weight"))


def shares(mixed: DataFrame, margin: str, alpha: float = ALPHA, target: dict[str, float] | None = None, keep: float = KEEP) -> DataFrame:
    """Of mix()'s rows, for each group of a margin: its goal in tokens, and what is expected of the draws."""
    named = F.coalesce(F.col(margin).cast("string"), F.lit("(none)")).alias(margin)
    held = written(mixed.groupBy(named).agg(F.sum("tokens").alias("tokens"), F.sum(F.col("tokens") * F.col("probability")).alias("expected")), "shares")
    return held.join(goals(held, margin, alpha, target, keep), margin).select(margin, "tokens", "goal", "expected")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", topic: Column | None = None, alpha: float = ALPHA, targets: dict[str, dict[str, float]] | None = None, keep: float = KEEP, rounds: int = ROUNDS) -> DataFrame:
    """docs with topic, tokens, probability and sampled."""
    kept = [c for c in docs.columns if c not in ("topic", "tokens", "probability", "sampled")]
    counted = docs.withColumn("tokens", F.greatest(token_count(F.col(text_col)), F.lit(1)))
    counted = counted.withColumn("topic", F.coalesce(topic if topic is not None else form_topic(F.coalesce(F.col(text_col), F.lit("")), F.col("tokens")), F.lit("(none)")))
    names = {m: unused(f"cell_{m}", counted.columns) for m in MARGINS}
    keys = [F.coalesce(F.col(m).cast("string"), F.lit("(none)")).alias(names[m]) for m in MARGINS]
    cells = written(counted.groupBy(*keys).agg(F.sum("tokens").alias("tokens")).toDF(*MARGINS, "tokens"), "cells")
    raked = written(rake(cells, alpha=alpha, targets=targets, keep=keep, rounds=rounds), "raked")
    chance = raked.select(*[F.col(m).alias(names[m]) for m in MARGINS], (F.col("weight") / F.col("tokens")).alias("probability"))
    # As many cells as groups occur: the join broadcasts them only where their measured size allows it.
    placed = counted.drop("probability", "sampled").select("*", *keys).join(chance, list(names.values()))
    draw = F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)
    return placed.select(*kept, "topic", "tokens", "probability", (draw < F.col("probability")).alias("sampled"))


def oracle(alpha: float = ALPHA, keep: float = KEEP, rounds: int = ROUNDS) -> str:
    """The same in DuckDB's SQL, over the table documents."""
    count = lambda sign: f"length(coalesce(text, '')) - length(replace(coalesce(text, ''), {sign}, ''))"
    steps = [
        f"d as (select doc_id, coalesce(source, '(none)') as source, coalesce(lang, '(none)') as lang, greatest(len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0b\\f\\r]+')), 1) as tokens, {count(chr(39) + '|' + chr(39))} as bars, {count('chr(10)')} as ends, length(coalesce(text, '')) - length(translate(coalesce(text, ''), '0123456789', '')) as digits from documents)",
        "e as (select *, case when bars * 10 >= tokens then 'table' when digits * 2 >= tokens then 'figures' when ends * 20 >= tokens then 'lines' else 'prose' end as topic from d)",
        "c as (select source, lang, topic, sum(tokens)::double as tokens from e group by all)",
        "g as (select *, sum(tokens) over () as total, " + ", ".join(f"pow(sum(tokens) over (partition by {m}) / sum(tokens) over (), {alpha}) as raw_{m}, tokens / sum(tokens) over (partition by {m}) as part_{m}" for m in MARGINS) + " from c)",
        "w0 as (select source, lang, topic, tokens, " + ", ".join(f"raw_{m} / sum(raw_{m} * part_{m}) over () * {keep} * total as goal_{m}, 1.0::double as f_{m}" for m in MARGINS) + " from g)",
    ]
    n, part = 0, " * ".join(f"f_{m}" for m in MARGINS)
    for _ in range(rounds):
        for m in MARGINS:
            full, free = (f"coalesce(sum(case when {part} {test} then {x} end) over (partition by {m}), 0)" for test, x in ((">= 1", "tokens"), ("< 1", f"tokens * ({part})")))
            steps.append(f"s{n + 1} as (select *, {full} as whole, {free} as free from w{n})")
            steps.append(f"w{n + 1} as materialized (select * exclude (whole, free) replace (least(f_{m} * case when goal_{m} > whole then case when free > 0 then (goal_{m} - whole) / free else 1 end else goal_{m} / (whole + free) end, {MOST!r}) as f_{m}) from s{n + 1})")
            n += 1
    steps.append(f"p as (select source, lang, topic, least(tokens, tokens * {part}) / tokens as probability from w{n})")
    return f"with {', '.join(steps)} select doc_id, topic, tokens::bigint as tokens, round(probability, 6) as probability, (('0x' || substr(md5(doc_id::varchar), 1, 13))::bigint::double / {float(1 << 52)!r}) < probability as sampled from e join p using (source, lang, topic)"
