"""Mixing sources to target weights by iterative proportional fitting, in DataFrame functions only.

Token weights of the cells (source, language, topic) are raked until their marginals meet the targets. The ratio of a
raked weight to the observed one calibrates the probability with which the cell's documents are sampled. Only cells are
iterated on; their number is that of categories, whatever the number of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from parlance.session import materialize

MARGINS = ("source", "lang", "topic")
#: Topics by the first pattern that a text holds; anything else is prose.
TOPICS = (("licence", r"[Ll]icen[sc]e"), ("contact", r"@[a-z0-9]|\+[0-9]"), ("markup", r"[#%&*$][#%&*$][#%&*$]"), ("loud", r"!!"))
REST = "prose"
MISSING = "(none)"
WORD = r"[^\x20\x09-\x0D]+"
#: Tempering of each marginal's observed shares: the target share is in proportion to share ** power.
POWERS = {"source": 0.7, "lang": 0.7, "topic": 0.8}
RATE, SWEEPS, CUTS, TOLERANCE, SEED = 0.8, 60, 60, 1e-11, "mix-1"
#: So many cells are raked in one row, which one task holds (about 100 bytes each); more of them in tables.
CELLS_IN_ROW = 200_000
#: Columns of the result, and those that it needs on the way: input columns of these names give way to them.
RESULTS = ("topic", "n_tokens", "probability", "kept", "_source", "_lang", "_topic", "_tokens", "_probability")
#: Cells up to this number are broadcast to the documents; more of them are joined by a shuffle.
BROADCAST_CELLS = 200_000


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with _source, _lang, _topic (never null) and _tokens, the number of its words."""
    whole = F.coalesce(F.col(text), F.lit(""))
    topic: Column = F.lit(REST)
    for name, pattern in reversed(TOPICS):
        topic = F.when(whole.rlike(pattern), name).otherwise(topic)
    return docs.withColumns(
        {
            "_source": F.coalesce(F.col("source").cast("string"), F.lit(MISSING)),
            "_lang": F.coalesce(F.col("lang").cast("string"), F.lit(MISSING)),
            "_topic": topic,
            "_tokens": F.regexp_count(whole, F.lit(WORD)).cast("long"),
        }
    )


def rake(cells: DataFrame, powers: dict[str, float] = POWERS, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """``cells(source, lang, topic, tokens)`` with ``share`` and ``raked``, whose marginals have the target shares.

    ``targets[margin]`` may give shares as (margin, share); else they come from the observed shares and ``powers``. A
    margin's value without a target has the goal 0. Cells without tokens keep weight 0. Up to ``CELLS_IN_ROW`` cells are
    raked in one row, in one job; more of them, as of host names, by windows in a written table for each sweep.
    """
    total, count = cells.agg(F.sum("tokens"), F.count("*")).first()
    cells = cells.withColumn("share", F.col("tokens") / F.lit(float(total or 1)))
    for m in MARGINS:
        observed = cells.groupBy(m).agg(F.sum("share").alias("w"))
        if targets and m in targets:
            goal = targets[m].select(m, F.col("share").alias(f"goal_{m}"))
        else:
            scale = observed.agg(F.sum(F.pow("w", F.lit(powers[m])))).first()[0] or 1.0
            goal = observed.select(m, (F.pow("w", F.lit(powers[m])) / F.lit(scale)).alias(f"goal_{m}"))
        cells = cells.join(goal, m, "left").fillna(0.0, [f"goal_{m}"])
    cells = materialize(cells, "cells")
    return _raked_in_a_row(cells) if count <= CELLS_IN_ROW else _raked_by_tables(cells)


def _raked_in_a_row(cells: DataFrame) -> DataFrame:
    """All sweeps as one fold over arrays.

    A raked weight is the cell's share times a factor for each of its three values. A sweep renews the factors of one
    margin after the other: goal / sum of share times the other two factors, over the cells that have the value.
    """
    first, second = {}, {}
    for m in MARGINS:
        values = cells.agg(F.sort_array(F.collect_set(m)).alias("v")).select(F.posexplode("v").alias(f"at_{m}", m))
        cells = cells.join(values, m)
        first[m], second[m] = (f"at_{n}" for n in MARGINS if n != m)
    cells = materialize(cells, "places")
    lists = None
    for m in MARGINS:
        entry = F.struct(F.col(first[m]).alias("i"), F.col(second[m]).alias("j"), F.col("share").alias("c"))
        own = cells.groupBy(f"at_{m}").agg(F.first(f"goal_{m}").alias("goal"), F.collect_list(entry).alias("cells"))
        own = own.select(F.lit(m).alias("margin"), F.struct(F.col(f"at_{m}").alias("at"), "goal", "cells").alias("value"))
        lists = own if lists is None else lists.union(own)
    # one row with an array of the values of each margin, in order
    row = lists.agg(*(F.sort_array(F.collect_list(F.when(F.col("margin") == m, F.col("value")))).alias(m) for m in MARGINS))

    def factors(m: str, i: Column, j: Column) -> Column:
        def factor(value: Column) -> Column:
            held = F.aggregate(value["cells"], F.lit(0.0), lambda acc, e: acc + e["c"] * F.get(i, e["i"]) * F.get(j, e["j"]))
            return F.when(held > 0, value["goal"] / held).otherwise(F.lit(0.0))

        return F.transform(F.col(m), factor)

    def one(acc: Column, name: str, value: Column) -> Column:
        return F.struct(*(value.alias(n) if n == name else acc[n].alias(n) for n in (*MARGINS, "miss")))

    def sweep(acc: Column, _: Column) -> Column:
        new = one(acc, "source", factors("source", acc["lang"], acc["topic"]))
        # a fold over one element names the value, so that it is worked out once
        new = F.aggregate(F.array(new), acc, lambda _a, x: one(x, "lang", factors("lang", x["source"], x["topic"])))
        new = F.aggregate(F.array(new), acc, lambda _a, x: one(x, "topic", factors("topic", x["source"], x["lang"])))
        moved = lambda x: F.zip_with(x["source"], acc["source"], lambda p, q: F.abs(p - q) / F.greatest(F.abs(p), F.lit(1e-300)))
        new = F.aggregate(F.array(new), acc, lambda _a, x: one(x, "miss", F.coalesce(F.array_max(moved(x)), F.lit(0.0))))
        return F.when(acc["miss"] < TOLERANCE, acc).otherwise(new)

    ones = F.struct(*(F.transform(F.col(m), lambda _: F.lit(1.0)).alias(m) for m in MARGINS), F.lit(1.0).alias("miss"))
    row = materialize(row.select(F.aggregate(F.sequence(F.lit(1), F.lit(SWEEPS)), ones, sweep).alias("f")), "factors")
    for m in MARGINS:
        found = row.select(F.posexplode(f"f.{m}").alias(f"at_{m}", f"factor_{m}"))
        cells = cells.join(found, f"at_{m}")
    raked = F.col("share") * F.col("factor_source") * F.col("factor_lang") * F.col("factor_topic")
    return cells.withColumn("raked", raked).drop(*(f"{x}_{m}" for m in MARGINS for x in ("at", "factor")))


def _raked_by_tables(cells: DataFrame) -> DataFrame:
    """Sweeps one by one, each a written table of cells."""
    cells, miss = cells.withColumn("raked", F.col("share")), Observation("miss")
    for k in range(SWEEPS):
        before = F.col("raked")
        for m in MARGINS:
            held = F.sum("raked").over(Window.partitionBy(m))
            cells = cells.withColumn("raked", F.when(held > 0, F.col("raked") * F.col(f"goal_{m}") / held).otherwise(F.lit(0.0)))
            if m == MARGINS[0]:
                cells = cells.withColumn("was", before) if k == 0 else cells
        miss = Observation(f"miss-{k}")
        cells = materialize(cells.observe(miss, F.max(F.abs(F.col("raked") - F.col("was"))).alias("gap")).withColumn("was", F.col("raked")), "cells")
        if (miss.get["gap"] or 0.0) < TOLERANCE:
            break
    return cells.drop("was")


def calibrated(docs: DataFrame, text: str = "text", rate: float = RATE) -> DataFrame:
    """source, lang, topic and the sampling probability of each cell; ``rate`` is the share of tokens to expect.

    Probabilities over 1 are cut there and the others raised, so that the expected share of tokens stays ``rate``.
    """
    rows = features(docs, text)
    cells = rows.groupBy(*(F.col(f"_{m}").alias(m) for m in MARGINS)).agg(F.sum("_tokens").cast("double").alias("tokens"))
    cells = rake(materialize(cells, "cells"))
    factor = F.when(F.col("share") > 0, F.col("raked") / F.col("share")).otherwise(F.lit(0.0))
    cells = materialize(cells.select(*MARGINS, "share", factor.alias("factor")), "factors")
    scale = rate
    for _ in range(CUTS):
        # the expected share grows with the scale in straight pieces: each step solves the piece that it is on
        cut = F.lit(scale) * F.col("factor") >= 1
        full, part = cells.agg(F.sum(F.when(cut, F.col("share"))), F.sum(F.when(~cut, F.col("share") * F.col("factor")))).first()
        if not part or (rate - (full or 0.0)) / part <= scale * (1 + 1e-12):
            break
        scale = (rate - (full or 0.0)) / part
    return cells.select(*MARGINS, F.least(F.lit(1.0), F.lit(scale) * F.col("factor")).alias("probability"))


def uniform(key: str = "doc_id", seed: str = SEED) -> Column:
    """A number in [0, 1) that the id and the seed fix."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double") / F.lit(float(16**12))


def mix(docs: DataFrame, text: str = "text", rate: float = RATE) -> DataFrame:
    """Every row of ``docs`` with topic, n_tokens, probability and kept.

    A document is kept if the number that its id fixes is below its cell's probability, whatever the partitioning, so
    repeated rows, and all rows without a doc_id in one cell, are kept or dropped together. Null sources and languages are categories of their own; texts without
    words weigh nothing and have probability 0 unless their cell has other documents. An empty table gives no rows.
    Columns named like a result column give way to it.
    """
    cells = calibrated(docs, text, rate)
    few = cells.count() <= BROADCAST_CELLS
    cells = cells.select(*(F.col(m).alias(f"_{m}") for m in MARGINS), F.col("probability").alias("_probability"))
    rows = features(docs, text).join(F.broadcast(cells) if few else cells, [f"_{m}" for m in MARGINS])
    result = {"topic": F.col("_topic"), "n_tokens": F.col("_tokens"), "probability": F.col("_probability"), "kept": uniform() < F.col("_probability")}
    return rows.withColumns(result).drop(*(f"_{m}" for m in MARGINS), "_tokens", "_probability")


def oracle() -> str:
    """The same by unrolled sweeps in SQL."""
    topic = "CASE " + " ".join(f"WHEN regexp_matches(coalesce(text, ''), '{p}') THEN '{n}'" for n, p in TOPICS) + f" ELSE '{REST}' END"
    parts = [
        f"d AS (SELECT doc_id, coalesce(source, '{MISSING}') AS source, coalesce(lang, '{MISSING}') AS lang, {topic} AS topic, "
        f"len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS n_tokens FROM documents)",
        "c0 AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM d GROUP BY ALL)",
        "c1 AS (SELECT *, tokens / sum(tokens) OVER () AS share, tokens / sum(tokens) OVER () AS raked FROM c0)",
    ]
    for m in MARGINS:
        parts.append(f"g_{m} AS (SELECT {m}, w / sum(w) OVER () AS goal FROM (SELECT {m}, pow(sum(raked), {POWERS[m]}) AS w FROM c1 GROUP BY {m}))")
    # one array step for each sweep keeps the text short: a recursive table over sweeps
    sweeps = " ".join(
        f"s_{m} AS (SELECT k, source, lang, topic, share, raked * goal / sum(raked) OVER (PARTITION BY {m}) AS raked FROM {before} JOIN g_{m} USING ({m})),"
        for m, before in zip(MARGINS, ("last", "s_source", "s_lang"))
    ).rstrip(",")
    parts.append(
        "ipf AS (SELECT 0 AS k, source, lang, topic, share, raked FROM c1 UNION ALL SELECT * FROM ("
        f"WITH last AS (SELECT * FROM ipf), {sweeps} SELECT k + 1 AS k, source, lang, topic, share, raked FROM s_topic WHERE k < 40))"
    )
    parts.append("f AS (SELECT source, lang, topic, share, raked / share AS factor FROM ipf WHERE k = 40)")
    parts.append(
        f"sc AS (SELECT 0 AS k, {RATE}::DOUBLE AS scale UNION ALL SELECT k + 1, scale * {RATE} / (SELECT sum(least(1.0, sc.scale * factor) * share) FROM f) FROM sc WHERE k < 40)"
    )
    parts.append("p AS (SELECT source, lang, topic, least(1.0, scale * factor) AS probability FROM f, (SELECT scale FROM sc WHERE k = 40))")
    unit = f"('0x' || substr(md5('{SEED}:' || doc_id::VARCHAR), 1, 12))::BIGINT / 281474976710656.0"
    return (
        "WITH RECURSIVE " + ", ".join(parts) + f" SELECT doc_id, source, lang, topic, n_tokens, round(probability, 6) AS probability, {unit} < probability AS kept FROM d JOIN p USING (source, lang, topic)"
    )
