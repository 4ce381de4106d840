"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of source x language x topic. The cells' token mass is
raked in turn to the three target marginals until all hold within ``TOLERANCE``. If they
don't after ``MOST_ROUNDS``, as where empty cells make the targets contradict each other,
no fit holds: the cells are those of the first ``ROUNDS``, a warning is given, and
``_margin_error`` is the largest share of all mass by which a margin misses. The ratio of raked to
found mass is a cell's weight. Inclusion probabilities are proportional to the
weights, at most one, and scaled so that the expected mass kept is the budget. A
document is kept if the uniform number that its doc_id hashes to lies below its
probability, so a rerun keeps the same documents.

Only cells are iterated, on the driver up to ``DRIVER_CELLS`` of them and in Spark
beyond; documents are read once to fill them and once to be
sampled, and are joined to the cells without moving them while the cell table is
small.

Defined cases: a missing source, language or topic is the category ``unknown``; a
document weighs at least one token, also without text; categories that a target
names but nobody has are left out, categories that it doesn't name keep their found
share; repeated rows share a decision; a missing id hashes like an empty text; an
empty table gives no rows.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.store import stored
from plumbline.llm.text import broadcast_if_small, packed, unpacked

DIMENSIONS = ("source", "lang", "topic")
#: Production targets: a power of the found share, or shares by name.
TARGETS: dict[str, float | dict[str, float]] = {"source": 0.5, "lang": {"en": 0.6, "de": 0.15, "fr": 0.15, "es": 0.1}, "topic": 0.7}
#: Share of the token mass to keep, in expectation.
BUDGET = 0.5
#: Rounds that the DuckDB text writes out, and of the fit that is given where none holds.
ROUNDS = 40
#: Rounds after which no fit is held to exist.
MOST_ROUNDS = 20_000
DRIVER_CELLS = 100_000
TOLERANCE = 1e-9
WORD = "[^\\x20\\x09-\\x0D]+"


def topic_of(text: Column) -> Column:
    """A plain topic rule for corpora without a topic column."""
    return (
        F.when(F.contains(text, F.lit("icense")), "legal")
        .when(F.contains(text, F.lit("@")), "contact")
        .when(F.contains(text, F.lit("password")) | F.contains(text, F.lit("AKIA")), "credentials")
        .otherwise("prose")
    )


def _categories(topic: Column | None) -> list[Column]:
    topic = topic_of(F.col("text")) if topic is None else topic
    named = {"source": F.col("source"), "lang": F.col("lang"), "topic": topic}
    return [F.coalesce(column.cast("string"), F.lit("unknown")).alias(f"_{name}") for name, column in named.items()]


def _mass(text: Column) -> Column:
    return F.greatest(F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)), F.lit(1)).cast("long")


def _uniform(doc_id: Column, text: Column) -> Column:
    """A number in [0, 1) from the id, or where it is missing from the text."""
    nameless = F.concat(F.lit("text:"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    digest = F.md5(F.coalesce(doc_id.cast("string"), nameless).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def _with_targets(cells: DataFrame, targets: dict) -> DataFrame:
    """Adds _t_<dimension>: the mass that the cell's category is to have."""
    whole = cells.agg(F.sum("_mass")).first()[0]
    for name in DIMENSIONS:
        target, key = targets[name], f"_{name}"
        found = F.sum("_mass") / F.lit(float(whole or 1))
        if isinstance(target, dict):
            wanted = found
            for category, share in target.items():
                wanted = F.when(F.col(key) == category, F.lit(float(share))).otherwise(wanted)
        else:
            wanted = F.pow(found, F.lit(float(target)))
        shares = cells.groupBy(key).agg(wanted.alias("_wanted"))
        total = shares.agg(F.sum("_wanted")).first()[0]
        cells = cells.join(shares.select(key, (F.col("_wanted") * (whole or 0) / (total or 1.0)).alias(f"_t_{name}")), key)
    return cells


def _raked_on_driver(masses: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray], rounds: int) -> tuple[np.ndarray, bool]:
    """Masses after fitting, and whether all margins hold; ``codes`` number the categories, ``targets`` hold each cell's wanted mass."""
    raked = early = masses.astype(float)
    sizes = [int(c.max()) + 1 for c in codes]
    for done in range(1, rounds + 1):
        factors = []
        for code, target, size in zip(codes, targets, sizes):
            held = np.bincount(code, raked, size)[code]
            factors.append(np.divide(target, held, out=np.zeros_like(raked), where=held > 0))
            raked = raked * factors[-1]
        left = raked > 0
        if max(float(np.abs(f[left] - 1).max(initial=0.0)) for f in factors) < TOLERANCE:
            return raked, True
        if done <= ROUNDS:
            early = raked
    return early, False


def _raked_in_spark(cells: DataFrame, rounds: int) -> tuple[DataFrame, bool]:
    early = cells
    for done in range(1, rounds + 1):
        step, off = cells, F.lit(0.0)
        for name in DIMENSIONS:
            held = F.sum("_raked").over(Window.partitionBy(f"_{name}"))
            step = step.withColumn(f"_f_{name}", F.when(held > 0, F.col(f"_t_{name}") / held).otherwise(0.0)).withColumn("_raked", F.col("_raked") * F.col(f"_f_{name}"))
            off = F.greatest(off, F.abs(F.col(f"_f_{name}") - 1))
        step = stored(step)
        largest = step.agg(F.max(F.when(F.col("_raked") > 0, off))).first()[0]
        cells = step.drop(*[f"_f_{name}" for name in DIMENSIONS])
        if largest is None or largest < TOLERANCE:
            return cells, True
        if done <= ROUNDS:
            early = cells
    return early, False


def margin_error(cells: DataFrame) -> float:
    """The largest share of all mass by which a margin of the raked cells misses its target."""
    whole = cells.agg(F.sum("_mass")).first()[0] or 1
    misses = [cells.groupBy(f"_{name}").agg((F.sum("_raked") - F.first(f"_t_{name}")).alias("m")).agg(F.max(F.abs("m"))).first()[0] for name in DIMENSIONS]
    return max(m or 0.0 for m in misses) / whole


def rake(cells: DataFrame, targets: dict, rounds: int = MOST_ROUNDS, driver_cells: int = DRIVER_CELLS) -> DataFrame:
    """Cells with _raked, their mass after fitting, and _margin_error; ``cells`` has the dimensions and _mass."""
    cells = stored(_with_targets(cells, targets).withColumn("_raked", F.col("_mass").cast("double")))
    if cells.count() > driver_cells:
        cells, holds = _raked_in_spark(cells, rounds)
    elif rows := sorted(cells.collect(), key=lambda r: [r[f"_{name}"] for name in DIMENSIONS]):
        codes = [np.unique([r[f"_{name}"] for r in rows], return_inverse=True)[1] for name in DIMENSIONS]
        wanted = [np.array([r[f"_t_{name}"] for r in rows], dtype=float) for name in DIMENSIONS]
        raked, holds = _raked_on_driver(np.array([r["_mass"] for r in rows]), codes, wanted, rounds)
        cells = stored(cells.sparkSession.createDataFrame([(*r[:-1], float(x)) for r, x in zip(rows, raked)], cells.schema))
    else:
        return cells.withColumn("_margin_error", F.lit(0.0))
    error = margin_error(cells)
    if not holds:
        warnings.warn(f"raking did not settle: a margin misses its target by {error:.3g} of all mass; do empty cells contradict the targets?", stacklevel=2)
    return cells.withColumn("_margin_error", F.lit(error))


def _scale(cells: DataFrame, budget: float) -> float:
    """Factor by which probabilities sum to the budget once those above one are cut."""
    full, factor = -1, 0.0
    while True:
        certain = F.lit(factor) * F.col("_raked") >= F.col("_mass") if full >= 0 else F.lit(False)
        row = cells.agg(F.sum(F.when(certain, F.col("_mass"))), F.sum(F.when(~certain, F.col("_raked"))), F.sum("_mass"), F.count(F.when(certain, 1))).first()
        if row[3] == full or not row[1]:
            return factor
        full, factor = row[3], max(factor, (budget * row[2] - (row[0] or 0)) / row[1])


def sampling_cells(docs: DataFrame, topic: Column | None = None, targets: dict | None = None, budget: float = BUDGET) -> DataFrame:
    """Per cell: _source, _lang, _topic, _weight, _probability."""
    keyed = docs.select(*_categories(topic), _mass(F.col("text")).alias("_mass"))
    cells = stored(keyed.groupBy("_source", "_lang", "_topic").agg(F.sum("_mass").alias("_mass")))
    raked = rake(cells, targets or TARGETS)
    weight = F.col("_raked") / F.col("_mass")
    return stored(raked.select("_source", "_lang", "_topic", weight.alias("_weight"), F.least(F.lit(1.0), F.lit(_scale(raked, budget)) * weight).alias("_probability")))


def mixture(docs: DataFrame, topic: Column | None = None, targets: dict | None = None, budget: float = BUDGET) -> DataFrame:
    """Per row: doc_id, source, lang, topic, tokens, weight, probability, kept."""
    cells = sampling_cells(docs, topic, targets, budget)
    rows = docs.select("doc_id", *_categories(topic), _mass(F.col("text")).alias("tokens"), _uniform(docs["doc_id"], docs["text"]).alias("_u"))
    joined = rows.join(broadcast_if_small(cells, cells.count()), ["_source", "_lang", "_topic"])
    kept = F.col("_u") < F.col("_probability")
    return joined.select("doc_id", *[F.col(f"_{name}").alias(name) for name in DIMENSIONS], "tokens", F.round("_weight", 6).alias("weight"), F.round("_probability", 6).alias("probability"), kept.alias("kept"))


def sample_mixture(docs: DataFrame, topic: Column | None = None, targets: dict | None = None, budget: float = BUDGET) -> DataFrame:
    """The documents that the mixture keeps, columns unchanged."""
    cells = sampling_cells(docs, topic, targets, budget)
    rows = packed(docs, *_categories(topic), _uniform(docs["doc_id"], docs["text"]).alias("_u"))
    joined = rows.join(broadcast_if_small(cells, cells.count()), ["_source", "_lang", "_topic"])
    return unpacked(joined.filter(F.col("_u") < F.col("_probability")))


def mixture_sql(rounds: int = ROUNDS) -> str:
    """The default mixture as one DuckDB query: the rounds written out, then a sorted search for the scale."""
    topic = "CASE WHEN contains(text, 'icense') THEN 'legal' WHEN contains(text, '@') THEN 'contact' WHEN contains(text, 'password') OR contains(text, 'AKIA') THEN 'credentials' ELSE 'prose' END"
    wanted = {"source": "pow(m / whole, 0.5)", "lang": "CASE lang WHEN 'en' THEN 0.6 WHEN 'de' THEN 0.15 WHEN 'fr' THEN 0.15 WHEN 'es' THEN 0.1 ELSE m / whole END", "topic": "pow(m / whole, 0.7)"}
    parts = [
        rf"keyed AS (SELECT doc_id, coalesce(source, 'unknown') AS source, coalesce(lang, 'unknown') AS lang, {topic} AS topic, greatest(1, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))) AS tokens, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'text:' || md5(coalesce(text, '')))), 1, 13))::BIGINT / 4503599627370496.0 AS draw FROM documents)",
        "cells AS (SELECT source, lang, topic, sum(tokens)::DOUBLE AS mass FROM keyed GROUP BY ALL)",
    ]
    for name, share in wanted.items():
        parts.append(f"t_{name} AS (SELECT {name}, whole * ({share}) / sum({share}) OVER () AS t_{name} FROM (SELECT {name}, sum(mass) AS m, (SELECT sum(mass) FROM cells) AS whole FROM cells GROUP BY {name}))")
    parts.append("r0 AS (SELECT *, mass AS w FROM cells JOIN t_source USING (source) JOIN t_lang USING (lang) JOIN t_topic USING (topic))")
    step = 0
    for _ in range(rounds):
        for name in wanted:
            step += 1
            parts.append(f"r{step} AS MATERIALIZED (SELECT * REPLACE (w * t_{name} / sum(w) OVER (PARTITION BY {name}) AS w) FROM r{step - 1})")
    parts += [
        f"ranked AS (SELECT source, lang, topic, mass, w, coalesce(sum(mass) OVER above, 0) AS full_mass, sum(w) OVER (ORDER BY w / mass, source, lang, topic) AS rest, sum(mass) OVER () AS whole FROM r{step} WINDOW above AS (ORDER BY w / mass DESC, source DESC, lang DESC, topic DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))",
        f"scale AS (SELECT max(({BUDGET} * whole - full_mass) / rest) AS f FROM ranked WHERE {BUDGET} * whole > full_mass)",
        "sampled AS (SELECT source, lang, topic, w / mass AS weight, least(1.0, f * w / mass) AS probability FROM ranked, scale)",
    ]
    return f"WITH {', '.join(parts)} SELECT doc_id, source, lang, topic, tokens, round(weight, 6) AS weight, round(probability, 6) AS probability, draw < probability AS kept FROM keyed JOIN sampled USING (source, lang, topic)"
