"""A mixture of sources in which each has its target share of the tokens."""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.llm.tokens import VOCABULARY, with_token_counts
from corpuslens.sources.tables import checkpointed

#: Levels of the sampling order for a whole probability, and the order's end.
_LEVELS, _TOP = 4096, 16384
#: Distinct languages, and topics, that are margins of their own; all others share one of as many hashed margins.
_MARGINS = 256


def _targets(mix: DataFrame) -> pd.DataFrame:
    """The wanted shares, one row a source; a plan of a few rows, whatever the corpus."""
    wanted = mix.where("source IS NOT NULL AND weight > 0").groupBy("source").agg(F.sum("weight").alias("weight"), F.max(F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0))).alias("max_repeats")).orderBy("source").toPandas()
    wanted["share"] = wanted["weight"] / wanted["weight"].sum() if len(wanted) else []
    return wanted


def total_tokens(share: np.ndarray, most: np.ndarray, coverage: float) -> float:
    """The largest total at which sources with `coverage` of the weight can have their share; `most` is what each can give."""
    reach = most / share
    order = np.argsort(-reach, kind="stable")
    met = np.cumsum(share[order])
    return float(reach[order][np.searchsorted(met, coverage - 1e-9)]) if len(share) else 0.0


def raked(cells: pd.DataFrame, goal: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Tokens of each cell by iterative proportional fitting.

    `cells` has source, lang and topic as numbers from 0, tokens, and cap, the most tokens it can give. Languages and topics
    have the margins that they have in the sources' own tokens; the sources' goals come last in each round, so
    they hold in the end. No cell exceeds its cap; what it can't give is taken by the source's other cells. Caps may leave no solution in
    which languages and topics have their margins too; then the rounds end without one, which a warning says.
    """
    source, tokens, cap = cells["source"].to_numpy(), cells["tokens"].to_numpy(float), cells["cap"].to_numpy(float)
    x = tokens * 1.0
    margins = [(v, np.bincount(v, tokens) / max(tokens.sum(), 1) * goal.sum()) for v in (cells["lang"].to_numpy(), cells["topic"].to_numpy())]
    for _ in range(rounds):
        before = x.copy()
        for v, wanted in margins:
            have = np.bincount(v, x, len(wanted))
            x = x * np.divide(wanted, have, out=np.ones_like(wanted), where=have > 0)[v]
        for _ in range(30):
            have = np.bincount(source, x, len(goal))
            full = x >= cap * (1 - 1e-12)
            fixed = np.bincount(source, np.where(full, x, 0), len(goal))
            scale = np.divide(goal - fixed, have - fixed, out=np.ones_like(goal), where=have - fixed > 1e-9)
            if (np.bincount(source, x, len(goal)) > goal * (1 + 1e-9)).any():  # too much: all cells give way
                x = x * np.minimum(1, np.divide(goal, have, out=np.ones_like(goal), where=have > 0))[source]
                continue
            x = np.minimum(cap, np.where(full, x, x * np.maximum(scale, 0)[source]))
            if np.allclose(np.bincount(source, x, len(goal)), goal, rtol=1e-9):
                break
        if np.allclose(before, x, rtol=1e-7):
            break
    else:
        if len(x):
            warnings.warn(f"margins of languages and topics aren't met within {rounds} rounds; sources are", stacklevel=2)
    return x


def _hashed(column: str, limit: int):
    return F.pmod(F.xxhash64(F.coalesce(F.col(column).cast("string"), F.lit(""))), F.lit(limit)).cast("int")


def mixture(documents: DataFrame, mix: DataFrame, vocabulary: str = VOCABULARY, total: float | None = None, coverage: float = 0.9, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """The mixture and its report.

    mixture: `doc_id, source, lang, doc_type, n_tokens, copies`, the documents that take part, at most max_repeats
    times. report: `source, weight, max_repeats, target_share, actual_share, target_tokens, tokens, available_tokens,
    documents, copies, status`, a row for each source of `mix`; status is `met`, `short` (all documents max_repeats
    times don't reach the target) or `empty` (no tokens).

    Token weights are raked to the sources' targets and to the languages' and topics' (doc_type) own margins.
    That gives each cell of source, language and topic its mean number of copies; every document gets the whole part, and one
    more with the rest as calibrated probability. For that, documents stand in the order of a number drawn from
    doc_id over that probability, and those before the point where the source's target is reached get one.

    total: tokens of the whole mixture; by default the largest at which sources with `coverage` of the weight can have
    their share. Shares of a source that can't give its target are left to the others in proportion. Weights of a
    source listed twice are added; a null max_repeats is 1. Null, empty and blank-less texts without tokens, null
    sources and unlisted sources take no part. Null lang and doc_type are values of their own. Repeated doc_id
    are documents of their own. Empty tables give an empty mixture.
    """
    spark = documents.sparkSession
    wanted = _targets(mix)
    listed = [str(s) for s in wanted["source"]]
    number = F.create_map(*[F.lit(v) for i, s in enumerate(listed) for v in (s, i)]) if listed else None
    chosen = documents.where(F.col("source").isin(listed) & (F.length("text") > 0)) if listed else documents.where("false")
    chosen = with_token_counts(chosen.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", "doc_type", "text"), vocabulary).where("n_tokens > 0")
    drawn = (F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1 << 40)) + 0.5) / (1 << 40)
    chosen = checkpointed(chosen.select("*", (number[F.col("source")] if listed else F.lit(0)).alias("s"), _hashed("lang", _MARGINS).alias("l"), _hashed("doc_type", _MARGINS).alias("t"), drawn.alias("u")))
    # at most listed sources x margins x margins cells
    cells = chosen.groupBy("s", "l", "t").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")).orderBy("s", "l", "t").toPandas()
    share, repeats = wanted["share"].to_numpy(float), wanted["max_repeats"].to_numpy(float)
    have = np.bincount(cells["s"], cells["tokens"], len(listed)) if len(cells) else np.zeros(len(listed))
    size = total_tokens(share, have * repeats, coverage) if total is None else float(total)
    aim = share * size
    goal = np.minimum(aim, have * repeats)
    table = pd.DataFrame({"source": cells["s"], "lang": pd.factorize(cells["l"])[0], "topic": pd.factorize(cells["t"])[0], "tokens": cells["tokens"]})
    table["cap"] = table["tokens"] * (repeats[table["source"]] if len(table) else 0)
    rate = raked(table, goal) / table["tokens"].to_numpy(float) if len(table) else np.zeros(0)
    whole = np.floor(rate + 1e-9)
    rest = np.maximum(rate - whole, 0)
    rest[rest < 1e-9] = 0
    rates = spark.createDataFrame(pd.DataFrame({"s": cells["s"].astype("int32"), "l": cells["l"].astype("int32"), "t": cells["t"].astype("int32"), "base": whole.astype("int32"), "rest": rest}), "s int, l int, t int, base int, rest double")
    rated = chosen.join(F.broadcast(rates), ["s", "l", "t"])  # as many rows as cells
    order = F.when(F.col("rest") > 0, F.col("u") / F.col("rest"))
    rated = rated.withColumn("r", order).withColumn("level", F.least(F.floor(F.col("r") * _LEVELS), F.lit(_TOP)).cast("int"))
    # tokens by level tell where each source's target is reached: sources x levels rows
    levels = rated.where("level IS NOT NULL").groupBy("s", "level").agg(F.sum("n_tokens").alias("tokens")).orderBy("s", "level").toPandas()
    need = goal - (np.bincount(table["source"], whole * table["tokens"], len(listed)) if len(table) else 0)
    stops = []
    for i in range(len(listed)):
        own = levels[levels["s"] == i]
        reached = own["tokens"].cumsum().to_numpy()
        k = int(np.searchsorted(reached, need[i] * (1 - 1e-12)))
        left = need[i] - (reached[k - 1] if k else 0)
        stops.append((i, int(own["level"].iloc[k]) if k < len(own) else _TOP + 1, float(max(left, 0))))
    stop = F.broadcast(spark.createDataFrame(stops, "s int, stop int, room double"))
    rated = rated.join(stop, "s", "left")
    before = rated.where(F.col("level").isNull() | (F.col("level") != F.col("stop"))).withColumn("extra", F.coalesce((F.col("level") < F.col("stop")).cast("int"), F.lit(0)))
    # only the documents of one level of each source are put in order
    running = F.sum("n_tokens").over(Window.partitionBy("s").orderBy("r", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0))
    edge = rated.where(F.col("level") == F.col("stop")).withColumn("extra", (running - F.col("n_tokens") / 2 <= F.col("room")).cast("int"))
    taken = before.unionByName(edge).withColumn("copies", F.col("base") + F.col("extra")).where("copies > 0")
    mixed = taken.select("doc_id", "source", "lang", "doc_type", "n_tokens", "copies")
    used = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("documents"), F.sum("copies").alias("copies"))
    plan = spark.createDataFrame(
        [(s, float(w), int(m), float(h), float(a), int(g)) for s, w, m, h, a, g in zip(listed, wanted["weight"], repeats, share, aim, have)],
        "source string, weight double, max_repeats int, target_share double, target_tokens double, available_tokens long",
    )
    report = plan.join(used, "source", "left").fillna(0, ["tokens", "documents", "copies"])
    every = F.sum("tokens").over(Window.partitionBy())  # a row for each listed source
    status = F.when(F.col("available_tokens") == 0, "empty").when(F.col("available_tokens") * F.col("max_repeats") < F.col("target_tokens") * (1 - 1e-9), "short").otherwise("met")
    report = report.select("source", "weight", "max_repeats", "target_share", F.when(every > 0, F.col("tokens") / every).otherwise(0.0).alias("actual_share"), "target_tokens", "tokens", "available_tokens", "documents", "copies", status.alias("status"))
    return mixed, report
