"""Mixing sources to target weights by entropy balancing.

The rates that stay nearest to 1 in relative entropy and meet token constraints have the form
exp(sum of the document's constraints' multipliers), where the multipliers minimise the convex dual
sum(size * exp(multipliers)) - sum(multiplier * target). newton_dual() finds them by Newton steps whose
gradients and Hessians are Spark aggregates, also for the one column of sources of mix(). Beyond MAX_CONSTRAINTS sources,
which would have to be held by the driver, the same dual, which separates by source, is solved with each source's steps in
its own row of a table. The rates are then rounded into whole copies.

Rounding is by a hash of the document, so reruns agree, then corrected: what a source has too much or too
little is taken from or given to documents that may be rounded the other way, first a hashed share of them,
then single documents, the largest that fits.

Nulls: a null text has size 0; null is a source of its own. Documents of size 0 get their rate's copies, which
cost nothing. Rows that repeat a doc_id with the same source and size count each, and are rounded alike.
Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import checkpointed, join_lookup, table, uniform

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: Most copies of a document; a source's target stops at as many times its size.
CAP = 3
#: Passes that move a hashed share of a source's documents, and passes that move one document each.
BULK_PASSES, SINGLE_PASSES = 2, 6
NEWTON_STEPS = 40
#: Constraints up to which the joint dual's dense Hessian is solved.
MAX_CONSTRAINTS = 4096


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(totals: DataFrame, weights=WEIGHTS, cap: int = CAP, share: float = 1.0) -> DataFrame:
    """Adds target to rows (source, total): weights shared out, none above cap * total.

    Sharing the excess again by weight until none is above ends at min(cap * total, level * weight), with one
    level for all. Sources by the code points they are capped at, so the level is that of the first source
    that the level does not cap. The windows run over one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.array(*[F.lit(float(w)) for w in weights])[
        F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))).cast("int")
    ]
    everything = Window.partitionBy()
    by_cap = Window.orderBy(F.col("_capped_at"), F.col("source").asc_nulls_first())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    out = totals.withColumn("_weight", weight).withColumn("_capped_at", cap * F.col("total") / F.col("_weight"))
    out = out.withColumn("_all", share * F.sum("total").over(everything))
    taken = F.coalesce(F.sum(cap * F.col("total")).over(before), F.lit(0))
    left = F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0))
    out = out.withColumn("_level", (F.col("_all") - taken) / left)
    # sources before the first that keeps its share are capped; the level is that one's
    free = F.when(F.col("_level") <= F.col("_capped_at"), F.struct("_capped_at", "_level"))
    level = F.min(free).over(everything)["_level"]
    full = (cap * F.col("total")).cast("double")
    target = F.when(level.isNull(), full).otherwise(F.least(full, level * F.col("_weight")))
    return out.withColumn("target", target).select("source", "total", "target")


def newton_separable(total: Column, target: Column, steps: int = NEWTON_STEPS) -> Column:
    """The multiplier of one constraint whose documents meet no other: Newton on total*exp(x) - target*x.

    Each step is bounded to 2, which keeps exp() small and does not change the limit.
    """
    size, goal = total.cast("double"), target

    def step(x, _):
        now = size * F.exp(x)
        return x - F.greatest(F.lit(-2.0), F.least(F.lit(2.0), (now - goal) / now))

    solved = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.lit(0.0), step)
    return F.when((total > 0) & (target > 0), solved).otherwise(F.lit(0.0))


def newton_dual(docs: DataFrame, columns: list[str], targets: dict[str, dict], size: str = "size", steps: int = 60, tol: float = 1e-9) -> dict[str, dict]:
    """Multipliers of token constraints over several columns, {column: {value: multiplier}}.

    targets[column][value] is the tokens that the documents with that value shall have. Documents are summed
    once into cells, one for each combination of the columns' values; every Newton step is a Spark aggregate
    over the cells, of which only the gradient and the Hessian (at most MAX_CONSTRAINTS squared) reach the
    driver. Values without a target are left free.
    """
    index = {}
    for c in columns:
        for v in targets[c]:
            index[c, v] = len(index)
    if len(index) > MAX_CONSTRAINTS and len(columns) > 1:
        raise ValueError(f"{len(index)} constraints over several columns; at most {MAX_CONSTRAINTS} can be solved jointly")
    spark = docs.sparkSession
    cells = docs.groupBy(*columns).agg(F.sum(size).cast("double").alias("_size"))
    for c in columns:
        names = spark.createDataFrame([(v, index[c, v]) for v in targets[c]], f"_v {docs.schema[c].dataType.simpleString()}, _k_{c} int")
        cells = cells.join(F.broadcast(names), F.col(c).eqNullSafe(F.col("_v")), "left").drop("_v")
    cells = checkpointed(cells.select("_size", F.array_compact(F.array(*[f"_k_{c}" for c in columns])).alias("_ks")))
    goal = np.zeros(len(index))
    for (c, v), k in index.items():
        goal[k] = targets[c][v]
    x = np.zeros(len(index))
    for _ in range(steps):
        at = F.array(*[F.lit(float(v)) for v in x]) if len(x) else F.array()
        tilt = F.exp(F.aggregate("_ks", F.lit(0.0), lambda a, k: a + at[k]))
        pairs = cells.select((F.col("_size") * tilt).alias("_w"), "_ks").select("_w", "_ks", F.explode("_ks").alias("_i"))
        pairs = pairs.select("_w", "_i", F.explode("_ks").alias("_j")).groupBy("_i", "_j").agg(F.sum("_w").alias("_w"))
        found = pairs.collect()
        now = np.zeros(len(x))
        for r in found:
            if r["_i"] == r["_j"]:
                now[r["_i"]] = r["_w"]
        gradient = np.where(now > 0, now - goal, 0)
        if (np.abs(gradient) <= tol * np.maximum(goal, 1)).all():
            break
        if len(columns) == 1:  # no document meets two constraints, so the Hessian is diagonal
            step = gradient / np.where(now > 0, now, 1)
        else:
            hessian = np.zeros((len(x), len(x)))
            for r in found:
                hessian[r["_i"], r["_j"]] = r["_w"]
            # constraints of two columns share their sum, so the Hessian is singular along one direction
            step = np.linalg.lstsq(hessian + 1e-12 * np.trace(hessian) * np.eye(len(x)), gradient, rcond=None)[0]
        x = x - step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-300))
    return {c: {v: float(x[index[c, v]]) for v in targets[c]} for c in columns}


def _copies(rate: Column, bulk: Column, singles: Column, key: Column) -> Column:
    """Whole copies of a document: hashed rounding, then its source's corrections."""
    low = F.floor(rate)
    first = low + (uniform(key, F.lit(0)) < rate - low).cast("long")
    moved = F.aggregate(
        bulk,
        first,
        lambda n, m: F.when(
            (n == F.when(m["dir"] > 0, low).otherwise(low + 1)) & (rate > low) & (uniform(key, m["seed"]) < m["p"]), n + m["dir"]
        ).otherwise(n),
    )
    return F.aggregate(singles, moved, lambda n, m: F.when(m["key"] == key, n + m["dir"]).otherwise(n))


def _name(source: Column) -> Column:
    """Null sources join like any other, through a name that no source has."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit("null"))


def _key(doc_id: Column, source: Column, size: Column) -> Column:
    return F.xxhash64(doc_id, source, size)


def _with_copies(df: DataFrame, plan: DataFrame, n_sources: int) -> DataFrame:
    """df (_source, _key, ...) with its source's plan and the copies of each row."""
    out = join_lookup(df, plan, "_source", n_sources)
    return out.withColumn("copies", _copies(F.col("rate"), F.col("_bulk"), F.col("_singles"), F.col("_key")))


def mix_plan(docs: DataFrame, weights=WEIGHTS, cap: int = CAP) -> tuple[DataFrame, DataFrame, int]:
    """(base, plan, sources): documents without their texts, and one row per source with its rate and corrections."""
    base = docs.select("doc_id", "source", words(F.col("text")).alias("size"))
    # rows that repeat are counted, rounded alike and dealt out again at the end
    base = base.groupBy("doc_id", "source", "size").agg(F.count("*").alias("_rows"))
    key = _key(F.col("doc_id"), F.col("source"), F.col("size"))
    base = checkpointed(base.withColumn("_key", key).withColumn("_tokens", F.col("_rows") * F.col("size")))
    totals = base.groupBy("source").agg(F.sum("_tokens").alias("total"))
    plan = checkpointed(source_targets(totals, weights, cap))
    if plan.count() <= MAX_CONSTRAINTS:
        goals = {r["source"]: r["target"] for r in plan.filter("total > 0 and target > 0").select("source", "target").collect()}
        solved = newton_dual(base, ["source"], {"source": goals}, "_tokens")["source"]
        solved = docs.sparkSession.createDataFrame(list(solved.items()), "_s string, _x double")
        plan = plan.join(F.broadcast(solved), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    else:
        plan = plan.withColumn("_x", newton_separable(F.col("total"), F.col("target")))
    rate = F.least(F.exp(F.coalesce("_x", F.lit(0.0))), F.lit(float(cap)))
    rate = F.when(F.abs(rate - F.round(rate)) < 1e-9, F.round(rate)).otherwise(rate)
    move = "array<struct<seed int, p double, dir int>>"
    single = "array<struct<key bigint, dir int>>"
    plan = plan.select(_name(F.col("source")).alias("_source"), "total", "target", rate.alias("rate"), F.array().cast(move).alias("_bulk"), F.array().cast(single).alias("_singles"))
    plan, base = checkpointed(plan), base.withColumn("_source", _name(F.col("source")))
    n_sources = plan.count()
    for i in range(BULK_PASSES + SINGLE_PASSES if n_sources else 0):
        now, low = _with_copies(base, plan, n_sources), F.floor("rate")
        up, down = (F.col("rate") > low) & (F.col("copies") == low), (F.col("rate") > low) & (F.col("copies") == low + 1)
        if i < BULK_PASSES:
            found = now.groupBy("_source").agg(
                F.sum(F.col("copies") * F.col("_tokens")).alias("_has"),
                F.sum(F.when(up, F.col("_tokens"))).alias("_up"),
                F.sum(F.when(down, F.col("_tokens"))).alias("_down"),
            )
            plan = plan.join(found, "_source")
            short = F.col("target") - F.col("_has")
            movable = F.when(short > 0, F.col("_up")).otherwise(F.col("_down"))
            step = F.struct(F.lit(i + 1).alias("seed"), F.least(F.abs(short) / movable, F.lit(1.0)).alias("p"), F.signum(short).cast("int").alias("dir"))
            plan = plan.withColumn("_bulk", F.when((movable > 0) & (short != 0), F.array_append("_bulk", step)).otherwise(F.col("_bulk")))
        else:
            has = now.groupBy("_source").agg(F.sum(F.col("copies") * F.col("_tokens")).alias("_has"))
            gap = checkpointed(has.join(plan.select("_source", "target"), "_source").select("_source", (F.col("target") - F.col("_has")).alias("_short")))
            wide = join_lookup(now, gap, "_source", n_sources)
            fits = F.when(F.col("_short") > 0, up).otherwise(down) & (F.col("_tokens") > 0) & (F.col("_tokens") <= F.abs("_short") * 2)
            # the document after which least is missing
            best = F.min(F.when(fits, F.struct(F.abs(F.abs("_short") - F.col("_tokens")).alias("_rest"), "_key", F.signum("_short").cast("int").alias("_dir")))).alias("_best")
            best = wide.groupBy("_source").agg(best, F.abs(F.first("_short")).alias("_gap"))
            plan = plan.join(best, "_source")
            step = F.struct(F.col("_best._key").alias("key"), F.col("_best._dir").alias("dir"))
            plan = plan.withColumn("_singles", F.when(F.col("_best._rest") < F.col("_gap"), F.array_append("_singles", step)).otherwise(F.col("_singles")))
        plan = checkpointed(plan.select("_source", "total", "target", "rate", "_bulk", "_singles"))
    return base, plan, n_sources


def mix(docs: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """Rows (doc_id, source, size, source_size, target, rate, copies, taken), one per document."""
    base, plan, n_sources = mix_plan(docs, weights, cap)
    out = _with_copies(base, plan, n_sources).withColumn("_row", F.explode(F.sequence(F.lit(1), F.col("_rows").cast("int"))))
    return out.select("doc_id", "source", "size", F.col("total").alias("source_size"), "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def copied(docs: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """docs with every row as often as the mix takes it; texts stay where they are."""
    _, plan, n_sources = mix_plan(docs, weights, cap)
    key = _key(F.col("doc_id"), F.col("source"), words(F.col("text")))
    # the row travels as one column, so its names can't clash
    named = docs.select(F.struct(*docs.columns).alias("_row"), _name(F.col("source")).alias("_source"), key.alias("_key"))
    out = _with_copies(named, plan.select("_source", "rate", "_bulk", "_singles"), n_sources).filter("copies > 0")
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_row.*")


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies")
