"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from partwise.llm.common import WORD, digest_unit, materialize, ordered_index, stored

MOST_COPIES = 3
WEIGHTS = (1, 2, 3)
ROWS_PER_BUCKET = 20_000
#: Rows of one number for each source go to every task up to so many sources; beyond, they are joined by shuffle.
MOST_BROADCAST = 100_000
#: Rounds in which documents of at most one in so many of what a source misses are added or taken away in rank order: each leaves less than that share, unless they run out.
ROUNDS, SHARE = 3, 8
#: Documents of each size class (powers of two), in the sample and outside, from which the last exchanges of a source are chosen, and how many there are at most.
EACH_CLASS, MOST_EXCHANGES = 4, 64


def source_targets(sizes: DataFrame, most: int = MOST_COPIES, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, n, weight, target) from (source, size).

    Sources in code-point order, null last, take the weights in turn and share
    the total size. A target stops at ``most`` times its source; the excess
    goes to the others by weight, again and again until none is above. Only
    sums reach the driver.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    ranked = ordered_index(sums, [F.col("source").asc_nulls_last()], "place")
    each = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("place"), F.lit(len(weights))) + 1).cast("int"))
    src = materialize(ranked.withColumn("weight", each).drop("place"))
    total = src.agg(F.sum("source_size")).first()[0] or 0
    level, below = 0.0, -1
    while total:
        full = F.col("weight") * F.lit(level) >= F.col("source_size") * most
        s = src.agg(
            F.sum(F.when(full, F.col("source_size") * most)).alias("held"),
            F.sum(F.when(~full, F.col("weight"))).alias("free"),
            F.count(F.when(full, 1)).alias("capped"),
        ).first()
        if s["capped"] == below or not s["free"]:
            break
        level, below = (total - (s["held"] or 0)) / s["free"], s["capped"]
    return src.withColumn("target", F.least(F.col("weight") * F.lit(float(level)), (F.col("source_size") * most).cast("double")))


def _by_source(rows: DataFrame, values: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``values``, which has a row for each source (null is one)."""
    own = values.withColumnRenamed("source", "__s")
    own = F.broadcast(own) if values.count() <= MOST_BROADCAST else own
    return rows.join(own, F.col("source").eqNullSafe(F.col("__s")), how).drop("__s")


def inclusion(slim: DataFrame, src: DataFrame) -> DataFrame:
    """(source, factor) so that the chances min(1, factor * sqrt(size)) of a source's documents let one expect ``rest`` words.

    Documents that would exceed 1 are certain, and the others share what is then
    left, again and again until no further one exceeds it.
    """
    factors, before = None, -1
    while True:
        if factors is None:
            rows = slim.withColumn("sure", F.lit(False))
        else:
            rows = _by_source(slim, factors).withColumn("sure", F.col("factor") * F.sqrt("size") >= 1)
        sums = rows.groupBy("source").agg(
            F.sum(F.when(F.col("sure"), F.col("size")).otherwise(0)).alias("held"), F.sum(F.when(~F.col("sure"), F.sqrt("size") * F.col("size")).otherwise(0.0)).alias("weighted"),
            F.sum(F.col("sure").cast("long")).alias("n_sure"),
        )
        left = F.greatest(F.col("rest") - F.col("held"), F.lit(0.0))
        factors = materialize(_by_source(src.select("source", "rest"), sums).select("source", F.when(F.col("weighted") > 0, left / F.col("weighted")).otherwise(0.0).alias("factor"), "n_sure"))
        sure = factors.agg(F.sum("n_sure")).first()[0] or 0
        if sure == before:
            return factors.drop("n_sure")
        factors, before = factors.drop("n_sure"), sure


def ranks(slim: DataFrame, factors: DataFrame) -> DataFrame:
    """``slim`` with ``chance`` and ``rank``: the odds of the random number ``u`` divided by those of the chance, brought to 0 to 1. Certain documents rank 0."""
    odds = lambda p: p / (1 - p)
    chance = F.least(F.col("factor") * F.sqrt("size"), F.lit(1.0))
    rows = _by_source(slim, factors).withColumn("chance", chance).drop("factor")
    pareto = odds(F.col("u")) / odds(F.greatest("chance", F.lit(1e-12)))
    return rows.withColumn("rank", F.when(F.col("chance") >= 1, 0.0).otherwise(pareto / (1 + pareto)))


def _leading(fits: DataFrame) -> DataFrame:
    """The rows of each source that come first in rank order and whose ``count`` fit its ``gap`` together.

    Buckets of ranks are summed first; only the bucket in which the gap ends is
    put in order.
    """
    sums = fits.groupBy("source", "gap", "bucket").agg(F.sum("count").alias("all"))
    upto = F.sum("all").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    begun = sums.withColumn("upto", upto).where(F.col("upto") - F.col("all") < F.col("gap"))
    last = begun.groupBy("source").agg(F.max(F.struct("bucket", (F.col("upto") - F.col("all")).alias("before"))).alias("at"))
    at = _by_source(fits, materialize(last.select("source", F.col("at.bucket").alias("last"), F.col("at.before").alias("before"))))
    running = F.sum("count").over(Window.partitionBy("source").orderBy("rank", "doc_id", "row").rowsBetween(Window.unboundedPreceding, 0))
    edge = at.where(F.col("bucket") == F.col("last")).withColumn("upto", F.col("before") + running).where("upto <= gap")
    return at.where(F.col("bucket") < F.col("last")).select("row").union(edge.select("row"))


def pareto_sample(every: DataFrame) -> DataFrame:
    """(row) of the documents that rank lowest in each source: as many as the chances of its documents sum to."""
    draws = materialize(every.groupBy("source").agg(F.round(F.sum("chance")).cast("long").alias("gap")))
    return _leading(_by_source(every.withColumn("count", F.lit(1)), draws))


def _gaps(state: DataFrame, rests: DataFrame) -> DataFrame:
    """(source, gap): the words that the picked documents of each source miss; less than 0 if they are too many."""
    words = state.groupBy("source").agg(F.sum(F.when(F.col("picked"), F.col("size")).otherwise(0)).alias("words"))
    return materialize(_by_source(rests, words).select("source", (F.col("rest") - F.col("words")).alias("gap")))


def _nearer(state: DataFrame, gaps: DataFrame) -> DataFrame:
    """``state`` after a round: small documents join in rank order where words are missing, and leave from the other end where there are too many."""
    rows = _by_source(state, gaps).where((F.col("picked") == (F.col("gap") < 0)) & (F.col("size") * SHARE <= F.abs("gap")))
    over = F.col("gap") < 0
    turned = lambda c, back: F.when(over, back).otherwise(F.col(c)).alias(c)
    moved = _leading(rows.select("row", "doc_id", "source", F.col("size").alias("count"), turned("rank", 1 - F.col("rank")), turned("bucket", -F.col("bucket")), F.abs("gap").alias("gap")))
    return _flipped(state, moved)


def _flipped(state: DataFrame, moved: DataFrame) -> DataFrame:
    rows = state.join(moved.select("row", F.lit(True).alias("moved")), "row", "left")
    return materialize(rows.withColumn("picked", F.col("picked") != F.coalesce("moved", F.lit(False))).drop("moved"))


def exchanged(gap: float, steps: np.ndarray) -> list[int]:
    """Which of the documents to move, each with the words that it would add: one or two at a time, as long as the gap shrinks."""
    left, out = list(range(len(steps))), []
    for _ in range(MOST_EXCHANGES):
        if not left:
            break
        x = steps[left]
        one = np.abs(gap - x)
        i = int(one.argmin())
        best, pick = one[i], [i]
        if best > 0.5 and len(x) > 1:
            two = np.abs(gap - x[:, None] - x[None, :])
            np.fill_diagonal(two, np.inf)
            if two.min() < best:
                best, pick = two.min(), sorted(map(int, np.unravel_index(two.argmin(), two.shape)))
        if best >= abs(gap):
            break
        gap -= x[pick].sum()
        out += [left[k] for k in pick]
        left = [k for n, k in enumerate(left) if n not in pick]
    return out


def _exchanges(state: DataFrame, gaps: DataFrame) -> DataFrame:
    """(row) of the documents that change sides at last: for each source from EACH_CLASS documents of each size class on either side, those next in rank."""
    order = Window.partitionBy("source", "picked", "class").orderBy(F.when(F.col("picked"), -F.col("rank")).otherwise(F.col("rank")), "doc_id", "row")
    classes = state.withColumn("class", F.floor(F.log2("size")).cast("int"))
    # First the buckets that hold the next few: only these are put in order.
    near = F.when(F.col("picked"), -F.col("bucket")).otherwise(F.col("bucket"))
    sums = classes.withColumn("near", near).groupBy("source", "picked", "class", "near").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source", "picked", "class").orderBy("near").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wanted = sums.withColumn("before", before).where(F.col("before") < EACH_CLASS).select(F.struct("source", "picked", "class", "near").alias("k"))
    rows = classes.withColumn("k", F.struct("source", "picked", "class", near.alias("near"))).join(wanted, "k", "left_semi")
    few = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= EACH_CLASS)
    step = F.when(F.col("picked"), -F.col("size")).otherwise(F.col("size")).alias("step")
    pool = _by_source(few, gaps.where("gap <> 0")).select("source", "gap", step, "rank", "row")

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["rank", "row"]).reset_index(drop=True)
        return group.loc[exchanged(float(group["gap"][0]), group["step"].to_numpy(float)), ["row"]]

    return pool.groupBy("source").applyInPandas(choose, "row long")


def _fill(ranked: DataFrame, rests: DataFrame) -> DataFrame:
    """(row, picked) of documents whose words come near the ``rest`` of their source.

    The Pareto sample of fixed size comes first. As documents come whole, its
    words are then brought nearer in ROUNDS rounds by rank order and by one last
    exchange of a few documents of each size.
    """
    sample = pareto_sample(ranked).withColumn("picked", F.lit(True))
    state = ranked.select("row", "doc_id", "source", "size", "rank", "bucket").join(sample, "row", "left").withColumn("picked", F.coalesce("picked", F.lit(False)))
    state = materialize(state)
    for _ in range(ROUNDS):
        state = _nearer(state, _gaps(state, rests))
    return _flipped(state, materialize(_exchanges(state, _gaps(state, rests)))).select("row", "picked")


def mix(docs: DataFrame, most: int = MOST_COPIES, weights: tuple[int, ...] = WEIGHTS, row: str | None = None) -> DataFrame:
    """How much of each document a mix takes: (doc_id, source, size, source_size, target, copies, taken), and the number ``row`` if ``docs`` has one.

    Every document of a source first gets the whole copies that its source's
    ratio of target to size makes certain. The rest of the target is filled by
    Pareto order sampling: a document of size s has a chance in proportion to
    sqrt(s), 1 at most, so that the words expected are the rest (see
    ``inclusion``); documents rank by the odds of a random number divided by the
    odds of their chance, and as many as the chances sum to are taken, lowest
    ranks first. As documents come whole, a fixed number of rounds then brings
    the words nearer (see _fill): what is kept is the Pareto sample but for
    these documents. No document exceeds ``most`` copies. The random number is a
    hash of doc_id, source and size: reruns agree.

    Null text: size 0. Null source: a source of its own. A size of 0 is never
    taken. Rows that repeat count one by one; ties rank by row. Empty table: no
    rows.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    unit = digest_unit(F.coalesce(F.col("doc_id").cast("string"), F.lit("∅")), F.coalesce(F.col("source"), F.lit("∅")), F.col("size").cast("string"))
    number = F.col(row) if row else F.monotonically_increasing_id()
    slim = docs.select("doc_id", "source", size.alias("size"), number.alias("row")).withColumn("u", unit)
    slim = materialize(slim)
    src = source_targets(slim, most, weights)
    copies = F.least(F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1))), F.lit(most)).cast("long")
    src = src.withColumn("copies", F.coalesce(copies, F.lit(0)))
    src = materialize(src.withColumn("rest", F.when(F.col("copies") < most, F.col("target") - F.col("copies") * F.col("source_size")).otherwise(0.0)))
    picked = stored(lambda: _picked(slim, src.where("rest > 0 and source_size > 0").select("source", "rest")))
    state = _by_source(slim, src).join(picked, "row", "left")
    taken = state.withColumn("copies", F.col("copies") + F.coalesce("picked", F.lit(False)).cast("long"))
    out = ["doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")]
    return taken.select(*out, *([F.col("row").alias(row)] if row else []))


def _picked(slim: DataFrame, rests: DataFrame) -> DataFrame:
    open_ = slim.where("size > 0")
    ranked = ranks(open_, inclusion(open_, rests))
    buckets = max(1, slim.count() // ROWS_PER_BUCKET)
    return _fill(materialize(ranked.withColumn("bucket", F.floor(F.col("rank") * buckets))), rests)


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents the mix takes, each row as often as it is taken, with the columns of ``docs``.

    Rows go by numbers of their own: doc_id may be null or repeated, and columns
    of any name stay. An empty table gives no rows.
    """
    held = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("held")
    rows = materialize(docs.select("doc_id", "source", "text", held).withColumn("row", F.monotonically_increasing_id()).select("row", "held"), "zstd")
    plan = mix(rows.select("row", "held.doc_id", "held.source", "held.text"), row="row").where("copies > 0").select("row", "copies")
    again = rows.join(plan, "row").withColumn("again", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return again.select(*[F.col(f"held.`{c}`").alias(c) for c in docs.columns])
