"""Mixing sources to target weights by entropy balancing.

Native: DataFrame functions only. Each source is to give a target number of words. Among all document
rates w with 0 <= w <= `most`, sum(w * size) = target, the ones nearest to 1 in relative entropy are
w = min(most, exp(lam * size / mean size)), lam being the source's dual variable. Newton steps,
kept inside a bracket, solve all sources' duals at once: one distributed aggregation over the
(source, size) histogram per step. The rates are then rounded to whole copies by systematic rounding
along size in hashed buckets, and what is left of each source's difference is closed by one more or
one fewer copy of small documents in one bucket.

Scale: rows cross the network once for the windows, as five numbers, without texts. Hot sources are
split into buckets of about `bucket_rows` rows. The only tables that are small by construction have
a row for each source; sums are whole numbers, so their order, and a rerun, change nothing.

Edge cases: null text counts 0 words and takes 0; a null source is a source of its own, the last;
a source without words has target 0; an empty table gives an empty result; repeated rows are rows
of their own. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, table

MOST = 3
WORD = r"[^\x20\x09-\x0D]+"
UNIT = 1024  # weighted sums are kept in 1024ths of a word
MILLION = 1_000_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST) -> DataFrame:
    """sid, source, source_size, n, target: a row for each source.

    Sources in code point order, null last, take the weights in turn and share the sum of all sizes.
    A source stops at `most` times its size; in the order of cap by weight the stopped ones come
    first, so one running sum finds the level at which the others share the rest.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    s = s.withColumn("sid", turn).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int")).cast("double"))
    cap = (F.col("source_size") * most).cast("double")
    everything = Window.partitionBy()
    before = Window.orderBy("ratio", "sid").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("ratio", cap / F.col("weight"))
    level = (F.sum("source_size").over(everything) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    s = s.withColumn("level", level).withColumn("stopped", F.col("ratio") <= F.col("level"))
    shared = F.first(F.when(~F.col("stopped"), F.col("level")), ignorenulls=True).over(Window.orderBy("ratio", "sid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return s.withColumn("shared", shared).select("sid", "source", "source_size", "n", F.when(F.col("stopped"), cap).otherwise(F.col("weight") * F.col("shared")).alias("target"))


def solve_duals(hist: DataFrame, sources: DataFrame, most: int = MOST, tolerance: float = 1e-6, rounds: int = 40) -> DataFrame:
    """sid, mean, lam, full: the dual variable of each source; `full`: all rates are `most`.

    hist: sid, size, n. Stops when every source's weighted sum is within `tolerance` of its target.
    """
    mean = F.col("source_size") / F.col("n")
    state = checkpointed(sources.where(F.col("source_size") > 0).select(
        "sid", "target", mean.alias("mean"), (F.col("target") >= most * F.col("source_size") * (1 - 1e-9)).alias("full"),
        F.lit(0.0).alias("lam"), F.lit(-1e4).alias("lo"), F.lit(1e4).alias("hi"), F.lit(False).alias("done")), gathered=True)
    for _ in range(rounds):
        x = F.col("size") / F.col("mean")
        capped = F.col("lam") * x >= F.log(F.lit(float(most)))
        w = F.when(capped, float(most)).otherwise(F.exp(F.col("lam") * x))
        words = F.col("n") * F.col("size") * w * UNIT
        sums = (hist.join(state, "sid").where(~F.col("full") & ~F.col("done") & (F.col("size") > 0)).groupBy("sid")
                .agg(F.sum(F.round(words).cast("long")).alias("f"), F.sum(F.when(capped, 0).otherwise(F.round(words * x)).cast("long")).alias("slope")))
        miss = F.col("f") / UNIT - F.col("target")
        lo, hi = F.when(miss < 0, F.col("lam")).otherwise(F.col("lo")), F.when(miss > 0, F.col("lam")).otherwise(F.col("hi"))
        newton = F.col("lam") - miss / F.when(F.col("slope") > 0, F.col("slope") / UNIT)
        half = F.when((lo > -1e4) & (hi < 1e4), (lo + hi) / 2).when(lo > -1e4, F.greatest(2 * lo, lo + 1)).otherwise(F.least(2 * hi, hi - 1))
        # A step beyond the bracket, or one of more than a unit without an outer bound, is replaced.
        safe = F.when((newton > lo) & (newton < hi) & (F.abs(newton - F.col("lam")) <= F.abs(F.col("lam")) + 1), newton).otherwise(half)
        near = F.abs(miss) <= tolerance * F.col("target")
        stepped = state.join(sums, "sid", "left").select(
            "sid", "target", "mean", "full", F.when(F.col("f").isNull() | near, F.col("lam")).otherwise(safe).alias("lam"),
            F.coalesce(lo, F.col("lo")).alias("lo"), F.coalesce(hi, F.col("hi")).alias("hi"),
            (F.col("done") | F.coalesce(near | ((hi - lo) < 1e-12), F.lit(False))).alias("done"))
        state = checkpointed(stepped, gathered=True)
        if state.where(~F.col("done") & ~F.col("full")).isEmpty():
            break
    return state.select("sid", "mean", "lam", "full")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST, bucket_rows: int = 2_000) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies, taken of every row of `docs`."""
    t = checkpointed(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    sources = checkpointed(source_targets(t, weights, most), gathered=True)
    t = t.join(sources.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    hist = checkpointed(t.groupBy("sid", "size").agg(F.count("*").alias("n")), gathered=True)  # read again by every step
    duals = solve_duals(hist, sources, most)
    t = t.join(duals, "sid", "left")
    tilt = F.col("lam") * F.col("size") / F.col("mean")
    rate = F.when(F.col("size") == 0, 1.0).when(F.col("full") | (tilt >= F.log(F.lit(float(most)))), float(most)).otherwise(F.exp(tilt))
    t = t.withColumn("rate", rate).withColumn("micro", F.round(F.col("rate") * MILLION).cast("long"))
    t = t.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("n") / bucket_rows)).cast("int"))
    t = t.repartition("sid", "bucket")  # joins above may have left rows dealt by source alone
    run = Window.partitionBy("sid", "bucket").orderBy(F.desc("size"), F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.sum(F.col("micro") % MILLION).over(run) + MILLION // 2
    t = t.withColumn("upto", upto)
    extra = F.floor(F.col("upto") / MILLION) - F.floor((F.col("upto") - F.col("micro") % MILLION) / MILLION)
    t = checkpointed(t.withColumn("copies", (F.floor(F.col("micro") / MILLION) + extra).cast("long")).drop("upto", "lam", "mean", "full", "micro"), gathered=True)
    # One bucket of each source closes what is left of its difference, smallest documents first.
    got = t.groupBy("sid").agg(F.sum(F.col("copies") * F.col("size")).alias("got"))
    first = t.where("bucket = 0").join(got, "sid").withColumn("short", F.round(F.col("target") - F.col("got")).cast("long"))
    one = F.when(F.col("short") > 0, F.when(F.col("copies") < most, 1)).when(F.col("short") < 0, F.when(F.col("copies") > 0, -1))
    first = first.withColumn("one", F.when(F.col("size") > 0, one))
    small = Window.partitionBy("sid", F.col("one").isNull()).orderBy("size", F.xxhash64(F.lit(1), "doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    first = first.withColumn("sofar", F.sum("size").over(small))
    moved = F.when(F.col("one").isNotNull() & (F.col("sofar") <= F.abs("short")), F.col("one")).otherwise(0)
    t = t.where("bucket > 0").unionByName(first.withColumn("copies", (F.col("copies") + moved).cast("long")).select(*t.columns))
    return t.select("doc_id", "source", "size", "source_size", F.col("target").cast("double").alias("target"), "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def op9_entropy_balancing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each document as often as the mix takes it; the columns of documents."""
    keys = ["doc_id", "source", "size"]
    plan = mix(docs).select(*keys, "copies").where(F.col("copies") > 0)
    plan = plan.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("copies"))))
    plan = plan.select(*[F.col(c).alias(f"__plan_{c}") for c in (*keys, "nth", "copies")])
    own = [F.col("doc_id"), F.col("source"), F.col("__size"), F.col("__nth")]
    sized = docs.withColumn("__size", word_count(F.col("text")))
    # Rows with equal keys are interchangeable: the nth of them takes the nth plan.
    sized = sized.withColumn("__nth", F.row_number().over(Window.partitionBy("doc_id", "source", "__size").orderBy("text")))
    same = [a.eqNullSafe(F.col(f"__plan_{c}")) for a, c in zip(own, (*keys, "nth"))]
    out = sized.join(plan, same[0] & same[1] & same[2] & same[3])
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__plan_copies")))).select(*docs.columns)
