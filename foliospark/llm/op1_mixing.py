"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame functions only.

Sources, in code-point order with null last, weigh ``weights`` in turn and share ``share`` times all words; a target
stops at ``cap`` times its source's words, and the excess goes to the others by weight until none is above. (That is one
water level: target = min(cap, level * weight).) A document of a source should be taken target / source words times on
average: the whole part is certain, and the fraction is a probability p whose mass is p times the document's words.

Fractions are rounded in pairs. Two documents of a source exchange mass until one has none of it or all its words; the
direction is drawn so that each expectation stays, and a source's total mass never changes. Documents are dealt by hash
into buckets of about ``FAN_IN``; a bucket folds into decided documents and one undecided residual, residuals are dealt
into buckets again, and so on: a reduction tree of logarithmic depth, each level written to the shared folder. Only the
last residual of a source is rounded alone, so a source misses its target by less than one document. Draws are hashes
of ids, so reruns agree, whatever the partitions.

Null and empty texts, and sources without a word, have size 0, target share 0 and are taken 0 times. A null doc_id or
source is a value like any other. Repeated rows are numbered and decided one by one. Extra columns change nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.llm.shared import Scratch, documents

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0
FAN_IN = 64
SEED = 20_231
WORDS = r"[^\x20\x09-\x0D]+"
ROW = "__mix_row"


def draw(*ids: Column) -> Column:
    """A number in [0, 1) that follows from the ids."""
    return F.pmod(F.xxhash64(F.lit(SEED), *ids), F.lit(1 << 52)) / float(1 << 52)


def source_targets(units: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """One row per source: words, target, documents with words. The windows run over sources, not documents."""
    sources = units.groupBy("source").agg(F.sum("size").alias("source_size"), F.count_if(F.col("size") > 0).alias("active"))
    named = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(named) - 1) % len(weights) + 1
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filling = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    full = F.col("source_size") * cap
    rows = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn)).withColumn("ratio", full / F.col("weight"))
    filled = F.coalesce(F.sum(full).over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    still = F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("level", (F.sum("source_size").over(whole) * share - filled) / still)
    water = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(whole)["level"]
    rows = rows.withColumn("water", water)
    target = F.when(F.col("water").isNull(), full).otherwise(F.least(full, F.col("water") * F.col("weight")))
    return rows.select("source", "source_size", target.cast("double").alias("target"), "active")


def fold_bucket(units: Column) -> Column:
    """Rounds a bucket's documents one after the other: struct(rest, done)."""

    def settled(unit: Column) -> Column:
        return (unit["mass"] == 0) | (unit["mass"] == unit["size"])

    def exchange(rest: Column, unit: Column) -> Column:
        give = F.least(rest["mass"], unit["size"] - unit["mass"])
        take = F.least(unit["mass"], rest["size"] - rest["mass"])
        sides = F.struct(rest.alias("rest"), unit.alias("unit"), give.alias("give"), take.alias("take"), draw(rest["order"], unit["order"]).alias("draw"))
        return F.transform(F.array(sides), moved)[0]

    def moved(s: Column) -> Column:
        to_unit = s["draw"] * (s["give"] + s["take"]) < s["take"]
        gained = lambda side, amount: F.when(side["size"] - side["mass"] == amount, side["size"].cast("double")).otherwise(side["mass"] + amount)
        rest = F.when(to_unit, s["rest"]["mass"] - s["give"]).otherwise(gained(s["rest"], s["take"]))
        unit = F.when(to_unit, gained(s["unit"], s["give"])).otherwise(s["unit"]["mass"] - s["take"])
        return F.struct(s["rest"].withField("mass", rest).alias("rest"), s["unit"].withField("mass", unit).alias("unit"))

    def after(done: Column, s: Column) -> Column:
        over = F.filter(F.array(s["rest"], s["unit"]), settled)
        left = F.filter(F.array(s["rest"], s["unit"]), lambda x: ~settled(x))
        return F.struct(F.get(left, F.lit(0)).alias("rest"), F.concat(done, over).alias("done"))

    def step(state: Column, unit: Column) -> Column:
        pair = F.transform(F.array(exchange(state["rest"], unit)), lambda s: after(state["done"], s))[0]
        return F.when(state["rest"].isNull(), F.struct(unit.alias("rest"), state["done"].alias("done"))).otherwise(pair)

    kind = "struct<order:bigint,key:struct<doc_id:bigint,row:bigint,n:bigint>,size:bigint,copies:int,mass:double>"
    start = F.struct(F.lit(None).cast(kind).alias("rest"), F.array().cast(f"array<{kind}>").alias("done"))
    return F.aggregate(units, start, step)


def mixing_plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, fan_in: int = FAN_IN) -> DataFrame:
    """One row per document: doc_id, row (hash, where the input has it, else null), size, source_size, target, copies, taken."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    row = F.col(ROW) if ROW in docs.columns else F.lit(None)
    size = F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long")
    units = scratch.store(docs.select(F.col("doc_id").cast("long").alias("doc_id"), row.cast("long").alias("row"), "source", size.alias("size")))
    sources = scratch.store(source_targets(units, weights, share, cap))
    most = sources.agg(F.max("active")).first()[0] or 0

    numbered = units.groupBy("doc_id", "row", "source", "size").count().withColumn("n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("count"))))
    named = sources.withColumnRenamed("source", "its_source")
    rated = numbered.join(named, F.col("source").eqNullSafe(F.col("its_source")))
    rate = F.when(F.col("size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rated = rated.select("doc_id", "row", "n", "source", "size", "active", F.floor(rate).cast("int").alias("copies"), ((rate - F.floor(rate)) * F.col("size")).alias("mass"))
    open_ = (F.col("mass") > 0) & (F.col("mass") < F.col("size"))
    begun = scratch.store(rated.withColumn("open", open_))
    extra = F.when((F.col("mass") >= F.col("size")) & (F.col("size") > 0), 1).otherwise(0)
    decided = begun.filter("not open").select("doc_id", "row", "source", "size", (F.col("copies") + extra).alias("copies"))

    key = F.struct("doc_id", "row", "n")
    level, groups = 0, most
    waiting = begun.filter("open").select("source", F.col("active").alias("groups"), F.struct(F.xxhash64("doc_id", "row", "n", "size").alias("order"), key.alias("key"), "size", "copies", "mass").alias("unit"))
    while groups > 0:
        level += 1
        groups = -(-groups // fan_in)
        parts = F.ceil(F.col("groups") / fan_in).cast("long")
        dealt = waiting.select("source", parts.alias("groups"), F.pmod(F.xxhash64(F.lit(level), F.col("unit.order")), parts).alias("bucket"), "unit")
        folded = dealt.groupBy("source", "groups", "bucket").agg(fold_bucket(F.sort_array(F.collect_list("unit"))).alias("state"))
        folded = scratch.store(folded.select("source", "groups", "state.rest", "state.done"))
        one = folded.select("source", F.explode("done").alias("unit"))
        if groups == 1:  # one residual per source is left
            last = F.when(draw(F.col("rest.order")) < F.col("rest.mass") / F.col("rest.size"), F.col("rest.size").cast("double")).otherwise(F.lit(0.0))
            one = one.unionByName(folded.filter("rest is not null").select("source", F.col("rest").withField("mass", last).alias("unit")))
            groups = 0
        waiting = folded.filter("rest is not null").select("source", "groups", F.col("rest").alias("unit"))
        copies = F.col("unit.copies") + F.when(F.col("unit.mass") > 0, 1).otherwise(0)
        decided = decided.unionByName(one.select("unit.key.doc_id", "unit.key.row", "source", "unit.size", copies.alias("copies")))
    out = decided.join(named, F.col("source").eqNullSafe(F.col("its_source")))
    return out.select("doc_id", "row", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as often as it is taken, with its own columns and ``mix_copy``, the number of the
    copy from 1 (it replaces a column of that name). Repeated rows are one row taken as often as all of them together."""
    own = [c for c in docs.columns if c != "mix_copy"]
    columns = [F.col(f"`{c}`") for c in own]
    keyed = docs.select(*columns, F.xxhash64(*columns).alias(ROW), F.coalesce(F.col("doc_id"), F.lit(0)).alias("__mix_id"))
    plan = mixing_plan(keyed.select("doc_id", ROW, "source", "text"), **options).filter("copies > 0")
    plan = plan.groupBy(F.col("row").alias(ROW), F.coalesce(F.col("doc_id"), F.lit(0)).alias("__mix_id")).agg(F.sum("copies").alias("__mix_copies"))
    joined = keyed.join(plan, [ROW, "__mix_id"]).dropDuplicates([ROW, "__mix_id"])  # the same keys: texts are shuffled once
    return joined.select(*columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col("__mix_copies"))).alias("mix_copy"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_plan(documents(spark, sf_dir)).drop("row")
