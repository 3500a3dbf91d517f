"""Mixing sources to target weights by hash thresholds, in DataFrame operations only.

Each row has a hash in [0, 2^60). A source that is to give a share of its words keeps the rows whose hash is at or below a
threshold; since thresholds are nested, a larger budget keeps what a smaller one kept. The threshold is found without
sorting: words are summed by (source, leading hash bits), the bucket in which the budget ends is found from running sums,
and only that bucket is split by the next bits, until it holds one hash value.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenelake.scale import attach, settle, settled

from .catalog import WORD, query, table

HASH_BITS, LEVEL_BITS = 60, 12
KEY = ["__none", "__source"]                     # a source and whether it is null, so that joins need no null-safe form


def row_hash(seed: str) -> Column:
    """60 bits from id and text; rows that agree in both share it and are taken together."""
    mark = F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(mark.cast("binary")), 1, 15), 16, 10).cast("long")


def word_count(col: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(col), F.lit(WORD)), F.lit(0)).cast("long")


def source_key() -> list[Column]:
    return [F.col("source").isNull().alias(KEY[0]), F.coalesce(F.col("source"), F.lit("")).alias(KEY[1])]


def targets(sizes: DataFrame, weights, share: float, most: float) -> DataFrame:
    """One row a source from (key, source_size): its target, by filling up to `most` times its size by weight.

    Sources in order of size over weight are full one after another; the first that isn't sets the level for the rest.
    """
    everything = Window.partitionBy()
    order = Window.orderBy(*KEY)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    t = sizes.withColumn("w", w).withColumns({"cap": most * F.col("source_size"), "budget": share * F.sum("source_size").over(everything), "all_w": F.sum("w").over(everything)})
    t = t.withColumn("ratio", F.col("cap") / F.col("w"))
    before = Window.orderBy("ratio", *KEY).rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.col("all_w") - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    t = t.withColumn("level", level).withColumn("full", F.col("ratio") <= F.col("level"))
    t = t.withColumn("level", F.max(F.when(~F.col("full"), F.col("level"))).over(everything))
    return t.select(*KEY, "source_size", F.when(F.col("full"), F.col("cap")).otherwise(F.col("level") * F.col("w")).alias("target"))


def thresholds(facts: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row a source: source_size, target, whole (how often every row is taken) and upto (hash up to which rows are
    taken once more). `facts` has the key, size and h of every row and is settled."""
    goal = targets(facts.groupBy(*KEY).agg(F.sum("size").alias("source_size")), weights, share, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    goal = goal.withColumn("whole", whole).withColumn("left", F.col("target") - F.col("whole") * F.col("source_size"))
    goal = settle(goal, "targets")
    state = goal.where("left > 0").select(*KEY, "left", F.lit(0).cast("long").alias("before"), F.lit(0).cast("long").alias("lead"))
    inside, shift = facts, HASH_BITS
    while shift > 0:
        state = settle(state, "mix")
        if shift < HASH_BITS:
            inside = settle(attach(inside, state.select(*KEY, "lead"), KEY).where(F.shiftright("h", shift) == F.col("lead")).drop("lead"), "edge")
        shift -= LEVEL_BITS
        bars = inside.groupBy(*KEY, F.shiftright("h", shift).alias("bar")).agg(F.sum("size").alias("z"), F.min("h").alias("lo"), F.max("h").alias("hi"))
        upto = F.sum("z").over(Window.partitionBy(*KEY).orderBy("bar").rowsBetween(Window.unboundedPreceding, 0)) + F.col("before")
        at = attach(bars, state.select(*KEY, "left", "before"), KEY).withColumn("upto", upto)
        at = at.where((F.col("upto") >= F.col("left")) & (F.col("upto") - F.col("z") < F.col("left")))
        state = settle(at.select(*KEY, "left", (F.col("upto") - F.col("z")).alias("before"), F.col("bar").alias("lead"), "z", "lo", "hi"), "mix", open=F.count_if(F.col("lo") < F.col("hi")))
        if not settled(state)["open"]:
            break
        state = state.drop("z", "lo", "hi")
    taken = 2 * (F.col("left") - F.col("before")) >= F.col("z")             # the last hash value goes to the nearer side
    edge = state.select(*KEY, F.when(taken, F.col("lo")).otherwise(F.col("lo") - 1).alias("upto"))
    return goal.join(edge, KEY, "left").select(*KEY, "source_size", "target", "whole", F.coalesce("upto", F.lit(-1)).alias("upto"))


def facts_of(docs: DataFrame, seed: str) -> DataFrame:
    return docs.select("doc_id", *source_key(), word_count().alias("size"), row_hash(seed).alias("h"))


def copies() -> Column:
    return F.col("whole") + F.when(F.col("h") <= F.col("upto"), 1).otherwise(0)


def mixed(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0, seed: str = "mix") -> DataFrame:
    """The mix itself: the rows of `docs` with all their columns, each as often as it is taken (not at all, once, twice).

    Null sources are one source, the last. Null and empty texts have no words: they go by the same threshold and count
    nothing. Rows that agree in id and text are taken together. An empty table gives no rows.
    """
    facts = settle(facts_of(docs, seed), "facts")
    limits = thresholds(facts, weights, share, most)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), *source_key(), row_hash(seed).alias("h"))
    taken = attach(whole, limits.select(*KEY, "whole", "upto"), KEY).withColumn("__n", copies()).where("__n > 0")
    return taken.select("__row", F.explode(F.sequence(F.lit(1), F.col("__n")))).select("__row.*")


def mix_report(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0, seed: str = "mix") -> DataFrame:
    """What `mixed` takes of each row, with its source's size and target."""
    facts = settle(facts_of(docs, seed), "facts")
    rows = attach(facts, thresholds(facts, weights, share, most), KEY)
    return rows.select("doc_id", "size", "source_size", "target", (copies() * F.col("size")).cast("long").alias("taken"))


SQL = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
    ('0x' || substr(md5('mix:' || coalesce(doc_id::varchar, 'null') || ':' || md5(coalesce(text, ''))), 1, 15))::bigint as h
  from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
n as (select *, row_number() over (order by source nulls last) as pos from s),
w as (select *, [3.0, 1.0, 2.0][(pos - 1) % 3 + 1]::double as w, 2.0::double * source_size as cap from n),
r as (select *, cap / w as ratio, 1.5::double * sum(source_size) over () as budget, sum(w) over () as all_w from w),
l as (select *, (budget - coalesce(sum(cap) over b, 0)) / (all_w - coalesce(sum(w) over b, 0)) as level
  from r window b as (order by ratio, source nulls last rows between unbounded preceding and 1 preceding)),
t as (select source, source_size, case when ratio <= level then cap
  else max(case when ratio > level then level end) over () * w end as target from l),
g as (select *, case when source_size > 0 then floor(target / source_size)::int else 0 end as whole from t),
c as (select d.*, g.source_size, g.target, g.whole, g.target - g.whole * g.source_size as rest,
    sum(d.size) over (partition by d.source order by d.h range between unbounded preceding and current row)::bigint as upto,
    sum(d.size) over (partition by d.source, d.h)::bigint as z
  from d join g on d.source is not distinct from g.source)
select doc_id, size, source_size, target,
  (size * (whole + case when rest > 0 and (upto < rest or upto - z < rest and 2 * (rest - (upto - z)) >= z) then 1 else 0 end))::bigint as taken
from c"""


@query("op7_mix_sources", SQL)
def op7_mix_sources(spark, sf_dir):
    return mix_report(table(spark, sf_dir, "documents"))
