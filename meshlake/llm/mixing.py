"""Mixing sources to target weights by capped water-filling (operator 1).

Built-in functions only. Sizes are aggregated per source before anything is
shuffled; each round of the water-filling reads the table of sources and brings
two sums back. The fractional repetition of a source is a prefix of its documents
in a seeded hash order. Its end is found digit by digit from histograms of the hash,
so no task ever sorts a whole source: only the documents that share the digits at which
the prefix ends are ordered, a 1/16^DIGITS of the source. What the mix takes of a document
follows from its own hash and its source's row of the plan, so texts are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshlake.llm.common import text_of, word_count
from meshlake.operators.ordering import global_row_number
from meshlake.runtime import materialize

#: Hexadecimal digits of the seeded order that one histogram resolves, and how often.
DIGITS, LEVELS = 3, 2


def cyclic_weights(sources: DataFrame, cycle: list[int], source: str = "source") -> DataFrame:
    """(source, weight): the sources by code point, null last, weigh cycle[0], cycle[1], ..., repeating."""
    ranked = global_row_number(sources.select(source).distinct(), [F.col(source).asc_nulls_last()], "__rank")
    at = F.pmod(F.col("__rank"), F.lit(len(cycle))).cast("int")
    return ranked.select(source, F.element_at(F.array(*[F.lit(x) for x in cycle]), at + 1).cast("long").alias("weight"))


def water_fill(sizes: DataFrame, budget: float, max_epochs: float) -> DataFrame:
    """(source, size, weight, target) from (source, size, weight).

    Each round shares what is left by weight among the sources not yet clamped and
    clamps those whose share is above max_epochs * size; it ends when none is, or
    when all are (the budget exceeds what all sources can give). Sources of weight
    zero or null, and empty ones, get 0.
    """
    cap = F.col("size") * F.lit(float(max_epochs))
    weight = F.coalesce(F.col("weight"), F.lit(0)).cast("double")
    state = sizes.withColumn("weight", F.coalesce("weight", F.lit(0))).withColumn("__cap", cap)
    clamped, rounds = F.lit(False), 0
    while True:
        left, open_weight, n_clamped = state.agg(
            F.lit(float(budget)) - F.coalesce(F.sum(F.when(clamped, F.col("__cap"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~clamped, weight)), F.lit(0.0)),
            F.count(F.when(clamped, 1)),
        ).first()
        share = weight * F.lit(left) / F.lit(open_weight) if open_weight > 0 else F.lit(0.0)
        above = clamped | (share > F.col("__cap"))
        if state.agg(F.count(F.when(above, 1))).first()[0] == n_clamped:
            return state.withColumn("target", F.when(clamped, F.col("__cap")).otherwise(share)).drop("__cap")
        # a source once clamped stays so: the level of the rest only rises
        state, rounds = state.withColumn("__done", above), rounds + 1
        if rounds % 8 == 0:
            state = materialize(state, "water")
        clamped = F.col("__done")


def seeded_order(doc_id: Column, text: Column, seed: int) -> Column:
    """15 hex digits of a hash of seed, identifier and text: an order all engines agree on.

    The text spreads rows whose identifier is null or repeated.
    """
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.md5(text.cast("binary")))
    return F.substring(F.md5(named), 1, 15)


def _key(source: Column) -> Column:
    """An equality key that null has too."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("null"))


def plan_mix(sized: DataFrame, weights: DataFrame | None = None, cycle: list[int] | None = None, share: float = 1.5, max_epochs: float = 2.0, digits: int = DIGITS, levels: int = LEVELS) -> DataFrame:
    """A row per source: __k, source_size, target, whole, rest, and where its prefix ends (cut, before).

    sized is (source, size, h). Documents whose hash starts below cut are in the prefix;
    those that start with cut are taken while their sizes, after before, stay near rest.
    A source without a cut takes no document more (rest 0) or, where sizes fall short, all.
    """
    per_source = sized.groupBy("source").agg(F.sum("size").alias("size"))
    if weights is None:
        weights = cyclic_weights(per_source, cycle or [1])
    keyed = weights.withColumn("__k", _key(F.col("source"))).drop("source")
    sources = materialize(per_source.withColumn("__k", _key(F.col("source"))).join(keyed, "__k", "left"), "sources")
    total = sources.agg(F.sum("size")).first()[0] or 0
    filled = water_fill(sources, share * total, max_epochs)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    filled = filled.select("__k", F.col("size").alias("source_size"), "target").withColumn("whole", F.floor(rate).cast("long"))
    plan = filled.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")).withColumn("cut", F.lit("")).withColumn("before", F.lit(0).cast("long"))
    plan = materialize(plan, "filled")
    for level in range(levels):
        upto = digits * level
        open_ = plan.where("rest > 0 and cut is not null").select("__k", "rest", "cut", "before")
        part = F.substring("h", upto + 1, digits)
        rows = sized.withColumn("__k", _key(F.col("source"))).join(open_, "__k").where(F.substring("h", 1, upto) == F.col("cut"))
        histogram = rows.groupBy("__k", "rest", "cut", "before", part.alias("part")).agg(F.sum("size").alias("in_part"))
        # 16^digits rows a source
        until = Window.partitionBy("__k").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        starts = histogram.withColumn("start", F.col("before") + F.coalesce(F.sum("in_part").over(until), F.lit(0)))
        ends = starts.where((F.col("start") <= F.col("rest")) & (F.col("rest") < F.col("start") + F.col("in_part")))
        ends = ends.select("__k", F.concat("cut", "part").alias("cut"), F.col("start").alias("before"))
        plan = materialize(plan.drop("cut", "before").join(ends, "__k", "left"), "plan")
    return plan


def _extra(rows: DataFrame, size) -> tuple[DataFrame, DataFrame]:
    """Rows joined with their source's plan, as (those decided by their hash, those at a cut), with copies.

    size makes the size of a row; it is only asked for at cuts.
    """
    begins = F.expr("substring(h, 1, length(cut))")
    clear = rows.where("cut is null or substring(h, 1, length(cut)) <> cut")
    # no cut: the rest is nothing, or reaches past all documents
    more = F.when(F.col("rest") <= 0, F.lit(0)).otherwise(F.coalesce((begins < F.col("cut")).cast("int"), F.lit(1)))
    clear = clear.withColumn("copies", F.col("whole") + more)
    at_cut = rows.where("substring(h, 1, length(cut)) = cut").withColumn("__size", size)
    within = Window.partitionBy("__k").orderBy("h", "__size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    through = F.col("before") + F.sum("__size").over(within)
    # the row in which the rest ends is taken if that comes nearer to it
    near = through - F.col("rest") < F.col("rest") - (through - F.col("__size"))
    at_cut = at_cut.withColumn("copies", F.col("whole") + ((through <= F.col("rest")) | near).cast("int"))
    return clear, at_cut.drop("__size")


def _sized(docs: DataFrame, seed: int, doc_id: str, source: str, text: str) -> DataFrame:
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), text_of(text).alias("t"))
    return own.select("doc_id", "source", word_count(F.col("t")).alias("size"), seeded_order(F.col("doc_id"), F.col("t"), seed).alias("h"))


def mix(docs: DataFrame, weights: DataFrame | None = None, cycle: list[int] | None = None, share: float = 1.5, max_epochs: float = 2.0, seed: int = 17, doc_id: str = "doc_id", source: str = "source", text: str = "text", digits: int = DIGITS) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies.

    copies is how often the mix takes the document: the whole part of
    target / source_size for every document, and once more for those in the seeded
    prefix whose sizes add up nearest to the rest; never more than max_epochs rounded up.
    Weights come as a table (source, weight) or as a cycle over the sorted sources. A null
    source is a source of its own. Null and empty texts have size 0 and follow their place
    in the order. Repeated rows are separate documents, tied in the order. An empty table
    gives no rows. Other columns are ignored.
    """
    sized = materialize(_sized(docs, seed, doc_id, source, text), "sized")
    plan = plan_mix(sized, weights, cycle, share, max_epochs, digits)
    clear, at_cut = _extra(sized.withColumn("__k", _key(F.col("source"))).join(plan, "__k"), F.col("size"))
    return clear.unionByName(at_cut).select("doc_id", "source", "size", "source_size", "target", "copies")


def repeat_rows(docs: DataFrame, weights: DataFrame | None = None, cycle: list[int] | None = None, share: float = 1.5, max_epochs: float = 2.0, seed: int = 17) -> DataFrame:
    """docs as the mix has them: each row as often as its copies say, all columns unchanged.

    Takes the columns doc_id, source and text; nulls, empty texts, ties, repeated rows and
    empty tables are as in mix. Other columns pass, whatever their names: a row travels as
    one struct. Only the rows at a source's cut are shuffled.
    """
    sized = materialize(_sized(docs, seed, "doc_id", "source", "text"), "sized")
    plan = plan_mix(sized, weights, cycle, share, max_epochs)
    rows = docs.select(F.struct("*").alias("row"))
    rows = rows.select("row", _key(F.col("row.source")).alias("__k"), seeded_order(F.col("row.doc_id"), F.coalesce("row.text", F.lit("")), seed).alias("h"))
    clear, at_cut = _extra(rows.join(plan, "__k"), word_count(F.coalesce("row.text", F.lit(""))))
    taken = clear.unionByName(at_cut).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("__copy")).select("row.*")
