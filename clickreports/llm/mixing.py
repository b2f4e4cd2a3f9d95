"""Mixing sources to target weights by Poisson replication, in DataFrame operations.

A source whose documents should appear ``rate`` times on average gets, for every document,
a number of copies drawn from a Poisson distribution of that mean: the distribution
function is tabled per source, inverted at a uniform number that a hash of seed and id
fixes, and the row is exploded by the result. Above a rate of ``WHOLE`` the count is the sum
of several draws of equal smaller mean, which is Poisson too. Any machine draws the same
counts, and no state passes between rows. The copies are then dealt to partitions and sorted within
them by a hash of their own: a global shuffle without a global sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickreports.llm.steps import ROW, Steps, numbered, without

UNIFORM_DIGITS = 13  # hexadecimal: 52 bits, exact in a double
WHOLE = 700.0  # the largest rate drawn at once: from 708, exp(-rate) loses digits, from 746 it is zero


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) that the parts fix, a multiple of 2^-52."""
    digits = F.substring(F.md5(F.concat_ws("/", *parts)), 1, UNIFORM_DIGITS)
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(1 << 4 * UNIFORM_DIGITS))


def poisson_table(rate: Column) -> Column:
    """The distribution function at 0, 1, ... up to where no uniform number lies above.

    Rates up to ``WHOLE`` (beyond, exp underflows towards zero and the table would lose digits).
    """
    last = F.ceil(rate + 12 * F.sqrt(rate) + 40).cast("int")
    first = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("table"))

    def step(state: Column, n: Column) -> Column:
        p = state["p"] * rate / n
        return F.struct(p.alias("p"), F.concat(state["table"], F.array(F.element_at(state["table"], -1) + p)).alias("table"))

    return F.aggregate(F.sequence(F.lit(1), last), first, step, lambda state: state["table"])


def source_rates(
    docs: DataFrame, source_column: str = "source", size_column: str = "n_chars", power: float = 0.5, epochs: float = 1.0
) -> DataFrame:
    """``source``, ``rate``: how often a document of the source should appear.

    A source's target weight is its size to the ``power`` (1 keeps the given mix, 0 gives
    all sources the same share); the output is ``epochs`` times the input's size. Sizes
    below zero or null count as zero, and a source of no size appears as it is.
    """
    size = F.greatest(F.coalesce(F.col(size_column), F.lit(0)), F.lit(0)).cast("double")
    sizes = docs.groupBy(F.col(source_column).alias("source")).agg(F.sum(size).alias("size"))
    weight = F.when(F.col("size") > 0, F.sqrt("size") if power == 0.5 else F.pow("size", F.lit(power))).otherwise(0.0)
    weighted = sizes.withColumn("weight", weight)
    total = weighted.agg(F.sum("size").alias("size"), F.sum("weight").alias("weight")).first()
    target = F.col("weight") / F.lit(total["weight"]) * F.lit(total["size"]) * F.lit(epochs)
    rate = F.when(F.col("size") > 0, target / F.col("size")).otherwise(F.lit(epochs))
    return weighted.select("source", rate.alias("rate"))


def replicate(
    docs: DataFrame,
    rates: DataFrame,
    id_column: str = "doc_id",
    source_column: str = "source",
    seed: str = "mix",
) -> DataFrame:
    """Every row as often as its source's Poisson draw says, in a random global order.

    ``rates`` has ``source`` and ``rate`` (0 or more), one row per source; a null source is a
    source like any other. Rows of sources without a rate, or with a null one, do not
    appear. Unique ids alone fix the draws. Where rows share an id or have none, all rows are
    landed and numbered once (``steps.numbered``) and every row's draw is by id and number,
    so that each of them draws on its own.

    Returns the columns of ``docs``, ``copy`` (from 0) and ``shuffle_key``, ascending within
    each partition; input columns of these two names are replaced.
    """
    steps = Steps(docs.sparkSession)
    rates = rates.select(F.col("source").alias("__source"), F.col("rate").cast("double").alias("__rate"))
    parts = F.greatest(F.ceil(F.col("__rate") / WHOLE), F.lit(1)).cast("int")
    rates = rates.where("__rate >= 0").withColumn("__parts", parts)
    rates = rates.withColumn("__table", poisson_table(F.col("__rate") / F.col("__parts")))
    # Landed, the few sources are known to be few; many are joined like any table.
    rates = steps.land("rates", rates.select("__source", "__parts", "__table"))
    rows, named = numbered(docs, id_column, id_column, steps)
    joined = rows.join(rates, rows[source_column].eqNullSafe(rates["__source"]))
    name = F.coalesce(F.col(id_column).cast("string"), F.lit(""))
    if not named:
        name = F.concat_ws("/", name, F.lit("row"), F.col(ROW).cast("string"))

    def drawn(part: Column) -> Column:
        return uniform(F.when(part == 0, F.lit(seed)).otherwise(F.concat(F.lit(f"{seed}/part "), part.cast("string"))), name)

    def inverted(number: Column) -> Column:
        return F.size(F.filter("__table", lambda below: below <= number))

    draws = F.transform(F.sequence(F.lit(0), F.col("__parts") - 1), drawn)
    copies = F.aggregate(draws, F.lit(0), lambda total, number: total + inverted(number))
    columns = without(docs, "copy", "shuffle_key")
    counted = joined.select(*columns, name.alias("__name"), copies.alias("__copies")).where("__copies > 0")
    copied = counted.select(*columns, "__name", F.explode(F.sequence(F.lit(0), F.col("__copies") - 1)).alias("copy"))
    key = F.md5(F.concat_ws("/", F.lit(seed), F.lit("order"), "__name", F.col("copy").cast("string")))
    dealt = copied.select(*columns, "copy", key.alias("shuffle_key")).repartition("shuffle_key")
    return dealt.sortWithinPartitions("shuffle_key")
