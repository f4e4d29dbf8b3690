"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document gets an exponential key, -ln(u) / w, with u from a hash of its id and w its quality.
In ascending key order within a source, the sizes are summed up to the source's budget: whole
epochs first, then the first documents by key for the rest. The order is never built for a whole
source. Keys fall into buckets of about ``BUCKET_ROWS`` documents; prefix sums over bucket totals
find the bucket in which the budget ends, and only that bucket is sorted. What comes out of it is
one cut per source, against which every document compares its own key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from accountloom.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
NOISE = "#*$%&|<>{}[]_=+~^@0123456789"
"""Characters that lower a document's quality weight."""
BUCKET_ROWS = 2000
BROADCAST_SOURCES = 50_000
"""Up to so many sources, one row of about 100 bytes each, are broadcast; more are joined by shuffle."""
_HASH_DIGITS = 13


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality(text: Column) -> Column:
    """A weight from 0.05 to 1 that falls with the share of noise characters; 1 for no text."""
    share = (F.length(text) - F.length(F.translate(text, NOISE, ""))) / F.greatest(F.length(text), F.lit(1))
    return F.coalesce(F.greatest(F.lit(0.05), F.lit(1.0) - F.lit(5.0) * share), F.lit(1.0))


def exponential_key(id_col: Column, weight: Column) -> Column:
    """-ln(u) / w; u, from 0 to 1 and neither, comes from the md5 of the id as text (null: 'null')."""
    digits = F.substring(F.md5(F.coalesce(id_col.cast("string"), F.lit("null"))), 1, _HASH_DIGITS)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(16 ** _HASH_DIGITS))
    return -F.log(u) / weight


def cyclic_weights(pattern: tuple[float, ...]) -> Column:
    """Weights that repeat ``pattern`` over the sources in code point order, null last."""
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return F.element_at(F.array(*[F.lit(float(w)) for w in pattern]), (turn % len(pattern)) + 1)


def targets(sources: DataFrame, weights: Column, share: float, most: float) -> DataFrame:
    """Targets of sources (source, source_size): ``share`` of all sizes by weight, each at most
    ``most`` times its source's size.

    In order of size over weight the capped sources come first, so running sums give the level at
    which the others share what is left. The windows without a key see one row per source.
    """
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    rows = sources.withColumn("weight", weights) \
        .withColumn("ratio", F.lit(most) * F.col("source_size") / F.col("weight"))
    everything = Window.partitionBy(F.lit(0))
    rows = rows.withColumn("size_before", F.sum("source_size").over(order) - F.col("source_size")) \
        .withColumn("weight_from", F.sum("weight").over(everything) - F.sum("weight").over(order) + F.col("weight")) \
        .withColumn("level", (F.lit(share) * F.sum("source_size").over(everything)
                              - F.lit(most) * F.col("size_before")) / F.col("weight_from"))
    free = F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "source", "level"))).over(everything)
    rows = rows.withColumn("free", free)
    capped = F.col("free").isNull() | (F.col("ratio") <= F.col("level"))
    return rows.select("source", "source_size", "weight", F.when(
        capped, F.lit(most) * F.col("source_size")).otherwise(F.col("free.level") * F.col("weight")).alias("target"))


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(id, source, size, key) of every document; the text itself goes no further."""
    text = F.col(text_col)
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(text).alias("size"),
                       exponential_key(F.col(id_col), quality(text)).alias("key"))


def mixture(rows: DataFrame, pattern: tuple[float, ...], share: float, most: float,
            bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per source: source_size, target, epochs and the cut (key, id, size, words taken).

    ``rows`` has id, source, size, key. Without a rest, the cut is null.
    """
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    goals = targets(sources.drop("docs"), cyclic_weights(pattern), share, most)
    words = F.round("target").cast("long")
    goals = goals.join(sources.select(F.col("source").alias("s"), "docs"), F.col("source").eqNullSafe(F.col("s"))) \
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("cast(round(target) as bigint) div source_size"))
                    .otherwise(F.lit(0))) \
        .withColumn("rest", words - F.col("epochs") * F.col("source_size")) \
        .withColumn("buckets", F.ceil(F.col("docs") / bucket_rows)) \
        .select("source", "source_size", "target", "epochs", "rest", "buckets")
    goals = cut_lineage(goals)
    wanted = goals.where("rest > 0").select(F.col("source").alias("s"), "rest", "buckets")
    placed = rows.join(wanted, F.col("source").eqNullSafe(F.col("s"))) \
        .withColumn("bucket", F.floor(F.col("buckets") * (1 - F.exp(-F.col("key")))))
    sums = placed.groupBy("s", "bucket", "rest").agg(F.sum("size").alias("sum")) \
        .withColumn("before", F.sum("sum").over(Window.partitionBy("s").orderBy("bucket")) - F.col("sum"))
    last = sums.where((F.col("before") < F.col("rest")) & (F.col("rest") <= F.col("before") + F.col("sum"))) \
        .select(F.col("s").alias("t"), F.col("bucket").alias("b"), "before")
    inside = placed.join(last, F.col("s").eqNullSafe(F.col("t")) & (F.col("bucket") == F.col("b"))) \
        .withColumn("upto", F.col("before") + F.sum("size").over(
            Window.partitionBy("s").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, 0)))
    cut = inside.where("upto >= rest").groupBy("s").agg(F.min(F.struct("key", "id", "size", (
        F.col("rest") - F.col("upto") + F.col("size")).alias("words"))).alias("cut"))
    return goals.join(cut.withColumnRenamed("s", "t"), F.col("source").eqNullSafe(F.col("t")), "left") \
        .select(F.col("source").alias("mix_source"), "source_size", "target", "epochs", "cut")


def _per_source(plan: DataFrame) -> DataFrame:
    """The plan, written once; broadcast if its counted rows are few, so no source's rows are moved."""
    plan = cut_lineage(plan)
    return F.broadcast(plan) if plan.count() <= BROADCAST_SOURCES else plan


def _place() -> tuple[Column, Column]:
    own = F.struct(F.col("key"), F.col("id"), F.col("size"))
    cut = F.struct(F.col("cut.key"), F.col("cut.id"), F.col("cut.size"))
    return F.col("cut").isNotNull() & (own < cut), F.col("cut").isNotNull() & own.eqNullSafe(cut)


def mix(docs: DataFrame, pattern: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per document: ``id_col``, size, source_size, target, taken.

    ``taken`` counts words with repeats: the source's full epochs, plus the document's words if it
    stands before the cut; the document at the cut gives the words that are still missing, so that
    a source's words meet its target to the word. No document is taken more than ``most`` times.

    A null text has size 0 and is never taken; a null source is a source of its own, the last one;
    null ids share one key; rows that agree in id and size stand or fall together; other columns
    are not read; an empty table gives an empty result. Reruns agree, as keys come from ids.
    """
    rows = cut_lineage(sized(docs, id_col, text_col, source_col))
    before, at = _place()
    return rows.join(_per_source(mixture(rows, pattern, share, most)), F.col("source").eqNullSafe(F.col("mix_source"))) \
        .select(F.col("id").alias(id_col), "size", "source_size", "target", (
            F.col("epochs") * F.col("size") + F.when(before, F.col("size")).when(at, F.col("cut.words"))
            .otherwise(F.lit(0))).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, pattern: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0,
                    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` as often as the mixture takes them, with the same columns.

    A document taken in part is written whole, at most one more copy per source.
    """
    rows = cut_lineage(sized(docs, id_col, text_col, source_col))
    plan = _per_source(mixture(rows, pattern, share, most))
    before, at = _place()
    text, all_of_it = F.col(text_col), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return docs.select(all_of_it, F.col(id_col).alias("id"), F.col(source_col).alias("source"),
                       word_count(text).alias("size"), exponential_key(F.col(id_col), quality(text)).alias("key")) \
        .join(plan, F.col("source").eqNullSafe(F.col("mix_source"))) \
        .withColumn("copies", F.col("epochs") + F.when(before | at, F.lit(1)).otherwise(F.lit(0))) \
        .where("copies > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies").cast("long")))
                                    .alias("copy")).select("row.*")
