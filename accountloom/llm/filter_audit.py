"""What a chain of filters removes, in every order of the filters, from one contingency table per part.

Every document gets one bit per filter: whether it fails it. The only thing counted over documents
is how many there are of each combination of bits, per part: 2^5 cells. From a part's cells, as a
2x2x2x2x2 tensor, every figure of every order and step is a contraction that selects, along each axis,
those that pass, those that fail, or all. Documents are read once; orders never touch them.

Four filters look at one text alone and are column expressions. The fifth finds texts that stand
under a smaller id. Texts meet by SHA-256, and equal ones are added up per cell before they do, so
a text that a third of all documents share sends a few rows to the task that holds it.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accountloom.llm.common import prepare, tidy

BLANKS = "[\\x20\\x09-\\x0D]+"
PARTS_AT_ONCE = 64
"""Parts whose cells are contracted together; each gives (orders x steps) rows."""
MEASURES = ("n", "good", "toxic")


def words_of(text: Column) -> Column:
    """The runs of characters other than the six ASCII blanks."""
    return F.filter(F.split(text, BLANKS, -1), lambda w: w != "")


def text_filters(text: Column) -> dict[str, Column]:
    """For each filter on a text alone, the condition under which a text fails it."""
    words = words_of(text)
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 3 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def contingency(docs: DataFrame, labels: DataFrame, fails: Mapping[str, Column], id_col: str = "doc_id",
                text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, cell, n, good, toxic): documents of each combination of failed filters.

    Bit i of ``cell`` is set where the i-th filter of ``fails`` fails; the last bit where the text
    also stands under a smaller id. Null texts count as empty, null parts as ''. A null id comes after
    all others and has no labels; rows that share id and text are no copies of each other. A document
    counts as good or toxic if any of its labels says so.
    """
    said = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(
        F.max((F.coalesce(F.col("quality"), F.lit(0)) == 1).cast("long")).alias("_good"),
        F.max((F.coalesce(F.col("toxic"), F.lit(0)) == 1).cast("long")).alias("_toxic"))
    bits = [F.when(condition, 1 << i).otherwise(0) for i, condition in enumerate(fails.values())]
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("_part"),
        F.unhex(F.sha2(text, 256)).alias("_text"), reduce(lambda a, b: a + b, bits, F.lit(0)).alias("_cell"))
    known = rows.join(said, "_id", "left").na.fill(0, ["_good", "_toxic"])
    kinds = ["_text", "_part", "_cell", "_good", "_toxic"]
    # Rows that share an id first, then documents that share a text: both are added up before they meet.
    each = known.groupBy("_id", *kinds).agg(F.count("*").alias("_n"))
    same = each.groupBy(*kinds).agg(
        F.sum("_n").alias("_n"), F.min(F.struct(F.col("_id").isNull().alias("last"), "_id", "_n")).alias("_first"))
    least = F.min(F.struct("_first.last", "_first._id")).over(Window.partitionBy("_text"))
    # Of each kind, the rows under the least id of the text hold the first copy; all others fail.
    lead = same.withColumn("_least", least).withColumn(
        "_lead", F.when(F.struct("_first.last", "_first._id").eqNullSafe(F.col("_least")), F.col("_first._n")).otherwise(0))
    copy = 1 << len(fails)
    cells = lead.select("_part", "_good", "_toxic", F.explode(F.array(
        F.struct(F.col("_cell").alias("cell"), F.col("_lead").alias("n")),
        F.struct((F.col("_cell") + copy).alias("cell"), (F.col("_n") - F.col("_lead")).alias("n")))).alias("_one"))
    return cells.groupBy(F.col("_part").alias("part"), F.col("_one.cell").alias("cell")).agg(
        F.sum("_one.n").alias("n"), F.sum(F.col("_one.n") * F.col("_good")).alias("good"),
        F.sum(F.col("_one.n") * F.col("_toxic")).alias("toxic"))


PASS, FAIL, ALL = (1, 0), (0, 1), (1, 1)


def selectors(n: int) -> tuple[list[tuple[int, ...]], np.ndarray, np.ndarray]:
    """All orders of ``n`` filters, and what each step selects along each axis to be kept and removed."""
    orders = list(permutations(range(n)))
    kept = np.empty((len(orders), n, n, 2), np.int64)
    removed = np.empty_like(kept)
    kept[:] = removed[:] = ALL
    for o, order in enumerate(orders):
        for step, own in enumerate(order):
            kept[o, step:, own] = PASS
            removed[o, step, own] = FAIL
            removed[o, step + 1:, own] = PASS
    return orders, kept.reshape(-1, n, 2), removed.reshape(-1, n, 2)


def contract(tensor: np.ndarray, select: np.ndarray) -> np.ndarray:
    """(part, measure, selection) sums of a (part, measure, 2, ..., 2) tensor."""
    n = select.shape[1]
    axes = [2 + i for i in range(n)]
    operands: list = [tensor, [0, 1, *axes]]
    for i in range(n):
        operands += [select[:, i], [2 + n, axes[i]]]
    return np.einsum(*operands, [0, 1, 2 + n], optimize="greedy")


def audit(cells: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per part, order of the filters and step, from the cells of ``contingency``.

    ``names`` are one letter per filter, in the order of the bits. No part gives no rows.
    """
    prepare(cells.sparkSession)
    n = len(names)
    orders, kept, removed = selectors(n)
    own = np.array(orders).reshape(-1)
    single = np.array([[FAIL if i == j else ALL for j in range(n)] for i in range(n)])
    alone = np.array([[FAIL if i == j else PASS for j in range(n)] for i in range(n)])
    spelled = ["".join(names[i] for i in order) for order in orders]
    figures = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), PARTS_AT_ONCE):
                piece = batch.slice(lo, PARTS_AT_ONCE)
                found = piece.column(1)
                at = np.repeat(np.arange(len(piece)), found.value_lengths().to_numpy(zero_copy_only=False))
                flat = found.flatten()
                tensor = np.zeros((len(piece), len(MEASURES), 1 << n), np.int64)
                cell = flat.field("cell").to_numpy()
                for m, measure in enumerate(MEASURES):
                    tensor[at, m, cell] = flat.field(measure).to_numpy()
                # The lowest bit is the last axis of the flat index: turn the axes round.
                tensor = tensor.reshape(len(piece), len(MEASURES), *[2] * n).transpose(0, 1, *range(n + 1, 1, -1))
                gone, left = contract(tensor, removed), contract(tensor[:, :1], kept)[:, 0]
                failing, only = (contract(tensor[:, :1], s)[:, 0] for s in (single, alone))
                share = np.stack([gone[:, 0, own == i].sum(1) for i in range(n)], 1)
                columns = [left, gone[:, 0], failing[:, own] - gone[:, 0], only[:, own], gone[:, 1], gone[:, 2], share[:, own]]
                yield pa.record_batch(
                    [piece.column(0).take(pa.array(np.repeat(np.arange(len(piece)), len(own)))),
                     pa.array(np.tile(np.repeat(np.arange(len(orders), dtype=np.int32), n), len(piece))),
                     pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), len(piece) * len(orders))),
                     *[pa.array(c.reshape(-1)) for c in columns]],
                    ["part", "order", "step", *figures])

    held = cells.groupBy("part").agg(F.collect_list(F.struct("cell", *MEASURES)).alias("cells"))  # 2^n at most
    rows = held.mapInArrow(tidy(run), "part string, order int, step int, " + ", ".join(f"{c} long" for c in figures))
    order = F.element_at(F.array(*map(F.lit, spelled)), F.col("order") + 1)
    return rows.select("part", order.alias("filter_order"), "step", *figures)


def audit_filters(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  part_col: str = "lang") -> DataFrame:
    """The audit of the filters A to D on texts and E on copies, per value of ``part_col``.

    Per part, filter_order and step: kept (after this step), removed (here), redundant (failing its
    filter, removed earlier), unique_fails (failing its filter only), good_lost and toxic_lost (removed
    here), shapley (removed by its filter, over all orders). Null texts are empty; an empty text fails A
    alone, and E if it is not the first; null parts read ''; null ids come last; very long texts are one
    row like any other; ties and repeated rows as in ``contingency``; other columns are not read; an empty
    table has no parts, and the result no rows; without labels good_lost and toxic_lost are 0.
    """
    fails = text_filters(F.coalesce(F.col(text_col), F.lit("")))
    return audit(contingency(docs, labels, fails, id_col, text_col, part_col), [*fails, "E"])
