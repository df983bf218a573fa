"""Orders, ranks and operators to which the order of rows matters. The order is always given by columns."""

from __future__ import annotations

from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from readloom.plans.prefix import before, rank
from readloom.schema import order_keys


def sort(ovl: DataFrame, order: str = "canonical", tie: list[str] = ()) -> DataFrame:
    """A global sort: a range exchange and a sort of each range."""
    return ovl.orderBy(*order_keys(order, tie))


def ranked(ovl: DataFrame, order: str, tie: list[str], name: str = "rank", block: int = 64) -> DataFrame:
    """``ovl`` with each row's place in an order, from 0, without a sort in one task: rows are sorted in blocks of
    ``block`` ids of the leading read."""
    keys = order_keys(order, tie)
    return rank(ovl, F.floor(F.col(keys[0]) / block), keys, name)


def merge(*tables: DataFrame, order: str = "canonical", tie: list[str] = ()) -> DataFrame:
    """Tables merged into one order; each is sorted even if it claims to be."""
    from readloom.operators.transform import concat

    return sort(concat(*tables), order, tie)


def chains(ovl: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``ovl`` with chain_id and chain_link, both from 0 in the order of a group: a start row opens a chain, and rows
    before the first start form chain 0 as well."""
    w = Window.partitionBy(*group).orderBy(*order)
    starts = F.sum(F.col("is_start").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    numbered = ovl.withColumn("chain_no", starts)
    numbered = numbered.withColumn("chain_id", F.col("chain_no") - F.min("chain_no").over(Window.partitionBy(*group)))
    link = F.row_number().over(Window.partitionBy(*group, "chain_id").orderBy(*order)) - 1
    return numbered.withColumn("chain_link", link.cast("long")).drop("chain_no")


def chain_sort(ovl: DataFrame, order: str, tie: list[str], chain: list[str], link: str, name: str = "rank", block: int = 64) -> DataFrame:
    """``ovl`` with each row's place when chains are ordered by their first row and rows follow in their chain's order.
    ``chain`` tells chains apart, ``link`` orders the rows of one."""
    keys = order_keys(order, tie)
    w = Window.partitionBy(*chain).orderBy(link).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    head = F.first(F.struct(*keys)).over(w)
    full = ovl.withColumn("_head", head)
    return rank(full, F.floor(F.col(f"_head.{keys[0]}") / block), ["_head", *chain, link], name).drop("_head")


def mark_primary(ovl: DataFrame, order: list[str], keep: list[str]) -> DataFrame:
    """``keep`` and is_primary: per A read in ``order``, a row is primary unless its A span meets that of an earlier
    primary row. Reads are streamed in order, and of each only its primary spans are held; these are disjoint."""
    names = [*keep, "is_primary"]

    def run(batches):
        of, begins, ends, odd = object(), [], [], []
        for batch in batches:
            marks = []
            for a, b, e in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if a != of:
                    of, begins, ends, odd = a, [], [], []
                if b is None or e is None:  # meets nothing
                    marks.append(True)
                    continue
                at = bisect_right(ends, b)
                hit = at < len(ends) and begins[at] < e or any(b < y and x < e for x, y in odd)
                marks.append(not hit)
                if not hit and b <= e:
                    begins.insert(at, b)
                    ends.insert(at, e)
                elif not hit:
                    odd.append((b, e))
            yield pa.RecordBatch.from_arrays([*batch.columns[3:], pa.array(marks, pa.bool_())], names=names)

    by = dict.fromkeys(["aread", *order, *keep, "abpos", "aepos"])
    rows = ovl.repartition("aread").sortWithinPartitions(*by)
    rows = rows.select(*(F.col(c).alias(f"_{i}") for i, c in enumerate(["aread", "abpos", "aepos"])), *keep)
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[3:], T.StructField("is_primary", T.BooleanType())]))


def chain_numbers(ovl: DataFrame, order: list[str]) -> DataFrame:
    """``ovl`` numbered for mapping output, per B read in ``order``: chain id, number of chains (starts), link, number of
    links, and the role: the first chain is primary, later ones secondary, links behind a head supplementary. Rows before
    the first start form a leading chain that isn't counted."""
    numbered = chains(ovl, ["bread"], order)
    numbered = numbered.withColumn("n_chains", F.sum(F.col("is_start").cast("long")).over(Window.partitionBy("bread")))
    numbered = numbered.withColumn("n_links", F.count("*").over(Window.partitionBy("bread", "chain_id")))
    role = F.when(F.col("chain_link") > 0, "supplementary").when(F.col("chain_id") == 0, "primary").otherwise("secondary")
    return numbered.withColumn("role", role)


def best(ovl: DataFrame, m: int, tie: list[str]) -> DataFrame:
    """The ``m`` best overlaps of each B read by B span less differences, with their place and role."""
    score = F.col("bepos") - F.col("bbpos") - F.col("diffs")
    w = Window.partitionBy("bread").orderBy(F.desc("score"), *tie)
    kept = ovl.withColumn("score", score).withColumn("place", F.row_number().over(w)).where(F.col("place") <= m)
    return kept.withColumn("role", F.when(F.col("place") == 1, "primary").otherwise("secondary"))


def with_before(rows: DataFrame, value: Column | str, order: list[str], group: list[str], bucket: Column | None) -> DataFrame:
    """``rows`` with _before: ``value`` of the row before in the group; by buckets of the order where they are given."""
    if bucket is not None:
        return before(rows, bucket, order, value, "_before", group)
    if not group:
        raise ValueError("rows in one order need a bucket: all would be sorted in one task")
    return rows.withColumn("_before", F.lag(value).over(Window.partitionBy(*group).orderBy(*order)))


def secondary_names(rows: DataFrame, name: str, order: list[str], group: list[str] = (), bucket: Column | None = None) -> DataFrame:
    """``rows`` with is_secondary: the name is that of the row before. ``bucket``, a number that doesn't decrease along the order,
    splits groups that are large; rows that aren't grouped need it."""
    found = with_before(rows, F.col(name), order, group, bucket)
    return found.withColumn("is_secondary", F.coalesce(F.col("_before") == F.col(name), F.lit(False))).drop("_before")


def unsorted(ovl: DataFrame, order: str, by: str, src: list[str] = (), tie: list[str] = (), bucket: Column | None = None) -> DataFrame:
    """Rows that come, by the column ``by``, behind a row that belongs behind them. ``bucket`` as for ``secondary_names``."""
    key = F.struct(*order_keys(order, tie))
    return with_before(ovl, key, [by], src, bucket).where(F.col("_before") > key).drop("_before")
