"""Running values along ordered rows of long keys, in two levels: within parts of a key, then from part to part.

A window over a whole key orders all of its rows in one task. Here a key is cut into parts along its order (time, or row
numbers), each part is a window of its own, and one row of each part carries what later or earlier parts need. Only those
rows, one for each part, share a window by key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Numbers of rows in a part where rows are numbered.
PART_ROWS = 10_000


@dataclass(frozen=True)
class Scan:
    """A running value: ``kind`` says which one, of which column or expression."""

    kind: str
    value: Column


def before(value: Column) -> Scan:
    """Of the row before; null at the first."""
    return Scan("before", value)


def after(value: Column) -> Scan:
    """Of the row after; null at the last."""
    return Scan("after", value)


def total(value: Column) -> Scan:
    """Sum up to and with a row."""
    return Scan("total", value)


def most_before(value: Column) -> Scan:
    """Maximum of the rows before; null at the first."""
    return Scan("most_before", value)


def last_known(value: Column) -> Scan:
    """Last value up to and with a row that is not null."""
    return Scan("last_known", value)


def next_known(value: Column) -> Scan:
    """First value from a row on that is not null."""
    return Scan("next_known", value)


def scanned(df: DataFrame, keys: list[str], part: Column, order: list[str], **scans: Scan) -> DataFrame:
    """``df`` with a column for each of ``scans`` along ``order`` within ``keys``.

    ``part`` is a number that never falls along the order. The order must tell rows apart as far as the values depend on it;
    keys may be null. Rows are shuffled once, by key and part; they are read twice, so long chains begin from written tables.
    """
    rows = df.withColumns({"_key": F.struct(*keys), "_part": part})
    own = Window.partitionBy("_key", "_part").orderBy(*order)
    place = F.struct(*order)
    up_to, ahead = own.rowsBetween(Window.unboundedPreceding, 0), own.rowsBetween(0, Window.unboundedFollowing)
    parts = Window.partitionBy("_key").orderBy("_part")
    earlier, later = parts.rowsBetween(Window.unboundedPreceding, -1), parts.rowsBetween(1, Window.unboundedFollowing)
    local, sums, carried, joined = {}, [], {}, {}
    for name, scan in scans.items():
        v, mine, theirs = scan.value, F.col(f"_l_{name}"), F.col(f"_c_{name}")
        known = F.when(v.isNotNull(), place)
        here, of_part, carry, both = {
            "before": (F.lag(F.struct(v.alias("v"))).over(own), F.max_by(F.struct(v.alias("v")), place), lambda c: F.lag(c).over(parts), F.coalesce(mine, theirs)["v"]),
            "after": (F.lead(F.struct(v.alias("v"))).over(own), F.min_by(F.struct(v.alias("v")), place), lambda c: F.lead(c).over(parts), F.coalesce(mine, theirs)["v"]),
            "total": (F.sum(v).over(up_to), F.sum(v), lambda c: F.sum(c).over(earlier), F.coalesce(mine + theirs, mine, theirs)),
            "most_before": (F.max(v).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.max(v), lambda c: F.max(c).over(earlier), F.greatest(mine, theirs)),
            "last_known": (F.last(v, ignorenulls=True).over(up_to), F.max_by(v, known), lambda c: F.last(c, ignorenulls=True).over(earlier), F.coalesce(mine, theirs)),
            "next_known": (F.first(v, ignorenulls=True).over(ahead), F.min_by(v, known), lambda c: F.first(c, ignorenulls=True).over(later), F.coalesce(mine, theirs)),
        }[scan.kind]
        local[f"_l_{name}"] = here
        sums.append(of_part.alias(f"_c_{name}"))
        carried[f"_c_{name}"] = carry(F.col(f"_c_{name}"))
        joined[name] = both
    carries = rows.groupBy("_key", "_part").agg(*sums).select("_key", "_part", *(c.alias(n) for n, c in carried.items()))
    rows = rows.withColumns(local).join(carries, ["_key", "_part"])
    return rows.withColumns(joined).select(*df.columns, *scans)


def following(df: DataFrame, keys: list[str], part: Column, order: list[str], **columns: str) -> DataFrame:
    """``df`` with new columns: what ``columns`` name holds in the next row along ``order`` within ``keys``; null at the last.

    As in ``scanned``, but only the first and last row of each part meet by key, and no row is joined.
    """
    values = F.struct(*(F.col(c).alias(name) for name, c in columns.items()))
    own = Window.partitionBy(*keys, "_part").orderBy(*order)
    rows = df.withColumn("_part", part).withColumns({"_next": F.lead(values).over(own), "_first": F.row_number().over(own) == 1})
    edges = rows.where(F.col("_next").isNull() | F.col("_first")).withColumn("_after", F.lead(values).over(Window.partitionBy(*keys).orderBy(*order)))
    last = edges.where("_next is null").withColumn("_next", F.col("_after")).drop("_after")
    both = rows.where("_next is not null").unionByName(last)
    return both.select(*df.columns, *(F.col("_next")[name].alias(name) for name in columns))


def pieces_of_runs(df: DataFrame, keys: list[str], part: Column, order: str, value: Column, **sums: Column) -> tuple[DataFrame, DataFrame]:
    """Rows with _part and _local, and the pieces of runs of equal ``value`` (null among them): keys, _part, _local, _head, _value
    and the aggregates ``sums``.

    A piece is a run within a part. _head is the _part and _local of the first piece of its run: pieces with one head are one
    run. Only the first and the last piece of each part are compared by key.
    """
    own = Window.partitionBy(*keys, "_part").orderBy(order)
    same = F.coalesce(F.lag(F.struct(value.alias("v"))).over(own) == F.struct(value.alias("v")), F.lit(False))
    rows = df.withColumn("_part", part).withColumn("_new", (~same).cast("int"))
    rows = rows.withColumn("_local", F.sum("_new").over(own.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    pieces = rows.groupBy(*keys, "_part", "_local").agg(F.min(order).alias("_at"), F.first(F.struct(value.alias("v"))).alias("_value"), *(c.alias(n) for n, c in sums.items()))
    pieces = pieces.withColumn("_last", F.max("_local").over(Window.partitionBy(*keys, "_part")))
    head = F.struct("_part", "_local")
    inside = pieces.where("_local > 1 and _local < _last").withColumn("_head", head)
    along = Window.partitionBy(*keys).orderBy("_at")
    joins = (F.col("_local") == 1) & F.coalesce(F.lag("_value").over(along) == F.col("_value"), F.lit(False))
    edges = pieces.where("_local = 1 or _local = _last").withColumn("_opens", ~joins)
    edges = edges.withColumn("_head", F.last(F.when(F.col("_opens"), head), ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, 0))).drop("_opens")
    return rows, inside.unionByName(edges).drop("_at", "_last")
