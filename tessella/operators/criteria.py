"""A criteria API over tables: optional filters, whitelisted sort, paging, counts, look-ups, strict maps and upserts."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass, field
from datetime import datetime
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


class NoKey(ValueError):
    """A look-up was given no key."""


@dataclass(frozen=True)
class Criteria:
    """What a find asks for. A filter or search of None doesn't filter. sort: a field, with a leading '-' for descending."""

    equal: Mapping[str, Any] = field(default_factory=dict)
    at_least: Mapping[str, Any] = field(default_factory=dict)
    before: Mapping[str, Any] = field(default_factory=dict)
    like: Mapping[str, str | None] = field(default_factory=dict)
    sort: tuple[str, ...] = ()
    limit: int | None = None
    offset: int = 0


def plain(text: str | None, lower: bool = False) -> str | None:
    """Input as it is compared: trimmed, and lower-cased where asked for; an empty one is none."""
    out = (text or "").strip()
    return (out.lower() if lower else out) or None


class Specification:
    """A condition that composes with & | ~."""

    def __init__(self, condition: Column) -> None:
        self.condition = condition

    def __and__(self, other: Specification) -> Specification:
        return Specification(self.condition & other.condition)

    def __or__(self, other: Specification) -> Specification:
        return Specification(self.condition | other.condition)

    def __invert__(self) -> Specification:
        return Specification(~F.coalesce(self.condition, F.lit(False)))

    def satisfied(self) -> Column:
        return F.coalesce(self.condition, F.lit(False))

    def of(self, rows: DataFrame) -> DataFrame:
        return rows.filter(self.satisfied())


@dataclass(frozen=True)
class Relation:
    """Rows that filters refer to as name.field: a row matches if one with right = its left does."""

    rows: DataFrame
    left: str
    right: str


def _conditions(criteria: Criteria) -> list[tuple[str, Callable[[Column], Column]]]:
    """(field, condition) of every filter that is given."""
    out = [(k, lambda c, v=v: c == F.lit(v)) for k, v in criteria.equal.items() if v is not None]
    out += [(k, lambda c, v=v: c >= F.lit(v)) for k, v in criteria.at_least.items() if v is not None]
    out += [(k, lambda c, v=v: c < F.lit(v)) for k, v in criteria.before.items() if v is not None]
    return out + [(k, lambda c, v=v: F.contains(F.lower(c), F.lit(v.lower()))) for k, v in criteria.like.items() if v is not None]


def matching(rows: DataFrame, criteria: Criteria, relations: Mapping[str, Relation] | None = None, foreign: str = "error") -> DataFrame:
    """The rows that meet every given filter. A relation is joined once if any filter refers to it, and else not at all.

    A criteria of another type is an error, or matches everything where foreign is 'all', as in memory."""
    if not isinstance(criteria, Criteria):
        if foreign == "all":
            return rows
        raise TypeError(f"no mapping for {type(criteria).__name__}")
    own: list[Column] = []
    by: dict[str, list[Column]] = {}
    for name, condition in _conditions(criteria):
        relation, dot, field_ = name.partition(".")
        if dot and relation in (relations or {}):
            by.setdefault(relation, []).append(condition(F.col(field_)))
        else:
            own.append(condition(F.col(name)))
    out = rows.filter(reduce(lambda a, b: a & b, own)) if own else rows
    for relation, parts in by.items():
        r = (relations or {})[relation]
        keys = r.rows.filter(reduce(lambda a, b: a & b, parts)).select(F.col(r.right).alias("_right"))
        out = out.join(keys, F.col(r.left) == F.col("_right"), "left_semi")
    return out


def ordered(rows: DataFrame, sort: tuple[str, ...], allowed: tuple[str, ...], default: tuple[str, ...] = (), tie: tuple[str, ...] = ()) -> DataFrame:
    """rows by allowed fields alone; tie makes the order total, so that pages don't depend on the run."""
    names = sort or default
    if wrong := [s for s in names if s.lstrip("-") not in allowed]:
        raise ValueError(f"no sort by {wrong}")
    keys = [F.col(s[1:]).desc() if s.startswith("-") else F.col(s).asc() for s in names]
    return rows.orderBy(*keys, *tie) if keys or tie else rows


def find(rows: DataFrame, criteria: Criteria, allowed: tuple[str, ...] = (), default: tuple[str, ...] = (), tie: tuple[str, ...] = ()) -> DataFrame:
    out = ordered(matching(rows, criteria), criteria.sort, allowed, default, tie)
    out = out.offset(criteria.offset) if criteria.offset else out
    return out if criteria.limit is None else out.limit(criteria.limit)


def count(rows: DataFrame, criteria: Criteria) -> DataFrame:
    """One row, total: how many there are before paging."""
    return matching(rows, criteria).agg(F.count(F.lit(1)).alias("total"))


def exists(rows: DataFrame, criteria: Criteria) -> DataFrame:
    """One row, found. One row at most is looked at."""
    return matching(rows, criteria).select(F.lit(1).alias("x")).limit(1).agg((F.count("x") > 0).alias("found"))


def count_by(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def page(rows: DataFrame, criteria: Criteria, **order: Any) -> tuple[DataFrame, DataFrame]:
    """(items, total)."""
    return find(rows, criteria, **order), count(rows, criteria)


def get_by_id(rows: DataFrame, id_: Any = None, uuid: str | None = None, id_col: str = "id", uuid_col: str = "uuid") -> DataFrame:
    """The one row of an id or, without one, of a uuid. No key is an error; so is no row, once the result is read, by which
    the rows are read no more than once."""
    if id_ is None and uuid is None:
        raise NoKey("an id or a uuid")
    key = F.col(id_col) == F.lit(id_) if id_ is not None else F.col(uuid_col) == F.lit(uuid)
    said = f"not found: {id_col}={id_}" if id_ is not None else f"not found: {uuid_col}={uuid}"
    one = rows.filter(key).limit(1).agg(F.first(F.struct(*rows.columns)).alias("r"))
    kind = rows.schema.simpleString()
    return one.select(F.when(F.col("r").isNull(), F.raise_error(F.lit(said)).cast(kind)).otherwise(F.col("r")).alias("r")).select("r.*")


def one_or_none(rows: DataFrame, criteria: Criteria, **order: Any) -> DataFrame:
    """The first row that matches, or no row."""
    return find(rows, criteria, **order).limit(1)


def first_match(rows: DataFrame, keys: tuple[str, ...], condition: Column, value: Column, position: Column) -> DataFrame:
    """By key the value of the first row, by position, that meets a condition."""
    return rows.filter(condition).groupBy(*keys).agg(F.min_by(value, position).alias("value"))


def last_wins(rows: DataFrame, keys: tuple[str, ...], value: Column, position: Column) -> DataFrame:
    """By key the value of the last row by position."""
    return rows.groupBy(*keys).agg(F.max_by(value, position).alias("value"))


def upsert(current: DataFrame, changes: DataFrame, keys: tuple[str, ...], position: str) -> DataFrame:
    """current with changes saved by key; of several changes of a key the last by position counts."""
    both = current.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    w = W.partitionBy(*keys).orderBy(F.desc("_new"), F.desc(position))
    return both.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_new")


def delete(current: DataFrame, gone: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return current.join(gone.select(*keys), list(keys), "left_anti")


def duplicate_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that both have."""
    return a.select(key).intersect(b.select(key))


def merged(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Key-value rows of both; b's value where both have one."""
    right = b.select(key, F.col(value).alias("_b"), F.lit(True).alias("_in"))
    return a.join(right, key, "full_outer").select(key, F.when(F.col("_in"), F.col("_b")).otherwise(F.col(value)).alias(value))


def merged_strict(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """The rows of both; a key that is there twice is an error when read."""
    both = a.unionByName(b)
    values = [c for c in both.columns if c != key]
    said = F.raise_error(F.concat(F.lit("there twice: "), F.col(key).cast("string")))
    one = both.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*values)).alias("_r"))
    return one.withColumn("_r", F.when(F.col("_n") > 1, said.cast(both.select(*values).schema.simpleString())).otherwise(F.col("_r"))).select(key, "_r.*")


def listed(spark: SparkSession, values: Mapping[Any, str] | Iterable[Any], column: str = "value", text: str = "text") -> DataFrame:
    """All values of an enumeration as rows, in their order; with their texts where there is a map."""
    if isinstance(values, Mapping):
        return spark.createDataFrame(list(values.items()), [column, text])
    return spark.createDataFrame([(v,) for v in values], [column])


def translated(rows: DataFrame, column: str, table: Mapping[Any, str], to: str = "text") -> DataFrame:
    """rows with a column's value looked up in a map of constants; a value that isn't there is an error when read."""
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    found = F.try_element_at(pairs, F.col(column))
    return rows.withColumn(to, F.when(found.isNull(), F.raise_error(F.concat(F.lit("no text for "), F.col(column).cast("string"))).cast("string")).otherwise(found))


def given(**columns: Column) -> Column:
    """A map of the named values that aren't null, as texts, for a query string."""
    pairs = F.create_map(*[x for name, c in columns.items() for x in (F.lit(name), c.cast("string"))])
    return F.map_filter(pairs, lambda k, v: v.isNotNull())


def dto(rows: DataFrame, fields: Mapping[str, Column], nested: Mapping[str, tuple[Column, Mapping[str, Column]]] | None = None) -> DataFrame:
    """A projection to fields and nested structs, each null where its key column is."""
    inner = [F.when(key.isNotNull(), F.struct(*[c.alias(n) for n, c in cols.items()])).alias(name) for name, (key, cols) in (nested or {}).items()]
    return rows.select(*[c.alias(n) for n, c in fields.items()], *inner)


def allowed_values(rows: DataFrame, column: str, values: tuple[Any, ...]) -> DataFrame:
    """Rows whose value isn't one of an enumeration's."""
    return rows.filter(~F.coalesce(F.col(column).isin(*values), F.lit(False)))


def batches(rows: DataFrame, key: str, size: int, after: Any = None) -> Iterator[tuple[Any, DataFrame]]:
    """(last key, batch) by ranges of a key, none by offset: each reads on from the last key of the one before.

    Rows of equal keys are in one batch, which may then be longer; rows without a key are the last batch, of the key None.
    after: the key to go on from."""
    last = after
    while True:
        rest = rows.filter(F.col(key).isNotNull() if last is None else F.col(key) > F.lit(last))
        edge = rest.select(key).orderBy(key).limit(size).agg(F.max(key)).head()[0]
        if edge is None:
            break
        yield edge, rest.filter(F.col(key) <= F.lit(edge))
        last = edge
    unkeyed = rows.filter(F.col(key).isNull())
    if unkeyed.limit(1).count():
        yield None, unkeyed


#: Ranges of keys that rows are numbered in, at most, and the rows of one.
MOST_RANGES, RANGE_ROWS = 256, 100_000


def numbered_batches(rows: DataFrame, key: str, size: int) -> DataFrame:
    """rows with batch, the number from 0 of the size rows by key that each comes in: all batches at once, for work that
    needs no loop. Rows without a key come last; equal keys may be in two batches.

    Rows are numbered within ranges of keys, cut at a sample. Only the sample and the ranges' counts go to the driver."""
    total = rows.count()
    ranges = min(MOST_RANGES, total // RANGE_ROWS + 1)
    cuts: list[Any] = []
    if ranges > 1:
        sample = rows.select(key).filter(F.col(key).isNotNull()).sample(min(1.0, 64 * ranges / total), seed=1).orderBy(key)
        found = [r[0] for r in sample.collect()]
        cuts = sorted({found[len(found) * i // ranges] for i in range(1, ranges)}) if found else []
    kind = rows.schema[key].dataType
    bounds = F.array(*[F.lit(c).cast(kind) for c in cuts]) if cuts else F.array().cast(f"array<{kind.simpleString()}>")
    part = F.when(F.col(key).isNull(), len(cuts) + 1).otherwise(F.size(F.filter(bounds, lambda c: c < F.col(key))))
    parted = rows.withColumn("_part", part)
    counts = {r["_part"]: r["count"] for r in parted.groupBy("_part").count().collect()}
    before = [sum(counts.get(j, 0) for j in range(i)) for i in range(len(cuts) + 2)]
    place = F.row_number().over(W.partitionBy("_part").orderBy(key)) - 1 + F.get(F.array(*[F.lit(n).cast("long") for n in before]), F.col("_part"))
    return parted.withColumn("batch", F.floor(place / size)).drop("_part")


def backup(rows: DataFrame, root: str, fix: str, prefix: str, headers: tuple[str, ...], now: datetime | None = None) -> str:
    """Keep rows, to the columns in headers, as CSV under root/fix/prefix-date-time.csv; that path."""
    path = f"{root.rstrip('/')}/{fix}/{prefix}-{(now or datetime.now()).strftime('%Y%m%d-%H%M%S')}.csv"
    rows.select(*headers).write.option("header", True).csv(path)
    return path


#: Rows that one transaction of a fix may have.
LEAST_BATCH, MOST_BATCH = 1_000, 10_000


def data_fix(rows: DataFrame, condition: Column, changes: Mapping[str, Column], execute: bool, backup: Callable[[DataFrame], Any] | None = None, write: Callable[[DataFrame, int], None] | None = None, key: str | None = None, size: int = LEAST_BATCH, progress: str | None = None) -> DataFrame:
    """One row (matched, changed): a fix is dry unless told to execute.

    Then the rows it changes are first given to backup(), and written in batches of size rows by key, one transaction each,
    or at once without a key. progress: a folder that keeps the last key written, from which a fix that broke off goes on."""
    if not LEAST_BATCH <= size <= MOST_BATCH:
        raise ValueError(f"a transaction has {LEAST_BATCH} to {MOST_BATCH} rows")
    hit = rows.filter(condition)
    differs = reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(v) for c, v in changes.items()])
    out = hit.agg(F.count(F.lit(1)).alias("matched"), F.coalesce(F.sum(differs.cast("long")), F.lit(0)).alias("changed"))
    if not execute:
        return out
    new = hit.withColumns(dict(changes))
    first, done = 0, None
    if progress is not None and (kept := _kept(rows.sparkSession, progress)) is not None:
        first, done = kept
    elif backup is not None:
        backup(hit)
    if write is not None and key is None:
        write(new, 0)
    elif write is not None:
        for number, (edge, _) in enumerate(batches(hit, key, size, done), first):
            past = F.lit(True) if done is None else F.col(key) > F.lit(done)
            part = hit.filter(F.col(key).isNull() if edge is None else past & (F.col(key) <= F.lit(edge)))
            write(part.withColumns(dict(changes)), number)
            done = edge
            if progress is not None and edge is not None:
                rows.sparkSession.createDataFrame([(number, edge)], ["batch", "last"]).write.mode("append").parquet(progress)
    return out


def _kept(spark: SparkSession, progress: str) -> tuple[int, Any] | None:
    """(number of the next batch, last key) of a fix that has begun, by what it kept."""
    path = spark._jvm.org.apache.hadoop.fs.Path(progress)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    row = spark.read.parquet(progress).agg(F.max(F.struct("batch", "last")).alias("m")).head()
    return (row.m.batch + 1, row.m.last) if row.m is not None else None
