"""Distinct counts over huge identifier sets with k-minimum-values sketches.

A sketch keeps the k smallest 63-bit hash values of a set. Its k-th smallest, as a share theta of
the hash range, gives (k - 1) / theta as the estimate with a relative standard error of about
1 / sqrt(k - 2); with fewer than k values the sketch holds the set's size exactly. Sketches of the
same k merge by keeping the k smallest of both, which gives the sketch of the union, so partial
results can be stored and merged later in any order. Intersections and differences compare the
values below the smaller theta.

Every value carries one bit, whether the id is known; a packed sketch holds the k smallest values of
all ids and the k smallest of the known ones, so that both sets come from one pass.

Every task combines its own rows first (numpy, no row loop) and its partial sketches are written. They
are then shuffled by the leading dimension and merged as a stream: a task holds one value of it at a
time, compressed. A value with many partials, a day that a third of all rows hold, say, is merged over
several tasks first. Merged sketches are a table that can be stored, and merged again by coarser groups.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldt.operators.sizing import small
from veldt.plans.materialize import Scratch

SPAN = float(2**63)


def hash63(values: np.ndarray) -> np.ndarray:
    """63-bit hash values: the splitmix64 finaliser, whose constants are fixed."""
    x = values.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) >> np.uint64(1)


def compress(group: np.ndarray, entry: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted (group, entry) without repeats: each group's k smallest entries and k smallest known ones.

    An entry is the hash value times two plus the known bit; of one value known and not, known stays.
    """
    if not len(group):
        return group, entry
    order = np.argsort(entry, kind="stable")
    narrow = group.astype(np.int16) if group.max(initial=0) < 32000 else group  # radix sort for small codes
    order = order[np.argsort(narrow[order], kind="stable")]
    group, entry = group[order], entry[order]
    keep = np.ones(len(group), dtype=bool)
    keep[:-1] = (group[1:] != group[:-1]) | (entry[1:] >> np.uint64(1) != entry[:-1] >> np.uint64(1))
    group, entry = group[keep], entry[keep]
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[first, len(group)])
    if sizes.max() > k:
        known = (entry & np.uint64(1)).astype(np.int64)
        rank = np.arange(len(group)) - np.repeat(first, sizes)
        so_far = np.cumsum(known)
        rank_known = so_far - np.repeat(so_far[first] - known[first], sizes)
        keep = (rank < k) | ((known == 1) & (rank_known <= k))
        group, entry = group[keep], entry[keep]
    return group, entry


def estimate(values: np.ndarray, k: int, z: float = 2.0) -> tuple[float, float, float, float]:
    """(estimate, lower, upper, theta) of a sketch's sorted hash values; exact below k values."""
    n = len(values)
    if n < k:
        return float(n), float(n), float(n), 1.0
    theta = (float(values[k - 1]) + 1) / SPAN
    mid = (k - 1) / theta
    e = z / math.sqrt(k - 2)
    return mid, max(float(k), mid / (1 + e)), mid / (1 - e), theta


def overlap(a: np.ndarray, b: np.ndarray, k: int, z: float = 2.0) -> dict[str, tuple[float, float, float]]:
    """Intersection and differences of two sketches, each (estimate, lower, upper)."""
    theta = min(estimate(a, k)[3], estimate(b, k)[3])
    if theta < 1:
        a, b = (x[x < np.uint64(min(theta * SPAN, SPAN - 1))] for x in (a, b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    out = {}
    for name, n in (("both", both), ("a_only", len(a) - both), ("b_only", len(b) - both)):
        e = 0.0 if theta == 1 else z * math.sqrt((n + 1) * (1 - theta)) / theta
        mid = n / theta
        out[name] = (mid, max(0.0, mid - e), mid + e)
    return out


def _counted(n: int, one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray], k: int, z: float) -> np.ndarray:
    """(estimate, lower, upper) of either side, union, both, and either side only, of ``n`` groups given as (group, entry).

    Groups of fewer than k values on both sides and in their union are exact, and counted all at once.
    """
    (ra, a), (rb, b) = ((r, e >> np.uint64(1)) for r, e in (one, two))
    na, nb = np.bincount(ra, minlength=n), np.bincount(rb, minlength=n)
    order = np.lexsort((np.r_[a, b], np.r_[ra, rb]))
    row, value = np.r_[ra, rb][order], np.r_[a, b][order]
    twice = (row[1:] == row[:-1]) & (value[1:] == value[:-1]) if len(row) else np.zeros(0, bool)
    both = np.bincount(row[1:][twice], minlength=n) if len(row) else np.zeros(n, np.int64)
    exact = np.stack([na, nb, na + nb - both, both, na - both, nb - both], axis=1).astype(float)
    out = np.repeat(exact[:, :, None], 3, axis=2)
    starts = [np.searchsorted(r, np.arange(n + 1)) for r in (ra, rb)]
    for g in np.flatnonzero((na >= k) | (nb >= k) | (na + nb - both >= k)).tolist():
        x, y = (e[s[g] : s[g + 1]][:k] for e, s in zip((a, b), starts, strict=True))
        shared = overlap(x, y, k, z)
        union = np.union1d(x, y)[:k]
        out[g] = [estimate(x, k, z)[:3], estimate(y, k, z)[:3], estimate(union, k, z)[:3], shared["both"], shared["a_only"], shared["b_only"]]
    return out


class _Table:
    """Growing arrays of (group, entry) that are compressed whenever they have doubled."""

    def __init__(self, k: int, least: int = 2_000_000):
        self.k, self.least, self.limit = k, least, least
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, group: np.ndarray, entry: np.ndarray) -> None:
        self.parts.append((group, entry))
        self.size += len(group)
        if self.size > self.limit:
            self.fold()
            self.limit = max(self.least, 2 * self.size)

    def fold(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.parts) > 1 or self.parts:
            g, e = (np.concatenate(x) for x in zip(*self.parts, strict=True))
            g, e = compress(g, e, self.k)
            self.parts = [(g, e)]
            self.size = len(g)
            return g, e
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)


class _Codes:
    """Dictionary codes of tuples of values (None allowed)."""

    def __init__(self) -> None:
        self.of: dict[tuple, int] = {}
        self.keys: list[tuple] = []

    def code(self, key: tuple) -> int:
        c = self.of.setdefault(key, len(self.keys))
        if c == len(self.keys):
            self.keys.append(key)
        return c


def _row_codes(columns: list[pa.Array], codes: _Codes) -> np.ndarray:
    """A code per row for the tuple of its column values, distinct tuples looked up once."""
    mixed, radix, values = np.zeros(len(columns[0]), dtype=np.int64), 1, []
    for c in columns:
        d = c.dictionary_encode() if not isinstance(c, pa.DictionaryArray) else c
        idx = pc.fill_null(d.indices.cast(pa.int64()), len(d.dictionary)).to_numpy(zero_copy_only=False)
        vals = [*d.dictionary.to_pylist(), None]
        mixed = mixed + idx * radix
        values.append((radix, vals))
        radix *= len(vals)
    found, back = np.unique(mixed, return_inverse=True)
    here = np.array([codes.code(tuple(vals[m // r % len(vals)] for r, vals in values)) for m in found.tolist()], dtype=np.int64)
    return here[back] if len(found) else back.astype(np.int64)


def _packed(names: list[str], types: list[pa.DataType], keys: list[tuple], sides: list[str], group: np.ndarray, entry: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row per key with its packed sketch of either side; the codes in ``group`` are 2 * key + side."""
    at = np.unique(group // 2)
    bodies = []
    for side in (0, 1):
        mine = group % 2 == side
        of = group[mine] // 2
        ends = np.searchsorted(of, at, side="right").astype(np.int64)
        offsets = np.r_[np.zeros(1, np.int64), ends] * 8
        bodies.append(pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(entry[mine]))]))
    rows = [keys[c] for c in at.tolist()]
    columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
    # all of a task's sketches may exceed the 2 GB of 32-bit offsets, 1,000 of them never do
    for first in range(0, len(rows), 1000):
        part = (x.slice(first, 1000) for x in columns)
        yield pa.RecordBatch.from_arrays([*part, *(x.slice(first, 1000).cast(pa.binary()) for x in bodies)], names=[*names, *(f"sketch_{s}" for s in sides)])


def _entries(batch: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray]:
    """(row of each entry, entries) of a column of packed sketches."""
    body = batch.column(column).cast(pa.large_binary())
    _, off, data = body.buffers()
    off = np.frombuffer(off, np.int64)[body.offset : body.offset + len(body) + 1]
    flat = np.frombuffer(data, np.uint8)[off[0] : off[-1]].view(np.uint64) if off[-1] > off[0] else np.zeros(0, np.uint64)
    return np.repeat(np.arange(len(body)), np.diff(off) // 8), flat


def sketch_groups(df: DataFrame, dims: list[str], sides: tuple[str, str], k: int, known: tuple[str, str] | None = None) -> DataFrame:
    """Partial sketches, one per task and dimension values: (dims..., sketch_<side>, sketch_<side>)."""
    names = list(dims)
    picked = df.select(*dims, *(F.col(s).cast("long").alias(f"__{i}") for i, s in enumerate(sides)), *(F.col(c).alias(f"__known{i}") for i, c in enumerate(known or ())))
    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(picked.schema[d].dataType) for d in dims]
    m, labels, flagged = len(dims), list(sides), known is not None

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, table = _Codes(), _Table(k)
        for batch in batches:
            key = _row_codes([batch.column(i) for i in range(m)], codes)
            for side in (0, 1):
                col = batch.column(m + side)
                there = np.asarray(col.is_valid())
                ids = pc.fill_null(col, 0).to_numpy(zero_copy_only=False)[there]
                bit = pc.fill_null(batch.column(m + 2 + side), False).to_numpy(zero_copy_only=False)[there].astype(np.uint64) if flagged else np.uint64(1)
                table.add(2 * key[there] + side, hash63(ids) * np.uint64(2) + bit)
        yield from _packed(names, types, codes.keys, labels, *table.fold())

    schema = ", ".join(f"`{d}` {picked.schema[d].dataType.simpleString()}" for d in dims)
    return picked.mapInArrow(scan, schema + "".join(f", sketch_{s} binary" for s in sides))


def _schema(df: DataFrame, names: list[str], sides: tuple[str, str]) -> str:
    return ", ".join(f"`{d}` {df.schema[d].dataType.simpleString()}" for d in names) + "".join(f", sketch_{s} binary" for s in sides)


def _merge_partition(names: list[str], types: list[pa.DataType], sides: list[str], k: int):
    """A function that merges the sketches of equal ``names`` within a partition."""
    m = len(names)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, table = _Codes(), _Table(k)
        for batch in batches:
            key = _row_codes([batch.column(i) for i in range(m)], codes)
            for side in (0, 1):
                rows, entry = _entries(batch, m + side)
                table.add(2 * key[rows] + side, entry)
        yield from _packed(names, types, codes.keys, sides, *table.fold())

    return merge


def merge_groups(sketches: DataFrame, dims: list[str], sides: tuple[str, str], k: int, salts: int = 8) -> DataFrame:
    """(dims..., sketch_<side>, sketch_<side>): stored sketches, say of days, merged by groups, say months.

    Every group is merged over ``salts`` tasks first.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(sketches.schema[d].dataType) for d in dims]
    parts = int(sketches.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns, schema = [*dims, *(f"sketch_{s}" for s in sides)], _schema(sketches, dims, sides)
    merge = _merge_partition(list(dims), types, list(sides), k)
    salt = F.pmod(F.xxhash64(*(f"sketch_{s}" for s in sides)), F.lit(salts))
    first = sketches.select(*columns, salt.alias("__salt")).repartition(parts, *dims, "__salt").select(*columns).mapInArrow(merge, schema)
    return first.repartition(parts, *dims).mapInArrow(merge, schema)


def _spread(partials: DataFrame, dims: list[str], sides: tuple[str, str], k: int, salt_bytes: int) -> DataFrame:
    """``partials``, a written table, with those of every leading value of over ``salt_bytes`` merged to a few per group."""
    lead = dims[0]
    size = F.sum(sum((F.length(f"sketch_{s}") for s in sides), F.lit(0)))
    heavy = partials.groupBy(lead).agg(size.alias("bytes")).filter(F.col("bytes") > salt_bytes)
    # at most the sketches' bytes over salt_bytes: a handful of days
    salts = heavy.select(lead, F.ceil(F.col("bytes") / F.lit(salt_bytes)).cast("int").alias("salts")).collect()
    if not salts:
        return partials
    is_heavy = [F.col(lead).eqNullSafe(F.lit(r[0])) for r in salts]
    count = F.coalesce(*(F.when(c, F.lit(r.salts)) for c, r in zip(is_heavy, salts, strict=True)))
    hot = reduce(lambda a, b: a | b, is_heavy)
    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(partials.schema[d].dataType) for d in dims]
    parts = int(partials.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = partials.columns
    salt = F.pmod(F.xxhash64(*(f"sketch_{s}" for s in sides)), count)
    picked = partials.filter(hot).withColumn("__salt", salt).repartition(parts, lead, "__salt").select(*columns)
    merged = picked.mapInArrow(_merge_partition(list(dims), types, list(sides), k), _schema(partials, dims, sides))
    return partials.filter(~hot).union(merged)


def merge_cube(
    partials: DataFrame,
    dims: list[str],
    sides: tuple[str, str],
    k: int,
    sets: list[tuple[str, ...]],
    salt_bytes: int = 64_000_000,
) -> DataFrame:
    """Merged sketches (by, dims..., sketch_<side>, sketch_<side>) for every grouping set; dims outside a set are null.

    Sets with the leading dimension are finished in one shuffle by it; the others are combined there
    and merged in a second, small shuffle. Both merges stream sorted rows. Leading values whose partial
    sketches take more than ``salt_bytes`` are merged over several tasks before; ``partials`` should be
    a written table, as it is read for that, too.
    """
    spark = partials.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lead, labels, m = dims[0], list(sides), len(dims)
    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(partials.schema[d].dataType) for d in dims]
    inner = [s for s in sets if lead in s]
    outer = [s for s in sets if lead not in s]
    schema = "`by` string, " + _schema(partials, dims, sides)
    partials = _spread(partials, dims, sides, k, salt_bytes)

    def out(by: str, keys: list[tuple], group: np.ndarray, entry: np.ndarray) -> Iterator[pa.RecordBatch]:
        for part in _packed(dims, types, keys, labels, group, entry):
            yield pa.RecordBatch.from_arrays([pa.array([by] * part.num_rows, pa.string()), *part.columns], names=["by", *part.schema.names])

    def regroup(codes: _Codes, sets_: list[tuple[str, ...]]) -> list[tuple[str, _Codes, np.ndarray]]:
        made = []
        for s in sets_:
            coarse = _Codes()
            to = np.array([coarse.code(tuple(v if d in s else None for d, v in zip(dims, key, strict=True))) for key in codes.keys], dtype=np.int64)
            made.append((",".join(s), coarse, to))
        return made

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coarse = {s: (_Codes(), _Table(k)) for s in outer}
        codes, table, open_lead = _Codes(), _Table(k), None

        def finish() -> Iterator[pa.RecordBatch]:
            nonlocal codes, table
            group, entry = table.fold()
            for by, fine, to in regroup(codes, inner):
                yield from out(by, fine.keys, *compress(2 * to[group // 2] + group % 2, entry, k))
            for s in outer:
                mine, kept = coarse[s]
                to = np.array([mine.code(tuple(v if d in s else None for d, v in zip(dims, key, strict=True))) for key in codes.keys], dtype=np.int64)
                kept.add(2 * to[group // 2] + group % 2, entry)
            codes, table = _Codes(), _Table(k)

        # rows are sorted by the leading dimension: its complete values are finished once it is worth it
        held = 0
        for batch in batches:
            key = _row_codes([batch.column(i) for i in range(m)], codes)
            leads = batch.column(0).to_pylist()
            last = next((i + 1 for i in range(len(leads) - 1, -1, -1) if leads[i] != leads[-1]), 0)
            fresh = bool(leads) and open_lead is not None and (last > 0 or open_lead[0] != leads[0])
            sides_ = [_entries(batch, m + side) for side in (0, 1)]
            held += sum(len(e) for _, e in sides_)
            cut = last if fresh and held >= 1_000_000 else len(leads)
            for side, (rows, entry) in enumerate(sides_):
                done = rows < cut
                table.add(2 * key[rows[done]] + side, entry[done])
            if cut < len(leads):
                keys = codes.keys
                yield from finish()
                again = np.array([codes.code(keys[c]) for c in key[cut:].tolist()], dtype=np.int64)
                for side, (rows, entry) in enumerate(sides_):
                    rest = rows >= cut
                    table.add(2 * again[rows[rest] - cut] + side, entry[rest])
                held = sum(int((rows >= cut).sum()) for rows, _ in sides_)
            open_lead = (leads[-1],) if leads else open_lead
        yield from finish()
        for s in outer:
            yield from out(",".join(s), coarse[s][0].keys, *coarse[s][1].fold())

    merged = partials.repartition(parts, lead).sortWithinPartitions(lead).mapInArrow(first, schema)
    if not outer:
        return merged
    # the sets without the leading dimension still have one partial per task
    names = [",".join(s) for s in outer]
    stage = Scratch(spark, "kmv").write(merged, "merged")
    rest = stage.filter(F.col("by").isin(names)).repartition(parts, "by", *dims).mapInArrow(_merge_partition(["by", *dims], [pa.string(), *types], labels, k), schema)
    return stage.filter(~F.col("by").isin(names)).union(rest)


def cube_sets(dims: list[str]) -> list[tuple[str, ...]]:
    return [s for r in range(len(dims), -1, -1) for s in combinations(dims, r)]


def distinct_counts(sketches: DataFrame, dims: list[str], sides: tuple[str, str], k: int, z: float = 2.0) -> DataFrame:
    """Estimates per group from merged sketches of both sides.

    what: either side, ``union``, ``both``, or ``<side>_only``; scope: ``all`` ids or ``known`` ones.
    lower and upper bound the estimate by ``z`` standard errors; they equal it where it is exact.
    """
    keys = ["by", *dims]
    wide = sketches.select(*keys, *(f"sketch_{s}" for s in sides))
    labels, m = list(sides), len(keys)
    schema = ", ".join(f"`{c}` {wide.schema[c].dataType.simpleString()}" for c in keys) + ", what string, scope string, estimate double, lower double, upper double"

    names = [labels[0], labels[1], "union", "both", f"{labels[0]}_only", f"{labels[1]}_only"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            (ra, ea), (rb, eb) = (_entries(batch, m + i) for i in (0, 1))
            values = np.zeros((2, n, 6, 3))
            for scope in (0, 1):
                pa_, pb_ = ((r, e) if scope == 0 else (r[e & np.uint64(1) == 1], e[e & np.uint64(1) == 1]) for r, e in ((ra, ea), (rb, eb)))
                values[scope] = _counted(n, pa_, pb_, k, z)
            flat = values.transpose(1, 0, 2, 3).reshape(-1, 3)
            index = pa.array(np.repeat(np.arange(n), 12))
            what = pa.array(names * (2 * n), pa.string())
            scope_ = pa.array((["all"] * 6 + ["known"] * 6) * n, pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(index) for i in range(m)), what, scope_, *(pa.array(flat[:, i]) for i in range(3))], names=[*keys, "what", "scope", "estimate", "lower", "upper"])

    return wide.mapInArrow(rows, schema)


def mark_known(df: DataFrame, columns: tuple[str, str], parents: DataFrame, key: str = "id") -> DataFrame:
    """``df`` with ``known_<column>``: whether the id occurs in ``parents``.

    The distinct ids that do *not* occur are normally few: they are broadcast behind a check of
    their number, so that the large table is not shuffled; beyond it both sides are shuffled.
    """
    scratch = Scratch(df.sparkSession, "unknown")
    known = parents.select(F.col(key).cast("long").alias("id")).filter("id IS NOT NULL").distinct()
    ids = df.select(F.explode(F.array(*(F.col(c).cast("long") for c in columns))).alias("id")).filter("id IS NOT NULL").groupBy("id").agg(F.lit(1))
    unknown = scratch.write(ids.select("id").join(known, "id", "left_anti"), "unknown")
    few = small(unknown)
    out = df
    for c in columns:
        side = (F.broadcast(unknown) if few else unknown).select(F.col("id").alias(f"__{c}"), F.lit(False).alias(f"known_{c}"))
        out = out.join(side, out[c] == F.col(f"__{c}"), "left").drop(f"__{c}").withColumn(f"known_{c}", F.coalesce(f"known_{c}", F.lit(True)))
    return out


def distinct_cube(df: DataFrame, dims: list[str], sides: tuple[str, str], parents: DataFrame, k: int = 4096) -> DataFrame:
    """Distinct ids of both sides, their union and overlap, per value of every combination of ``dims``.

    With k = 4096 the relative standard error is 1.6 %, the bounds hold 95 %; groups of fewer ids
    are exact. Defined results: null ids are not counted; a null dimension value is a group of its
    own (``by`` tells it from a dimension summed over); repeated rows count once; an empty table
    gives no rows; other columns are not read.
    """
    return distinct_counts(cube_sketches(df, dims, sides, parents, k, cube_sets(dims)), dims, sides, k)


def cube_sketches(df: DataFrame, dims: list[str], sides: tuple[str, str], parents: DataFrame, k: int, sets: list[tuple[str, ...]], salt_bytes: int = 64_000_000) -> DataFrame:
    """(by, dims..., sketch_<side>, sketch_<side>) for every grouping set: the mergeable results behind :func:`distinct_cube`."""
    scratch = Scratch(df.sparkSession, "sketches")
    marked = mark_known(df.select(*dims, *sides), sides, parents)
    partials = scratch.write(sketch_groups(marked, dims, sides, k, tuple(f"known_{s}" for s in sides)), "partials")
    return merge_cube(partials, dims, sides, k, sets, salt_bytes)
