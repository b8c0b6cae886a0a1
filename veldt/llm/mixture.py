"""Mixing sources to target weights by the cube method.

1. Tokens of every document are counted once; totals per source follow.
2. The largest total is planned at which every source reaches its share within its repeat limit. A
   source's expected number of uses per document splits into a whole part, which every document gets,
   and a fraction, its inclusion probability for one more use.
3. Flight: fractions move along the null space of the constraints (documents, tokens), three documents
   at a time, until one of them is 0 or 1; so both totals of the source stay exactly as planned. Every
   task keeps at most two open documents per source and streams over the rest: no shuffle.
4. The open documents of all tasks, at most two per task and source, fly on in a tree: each level joins those
   of up to ``fan_in`` / 2 tasks of the level before, so that no task meets more than ``fan_in`` of a source.
   What is left at its root, at most two per source, is the landing problem, solved by enumeration.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veldt.llm.tokens import PATTERN, RANKS, with_tokens
from veldt.plans.materialize import Scratch

_EPS = 1e-9


@dataclass(frozen=True)
class SourcePlan:
    source: str
    target_share: float | None
    max_repeats: int
    documents: int
    tokens: int
    uses: float  # expected uses of a document

    @property
    def whole(self) -> int:
        return min(self.max_repeats, int(self.uses + _EPS))

    @property
    def fraction(self) -> float:
        x = self.uses - self.whole
        return 0.0 if x < 1e-7 or self.whole >= self.max_repeats else min(x, 1.0)


def plan_mixture(targets: list[tuple[str, float | None, int]], available: dict[str, tuple[int, int]], total: float | None = None, least: float = 0.5) -> list[SourcePlan]:
    """Expected uses per source; ``available`` gives (documents, tokens).

    Without ``total`` the largest one is taken at which all sources with a target and with tokens reach it.
    With it, sources that cannot reach theirs are used up to their limit. What the targets of present
    sources leave of 1 is filled from sources without a target; where those do not suffice, the total
    shrinks for them, to ``least`` of it at most.
    """
    wanted = {s: share for s, share, _ in targets if share is not None and share > 0 and available.get(s, (0, 0))[1] > 0}
    limit = {s: max(0, int(r)) for s, _, r in targets}
    free = {s: limit[s] * available[s][1] for s, share, _ in targets if share is None and available.get(s, (0, 0))[1] > 0}
    left = max(0.0, 1.0 - sum(wanted.values()))
    if total is None:
        total = min((limit[s] * available[s][1] / share for s, share in wanted.items()), default=0.0)
        if left > _EPS and sum(free.values()):
            total = max(least * total, min(total, sum(free.values()) / left))
    rest = left * total
    part = min(1.0, rest / sum(free.values())) if sum(free.values()) and rest > _EPS * total else 0.0
    out = []
    for s, share, _ in targets:
        documents, tokens = available.get(s, (0, 0))
        uses = min(limit[s], wanted[s] * total / tokens) if s in wanted else part * limit[s] if s in free else 0.0
        out.append(SourcePlan(s, share, limit[s], documents, tokens, uses))
    return out


class Flight:
    """The flight phase of one source, fed one document at a time."""

    def __init__(self, rng: np.random.Generator):
        self.rng = rng
        self.open: list[list] = []  # [key, tokens, probability]

    def feed(self, key: object, tokens: int, probability: float) -> Iterator[tuple[object, int, int]]:
        """Take a document in; yields (key, tokens, chosen) of documents that are decided."""
        self.open.append([key, tokens, probability])
        yield from self._settled()
        while len(self.open) == 3:
            (_, t1, p1), (_, t2, p2), (_, t3, p3) = self.open
            u = (t2 - t3, t3 - t1, t1 - t2)  # orthogonal to (1, 1, 1) and to the tokens
            if u == (0, 0, 0):
                u = (1, -1, 0)
            up = down = float("inf")
            for p, d in zip((p1, p2, p3), u, strict=True):
                if d > 0:
                    up, down = min(up, (1 - p) / d), min(down, p / d)
                elif d < 0:
                    up, down = min(up, p / -d), min(down, (1 - p) / -d)
            step = up if self.rng.random() * (up + down) < down else -down
            for x, d in zip(self.open, u, strict=True):
                x[2] += step * d
            yield from self._settled()

    def _settled(self) -> Iterator[tuple[object, int, int]]:
        still = []
        for x in self.open:
            if _EPS < x[2] < 1 - _EPS:
                still.append(x)
            else:
                yield x[0], x[1], int(x[2] > 0.5)
        self.open = still

    def land(self) -> list[tuple[object, int, int]]:
        """Decide the at most two open documents so that the tokens, then the documents, are nearest."""
        tokens, count = sum(x[1] * x[2] for x in self.open), sum(x[2] for x in self.open)
        best = min(product((0, 1), repeat=len(self.open)), key=lambda c: (abs(sum(x[1] * y for x, y in zip(self.open, c, strict=True)) - tokens), abs(sum(c) - count), c))
        out = [(x[0], x[1], y) for x, y in zip(self.open, best, strict=True)]
        self.open = []
        return out


def mix_sources(
    docs: DataFrame,
    targets: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    total_tokens: float | None = None,
    seed: int = 42,
    ranks: str = RANKS,
    pattern: str = PATTERN,
    max_sources: int = 100_000,
    fan_in: int = 2_000,
) -> tuple[DataFrame, list[SourcePlan]]:
    """((key, source, tokens, repeats) of the chosen documents, the plan per source).

    Sources are compared without case and outer blanks. Defined results: documents without tokens (null
    or empty text), of null sources and of sources that ``targets`` does not name are not used; a null
    share means no target, a null limit 1; repeated rows count as separate documents; other columns are
    not read; an empty table on either side chooses nothing. A choice is reproducible: it depends on the
    seed and on the rows of the files only.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixture")
    name = F.lower(F.trim(F.col(source)))
    listed = targets.select(name.alias("source"), F.col("target_share").cast("double"), F.coalesce(F.col("max_repeats").cast("int"), F.lit(1)))
    rows = [tuple(r) for r in listed.filter("source IS NOT NULL").limit(max_sources + 1).collect()]
    if len(rows) > max_sources:
        raise ValueError(f"more than {max_sources} target sources")
    known = [r[0] for r in rows]
    counted = scratch.write(with_tokens(docs.filter(name.isin(known) & F.col(text).isNotNull()), [(key, docs[key]), ("source", F.lower(F.trim(docs[source])))], text, ranks, pattern).filter("tokens > 0"), "tokens")
    # at most one row per target source
    available = {r.source: (r.n, r.t) for r in counted.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("t")).collect()}
    plan = plan_mixture(rows, available, total_tokens)
    whole, fraction = {p.source: p.whole for p in plan}, {p.source: p.fraction for p in plan}
    kind = counted.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, source string, tokens long, extra int, open double"

    def fly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flights: dict[str, Flight] = {}

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            types = (None, pa.string(), pa.int64(), pa.int32(), pa.float64())
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            arrays = [pa.array(c, t or key_type) for c, t in zip(columns, types, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, names=[key, "source", "tokens", "extra", "open"])

        key_type = pa.int64()
        for batch in batches:
            key_type = batch.schema.field(0).type
            out: list[tuple] = []
            for k, s, t in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                p = fraction[s]
                if p == 0.0:
                    out.append((k, s, t, 0, None))
                    continue
                if s not in flights:  # seeded by the first document that the task meets
                    flights[s] = Flight(np.random.default_rng([seed, abs(hash_of(k)), t]))
                out.extend((dk, s, dt, chosen, None) for dk, dt, chosen in flights[s].feed(k, t, p))
            yield batch_of(out)
        yield batch_of([(k, s, t, None, p) for s, f in flights.items() for k, t, p in f.open])

    def fly_on(frame: pd.DataFrame) -> pd.DataFrame:
        return node_of_tree(frame, land=False)

    def fly_home(frame: pd.DataFrame) -> pd.DataFrame:
        return node_of_tree(frame, land=True)

    def node_of_tree(frame: pd.DataFrame, land: bool) -> pd.DataFrame:
        frame = frame.sort_values([key, "tokens", "open"], kind="stable")
        flight = Flight(np.random.default_rng([seed, len(frame)]))
        out = [(*x, None) for row in frame.itertuples(index=False) for x in flight.feed(row[0], int(row[2]), float(row[4]))]
        out += [(*x, None) for x in flight.land()] if land else [(k, t, 0, p) for k, t, p in flight.open]
        columns = dict(zip((key, "tokens", "extra", "open"), zip(*out, strict=True), strict=True)) if out else {c: [] for c in (key, "tokens", "extra", "open")}
        return pd.DataFrame({**columns, "source": frame["source"].iloc[0]})[[key, "source", "tokens", "extra", "open"]].astype({"open": float})

    flown = scratch.write(counted.select(key, "source", "tokens").mapInArrow(fly, schema), "flown")
    decided, still = [flown.filter("open IS NULL")], flown.filter("open IS NOT NULL")
    level = 0
    while True:
        most = still.groupBy("source").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        root = most <= fan_in
        # so many nodes that the largest source's have some half of fan_in each
        node = F.lit(0) if root else F.pmod(F.xxhash64(F.lit(level), key, "tokens", "open"), F.lit(-(-2 * most // fan_in)))
        flew = still.groupBy("source", node.alias("node")).applyInPandas(fly_home if root else fly_on, schema)
        flew = scratch.write(flew, f"level-{level}")
        decided.append(flew.filter("open IS NULL"))
        if root:
            break
        still, level = flew.filter("open IS NOT NULL"), level + 1
    chosen = reduce(DataFrame.union, decided).select(key, "source", "tokens", "extra")
    base = F.create_map(*(F.lit(x) for s, n in (whole or {"": 0}).items() for x in (s, n)))
    return chosen.select(key, "source", "tokens", (base[F.col("source")] + F.col("extra")).cast("int").alias("repeats")).filter("repeats > 0"), plan


def hash_of(value: object) -> int:
    """A hash that is the same in every process."""
    import xxhash

    return xxhash.xxh64_intdigest(repr(value))


def mixture_shares(mix: DataFrame, plan: list[SourcePlan]) -> DataFrame:
    """A row per target source: target and reached share, repeats and limits."""
    spark = mix.sparkSession
    told = spark.createDataFrame(
        [(p.source, p.target_share, p.max_repeats, p.documents, p.tokens) for p in plan],
        "source string, target_share double, max_repeats int, documents long, tokens long",
    )
    used = mix.groupBy("source").agg(F.count(F.lit(1)).alias("chosen"), F.max("repeats").alias("most_repeats"), F.sum(F.col("tokens") * F.col("repeats")).alias("mixed_tokens"))
    # at most one row per target source: a window over all of them reads the mixture once
    whole = F.sum("mixed_tokens").over(W.partitionBy())
    joined = told.join(F.broadcast(used), "source", "left").fillna(0, ["chosen", "most_repeats", "mixed_tokens"])
    return joined.withColumn("reached_share", F.try_divide("mixed_tokens", whole))
