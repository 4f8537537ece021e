"""Problem 6: filling fixed-capacity containers with items.

Method: mixture-controlled packing. Documents wait in one queue per source; deficit round-robin serves the queue that is furthest behind its
target share of tokens, window after window, and the deficit is carried from window to window. Partitions work in parallel: a first pass adds up
each partition's tokens per source, from which every partition's opening deficits follow (what the partitions before it leave behind), so
deficits are carried across partitions as well. The rest of a window that the leading queue's next document does not fit is offered
to the largest waiting document that does, which pays from its own queue's deficit.

A document above the capacity is cut into full containers and one rest; nothing else is cut, nothing is dropped. A partition holds documents of
about ``windows`` containers, whatever their sources, so a hot source is spread and memory stays bounded. What lies in each partition's last
container is taken out again and packed together, so that space left over does not grow with the number of partitions. Targets default to the sources' own shares of all tokens, the only ones every window can keep to the end;
a source without target is served by what it holds, and one that runs out leaves its share to the others.

Defined cases: a NULL text or one without tokens takes no space and has one empty piece in container NULL; a NULL source is a queue of its own; of repeated
keys one row is packed (the one with most tokens); equal sizes go by key; an empty table gives no pieces.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise, ship
from .tokens import token_sizes

SCHEMA = "doc_id bigint, piece int, pieces int, source string, first_token bigint, tokens bigint, container string, at int"


class Packer:
    """Deficit round-robin over the queues of one partition. ``deficit``: tokens each source is owed at the start."""

    def __init__(self, capacity: int, share: dict[str | None, float], deficit: dict[str | None, float]) -> None:
        self.capacity, self.share = capacity, share
        self.deficit = dict(deficit)

    def pack(self, items: Iterable[tuple[int, str | None, int]]) -> Iterator[tuple[int, str | None, int, int, int, int, int]]:
        """Yields (key, source, piece, first token, tokens, window, place in window) for (key, source, tokens > 0)."""
        cap = self.capacity
        queues: dict[str | None, list[tuple[int, int, int, int]]] = {}
        window = 0
        for key, source, tokens in sorted(items, key=lambda x: x[0]):
            piece = first = 0
            while tokens - first > cap:
                yield key, source, piece, first, cap, window, 0
                self._served(source, cap)
                piece, first, window = piece + 1, first + cap, window + 1
            if tokens > first:
                queues.setdefault(source, []).append((tokens - first, key, piece, first))
        order: dict[str | None, int] = dict.fromkeys(queues, 0)  # next of each queue, in order of keys
        sizes = {s: sorted((n, i) for i, (n, *_) in enumerate(q)) for s, q in queues.items()}  # waiting, by size
        waiting = {s: [True] * len(q) for s, q in queues.items()}
        left = sum(map(len, queues.values()))
        while left:
            space, place = cap, 0
            while left:
                pick = self._pick(queues, order, waiting, sizes, space, place)
                if pick is None:
                    break
                s, i = pick
                n, key, piece, first = queues[s][i]
                waiting[s][i] = False
                del sizes[s][bisect_left(sizes[s], (n, i))]
                yield key, s, piece, first, n, window, place
                self._served(s, n)
                space, place, left = space - n, place + 1, left - 1
            window += 1

    def _served(self, source: str | None, n: int) -> None:
        for s, w in self.share.items():
            self.deficit[s] = self.deficit.get(s, 0.0) + w * n
        self.deficit[source] = self.deficit.get(source, 0.0) - n

    def _pick(self, queues: dict, order: dict, waiting: dict, sizes: dict, space: int, place: int) -> tuple | None:
        """The next document of the queue that is owed most, at the start of a window its largest, so that large ones are not left over;
        where the next one does not fit, the queue's largest that does; else the next queue's.
        Once a window is nearly full the largest fitting document of all queues closes it best."""
        ranked = sorted((s for s in queues if sizes[s]), key=lambda s: (-self.deficit.get(s, 0.0), s is None, s or ""))
        if space <= self.capacity // 8:
            best = None
            for s in ranked:
                k = bisect_right(sizes[s], (space, math.inf)) - 1
                if k >= 0 and (best is None or sizes[s][k][0] > best[0]):
                    best = (sizes[s][k][0], s, sizes[s][k][1])
            return best and best[1:]
        for s in ranked:
            q, w = queues[s], waiting[s]
            while order[s] < len(q) and not w[order[s]]:
                order[s] += 1
            if place and order[s] < len(q) and q[order[s]][0] <= space:
                return s, order[s]
            k = bisect_right(sizes[s], (space, math.inf)) - 1
            if k >= 0:
                return s, sizes[s][k][1]
        return None


def pack(df: DataFrame, capacity: int, key: str = "doc_id", text: str = "text", source: str = "source", targets: dict[str, float] | None = None, windows: int = 128) -> DataFrame:
    """One row per piece: (doc_id, piece, pieces, source, first_token, tokens, container, at)."""
    if capacity < 1:
        raise ValueError("capacity must be positive")
    spark = df.sparkSession
    every = token_sizes(df.filter(F.col(key).isNotNull()), key, text, source)
    sizes = materialise(every.groupBy("doc_key").agg(F.max(F.struct("tokens", "source")).alias("m")).select("doc_key", "m.source", "m.tokens"))
    total = sizes.agg(F.sum("tokens")).first()[0] or 0
    n = max(1, math.ceil(total / (capacity * windows)))
    placed = sizes.withColumn("part", F.pmod(F.xxhash64("doc_key"), F.lit(n)).cast("int"))
    by_part = placed.groupBy("part", "source").agg(F.sum("tokens").alias("n"))
    by_source = {r["source"]: r["n"] for r in by_part.groupBy("source").agg(F.sum("n").alias("n")).collect()}  # one row a source
    share = {s: v / max(total, 1) for s, v in by_source.items()} if targets is None else {s: targets.get(s, 0.0) for s in by_source}
    if not share:
        return spark.createDataFrame([], SCHEMA)
    # opening deficits: what the partitions before owe each source, less what they gave it; one small row a partition and source
    parts = _running(by_part.groupBy("part").agg(F.sum("n").alias("all")), ["all"], [])
    owed = F.explode(F.array(*[F.struct(F.lit(s).cast("string").alias("source"), F.lit(float(w)).alias("w")) for s, w in share.items()]))
    grid = parts.select("part", "before_all", owed.alias("k")).select("part", "before_all", "k.source", "k.w")
    got = _running(grid.join(by_part, (grid["part"] == by_part["part"]) & grid["source"].eqNullSafe(by_part["source"]), "left").select(grid["part"], grid["source"], "before_all", "w", F.coalesce("n", F.lit(0)).alias("n")), ["n"], ["source"])
    opening = got.groupBy("part").agg(F.collect_list(F.struct("source", (F.col("w") * F.col("before_all") - F.col("before_n")).alias("d"))).alias("opening"))
    work = placed.filter("tokens > 0").join(opening, "part").select("part", "doc_key", "source", "tokens", "opening", F.lit(0).alias("piece"), F.lit(0).cast("bigint").alias("first"), F.ceil(F.col("tokens") / capacity).cast("int").alias("pieces"))
    ship(spark)
    full = materialise(_level(work, n, capacity, share, ""))
    tail = full.filter("open")
    left = tail.agg(F.sum("tokens")).first()[0] or 0
    m = max(1, math.ceil(left / (capacity * windows)))
    owed_nothing = F.array(*[F.struct(F.lit(s).cast("string").alias("source"), F.lit(0.0).alias("d")) for s in share])
    again = tail.select(F.pmod(F.xxhash64("doc_id"), F.lit(m)).cast("int").alias("part"), F.col("doc_id").alias("doc_key"), "source", "tokens", owed_nothing.alias("opening"), "piece", F.col("first_token").alias("first"), "pieces")
    packed = full.filter("not open").drop("open").unionByName(_level(again, m, capacity, share, "t").drop("open"))
    none = placed.filter("tokens = 0").select(F.col("doc_key").alias("doc_id"), F.lit(0).alias("piece"), F.lit(1).alias("pieces"), "source", F.lit(0).cast("bigint").alias("first_token"), "tokens", F.lit(None).cast("string").alias("container"), F.lit(None).cast("int").alias("at"))
    return packed.unionByName(none)


def _level(work: DataFrame, n: int, capacity: int, share: dict[str | None, float], prefix: str) -> DataFrame:
    """One packing of (part, doc_key, source, tokens, opening, piece, first, pieces) rows, a task for each of n partitions; ``open``: in its partition's last container, which is not full."""
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        part = rows[0]["part"]
        packer = Packer(capacity, share, {x["source"]: x["d"] for x in rows[0]["opening"]})
        row = {r["doc_key"]: r for r in rows}
        out = list(packer.pack((r["doc_key"], r["source"], r["tokens"]) for r in rows))
        last = max(w for *_, w, _ in out)
        loose = sum(t for _, _, _, _, t, w, _ in out if w == last) < capacity
        made = [(k, row[k]["piece"] + p, row[k]["pieces"], s, row[k]["first"] + f, t, f"{prefix}{part}-{w}", a, loose and w == last) for k, s, p, f, t, w, a in out]
        types = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.bool_()]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*made), types)], names=[x.split()[0] for x in (SCHEMA + ", open").split(", ")])

    return work.repartition(n, "part").groupBy("part").applyInArrow(run, SCHEMA + ", open boolean")


BLOCK = 1000  # partitions whose sums are added up together


def _running(df: DataFrame, cols: list[str], per: list[str]) -> DataFrame:
    """Adds before_<col>: the sum over smaller partition numbers (per group), from one small row a partition and group. Blocks of partitions are added
    up first, so that no task orders more than the blocks or the rows of one block."""
    df = df.withColumn("_block", F.floor(F.col("part") / BLOCK))
    sums = df.groupBy(*per, "_block").agg(*[F.sum(c).alias(f"_{c}") for c in cols])
    before = lambda keys, by: Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*[F.col(c).alias(f"_p_{c}") for c in per], F.col("_block").alias("_b"), *[F.coalesce(F.sum(f"_{c}").over(before(per, "_block")), F.lit(0)).alias(f"_{c}") for c in cols])
    on = F.col("_block") == F.col("_b")
    for c in per:
        on = on & F.col(c).eqNullSafe(F.col(f"_p_{c}"))
    inner = before([*per, "_block"], "part")
    return df.join(offsets, on).select(*df.columns[:-1], *[(F.coalesce(F.sum(c).over(inner), F.lit(0)) + F.col(f"_{c}")).alias(f"before_{c}") for c in cols])


def containers(packed: DataFrame, capacity: int) -> DataFrame:
    """(container, pieces, tokens, unused)."""
    return packed.filter("container is not null").groupBy("container").agg(F.count(F.lit(1)).alias("pieces"), F.sum("tokens").alias("tokens")).withColumn("unused", F.lit(capacity) - F.col("tokens"))


def mixture(packed: DataFrame, capacity: int, targets: dict[str | None, float] | None = None) -> DataFrame:
    """(container, pieces, tokens, unused, source, share, target, deviation): the source whose share of a container's tokens is farthest from its target.
    Targets default to the sources' own shares, as in ``pack``."""
    per = packed.filter("container is not null").groupBy("container", F.coalesce("source", F.lit("")).alias("source")).agg(F.count(F.lit(1)).alias("pieces"), F.sum("tokens").alias("n"))
    if targets is None:
        every = {r["source"]: r["n"] for r in per.groupBy("source").agg(F.sum("n").alias("n")).collect()}  # one row a source
        targets = {s: n / max(1, sum(every.values())) for s, n in every.items()}
    whole = per.groupBy("container").agg(F.sum("pieces").alias("pieces"), F.sum("n").alias("tokens"), F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("m"))
    wanted = F.array(*[F.struct(F.lit(s or "").alias("source"), F.lit(float(w)).alias("target")) for s, w in targets.items()])
    share = lambda x: F.coalesce(F.col("m")[x["source"]], F.lit(0)) / F.col("tokens")
    far = F.array_max(F.transform(wanted, lambda x: F.struct(F.abs(share(x) - x["target"]).alias("deviation"), x["source"].alias("source"), share(x).alias("share"), x["target"].alias("target"))))
    return whole.select("container", "pieces", "tokens", (F.lit(capacity) - F.col("tokens")).alias("unused"), far.alias("f")).select("container", "pieces", "tokens", "unused", "f.source", "f.share", "f.target", "f.deviation")


def capacity_of(limits: DataFrame, kind: str = "training_window") -> int:
    r = limits.filter(F.col("container_kind") == kind).agg(F.min("capacity_tokens")).first()
    if r[0] is None:
        raise ValueError(f"no capacity for {kind}")
    return int(r[0])


def found(documents: DataFrame, limits: DataFrame) -> DataFrame:
    """p6_found: documents the packing had to cut."""
    packed = pack(documents, capacity_of(limits))
    return packed.filter("pieces > 1").select("doc_id").distinct()
