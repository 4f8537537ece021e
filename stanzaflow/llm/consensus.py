"""Problem 5: consensus from several annotators' labels.

Method: minimax conditional entropy. Given item j's true class c, annotator i says k with probability proportional to
exp(sigma_i(c, k) + tau_j(c, k)): tilting parameters of the annotator and of the item. They are fitted by coordinate ascent on the regularised dual,
alternating with the label posteriors and the class shares: a pass maximises over each item's posterior and tau, then moves every sigma by its own gradient
and curvature. Given the posteriors and tau, the dual falls apart into annotators and classes, and the Hessian of each part is at most twice its
diagonal, so half of the coordinatewise Newton step climbs; should the value (``dual``, one number a pass) fall all the same, the step is halved and
taken back. Agreement (pairwise per item, Krippendorff's alpha overall) is reported separately; an annotator's reliability is the probability of the
true class without item effects. ``beta`` holds tau a hundred times as tightly as ``alpha`` holds sigma, whatever the size of the table, as an item has
few labels and an annotator many.

Items are packed into chunks of about ``CHUNK`` judgments once; in a pass each chunk gives one row of sums per annotator, added up by a shuffle. Up to ``FEW``
annotators (4 MB) sigma is a broadcast variable. Beyond, it is a table, each chunk is joined to the rows of its own annotators, and the driver sees no more
than class shares and the value; results are the same. There is no bound on annotators; an item's judgments, one an annotator, meet in one task.

Defined cases: ids count without case and outer blanks; a label that is no option, NULL or blank is no judgment; of an annotator's judgments of an item the latest
``created_at`` holds (ties: greatest id, then label), records sent twice count once; equal posteriors go by the order of the options; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialise, ship
from ._rows import map_rows

OPTIONS = ("1st person", "2nd person", "3rd person", "Mixed", "Other")


def trimmed(c) -> F.Column:
    return F.lower(F.regexp_replace(c, r"(?U)^[\s\p{Cf}]+|[\s\p{Cf}]+$", ""))


def judgments(df: DataFrame, annotator: str = "annotator_id", item: str = "poem_id", label: str = "perspective_primary", at: str = "created_at", key: str = "id", options: tuple[str, ...] = OPTIONS) -> DataFrame:
    """(item, annotator, label): current judgments; label is the option's number."""
    said = F.regexp_replace(trimmed(F.col(label)), r"(?U)\s+", " ")
    number = F.lit(None).cast("int")
    for k, o in enumerate(options):
        number = F.when(said == o.lower(), k).otherwise(number)
    who = F.nullif(trimmed(F.col(annotator)), F.lit(""))
    what = F.nullif(F.regexp_replace(F.col(item).cast("string"), r"(?U)^\s+|\s+$", ""), F.lit(""))
    rows = df.select(what.alias("item"), who.alias("annotator"), number.alias("label"), F.struct(F.col(at), F.col(key).cast("string"), number).alias("order"))
    valid = rows.filter("item is not null and annotator is not null and label is not null")
    return valid.groupBy("item", "annotator").agg(F.max_by("label", "order").alias("label"))


class _Votes:
    """The judgments of a chunk, ordered by item: ``who`` are positions in ``names``. Arrays over judgments, items or annotators have these last."""

    def __init__(self, size: np.ndarray, who: np.ndarray, said: np.ndarray, k: int) -> None:
        self.n, self.k, self.who, self.said = len(size), k, who, said
        self.item = np.repeat(np.arange(len(size)), size)
        self.first = np.concatenate(([0], np.cumsum(size)[:-1])).astype(np.int64)
        self.at = np.arange(len(who))
        self.order = np.argsort(who, kind="stable")
        self.ids, self.begins = np.unique(who[self.order], return_index=True)

    def per_item(self, x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x, self.first, axis=-1)

    def per_annotator(self, x: np.ndarray) -> np.ndarray:
        """(annotator x numbers)"""
        return np.add.reduceat(x[..., self.order], self.begins, axis=-1).reshape(-1, len(self.ids)).T

    def counts(self) -> np.ndarray:
        return self.per_item(np.eye(self.k)[:, self.said])

    def majority(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Shares of the answers in place of posteriors, with the sums that start the annotators' tables."""
        q = self.counts() + 1e-9
        q /= q.sum(0)
        g = np.zeros((self.k, self.k, len(self.who)))
        g[:, self.said, self.at] = q[:, self.item]
        return q, g, np.zeros_like(g)

    def posteriors(self, sigma: np.ndarray, prior: np.ndarray, beta: float, rounds: int = 3) -> tuple[np.ndarray, np.ndarray, float]:
        """Label posteriors Q (class x item), answer probabilities P (class x answer x judgment) and the items' part of the dual, at their maximum over tau and Q."""
        k = self.k
        tau = np.zeros((k, k, self.n))
        base = np.ascontiguousarray(sigma.transpose(1, 2, 0))[:, :, self.who]
        for r in range(rounds):
            p = np.exp(base + tau[:, :, self.item] if r else base)
            p /= p.sum(1, keepdims=True)
            q = self.per_item(np.log(np.maximum(p[:, self.said, self.at], 1e-12))) + np.log(prior)[:, None]
            top = q.max(0)
            q = np.exp(q - top)
            total = q.sum(0)
            q /= total
            if r < rounds - 1:
                g, h = self.gradient(q, p)
                tau += (self.per_item(g) - beta * tau) / (self.per_item(h) + beta)
        return q, p, float((np.log(total) + top).sum() - beta / 2 * (tau * tau).sum())

    def gradient(self, q: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per judgment the gradient and curvature (class x answer x judgment) of the expected log-likelihood."""
        w = q[:, self.item]
        g = p * w[:, None, :]
        h = g * (1 - p)
        np.negative(g, out=g)
        g[:, self.said, self.at] += w
        return g, h


CHUNK = 20_000  # judgments
FEW = 20_000  # annotators whose parameters are broadcast


class Consensus:
    """Fitted annotators; ``labels()``, ``annotators()`` and ``agreement()`` are the results, ``dual`` the value after each pass."""

    def __init__(self, votes: DataFrame, options: tuple[str, ...] = OPTIONS, alpha: float = 0.2, beta: float = 20.0, passes: int = 12, tolerance: float = 1e-5, damping: float = 0.5) -> None:
        self.options, self.alpha, self.beta, self.damping, k = options, alpha, beta, damping, len(options)
        self.dual: list[float] = []
        votes = materialise(votes.select("item", "annotator", "label"))
        n = votes.count()
        chunk = F.pmod(F.xxhash64("item"), F.lit(n // CHUNK + 1)).cast("int")
        self.chunks = materialise(votes.withColumn("chunk", chunk).groupBy("chunk").applyInArrow(_packed, _CHUNK_SCHEMA))
        discard(votes)
        self.need = materialise(self.chunks.select("chunk", F.explode("names").alias("annotator")))
        self.few = self.need.select("annotator").distinct().count() <= FEW
        self.prior, self._squares = np.full(k, 1 / k), 0.0
        self.state: DataFrame | _Local = self._next(None)  # majority shares start the annotators' tables
        if n:
            self._read()
        before = None
        for _ in range(passes if n else 0):
            old, self.state = self.state, self._next(self.state)
            value = self._read()
            if self.dual and value < self.dual[-1] - 1e-7 * abs(self.dual[-1]):
                self.damping /= 2  # the step before this pass was too long: half of it back
                self.state = self._between(before, old)
                continue
            self.dual.append(value)
            if before is not None and not self.few:
                discard(before)
            before = old
            if len(self.dual) > 1 and value - self.dual[-2] < tolerance * abs(value):
                break

    def _joined(self, *columns: str) -> DataFrame:
        """Chunks with the parameters of their annotators, unless these are broadcast."""
        if self.few:
            return self.chunks.select(*columns)
        mine = self.need.join(self.state.filter("annotator is not null").select("annotator", "s"), "annotator").groupBy("chunk").agg(F.collect_list(F.struct("annotator", "s")).alias("sigma"))
        return self.chunks.join(mine, "chunk").select(*columns, "sigma.annotator", "sigma.s")

    def _next(self, state: DataFrame | _Local | None) -> DataFrame | _Local:
        """The state after one pass: a row an annotator (annotator, judgments, s); without annotator: the class sums and the items' part of the dual at the
        state the pass began with."""
        k, prior, beta, alpha, damping = len(self.options), self.prior, self.beta, self.alpha, self.damping
        columns, spark = ("names", "size", "who", "said"), self.chunks.sparkSession
        local = spark.sparkContext.broadcast(state) if isinstance(state, _Local) else None
        first = state is None

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    names, votes, sigma = _unpacked(b, i, k, local)
                    if first:
                        (q, g, h), value = votes.majority(), 0.0
                    else:
                        q, p, value = votes.posteriors(sigma, prior, beta)
                        g, h = votes.gradient(q, p)
                    parts = np.concatenate((votes.per_annotator(g), votes.per_annotator(h)), 1)
                    total = np.concatenate((q.sum(1), [value], np.zeros(2 * k * k - k - 1)))
                    counts = np.append(np.bincount(votes.who, minlength=len(names))[votes.ids], 0)
                    yield _batch([*(names[x] for x in votes.ids.tolist()), None], counts, np.vstack((parts, total)))

        def stepped(d: np.ndarray, old: np.ndarray | None, none: np.ndarray) -> np.ndarray:
            g, h = d[:, : k * k].reshape(-1, k, k), d[:, k * k :].reshape(-1, k, k)
            if old is None:
                table = np.maximum(g + 0.5 + 2 * np.eye(k), 1e-9)
                new = np.log(table / table.sum(2, keepdims=True))
            else:
                old = old.reshape(-1, k, k)
                new = old + np.clip(damping * (g - alpha * old) / (h + alpha), -1, 1)
            new = (new - new.mean(2, keepdims=True)).reshape(-1, k * k)
            new[none] = np.pad(d[none, : k + 1], ((0, 0), (0, k * k - k - 1)))
            return new

        def update(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    none = b["annotator"].is_null().to_numpy(zero_copy_only=False)
                    old = None
                    if not first:
                        old = np.zeros((b.num_rows, k * k))
                        old[~none] = _matrix(b["s"].drop_null())
                    yield _batch(b["annotator"], b["judgments"], stepped(_matrix(b["d"]), old, none))

        ship(spark)
        rows = self.chunks.select(*columns) if first else self._joined(*columns)
        added = rows.mapInArrow(sums, _STATE).groupBy("annotator").agg(F.sum("judgments").cast("bigint").alias("judgments"), F.array(*[F.sum(F.col("s")[i]) for i in range(2 * k * k)]).alias("d"))
        if self.few:
            got = sorted(added.collect(), key=lambda r: (r["annotator"] is None, r["annotator"] or ""))  # FEW rows at most, the sums without annotator last
            d = np.array([r["d"] for r in got], float).reshape(len(got), 2 * k * k)
            none = np.array([r["annotator"] is None for r in got], bool)
            old = None if first else np.vstack((state.s, np.zeros((1, k * k))))
            new = stepped(d, old, none)
            return _Local([r["annotator"] for r in got if r["annotator"] is not None], np.array([r["judgments"] for r in got], np.int64)[~none], new[~none], new[none].sum(0))
        before = F.lit(None).cast("array<double>").alias("s")
        with_old = added.select("*", before) if first else added.join(state.filter("annotator is not null").select("annotator", "s"), "annotator", "left")
        return materialise(with_old.select("annotator", "judgments", "d", "s").mapInArrow(update, _STATE))

    def _between(self, a: DataFrame | _Local, b: DataFrame | _Local) -> DataFrame | _Local:
        if isinstance(a, _Local):
            return _Local(a.names, a.judgments, (a.s + b.s) / 2, b.total)
        mean = F.zip_with(F.col("s"), F.col("o"), lambda x, y: (x + y) / 2)
        return materialise(b.join(a.select("annotator", F.col("s").alias("o")), "annotator").select("annotator", "judgments", mean.alias("s")))

    def _read(self) -> float:
        """Takes over the class shares; the dual at the state that the pass began with."""
        k = len(self.options)
        if isinstance(self.state, _Local):
            total, squares = self.state.total, float((self.state.s**2).sum())
        else:
            squares = F.sum(F.when(F.col("annotator").isNotNull(), F.aggregate("s", F.lit(0.0), lambda a, x: a + x * x)))
            total, squares = self.state.agg(F.max(F.when(F.col("annotator").isNull(), F.col("s"))), squares).first()
        value = total[k] + float(np.log(self.prior).sum()) - self.alpha / 2 * self._squares
        self._squares = squares
        self.prior = (np.array(total[:k]) + 1) / (np.array(total[:k]) + 1).sum()
        return value

    def labels(self) -> DataFrame:
        """(item, label, probability, judgments, agreement): agreement is the share of agreeing pairs, NULL for one judgment."""
        options, prior, beta, k = self.options, self.prior, self.beta, len(self.options)
        local = self.chunks.sparkSession.sparkContext.broadcast(self.state) if self.few else None

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    _, votes, sigma = _unpacked(b, i, k, local)
                    q = votes.posteriors(sigma, prior, beta)[0]
                    best = q.argmax(0)
                    c = votes.counts()
                    m = c.sum(0)
                    same = np.divide((c * (c - 1)).sum(0), m * (m - 1), out=np.full(len(m), np.nan), where=m > 1)
                    yield pa.RecordBatch.from_arrays([b["items"][i].values, pa.array([options[x] for x in best]), pa.array(q.max(0)), pa.array(m.astype(np.int32)), pa.array(same, from_pandas=True)], names=["item", "label", "probability", "judgments", "agreement"])

        ship(self.chunks.sparkSession)
        return self._joined("items", "names", "size", "who", "said").mapInArrow(run, "item string, label string, probability double, judgments int, agreement double")

    def annotators(self) -> DataFrame:
        """(annotator, judgments, reliability): the probability of the true class, averaged over the class shares."""
        k, prior = len(self.options), self.prior

        def make():
            def work(names: list, n: list, s: list) -> Iterable[tuple]:
                z = np.array(s, float).reshape(len(s), k, k)
                p = np.exp(z - z.max(2, keepdims=True))
                rel = ((p / p.sum(2, keepdims=True))[:, range(k), range(k)] * prior).sum(1)
                return zip(names, n, rel.tolist())
            return work

        state = self.state
        if isinstance(state, _Local):
            state = self.chunks.sparkSession.createDataFrame([(a, int(n), x.tolist()) for a, n, x in zip(state.names, state.judgments, state.s)], _STATE)
        return map_rows(state.filter("annotator is not null").select("annotator", "judgments", "s"), make, "annotator string, judgments bigint, reliability double")

    def agreement(self) -> DataFrame:
        """One row (items, judgments, pair_agreement, krippendorff_alpha) over items with two or more judgments."""
        rows = self.chunks.select(F.explode(F.arrays_zip("of", "said")).alias("v"), "chunk")
        return krippendorff(rows.select(F.struct("chunk", "v.of").alias("item"), F.col("v.said").alias("label")))


_CHUNK_SCHEMA = "chunk int, items array<string>, names array<string>, size array<int>, of array<int>, who array<int>, said array<int>"
_STATE = "annotator string, judgments bigint, s array<double>"


class _Local:
    """The state of few annotators, ordered by name."""

    def __init__(self, names: list[str], judgments: np.ndarray, s: np.ndarray, total: np.ndarray) -> None:
        self.names, self.judgments, self.s, self.total = names, judgments, s, total

    def of(self, names: list[str]) -> np.ndarray:
        return self.s[np.searchsorted(np.array(self.names, object), np.array(names, object))]


def _packed(table: pa.Table) -> pa.Table:
    """One row of arrays for the judgments of a chunk, in order of item and annotator."""
    table = table.sort_by([("item", "ascending"), ("annotator", "ascending")]).combine_chunks()
    item, who = (table[c].combine_chunks().dictionary_encode() for c in ("item", "annotator"))
    item, who = (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in (item, who))
    of = item.indices.to_numpy()
    columns = [item.dictionary, who.dictionary, np.bincount(of).astype(np.int32), of.astype(np.int32), who.indices.to_numpy().astype(np.int32), table["label"].to_numpy().astype(np.int32)]
    one = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c if isinstance(c, pa.Array) else pa.array(c)) for c in columns]
    return pa.table([pa.array([table["chunk"][0].as_py()], pa.int32()), *one], names=[x.split()[0] for x in _CHUNK_SCHEMA.split(", ")])


def _matrix(x: pa.Array) -> np.ndarray:
    """Lists of equal length as a matrix."""
    flat = x.flatten().to_numpy()
    return flat.reshape(len(x), -1) if len(x) else np.zeros((0, 0))


def _unpacked(b: pa.RecordBatch, i: int, k: int, local: Broadcast | None) -> tuple[list[str], _Votes, np.ndarray | None]:
    """A chunk's annotators, its judgments and, if there are parameters yet, these in the annotators' order."""
    names = b["names"][i].as_py()
    votes = _Votes(*(b[c][i].values.to_numpy() for c in ("size", "who", "said")), k)
    if local is not None:
        return names, votes, local.value.of(names).reshape(-1, k, k)
    if "s" not in b.schema.names:
        return names, votes, None
    at = {a: j for j, a in enumerate(names)}
    sigma = np.empty((len(names), k, k))
    sigma[[at[a] for a in b["annotator"][i].as_py()]] = _matrix(b["s"][i].values).reshape(-1, k, k)
    return names, votes, sigma


def _batch(names: list | pa.Array, judgments: np.ndarray | pa.Array, s: np.ndarray) -> pa.RecordBatch:
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(s) + 1) * s.shape[1], pa.int32()), pa.array(s.ravel()))
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()) if isinstance(names, list) else names, pa.array(judgments, pa.int64()), lists], names=["annotator", "judgments", "s"])


def krippendorff(votes: DataFrame) -> DataFrame:
    """Nominal alpha from (item, label) rows; NULL where it is not defined (no pair, or one label only)."""
    per = votes.groupBy("item", "label").agg(F.count(F.lit(1)).alias("c"))
    units = per.groupBy("item").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("sq")).filter("m > 1")
    seen = units.agg(F.count(F.lit(1)).alias("items"), F.sum("m").alias("n"), F.sum((F.col("m") * F.col("m") - F.col("sq")) / (F.col("m") - 1)).alias("dis"), F.avg((F.col("sq") - F.col("m")) / (F.col("m") * (F.col("m") - 1))).alias("pair"))
    totals = per.join(units.select("item"), "item", "left_semi").groupBy("label").agg(F.sum("c").alias("t")).agg(F.sum(F.col("t") * F.col("t")).alias("tsq"))
    expected = (F.col("n") * F.col("n") - F.col("tsq")) / (F.col("n") - 1)
    return seen.crossJoin(F.broadcast(totals)).select("items", F.coalesce("n", F.lit(0)).alias("judgments"), F.col("pair").alias("pair_agreement"), F.when(expected > 0, 1 - F.col("dis") / expected).alias("krippendorff_alpha"))  # one row each


def found(perspectives: DataFrame, least: int = 3) -> DataFrame:
    """p5_found: the consensus of every poem with current judgments from at least three annotators."""
    c = Consensus(judgments(perspectives))
    return c.labels().filter(F.col("judgments") >= least).select(F.col("item").alias("poem_id"), F.col("label").alias("perspective"))
