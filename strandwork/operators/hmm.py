"""The occupancy model: a hidden Markov model of background, binding motifs on both strands, and nucleosomes.

Only emitting states are kept. Every element (background, a motif on a strand, the nucleosome) is entered with its own
weight from the end of any other, so a step forward is one sum over the ends, a shift along the chains, and 127 small
products in the middle of the nucleosome. Each segment is decoded by itself; the model is broadcast.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import BACKGROUND_CONC, EM_ROUNDS, NUCLEOSOME, NUCLEOSOME_CONC, POSTERIOR_CUT, UNKNOWN_LENGTH
from ..functions.scalar import to_probabilities

# The nucleosome's 147 positions are 9 single states, 128 groups of one state for each base, 10 single ones.
HEAD, MIDDLE, TAIL = 9, 128, 10
NUC_STATES = HEAD + 4 * MIDDLE + TAIL
DYAD_POSITION = NUCLEOSOME // 2
TOGETHER = 8  # segments that a task decodes at once at most
MEMORY = 64 << 20  # bytes of forward values that a task holds, which decides how many segments that is


@dataclass(frozen=True)
class Counts:
    """Negative binomial means and sizes of one signal: other and motif bases, and the nucleosome's 147 positions."""

    other: tuple[float, float]
    motif: tuple[float, float]
    nucleosome: tuple[tuple[float, ...], float]


@dataclass(frozen=True)
class Density:
    """As ``Counts`` for a smoothed signal: kind is normal (means, standard deviations) or gamma (shapes, rates), with a pair
    for each of the nucleosome's positions. Under a gamma, a signal below 1e-6 counts as that."""

    kind: str
    other: tuple[float, float]
    motif: tuple[float, float]
    nucleosome: tuple[tuple[float, float], ...]

    def at(self, x: float, a: float, b: float) -> float:
        if self.kind == "normal":
            return math.exp(-((x - a) ** 2) / (2 * b * b)) / (b * math.sqrt(2 * math.pi))
        x = max(x, 1e-6)
        return math.exp(a * math.log(b) + (a - 1) * math.log(x) - b * x - math.lgamma(a))


@dataclass(frozen=True)
class Model:
    """motifs: name -> length x 4 probabilities; background: shares of A, C, G, T; dinucleotides: the first base's chances
    and 127 x 4 x 4 transitions in the nucleosome's middle; ends: base shares of its head and tail; weights: of
    ``background``, each motif and ``nucleosome``, summing to 1; counts: signal name -> Counts."""

    motifs: dict[str, list[list[float]]]
    background: list[float]
    weights: dict[str, float]
    first: list[float] = field(default_factory=lambda: [0.25] * 4)
    transitions: list[list[list[float]]] = field(default_factory=lambda: [[[0.25] * 4] * 4] * (MIDDLE - 1))
    ends: list[list[float]] = field(default_factory=lambda: [[0.25] * 4] * (HEAD + TAIL))
    counts: dict[str, Counts | Density] = field(default_factory=dict)
    use_sequence: bool = True

    def __post_init__(self) -> None:
        total = sum(self.weights.values())
        if any(w < 0 for w in self.weights.values()) or self.weights.get("background", 0) <= 0:
            raise ValueError("weights must not be negative, and the background's must exceed 0")
        if abs(total - 1) > 1e-9:
            raise ValueError(f"weights sum to {total}")
        if set(self.weights) != {"background", "nucleosome", *self.motifs}:
            raise ValueError("each of background, nucleosome and the motifs needs a weight")

    @property
    def names(self) -> list[str]:
        return sorted(self.motifs)

    def starts(self) -> dict[str, tuple[int, int]]:
        """First state of each motif forward, and backward; state 0 is the background."""
        out, at = {}, 1
        for name in self.names:
            size = len(self.motifs[name])
            out[name] = (at, at + size)
            at += 2 * size
        return out

    @property
    def nuc_start(self) -> int:
        return 1 + 2 * sum(len(m) for m in self.motifs.values())

    @property
    def n_states(self) -> int:
        return self.nuc_start + NUC_STATES

    def factors(self) -> list[tuple[int, str]]:
        """(state, dbf): which states make up which factor; a state may be in several."""
        rows = [(0, "background")]
        for name, (forward, _) in self.starts().items():
            rows += [(forward + i, name) for i in range(2 * len(self.motifs[name]))]
        n = self.nuc_start
        rows += [(n + i, "nucleosome") for i in range(NUC_STATES)]
        rows += [(n + HEAD + 4 * (DYAD_POSITION - HEAD) + i, "nuc_center") for i in range(4)]
        return [*rows, (n, "nuc_start"), (n + NUC_STATES - 1, "nuc_end")]

    def edges(self) -> list[tuple[int, int, float]]:
        """(from, to, prob): the nucleosome's states, from 1, and the steps between them."""
        chain = [(i, i + 1, 1.0) for i in range(1, HEAD)]
        rows = chain + [(HEAD, HEAD + 1 + b, self.first[b]) for b in range(4)]
        for g, step in enumerate(self.transitions):
            at = HEAD + 1 + 4 * g
            rows += [(at + a, at + 4 + b, step[a][b]) for a in range(4) for b in range(4)]
        tail = HEAD + 4 * MIDDLE + 1
        rows += [(tail - 4 + b, tail, 1.0) for b in range(4)]
        return rows + [(i, i + 1, 1.0) for i in range(tail, NUC_STATES)]

    def with_edges(self, edges: list[tuple[int, int, float]]) -> Model:
        """This model with the nucleosome's steps from ``edges``; steps that are not named have no chance. Raises where an edge
        joins states that are not neighbours, or the chain outside of the middle is not certain."""
        known = {(a, b): p for a, b, p in edges}
        if any((a, b) not in known for a, b, _ in self.edges() if a < HEAD or b > HEAD + 4 * MIDDLE):
            raise ValueError("the nucleosome's chain is not complete")
        at = [HEAD + 1 + 4 * g for g in range(MIDDLE - 1)]
        first = [known.get((HEAD, HEAD + 1 + b), 0.0) for b in range(4)]
        steps = [[[known.get((i + a, i + 4 + b), 0.0) for b in range(4)] for a in range(4)] for i in at]
        read = replace(self, first=first, transitions=steps)
        own = {(a, b): p for a, b, p in read.edges()}
        if any(own.get(edge) != p for edge, p in known.items()):
            raise ValueError("edges do not fit the nucleosome's states")
        return read

    def save(self, spark: SparkSession, path: str) -> None:
        data = {k: getattr(self, k) for k in ("motifs", "background", "weights", "first", "transitions", "ends", "use_sequence")}
        data["counts"] = {k: [c.other, c.motif, c.nucleosome, getattr(c, "kind", None)] for k, c in self.counts.items()}
        spark.createDataFrame([(json.dumps(data),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Model:
        data = json.loads(spark.read.text(path).first()[0])
        for k, (a, b, c, kind) in data["counts"].items():
            known = Counts(tuple(a), tuple(b), (tuple(c[0]), c[1])) if kind is None else Density(kind, tuple(a), tuple(b), tuple(map(tuple, c)))
            data["counts"][k] = known
        return Model(**data)


def unknown_motif(background: list[float], length: int = UNKNOWN_LENGTH) -> list[list[float]]:
    return [list(background) for _ in range(length)]


def dissociation(motif: list[list[float]], background: list[float]) -> float:
    """How much likelier the background gives the motif's best sequence than the motif does."""
    best = [int(np.argmax(row)) for row in motif]
    return math.exp(sum(math.log(background[b]) - math.log(row[b]) for b, row in zip(best, motif, strict=True)))


def initial_weights(motifs: dict[str, list[list[float]]], background: list[float]) -> dict[str, float]:
    """Weights from concentrations: 1 for the background, 35 for nucleosomes, the dissociation constant for each motif."""
    conc = {"background": BACKGROUND_CONC, "nucleosome": NUCLEOSOME_CONC} | {k: dissociation(m, background) for k, m in motifs.items()}
    length = {"background": 1, "nucleosome": NUCLEOSOME} | {k: len(m) for k, m in motifs.items()}
    prob = to_probabilities(conc, length)
    total = sum(prob.values())
    return {k: p / total for k, p in prob.items()}


def motif_cap(weights: dict[str, float], exempt: str = "unknown") -> float:
    """Mean and two population standard deviations of the motifs' weights."""
    w = np.array([x for k, x in weights.items() if k not in ("background", "nucleosome", exempt)])
    return float(w.mean() + 2 * w.std()) if len(w) else 1.0


class Kernel:
    """The model as arrays, and forward-backward over one segment."""

    def __init__(self, model: Model, strict_compat: bool = False) -> None:
        self.model, self.n, self.nuc = model, model.n_states, model.nuc_start
        s, w = self.n, model.weights
        base = np.zeros((5, s))
        base[:4, 0] = model.background
        self.entry, self.is_end = np.zeros(s), np.zeros(s)
        self.entry[0], self.is_end[0] = w["background"], 1
        self.position = np.full(s, -2)  # -2 background, -1 motif, else position in the nucleosome
        for name, (forward, backward) in model.starts().items():
            m = np.array(model.motifs[name])
            size = len(m)
            base[:4, forward:backward], base[:4, backward : backward + size] = m.T, m[::-1, ::-1].T
            self.position[forward : backward + size] = -1
            for a in (forward, backward):
                self.entry[a], self.is_end[a + size - 1] = w[name] / 2, 1
        a, b = self.nuc + HEAD, self.nuc + HEAD + 4 * MIDDLE
        self.entry[self.nuc], self.is_end[s - 1] = w["nucleosome"], 1
        base[:4, self.nuc : a], base[:4, b:] = np.array(model.ends[:HEAD]).T, np.array(model.ends[HEAD:]).T
        base[:4, a:b] = np.tile(np.eye(4), MIDDLE)
        self.position[self.nuc :] = np.concatenate([np.arange(HEAD), HEAD + np.repeat(np.arange(MIDDLE), 4), HEAD + MIDDLE + np.arange(TAIL)])
        base[4] = 0 if strict_compat else 1  # an unknown base tells nothing; the strict form forbids it
        self.base, self.middle = base, slice(a, b)
        self.first, self.trans = np.array(model.first), np.array(model.transitions)
        self.chain = np.ones(s, bool)  # states reached from the one before them
        self.chain[self.entry > 0] = self.chain[a:b] = self.chain[b] = False
        self.chain[[0, self.nuc, *(x for pair in model.starts().values() for x in pair)]] = False
        self.chain = self.chain.astype(float)

    def _forward_step(self, alpha: np.ndarray) -> np.ndarray:
        """(segments x states) -> the next position's values before its emission."""
        a, b = self.middle.start, self.middle.stop
        out = (alpha @ self.is_end)[:, None] * self.entry
        out[:, 1:] += alpha[:, :-1] * self.chain[1:]
        mid = alpha[:, a:b].reshape(-1, MIDDLE, 4)
        out[:, a : a + 4] += alpha[:, a - 1, None] * self.first
        out[:, a + 4 : b] += sum(mid[:, :-1, i, None] * self.trans[:, i] for i in range(4)).reshape(len(alpha), -1)
        out[:, b] += mid[:, -1].sum(axis=1)
        return out

    def _backward_step(self, x: np.ndarray) -> np.ndarray:
        """x: emission times backward value of the next position -> backward value."""
        a, b = self.middle.start, self.middle.stop
        out = (x @ self.entry)[:, None] * self.is_end
        out[:, :-1] += x[:, 1:] * self.chain[1:]
        mid = x[:, a:b].reshape(-1, MIDDLE, 4)
        out[:, a - 1] += (self.first * mid[:, 0]).sum(axis=1)
        out[:, a : b - 4] += sum(mid[:, 1:, j, None] * self.trans[:, :, j] for j in range(4)).reshape(len(x), -1)
        out[:, b - 4 : b] += x[:, b, None]
        return out

    def _emissions(self, codes: np.ndarray | None, signals: dict[str, np.ndarray]):
        """A function of two places -> emissions between them (bases x segments x states)."""
        looked_up = []
        for name, values in signals.items():
            c = self.model.counts[name]
            smooth = isinstance(c, Density)
            inside = c.nucleosome if smooth else [(m, c.nucleosome[1]) for m in c.nucleosome[0]]
            seen, at = np.unique(values, return_inverse=True)
            table = np.array([[c.at(float(k), *p) if smooth else _nb(int(k), *p) for p in (c.other, c.motif, *inside)] for k in seen])
            looked_up.append((table, at.reshape(values.shape).T))
        if codes is not None:
            codes = codes.T

        def between(a: int, b: int) -> np.ndarray:
            if codes is not None and self.model.use_sequence:
                out = self.base[codes[a:b]]
            else:
                out = np.ones((b - a, (codes if codes is not None else looked_up[0][1]).shape[1], self.n))
            for table, at in looked_up:
                out *= table[at[a:b]][..., self.position + 2]
            return out

        return between

    def _emission(self, codes: np.ndarray | None, signals: dict[str, np.ndarray]) -> np.ndarray:
        """All emissions of one segment (bases x states)."""
        lifted = self._emissions(None if codes is None else codes[None], {k: v[None] for k, v in signals.items()})
        return lifted(0, len(codes if codes is not None else next(iter(signals.values()))))[:, 0]

    def _next(self, alpha: np.ndarray | None, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next base's forward values, of sum 1, and what they were divided by. All segments take a step together."""
        x = (np.broadcast_to(self.entry, e.shape) if alpha is None else self._forward_step(alpha)) * e
        total = x.sum(axis=1, keepdims=True)
        if not (total > 0).all():
            x = np.where(total > 0, x, x + np.finfo(float).tiny)
            total = x.sum(axis=1, keepdims=True)
        return x / total, total

    def blocks(self, codes: np.ndarray | None, signals: dict[str, np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For segments of equal length: (first base, chances of states (segments x bases x states), log likelihoods), from
        the last stretch of bases to the first one. One scale is shared by both directions.

        Forward values are kept at the border of each of some sqrt(bases) stretches and made again within a stretch when the
        backward values get there, so memory follows the square root of the bases.
        """
        m, n = (codes if codes is not None else next(iter(signals.values()))).shape
        emissions, step = self._emissions(codes, signals), math.isqrt(n - 1) + 1 if n else 1
        starts, kept, scale, alpha = range(0, n, step), [], np.empty((n, m, 1)), None
        for a in starts:
            kept.append(alpha)
            for t, e in enumerate(emissions(a, min(n, a + step)), a):
                alpha, scale[t] = self._next(alpha, e)
        ll = np.log(scale).sum(axis=(0, 2))
        beta, following = np.ones((m, self.n)), None
        for a in reversed(starts):
            e, alpha = emissions(a, min(n, a + step)), kept.pop()
            post = np.empty(e.shape)
            for i in range(len(e)):
                alpha, _ = self._next(alpha, e[i])
                post[i] = alpha
            for i in range(len(e) - 1, -1, -1):
                if following is not None:
                    beta = self._backward_step(following * beta) / scale[a + i + 1]
                post[i] *= beta
                following = e[i]
            total = post.sum(axis=2, keepdims=True)
            post /= np.where(total > 0, total, 1)
            yield a, np.swapaxes(post, 0, 1), ll

    def together(self, bases: int) -> int:
        """How many segments of a length are decoded at once: two stretches of values and one of emissions fit MEMORY."""
        return max(1, min(TOGETHER, MEMORY // (3 * 8 * self.n * (math.isqrt(max(0, bases - 1)) + 1))))

    def posteriors(self, codes: np.ndarray | None, signals: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Chances of states of segments of equal length (segments x bases x states), whole, and the log likelihood of each."""
        found = list(self.blocks(codes, signals))
        return np.concatenate([post for _, post, _ in reversed(found)], axis=1), found[0][2]

    def posterior(self, codes: np.ndarray | None, signals: dict[str, np.ndarray]) -> tuple[np.ndarray, float]:
        """``posteriors`` of one segment."""
        post, ll = self.posteriors(None if codes is None else codes[None], {k: v[None] for k, v in signals.items()})
        return post[0], float(ll[0])

    def expected(self, post: np.ndarray) -> dict[str, float]:
        """Expected entries by element: background, both strands of each motif, nucleosome."""
        out = {"background": float(post[:, 0].sum()), "nucleosome": float(post[:, self.nuc].sum())}
        return out | {k: float(post[:, list(pair)].sum()) for k, pair in self.model.starts().items()}


def _nb(k: int, mu: float, phi: float) -> float:
    return math.exp(math.lgamma(k + phi) - math.lgamma(phi) - math.lgamma(k + 1) + phi * math.log(phi / (phi + mu)) + k * math.log(mu / (phi + mu)))


def _inputs(segments: DataFrame, model: Model) -> DataFrame:
    """What a decoder needs, dealt out evenly over all tasks: a segment is small, but takes long, so Spark must not join tasks
    by their bytes."""
    spark = segments.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return segments.repartition(tasks).select("segment_id", "chr", "start", *(["codes"] if model.use_sequence else []), *model.counts)


def _decoded(batches: Iterator[pa.RecordBatch], kernel: Kernel) -> Iterator[tuple]:
    """(segment, chr, position, posterior, log likelihood, whether it is the last, place in the group) of each row's
    stretches, from its end to its start; segments of equal length are decoded in groups."""
    counts, use_sequence = kernel.model.counts, kernel.model.use_sequence
    for batch in batches:
        sizes = np.array([len(x) for x in batch.column(batch.num_columns - 1)], np.int64)
        order = np.argsort(sizes, kind="stable")
        for same in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1) if len(order) else ():
            size = int(sizes[same[0]])
            step = kernel.together(size)
            for i in range(0, len(same) if size else 0, step):
                rows = same[i : i + step].tolist()
                get = lambda c: np.stack([np.asarray(batch.column(c)[r].values) for r in rows])  # noqa: E731, B023
                names = [[batch.column(c)[r].as_py() for c in ("segment_id", "chr", "start")] for r in rows]
                for a, post, ll in kernel.blocks(get("codes").astype(int) if use_sequence else None, {k: get(k) for k in counts}):
                    for k, (segment, chrom, start) in enumerate(names):
                        yield segment, chrom, start + a, post[k], float(ll[k]), a == 0, k


def decode_scored(segments: DataFrame, model: Model, cut: float = POSTERIOR_CUT, strict_compat: bool = False) -> DataFrame:
    """(segment_id, chr, start[, codes], a count array for each signal of the model) -> (segment_id, chr, pos, state, prob,
    log_likelihood): the sparse posterior, rows with prob >= cut, and a row for each segment that has its log likelihood and
    no position, state or prob. One pass gives both."""
    shared = segments.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for segment, chrom, start, post, ll, last, _ in _decoded(batches, Kernel(shared.value, strict_compat)):
            at, state = np.nonzero(post >= cut)
            n = len(at)
            cols = [
                pa.array(np.full(n + last, segment), pa.int64()),
                pa.array([chrom] * (n + last), pa.string()),
                pa.array([*(start + at).tolist(), *[None] * last], pa.int64()),
                pa.array([*state.tolist(), *[None] * last], pa.int32()),
                pa.array([*post[at, state].tolist(), *[None] * last], pa.float64()),
                pa.array([*[None] * n, *[ll] * last], pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(cols, ["segment_id", "chr", "pos", "state", "prob", "log_likelihood"])

    return _inputs(segments, model).mapInArrow(run, "segment_id long, chr string, pos long, state int, prob double, log_likelihood double")


def decode(segments: DataFrame, model: Model, cut: float = POSTERIOR_CUT, strict_compat: bool = False) -> DataFrame:
    """The sparse posterior (segment_id, chr, pos, state, prob) of ``decode_scored``."""
    return decode_scored(segments, model, cut, strict_compat).where("state is not null").drop("log_likelihood")


def decode_factors(segments: DataFrame, model: Model, cut: float = POSTERIOR_CUT) -> DataFrame:
    """(segment_id, chr, pos, dbf, prob): as ``decode`` and the sum by factor, added up before rows leave the worker."""
    shared = segments.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = shared.value.factors()
        names = sorted({f for _, f in factors})
        member = np.zeros((shared.value.n_states, len(names)))
        for state, f in factors:
            member[state, names.index(f)] = 1
        for segment, chrom, start, post, *_ in _decoded(batches, Kernel(shared.value)):
            sums = np.where(post >= cut, post, 0) @ member
            at, k = np.nonzero(sums)
            dbf = pa.DictionaryArray.from_arrays(pa.array(k.astype(np.int32)), pa.array(names)).cast(pa.string())
            cols = [pa.array(np.full(len(at), segment)), pa.array([chrom] * len(at), pa.string()), pa.array(start + at), dbf, pa.array(sums[at, k])]
            yield pa.RecordBatch.from_arrays(cols, ["segment_id", "chr", "pos", "dbf", "prob"])

    return _inputs(segments, model).mapInArrow(run, "segment_id long, chr string, pos long, dbf string, prob double")


def expectations(segments: DataFrame, model: Model) -> DataFrame:
    """(segment_id, dbf, expected, log_likelihood): what training needs of a segment, before any cut."""
    shared = segments.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel, sums = Kernel(shared.value), {}
        for segment, _, _, post, ll, last, place in _decoded(batches, kernel):
            own = sums.setdefault(place, dict.fromkeys(kernel.expected(post[:0]), 0.0))
            for k, x in kernel.expected(post).items():
                own[k] += x
            if last:
                rows = [(segment, k, x, ll) for k, x in sums.pop(place).items()]
                yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["segment_id", "dbf", "expected", "log_likelihood"]), preserve_index=False)

    return _inputs(segments, model).mapInArrow(run, "segment_id long, dbf string, expected double, log_likelihood double")


def log_likelihoods(segments: DataFrame, model: Model) -> DataFrame:
    """(segment_id, log_likelihood): how well the model explains each segment."""
    return expectations(segments, model).where("dbf = 'background'").select("segment_id", "log_likelihood")


def _round(spark: SparkSession, path: str, i: int) -> tuple[Model, float] | None:
    """What round ``i`` left under ``path``: the model before it and the log likelihood under that model."""
    try:
        return Model.load(spark, f"{path}/round-{i}/model"), spark.read.schema("log_likelihood double").json(f"{path}/round-{i}/likelihood").first()[0]
    except (AnalysisException, TypeError):
        return None


def train(segments: DataFrame, model: Model, rounds: int = EM_ROUNDS, cap: float | None = None, path: str | None = None) -> tuple[Model, list[float]]:
    """Expectation-maximisation of the weights -> the model and the log likelihood before each round and after the last.

    A round returns one row for each element to the driver. Motifs over ``cap`` (by default ``motif_cap`` of the first
    weights) are held there. With a ``path``, each round's model and likelihood are kept there, and a training that was
    interrupted goes on after its last finished round.
    """
    from .occupancy import capped, weights

    spark = segments.sparkSession
    cap = motif_cap(model.weights) if cap is None else cap
    history: list[float] = []
    segments = segments.persist()
    for i in range(rounds + 1):
        if path and (kept := _round(spark, path, i)):
            model = kept[0]
            history.append(kept[1])
            if i == rounds or _round(spark, path, i + 1):
                continue
            found = expectations(segments, model).persist()
        else:
            found = expectations(segments, model).persist()
            history.append(found.groupBy("segment_id").agg(F.first("log_likelihood").alias("l")).agg(F.sum("l")).first()[0] or 0.0)
            if path:
                model.save(spark, f"{path}/round-{i}/model")
                spark.createDataFrame([(history[-1],)], "log_likelihood double").coalesce(1).write.mode("overwrite").json(f"{path}/round-{i}/likelihood")
        if i < rounds:
            new = {r["dbf"]: r["weight"] for r in capped(weights(found), cap).collect()}
            total = sum(new.values())
            if new:
                model = replace(model, weights={k: x / total for k, x in new.items()})
        found.unpersist()
    segments.unpersist()
    return model, history
