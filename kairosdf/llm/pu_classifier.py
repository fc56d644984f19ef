"""Quality classifier by positive-unlabelled learning.

Trusted positives are labelled good documents; the unlabelled rows are
documents of any quality whose labels are not looked at.  The class prior is
estimated by the best bin of a positive-against-unlabelled score: among the
top fractions, the smallest upper confidence bound of the ratio between the
shares of unlabelled and of positive rows.  The model then minimises the
non-negative unbiased risk with the logistic loss,

    prior * R_P(+)  +  max(0, R_U(-) - prior * R_P(-)),

stepping back along the second term's gradient where it is negative, so that
its output is a probability of being good.  An overestimated prior would keep
that term negative for ever, so the estimate is lowered by a margin first, and
again while the term doesn't recover.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import RATES, rates, vectors
from .store import bounded_batches

THRESHOLD = 0.3
FOLDS, HELD_OUT_FOLD = 5, 0
MARGIN = 0.03
ROUNDS = 20


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class PUModel:
    edges: np.ndarray  # (statistics, bins - 1) quantiles of the unlabelled rows
    weights: np.ndarray  # statistics * bins, and the bias last
    prior: float  # as used
    estimated: float = float("nan")  # before it was lowered
    rounds: int = 0  # in which it was

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(_logit(_cells(x, self.edges), self.weights))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    """Bin edges from quantiles; the tails, where junk sits, get edges of their own."""
    at = np.unique(np.concatenate((np.linspace(0, 1, bins - 5)[1:-1], [0.005, 0.02, 0.98, 0.995, 0.97, 0.99])))
    q = np.quantile(x, at, axis=0).T
    return np.ascontiguousarray(q)


def _cells(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Index of each row's cell in each statistic, in one flat space."""
    width = edges.shape[1] + 1
    return np.stack([np.searchsorted(edges[j], x[:, j], "left") + j * width for j in range(len(edges))], 1)


def _logit(cells: np.ndarray, w: np.ndarray) -> np.ndarray:
    return w[cells].sum(1) + w[-1]


def _push(cells: np.ndarray, g: np.ndarray, size: int) -> np.ndarray:
    """Gradient of the weights from that of the logits."""
    out = np.bincount(cells.ravel(), np.repeat(g, cells.shape[1]), size)
    out[-1] = g.sum()
    return out


def _descend(w: np.ndarray, gradient, steps: int, rate: float) -> np.ndarray:
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.5, least: float = 0.01) -> float:
    """Best bin estimate of the share of positives among the unlabelled, from scores."""
    cuts = np.quantile(positive, np.linspace(least, 1 - least, 200))
    p = 1 - np.searchsorted(np.sort(positive), cuts, "left") / len(positive)
    u = 1 - np.searchsorted(np.sort(unlabelled), cuts, "left") / len(unlabelled)
    slack = np.sqrt(np.log(1 / delta) / (2 * len(unlabelled))) + np.sqrt(np.log(1 / delta) / (2 * len(positive)))
    p = np.maximum(p, 1e-9)
    best = int(np.argmin((u + slack) / p))
    return float(np.clip(u[best] / p[best], 0.01, 0.99))


def fit_pu(positive: np.ndarray, unlabelled: np.ndarray, *, bins: int = 16, steps: int = 2000, rate: float = 0.1, ridge: float = 2e-5, prior: float | None = None) -> PUModel:
    edges = _edges(unlabelled, bins)
    size = edges.shape[0] * (edges.shape[1] + 1) + 1
    cp, cu = _cells(positive, edges), _cells(unlabelled, edges)
    zero = np.zeros(size)
    if prior is None:
        # each half is compared by a score fitted on the other
        scores = []
        for k in (0, 1):
            p, u, p_rest, u_rest = cp[k::2], cu[k::2], cp[1 - k :: 2], cu[1 - k :: 2]

            def against(w: np.ndarray) -> np.ndarray:
                return _push(p, -_sigmoid(-_logit(p, w)) / len(p), size) + _push(u, _sigmoid(_logit(u, w)) / len(u), size) + ridge * w

            w = _descend(zero, against, steps // 8, rate)
            scores.append((_logit(p_rest, w), _logit(u_rest, w)))
        prior = estimate_prior(*(np.concatenate(x) for x in zip(*scores, strict=True)))

    def risk(w: np.ndarray) -> np.ndarray:
        zp, zu = _logit(cp, w), _logit(cu, w)
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        down = _push(cu, _sigmoid(zu) / len(cu), size) - prior * _push(cp, _sigmoid(zp) / len(cp), size)
        if negative < 0:
            return -down
        return prior * _push(cp, -_sigmoid(-zp) / len(cp), size) + down + ridge * w

    # a second term that stays below zero says that the prior is too high: it is lowered by MARGIN a round, ROUNDS at most,
    # and the model keeps what was estimated beside what was used
    estimated = prior
    for rounds in range(1, ROUNDS + 1):
        prior *= 1 - MARGIN
        w = _descend(zero, risk, steps, rate)
        if np.logaddexp(0, _logit(cu, w)).mean() - prior * np.logaddexp(0, _logit(cp, w)).mean() > -0.02 * prior:
            break
    return PUModel(edges, w, prior, estimated, rounds)


def held_out(id_column: str):
    """Rows of the fold that no label is learnt from."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % FOLDS == HELD_OUT_FOLD, F.lit(False))


def _vectors(docs: DataFrame, keep: str) -> DataFrame:
    """(keep, rates) of every row of (keep, text)."""
    schema = pa.schema([(keep, pa.int64()), ("rates", pa.list_(pa.float32()))])

    def make(rows: pa.RecordBatch, counts: np.ndarray) -> list[pa.Array]:
        flat = rates(counts).astype(np.float32)
        return [rows.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * len(RATES)), pa.array(flat.ravel()))]

    return docs.mapInArrow(vectors(schema, 1, make), f"{keep} long, rates array<float>")


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", positives: int = 10_000, unlabelled: int = 20_000, seed: int = 23) -> PUModel | None:
    """Fit on at most `positives` labelled good rows and `unlabelled` rows, those with the
    smallest hashes of their ids; both leave out the held-out fold.  None without positives."""
    bounded_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where(~held_out("doc_id") & F.col("doc_id").isNotNull())
    ids = base.select("doc_id")
    order = (F.xxhash64(F.lit(seed), "doc_id"), "doc_id")
    good = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).alias("label")).where("label = 1 and doc_id is not null").select("doc_id").where(~held_out("doc_id"))
    trusted = good.join(ids, "doc_id", "left_semi").distinct().orderBy(*order).limit(positives)
    web = ids.distinct().orderBy(F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id").limit(unlabelled)
    chosen = trusted.withColumn("kind", F.lit(1)).union(web.withColumn("kind", F.lit(0))).groupBy("doc_id").agg(F.max("kind").alias("is_p"), F.min("kind").alias("is_u"))
    # at most positives + unlabelled ids, a bound of this function's parameters
    sample = base.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])
    tagged = sample.select((F.col("doc_id") * 0 + F.col("is_p") * 2 + (1 - F.col("is_u"))).alias("tag"), "text")
    rows = _vectors(tagged, "tag").toArrow()
    tag = rows["tag"].to_numpy()
    x = np.array(rows["rates"].to_pylist(), float).reshape(-1, len(RATES))
    is_p, is_u = tag >= 2, tag % 2 == 1
    if not is_p.any() or not is_u.any():
        return None
    return fit_pu(x[is_p], x[is_u])


def score_documents(docs: DataFrame, model: PUModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row; 0.5 without a model."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def make(rows: pa.RecordBatch, counts: np.ndarray) -> list[pa.Array]:
        x = rates(counts).astype(np.float32).astype(float)
        return [rows.column(0), pa.array(np.full(len(x), 0.5) if model is None else model.score(x))]

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return base.mapInArrow(vectors(schema, 1, make), "doc_id long, score double")


def quality_classifier(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD, **bounds: int) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Labels are learnt only outside the held-out fold and are, like id, source
    and language, no input of a score.  Null texts score as empty ones; rows
    without an id are scored and never held out; repeated rows are each
    returned; without trusted positives every score is 0.5.  bounds are those
    of train(): positives, at most 10,000 labelled good rows, and unlabelled, at
    most 20,000 rows for the unlabelled half of the risk.  Texts of any length
    are read whole; an empty table gives an empty result.  Only the named
    columns are read.
    """
    model = train(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, **bounds)
    scored = score_documents(docs, model, id_col, text_col)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, that score at least threshold.

    Null texts score as empty ones, rows without an id like others; repeated
    rows stay or go together; without trusted positives all rows stay; an
    empty table gives an empty one.
    """
    model = train(docs, labels)
    names = docs.columns

    fields = docs.schema
    at = names.index("text")

    def keep(batches):
        from .features import count_statistics
        from .text import slices

        for batch in batches:
            for s in slices(batch.column(at), 1 << 20):
                rows = batch.slice(s.first, len(s))
                if model is None:
                    yield rows
                else:
                    x = rates(count_statistics(s)).astype(np.float32).astype(float)
                    yield rows.filter(pa.array(model.score(x) >= threshold))

    return docs.mapInArrow(keep, fields)
