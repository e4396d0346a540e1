"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One weight vector over hashed text features and ordered thresholds: P(grade <= k) = sigmoid(threshold_k - w.x).
It gives an expected grade and tail probabilities P(grade >= k), by which documents are selected.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import tune

#: Hashed features.
DIMENSIONS = 1 << 18
#: Labelled documents that the model is fitted on: at most about so many, those of the smallest hashed ids.
FIT_ROWS = 20_000
#: Bytes that are neither letters nor digits end a word; beyond ASCII all bytes are letters.
_WORD = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 else c + 32 if 65 <= c < 91 else 32 for c in range(256))
_MARKS = bytes(c for c in range(33, 127) if _WORD[c] == 32)
_UPPER, _DIGITS, _SPACES = bytes(range(65, 91)), b"0123456789", b" \t\n\x0b\x0c\r"


def _level(name: str, share: float, steps: int = 20) -> list[bytes]:
    """A share as the levels that it passes: near shares have most levels in common."""
    return [b"\x01%s%d" % (name.encode(), i) for i in range(1, int(share * steps) + 1)]


def _named(raw: bytes, n_distinct: int) -> list[bytes]:
    """Features of the shape of a text. Levels are of the whole text and of its most extreme line, so that a poor passage shows in a long text."""
    lines = [x for x in raw.split(b"\n") if x.strip()]
    shapes = [_shape(x) for x in set(lines) if len(x) >= 40]
    whole = _shape(raw)
    named = [b"\x01words%d" % min(12, n_distinct.bit_length()), *_level("same line", 1 - len(set(lines)) / max(1, len(lines)))]
    for i, name in enumerate(("upper", "digit", "mark", "again", "lone")):
        named += _level(name, whole[i])
        named += _level("most " + name, max((x[i] for x in shapes), default=0.0))
    return named


def features(text: bytes | None) -> np.ndarray:
    """Sorted distinct feature numbers of a whole text: its words, lower-cased, how they begin, and levels of its shape."""
    raw = bytes(text or b"")
    distinct = set(raw.translate(_WORD).split())
    begins = {b"\x02" + w[:k] for w in distinct for k in (4, 5) if len(w) > k}
    names = (*distinct, *begins, *_named(raw, len(distinct)))
    return np.unique(np.fromiter(map(zlib.crc32, names), np.int64, len(names)) % DIMENSIONS).astype(np.int32)


def _shape(text: bytes) -> tuple[float, ...]:
    """Shares: upper case, digits and other marks of what isn't space; words that are there before; words of one character."""
    words = text.split()
    plain = text.translate(None, _SPACES)
    size, n = max(1, len(plain)), max(1, len(words))
    letters = len(plain.translate(None, _MARKS))
    upper, digit = (size - len(plain.translate(None, x)) for x in (_UPPER, _DIGITS))
    return upper / size, digit / size, (size - letters) / size, 1 - len(set(words)) / n, sum(len(w) == 1 for w in words) / n


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k from 1, one column each."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -30, 30)))


def fit(rows: list[np.ndarray], grades: np.ndarray, n_grades: int, epochs: int = 20, rate: float = 0.3, decay: float = 1e-5, least: float = 4.5, seed: int = 6) -> Model:
    """Minimises the negative log likelihood by AdaGrad over mini-batches in a seeded order.

    Only features get a weight whose rows reach some grade or a higher one more or less often than all rows do, by
    ``least`` standard errors: the many others would add up to noise in long texts.
    The thresholds are the first one and positive steps, so they stay in order. Grades that no row has keep their
    threshold near its start.
    """
    w, g2 = np.zeros(DIMENSIONS), np.full(DIMENSIONS, 1e-8)
    cuts = np.concatenate([[-0.5], np.zeros(max(0, n_grades - 2))])  # first threshold, log steps
    c2 = np.full(len(cuts), 1e-8)
    rng = np.random.Generator(np.random.PCG64(seed))
    if rows:
        n = np.zeros(DIMENSIONS, np.int64)
        for r in rows:
            n[r] += 1
        telling = np.zeros(DIMENSIONS, bool)
        for k in range(1, n_grades):
            reach = (grades >= k).astype(float)
            off = np.zeros(DIMENSIONS)
            for r, x in zip(rows, reach - reach.mean()):
                off[r] += x
            telling |= np.abs(off) >= least * max(reach.std(), 1e-9) * np.sqrt(np.maximum(n, 5))
        rows = [r[telling[r]] for r in rows]
    lens = np.array([len(r) for r in rows], np.int64)
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int32)
    first = np.cumsum(lens) - lens
    batch = 64
    for _ in range(epochs if len(rows) else 0):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), batch):
            own = order[lo : lo + batch]
            idx = np.concatenate([flat[first[i] : first[i] + lens[i]] for i in own])
            rep = np.repeat(np.arange(len(own)), lens[own])
            s = np.bincount(rep, w[idx], len(own))
            t = cuts[0] + np.concatenate([[0.0], np.cumsum(np.exp(cuts[1:]))])
            # P(grade <= k) with 0 before the first and 1 after the last threshold
            cdf = np.hstack([np.zeros((len(own), 1)), 1 / (1 + np.exp(np.clip(s[:, None] - t[None, :], -30, 30))), np.ones((len(own), 1))])
            y = grades[own]
            hi, low = cdf[np.arange(len(own)), y + 1], cdf[np.arange(len(own)), y]
            p = np.maximum(hi - low, 1e-9)
            dhi, dlow = hi * (1 - hi) / p, low * (1 - low) / p
            ds = dhi - dlow  # derivative of the loss by the score
            grad_t = np.zeros(len(t))
            np.add.at(grad_t, y[y < len(t)], -dhi[y < len(t)])
            np.add.at(grad_t, y[y > 0] - 1, dlow[y > 0])
            used, inverse = np.unique(idx, return_inverse=True)
            gw = np.bincount(inverse, ds[rep], len(used)) / len(own) + decay * w[used]
            g2[used] += gw * gw
            w[used] -= rate * gw / np.sqrt(g2[used])
            gc = np.concatenate([[grad_t.sum()], [grad_t[k:].sum() * np.exp(cuts[k]) for k in range(1, len(cuts))]]) / len(own)
            c2 += gc * gc
            cuts = cuts - rate * gc / np.sqrt(c2)
    return Model(w, cuts[0] + np.concatenate([[0.0], np.cumsum(np.exp(cuts[1:]))]))


def grade() -> Column:
    """Grades of the labels: 0 toxic, 1 poor, 2 good; null where quality is unknown and the text isn't toxic."""
    return F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, doc_id: str = "doc_id", text: str = "text", n_grades: int = 3) -> Model:
    """Fits on at most ``rows`` labelled documents, those whose hashed ids come first (ids of equal hashes by the id), in one task of an executor.

    Only the model reaches the driver. Labels without a grade or an id, and repeated labels of an id beyond the worst
    grade, are not used; of documents with one id the least text is. Without usable labels all documents get the same
    score.
    """
    tune(docs.sparkSession)
    graded = labels.select(F.col(doc_id).alias("__id"), grade().alias("grade")).filter("grade is not null and __id is not null")
    graded = graded.groupBy("__id").agg(F.min("grade").alias("grade"))
    chosen = graded.orderBy(F.xxhash64(F.lit(6), "__id"), "__id").limit(rows)
    texts = docs.select(F.col(doc_id).alias("__id"), F.col(text).cast("binary").alias("__text"))

    def extract(parts):
        for b in parts:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([features(t) for t in b.column(2).to_pylist()], pa.list_(pa.int32()))], ["__id", "grade", "features"])

    def solve(key, sample):
        sample = sample.sort_by("__id")
        lists = sample["features"].combine_chunks()
        offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        model = fit([flat[a:b] for a, b in zip(offsets, offsets[1:])], sample["grade"].to_numpy().astype(np.int64), n_grades)
        used = np.flatnonzero(model.weights)
        return pa.table({"feature": [used.tolist()], "weight": [model.weights[used].tolist()], "threshold": [model.thresholds.tolist()]})

    kind = docs.schema[doc_id].dataType.simpleString()
    # at most `rows` ids, one text of each
    found = texts.join(F.broadcast(chosen), "__id").groupBy("__id", "grade").agg(F.min("__text").alias("__text"))
    sample = found.mapInArrow(extract, f"__id {kind}, grade int, features array<int>")
    # the sample is bounded, and so are its features
    got = sample.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(solve, "feature array<long>, weight array<double>, threshold array<double>").first()
    if got is None:
        return fit([], np.zeros(0, np.int64), n_grades)
    weights = np.zeros(DIMENSIONS)
    weights[got["feature"]] = got["weight"]
    return Model(weights, np.array(got["threshold"]))


def score(docs: DataFrame, model: Model, carry: tuple = ("doc_id",), text: str = "text") -> DataFrame:
    """One row per row of ``docs``: the carried columns, expected_grade, tail_1 and on (P(grade >= k)).

    The whole text counts, however long; null counts as empty and is scored like any text; repeated rows are rows of
    their own and get equal scores; an empty table gives no rows; other columns, whatever their names, are not read.
    """
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIMENSIONS numbers
    n = len(model.thresholds)

    def run(parts):
        m = shared.value
        for b in parts:
            tails = m.tails(np.fromiter((m.weights[features(t)].sum() for t in b.column(len(carry)).to_pylist()), float, b.num_rows))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(carry)], pa.array(tails.sum(axis=1)), *[pa.array(np.ascontiguousarray(tails[:, k])) for k in range(n)]], [*carry, "expected_grade", *[f"tail_{k + 1}" for k in range(n)]])

    source = docs.select(*[F.col(f"`{c}`") for c in carry], F.col(text).cast("binary").alias("__text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(run, f"{kinds}, expected_grade double, " + ", ".join(f"tail_{k + 1} double" for k in range(n)))


def good_documents(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """``docs`` whose chance of the top grade is at least ``least``, all columns kept. No shuffle: rows are scored where they are."""
    model = train(docs, labels)
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    text = next(f"c{i}" for i, c in enumerate(names) if c.lower() == "text")
    scored = score(plain, model, carry=tuple(plain.columns), text=text).filter(F.col(f"tail_{len(model.thresholds)}") >= least)
    return scored.select([F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
