"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad from its own features and those of the lines
around it. Documents carry the only labels, so training starts from the document's
label on all its lines and then frees those lines of bad documents that the field
itself finds good. Forward-backward marginals, weighted by line length, make the
document's score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldseq.llm.base import hash_sample, query, stored, table
from fieldseq.llm.language import groups, is_held_out
from fieldseq.llm.words import mix, text_buffers, word_spans

PER_CLASS, GROUP_BYTES = 1500, 2 << 20
_BYTES = np.arange(256)


def _one_of(chars: str) -> np.ndarray:
    return np.isin(_BYTES, [ord(c) for c in chars]).astype(np.uint8)


#: Byte classes whose share of a line is a feature.
CLASSES = [
    ((_BYTES >= 65) & (_BYTES <= 90)).astype(np.uint8),
    ((_BYTES >= 97) & (_BYTES <= 122)).astype(np.uint8),
    ((_BYTES >= 48) & (_BYTES <= 57)).astype(np.uint8),
    (_BYTES >= 128).astype(np.uint8),
    _one_of(" \t\r"), _one_of(".,;:?"), _one_of("!"), _one_of("|<>{}[]()=\\/_"), _one_of("#$%&*@^~+"),
    _one_of("-'\""),
]
OWN = len(CLASSES) + 7


def line_features(raw: np.ndarray, texts: pa.Array, offsets: np.ndarray
                  ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per line: features, text index, bytes. Lines end at line feeds; empty texts have none.

    Own features are byte class shares, size, word sizes, and how much of the line occurred
    before in its text (as whole line, as three words in a row, as single words).
    """
    lo, hi = int(offsets[0]), int(offsets[-1])
    part = raw[lo:hi]
    n_texts = len(offsets) - 1
    if not len(part):
        return np.zeros((0, OWN * 3), np.float32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.zeros(len(part), bool)
    first[1:] = part[:-1] == 10
    begins = offsets[:-1][np.diff(offsets) > 0] - lo
    first[begins] = True
    starts = np.flatnonzero(first)
    size = np.diff(np.append(starts, len(part)))
    doc = np.searchsorted(offsets, starts + lo, "right") - 1
    out = np.zeros((len(starts), OWN), np.float32)
    for k, member in enumerate(CLASSES):
        out[:, k] = np.add.reduceat(member[part], starts, dtype=np.int64) / size
    at = len(CLASSES)
    spans = list(word_spans(texts))
    hashes, owner, length, begin = (np.concatenate([s[i] for s in spans]) for i in range(4)) \
        if spans else (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
    line = np.searchsorted(starts + lo, begin, "right") - 1
    n_words = np.bincount(line, minlength=len(starts))
    out[:, at] = np.log1p(size) / 5
    out[:, at + 1] = np.log1p(n_words) / 4
    out[:, at + 2] = np.bincount(line, length, len(starts)) / np.maximum(n_words, 1) / 8

    def seen(keys: np.ndarray, where: np.ndarray) -> np.ndarray:
        """Whether a key occurred earlier in the same text."""
        order = np.lexsort((keys, where))
        again = np.zeros(len(keys), bool)
        same = (keys[order][1:] == keys[order][:-1]) & (where[order][1:] == where[order][:-1])
        again[order[1:]] = same
        return again

    every = np.maximum(n_words, 1)
    out[:, at + 3] = np.bincount(line, seen(hashes, owner), len(starts)) / every
    if len(hashes) > 2:
        runs = mix(hashes[:-2]) + mix(hashes[1:-1] * np.uint64(3)) + mix(hashes[2:] * np.uint64(5))
        whole = owner[:-2] == owner[2:]
        again = seen(runs[whole], owner[:-2][whole])
        out[:, at + 4] = np.bincount(line[:-2][whole], again, len(starts)) / every
    where = np.flatnonzero(n_words > 0)
    if len(where):
        heads = np.searchsorted(line, where)
        keys = np.add.reduceat(hashes * (np.arange(len(hashes)) - np.repeat(
            heads, np.diff(np.append(heads, len(hashes)))) + 1).astype(np.uint64), heads)
        out[where, at + 5] = seen(mix(keys), doc[where])
    out[:, at + 6] = n_words == 0
    before, after = np.zeros_like(out), np.zeros_like(out)
    joined = doc[1:] == doc[:-1]
    before[1:][joined] = out[:-1][joined]
    after[:-1][joined] = out[1:][joined]
    return np.concatenate((out, before, after), axis=1), doc, size


@dataclass
class Field:
    """Weights of the chain: unary weights and bias, scores of the four transitions, calibration."""

    unary: np.ndarray
    bias: float
    steps: np.ndarray  # [from, to], 0 bad, 1 good
    mean: np.ndarray
    scale: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def marginals(self, features: np.ndarray, doc: np.ndarray
                  ) -> tuple[np.ndarray, np.ndarray]:
        """P(line good), and per line the four pair probabilities with its predecessor.

        Forward and backward passes move line by line over all texts at once.
        """
        n = len(doc)
        u = ((features - self.mean) / self.scale) @ self.unary + self.bias
        first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if n else np.zeros(0, np.int64)
        size = np.diff(np.append(first, n))
        order = np.argsort(-size, kind="stable")
        first, size = first[order], size[order]
        good = 1 / (1 + np.exp(-np.clip(u, -30, 30)))
        local = np.stack((1 - good, good), axis=1)
        step = np.exp(self.steps - self.steps.max())
        forward, back = np.zeros((n, 2)), np.ones((n, 2))
        if n:
            a = local[first]
            forward[first] = a / a.sum(axis=1, keepdims=True)
        alive = np.searchsorted(-size, -np.arange(1, int(size.max()) + 1 if n else 1), "right")
        for t in range(1, int(size.max()) if n else 0):
            k = alive[t]
            at = first[:k] + t
            a = (forward[at - 1] @ step) * local[at]
            forward[at] = a / a.sum(axis=1, keepdims=True)
        for t in range((int(size.max()) if n else 0) - 1, 0, -1):
            k = alive[t]
            at = first[:k] + t
            b = (local[at] * back[at]) @ step.T
            back[at - 1] = b / b.sum(axis=1, keepdims=True)
        p = forward * back
        p /= p.sum(axis=1, keepdims=True)
        pair = np.zeros((n, 2, 2))
        inner = np.ones(n, bool)
        inner[first] = False
        at = np.flatnonzero(inner)
        pair[at] = forward[at - 1][:, :, None] * step[None] * (local[at] * back[at])[:, None, :]
        pair[at] /= pair[at].sum(axis=(1, 2), keepdims=True)
        return p[:, 1], pair

    def good_share(self, features: np.ndarray, doc: np.ndarray, size: np.ndarray, n: int
                   ) -> np.ndarray:
        """Length-weighted marginal of good lines per text; nan without lines."""
        p, _ = self.marginals(features, doc)
        total = np.bincount(doc, size, n)
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.bincount(doc, size * p, n) / total

    def score(self, share: np.ndarray) -> np.ndarray:
        """Calibrated probability of label 1; a text without lines counts as all bad."""
        share = np.clip(np.nan_to_num(share, nan=0.0), 1e-4, 1 - 1e-4)
        z = self.slope * np.log(share / (1 - share)) + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(features: np.ndarray, doc: np.ndarray, size: np.ndarray, label: np.ndarray,
          weight: np.ndarray, rounds: int = 3, steps: int = 80, rate: float = 0.15,
          decay: float = 1e-3) -> Field:
    """Fit the field to documents (label 0/1 per text index) by adaptive gradient steps."""
    mean, scale = features.mean(axis=0), features.std(axis=0) + 1e-3
    model = Field(np.zeros(features.shape[1]), 0.0, np.zeros((2, 2)), mean, scale)
    x = (features - mean) / scale
    y = label[doc].astype(float)
    share = size / np.bincount(doc, size, len(label))[doc]
    heavy = weight[doc] * (0.2 + np.bincount(doc, minlength=len(label))[doc] * share)
    heavy = heavy / heavy.mean()
    follows = np.append(False, doc[1:] == doc[:-1]) if len(doc) else np.zeros(0, bool)
    for _ in range(rounds):
        moment, second = 0.0, 0.0
        for t in range(1, steps + 1):
            p, pair = model.marginals(features, doc)
            miss = (y - p) * heavy
            seen = np.zeros((2, 2))
            np.add.at(seen, (y[:-1][follows[1:]].astype(int), y[1:][follows[1:]].astype(int)), 1.0)
            gap = (seen - pair.sum(axis=0)) / max(len(doc), 1)
            slope = np.concatenate((x.T @ miss / len(doc) - decay * model.unary, [miss.mean()],
                                    (gap - decay * model.steps).ravel()))
            moment = 0.9 * moment + 0.1 * slope
            second = 0.99 * second + 0.01 * slope ** 2
            move = rate * (moment / (1 - 0.9 ** t)) / (np.sqrt(second / (1 - 0.99 ** t)) + 1e-8)
            model.unary = model.unary + move[:-5]
            model.bias += move[-5]
            model.steps = model.steps + move[-4:].reshape(2, 2)
        p, _ = model.marginals(features, doc)
        # lines of bad documents the field finds good are freed, but never the worse half
        order = np.lexsort((p, doc))
        rank = np.empty(len(doc))
        rank[order] = np.arange(len(doc)) - np.searchsorted(doc[order], doc[order])
        count = np.bincount(doc, minlength=len(label))[doc]
        y = np.where(label[doc] == 1, 1.0, ((p > 0.5) & (rank >= (count + 1) // 2)).astype(float))
    share = np.clip(np.nan_to_num(model.good_share(features, doc, size, len(label)), nan=0.0),
                    1e-4, 1 - 1e-4)
    z = np.log(share / (1 - share))
    beta = np.array([1.0, 0.0])
    design = np.stack((z, np.ones(len(z))), axis=1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        slope = design.T @ ((label - p) * weight) - 0.1 * (beta - [1.0, 0.0])
        curve = (design * (weight * p * (1 - p))[:, None]).T @ design + 0.1 * np.eye(2)
        beta = beta + np.linalg.solve(curve, slope)
    model.slope, model.shift = max(float(beta[0]), 0.05), float(beta[1])
    return model


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(0)
        raw, offsets = text_buffers(texts)
        for a, b in groups(offsets, GROUP_BYTES):
            part = texts.slice(a, b - a)
            own = offsets[a:b + 1]
            x, doc, size = line_features(raw, part, own)
            cut = np.searchsorted(doc, np.arange(b - a + 1))
            yield pa.RecordBatch.from_arrays([
                batch.column(1).slice(a, b - a), batch.column(2).slice(a, b - a),
                pa.array([x[i:j].astype(np.float32).tobytes() for i, j in zip(cut, cut[1:])],
                         pa.binary()),
                pa.array([size[i:j].tolist() for i, j in zip(cut, cut[1:])], pa.list_(pa.int64()))],
                ["doc_id", "label", "x", "size"])


def fit(docs: DataFrame, labels: DataFrame, label: Column, per_class: int = PER_CLASS) -> Field:
    """Fit on at most `per_class` labelled documents of each class, by a hash of the id.

    Ids with contradicting labels are left out. Classes weigh as they occur among all labels.
    """
    known = (labels.select("doc_id", label.alias("label")).filter("doc_id is not null")
             .groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("_top"))
             .filter("label = _top and label in (0, 1)").drop("_top"))
    known = stored(known, "quality_labels")
    chosen = stored(hash_sample(known, "label", "doc_id", per_class), "quality_sample")
    totals = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    rows = (docs.select("text", "doc_id").join(chosen, "doc_id").select("text", "doc_id", "label")
            .mapInArrow(_measure, "doc_id long, label int, x binary, size array<long>")
            .orderBy("doc_id", F.xxhash64("x")).collect())
    sizes = [np.asarray(r["size"], np.int64) for r in rows]
    doc = np.repeat(np.arange(len(rows)), [len(s) for s in sizes]) if rows else np.zeros(0, np.int64)
    if not len(doc) or len(totals) < 2:
        prior = totals.get(1, 0) / max(sum(totals.values()), 1)
        flat = Field(np.zeros(OWN * 3), 0.0, np.zeros((2, 2)), np.zeros(OWN * 3), np.ones(OWN * 3))
        flat.slope, flat.shift = 0.05, float(np.log((prior + 0.01) / (1.01 - prior)))
        return flat
    x = np.concatenate([np.frombuffer(r["x"], np.float32).reshape(-1, OWN * 3) for r in rows])
    y = np.array([r["label"] for r in rows])
    took = np.bincount(y, minlength=2)
    weight = np.array([totals[c] / max(took[c], 1) for c in (0, 1)])[y]
    return train(x.astype(np.float64), doc, np.concatenate(sizes), y, weight / weight.mean())


def score(docs: DataFrame, model: Field) -> DataFrame:
    """Add quality_score (0 to 1) to all rows in one pass; null and empty texts are scored too.

    A column of that name is replaced; other columns and repeated rows stay as they are.
    """
    docs = docs.drop("quality_score")
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred numbers

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for batch in batches:
            texts = batch.column(names.index("text"))
            raw, offsets = text_buffers(texts)
            out = np.zeros(batch.num_rows)
            for a, b in groups(offsets, GROUP_BYTES):
                x, doc, size = line_features(raw, texts.slice(a, b - a), offsets[a:b + 1])
                out[a:b] = field.score(field.good_share(x, doc, size, b - a))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)],
                                             [*names, "quality_score"])

    return docs.mapInArrow(apply, T.StructType(list(docs.schema)).add("quality_score", "double"))


@query("op5_line_crf_quality")
def op5_line_crf_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(is_held_out(3, 1), F.lit(False))
    model = fit(docs, table(spark, sf_dir, "labels").filter(~held), F.col("quality").cast("int"))
    value = F.col("quality_score")
    return score(docs, model).select("doc_id", held.alias("held_out"), value.alias("score"),
                                     (value >= 0.5).cast("int").alias("predicted"))
