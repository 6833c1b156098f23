"""Toxicity by a classifier chain of linear models.

A text's features are its distinct words (letters, digits and non-ASCII characters, lower-cased) and the words'
first 4 and 5 bytes, hashed to 2 ** BITS places. The chain predicts its categories in order; each model is a
logistic regression over the most telling features and the earlier categories' probabilities.
Later models are trained with out-of-fold predictions of the earlier ones: for each of FOLDS folds, by models
fitted to the other folds, feature choice included. At prediction the models of all rows are used.

A text is toxic if the last category's probability is over `threshold`; by default that is the cut with the largest F1
over the last category's own out-of-fold predictions.

Training uses a bounded sample (parameters): the SAMPLE labelled doc_ids of least hash, one text each (that of least hash, where a
doc_id has several), as far as their distinct features number CELLS together. Prediction covers every document.

Defined results: null and empty texts have no features and get the models' intercepts; a doc_id labelled more than once has
the largest of each label; labels that are null, or without a document, are left out; a category without both kinds of rows has its
smoothed share as probability ((n1 + 0.5) / (n + 1)); repeated documents each give a row; other columns are kept by `remove`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import words as W
from .common import Scratch

SAMPLE = 10_000
CELLS = 1 << 25  # distinct features of the sample's texts, 4 bytes each, that the driver takes
BITS = 20
STEMS = (4, 5)
FEATURES = 4096
LEAST = 3  # training texts that have a feature
FOLDS = 5
STEPS = 150
RIDGE = 2.0
#: The chain: name of the category and its label, an expression over the labels' columns.
CHAIN = (("junk", "1 - quality"), ("toxic", "toxic"))


def features(data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text number, feature) pairs, sorted; of the wanted features (a mask) alone."""
    words = W.split(data, offsets, W.ALNUM_WORDS, STEMS)
    doc = words.doc()
    longer = words.end - words.start
    found = []
    for k, hashes in ((0, words.hash), *zip(STEMS, words.stems, strict=True)):
        place = (W.mix(hashes + np.uint64(k)) >> np.uint64(64 - BITS)).astype(np.int64)
        ok = longer > k if k else np.ones(len(place), bool)
        if wanted is not None:
            ok &= wanted[place]
        found.append((doc[ok] << BITS) | place[ok])
    both = np.unique(np.concatenate(found))
    return both >> BITS, both & ((1 << BITS) - 1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Linear:
    """A logistic regression over chosen features and `extra` dense columns."""

    def fit(self, doc: np.ndarray, feature: np.ndarray, y: np.ndarray, extra: np.ndarray) -> Linear:
        n, ones = len(y), float(y.sum())
        self.weights, self.extra = np.zeros(0), np.zeros(extra.shape[1])
        self.chosen = np.zeros(0, np.int64)
        share = (ones + 0.5) / (n + 1)
        self.bias = float(np.log(share / (1 - share)))
        if not 0 < ones < n:
            return self
        a = np.bincount(feature, weights=y[doc], minlength=1 << BITS)
        b = np.bincount(feature, minlength=1 << BITS) - a
        z = np.log((a + 0.5) / (ones - a + 0.5)) - np.log((b + 0.5) / (n - ones - b + 0.5))
        z = np.abs(z) / np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
        z[a + b < LEAST] = 0
        best = np.argsort(-z, kind="stable")[:FEATURES]
        self.chosen = np.sort(best[z[best] > 0])
        at = np.full(1 << BITS, -1, np.int64)
        at[self.chosen] = np.arange(len(self.chosen))
        use = at[feature] >= 0
        row, column = doc[use], at[feature[use]]
        w, v, bias = np.zeros(len(self.chosen)), np.zeros(extra.shape[1]), self.bias
        m = [np.zeros_like(w), np.zeros_like(v), 0.0]
        s = [np.zeros_like(w), np.zeros_like(v), 0.0]
        for t in range(1, STEPS + 1):  # Adam over all rows
            p = _sigmoid(np.bincount(row, weights=w[column], minlength=n) + extra @ v + bias)
            d = p - y
            g = [np.bincount(column, weights=d[row], minlength=len(w)) + RIDGE * w, extra.T @ d + RIDGE * v, d.sum()]
            step = []
            for k in range(3):
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                s[k] = 0.99 * s[k] + 0.01 * g[k] ** 2
                step.append(0.1 * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.99**t)) + 1e-8))
            w, v, bias = w - step[0], v - step[1], bias - float(step[2])
        self.weights, self.extra, self.bias = w, v, bias
        return self

    def logit(self, doc: np.ndarray, feature: np.ndarray, n: int, extra: np.ndarray) -> np.ndarray:
        table = np.zeros(1 << BITS)
        table[self.chosen] = self.weights
        return np.bincount(doc, weights=table[feature], minlength=n) + extra @ self.extra + self.bias


def best_cut(logit: np.ndarray, y: np.ndarray) -> float:
    """The cut with the largest F1 over out-of-fold log-odds, in the middle of its gap; 0 without rows of both kinds."""
    if not 0 < y.sum() < len(y):
        return 0.0
    order = np.argsort(-logit, kind="stable")
    x, hits = logit[order], np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][x[:-1] == x[1:]] = -1
    at = int(f1.argmax())
    return float(x[at] + x[at + 1]) / 2 if at + 1 < len(x) else float(x[at]) - 1e-9


class Chain:
    """Models of the categories in order."""

    def __init__(self, names: list[str]):
        self.names, self.models, self.threshold = names, [], 0.5

    def fit(self, doc: np.ndarray, feature: np.ndarray, labels: np.ndarray, folds: int = FOLDS) -> Chain:
        n = len(labels)
        fold = np.arange(n) % folds
        extra = np.zeros((n, 0))
        for k in range(len(self.names)):
            y = labels[:, k].astype(float)
            self.models.append(Linear().fit(doc, feature, y, extra))
            held = np.zeros(n)
            for f in range(min(folds, n)):
                own, rest = fold == f, fold != f
                held[own] = self._held(doc, feature, y, extra, own, rest)
            extra = np.column_stack([extra, _sigmoid(held)])
        self.threshold = float(_sigmoid(best_cut(held, y)))
        return self

    @staticmethod
    def _held(doc, feature, y, extra, own, rest) -> np.ndarray:
        number = np.where(rest, np.cumsum(rest) - 1, np.cumsum(own) - 1)
        ours, theirs = own[doc], rest[doc]
        model = Linear().fit(number[doc[theirs]], feature[theirs], y[rest], extra[rest])
        return model.logit(number[doc[ours]], feature[ours], int(own.sum()), extra[own])

    def wanted(self) -> np.ndarray:
        mask = np.zeros(1 << BITS, bool)
        for m in self.models:
            mask[m.chosen] = True
        return mask

    def predict(self, doc: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        """Probabilities, a column for each category."""
        extra = np.zeros((n, 0))
        out = []
        for m in self.models:
            logit = m.logit(doc, feature, n, extra)
            out.append(_sigmoid(logit))
            extra = np.column_stack([extra, out[-1]])
        return np.column_stack(out)


def train(docs: DataFrame, labels: DataFrame, chain=CHAIN, sample: int = SAMPLE, cells: int = CELLS) -> Chain:
    """The chain, fitted to at most `sample` labelled doc_ids of `cells` features; their distinct features come to the driver, never texts."""
    names = [name for name, _ in chain]
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(*(F.max(F.expr(e)).cast("int").alias(f"label_{k}") for k, (_, e) in enumerate(chain)))
    known = known.where(" and ".join(f"label_{k} is not null" for k in range(len(chain)))).orderBy(F.xxhash64("label_id"), "label_id").limit(sample)
    rows = docs.select(F.col("doc_id").alias("label_id"), "text").join(F.broadcast(known), "label_id")  # `sample` rows at most are broadcast
    one = rows.groupBy("label_id", *(f"label_{k}" for k in range(len(chain)))).agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text"))["text"].alias("text"))
    kind = T.StructType([T.StructField("label_id", T.LongType()), T.StructField("y", T.ArrayType(T.IntegerType())), T.StructField("n", T.LongType()), T.StructField("f", T.BinaryType())])

    def run(frames):
        for frame in frames:
            for own, data, offsets in W.pieces(frame, "text"):
                doc, feature = features(data, offsets)
                cuts = np.searchsorted(doc, np.arange(own.num_rows + 1))
                y = np.column_stack([own.column(f"label_{k}").to_numpy(zero_copy_only=False) for k in range(len(names))])
                yield pa.RecordBatch.from_arrays([own.column("label_id").cast(pa.int64()), pa.array(y.tolist(), pa.list_(pa.int32())), pa.array(np.diff(cuts), pa.int64()), pa.array([feature[a:b].astype("<u4").tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], names=kind.names)

    found = Scratch(docs.sparkSession).save(one.mapInArrow(run, kind), "features")
    sizes = found.select("label_id", "n", F.xxhash64("label_id").alias("hash")).toPandas().sort_values(["hash", "label_id"])  # `sample` rows at most
    taken = set(sizes["label_id"][sizes["n"].cumsum() <= cells])
    got = sorted(((r["label_id"], bytes(r["f"]), r["y"]) for r in found.toLocalIterator() if r["label_id"] in taken), key=lambda r: r[0])
    y = np.array([y for _, _, y in got]).reshape(len(got), len(names))
    doc = np.repeat(np.arange(len(got), dtype=np.int32), [len(f) // 4 for _, f, _ in got])
    feature = np.frombuffer(b"".join(f for _, f, _ in got), "<u4").astype(np.int32)
    del got
    often = (np.bincount(feature, minlength=1 << BITS) >= LEAST)[feature]  # rarer ones are never chosen
    return Chain(names).fit(doc[often], feature[often], y)


def _run(docs: DataFrame, model: Chain, schema: T.StructType, row) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES weights for each category

    def run(frames):
        own_model = shared.value
        wanted = own_model.wanted()
        for frame in frames:
            for own, data, offsets in W.pieces(frame, "text", 1 << 21):
                doc, feature = features(data, offsets, wanted)
                yield row(own, own_model.predict(doc, feature, own.num_rows))

    return docs.mapInArrow(run, schema)


def scores(docs: DataFrame, labels: DataFrame, chain=CHAIN, sample: int = SAMPLE, threshold: float | None = None) -> DataFrame:
    """(doc_id, p_<category> for each category, <last category> boolean) of every document row."""
    model = train(docs, labels, chain, sample)
    last, cut = model.names[-1], model.threshold if threshold is None else threshold
    schema = T.StructType([T.StructField("doc_id", T.LongType()), *(T.StructField(f"p_{x}", T.DoubleType()) for x in model.names), T.StructField(last, T.BooleanType())])

    def row(own, p):
        return pa.RecordBatch.from_arrays([own.column("doc_id").cast(pa.int64()), *(pa.array(c, pa.float64()) for c in p.T.copy()), pa.array(p[:, -1] > cut)], names=schema.names)

    return _run(docs.select("doc_id", "text"), model, schema, row)


def remove(docs: DataFrame, labels: DataFrame, chain=CHAIN, sample: int = SAMPLE, threshold: float | None = None) -> DataFrame:
    """docs, in their own columns, without the toxic ones."""
    arrow = to_arrow_schema(docs.schema)
    model = train(docs, labels, chain, sample)
    cut = model.threshold if threshold is None else threshold

    def row(own, p):
        kept = own.filter(pa.array(~(p[:, -1] > cut)))
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(kept.columns, arrow, strict=True)], schema=arrow)

    return _run(docs, model, docs.schema, row)
