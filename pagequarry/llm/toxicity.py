"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters as its own embedding and the mean of those of its runs of four bytes, both hashed to tables
of fixed size. A window of words is read in both directions by gated recurrent units; attention pools the
states, and a logistic unit gives the window's probability. A document's score is that of its highest
window; windows overlap by a quarter and cover the whole text.

Training sees a bounded sample of labelled rows (`max_rows` of either label, the smallest by a hash of the
id), whole texts, and never a held-out row (crc32 of the id as text, modulo 5, is 0). Labels belong to
documents, so in every epoch a document trains through its highest windows of the moment. Embeddings start
from smoothed log-odds of the words and runs; those that fewer than `LEAST_DOCUMENTS` of the sample hold stay
zero, since they could only be learned by heart.

Only text enters a score. Defined results: null, empty and blank texts score as one window without words;
a null doc_id is neither held out nor trained on; repeated rows are scored each; without labels of
both kinds every score is 0; other columns are not read, ids may be of any type. An empty table gives no rows. A long text is
scored in all its windows, a step of bounded size at a time; a score of exactly 0.5 is predicted toxic.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.llm.near_dedup import _ODD, _U, _steps, mix, word_hashes

WORDS, GRAMS = 1 << 16, 1 << 15
WORD_DIM, CHAR_DIM, HIDDEN, ATTENTION = 6, 6, 8, 8
WINDOW, STRIDE = 32, 16
#: Labelled documents of either label that the network is fitted on.
MAX_ROWS = 1500
EPOCHS, BATCH, RATE, SEED = 5, 128, 0.015, 11
LEAST_DOCUMENTS = 5
#: Log-odds count in full for a word that many more documents than these hold.
SHRINK = 8
#: Share of words whose own embedding is left out in training, and the rate of embeddings to other parameters.
DROPPED, EMBEDDING_RATE = 0.4, 0.2
#: Windows of a document that train it in an epoch: the highest ones of a clean document, one of a toxic one.
CLEAN_WINDOWS = 3


def lowered(texts: list[bytes]) -> list[bytes]:
    return [t.decode("utf-8", "replace").lower().encode() for t in texts]


def inputs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the words of all texts: bucket and text; and the buckets of the four-byte runs of every word with their ends."""
    hashes, doc = word_hashes(texts)
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    word = ~((data == 32) | ((data >= 9) & (data <= 13)))
    start = np.flatnonzero(word & ~np.concatenate([[False], word[:-1]]))
    end = np.flatnonzero(word & ~np.concatenate([word[1:], [False]])) + 1
    # Runs of " word  ": as many as the word has bytes.
    size = end - start
    at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
    wide = np.where(word, data, 32).astype(_U)
    wide = np.concatenate([[_U(32)], wide, [_U(32), _U(32)]])
    code = ((wide[at] * _U(256) + wide[at + 1]) * _U(256) + wide[at + 2]) * _U(256) + wide[at + 3]
    grams = (mix(code * _ODD) % _U(GRAMS)).astype(np.int32)
    return (hashes % _U(WORDS)).astype(np.int64), doc, grams, np.cumsum(size)


def window_starts(n: int) -> list[int]:
    """Starts of overlapping windows over n words; the last one ends with the text."""
    if n <= WINDOW:
        return [0]
    return [*range(0, n - WINDOW, STRIDE), n - WINDOW]


@dataclass
class Windows:
    """Windows over numbered words: index (windows, WINDOW) into words, -1 as padding; the text of each."""

    index: np.ndarray
    doc: np.ndarray


def cut_windows(doc: np.ndarray, n: int) -> Windows:
    counts = np.bincount(doc, minlength=n)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    many = np.where(counts <= WINDOW, 1, -(-(counts - WINDOW) // STRIDE) + 1)
    owner = np.repeat(np.arange(n), many)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    start = np.minimum(nth * STRIDE, np.maximum(counts[owner] - WINDOW, 0))
    place = start[:, None] + np.arange(WINDOW)
    return Windows(np.where(place < counts[owner][:, None], place + first[owner][:, None], -1), owner)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Parameters and passes. Both directions run side by side: the second reads the window reversed."""

    def __init__(self, seed: int = SEED, dtype=np.float32):
        rng, d, h = np.random.default_rng(seed), WORD_DIM + CHAR_DIM, HIDDEN
        self.p = {
            "word": rng.normal(0, 0.05, (WORDS, WORD_DIM)),
            "char": rng.normal(0, 0.05, (GRAMS, CHAR_DIM)),
            "wx": rng.normal(0, 1 / np.sqrt(d), (2, d, 3 * h)),
            "wh": rng.normal(0, 1 / np.sqrt(h), (2, h, 3 * h)),
            "b": np.zeros((2, 3 * h)),
            "wa": rng.normal(0, 1 / np.sqrt(2 * h), (2 * h, ATTENTION)),
            "va": rng.normal(0, 1 / np.sqrt(ATTENTION), ATTENTION),
            "wo": rng.normal(0, 1 / np.sqrt(2 * h), 2 * h),
            "bo": np.zeros(1),
        }
        self.p = {k: v.astype(dtype) for k, v in self.p.items()}

    def embed(self, buckets: np.ndarray, grams: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Input of every word."""
        if not len(buckets):
            return np.zeros((0, WORD_DIM + CHAR_DIM), self.p["word"].dtype)
        starts = np.concatenate([[0], ends[:-1]])
        chars = np.add.reduceat(self.p["char"][grams], starts, axis=0) / (ends - starts)[:, None].astype(self.p["char"].dtype)
        return np.concatenate([self.p["word"][buckets], chars], 1)

    def forward(self, x: np.ndarray, index: np.ndarray, keep: bool = False):
        """Probability of every window; with `keep` also what the backward pass needs."""
        p, h, n = self.p, HIDDEN, len(index)
        x = np.concatenate([x, np.zeros((1, x.shape[1]), x.dtype)])  # the last row is the padding
        gates_x = [x @ p["wx"][k] + p["b"][k] for k in (0, 1)]
        mask = (index >= 0).astype(x.dtype)
        states, trace = np.zeros((n, WINDOW, 2 * h), x.dtype), []
        for k in (0, 1):
            s, u = np.zeros((n, h), x.dtype), p["wh"][k]
            for step in range(WINDOW):
                t = step if k == 0 else WINDOW - 1 - step
                g = gates_x[k][index[:, t]]
                zr = sigmoid(g[:, : 2 * h] + s @ u[:, : 2 * h])
                z, r = zr[:, :h], zr[:, h:]
                c = np.tanh(g[:, 2 * h :] + (r * s) @ u[:, 2 * h :])
                m = mask[:, t, None]
                new = s + m * z * (c - s)
                if keep:
                    trace.append((k, t, s, z, r, c, m))
                s = new
                states[:, t, k * h : (k + 1) * h] = s
        e = np.tanh(states @ p["wa"])
        a = e @ p["va"]
        a = np.where(mask > 0, a, -1e9) if mask.size else a
        a = np.exp(a - a.max(1, keepdims=True))
        a /= a.sum(1, keepdims=True)
        pooled = (a[:, :, None] * states).sum(1)
        y = sigmoid(pooled @ p["wo"] + p["bo"])
        return (y, (x, index, mask, states, trace, e, a, pooled)) if keep else y

    def backward(self, dlogit: np.ndarray, kept, words: tuple[np.ndarray, np.ndarray, np.ndarray], stay: np.ndarray | None = None) -> dict[str, np.ndarray]:
        p, h = self.p, HIDDEN
        x, index, mask, states, trace, e, a, pooled = kept
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["wo"], g["bo"] = pooled.T @ dlogit, dlogit.sum(keepdims=True)
        dpool = dlogit[:, None] * p["wo"]
        dstates = a[:, :, None] * dpool[:, None, :]
        da = (states * dpool[:, None, :]).sum(2)
        da = a * (da - (a * da).sum(1, keepdims=True))
        g["va"] = (e * da[:, :, None]).sum((0, 1))
        de = da[:, :, None] * p["va"] * (1 - e * e)
        g["wa"] = np.einsum("nth,nta->ha", states, de)
        dstates = dstates + de @ p["wa"].T
        dx = np.zeros_like(x)
        ds = np.zeros((len(index), h), x.dtype)
        last = None
        for k, t, s, z, r, c, m in reversed(trace):
            if k != last:
                ds, last = np.zeros_like(ds), k
            ds = ds + dstates[:, t, k * h : (k + 1) * h]
            dz, dc = ds * m * (c - s) * z * (1 - z), ds * m * z * (1 - c * c)
            drs = dc @ p["wh"][k][:, 2 * h :].T
            dr = drs * s * r * (1 - r)
            dg = np.concatenate([dz, dr, dc], 1)
            g["wh"][k][:, : 2 * h] += s.T @ dg[:, : 2 * h]
            g["wh"][k][:, 2 * h :] += (r * s).T @ dc
            g["b"][k] += dg.sum(0)
            own = index[:, t]
            g["wx"][k] += x[own].T @ dg
            np.add.at(dx, own, dg @ p["wx"][k].T)
            ds = ds * (1 - m * z) + drs * r + dg[:, : 2 * h] @ p["wh"][k][:, : 2 * h].T
        buckets, grams, ends = words
        dx = dx[:-1]
        if len(buckets):
            np.add.at(g["word"], buckets, dx[:, :WORD_DIM] if stay is None else dx[:, :WORD_DIM] * stay[:, None])
            size = np.diff(np.concatenate([[0], ends]))
            np.add.at(g["char"], grams, np.repeat(dx[:, WORD_DIM:] / size[:, None].astype(dx.dtype), size, axis=0))
        return g


def _window_scores(net: Network, texts: list[bytes], size: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Probability and text of every window."""
    buckets, doc, grams, ends = inputs(texts)
    windows = cut_windows(doc, len(texts))
    x = net.embed(buckets, grams, ends)
    parts = [_forward_local(net, x, windows.index[i : i + size]) for i in range(0, len(windows.index), size)]
    return np.concatenate(parts), windows.doc


def _forward_local(net: Network, x: np.ndarray, index: np.ndarray) -> np.ndarray:
    """The forward pass over the words of these windows alone, which lie together."""
    real = index[index >= 0]
    if not len(real):
        return net.forward(x[:0], index)
    low, high = real.min(), real.max() + 1
    return net.forward(x[low:high], np.where(index >= 0, index - low, -1))


def score_texts(net: Network, texts: list[bytes]) -> np.ndarray:
    y, doc = _window_scores(net, lowered(texts))
    out = np.zeros(len(texts))
    np.maximum.at(out, doc, y)
    return out


def train(texts: list[str], labels: list[int], epochs: int = EPOCHS, seed: int = SEED) -> Network | None:
    """The network fitted on whole labelled texts; none if there is only one label."""
    if len(set(labels)) < 2:
        return None
    net, rng = Network(seed), np.random.default_rng(seed)
    raw, label = lowered([t.encode() for t in texts]), np.array(labels)
    per = [inputs([t]) for t in raw]
    # Words and runs start from the log-odds of the documents that hold them.
    odds, learned = {}, {}
    for name, part, size in (("word", 0, WORDS), ("char", 2, GRAMS)):
        seen = np.zeros((2, size))
        for own, y in zip(per, label):
            seen[y, np.unique(own[part])] += 1
        rate = (seen + 0.5) / (np.bincount(label, minlength=2)[:, None] + 1)
        learned[name] = (seen.sum(0) >= LEAST_DOCUMENTS)[:, None]
        total = seen.sum(0)
        odds[name] = np.log(rate[1] / rate[0]) * learned[name][:, 0] * total / (total + SHRINK)
        net.p[name] *= learned[name]
        net.p[name][:, 0] = odds[name].astype(np.float32)
    starts = [cut_windows(np.zeros(len(b), np.int64), 1).index for b, *_ in per]
    best = []
    for place, (buckets, _, grams, ends) in zip(starts, per):
        if not len(buckets):
            best.append(np.zeros(1))
            continue
        size = np.diff(np.concatenate([[0], ends]))
        own = odds["word"][buckets] + np.add.reduceat(odds["char"][grams], ends - size) / size
        best.append(np.where(place >= 0, own[np.maximum(place, 0)], -99).max(1))
    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    step = 0
    for epoch in range(epochs):
        if epoch:
            best = []
            for at in range(0, len(raw), 64):
                y, doc = _window_scores(net, raw[at : at + 64])
                best += [y[doc == i] for i in range(len(raw[at : at + 64]))]
        chosen = []
        for i, scores in enumerate(best):
            top = np.argsort(-scores, kind="stable")[: 1 if label[i] else CLEAN_WINDOWS]
            # A window of any rank keeps a clean document's ordinary text in view.
            extra = [] if label[i] else [int(rng.integers(len(scores)))]
            chosen += [(i, int(w)) for w in [*top, *extra]]
        order = rng.permutation(len(chosen))
        target = np.array([label[i] for i, _ in chosen], np.float32)
        weight = np.where(target == 1, len(target) / (2 * max(target.sum(), 1)), len(target) / (2 * max((1 - target).sum(), 1))).astype(np.float32)
        # Small samples are taken in smaller batches, so that an epoch has some fifty steps at least.
        batch = min(BATCH, max(8, len(order) // 50))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            words, index = _gather([(per[chosen[j][0]], starts[chosen[j][0]][chosen[j][1]]) for j in own])
            x, stay = net.embed(*words), rng.random(len(words[0])) >= DROPPED
            x[:, :WORD_DIM] *= stay[:, None]
            y, kept = net.forward(x, index, keep=True)
            grads = net.backward((y - target[own]) * weight[own] / len(own), kept, words, stay)
            step += 1
            for k, g in grads.items():
                if k in learned:
                    g *= learned[k]
                one, two = moment[k]
                one += 0.1 * (g - one)
                two += 0.001 * (g * g - two)
                rate = RATE * EMBEDDING_RATE if k in learned else RATE
                net.p[k] -= (rate * (one / (1 - 0.9**step)) / (np.sqrt(two / (1 - 0.999**step)) + 1e-8)).astype(net.p[k].dtype)
    return net


def _gather(windows) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """The words of some windows, put together."""
    buckets, grams, sizes, rows, at = [], [], [], [], 0
    for (b, _, g, ends), place in windows:
        own = place[place >= 0]
        bounds = np.concatenate([[0], ends])
        if len(own):
            buckets.append(b[own])
            grams.append(g[bounds[own[0]] : bounds[own[-1] + 1]])
            sizes.append(np.diff(bounds[own[0] : own[-1] + 2]))
        rows.append(np.where(place >= 0, at + np.arange(WINDOW), -1))
        at += len(own)
    none = np.empty(0, np.int64)
    return (np.concatenate([none, *buckets]), np.concatenate([none.astype(np.int32), *grams]), np.cumsum(np.concatenate([none, *sizes]))), np.array(rows)


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> list[tuple[str, int]]:
    """Text and label of the sample, in a fixed order. At most max_rows texts of either label reach the driver, one for
    each id (of several the smallest), so their bytes are bounded by the longest texts of the sample."""
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(remainder(F.col("doc_id")) != 0)
    sample = None
    for y in (0, 1):
        part = known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
        sample = part if sample is None else sample.union(part)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    return [(r.text, r.toxic) for r in sorted(rows.collect(), key=lambda r: r.doc_id)]


def score(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, score of every row."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [score_texts(net, run) if net else np.zeros(len(run)) for _, run in _steps(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate([*out, np.empty(0)]))], ["doc_id", "score"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(scored, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = training_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    net = train([t for t, _ in rows], [y for _, y in rows])
    held = F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False))
    return score(docs, net).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
