"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a text's UTF-8 bytes in windows of WINDOW bytes, from the left
and from the right, and gives each byte position probabilities of the languages.
A document's probabilities are the mean over all its positions. It is trained in
numpy by backpropagation through time, on windows of a bounded sample of labelled documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes that the network reads before its state starts anew, units in each direction, windows in a batch.
WINDOW, UNITS, BATCH = 128, 8, 4096
#: Training: documents sampled for each language at most, about; windows a document gives; steps; windows in a step, their bytes at most; rate.
SAMPLE, WINDOWS, STEPS, STEP_WINDOWS, STEP_BYTES, RATE = 400, 4, 240, 192, 48, 0.02
#: Characters of a sampled text that come to the driver at most; languages learned at most, the most frequent ones.
STRETCH, LANGUAGES = 4096, 1000
UNKNOWN = "und"


@dataclass
class Direction:
    """Gates z, r and candidate n, one under the other: inputs (3 units x 256 bytes), recurrent weights and their bias."""

    inputs: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def step(self, x: np.ndarray, h: np.ndarray) -> np.ndarray:
        return self.step_kept(x, h)[0]

    def step_kept(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """h' = (1 - z) n + z h, with what the way back needs."""
        k = h.shape[0]
        a = np.take(self.inputs, x, axis=1)
        u = self.weights @ h
        u += self.bias
        g = a[: 2 * k]
        g += u[: 2 * k]
        g *= 0.25
        g += 0.5
        np.clip(g, 0.0, 1.0, out=g)  # gates: a piecewise linear sigmoid
        z, r = g[:k], g[k:]
        n = u[2 * k :] * r
        n += a[2 * k :]
        np.tanh(n, out=n)
        out = h - n
        out *= z
        out += n
        return out, g, n, u[2 * k :]


@dataclass
class Network:
    languages: list[str]
    left: Direction
    right: Direction
    out: np.ndarray  # languages x 2 units
    out_bias: np.ndarray
    parts: list[np.ndarray] = field(default_factory=list)

    def parameters(self) -> list[np.ndarray]:
        return [self.left.inputs, self.left.weights, self.left.bias, self.right.inputs, self.right.weights, self.right.bias, self.out, self.out_bias]

    def label(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Sum over a window's positions of their probabilities: windows as columns of x (bytes x windows), the first `length` rows real."""
        steps, many = x.shape
        whole = int(lengths.min()) if many else 0
        h = np.zeros((UNITS, many), np.float32)
        ahead = np.empty((steps, UNITS, many), np.float32)
        for t in range(steps):
            h = ahead[t] = self.left.step(x[t], h)
        h = np.zeros((UNITS, many), np.float32)
        total = np.zeros((len(self.languages), many), np.float32)
        w_left, w_right = self.out[:, :UNITS], self.out[:, UNITS:]
        for t in range(steps - 1, -1, -1):
            h = self.right.step(x[t], h)
            if t >= whole:  # the way from the right begins at each window's own end
                h *= lengths > t
            p = w_left @ ahead[t]
            p += w_right @ h
            p += self.out_bias
            np.exp(p, out=p)
            s = p.sum(0)
            if t >= whole:
                s[lengths <= t] = np.inf
            p /= s
            total += p
        return total


def new_network(languages: list[str], rng: np.random.Generator) -> Network:
    def some(*shape: int, scale: float) -> np.ndarray:
        return rng.normal(0, scale, shape).astype(np.float32)

    def one() -> Direction:
        return Direction(some(3 * UNITS, 256, scale=0.3), some(3 * UNITS, UNITS, scale=0.3), np.zeros((3 * UNITS, 1), np.float32))

    return Network(languages, one(), one(), some(len(languages), 2 * UNITS, scale=0.3), np.zeros((len(languages), 1), np.float32))


def _run(d: Direction, x: np.ndarray) -> tuple[list, np.ndarray]:
    h, kept, states = np.zeros((UNITS, x.shape[1]), np.float32), [], []
    for row in x:
        new, g, n, u = d.step_kept(row, h)
        kept.append((h, g, n, u))
        states.append(new)
        h = new
    return kept, np.stack(states)


def _back(d: Direction, x: np.ndarray, kept: list, grads: np.ndarray) -> list[np.ndarray]:
    """Gradients of one direction's parameters, by backpropagation through time."""
    k = UNITS
    dw, db, dh = np.zeros_like(d.weights), np.zeros_like(d.bias), np.zeros_like(grads[0])
    da = np.empty((len(x), 3 * k, x.shape[1]), np.float32)
    for t in range(len(x) - 1, -1, -1):
        h, g, n, u = kept[t]
        dh = dh + grads[t]
        z, r = g[:k], g[k:]
        inner = 0.25 * ((g > 0) & (g < 1))
        dn = dh * (1 - z) * (1 - n * n)
        da[t, :k] = dh * (h - n) * inner[:k]
        da[t, k : 2 * k] = dn * u * inner[k:]
        da[t, 2 * k :] = dn
        du = da[t].copy()
        du[2 * k :] *= r
        dw += du @ h.T
        db += du.sum(1, keepdims=True)
        dh = dh * z + d.weights.T @ du
    di = np.zeros((256, 3 * k), np.float32)
    np.add.at(di, x.ravel(), da.transpose(0, 2, 1).reshape(-1, 3 * k))
    return [di.T, dw, db]


def _windows(samples: list[tuple[str, str]], languages: list[str], rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, lengths, labels) of WINDOWS windows of each text; a text of fewer than STEP_BYTES bytes is a window whole, filled up with zeros."""
    rows, lengths, labels = [], [], []
    for text, lang in samples:
        data = np.frombuffer(text.encode(), np.uint8)
        n = min(len(data), STEP_BYTES)
        for _ in range(WINDOWS if n else 0):
            s = rng.integers(0, len(data) - n + 1)
            rows.append(np.pad(data[s : s + n], (0, STEP_BYTES - n)))
            lengths.append(n)
            labels.append(languages.index(lang))
    return np.array(rows, np.uint8).reshape(-1, STEP_BYTES), np.array(lengths, np.int64), np.array(labels, np.int64)


def _gradients(net: Network, x: np.ndarray, lengths: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Gradients of all parameters for windows as columns of x; positions from a window's length on count for nothing."""
    back = lengths - 1 - np.arange(len(x))[:, None]  # a position's place from the window's end, its own inverse
    real = back >= 0
    back = np.where(real, back, 0)

    def turned(states: np.ndarray) -> np.ndarray:
        return np.take_along_axis(states, back[:, None, :], 0) * real[:, None, :]

    x_back = np.take_along_axis(x, back, 0)
    kept_l, left = _run(net.left, x)
    kept_r, right = _run(net.right, x_back)
    both = np.concatenate([left, turned(right)], 1)  # positions x 2 units x windows
    logits = net.out @ both + net.out_bias
    p = np.exp(logits - logits.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    p[:, y, np.arange(len(y))] -= 1  # each position carries its document's label
    p *= (real / real.sum())[:, None, :]
    p = p.astype(np.float32)
    grad_both = net.out.T @ p
    grads = _back(net.left, x, kept_l, grad_both[:, :UNITS]) + _back(net.right, x_back, kept_r, turned(grad_both[:, UNITS:]).astype(np.float32))
    return [*grads, np.einsum("tlb,tub->lu", p, both, optimize=True), p.sum((0, 2))[:, None]]


def train(samples: list[tuple[str, str]], seed: int = 7) -> Network:
    """A network from (text, language) pairs. The same pairs in the same order give the same network. Empty texts teach nothing."""
    rng = np.random.default_rng(seed)
    languages = sorted({lang for text, lang in samples if text})
    x_all, n_all, y_all = _windows(samples, languages, rng) if languages else (np.zeros((0, STEP_BYTES), np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64))
    net = new_network(languages, rng)
    if len(languages) < 2:
        return net
    by = [np.flatnonzero(y_all == i) for i in range(len(languages))]
    params = net.parameters()
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, STEPS + 1):
        pick = np.concatenate([rng.choice(b, STEP_WINDOWS // len(by) + 1) for b in by])  # languages in like shares
        grads = _gradients(net, np.ascontiguousarray(x_all[pick].T), n_all[pick], y_all[pick])
        norm = max(1.0, float(np.sqrt(sum((g * g).sum() for g in grads))))
        rate = RATE * min(1.0, 2 * (1 - step / (STEPS + 1)))
        for q, g, a, b in zip(params, grads, first, second, strict=True):  # Adam
            g = g / norm
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            q -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def probabilities(net: Network, texts: list[str]) -> np.ndarray:
    """documents x languages: means over all byte positions (zeros for empty texts)."""
    sums = np.zeros((len(texts), len(net.languages)))
    sizes = np.zeros(len(texts))
    group, at, held = [], [], 0
    for i, t in enumerate(texts):
        data = np.frombuffer(t.encode(), np.uint8)
        sizes[i] = max(1, len(data))
        for s in range(0, len(data), WINDOW * BATCH):  # the longest texts give several groups
            group.append(data[s : s + WINDOW * BATCH])
            at.append(i)
            held += -(-len(group[-1]) // WINDOW)
            if held >= BATCH:
                _label_group(net, group, at, sums)
                group, at, held = [], [], 0
    _label_group(net, group, at, sums)
    return sums / sizes[:, None]


def _label_group(net: Network, group: list[np.ndarray], at: list[int], sums: np.ndarray) -> None:
    if not group:
        return
    counts = [-(-len(g) // WINDOW) for g in group]
    n = sum(counts)
    x, lengths, owner = np.zeros((n, WINDOW), np.uint8), np.full(n, WINDOW), np.repeat(at, counts)
    row = 0
    for g, c in zip(group, counts, strict=True):
        x[row : row + c].reshape(-1)[: len(g)] = g
        lengths[row + c - 1] = len(g) - (c - 1) * WINDOW
        row += c
    for part in (np.flatnonzero(lengths == WINDOW), np.flatnonzero(lengths < WINDOW)):
        for s in range(0, len(part), BATCH):
            rows = part[s : s + BATCH]
            steps = int(lengths[rows].max())
            total = net.label(np.ascontiguousarray(x[rows, :steps].T).astype(np.intp), lengths[rows])
            for k in range(len(net.languages)):
                sums[:, k] += np.bincount(owner[rows], total[k], len(sums))


def held_out_number(doc_id) -> int:
    """crc32 of the id as text, modulo 5; 0 means held out."""
    return zlib.crc32(str(doc_id).encode()) % 5


def sample(docs: DataFrame) -> list[tuple[str, str]]:
    """Of labelled documents that are not held out, about SAMPLE for each language, whatever the table's size: the lowest hashes of their ids."""
    d = docs.where(F.col("lang").isNotNull() & (F.col("text") != "") & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    counts = {r.lang: r.n for r in d.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()}
    if not counts:
        return []
    spread = 1 << 30
    share = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, int(min(1.0, SAMPLE / n) * spread))])
    kept = d.withColumn("_h", F.pmod(F.xxhash64("doc_id"), F.lit(spread))).where(F.col("_h") < F.coalesce(F.try_element_at(share, F.col("lang")), F.lit(0)))
    # of a text what windows may be cut from: a stretch from a place that its hash names, so that the driver holds little
    at = F.pmod(F.xxhash64("text", F.lit(1)), F.greatest(F.lit(1), F.length("text") - STRETCH + 1)).cast("int") + 1
    rows = kept.orderBy("_h", "doc_id", "text").limit(2 * SAMPLE * len(counts)).select(F.substring("text", at, F.lit(STRETCH)).alias("text"), "lang").collect()
    return [(r.text, r.lang) for r in rows]


RESULT = "doc_id long, held_out boolean, lang_pred string, score double"


def identify(docs: DataFrame, net: Network | None = None, extra: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score (mean probability of lang_pred), and the extra columns as they are.

    Without a network one is trained on a sample of the documents that have a language and are not held out.
    Texts that are null, empty or without a letter (str.isalpha) are `und`, score 0; so is every text where nothing could be learned.
    Ties go to the language that comes first. Long texts are read whole. Null ids count as held out by the text "None".
    Repeated rows give a row each, an empty table none.
    """
    net = net or train(sample(docs))
    held = docs.sparkSession.sparkContext.broadcast(net)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = held.value
        for b in (whole.slice(i, 1000) for whole in batches for i in range(0, whole.num_rows, 1000)):
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            real = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))] if net.languages else []
            lang, score = [UNKNOWN] * len(ids), [0.0] * len(ids)
            if real:
                p = probabilities(net, [texts[i] for i in real])
                for i, k, s in zip(real, p.argmax(1), p.max(1), strict=True):
                    lang[i], score[i] = net.languages[k], min(1.0, float(s))
            cols = [b.column(0), pa.array([held_out_number(i) == 0 for i in ids], pa.bool_()), pa.array(lang, pa.string()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays(cols + b.columns[2:], names=["doc_id", "held_out", "lang_pred", "score", *extra])

    kinds = dict(docs.dtypes)
    schema = ", ".join([RESULT, *(f"`{c}` {kinds[c]}" for c in extra)])
    return docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("_text"), *extra).mapInArrow(work, schema)
