"""Language identification by a bidirectional gated recurrent network over bytes.

The unit has an update gate and no reset gate (the light gated unit of
Ravanelli et al., 2018). It is trained in numpy by backpropagation through time
on windows of bytes, with the document's language as the label of every
position. For prediction every text is cut into windows of WINDOW bytes, which
run side by side as lanes of one matrix. A window's states start afresh, so it
also reads CONTEXT bytes on either side, which warm them up and are labelled in
their own windows; every byte of a text is labelled once, and a document's
probabilities are the means over all its bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HIDDEN, WINDOW, CONTEXT, LANES = 8, 256, 16, 1024
#: Bounds of the training sample by default: documents in all, documents of a language, code points of a document.
SAMPLE_DOCS, DOCS_PER_LANGUAGE, SAMPLE_CHARS = 20_000, 300, 1200
#: A label column with more values than this holds no languages.
MAX_LABELS = 10_000
#: Length and number of the windows of a training step, steps, and learning rate.
TRAIN_WINDOW, TRAIN_BATCH, STEPS, RATE = 64, 128, 240, 0.02
UNDETERMINED = "und"
_LETTER = re.compile(r"[^\W\d_]")


def _run(table: np.ndarray, u: np.ndarray, x: np.ndarray, out: np.ndarray, back: bool, gates: np.ndarray | None = None, begin: np.ndarray | None = None) -> None:
    """States (T, B, H) of one direction over the bytes x (T, B); ``gates`` receives the activations, lanes in ``begin`` start after CONTEXT bytes."""
    steps, n = x.shape
    hidden = u.shape[0]
    h = np.zeros((n, hidden), np.float32)
    a, b = np.empty((n, 2 * hidden), np.float32), np.empty((n, 2 * hidden), np.float32)
    for t in range(steps - 1, -1, -1) if back else range(steps):
        if begin is not None and t == CONTEXT and not back:
            h[begin] = 0
        np.take(table, x[t], axis=0, out=a, mode="clip")
        np.matmul(h, u, out=b)
        a += b
        np.tanh(a, out=a)
        f = a[:, :hidden] * 0.5
        f += 0.5
        step = a[:, hidden:] - h
        step *= f
        h = np.add(h, step, out=out[t])
        if gates is not None:
            gates[t] = a


class Network:
    """Parameters, training and inference of the network."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.languages = languages
        small = lambda *s: (rng.standard_normal(s) * 0.3).astype(np.float32)
        self.p = {"table0": small(256, 2 * hidden), "table1": small(256, 2 * hidden), "u0": small(hidden, 2 * hidden), "u1": small(hidden, 2 * hidden), "v": small(2 * hidden, len(languages)), "c": np.zeros(len(languages), np.float32)}

    def _states(self, x: np.ndarray, gates: list[np.ndarray] | None = None, begin: np.ndarray | None = None) -> np.ndarray:
        hidden = self.p["u0"].shape[0]
        out = np.empty((2, *x.shape, hidden), np.float32)
        for d in (0, 1):
            _run(self.p[f"table{d}"], self.p[f"u{d}"], x, out[d], d == 1, None if gates is None else gates[d], begin)
        return out

    def _probabilities(self, states: np.ndarray) -> np.ndarray:
        """(C, T * B) from states (2, T, B, H)."""
        hidden = states.shape[-1]
        z = self.p["v"][:hidden].T @ states[0].reshape(-1, hidden).T
        z += self.p["v"][hidden:].T @ states[1].reshape(-1, hidden).T
        z += self.p["c"][:, None]
        z -= z.max(0)
        np.exp(z, out=z)
        z /= z.sum(0)
        return z

    def loss_and_gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over the non-zero positions of x (T, B), and its gradients; y (B) holds the labels."""
        steps, n = x.shape
        hidden = self.p["u0"].shape[0]
        gates = [np.empty((steps, n, 2 * hidden), np.float32) for _ in range(2)]
        states = self._states(x, gates)
        prob = self._probabilities(states).reshape(-1, steps, n)
        used = x != 0
        total = max(1, int(used.sum()))
        picked = prob[y[None, :].repeat(steps, 0), np.arange(steps)[:, None], np.arange(n)[None, :]]
        loss = float(-(np.log(np.maximum(picked, 1e-9)) * used).sum() / total)
        dz = prob.copy()
        dz[y[None, :].repeat(steps, 0), np.arange(steps)[:, None], np.arange(n)[None, :]] -= 1
        dz *= used / np.float32(total)
        dz = dz.reshape(len(self.languages), -1).T
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["c"] = dz.sum(0)
        for d in (0, 1):
            own = states[d].reshape(-1, hidden)
            g["v"][d * hidden : (d + 1) * hidden] = own.T @ dz
            from_out = (dz @ self.p["v"][d * hidden : (d + 1) * hidden].T).reshape(steps, n, hidden)
            carry = np.zeros((n, hidden), np.float32)
            da = np.empty((steps, n, 2 * hidden), np.float32)
            for t in range(steps) if d else range(steps - 1, -1, -1):
                before = t + 1 if d else t - 1
                h = states[d][before] if 0 <= before < steps else np.zeros((n, hidden), np.float32)
                dh = from_out[t] + carry
                gate, cand = gates[d][t][:, :hidden], gates[d][t][:, hidden:]
                f = 0.5 + 0.5 * gate
                da[t][:, :hidden] = dh * (cand - h) * 0.5 * (1 - gate * gate)
                da[t][:, hidden:] = dh * f * (1 - cand * cand)
                g[f"u{d}"] += h.T @ da[t]
                carry = dh * (1 - f) + da[t] @ self.p[f"u{d}"].T
            np.add.at(g[f"table{d}"], x.ravel(), da.reshape(-1, 2 * hidden))
        return loss, g

    def train(self, texts: list[bytes], labels: list[int], steps: int = STEPS, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        by_label = [[t for t, y in zip(texts, labels, strict=True) if y == k] for k in range(len(self.languages))]
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step in range(1, steps + 1):
            y = rng.integers(0, len(self.languages), TRAIN_BATCH)
            x = np.zeros((TRAIN_BATCH, TRAIN_WINDOW), np.uint8)
            for i, k in enumerate(y):
                t = by_label[k][rng.integers(len(by_label[k]))]
                at = int(rng.integers(0, max(1, len(t) - TRAIN_WINDOW + 1)))
                cut = np.frombuffer(t[at : at + TRAIN_WINDOW], np.uint8)
                x[i, : len(cut)] = cut
            _, g = self.loss_and_gradients(np.ascontiguousarray(x.T), y)
            norm = float(np.sqrt(sum((v.astype(np.float64) ** 2).sum() for v in g.values())))
            rate = RATE * min(1.0, 1.5 - step / steps)
            for k, v in g.items():
                v = v * np.float32(min(1.0, 5.0 / max(norm, 1e-9)))
                m[k] = 0.9 * m[k] + 0.1 * v
                s[k] = 0.99 * s[k] + 0.01 * v * v
                self.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)

    def read(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Mean probabilities (documents, C) and numbers of positions by label (documents, C)."""
        c = len(self.languages)
        sums, counts = np.zeros((len(texts), c)), np.zeros((len(texts), c), np.int64)
        sizes = np.array([len(t) for t in texts], np.int64)
        lanes = -(-sizes // WINDOW)
        owner = np.repeat(np.arange(len(texts)), lanes)
        first = np.concatenate(([0], np.cumsum(lanes)))
        left = sizes[owner] - (np.arange(int(first[-1])) - first[owner]) * WINDOW
        wide = WINDOW + 2 * CONTEXT
        data = np.empty((int(first[-1]), wide), np.uint8)
        for k, t in enumerate(texts):
            own = np.zeros(int(lanes[k]) * WINDOW + 2 * CONTEXT, np.uint8)
            own[CONTEXT : CONTEXT + len(t)] = np.frombuffer(t, np.uint8)
            if len(t):
                data[first[k] : first[k + 1]] = np.lib.stride_tricks.sliding_window_view(own, wide)[::WINDOW]
        for at in range(0, len(data), LANES):
            states = self._states(np.ascontiguousarray(data[at : at + LANES].T), begin=np.flatnonzero(np.isin(np.arange(at, min(at + LANES, len(data))), first)))
            prob = self._probabilities(np.ascontiguousarray(states[:, CONTEXT : CONTEXT + WINDOW]))
            label = prob == prob.max(0)
            used = (np.arange(WINDOW)[:, None] < left[at : at + LANES]).ravel()
            prob *= used
            label &= used
            who = owner[at : at + LANES]
            np.add.at(sums, who, prob.reshape(c, WINDOW, -1).sum(1).T)
            np.add.at(counts, who, label.reshape(c, WINDOW, -1).sum(1).T)
        return sums / np.maximum(sums.sum(1, keepdims=True), 1e-9), counts


def held_out(id_col: str = "doc_id"):
    """Documents kept from training: crc32 of the id as text, modulo 4, is 2."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", steps: int = STEPS, documents: int = DOCS_PER_LANGUAGE, chars: int = SAMPLE_CHARS, most: int = SAMPLE_DOCS) -> Network | None:
    """A network trained on a bounded, hash-chosen sample of labelled rows that aren't held out; None without any.

    The sample has about ``documents`` different texts of each language, of each
    ``chars`` code points from a hashed offset. Every language has its share,
    and with more than ``most`` / ``documents`` languages the shares shrink.
    Texts are chosen by a hash of the text, and equal ones count once, so the
    sample does not depend on partitioning, null and repeated ids have no part
    in it, and a text that fills a third of all rows is one row of it. A
    language with fewer texts gives all of them. Rows without a label or a text
    are left out; more than MAX_LABELS labels raise.
    """
    rows = docs.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col)).select(F.col(label_col).cast("string").alias("label"), F.col(text_col).cast("string").alias("text"))
    rows = rows.where("text <> ''").withColumn("h", F.xxhash64("text", F.lit(7)))
    totals = rows.groupBy("label").agg(F.approx_count_distinct("h", 0.02).alias("n")).limit(MAX_LABELS + 1).collect()  # a row for each language
    if not totals:
        return None
    if len(totals) > MAX_LABELS:
        raise ValueError(f"{label_col} has more than {MAX_LABELS} values")
    share = max(1, min(documents, most // len(totals)))
    bounds = docs.sparkSession.createDataFrame([(r["label"], min(1.0, share / r["n"])) for r in totals], "label string, bound double")
    chosen = rows.join(F.broadcast(bounds), "label").where((F.pmod("h", F.lit(1 << 30)) + 1).cast("double") / (1 << 30) <= F.col("bound"))
    offset = F.pmod(F.xxhash64("h"), F.greatest(F.lit(1), F.length("text") - chars)).cast("int") + 1
    pieces = chosen.groupBy("label", "h").agg(F.min(F.substring("text", offset, F.lit(chars))).alias("piece"))
    sample = sorted((r["label"], r["h"], r["piece"]) for r in pieces.collect())
    languages = sorted({label for label, _, _ in sample})
    if not languages:
        return None
    net = Network(languages)
    net.train([p.encode("utf-8", "surrogatepass") for _, _, p in sample], [languages.index(y) for y, _, _ in sample], steps)
    return net


def _predict(model, at_text: int, keep: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net: Network | None = model.value
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = [t or "" for t in batch.column(at_text).to_pylist()]
                known = [i for i, t in enumerate(texts) if net and _LETTER.search(t)]
                pred, score, positions = [UNDETERMINED] * len(texts), [0.0] * len(texts), [[] for _ in texts]
                if known:
                    prob, counts = net.read([texts[i].encode("utf-8", "surrogatepass") for i in known])
                    for i, p, n in zip(known, prob, counts, strict=True):
                        k = int(p.argmax())
                        pred[i], score[i] = net.languages[k], float(min(1.0, p[k]))
                        positions[i] = [(y, int(v)) for y, v in zip(net.languages, n, strict=True) if v]
                cols = [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(positions, pa.map_(pa.string(), pa.int64()))]
                own = [batch.column(k) for k in range(keep)]
                yield pa.RecordBatch.from_arrays([*own, *cols], names=[*batch.schema.names[:keep], "lang_pred", "score", "positions"])

    return run


def identify(docs: DataFrame, model: Network | None, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` with ``lang_pred``, ``score`` and ``positions``, one row per row of ``docs``.

    Texts are read whole. ``positions`` counts the positions (bytes) by their
    label. Null texts, texts without a letter, and all texts where there is no
    model get ``und`` with score 0. Repeated rows each give their row; an empty
    table gives none. Columns not in ``keep`` are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(*keep) if text_col in keep else docs.select(*keep, F.col(text_col).cast("string"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keep)])
    place = keep.index(text_col) if text_col in keep else len(keep)
    return rows.mapInArrow(_predict(spark.sparkContext.broadcast(model), place, len(keep)), f"{fields}, lang_pred string, score double, positions map<string, bigint>")
