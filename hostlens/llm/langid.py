"""Language identification by a bidirectional gated recurrent network over bytes.

``train`` fits the network in numpy by backpropagation through time (Adam) on
segments cut from a bounded sample of labelled rows (``sample_rows``: those of
least hash of the id).  ``predict`` runs it over every byte of every text:
segments of ``SEGMENT`` bytes are rows of a matrix, both directions go through
the recurrence together, each position gets label probabilities, and a
document's probabilities are the mean over its positions.

Defined results: null texts and texts without a letter are ``und`` with score 0,
as is everything when there are no labelled rows; equal texts get equal
predictions wherever they are; the language, source and id columns are never
inputs; ``predict`` keeps all input columns and replaces those of its outputs'
names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import binary_view, set_column, slices, with_field

SEGMENT = 128  # bytes of a segment
ROWS = 2048  # segments worked on at a time
HIDDEN = 6
UNKNOWN = "und"
PAD = 256


@dataclass
class Network:
    """Input weights per byte, recurrent weights and biases of both directions; output layer."""

    labels: list[str]
    inputs: np.ndarray  # [2, 257, 3H]: update, reset, candidate; the last row is padding
    recur: np.ndarray  # [2, H, 3H]
    bias: np.ndarray  # [2, 3H], added to inputs
    inner: np.ndarray  # [2, H], candidate's bias inside the reset gate
    out: np.ndarray  # [2, H, C]
    out_bias: np.ndarray  # [C]

    NAMES = ("inputs", "recur", "bias", "inner", "out", "out_bias")

    @classmethod
    def start(cls, labels: list[str], hidden: int, seed: int) -> Network:
        rng = np.random.default_rng(seed)
        f = np.float32
        return cls(labels, rng.normal(0, 0.3, (2, 257, 3 * hidden)).astype(f), rng.normal(0, 0.3, (2, hidden, 3 * hidden)).astype(f),
                   np.zeros((2, 3 * hidden), f), np.zeros((2, hidden), f), rng.normal(0, 0.3, (2, hidden, len(labels))).astype(f),
                   np.zeros(len(labels), f))

    def states(self, x: np.ndarray, keep: bool = False):
        """Hidden states [2, T, B, H] of byte rows x [B, T] (PAD beyond a row's end); with ``keep`` all that
        the backward pass needs.  Padding leaves a state as it is, so both directions start at the text."""
        rows, steps = x.shape
        h3 = self.recur.shape[2]
        hid = h3 // 3
        table = (self.inputs + self.bias[:, None, :]).reshape(-1, h3)
        both = np.stack([x.T, x.T[::-1] + 257])  # [2, T, B]; the second direction reads from the end
        padded = bool((x == PAD).any())
        h = np.zeros((2, rows, hid), np.float32)
        states = np.empty((2, steps, rows, hid), np.float32)
        kept = []
        for t in range(steps):
            a = table[both[:, t]]
            u = h @ self.recur
            gates = np.tanh((a[..., :2 * hid] + u[..., :2 * hid]) * np.float32(0.5))
            gates *= np.float32(0.5)
            gates += np.float32(0.5)
            z, r = gates[..., :hid], gates[..., hid:]
            un = u[..., 2 * hid:] + self.inner[:, None, :]
            n = np.tanh(a[..., 2 * hid:] + r * un)
            new = n - h
            new *= z
            if padded:
                new *= (both[:, t] % 257 != PAD)[..., None]
            new += h
            if keep:
                kept.append((h, z, r, un, n))
            h = new
            states[0, t] = h[0]
            states[1, steps - 1 - t] = h[1]
        return (states, both, kept) if keep else states

    def probabilities(self, states: np.ndarray) -> np.ndarray:
        """Label probabilities [T, B, C] of every position."""
        steps, rows, hid = states.shape[1:]
        logits = (states[0].reshape(-1, hid) @ self.out[0] + states[1].reshape(-1, hid) @ self.out[1] + self.out_bias)
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        return logits.reshape(steps, rows, -1)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over positions and its gradients, by backpropagation through time."""
        states, both, kept = self.states(x, keep=True)
        steps, rows, hid = states.shape[1:]
        real = (x != PAD).T
        p = self.probabilities(states)
        scale = np.float32(1 / max(1, real.sum()))
        loss = float(-(np.log(p[:, np.arange(rows), y] + 1e-9) * real).sum() * scale)
        d = p.copy()
        d[:, np.arange(rows), y] -= 1
        d *= real[..., None] * scale
        flat = d.reshape(-1, d.shape[2])
        g = {"out": np.stack([states[k].reshape(-1, hid).T @ flat for k in (0, 1)]), "out_bias": flat.sum(axis=0),
             "recur": np.zeros_like(self.recur), "inner": np.zeros_like(self.inner)}
        dstate = np.stack([d @ self.out[0].T, (d @ self.out[1].T)[::-1]])  # in each direction's own order
        table = np.zeros((2 * 257, 3 * hid), np.float32)
        dh = np.zeros((2, rows, hid), np.float32)
        for t in range(steps - 1, -1, -1):
            h, z, r, un, n = kept[t]
            live = (both[:, t] % 257 != PAD)[..., None]
            dh = dh + dstate[:, t]
            dnew = dh * live
            dn = dnew * z * (1 - n * n)
            dun = dn * r
            da = np.concatenate([dnew * (n - h) * z * (1 - z), dn * un * r * (1 - r), dn], axis=2)
            du = np.concatenate([da[..., :2 * hid], dun], axis=2)
            g["recur"] += h.transpose(0, 2, 1) @ du
            g["inner"] += dun.sum(axis=1)
            np.add.at(table, both[:, t].ravel(), da.reshape(-1, 3 * hid))
            dh = dh - dnew * z + du @ self.recur.transpose(0, 2, 1)
        g["inputs"] = table.reshape(2, 257, 3 * hid)
        g["bias"] = g["inputs"].sum(axis=1)
        return loss, g


def fit(texts: list[bytes], labels: list[str], hidden: int = HIDDEN, steps: int = 300, batch: int = 128, seed: int = 7) -> Network:
    """Train on segments with Adam; equal numbers of each label per batch on average."""
    names = sorted(set(labels))
    net = Network.start(names, hidden, seed)
    x = np.full((len(texts), SEGMENT), PAD, np.int64)
    for i, t in enumerate(texts):
        x[i, :len(t[:SEGMENT])] = np.frombuffer(t[:SEGMENT], np.uint8)
    y = np.array([names.index(v) for v in labels])
    weight = 1 / np.bincount(y, minlength=len(names))[y]
    rng = np.random.default_rng(seed)
    moment = {k: (np.zeros_like(getattr(net, k)), np.zeros_like(getattr(net, k))) for k in net.NAMES}
    for step in range(1, steps + 1):
        pick = rng.choice(len(y), size=batch, p=weight / weight.sum())
        _, g = net.gradients(x[pick], y[pick])
        norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
        rate = np.float32(0.03 * min(1.0, step / 20) * (1 - 0.9 * step / steps))
        for k, v in g.items():
            v = v * np.float32(min(1.0, 1.0 / (norm + 1e-9)))
            m, s = moment[k]
            m *= np.float32(0.9)
            m += np.float32(0.1) * v
            s *= np.float32(0.99)
            s += np.float32(0.01) * v * v
            getattr(net, k)[...] -= rate * (m / np.float32(1 - 0.9**step)) / (np.sqrt(s / np.float32(1 - 0.99**step)) + np.float32(1e-8))
    return net


def held_out(id_col: Column) -> Column:
    """Rows kept from training: crc32 of the id's text leaves 2 when divided by 4 (a null id: its empty text)."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))), F.lit(4)) == 2


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", sample_rows: int = 4000,
          **how) -> Network | None:
    """The network, trained on one segment of each of at most ``sample_rows`` labelled rows; None without any."""
    ids, text = F.col(id_col), F.col(text_col)
    order = F.xxhash64(ids.cast("string"), text)
    at = F.pmod(F.xxhash64(text), F.greatest(F.char_length(text) - SEGMENT, F.lit(0)) + 1).cast("int") + 1
    labelled = df.where(~held_out(ids) & F.col(label_col).isNotNull())
    pieces = labelled.where(has_letter(text)).select(
        F.substring(text, at, F.lit(SEGMENT)).alias("piece"), F.col(label_col).cast("string").alias("label"), order.alias("k"))
    # hashes are even, so about four samples lie below this bound: tasks send few rows, however many tasks there are
    n = labelled.count()
    low = pieces.where(F.col("k") < -(2**63) + 2**64 * 4 * sample_rows // n) if n > 4 * sample_rows else pieces
    rows = low.orderBy("k", "piece", "label").limit(sample_rows).collect()
    if len(rows) < sample_rows and low is not pieces:  # few texts with letters
        rows = pieces.orderBy("k", "piece", "label").limit(sample_rows).collect()
    rows = [(r["piece"].encode(), r["label"]) for r in rows]
    return fit([t for t, _ in rows], [v for _, v in rows], **how) if rows else None


def document_probabilities(net: Network, raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Mean label probabilities [documents, labels] over all bytes of each document (0 for empty ones)."""
    size = np.diff(starts)
    pieces = -(-size // SEGMENT)
    doc = np.repeat(np.arange(len(size)), pieces)
    first = np.concatenate([[0], np.cumsum(pieces)[:-1]])
    begin = starts[:-1][doc] + (np.arange(len(doc)) - first[doc]) * SEGMENT
    length = np.minimum(starts[1:][doc] - begin, SEGMENT)
    total = np.zeros((len(size), len(net.labels)))
    order = np.argsort(-length, kind="stable")  # whole segments first: only the rest need padding
    col = np.arange(SEGMENT)
    for k in range(0, len(order), ROWS):
        rows = order[k:k + ROWS]
        width = int(length[rows[0]])
        at = begin[rows][:, None] + col[:width]
        x = raw[np.minimum(at, len(raw) - 1)].astype(np.int64)
        short = length[rows][:, None] <= col[:width]
        x[short] = PAD
        p = net.probabilities(net.states(x))
        if short.any():
            p *= ~short.T[..., None]
        np.add.at(total, doc[rows], p.sum(axis=0))
    return total / np.maximum(size, 1)[:, None]


def predict(df: DataFrame, net: Network | None, text_col: str = "text", label_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """``df`` with the predicted label and its probability."""
    schema = with_field(with_field(df.schema, label_out, T.StringType()), score_out, T.DoubleType())
    if net is None:
        plain = df.withColumn(label_out, F.lit(UNKNOWN)).withColumn(score_out, F.lit(0.0))
        return plain.select(*[f"`{c}`" for c in schema.names])
    import regex

    shipped = df.sparkSession.sparkContext.broadcast(net)  # a few thousand numbers
    letter = regex.compile(r"\p{L}")

    def run(batches):
        network = shipped.value
        for batch in slices(batches, text_col, 2 << 20):
            col = batch.column(batch.schema.names.index(text_col))
            p = document_probabilities(network, *binary_view(col))
            best = p.argmax(axis=1)
            known = [t is not None and letter.search(t) is not None for t in col.to_pylist()]
            names = [network.labels[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), known)]
            score = np.where(known, p[np.arange(len(best)), best].clip(0, 1), 0.0)
            batch = set_column(batch, label_out, pa.array(names, pa.string()))
            yield set_column(batch, score_out, pa.array(score, pa.float64()))

    return df.mapInArrow(run, schema)
