"""Language identification: a bidirectional gated recurrent network over bytes labels every position of a text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.text import parts, utf8

UNDETERMINED = "und"


@dataclass(frozen=True)
class LanguageRule:
    """``hidden`` units a direction; training takes ``texts`` texts of a label at most, with ``windows`` windows of
    ``window`` bytes each, for ``steps`` batches. Texts are read in segments of ``segment`` bytes, each from a blank
    state, ``lanes`` of them side by side."""

    hidden: int = 8
    texts: int = 400
    windows: int = 8
    window: int = 48
    steps: int = 300
    batch: int = 256
    rate: float = 0.01
    segment: int = 128
    lanes: int = 2048
    seed: int = 7


def squash(x: np.ndarray) -> np.ndarray:
    """A rational tanh, which is exactly 1 from 3 on; it needs no transcendental function per byte and unit."""
    x = np.clip(x, -3, 3)
    square = x * x
    return x * (27 + square) / (27 + 9 * square)


def squash_slope(x: np.ndarray) -> np.ndarray:
    square = np.minimum(x * x, 9)
    return ((9 - square) / (9 + 3 * square)) ** 2


class ByteNetwork:
    """Weights and passes. Arrays have the direction first and the lanes last; the backward direction reads from the end.

    Gates: z = s(e_z + U_z h), r = s(e_r + U_r h), n = q(e_n + r (U_n h + b)), h' = (1 - z) n + z h, with e from a
    table by byte, q = ``squash`` and s(x) = (1 + q(x / 2)) / 2. Both directions' states at a position give the label scores there.
    """

    NAMES = ("table", "state", "bias", "out", "out_bias")

    def __init__(self, hidden: int, labels: list[str], seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.hidden, self.labels = hidden, labels
        self.table = rng.normal(0, 0.3, (2, 3 * hidden, 256)).astype(np.float32)
        self.state = rng.normal(0, hidden**-0.5, (2, 3 * hidden, hidden)).astype(np.float32)
        self.bias = np.zeros((2, hidden, 1), np.float32)
        self.out = rng.normal(0, 0.3, (len(labels), 2 * hidden)).astype(np.float32)
        self.out_bias = np.zeros((len(labels), 1), np.float32)

    def _inputs(self, data: np.ndarray, t: int, out: np.ndarray) -> np.ndarray:
        np.take(self.table[0], data[t], axis=1, out=out[0], mode="clip")
        np.take(self.table[1], data[-1 - t], axis=1, out=out[1], mode="clip")
        return out

    def gradients(self, data: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over all positions of windows (positions x lanes), and its slope, back through time."""
        steps, lanes = data.shape
        k = self.hidden
        h = np.zeros((2, k, lanes), np.float32)
        kept = []
        for t in range(steps):
            x = self._inputs(data, t, np.empty((2, 3 * k, lanes), np.float32))
            u = self.state @ h
            a = 0.5 * (x[:, : 2 * k] + u[:, : 2 * k])
            gates = 0.5 * squash(a) + 0.5
            z, r = gates[:, :k], gates[:, k:]
            c = u[:, 2 * k :] + self.bias
            m = x[:, 2 * k :] + r * c
            n = squash(m)
            kept.append((h, z, r, c, n, 0.25 * squash_slope(a), squash_slope(m)))
            h = n + z * (h - n)
        states = np.stack([after[0] for after in kept[1:]] + [h])  # steps, direction, unit, lane
        both = np.concatenate([states[:, 0], states[::-1, 1]], axis=1)
        scores = np.einsum("lk,tkb->tlb", self.out, both) + self.out_bias
        scores -= scores.max(axis=1, keepdims=True)
        p = np.exp(scores)
        p /= p.sum(axis=1, keepdims=True)
        lane = np.arange(lanes)
        loss = -float(np.log(np.maximum(p[:, labels, lane], 1e-9)).mean())
        p[:, labels, lane] -= 1
        p /= steps * lanes
        slope = {name: np.zeros_like(getattr(self, name)) for name in self.NAMES}
        slope["out"] = np.einsum("tlb,tkb->lk", p, both)
        slope["out_bias"] = p.sum(axis=(0, 2))[:, None]
        into = np.einsum("lk,tlb->tkb", self.out, p)
        carried = np.zeros_like(h)
        by_byte = np.empty((2, 3 * k, steps, lanes), np.float32)
        for t in range(steps - 1, -1, -1):
            h, z, r, c, n, gate_slope, n_slope = kept[t]
            d = carried + np.stack([into[t, :k], into[steps - 1 - t, k:]])
            dn = d * (1 - z) * n_slope
            dz = d * (h - n) * gate_slope[:, :k]
            dr = dn * c * gate_slope[:, k:]
            dc = dn * r
            du = np.concatenate([dz, dr, dc], axis=1)
            by_byte[:, :, t] = np.concatenate([dz, dr, dn], axis=1)
            slope["state"] += du @ h.transpose(0, 2, 1)
            slope["bias"] += dc.sum(axis=2, keepdims=True)
            carried = d * z + self.state.transpose(0, 2, 1) @ du
        for way, read in enumerate((data, data[::-1])):
            seen, back = np.unique(read, return_inverse=True)
            hot = np.zeros((read.size, len(seen)), np.float32)
            hot[np.arange(read.size), back.ravel()] = 1
            slope["table"][way][:, seen] = by_byte[way].reshape(3 * k, -1) @ hot
        return loss, slope

    def fit(self, windows: np.ndarray, labels: np.ndarray, rule: LanguageRule) -> ByteNetwork:
        """Adam over batches in which every label is drawn alike."""
        rng = np.random.default_rng(rule.seed)
        groups = [np.flatnonzero(labels == k) for k in range(len(self.labels))]
        first = {name: np.zeros_like(getattr(self, name)) for name in self.NAMES}
        second = {name: np.zeros_like(getattr(self, name)) for name in self.NAMES}
        for step in range(1, rule.steps + 1):
            drawn = rng.integers(0, len(groups), rule.batch)
            pick = np.array([groups[k][rng.integers(0, len(groups[k]))] for k in drawn])
            _, slope = self.gradients(np.ascontiguousarray(windows[pick].T), labels[pick])
            rate = rule.rate * (1 - (step - 1) / rule.steps)
            for name in self.NAMES:
                g = slope[name]
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.999 * second[name] + 0.001 * g * g
                m, v = first[name] / (1 - 0.9**step), second[name] / (1 - 0.999**step)
                setattr(self, name, (getattr(self, name) - rate * m / (np.sqrt(v) + 1e-8)).astype(np.float32))
        return self

    def label_positions(self, data: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Sum over a segment's positions of the label probabilities: (labels, lanes). ``mask`` is 0 behind its end."""
        steps, lanes = data.shape
        k = self.hidden
        h = np.zeros((2, k, lanes), np.float32)
        x, u = np.empty((2, 3 * k, lanes), np.float32), np.empty((2, 3 * k, lanes), np.float32)
        states = np.empty((steps, 2 * k, lanes), np.float32)
        spare = np.empty((2, 2 * k, lanes), np.float32)
        full = mask.all(axis=1)

        def squashed(v: np.ndarray, square: np.ndarray, scale: float) -> None:
            """v becomes scale * squash(v)."""
            np.clip(v, -3, 3, out=v)
            np.multiply(v, v, out=square)
            square += 27
            v *= square
            square *= 9 / scale
            square += (27 - 27 * 9) / scale
            v /= square

        for t in range(steps):
            self._inputs(data, t, x)
            np.matmul(self.state, h, out=u)
            gates = x[:, : 2 * k]
            gates += u[:, : 2 * k]
            gates *= 0.5
            squashed(gates, spare, 0.5)
            gates += 0.5
            n = u[:, 2 * k :]
            n += self.bias
            n *= gates[:, k:]
            n += x[:, 2 * k :]
            squashed(n, spare[:, :k], 1)
            h -= n
            h *= gates[:, :k]
            h += n
            if not full[-1 - t]:
                h[1] *= mask[-1 - t]
            states[t, :k], states[steps - 1 - t, k:] = h[0], h[1]
        total = np.zeros((len(self.labels), lanes), np.float32)
        for t in range(steps):
            p = self.out @ states[t]
            p += self.out_bias
            p -= p.max(axis=0)
            np.exp(p, out=p)
            p *= mask[t] / p.sum(axis=0)
            total += p
        return total

    def pooled(self, column: pa.Array, rule: LanguageRule) -> np.ndarray:
        """Mean probability of every label over all bytes of each text: (texts, labels)."""
        data, offsets = utf8(column)
        size = np.diff(offsets)
        n = -(-size // rule.segment)
        owner = np.repeat(np.arange(len(size)), n)
        rank = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        start = offsets[owner] + rank * rule.segment
        length = np.minimum(rule.segment, offsets[owner + 1] - start)
        order = np.argsort(-length, kind="stable")
        out = np.zeros((len(size), len(self.labels)))
        padded = np.concatenate([data, np.zeros(rule.segment, np.uint8)])
        for at in range(0, len(order), rule.lanes):
            own = order[at : at + rule.lanes]
            steps = np.arange(int(length[own[0]]))[:, None]
            mask = (steps < length[own]).astype(np.float32)
            total = self.label_positions(padded[start[own] + steps], mask)
            np.add.at(out, owner[own], total.T.astype(float))
        return out / np.maximum(size, 1)[:, None]


def _sample(docs: DataFrame, rule: LanguageRule, id_col: str, text_col: str, label_col: str) -> list:
    """Windows (label, order, piece) of a bounded number of texts per label, chosen by the hash of their id."""
    rows = docs.select(docs[label_col].alias("label"), docs[text_col].alias("body"), docs[id_col].cast("string").alias("id"))
    rows = rows.filter(F.col("label").isNotNull() & (F.coalesce(F.length("body"), F.lit(0)) > 0))
    counts = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    if not counts:
        return []
    draw = F.pmod(F.xxhash64("id", F.lit(rule.seed)), F.lit(1 << 30))
    limit = F.lit(0)
    for label, n in sorted(counts.items()):
        limit = F.when(F.col("label") == label, int((1 << 30) * min(1.0, 1.5 * rule.texts / n))).otherwise(limit)
    drawn = rows.withColumn("draw", draw).filter(F.col("draw") < limit)
    ranked = drawn.withColumn("k", F.row_number().over(Window.partitionBy("label").orderBy("draw", "id", "body")))
    step = F.greatest(F.lit(1), F.expr(f"length(body) div {rule.windows}"))
    pieces = ranked.filter(F.col("k") <= rule.texts).select(
        "label",
        "k",
        F.posexplode(
            F.transform(
                F.sequence(F.lit(0), F.least(F.lit(rule.windows), F.length("body")) - 1),
                lambda i: F.substring(F.col("body"), i * step + 1, F.lit(rule.window)),
            )
        ).alias("w", "piece"),
    )
    return sorted((r.label, r.k, r.w, r.piece) for r in pieces.collect())


def fit_languages(
    docs: DataFrame,
    rule: LanguageRule = LanguageRule(),
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "lang",
) -> ByteNetwork | None:
    """A network fitted on a bounded sample of the labelled texts; None without any.

    The sample is at most ``texts`` texts of a label with ``windows`` windows each, so its size does not follow the
    input's; null labels, null and empty texts are left out.
    """
    rows = _sample(docs, rule, id_col, text_col, label_col)
    if not rows:
        return None
    labels = sorted({r[0] for r in rows})
    number = {x: k for k, x in enumerate(labels)}
    windows, targets = [], []
    for label, _, _, piece in rows:
        raw = piece.encode()
        # short pieces are repeated, so that every window is full
        windows.append(np.frombuffer((raw * (rule.window // len(raw) + 1))[: rule.window], np.uint8))
        targets.append(number[label])
    return ByteNetwork(rule.hidden, labels, rule.seed).fit(np.stack(windows), np.array(targets), rule)


def predict_languages(
    docs: DataFrame,
    network: ByteNetwork | None,
    rule: LanguageRule = LanguageRule(),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per input row: id, ``lang_pred`` and ``score``, the pooled probability of that label.

    Only the text is looked at, all of it. A null text or one without a letter is ``und`` with score 0, as is every text
    without a network. Of equal probabilities the first label in order wins. Repeated rows repeat their result.
    """
    d = docs.select(
        docs[id_col].alias("id"),
        F.when(docs[text_col].rlike(r"\p{L}"), docs[text_col]).alias("body"),
    )
    kind = d.schema["id"].dataType.simpleString()
    if network is None:
        return d.select(F.col("id").alias(id_col), F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = shared.value.labels
        for batch in parts(batches, "body"):
            p = shared.value.pooled(batch["body"], rule)
            known = batch["body"].is_valid().to_pylist()
            best = p.argmax(axis=1)
            score = np.clip(p[np.arange(len(best)), best], 0, 1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch["id"],
                    pa.array([labels[k] if ok else UNDETERMINED for k, ok in zip(best, known)], pa.string()),
                    pa.array([float(s) if ok else 0.0 for s, ok in zip(score, known)]),
                ],
                names=["id", "lang_pred", "score"],
            )

    return d.mapInArrow(read, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)
