"""Quality classifier: a convolutional network over bytes, max-pooled over overlapping chunks of the whole text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import parts, utf8


@dataclass(frozen=True)
class QualityRule:
    """``filters`` windows of ``width`` bytes, each byte an ``embed``-vector, over chunks of ``chunk`` bytes.

    Neighbouring chunks overlap by ``width - 1`` bytes, so that every window of a text lies in one chunk. Training takes
    ``texts`` texts of a label at most, with ``pieces`` chunks each, for ``steps`` batches of ``batch`` texts.
    """

    embed: int = 8
    width: int = 8
    filters: int = 32
    hidden: int = 16
    chunk: int = 256
    texts: int = 800
    pieces: int = 12
    steps: int = 300
    batch: int = 48
    rate: float = 0.005
    decay: float = 1e-4
    lanes: int = 256
    seed: int = 11


class ByteConvolution:
    """Filter responses, cut off at 0, are max-pooled over a chunk; a hidden layer reads each chunk's maxima; its greatest
    and its mean values over a text's chunks are combined into one probability."""

    NAMES = ("table", "filter", "filter_bias", "mixed", "mixed_bias", "out", "out_bias")

    def __init__(self, rule: QualityRule) -> None:
        rng = np.random.default_rng(rule.seed)
        span = rule.width * rule.embed
        self.rule = rule
        self.table = rng.normal(0, 1, (256, rule.embed)).astype(np.float32)
        self.filter = rng.normal(0, span**-0.5, (span, rule.filters)).astype(np.float32)
        self.filter_bias = np.zeros(rule.filters, np.float32)
        self.mixed = rng.normal(0, rule.filters**-0.5, (rule.filters, rule.hidden)).astype(np.float32)
        self.mixed_bias = np.full(rule.hidden, 0.1, np.float32)
        self.out = rng.normal(0, 0.1, 2 * rule.hidden).astype(np.float32)
        self.out_bias = np.zeros(1, np.float32)
        #: Added to the log odds after training, in which both labels are drawn alike.
        self.prior = 0.0

    def maxima(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greatest response of every filter in every chunk (chunks x bytes), and the place of its window."""
        n, size = data.shape
        e, w = self.rule.embed, self.rule.width
        flat = self.table[data].reshape(n, size * e)
        step = flat.strides[1]
        windows = np.lib.stride_tricks.as_strided(flat, (n, size - w + 1, w * e), (flat.strides[0], e * step, step))
        response = windows.reshape(-1, w * e) @ self.filter
        response = response.reshape(n, size - w + 1, -1)
        place = response.argmax(axis=1)
        best = np.take_along_axis(response, place[:, None], axis=1)[:, 0]
        return best + self.filter_bias, place

    def chunk_values(self, best: np.ndarray) -> np.ndarray:
        return np.maximum(np.maximum(best, 0) @ self.mixed + self.mixed_bias, 0)

    def pooled(self, values: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """(texts, 2 hidden): greatest and mean values; ``starts`` is each text's first chunk, and no text has none."""
        n = np.diff(np.append(starts, len(values)))[:, None]
        return np.concatenate([np.maximum.reduceat(values, starts), np.add.reduceat(values, starts) / n], axis=1)

    def gradients(self, data: np.ndarray, starts: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over texts, and its slope. Only the windows that won a maximum receive any."""
        e, w, k = self.rule.embed, self.rule.width, self.rule.hidden
        best, place = self.maxima(data)
        active = np.maximum(best, 0)
        values = self.chunk_values(best)
        joint = self.pooled(values, starts)
        p = 1 / (1 + np.exp(-(joint @ self.out + self.out_bias)))
        loss = -float(np.mean(np.log(np.maximum(np.where(labels == 1, p, 1 - p), 1e-7))))
        d = (p - labels) / len(labels)
        slope = {"out": joint.T @ d, "out_bias": d.sum(keepdims=True)}
        into = d[:, None] * self.out
        owner = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(data))))
        count = np.bincount(owner)[:, None]
        # the first chunk that has the greatest value of a unit receives its slope
        top = values == joint[owner, :k]
        earlier = np.cumsum(top, axis=0) - top
        first = top & (earlier == earlier[starts][owner])
        dv = (into[:, k:] / count)[owner] + np.where(first, into[owner, :k], 0)
        dv *= values > 0
        slope["mixed"], slope["mixed_bias"] = active.T @ dv, dv.sum(axis=0)
        db = (dv @ self.mixed.T) * (best > 0)
        slope["filter_bias"] = db.sum(axis=0)
        chunk, which = np.nonzero(db)
        bytes_ = data[chunk[:, None], place[chunk, which][:, None] + np.arange(w)]
        strength = db[chunk, which][:, None].astype(np.float32)
        won = self.table[bytes_].reshape(len(chunk), -1)
        hot = np.zeros((len(chunk), self.rule.filters), np.float32)
        hot[np.arange(len(chunk)), which] = strength[:, 0]
        slope["filter"] = won.T @ hot
        back = (self.filter.T[which] * strength).reshape(-1, e)
        slope["table"] = np.stack([np.bincount(bytes_.ravel(), back[:, j], 256) for j in range(e)], axis=1)
        return loss, slope

    def fit(self, texts: list[np.ndarray], labels: np.ndarray) -> ByteConvolution:
        """Adam over batches in which both labels are drawn alike; each text is its chunks."""
        rule, rng = self.rule, np.random.default_rng(self.rule.seed)
        groups = [np.flatnonzero(labels == k) for k in (0, 1)]
        first = {name: np.zeros_like(getattr(self, name)) for name in self.NAMES}
        second = {name: np.zeros_like(getattr(self, name)) for name in self.NAMES}
        for step in range(1, rule.steps + 1):
            pick = np.concatenate([g[rng.integers(0, len(g), rule.batch // 2)] for g in groups])
            sizes = np.array([len(texts[i]) for i in pick])
            _, slope = self.gradients(np.concatenate([texts[i] for i in pick]), np.cumsum(sizes) - sizes, labels[pick])
            rate = rule.rate * (1 - (step - 1) / rule.steps)
            for name in self.NAMES:
                g = slope[name] + rule.decay * getattr(self, name)
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.999 * second[name] + 0.001 * g * g
                m, v = first[name] / (1 - 0.9**step), second[name] / (1 - 0.999**step)
                setattr(self, name, (getattr(self, name) - rate * m / (np.sqrt(v) + 1e-8)).astype(np.float32))
        return self

    def score(self, column: pa.Array) -> np.ndarray:
        """Probability of label 1 for each whole text."""
        rule = self.rule
        data, offsets = utf8(column)
        size = np.diff(offsets)
        stride = rule.chunk - rule.width + 1
        n = np.maximum(1, -(-(size - rule.width + 1) // stride))
        owner = np.repeat(np.arange(len(size)), n)
        starts = np.cumsum(n) - n
        at = offsets[owner] + (np.arange(len(owner)) - starts[owner]) * stride
        padded = np.concatenate([data, np.zeros(rule.chunk, np.uint8)])
        values = np.empty((len(owner), rule.hidden), np.float32)
        for k in range(0, len(owner), rule.lanes):
            places = at[k : k + rule.lanes, None] + np.arange(rule.chunk)
            chunks = np.where(places < offsets[owner[k : k + rule.lanes] + 1][:, None], padded[places], 0)
            values[k : k + rule.lanes] = self.chunk_values(self.maxima(chunks)[0])
        if not len(size):
            return np.zeros(0)
        odds = self.pooled(values, starts).astype(float) @ self.out.astype(float) + float(self.out_bias[0]) + self.prior
        return np.round(1 / (1 + np.exp(-np.clip(odds, -60, 60))), 6)


def _chunks(pieces: list[str], rule: QualityRule) -> np.ndarray:
    out = np.zeros((len(pieces), rule.chunk), np.uint8)
    for k, piece in enumerate(pieces):
        raw = np.frombuffer(piece.encode()[: rule.chunk], np.uint8)
        out[k, : len(raw)] = raw
    return out


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    rule: QualityRule = QualityRule(),
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
) -> ByteConvolution | None:
    """A network fitted on a bounded sample of the labelled texts; None unless both labels occur in it.

    Of each label at most ``texts`` ids are drawn by hash; of an id that ``labels`` holds several times the least label
    counts, and of an id that ``docs`` holds several times one text. Null ids and labels other than 0 and 1 are left out.
    """
    own = labels.select(labels[id_col].alias("id"), labels[label_col].alias("label")).filter("id is not null and label in (0, 1)")
    own = own.groupBy("id").agg(F.min("label").cast("int").alias("label")).withColumn("draw", F.xxhash64("id", F.lit(rule.seed)))
    counts = {r.label: r["count"] for r in own.groupBy("label").count().collect()}
    if len(counts) < 2:
        return None
    drawn = [own.filter(F.col("label") == k).orderBy("draw", "id").limit(rule.texts) for k in (0, 1)]
    chosen = F.broadcast(drawn[0].union(drawn[1]))  # twice ``texts`` rows at most
    # evenly spaced pieces, next to each other where the text is short enough
    stride = F.lit(rule.chunk - rule.width + 1)
    n = F.greatest(F.lit(1), F.least(F.lit(rule.pieces), F.ceil(F.length("body") / stride))).cast("int")
    step = F.greatest(stride, F.expr(f"length(body) div {rule.pieces}"))
    pieces = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col("body"), i * step + 1, F.lit(rule.chunk)))
    d = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("body"))
    rows = d.join(chosen, "id").select("id", "label", F.xxhash64("body").alias("key"), pieces.alias("pieces"))
    found = rows.groupBy("id").agg(F.first("label").alias("label"), F.min_by("pieces", "key").alias("pieces")).collect()
    found.sort(key=lambda r: str(r.id))
    known = np.array([r.label for r in found])
    if len(set(known.tolist())) < 2:
        return None
    network = ByteConvolution(rule).fit([_chunks(r.pieces, rule) for r in found], known)
    network.prior = float(np.log(counts[1] / counts[0]))
    return network


def score_quality(
    docs: DataFrame,
    network: ByteConvolution | None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per input row: id and ``score``, the probability of label 1, to six digits.

    Only the text is read, all of it; a null text is an empty one, which the network scores as a chunk without bytes.
    Without a network every score is 0.5. Repeated rows repeat their score; an empty table gives an empty one.
    """
    d = docs.select(docs[id_col].alias("id"), docs[text_col].alias("body"))
    if network is None:
        return d.select(F.col("id").alias(id_col), F.lit(0.5).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, "body"):
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(shared.value.score(batch["body"]))], names=["id", "score"])

    kind = d.schema["id"].dataType.simpleString()
    return d.mapInArrow(read, f"id {kind}, score double").withColumnRenamed("id", id_col)
