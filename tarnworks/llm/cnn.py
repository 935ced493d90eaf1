"""Quality by a byte-level convolutional network in numpy.

Filters of five bytes slide over the whole text in UTF-8. In every chunk of 512 bytes, which overlaps the next by
half, each filter keeps its largest response; means and maxima over all chunks, however many, feed a small layer
that gives one probability. So a text of any length counts in full, in memory that one block of chunks bounds.

The network is fitted on at most ``most`` labelled texts of at most ``most_bytes`` bytes, those of smallest
identifier hash, by the driver; scoring needs no label and broadcasts only the weights (about 0.2 MB). Null and
empty texts are one chunk of padding and get a score too. Repeated rows are scored each. Without labels of both
kinds the score is the share of good ones (0.5 without any).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnworks.llm.common import filtered, over_batches

WIDTH, FILTERS, HIDDEN, HALF = 5, 24, 16, 256
MOST_TEXTS, MOST_BYTES, EPOCHS, BATCH, SEED = 3000, 1 << 16, 7, 32, 7
#: Half chunks that are convolved at a time.
HALVES = 1 << 10
THRESHOLD = 0.7
SCORE = "score"


def padded(text: str | None) -> np.ndarray:
    """Bytes of a text, at least one zero after them, up to full halves of chunks, and what the last window reads."""
    raw = (text or "").encode()
    out = np.zeros((len(raw) // HALF + 1) * HALF + WIDTH - 1, dtype=np.uint8)
    out[: len(raw)] = np.frombuffer(raw, dtype=np.uint8)
    return out


def fresh(seed: int = SEED) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    return {
        "table": draw(WIDTH, 256, FILTERS, scale=0.3),
        "bias": np.zeros(FILTERS, np.float32),
        "inner": draw(2 * FILTERS, HIDDEN, scale=0.2),
        "inner_bias": np.zeros(HIDDEN, np.float32),
        "outer": draw(HIDDEN, scale=0.3),
        "outer_bias": np.zeros(1, np.float32),
    }


def pooled(data: np.ndarray, net: dict, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Largest response of each filter in each half chunk, and where it lies."""
    halves = (len(data) - WIDTH + 1) // HALF
    best, where = [], []
    for start in range(0, halves, HALVES):
        n = min(HALVES, halves - start) * HALF
        part = data[start * HALF : start * HALF + n + WIDTH - 1]
        out = net["table"][0][part[:n]]
        for k in range(1, WIDTH):
            out += net["table"][k][part[k : k + n]]
        out = out.reshape(-1, HALF, FILTERS)
        if places:
            at = out.argmax(1)
            where.append(at + (np.arange(len(at)) + start)[:, None] * HALF)
            best.append(np.take_along_axis(out, at[:, None], 1)[:, 0])
        else:
            best.append(out.max(1))
    return np.concatenate(best) + net["bias"], np.concatenate(where) if places else None


def chunked(halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Responses of chunks from those of their halves, and which half each comes from."""
    if len(halves) == 1:
        return halves, np.zeros(halves.shape, dtype=np.int64)
    second = halves[1:] > halves[:-1]
    return np.where(second, halves[1:], halves[:-1]), np.arange(len(halves) - 1)[:, None] + second


def forward(data: np.ndarray, net: dict, places: bool = False) -> tuple:
    halves, where = pooled(data, net, places)
    chunks, source = chunked(np.maximum(halves, 0))
    top = chunks.argmax(0)
    features = np.concatenate([chunks.mean(0), chunks[top, np.arange(FILTERS)]])
    hidden = np.tanh(features @ net["inner"] + net["inner_bias"])
    return float(hidden @ net["outer"] + net["outer_bias"][0]), features, hidden, halves, where, source, top


def probability(text: str | None, net: dict) -> float:
    return float(1 / (1 + np.exp(-np.clip(forward(padded(text), net)[0], -30, 30))))


def gradients(data: np.ndarray, label: float, net: dict, into: dict) -> float:
    logit, features, hidden, halves, where, source, top = forward(data, net, True)
    p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    error = np.float32(p - label)
    into["outer"] += error * hidden
    into["outer_bias"] += error
    d_hidden = error * net["outer"] * (1 - hidden**2)
    into["inner"] += np.outer(features, d_hidden)
    into["inner_bias"] += d_hidden
    d_mean, d_top = np.split(net["inner"] @ d_hidden, 2)
    d_halves = np.zeros_like(halves)
    every = np.arange(FILTERS)
    np.add.at(d_halves, (source, every[None, :]), d_mean[None, :] / len(source))
    np.add.at(d_halves, (source[top, every], every), d_top)
    d_halves *= halves > 0
    into["bias"] += d_halves.sum(0)
    for k in range(WIDTH):
        np.add.at(into["table"][k], (data[where + k], np.broadcast_to(every, where.shape)), d_halves)
    return -np.log(max(1e-9, p if label else 1 - p))


def fit(texts: list[str | None], labels: list[float], epochs: int = EPOCHS, seed: int = SEED) -> dict[str, np.ndarray] | float:
    """The network's weights by Adam on the logistic loss; a constant if the labels are of one kind."""
    if len(set(labels)) < 2:
        return float(np.mean(labels)) if labels else 0.5
    net, rng = fresh(seed), np.random.default_rng(seed)
    data = [padded(t) for t in texts]
    slope, square, step = {k: np.zeros_like(v) for k, v in net.items()}, {k: np.zeros_like(v) for k, v in net.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(data))
        for start in range(0, len(order), BATCH):
            batch, got = order[start : start + BATCH], {k: np.zeros_like(v) for k, v in net.items()}
            for i in batch:
                gradients(data[i], labels[i], net, got)
            step += 1
            rate = 0.01 * (1 - epoch / epochs) + 0.0005
            for k, g in got.items():
                g /= len(batch)
                slope[k] = 0.9 * slope[k] + 0.1 * g
                square[k] = 0.999 * square[k] + 0.001 * g * g
                net[k] -= rate * (slope[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-7)
    return net


def remainder(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(4))


def labelled(docs: DataFrame, labels: DataFrame, most: int = MOST_TEXTS, most_bytes: int = MOST_BYTES) -> tuple[list, list]:
    """Texts and labels to learn from: rows that aren't held out, at most ``most`` of smallest hash."""
    known = labels.select("doc_id", F.col("quality").cast("double").alias("label")).where("label is not null").where(remainder(F.col("doc_id")) != 2)
    chosen = known.select("*", F.xxhash64("doc_id").alias("hash")).orderBy("hash", "doc_id", "label").limit(most)
    texts = docs.select("doc_id", "text").where(F.octet_length(F.coalesce("text", F.lit(""))) <= most_bytes)
    # at most ``most`` small rows are broadcast; a repeated identifier gives its first text
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label", "hash").agg(F.min("text").alias("text")).orderBy("hash", "doc_id", "label").collect()
    return [r.text for r in rows], [r.label for r in rows]


def score(docs: DataFrame, net: dict | float, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``columns`` and the score of every row of ``docs``."""
    kept = docs.select(*dict.fromkeys((*columns, "text")))
    types = ", ".join(f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in columns)

    def run(batches):
        for batch in batches:
            yield batch | {SCORE: [net if isinstance(net, float) else probability(t, net) for t in batch["text"]]}

    return over_batches(kept, run, f"{types}, {SCORE} double")


def quality_classifier(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted, for every row of ``docs``."""
    net = fit(*labelled(docs, labels))
    rows = score(docs, net)
    return rows.select("doc_id", F.coalesce(remainder(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs`` with a score of at least ``THRESHOLD``, with all their columns."""
    net = fit(*labelled(docs, labels))

    return filtered(docs, lambda texts: [(net if isinstance(net, float) else probability(t, net)) >= THRESHOLD for t in texts], "text")
