"""Quality classifier: attention-based multiple-instance learning.

A text is a bag of passages of equal bytes. Every passage is encoded, a gated attention network weighs the passages, and
the weighted sum of their encodings is scored; only the document has a label, so the weights are learned from documents.
The sample that trains is bounded by parameters; every text is scored whole, passage by passage, on the executors.

Defined cases: null and empty texts are one empty passage and get a score like any other; a label counts for its doc_id
(the larger one, if they differ) and null labels or ids teach nothing; documents of a null doc_id are held out; repeated
rows are scored each; without any label every score is one half; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from gaugeline.llm.common import raw

#: Bytes of a passage; labelled documents that train at most, and passages they may have together (160 MB on the driver).
PASSAGE, SAMPLE, PASSAGES = 512, 4000, 1 << 17
CLASSES, GRAMS, FOLDED = 16, 256, 64
FEATURES, HIDDEN, GATE = CLASSES * CLASSES + FOLDED + 3, 24, 12
EPOCHS, BATCH, RATE, DECAY, SEED = 24, 64, 0.01, 1e-4, 11
#: Passages that are encoded at once.
SLICE = 256


def byte_classes() -> np.ndarray:
    """Kinds of bytes: letters by case, digits, blanks, marks by use, the rest."""
    kind = np.full(256, 15, np.int64)
    for number, members in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n\r", "\t\v\f", ".", ",;:", "!?", "'\"-()", "#*", "$%&", "|<>[]{}", "/\\_=+~^@`")):
        for c in members:
            kind[ord(c)] = number
    kind[128:] = 14
    return kind


KINDS = byte_classes()


def encode(text: bytes) -> np.ndarray:
    """One row of features for each passage: frequencies of byte class pairs and hashed 4-grams, and how varied they are."""
    if not text:
        return np.zeros((1, FEATURES), np.float32)
    rows = []
    for at in range(0, len(text), SLICE * PASSAGE):
        data = np.frombuffer(text[at : at + SLICE * PASSAGE], np.uint8)
        n = -(-len(data) // PASSAGE)
        own = np.arange(len(data)) // PASSAGE
        kinds = KINDS[data]
        size = np.bincount(own, minlength=n).astype(np.float32)[:, None]
        pairs = np.bincount(own[1:] * CLASSES**2 + kinds[:-1] * CLASSES + kinds[1:], minlength=n * CLASSES**2).reshape(n, -1)
        wide = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.uint32)
        grams = (wide[:-3] | wide[1:-2] << 8 | wide[2:-1] << 16 | wide[3:] << 24) * np.uint32(2_654_435_761) >> np.uint32(24)
        hashed = np.bincount(own * GRAMS + grams, minlength=n * GRAMS).reshape(n, -1)
        share = hashed / size
        rows.append(np.concatenate([
            np.sqrt(pairs / size), share.reshape(n, FOLDED, -1).sum(axis=2), (hashed > 0).mean(axis=1, keepdims=True),
            np.sqrt((share**2).sum(axis=1, keepdims=True)), np.log1p(size) / 6,
        ], axis=1, dtype=np.float32))
    return np.concatenate(rows)


def start() -> dict[str, np.ndarray]:
    draw = np.random.default_rng(SEED)
    shape = {"encoder": (FEATURES, HIDDEN), "tanh": (HIDDEN, GATE), "gate": (HIDDEN, GATE), "attention": (GATE,), "score": (HIDDEN,)}
    weights = {k: draw.standard_normal(s) / np.sqrt(s[0]) for k, s in shape.items()}
    return weights | {"encoder_bias": np.zeros(HIDDEN), "score_bias": np.zeros(1)}


def forward(w: dict[str, np.ndarray], x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
    """All bags at once: rows of x from first[i] on belong to bag i."""
    length = np.diff(np.append(first, len(x)))
    h = np.tanh(x @ w["encoder"] + w["encoder_bias"])
    t, g = np.tanh(h @ w["tanh"]), 1 / (1 + np.exp(-np.clip(h @ w["gate"], -30, 30)))
    e = (t * g) @ w["attention"]
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), length))
    a = e / np.repeat(np.add.reduceat(e, first), length)
    z = np.add.reduceat(a[:, None] * h, first)
    p = 1 / (1 + np.exp(-np.clip(z @ w["score"] + w["score_bias"], -30, 30)))
    return {"length": length, "h": h, "t": t, "g": g, "a": a, "z": z, "p": p}


def gradients(w: dict[str, np.ndarray], x: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean log loss."""
    o = forward(w, x, first)
    d = (o["p"] - y) / len(y)
    dz = np.repeat(np.outer(d, w["score"]), o["length"], axis=0)
    da = (dz * o["h"]).sum(axis=1)
    de = o["a"] * (da - np.repeat(np.add.reduceat(o["a"] * da, first), o["length"]))
    dt = de[:, None] * w["attention"] * o["g"] * (1 - o["t"] ** 2)
    dg = de[:, None] * w["attention"] * o["t"] * o["g"] * (1 - o["g"])
    dh = (o["a"][:, None] * dz + dt @ w["tanh"].T + dg @ w["gate"].T) * (1 - o["h"] ** 2)
    return {
        "encoder": x.T @ dh, "encoder_bias": dh.sum(axis=0), "tanh": o["h"].T @ dt, "gate": o["h"].T @ dg,
        "attention": (o["t"] * o["g"]).T @ de, "score": o["z"].T @ d, "score_bias": np.array([d.sum()]),
    }


def fit(bags: list[np.ndarray], labels: np.ndarray) -> dict[str, np.ndarray]:
    """Weights after some passes of Adam over the bags, in a fixed random order, for features of mean 0 and deviation 1."""
    passages = sum(map(len, bags))  # bag by bag, since all of them together are large
    mean = sum(b.sum(axis=0, dtype=np.float64) for b in bags) / passages
    deviation = np.sqrt(sum(((b - mean) ** 2).sum(axis=0) for b in bags) / passages) + 0.01
    w, draw = start(), np.random.default_rng(SEED)
    w["score_bias"][:] = np.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1))
    slow, fast, step = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    for epoch in range(EPOCHS):
        order = draw.permutation(len(bags))
        for at in range(0, len(order), BATCH):
            part = order[at : at + BATCH]
            x = (np.concatenate([bags[i] for i in part]) - mean) / deviation
            first = np.cumsum([0, *[len(bags[i]) for i in part[:-1]]])
            step += 1
            for k, slope in gradients(w, x, first, labels[part]).items():
                slope = slope + DECAY * w[k]
                slow[k] = 0.9 * slow[k] + 0.1 * slope
                fast[k] = 0.999 * fast[k] + 0.001 * slope**2
                rate = RATE * (1 - epoch / EPOCHS)
                w[k] = w[k] - rate * (slow[k] / (1 - 0.9**step)) / (np.sqrt(fast[k] / (1 - 0.999**step)) + 1e-8)
    return w | {"mean": mean, "deviation": deviation}


def probability(w: dict[str, np.ndarray] | None, text: bytes) -> float:
    """The score of one whole text. Bags are summed slice by slice, so a long text needs no more memory."""
    if w is None:
        return 0.5
    total, weight, top = np.zeros(HIDDEN), 0.0, -np.inf
    for at in range(0, max(1, len(text)), SLICE * PASSAGE):
        x = (encode(text[at : at + SLICE * PASSAGE]) - w["mean"]) / w["deviation"]
        h = np.tanh(x @ w["encoder"] + w["encoder_bias"])
        e = (np.tanh(h @ w["tanh"]) / (1 + np.exp(-np.clip(h @ w["gate"], -30, 30)))) @ w["attention"]
        high = max(top, float(e.max()))
        keep, e = np.exp(top - high), np.exp(e - high)
        total, weight, top = total * keep + e @ h, weight * keep + e.sum(), high
    return float(1 / (1 + np.exp(-np.clip(total / weight @ w["score"] + w["score_bias"][0], -30, 30))))


def held_out(doc_id: Column) -> Column:
    """A fifth of all ids, by checksum; null ids are held out."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE, passages: int = PASSAGES) -> dict[str, np.ndarray] | None:
    """Weights from at most ``sample`` labelled documents that aren't held out, the ones of smallest hash; None without any.

    They train with all their passages. A document that would bring these beyond ``passages`` in all is not of the sample.
    """
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).alias("label")).where("doc_id IS NOT NULL AND label IS NOT NULL")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), raw(text).alias("text"))
    present = known.join(rows.select("doc_id").distinct(), "doc_id", "left_semi")
    first = present.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # so many rows of two numbers
    size = F.greatest(F.lit(1), F.ceil(F.octet_length("text") / PASSAGE))
    sized = rows.join(F.broadcast(first), "doc_id").groupBy("doc_id").agg(F.min("label").alias("label"), F.max(size).alias("n"), F.min(F.xxhash64("doc_id")).alias("h"))
    picked, room = [], passages
    for row in sorted(sized.collect(), key=lambda r: (r["h"], r["doc_id"])):
        if row["n"] <= room:
            picked.append((row["doc_id"], row["label"]))
            room -= row["n"]
    if not picked:
        return None
    chosen = docs.sparkSession.createDataFrame(picked, "doc_id long, label int")

    def bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "label": batch["label"], "bag": [encode(content).tobytes() for content in batch["text"]]})

    joined = rows.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")
    bagged = joined.mapInPandas(bags, "doc_id long, label int, bag binary")
    found = bagged.groupBy("doc_id").agg(F.min("label").alias("label"), F.min("bag").alias("bag")).collect()  # one per id
    found.sort(key=lambda r: r["doc_id"])
    taken = [np.frombuffer(r["bag"], np.float32).reshape(-1, FEATURES) for r in found]
    return fit(taken, np.array([float(r["label"]) for r in found]))


def score(weights: dict[str, np.ndarray] | None, text: Column) -> Column:
    """The probability of label 1 for a column of texts as bytes."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([probability(weights, t) for t in texts], dtype="float64")

    return scored(text)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    weights = train(docs, labels, doc_id, text)
    rows = docs.select(F.col(doc_id).alias("doc_id"), score(weights, raw(text)).alias("score"))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents whose score reaches the threshold, with all their columns."""
    return docs.where(score(train(docs, labels, doc_id, text), raw(text)) >= threshold)
