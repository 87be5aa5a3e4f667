"""Quality classifier: a byte-level convolutional network in numpy.

A document's UTF-8 bytes are cut into blocks of 128; two neighbouring blocks
form a chunk, so chunks overlap by half and cover the whole document. Bytes are
embedded, learned filters of width 8 run over them at stride 4, their rectified
responses are averaged over a chunk, a dense layer of learned chunk filters
follows, each of these is max-pooled over the document's chunks, and a logistic
unit combines the maxima into one probability.

The network is trained on the driver with Adam, on a sample of labelled rows
bounded by SAMPLE_PER_CLASS rows a class; a text of more than STRETCHES times
STRETCH characters is trained on by so many stretches, evenly spaced from its
start to its end. Rows whose crc32(doc_id as text) mod 4 is 2 are never used. It
reads the text alone. A document is scored in pieces of PIECE blocks, of whose
chunks the running maxima are kept, so memory does not grow with its length.

Defined cases: a null text is an empty one and gets the score of a document
without chunks of text; a null doc_id is not held out and can have no label; a
label that is null is no label, of several labels of a doc_id the highest
counts; with no usable label every score is 0.5; repeated rows score alike; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from folioscope.llm.common import byte_rows, slices

SAMPLE_PER_CLASS = 600
STRETCHES, STRETCH = 8, 2048
THRESHOLD = 0.7
BLOCK, STRIDE, EMBED, FILTERS, CHUNK_FILTERS = 128, 4, 8, 32, 16
EPOCHS, BATCH_DOCS, RATE = 14, 32, 4e-3
SLICE = 1 << 20
#: Blocks of a long document that are scored at once.
PIECE = 1 << 13

Params = dict[str, np.ndarray]


def init_params(seed: int = 7) -> Params:
    rng = np.random.default_rng(seed)
    width = STRIDE * EMBED
    shapes = {"embed": (256, EMBED), "left": (width, FILTERS), "right": (width, FILTERS), "bias": (FILTERS,), "chunk": (FILTERS, CHUNK_FILTERS), "chunk_bias": (CHUNK_FILTERS,), "out": (CHUNK_FILTERS,), "out_bias": (1,)}
    scale = {"embed": 0.5, "left": 0.25, "right": 0.25, "chunk": 0.4, "out": 0.4}
    return {k: (rng.standard_normal(s) * scale.get(k, 0.0)).astype(np.float32) for k, s in shapes.items()}


def blocks_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(blocks, first block of each row and the end, windows that start inside the text of each block)."""
    sizes = np.diff(offsets)
    counts = np.maximum(1, -(-sizes // BLOCK))
    first = np.concatenate([[0], np.cumsum(counts)])
    padded = np.zeros(int(first[-1]) * BLOCK, np.uint8)
    for i in np.flatnonzero(sizes):
        at = first[i] * BLOCK
        padded[at : at + sizes[i]] = data[offsets[i] : offsets[i + 1]]
    inside = np.full(int(first[-1]), BLOCK, np.int64)
    inside[first[1:] - 1] = sizes - (counts - 1) * BLOCK
    live = np.minimum(BLOCK // STRIDE - 1, -(-inside // STRIDE))
    return padded.reshape(-1, BLOCK), first, live


def units_of(p: Params, blocks: np.ndarray, first: np.ndarray, live: np.ndarray):
    """(quads, responses, followers, chunks, chunk filters) of the blocks of rows."""
    n = len(blocks)
    quads = p["embed"][blocks].reshape(n, BLOCK // STRIDE, STRIDE * EMBED)
    response = quads[:, :-1] @ p["left"] + quads[:, 1:] @ p["right"] + p["bias"]
    response *= np.arange(BLOCK // STRIDE - 1)[None, :, None] < live[:, None, None]
    np.maximum(response, 0, out=response)
    mean = response.sum(1) / np.maximum(live, 1)[:, None].astype(np.float32)
    follower = np.minimum(np.arange(n) + 1, np.repeat(first[1:] - 1, np.diff(first)))
    chunk = 0.5 * (mean + mean[follower])
    return quads, response, follower, chunk, np.tanh(chunk @ p["chunk"] + p["chunk_bias"])


def forward(p: Params, blocks: np.ndarray, first: np.ndarray, live: np.ndarray, keep: bool = False):
    """Logits of the rows; with ``keep`` also what the backward pass needs."""
    quads, response, follower, chunk, unit = units_of(p, blocks, first, live)
    pooled = np.maximum.reduceat(unit, first[:-1], axis=0)
    logit = pooled @ p["out"] + p["out_bias"][0]
    return (logit, (quads, response, follower, chunk, unit, pooled)) if keep else logit


def _gradients(p: Params, blocks, first, live, wanted: np.ndarray, weight: np.ndarray) -> Params:
    logit, (quads, response, follower, chunk, unit, pooled) = forward(p, blocks, first, live, keep=True)
    error = ((1 / (1 + np.exp(-logit)) - wanted) * weight / weight.sum()).astype(np.float32)
    grad = {"out": pooled.T @ error, "out_bias": np.array([error.sum()], np.float32)}
    n, row = len(blocks), np.repeat(np.arange(len(first) - 1), np.diff(first))
    best = unit == pooled[row]
    share = best / np.maximum(np.add.reduceat(best, first[:-1], axis=0, dtype=np.float32), 1)[row]
    d_unit = (share * (error[:, None] * p["out"])[row] * (1 - unit**2)).astype(np.float32)
    grad["chunk"], grad["chunk_bias"] = chunk.T @ d_unit, d_unit.sum(0)
    d_chunk = 0.5 * (d_unit @ p["chunk"].T)
    d_mean = d_chunk.copy()
    np.add.at(d_mean, follower, d_chunk)
    d_response = (response > 0) * (d_mean / np.maximum(live, 1)[:, None].astype(np.float32))[:, None, :]
    flat = d_response.reshape(-1, FILTERS)
    width = STRIDE * EMBED
    grad["left"] = quads[:, :-1].reshape(-1, width).T @ flat
    grad["right"] = quads[:, 1:].reshape(-1, width).T @ flat
    grad["bias"] = flat.sum(0)
    d_quads = np.zeros_like(quads)
    d_quads[:, :-1] += d_response @ p["left"].T
    d_quads[:, 1:] += d_response @ p["right"].T
    d_bytes = d_quads.reshape(n * BLOCK, EMBED)
    codes = blocks.reshape(-1)
    grad["embed"] = np.stack([np.bincount(codes, d_bytes[:, e], 256) for e in range(EMBED)], 1).astype(np.float32)
    return grad


def train(texts: list[bytes], labels: list[int], epochs: int = EPOCHS, seed: int = 7) -> Params | None:
    """Fit the network; both classes weigh the same. None without examples."""
    if not texts:
        return None
    p, rng = init_params(seed), np.random.default_rng(seed)
    moment = {k: np.zeros_like(v) for k, v in p.items()}
    second = {k: np.zeros_like(v) for k, v in p.items()}
    y = np.array(labels, np.float32)
    weight = np.where(y == 1, 1 / max(1, (y == 1).sum()), 1 / max(1, (y == 0).sum())).astype(np.float32)
    steps = 0
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        rate = RATE * (1 - 0.8 * epoch / epochs)
        for at in range(0, len(order), BATCH_DOCS):
            pick = order[at : at + BATCH_DOCS]
            offsets = np.concatenate([[0], np.cumsum([len(texts[i]) for i in pick])])
            data = np.frombuffer(b"".join(texts[i] for i in pick), np.uint8)
            grad = _gradients(p, *blocks_of(data, offsets), y[pick], weight[pick])
            steps += 1
            for k, g in grad.items():
                moment[k] += 0.1 * (g - moment[k])
                second[k] += 0.01 * (g * g - second[k])
                p[k] -= rate * (moment[k] / (1 - 0.9**steps)) / (np.sqrt(second[k] / (1 - 0.99**steps)) + 1e-7)
    return p


def long_logit(p: Params, data: np.ndarray) -> float:
    """Logit of one document, piece by piece."""
    best = np.full(CHUNK_FILTERS, -np.inf)
    count = max(1, -(-len(data) // BLOCK))
    for low in range(0, count, PIECE):
        high = min(count, low + PIECE)
        part = data[low * BLOCK : (high + 1) * BLOCK]  # with the block that the last chunk overlaps
        unit = units_of(p, *blocks_of(part, np.array([0, len(part)])))[-1]
        best = np.maximum(best, unit[: high - low].max(0))
    return float(best @ p["out"] + p["out_bias"][0])


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame) -> tuple[list[bytes], list[int]]:
    """At most SAMPLE_PER_CLASS texts a class, chosen by a hash of doc_id among the rows that are not held out."""
    known = (
        labels.select(F.col("doc_id").cast("long").alias("l_id"), F.col("quality").cast("int").alias("quality"))
        .filter("l_id IS NOT NULL AND quality IN (0, 1)")
        .filter(~held_out(F.col("l_id")))
        .groupBy("l_id")
        .agg(F.max("quality").alias("quality"))
    )
    picked = None
    for label in (0, 1):
        part = known.filter(F.col("quality") == label).orderBy(F.xxhash64("l_id"), "l_id").limit(SAMPLE_PER_CLASS)
        picked = part if picked is None else picked.unionByName(part)
    ids = [(r["l_id"], r["quality"]) for r in picked.collect()]
    if not ids:
        return [], []
    small = docs.sparkSession.createDataFrame(ids, "l_id long, quality int")
    step = (F.char_length("text") - STRETCH) / (STRETCHES - 1)
    spaced = F.concat(*(F.substr(F.col("text"), (step * i).cast("int") + 1, F.lit(STRETCH)) for i in range(STRETCHES)))
    rows = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .join(F.broadcast(small), F.col("doc_id") == F.col("l_id"))  # 2 * SAMPLE_PER_CLASS rows at most
        .filter("text IS NOT NULL")
        .withColumn("text", F.when(F.char_length("text") > STRETCHES * STRETCH, spaced).otherwise(F.col("text")))
        .groupBy("l_id")
        .agg(F.min("text").alias("text"), F.max("quality").alias("quality"))
        .collect()
    )
    rows.sort(key=lambda r: r["l_id"])
    return [r["text"].encode() for r in rows], [r["quality"] for r in rows]


def score_rows(p: Params | None, column: pa.Array) -> np.ndarray:
    """Scores of a text column."""
    data, offsets = byte_rows(column)
    if p is None or len(offsets) == 1:
        return np.full(len(offsets) - 1, 0.5)
    if len(offsets) == 2 and offsets[-1] > PIECE * BLOCK:
        return 1 / (1 + np.exp(-np.array([long_logit(p, data)], np.float64)))
    return 1 / (1 + np.exp(-forward(p, *blocks_of(data, offsets)).astype(np.float64)))


def score(docs: DataFrame, params: Params | None, name: str = "quality_score") -> DataFrame:
    """docs with the score in a last column ``name``; a column that has the name already gives way."""
    docs = docs.drop(name)
    schema = StructType([*docs.schema.fields, StructField(name, DoubleType())])

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                scores = pa.array(score_rows(params, part.column("text")), pa.float64())
                yield pa.RecordBatch.from_arrays([*part.columns, scores], schema=part.schema.append(pa.field(name, pa.float64())))

    return docs.mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame) -> Params | None:
    return train(*training_sample(docs, labels))


def op2_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document; 1 is good."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    params = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, params).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"),
    )
