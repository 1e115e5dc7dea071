"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded, learned filters slide over them two bytes at a time, and
each filter's response is max-pooled over overlapping chunks that cover the
whole document. A small hidden layer turns the pooled responses of a chunk into
a chunk score; the highest, the lowest and the mean chunk score, and the length,
are combined into one probability.

Filters run once over each byte: responses are first pooled over short cells,
and a chunk is a run of cells.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, buffers
from .labels import training_sample

EMBED, WIDTH, STRIDE, FILTERS, HIDDEN = 8, 8, 2, 32, 16
#: Windows in a cell, cells in a chunk, cells from one chunk to the next: chunks of 256 bytes, 192 apart.
CELL, CHUNK, HOP = 32, 4, 3
#: Documents a class in the training sample, of any length.
PER_CLASS = 1200
#: Chunks whose windows the backward pass looks at together.
BACK_CHUNKS = 2048
#: Passes over the sample, or as many as make up the least number of steps.
EPOCHS, BATCH, LEAST_STEPS = 12, 32, 600


def new_model(seed: int = 7) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    normal = lambda *shape, scale: (r.standard_normal(shape) * scale).astype(np.float32)
    return {
        "embed": normal(256, EMBED, scale=0.5),
        "conv": normal(WIDTH * EMBED, FILTERS, scale=(WIDTH * EMBED) ** -0.5),
        "hidden": normal(FILTERS, HIDDEN, scale=FILTERS**-0.5),
        "hidden_bias": np.zeros(HIDDEN, np.float32),
        "chunk": normal(HIDDEN, 1, scale=HIDDEN**-0.5)[:, 0],
        "combine": np.array([0.5, 0.5, 0.5, 0.0], np.float32),
        "bias": np.zeros(1, np.float32),
    }


def layout(off: np.ndarray):
    """Where each document lies once padded: padded offsets, first cell of each document (and the total), first cell and document of each chunk.

    A document is padded with zero bytes to whole cells and WIDTH - STRIDE more;
    one without bytes is a cell of zeros. Chunks start every HOP cells; the last
    one of a document ends with it, whatever its length.
    """
    n = np.diff(off)
    cells = np.maximum(1, -(-n // (CELL * STRIDE)))
    cell_off = np.concatenate([[0], np.cumsum(cells)])
    chunks = np.where(cells <= CHUNK, 1, 1 + -(-(cells - CHUNK) // HOP))
    doc = np.repeat(np.arange(len(n)), chunks)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    # the last chunk is moved back so that it is whole
    start = np.minimum(k * HOP, np.maximum(cells[doc] - CHUNK, 0))
    return cells, cell_off, cell_off[doc] + start, doc, np.minimum(CHUNK, cells)[doc]


def padded(data: np.ndarray, off: np.ndarray, cells: np.ndarray, cell_off: np.ndarray) -> np.ndarray:
    """Bytes of all documents at their cells, zeros after each, and WIDTH zeros at the end.

    Windows at the end of a document reach into the next one's first bytes by
    WIDTH - STRIDE at most; those bytes are masked by the caller's zero windows.
    """
    out = np.zeros(int(cell_off[-1]) * CELL * STRIDE + WIDTH, np.uint8)
    n = np.diff(off)
    out[np.arange(len(data)) + np.repeat(cell_off[:-1] * CELL * STRIDE - off[:-1], n)] = data
    return out


def responses(model: dict, raw: np.ndarray, n_windows: int) -> np.ndarray:
    """Filter responses of windows at every STRIDE bytes (n_windows x FILTERS)."""
    e = model["embed"][raw].reshape(-1)
    view = np.lib.stride_tricks.as_strided(e, (n_windows, WIDTH * EMBED), (STRIDE * EMBED * 4, 4))
    return np.ascontiguousarray(view) @ model["conv"]


def pooled(model: dict, data: np.ndarray, off: np.ndarray, where: bool = False):
    """Chunk maxima of all filters (chunks x FILTERS), documents of the chunks; where: also the window of each maximum."""
    cells, cell_off, first, doc, length = layout(off)
    total = int(cell_off[-1])
    raw = padded(data, off, cells, cell_off)
    # the last windows of a document see nothing of the next one: only whole windows inside its own cells count
    inside = WIDTH // STRIDE - 1
    cell_max = np.empty((total, FILTERS), np.float32)
    cell_arg = np.empty((total, FILTERS), np.int64) if where else None
    last = np.zeros(total, bool)
    last[cell_off[1:] - 1] = True
    for a in range(0, total, 1024):
        b = min(total, a + 1024)
        r = responses(model, raw[a * CELL * STRIDE : b * CELL * STRIDE + WIDTH], (b - a) * CELL).reshape(b - a, CELL, FILTERS)
        r[last[a:b], CELL - inside :] = -1e9
        if where:
            arg = r.argmax(1)
            cell_arg[a:b] = arg + (np.arange(a, b) * CELL)[:, None]
            cell_max[a:b] = np.take_along_axis(r, arg[:, None], 1)[:, 0]
        else:
            cell_max[a:b] = r.max(1)
    index = first[:, None] + np.minimum(np.arange(CHUNK), length[:, None] - 1)
    x = cell_max[index]
    if not where:
        return x.max(1), doc, raw, None
    arg = x.argmax(1)
    return np.take_along_axis(x, arg[:, None], 1)[:, 0], doc, raw, np.take_along_axis(cell_arg[index], arg[:, None], 1)[:, 0]


def combined(model: dict, pool: np.ndarray, doc: np.ndarray, n_bytes: np.ndarray):
    """Logit of each document and what the backward pass needs."""
    h = np.maximum(pool @ model["hidden"] + model["hidden_bias"], 0)
    z = h @ model["chunk"]
    n = len(n_bytes)
    start = np.searchsorted(doc, np.arange(n))
    count = np.bincount(doc, minlength=n)
    high, low = np.maximum.reduceat(z, start), np.minimum.reduceat(z, start)
    features = np.stack([high, low, np.add.reduceat(z, start) / count, np.log1p(n_bytes) / 8], 1).astype(np.float32)
    return features @ model["combine"] + model["bias"][0], features, h, z, start, count


def probabilities(model: dict, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    if len(off) < 2:
        return np.zeros(0)
    pool, doc, _, _ = pooled(model, data, off)
    logit = combined(model, pool, doc, np.diff(off))[0]
    return 1 / (1 + np.exp(-np.clip(logit.astype(np.float64), -35, 35)))


def gradients(model: dict, data: np.ndarray, off: np.ndarray, label: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """Of the weighted mean log loss. Maxima pass the gradient to the window or chunk that they came from."""
    pool, doc, raw, window = pooled(model, data, off, where=True)
    logit, features, h, z, start, count = combined(model, pool, doc, np.diff(off))
    p = 1 / (1 + np.exp(-np.clip(logit, -35, 35)))
    d = ((p - label) * weight / weight.sum()).astype(np.float32)
    g = {"combine": features.T @ d, "bias": np.array([d.sum()], np.float32)}
    c = model["combine"]
    dz = (d * c[2] / count)[doc]
    for k, extreme in ((0, features[:, 0]), (1, features[:, 1])):
        at = np.flatnonzero(z == extreme[doc])
        _, one = np.unique(doc[at], return_index=True)  # the first of equal chunks
        dz[at[one]] += d[doc[at[one]]] * c[k]
    g["chunk"] = h.T @ dz
    dh = (dz[:, None] * model["chunk"]) * (h > 0)
    g["hidden"], g["hidden_bias"] = pool.T @ dh, dh.sum(0)
    dpool = dh @ model["hidden"].T
    g["conv"], embed = np.zeros_like(model["conv"]), np.zeros((256, EMBED))
    for a in range(0, len(window), BACK_CHUNKS):  # so that a long text takes no more memory than a short one
        at, d = window[a : a + BACK_CHUNKS], dpool[a : a + BACK_CHUNKS]
        seen = raw[at[:, :, None] * STRIDE + np.arange(WIDTH)]  # chunks x FILTERS x WIDTH
        g["conv"] += np.einsum("cf,cfk->kf", d, model["embed"][seen].reshape(*at.shape, WIDTH * EMBED), optimize=True)
        back = (d[:, :, None] * model["conv"].T[None]).reshape(-1, EMBED)
        flat = seen.reshape(-1)
        embed += np.stack([np.bincount(flat, back[:, k], 256) for k in range(EMBED)], 1)
    g["embed"] = embed.astype(np.float32)
    return g


def train(rows: list[tuple[bytes, int]], epochs: int = EPOCHS, batch: int = BATCH, rate: float = 4e-3, seed: int = 7) -> dict[str, np.ndarray]:
    """A model fitted by Adam on (text, label) rows, both classes weighing the same; deterministic. Without both classes, a constant one."""
    model = new_model(seed)
    label = np.array([k for _, k in rows], np.float32)
    if len(rows) == 0 or label.min() == label.max():
        for k in model:
            model[k][...] = 0
        model["bias"][0] = 30 if len(rows) and label[0] else -30
        return model
    each = np.where(label == 1, 0.5 / label.mean(), 0.5 / (1 - label.mean())).astype(np.float32)
    r = np.random.default_rng(seed)
    m, v, t = {k: np.zeros_like(x) for k, x in model.items()}, {k: np.zeros_like(x) for k, x in model.items()}, 0
    epochs = max(epochs, -(-LEAST_STEPS // -(-len(rows) // batch)))
    steps = epochs * -(-len(rows) // batch)
    for _ in range(epochs):
        order = r.permutation(len(rows))
        for a in range(0, len(order), batch):
            at = order[a : a + batch]
            data = np.frombuffer(b"".join(rows[i][0] for i in at), np.uint8)
            off = np.concatenate([[0], np.cumsum([len(rows[i][0]) for i in at])]).astype(np.int64)
            t += 1
            for k, g in gradients(model, data, off, label[at], each[at]).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                model[k] -= (rate * (1 - t / (steps + 1)) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return model


def fit(docs: DataFrame, labels: DataFrame, usable: Column, per_class: int = PER_CLASS) -> dict[str, np.ndarray]:
    """A model from a sample of labelled documents: per_class of each class, whole texts of any length."""
    sample = training_sample(docs, labels, "quality", usable, per_class).orderBy("doc_id")
    return train([(r["text"].encode(), int(r["label"])) for r in sample.select("text", "label").collect()])


def score(docs: DataFrame, model: dict, text: str = "text", name: str = "score") -> DataFrame:
    """docs with the score of every whole text, between 0 and 1; null text counts as empty. A column of that name is replaced."""
    out = docs.withColumn(name, F.lit(0.0).cast("double"))
    names, schema = out.columns, out.schema
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            data, off = buffers(batch.column(names.index(text)))
            p = np.zeros(batch.num_rows)
            for a, b in blocks(off, 1 << 20):
                p[a:b] = probabilities(shared.value, data[off[a] : off[b]], off[a : b + 1] - off[a])
            columns = list(batch.columns)
            columns[names.index(name)] = pa.array(p)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return out.mapInArrow(run, schema)


def quality(docs: DataFrame, labels: DataFrame, held_out: Column, threshold: float = 0.3, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, score, predicted of every document. held_out: condition on doc_id; labels of such rows are never used.

    Null and empty texts are scored as a cell of zero bytes. Rows that repeat a
    doc_id, also with another text, and rows with a null one are scored each by
    its own text; equal texts have equal scores. A text of any length is one row
    of an Arrow batch and is scored in one piece, its filters cell by cell. An
    empty table of documents gives an empty result; without labels every score
    is 0. Other columns are not read.
    """
    model = fit(docs, labels, ~held_out, per_class)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), held_out.alias("held_out"))
    return score(rows, model).select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
