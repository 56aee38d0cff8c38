"""Toxicity from subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its byte n-grams, boundaries included, hashed into buckets with small vectors. A segment of words is
the mean of its words, a word the mean of its n-grams; two linear outputs and a softmax follow. Embeddings and outputs
are trained together by full-batch gradient steps with momentum. A document's label is only known for the whole, so a toxic document teaches by
its most toxic segments and a clean one by all; a document's score is that of its most toxic segment, calibrated on
documents kept out of the training. Misspelled words share most of their n-grams with the words they stand for.
"""

from __future__ import annotations

import pickle
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quillspan.llm import bytekernel as bk
from quillspan.llm.bpe import gather_ranges
from quillspan.llm.shared import thinned

GRAMS = (3, 4, 5, 6, 7)
BITS, DIMS, SEGMENT = 18, 4, 24
SAMPLE_ROWS = 2000  # labelled rows of each class that training sees at most, chosen by a hash of the id
SAMPLE_BYTES = 8192  # longer texts teach nothing; they are scored whole
STEP = (0.6, 0.1, 0.05)  # longest step of an embedding, an output and a bias in a round
FEW, TIE = 4, 6.0  # n-grams in fewer training documents, or with a weaker tie to the label in standard deviations, are ignored

_edge = 0x20
_table = np.where(np.arange(256) >= 0x80, np.arange(256), _edge).astype(np.uint8)
_table[list(range(48, 58)) + list(range(97, 123))] = list(range(48, 58)) + list(range(97, 123))
_table[65:91] = np.arange(97, 123)
_inside = _table != _edge


def gram_buckets(buf: np.ndarray, n: int, before: np.ndarray | None = None) -> np.ndarray:
    """A 32-bit hash of the n bytes from each place on, from that of n - 1 bytes."""
    if before is None:
        before = np.zeros(len(buf), np.uint32)
        for k in range(n - 1):
            before[: len(buf) - k] = before[: len(buf) - k] * np.uint32(0x01000193) + buf[k:] + np.uint32(1)
    out = before.copy()
    out[: len(buf) - n + 1] = before[: len(buf) - n + 1] * np.uint32(0x01000193) + buf[n - 1 :] + np.uint32(1)
    return out


def bucket_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)


def padded(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes with an edge before each row and at the end, and starts, ends and row of the words in them."""
    out = np.full(len(buf) + len(offs), _edge, np.uint8)
    rows = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    out[np.arange(len(buf)) + rows + 1] = _table[buf]
    starts, ends, row = bk.word_spans(out, offs + np.arange(len(offs)), _inside)
    return out, starts, ends, row


def segments_of(row: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Segment of each word (segments are half-overlapping pairs of halves) as the half it lies in, and the row of each half."""
    first = np.searchsorted(row, np.arange(n_rows))
    half = SEGMENT // 2
    nth = (np.arange(len(row)) - first[row]) // half
    new = np.append(True, (row[1:] != row[:-1]) | (nth[1:] != nth[:-1])) if len(row) else np.zeros(0, bool)
    return np.cumsum(new) - 1, row[new]


class Model:
    """Bucket weights (outputs applied to embeddings), their bias, and the calibration."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float, shift: float):
        self.weights, self.bias, self.slope, self.shift = weights, bias, slope, shift

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * logits + self.shift, -30, 30)))

    def word_logits(self, out: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        total, count = np.zeros(len(starts)), np.zeros(len(starts))
        hashes = None
        for n in GRAMS:
            hashes = gram_buckets(out, n, hashes)
            sums = np.concatenate([[0.0], np.cumsum(self.weights[bucket_of(hashes)], dtype=np.float64)])
            a, b = starts - 1, ends + 2 - n
            some = b > a
            total[some] += sums[b[some]] - sums[a[some]]
            count[some] += (b - a)[some]
        return total / np.maximum(count, 1)

    def logits(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """The logit of each row's most toxic segment; rows without words get the bias."""
        n_rows = len(offs) - 1
        out, starts, ends, row = padded(buf, offs)
        best = np.full(n_rows, self.bias)
        if not len(starts):
            return best
        half, half_row = segments_of(row, n_rows)
        logits = self.word_logits(out, starts, ends)
        fresh = np.append(True, (logits[1:] != logits[:-1]) | (np.diff(ends - starts) != 0) | (row[1:] != row[:-1]))
        value = np.bincount(half, logits * fresh)
        words = np.bincount(half, fresh)
        score = _pooled(value, words, half_row) + self.bias
        best[:] = -np.inf
        np.maximum.at(best, half_row, score)
        return np.where(np.isinf(best), self.bias, best)


def _pooled(value: np.ndarray, words: np.ndarray, half_row: np.ndarray) -> np.ndarray:
    """The mean over each half and the one after it in the same row."""
    pair = np.append(half_row[1:] == half_row[:-1], False)
    v, w = value.copy(), words.astype(np.float64)
    v[:-1] += np.where(pair[:-1], value[1:], 0)
    w[:-1] += np.where(pair[:-1], words[1:], 0)
    return v / np.maximum(w, SEGMENT / 4)


def fit(texts: list[str], labels: np.ndarray, keep_out: np.ndarray, rounds: int = 120, seed: int = 5) -> Model:
    """A model of texts with labels 0 and 1; keep_out marks rows used for calibration only."""
    column = pa.array(texts, pa.large_string())
    (_, buf, offs), *more = list(bk.blocks(column, 1 << 40)) or [(0, np.zeros(0, np.uint8), np.zeros(1, np.int64))]
    neutral = Model(np.zeros(1 << BITS, np.float32), 0.0, 1.0, float(np.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1))) if len(labels) else 0.0)
    if not len(buf) or labels.sum() in (0, len(labels)):
        return neutral
    out, starts, ends, row = padded(buf, offs)
    if not len(starts):
        return neutral
    # Distinct words, and their n-grams' buckets.
    hashes = bk.span_hashes(out, starts, ends, bk.byte_values(3))
    _, where, word = np.unique(hashes, return_index=True, return_inverse=True)
    grams, owner, h = [], [], None
    for n in GRAMS:
        h = gram_buckets(out, n, h)
        a, k = starts[where] - 1, np.maximum(ends[where] + 2 - n - (starts[where] - 1), 0)
        grams.append(bucket_of(h[gather_ranges(a, k)]).astype(np.int32))
        owner.append(np.repeat(np.arange(len(where), dtype=np.int32), k))
    grams, owner = np.concatenate(grams), np.concatenate(owner)
    count = np.maximum(np.bincount(owner, minlength=len(where)), 1).astype(np.float32)
    learn = ~keep_out
    # The vocabulary: buckets whose presence in documents goes with the label, by distinct (row, word) pairs.
    pairs = np.unique(row[learn[row]].astype(np.int64) * len(where) + word[learn[row]])
    toxic = labels[pairs // len(where)] > 0
    p, n = (np.bincount(grams, np.bincount(pairs[side] % len(where), minlength=len(where))[owner], minlength=1 << BITS) for side in (toxic, ~toxic))
    n_p, n_n = (labels[learn] > 0).sum(), (labels[learn] == 0).sum()
    tie = (p * n_n - n * n_p) / np.sqrt((p + n + 1e-9) * n_p * n_n)
    often = (p + n >= FEW) & (np.abs(tie) >= TIE)
    if not often.any():
        return neutral
    used = often[grams]
    grams, owner = grams[used], owner[used]
    ids = np.flatnonzero(often)
    compact = np.zeros(1 << BITS, np.int32)
    compact[ids] = np.arange(len(ids))
    grams = compact[grams]
    half, half_row = segments_of(row, len(texts))
    n_half = len(half_row)
    # A word that only repeats the one before it counts once.
    fresh = np.append(True, (word[1:] != word[:-1]) | (row[1:] != row[:-1]))
    words = np.bincount(half, fresh, minlength=n_half)
    tokens, half = word[fresh], half[fresh]
    y, teach = labels[half_row].astype(np.float32), learn[half_row]
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (len(ids), DIMS)).astype(np.float32)
    lin = rng.normal(0, 0.5, (2, DIMS)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (emb, lin, bias)]

    peak = [0.0, 0.0, 0.0]

    def mean_words() -> np.ndarray:
        return np.stack([np.bincount(owner, emb[grams, k], minlength=len(where)) for k in range(DIMS)], 1).astype(np.float32) / count[:, None]

    pair = np.append(half_row[1:] == half_row[:-1], False)
    size = words.astype(np.float32)
    size[:-1] += np.where(pair[:-1], words[1:], 0)
    size = np.maximum(size, SEGMENT / 4)

    def forward() -> tuple[np.ndarray, np.ndarray]:
        wv = mean_words()
        seg = np.stack([np.bincount(half, wv[tokens, k], minlength=n_half) for k in range(DIMS)], 1).astype(np.float32)
        both = seg.copy()
        both[:-1] += np.where(pair[:-1, None], seg[1:], 0)
        both /= size[:, None]
        return both, both @ lin.T + bias

    for t in range(1, rounds + 1):
        seg, z = forward()
        p1 = 1 / (1 + np.exp(np.clip(z[:, 0] - z[:, 1], -30, 30)))
        top = np.full(len(texts), -np.inf, np.float32)
        np.maximum.at(top, half_row, z[:, 1] - z[:, 0])
        chief = (z[:, 1] - z[:, 0]) >= top[half_row]
        weight = np.where(y > 0, chief if t > rounds // 6 else True, True) * teach
        each = np.bincount(half_row, weight, minlength=len(texts))[half_row]
        # Toxic and clean documents weigh alike in sum, and so do the segments of one document.
        weight = weight / np.maximum(each ** np.where(y > 0, 1.0, 0.5), 1)
        for c in (0, 1):
            weight[y == c] /= max(weight[y == c].sum(), 1e-6)
        g = ((p1 - y) * weight).astype(np.float32)
        dz = np.stack([-g, g], 1)
        grads = [None, dz.T @ seg, dz.sum(0)]
        back = (dz @ lin) / size[:, None]
        back[1:] += np.where(pair[:-1, None], back[:-1].copy(), 0)
        dw = np.stack([np.bincount(tokens, back[half, k], minlength=len(where)) for k in range(DIMS)], 1) / count[:, None]
        grads[0] = np.stack([np.bincount(grams, dw[owner, k], minlength=len(ids)) for k in range(DIMS)], 1).astype(np.float32)
        # Plain momentum, scaled for all of a matrix at once: rare n-grams move little, consistent ones far.
        for q, (param, grad, (m, _)) in enumerate(zip((emb, lin, bias), grads, state)):
            m *= 0.8
            m += grad
            peak[q] = max(0.9 * peak[q], float(np.abs(m).max()), 1e-12)
            param -= STEP[q] * m / peak[q]
    weights = np.zeros(1 << BITS, np.float32)
    weights[ids] = emb @ (lin[1] - lin[0])
    model = Model(weights, float(bias[1] - bias[0]), 1.0, 0.0)
    z = model.logits(buf, offs)
    model.slope, model.shift = _calibrated(z[keep_out], labels[keep_out]) if 0 < labels[keep_out].sum() < keep_out.sum() else _calibrated(z, labels)
    return model


def _calibrated(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic fit by Newton steps on scaled logits, slightly drawn to the middle; never falling."""
    scale, middle = max(float(z.std()), 1e-6), float(z.mean())
    x = np.stack([(z - middle) / scale, np.ones(len(z))], 1)
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    w = np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        w -= np.linalg.solve(hess, x.T @ (p - target) + 1e-3 * w)
    w[0] = max(w[0], 1e-3)
    return float(w[0] / scale), float(w[1] - w[0] * middle / scale)


def fold_of(doc_id) -> object:
    """crc32(doc_id as text) mod 5 as a column; 0 is held out."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(5))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from at most SAMPLE_ROWS labelled rows of each class, none of them held out.

    The sample is the rows of least hash of the id: the same for the same tables. Null texts, labels and ids teach
    nothing; repeated labels count once, as toxic if any says so.
    """
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where(fold_of("doc_id") > 0)
    known = known.withColumn("hash", F.xxhash64("doc_id"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}  # two rows
    least = W.partitionBy("toxic").orderBy("hash", "doc_id")
    # Twice as many as are wanted, since some are too long; a bounded number of ids.
    some = known.where(thinned("toxic", counts, 2 * SAMPLE_ROWS, "hash")).withColumn("n", F.row_number().over(least)).where(F.col("n") <= 2 * SAMPLE_ROWS)
    usable = docs.select("doc_id", "text").where(F.col("text").isNotNull() & (F.octet_length("text") <= SAMPLE_BYTES) & (fold_of("doc_id") > 0))
    sample = usable.join(F.broadcast(some.select("doc_id", "toxic", "hash")), "doc_id").dropDuplicates(["doc_id", "text"])
    least = W.partitionBy("toxic").orderBy("hash", "doc_id", "text")
    sample = sample.withColumn("n", F.row_number().over(least)).where(F.col("n") <= SAMPLE_ROWS).select("doc_id", "text", "toxic")

    def run(batches):
        rows = [r for b in batches for r in b.to_pylist()]
        rows.sort(key=lambda r: (r["toxic"], str(r["doc_id"]), r["text"]))
        keep = np.array([zlib.crc32(f"kept {r['doc_id']}".encode()) % 5 == 0 for r in rows], bool)
        model = fit([r["text"] for r in rows], np.array([r["toxic"] for r in rows], np.float64), keep)
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(model)], pa.binary())})

    # One task fits the bounded sample; the driver gets the weights alone.
    found = sample.coalesce(1).mapInArrow(run, "model binary").first()
    return pickle.loads(found["model"]) if found else fit([], np.zeros(0), np.zeros(0, bool))


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score) for each row: 0 to 1 for its whole text; null is an empty text, which scores as the model's bias."""
    base = docs.select(id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS weights: a fixed size

    def run(batches):
        model = shared.value
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            for first, buf, offs in bk.blocks(batch.column(1)):
                scores[first : first + len(offs) - 1] = model.probabilities(model.logits(buf, offs))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], names=[id_col, "score"])

    kind = base.schema[id_col].dataType.simpleString()
    return base.mapInArrow(run, f"{id_col} {kind}, score double")


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document. Labels and doc_id choose the training rows and fold, never a score."""
    found = scored(docs, train(docs, labels))
    return found.select("doc_id", (fold_of("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
