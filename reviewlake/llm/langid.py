"""Language identification with a string kernel.

A text is the set of its byte n-grams (lengths blended, presence only); the kernel of two
texts is the share of n-grams they have in common, |A and B| / sqrt(|A| |B|).  A Nyström map
over landmark texts turns it into a short vector, and one ridge regression per language
(one versus rest) scores that.  Texts are scored in batches by two matrix products: presence
rows by landmark rows, then landmark kernels by class weights.

N-grams are hashed to ``BUCKETS`` places.  Two that meet in one place count as one, which
costs the kernel little while a row is sparse; so a long text is read in parts of
``PART_BYTES``, each with a row of its own, and its class scores are the means over its parts.
Every byte of a text is read.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import portions, session, text_bytes

#: Places for hashed n-grams (a power of two), and the lengths that are blended.
BUCKETS, LENGTHS = 8192, (1, 2, 3)
#: Bytes of a text that share a row, and rows in one matrix product.
PART_BYTES, ROWS = 8192, 256
#: Labelled rows the classifier is fitted on at most, dealt evenly to the labels, and how many of them are landmarks.
TRAIN_ROWS, LANDMARKS = 2000, 64
RIDGE = 1e-2

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[48:58] = 48


def presence(raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """0/1 rows (texts x BUCKETS) of n-grams that occur; A-Z fold to a-z, digits to one."""
    n = len(offs) - 1
    out = np.zeros((n, BUCKETS), np.float32)
    x = _FOLD[raw].astype(np.uint32)
    row = np.repeat(np.arange(n, dtype=np.int64) * BUCKETS, np.diff(offs))
    left = np.repeat(offs[1:], np.diff(offs)) - np.arange(len(raw))  # bytes of the text from here on
    flat, code = out.reshape(-1), np.zeros(len(x), np.uint32)
    for k in range(1, max(LENGTHS) + 1):
        m = len(x) - k + 1
        if m <= 0:
            break
        code = code[:m] * np.uint32(257) + x[k - 1 :] + np.uint32(1)
        if k in LENGTHS:
            place = ((code * np.uint32(2654435761)) >> np.uint32(18)) & np.uint32(BUCKETS - 1)
            ok = left[:m] >= k
            flat[row[:m][ok] + place[ok]] = 1.0
    return out


def has_letter(text: str | None) -> bool:
    """Whether any character is a letter (Unicode categories L*)."""
    return text is not None and any(map(str.isalpha, text))


@dataclass
class Model:
    classes: list[str]
    landmarks: np.ndarray  # BUCKETS x landmarks, columns scaled by their size
    weights: np.ndarray  # landmarks x classes: Nyström map and ridge weights in one
    bias: np.ndarray

    def scores(self, rows: np.ndarray) -> np.ndarray:
        size = np.sqrt(np.maximum(rows.sum(axis=1, keepdims=True), 1))
        return (rows @ self.landmarks) / size @ self.weights + self.bias

    def text_scores(self, raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Class scores of whole texts: means over their parts, by the parts' bytes."""
        return over_parts(raw, offs, len(self.classes), self.scores)


def over_parts(raw: np.ndarray, offs: np.ndarray, width: int, fn) -> np.ndarray:
    """Means of ``fn``, ``width`` figures for each presence row, over the parts of every text, by the parts' bytes."""
    size = np.diff(offs)
    many = np.maximum(-(-size // PART_BYTES), 1)
    text = np.repeat(np.arange(len(size)), many)
    no = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    edges = np.append(offs[text] + size[text] * no // many[text], offs[-1])
    out = np.zeros((len(size), width))
    for a in range(0, len(text), ROWS):
        z = min(a + ROWS, len(text))
        got = fn(presence(raw[edges[a] : edges[z]], edges[a : z + 1] - edges[a])).astype(np.float64)
        np.add.at(out, text[a:z], got * np.diff(edges[a : z + 1])[:, None])
    return out / np.maximum(size, 1)[:, None]


def kernel_with(marks: np.ndarray):
    """Presence rows to their kernel with the 0/1 rows ``marks``: counts in common are whole numbers, whatever the batch."""
    columns, own = marks.T.astype(np.float32), np.sqrt(np.maximum(marks.sum(axis=1, dtype=np.float64), 1))

    def kernel(rows: np.ndarray) -> np.ndarray:
        return (rows @ columns).astype(np.float64) / np.sqrt(np.maximum(rows.sum(axis=1, dtype=np.float64), 1))[:, None] / own

    return kernel


def fit(rows: np.ndarray, labels: list[str]) -> Model:
    """Nyström features from the first rows of every class as landmarks, then ridge regressions.

    Rows come in the order of their ids' hashes, so the first ones are a fair sample.
    """
    share = landmark_share(len(set(labels)))
    pick = np.concatenate([np.flatnonzero(np.array(labels, object) == c)[:share] for c in sorted(set(labels))])
    return ridge(rows[pick], kernel_with(rows[pick])(rows), labels)


def landmark_share(classes: int) -> int:
    """Landmarks of each class."""
    return max(1, LANDMARKS // max(1, classes))


def ridge(marks: np.ndarray, kernel: np.ndarray, labels: list[str]) -> Model:
    """One ridge regression for each class on the Nyström map of kernel rows with 0/1 landmark rows."""
    classes = sorted(set(labels))
    y = np.array([classes.index(c) for c in labels])
    own = kernel_with(marks)(marks.astype(np.float32))
    values, vectors = np.linalg.eigh((own + own.T) / 2)
    keep = values > 1e-6 * max(values.max(), 1e-12)
    to_map = vectors[:, keep] / np.sqrt(values[keep])
    z = kernel @ to_map
    mean = z.mean(axis=0)
    target = np.where(y[:, None] == np.arange(len(classes)), 1.0, -1.0)
    z = z - mean
    gram = z.T @ z + RIDGE * len(z) / 100 * np.eye(z.shape[1])
    beta = np.linalg.solve(gram, z.T @ (target - target.mean(axis=0)))
    weights = to_map @ beta
    bias = target.mean(axis=0) - mean @ beta
    scaled = marks.T / np.sqrt(np.maximum(marks.sum(axis=1, dtype=np.float64), 1))
    return Model(classes, scaled.astype(np.float32), weights.astype(np.float32), bias.astype(np.float32))


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", rows: int = TRAIN_ROWS) -> Model | None:
    """Fit on at most ``rows`` labelled rows: of every label those with the smallest hash of their id.

    Labels take turns, so a rare label is not missed while there are fewer labels than rows.
    Every part of a chosen text teaches: its kernel with a landmark is the mean over its parts by
    their bytes, as in scoring, so a text of any length is one short vector.  A landmark is one
    part of its text, which the hash picks.  Rows that share id and label teach once.  Only the
    model, the chosen hashes, the landmarks and the counts of at most ``rows`` labels reach the
    driver.  None, if no row has text and label.
    """
    session(df)

    def landmark(batches):
        for b in (p for whole in batches for p in portions(whole, 2)):
            raw, offs = text_bytes(b.column(2))
            h, size = b.column(0).to_numpy(), np.diff(offs)
            many = np.maximum(-(-size // PART_BYTES), 1)
            no = h.astype(np.uint64).astype(np.int64) % many
            bits = []
            for k in range(b.num_rows):
                part = raw[offs[k] + size[k] * no[k] // many[k] : offs[k] + size[k] * (no[k] + 1) // many[k]]
                bits.append(np.packbits(presence(part, np.array([0, len(part)])).astype(bool)).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(bits, pa.binary())], ["h", "label", "bits"])

    some = df.select(F.xxhash64(F.col(id_col)).alias("h"), F.col(label_col).alias("label"), F.col(text_col).alias("text")).filter("label is not null and text is not null and text <> ''")
    # The choice needs ids and labels only; texts of the chosen rows are read by a second, filtered scan.
    counts = some.groupBy("label").count().orderBy(F.desc("count"), "label").limit(rows).collect()
    share = 2 * rows // max(1, len(counts)) + 64  # of each label about so many rows, by a bound on the hash
    least = [(r["label"], min((1 << 63) - 1, -(1 << 63) + (1 << 64) * share // r["count"])) for r in counts]
    few = some.join(F.broadcast(df.sparkSession.createDataFrame(least, "label string, most long")), "label").filter("h <= most").select("h", "label").distinct()
    turn = F.row_number().over(Window.partitionBy("label").orderBy("h"))
    chosen = few.withColumn("turn", turn).orderBy("turn", "h", "label").limit(rows).select("h", "label").collect()
    if not chosen:
        return None

    def texts(names: list[tuple[int, str]]) -> DataFrame:
        wanted = F.broadcast(df.sparkSession.createDataFrame(names, "h long, label string"))  # at most ``rows``
        return some.join(wanted, ["h", "label"], "left_semi").select("h", "label", "text")

    every = sorted(set(map(tuple, chosen)), key=lambda r: (r[1], r[0]))
    most = landmark_share(len({c for _, c in every}))
    first = [r for c in sorted({c for _, c in every}) for r in [e for e in every if e[1] == c][:most]]
    found = texts(first).mapInArrow(landmark, "h long, label string, bits binary").groupBy("h", "label").agg(F.min("bits").alias("bits")).collect()
    found = [r["bits"] for r in sorted(found, key=lambda r: (r["label"], r["h"]))]
    marks = np.unpackbits(np.frombuffer(b"".join(found), np.uint8).reshape(len(found), -1), axis=1)

    def kernels(batches):
        kernel = kernel_with(marks)
        for b in (p for whole in batches for p in portions(whole, 2)):
            got = over_parts(*text_bytes(b.column(2)), len(marks), kernel)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x.tobytes() for x in got], pa.binary())], ["h", "label", "kernel"])

    got = texts(every).mapInArrow(kernels, "h long, label string, kernel binary").groupBy("h", "label").agg(F.min("kernel").alias("kernel"))

    def learn(batches):
        """The bounded sample is fitted in one task, and only the model comes back."""
        rows = sorted(r for b in batches for r in zip(b.column(1).to_pylist(), b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True))
        kernel = np.frombuffer(b"".join(k for *_, k in rows), np.float64).reshape(len(rows), -1)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(ridge(marks, kernel, [c for c, *_ in rows]))], pa.binary())], ["model"])

    return pickle.loads(bytes(got.repartition(1).mapInArrow(learn, "model binary").first()["model"]))


def identify(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, ``keep`` columns, lang_pred and score (0 to 1) of every whole text.

    Null texts and texts without a letter are ``und`` with score 0, as is every text when
    nothing could be learned.  The score is the softmax share of the best class; of classes
    that tie the first by name is taken.  Rows that repeat each get a row, an empty table gives
    an empty one; other columns than those named are not read and may have any names.
    """
    session(df)
    types = dict(df.dtypes)

    def run(batches):
        for b in (p for whole in batches for p in portions(whole, whole.num_columns - 1)):
            texts = b.column(b.num_columns - 1)
            real = np.fromiter(map(has_letter, texts.to_pylist()), bool, b.num_rows)
            pred, score = np.full(len(real), "und", object), np.zeros(len(real))
            if model is not None and real.any():
                s = model.text_scores(*text_bytes(texts)) * 2
                e = np.exp(s - s.max(axis=1, keepdims=True))
                best = s.argmax(axis=1)
                pred[real] = np.array(model.classes, object)[best[real]]
                score[real] = (e[np.arange(len(best)), best] / e.sum(axis=1))[real]
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(b.num_columns - 1)] + [pa.array(pred, pa.string()), pa.array(score, pa.float64())], [id_col, *keep, "lang_pred", "score"])

    lead = ", ".join(f"`{c}` {types[c]}" for c in (id_col, *keep))
    return df.select(id_col, *keep, F.col(text_col).alias("__text")).mapInArrow(run, f"{lead}, lang_pred string, score double")
