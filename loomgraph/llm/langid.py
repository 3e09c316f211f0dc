"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

Character n-grams (1 to 3 letters, across word edges) are hashed into a fixed number of
features. Document frequencies are counted over all training documents. The classifier learns
by follow-the-regularised-leader with an elastic net from a bounded sample of them: about
`sample_per_label` documents of each label, or fewer of each where there are more than
`full_labels` labels, but at least one; no label is left out. They are chosen by a hash of the
id; a part of the sample only calibrates the temperature. Prediction reads whole texts.

Defined results: a text that is null or has no letter is `und` with score 0; without training
documents every text is `und`; null labels teach nothing; repeated rows give one row each; of
labels with one score the first by name wins; only the named columns are read, so others of any
name do no harm. Memory per task grows with a chunk of texts or the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..layout import spread
from .common import crc_mod, id_and_text, id_field, map_chunks

UNKNOWN = "und"
#: Most bytes of a model that is broadcast.
MODEL_BYTES = 256 << 20
BITS = 15
ORDERS = 3
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _letter_table() -> np.ndarray:
    """True for the code points that are letters."""
    import sys

    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


_LETTERS: np.ndarray | None = None


def features(texts: list[bytes], bits: int = BITS, orders: int = ORDERS) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
    """(feature numbers, counts) of each text's n-grams, or None for a text without letters. Runs of non-letters count as one space."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = _letter_table()
    for text in texts:
        codes = np.frombuffer((" " + text.decode("utf-8", "replace").lower() + " ").encode("utf-32-le", "replace"), np.uint32)
        letter = _LETTERS[codes]
        if not letter.any():
            yield None
            continue
        keep = letter.copy()
        keep[1:] |= letter[:-1]  # the first of each run of other characters
        keep[0] = True
        codes = np.where(letter, codes, 32)[keep].astype(np.uint64)
        total = np.zeros(1 << bits, np.int64)
        key = np.zeros(len(codes), np.uint64)
        for n in range(1, orders + 1):
            key = (key[: len(codes) - n + 1] * np.uint64(0x110000)) + codes[n - 1 :]
            mixed = (key + np.uint64(n)) * _MIX
            mixed ^= mixed >> np.uint64(29)
            mixed *= _MIX
            total += np.bincount((mixed >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        at = np.flatnonzero(total)
        yield at, total[at]


def weights(found: tuple[np.ndarray, np.ndarray], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit-length TF-IDF with logarithmic term frequency."""
    at, count = found
    x = (1.0 + np.log(count)) * idf[at]
    return at, x / np.sqrt((x * x).sum())


def document_frequency(df: DataFrame, text_col: str = "text", bits: int = BITS) -> tuple[np.ndarray, int]:
    """How many documents have each feature, and how many have letters: at most 2**bits + 1 rows come back."""
    rows = df.select(F.lit(0).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = T.StructType([T.StructField("feature", T.IntegerType()), T.StructField("df", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 << bits) + 1, np.int64)  # the last counts documents
        for batch in batches:
            for found in features(batch.column(1).cast(pa.binary()).to_pylist(), bits):
                if found is not None:
                    total[found[0]] += 1
                    total[-1] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["feature", "df"])

    out = np.zeros((1 << bits) + 1, np.int64)
    for r in rows.mapInArrow(run, schema).groupBy("feature").agg(F.sum("df").alias("df")).collect():
        out[r.feature] = r.df
    return out[:-1], int(out[-1])


class Model:
    """labels, idf, sparse weights, bias and temperature; `bits` gives the features. Only weights other than zero are kept, feature by feature."""

    def __init__(self, labels: list[str], idf: np.ndarray, w: np.ndarray, bias: np.ndarray, temperature: float = 1.0, bits: int = BITS, rows: np.ndarray | None = None):
        """`w`: one row a feature, or one for each feature of `rows`, which ascend."""
        self.labels, self.idf, self.bias, self.temperature, self.bits = labels, idf, bias, temperature, bits
        row, self.label = np.nonzero(w)
        self.weight = w[row, self.label]
        feature = row if rows is None else rows[row]
        self.starts = np.searchsorted(feature, np.arange((1 << bits) + 1))

    @property
    def w(self) -> np.ndarray:
        """The weights as a dense array of features by labels."""
        out = np.zeros((1 << self.bits, len(self.labels)))
        out[np.repeat(np.arange(1 << self.bits), np.diff(self.starts)), self.label] = self.weight
        return out

    @property
    def size(self) -> int:
        """Bytes of what is broadcast."""
        return sum(x.nbytes for x in (self.idf, self.bias, self.label, self.weight, self.starts))

    def logits(self, found: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        at, x = weights(found, self.idf)
        n = self.starts[at + 1] - self.starts[at]
        ends = np.cumsum(n)
        held = np.repeat(self.starts[at] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)
        return np.bincount(self.label[held], np.repeat(x, n) * self.weight[held], len(self.labels)) + self.bias

    def predict(self, found: tuple[np.ndarray, np.ndarray] | None) -> tuple[str, float]:
        if found is None or not self.labels:
            return UNKNOWN, 0.0
        p = softmax(self.logits(found) / self.temperature)
        best = int(p.argmax())
        return self.labels[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(examples: list[tuple[np.ndarray, np.ndarray, int]], n_features: int, n_labels: int, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal for the multinomial logistic loss with an elastic net; the bias (last row) is not penalised. Returns weights and bias."""
    z, n = np.zeros((n_features + 1, n_labels)), np.zeros((n_features + 1, n_labels))

    def solve(zs: np.ndarray, ns: np.ndarray, l1: float, l2: float) -> np.ndarray:
        return np.where(np.abs(zs) <= l1, 0.0, -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(ns)) / alpha + l2))

    order = np.random.default_rng(0)
    for _ in range(epochs):
        for k in order.permutation(len(examples)):
            at, x, label = examples[k]
            zs, ns = z[at], n[at]
            w = solve(zs, ns, l1, l2)
            bias = solve(z[-1], n[-1], 0.0, 0.0)
            g = softmax(x @ w + bias)
            g[label] -= 1.0
            grad = np.outer(x, g)
            z[at] = zs + grad - (np.sqrt(ns + grad * grad) - np.sqrt(ns)) / alpha * w
            n[at] = ns + grad * grad
            z[-1] += g - (np.sqrt(n[-1] + g * g) - np.sqrt(n[-1])) / alpha * bias
            n[-1] += g * g
    return solve(z[:-1], n[:-1], l1, l2), solve(z[-1], n[-1], 0.0, 0.0)


def best_temperature(logits: np.ndarray, label: np.ndarray) -> float:
    """The temperature of least negative log-likelihood, from a fixed ladder."""
    ladder = np.exp(np.linspace(np.log(0.05), np.log(20.0), 121))
    loss = [-np.log(softmax(logits / t)[np.arange(len(label)), label] + 1e-300).mean() for t in ladder]
    return float(ladder[int(np.argmin(loss))])


def counted(rows: DataFrame, bits: int) -> DataFrame:
    """(u, label, at, count_of) of rows (u, text, label): each text's n-gram counts, packed, at most 2 ** (bits + 3) bytes however long it is; null for one without letters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = next(features([batch.column(1)[i].as_py()], bits))
                at, count = (None, None) if found is None else (x.astype("<i4").tobytes() for x in found)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), batch.column(2).slice(i, 1), pa.array([at], pa.binary()), pa.array([count], pa.binary())], names=["u", "label", "at", "count_of"])

    return rows.mapInArrow(run, "u double, label string, at binary, count_of binary")


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", sample_per_label: int = 1500, full_labels: int = 200, bits: int = BITS) -> Model:
    """Fit the classifier. `df` holds training documents only.

    The sample: ids whose hash falls below rows per label / (documents of the label), and the
    least hash of each label, so about that many of each label reach the driver as packed counts.
    N-grams are counted where the documents lie; no text travels. Rows per label: `sample_per_label`, lowered so that all labels
    have no more than `full_labels` labels would have. The model grows with the labels.
    """
    labelled = df.filter(F.col(label_col).isNotNull())
    df_counts, n = document_frequency(labelled, text_col, bits)
    idf = np.log((1.0 + n) / (1.0 + df_counts)) + 1.0
    label = F.col(label_col).cast("string")
    u = F.pmod(F.xxhash64(F.lit("sample"), F.col(id_col).cast("string"), F.col(text_col)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    first = F.min(F.when(F.col(text_col).rlike(r"\p{L}"), u))  # of the texts that teach something
    counts = labelled.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("count"), first.alias("first")).collect()
    labels = sorted(r.label for r in counts)
    if not labels:
        return Model([], idf, np.zeros((1 << bits, 0)), np.zeros(0), bits=bits)
    number = {x: i for i, x in enumerate(labels)}
    most = sample_per_label * full_labels
    if len(labels) > most:
        raise ValueError(f"{len(labels)} labels, more than the {most} rows of the sample")
    per_label = min(sample_per_label, most // len(labels))
    shares = [(r.label, max(min(1.0, per_label / r["count"]), 0.0 if r.first is None else float(np.nextafter(r.first, 2.0)))) for r in counts]
    share = df.sparkSession.createDataFrame(shares, "label string, share double")
    rows = labelled.select(u.alias("u"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"), label.alias("label"))
    rows = rows.join(F.broadcast(share), "label").filter("u < share").select("u", "text", "label").distinct()  # rows that repeat an id and text have one hash
    sample = sorted(counted(rows, bits).collect(), key=lambda r: (r.u, r.label, r.at or b"", r.count_of or b""))
    learn, calibrate, known = [], [], set()
    for k, r in enumerate(sample):
        if r.at is not None:
            found = np.frombuffer(r.at, "<i4").astype(np.int64), np.frombuffer(r.count_of, "<i4").astype(np.int64)
            (calibrate if k % 5 == 4 and r.label in known else learn).append((*weights(found, idf), number[r.label]))
            known.add(r.label)
    # learned over the features that the sample touches only
    touched = np.unique(np.concatenate([at for at, _, _ in learn] or [np.zeros(0, np.int64)]))
    w, bias = ftrl([(np.searchsorted(touched, at), x, y) for at, x, y in learn], len(touched), len(labels))
    model = Model(labels, idf, w, bias, bits=bits, rows=touched)
    if model.size > MODEL_BYTES:
        raise ValueError(f"a model of {model.size} bytes, more than the {MODEL_BYTES} that are broadcast; raise l1 or lower bits")
    if calibrate:
        logits = np.array([x[found] @ w[np.searchsorted(touched, at[found])] + bias for at, x, _ in calibrate for found in [np.isin(at, touched)]])
        model.temperature = best_temperature(logits, np.array([y for _, _, y in calibrate]))
    return model


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id_col`, lang_pred and score (calibrated probability) of each whole text. The model's size is bounded by its features and labels."""
    rows = id_and_text(df, id_col, text_col)
    schema = T.StructType([id_field(rows, id_col), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = df.sparkSession.sparkContext.broadcast(model)

    def work(ids: pa.Array, texts: list[bytes]) -> pa.RecordBatch:
        found = [shared.value.predict(f) for f in features(texts, shared.value.bits)]
        return pa.RecordBatch.from_arrays([ids, pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=schema.names)

    return map_chunks(rows, work, schema)


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    model = train(docs.filter(crc_mod("doc_id", 4) != 2).select("doc_id", "text", "lang"))
    return predict(docs, model).select("doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
