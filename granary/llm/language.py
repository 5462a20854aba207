"""Language identification by error-correcting output codes over character n-grams.

Every language has a binary codeword. For each bit a binary naive-Bayes classifier over hashed byte n-grams tells the
languages with a 1 there from those with a 0; a text's margins on all bits are compared with the codewords under the
logistic loss, each bit weighted by what it got right on the training rows, and the nearest codeword wins. A text whose
two nearest codewords are about as far is flagged ambiguous.

n-grams are taken over letters in lower case; whatever lies between letters is one border sign. Only text is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, text_buffers

#: Hashed features; the last slot takes what is no feature.
DIMS = 1 << 16
#: Sampled training rows of a language, in expectation.
TRAIN_ROWS = 1500
#: Two nearest codewords whose scores differ by less make a text ambiguous.
AMBIGUOUS = 0.1
CHUNK = 1 << 18


def _letters() -> np.ndarray:
    out = np.zeros(256, np.uint8)
    for b in range(256):
        if 65 <= b <= 90 or 97 <= b <= 122:
            out[b] = b | 32
        elif b >= 0x80:
            out[b] = b
    return out


LETTERS = _letters()


def features(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The feature of the three bytes that start at each byte; DIMS where they cross a row's end or hold no letter pair."""
    x = LETTERS[data]
    if len(x) < 3:
        return np.full(len(x), DIMS, np.int64)
    upper = (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97) & (data[:-1] == 0xC3)  # Latin-1 capitals
    x[1:][upper] += 0x20
    a, b, c = x[:-2].astype(np.uint32), x[1:-1], x[2:]
    code = ((a << 16 | b.astype(np.uint32) << 8 | c) * np.uint32(2654435761)) >> np.uint32(16)
    out = np.full(len(x), DIMS, np.int64)
    out[:-2] = np.where((b > 0) & ((x[:-2] > 0) | (c > 0)), code, DIMS)
    last = ends[1:][ends[1:] > ends[:-1]]
    out[last - 1] = DIMS
    out[np.maximum(last - 2, 0)] = DIMS
    return out


def codewords(n: int, most: int = 31, seed: int = 11) -> np.ndarray:
    """n codewords (rows) of 0 and 1: the exhaustive code for a few languages, else random columns that split them evenly."""
    if n < 2:
        return np.ones((n, 1), np.int8)
    if 2 ** (n - 1) - 1 <= most:
        columns = [(1, *c) for c in product((0, 1), repeat=n - 1) if not all(c)]
        return np.array(columns, np.int8).T
    rng, columns = np.random.default_rng(seed), set()
    want = max(most, 4 * int(np.ceil(np.log2(n))))
    while len(columns) < want:
        columns.add(tuple(rng.permutation(np.arange(n) % 2)))
    return np.array(sorted(columns), np.int8).T


class Model:
    """languages, their codewords (languages x bits), a weight row for each feature (the last one 0), and bit weights."""

    def __init__(self, languages: list[str], code: np.ndarray, weights: np.ndarray, bits: np.ndarray):
        self.languages, self.code, self.weights, self.bits = languages, code, weights, bits

    def margins(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Sum of the features' log odds over the root of their number, for each row and bit; whole texts, in chunks."""
        sums, seen = np.zeros((len(ends) - 1, self.weights.shape[1] + 1)), None
        table = np.hstack([self.weights, np.ones((DIMS + 1, 1), np.float32)])
        table[DIMS] = 0
        for i, j in slices(ends, CHUNK):
            f = features(data[ends[i] : ends[j]], ends[i : j + 1] - ends[i])
            local = ends[i : j + 1] - ends[i]
            if j == i + 1:  # one row, maybe very long
                for k in range(0, len(f), CHUNK):
                    sums[i] += table[f[k : k + CHUNK]].sum(axis=0, dtype=np.float64)
                continue
            full = np.flatnonzero(local[1:] > local[:-1])
            if len(full):
                sums[i + full] = np.add.reduceat(table[f], local[full], axis=0, dtype=np.float64)
        seen = sums[:, -1]
        return sums[:, :-1] / np.sqrt(np.maximum(seen, 1))[:, None]

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest codeword, its score (0 to 1), and that of the second nearest."""
        sign = 2.0 * self.code - 1
        loss = (self.bits * np.logaddexp(0, -margins[:, None, :] * sign[None])).sum(axis=2)
        p = np.exp(loss.min(axis=1, keepdims=True) - loss)
        p /= p.sum(axis=1, keepdims=True)
        best = loss.argmin(axis=1)
        top = np.sort(p, axis=1)
        return best, top[:, -1], top[:, -2] if p.shape[1] > 1 else np.zeros(len(p))


def has_letter(data: np.ndarray, ends: np.ndarray, texts: pa.Array) -> np.ndarray:
    """Whether each text has a letter of any script."""
    out = np.zeros(len(texts), bool)
    for i, j in slices(ends, CHUNK):
        raw = data[ends[i] : ends[j]]
        at = np.flatnonzero(((raw | 32) >= 97) & ((raw | 32) <= 122)) + ends[i]
        out[i:j] = np.searchsorted(at, ends[i + 1 : j + 1]) > np.searchsorted(at, ends[i:j])
    for i in np.flatnonzero(~out & (ends[1:] > ends[:-1])):
        out[i] = any(ch.isalpha() for ch in texts[int(i)].as_py())
    return out


def train(docs: DataFrame, where: Column, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Fit on a sample of the labelled rows that meet ``where``: about ``rows`` of each language, by a hash of id and text.

    The sample's texts are counted on the executors; the driver gets eight count vectors of each language. None: no
    labelled row.
    """
    labelled = docs.where(where & F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    languages = sorted(counts)
    share = F.element_at(F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(rows / counts[k]))]), F.col("lang"))
    draw = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1 << 20)) / float(1 << 20)
    sample = labelled.where((draw < share) & F.col("text").isNotNull()).select("lang", "text").repartition(8)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            data, ends = text_buffers(batch.column("text"))
            f = features(data, ends)
            for i, lang in enumerate(langs):
                c = np.bincount(f[ends[i] : ends[i + 1]], minlength=DIMS + 1)[:DIMS]
                c = np.minimum(c, 50)  # a text that repeats itself counts as fifty at most
                total[lang] = total.get(lang, 0) + c
        if total:
            yield pa.RecordBatch.from_pydict({"lang": list(total), "c": [v.astype(np.int64).tobytes() for v in total.values()]})

    c = np.zeros((len(languages), DIMS))
    for r in sample.mapInArrow(tally, "lang string, c binary").toLocalIterator():
        c[languages.index(r["lang"])] += np.frombuffer(r["c"], np.int64)
    code = codewords(len(languages))
    p = (c + 0.2) / (c.sum(axis=1, keepdims=True) + 0.2 * DIMS)
    weights = np.zeros((DIMS + 1, code.shape[1]), np.float32)
    for b in range(code.shape[1]):
        ones, zeros = p[code[:, b] == 1], p[code[:, b] == 0]
        if len(ones) and len(zeros):
            weights[:DIMS, b] = np.log(ones.mean(axis=0)) - np.log(zeros.mean(axis=0))
    model = Model(languages, code, weights, np.ones(code.shape[1]))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        right, n = 0, 0
        for batch in batches:
            data, ends = text_buffers(batch.column("text"))
            truth = model.code[[model.languages.index(x) for x in batch.column("lang").to_pylist()]]
            right, n = right + ((model.margins(data, ends) > 0) == (truth == 1)).sum(axis=0), n + len(truth)
        if n:
            yield pa.RecordBatch.from_pydict({"right": [np.asarray(right, np.int64).tobytes()], "n": [n]})

    right, n = 0, 0
    for r in sample.mapInArrow(verify, "right binary, n long").toLocalIterator():
        right, n = right + np.frombuffer(r["right"], np.int64), n + r["n"]
    if n:
        e = np.clip(1 - right / n, 0.001, 0.4)
        model.bits = np.log((1 - e) / e) / np.log(0.999 / 0.001)
    return model


def label(texts: pa.Array, model: Model | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """lang_pred, score and ambiguous of each text; ``und`` with score 0 where there is no letter or no model."""
    texts = texts.fill_null("")
    data, ends = text_buffers(texts)
    n = len(texts)
    if not (model and n):
        return np.full(n, "und", object), np.zeros(n), np.zeros(n, bool)
    known = has_letter(data, ends, texts)
    best, score, second = model.decode(model.margins(data, ends))
    names = np.array([*model.languages, "und"], object)
    return names[np.where(known, best, len(names) - 1)], np.where(known, score, 0.0), known & (score - second < AMBIGUOUS)


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, ambiguous for each row of ``docs``, whose whole texts are read.

    ``und`` with score 0 where the text is null or has no letter, or where there was nothing to learn from. Repeated
    rows and null ids pass through, an empty table gives an empty result; other columns are ignored.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pred, score, ambiguous = label(batch.column("text"), model)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(pred, pa.string()), pa.array(score), pa.array(ambiguous)], names=["doc_id", "lang_pred", "score", "ambiguous"])

    return source.mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")


def accepted(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, unchanged, whose language is told: neither ``und`` nor ambiguous. One scan, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pred, _, ambiguous = label(batch.column(text_col), model)
            yield batch.filter(pa.array((pred != "und") & ~ambiguous))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are not learned from: crc32 of the id as text leaves 1 when divided by 3; a null id counts as empty."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1
