"""Document quality by a linear-chain conditional random field over lines.

Every line has a label, good or bad.  Its evidence is what its own characters and words and those of the lines beside it
look like; neighbouring labels are tied by learnt transitions.  Forward-backward gives each line's marginal of being
good, and their mean, weighted by the lines' lengths, is the document's score.  The lines that it learns from have
their document's label.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressglass.llm.common import bounded_batches
from pressglass.llm.words import mixed, word_hashes

#: Labelled documents to learn from at most: those of the smallest hashes of their ids.
SAMPLE = 4_000
#: Lines of them to learn from at most: those of the smallest hashes, over whole runs of RUN lines. Scoring takes all lines.
SAMPLE_LINES, RUN = 400_000, 50
_KINDS = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "stop": b".,;:?'\"()-", "shout": b"!", "bar": b"|", "sign": b"#$%&*+/<=>@[\\]^_`{}~", "space": b" \t", "wide": bytes(range(0x80, 0x100))}
_TABLES = {k: np.isin(np.arange(256), list(v)) for k, v in _KINDS.items()}
N_OWN = len(_KINDS) + 5
N_FEATURES = 3 * N_OWN + 3


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines that aren't blank (a text without one has one empty line): the matrix (float32), the lines'
    lengths in bytes, and n + 1 offsets of the texts in them."""
    lines, rows = [], [0]
    for t in texts:
        own = [x for x in t.split("\n") if x.strip()] or [""]
        lines += own
        rows.append(len(lines))
    data = np.frombuffer("\n".join([*lines, ""]).encode("utf-8", "surrogatepass"), np.uint8)
    ends = np.flatnonzero(data == 10)
    begins = np.append(0, ends[:-1] + 1)
    size = (ends - begins).astype(np.float64)
    per = np.maximum(size, 1)
    columns = []
    for table in _TABLES.values():
        sums = np.append(0, np.cumsum(table[data], dtype=np.int32))
        columns.append((sums[ends] - sums[begins]) / per)
    hashes, words, _, _ = word_hashes(lines, lower=False)
    n = np.diff(words)
    line = np.repeat(np.arange(len(lines)), n)
    order = np.lexsort((hashes, line))
    h, at = hashes[order], line[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (at[1:] != at[:-1])
    distinct = np.bincount(at[new], minlength=len(lines))
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (line[1:] == line[:-1])
    n1 = np.maximum(n, 1)
    upper, lower = columns[0], columns[1]
    columns += [distinct / n1, np.bincount(line, again, len(lines)) / n1, np.minimum(size / n1, 40) / 10, np.log1p(size) / 5, upper / np.maximum(upper + lower, 1e-9)]
    own = np.stack(columns, 1).astype(np.float32)
    rows = np.array(rows)
    first, last = np.zeros(len(lines), bool), np.zeros(len(lines), bool)
    first[rows[:-1]], last[rows[1:] - 1] = True, True
    before, behind = np.roll(own, 1, 0), np.roll(own, -1, 0)
    before[first], behind[last] = 0, 0
    return np.hstack([own, before, behind, first[:, None], last[:, None], np.ones((len(lines), 1))]).astype(np.float32), size, rows


def _log_sum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


def marginals(score: np.ndarray, live: np.ndarray, pull: np.ndarray, pairs: bool = False):
    """Forward-backward on padded chains. score: evidence for good, chains x places; live: places that exist (a prefix
    of each chain); pull: 2 x 2 log transitions.  Returns P(good) per place, the chains' log partition sums and,
    with pairs, the expected transitions."""
    n, length = score.shape
    fa, fb = np.zeros((length, n)), np.zeros((length, n))  # log forward: bad, good
    fb[0] = score[:, 0]
    for i in range(1, length):
        bad = _log_sum(fa[i - 1] + pull[0, 0], fb[i - 1] + pull[1, 0])
        good = _log_sum(fa[i - 1] + pull[0, 1], fb[i - 1] + pull[1, 1]) + score[:, i]
        fa[i], fb[i] = np.where(live[:, i], bad, fa[i - 1]), np.where(live[:, i], good, fb[i - 1])
    total = _log_sum(fa[-1], fb[-1])
    ba, bb = np.zeros((length, n)), np.zeros((length, n))
    for i in range(length - 2, -1, -1):
        good = bb[i + 1] + score[:, i + 1]
        bad_, good_ = _log_sum(pull[0, 0] + ba[i + 1], pull[0, 1] + good), _log_sum(pull[1, 0] + ba[i + 1], pull[1, 1] + good)
        ba[i], bb[i] = np.where(live[:, i + 1], bad_, 0), np.where(live[:, i + 1], good_, 0)
    p = np.exp(fb + bb - total).T
    if not pairs:
        return np.clip(p, 0, 1), total, None
    expected = np.zeros((2, 2))
    on = live[:, 1:].T
    ahead = (ba[1:], bb[1:] + score[:, 1:].T)
    for a, f in enumerate((fa[:-1], fb[:-1])):
        for b in range(2):
            expected[a, b] = np.exp(np.where(on, f + pull[a, b] + ahead[b] - total, -np.inf)).sum()
    return np.clip(p, 0, 1), total, expected


def _padded(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.diff(rows)
    live = np.arange(n.max()) < n[:, None]
    out = np.zeros(live.shape)
    out[live] = values
    return out, live


class LineField:
    """weights (features scaled by mean and spread), pull (2 x 2); without training, scores are 0.5."""

    def __init__(self):
        self.mean, self.spread = np.zeros(N_FEATURES, np.float32), np.ones(N_FEATURES, np.float32)
        self.weights, self.pull = np.zeros(N_FEATURES), np.zeros((2, 2))

    def fit(self, features: np.ndarray, rows: np.ndarray, labels: np.ndarray, steps: int = 250, ridge: float = 1e-3) -> LineField:
        """Penalised likelihood by Adam; chains are cut into pieces of RUN lines."""
        self.mean, self.spread = features.mean(0), features.std(0) + 1e-3
        self.mean[-1], self.spread[-1] = 0, 1
        x = (features - self.mean) / self.spread
        cuts = np.unique(np.concatenate([np.arange(a, b, RUN) for a, b in zip(rows, rows[1:], strict=False)] + [rows[-1:]]))
        y = np.repeat(labels, np.diff(rows)).astype(float)
        truth, live = _padded(y, cuts)
        both = live[:, 1:]
        seen = np.array([[(both & (truth[:, :-1] == a) & (truth[:, 1:] == b)).sum() for b in (0, 1)] for a in (0, 1)])
        theta = np.zeros(N_FEATURES + 4)
        m, v, n = np.zeros_like(theta), np.zeros_like(theta), len(y)
        for t in range(1, steps + 1):
            score, _ = _padded(x @ theta[:-4], cuts)
            p, _, expected = marginals(score, live, theta[-4:].reshape(2, 2), True)
            slope = np.append(x.T @ (y - p[live]), (seen - expected).ravel()) / n - ridge * theta
            m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
            theta += 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        self.weights, self.pull = theta[:-4], theta[-4:].reshape(2, 2)
        return self

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Each text's score, and its number of lines."""
        features, size, rows = line_features(texts)
        own = ((features - self.mean) / self.spread) @ self.weights
        n = np.diff(rows)
        out = np.zeros(len(texts))
        order = np.argsort(n)
        i = 0
        while i < len(order):  # chains of like length together
            j = int(np.searchsorted(n[order], 1.5 * n[order[i]] + 8, "right"))
            some = order[i:j]
            places = np.concatenate([np.arange(rows[k], rows[k + 1]) for k in some])
            at = np.append(0, np.cumsum(n[some]))
            score, live = _padded(own[places], at)
            p, _, _ = marginals(score, live, self.pull)
            weight, _ = _padded(size[places] + 1, at)
            out[some] = (p * weight).sum(1) / weight.sum(1)
            i = j
        return np.round(out, 12), n


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, sample_lines: int = SAMPLE_LINES) -> LineField:
    """Learns from at most `sample` labelled documents and `sample_lines` of their lines; labels: id and 0/1.

    Both bounds are on rows, so the driver gets sample_lines * N_FEATURES numbers at most, whatever the texts' lengths.  What is
    taken is fixed by hashes of ids and run numbers (then by label and features): the order in which tasks end doesn't
    matter, nor do repeated ids.  With one label only, or none, all scores are 0.5.
    """
    bounded_batches(docs.sparkSession)
    chosen = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("id"), "id", "label").limit(sample)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "id")
    rows = rows.select("label", F.xxhash64("id").alias("key"), "text")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            features, _, at = line_features(batch.column("text").to_pylist())
            out = []
            for label, key, a, b in zip(batch.column("label").to_pylist(), batch.column("key").to_numpy().view(np.uint64), at, at[1:], strict=False):
                begins = np.arange(a, b, RUN)
                hashes = mixed(key + np.arange(len(begins)).astype(np.uint64)).view(np.int64).tolist()
                out += [(label, h, features[i : min(b, i + RUN)].tobytes()) for h, i in zip(hashes, begins.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 3, (pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["label", "hash", "features"])

    runs = rows.mapInArrow(each, "label int, hash long, features binary").orderBy("hash", "label", "features").limit(max(1, sample_lines // RUN))
    got = sorted((r.label, bytes(r.features)) for r in runs.select("label", "features").collect())
    field = LineField()
    if len({label for label, _ in got}) < 2:
        return field
    parts = [np.frombuffer(f, np.float32).reshape(-1, N_FEATURES) for _, f in got]
    return field.fit(np.concatenate(parts), np.cumsum([0, *map(len, parts)]), np.array([label for label, _ in got]))


def score(docs: DataFrame, field: LineField, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, names_out: tuple[str, str] = ("score", "n_lines")) -> DataFrame:
    """One row per row of docs: id (and the columns in keep), score, n_lines. Null and empty texts are one empty line.

    names_out: other names for the last two, where keep has columns of these names.
    """
    bounded_batches(docs.sparkSession)
    kept = keep or [id_col]
    names = [f"c{i}" for i in range(len(kept))]
    read = docs.select(*[F.col(c).alias(n) for c, n in zip(kept, names, strict=True)], F.coalesce(F.col(text_col), F.lit("")).alias("text_"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value, n = field.score(batch.column("text_").to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(value), pa.array(n, pa.int64())], names=[*names, "score", "n_lines"])

    kinds = ", ".join(f"{n} {docs.schema[c].dataType.simpleString()}" for c, n in zip(kept, names, strict=True))
    return read.mapInArrow(each, f"{kinds}, score double, n_lines long").toDF(*kept, *names_out)
