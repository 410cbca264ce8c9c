"""Language identification by a linear-chain conditional random field over words."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_remainder, give_back, slices, small_batches

LETTERS = re.compile(r"[^\W\d_]+")
#: Features are hashed to so many weights a label.
BUCKETS = 1 << 18
_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters; runs that hold number signs alone are none."""
    if not text:
        return []
    found = LETTERS.findall(text.lower())
    return found if text.isascii() else [w for w in found if any(map(str.isalpha, w))]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX[1])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX[2])
    return (x ^ (x >> np.uint64(31))) & np.uint64(BUCKETS - 1)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of words: which word, which bucket.

    Character n-grams of one to three with word bounds, affixes of three and four
    letters, and the word itself as a lexicon entry, for all words at once: the
    code points lie in one array, and n-grams are sums of shifted copies.
    """
    with np.errstate(over="ignore"):
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
        flat = np.frombuffer(("\x02" + "\x03\x02".join(words) + "\x03").encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        word = np.repeat(np.arange(len(words)), sizes)
        starts = np.cumsum(sizes) - sizes
        at = np.arange(len(flat)) - starts[word]
        left = sizes[word] - at
        step = np.uint64(_MIX[0])
        which, hashes = [], []

        def add(rows: np.ndarray, h: np.ndarray, kind: int) -> None:
            which.append(rows)
            hashes.append(_mixed((h + np.uint64(kind)) * step))

        gram = flat.copy()
        inner = (at > 0) & (left > 1)
        add(word[inner], gram[inner], 1)
        for n in (2, 3):
            gram = gram[:-1] * np.uint64(0x10001) * step + flat[n - 1 :]
            ok = left[: len(gram)] >= n
            add(word[: len(gram)][ok], gram[ok], n)
        power = np.cumprod(np.full(int(sizes.max()), step, dtype=np.uint64))
        term = flat * power[at]
        upto = np.cumsum(term)
        before = upto[starts] - term[starts]
        ends = starts + sizes - 1
        every = np.arange(len(words))
        for n in (3, 4):
            ok = sizes >= n + 2
            add(every[ok], upto[starts[ok] + n] - before[ok], 10 + n)
            tail = np.zeros(int(ok.sum()), dtype=np.uint64)
            for k in range(n, 0, -1):
                tail = tail * step + flat[ends[ok] - k]
            add(every[ok], tail, 20 + n)
        add(every, upto[ends] - before, 30)
    return np.concatenate(which), np.concatenate(hashes).astype(np.int64)


def emissions(words: list[str], weights: np.ndarray) -> np.ndarray:
    """Score of each label for each word."""
    out = np.empty((len(words), len(weights)))
    for at in range(0, len(words), 20_000):  # features of so many words at a time are held
        part = words[at : at + 20_000]
        which, feats = features(part)
        for k in range(len(weights)):
            out[at : at + len(part), k] = np.bincount(which, weights=weights[k][feats], minlength=len(part))
    return out


def marginals(scores: np.ndarray, lengths: np.ndarray, trans: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Posterior of each label at each word, by scaled forward-backward over many sequences.

    ``scores``: words of all sequences, one sequence after the other. All
    sequences advance together; those that have ended leave the front, since the
    longest come first.
    """
    k = scores.shape[1]
    order = np.argsort(-lengths, kind="stable")
    n = lengths[order]
    begin = (np.cumsum(lengths) - lengths)[order]
    emit = np.exp(scores - scores.max(axis=1, keepdims=True))
    move = np.exp(trans - trans.max())
    first = np.exp(start - start.max())
    alpha = np.empty_like(emit)
    steps = int(n[0]) if len(n) else 0
    live = np.searchsorted(-n, -np.arange(steps), side="left")  # how many sequences are longer than t
    now = np.zeros((0, k))
    for t in range(steps):
        rows = begin[: live[t]] + t
        now = (first * emit[rows]) if t == 0 else (now[: live[t]] @ move) * emit[rows]
        now /= now.sum(axis=1, keepdims=True)
        alpha[rows] = now
    post = alpha
    beta = np.zeros((0, k))
    for t in range(steps - 1, -1, -1):
        rows = begin[: live[t]] + t
        m = len(beta)
        if t < steps - 1 and m:
            back = (beta * emit[begin[:m] + t + 1]) @ move.T
            back /= back.sum(axis=1, keepdims=True)
        else:
            back = beta
        beta = np.concatenate([back, np.full((live[t] - m, k), 1.0 / k)])
        p = alpha[rows] * beta
        post[rows] = p / p.sum(axis=1, keepdims=True)
    return post


@dataclass
class Crf:
    """Labels with their feature weights (float32, a row each), transitions and starts."""

    labels: list[str]
    weights: np.ndarray
    trans: np.ndarray
    start: np.ndarray
    known: dict[str, int] = field(default_factory=dict)
    table: np.ndarray | None = None

    #: Words whose scores are kept between batches, at most.
    KNOWN = 150_000

    def forget(self) -> None:
        self.known, self.table = {}, None
        give_back()

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}, "table": None}

    def scores(self, flat: list[str]) -> np.ndarray:
        new = set(flat).difference(self.known)
        if len(self.known) + len(new) > self.KNOWN:
            self.known, self.table = {}, None
            new = set(flat)
        if new:
            added = sorted(new)
            self.known.update(zip(added, range(len(self.known), len(self.known) + len(added)), strict=True))
            more = emissions(added, self.weights)
            self.table = more if self.table is None else np.concatenate([self.table, more])
        return self.table[np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))]

    def label(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[int]]:
        """The posteriors of the words of each text, and how many words it has."""
        words = [words_of(t) for t in texts]
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        flat = [w for ws in words for w in ws]
        if not flat or not self.labels:
            return [np.zeros((0, len(self.labels)))] * len(texts), lengths.tolist()
        post = marginals(self.scores(flat), lengths[lengths > 0], self.trans, self.start)
        ends = np.cumsum(lengths)
        return [post[e - n : e] for e, n in zip(ends, lengths, strict=True)], lengths.tolist()

    def decide(self, texts: list[str | None]) -> tuple[list[str], list[float], list[list[dict]]]:
        """Label, score and runs of equally labelled words of each text."""
        names, scores, runs = [], [], []
        for post, n in zip(*self.label(texts), strict=True):
            if not n or not self.labels:
                names.append("und")
                scores.append(0.0)
                runs.append([])
                continue
            mean = post.mean(axis=0)
            best = int(mean.argmax())
            names.append(self.labels[best])
            scores.append(float(min(1.0, mean[best])))
            each = post.argmax(axis=1)
            cut = np.flatnonzero(np.r_[True, each[1:] != each[:-1], True])
            runs.append([{"lang": self.labels[each[a]], "words": int(b - a)} for a, b in zip(cut[:-1], cut[1:], strict=True)])
        return names, scores, runs


def fit(sequences: list[tuple[list[str], list[int]]], labels: list[str], rounds: int = 40, decay: float = 1e-6) -> Crf:
    """Maximise the conditional likelihood of labelled word sequences by Adagrad.

    Sequences have any length; gradients come from forward-backward.
    """
    k = len(labels)
    weights, trans, start = np.zeros((k, BUCKETS)), np.zeros((k, k)), np.zeros(k)
    if sequences and k > 1:
        flat = [w for ws, _ in sequences for w in ws]
        gold = np.array([y for _, ys in sequences for y in ys])
        lengths = np.array([len(ws) for ws, _ in sequences])
        names = sorted(set(flat))
        at = {w: i for i, w in enumerate(names)}
        ids = np.fromiter(map(at.__getitem__, flat), np.int64, len(flat))
        which, feats = features(names)
        ends = np.cumsum(lengths)
        begins = ends - lengths
        inner = np.ones(len(flat), dtype=bool)
        inner[begins] = False
        follow = np.flatnonzero(inner)
        truth = np.zeros((k, k))
        np.add.at(truth, (gold[follow - 1], gold[follow]), 1)
        firsts = np.bincount(gold[begins], minlength=k)
        seen = [np.full((k, BUCKETS), 1e-8), np.full((k, k), 1e-8), np.full(k, 1e-8)]
        target = np.eye(k)[gold]
        for _ in range(rounds):
            emit = np.stack([np.bincount(which, weights=weights[j][feats], minlength=len(names)) for j in range(k)], axis=1)
            scores = emit[ids]
            post = marginals(scores, lengths, trans, start)
            # expected transitions from neighbours' posteriors, through the same scaled messages
            pair = _pairs(scores, lengths, trans, start)
            diff = target - post
            by_word = np.stack([np.bincount(ids, weights=diff[:, j], minlength=len(names)) for j in range(k)])
            grads = [np.stack([np.bincount(feats, weights=by_word[j][which], minlength=BUCKETS) for j in range(k)]), truth - pair, firsts - post[begins].sum(axis=0)]
            for value, grad, g2 in zip((weights, trans, start), grads, seen, strict=True):
                grad = grad - decay * len(flat) * value
                g2 += grad * grad
                value += 0.2 * grad / np.sqrt(g2)
    return Crf(labels, weights.astype(np.float32), trans, start)


def _pairs(scores: np.ndarray, lengths: np.ndarray, trans: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Expected number of transitions between labels, over all sequences."""
    k = scores.shape[1]
    order = np.argsort(-lengths, kind="stable")
    n = lengths[order]
    begin = (np.cumsum(lengths) - lengths)[order]
    emit = np.exp(scores - scores.max(axis=1, keepdims=True))
    move, first = np.exp(trans - trans.max()), np.exp(start - start.max())
    live = np.searchsorted(-n, -np.arange(int(n[0])), side="left")
    alphas = []
    now = np.zeros((0, k))
    for t in range(int(n[0])):
        rows = begin[: live[t]] + t
        now = (first * emit[rows]) if t == 0 else (now[: live[t]] @ move) * emit[rows]
        now = now / now.sum(axis=1, keepdims=True)
        alphas.append(now)
    total = np.zeros((k, k))
    beta = np.full((live[-1], k), 1.0)
    for t in range(int(n[0]) - 2, -1, -1):
        ahead = beta * emit[begin[: live[t + 1]] + t + 1]
        both = alphas[t][: live[t + 1], :, None] * move[None] * ahead[:, None, :]
        total += (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        back = ahead @ move.T
        back /= back.sum(axis=1, keepdims=True)
        beta = np.concatenate([back, np.full((live[t] - len(back), k), 1.0)])
    return total


def train(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", docs_per_label: int = 400, spans: int = 4, span_words: int = 20, fold: int = 5
) -> Crf:
    """Fit on a bounded sample of labelled rows outside fold 0.

    Bound: ``docs_per_label`` rows of each label, those of smallest id hash, and of
    each ``spans`` stretches of ``span_words`` words spread over the whole text.
    Stretches of different documents are chained by three, so that transitions
    between labels are learned too. Rows with null label or without words teach
    nothing. The driver holds labels x docs_per_label x spans stretches at most.
    """
    import zlib

    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{label_col}`").cast("string").alias("label"))
    rows = rows.where(F.col("label").isNotNull() & F.col("text").isNotNull() & (crc_remainder(F.col("id"), fold) != 0))
    counts = {r[0]: r[1] for r in rows.groupBy("label").agg(F.count("*")).collect()}
    if not counts:
        return Crf([], np.zeros((0, BUCKETS), np.float32), np.zeros((0, 0)), np.zeros(0))
    # a hash bound leaves about three times the rows wanted, so the exact choice sees a bounded number
    share = F.element_at(F.create_map(*[F.lit(x) for kv in ((k, min(1.0, 3.0 * docs_per_label / n)) for k, n in counts.items()) for x in kv]), F.col("label"))
    order = F.pmod(F.xxhash64(F.lit("crf"), "id"), F.lit(1 << 40))
    near = rows.withColumn("o", order).where(F.col("o") < share * F.lit(float(1 << 40)))
    first = near.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy("o", "id"))).where(F.col("r") <= docs_per_label)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            ids, labels, found = [], [], []
            for i, text, label in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                words = words_of(text)
                pieces = [words[a : a + span_words] for a in range(0, len(words), span_words)]
                for piece in pieces[:: max(1, -(-len(pieces) // spans))]:
                    ids.append(str(i))
                    labels.append(label)
                    found.append(piece)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(labels, pa.string()), pa.array(found, pa.list_(pa.string()))], names=["id", "label", "words"])

    got = first.select("id", "text", "label").mapInArrow(cut, "id string, label string, words array<string>").collect()
    labels = sorted({r.label for r in got})
    got.sort(key=lambda r: (zlib.crc32(f"{r.id} {' '.join(r.words)}".encode()), r.id, r.words))
    chained = []
    for i in range(0, len(got), 3):
        part = got[i : i + 3]
        chained.append(([w for r in part for w in r.words], [labels.index(r.label) for r in part for _ in r.words]))
    return fit(chained, labels)


def identify(df: DataFrame, model: Crf, id_col: str = "doc_id", text_col: str = "text", runs: bool = False) -> DataFrame:
    """Label whole texts: ``id_col`` (long), ``lang_pred``, ``score`` and, if asked for, ``runs``.

    ``lang_pred`` is the label of largest mean posterior over the text's words,
    ``score`` that mean; ``runs`` are the stretches of words of one label in order
    (code switches). Null text, text without a letter, or a model without labels:
    ``und``, 0, no runs. Rows are independent, without shuffle; repeated rows give
    repeated results; an empty table gives an empty result. Other columns are not read.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # labels x 2^18 weights: a fixed size
    schema = "id long, lang_pred string, score double" + (", runs array<struct<lang: string, words: int>>" if runs else "")
    kind = pa.list_(pa.struct([("lang", pa.string()), ("words", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            names, scores, found = shared.value.decide(batch.column("text").to_pylist())
            columns = [batch.column("id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(found, kind)] * runs, names=["id", "lang_pred", "score"] + ["runs"] * runs)
        shared.value.forget()

    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return small_batches(rows).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def keep_identified(df: DataFrame, model: Crf, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``df``, all columns whatever their names, whose text has a language with a score of ``least`` or more.

    Null and empty texts and those without a letter have none. Rows are independent
    and texts read whole; repeated rows stay or go together; an empty table gives an
    empty result.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col, 2 << 20):
            names, scores, _ = shared.value.decide(batch.column(text_col).to_pylist())
            yield batch.filter(pa.array([n != "und" and s >= least for n, s in zip(names, scores, strict=True)], pa.bool_()))
        shared.value.forget()

    return small_batches(df).mapInArrow(run, df.schema)
