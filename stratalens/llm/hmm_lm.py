"""Scoring texts by a hidden Markov language model over word classes."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_remainder, few_files, give_back, materialize, row_id, slices, small_batches

#: What is added to each count.
ADD = 0.1
#: Training cuts token sequences longer than this into stretches of so many, and reads so many more on each side.
STRETCH, LEAD = 256, 24
#: Stretches whose messages are in memory at a time.
AT_ONCE = 8192
#: Steps between two scalings of the messages of expected counts; in four steps these stay within single precision.
SCALED = 4
#: Steps between two scalings of the forward recursion of scores, in double precision.
APART = 8
#: Tokens whose posteriors are added up by class at a time, or one step's if these are more.
COUNTED = 16_384
#: Expected counts that go from task to task in one binary value.
PIECE = 4096


def tokens(text: str | None) -> list[bytes]:
    """Words of a text, A-Z lower-cased: for bytes, lower and split know ASCII alone."""
    return text.encode().lower().split() if text else []


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The :func:`tokens` of all texts in one flat binary array, and how many each text has, without an object for each."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, sizes = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    full = pc.not_equal(words, "")
    empty = np.flatnonzero(~full.to_numpy(zero_copy_only=False))  # at the ends of texts
    if len(empty):
        sizes -= np.bincount(np.searchsorted(np.cumsum(sizes), empty, side="right"), minlength=len(sizes))
        words = words.filter(full)
    return words.cast(pa.large_binary() if pa.types.is_large_string(words.type) else pa.binary()), sizes


def word_counts(docs: DataFrame, held: int = 48 << 20) -> DataFrame:
    """(word, c) over all texts of ``docs``; a task counts words of about ``held`` bytes, sends the counts on, and starts anew."""

    def counted(words: list[pa.Array]) -> pa.RecordBatch:
        found = pa.chunked_array(words).value_counts()
        return pa.RecordBatch.from_arrays([found.field("values").cast(pa.binary()), found.field("counts")], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: list[pa.Array] = []
        size = 0
        for batch in slices(batches, "text"):
            words.append(split_words(batch.column("text"))[0])
            size += words[-1].nbytes
            if size > held:
                yield counted(words)
                words, size = [], 0
        if size:
            yield counted(words)
        del words
        give_back()

    return small_batches(docs).select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


@dataclass
class Classes:
    """Words to classes: frequent words are classes of their own, others share one by their last letters.

    Class 0 is the end of a text. ``own`` frequent words follow, then ``rest`` classes.
    ``known`` words, which include the frequent ones, come with their counts.
    """

    known: dict[bytes, int]
    counts: np.ndarray
    own: int
    rest: int
    ends: int
    mass: np.ndarray

    def rest_class(self, word: bytes) -> int:
        return 1 + self.own + zlib.crc32(word[-3:]) % self.rest

    def number(self) -> int:
        return 1 + self.own + self.rest


class Endings(dict[bytes, int]):
    """Shared classes by the last letters of words, worked out once for each ending; it starts anew when it holds ``most``."""

    def __init__(self, classes: Classes, most: int = 100_000) -> None:
        super().__init__()
        self.classes, self.most = classes, most

    def __missing__(self, ending: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        found = self[ending] = self.classes.rest_class(ending)
        return found


def make_classes(counts: DataFrame, ends: int, own: int, rest: int, known: int, longest: int = 64) -> Classes:
    """Classes from the corpus counts. The driver gets ``known`` words of at most ``longest`` bytes and ``rest`` sums.

    Which words those are is read off a histogram of counts in 16 steps to each
    power of two: the lowest step above which at most ``known`` words lie. So no task
    sorts the vocabulary.
    """
    short = counts.where(F.octet_length("word") <= longest).withColumn("step", F.floor(F.log2("c") * 16).cast("int"))
    steps = sorted(((r.step, r.n) for r in short.groupBy("step").agg(F.count("*").alias("n")).collect()), reverse=True)
    above = [step for (step, _), total in zip(steps, np.cumsum([n for _, n in steps]), strict=True) if total <= known]
    if above:
        top = short.where(F.col("step") >= above[-1]).select("word", "c").toArrow()
        pairs = sorted(zip(top.column("c").to_pylist(), top.column("word").to_pylist(), strict=True), key=lambda x: (-x[0], x[1]))
    else:
        pairs = []
    names = [w for _, w in pairs]
    values = np.array([c for c, _ in pairs], dtype=np.float64)
    del pairs
    own = min(own, len(names))
    # same place as rest_class
    place = F.pmod(F.crc32(F.when(F.octet_length("word") > 3, F.expr("substring(word, octet_length(word) - 2, 3)")).otherwise(F.col("word"))), F.lit(rest)).cast("int").alias("place")
    sums = counts.groupBy(place).agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect()
    found = Classes(dict(zip(names, range(len(names)), strict=True)), values, own, rest, ends, np.zeros(1 + own + rest))
    found.mass[0] = ends + ADD
    found.mass[1 : 1 + own] = values[:own] + ADD
    # a shared class holds its words' counts and one unseen word; frequent words have left it
    share = found.mass[1 + own :]
    share += ADD
    for r in sums:
        share[r.place] += r.c + ADD * r.n
    for w, c in zip(names[:own], values[:own], strict=True):
        share[zlib.crc32(w[-3:]) % rest] -= c + ADD
    np.maximum(share, ADD, out=share)
    return found


def classify(docs: DataFrame, classes: Classes) -> DataFrame:
    """Each text as its class sequence, with what is known of its words.

    Per row: n_tokens, codes (classes as little-endian 16-bit numbers, the end
    included), known_sum (log10 of count plus 0.1, over known words), rest_sum (the
    same over those in shared classes, less log10 of the class mass of all words in
    shared classes), n_known, and rare: words whose counts are looked up elsewhere.
    """
    shared = docs.sparkSession.sparkContext.broadcast(classes)  # of a size bounded by its parameters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cl = shared.value
        known, shared_class = pa.array(list(cl.known), pa.binary()), Endings(cl).__getitem__

        def shared_classes(words: pa.Array) -> np.ndarray:
            ending = pc.binary_slice(words, -3).dictionary_encode()
            return np.fromiter(map(shared_class, ending.dictionary.to_pylist()), np.uint16, len(ending.dictionary))[ending.indices.to_numpy()]

        class_of = np.r_[np.arange(1, cl.own + 1).astype(np.uint16), shared_classes(known[cl.own :])]
        log_count = np.log10(cl.counts + ADD)
        log_mass = np.log10(cl.mass)
        is_rest = np.arange(cl.number()) > cl.own
        end_log = float(np.log10(cl.ends + ADD))
        for batch in slices(batches, "text"):
            words, sizes = split_words(batch.column("text"))
            texts = len(sizes)
            coded = words.dictionary_encode()  # each different word is looked up once
            which, different = coded.indices.to_numpy(), coded.dictionary.cast(pa.binary())
            at = pc.fill_null(pc.index_in(different, value_set=known), -1).to_numpy()
            own_code = class_of[at] if len(class_of) else np.zeros(len(at), np.uint16)
            own_code[at < 0] = shared_classes(different.filter(pa.array(at < 0)))
            own_log = np.zeros(len(at))
            own_log[at >= 0] = log_count[at[at >= 0]]
            codes, logs, seen = own_code[which], own_log[which], (at >= 0)[which]
            rare = np.flatnonzero(~seen)
            rare_words = words.take(pa.array(rare)).cast(pa.binary())
            owner = np.repeat(np.arange(texts), sizes)
            total = lambda values: np.bincount(owner, weights=values, minlength=texts).astype(float)
            known_sum = total(logs) + end_log
            in_rest = is_rest[codes]
            rest_sum = total(np.where(in_rest, logs - log_mass[codes], 0.0))
            bounds = np.cumsum(sizes)
            whole = np.insert(codes, bounds, 0).astype("<u2").tobytes()  # an end after each text
            stops = np.r_[0, 2 * np.cumsum(sizes + 1)]
            packed = pa.Array.from_buffers(pa.binary(), texts, [None, pa.py_buffer(stops.astype(np.int32).tobytes()), pa.py_buffer(whole)])
            each = np.bincount(owner[rare], minlength=texts)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(each)], pa.int32()), rare_words)
            arrays = [batch.column("row"), batch.column("id"), batch.column("held_out"), pa.array(sizes + 1), packed, pa.array(known_sum), pa.array(rest_sum), pa.array(total(seen).astype(np.int64) + (1 if cl.ends else 0)), lists]
            yield pa.RecordBatch.from_arrays(arrays, names=["row", "id", "held_out", "n_tokens", "codes", "known_sum", "rest_sum", "n_known", "rare"])

    return docs.mapInArrow(run, "row long, id long, held_out boolean, n_tokens long, codes binary, known_sum double, rest_sum double, n_known long, rare array<binary>")


def even_slices(batches: Iterable[pa.RecordBatch], column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """:func:`slices` that go on across batches: a small remainder takes nearly as many steps as a full slice."""
    held: list[pa.RecordBatch] = []
    size = 0
    for part in slices(batches, column, most_bytes // 16):
        more = pc.sum(pc.binary_length(part.column(column))).as_py() or 0
        if held and size + more > most_bytes:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(part)
        size += more
    if held:
        yield pa.concat_batches(held)


@dataclass
class Hmm:
    """Start, transition and emission probabilities (states x classes)."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def stretches(codes: list[bytes], times: list[int] | None = None) -> tuple[np.ndarray, ...]:
    """Sequences, which occur ``times`` times each, cut into stretches of STRETCH classes.

    All classes one after the other; of each stretch where it begins in them, its
    length, how many classes are read after it, whether it begins a text, and how often
    it occurs. LEAD classes more are read on each side, as far as the text goes, so that
    the messages that reach a stretch have forgotten where they began.
    """
    sizes = np.fromiter(map(len, codes), np.int64, len(codes)) // 2
    number = -(-sizes // STRETCH)
    own = STRETCH * (np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number))
    left = np.repeat(sizes, number) - own
    lengths = np.minimum(left, STRETCH)
    at = np.repeat(np.cumsum(sizes) - sizes, number) + own
    return np.frombuffer(b"".join(codes), dtype="<u2"), at, lengths, np.minimum(left - lengths, LEAD), own == 0, np.repeat(np.asarray(times or [1] * len(codes), np.float32), number)


class Room(dict[str, np.ndarray]):
    """Arrays by name that are used again for every slice: new ones cost page faults each time."""

    def take(self, name: str, size: int, dtype: type = np.float32) -> np.ndarray:
        if name not in self or self[name].size < size:
            self[name] = np.empty(size + size // 4, dtype)
        return self[name][:size]


def expected(
    hmm: Hmm, flat: np.ndarray, at: np.ndarray, lengths: np.ndarray, more: np.ndarray, heads: np.ndarray, times: np.ndarray, room: Room | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Baum-Welch: expected starts, transitions and emissions of stretches, by scaled forward-backward.

    Each token and each transition of a text counts once, times ``times``, and starts
    where a text starts. Texts of one stretch have exact counts. Later stretches begin
    LEAD tokens before from the chain's stationary distribution, and all but the last
    end without knowing what follows, ``more`` tokens away: forward messages are passed
    up to a stretch and through it, backward ones down to its end and through it.
    Arrays are states x stretches, so that every step runs along the stretches.

    Emissions are taken relative to the largest of each class, which leaves all
    expectations as they are and messages near 1; these are scaled at every
    ``SCALED``-th step. Those backwards begin in a stretch so that posteriors add up to
    ``times``. Posteriors are added up by class whenever some ``COUNTED`` tokens have
    theirs, while these are in a core's cache.
    """
    room = Room() if room is None else room
    k, c = hmm.emit.shape
    order = np.argsort(-(lengths + more), kind="stable")  # those with more are whole, so lengths descend, too
    at, lengths, more, heads, times = at[order], lengths[order], more[order], heads[order], times[order]
    steps, number = int(lengths[0]), len(at)
    live = np.searchsorted(-lengths, -np.arange(steps), side="left")
    begin = np.r_[0, np.cumsum(live)].tolist()
    live = [*live.tolist(), 0]
    beyond = [*np.searchsorted(-more, -np.arange(int(more[0])), side="left").tolist(), 0]  # stretches with more than so many
    emit = np.ascontiguousarray(hmm.emit / np.maximum(hmm.emit.max(axis=0), 1e-300), dtype=np.float32)
    move = hmm.move.astype(np.float32)
    back = np.ascontiguousarray(move.T)
    where, held = room.take("where", begin[-1], np.intp), room.take("held", k * begin[-1])
    emitted, moved = room.take("emitted", k * number), room.take("moved", k * number)

    def emissions(classes: np.ndarray) -> np.ndarray:
        return emit.take(classes, axis=1, mode="clip", out=emitted[: k * len(classes)].reshape(k, len(classes)))

    now = np.empty((k, number), dtype=np.float32)
    now[:, heads] = hmm.start.astype(np.float32)[:, None]
    later = np.flatnonzero(~heads)
    if len(later):
        before = np.repeat(np.linalg.matrix_power(hmm.move, 64).mean(axis=0).astype(np.float32)[:, None], len(later), axis=1)
        for t in range(LEAD):
            before *= emissions(flat.take(at[later] + (t - LEAD)))
            if t % SCALED == SCALED - 1:
                before /= before.sum(axis=0)
            before = back @ before
        now[:, later] = before
    scales = {}
    for t in range(steps):
        m, here = live[t], slice(begin[t], begin[t + 1])
        where[here] = flat[t:].take(at[:m], mode="clip")
        e = emissions(where[here])
        if t:
            now = np.matmul(back, now[:, :m], out=moved[: k * m].reshape(k, m))
        now = np.multiply(now, e, out=held[k * here.start : k * here.stop].reshape(k, m))
        if t % SCALED == SCALED - 1:
            scales[t] = 1 / now.sum(axis=0)
            now *= scales[t]
        ends = max(live[t + 1], beyond[0])
        if ends < m:
            times[ends:m] /= now[:, ends:].sum(axis=0)
    after = np.ones((k, 0), dtype=np.float32)  # emissions times backward messages of the tokens that follow
    for t in range(len(beyond) - 2, -1, -1):
        beta = np.ones((k, beyond[t]), dtype=np.float32)
        beta[:, : beyond[t + 1]] = move @ after
        if t % SCALED == SCALED - 1:
            beta /= beta.sum(axis=0)
        after = beta * emissions(flat.take(at[: beyond[t]] + (STRETCH + t)))
    if beyond[0]:
        after *= times[: beyond[0]] / (now[:, : beyond[0]] * (move @ after)).sum(axis=0)
    pairs = np.zeros((k, k), dtype=np.float64)
    emits = np.zeros((k, c))
    most = max(COUNTED, number)
    posterior = room.take("posterior", k * most).reshape(k, most)  # filled from the right, by tokens first .. last
    first = last = begin[-1]

    def count() -> None:
        for j in range(k):
            emits[j] += np.bincount(where[first:last], weights=posterior[j, most - (last - first) :], minlength=c)

    for t in range(steps - 1, -1, -1):
        m, here = live[t], slice(begin[t], begin[t + 1])
        alpha = held[k * here.start : k * here.stop].reshape(k, m)
        if t < steps - 1:
            after = emissions(where[begin[t + 1] : begin[t + 2]])
            after *= beta
            if t + 1 in scales:
                after *= scales[t + 1]
        goes_on = after.shape[1]
        beta = moved[: k * m].reshape(k, m)
        if goes_on:
            pairs += alpha[:, :goes_on] @ after.T
            np.matmul(move, after, out=beta[:, :goes_on])
        beta[:, goes_on:] = times[goes_on:m]
        if last - here.start > most:
            count()
            last = first
        first = here.start
        done = np.multiply(alpha, beta, out=posterior[:, most - (last - first) :][:, :m])
    count()
    return done[:, heads].sum(axis=1, dtype=np.float64), pairs * move, emits


def maximise(starts: np.ndarray, pairs: np.ndarray, emits: np.ndarray, unigram: np.ndarray, prior: float) -> Hmm:
    """Probabilities from expected counts, drawn towards the class frequencies by ``prior`` counts."""
    k = len(starts)
    emit = emits + prior * unigram
    move = pairs + prior / k
    start = starts + prior / k
    return Hmm(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=1, keepdims=True))


def log10_likelihood(hmm: Hmm, codes: list[bytes]) -> np.ndarray:
    """Log10 probability of whole class sequences, by the scaled forward recursion in double precision."""
    lengths = np.fromiter(map(len, codes), np.int64, len(codes)) // 2
    order = np.argsort(-lengths, kind="stable")
    n = lengths[order]
    flat = np.frombuffer(b"".join(codes), dtype="<u2")
    begin = (np.cumsum(lengths) - lengths)[order]
    emit, back = np.ascontiguousarray(hmm.emit), np.ascontiguousarray(hmm.move.T)  # states x texts, so that every step runs along the texts
    live = [*np.searchsorted(-n, -np.arange(n[0]), side="left").tolist(), 0]
    total = np.zeros(len(codes))
    now = hmm.start[:, None]
    for t in range(int(n[0])):
        m, after = live[t], live[t + 1]
        e = emit.take(flat[t:].take(begin[:m], mode="clip"), axis=1, mode="clip")
        now = now * e if t == 0 else np.multiply(back @ now[:, :m], e, out=e)
        since = 0 if t % APART == APART - 1 else after  # texts from here on are scaled
        if since < m:
            scale = now[:, since:].sum(axis=0)
            now[:, since:] /= scale
            total[since:m] += np.log10(scale)
    out = np.empty(len(codes))
    out[order] = total
    return out


def pieces(flat: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(at, sums): each ``PIECE`` numbers in bytes, and where they begin."""
    for at in range(0, len(flat), PIECE):
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([flat[at : at + PIECE].astype("<f8").tobytes()], pa.binary())], names=["at", "sums"])


def added(parts: pa.Table) -> pa.Table:
    """The pieces of one place, of all tasks, added up."""
    total = sum(np.frombuffer(x.as_buffer(), "<f8") for x in parts.column("sums"))
    return pa.table({"at": parts.column("at")[:1], "sums": pa.array([total.tobytes()], pa.binary())})


def train(coded: DataFrame, classes: Classes, states: int, rounds: int, prior: float, seed: int) -> Hmm:
    """Baum-Welch over all coded training texts, ``rounds`` times, from random emissions. A class is a 16-bit number.

    Each round adds up expected counts in every partition, sums them in Spark, and
    gives the driver states x classes sums. Texts of the same classes are worked on once
    and count as often as they occur.
    """
    if classes.number() > 1 << 16:
        raise ValueError(f"{classes.number()} classes: own and rest together must stay below 65536")
    unigram = classes.mass / classes.mass.sum()
    rng = np.random.default_rng(seed)
    c = classes.number()
    emit = unigram * rng.gamma(2.0, 0.5, size=(states, c))
    hmm = Hmm(np.full(states, 1 / states), np.full((states, states), 0.1 / states) + 0.9 * np.eye(states), emit / emit.sum(axis=1, keepdims=True))
    if not classes.ends:
        return hmm
    shapes = ((states,), (states, states), (states, c))
    # in a fixed order, since single precision depends on which texts stand together
    texts = materialize(coded.groupBy("codes").agg(F.count("*").alias("times")).sortWithinPartitions("codes"), "lm-texts")
    for _ in range(rounds):
        now = hmm

        def run(batches: Iterator[pa.RecordBatch], now: Hmm = now) -> Iterator[pa.RecordBatch]:
            sums, room = [np.zeros(s) for s in shapes], Room()
            for batch in even_slices(batches, "codes", 3 << 19):  # larger ones leave a core's cache
                flat, *cut = stretches(batch.column("codes").to_pylist(), batch.column("times").to_pylist())
                for at in range(0, len(cut[0]), AT_ONCE):
                    for total, more in zip(sums, expected(now, flat, *(x[at : at + AT_ONCE] for x in cut), room), strict=True):
                        total += more
            flat = np.concatenate([s.ravel() for s in sums])
            yield from pieces(flat)

        parts = few_files(texts, 2).mapInArrow(run, "at long, sums binary").groupBy("at").applyInArrow(added, "at long, sums binary").toArrow()
        flat = np.zeros(sum(int(np.prod(s)) for s in shapes))
        for at, sums in zip(parts.column("at").to_pylist(), parts.column("sums").to_pylist(), strict=True):
            more = np.frombuffer(sums, "<f8")
            flat[at : at + len(more)] = more
        cut = np.cumsum([int(np.prod(s)) for s in shapes])[:-1]
        hmm = maximise(*(x.reshape(s) for x, s in zip(np.split(flat, cut), shapes, strict=True)), unigram, prior)
    return hmm


def score(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    fold: int = 10,
    states: int = 8,
    own: int = 4096,
    rest: int = 1024,
    known: int = 100_000,
    rounds: int = 2,
    first_rounds: int = 25,
    prior: float = 20.0,
    seed: int = 5,
) -> DataFrame:
    """Base and model scores of every whole text, learned from the texts outside fold 0.

    The model draws a hidden state for each token from the state before, a word
    class from the state, and the word from its class: frequent words are classes
    of their own, others share classes in proportion to count plus 0.1. Counts
    cover all training texts. Counts of the ``known`` most frequent words (of 64
    bytes at most) go to every executor; those of all others are joined by word,
    where no word is frequent. ``score`` is log10 of the probability of the word and
    end sequence, summed over all state paths. Each of the ``first_rounds`` +
    ``rounds`` rounds of Baum-Welch covers all training texts.

    Returns per input row ``id_col``, held_out, n_tokens, n_known, train_tokens,
    base_score, score. Null and empty texts have the end token alone. Repeated rows
    count and are scored as often as they occur. Without training texts every
    token has base probability 1. An empty table gives an empty result; other
    columns are not read.
    """
    docs = df.select(row_id().alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"), (crc_remainder(F.col(f"`{id_col}`"), fold) == 0).alias("held_out"), F.col(f"`{text_col}`").cast("string").alias("text"))
    learn = docs.where(~F.col("held_out"))
    counts = materialize(word_counts(learn), "lm-counts", gathered=True)
    ends = learn.count()
    facts = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n, v = facts.n + ends, facts.v + (1 if ends else 0)
    classes = make_classes(counts, ends, own, rest, known)
    coded = materialize(classify(docs, classes), "lm-coded")
    hmm = train(coded.where(~F.col("held_out")).select("row", "codes"), classes, states, first_rounds + rounds, prior, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in even_slices(batches, "codes", 8 << 20):  # of many texts, as a step costs nearly the same for few
            got = pa.array(log10_likelihood(hmm, batch.column("codes").to_pylist()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "id", "held_out", "n_tokens", "known_sum", "rest_sum", "n_known")), got], names=["row", "id", "held_out", "n_tokens", "known_sum", "rest_sum", "n_known", "path"])

    scored = coded.drop("rare").mapInArrow(run, "row long, id long, held_out boolean, n_tokens long, known_sum double, rest_sum double, n_known long, path double")
    rare = coded.select("row", F.explode("rare").alias("word")).join(counts, "word", "left")
    rare = rare.groupBy("row").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + F.lit(ADD))).alias("rare_sum"), F.count("c").alias("rare_known"))
    both = scored.join(rare, "row", "left")
    extra = F.coalesce("rare_sum", F.lit(0.0))
    return both.select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("known_sum") + extra - F.col("n_tokens") * F.log10(F.lit(n + ADD * (v + 1)))).alias("base_score"),
        (F.col("path") + F.col("rest_sum") + extra).alias("score"),
    )
