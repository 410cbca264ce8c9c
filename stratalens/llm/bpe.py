"""BPE encoding and decoding by batched numpy merge rounds."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, slices, small_batches

#: Code points of Unicode's property White_Space.
WHITE_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Bytes that the byte alphabet shows as themselves, as ranges.
SHOWN_BYTES = ((33, 126), (161, 172), (174, 255))
#: A lone surrogate marks special tokens among words.
MARK = "\ud800"


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: itself if printable, else the next free one from 256."""
    shown = {b for low, high in SHOWN_BYTES for b in range(low, high + 1)}
    free = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(free)) for b in range(256)]


class WordBpe:
    """A BPE vocabulary with word ends: words of a text, ids of words, tokens of ids.

    ``path`` is a tokenizer file of the public ``tokenizers`` library whose
    normaliser is NFC, white space, lower case, whose splitter keeps the matches
    of one pattern, and whose model marks the end of a word.
    """

    #: Words whose ids are kept between batches, at most.
    KNOWN = 200_000

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        size = max([*vocab.values(), *added.values()]) + 1
        tokens = np.full(size, "", dtype=object)
        for token, i in (*vocab.items(), *added.items()):
            tokens[i] = token
        self.tokens, self.added = tokens, added
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(pattern.replace(r"\s", WHITE_SPACE))
        end = model["end_of_word_suffix"]
        letters = byte_alphabet()
        self.inner = np.array([vocab[c] for c in letters], dtype=np.int64)
        self.last = np.array([vocab[c + end] for c in letters], dtype=np.int64)
        # sorted keys of the pairs that merge, with their rank and the product
        self.base = size
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        left, right = (np.array([vocab[p[k]] for p in pairs], dtype=np.int64) for k in (0, 1))
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        keys = left * size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        # in a list whose products appear before their use, a merge never enables one of lower rank
        first = np.full(size, -1, dtype=np.int64)
        first[made] = np.arange(len(pairs))
        self.monotone = bool(np.all(np.maximum(first[left], first[right]) < np.arange(len(pairs))))
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.starts = np.zeros(1, dtype=np.int64)
        self.flat = np.zeros(0, dtype=np.int32)

    def split(self, text: str) -> list[str]:
        """The words of a text, normalised; a special token is a word of its own, marked by what no text can hold."""
        if self.special is not None and "<|" in text:
            parts = self.special.split(text)
            return [w for i, p in enumerate(parts) for w in ([MARK + p] if i % 2 else self.plain(p))]
        return self.plain(text)

    def plain(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # str.lower looks at what follows a capital sigma; lowering by character does not
                text = text.replace("Σ", "σ")
        return self.words.findall(text.lower())

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of non-empty words: one flat array, and where each word begins in it, with the end.

        All symbols of all words lie in one array. Each round looks up every
        adjacent pair in the sorted keys, takes each word's lowest rank, and joins
        the places that have it, from the left.
        """
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        word = np.repeat(np.arange(len(words)), sizes)
        ends = np.cumsum(sizes) - 1
        symbols = self.inner[raw]
        symbols[ends] = self.last[raw[ends]]
        done_ids: list[np.ndarray] = []
        done_word: list[np.ndarray] = []
        never = len(self.keys)
        while len(symbols):
            pair = np.full(len(symbols), -1, dtype=np.int64)
            pair[:-1] = np.where(word[:-1] == word[1:], symbols[:-1] * self.base + symbols[1:], -1)
            at = np.minimum(np.searchsorted(self.keys, pair), never - 1)
            rank = np.where(self.keys[at] == pair, self.ranks[at], never)
            begins = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            lowest = np.minimum.reduceat(rank, begins)
            span = np.diff(np.r_[begins, len(symbols)])
            spread = np.repeat(lowest, span)
            live = spread < never
            if not live.all():  # words with nothing left to merge leave the array
                done_ids.append(symbols[~live])
                done_word.append(word[~live])
                symbols, word, rank, at, spread = symbols[live], word[live], rank[live], at[live], spread[live]
                if not len(symbols):
                    break
            hit = rank == spread
            places = np.flatnonzero(hit)
            if self.monotone:  # in a run of overlapping places every other one merges
                run = np.r_[True, np.diff(places) > 1]
                since = places - places[np.maximum.accumulate(np.where(run, np.arange(len(places)), 0))]
                places = places[since % 2 == 0]
            else:
                places = places[np.r_[True, word[places][1:] != word[places][:-1]]]
            symbols[places] = self.made[at[places]]
            stay = np.ones(len(symbols), dtype=bool)
            stay[places + 1] = False
            symbols, word = symbols[stay], word[stay]
        ids = np.concatenate(done_ids) if done_ids else np.zeros(0, np.int64)
        word = np.concatenate(done_word) if done_word else np.zeros(0, np.int64)
        order = np.argsort(word, kind="stable")
        counts = np.bincount(word, minlength=len(words))
        return ids[order].astype(np.int32), np.r_[0, np.cumsum(counts)]

    def learn(self, new: list[str]) -> None:
        """Encode words not met before and append them to the table."""
        plain = [w for w in new if w[0] != MARK]
        special = [w for w in new if w[0] == MARK]
        ids, starts = self.merge([w.encode() for w in plain])
        more = np.array([self.added[w[1:]] for w in special], dtype=np.int32)
        for w in (*plain, *special):
            self.index[w] = len(self.index)
        n = len(self.flat)
        self.flat = np.concatenate([self.flat, ids, more])
        tail = n + len(ids) + np.arange(1, len(special) + 1)
        self.starts = np.concatenate([self.starts, n + starts[1:], tail])

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one flat array, and the offsets of the texts in it."""
        words = [self.split(t) for t in texts]
        flat = [w for ws in words for w in ws]
        new = set(flat).difference(self.index)
        if len(self.index) + len(new) > self.KNOWN:
            self.forget()
            new = set(flat)
        if new:
            self.learn(sorted(new))
        which = np.fromiter(map(self.index.__getitem__, flat), np.int64, len(flat))
        begin = self.starts[which]
        sizes = self.starts[which + 1] - begin
        before = np.cumsum(sizes) - sizes
        total = int(sizes.sum())
        ids = self.flat[np.repeat(begin - before, sizes) + np.arange(total)] if total else np.zeros(0, np.int32)
        ends = np.r_[0, np.cumsum(sizes)]
        bounds = np.r_[0, np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))]
        return ids, ends[bounds]

    def decode_batch(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The tokens of each text, joined by one space, specials kept (no decoder is set in such a file)."""
        tokens = self.tokens[ids].tolist()
        return [" ".join(tokens[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    """The vocabulary, once for each Python worker."""
    return WordBpe(path)


def bpe_encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode whole texts and decode the ids again.

    Returns per input row ``id_col`` (long), ``ids`` (array of int) and ``decoded``
    (string). Null and empty text: no ids, empty string. Texts of any length are
    processed whole; a slice of about 1 MB of text, or one longer text, is in
    memory at a time. Rows are independent: no shuffle, repeated rows give
    repeated results, an empty table an empty result. ``path`` is a file that
    every executor can read. Other input columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in slices(batches, "text", 1 << 20):
            ids, offsets = bpe.encode_batch([t or "" for t in batch.column("text").to_pylist()])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), lists, pa.array(bpe.decode_batch(ids, offsets), pa.string())], names=["id", "ids", "decoded"])
        bpe.forget()
        give_back()

    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return small_batches(rows).mapInArrow(run, "id long, ids array<int>, decoded string").withColumnRenamed("id", id_col)
