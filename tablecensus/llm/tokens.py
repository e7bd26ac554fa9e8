"""Token counts of a word-end BPE by rank-synchronous merging of ragged numpy arrays.

All distinct pre-tokens of a batch lie in one array of symbol ids. Every step looks up the rank of
each adjacent pair, finds the lowest rank of each sequence, and merges that pair everywhere in its
sequence at once; sequences without a pair drop out. What remains are the tokens.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

#: Distinct pre-tokens that a task remembers; beyond that it starts anew (results do not depend on it).
REMEMBERED = 400_000
BATCH = 20_000
#: Texts whose pre-tokens are in memory at once.
ROWS = 500


class WordBpe:
    """Merges of a tokenizer file: lower case, white space dropped, byte symbols, word ends."""

    def __init__(self, text: str):
        file = json.loads(text)
        model = file["model"]
        end = model["end_of_word_suffix"]
        ids = {symbol: i for i, symbol in enumerate(model["vocab"])}
        self.first = np.zeros(256, np.int64)  # of a byte inside a word, and at its end
        self.last = np.zeros(256, np.int64)
        for byte, symbol in enumerate(byte_symbols()):
            self.first[byte], self.last[byte] = ids[symbol], ids[symbol + end]
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        self.size = len(ids)
        keys = np.array([ids[a] * self.size + ids[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([ids[a + b] for a, b in merges], np.int64)
        self.special = [t["content"] for t in file["added_tokens"]]
        pattern = next(p["pattern"]["Regex"] for p in file["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split = regex.compile(pattern).findall
        self.known: dict[str, int] = {}
        self.library = Tokenizer.from_str(text)
        self.byte_of = {symbol: byte for byte, symbol in enumerate(byte_symbols())}

    def text_tokens(self, texts: list[str | None]) -> np.ndarray:
        parts = [self.pre_tokens(t) for t in texts]
        new = set().union(*[w for w, _ in parts]) - self.known.keys()
        if len(self.known) + len(new) > REMEMBERED:
            self.known, new = {}, set().union(*[w for w, _ in parts])
        words = sorted(new)
        for at in range(0, len(words), BATCH):
            part = words[at : at + BATCH]
            self.known.update(zip(part, self.counts(part).tolist(), strict=True))
        get = self.known.__getitem__
        return np.array([sum(map(get, w)) + s for w, s in parts], np.int64)

    def pre_tokens(self, text: str | None) -> tuple[list[str], int]:
        """Pre-tokens, and the number of special strings, which are tokens of their own."""
        if not text:
            return [], 0
        pieces, found = [text], 0
        if any(s in text for s in self.special):
            pieces = regex.split("|".join(map(regex.escape, self.special)), text)
            found = len(pieces) - 1
        words: list[str] = []
        for piece in pieces:
            if piece.isascii() or all(unicodedata.category(c) != "Cn" for c in set(piece)):
                words += self.split(lower(unicodedata.normalize("NFC", piece)))
            else:  # characters newer than Python's tables: the library knows their class
                plain = self.library.normalizer.normalize_str(piece)
                found_words = self.library.pre_tokenizer.pre_tokenize_str(plain)
                words += [bytes(self.byte_of[c] for c in w).decode() for w, _ in found_words]
        return words, found

    def counts(self, words: list[str]) -> np.ndarray:
        """Tokens of each word."""
        raw = [w.encode() for w in words]
        n = np.array([len(b) for b in raw], np.int64)
        owner = np.repeat(np.arange(len(raw)), n)
        data = np.frombuffer(b"".join(raw), np.uint8)
        symbol = self.first[data]
        ends = np.cumsum(n)[n > 0] - 1
        symbol[ends] = self.last[data[ends]]
        out = n.copy()
        none = np.int64(len(self.keys))
        while len(symbol) > 1:
            pair = symbol[:-1] * self.size + symbol[1:]
            place = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            rank = np.where((self.keys[place] == pair) & (owner[:-1] == owner[1:]), self.ranks[place], none)
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            least = np.minimum.reduceat(np.r_[rank, none], starts)
            live = np.repeat(least < none, np.diff(np.r_[starts, len(owner)]))
            hit = (rank == np.repeat(least, np.diff(np.r_[starts, len(owner)]))[:-1]) & (rank < none)
            # Of overlapping equal pairs (a a a) every second one merges, from the left.
            run = np.flatnonzero(hit)
            if len(run):
                fresh = np.r_[True, np.diff(run) > 1]
                begin = np.maximum.accumulate(np.where(fresh, np.arange(len(run)), 0))
                run = run[(np.arange(len(run)) - begin) % 2 == 0]
            symbol[run] = self.merged[rank[run]]
            gone = np.zeros(len(symbol), bool)
            gone[run + 1] = True
            out -= np.bincount(owner[run], minlength=len(out))
            stay = live & ~gone
            symbol, owner = symbol[stay], owner[stay]
        return out


def lower(text: str) -> str:
    """Lower case of each character by itself (no final sigma)."""
    return text.lower() if "Σ" not in text else "σ".join(p.lower() for p in text.split("Σ"))


def byte_symbols() -> list[str]:
    """The printable character of each byte: itself where visible, else the next free one from 256."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(free)) for b in range(256)]


def token_counts(docs: DataFrame, tokenizer_json: str, limit: int = 2048) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit.

    ``tokenizer_json`` is the text of the tokenizer file. Null and empty texts have no bytes and no
    tokens; special strings inside a text are one token each. Repeated rows are counted each for
    itself, other columns are ignored, an empty table gives an empty result.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBpe(tokenizer_json)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                texts = part.column(1).to_pylist()
                n = bpe.text_tokens(texts)
                size = [len(t.encode()) if t else 0 for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return narrow.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
