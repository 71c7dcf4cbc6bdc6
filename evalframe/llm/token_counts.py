"""Token counts by rank-synchronous merging of ragged arrays.

The vocabulary and its ranks come from a SentencePiece BPE model with byte fallback; the
merging is done here. Texts are cut into pre-tokens where no piece of the vocabulary has the
two characters side by side, so no merge can cross the cut. All pre-tokens a batch has not
met before are held as one array of symbols with row starts. In every round each sequence
merges its lowest-rank pair (the leftmost of equals), all sequences at once, until no
sequence has a pair of the vocabulary left. What survives is counted; a character outside
the vocabulary counts as its UTF-8 bytes.

Nulls and odd input: a null text is empty and has 0 tokens. Strings like ``</s>`` inside a
text are ordinary text. Nothing is truncated: a very long text is counted whole, word by
word. Repeated rows are counted alike; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OVER_LIMIT = 4096
SPACE = "▁"
#: Counts of words that a worker keeps; beyond it the worker starts anew.
CACHED_WORDS = 500_000
#: Symbols merged together; longer input goes in several arrays.
MERGED_SYMBOLS = 2_000_000
_NONE = np.int64(2**62)
#: Characters whose words are held at once.
CHUNK_CHARS = 2_000_000
_WORD_END = re.compile("[^ ](?= )")
_BLANKS_THEN_TEXT = re.compile(" *[^ ]+| +")


class Pieces:
    """The merge table of one model: symbols are numbers, pairs of symbols have ranks."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        special = lambda i: model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)
        ids = [i for i in range(model.get_piece_size()) if not special(i)]
        ranked = sorted(ids, key=lambda i: (-model.get_score(i), i))
        self.rank = {model.id_to_piece(i): r for r, i in enumerate(ranked)}
        if any(SPACE in piece.lstrip(SPACE) for piece in self.rank):
            raise ValueError("a piece holds a blank after text, so texts can't be cut at blanks")
        self.symbol = {piece: n for n, piece in enumerate(self.rank)}
        # Characters are symbols even where they are not pieces: merges can start from them.
        for char in sorted({c for piece in self.rank for c in piece}):
            self.symbol.setdefault(char, len(self.symbol))
        keys, ranks, made = [], [], []
        for piece, rank in self.rank.items():
            for cut in range(1, len(piece)):
                left, right = self.symbol.get(piece[:cut]), self.symbol.get(piece[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    ranks.append(rank)
                    made.append(self.symbol[piece])
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.keys, self.ranks, self.made = (np.array(x, np.int64)[order] for x in (keys, ranks, made))
        # A symbol for each character of the vocabulary, by code point; -1 elsewhere.
        chars = {c: self.symbol[c] for piece in self.rank for c in piece}
        self.of_char = np.full(0x110000, -1, np.int64)
        self.of_char[[ord(c) for c in chars]] = list(chars.values())
        pairs = {piece[i : i + 2] for piece in self.rank for i in range(len(piece) - 1)}
        self.adjacent = np.sort(np.array([ord(p[0]) << 21 | ord(p[1]) for p in pairs], np.int64))

    def _pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        known = self.keys[at] == key
        return np.where(known, self.ranks[at], _NONE), self.made[at]

    def _survivors(self, symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Symbols left in each sequence once none of its pairs can merge.

        ``starts`` are the places where sequences begin. Pairs are looked up once, and again
        only where a merge has changed a neighbour.
        """
        done = np.zeros(len(starts), np.int64)
        seq = np.arange(len(starts))
        rank, made = (np.r_[x, 0] for x in self._pair(symbols[:-1], symbols[1:]))
        rank[np.r_[starts[1:], len(symbols)] - 1] = _NONE  # a sequence's last symbol has no pair
        while len(seq):
            size = np.diff(np.r_[starts, len(symbols)])
            lowest = np.minimum.reduceat(rank, starts)
            live = lowest < _NONE
            if not live.all():
                done[seq[~live]] = size[~live]
                stay = live.repeat(size)
                symbols, rank, made = symbols[stay], rank[stay], made[stay]
                seq, size, lowest = seq[live], size[live], lowest[live]
                starts = np.r_[0, np.cumsum(size)][:-1]
                if not len(seq):
                    break
            row = np.arange(len(seq)).repeat(size)
            hit = np.flatnonzero(rank == lowest[row])
            at = hit[np.r_[True, row[hit[1:]] != row[hit[:-1]]]]  # the leftmost of each sequence
            symbols[at] = made[at]
            last = at + 1 == starts + size - 1  # the merged pair ended the sequence
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            follow = np.minimum(at + 2, len(symbols) - 1)
            rank[at], made[at] = self._pair(symbols[at], symbols[follow])
            rank[at[last]] = _NONE
            before = at[at > starts] - 1
            rank[before], made[before] = self._pair(symbols[before], symbols[before + 1])
            symbols, rank, made = symbols[keep], rank[keep], made[keep]
            starts = starts - np.arange(len(starts))  # each sequence before has lost one symbol
        return done

    def count(self, words: list[str]) -> np.ndarray:
        """Tokens of each word; blanks in words are already the model's blank sign."""
        total = np.zeros(len(words), np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        begin = 0
        for stop in [*(np.flatnonzero(np.diff(np.cumsum(sizes) // MERGED_SYMBOLS)) + 1).tolist(), len(words)]:
            if stop > begin:
                total[begin:stop] = self._count(words[begin:stop], sizes[begin:stop])
            begin = stop
        return total

    def _count(self, words: list[str], sizes: np.ndarray) -> np.ndarray:
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        word = np.arange(len(words)).repeat(sizes)
        symbols = self.of_char[code]
        known = symbols >= 0
        odd = code[~known]
        spare = 1 + (odd >= 0x80).astype(np.int64) + (odd >= 0x800) + (odd >= 0x10000)
        total = np.bincount(word[~known], spare, len(words)).astype(np.int64)
        if known.any():
            pair = code[:-1] << 21 | code[1:]
            at = np.minimum(np.searchsorted(self.adjacent, pair), len(self.adjacent) - 1)
            joined = (self.adjacent[at] == pair) & (word[1:] == word[:-1])
            starts = np.flatnonzero(np.r_[True, ~joined][known])
            left = self._survivors(symbols[known], starts)
            total += np.bincount(word[known][starts], left, len(words)).astype(np.int64)
        return total


@lru_cache(maxsize=4)
def _pieces(path: str) -> Pieces:
    return Pieces(path)


def _chunks(text: str) -> Iterator[str]:
    """The text as the model reads it, with one blank before it, in parts cut before blanks."""
    text, start = " " + text.replace(SPACE, " "), 0
    while start < len(text):
        cut = _WORD_END.search(text, start + CHUNK_CHARS)
        stop = cut.end() if cut else len(text)
        yield text[start:stop]
        start = stop


def count_texts(texts: Iterable[str], pieces: Pieces, cache: dict[str, int]) -> list[int]:
    """Tokens of whole texts. ``cache`` holds the counts of words met before.

    Words are held for some ``CHUNK_CHARS`` characters at a time, whether these are many
    texts or a part of one, and the new ones among them merge together.
    """
    counts: list[int] = []
    held: list[tuple[int, list[str]]] = []
    chars = 0

    def settle() -> None:
        fresh = {word for _, words in held for word in words if word not in cache}
        if len(cache) + len(fresh) > CACHED_WORDS:
            cache.clear()
            fresh = {word for _, words in held for word in words}
        new = list(fresh)
        cache.update(zip(new, pieces.count([word.replace(" ", SPACE) for word in new]).tolist(), strict=True))
        for n, words in held:
            counts[n] += sum(map(cache.__getitem__, words))
        held.clear()

    for text in texts:
        counts.append(0)
        for chunk in _chunks(text) if text else ():
            held.append((len(counts) - 1, _BLANKS_THEN_TEXT.findall(chunk)))
            chars += len(chunk)
            if chars > CHUNK_CHARS:
                settle()
                chars = 0
    settle()
    return counts


def token_count(text: Column | str, path: str) -> Column:
    """Tokens of a text column under the model at ``path``, which every executor can read."""
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pieces, cache = _pieces(path), {}
        for batch in batches:
            yield pd.Series(count_texts((x or "" for x in batch), pieces, cache), dtype="int64")

    # The return annotation of an iterator is taken as written, not from postponed text.
    counted.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(counted, "bigint")(text)


def count_tokens(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row; no shuffle."""
    body = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(text, F.lit("")).alias("_text"))
    return body.select(
        "doc_id", F.octet_length("_text").cast("bigint").alias("n_bytes"), token_count("_text", path).alias("n_tokens")
    ).withColumn("over_limit", F.col("n_tokens") > OVER_LIMIT)
