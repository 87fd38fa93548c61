"""Token counts by heap-and-linked-list byte-pair merging, without making identifiers."""

from __future__ import annotations

import functools
import heapq
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import PATTERN, pieces, public_path, settled, slices


def merge(symbols: list, rank: Callable[[object], int | None]) -> list:
    """The symbols left when the adjacent pair of the lowest rank, the leftmost of equals, is joined until none has a rank."""
    n = len(symbols)
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    parts = list(symbols)
    heap = []
    for i in range(n - 1):
        joined = parts[i] + parts[i + 1]
        if (r := rank(joined)) is not None:
            heap.append((r, i, joined))
    heapq.heapify(heap)
    while heap:
        _, i, joined = heapq.heappop(heap)
        if parts[i] is None or (j := right[i]) >= n or len(parts[i]) + len(parts[j]) != len(joined) or parts[i] + parts[j] != joined:
            continue  # one of the two has been merged meanwhile
        parts[i], parts[j] = joined, None
        k = right[i] = right[j]
        if k < n:
            left[k] = i
            if (r := rank(pair := joined + parts[k])) is not None:
                heapq.heappush(heap, (r, i, pair))
        if (h := left[i]) >= 0 and (r := rank(pair := parts[h] + joined)) is not None:
            heapq.heappush(heap, (r, h, pair))
    return [p for p in parts if p is not None]


class PieceModelCounter:
    """Counts as a sentencepiece BPE model with byte fallback gives them: initial symbols minus merges.

    The text's spaces become U+2581 and one is put in front; where no vocabulary entry has U+2581 behind
    another character, no merge crosses from a word into the next, so each distinct word is merged once."""

    def __init__(self, path: str, words_kept: int = 400_000):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        usable = [i for i in range(len(model)) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.rank = {model.id_to_piece(i): (-model.get_score(i), i) for i in usable}
        self.rank = {p: n for n, p in enumerate(sorted(self.rank, key=self.rank.get))}
        probe = " \tx ﬁ  y "
        if model.normalize(probe) != "▁" + probe.replace(" ", "▁"):
            raise ValueError("only models with the identity normalizer and a dummy prefix are supported")
        self.fallback = any(model.is_byte(i) for i in range(len(model)))
        alone = all("▁" not in p.lstrip("▁") for p in self.rank)
        self.words = re.compile("▁+[^▁]*|[^▁]+" if alone else "(?s).+")
        self.kept = words_kept
        self.cache: dict[str, int] = {}

    def word(self, text: str) -> int:
        n = len(text)
        left = len(merge(list(text), self.rank.get))
        if self.fallback:
            return left + sum(len(c.encode("utf-8")) - 1 for c in text if c not in self.rank)
        return left

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        words = self.words.findall("▁" + text.replace(" ", "▁"))
        cache = self.cache
        try:
            return sum(map(cache.__getitem__, words))
        except KeyError:
            if len(cache) > self.kept:
                cache.clear()
            for w in set(words):
                if w not in cache:
                    cache[w] = self.word(w)
            return sum(map(cache.__getitem__, words))


class ByteModelCounter:
    """Counts by a rank file over bytes; each match of the splitting pattern is merged separately."""

    def __init__(self, path: str, words_kept: int = 400_000):
        import base64

        import tiktoken

        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.library = tiktoken.Encoding("counts", pat_str=PATTERN, mergeable_ranks=self.rank, special_tokens={})
        self.kept = words_kept
        self.cache: dict[str, int] = {}

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not settled(text):
            return len(self.library.encode_ordinary(text))
        words, cache = pieces(text), self.cache
        if len(cache) > self.kept:
            cache.clear()
        for w in set(words):
            if w not in cache:
                raw = w.encode("utf-8")
                cache[w] = len(merge([raw[i : i + 1] for i in range(len(raw))], self.rank.get))
        return sum(map(cache.__getitem__, words))


@functools.cache
def counter(path: str):
    return PieceModelCounter(path) if path.endswith(".model") else ByteModelCounter(path)


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = 4096) -> DataFrame:
    """Number of tokens of each whole text by a .model (sentencepiece) or .tiktoken file.

    Returns one row per input row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).
    A null text counts as empty: 0 bytes, 0 tokens. Repeated rows and null ids give a row each. Other
    columns are ignored. One pass without a shuffle; a task remembers a bounded number of words.
    """
    path = path or public_path("piece_bpe_32k.model")
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        c = counter(path)
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column(1).to_pylist()
                n = np.fromiter(map(c.count, texts), np.int64, len(texts))
                size = np.fromiter((len(t) if t.isascii() else len(t.encode("utf-8")) for t in texts), np.int64, len(texts))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
