"""Byte-level BPE over distinct pieces: a tokenizer file encodes each distinct piece once per block of texts."""

from __future__ import annotations

import functools
import json
import os
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex

#: The pattern by which byte-level BPE vocabularies split text (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def public_path(name: str) -> str:
    """Place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: Letters, digits and spaces among U+0000..U+00FF (fixed values of the Unicode standard).
_LETTERS, _DIGITS, _SPACES = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾", "\t-\r \x85\xa0"


@functools.cache
def _splitters():
    latin = f" ?[{_LETTERS}]+|'(?:[stmd]|re|ve|ll)| ?[{_DIGITS}]+| ?[^{_SPACES}{_LETTERS}{_DIGITS}]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+"
    return re.compile(latin).findall, regex.compile(PATTERN).findall


def pieces(text: str) -> list[str]:
    """The matches of PATTERN; texts of the first 256 characters alone take a faster pattern of the same meaning."""
    latin, general = _splitters()
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return general(text)
    return latin(text)


@functools.cache
def unsettled() -> frozenset[str]:
    """Letters and digits of the newest Unicode version only: libraries may class these few differently."""
    known = regex.compile(r"[\p{L}\p{N}]")
    return frozenset(c for c in map(chr, range(0x370, sys.maxunicode + 1)) if unicodedata.category(c) == "Cn" and known.match(c))


def settled(text: str) -> bool:
    try:
        text.encode("latin-1")  # by far faster than a look at each character
    except UnicodeEncodeError:
        return unsettled().isdisjoint(text)
    return True


def slices(batch: pa.RecordBatch, text: str, most_bytes: int = 2 << 20, most_rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts have about `most_bytes` together; a longer text is a run of its own."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
    at, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > at and (total + n > most_bytes or i - at >= most_rows):
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += n
    if at < batch.num_rows:
        yield batch.slice(at)


#: Stands between pieces that the library encodes as one string, so many at once: a byte that is a token of its own there.
BETWEEN, TOGETHER = "\0", 100


class TextEncoder:
    """Ids of texts by a tokenizers file, without added special tokens.

    Where the file describes plain byte-level BPE, texts are split by its pattern and the library
    encodes each distinct piece once; the pieces are remembered up to a limit, beyond which those go that came in one run of texts only.
    Texts with a special token's string, with U+0000 or with letters that libraries may class differently go to the library whole, and so
    do all texts of other tokenizers. A plain file's whole tokenizer is loaded when the first such text comes.
    """

    def __init__(self, path: str, pieces_kept: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        self.plain = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and model.get("type") == "BPE" and not model.get("dropout") and not spec.get("truncation") and not spec.get("padding")
        self.apart = [BETWEEN, *(t["content"] for t in spec.get("added_tokens", []))]
        self.path, self.kept = path, pieces_kept
        self.cache: dict[str, bytes | None] = {}
        self.again: set[str] = set()
        one = Tokenizer.from_file(path)
        self.size = one.get_vocab_size(with_added_tokens=True)
        if self.plain:
            self.alone = one
            self.alone.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(BETWEEN, "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            mark = self.alone.encode(BETWEEN, add_special_tokens=False)
            alone = mark.tokens == ["\u0100"] and not any(BETWEEN in s for s in self.apart[1:])
            self.mark, self.together = (mark.ids[0], TOGETHER) if alone else (-1, 1)

    @functools.cached_property
    def whole(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _direct(self, text: str) -> np.ndarray:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)

    def _remember(self, distinct: set[str]) -> None:
        known = {p for p in distinct if p in self.cache}
        new = list(distinct - known)
        self.again |= known
        if len(self.cache) + len(new) > self.kept:
            if 2 * len(self.again) > self.kept:
                self.again = known
            self.cache = {k: v for k, v in self.cache.items() if k in self.again}
        for at in range(0, len(new), 200 * self.together):
            part = new[at : at + 200 * self.together]
            runs = [part[i : i + self.together] for i in range(0, len(part), self.together)]
            for run, e in zip(runs, self.alone.encode_batch_fast([BETWEEN.join(run) for run in runs], add_special_tokens=False)):
                ids = np.array(e.ids, np.uint32)
                raw, start = ids.tobytes(), 0
                for p, end in zip(run, [*(4 * np.flatnonzero(ids == self.mark)).tolist(), len(raw)], strict=True):
                    self.cache[p] = raw[start:end]
                    start = end + 4
            if not settled("".join(part)):
                self.cache.update((p, None) for p in part if not settled(p))

    def encode_many(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        if not self.plain:
            yield from (self._direct(t or "") for t in texts)
            return
        split = [pieces(t) if t and not any(s in t for s in self.apart) else None for t in texts]
        self._remember(set().union(*(s for s in split if s is not None)))
        get = self.cache.__getitem__
        for text, parts in zip(texts, split):
            if parts is None:
                yield self._direct(text) if text else np.empty(0, np.uint32)
                continue
            try:
                yield np.frombuffer(b"".join(map(get, parts)), np.uint32)
            except TypeError:  # a piece without ids of its own
                yield self._direct(text)


@functools.cache
def text_encoder(path: str) -> TextEncoder:
    return TextEncoder(path)
