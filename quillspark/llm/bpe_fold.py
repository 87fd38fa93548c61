"""Byte-level BPE encoding and decoding with Spark higher-order functions.

Texts are dealt into blocks, whose pieces become a list of distinct words and a list of places in it.
Between two Arrow steps the plan folds ranked merges over the bytes of each distinct word, looking the
ranks up in a literal map, and concatenates the vocabulary's pieces again. No shuffle takes part: a lost
task is one input split. Bytes stand as the characters U+0000..U+00FF, so that they can be map keys.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from array import array
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .byte_bpe import PATTERN, pieces, public_path, settled, slices
from .token_counts import merge

#: More than any rank.
NO_RANK = 1 << 20
ID_BITS = 18
ID_MASK = (1 << ID_BITS) - 1
REST_BITS = ID_BITS + 10
#: Above the rank and NO_RANK, in the map of pairs.
PAIR_BITS = 20


@functools.cache
def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.cache
def library(path: str):
    import tiktoken

    return tiktoken.Encoding("fold", pat_str=PATTERN, mergeable_ranks=ranks_of(path), special_tokens={})


def _displaced(rows: dict[int, dict[int, int]], size: int) -> tuple[dict[int, int], dict[int, tuple[int, int]]] | None:
    """Where each row begins in a list of `size` entries in which no two rows use one place, and by place the row and its value."""
    free, starts, held = np.ones(size, bool), {}, {}
    for row in sorted(rows, key=lambda a: (-len(rows[a]), a)):
        at = np.fromiter(rows[row], np.int64)
        span = size - int(at.max() - at.min())
        at -= (least := int(at.min()))
        for tried in range(0, max(0, span), 256):
            # Rows begin their search far from each other, so few places are looked at.
            first = (np.arange(tried, min(span, tried + 256)) + row * 40503) % span
            if len(fits := np.flatnonzero(free[first[:, None] + at].all(1))):
                starts[row] = (start := int(first[fits[0]])) - least
                free[start + at] = False
                held.update((starts[row] + right, (row, value)) for right, value in rows[row].items())
                break
        else:
            return None
    return starts, held


@functools.cache
def rank_literal(path: str) -> tuple[str, str]:
    """The rank of each pair of tokens whose bytes together are a token, as a literal map.

    The map is two arrays: by the left token where its row begins in the other, in which the right token's place from there on has
    left << PAIR_BITS | rank, or 0. So finding a pair reads one place of each whatever the vocabulary (rows displaced until none overlap).
    Here and in the fold tokens and ranks count from 1, so that no token's bits are those of an unused place."""
    ranks = ranks_of(path)
    if max(ranks.values()) + 1 >= 1 << ID_BITS:
        raise ValueError("a vocabulary of over 2^18 entries")
    rows: dict[int, dict[int, int]] = {}
    for w, r in ranks.items():
        for i in range(1, len(w)):
            if w[:i] in ranks and w[i:] in ranks:
                rows.setdefault(ranks[w[:i]] + 1, {})[ranks[w[i:]] + 1] = r + 1
    size = 4 * sum(map(len, rows.values())) + max(ranks.values()) + 1
    while (found := _displaced(rows, size)) is None:
        size *= 2
    starts, held = found
    entries = (held[i][0] << PAIR_BITS | held[i][1] if i in held else 0 for i in range(max(held, default=0) + 1))
    return ",".join(str(starts.get(i, 0)) for i in range(max(starts, default=0) + 1)), ",".join(map(str, entries))


@functools.cache
def piece_literal(path: str) -> str:
    """The vocabulary's bytes in hex, in the order of the ranks, joined by commas."""
    ranks = ranks_of(path)
    entries = [""] * (max(ranks.values()) + 1)
    for word, rank in ranks.items():
        entries[rank] = word.hex()
    return ",".join(entries)


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def pair_rank(table: Column, left: Column, right: Column) -> Column:
    """Rank of two adjacent tokens' bytes together, or NO_RANK; also where one of them is null.

    Another row's place differs in the left token, whose bits are above NO_RANK."""
    place = F.get(table["starts"], left.cast("int")) + right.cast("int")
    return F.least(F.lit(NO_RANK).cast("long"), F.get(table["entries"], place).bitwiseXOR(F.shiftleft(left.cast("long"), PAIR_BITS)))


def _own(token: Column) -> Column:
    return token.bitwiseAND(F.lit(ID_MASK))


def _with_rank(rest: Column, rank: Column) -> Column:
    """A token as one long, ordered by the rank of it and the next together, then by its place in the word.

    rest: place << 18 | id."""
    return F.shiftleft(rank, REST_BITS).bitwiseOR(rest)


def _merge_once(table: Column, tokens: Column) -> Column:
    """Join the leftmost adjacent pair of the lowest rank, which is also its id."""

    def put(lowest: Column, p: Column) -> Column:
        joined = F.shiftright(lowest, REST_BITS)
        before, tail = F.get(tokens, p - 2), F.slice(tokens, p + 2, F.size(tokens))
        left = _with_rank(before.bitwiseAND(F.lit((1 << REST_BITS) - 1)), pair_rank(table, _own(before), joined))
        made = _with_rank(lowest.bitwiseAND(F.lit(((1 << REST_BITS) - 1) ^ ID_MASK)).bitwiseOR(joined), pair_rank(table, joined, _own(F.get(tokens, p + 1))))
        return F.when(p > 1, F.flatten(F.array(F.slice(tokens, 1, p - 2), F.array(left, made), tail))).otherwise(F.flatten(F.array(F.array(made), tail)))

    def step(lowest: Column) -> Column:
        return F.when(lowest < F.lit(NO_RANK << REST_BITS), _let(F.array_position(tokens, lowest).cast("int"), lambda p: put(lowest, p))).otherwise(tokens)

    return _let(F.array_min(tokens), step)


def encode_word(table: Column, parts: Column) -> Column:
    """Ids of a word of two or more bytes, given as the ids of its bytes."""
    start = F.transform(parts, lambda x, i: _with_rank(F.shiftleft(i.cast("long"), ID_BITS).bitwiseOR(x + 1), pair_rank(table, x + 1, F.get(parts, i + 1) + 1)))
    return F.aggregate(F.slice(parts, 2, F.size(parts)), start, lambda s, _: _merge_once(table, s), lambda s: F.transform(s, lambda t: _own(t).cast("int") - 1))


def decode_ids(entries: Column, ids: Column) -> Column:
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(entries, i)), ""))


class _Places(dict):
    """Words in the order in which they were first asked for."""

    def __missing__(self, word: str) -> int:
        at = self[word] = len(self)
        return at


class _Blocks:
    """Texts as places in a list of distinct words: the common words, then those of this task, up to a limit."""

    def __init__(self, path: str, fold_bytes: int, words_kept: int, common: list[str]):
        self.ranks, self.fold_bytes, self.kept = ranks_of(path), fold_bytes, words_kept
        self.single = [self.ranks[bytes([b])] for b in range(256)]
        self.path, self.common, self.fresh = path, common, True
        self.index = _Places(zip(common, range(len(common))))
        self.clear()

    def clear(self) -> None:
        self.ids, self.counts, self.codes, self.direct, self.size = [], [], array("i"), [], 0
        if len(self.index) - len(self.common) > self.kept:
            self.index, self.fresh = _Places(zip(self.common, range(len(self.common)))), True
        self.known = len(self.index)

    def add(self, text: str) -> None:
        self.size += len(text)
        if not settled(text):
            self.counts.append(0)
            self.direct.append(library(self.path).encode_ordinary(text))
            return
        words = pieces(text)
        self.codes.extend(map(self.index.__getitem__, words))
        self.counts.append(len(words))
        self.direct.append(None)

    def word(self, raw: bytes) -> tuple[list[int], bool]:
        """Ids of the bytes, and whether they are to be merged by the plan."""
        if (whole := self.ranks.get(raw)) is not None:
            return [whole], False
        if len(raw) > self.fold_bytes:
            return [self.ranks[p] for p in merge([raw[i : i + 1] for i in range(len(raw))], self.ranks.get)], False
        return [self.single[b] for b in raw], True

    def batch(self, kind: pa.DataType) -> pa.RecordBatch:
        made = [self.word(w.encode("utf-8")) for w in islice(self.index, self.known, None)]
        ints = pa.list_(pa.int32())
        cols = {"ids": pa.array([self.ids], pa.list_(kind)), "counts": pa.array([self.counts], ints), "codes": pa.array([self.codes.tobytes()], pa.binary()), "direct": pa.array([self.direct], pa.list_(ints)), "words": pa.array([[w for w, _ in made]], pa.list_(ints)), "fold": pa.array([[f for _, f in made]], pa.list_(pa.bool_())), "fresh": pa.array([self.fresh])}
        self.fresh = False
        self.clear()
        return pa.RecordBatch.from_pydict(cols)


def blocks(docs: DataFrame, path: str, block_bytes: int, fold_bytes: int, words_kept: int, common: Broadcast) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"ids array<{kind}>, counts array<int>, codes binary, direct array<array<int>>, words array<array<int>>, fold array<boolean>, fresh boolean"

    def run(batches):
        made = _Blocks(path, fold_bytes, words_kept, common.value[0].to_pylist())
        for batch in batches:
            for part in slices(batch, "text", block_bytes):
                made.ids += part.column(0).to_pylist()
                for text in part.column(1).to_pylist():
                    made.add(text)
                if made.size >= block_bytes // 2:
                    yield made.batch(batch.column(0).type)
            if made.ids:
                yield made.batch(batch.column(0).type)

    return docs.mapInArrow(run, schema)


class _Dictionary:
    """By place: a word's ids joined by commas, its bytes decoded from them, and how many ids they are."""

    def __init__(self, common: tuple[pa.Array, pa.Array, np.ndarray]):
        self.texts, self.pieces, self.lengths = common

    def copy(self) -> _Dictionary:
        return _Dictionary((self.texts, self.pieces, self.lengths))

    def add(self, tokens: pa.ListArray, decoded: pa.BinaryArray) -> None:
        texts, lengths = joined_ids(tokens)
        self.texts, self.pieces = pa.concat_arrays([self.texts, texts]), pa.concat_arrays([self.pieces, decoded])
        self.lengths = np.concatenate([self.lengths, lengths])

    def joined(self, codes: np.ndarray, ends: np.ndarray) -> tuple[pa.Array, pa.Array]:
        """Ids and bytes of each document, out of its words' places."""
        at, ends = pa.array(codes), pa.array(ends)
        ids = pc.binary_join(pa.ListArray.from_arrays(ends, self.texts.take(at)), ",")
        return ids, pc.binary_join(pa.ListArray.from_arrays(ends, self.pieces.take(at)), pa.scalar(b"", pa.binary()))


def joined_ids(tokens: pa.ListArray) -> tuple[pa.StringArray, np.ndarray]:
    lengths = pc.list_value_length(tokens).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
    return pc.binary_join(pa.ListArray.from_arrays(ends, tokens.flatten().cast(pa.string())), ","), lengths


def _encode(path: str, words: Column, fold: Column) -> Column:
    starts, entries = (F.split(F.lit(x), ",").cast(f"array<{kind}>") for x, kind in zip(rank_literal(path), ("int", "bigint")))
    return _let(F.struct(starts.alias("starts"), entries.alias("entries")), lambda table: F.transform(words, lambda w, i: F.when(F.get(fold, i), encode_word(table, w)).otherwise(w)))


def _pieces(path: str) -> Column:
    return F.split(F.lit(piece_literal(path)), ",")


def _common_words(docs: DataFrame, path: str, fold_bytes: int, most: int, sample_rows: int) -> tuple[pa.Array, pa.Array, pa.Array, np.ndarray]:
    """Common words, their ids joined by commas, their bytes decoded from these ids, and how many ids they are."""
    if not most:
        return pa.array([], pa.string()), pa.array([], pa.string()), pa.array([], pa.binary()), np.empty(0, np.int64)
    share = min(1.0, sample_rows / max(1, docs.count()))
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("text")

    def words(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([pa.array([w for t in part.column(0).to_pylist() if settled(t) for w in pieces(t)], pa.string())], ["word"])

    def split(batches):
        made = _Blocks(path, fold_bytes, 0, [])
        for batch in batches:
            for at in range(0, batch.num_rows, 5000):
                part = batch.column(0).slice(at, 5000)
                both = [made.word(w.encode("utf-8")) for w in part.to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([part.to_pylist()]), pa.array([[w for w, _ in both]], pa.list_(pa.list_(pa.int32()))), pa.array([[f for _, f in both]])], ["word", "words", "fold"])

    counted = sample.mapInArrow(words, "word string").groupBy("word").count().where("count > 1").orderBy(F.desc("count"), "word").limit(most)
    rows = counted.select("word").repartition(docs.sparkSession.sparkContext.defaultParallelism * 2, "word").mapInArrow(split, "word array<string>, words array<array<int>>, fold array<boolean>")
    rows = rows.select("word", _encode(path, F.col("words"), F.col("fold")).alias("tokens"))
    entries = _pieces(path)
    found = rows.select("word", "tokens", F.transform("tokens", lambda t: decode_ids(entries, t)).alias("decoded")).toArrow().combine_chunks()
    flat = lambda name: pc.list_flatten(found[name]).combine_chunks()
    tokens, words_found, decoded = (x if not isinstance(x, pa.ChunkedArray) else pa.concat_arrays(x.chunks) for x in map(flat, ("tokens", "word", "decoded")))
    texts, lengths = joined_ids(tokens)
    return words_found, texts, decoded, lengths


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, digest: bool = False, block_bytes: int = 1 << 20, fold_bytes: int = 128, words_kept: int = 200_000, common_words: int = 150_000, sample_rows: int = 10_000, splits_per_task: int = 3) -> DataFrame:
    """Encode each whole text by a rank file and decode the ids again.

    Each match of the splitting pattern is merged by itself, as the tiktoken library does. Returns one
    row per input row: doc_id, ids (array<int>), decoded (binary); or with `digest` doc_id, n_tokens,
    ids_sha256 (of decimal ids joined by commas), decoded_sha256. A null text counts as empty: no ids, no
    bytes. Null ids and repeated rows give a row each. Other columns are ignored.

    A word that is a vocabulary entry is its id. Merging by a fold is quadratic in a word's length, so
    words of over `fold_bytes` bytes are merged with a heap instead, with the same result; and texts with
    letters newer than the Unicode version that libraries agree on are encoded by the library whole.
    About `sample_rows` rows, dealt by a hash, show which words are common; the `common_words` most frequent
    of them are folded once for all tasks. Which words these are changes the work, never the result.
    """
    path = path or public_path("byte_bpe_multi_50k.tiktoken")
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    context = docs.sparkSession.sparkContext
    # Larger tasks share the list of words among more texts.
    docs = docs.coalesce(max(2 * context.defaultParallelism, -(-docs.rdd.getNumPartitions() // splits_per_task)))
    common = context.broadcast(_common_words(docs, path, fold_bytes, common_words, sample_rows))
    made = blocks(docs, path, block_bytes, fold_bytes, words_kept, common)
    made = made.select("ids", "counts", "codes", "direct", "fresh", _encode(path, F.col("words"), F.col("fold")).alias("tokens"))
    entries = _pieces(path)
    made = made.select("*", F.transform("tokens", lambda t: decode_ids(entries, t)).alias("decoded"), F.transform("direct", lambda t: F.when(t.isNotNull(), decode_ids(entries, t))).alias("direct_decoded"))
    kind = made.schema["ids"].dataType.elementType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else f"doc_id {kind}, ids array<int>, decoded binary"
    names = ["n_tokens", "ids_sha256", "decoded_sha256"] if digest else ["ids", "decoded"]
    types = [pa.int64(), pa.string(), pa.string()] if digest else [pa.list_(pa.int32()), pa.binary()]

    def run(batches):
        first = _Dictionary(common.value[1:])
        known = first.copy()
        for batch in batches:
            for row in range(batch.num_rows):
                col = {f.name: batch.column(i)[row] for i, f in enumerate(batch.schema)}
                if col["fresh"].as_py():
                    known = first.copy()
                known.add(col["tokens"].values, col["decoded"].values)
                codes, counts = np.frombuffer(col["codes"].as_py(), np.int32), col["counts"].values.to_numpy()
                ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                n_tokens = np.diff(np.concatenate([[0], np.cumsum(known.lengths[codes])])[ends])
                ids, back = known.joined(codes, ends)
                apart = {i: (plain, bytes_ or b"") for i, (plain, bytes_) in enumerate(zip(col["direct"].as_py(), col["direct_decoded"].as_py())) if plain is not None}
                texts = [x.as_buffer() for x in ids] if digest else [[int(k) for k in x.as_py().split(",")] if len(x.as_py()) else [] for x in ids]
                bytes_of = [x.as_buffer() for x in back] if digest else back.to_pylist()
                for i, (plain, raw) in apart.items():
                    texts[i], bytes_of[i], n_tokens[i] = (",".join(map(str, plain)).encode() if digest else plain), raw, len(plain)
                sha = lambda x: hashlib.sha256(x).hexdigest()
                out = [n_tokens, list(map(sha, texts)), list(map(sha, bytes_of))] if digest else [texts, bytes_of]
                yield pa.RecordBatch.from_arrays([col["ids"].values, *map(pa.array, out, types)], ["doc_id", *names])

    return made.mapInArrow(run, schema)
