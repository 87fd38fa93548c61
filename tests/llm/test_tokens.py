"""Tokenisation, counting, packing and token files against the libraries themselves."""

import base64
import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import bpe_fold, byte_bpe, packing, token_counts, token_files
from quillspark.llm.byte_bpe import PATTERN, public_path

HF, RANKS, SP = public_path("byte_bpe_50k.json"), public_path("byte_bpe_multi_50k.tiktoken"), public_path("piece_bpe_32k.model")
ODD = "aé ▁\t\n  ,.!12ñ语漢🙂́\x00<s>'s'll\x1c\x85 ²½ªµ"


def fuzz(n, seed=3):
    random.seed(seed)
    return ["".join(random.choice(ODD) for _ in range(random.randint(0, 40))) for _ in range(n)] + ["a" * 3000, " " * 1000, "ab" * 2000, "Ᲊx", "x<|endoftext|>y", "", None]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(HF)


@settings(max_examples=400, deadline=None)
@given(st.text(st.characters(max_codepoint=255), max_size=30))
def test_latin_pattern_means_the_same(text):
    assert byte_bpe.pieces(text) == regex.findall(PATTERN, text)


def test_text_encoder_equals_library(library):
    encoder = byte_bpe.TextEncoder(HF, pieces_kept=300)
    texts = fuzz(1500)
    assert [x.tolist() for x in encoder.encode_many(texts)] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    other = byte_bpe.TextEncoder(public_path("word_bpe_49k.json"))
    assert not other.plain and next(other.encode_many(["Some words"])).tolist() == other.whole.encode("Some words", add_special_tokens=False).ids


def test_text_encoder_remembers_pieces_of_several_runs(library):
    """Pieces that came in more than one run are not encoded again after the limit; ids are the library's, with U+0000 and without."""
    encoder = byte_bpe.TextEncoder(HF, pieces_kept=300)
    asked = []

    class Counted:
        def encode_batch_fast(self, part, **options):
            asked.extend(part)
            return alone.encode_batch_fast(part, **options)

    alone, encoder.alone = encoder.alone, Counted()
    common = " ".join(f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(100))
    rare = [" ".join(f"r{run}{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(200)) for run in "xyz"]
    odd = [(t or "").replace("\0", "") for t in fuzz(300, 8)] + ["a\0b", "\0", " \0 \0"]
    for run in ([common], [common], [rare[0]], [rare[1]], [rare[2]], [common]):
        asked.clear()
        assert [x.tolist() for x in encoder.encode_many(run)] == [library.encode(t, add_special_tokens=False).ids for t in run]
    assert not asked
    assert [x.tolist() for x in encoder.encode_many(odd)] == [library.encode(t, add_special_tokens=False).ids for t in odd]


def test_text_encoder_joins_new_pieces(library):
    """The library is asked for strings of many pieces, not for each."""
    encoder, asked = byte_bpe.TextEncoder(HF), []

    class Counted:
        def encode_batch_fast(self, part, **options):
            asked.extend(part)
            return alone.encode_batch_fast(part, **options)

    alone, encoder.alone = encoder.alone, Counted()
    text = " ".join(f"é{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(500))
    assert next(encoder.encode_many([text])).tolist() == library.encode(text, add_special_tokens=False).ids
    assert 0 < len(asked) <= 10


def test_settled_needs_no_look_at_latin_characters(monkeypatch):
    assert not byte_bpe.settled("a" + min(byte_bpe.unsettled())) and byte_bpe.settled("漢字 é")
    monkeypatch.setattr(byte_bpe, "unsettled", None)
    assert byte_bpe.settled("naïve ÿ") and byte_bpe.settled("plain") and byte_bpe.settled("")


def test_counts_equal_libraries():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=SP)
    counter = token_counts.PieceModelCounter(SP, words_kept=200)
    texts = fuzz(1500) + [" ", "<unk>", "a▁b", "​", "  a  b "]
    assert [counter.count(t) for t in texts] == [len(model.encode(t)) if t else 0 for t in texts]
    bytes_counter = token_counts.ByteModelCounter(RANKS)
    assert [bytes_counter.count(t) for t in texts] == [len(bytes_counter.library.encode_ordinary(t or "")) for t in texts]


def test_token_counts_table(spark, messy, nothing):
    got = token_counts.token_counts(messy, path=SP, limit=100)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"] and got.count() == 12
    by_id = {r["doc_id"]: r for r in got.collect()}
    assert (by_id[3]["n_bytes"], by_id[3]["n_tokens"]) == (0, 0) and by_id[7]["over_limit"] and not by_id[5]["over_limit"]
    assert token_counts.token_counts(nothing, path=SP).count() == 0


def test_fold_equals_library_and_round_trips(spark, messy, nothing):
    lib = bpe_fold.library(RANKS)
    texts = fuzz(250)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = bpe_fold.encode_decode(df, path=RANKS, block_bytes=2000, words_kept=50, common_words=40).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r["doc_id"]] or ""
        assert r["ids"] == lib.encode_ordinary(text) and bytes(r["decoded"]) == text.encode()
    by_id = {}
    for r in bpe_fold.encode_decode(messy, path=RANKS, digest=True, common_words=0).collect():
        by_id[r["doc_id"]] = r
    assert len(by_id) == 11 and by_id[3]["n_tokens"] == 0 and by_id[3]["ids_sha256"] == hashlib.sha256(b"").hexdigest()
    assert by_id[-9]["decoded_sha256"] == hashlib.sha256("Ünï çode 漢字 🙂 don't stop\r\nnow".encode()).hexdigest()
    assert bpe_fold.encode_decode(nothing, path=RANKS).count() == 0


def test_fold_finds_pairs_without_hashes(spark, messy, tmp_path):
    """Each pair that is a token is found in one place of its row, no other pair is, and the plan computes no hash for it."""
    plan = bpe_fold.encode_decode(messy, path=RANKS, common_words=0)._jdf.queryExecution().optimizedPlan().toString()
    assert "xxhash64" not in plan
    words = [bytes([b]) for b in range(256)] + [b"ab", b"ba", b"abab", b"aba", b"bb", b"abb", b"aa", b"aaa"]
    path = tmp_path / "few.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(w) + b" %d\n" % i for i, w in enumerate(words)))
    starts, entries = ([int(x) for x in half.split(",")] for half in bpe_fold.rank_literal(str(path)))
    for left, a in enumerate(words, 1):
        for right, b in enumerate(words, 1):
            place = (starts[left] if left < len(starts) else 0) + right
            found = (entries[place] if 0 <= place < len(entries) else 0) ^ left << bpe_fold.PAIR_BITS
            assert (found if found < bpe_fold.NO_RANK else None) == (words.index(a + b) + 1 if a + b in words else None)
    texts = ["".join(t) for n in range(9) for t in itertools.product("ab", repeat=n)]
    rows = bpe_fold.encode_decode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path=str(path), common_words=0).collect()
    lib = bpe_fold.library(str(path))
    assert len(rows) == len(texts) and all(r["ids"] == lib.encode_ordinary(texts[r["doc_id"]]) and bytes(r["decoded"]) == texts[r["doc_id"]].encode() for r in rows)


def test_fold_uses_no_shuffle_beyond_the_common_words(spark, messy):
    plan = bpe_fold.encode_decode(messy, path=RANKS, common_words=0)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan


@given(st.lists(st.integers(0, 5000), min_size=1, max_size=1500))
@settings(max_examples=40, deadline=None)
def test_elias_fano(gaps):
    values = np.cumsum(gaps)
    ef = token_files.EliasFano.of(values, int(values[-1]))
    assert (ef.all() == values).all()
    for i in {0, len(gaps) // 2, len(gaps) - 1, len(gaps) // 3}:
        assert ef.select(i) == values[i]
    if len(gaps) > 600:
        assert 8 * (ef.low.nbytes + ef.high.nbytes) <= len(gaps) * (3 + np.log2(max(2, values[-1] / len(gaps)))) + 32


def test_token_file_documents():
    lengths = np.array([3, 0, 1, 70_000])
    ids = np.arange(70_004, dtype=np.uint32) % 70_001
    f = token_files.TokenFile(token_files.pack_file(np.array([0, 4, 5, 6]), 1, lengths, ids))
    assert f.nulls == 1 and f.document(1).tolist() == [] and f.document(2).tolist() == [3] and (f.document(3) == ids[4:]).all()


def test_token_files_round_trip(spark, library, messy, nothing, tmp_path):
    texts = [t for t in fuzz(200)]
    df = spark.createDataFrame([(i * 7 % 1000 - 300, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    folder = f"file://{tmp_path}/tokens"
    manifest = token_files.write_token_files(df, folder, path=HF, file_ids=500, partitions=5)
    got = token_files.read_token_files(manifest, folder).orderBy("doc_id").collect()
    at = 0
    for r, (key, text) in zip(got, sorted((i * 7 % 1000 - 300, t) for i, t in enumerate(texts))):
        want = library.encode(text or "", add_special_tokens=False).ids + [0]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids"]) == (key, at, len(want), want)
        at += len(want)
    assert manifest.count() > 5 and not [p for p in tmp_path.rglob(".*.tokens.*")]
    rows = token_files.encoded_documents(messy, path=HF).orderBy("start").collect()
    assert len(rows) == 12 and rows[0]["doc_id"] is None and [r["n_tokens"] for r in rows if r["doc_id"] in (2, 3)] == [1, 1]
    assert rows[1]["ids_crc32"] == zlib.crc32(np.array(library.encode("Ünï çode 漢字 🙂 don't stop\r\nnow", add_special_tokens=False).ids + [0], "<u4").tobytes())
    assert token_files.encoded_documents(nothing, path=HF).count() == 0


def check_bins(counts, capacities, bins):
    held = {}
    for b in bins:
        tokens, docs, cost = capacities.vector()
        assert sum(b.lengths) <= tokens and len(b.lengths) <= docs and sum(s * s for s in b.lengths) <= cost
        for s in b.lengths:
            held[s] = held.get(s, 0) + b.count
    assert held == {s: n for s, n in counts.items() if n}


@given(st.dictionaries(st.integers(1, 64), st.integers(0, 300), max_size=30), st.sampled_from([None, 2, 5]), st.sampled_from([None, 2000]), st.sampled_from(["norm", "dot"]))
@settings(max_examples=120, deadline=None)
def test_plan_keeps_every_capacity(counts, docs, cost, by):
    if cost:
        counts = {s: n for s, n in counts.items() if s * s <= cost}
    capacities = packing.Capacities(64, docs, cost)
    bins = packing.plan_bins(counts, capacities, by=by)
    check_bins(counts, capacities, bins)
    if not docs and not cost and by == "norm" and counts:
        least = -(-sum(s * n for s, n in counts.items()) // 64)
        assert sum(b.count for b in bins) <= max(least, sum(n for s, n in counts.items() if s > 32)) * 11 / 9 + 1


def test_plan_is_close_to_the_bound_at_scale():
    random.seed(1)
    counts = {}
    for _ in range(200_000):
        s = int(random.lognormvariate(6, 1.3)) % 1024 + 1
        counts[s] = counts.get(s, 0) + 1
    bins = packing.plan_bins(counts, packing.Capacities())
    least = -(-sum(s * n for s, n in counts.items()) // 1024)
    assert sum(b.count for b in bins) <= least * 1.001 + 1 and len(bins) < 5000


def test_a_piece_that_fits_nowhere():
    with pytest.raises(ValueError):
        packing.plan_bins({10: 1}, packing.Capacities(64, None, 50))


def test_packing_table(spark, library, messy, nothing):
    texts = [t for t in fuzz(150)] + ["many words here " * n for n in range(1, 60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    capacities = packing.Capacities(64, 6, None)
    rows = packing.pack_documents(df, path=HF, capacities=capacities).collect()
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    for key, own in pieces.items():
        ids = np.array(library.encode(texts[key] or "", add_special_tokens=False).ids + [2], "<u4")
        own.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(-(-len(ids) // 64))) and all(r["length"] == 64 for r in own[1:])
        at = 0
        for r in own:
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["n_docs"] == len(own) <= 6 and r["attention_cost"] == sum(x["length"] ** 2 for x in own)
            at += r["length"]
        assert at <= 64
    assert len(pieces) == len(texts)
    assert packing.pack_documents(messy, path=HF).where("piece = 0").count() == 12
    assert packing.pack_documents(nothing, path=HF).count() == 0
