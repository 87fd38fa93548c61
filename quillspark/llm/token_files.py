"""Token files: concatenated ids with Elias-Fano encoded document boundaries.

A file holds, after a fixed header of nine little-endian 64-bit numbers, the document ids, the ends of
the documents in its id array as an Elias-Fano sequence, and the ids as unsigned 16-bit or 32-bit
numbers. Ends take 2 + log2(ids / documents) bits each, and a select sample for every 512 documents.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .byte_bpe import public_path, slices, text_encoder
from .common import materialize, scratch_dir

MAGIC = 0x31_46_45_4C_49_55_51
SAMPLE = 512
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


class EliasFano:
    """A non-decreasing sequence of n numbers below `universe` + 1 in about n * (2 + log2(universe / n)) bits."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.width, self.low, self.high, self.samples = n, width, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray, universe: int) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        width = max(0, int(universe // max(n, 1)).bit_length() - 1)
        bits = ((values[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        low = np.packbits(bits.reshape(-1), bitorder="little")
        places = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        flags = np.zeros(int(universe >> width) + n + 1, np.uint8)
        flags[places] = 1
        return cls(n, width, low, np.packbits(flags, bitorder="little"), places[::SAMPLE].astype(np.uint64))

    @staticmethod
    def sizes(n: int, universe: int) -> tuple[int, int, int, int]:
        width = max(0, int(universe // max(n, 1)).bit_length() - 1)
        return width, -(-n * width // 8), -(-(int(universe >> width) + n + 1) // 8), -(-n // SAMPLE)

    def _low(self, i: int) -> int:
        at, out = i * self.width, 0
        for k in range(self.width):
            out |= int(self.low[(at + k) >> 3] >> ((at + k) & 7) & 1) << k
        return out

    def select(self, i: int) -> int:
        """The i-th number, from the nearest sample on."""
        place = int(self.samples[i // SAMPLE])
        left = i % SAMPLE
        byte = place >> 3
        word = int(self.high[byte]) >> (place & 7) << (place & 7)
        while (ones := int(_ONES[word])) <= left:
            left -= ones
            byte += 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        place = (byte << 3) + (word & -word).bit_length() - 1
        return ((place - i) << self.width) | self._low(i)

    def all(self) -> np.ndarray:
        """Every number, by one select over the whole bit vector."""
        places = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        out = (places - np.arange(self.n)).astype(np.uint64) << np.uint64(self.width)
        if self.width:
            bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.width].reshape(self.n, self.width).astype(np.uint64)
            out |= (bits << np.arange(self.width, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return out.astype(np.int64)


def pack_file(doc_ids: np.ndarray, nulls: int, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """doc_ids in order, of which the first `nulls` are null."""
    kind = np.uint16 if not len(ids) or int(ids.max()) < 1 << 16 else np.uint32
    ef = EliasFano.of(np.cumsum(lengths), len(ids))
    head = np.array([MAGIC, 1, len(doc_ids), len(ids), np.dtype(kind).itemsize, ef.width, len(ef.low), len(ef.high), nulls], "<i8")
    return b"".join([head.tobytes(), doc_ids.astype("<i8").tobytes(), ef.samples.astype("<u8").tobytes(), ef.low.tobytes(), ef.high.tobytes(), ids.astype(np.dtype(kind).newbyteorder("<")).tobytes()])


class TokenFile:
    def __init__(self, raw: bytes):
        magic, version, n, total, item, width, low, high, self.nulls = np.frombuffer(raw, "<i8", 9).tolist()
        if magic != MAGIC or version != 1:
            raise ValueError("not a token file")
        at = 72
        self.doc_ids = np.frombuffer(raw, "<i8", n, at)
        at += 8 * n
        samples = np.frombuffer(raw, "<u8", -(-n // SAMPLE), at)
        at += samples.nbytes
        lows = np.frombuffer(raw, np.uint8, low, at)
        self.ends = EliasFano(n, width, lows, np.frombuffer(raw, np.uint8, high, at + low), samples)
        self.ids = np.frombuffer(raw, f"<u{item}", total, at + low + high)

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.ends.select(i - 1) if i else 0 : self.ends.select(i)]


def _place(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder else folder.replace("file:", "file://", 1))


def write_token_files(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int | None = 0, file_ids: int = 8 << 20, partitions: int | None = None) -> DataFrame:
    """Encode whole texts and write them in ascending id order as token files under `folder`.

    `folder` is a URI that executors can write to (file, hdfs, s3, gs). Texts are dealt by ranges of
    their ids, so that only they are shuffled, and each task writes files of about `file_ids` ids; a file
    appears under its name only when it is whole, so a repeated task writes the same files again.
    Returns the manifest: shard, part, file, n_docs, n_ids, start (ids in all files before it). A null
    text counts as empty (its end id alone); null ids come first; rows that repeat an id keep apart, in
    the order of their texts. An empty table gives an empty manifest. Other columns are ignored.
    """
    path = path or public_path("byte_bpe_50k.json")
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    ordered = docs.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches):
        from pyspark import TaskContext

        shard, part = TaskContext.get().partitionId(), 0
        place, root = _place(folder)
        place.create_dir(root, recursive=True)
        held: list[tuple[int | None, np.ndarray]] = []

        def flush():
            nonlocal part
            ids = np.concatenate([x for _, x in held])
            keys = [k for k, _ in held]
            raw = pack_file(np.array([k or 0 for k in keys]), sum(k is None for k in keys), np.array([len(x) for _, x in held]), ids)
            name = f"{shard:06d}-{part:04d}.tokens"
            unfinished = f"{root}/.{name}.{uuid.uuid4().hex}"
            with place.open_output_stream(unfinished) as out:
                out.write(raw)
            place.move(unfinished, f"{root}/{name}")
            row = (shard, part, name, len(held), len(ids))
            held.clear()
            part += 1
            return row

        encoder, total, end = text_encoder(path), 0, np.array([] if end_id is None else [end_id], np.uint32)
        for batch in batches:
            for piece in slices(batch, "text"):
                for key, ids in zip(piece.column(0).to_pylist(), encoder.encode_many(piece.column(1).to_pylist())):
                    held.append((key, np.concatenate([ids, end])))
                    total += len(held[-1][1])
                    if total >= file_ids:
                        yield _manifest([flush()])
                        total = 0
        if held:
            yield _manifest([flush()])

    manifest = materialize(ordered.mapInArrow(run, "shard int, part int, file string, n_docs long, n_ids long"), "manifest")
    before = Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long"))


def _manifest(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["shard", "part", "file", "n_docs", "n_ids"])


def read_token_files(manifest: DataFrame, folder: str, digest: bool = False) -> DataFrame:
    """One row per document out of the files: doc_id, start, n_tokens, and ids (array<int>) or ids_crc32."""
    last = "ids_crc32 long" if digest else "ids array<int>"

    def run(batches):
        place, root = _place(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with place.open_input_file(f"{root}/{row['file']}") as f:
                    tokens = TokenFile(f.read())
                ends = tokens.ends.all()
                starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
                keys = pa.array(tokens.doc_ids, pa.int64(), mask=np.arange(len(ends)) < tokens.nulls)
                for at in range(0, len(ends), 2000):
                    cut = [tokens.ids[a:b] for a, b in zip(starts[at : at + 2000], ends[at : at + 2000])]
                    made = pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in cut], pa.int64()) if digest else pa.array([x.astype(np.int32) for x in cut], pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays([keys.slice(at, 2000), pa.array(starts[at : at + 2000] + row["start"]), pa.array((ends - starts)[at : at + 2000]), made], ["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])

    files = manifest.select("file", "start")
    return files.repartition(max(1, manifest.sparkSession.sparkContext.defaultParallelism), "file").mapInArrow(run, f"doc_id long, start long, n_tokens long, {last}")


def encoded_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = 0, digest: bool = True) -> DataFrame:
    """Write token files to the shared folder and read every document back from them."""
    folder = f"{scratch_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    manifest = write_token_files(docs, folder, id_col, text_col, path, end_id)
    return read_token_files(manifest, folder, digest)
