"""Token ids in blocks of canonical length-limited Huffman codes.

The file format is a Parquet table ``codes`` (id, bits), which holds the code lengths
of all ids, and a Parquet table ``blocks``, one row per block of whole documents:

    part, first   the block's place: ids of part ``part`` before it
    doc_ids, sizes   its documents in ascending order and their numbers of ids
    marks         little-endian unsigned 32-bit bit offsets of every 256th id
    bits          the codes, first bit highest, in big-endian 64-bit words

A block decodes alone, and from any of its checkpoints. Codes follow from the lengths;
these follow from the counts of all ids in the corpus.

Documents are dealt out by ranges of doc_id and sorted once; ids are counted per task
before they meet. The driver sees counts per id (bounded by the vocabulary) and per
part, nothing per document.

Edge cases: a null text is empty and has the end id alone; a null doc_id comes first;
rows of one doc_id stand in the order of their texts' hashes, equal rows in any; a
part without documents has no blocks; empty tables give an empty file and result;
other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import huffman, units, wordhash
from .bpe import slices
from .shared import discard, materialize

END = 0
BLOCK = 1 << 16  # ids from which a block is full
_encoders: dict = {}


def _encoder(path: str) -> units.Encoder:
    if path not in _encoders:
        _encoders[path] = units.Encoder(path)
    return _encoders[path]


def _ids(path: str):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encoder, part, done = _encoder(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for piece in slices(batch, "text"):
                ids, bounds = encoder.encode(wordhash.utf8(piece.column("text")))
                sizes = np.diff(bounds) + 1
                rows = [ids[a:b].astype("<u4").tobytes() + END.to_bytes(4, "little") for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                first = done + np.concatenate(([0], np.cumsum(sizes)[:-1]))
                done += int(sizes.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(rows), part, np.int32)), pa.array(first), piece.column("doc_id"), pa.array(rows, pa.binary())],
                    names=["part", "first", "doc_id", "ids"],
                )

    return run


def encode_sorted(docs: DataFrame, path: str) -> DataFrame:
    """(part, first, doc_id, ids) in ascending order within each part, END appended."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", "text").repartitionByRange(parts, "doc_id")
    rows = rows.sortWithinPartitions("doc_id", F.xxhash64("text"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(_ids(path), f"part int, first long, doc_id {kind}, ids binary")


def _count(batches):
    import pyarrow as pa

    total = np.zeros(1, np.int64)
    for batch in batches:
        for piece in slices(batch, "ids"):
            data = b"".join(piece.column("ids").to_pylist())
            own = np.bincount(np.frombuffer(data, "<u4"))
            if len(own) > len(total):
                total = np.concatenate((total, np.zeros(len(own) - len(total), np.int64)))
            total[: len(own)] += own
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])


def _blocks(lengths):
    def run(batches):
        import pyarrow as pa

        bits = lengths.value
        codes = huffman.canonical(bits)
        held, n = [], 0

        def block():
            ids = np.concatenate([np.frombuffer(r[3], "<u4") for r in held])
            data, marks = huffman.pack(ids, codes, bits)
            columns = [[held[0][0]], [held[0][1]], [[r[2] for r in held]], [[len(r[3]) // 4 for r in held]], [marks.astype("<u4").tobytes()], [data]]
            kinds = [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["part", "first", "doc_ids", "sizes", "marks", "bits"]
            )

        for batch in batches:
            for piece in slices(batch, "ids"):
                for row in zip(*(piece.column(c).to_pylist() for c in ("part", "first", "doc_id", "ids")), strict=True):
                    # a task may read several parts, or a part from its middle on
                    if held and (n >= BLOCK or row[0] != held[0][0] or row[1] != held[0][1] + n):
                        yield block()
                        held, n = [], 0
                    held.append(row)
                    n += len(row[3]) // 4
        if held:
            yield block()

    return run


def write(docs: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """The file's tables (codes, blocks)."""
    spark = docs.sparkSession
    ids = materialize(encode_sorted(docs, path), "ids")
    counts = ids.select("ids").mapInArrow(_count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(int(counts["id"].max()) + 1 if len(counts) else 1, np.int64)
    total[counts["id"].to_numpy(int)] = counts["n"].to_numpy(int)
    lengths = huffman.code_lengths(total)
    used = np.flatnonzero(lengths)
    codes = spark.createDataFrame([(int(k), int(lengths[k])) for k in used], "id long, bits int")
    blocks = ids.mapInArrow(
        _blocks(spark.sparkContext.broadcast(lengths)),
        "part int, first long, doc_ids array<long>, sizes array<long>, marks binary, bits binary",
    )
    out = materialize(codes.coalesce(1), "codes"), materialize(blocks, "blocks")
    discard(ids)  # the whole corpus as plain ids, which nothing reads from now on
    return out


def _decoded(lengths, before, full: bool):
    def run(batches):
        import pyarrow as pa

        table, base = huffman.decode_table(lengths.value), before.value
        for batch in batches:
            for at in range(0, batch.num_rows, 16):
                rows = batch.slice(at, 16).to_pylist()
                found = huffman.unpack([(r["bits"], np.frombuffer(r["marks"], "<u4").astype(np.int64), sum(r["sizes"])) for r in rows], table)
                docs, starts, sizes, sums, data = [], [], [], [], []
                for r, ids in zip(rows, found, strict=True):
                    cut = np.concatenate(([0], np.cumsum(r["sizes"])))
                    raw = ids.astype("<u4")
                    docs += r["doc_ids"]
                    starts.append(base[r["part"]] + r["first"] + cut[:-1])
                    sizes += r["sizes"]
                    each = [raw[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
                    sums += map(zlib.crc32, each)
                    data += each if full else []
                columns = [pa.array(docs, pa.int64()), pa.array(np.concatenate(starts)), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if full:
                    columns.append(pa.array(data, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def read(codes: DataFrame, blocks: DataFrame, full: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the file, and its ids if asked."""
    spark = blocks.sparkSession
    known = codes.toPandas()
    lengths = np.zeros(int(known["id"].max()) + 1 if len(known) else 1, np.int64)
    lengths[known["id"].to_numpy(int)] = known["bits"].to_numpy(int)
    size = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)
    parts = blocks.groupBy("part").agg(F.sum(size).alias("n")).orderBy("part").collect()
    before, total = {}, 0
    for r in parts:
        before[r["part"]] = total
        total += r["n"]
    send = spark.sparkContext.broadcast
    return blocks.mapInArrow(
        _decoded(send(lengths), send(before), full),
        "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * full,
    )
