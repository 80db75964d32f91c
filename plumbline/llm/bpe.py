"""Byte-level BPE encoding and decoding with the tiktoken library.

The rank file is local and its path a parameter; every task loads it once. Long texts
are cut before the library sees them, only where a pre-split piece must end anyway: at
a space or line break after a printable ASCII character (no piece runs from a
non-space into a space, and what follows is matched from the space on alike). Decoding
joins the tokens' raw bytes, so ids that end inside a character still decode.

Edge cases: a null text is empty and has no ids; repeated rows are encoded alike; no
special tokens exist, so their strings are ordinary text; empty tables give empty
results; other columns are dropped unless named in ``carry``.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONG = 1 << 15  # characters a call of the library gets at least, where a text is cut
OUT_BYTES = 1 << 22  # of text in one batch of results
_SAFE = re.compile(r"[!-~](?=[ \n])")


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_parts(text: str, size: int = LONG) -> Iterator[str]:
    """Parts of at least ``size`` characters whose pieces are those of the whole text."""
    at = 0
    while len(text) - at > size:
        found = _SAFE.search(text, at + size)
        if not found:
            break
        yield text[at : found.end()]
        at = found.end()
    yield text[at:] if at else text


def encode_text(text: str, enc) -> np.ndarray:
    parts = [enc.encode_to_numpy(p, disallowed_special=()) for p in safe_parts(text)]
    return np.concatenate(parts).astype("<u4") if len(parts) > 1 else parts[0].astype("<u4")


def decode_ids(ids: np.ndarray, enc) -> bytes:
    return enc.decode_bytes(ids.tolist())


def slices(batch, column: str | int, limit: int = OUT_BYTES):
    """Slices of a batch with about ``limit`` bytes of a text column each."""
    import pyarrow.compute as pc

    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        base = sizes[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, base + limit, "right")))
        yield batch.slice(at, end - at)
        at = end


def _codec(path: str, pattern: str, decode: bool):
    def run(batches):
        import pyarrow as pa

        enc = encoding(path, pattern)
        for batch in batches:
            for part in slices(batch, batch.num_columns - 1):
                ids = [encode_text(t or "", enc) for t in part.column(part.num_columns - 1).to_pylist()]
                columns = [part.column(k) for k in range(part.num_columns - 1)]
                columns += [pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())]
                names = [*part.schema.names[:-1], "n_tokens", "ids"]
                if decode:
                    columns.append(pa.array([decode_ids(x, enc) for x in ids], pa.binary()))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def encode(docs: DataFrame, path: str, pattern: str, carry: tuple = ("doc_id",), decode: bool = False) -> DataFrame:
    """carry, n_tokens, ids (little-endian unsigned 32-bit) and, if asked, the decoded bytes."""
    rows = docs.select(*carry, F.col("text").alias("_encoded"))
    fields = [f"`{c}` {t}" for c, t in rows.dtypes[:-1]] + ["n_tokens long", "ids binary"] + ["decoded binary"] * decode
    return rows.mapInArrow(_codec(path, pattern, decode), ", ".join(fields))


def _decoder(path: str, pattern: str):
    def run(batches):
        import pyarrow as pa

        enc = encoding(path, pattern)
        for batch in batches:
            for part in slices(batch, "ids"):
                texts = [decode_ids(np.frombuffer(x or b"", "<u4"), enc) for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.binary())], names=["doc_id", "decoded"])

    return run


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, decoded) of encoded(doc_id, ids); null ids decode to nothing."""
    kind = dict(encoded.dtypes)["doc_id"]
    return encoded.select("doc_id", "ids").mapInArrow(_decoder(path, pattern), f"doc_id {kind}, decoded binary")


def digests(coded: DataFrame) -> DataFrame:
    """Sizes and SHA-256 of what encode(..., decode=True) returns."""
    return coded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
