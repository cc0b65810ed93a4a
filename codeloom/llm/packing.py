"""Operator 9, packing by powers of two.

A document of n tokens is cut into n // 2048 pieces of 2048 and one piece for
each bit of the rest, longest first. Every piece is a sequence of its own, in
the bucket of its length: no sequence crosses documents and none needs padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import BATCH_ROWS, by_bytes, freeing, stash
from codeloom.llm.tokens import encode_texts, encoder

END_ID = 1
SCHEMA = "k {kind}, start long, length long, ids_crc32 long, doc_tokens long, bucket int"


def binary_lengths(n: int, most: int = 2048) -> list[int]:
    """Powers of two, `most` at most, that sum to n; longest first."""
    return [most] * (n // most) + [1 << b for b in reversed(range(most.bit_length() - 1)) if n % most >> b & 1]


def pack(docs: DataFrame, path: str, most: int = 2048, key: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents: key, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket (and ids, if asked for).

    A document is the ids of its whole text (null: empty) and id 1 after them,
    so an empty text still gives one piece. `most` is a power of two. Keys may
    be null or repeat; each row is packed alone and other columns are not
    read. An empty table gives no rows. bucket is the exponent of the length;
    sequence_id is unique within a run and follows the input's partitions. A
    piece fills its sequence, so offset is 0 throughout. Map-only; the pieces
    are written to the shared folder.
    """
    if most < 1 or most & (most - 1):
        raise ValueError("most must be a power of two")
    kind = docs.schema[key].dataType.simpleString()
    schema = SCHEMA.format(kind=kind) + (", ids array<int>" if keep_ids else "")
    end = np.array([END_ID], dtype="<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in by_bytes(batches, 1):
            texts = [t or "" for t in b.column(1).to_pylist()]
            parts: list[list[np.ndarray]] = [[] for _ in texts]
            for i, ids in encode_texts(enc, texts):
                parts[i].append(ids)
            rows: list[list] = [[] for _ in range(7)]
            for i, p in enumerate(parts):
                raw = memoryview(np.concatenate([*p, end]).tobytes())
                n, at = len(raw) // 4, 0
                for size in binary_lengths(n, most):
                    piece = raw[4 * at : 4 * (at + size)]
                    for col, v in zip(rows, (i, at, size, zlib.crc32(piece), n, size.bit_length() - 1), strict=False):
                        col.append(v)
                    if keep_ids:
                        rows[6].append(np.frombuffer(piece, dtype="<u4").astype(np.int32))
                    at += size
            arrays = [b.column(0).take(pa.array(rows[0], pa.int64())), *(pa.array(x, pa.int64()) for x in rows[1:5]), pa.array(rows[5], pa.int32())]
            names = ["k", "start", "length", "ids_crc32", "doc_tokens", "bucket"]
            if keep_ids:
                arrays.append(pa.array(rows[6], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    out = stash(docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(freeing(run), schema), batch_rows=BATCH_ROWS)
    own = ["start", "length", "ids_crc32", "doc_tokens"]
    return out.select(F.col("k").alias(key), *own, F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"), "bucket", *(["ids"] if keep_ids else []))
