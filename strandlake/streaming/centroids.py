"""Centroids kept as state of a stream: sequences are assigned as they arrive, whatever has been seen before.

Sequences are filed under the smallest hash of their k-mers, so that like ones meet in one key with a chance of the Jaccard index of their k-mers,
and a key stays small. The state of a key is the list of its centroids in order of arrival; it lives in the checkpoint, so a stream that is
started again goes on where it was, and a repeated micro-batch finds the state that it began with.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strandlake.operators.mapping import _CODE, _NONE, hashes

_RESULT = "orf_id bigint, centroid_id bigint, status string"


def _filed(rows: DataFrame, k: int, least: float) -> DataFrame:
    """(file, orf_id, h): each sequence (orf_id, seq) with the hashes of its distinct k-mers, either strand, under the smallest; one without k-mers by the hash of itself.

    Where only equal sets match (``least`` 1) two numbers of 64 bits, a digest of all hashes, stand for the set, so that state does not grow with the length of sequences.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, files = [], []
            for seq, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                h = np.unique(hashes(_CODE[np.frombuffer(seq, np.uint8)], k)[0])
                h = h[h != _NONE].astype(np.int64)
                files.append(int(h[0]) if len(h) else own)
                found.append(np.array([own]) if not len(h) else np.frombuffer(blake2b(h.tobytes(), digest_size=16).digest(), np.int64) if least >= 1 else h)
            flat = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *found])))
            yield pa.RecordBatch.from_arrays([pa.array(files, pa.int64()), batch.column(0), flat], names=["file", "orf_id", "h"])

    s = F.upper(F.coalesce("seq", F.lit("")))
    own = F.xxhash64(s, F.lit("short")).bitwiseOR(F.lit(-(1 << 63)))  # below the hashes of k-mers
    return rows.select(F.col("orf_id").cast("bigint").alias("orf_id"), s.cast("binary").alias("s"), own.alias("own")).mapInArrow(run, "file bigint, orf_id bigint, h array<bigint>")


def assigned(known: list[tuple[int, frozenset]], arriving: Iterator[tuple[int, frozenset]], least: float) -> tuple[list[tuple[int, int, str]], list[tuple[int, frozenset]]]:
    """Each arriving sequence with the first centroid whose k-mers are alike enough, or as a new centroid of its own; and the new ones. ``known`` grows."""
    out, new = [], []
    for orf, h in arriving:
        hit = next((c for c, other in known if len(h & other) >= least * len(h | other)), None)
        if hit is None:
            known.append((orf, h))
            new.append((orf, h))
        out.append((orf, orf if hit is None else hit, "new_centroid" if hit is None else "matched"))
    return out, new


def _arriving(rows: list[pd.DataFrame]) -> Iterator[tuple[int, frozenset]]:
    """By id, as the order inside a micro-batch is not told."""
    ids, hs = np.concatenate([r["orf_id"].to_numpy() for r in rows]), [h for r in rows for h in r["h"]]
    for i in np.argsort(ids, kind="stable"):
        yield int(ids[i]), frozenset(hs[i].tolist())


def packed(known: list[tuple[int, frozenset]]) -> tuple[bytes, bytes, bytes]:
    """Ids, how many hashes each has, and the hashes, as bytes; the state of a key."""
    numbers = lambda x: np.array(x, np.int64).tobytes()
    return numbers([i for i, _ in known]), numbers([len(h) for _, h in known]), numbers([x for _, h in known for x in sorted(h)])


def unpacked(ids: bytes, sizes: bytes, hashes: bytes) -> list[tuple[int, frozenset]]:
    i, n, h = (np.frombuffer(x, np.int64) for x in (ids, sizes, hashes))
    return [(a, frozenset(part.tolist())) for a, part in zip(i.tolist(), np.split(h, np.cumsum(n)[:-1]), strict=True)] if len(i) else []


def _keep(least: float):
    def run(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = unpacked(*state.get) if state.exists else []
        out, new = assigned(known, _arriving(list(rows)), least)
        if new:
            state.update(packed(known))
        orf, centroid, status = zip(*out)
        yield pd.DataFrame({"orf_id": orf, "centroid_id": centroid, "status": status})

    return run


def assign_stream(stream: DataFrame, out: str, checkpoint: str, *, k: int = 15, least: float = 0.9) -> StreamingQuery:
    """Appends (orf_id, centroid_id, status) of a stream of sequences (orf_id, seq) to Parquet files; takes what is there and stops.

    A sequence matches a centroid if ``least`` of their k-mers together are common. Those that came in earlier micro-batches are before, inside one
    the smaller id. Null and short sequences are alike if they are equal. k is at most 31.
    """
    x = _filed(stream, k, least).groupBy("file").applyInPandasWithState(_keep(least), _RESULT, "ids binary, sizes binary, hashes binary", "append", GroupStateTimeout.NoTimeout)
    return x.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def assign_batch(rows: DataFrame, order: str, *, k: int = 15, least: float = 0.9) -> DataFrame:
    """What the stream gives for rows (orf_id, seq) that arrive by a column ``order``."""
    filed = _filed(rows, k, least).join(rows.select("orf_id", F.col(order).alias("at")), "orf_id")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        known: list[tuple[int, frozenset]] = []
        out = [row for _, part in pdf.groupby("at", sort=True) for row in assigned(known, _arriving([part]), least)[0]]
        return pd.DataFrame(out, columns=["orf_id", "centroid_id", "status"])

    return filed.groupBy("file").applyInPandas(run, _RESULT)
