"""Substring deduplication by content-defined chunking.

A gear hash rolls over a text's bytes: each step doubles it and adds the byte's random
number, so that it depends on the last 32 bytes only. A chunk ends where the hash's top bits
are zero, within a least and a most size. An insertion moves the cuts near it; the chunks
after it are the same again. Chunks are known by a 128-bit digest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from muster.llm.common import NO_ID, null_id, whole_id, written
from muster.llm.words import slices

#: Top bits that are zero at a cut (one cut in 32 places), least and most bytes of a chunk.
BITS, LEAST, MOST = 5, 32, 512
_WINDOW = 32


def gear() -> np.ndarray:
    """The random number of each byte."""
    return np.random.default_rng(2016).integers(0, 1 << 32, 256, np.uint32)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte, by doubling the bytes that it covers."""
    x, have = gear()[data], 1
    while have < _WINDOW:
        y = x.copy()
        y[have:] += x[:-have] << np.uint32(have)
        x, have = y, have * 2
    return x


def cut_batch(texts: list[bytes], bits: int = BITS, least: int = LEAST, most: int = MOST) -> list[list[int]]:
    """Ends of the chunks of each text."""
    # Zero bytes between texts, as many as the hash looks back on, make it forget the last text.
    gap = bytes(_WINDOW)
    data = np.frombuffer(b"".join(gap + t for t in texts), np.uint8)
    marks = (gear_hashes(data) >> np.uint32(32 - bits) == 0).nonzero()[0]
    out, at = [], 0
    for t in texts:
        at += _WINDOW
        inside = marks[np.searchsorted(marks, at) : np.searchsorted(marks, at + len(t))] - at + 1
        ends, last = [], 0
        for end in inside.tolist():
            while end - last > most:
                last += most
                ends.append(last)
            if end - last >= least:
                ends.append(end)
                last = end
        while len(t) - last > most:
            last += most
            ends.append(last)
        if last < len(t):
            ends.append(len(t))
        out.append(ends)
        at += len(t)
    return out


def chunks(docs: DataFrame) -> DataFrame:
    """(doc_id, two, three, place, size, one, other) of each chunk of docs(doc_id, two, three, text)."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            raw = [t.encode("utf-8", "replace") for t in f["text"]]
            for at, end in slices(raw):
                part = raw[at:end]
                ends = cut_batch(part)
                n = np.array([len(e) for e in ends])
                digest = xxhash.xxh3_128_digest
                keys = b"".join(digest(t[a:b]) for t, e in zip(part, ends, strict=True) for a, b in zip([0, *e], e, strict=False))
                halves = np.frombuffer(keys, "<i8").reshape(-1, 2)
                yield pd.DataFrame(
                    {
                        "doc_id": f["doc_id"].to_numpy()[at:end].repeat(n),
                        "two": f["two"].to_numpy()[at:end].repeat(n),
                        "three": f["three"].to_numpy()[at:end].repeat(n),
                        "place": np.concatenate([np.arange(x, dtype=np.int32) for x in n]),
                        "size": np.concatenate([np.diff([0, *e]).astype(np.int32) for e in ends]),
                        "one": halves[:, 0],
                        "other": halves[:, 1],
                    }
                )

    return docs.where("text <> ''").mapInPandas(cut, "doc_id long, two long, three int, place int, size int, one long, other long")


def deduplicate(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_chunks, n_repeated, n_removed, kept) of each row of docs(doc_id, text).

    n_repeated: bytes of chunks, of whatever length, that occur more than once, here or in
    another row. n_removed: bytes of those of which this is not the first occurrence (that of
    the smallest doc_id, and there the first place); kept is the rest, as binary, since a cut
    may fall inside a character. Null texts count as empty, an empty text
    has no chunks. Rows equal in doc_id and text are one occurrence of each chunk's owner and
    lose nothing to each other; rows without a doc_id lose to any that has one, and not to
    each other. No rows give no rows; extra columns are not looked at. A text of any length is
    cut whole by one task.
    """
    rows = docs.select(whole_id(F.col("doc_id")).alias("doc_id"), F.xxhash64("text").alias("two"), F.hash("text").alias("three"), "text")
    row = ["doc_id", "two", "three"]
    pieces = written(spark, chunks(rows), "chunks")
    owner = pieces.groupBy("one", "other").agg(
        F.count("*").alias("times"),
        F.min(F.when(F.col("doc_id") != NO_ID, F.col("doc_id"))).alias("owner"),
    )
    owner = owner.where("times > 1").select("one", "other", "owner").hint("rebalance")
    later = F.coalesce(F.col("owner") != F.col("doc_id"), F.lit(False)).alias("later")
    hits = pieces.join(owner, ["one", "other"]).select(*row, "place", "one", "other", later)
    hits = hits.groupBy(*row, "place", "one", "other", "later").agg(F.lit(1).alias("x"))
    hits = hits.groupBy(*row).agg(F.sort_array(F.collect_list(F.struct("place", "one", "other", "later"))).alias("hits"))
    hits = written(spark, hits.withColumnsRenamed({"doc_id": "d", "two": "t", "three": "u"}), "hits")
    same = (F.col("doc_id") == F.col("d")) & (F.col("two") == F.col("t")) & (F.col("three") == F.col("u"))
    found = rows.join(hits.hint("merge"), same, "left")

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for doc_id, text, hits in zip(f["doc_id"], f["text"], f["hits"], strict=True):
                raw = (text or "").encode("utf-8", "replace")
                ends = cut_batch([raw])[0]
                hits = [] if hits is None else list(hits)
                seen, repeated, bounds = set(), 0, [0]
                for h in hits:
                    start, end = ends[h["place"] - 1] if h["place"] else 0, ends[h["place"]]
                    repeated += end - start
                    # In the owner itself, all but the first place of a chunk are later.
                    if h["later"] or (h["one"], h["other"]) in seen:
                        bounds += [start, end]
                    seen.add((h["one"], h["other"]))
                bounds.append(len(raw))
                kept = b"".join(raw[a:b] for a, b in zip(bounds[::2], bounds[1::2], strict=True))
                out.append((doc_id, len(raw), len(ends), repeated, len(raw) - len(kept), kept))
            yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_chunks", "n_repeated", "n_removed", "kept"])

    schema = "doc_id long, n_bytes long, n_chunks long, n_repeated long, n_removed long, kept binary"
    out = found.select("doc_id", "text", "hits").mapInPandas(cut, schema)
    return out.withColumn("doc_id", null_id(F.col("doc_id")))
