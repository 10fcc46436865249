"""Repeated strings of bytes by suffix arrays.

Every string of LENGTH bytes belongs to one anchor: of the GRAM-byte strings in it, that of
the smallest hash, the leftmost of equals. Equal strings have equal anchors at equal places,
so all copies of a string meet where their anchors meet. Consecutive strings of one anchor
form a segment of at most 2 * LENGTH - GRAM bytes, and a text is one segment after another.

1. Anchors that occur once are done: none of their strings repeats.
2. Segments that occur more than once, as a whole, are done: all of their strings repeat.
3. What is left, each different segment of a repeated anchor, goes to shards by its anchor. A
   shard sorts its suffixes by Larsson-Sadakane refinement (each round sorts only groups
   still equal, by the rank of the suffix as far behind as is already sorted), and Kasai's
   rule gives the common prefixes of neighbours in that order. Strings whose neighbour
   shares LENGTH bytes repeat.
4. An anchor with very many different segments is dealt over several shards. Each hands on
   one copy of each of its strings as a digest; the digests of all shards, dealt by value
   and sorted, are searched by bisection for each string that its own shard has only once.

Every string is judged on the input. Only texts that keep something to look at travel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from muster.llm.common import null_id, whole_id, written
from muster.llm.words import slices

#: Bytes of a string that may not repeat, and of an anchor.
LENGTH, GRAM = 200, 32
#: Segments of a shard; an anchor with more different ones is dealt over several shards.
SHARD = 4096


def _windows(x: np.ndarray, n: int, merge) -> np.ndarray:
    """merge over each n consecutive members, by doubling."""
    have = 1
    while have * 2 <= n:
        x, have = merge(x[:-have], x[have:]), have * 2
    return merge(x[: len(x) - (n - have)], x[n - have :]) if n > have else x


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of each gram-byte string; gram is a power of two."""
    with np.errstate(over="ignore"):
        x = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        have, factor = 1, np.uint64(0xBF58476D1CE4E5B9)
        while have < gram:
            x = x[:-have] * factor + x[have:]
            have, factor = have * 2, factor * factor
        x ^= x >> np.uint64(29)
        x *= np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(32))


def segments(data: np.ndarray, bounds: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Text, first string, number of strings and anchor's hash of each segment.

    data: texts one after another; bounds: where each begins, and the end.
    """
    empty = np.empty(0, np.int64)
    if len(data) < length:
        return empty, empty, empty, empty.astype(np.uint64)
    hashes = gram_hashes(data, gram)
    place = np.arange(len(hashes), dtype=np.uint64)
    packed = (hashes & np.uint64(0xFFFFFFFF00000000)) | place
    anchor = (_windows(packed, length - gram + 1, np.minimum) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    start = np.arange(len(anchor))
    text = np.searchsorted(bounds, start, side="right") - 1
    fits = start + length <= bounds[text + 1]
    start, text, anchor = start[fits], text[fits], anchor[fits]
    if not len(start):
        return empty, empty, empty, empty.astype(np.uint64)
    new = np.append(True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])).nonzero()[0]
    return text[new], start[new], np.diff(np.append(new, len(start))), hashes[anchor[new]]


def _batches(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Texts in groups of some bytes: number of the first, bytes, bounds."""
    for at, end in slices(texts):
        part = texts[at:end]
        yield at, np.frombuffer(b"".join(part), np.uint8), np.append(0, np.cumsum([len(t) for t in part]))


def suffix_array(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order of their first `depth` symbols at least, and each one's rank.

    data: symbols from 0 to 511. Larsson-Sadakane: a group of suffixes equal so far has the
    rank of its first place; a round sorts the members of groups by the rank of the suffix
    `have` behind, which doubles the symbols sorted by.
    """
    n = len(data)
    key, have = np.zeros(n, np.int64), 7
    padded = np.append(data.astype(np.int64), np.zeros(have, np.int64))
    for i in range(have):
        key = key << 9 | padded[i : i + n]
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    first = np.append(True, sorted_key[1:] != sorted_key[:-1])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    while have < depth:
        slots = (~(first & np.append(first[1:], True))).nonzero()[0]  # of groups of more than one
        if not len(slots):
            break
        members = order[slots]
        behind = members + have
        follow = np.where(behind < n, rank[np.minimum(behind, n - 1)] + 1, 0)
        key = rank[members] * (n + 1) + follow
        by = np.argsort(key, kind="stable")
        order[slots] = members[by]
        key = key[by]
        new = np.append(True, key[1:] != key[:-1])
        first[slots] = new
        rank[order[slots]] = np.maximum.accumulate(np.where(new, slots, 0))
        have *= 2
    return order, rank


def common_prefixes(data: np.ndarray, order: np.ndarray, starts: np.ndarray, lengths: np.ndarray, most: int) -> np.ndarray:
    """Symbols that each suffix shares with the one before it in order, counted up to `most`.

    Kasai's rule: the suffix one further on shares at least one symbol less. All segments
    take a step at once, each from its own first symbol on, so that the count that a step
    starts from is the last one's less one.
    """
    n = len(data)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    out = np.zeros(n, np.int64)
    shared, last = np.zeros(len(starts), np.int64), np.full(len(starts), -1)
    for step in range(int(lengths.max(initial=0))):
        live = (lengths > step).nonzero()[0]
        at = starts[live] + step
        mate = before[at]
        # The rule needs the last mate's follower to come before: equals beyond the sorted
        # depth stand in no order, and then the count starts anew.
        follows = (last[live] >= 0) & (place[np.minimum(last[live] + 1, n - 1)] < place[at])
        k = np.where(follows & (mate >= 0), np.maximum(shared[live] - 1, 0), 0)
        more = ((mate >= 0) & (k < most)).nonzero()[0]
        while len(more):
            a, b = at[more] + k[more], mate[more] + k[more]
            same = (a < n) & (b < n)
            same[same] = (data[a[same]] == data[b[same]]) & (data[a[same]] > 0)
            more = more[same]
            k[more] += 1
            more = more[k[more] < most]
        shared[live], last[live] = k, mate
        out[place[at]] = k
    return out


def repeats_in_shard(parts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(part, start, first, repeated) of each string of `length` bytes of these segments.

    first: whether it is the first of its equals in the shard's order; repeated: whether it
    has any. 0 stands between segments and equals nothing.
    """
    lengths = np.array([len(p) for p in parts], np.int64)
    starts = np.cumsum(lengths + 1) - lengths - 1
    data = np.zeros(int((lengths + 1).sum()), np.int16)
    inside = np.ones(len(data), bool)
    inside[starts + lengths] = False
    data[inside] = np.frombuffer(b"".join(parts), np.uint8).astype(np.int16) + 1
    order, _ = suffix_array(data, length)
    shared = common_prefixes(data, order, starts, lengths, length)
    same_before = shared >= length
    same_after = np.append(same_before[1:], False)
    part = np.searchsorted(starts, order, side="right") - 1
    start = order - starts[part]
    string = start + length <= lengths[part]
    return part[string], start[string], ~same_before[string], (same_before | same_after)[string]


def _runs(part: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive starts within a part: part, first start, number."""
    by = np.lexsort((start, part))
    part, start = part[by], start[by]
    new = np.append(True, (part[1:] != part[:-1]) | (start[1:] != start[:-1] + 1))[: len(part)].nonzero()[0]
    return part[new], start[new], np.diff(np.append(new, len(part)))


def cut_spans(data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, int]:
    """What is left of data without these spans, and how many maximal spans they make."""
    if not len(starts):
        return data, 0
    mark = np.zeros(len(data) + 1, np.int32)
    np.add.at(mark, starts, 1)
    np.add.at(mark, ends, -1)
    gone = np.cumsum(mark[:-1]) > 0
    return np.frombuffer(data, np.uint8)[~gone].tobytes(), int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))


def row_key() -> list[Column]:
    """What a row of docs(doc_id, text) is known by: 96 bits of two unlike hashes."""
    return [F.xxhash64(whole_id(F.col("doc_id")), F.col("text")).alias("row"), F.hash("text").alias("two")]


def repeated_spans(spark: SparkSession, docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(row, two, at, n): in the rows of that key, see row_key(), the n strings from byte at repeat.

    See remove_repeats().
    """
    texts = docs.where(F.octet_length("text") >= length).select(*row_key(), "text")

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            raw = [t.encode("utf-8", "replace") for t in f["text"]]
            for first, data, bounds in _batches(raw):
                text, start, n, anchor = segments(data, bounds, length, gram)
                view, digest = memoryview(data.tobytes()), xxhash.xxh3_64_intdigest
                whole = [digest(view[a : a + m + length - 1]) for a, m in zip(start.tolist(), n.tolist(), strict=True)]
                row = first + text
                yield pd.DataFrame(
                    {
                        "row": f["row"].to_numpy()[row],
                        "two": f["two"].to_numpy()[row],
                        "at": (start - bounds[text]).astype(np.int32),
                        "n": n.astype(np.int32),
                        "anchor": anchor.view(np.int64),
                        "whole": np.array(whole, np.uint64).view(np.int64),
                    }
                )

    names = ["row", "two", "at", "n"]
    schema = "row long, two int, at int, n int, anchor long, whole long"
    pieces = written(spark, texts.mapInPandas(cut, schema), "segments")
    often = pieces.groupBy("anchor").agg(F.count("*").alias("times")).where("times > 1").select("anchor")
    pieces = written(spark, pieces.join(often.hint("rebalance"), "anchor", "left_semi"), "segments")
    # One row stands for all equal segments; its columns are of one row.
    kinds = pieces.groupBy("anchor", "whole").agg(
        F.count("*").alias("times"), *(F.first(c).alias(c) for c in names)
    )
    kinds = written(spark, kinds, "kinds")
    twice = kinds.where("times > 1").select("anchor", "whole").hint("rebalance")
    same = pieces.join(twice, ["anchor", "whole"], "left_semi").select(*names)

    varied = kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1").hint("rebalance")
    deal = F.pmod(F.col("whole"), F.ceil(F.col("kinds") / SHARD)).cast("int")
    chosen = kinds.join(varied, "anchor").withColumn("block", F.when(F.col("kinds") > SHARD, deal).otherwise(-1))
    chosen = written(spark, chosen.select(*names, "anchor", "times", "block"), "chosen")
    shards = max(1, chosen.count() // SHARD)
    cuts = chosen.groupBy("row", "two").agg(F.collect_list(F.struct("at", "n", "anchor", "times", "block")).alias("cuts"))
    held = cuts.join(texts.withColumnsRenamed({"row": "r", "two": "t"}), (F.col("row") == F.col("r")) & (F.col("two") == F.col("t")))

    def extract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for row_, two, cuts, text in zip(f["row"], f["two"], f["cuts"], f["text"], strict=True):
                raw = text.encode("utf-8", "replace")
                for c in cuts:
                    part = raw[c["at"] : c["at"] + c["n"] + length - 1]
                    out.append((row_, two, c["at"], c["anchor"], c["times"], c["block"], part))
            yield pd.DataFrame(out, columns=["row", "two", "at", "anchor", "times", "block", "part"])

    parts = held.select("row", "two", "cuts", "text").mapInPandas(
        extract, "row long, two int, at int, anchor long, times long, block int, part binary"
    )
    # Repeated rows bring the same segment again; it stands for one place all the same.
    alone = F.pmod(F.hash("anchor"), F.lit(shards))
    parts = parts.withColumn("shard", F.when(F.col("block") < 0, alone).otherwise(F.col("anchor")))

    def search(f: pd.DataFrame) -> pd.DataFrame:
        f = f.drop_duplicates(["row", "two", "at"]).reset_index(drop=True)
        parts = f["part"].tolist()
        part, start, first, repeated = repeats_in_shard(parts, length)
        once = f["times"].to_numpy() == 1
        hit = repeated & once[part]
        p, s, n = _runs(part[hit], start[hit])
        found = pd.DataFrame(
            {"row": f["row"].to_numpy()[p], "two": f["two"].to_numpy()[p], "at": f["at"].to_numpy()[p] + s, "n": n, "one": None, "other": None, "open": False}
        )
        dealt = f["block"].to_numpy() >= 0
        hand = (dealt[part] & first).nonzero()[0]
        if len(hand):
            p, s = part[hand], start[hand]
            digests = [xxhash.xxh3_128_digest(parts[i][j : j + length]) for i, j in zip(p.tolist(), s.tolist(), strict=True)]
            halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            more = pd.DataFrame(
                {
                    "row": f["row"].to_numpy()[p],
                    "two": f["two"].to_numpy()[p],
                    "at": f["at"].to_numpy()[p] + s,
                    "n": 1,
                    "one": halves[:, 0],
                    "other": halves[:, 1],
                    "open": ~repeated[hand] & once[p],
                }
            )
            found = more if found.empty else pd.concat([found, more])
        return found.astype({"one": "Int64", "other": "Int64"})

    sought = parts.groupBy("shard", "block").applyInPandas(
        search, "row long, two int, at int, n int, one long, other long, open boolean"
    )
    sought = written(spark, sought, "sought")
    handed = sought.where("one is not null")
    buckets = max(1, handed.count() // (64 * SHARD))

    def merge(f: pd.DataFrame) -> pd.DataFrame:
        digests = np.sort(_joined(f))
        own = _joined(f[f["open"]])
        n = np.searchsorted(digests, own, side="right") - np.searchsorted(digests, own, side="left")
        return f.loc[f["open"], names][n > 1]

    merged = handed.groupBy(F.pmod(F.col("one"), F.lit(buckets))).applyInPandas(
        merge, "row long, two int, at int, n int"
    )
    return same.unionByName(sought.where("one is null").select(*names)).unionByName(merged)


def _joined(f: pd.DataFrame) -> np.ndarray:
    """The two halves of each digest as one value that numpy sorts."""
    both = np.empty(len(f), "i8,i8")
    both["f0"], both["f1"] = f["one"].to_numpy(np.int64), f["other"].to_numpy(np.int64)
    return both


def remove_repeats(spark: SparkSession, docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of each row of docs(doc_id, text).

    A byte goes if a string of `length` bytes that covers it also starts anywhere else, in
    the same text or another row's. Texts are UTF-8 bytes, null counts as empty; kept, what
    is left, is binary, since a cut may fall inside a character. n_spans counts maximal
    removed runs. Repeated rows repeat each other. Rows are known by 96 bits of hashes of doc_id
    and text, so null and repeated doc_ids do no harm. No rows give no rows; extra columns
    are not looked at. A text of any length is worked on whole by one task, which takes some
    80 bytes for each of its.
    """
    spans = repeated_spans(spark, docs, length).distinct()
    spans = spans.groupBy("row", "two").agg(
        F.collect_list("at").alias("at"), F.collect_list("n").alias("n")
    )
    spans = written(spark, spans.withColumnsRenamed({"row": "r", "two": "t"}), "spans")
    rows = docs.select(whole_id(F.col("doc_id")).alias("doc_id"), *row_key(), "text")
    rows = rows.join(spans, (F.col("row") == F.col("r")) & (F.col("two") == F.col("t")), "left")

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for doc_id, text, at, n in zip(f["doc_id"], f["text"], f["at"], f["n"], strict=True):
                raw = (text or "").encode("utf-8", "replace")
                kept, spans = raw, 0
                if at is not None:
                    at = np.asarray(at, np.int64)
                    kept, spans = cut_spans(raw, at, at + np.asarray(n, np.int64) + length - 1)
                out.append((doc_id, len(raw), len(raw) - len(kept), spans, kept))
            yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    out = rows.select("doc_id", "text", "at", "n").mapInPandas(cut, schema)
    return out.withColumn("doc_id", null_id(F.col("doc_id")))
