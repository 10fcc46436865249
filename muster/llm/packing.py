"""Packing by lexical retrieval: windows filled with a seed document's BM25 neighbours.

A document is cut at multiples of the window; whole windows are sequences of their own, so
only the tail (less than a window) has to find company. Tails are dealt to shards of
bounded size by a hash of the document. A shard builds an inverted index over its tails'
token ids with BM25 weights; the longest unused tail is a seed, the index returns its unused
neighbours, and those fill the seed's window greedily, best first. When the best one left
does not fit, it is cut, and its rest goes back among the unused tails. So only a shard's
very last window can be short, and that is cut into powers of two, which need no padding.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from muster.llm.common import null_id, whole_id
from muster.llm.words import ragged, slices, split_words

#: Tokens of a sequence, tails of a shard, best terms of a seed that are looked up.
WINDOW, SHARD_DOCS, QUERY_TERMS = 1024, 2048, 24
K1, B = 1.2, 0.75
END = 0
_CACHE = 150_000
# White space beyond ASCII, where cutting at ASCII white space could differ.
_OTHER_SPACE = re.compile("[\x85\xa0  -     　]")

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_CUT = "doc_id long, doc_tokens long, shard long, crcs array<long>, tail binary"


class Encoder:
    """Token ids of many texts at once: each distinct word is encoded once.

    The vocabulary's pattern never joins a word to the white space after it, so a text may
    be cut before each run of white space. Words already met are kept, at most _CACHE.
    """

    def __init__(self, ranks_path: str, pattern: str) -> None:
        import tiktoken

        lines = (line.split() for line in open(ranks_path, "rb"))
        ranks = {base64.b64decode(token): int(rank) for token, rank in lines}
        self.plain = tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, list[int]] = {}

    def word(self, word: str) -> list[int]:
        ids = self.known.get(word)
        if ids is None:
            ids = self.plain.encode_ordinary(word)
            if len(self.known) >= _CACHE:
                self.known.clear()
            self.known[word] = ids
        return ids

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids (uint16) of each text, without the closing id."""
        odd = [i for i, t in enumerate(texts) if _OTHER_SPACE.search(t)]
        words, code, at = split_words(["" if _OTHER_SPACE.search(t) else t for t in texts] if odd else texts)
        found = [self.word(w) for w in words]
        lengths = np.array([len(f) for f in found], np.int64)
        flat = np.array([x for f in found for x in f], np.uint16)
        ids = flat[ragged(np.cumsum(lengths) - lengths, lengths, code)]
        at = np.append(0, np.cumsum(lengths[code]))[at]
        out = [ids[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        for i in odd:
            out[i] = np.array(self.plain.encode_ordinary(texts[i]), np.uint16)
        return out


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(ranks_path: str, pattern: str) -> Encoder:
    """The worker's encoder, kept between tasks."""
    key = (ranks_path, pattern)
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


class Shard:
    """The unused tails of a shard and their inverted index."""

    def __init__(self, tails: list[np.ndarray]) -> None:
        n = len(tails)
        lengths = np.array([len(t) for t in tails], np.int64)
        doc = np.repeat(np.arange(n), lengths)
        term = np.concatenate(tails).astype(np.int64) if n else np.empty(0, np.int64)
        pair, tf = np.unique(term * max(n, 1) + doc, return_counts=True)
        term, doc = np.divmod(pair, max(n, 1))
        self.terms, at, df = np.unique(term, return_index=True, return_counts=True)
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        self.doc, self.at, self.end = doc, at, at + df
        row = np.repeat(np.arange(len(df)), df)
        size = K1 * (1 - B + B * lengths[doc] / max(lengths.mean() if n else 1, 1))
        self.weight = idf[row] * tf * (K1 + 1) / (tf + size)
        # The query terms of a document: its own of most weight that another one has too.
        use = df[row] > 1
        row, doc, worth = row[use], doc[use], idf[row[use]]
        order = np.lexsort((row, -worth, doc))
        self.query = row[order]
        self.query_at = np.searchsorted(doc[order], np.arange(n + 1))
        self.n = n

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """Unused tails that share a query term with the seed, best first, ties by position."""
        score = np.zeros(self.n)
        for q in self.query[self.query_at[seed] : self.query_at[seed + 1]][:QUERY_TERMS]:
            span = slice(self.at[q], self.end[q])
            score[self.doc[span]] += self.weight[span]
        score[~unused] = 0
        hit = score.nonzero()[0]
        return hit[np.argsort(-score[hit], kind="stable")]


def pack_shard(tails: list[np.ndarray], window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (tail, start in the tail, length) that use each id once."""
    shard = Shard(tails)
    size = np.array([len(t) for t in tails], np.int64)
    start, unused = np.zeros(len(tails), np.int64), size > 0
    by_size, out = np.argsort(-size, kind="stable"), []
    # Cut tails are shorter than the order says; they wait as company, or come at the end.
    for seed in by_size:
        if not unused[seed]:
            continue
        room, made = window, []

        def take(i: int, most: int) -> int:
            n = min(size[i] - start[i], most)
            made.append((int(i), int(start[i]), int(n)))
            start[i] += n
            unused[i] = start[i] < size[i]
            return n

        room -= take(seed, room)
        if room:
            near = shard.neighbours(seed, unused)
            # Whole neighbours first, in order of score; then the best one left is cut.
            for i in near:
                if size[i] - start[i] <= room:
                    room -= take(i, room)
                    if not room:
                        break
            for i in near:
                if not room:
                    break
                if unused[i]:
                    room -= take(i, room)
            while room and unused.any():
                # No neighbour left: the shortest unused tails, which leaves few pieces cut.
                for i in by_size[unused[by_size]][::-1][:64]:
                    if room:
                        room -= take(i, room)
        out.append(made)
    return [part for made in out for part in powers(made, window)]


def powers(made: list[tuple[int, int, int]], window: int) -> Iterator[list[tuple[int, int, int]]]:
    """A full sequence as it is; a short one as sequences whose lengths are powers of two."""
    left = sum(n for _, _, n in made)
    if left == window:
        yield made
        return
    made = list(reversed(made))
    while left:
        room, part = 1 << (left.bit_length() - 1), []
        left -= room
        while room:
            i, start, n = made.pop()
            if n > room:
                made.append((i, start + room, n - room))
                n = room
            part.append((i, start, n))
            room -= n
        yield part


def pack(
    spark: SparkSession,
    docs: DataFrame,
    window: int = WINDOW,
    shard_docs: int = SHARD_DOCS,
    ranks_path: str | None = None,
    pattern: str | None = None,
) -> DataFrame:
    """Pieces of all rows of docs(doc_id, text), packed into sequences of `window` tokens.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. A document is
    its token ids and a closing id 0, so that a null or empty text is one token; it is
    counted with that id. Repeated rows, and rows without a doc_id, are documents like any
    other. No rows give no pieces. Other columns are not looked at. A text of any length is
    tokenized whole by one task; its whole windows are sequences of their own.

    ranks_path and pattern name the vocabulary as ranks (default: the public 50k byte BPE,
    whose ids equal those of its JSON file); it has to be at the same place on every
    executor. The number of shards follows the number of rows, so that a shard has about
    shard_docs tails of less than a window at any input size.
    """
    if ranks_path is None or pattern is None:
        import public_tokenizers

        ranks_path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
        pattern = pattern or public_tokenizers.PATTERN
    shards = max(1, -(-docs.count() // shard_docs))

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts = f["text"].fillna("").tolist()
            code = encoder(ranks_path, pattern)
            ids = [np.append(x, np.uint16(END)) for a, b in slices(texts) for x in code.encode(texts[a:b])]
            whole = [len(x) // window * window for x in ids]
            yield pd.DataFrame(
                {
                    "doc_id": f["doc_id"],
                    "doc_tokens": [len(x) for x in ids],
                    "shard": f["shard"],
                    "crcs": [[crc(x[i : i + window]) for i in range(0, w, window)] for x, w in zip(ids, whole, strict=True)],
                    "tail": [x[w:].astype("<u2").tobytes() for x, w in zip(ids, whole, strict=True)],
                }
            )

    def fill(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        # Order within a shard is fixed by content, so that a task run again agrees.
        f = f.sort_values(["doc_id", "doc_tokens", "tail"], ignore_index=True)
        ids, total = f["doc_id"].to_numpy(), f["doc_tokens"].to_numpy()
        tails = [np.frombuffer(t, "<u2") for t in f["tail"]]
        out, sequence = [], int(key[0]) << 32
        for i, crcs in enumerate(f["crcs"]):
            for j, c in enumerate(crcs):
                out.append((ids[i], j * window, window, c, total[i], sequence, 0))
                sequence += 1
        for made in pack_shard(tails, window):
            offset = 0
            for i, start, n in made:
                at = total[i] - len(tails[i]) + start
                out.append((ids[i], at, n, crc(tails[i][start : start + n]), total[i], sequence, offset))
                offset += n
            sequence += 1
        return pd.DataFrame(out, columns=[c.split()[0] for c in PIECES.split(", ")])

    deal = F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards))
    rows = docs.select(whole_id(F.col("doc_id")).alias("doc_id"), "text", deal.alias("shard")).mapInPandas(cut, _CUT)
    pieces = rows.groupBy("shard").applyInPandas(fill, PIECES)
    return pieces.withColumn("doc_id", null_id(F.col("doc_id")))
