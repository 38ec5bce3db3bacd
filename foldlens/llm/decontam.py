"""Benchmark decontamination: Wu-Manber search for many word sequences at once.

The alphabet is words. Patterns of the same length m form one searcher. A block is two
consecutive words (one for m = 1), hashed to a table of at least ``SLOTS`` slots for each
different block of the patterns, so that it stays sparse. SHIFT holds for every
block how far the window can move on: m - 1 for blocks that no pattern has, else the
distance of the block's last occurrence from the pattern's end. Where SHIFT is 0 the
block may end a pattern: the patterns with that suffix block stand together, sorted by
the hash of their first block, and those with the text's first block are compared word by
word (hashes first, then the bytes themselves). A pattern is the place of its first word in
one array of all words.

The scan keeps the algorithm's jumps but moves many windows together: texts are cut into
lanes of a few hundred words that overlap by m - 1 words, and each numpy step moves every
lane's window by its own shift.

The pattern side is the benchmark: it is read in blocks of at most ``BLOCK_BYTES`` bytes of
text (a longer item is cut into overlapping runs of words, whose windows are just its own), so
that the tables sent to the executors have a fixed bound. One block is searched in the pass
that makes the result. Several are searched one after the other, each in a pass of its own over
the texts; a pass writes the hits of texts that have any and its tables are destroyed. Then
the documents are joined once with the hits, by 128 bits of their text, and no plan holds more
than one Python operator or one block's tables.

Defined results: a null or empty text has no words and no hits; an item without words has
no window; several items may share a window and all of them are reported; rows with the
same item_id count once in ``n_items``; an item without id still marks words, without
being listed; an empty benchmark contaminates nothing and empty documents give an empty table;
repeated documents are searched each for itself; a text of any length is searched whole, at
about 60 bytes of memory a word; columns named n_words, hit_words or item_ids are replaced,
all others stay, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Scratch, bounded_batches, named_as, need, place_of, plainly_named
from .words import ALPHANUMERIC, Words, packs, to_bytes

WINDOW = 10
#: A word before A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Least size of a SHIFT table, and its slots for each different block.
TABLE_BITS, SLOTS = 16, 8
LANE = 256
BLOCK_BYTES = 4 << 20


class Book:
    """The words of all items, one space after each: ``data``, ``start``, ``end``, ``hash``, the item's number ``owner``."""

    def __init__(self, texts: list[bytes]):
        data, start, end, hashes, owner, at = [], [], [], [], [], 0
        for begin, stop in packs(texts):
            words = Words(texts[begin:stop], ALPHANUMERIC)
            inside = ALPHANUMERIC[words.data]
            held = inside.copy()
            held[1:] |= inside[:-1]
            data.append(np.where(inside, words.data, np.uint8(32))[held])
            size = words.end - words.start
            start.append(at + np.cumsum(size + 1) - size - 1)
            end.append(start[-1] + size)
            hashes.append(words.hash)
            owner.append(begin + words.doc())
            at += len(data[-1])
        none = np.zeros(0, np.int64)
        self.data = np.concatenate([none.astype(np.uint8), *data])
        self.start, self.end, self.owner = (np.concatenate([none, *x]) for x in (start, end, owner))
        self.hash = np.concatenate([none.astype(np.uint64), *hashes])

    def spelled(self, at: int, m: int) -> bytes:
        return self.data[self.start[at] : self.end[at + m - 1]].tobytes()


def blocks_of(hashes: np.ndarray, block: int) -> np.ndarray:
    """The hash of the block of words that ends at each word."""
    if block == 1 or not len(hashes):
        return hashes
    return np.concatenate([hashes[:1], hashes[1:] + hashes[:-1] * np.uint64(0x9E3779B97F4A7C15)])


class WuManber:
    """Searches the sequences of ``m`` words that begin at the words ``at`` of ``book``.

    Sequence i belongs to the items ``owners[owner_first[i]:owner_first[i + 1]]`` of ``names``.
    """

    def __init__(self, m: int, book: Book, at: np.ndarray, owners: np.ndarray, owner_first: np.ndarray, names: list[str]):
        self.m, self.book, self.owners, self.names = m, book, owners, names
        self.block = min(2, m)
        blocks = blocks_of(book.hash, self.block)
        held = np.zeros(len(blocks), bool)
        for k in range(self.block - 1, m):
            held[at + k] = True
        self.bits = max(TABLE_BITS, (SLOTS * len(np.unique(blocks[held])) - 1).bit_length())
        slot = self._slot(blocks)
        self.shift = np.full(1 << self.bits, m - self.block + 1, np.min_scalar_type(m))
        for k in range(self.block - 1, m):  # later positions give smaller shifts
            self.shift[slot[at + k]] = m - 1 - k
        bucket = self._bucket(blocks, at + m - 1)
        order = np.argsort(bucket, kind="stable")
        self.bucket, self.at = bucket[order], at[order]
        self.low, self.high = owner_first[:-1][order], owner_first[1:][order]

    def _slot(self, blocks: np.ndarray) -> np.ndarray:
        return (blocks >> np.uint64(64 - self.bits)).astype(np.int64)

    def _bucket(self, blocks: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The slot of the suffix block of windows that end at ``last``, then the hash of their prefix block."""
        suffix, prefix = blocks[last], blocks[last - self.m + self.block]
        return (suffix >> np.uint64(64 - self.bits) << np.uint64(64 - self.bits)) | (prefix >> np.uint64(self.bits))

    def ends(self, words: Words, blocks: np.ndarray) -> tuple[np.ndarray, int]:
        """Positions of words where SHIFT is 0 and a whole window fits into the text; how many were looked at."""
        m, first = self.m, words.first
        lengths = np.diff(first)
        texts = np.flatnonzero(lengths >= m)
        if not len(texts):
            return np.zeros(0, np.int64), 0
        lanes = -(-(lengths[texts] - m + 1) // LANE)
        lane = np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        at = np.repeat(first[texts], lanes) + lane * LANE + m - 1
        stop = np.minimum(at + LANE, np.repeat(first[texts + 1], lanes))
        found, looked = [], 0
        step = self.shift[self._slot(blocks)]
        while len(at):
            looked += len(at)
            jump = step[at]
            if (hit := jump == 0).any():
                found.append(at[hit])
            at = at + np.maximum(jump, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64), looked

    def matches(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(last word, sequence) of all true occurrences."""
        blocks = blocks_of(words.hash, self.block)
        ends, _ = self.ends(words, blocks)
        if not len(ends):
            return ends, ends
        wanted = self._bucket(blocks, ends)
        low, high = np.searchsorted(self.bucket, wanted), np.searchsorted(self.bucket, wanted, "right")
        last = np.repeat(ends, high - low)
        which = np.repeat(low - np.cumsum(high - low) + (high - low), high - low) + np.arange((high - low).sum())
        span = np.arange(self.m)
        same = (words.hash[last[:, None] + span + 1 - self.m] == self.book.hash[self.at[which][:, None] + span]).all(axis=1)
        last, which = last[same], which[same]
        data, start, end = words.data, words.start, words.end
        true = np.array([
            b" ".join(data[start[i] : end[i]].tobytes() for i in range(e - self.m + 1, e + 1)) == self.book.spelled(p, self.m)
            for e, p in zip(last.tolist(), self.at[which].tolist(), strict=True)
        ], bool)
        return last[true], which[true]

    def items(self, sequence: int) -> list[str]:
        return [self.names[i] for i in self.owners[self.low[sequence] : self.high[sequence]].tolist()]


def build(items: list[tuple[str | None, str | None]], window: int = WINDOW) -> list[WuManber]:
    """One searcher for each length of window among ``items`` (id, text)."""
    book = Book([to_bytes(t) for _, t in items])
    names = sorted({i for i, _ in items if i is not None})
    number = {name: k for k, name in enumerate(names)} | {None: -1}
    named = np.array([number[i] for i, _ in items], np.int64)
    first = np.searchsorted(book.owner, np.arange(len(items) + 1))
    lengths = np.diff(first)
    sizes = np.minimum(lengths, window)
    made = []
    for m in np.unique(sizes[sizes > 0]).tolist():
        own = np.flatnonzero(sizes == m)
        windows = lengths[own] - m + 1
        at = np.repeat(first[own] - np.cumsum(windows) + windows, windows) + np.arange(windows.sum())
        owner = np.repeat(named[own], windows)
        # equal windows stand together, and of those the same item's
        mixed = np.zeros(len(at), np.uint64)
        for k in range(m):
            mixed = mixed * np.uint64(0xD6E8FEB86659FD93) + book.hash[at + k]
        order = np.lexsort((owner, mixed))
        at, owner, mixed = at[order], owner[order], mixed[order]
        fresh = np.concatenate([[True], mixed[1:] != mixed[:-1]])
        for i in np.flatnonzero(~fresh).tolist():
            fresh[i] = book.spelled(at[i], m) != book.spelled(at[i - 1], m)
        sequence = np.cumsum(fresh) - 1
        once = np.concatenate([[True], (sequence[1:] != sequence[:-1]) | (owner[1:] != owner[:-1])]) & (owner >= 0)
        owner_first = np.searchsorted(sequence[once], np.arange(sequence[-1] + 2))
        made.append(WuManber(m, book, at[fresh], owner[once].astype(np.int32), owner_first, names))
    return made


def scan(texts: list[str | None], searchers: list[WuManber]) -> Iterator[tuple[int, np.ndarray, set[str]]]:
    """For each text: its number of words, its hit words (positions), the items found."""
    raw = [to_bytes(t) for t in texts]
    for begin, end in packs(raw):
        words = Words(raw[begin:end], ALPHANUMERIC)
        n = end - begin
        hit, found = np.zeros(len(words) + 1, np.int32), [set() for _ in range(n)]
        for s in searchers:
            at, which = s.matches(words)
            np.add.at(hit, at - s.m + 1, 1)
            np.add.at(hit, at + 1, -1)
            for d, p in zip((np.searchsorted(words.first, at, "right") - 1).tolist(), which.tolist(), strict=True):
                found[d].update(s.items(p))
        marked = np.cumsum(hit[:-1]) > 0
        for i in range(n):
            a, b = words.first[i], words.first[i + 1]
            yield int(b - a), np.flatnonzero(marked[a:b]), found[i]


def _runs(text: str | None, most: int, window: int) -> Iterator[str]:
    """``text`` in runs of whole words of about ``most`` bytes, each beginning window - 1 words before the last one's end."""
    raw = to_bytes(text)
    if len(raw) <= most:
        yield text
        return
    words = Words([raw], ALPHANUMERIC, hashes=False)
    at = 0
    while at < len(words):
        end = max(int(np.searchsorted(words.end, words.start[at] + most, "right")), min(at + window, len(words)))
        yield raw[words.start[at] : words.end[end - 1]].decode("utf-8", "surrogatepass")
        at = len(words) if end == len(words) else end - window + 1


def benchmark_blocks(benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple]]:
    """(item_id, text) in lists of about ``block_bytes`` bytes of text, never all at once."""
    block, held = [], 0
    for row in benchmark.select(F.col("item_id").cast("string"), "text").toLocalIterator():
        for run in _runs(row[1], block_bytes, window):
            size = len(to_bytes(run)) + 64
            if block and held + size > block_bytes:
                yield block
                block, held = [], 0
            block.append((row[0], run))
            held += size
    if block:
        yield block


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """``docs`` plus n_words, hit_words (positions, ascending) and item_ids (sorted strings)."""
    need(docs, text_col)
    need(benchmark, "item_id", "text")
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.drop("n_words", "hit_words", "item_ids")
    added = [
        T.StructField("n_words", T.LongType()),
        T.StructField("hit_words", T.ArrayType(T.IntegerType())),
        T.StructField("item_ids", T.ArrayType(T.StringType())),
    ]

    def searching(tables, text: str, columns: list[str], hits_only: bool):
        def run(frames):
            searchers = tables.value if tables is not None else []
            for pdf in frames:
                n, hits, items = zip(*scan(pdf[text].tolist(), searchers), strict=True) if len(pdf) else ((), (), ())
                out = pdf[columns].assign(
                    n_words=pd.Series(n, dtype="int64", index=pdf.index),
                    hit_words=pd.Series([h.astype(np.int32) for h in hits], dtype=object, index=pdf.index),
                    item_ids=pd.Series([sorted(i) for i in items], dtype=object, index=pdf.index),
                )
                yield out[[len(h) > 0 for h in hits]].drop(columns="n_words") if hits_only else out

        return run

    blocks = benchmark_blocks(benchmark, window, block_bytes)
    block, following = next(blocks, None), next(blocks, None)
    if following is None:
        tables = spark.sparkContext.broadcast(build(block, window)) if block else None
        return docs.mapInPandas(searching(tables, text_col, docs.columns, False), T.StructType([*docs.schema.fields, *added]))

    scratch = Scratch(spark, "decontamination")
    key = lambda text: [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("text"), text).alias("k2")]
    texts = docs.select(F.col(f"`{text_col}`").alias("text")).filter("text is not null").select(*key(F.col("text")), "text")
    keys = [T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType())]
    made, like = 0, None
    while block is not None:
        tables = spark.sparkContext.broadcast(build(block, window))
        hits = texts.mapInPandas(searching(tables, "text", ["k1", "k2"], True), T.StructType([*keys, *added[1:]]))
        once = hits.groupBy("k1", "k2").agg(F.first("hit_words").alias("hit_words"), F.first("item_ids").alias("item_ids"))
        like = scratch.write(once, f"hits/block={made}")
        tables.destroy()
        block, following, made = following, next(blocks, None), made + 1
    every = spark.read.schema(like.schema).parquet(scratch.path("hits")).groupBy("k1", "k2")
    united = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    found = scratch.write(every.agg(united("hit_words").alias("hit_words"), united("item_ids").alias("item_ids")), "found")
    scratch.remove("hits")
    # Rows travel as one column, so that no name of theirs can clash.
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    joined = docs.select(row, *key(F.col(f"`{text_col}`"))).join(found, ["k1", "k2"], "left")
    return joined.select(
        *[F.col("row")[c].alias(c) for c in docs.columns],
        F.coalesce(F.regexp_count(F.col("row")[text_col], F.lit(WORD)), F.lit(0)).cast("long").alias("n_words"),
        F.coalesce("hit_words", F.array().cast("array<int>")).alias("hit_words"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
    )


def item_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without those that hold a window of a benchmark item."""
    found = find_contamination(plainly_named(docs), benchmark, text_col=place_of(docs, "text"))
    return named_as(found.filter(F.size("hit_words") == 0), docs)


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("hit_words").cast("long").alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hit_words") > 0).alias("contaminated"),
    )


_WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP1_SQL = rf"""
WITH items AS (
  SELECT item_id, ws, least(10, len(ws)) AS m FROM (SELECT item_id, {_WORDS_SQL} AS ws FROM benchmark) WHERE len(ws) > 0
), windows AS (
  SELECT DISTINCT item_id, m, array_to_string(ws[i + 1:i + m], ' ') AS w FROM (SELECT *, unnest(range(0, len(ws) - m + 1)) AS i FROM items)
), docs AS (
  SELECT row_number() OVER () AS r, doc_id, {_WORDS_SQL} AS ws FROM documents
), spots AS (
  SELECT r, m, i, array_to_string(ws[i + 1:i + m], ' ') AS w
  FROM (SELECT r, ws, m, unnest(range(0, len(ws) - m + 1)) AS i FROM docs CROSS JOIN (SELECT DISTINCT m FROM windows) WHERE len(ws) >= m)
), found AS (SELECT r, m, i, item_id FROM spots JOIN windows USING (m, w)
), hits AS (SELECT r, count(DISTINCT spot)::BIGINT AS n FROM (SELECT r, unnest(range(i, i + m)) AS spot FROM found) GROUP BY r
), names AS (SELECT r, count(*)::BIGINT AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS item_id FROM found) GROUP BY r
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(hits.n, 0) AS n_hit, coalesce(names.n, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(hits.n, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (r) LEFT JOIN names USING (r)
"""
