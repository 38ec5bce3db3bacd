"""Cross-tokenizer alignment: an event sweep over the token ends of two tokenizers.

Both tokenizers encode each text; where a token of either ends is an event. Events are the rows
that Spark deals out: side A and side B are united, dealt by document and sorted within
partitions by offset, and one pass streams through each partition. Its state is the open group,
that is the events since both sides last ended together; there it emits the group and its
links, a link for each stretch between neighbouring ends, as that is where one A token meets
one B token. To keep rows few, a row carries the consecutive events of one side within
``SPAN`` bytes of a document, as ids: lengths follow from the vocabulary.

Links are counted in three passes over a table of each document's distinct links: documents
for each pair of ids (combined in tasks, then by a shuffle), each A id's highest count (one row
for an id), and the sums for each document. For those sums the most common pairs, at most
``HOT_PAIRS``, are broadcast; links of rarer pairs meet their counts by a shuffle, in which no
pair is hot, as all common ones are gone.

Long texts are cut at single spaces between characters that are not white space. No token crosses
such a place (checked against both vocabularies when they are loaded; otherwise texts are encoded
whole). Tokenizer files are read by the driver and broadcast.

Defined results: null and empty texts, and texts that a tokenizer doesn't give back byte for byte,
have no tokens: counts of 0 and no digest; repeated rows are documents of their own; rows
without id are kept; texts of any length are swept in spans (a stretch without a single space
is encoded in one piece; an open group is held until it closes); an empty table gives no rows;
other columns are not returned. Rows are told apart by their place in the partitions of the
input, so the input should be a table, or a deterministic query of one.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Scratch, need

TOKENIZERS = "/opt/tokenizers"
#: Bytes of a document whose events of one side share a row.
SPAN = 1 << 15
#: Pairs of ids that are broadcast at most: 17 bytes each.
HOT_PAIRS = 1 << 20
#: Characters of texts whose events are put together, and of a piece of a long text that is encoded alone.
PACK, PIECE = 1 << 19, 1 << 19
#: Distinct pairs that a task combines before it passes them on, and links of one output row.
COMBINED, ROW_LINKS = 1 << 20, 1 << 15

_CUT = re.compile(r"(?<=\S) (?=\S)")


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


#: How byte-level vocabularies of this family split texts before merging. A fixed value.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _by_ranks(a_json: bytes):
    """A faster encoder with the ids of ``a_json``, if that is plain byte-level BPE whose ids follow its merges."""
    import tiktoken

    told = json.loads(a_json)
    model, split = told["model"], told.get("pre_tokenizer") or {}
    alphabet, vocabulary = byte_alphabet(), model.get("vocab", {})
    plain = model.get("type") == "BPE" and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
    plain = plain and not told.get("normalizer") and not any(model.get(k) for k in ("dropout", "end_of_word_suffix", "continuing_subword_prefix", "ignore_merges"))
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
    if not plain or any(vocabulary.get("".join(m)) != 256 + i for i, m in enumerate(pairs)):
        return None
    ranks = {bytes(alphabet[c] for c in t): i for t, i in vocabulary.items() if i < 256 + len(pairs)}
    return tiktoken.Encoding("a", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


class Encoders:
    """Both tokenizers and their tokens' bytes."""

    def __init__(self, a_json: bytes, b_model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_json.decode())
        self.a.encode_special_tokens = True
        self.fast_a = _by_ranks(a_json)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        alphabet = byte_alphabet()
        vocabulary = self.a.get_vocab()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        self.bytes_b = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.bytes_b.append(bytes([int(piece[3:-1], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        self.length_a, self.length_b = (np.array([len(x) for x in side], np.int64) for side in (self.bytes_a, self.bytes_b))
        self.flat = [(np.frombuffer(b"".join(side), np.uint8), np.cumsum(n) - n) for side, n in ((self.bytes_a, self.length_a), (self.bytes_b, self.length_b))]
        self.separable = not any(_CUT.search(x.decode(errors="replace")) for side in (self.bytes_a, self.bytes_b) for x in side)

    def pieces(self, text: str) -> list[str]:
        """``text`` in pieces of about ``PIECE`` characters that are encoded alone; a space stood between them."""
        out, begin = [], 0
        while self.separable and len(text) - begin > PIECE and (cut := _CUT.search(text, begin + PIECE)):
            out.append(text[begin : cut.start()])
            begin = cut.end()
        return [*out, text[begin:]]

    def _ids(self, pieces: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        spaced = [f" {p}" for p in pieces]
        a = [self.fast_a.encode_ordinary(p) for p in spaced] if self.fast_a else [e.ids for e in self.a.encode_batch(spaced, add_special_tokens=False)]
        return a, [self.b.EncodeAsIds(p) for p in pieces]  # a list would start a pool of threads each time

    def _whole(self, side: int, ids: np.ndarray, text: np.ndarray) -> bool:
        """Whether the tokens' bytes are those of ``text``."""
        length = (self.length_a, self.length_b)[side][ids]
        ends = np.cumsum(length)
        if not len(ids) or ends[-1] != len(text):
            return False
        flat, start = self.flat[side]
        return np.array_equal(flat[np.repeat(start[ids] - ends + length, length) + np.arange(len(text))], text)

    def encode(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of A and of B for each text; none for texts that don't come back whole."""
        for text in texts:
            a, b = self._ids(self.pieces(text)) if text else ([], [])
            a, b = (np.array(x[0] if len(x) == 1 else list(chain.from_iterable(x)), np.int64) for x in (a, b))
            whole = np.frombuffer(f" {text}".encode(), np.uint8)
            if self._whole(0, a, whole) and self._whole(1, b, whole):
                yield a, b
            else:
                yield np.zeros(0, np.int64), np.zeros(0, np.int64)


_loaded: dict[str, Encoders] = {}


def encoders(files: Broadcast) -> Encoders:
    """The encoders of this worker, loaded once."""
    a, b, name = files.value
    if name not in _loaded:
        _loaded[name] = Encoders(a, b)
    return _loaded[name]


def _packs(texts: list[str | None]) -> Iterator[list[int]]:
    held, size = [], 0
    for i, text in enumerate(texts):
        held.append(i)
        size += len(text or "")
        if size >= PACK:
            yield held
            held, size = [], 0
    if held:
        yield held


def _spans(ids: np.ndarray, length: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(span, ids) of the tokens that end in each span of a document."""
    ends = np.cumsum(length[ids])
    if len(ids) and ends[-1] <= SPAN:
        yield 0, packed(ids)
        return
    span = (ends - 1) // SPAN
    cuts = [0, *(np.flatnonzero(np.diff(span)) + 1).tolist(), len(ids)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield int(span[a]), packed(ids[a:b])


def packed(ids: np.ndarray) -> bytes:
    """Ids in two bytes each, or four, after that number; the shuffle compresses them."""
    width = 2 if not len(ids) or ids.max() < 1 << 16 else 4
    return bytes([width]) + ids.astype(f"<u{width}").tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)


def end_events(docs: DataFrame, id_col: str, text_col: str, files: Broadcast) -> DataFrame:
    """(key, span, side, id, ids): the end events of both sides; each document has a first row of side 0."""
    kept = T.StructType([T.StructField(n, t) for n, t in (("key", T.LongType()), ("span", T.LongType()), ("side", T.IntegerType()), ("id", docs.schema[id_col].dataType), ("ids", T.BinaryType()))])
    numbered = docs.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = encoders(files)
        for batch in batches:
            keys, ids, texts = (batch.column(c) for c in ("key", "id", "text"))
            texts, names = texts.to_pylist(), keys.to_pylist()
            for pack in _packs(texts):
                rows = []
                for i, (a, b) in zip(pack, both.encode([texts[i] for i in pack]), strict=True):
                    rows.append((i, -1, 0, None))
                    rows += [(i, s, 0, raw) for s, raw in _spans(a, both.length_a)]
                    rows += [(i, s, 1, raw) for s, raw in _spans(b, both.length_b)]
                of, span, side, raw = zip(*rows, strict=True)
                heads = pa.array([i if s < 0 else None for i, s in zip(of, span, strict=True)], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([names[i] for i in of], pa.int64()), pa.array(span, pa.int64()), pa.array(side, pa.int32()), ids.take(heads), pa.array(raw, pa.binary())],
                    kept.names,
                )

    return numbered.mapInArrow(run, kept)


class Sweep:
    """The machine that one document's events pass through."""

    def __init__(self, both: Encoders, written: np.ndarray):
        self.length = (both.length_a, both.length_b)
        self.written = written
        self.ends = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.ids = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.at = [0, 0]
        self.tokens, self.groups, self.links = [0, 0], 0, 0
        self.digest = hashlib.sha256()
        self.found: list[tuple[np.ndarray, np.ndarray]] = []

    def feed(self, side: int, ids: np.ndarray) -> None:
        ends = self.at[side] + np.cumsum(self.length[side][ids])
        self.at[side] = int(ends[-1])
        self.tokens[side] += len(ids)
        self.ends[side] = np.concatenate([self.ends[side], ends])
        self.ids[side] = np.concatenate([self.ids[side], ids])

    def close(self) -> None:
        """Emit all groups that are whole."""
        place = np.searchsorted(self.ends[1], self.ends[0])
        in_b = place < len(self.ends[1])
        in_b[in_b] = self.ends[1][place[in_b]] == self.ends[0][in_b]
        common = self.ends[0][in_b]
        if not len(common):
            return
        upto = [int(np.searchsorted(e, common[-1], "right")) for e in self.ends]
        ends, ids = ([x[s][: upto[s]] for s in (0, 1)] for x in (self.ends, self.ids))
        for s in (0, 1):
            self.ends[s], self.ids[s] = self.ends[s][upto[s] :], self.ids[s][upto[s] :]
        cut = np.sort(np.concatenate([ends[0][~in_b[: upto[0]]], ends[1]]), kind="stable")
        code = (ids[0][np.searchsorted(ends[0], cut)] << 32) | ids[1][np.searchsorted(ends[1], cut)]
        self._count(code, np.ones(len(code), np.int64))
        order = np.concatenate([np.searchsorted(common, ends[s]) * 2 + s for s in (0, 1)])
        sort = np.argsort(order, kind="stable")
        place = order[sort]
        fresh = np.concatenate([[True], place[1:] != place[:-1]])
        between = np.where(fresh, np.where(place % 2 == 1, b"|", b";"), b",").astype(object)
        if not self.groups:
            between[0] = b""
        parts = np.empty(2 * len(sort), object)
        parts[0::2], parts[1::2] = between, self.written[np.concatenate(ids)[sort]]
        self.digest.update(b"".join(parts.tolist()))
        self.groups += len(common)
        self.links += len(code)

    def _count(self, code: np.ndarray, times: np.ndarray) -> None:
        self.found.append((code, times))
        if sum(len(c) for c, _ in self.found) > COMBINED:
            self.found = [self.distinct()]

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """Each link of the document once, in order, and how often it occurs."""
        return _summed(*[np.concatenate([x[i] for x in self.found] or [np.zeros(0, np.int64)]) for i in (0, 1)])


def _summed(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(code, kind="stable")
    code, n = code[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
    return code[first], np.add.reduceat(n, first) if len(first) else n


_LINKS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a array<int>, b array<int>, times array<int>"


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*arrays, np.zeros(0, np.int32)]).astype(np.int32)))


def sweep_documents(events: DataFrame, files: Broadcast) -> DataFrame:
    """A row for each document with its counts, digest and distinct links; further rows, without counts, for more than ``ROW_LINKS`` links."""
    schema = T.StructType([events.schema["key"], events.schema["id"], *T._parse_datatype_string(_LINKS).fields])
    ordered = events.repartition(F.col("key")).sortWithinPartitions("key", "span", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = encoders(files)
        written = np.array([str(i).encode() for i in range(max(len(both.length_a), len(both.length_b)))], object)
        key, machine, done, links = None, None, [], []
        id_type = None

        def finish() -> None:
            code, times = machine.distinct()
            some = machine.tokens[0] > 0
            for at in range(0, max(len(code), 1), ROW_LINKS):
                counts = (*machine.tokens, machine.groups, machine.links, machine.digest.hexdigest() if some else "") if at == 0 else (None,) * 5
                done.append((key, name if at == 0 else None, *counts))
                part = code[at : at + ROW_LINKS]
                links.append((part >> 32, part & 0xFFFFFFFF, times[at : at + ROW_LINKS]))

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True))
            types = [pa.int64(), id_type, *[pa.int64()] * 4, pa.string()]
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)] + [_lists([x[i] for x in links]) for i in range(3)]
            done.clear()
            links.clear()
            return pa.RecordBatch.from_arrays(arrays, schema.names)

        for batch in batches:
            id_type = batch.column("id").type
            for k, side, who, raw in zip(*[batch.column(c).to_pylist() for c in ("key", "side", "id", "ids")], strict=True):
                if k != key:
                    if machine is not None:
                        finish()
                    if sum(len(x[0]) for x in links) + len(links) > ROW_LINKS * 4:
                        yield batch_of()
                    key, name, machine = k, who, Sweep(both, written)
                    continue  # the first row of a document has no events
                machine.feed(side, unpacked(raw))
                if side == 1:
                    machine.close()
        if machine is not None:
            finish()
        if done:
            yield batch_of()

    return ordered.mapInArrow(run, schema)


def pair_counts(links: DataFrame) -> DataFrame:
    """(a, b, docs, best): documents that hold each pair of ids linked, and whether no pair of that A id has more."""

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, docs = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            fresh = _codes(batch)
            code, docs = _summed(np.concatenate([code, fresh]), np.concatenate([docs, np.ones(len(fresh), np.int64)]))
            if len(code) > COMBINED:
                yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(docs)], ["code", "docs"])
                code, docs = code[:0], docs[:0]
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(docs)], ["code", "docs"])

    counts = links.select("a", "b").mapInArrow(combine, "code long, docs long").groupBy("code").agg(F.sum("docs").alias("docs"))
    counts = counts.withColumn("a", F.shiftright("code", 32))
    most = counts.groupBy("a").agg(F.max("docs").alias("most"))
    return counts.join(most, "a").select("code", "docs", (F.col("docs") == F.col("most")).alias("best"))


def _codes(batch: pa.RecordBatch) -> np.ndarray:
    a, b = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("a", "b"))
    return (a << 32) | b


def common_pairs(counts: DataFrame, most: int) -> tuple[DataFrame, int]:
    """The pairs of at least so many documents that they are at most ``most``, and that number of documents."""
    bits = F.length(F.bin("docs"))
    sizes = {r["w"]: r["n"] for r in counts.groupBy(bits.alias("w")).agg(F.count(F.lit(1)).alias("n")).collect()}  # 63 rows at most
    total, least = 0, 63
    for w in sorted(sizes, reverse=True):
        total += sizes[w]
        if total > most:
            break
        least = w
    bound = 1 << (least - 1) if sizes else 1
    return counts.filter(F.col("docs") >= bound), bound


def link_sums(links: DataFrame, counts: DataFrame, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """(key, n_best, count_sum) summed over each document's links."""
    spark = links.sparkSession
    hot, bound = common_pairs(counts, hot_pairs)
    held = hot.toArrow()  # hot_pairs rows at most
    code = held["code"].to_numpy()
    order = np.argsort(code)
    table = spark.sparkContext.broadcast((code[order], held["docs"].to_numpy()[order], held["best"].to_numpy(zero_copy_only=False).astype(bool)[order]))

    def look_up(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        codes, docs, best = table.value
        mine = _codes(batch)
        at = np.minimum(np.searchsorted(codes, mine), max(len(codes) - 1, 0))
        known = codes[at] == mine if len(codes) else np.zeros(len(mine), bool)
        times = batch.column("times").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        per = np.diff(batch.column("a").offsets.to_numpy())
        return mine, at, known, times, per

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, docs, best = table.value
        for batch in batches:
            mine, at, known, times, per = look_up(batch)
            row = np.repeat(np.arange(len(per)), per)[known]
            times, at = times[known], at[known]
            n_best, total = np.zeros(len(per), np.int64), np.zeros(len(per), np.int64)
            np.add.at(n_best, row, times * best[at])
            np.add.at(total, row, times * docs[at])
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(n_best), pa.array(total)], ["key", "n_best", "count_sum"])

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine, _, known, times, per = look_up(batch)
            keys = np.repeat(batch.column("key").to_numpy(), per)
            yield pa.RecordBatch.from_arrays([pa.array(keys[~known]), pa.array(mine[~known]), pa.array(times[~known])], ["key", "code", "times"])

    rows = links.select("key", "a", "b", "times")
    sums = rows.mapInArrow(add, "key long, n_best long, count_sum long")
    if bound > 1:  # there are pairs that aren't broadcast
        rest = rows.mapInArrow(rare, "key long, code long, times long").join(counts.filter(F.col("docs") < bound), "code")
        sums = sums.unionByName(rest.select("key", F.when(F.col("best"), F.col("times")).otherwise(0).alias("n_best"), (F.col("times") * F.col("docs")).alias("count_sum")))
    return sums.groupBy("key").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def read_files(spark: SparkSession, a_path: str, b_path: str) -> Broadcast:
    with open(a_path, "rb") as a, open(b_path, "rb") as b:
        raw = a.read(), b.read()
    return spark.sparkContext.broadcast((*raw, hashlib.sha256(raw[0] + raw[1]).hexdigest()))


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", hot_pairs: int = HOT_PAIRS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, links, counts): a row for each document; each document's distinct links with times; counts of all pairs of ids."""
    need(docs, id_col, text_col)
    files = read_files(docs.sparkSession, a_path, b_path)
    scratch = Scratch(docs.sparkSession, "alignment")
    links = scratch.write(sweep_documents(end_events(docs, id_col, text_col, files), files), "links", compression="zstd")
    counts = scratch.write(pair_counts(links), "counts", compression="zstd")
    sums = link_sums(links, counts, hot_pairs)
    whole = links.filter("n_a is not null").drop("a", "b", "times").join(sums, "key", "left")
    return whole, links.select("key", "a", "b", "times"), counts


def op13_token_alignment(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows, _, _ = align(docs, f"{tokenizers}/byte_bpe_50k.json", f"{tokenizers}/piece_bpe_32k.model")
    return rows.select(F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
