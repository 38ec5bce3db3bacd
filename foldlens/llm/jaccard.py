"""N-gram Jaccard join by universe partition and pigeonhole, for near duplicates.

Sets. A document's set are the hashes (64 bits) of its distinct word shingles. Documents
with equal sets form a class; only one member of a class goes on, so copies cost nothing.

Signatures. Sizes are cut into bands [lo, lo / t]; two sets with similarity t or more lie in
the same band or in neighbouring ones, so each set signs for its own band and for the next
one. Within a band at most H = 2 hi (1 - t) / (1 + t) elements of a similar pair differ. The
universe is cut by hash into m = H + 1 + k segments: at least k + 1 of them must be equal in
both sets, and their signatures (band, segment, sum of mixed elements) meet there.

Allocation. Of its m segments a set may skip the k costliest. The cost of a segment is
measured: it is the number of sets, over all documents, that share its signature, which is
known where signatures meet; empty segments, which meet all others without elements there,
cost most. Equal segments cost the same on both sides, so the cheapest of a similar pair's
k + 1 equal segments has k costlier ones on neither side and is skipped by neither: no pair is
lost, and a passage that many documents share makes no bucket as long as its sets have cheaper
segments. A set with z > k empty segments skips those, and what that leaves uncovered is
given to one-deletion neighbourhoods (the segment, and it without each element) of its first
z - k non-empty segments. This loses no pair either: if no non-empty segment is equal and z'
segments are empty in both, then the other H + 1 + k - z' segments differ in at most H
elements, so at most z' - k - 1 of them in more than one, and of the first z' - k of them
one differs in just one element. (Such a set also signs, as empty, the empty segments on the
way there; where half or more of the segments are empty, the empty ones are signed as well.)

Packing. Signatures are many and mostly unique, so they don't travel as rows: a task packs
those of many documents by destination (6 bytes and a 2-byte place in the pack's list of
classes), and a destination sorts what it gets and reports shared signatures only.

Filter. Every class has a sketch: how many of its elements fall into each of 64 or more parts
of the universe. The sum of the absolute differences of two sketches never exceeds the number
of elements in which the sets differ, so it drops most chance meetings and no link. In each
bucket (a set of classes with a common signature) classes that pass are joined into trees.

Verification. Connected candidates form a cluster; its sets are compared exactly, by an
inverted list of elements, and only links that join two components are returned.

Large groups. Buckets and clusters are dealt to chunks of about ``CHUNK_SETS`` sets (clusters:
``CHUNK_ELEMENTS`` elements, too). First each chunk is compared within itself and with about
``PIVOTS`` sets of the whole group. A group of near copies is connected by that, at a cost
that grows with its size only. What isn't connected to the group's largest component by then
is compared with all of the group, in pieces of two chunks. So k copies of one text cost about
k comparisons with the pivots; in a group whose members are similar by sketch but not linked,
all members stay outside and all pairs of chunks are tried, which grows with its square.
Components of candidates and of links come from alternating large-star and small-star steps,
which end when nothing changes. Tables in between are written to the shared folder and
removed; joins on nodes that hold many rows are split (``join_by_weight``).

Defined results: a null or empty text, or one without words, has an empty set and is linked
with nothing; fewer words than a shingle make one element; texts of any length are shingled
whole (a text's memory is about 60 bytes a word); ids are integers; a row without id is linked
with nothing and has no component; rows with the same id are one document with several texts
and share their component; an empty table gives an empty one; other columns stay out of the
join, whatever their names.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Scratch, bounded_batches, join_by_weight, named_as, need, place_of, plainly_named
from .words import NOT_BLANK, Words, mix64, packs, to_bytes

CHUNK_SETS = 256
CHUNK_ELEMENTS = 1 << 20
#: Sets of a large group that all its chunks are compared with.
PIVOTS = 16
#: About so many signatures (8 bytes each) meet in one task.
PART_SIGNS = 1 << 21
#: Elements in a part of a sketch.
PART_ELEMENTS = 8
#: Signatures that a task collects before it packs them.
PACK_SIGNS = 1 << 19
#: Up to so many clustered sets (8 bytes each and their cluster) are broadcast to the texts.
BROADCAST_NODES = 500_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SALTS = np.array([0x632BE59BD9B4E019, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


class Bands:
    """Size bands of a threshold num / den: ``edge[b]`` is the smallest size of band b."""

    def __init__(self, num: int, den: int):
        self.t = Fraction(num, den)
        self.edge = [1]

    def reach(self, size: int) -> None:
        while self.edge[-1] <= size:
            self.edge.append(int(self.edge[-1] / self.t) + 1)

    def of(self, sizes: np.ndarray) -> np.ndarray:
        self.reach(int(sizes.max(initial=1)) + 1)
        return np.searchsorted(self.edge, sizes, "right") - 1

    def segments(self, band: int) -> tuple[int, int]:
        """(m, k) = (H + 1 + k, a quarter of H) for sets of band ``band`` or the one below."""
        while len(self.edge) <= band + 1:
            self.reach(self.edge[-1])
        high = self.edge[band + 1] - 1
        differ = int(2 * high * (1 - self.t) / (1 + self.t))
        spare = (differ + 3) // 4
        return differ + 1 + spare, spare


def shingle_sets(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(elements, sorted within each text; number of elements of each text)."""
    words = Words(texts, NOT_BLANK)
    counts = np.diff(words.first)
    per = np.where(counts == 0, 0, np.maximum(counts - n + 1, 1))
    owner = np.repeat(np.arange(len(texts)), per)
    at = np.repeat(words.first[:-1], per) + np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
    element = np.zeros(len(owner), np.uint64)
    short = counts[owner] < n
    for k in range(n):
        use = ~short | (k < counts[owner])
        element[use] = mix64(element[use] * _ODD + words.hash[at[use] + k] + np.uint64(k + 1))
    order = np.lexsort((element, owner))
    element, owner = element[order], owner[order]
    fresh = np.ones(len(owner), bool)
    fresh[1:] = (element[1:] != element[:-1]) | (owner[1:] != owner[:-1])
    return element[fresh], np.bincount(owner[fresh], minlength=len(texts))


def _class_hash(element: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set, whatever its order; 0 for empty sets."""
    begin, full = np.cumsum(per) - per, per > 0
    found = []
    for salt in _SALTS[:2]:
        sums = np.zeros(len(per), np.uint64)
        if full.any():
            sums[full] = mix64(np.add.reduceat(mix64(element ^ salt), begin[full]) + per[full].astype(np.uint64))
        found.append(sums.view(np.int64))
    return found[0], found[1]


def signatures(element: np.ndarray, per: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set, signature) rows, two bands for each set, and how many each set may skip in each band.

    The last bit of a signature is that of its band. Empty sets sign nothing.
    """
    own_band = bands.of(np.maximum(per, 1))
    owners, signs = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    skip = np.zeros((len(per), 2), np.int64)
    set_of = np.repeat(np.arange(len(per)), per)
    value = mix64(element ^ _SALTS[2])
    for step in (0, 1):
        tags = own_band + step
        cut = {int(b): bands.segments(int(b)) for b in np.unique(tags[per > 0])}
        m, spare = (np.array([cut.get(int(b), (1, 0))[i] for b in tags], np.int64) for i in (0, 1))
        base = np.cumsum(m) - m  # the first segment of each set in one long list of segments
        spot = base[set_of] + (mix64(element ^ (_SALTS[3] + tags[set_of].astype(np.uint64))) % m[set_of].astype(np.uint64)).astype(np.int64)
        order = np.argsort(spot, kind="stable")
        spot, held = spot[order], value[order]
        if not len(spot):
            continue
        first = np.flatnonzero(np.append(True, spot[1:] != spot[:-1]))
        where, sums = spot[first], np.add.reduceat(held, first)
        size = np.diff(np.append(first, len(spot)))
        owner = set_of[order][first]
        part = where - base[owner]
        place = mix64(tags[owner].astype(np.uint64) * _ODD + part.astype(np.uint64))
        owners.append(owner)
        signs.append(_of_band(mix64(sums + place), tags[owner]))
        empty = np.where(per > 0, m - np.bincount(owner, minlength=len(per)), 0)
        skip[np.arange(len(per)), tags & 1] = np.where(per > 0, np.maximum(spare - empty, 0), 0)
        for i in np.flatnonzero(empty > spare):
            mine = slice(*np.searchsorted(owner, [i, i + 1]))
            extra = _neighbourhoods(part[mine], size[mine], first[mine], sums[mine], held, int(empty[i]), int(spare[i]), int(m[i]), int(tags[i]))
            owners.append(np.full(len(extra), i))
            signs.append(_of_band(extra, tags[i]))
    return np.concatenate(owners), np.concatenate(signs), skip


def _of_band(sign: np.ndarray, tag) -> np.ndarray:
    return (sign & ~np.uint64(1)) | (np.asarray(tag).astype(np.uint64) & np.uint64(1))


def _neighbourhoods(part, size, first, sums, held, empty: int, spare: int, m: int, tag: int) -> np.ndarray:
    """What a set with more ``empty`` segments than it may skip signs besides its segments."""
    place = lambda segment, salt: mix64(np.uint64(tag) * _ODD + np.uint64(segment)) ^ salt
    z = empty - spare
    found = []
    with np.errstate(over="ignore"):
        for k in range(min(z, len(part))):
            less = sums[k] - held[first[k] : first[k] + size[k]]
            found.append(mix64(np.append(less, sums[k]) + place(part[k], _SALTS[0])))
        gone = np.setdiff1d(np.arange(m), part)
        passed = gone[gone < part[z - 1]] if z <= len(part) else gone
        if z > 1 and len(passed):  # an empty segment is what a single element leaves
            found.append(np.array([mix64(place(s, _SALTS[0]).reshape(1))[0] for s in passed], np.uint64))
        if 2 * empty >= m + spare:
            found.append(np.array([mix64(place(s, _SALTS[1]).reshape(1))[0] for s in gone], np.uint64))
    return np.concatenate(found)


def sketches(element: np.ndarray, per: np.ndarray) -> list[bytes]:
    """How many elements of each set are in each part of the universe, a byte for each part.

    A set of n elements has 64, 128, ... parts, about n / 8 and more: with larger parts
    unrelated large sets would look alike. Counts are cut off at 255; cut-off counts differ
    less, never more.
    """
    owner = np.repeat(np.arange(len(per)), per)
    bits = 6 + np.ceil(np.log2(np.maximum(per / (64 * PART_ELEMENTS), 1))).astype(np.int64)
    parts = 1 << bits
    begin = np.cumsum(parts) - parts
    spot = begin[owner] + (mix64(element ^ _SALTS[0]) >> (64 - bits[owner]).astype(np.uint64)).astype(np.int64)
    counts = np.minimum(np.bincount(spot, minlength=int(parts.sum())), 255).astype(np.uint8)
    return [row.tobytes() for row in np.split(counts, begin[1:])]


def aligned(raw: list[bytes]) -> np.ndarray:
    """Sketches with as many parts as the shortest: neighbouring parts are added."""
    least = min(map(len, raw))
    rows = [np.frombuffer(r, np.uint8).reshape(least, -1).sum(axis=1, dtype=np.int32) for r in raw]
    return np.minimum(np.stack(rows), 255)


#: Ids pass as text: as pandas numbers they would be rounded where some are NULL.
_THIN = [T.StructField("id", T.StringType()), *[T.StructField(c, T.LongType()) for c in ("n_shingles", "c1", "c2", "skip0", "skip1")], T.StructField("sketch", T.BinaryType())]
SIGNED = T.StructType([T.StructField("part", T.IntegerType()), *_THIN, *[T.StructField(c, T.BinaryType()) for c in ("signs", "owners", "classes")]])
MET = T.StructType([T.StructField("kind", T.IntegerType()), *_THIN, *[T.StructField(c, T.LongType()) for c in ("bucket", "size", "signs")]])


def _shaped(df: pd.DataFrame, schema: T.StructType) -> pd.DataFrame:
    """``df`` with all columns of ``schema``; those that it lacks are 0 or NULL."""
    df = df.reset_index(drop=True)
    whole = (T.LongType(), T.IntegerType())
    lacking = {f.name: 0 if f.dataType in whole else pd.Series([None] * len(df), dtype=object) for f in schema.fields if f.name not in df}
    return df.assign(**lacking)[schema.names]


class Packer:
    """Collects (class, signature) rows and packs them by destination."""

    def __init__(self, parts: int):
        self.parts = parts
        self._clear()

    def _clear(self) -> None:
        self.signs, self.classes, self.known, self.held = [], [], set(), 0

    def add(self, c1: np.ndarray, owner: np.ndarray, sign: np.ndarray) -> None:
        """Classes that this pack has had already are left out, so copies are signed once."""
        fresh = np.zeros(len(c1), bool)
        for i, c in enumerate(c1.tolist()):
            fresh[i] = c not in self.known
            self.known.add(c)
        use = fresh[owner]
        self.signs.append(sign[use])
        self.classes.append(c1[owner[use]])
        self.held += int(use.sum())

    def rows(self) -> pd.DataFrame:
        sign, c1 = np.concatenate(self.signs), np.concatenate(self.classes)
        self._clear()
        part = ((sign >> np.uint64(24)) % np.uint64(self.parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        sign, c1, part = sign[order], c1[order], part[order]
        low = np.ascontiguousarray(sign).view(np.uint8).reshape(-1, 8)[:, :6]
        begin = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
        rows = []
        for a, b in zip(begin, np.append(begin[1:], len(part)), strict=True):
            for k in range(a, b, 65_536):
                classes, owner = np.unique(c1[k : min(b, k + 65_536)], return_inverse=True)
                rows.append((int(part[k]), low[k : min(b, k + 65_536)].tobytes(), owner.astype(np.uint16).tobytes(), classes.tobytes()))
        return _shaped(pd.DataFrame(rows, columns=["part", "signs", "owners", "classes"]), SIGNED)


def sign_documents(docs: DataFrame, n: int, num: int, den: int, parts: int) -> DataFrame:
    """One row for each document (signs is null) and rows of packed signatures.

    Documents are dealt to the parts in turn, so that copies don't meet in one.
    """

    def run(frames):
        bands, packer = Bands(num, den), Packer(parts)
        for pdf in frames:
            raw = [to_bytes(t) for t in pdf["text"]]
            for a, b in packs(raw):
                element, per = shingle_sets(raw[a:b], n)
                c1, c2 = _class_hash(element, per)
                owner, sign, skip = signatures(element, per, bands)
                packer.add(c1, owner, sign)
                yield _shaped(
                    pd.DataFrame(
                        {
                            "part": (np.arange(a, b) % parts).astype(np.int32),
                            "id": pdf["id"].iloc[a:b].to_numpy(),
                            "n_shingles": per.astype(np.int64),
                            "c1": c1,
                            "c2": c2,
                            "skip0": skip[:, 0],
                            "skip1": skip[:, 1],
                            "sketch": sketches(element, per),
                        }
                    ),
                    SIGNED,
                )
                if packer.held >= PACK_SIGNS:
                    yield packer.rows()
        if packer.held:
            yield packer.rows()

    return docs.select(F.col("id").cast("string").alias("id"), "text").mapInPandas(run, SIGNED)


def meet(signed: DataFrame) -> DataFrame:
    """The documents' rows (kind 0), and (bucket, size, signs, c1) of shared signatures (kind 1).

    A bucket has the ``size`` classes of a signature that several have. It is named by them, so
    the ``signs`` signatures of one band that are shared by the same classes give one bucket;
    its last bit is that of the band.
    """

    def bucket_rows(held: list) -> pd.DataFrame:
        sign = np.concatenate([_six_bytes(s) for s, _, _ in held])
        c1 = np.concatenate([np.frombuffer(c, np.int64)[np.frombuffer(o, np.uint16)] for _, o, c in held])
        order = np.lexsort((c1, sign))
        sign, c1 = sign[order], c1[order]
        new = np.append(True, sign[1:] != sign[:-1])
        fresh = new | np.append(True, c1[1:] != c1[:-1])
        sign, c1 = sign[fresh], c1[fresh]
        begin = np.flatnonzero(np.append(True, sign[1:] != sign[:-1]))
        size = np.diff(np.append(begin, len(sign)))
        with np.errstate(over="ignore"):
            name = mix64(np.add.reduceat(mix64(c1.view(np.uint64) ^ _SALTS[1]), begin) + size.astype(np.uint64))
        name = _of_band(name, sign[begin]).view(np.int64)
        _, first, count = np.unique(name, return_index=True, return_counts=True)
        signs = np.zeros(len(begin), np.int64)
        signs[first] = count
        rows = np.repeat((signs > 0) & (size > 1), size)
        wide = {"bucket": name, "size": size, "signs": signs}
        return _shaped(pd.DataFrame({"kind": np.int32(1), "c1": c1[rows], **{k: np.repeat(v, size)[rows] for k, v in wide.items()}}), MET)

    def run(frames):
        part, held = None, []
        for pdf in frames:
            packed = pdf["signs"].notna()
            yield _shaped(pdf[~packed].drop(columns="signs").assign(kind=np.int32(0)), MET)
            pdf = pdf[packed]
            for p, *pack in zip(pdf["part"].tolist(), pdf["signs"], pdf["owners"], pdf["classes"], strict=True):
                if p != part and held:
                    yield bucket_rows(held)
                    held = []
                part = p
                held.append(pack)
        if held:
            yield bucket_rows(held)

    return signed.repartition("part").sortWithinPartitions("part").mapInPandas(run, MET)


def _six_bytes(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return wide.view(np.uint64).reshape(-1)


class Forest:
    """Union-find over places 0 ... n - 1, with the largest component."""

    def __init__(self, n: int):
        self.up, self.size, self.largest = list(range(n)), [1] * n, 0

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        if self.size[x] < self.size[y]:
            x, y = y, x
        self.up[y] = x
        self.size[x] += self.size[y]
        if self.size[x] >= self.size[self.find(self.largest)]:
            self.largest = x
        return True

    def in_largest(self, x: int) -> bool:
        return self.find(x) == self.find(self.largest)


def spanning_links(n: int, neighbours, ask: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect 0 ... n - 1 just as all links would; ``neighbours(i)`` has i's.

    Members of the largest component aren't asked: a link between components has an end
    outside of it, and when all outside have been asked, no such link is left. With ``ask``
    only links of these members count, and all of them are asked.
    """
    forest, links = Forest(n), []
    if ask is not None:
        return [(i, j) for i in ask.tolist() for j in neighbours(i).tolist() if forest.join(i, j)]
    todo = list(range(n))
    while todo:
        rest, asked = [], False
        for i in todo:
            if asked and forest.in_largest(i):
                rest.append(i)
                continue
            asked = True
            for j in neighbours(i).tolist():
                if forest.join(i, j):
                    links.append((i, j))
        todo = [i for i in rest if not forest.in_largest(i)]
    return links


def passing_forest(sketch: np.ndarray, size: np.ndarray, num: int, den: int, ask: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (i, j) that connect the sets of one bucket whose sketches may belong to a link."""

    def passing(i: int) -> np.ndarray:
        apart = np.abs(sketch - sketch[i]).sum(axis=1)
        return np.flatnonzero(apart * (num + den) <= (size + size[i]) * (den - num))

    return spanning_links(len(size), passing, ask)


def similar_forest(sets: list[np.ndarray], num: int, den: int, ask: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links of similarity num / den or more that join components."""
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(code, kind="stable")
    posting, begin = owner[order], np.concatenate([[0], np.cumsum(np.bincount(code))])
    ends = np.cumsum(size)

    def linked(i: int) -> np.ndarray:
        codes = code[ends[i] - size[i] : ends[i]]
        low, count = begin[codes], begin[codes + 1] - begin[codes]
        spread = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
        shared = np.bincount(posting[spread], minlength=len(sets))
        return np.flatnonzero((den * shared >= num * (size[i] + size - shared)) & (shared > 0))

    return spanning_links(len(sets), linked, ask)


def _groups(frames, keys: list[str]):
    """The rows of each group of sorted frames; a group is as large as its chunk, never more."""
    rest = None
    for pdf in frames:
        if not len(pdf):
            continue
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        key = pdf[keys].to_numpy()
        begin = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(axis=1)))
        for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
            yield pdf.iloc[a:b]
        rest = pdf.iloc[begin[-1] :]
    if rest is not None:
        yield rest


FOUND = "kind int, g long, chunk long, chunks long, a long, b long"


def _found(held: list[tuple]) -> pd.DataFrame:
    kinds = {"kind": "int32", **dict.fromkeys(("g", "chunk", "chunks", "a", "b"), "int64")}
    return pd.DataFrame(held, columns=list(kinds)).astype(kinds)


def chunked(members: DataFrame, chunks: DataFrame) -> DataFrame:
    """``members`` (g, node, ...) with ``chunk``, ``chunks`` and ``sets``; ``chunks`` (g, sets, chunks) is a table of the large groups."""
    small = F.broadcast if chunks.count() <= BROADCAST_NODES else (lambda df: df)
    dealt = members.join(small(chunks), "g", "left").withColumns({"chunks": F.coalesce("chunks", F.lit(1)).cast("long"), "sets": F.coalesce("sets", F.lit(1)).cast("long")})
    return dealt.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")))


def link_groups(members: DataFrame, forest, scratch: Scratch, name: str) -> DataFrame:
    """(a, b): links that connect the members (g, node, chunk, chunks, sets, ...) of each group.

    ``forest(rows, ask)`` has the links (places) among rows of one group.
    """
    payload = [c for c in members.columns if c not in ("g", "node", "chunk", "chunks", "sets")]
    every: Column = F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)

    def first(frames):
        held = []
        for pdf in _groups(frames, ["g", "chunk"]):
            if len(pdf) > 1:
                node, pivot, guest = pdf["node"].to_numpy(), pdf["pivot"].to_numpy(), pdf["guest"].to_numpy()
                g, chunk, chunks = (int(pdf[c].iloc[0]) for c in ("g", "chunk", "chunks"))
                links = forest(pdf, None)
                held += [(0, g, chunk, chunks, int(node[i]), int(node[j])) for i, j in links]
                if chunks > 1:
                    tree = Forest(len(pdf))
                    for i, j in links:
                        tree.join(i, j)
                    label = {}
                    for i in sorted(np.flatnonzero(pivot).tolist(), key=lambda i: node[i]):
                        own = label.setdefault(tree.find(i), int(node[i]))
                        held.append((2, g, 0, chunks, int(node[i]), own))
                    held += [(1, g, chunk, chunks, int(node[i]), label.get(tree.find(i), -1)) for i in np.flatnonzero(~guest).tolist()]
            elif len(pdf) == 1 and pdf["chunks"].iloc[0] > 1:
                held.append((1, *(int(pdf[c].iloc[0]) for c in ("g", "chunk", "chunks", "node")), -1))
            if len(held) > 10_000:
                yield _found(held)
                held = []
        yield _found(held)

    def main(pdf: pd.DataFrame) -> pd.DataFrame:
        """The labels of the group's largest component; -1 stands for no pivot and is in none."""
        names = sorted({*pdf["a"], *pdf["b"]} - {-1})
        place = {x: i for i, x in enumerate(names)}
        tree, size = Forest(len(names)), np.zeros(len(names))
        for a, b in zip(pdf["a"], pdf["b"], strict=True):
            if a != b and -1 not in (a, b):
                tree.join(place[a], place[b])
        for a, n in zip(pdf["a"], pdf["n"], strict=True):
            if a != -1:
                size[tree.find(place[a])] += n
        best = int(size.argmax()) if len(names) else -1
        rows = [(pdf["g"].iloc[0], pdf["chunks"].iloc[0], x) for x in names if tree.find(place[x]) == best]
        return pd.DataFrame(rows, columns=["g", "chunks", "b"]).astype("int64")

    def second(frames):
        held = []
        for pdf in _groups(frames, ["g", "chunk", "piece"]):
            ask, node = np.flatnonzero(pdf["guest"].to_numpy()), pdf["node"].to_numpy()
            if 0 < len(ask) < len(pdf):
                held += [(0, 0, 0, 0, int(node[i]), int(node[j])) for i, j in forest(pdf, ask)]
            if len(held) > 10_000:
                yield _found(held)
                held = []
        yield _found(held)

    # A pivot is chosen by its hash, so that no group has to be sorted for it.
    chosen = (F.col("chunks") > 1) & (F.pmod(F.xxhash64("node", F.lit("pivot")), F.col("sets")) < PIVOTS)
    own = members.withColumns({"pivot": chosen, "guest": F.lit(False)}).drop("sets")
    guests = members.filter(chosen).withColumn("other", F.explode(F.filter(every, lambda c: c != F.col("chunk"))))
    guests = guests.withColumns({"chunk": F.col("other"), "pivot": F.lit(True), "guest": F.lit(True)}).drop("other", "sets")
    rows = own.unionByName(guests).repartition("g", "chunk").sortWithinPartitions("g", "chunk")
    found = scratch.write(rows.mapInPandas(first, FOUND), f"{name}-first", "kind")
    links = found.filter("kind = 0").select("a", "b")
    labels = found.filter("kind = 1").select("g", "chunk", "chunks", F.col("a").alias("node"), "b")
    if labels.isEmpty():
        return links
    counts = labels.groupBy("g", "b").agg(F.max("chunks").alias("chunks"), F.count(F.lit(1)).alias("n")).select("g", "chunks", F.col("b").alias("a"), "b", "n")
    joins = found.filter("kind = 2").select("g", "chunks", "a", "b").distinct().withColumn("n", F.lit(0).cast("long"))
    largest = counts.unionByName(joins).groupBy("g").applyInPandas(main, "g long, chunks long, b long")
    largest = largest.select("g", F.explode(every).alias("chunk"), "b")
    outside = scratch.write(labels.join(largest, ["g", "chunk", "b"], "left_anti").select("g", "node", "chunk", "chunks"), f"{name}-outside")
    if outside.isEmpty():
        return links
    pieces = outside.groupBy("g").agg(F.max("chunks").alias("chunks"), F.ceil(F.count(F.lit(1)) / CHUNK_SETS).cast("long").alias("pieces"))
    pieces = scratch.write(pieces.select("g", F.explode(every).alias("chunk"), "pieces"), f"{name}-pieces")
    asked = outside.join(pieces, ["g", "chunk"]).withColumn("piece", F.pmod(F.xxhash64("node", F.lit("piece")), F.col("pieces")))
    asked = asked.select("g", "node", "piece").join(members.drop("sets"), ["g", "node"])
    asked = asked.withColumn("other", F.explode(F.filter(every, lambda c: c != F.col("chunk")))).withColumns({"chunk": F.col("other"), "guest": F.lit(True)})
    hosts = members.join(pieces, ["g", "chunk"]).withColumns({"piece": F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)), "guest": F.lit(False)})
    columns = ["g", "chunk", "piece", "node", "guest", *payload]
    rows = hosts.select(*columns).unionByName(asked.select(*columns)).repartition("g", "chunk", "piece").sortWithinPartitions("g", "chunk", "piece")
    return links.union(scratch.write(rows.mapInPandas(second, FOUND), f"{name}-second").select("a", "b"))


def allocated(met: DataFrame, classes: DataFrame) -> DataFrame:
    """(g, node): the buckets that classes keep; of each band they skip the costliest signatures that they may.

    Cost is the number of classes that share the signature. Ties go by the bucket's name, so
    that both sides of a pair order common buckets alike.
    """
    cost = met.groupBy("bucket", "c1").agg(F.max("size").alias("size"), F.sum("signs").alias("signs"))
    cost = cost.withColumn("band", F.pmod("bucket", F.lit(2)))
    known = cost.join(classes.select("c1", "skip0", "skip1").groupBy("c1").agg(F.min("skip0").alias("skip0"), F.min("skip1").alias("skip1")), "c1")
    # a class has two bands and at most a few hundred signatures in each
    upto = Window.partitionBy("c1", "band").orderBy(F.col("size").desc(), "bucket").rowsBetween(Window.unboundedPreceding, 0)
    ranked = known.withColumn("upto", F.sum("signs").over(upto))
    may = F.when(F.col("band") == 0, F.col("skip0")).otherwise(F.col("skip1"))
    return ranked.filter(F.col("upto") > may).select(F.col("bucket").alias("g"), F.col("c1").alias("node"))


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, root): the smallest node connected to each node of ``edges`` (a, b).

    Alternating stars: each node's larger neighbours are hung on its smallest neighbour
    (large star), then its smaller ones (small star), until nothing changes; labels only fall,
    so that comes. Only minima are aggregated, and nodes with many neighbours are broadcast.
    """

    def star(pairs: DataFrame, total: int, large: bool) -> DataFrame:
        if large:
            both = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:  # from the larger node to the smaller one
            both = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"), F.count(F.lit(1)).alias("rows"))
        joined = join_by_weight(both, least, ["a"], "rows", total)
        if large:
            out = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("least").alias("b"))
        else:
            out = joined.select(F.col("b").alias("a"), F.col("least").alias("b")).union(least.select("a", F.col("least").alias("b")))
        return out.filter("a <> b").distinct()

    state = F.struct(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).alias("state")
    pairs = scratch.write(edges.select("a", "b").filter("a <> b").distinct(), f"{name}-0")
    before, step = pairs.select(state).first()["state"], 0
    while before.n:
        hung = scratch.write(star(pairs, 2 * before.n, True), f"{name}-large-{step}")
        pairs = scratch.write(star(hung, before.n, False), f"{name}-{step + 1}")
        scratch.remove(f"{name}-large-{step}", f"{name}-{step}")
        now, step = pairs.select(state).first()["state"], step + 1
        if now == before:
            break
        before = now
    hung = pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return hung.union(hung.select(F.col("root").alias("node"), "root").distinct())


def near_duplicates(
    docs: DataFrame, n: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: id_col, n_shingles, component_id (the smallest id it is linked to)."""
    need(docs, id_col, text_col)
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "jaccard")
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    bands = Bands(num, den)
    met = scratch.write(meet(sign_documents(docs, n, num, den, meeting_parts(docs, bands))), "met", "kind")

    # Equal sets are one class, its node is its smallest id.
    thin = met.filter("kind = 0").select(F.col("id").cast("long").alias("id"), "n_shingles", "c1", "c2", "skip0", "skip1", "sketch")
    known = thin.filter(F.col("id").isNotNull() & (F.col("n_shingles") > 0))
    most = [F.max(c).alias(c) for c in ("n_shingles", "skip0", "skip1", "sketch")]
    classes = scratch.write(known.groupBy("c1", "c2").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("copies"), *most), "classes")

    # Classes whose first halves of the hash agree come together and are told apart later.
    # Chunks, pivots and pieces all read the members, so these meet their sketches once.
    kept = allocated(met.filter("kind = 1").select("bucket", "size", "signs", "c1"), classes)
    kept = scratch.write(kept.join(classes.select(F.col("c1").alias("node"), "n_shingles", "sketch"), "node"), "kept")
    large = kept.groupBy("g").agg(F.count(F.lit(1)).alias("sets")).filter(F.col("sets") > CHUNK_SETS)
    large = scratch.write(large.withColumn("chunks", F.ceil(F.col("sets") / CHUNK_SETS)), "large-buckets")
    members = chunked(kept, large)

    def by_sketch(pdf: pd.DataFrame, ask):
        return passing_forest(aligned(pdf["sketch"].tolist()), pdf["n_shingles"].to_numpy(), num, den, ask)

    clusters = components(link_groups(members, by_sketch, scratch, "buckets"), scratch, "clusters")
    clusters = clusters.select(F.col("node").alias("c1"), F.col("root").alias("g"))
    sized = scratch.write(classes.select("c1", "node", "n_shingles").join(clusters, "c1"), "sized")
    large = sized.groupBy("g").agg(F.count(F.lit(1)).alias("sets"), F.sum("n_shingles").alias("elements"))
    large = large.select("g", "sets", F.greatest(F.ceil(F.col("sets") / CHUNK_SETS), F.ceil(F.col("elements") / CHUNK_ELEMENTS)).alias("chunks"))
    large = scratch.write(large.filter("chunks > 1"), "large-clusters")
    placed = scratch.write(chunked(sized.select("g", "node"), large), "placed")
    small = F.broadcast if placed.count() <= BROADCAST_NODES else (lambda df: df)
    members = docs.select(F.col("id").alias("node"), "text").join(small(placed), "node")

    def by_text(pdf: pd.DataFrame, ask):
        raw, sets = [to_bytes(t) for t in pdf["text"]], []
        for a, b in packs(raw):
            element, per = shingle_sets(raw[a:b], n)
            sets += np.split(element, np.cumsum(per)[:-1])
        return similar_forest(sets, num, den, ask)

    links = link_groups(members, by_text, scratch, "links")

    # An id with several texts is one document.
    first, last = F.min(F.struct("c1", "c2")).alias("first"), F.max(F.struct("c1", "c2")).alias("last")
    several = known.groupBy("id").agg(first, last).filter("first <> last").select("id")
    several = known.join(several, "id").select("id", "c1", "c2").distinct().join(classes.select("c1", "c2", "node"), ["c1", "c2"])
    least = several.groupBy("id").agg(F.min("node").alias("b"))
    several = several.join(least, "id").filter("node <> b").select(F.col("node").alias("a"), "b")
    roots = components(links.union(several), scratch, "roots")

    own = classes.select("c1", "c2", "node", "copies").join(roots, "node", "left")
    own = scratch.write(own.select("c1", "c2", F.coalesce("root", "node").alias("component"), "copies"), "components")
    names = F.col("id").alias(id_col), F.col("n_shingles")
    found = join_by_weight(known.select("id", "n_shingles", "c1", "c2"), own, ["c1", "c2"], "copies", known.count())
    alone = thin.filter(F.col("id").isNull() | (F.col("n_shingles") == 0)).select(*names, F.col("id").alias("component_id"))
    scratch.remove("kept", "large-buckets", "sized", "large-clusters", "placed", "classes", *[f"{x}-{y}" for x in ("buckets", "links") for y in ("first", "outside", "pieces", "second")])
    return found.select(*names, F.col("component").alias("component_id")).unionByName(alone)


def meeting_parts(docs: DataFrame, bands: Bands) -> int:
    """How many parts signatures meet in, by the size of all texts; a part is one task's work."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    m, _ = bands.segments(int(bands.of(np.array([1000]))[0]) + 1)
    signs = 2 * m / 1000 * size / 6  # two bands; words of about 6 bytes
    floor = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(floor, min(1 << 24, int(signs / PART_SIGNS) + 1))


def keep_one_each(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without those whose component has a smaller id.

    Of rows with the same id the one with the smallest text stays, and one of equal ones.
    Rows without id stay, as nothing tells which of them would be kept.
    """
    need(docs, id_col, text_col)
    found = near_duplicates(docs, n, num, den, id_col, text_col)
    plain, ident, text = plainly_named(docs), place_of(docs, id_col), place_of(docs, text_col)
    heads = found.filter(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias("head")).distinct()
    own = plain.filter(F.col(ident).isNotNull()).join(heads, F.col(ident) == F.col("head"), "left_semi")
    # one row of each id, by minima that are combined before the shuffle
    rest = [c for c in plain.columns if c != ident]
    least = own.groupBy(ident).agg(F.min_by(F.struct(*rest), F.struct(text, F.xxhash64(*rest))).alias("row"))
    own = least.select(ident, *[F.col("row")[c].alias(c) for c in rest]).select(*plain.columns)
    return named_as(own.unionByName(plain.filter(F.col(ident).isNull())), docs)


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def components_sql(table: str, n: int, num: int, den: int) -> str:
    """DuckDB SQL for (r, doc_id, n_shingles, component_id) of ``table`` (r, doc_id, text), by all pairs."""
    word = "array_to_string(ws[i + 1:i + {m}], ' ')"
    return rf"""
      WITH RECURSIVE split AS MATERIALIZED (
        SELECT r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM {table}
      ), shingles AS MATERIALIZED (
        SELECT DISTINCT r, doc_id, {word.format(m=n)} AS s
        FROM (SELECT *, unnest(range(0, greatest(1, len(ws) - {n - 1}))) AS i FROM split WHERE len(ws) > 0)
      ), sizes AS MATERIALIZED (SELECT r, any_value(doc_id) AS doc_id, count(*)::BIGINT AS n FROM shingles GROUP BY r
      ), pairs AS MATERIALIZED (
        SELECT a.r AS ra, b.r AS rb, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.r < b.r GROUP BY ALL
      ), linked AS MATERIALIZED (
        SELECT a.doc_id AS x, b.doc_id AS y FROM pairs JOIN sizes a ON a.r = ra JOIN sizes b ON b.r = rb
        WHERE {den} * k >= {num} * (a.n + b.n - k)
      ), edges AS MATERIALIZED (SELECT x, y FROM linked UNION SELECT y, x FROM linked
      ), reach(x, y) AS (SELECT x, y FROM edges UNION SELECT reach.x, edges.y FROM reach JOIN edges ON reach.y = edges.x
      ), least AS (SELECT x, min(y) AS y FROM reach GROUP BY x
      )
      SELECT split.r, split.doc_id, coalesce(sizes.n, 0) AS n_shingles, least(split.doc_id, coalesce(least.y, split.doc_id)) AS component_id
      FROM split LEFT JOIN sizes USING (r) LEFT JOIN least ON least.x = split.doc_id AND sizes.n IS NOT NULL"""


OP5_SQL = f"""
SELECT doc_id, n_shingles, component_id FROM (
  {components_sql("(SELECT row_number() OVER () AS r, doc_id, text FROM documents)", 3, 90, 100)}
)
"""
