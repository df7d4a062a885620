"""Repeated passages: strings of 50 bytes that an earlier document holds, by Burrows-Wheeler interval expansion.

Texts travel in packs of some megabytes, compressed.  Every string of ``LENGTH`` bytes has one
anchor: of the strings of ``ANCHOR`` bytes inside, the leftmost of least hash.  So equal strings
have equal anchors at equal places, and only anchors found in two documents matter:

* packs send the hashes of their anchors by group; a group answers with one bit for each;
* packs send the surroundings of the anchors that are left, each different one once with its
  smallest document, to the group of the anchor;
* a group sorts its surroundings as a Burrows-Wheeler transform does, by backward steps: one
  stable sort by the byte before (LF mapping).  Equal beginnings are an interval.  An anchor's
  interval is expanded to the right and then byte by byte to the left, up to ``LENGTH`` bytes, and the least
  document of each interval goes back to the packs, which mark and cut their texts.

Hashes only choose what is compared; intervals hold equal bytes.  An anchor found in more than
``CROWD`` documents is no matter for one group: packs expand its intervals themselves and send
each different string with its smallest document, and the least of all packs comes from an
aggregate that combines before its shuffle.

Cases: a null text is empty; null ids count as the largest; documents of one id are none smaller than
the other; other columns are not passed on, so none can clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracksieve.llm.workspace import stored, table

LENGTH = 50
ANCHOR = 24
#: Bytes on either side of an anchor that a string may reach, and those of a string's surroundings.
REACH = LENGTH - ANCHOR
WIDE = ANCHOR + 2 * REACH
#: Bytes of a pack, bytes of all texts for each group, documents of an anchor that one group compares.
PACK, GROUP, CROWD = 1 << 23, 1 << 22, 1 << 16
#: String starts hashed at once, surroundings cut out at once.
CHUNK, CUT = 1 << 20, 1 << 15
NEVER = np.iinfo(np.int64).max
_MIX = np.random.default_rng(8).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_BASE, n, 1 << 64))


def _hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the ``ANCHOR`` bytes from each place on; pieces of 1, 2, 4, ... bytes are put together."""
    piece, size, total, length = _MIX[data], 1, None, 0
    while size <= ANCHOR:
        if ANCHOR & size:
            if total is None:
                total, length = piece, size
            else:
                n = len(data) - length - size + 1
                total, length = total[:n] * _power(size) + piece[length:length + n], length + size
        if size * 2 <= ANCHOR:
            piece = piece[:-size] * _power(size) + piece[size:]
        size *= 2
    total = total ^ (total >> np.uint64(29))
    total *= np.uint64(0xBF58476D1CE4E5B9)
    return total ^ (total >> np.uint64(32))


def anchors(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of the anchors of all strings that lie inside one text."""
    last = np.repeat(np.cumsum(sizes) - LENGTH, sizes).astype(np.int64)  # the last start in the text of each byte
    places, found = [], []
    for start in range(0, max(len(data) - LENGTH + 1, 0), CHUNK):
        value = _hashes(data[start:start + CHUNK + LENGTH - 1])
        h, at, size = value, np.arange(len(value), dtype=np.int32), 1
        while size <= REACH:  # the least of REACH + 1 neighbours, by doubling
            step = min(size, REACH + 1 - size)
            later = h[step:] < h[:-step]
            h, at, size = np.where(later, h[step:], h[:-step]), np.where(later, at[step:], at[:-step]), size + step
        at = at[np.arange(start, start + len(at)) <= last[start:start + len(at)]]
        at = at[np.diff(at, prepend=-1) != 0]
        places.append(at.astype(np.int64) + start)
        found.append(value[at])
    if not places:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    place, value = np.concatenate(places), np.concatenate(found)
    new = np.diff(place, prepend=-1) != 0  # a border of chunks repeats one
    return place[new], value[new]


def _packed(x: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(x).tobytes(), codec="zstd", asbytes=True)


def _unpacked(x: bytes, n: int, kind: type) -> np.ndarray:
    return np.frombuffer(pa.decompress(x, n * np.dtype(kind).itemsize, codec="zstd"), dtype=kind) if n else np.zeros(0, dtype=kind)


def _starts(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.diff(x, prepend=x[0] - 1)) if len(x) else np.zeros(0, dtype=np.int64)


@dataclass
class Pack:
    """The texts of a pack with the anchors of their strings; different anchors lie by group and hash."""

    data: np.ndarray
    sizes: np.ndarray
    ids: pa.Array
    docs: np.ndarray
    place: np.ndarray
    owner: np.ndarray
    which: np.ndarray
    keys: np.ndarray
    group: np.ndarray

    @staticmethod
    def of(ids: pa.Array, sizes: np.ndarray, blob: bytes, groups: int) -> Pack:
        data = _unpacked(blob, int(sizes.sum()), np.uint8)
        docs = ids.fill_null(NEVER).to_numpy(zero_copy_only=False).astype(np.int64)
        place, value = anchors(data, sizes)
        owner = np.searchsorted(np.cumsum(sizes), place, side="right")
        keys, which = np.unique(value, return_inverse=True)
        group = (keys % np.uint64(groups)).astype(np.int64)
        order = np.argsort(group, kind="stable")
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        return Pack(data, sizes, ids, docs, place, owner, rank[which], keys[order], group[order])

    def documents(self) -> np.ndarray:
        """Documents that hold each different anchor."""
        doc = self.docs[self.owner]
        order = np.lexsort((doc, self.which))
        new = (np.diff(self.which[order], prepend=-1) != 0) | np.append(True, np.diff(doc[order]) != 0)[:len(order)]
        return np.bincount(self.which[order][new], minlength=len(self.keys))


@dataclass
class Surroundings:
    """The different surroundings of the anchors left in a pack: first those of groups, in their order, then the crowded ones."""

    place: np.ndarray
    owner: np.ndarray
    which: np.ndarray
    cells: np.ndarray
    group: np.ndarray
    calm: int

    @staticmethod
    def of(pack: Pack, left: np.ndarray, crowded: np.ndarray) -> Surroundings:
        kept = left[pack.which]
        place, owner, anchor = pack.place[kept], pack.owner[kept], pack.which[kept]
        end = np.cumsum(pack.sizes)
        start = end - pack.sizes
        rows = []
        for i in range(0, len(place), CUT):
            p, s, e = (x[i:i + CUT, None] for x in (place, start[owner], end[owner]))
            at = p + np.arange(-REACH, ANCHOR + REACH)
            own = np.empty((len(p), WIDE + 2), dtype=np.uint8)
            own[:, :WIDE] = np.where((at >= s) & (at < e), pack.data[np.clip(at, 0, len(pack.data) - 1)], 0)
            own[:, WIDE:] = np.concatenate([np.minimum(p - s, REACH), np.minimum(e - p - ANCHOR, REACH)], axis=1)
            rows.append(own)
        if not rows:
            none = np.zeros(0, dtype=np.int64)
            return Surroundings(none, none, none, np.zeros((0, WIDE + 2), dtype=np.uint8), none, 0)
        whole = np.concatenate(rows)
        _, first, which = np.unique(whole.view(f"V{WIDE + 2}").ravel(), return_index=True, return_inverse=True)
        group, far = pack.group[anchor[first]], crowded[anchor[first]]
        order = np.lexsort((group, far))
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        return Surroundings(place, owner, rank[which.ravel()], whole[first[order]], group[order], int((~far).sum()))

    def least(self, docs: np.ndarray) -> np.ndarray:
        out = np.full(len(self.cells), NEVER)
        np.minimum.at(out, self.which, docs[self.owner])
        return out


def expand(cells: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes left of the anchor, order, interval, whole): for each place of a string around its anchor, the surroundings in the order of
    what begins there, the interval of each (equal strings, numbered in that order), and whether a text holds the whole string.
    """
    at = np.arange(WIDE)
    left, right = (cells[:, WIDE + i].astype(np.int64) for i in (0, 1))
    there = (at[:, None] >= REACH - left[None, :]) & (at[:, None] < REACH + ANCHOR + right[None, :])
    column = np.where(there, cells[:, :WIDE].T.astype(np.uint16), np.uint16(256))  # what lies beyond a text is no byte
    order = np.arange(len(cells))
    for c in range(WIDE - 1, REACH - 1, -1):
        order = order[np.argsort(column[c][order], kind="stable")]
    differ = np.zeros(len(cells), dtype=bool)
    intervals = []
    for c in range(REACH, WIDE):
        own = column[c][order]
        differ[1:] |= own[1:] != own[:-1]
        if c >= REACH + ANCHOR - 1:
            intervals.append(np.empty(len(cells), dtype=np.int32))
            intervals[-1][order] = np.cumsum(differ)
    for o in range(REACH + 1):
        if o:
            intervals.pop()  # complete
            order = order[np.argsort(column[REACH - o][order], kind="stable")]
            own = column[REACH - o][order]
            other = np.append(False, own[1:] != own[:-1])[:len(own)]
            for x in intervals:
                before = x[order]
                differ = other.copy()
                differ[1:] |= before[1:] != before[:-1]
                x[order] = np.cumsum(differ)
        yield o, order, intervals[-1], (left >= o) & (right >= REACH - o)


def least_documents(cells: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """(surroundings, bytes left of the anchor): the least document that holds the string; ``NEVER`` if it is not whole."""
    out = np.full((len(cells), REACH + 1), NEVER)
    for o, order, interval, whole in expand(cells):
        if len(order):
            out[whole, o] = np.minimum.reduceat(docs[order], _starts(interval[order]))[interval[whole]]
    return out


def _bits(x: np.ndarray) -> bytes:
    return np.packbits(x).tobytes()


def _column(t: pa.Table, name: str) -> list:
    return t[name].to_pylist()


def _pack_of(left: pa.Table, groups: int) -> Pack:
    row = left.combine_chunks()
    return Pack.of(row["ids"].chunk(0).flatten(), row["sizes"].chunk(0).flatten().to_numpy(), row["blob"][0].as_py(), groups)


def _surroundings_of(pack: Pack, replies: pa.Table) -> Surroundings:
    sizes = dict(zip(*(x.tolist() for x in np.unique(pack.group, return_counts=True))))
    left, crowded = np.zeros(len(pack.keys), dtype=bool), np.zeros(len(pack.keys), dtype=bool)
    begins = dict(zip(pack.group[_starts(pack.group)].tolist(), _starts(pack.group).tolist()))
    for g, some, many in zip(*(_column(replies, c) for c in ("group", "bits", "crowd"))):
        own = slice(begins[g], begins[g] + sizes[g])
        left[own], crowded[own] = (np.unpackbits(np.frombuffer(x, dtype=np.uint8), count=sizes[g]).astype(bool) for x in (some, many))
    return Surroundings.of(pack, left, crowded)


def _cut(pack: Pack, s: Surroundings, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(removed bytes, spans, hash of the rest) of every text."""
    end = np.cumsum(pack.sizes)
    start = end - pack.sizes
    edge = np.zeros(len(pack.data) + 1, dtype=np.int32)
    for i in range(0, len(s.place), CUT):
        own = slice(i, i + CUT)
        hit, o = np.nonzero(least[s.which[own]] < pack.docs[s.owner[own]][:, None])
        begin = s.place[own][hit] - o
        np.add.at(edge, begin, 1)
        np.add.at(edge, begin + LENGTH, -1)
    removed = np.cumsum(edge[:-1]) > 0
    opens = removed.copy()
    opens[1:] &= ~removed[:-1]
    first = start[pack.sizes > 0]
    opens[first] = removed[first]
    total, spans = (np.concatenate([[0], np.cumsum(x)]) for x in (removed, opens))
    rest = memoryview(np.ascontiguousarray(pack.data[~removed]))
    a, b = start - total[start], end - total[end]
    return total[end] - total[start], spans[end] - spans[start], [hashlib.sha256(rest[i:j]).hexdigest() for i, j in zip(a.tolist(), b.tolist())]


def repeated_passages(df: DataFrame, ident: str = "doc_id", text: str = "text", pack_bytes: int = PACK, group_bytes: int = GROUP, crowd: int = CROWD) -> DataFrame:
    """(ident, n_bytes, n_removed, n_spans, kept_sha256): every text without the bytes of strings that a document of smaller id holds."""

    def packs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = batch.column("bytes")
            size = np.diff(np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset:texts.offset + len(texts) + 1]).astype(np.int64)
            data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
            at = int(np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset]) if len(texts) else 0
            ends = np.cumsum(size)
            i = 0
            while i < len(texts):
                before = int(ends[i - 1]) if i else 0
                j = max(i + 1, int(np.searchsorted(ends, before + pack_bytes, side="right")))
                ids = batch.column("id").slice(i, j - i)
                yield pa.RecordBatch.from_arrays([
                    pa.array([number]), pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), pa.concat_arrays([ids])), pa.array([size[i:j]], pa.list_(pa.int64())),
                    pa.array([_packed(data[at + before:at + int(ends[j - 1])])], pa.binary()), pa.array([int(ends[j - 1]) - before])], ["pack", "ids", "sizes", "blob", "total"])
                number, i = number + 1, j

    texts = df.select(F.col(ident).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("bytes"))
    packs = stored(texts.mapInArrow(packs_of, "pack long, ids array<long>, sizes array<long>, blob binary, total long"), "packs")
    groups = max(-(-(packs.agg(F.sum("total")).first()[0] or 0) // group_bytes), 1)

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = pa.Table.from_batches([batch.slice(i, 1)])
                pack = _pack_of(row, groups)
                many = pack.documents()
                cut = _starts(pack.group)
                short = (pack.keys >> np.uint64(24)).astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:]
                rows = list(zip(cut, np.append(cut[1:], len(pack.keys)))) if len(cut) else []
                yield pa.RecordBatch.from_arrays([
                    pa.array(pack.group[cut], pa.int64()), pa.array([row["pack"][0].as_py()] * len(rows), pa.int64()),
                    pa.array([short[a:b].tobytes() for a, b in rows], pa.binary()), pa.array([_packed(many[a:b].astype(np.int32)) for a, b in rows], pa.binary())],
                    ["group", "pack", "keys", "many"])

    def judged(t: pa.Table) -> pa.Table:
        """Of each anchor a bit whether two documents hold it, and one whether too many do."""
        keys, many, sizes = [], [], []
        for k, m in zip(_column(t, "keys"), _column(t, "many")):
            wide = np.zeros((len(k) // 5, 8), dtype=np.uint8)
            wide[:, 3:] = np.frombuffer(k, dtype=np.uint8).reshape(-1, 5)
            keys.append(wide.view(">u8").ravel().astype(np.uint64))
            many.append(_unpacked(m, len(wide), np.int32))
            sizes.append(len(wide))
        _, which = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(which, weights=np.concatenate(many))[which]
        ends = np.cumsum(sizes)
        own = [total[e - n:e] for e, n in zip(ends, sizes)]
        return pa.table([t["pack"], t["group"], pa.array([_bits(x > 1) for x in own], pa.binary()), pa.array([_bits(x > crowd) for x in own], pa.binary()),
                         pa.array([int(((x > 1) & (x > crowd)).sum()) for x in own], pa.int64())], names=["pack", "group", "bits", "crowd", "n"])

    asked = packs.mapInArrow(sent, "group long, pack long, keys binary, many binary")
    replies = stored(asked.groupBy("group").applyInArrow(judged, "pack long, group long, bits binary, crowd binary, n long"), "replies")

    def told(left: pa.Table, right: pa.Table) -> pa.Table:
        """The calm surroundings of a pack by group."""
        names = ["group", "pack", "cells", "least"]
        if not right.num_rows:
            return pa.table([pa.array([], k) for k in (pa.int64(), pa.int64(), pa.binary(), pa.binary())], names=names)
        pack = _pack_of(left, groups)
        s = _surroundings_of(pack, right)
        least = s.least(pack.docs)
        cut = _starts(s.group[:s.calm])
        rows = list(zip(cut, np.append(cut[1:], s.calm))) if len(cut) else []
        return pa.table([
            pa.array(s.group[cut], pa.int64()), pa.array([left["pack"][0].as_py()] * len(rows), pa.int64()),
            pa.array([s.cells[a:b].tobytes() for a, b in rows], pa.binary()), pa.array([least[a:b].tobytes() for a, b in rows], pa.binary())], names=names)

    def told_crowded(left: pa.Table, right: pa.Table) -> pa.Table:
        """The different strings of a pack around crowded anchors."""
        out = []
        if right.num_rows:
            pack = _pack_of(left, groups)
            s = _surroundings_of(pack, right)
            docs, cells = s.least(pack.docs)[s.calm:], s.cells[s.calm:]
            for o, order, interval, whole in expand(cells) if len(cells) else ():
                begins = _starts(interval[order])
                least, some = np.minimum.reduceat(docs[order], begins), order[begins]
                use = np.flatnonzero(whole[some])
                strings = cells[some[use], REACH - o:REACH - o + LENGTH]
                out += zip([x.tobytes() for x in strings], (use + (o << 32)).tolist(), least[use].tolist())
        string, no, least = zip(*out) if out else ((), (), ())
        pack = [left["pack"][0].as_py()] * len(out) if out else []
        return pa.table([pa.array(pack, pa.int64()), pa.array(string, pa.binary()), pa.array(no, pa.int64()), pa.array(least, pa.int64())], names=["pack", "string", "no", "least"])

    def expanded(t: pa.Table) -> pa.Table:
        cells = [np.frombuffer(x, dtype=np.uint8).reshape(-1, WIDE + 2) for x in _column(t, "cells")]
        found = least_documents(np.concatenate(cells), np.concatenate([np.frombuffer(x, dtype=np.int64) for x in _column(t, "least")]))
        ends = np.cumsum([len(x) for x in cells])
        return pa.table([t["pack"], t["group"], pa.array([_packed(found[e - len(x):e]) for e, x in zip(ends, cells)], pa.binary())], names=["pack", "group", "bits"])

    by_pack = packs.groupBy("pack").cogroup(replies.groupBy("pack"))
    answers = by_pack.applyInArrow(told, "group long, pack long, cells binary, least binary").groupBy("group").applyInArrow(expanded, "pack long, group long, bits binary")
    back = replies.select("pack", F.lit(0).alias("kind"), "group", "bits", "crowd").unionByName(answers.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    if not replies.where("n > 0").isEmpty():
        strings = stored(by_pack.applyInArrow(told_crowded, "pack long, string binary, no long, least long"), "strings")
        first = strings.groupBy("string").agg(F.min("least").alias("least"))
        back = back.unionByName(strings.drop("least").join(first, "string").select("pack", F.lit(2).alias("kind"), "no", "least"), allowMissingColumns=True)
    else:
        back = back.withColumns({"no": F.lit(None).cast("long"), "least": F.lit(None).cast("long")})

    def finished(left: pa.Table, right: pa.Table) -> pa.Table:
        pack = _pack_of(left, groups)
        kind = right["kind"].to_numpy()
        s = _surroundings_of(pack, right.filter(pa.array(kind == 0)))
        least = np.full((len(s.cells), REACH + 1), NEVER)
        cut = _starts(s.group[:s.calm])
        begins = dict(zip(s.group[cut].tolist(), zip(cut.tolist(), np.append(cut[1:], s.calm).tolist())))
        calm = right.filter(pa.array(kind == 1))
        for g, x in zip(_column(calm, "group"), _column(calm, "bits")):
            a, b = begins[g]
            least[a:b] = _unpacked(x, (b - a) * (REACH + 1), np.int64).reshape(-1, REACH + 1)
        far = right.filter(pa.array(kind == 2))
        if far.num_rows:
            no, found = far["no"].to_numpy(), far["least"].to_numpy()
            for o, _, interval, whole in expand(s.cells[s.calm:]):
                own = no >> 32 == o
                first = np.full(len(interval), NEVER)
                first[no[own] & (1 << 32) - 1] = found[own]
                least[s.calm:, o] = np.where(whole, first[interval], NEVER)
        n_removed, n_spans, digest = _cut(pack, s, least)
        return pa.table([pack.ids, pa.array(pack.sizes), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digest, pa.string())],
                        names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return packs.groupBy("pack").cogroup(back.groupBy("pack")).applyInArrow(
        finished, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string").withColumnRenamed("id", ident)


def op8_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    return repeated_passages(table(spark, sf_dir, "documents"))
