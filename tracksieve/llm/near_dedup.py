"""Near-duplicate removal: Order MinHash sketches propose pairs, a banded alignment decides them.

A text is its sequence of words.  Its shingles are runs of ``SHINGLE`` words, numbered by
occurrence.  Each of ``SKETCHES`` hash functions takes the ``TAKEN`` smallest shingles and
lists them in the order of the text, so texts meet if they share shingles *and* their
order.  A pair is near if its word edit distance is at most ``1 - least`` of the longer
text; the distance is found inside a band of that width by bit-parallel rows, after two
bounds that lose nothing (the lengths, and the words that both have).

Exact copies (equal MD5) are settled before and share their first text's group.  The others
are sorted once by sketch and id; texts that share a sketch form a run, cut into blocks of at
most ``MEMBERS``, and all pairs of a run are judged: every block meets itself and the others
of its run.  Lengths and signatures of three bits or more a word rule most pairs out without
losing one; what is left is aligned.  Where that would be more than ``MANY`` pairs a text, as
in a large group of near copies, a text first meets its closest one; classes are joined, and
only texts that are still in two classes meet in the next round, in the last one all of them.
So no link between two groups is lost that a shared sketch shows.  Comparing signatures
costs the square of a run (some 10 million pairs a second and core) in bounded memory and
in as many tasks as there are block pairs; aligning grows with the pairs that are alike.
Groups are the connected components of the near pairs; the smallest id of a group is kept.

Only narrow rows and arrays of word hashes are shuffled, never texts.

Cases: a text without a word, null too, and a row with a null id are never copies; rows that
share an id share its decision, and the id is judged by all its texts; an empty table gives an
empty table; other columns pass unchanged, input columns named like a result column are
replaced, and no other name clashes.  A long text costs memory in proportion to its words;
aligning two of them costs time with the product of words and band.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracksieve.llm.workspace import WORD, attach, stored, table
from tracksieve.operators.ordered import fits_broadcast

SHINGLE = 5
TAKEN = 2
SKETCHES = 32
LEAST = 0.8
SALTS = 16
#: Texts of a run compared at a time, least and most bits of a text's word signature, and the proposals a text that a block may make in a round before the last.
MEMBERS = 4096
BITS = 1024
WIDEST = 64 * BITS
POWERS = [1 << k for k in range(BITS.bit_length() - 1, WIDEST.bit_length())]
MANY = 2
ROUNDS = 3
#: Ranks or pairs held at a time, and the bands that are tried before the widest one.
BLOCK = 1 << 16
BANDS = (7, 30)
_ODD = np.random.default_rng(20).integers(1, 1 << 63, SKETCHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def word_hashes(text: str) -> np.ndarray:
    words = text.encode().split()  # at the same bytes as WORD_BREAK
    return np.fromiter(map(crc32, words), np.uint64, len(words))


def signature(words: np.ndarray, each: int = 3, widest: int = 8 * BITS) -> bytes:
    """One bit for every word, numbered by occurrence; a bit that another text has not is a word that it has not.

    Signatures of longer texts are wider by powers of two; ``folded`` makes them comparable.
    """
    width = BITS
    while width < min(widest, each * len(words)):
        width *= 2
    bits = np.zeros(width, dtype=bool)
    bits[_mixed(words + _nth(words) * np.uint64(0xD6E8FEB86659FD93)) % np.uint64(width)] = True
    return np.packbits(bits).tobytes()


def folded(bits: np.ndarray, width: int) -> np.ndarray:
    """Rows of signatures at ``width`` bits, in 64-bit parts."""
    return np.bitwise_or.reduce(bits.reshape(len(bits), -1, width // 64), axis=1)


def _nth(x: np.ndarray) -> np.ndarray:
    """How many equal values stand before each value."""
    order = np.argsort(x, kind="stable")
    place, sorted_ = np.arange(len(x)), x[order]
    first = np.maximum.accumulate(np.where(np.r_[True, sorted_[1:] != sorted_[:-1]], place, 0))
    nth = np.empty(len(x), dtype=np.uint64)
    nth[order] = place - first
    return nth


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sketches(words: np.ndarray) -> np.ndarray:
    """The ``SKETCHES`` sketches of a text of at least one word."""
    width = min(SHINGLE, len(words))
    rows = len(words) - width + 1
    shingles = np.zeros(rows, dtype=np.uint64)
    for i in range(width):
        shingles = _mixed(shingles * np.uint64(0x9E3779B97F4A7C15) + words[i:i + rows] + np.uint64(1))
    shingles = _mixed(shingles + _nth(shingles) * np.uint64(0xD6E8FEB86659FD93))
    at = np.empty((SKETCHES, min(TAKEN, rows)), dtype=np.int64)
    step = max(1, BLOCK // rows)  # sketches at a time, for the memory of long texts
    for start in range(0, SKETCHES, step):
        ranks = shingles[None, :] * _ODD[start:start + step, None]
        for k in range(at.shape[1]):
            least = ranks.argmin(axis=1)
            at[start:start + step, k] = least
            ranks[np.arange(len(least)), least] = np.uint64(0xFFFFFFFFFFFFFFFF)
    at.sort(axis=1)
    sketch = np.arange(SKETCHES, dtype=np.uint64)
    for k in range(at.shape[1]):
        sketch = _mixed(sketch * np.uint64(0x9E3779B97F4A7C15) + shingles[at[:, k]])
    return sketch


def banded_distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """The edit distance of two sequences, or ``most + 1`` if it is larger; only cells within ``most`` of the diagonal are held."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return most + 1
    differs = np.flatnonzero(a[:len(b)] != b)
    head = int(differs[0]) if len(differs) else len(b)
    a, b = a[head:], b[head:]
    differs = np.flatnonzero(a[len(a) - len(b):][::-1] != b[::-1])
    tail = int(differs[0]) if len(differs) else len(b)
    a, b = a[:len(a) - tail].tolist(), b[:len(b) - tail].tolist()
    if not b:
        return len(a)
    most_here = min(most, len(a))
    at: dict[int, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    width = 2 * most_here + 2
    full, top = (1 << width) - 1, 1 << width - 1
    up, down = full << (width - most_here - 1) & full, 0  # vertical steps of +1 and of -1
    score, start, edge = most_here, most_here + 1 - width, top >> 1
    for i, w in enumerate(b):
        x = at.get(w, 0)
        x = (x << -start if start < 0 else x >> start) & full
        zero = ((((x & up) + up) ^ up) | x | down) & full
        right, left = down | full & ~(zero | up), zero & up
        if i < len(a) - most_here:
            score += not zero & top
        else:
            score += bool(right & edge) - bool(left & edge)
            edge >>= 1
        up, down = left | full & ~(zero >> 1 | right), zero >> 1 & right
        start += 1
        if score > 2 * most_here + len(b) - len(a) + most_here:
            return most + 1
    return score if score <= most else most + 1


def near_words(x: np.ndarray, y: np.ndarray, least: float = LEAST) -> bool:
    longer = max(len(x), len(y))
    most = int((1 - least) * longer + 1e-9)
    if abs(len(x) - len(y)) > most:
        return False
    # words of the longer text that the other has not, with multiplicity, each cost a step
    values, counts = np.unique(x, return_counts=True)
    others, other_counts = np.unique(y, return_counts=True)
    _, i, j = np.intersect1d(values, others, assume_unique=True, return_indices=True)
    fewest = longer - int(np.minimum(counts[i], other_counts[j]).sum())
    # a narrow band costs less and is enough for most copies
    return fewest <= most and any(banded_distance(x, y, b) <= b for b in (*(b for b in BANDS if fewest <= b < most), most))


def near(a: str, b: str, least: float = LEAST) -> bool:
    return near_words(word_hashes(a), word_hashes(b), least)


def components(edges: DataFrame) -> DataFrame:
    """(_id, _group): the smallest id of the connected component of every id in (_a, _b).

    In every round each id takes the smallest one next to it as its head, heads are followed twice, and edges
    are replaced by those between heads, without those inside one, until none is left.
    """
    left = stored(edges.select("_a", "_b").union(edges.select("_b", "_a")).distinct(), "edges")
    groups = left.select(F.col("_a").alias("_id"), F.col("_a").alias("_group")).distinct()
    while True:
        heads = stored(left.groupBy(F.col("_a").alias("_from")).agg(F.min(F.least("_a", "_b")).alias("_to")), "heads")
        for _ in range(2):
            over = heads.select(F.col("_from").alias("_to"), F.col("_to").alias("_far"))
            heads = stored(heads.join(over, "_to").select("_from", F.col("_far").alias("_to")), "heads")
        groups = stored(groups.join(heads, groups["_group"] == heads["_from"], "left").select("_id", F.coalesce("_to", "_group").alias("_group")), "groups")
        moved = left.join(heads.select(F.col("_from").alias("_a"), F.col("_to").alias("_x")), "_a").join(
            heads.select(F.col("_from").alias("_b"), F.col("_to").alias("_y")), "_b")
        left = stored(moved.filter(F.col("_x") != F.col("_y")).select(F.col("_x").alias("_a"), F.col("_y").alias("_b")).distinct(), "edges")
        if left.isEmpty():
            return groups


def runs(rows: DataFrame, kind: str) -> DataFrame:
    """(_s, _block, _id): all texts that share a sketch with another, each run of them in blocks of at most ``MEMBERS``."""
    order = ["_s", "_id"]
    keyed = rows.select(F.explode("_keys").alias("_s"), "_id")
    ranged = keyed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_block", F.spark_partition_id().cast("bigint"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows of a sorted task without those alone with their sketch; its first and last row stay, as their run may go on elsewhere."""
        last, before, begun = None, 0, False
        for batch in batches:
            if batch.empty:
                continue
            whole = batch if last is None else pd.concat([last, batch], ignore_index=True)
            s, place = whole["_s"].to_numpy(), np.arange(len(whole))
            new = np.r_[True, s[1:] != s[:-1]]
            start = np.maximum.accumulate(np.where(new, place, 0))
            nth = place - start + np.where(start == 0, before, 0)
            stays = ~((nth == 0) & np.r_[new[1:], True])
            if not begun and len(whole) > 1:
                stays[0] = begun = True
            stays[-1] = False  # decided with the next rows
            yield whole.assign(_block=whole["_block"] * (1 << 32) + nth // MEMBERS)[stays]
            last, before = whole.iloc[-1:], int(nth[-1])
        if last is not None:
            yield last.assign(_block=last["_block"] * (1 << 32) + before // MEMBERS)

    return stored(ranged.mapInPandas(cut, f"_s bigint, _id {kind}, _block bigint"), "runs")


class Side(NamedTuple):
    """Texts of a block: ids, words, classes, widths, and for each power of two the bits, their number and the rows of the texts that have it."""

    ids: np.ndarray
    n: np.ndarray
    of: np.ndarray
    widths: np.ndarray
    bits: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]


def side(ids: np.ndarray, n: np.ndarray, of: np.ndarray, signatures: np.ndarray) -> Side:
    widths, bits = np.array([len(x) * 8 for x in signatures]), {}
    own = {w: np.frombuffer(b"".join(signatures[widths == w]), np.uint64).reshape(-1, w // 64) for w in np.unique(widths).tolist()}
    for w in (w for w in POWERS if w <= max(own)):
        row, at = np.full(len(ids), -1), 0
        for wider in (x for x in own if x >= w):
            there = np.flatnonzero(widths == wider)
            row[there], at = np.arange(at, at + len(there)), at + len(there)
        rows = np.concatenate([folded(own[x], w) for x in own if x >= w])
        bits[w] = rows, np.bitwise_count(rows).sum(axis=1, dtype=np.int64), row
    return Side(np.asarray(ids), np.asarray(n, dtype=np.int64), of, widths, bits)


def _missing(a: Side, j: np.ndarray, b: Side, i: np.ndarray) -> np.ndarray:
    """Words of ``b[i]`` or ``a[j]``, whichever are more, that the other has not, as far as their signatures tell."""
    missing, width = np.empty(len(i), dtype=np.int64), np.minimum(a.widths[j], b.widths[i])
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        (bits, ones, row), (bits2, ones2, row2) = a.bits[w], b.bits[w]
        for some in np.array_split(at, -(-len(at) * w // (64 * BLOCK))):  # of bounded memory
            x, y = row[j[some]], row2[i[some]]
            missing[some] = np.maximum(ones[x], ones2[y]) - np.bitwise_count(bits[x] & bits2[y]).sum(axis=1, dtype=np.int64)
    return missing


def close_pairs(a: Side, b: Side | None, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of b, rows of a, bound) of all pairs of two classes that bounds do not rule out; ``b`` None: pairs within ``a``."""
    within, b = b is None, a if b is None else b
    (bits, ones, row), (bits2, ones2, row2) = a.bits[BITS], b.bits[BITS]
    bits, ones, bits2, ones2 = bits[row], ones[row], bits2[row2], ones2[row2]
    step = max(1, BLOCK // len(a.ids))
    for start in range(0, len(b.ids), step):
        here, there = slice(start, start + step), slice(0, start + step if within else len(a.ids))
        common = np.zeros((len(b.ids[here]), len(a.ids[there])), dtype=np.int32)
        for k in range(BITS // 64):
            common += np.bitwise_count(bits2[here, k, None] & bits[None, there, k])
        n, m = b.n[here, None], a.n[None, there]
        longer = np.maximum(n, m)
        most = ((1 - least) * longer + 1e-9).astype(np.int64)
        bound = np.maximum(np.maximum(ones2[here, None], ones[None, there]) - common, longer - np.minimum(n, m))
        able = (bound <= most) & (b.of[here, None] != a.of[None, there])
        if within:
            able &= np.arange(start, start + able.shape[0])[:, None] > np.arange(able.shape[1])[None, :]
        i, j = np.nonzero(able)
        bound, most, i = bound[i, j], most[i, j], i + start
        wide = np.flatnonzero(np.minimum(a.widths[j], b.widths[i]) > BITS)
        if len(wide):
            bound[wide] = np.maximum(bound[wide], _missing(a, j[wide], b, i[wide]))
            able = bound <= most
            i, j, bound = i[able], j[able], bound[able]
        if len(i):
            yield i, j, bound


def candidates(met: DataFrame, info: DataFrame, asked: DataFrame | None, kind: str, least: float, whole: bool) -> DataFrame:
    """(_a, _b): pairs of texts of one run and of two classes that bounds do not rule out.

    ``info`` is (_id, _n, _class, _bits); ``asked`` holds the block pairs to compare, all if it is None.  Where a block pair has
    more than ``MANY`` pairs a text, and not ``whole``, every text meets its closest one only, and a row with null _a names it.
    """
    if asked is not None:
        met = met.join(asked.select("_s", F.explode(F.array("_block", "_other")).alias("_block")).distinct(), ["_s", "_block"], "left_semi")
    packed = stored(met.join(info, "_id").groupBy("_s", "_block").agg(*[F.collect_list(c).alias(c) for c in ("_id", "_n", "_class", "_bits")]), "blocks")
    if asked is None:
        # runs of more than one block are rare: long ones, and those on the border of two tasks
        blocks = packed.groupBy("_s").agg(F.sort_array(F.collect_list("_block")).alias("_all")).filter(F.size("_all") > 1)
        cross = blocks.select("_s", F.posexplode("_all").alias("_at", "_other"), "_all").select("_s", "_other", F.explode(F.slice("_all", 1, F.col("_at"))).alias("_block"))
        inner = packed
    else:
        cross = asked.filter(F.col("_block") != F.col("_other")).select("_s", "_other", "_block")
        inner = packed.join(asked.filter(F.col("_block") == F.col("_other")).select("_s", "_block"), ["_s", "_block"], "left_semi")
    cols = ("_id", "_n", "_class", "_bits")
    others = packed.select("_s", F.col("_block").alias("_other"), *[F.col(c).alias(c + "2") for c in cols])
    two = packed.join(cross, ["_s", "_block"]).join(others, ["_s", "_other"]).select("_s", "_block", "_other", *cols, *[c + "2" for c in cols])
    one = inner.filter(F.size("_id") > 1).select("_s", "_block", F.col("_block").alias("_other"), *cols)

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            few = []  # of blocks that are done
            for r in rows.itertuples(index=False, name=None):
                (*key, ids, n, of, bits), more = r[:7], r[7:]
                codes = pd.factorize(np.concatenate([of, more[2]]) if more else np.asarray(of))[0]
                a = side(ids, n, codes[:len(ids)], bits)
                b = side(*more[:2], codes[len(ids):], more[3]) if more else None
                of_b = b or a
                closest, bound_there = np.full(len(of_b.ids), -1), np.full(len(of_b.ids), np.iinfo(np.int64).max)
                hits, many = [], 0
                for i, j, bound in close_pairs(a, b, least):
                    many += len(i)
                    if whole:
                        yield proposed(of_b.ids[i], a.ids[j], key)
                        continue
                    if many <= MANY * len(of_b.ids):
                        hits.append((i, j))
                    order = np.lexsort((bound, i))
                    best = order[np.r_[True, i[order][1:] != i[order][:-1]]]
                    best = best[bound[best] < bound_there[i[best]]]
                    closest[i[best]], bound_there[i[best]] = j[best], bound[best]
                if not whole and many > MANY * len(of_b.ids):
                    i = np.flatnonzero(closest >= 0)
                    yield proposed(of_b.ids[i], a.ids[closest[i]], key)
                    yield proposed([None], [None], key)
                elif not whole:
                    few += [(of_b.ids[i], a.ids[j]) for i, j in hits]
            if few:
                yield proposed(*map(np.concatenate, zip(*few)), (None, None, None))

    def proposed(x: np.ndarray | list, y: np.ndarray | list, key: Sequence) -> pd.DataFrame:
        return pd.DataFrame({"_a": x, "_b": y}).assign(_s=key[0], _block=key[1], _other=key[2])

    schema = f"_a {kind}, _b {kind}, _s bigint, _block bigint, _other bigint"
    return stored(one.mapInPandas(meet, schema).union(two.mapInPandas(meet, schema)), "met")


def joined_groups(groups: DataFrame, links: DataFrame) -> DataFrame:
    """``groups`` with those made one that ``links`` join; ids without a group are their own."""
    of = {c: groups.select(F.col("_id").alias(c), F.col("_group").alias("_of" + c)) for c in ("_a", "_b")}
    between = links.join(of["_a"], "_a", "left").join(of["_b"], "_b", "left").select(
        F.coalesce("_of_a", "_a").alias("_a"), F.coalesce("_of_b", "_b").alias("_b")).filter(F.col("_a") != F.col("_b"))
    merged = components(between).select(F.col("_id").alias("_head"), F.col("_group").alias("_to"))
    whole = groups.join(merged, groups["_group"] == merged["_head"], "full_outer")
    return stored(whole.select(F.coalesce("_id", "_head").alias("_id"), F.coalesce("_to", "_group").alias("_group")).distinct(), "groups")


def detailed(rows: DataFrame, wanted: DataFrame, kind: str) -> DataFrame:
    """(_id, _n, _bits) with signatures that hardly two words share a bit in, for the few texts left in the last round."""
    def wide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for r in batches:
            yield r[["_id", "_n"]].assign(_bits=[signature(np.frombuffer(w, np.uint32).astype(np.uint64), 32, WIDEST) for w in r["_words"]])

    return rows.select("_id", "_n", "_words").join(wanted.select("_id").distinct(), "_id", "left_semi").mapInPandas(wide, f"_id {kind}, _n bigint, _bits binary")


def near_pairs(rows: DataFrame, single: DataFrame, kind: str, least: float) -> DataFrame:
    """(_id, _group): the components of all near pairs of texts that share a sketch.

    A round aligns what the blocks propose and joins classes.  A block with few proposals is done after one round; in the
    others, mostly of near copies, a text first meets its closest one, and the last round all texts that are still in another class.
    """
    met, asked, tested, groups = runs(single, kind), None, None, None
    info = single.select("_id", "_n", "_bits")
    for turn in range(ROUNDS):
        if turn == ROUNDS - 1:
            info = stored(detailed(rows, met.join(asked.select("_s", F.explode(F.array("_block", "_other")).alias("_block")), ["_s", "_block"]), kind), "details")
        classed = info.withColumn("_class", F.col("_id")) if groups is None else info.join(groups, "_id", "left").select("_id", "_n", "_bits", F.coalesce("_group", "_id").alias("_class"))
        found = candidates(met, classed, asked, kind, least, turn == ROUNDS - 1)
        pairs = found.filter(F.col("_a").isNotNull()).select(F.greatest("_a", "_b").alias("_a"), F.least("_a", "_b").alias("_b")).distinct()
        pairs = stored(pairs if tested is None else pairs.join(tested, ["_a", "_b"], "left_anti"), "pairs")
        near = stored(aligned(rows, pairs, kind, least), "near")
        tested = pairs if tested is None else tested.union(pairs)
        groups = components(near) if groups is None else joined_groups(groups, near)
        asked = found.filter(F.col("_a").isNull()).select("_s", "_block", "_other")
        if asked.isEmpty():
            break
    return groups


def aligned(rows: DataFrame, pairs: DataFrame, kind: str, least: float) -> DataFrame:
    """The rows of ``pairs`` whose texts are near."""
    # written, so its size is known before any words move
    wanted = stored(pairs.select(F.explode(F.array("_a", "_b")).alias("_id")).distinct(), "wanted")
    needed = stored(rows.select("_id", "_words").join(wanted, "_id", "left_semi"), "words")
    joined = pairs.join(needed.select(F.col("_id").alias("_a"), F.col("_words").alias("_x")), "_a").join(
        needed.select(F.col("_id").alias("_b"), F.col("_words").alias("_y")), "_b").select("_a", "_b", "_x", "_y")

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            yield p.loc[[near_words(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32), least) for x, y in zip(p["_x"], p["_y"])], ["_a", "_b"]]

    return joined.mapInPandas(judge, f"_a {kind}, _b {kind}")


def copies(df: DataFrame, ident: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """(_id, _group) of all rows that are not alone in their group; the row with _id = _group is the one to keep."""
    texts = df.select(F.col(ident).alias("_id"), F.col(text).alias("_text")).filter(F.rlike("_text", F.lit(WORD)) & F.col("_id").isNotNull())
    kind = dict(texts.dtypes)["_id"]

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            words = [word_hashes(t) for t in rows["_text"]]
            keys = [sketches(w).view(np.int64) for w in words]
            yield pd.DataFrame({"_id": rows["_id"], "_print": rows["_print"], "_n": [len(w) for w in words],
                                "_words": [w.astype(np.uint32).tobytes() for w in words], "_keys": keys, "_bits": [signature(w) for w in words]})

    rows = stored(texts.withColumn("_print", F.unhex(F.md5("_text"))).mapInPandas(
        hashed, f"_id {kind}, _print binary, _n bigint, _words binary, _keys array<bigint>, _bits binary"), "sketches")
    firsts = rows.groupBy(F.col("_print").alias("_key")).agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_many")).filter("_many > 1").drop("_many")
    exact = stored(attach(rows.select("_id", "_print"), firsts, "_print", F.col("_id"), SALTS, "inner").filter(F.col("_id") != F.col("_first")).select(
        F.col("_id").alias("_a"), F.col("_first").alias("_b")).distinct(), "exact")
    single = rows.join(exact, rows["_id"] == exact["_a"], "left_anti")
    alike = near_pairs(rows, single, kind, least)
    # an exact copy takes the group of its first text; every first is there, alone if it has no near one
    heads = exact.select(F.col("_b").alias("_id")).distinct().join(alike, "_id", "full_outer").select("_id", F.coalesce("_group", "_id").alias("_group"))
    heads = stored(heads, "heads")
    far = attach(exact, heads.withColumnRenamed("_id", "_key"), "_b", F.col("_a"), SALTS, "inner").select(F.col("_a").alias("_id"), "_group")
    return far.union(heads).groupBy("_id").agg(F.min("_group").alias("_group"))


def group_copies(df: DataFrame, ident: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """Rows of ``df`` with ``copy_of`` (the id that its group keeps, its own if it is alone) and ``kept``."""
    found = copies(df, ident, text, least)
    df = df.drop("copy_of", "kept")
    joined = df.join(found, df[ident] == found["_id"], "left")
    return joined.select(*[df[c] for c in df.columns], F.coalesce(found["_group"], df[ident]).alias("copy_of"),
                         F.coalesce(found["_id"] == found["_group"], F.lit(True)).alias("kept"))


def drop_copies(df: DataFrame, ident: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """Rows of ``df`` without those whose group keeps another row."""
    found = stored(copies(df, ident, text, least).filter(F.col("_id") != F.col("_group")).select("_id"), "dropped")
    return df.join(F.broadcast(found) if fits_broadcast(found) else found, df[ident] == found["_id"], "left_anti")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    return group_copies(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "copy_of", "kept")
