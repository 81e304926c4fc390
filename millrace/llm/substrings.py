"""Exact substring dedup over a logarithmic family of sparse suffix arrays.

Every byte that lies in a string of ``least`` bytes (200) which also starts anywhere else is
removed. Texts are UTF-8 bytes; matches don't cross documents.

Sparse suffixes. A suffix array over every byte would be several times the input, so only
suffixes that begin at *anchors* are indexed. Of the ``least - WORD + 1`` words of ``WORD`` bytes
in a string of ``least`` bytes, those with the smallest hash are anchors. Which they are depends
on the string alone, so equal strings have equal anchors at equal places, and no match of
``least`` bytes is missed. About one byte in 65 is an anchor.

The family. An entry is a suffix's first ``WORD`` bytes, the hash of its surroundings (``ctx``: all
bytes of the document that share a string of ``least`` bytes with the word) and its smallest and largest owner. Entries are dealt by range
of (word, ctx), so the shards together are in the byte order of the suffixes; a shard holds about ``SHARD`` entries, whatever
the corpus holds, and a frequent word is cut over several. Each shard keeps a logarithmic family: the corpus comes in
``BATCHES`` batches of documents; a batch becomes a suffix array, sorted in byte order; it is merge-scanned against each
level for suffixes with equal words; then it becomes a level, and levels of equal size merge, so n batches make
log n levels. Suffixes whose word came up in two places are hits; the first and the last word of a shard are passed on as hits in any
case, as the next shard may hold more of them.

What a hit means. Equal (word, ctx) with two owners: all strings of ``least`` bytes around the
word repeat. Equal word and different ctx: how far the match reaches is decided on the bytes.
A string of ``least`` bytes around the word holds the ``least / 2`` bytes from the word's start on, or the
``least / 2`` bytes before it and the word. So undecided anchors meet by the hash of either, which splits
the places of a frequent word by what stands around it, and those that nobody shares a side with are
done. The surroundings of the rest are cut out of their documents, and strings of ``least`` bytes in
them with equal hashes are compared byte by byte. Of equal surroundings one stands for all. Where over ``HOT`` places share a
side, they don't meet: their strings are hashed to 128 bits where they are read, and the hashes are counted.

Equal texts are one text throughout: they are known by their digest, they are removed
entirely if they have ``least`` bytes, and one of them is the partner of others.

Defined cases: null text is empty; texts under ``least`` bytes are never touched; repeated
rows are copies, so they go entirely if long enough; very long texts are cut by the same rule as others; an empty table
gives no rows; null doc_id is carried through; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table, texts_of, whole_groups

LEAST = 200
WORD = 32
#: Batches that the corpus comes in, entries of a shard, and places of a side that meet in one task at most.
BATCHES = 8
SHARD = 1 << 19
HOT = 1 << 14
#: Texts that a task knows by their digest, and entries that it knows, before it forgets them.
SEEN, GIVEN = 1 << 16, 1 << 20
_BUFFER = 1 << 21
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def _mix(a: np.ndarray, b: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of one or two arrays of 64-bit values."""
    out = a * np.uint64(_MULTIPLIERS[0])
    if b is not None:
        out += (b ^ (b >> np.uint64(29))) * np.uint64(_MULTIPLIERS[1])
    out ^= out >> np.uint64(32)
    out *= np.uint64(_MULTIPLIERS[2])
    out ^= out >> np.uint64(29)
    return out


def _words(data: np.ndarray, size: int) -> dict[int, np.ndarray]:
    """Hashes of all strings of 8, 16, ... size bytes (along the last axis), by length."""
    n = data.shape[-1]
    eight = np.lib.stride_tricks.sliding_window_view(data, 8, axis=-1)
    known = {8: _mix(np.ascontiguousarray(eight).view("<u8")[..., 0])}
    m = 8
    while m < size:
        known[2 * m] = _mix(known[m][..., : n - 2 * m + 1], known[m][..., m : n - m + 1])
        m *= 2
    return known


def _slide(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over each run of width values."""
    m = 1
    while 2 * m <= width:
        values = pick(values[:-m], values[m:])
        m *= 2
    return values if m == width else pick(values[: len(values) - (width - m)], values[width - m :])


def _stretch(hashes: np.ndarray, low: np.ndarray, high: np.ndarray, most: int, out: np.ndarray) -> np.ndarray:
    """Hash of the bytes from low to high, most bytes at most, from the hashes of their words."""
    for j in range(-(-most // WORD)):
        out = _mix(out, hashes[np.minimum(low + j * WORD, high - WORD)])
    return out


def anchors(texts: list[bytes], least: int = LEAST) -> tuple[np.ndarray, ...]:
    """(number of the text, position, word, key, ctx, right, left) of every anchor of every text; a side that the text is too short
    for is 0."""
    use = [i for i, x in enumerate(texts) if len(x) >= least]
    if not use:
        return (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, f"S{WORD}"), *(np.empty(0, np.int64),) * 4)
    sizes = np.array([len(texts[i]) for i in use])
    data = np.frombuffer(b"".join(texts[i] for i in use), np.uint8)
    ends = np.cumsum(sizes)
    hashes = _words(data, WORD)[WORD]
    width = least - WORD + 1
    order = (hashes >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    low = _slide(order, width, np.minimum)  # of each string of ``least`` bytes, by its start
    first = np.repeat(ends - sizes, sizes)
    last = np.repeat(ends, sizes)
    at = np.arange(len(low))
    low = np.where(at + least <= last[: len(low)], low, np.uint32(0))  # strings across texts have none
    edge = np.zeros(width - 1, np.uint32)
    high = _slide(np.concatenate([edge, low, edge]), width, np.maximum)[: len(order)]
    p = np.flatnonzero(high == order)
    left, right = np.maximum(p - (width - 1), first[p]), np.minimum(p + least, last[p])
    ctx = _stretch(hashes, left, right, width - 1 + least, _mix((p - left).astype(np.uint64), (right - p).astype(np.uint64)))
    half = least // 2
    behind, before = np.minimum(p + half, last[p]), np.maximum(p - half, first[p])
    side_r = np.where(behind - p == half, _stretch(hashes, p, behind, half, np.full(len(p), 1, np.uint64)), np.uint64(0))
    side_l = np.where(p - before == half, _stretch(hashes, before, p + WORD, half + WORD, np.full(len(p), 2, np.uint64)), np.uint64(0))
    number = np.repeat(np.arange(len(use)), sizes)[p]
    words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, WORD)[p]).view(f"S{WORD}")[:, 0]
    return np.array(use)[number], p - first[p], words, *(x.view(np.int64) for x in (hashes[p], ctx, side_r, side_l))


def _anchor_rows(batches: Iterator[pd.DataFrame], least: int) -> Iterator[pd.DataFrame]:
    seen: set[bytes] = set()  # of this batch of rows: copies close together are left out at once
    given: dict[int, int] = {}  # entries by (word, ctx) that this task has given to the family: two of different owners tell all
    for batch in batches:
        texts, digests, held = [], [], 0
        for text in batch["text"]:
            raw = text.encode("utf-8", "surrogatepass") if text else b""
            digest = hashlib.md5(raw).digest()
            if len(raw) >= least and digest not in seen:
                seen.add(digest)
                texts.append(raw)
                digests.append(digest)
                held += len(raw)
            if held > _BUFFER:
                yield _frame(texts, digests, least, given)
                texts, digests, held = [], [], 0
        if texts:
            yield _frame(texts, digests, least, given)
        if len(seen) > SEEN:
            # a copy of a text that is forgotten gives the same owners again, so what they have given is forgotten too
            seen.clear()
            given.clear()
        if len(given) > GIVEN:
            given.clear()


def _frame(texts: list[bytes], digests: list[bytes], least: int, given: dict[int, int]) -> pd.DataFrame:
    number, at, words, key, ctx, right, left = anchors(texts, least)
    names = np.empty(len(digests), object)
    names[:] = digests
    own = np.empty(len(words), object)
    raw = words.tobytes()
    for i, one in enumerate((key ^ (ctx << 1)).tolist()):
        n = given.get(one, 0)
        if n < 2:
            given[one] = n + 1
            own[i] = raw[WORD * i : WORD * i + WORD]
    return pd.DataFrame({"digest": names[number], "at": at.astype(np.int32), "word": own, "key": key, "ctx": ctx, "right": right, "left": left})


def _owner() -> F.Column:
    return F.xxhash64("digest", "at")


@dataclass
class SuffixArray:
    """Suffixes in byte order of their words, then of ctx; equal (word, ctx) are one entry."""

    word: np.ndarray
    key: np.ndarray
    ctx: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    hit: np.ndarray

    @classmethod
    def of(cls, word, key, ctx, lo, hi, hit) -> SuffixArray:
        """Sorts entries; stretches that are sorted already are merged (the stable sort takes them as runs)."""
        order = np.argsort(word, kind="stable")
        group = _groups(word[order])
        order = order[np.lexsort((ctx[order], group))]
        word, key, ctx, lo, hi, hit = (x[order] for x in (word, key, ctx, lo, hi, hit))
        first = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (ctx[1:] != ctx[:-1])])) if len(word) else np.empty(0, np.int64)
        if len(first) == len(word):
            return cls(word, key, ctx, lo, hi, hit)
        return cls(word[first], key[first], ctx[first], np.minimum.reduceat(lo, first), np.maximum.reduceat(hi, first), np.maximum.reduceat(hit, first))

    def columns(self) -> tuple[np.ndarray, ...]:
        return self.word, self.key, self.ctx, self.lo, self.hi, self.hit

    def __len__(self) -> int:
        return len(self.word)


def _groups(words: np.ndarray) -> np.ndarray:
    """Numbers of the runs of equal words."""
    return np.cumsum(np.concatenate([[0], words[1:] != words[:-1]])) if len(words) else np.empty(0, np.int64)


class SuffixFamily:
    """Levels of suffix arrays. ``add`` takes a new batch; what it shares with itself or with a level is marked as a hit."""

    def __init__(self):
        self.levels: list[tuple[int, SuffixArray]] = []  # (batches, suffixes), largest first
        self.merges = 0

    def add(self, word: np.ndarray, key: np.ndarray, ctx: np.ndarray, owner: np.ndarray) -> None:
        run = SuffixArray.of(word, key, ctx, owner, owner.copy(), np.zeros(len(word), bool))
        group = _groups(run.word)
        run.hit |= (np.bincount(group)[group] > 1 if len(run) else run.hit) | (run.lo != run.hi)
        for _, level in self.levels:
            self.scan(run, level)
        self.levels.append((1, run))
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            self._merge()

    @staticmethod
    def scan(run: SuffixArray, level: SuffixArray) -> None:
        """Walks both arrays in byte order; words that are in both are hits in both."""
        if not len(run) or not len(level):
            return
        both = np.concatenate([level.word, run.word])
        order = np.argsort(both, kind="stable")
        new = order >= len(level)
        first = np.flatnonzero(np.concatenate([[True], both[order[1:]] != both[order[:-1]]]))
        shared = np.maximum.reduceat(new, first) & ~np.minimum.reduceat(new, first)
        hit = order[np.repeat(shared, np.diff([*first, len(order)]))]
        level.hit[hit[hit < len(level)]] = True
        run.hit[hit[hit >= len(level)] - len(level)] = True

    def _merge(self) -> None:
        (n, a), (m, b) = self.levels.pop(-2), self.levels.pop(-1)
        self.levels.append((n + m, SuffixArray.of(*map(np.concatenate, zip(a.columns(), b.columns())))))
        self.merges += 1

    def whole(self) -> SuffixArray | None:
        while len(self.levels) > 1:
            self._merge()
        return self.levels[0][1] if self.levels else None


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One shard's entries -> its hits. decided: all strings around the word repeat; open: the word has other surroundings too."""
    parts: dict[int, list] = {}
    for batch in batches:
        if batch.num_rows:
            word = np.frombuffer(b"".join(batch.column(0).to_pylist()), f"S{WORD}")
            key, ctx, owner, number = (batch.column(i).to_numpy() for i in range(1, 5))
            for b in np.unique(number):
                some = number == b
                parts.setdefault(int(b), []).append((word[some], key[some], ctx[some], owner[some]))
    family = SuffixFamily()
    for b in sorted(parts):
        family.add(*map(np.concatenate, zip(*parts.pop(b))))
    merges, array = family.merges, family.whole()
    if array is None:
        return
    group = _groups(array.word)
    alone = array.lo == array.hi
    loose = (np.bincount(group)[group] > 1) & (np.bincount(group, alone)[group] > 0)
    edge = (group == group[0]) | (group == group[-1])
    decided, some = ~alone, array.hit | edge
    out = np.flatnonzero(some & (decided | loose | edge))
    for at in range(0, len(out), 1 << 16):
        o = out[at : at + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(array.key[o]), pa.array(array.ctx[o]), pa.array(array.lo[o]), pa.array(decided[o]), pa.array((loose | edge)[o]), pa.array(np.full(len(o), merges, np.int32))], ["key", "ctx", "lo", "decided", "open", "merges"])


def family_hits(suffixes: DataFrame, shards: int, batches: int = BATCHES) -> DataFrame:
    """suffixes(digest, at, word, key, ctx) -> hits(key, ctx, lo, decided, open, merges)."""
    entries = suffixes.where("word is not null").select("word", "key", "ctx", _owner().alias("o"), F.pmod(F.xxhash64("digest"), F.lit(batches)).cast("int").alias("batch"))
    return entries.repartitionByRange(shards, "word", "ctx").mapInArrow(_shard, "key long, ctx long, lo long, decided boolean, open boolean, merges int")


def _no_spans() -> pd.DataFrame:
    return pd.DataFrame({"digest": pd.Series(dtype=object), "low": pd.Series(dtype="int32"), "high": pd.Series(dtype="int32")})


def _compare(frame: pd.DataFrame, least: int) -> pd.DataFrame:
    """Spans of undecided anchors, from the bytes around all anchors that share a side with them.

    ``before`` bytes stand ahead of the anchor. A group by the right side looks at the strings that begin at most least / 2 bytes ahead
    of the anchor, one by the left side at those that begin earlier."""
    half = least // 2
    out = [_compare_side(own, least, *reach) for own, reach in ((frame[frame["side"] == 0], (half, half + 1)), (frame[frame["side"] == 1], (least - WORD, least - WORD - half)))]
    return pd.concat(out)


def _strings(frame: pd.DataFrame, least: int, reach: int, wide: int) -> Iterator[tuple[np.ndarray, ...]]:
    """All strings of ``least`` bytes around the places of a frame: (row, start from the anchor, hash, second hash).

    reach: the earliest start ahead of an anchor; wide: how many starts."""
    before = frame["before"].to_numpy()
    for some in range(0, len(frame), 2048):
        part = frame["around"].iloc[some : some + 2048]
        data = np.zeros((len(part), wide - 1 + least), np.uint8)
        begin = reach - before[some : some + len(part)]
        stop = np.empty(len(part), np.int64)
        for i, raw in enumerate(part):
            low = max(0, int(begin[i]))
            own = raw[low - int(begin[i]) :][: data.shape[1] - low]
            data[i, low : low + len(own)] = np.frombuffer(own, np.uint8)
            stop[i] = low + len(own)
        known = _words(data, 128)
        rest, place, whole, second = least, 0, None, None
        while rest >= 8:  # least as a sum of powers of two, then eight bytes that overlap
            m = min(128, 1 << (rest.bit_length() - 1))
            piece = known[m][:, place : place + wide]
            whole = piece if whole is None else _mix(whole, piece)
            second = ~piece if second is None else _mix(piece, second)
            place, rest = place + m, rest - m
        if rest:
            piece = known[8][:, least - 8 : least - 8 + wide]
            whole, second = _mix(whole, piece), _mix(piece, second)
        start = np.arange(wide)[None, :]
        i, j = np.nonzero((start >= begin[:, None]) & (start + least <= stop[:, None]))
        yield (some + i).astype(np.int32), (j - reach).astype(np.int32), whole[i, j], second[i, j]


def _runs(r: np.ndarray, d: np.ndarray, frame: pd.DataFrame, least: int) -> pd.DataFrame:
    """Spans of the repeated strings (row, start), sorted: neighbouring starts of one anchor make one span."""
    at = frame["at"].to_numpy()
    new = np.concatenate([[True], (r[1:] != r[:-1]) | (d[1:] != d[:-1] + 1)])
    begin = np.flatnonzero(new)
    end = np.concatenate([begin[1:], [len(r)]]) - 1
    return pd.DataFrame({"digest": frame["digest"].to_numpy()[r[begin]], "low": (at[r[begin]] + d[begin]).astype(np.int32), "high": (at[r[end]] + d[end] + least).astype(np.int32)})


def _compare_side(frame: pd.DataFrame, least: int, reach: int, wide: int) -> pd.DataFrame:
    n = len(frame)
    if n < 2:
        return _no_spans()
    digest64 = np.frombuffer(b"".join(x[:8] for x in frame["digest"]), "<u8")
    at, before, keys = frame["at"].to_numpy(), frame["before"].to_numpy(), frame["grp"].to_numpy().view(np.uint64)
    found = list(_strings(frame, least, reach, wide))
    r, d, h = (np.concatenate([x[i] for x in found]) for i in range(3))
    if not len(h):
        return _no_spans()
    h = _mix(h, keys[r])
    o = _mix(digest64[r], (at[r] + d).astype(np.uint64))
    order = np.argsort(h, kind="stable")
    h, o, r, d = h[order], o[order], r[order], d[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    size = np.diff([*first, len(h)])
    lead = np.repeat(first, size)
    other = o != o[lead]
    last = np.maximum.reduceat(np.where(other, np.arange(len(h)), -1), first)  # of each hash, one of another owner than its first
    mate = np.where(other, lead, np.repeat(last, size))
    hit = np.flatnonzero((mate >= 0) & ~frame["decided"].to_numpy()[r])
    if not len(hit):
        return _no_spans()
    # strings that begin next to each other and whose mates do so too are compared in one go, byte by byte
    hit = hit[np.lexsort((d[hit], r[hit]))]
    mate = mate[hit]
    rr, dd, mr, md = r[hit], d[hit], r[mate], d[mate]
    new = np.concatenate([[True], (rr[1:] != rr[:-1]) | (dd[1:] != dd[:-1] + 1) | (mr[1:] != mr[:-1]) | (md[1:] != md[:-1] + 1)])
    begin = np.flatnonzero(new)
    end = np.concatenate([begin[1:], [len(hit)]])
    around = frame["around"].to_numpy()
    same = np.ones(len(hit), bool)
    for b, e, i, j, x, y in zip(begin.tolist(), end.tolist(), rr[begin].tolist(), mr[begin].tolist(), (before[rr[begin]] + dd[begin]).tolist(), (before[mr[begin]] + md[begin]).tolist()):
        m = e - b - 1 + least
        if around[i][x : x + m] != around[j][y : y + m]:
            for c in range(e - b):  # a hash that two strings share: each string is looked for among all with its hash
                own = around[i][x + c : x + c + least]
                s = np.searchsorted(h, h[hit[b + c]])
                t = np.searchsorted(h, h[hit[b + c]], side="right")
                same[b + c] = any(o[z] != o[hit[b + c]] and around[r[z]][before[r[z]] + d[z] :][:least] == own for z in range(s, t))
    return _runs(rr[same], dd[same], frame, least) if same.any() else _no_spans()


def _string_rows(batches: Iterator[pd.DataFrame], least: int) -> Iterator[pd.DataFrame]:
    """For sides that very many places share: each string's 128-bit hash and owner."""
    half = least // 2
    for batch in batches:
        for side, reach, wide in ((0, half, half + 1), (1, least - WORD, least - WORD - half)):
            own = batch[batch["side"] == side].reset_index(drop=True)
            for some in range(0, len(own), 256):
                frame = own.iloc[some : some + 256].reset_index(drop=True)
                for r, d, h, h2 in _strings(frame, least, reach, wide):
                    yield pd.DataFrame({"h": h.view(np.int64), "h2": h2.view(np.int64), "digest": frame["digest"].to_numpy()[r], "start": (frame["at"].to_numpy()[r] + d).astype(np.int32), "decided": frame["decided"].to_numpy()[r]})


def _counted_strings(around: DataFrame, least: int, scratch: Scratch) -> DataFrame:
    """Spans in the places of sides that are too frequent to meet: hashes add up where they are read."""
    strings = scratch.put(around.mapInPandas(lambda b: _string_rows(b, least), "h long, h2 long, digest binary, start int, decided boolean"))
    owner = F.xxhash64("digest", "start")
    # written, so that the join below may split a string that very many places hold
    twice = scratch.put(strings.groupBy("h", "h2").agg(F.min(owner).alias("lo"), F.max(owner).alias("hi")).where("lo <> hi").select("h", "h2"))
    return strings.where("not decided").join(twice, ["h", "h2"], "left_semi").select("digest", F.col("start").alias("low"), (F.col("start") + least).cast("int").alias("high")).distinct()


def repeated_spans(docs: DataFrame, scratch: Scratch, least: int = LEAST, batches: int = BATCHES, shard: int = SHARD, hot: int = HOT) -> DataFrame:
    """docs(digest, text) -> (digest, spans array<struct<low, high>>): repeated bytes of each text, unions not yet formed.

    Texts that occur more than once aren't told apart here (see ``remove_repeats``).
    """
    kinds = "digest binary, at int, word binary, key long, ctx long, right long, left long"
    suffixes = scratch.put(docs.select("text").mapInPandas(lambda b: _anchor_rows(b, least), kinds))
    shards = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-suffixes.where("word is not null").count() // shard))
    hits = scratch.put(family_hits(suffixes, shards, batches))
    # a hit is one row of its (key, ctx), so it is the side to hash; a frequent one is split by the adaptive skew join
    met = suffixes.drop("word").join(hits.select("key", "ctx", "lo", "decided", "open").hint("shuffle_hash"), ["key", "ctx"])
    met = scratch.put(met.select("digest", "at", "key", "right", "left", "decided", (F.col("open") & (_owner() == F.col("lo"))).alias("place")).where("decided or place"))
    scratch.drop(suffixes, hits)
    sure = met.where("decided").select("digest", F.greatest(F.col("at") - (least - WORD), F.lit(0)).alias("low"), (F.col("at") + least).alias("high"))

    sides = F.array(*[F.struct(F.col(c).alias("hash"), F.lit(i).alias("side")) for i, c in enumerate(("right", "left"))])
    places = met.where("place").select("digest", "at", "key", "decided", F.explode(sides).alias("s")).where("s.hash <> 0").select("digest", "at", "decided", "s.side", F.xxhash64("key", "s.hash").alias("grp")).distinct()
    places = scratch.put(places)
    shared = places.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.bool_and("decided").alias("all")).where("n > 1 and not all").select("grp", (F.col("n") > hot).alias("often"))
    places = scratch.put(places.join(shared, "grp").groupBy("digest").agg(F.collect_list(F.struct("at", "grp", "side", "decided", "often")).alias("places")))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reach, half, names = least - WORD, least // 2, ["grp", "digest", "at", "before", "side", "decided", "often", "around"]
        for batch in batches:
            rows = []
            for digest, text, wanted in zip(batch["digest"], batch["text"], batch["places"]):
                raw = text.encode("utf-8", "surrogatepass")
                for x in wanted:
                    at = x["at"]
                    low, high = (max(0, at - half), at + least) if x["side"] == 0 else (max(0, at - reach), at + least - half - 1)
                    rows.append((x["grp"], bytes(digest), at, at - low, x["side"], x["decided"], x["often"], raw[low:high]))
                if len(rows) > 20_000:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=names)

    around = texts_of(docs, places).mapInPandas(cut, "grp long, digest binary, at int, before int, side int, decided boolean, often boolean, around binary")
    around = scratch.put(around)
    compare = whole_groups(lambda x: _compare(x, least), "grp")
    close = around.where("not often").repartition("grp").sortWithinPartitions("grp").mapInPandas(compare, "digest binary, low int, high int")
    frequent = _counted_strings(around.where("often"), least, scratch)
    return scratch.put(sure.unionByName(close).unionByName(frequent).groupBy("digest").agg(F.collect_list(F.struct("low", "high")).alias("spans")))


def union_spans(spans: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    """Maximal runs covered by the spans, within n bytes."""
    out: list[list[int]] = []
    for low, high in sorted(spans):
        high = min(high, n)
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return [(a, b) for a, b in out]


def _cut_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        kept, runs = [], []
        for text, spans in zip(batch["text"], batch["spans"]):
            raw = text.encode("utf-8", "surrogatepass")
            own = union_spans([(x["low"], x["high"]) for x in spans], len(raw))
            at, parts = 0, []
            for a, b in own:
                parts.append(raw[at:a])
                at = b
            kept.append(b"".join([*parts, raw[at:]]))
            runs.append([{"low": a, "high": b} for a, b in own])
        yield pd.DataFrame({"digest": batch["digest"], "runs": runs, "kept": kept})


def remove_repeats(docs: DataFrame, scratch: Scratch, least: int = LEAST, doc_id: str = "doc_id", text: str = "text", **sizes: int) -> tuple[DataFrame, DataFrame]:
    """(per document: doc_id, digest, n_bytes, copies, text_sha256; per changed text: digest, runs, kept binary).

    A text that occurs more than once (copies > 1) and has ``least`` bytes goes entirely. ``sizes`` go to ``repeated_spans``.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    own = own.select("doc_id", "text", F.unhex(F.md5("text")).alias("digest"))
    spans = repeated_spans(own, scratch, least, **sizes)
    changed = texts_of(own, spans).mapInPandas(_cut_out, "digest binary, runs array<struct<low:int,high:int>>, kept binary")
    rows = own.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("text_sha256"))
    copies = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"))
    return rows.join(copies, "digest"), changed


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark) as scratch:
        rows, changed = remove_repeats(table(spark, sf_dir, "documents"), scratch)
        done = changed.select(
            "digest",
            F.aggregate("runs", F.lit(0).cast("long"), lambda n, x: n + x["high"] - x["low"]).alias("removed"),
            F.size("runs").cast("long").alias("spans"),
            F.sha2("kept", 256).alias("kept"),
        )
        whole = (F.col("copies") > 1) & (F.col("n_bytes") >= LEAST)
        out = rows.join(done, "digest", "left").select(
            "doc_id",
            "n_bytes",
            F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0).cast("long"))).alias("n_removed"),
            F.when(whole, F.lit(1).cast("long")).otherwise(F.coalesce("spans", F.lit(0).cast("long"))).alias("n_spans"),
            F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept", "text_sha256")).alias("kept_sha256"),
        )
        return scratch.keep(out)


def brute_force(texts: list[bytes], least: int = LEAST) -> list[list[tuple[int, int]]]:
    """Removed runs of each text, by counting all strings (for tests)."""
    count: dict[bytes, int] = {}
    for x in texts:
        for i in range(len(x) - least + 1):
            count[x[i : i + least]] = count.get(x[i : i + least], 0) + 1
    return [union_spans([(i, i + least) for i in range(len(x) - least + 1) if count[x[i : i + least]] > 1], len(x)) for x in texts]
