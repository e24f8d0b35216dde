"""Removal of repeated passages by suffix arrays (operator 2).

A string of ``length`` bytes belongs to its minimizer: the place of the smallest hash
of its ``GRAM``-byte parts. Equal strings have it at the same offset, so all places of
a repeated string meet under one anchor hash. The strings of one anchor stand side by
side and make up its context. Contexts are counted first: those that occur more than
once are repeated as a whole, in however many documents. Where contexts of one anchor
differ, their strings are cut into blocks by offset from the anchor; all strings of a
block hold the block's core, so a core that no other context has ends the matter.
What is left are blocks of equal cores with different edges. There the core is one
symbol, and suffixes over edges and core are sorted.

Suffixes are sorted in two stages: those smaller than their successors directly,
by ranks of the pieces between them; the others are induced by one scan over the buckets
of first bytes. Common prefixes of neighbours then show which strings repeat.

The blocks of a core that has more than HOT different ones are halved: the strings of a half share the core
and the bytes next to it on one side, which make up a longer core. Halves are counted and sorted as
blocks were, and halved again where a core still has too many; at one string a block the core is the string.

Digests only bring equal bytes together. Contexts are named by 128 bits (``h`` and ``c``), cores by 128 bits, and blocks of one
core by 64 bits more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dendrospark.llm.common import clearing, mapped, small, table, written

LENGTH, GRAM = 400, 32
HOT, BLOCK = 10_000, 46
#: Symbols that one suffix array takes at least, and bytes of one round of hashing.
SORT_SYMBOLS, HASH_BYTES = 1_000_000, 1 << 19
#: Symbols: 0 between strings, bytes from 1 on, and the core's mark.
CORE = 257

_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


# --- anchors -----------------------------------------------------------------------------


def _hashes(buf: np.ndarray) -> np.ndarray:
    """A hash, over zero, of the GRAM bytes from each place."""
    n = len(buf) - GRAM + 1
    w = np.ndarray((len(buf) - 7,), dtype="<u8", buffer=buf, strides=(1,)) * _C[0]
    w ^= w >> np.uint64(31)
    h = np.zeros(n, dtype=np.uint64)
    for i, c in enumerate(_C[1:]):
        h += w[8 * i : 8 * i + n] * c
    h ^= h >> np.uint64(29)
    h *= _C[4]
    h ^= h >> np.uint64(32)
    return h | np.uint64(1)


def _sliding(x: np.ndarray, w: int, best: np.ufunc, fill: int) -> np.ndarray:
    """``best`` of each ``w`` neighbours, from each place on."""
    n = len(x)
    rows = -(-n // w) + 1
    padded = np.full(rows * w, fill, dtype=x.dtype)
    padded[:n] = x
    grid = padded.reshape(rows, w)
    ahead = best.accumulate(grid, axis=1).ravel()
    behind = best.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(behind[: n - w + 1], ahead[w - 1 : n])


def minimizers(parts: list[bytes], length: int) -> Iterator[tuple[int, np.ndarray]]:
    """Of each part: its number, and rows of anchor, its hash, and the first and last string that belong to it."""
    buf = np.frombuffer(b"".join(parts), dtype=np.uint8)
    ends = np.cumsum([len(p) for p in parts])
    starts = ends - [len(p) for p in parts]
    h = _hashes(buf)
    low = _sliding(h, length - GRAM + 1, np.minimum, 0)  # of the string from each place
    part = np.searchsorted(ends, np.arange(len(low)), side="right")
    good = np.arange(len(low)) + length <= ends[part]
    edge = np.ones(len(low), dtype=bool)
    edge[1:] = (low[1:] != low[:-1]) | (part[1:] != part[:-1])
    first = np.flatnonzero(edge & good)
    bound = np.flatnonzero(edge | ~good)
    after = np.searchsorted(bound, first, side="right")
    last = np.where(after < len(bound), np.append(bound, len(low))[after], len(low)) - 1
    # the place of a run's smallest hash: the first not before the run's first string; when strings pass it, the next
    value = low[first]
    pad = np.zeros(length - GRAM, dtype=np.uint64)
    top = _sliding(np.concatenate([pad, np.where(good, low, np.uint64(0)), pad]), length - GRAM + 1, np.maximum, 0)
    places = np.flatnonzero(top == h)  # smallest in some string
    rank = np.unique(h[places], return_inverse=True)
    order = np.lexsort((places, rank[1]))
    keys, sorted_places = rank[1][order] * len(buf) + places[order], places[order]
    own = np.searchsorted(rank[0], value) * len(buf)
    out = []
    while len(first):
        at = sorted_places[np.searchsorted(keys, own + first)]
        stop = np.minimum(last, at)
        out.append(np.stack([at, value.view(np.int64), first, stop]))
        more = last > at
        first, last, value, own = at[more] + 1, last[more], value[more], own[more]
    rows = np.concatenate(out, axis=1) if out else np.zeros((4, 0), dtype=np.int64)
    rows = rows[:, np.argsort(rows[2], kind="stable")]
    whose = part[rows[2]] if rows.shape[1] else rows[2]
    for i, mine in zip(*_groups(whose)):
        got = rows[:, mine].copy()
        got[[0, 2, 3]] -= starts[i]
        yield int(i), got


def _groups(sorted_keys: np.ndarray) -> tuple[np.ndarray, list[slice]]:
    cut = np.append(0, np.flatnonzero(np.diff(sorted_keys)) + 1)
    if not len(sorted_keys):
        return sorted_keys, []
    return sorted_keys[cut], [slice(a, b) for a, b in zip(cut, np.append(cut[1:], len(sorted_keys)))]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def anchors(texts: DataFrame, length: int) -> DataFrame:
    """Per anchor of each text: its hash ``h``, hash ``c`` of its context, and ``at``: its first string, with
    the steps from there to the anchor and to its last string in higher bits."""
    from xxhash import xxh3_64_intdigest

    names = ["h", "c", "t", "at"]
    step = HASH_BYTES

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            held, size = [], 0
            for t, text in zip(pdf["t"], pdf["text"]):
                raw = (text or "").encode("utf-8", "surrogatepass")
                for a in range(0, len(raw) - length + 1, step):  # parts of a long text, each string in one of them
                    held.append((t, raw, a, raw[a : a + step + length - 1]))
                    size += len(held[-1][3])
                    if size >= step:
                        yield found(held)
                        held, size = [], 0
            if held:
                yield found(held)

    def found(held: list[tuple[bytes, bytes, int, bytes]]) -> pd.DataFrame:
        cols: dict[str, list] = {n: [] for n in names}
        for i, rows in minimizers([x[3] for x in held], length):
            t, raw, a, _ = held[i]
            pos, h, low, high = rows[0] + a, rows[1], rows[2] + a, rows[3] + a
            c = [xxh3_64_intdigest(raw[b : e + length], p - b) for p, b, e in zip(pos.tolist(), low.tolist(), high.tolist())]
            for n, v in zip(names, (h, np.array(c, dtype=np.uint64).view(np.int64), [t] * len(pos), low + (pos - low << 32) + (high - low << 44))):
                cols[n].append(v)
        return pd.DataFrame({n: [t for x in v for t in x] if n == "t" else np.concatenate(v) for n, v in cols.items()})

    return mapped(texts.select("t", "text"), run, "h long, c long, t binary, at long")


# --- suffix arrays -----------------------------------------------------------------------


def _dense(x: np.ndarray) -> np.ndarray:
    return np.unique(x, return_inverse=True)[1]


def _sorted_small(text: np.ndarray, small: np.ndarray, depth: int) -> np.ndarray:
    """The places of suffixes smaller than their successors, sorted by ``depth`` bytes at least.

    Each is its piece up to the next such place, then that place's suffix. Pieces,
    with each byte's type, are not prefixes of one another, so ranks of pieces can be doubled.
    """
    at = np.flatnonzero(small)
    n = len(at)
    if not n:
        return at
    ends = np.append(at[1:], len(text) - 1)
    size = ends - at + 1
    sign = 2 * text.astype(np.int64) + small + 1
    sign = np.append(sign, np.zeros(8, dtype=np.int64))
    rank = np.zeros(n, dtype=np.int64)
    for from_ in range(0, int(size.max()), 6):
        far = np.flatnonzero(size > from_)
        word = np.zeros(len(far), dtype=np.int64)
        for j in range(from_, from_ + 6):
            place = np.minimum(at[far] + j, len(text))
            word = (word << 10) | np.where(j < size[far], sign[place], 0)
        part = np.zeros(n, dtype=np.int64)
        part[far] = _dense(word) + 1
        rank = _dense(rank * (n + 2) + part)
    hops = 1
    while hops < n and int(rank.max()) + 1 < n and hops < depth:
        after = np.zeros(n, dtype=np.int64)
        after[:-hops] = rank[hops:] + 1
        rank = _dense(rank * (n + 2) + after)
        hops *= 2
    return at[np.argsort(rank, kind="stable")]


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``text`` (numbers up to CORE) in order, by ``depth`` bytes at least."""
    n = len(text)
    t = text.astype(np.int64)
    rise = np.sign(np.diff(t))
    last = np.where(rise != 0, np.arange(n - 1), n)  # an equal byte has its successor's type
    last = np.minimum.accumulate(last[::-1])[::-1] if n > 1 else last
    small = np.zeros(n, dtype=bool)
    known = last < n
    small[:-1][known] = rise[last[known]] > 0
    direct = _sorted_small(text, small, depth)
    first = t[direct]
    cut = np.searchsorted(first, np.arange(CORE + 2))
    induced: list[list[np.ndarray]] = [[] for _ in range(CORE + 1)]
    induced[t[-1]].append(np.array([n - 1]))
    out = []

    def spread(scanned: np.ndarray, c: int) -> np.ndarray:
        """Put the larger predecessors into their buckets; those of this bucket are returned."""
        before = scanned[scanned > 0] - 1
        before = before[~small[before]]
        heads = t[before]
        here = before[heads == c]
        others, heads = before[heads != c], heads[heads != c]
        if len(others):
            order = np.argsort(heads, kind="stable")
            others, heads = others[order], heads[order]
            edges = np.flatnonzero(np.diff(heads)) + 1
            for part, head in zip(np.split(others, edges), heads[np.append(0, edges)].tolist()):
                induced[head].append(part)
        return here

    for c in range(CORE + 1):
        now = np.concatenate(induced[c]) if induced[c] else np.zeros(0, dtype=np.int64)
        while len(now):
            out.append(now)
            now = spread(now, c)
        own = direct[cut[c] : cut[c + 1]]
        if len(own):
            out.append(own)
            spread(own, c)
    return np.concatenate(out)


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Of each suffix in order, the bytes it shares with the one before, up to ``most`` or more.

    Read in text order, partners stay side by side over long runs: a run is compared once,
    and only its last place is compared byte by byte beyond it.
    """
    n = len(text)
    partner = np.full(n, -1)
    partner[order[1:]] = order[:-1]
    at = np.arange(n)
    same = (partner >= 0) & (text == text[partner])
    ends = np.ones(n, dtype=bool)
    ends[:-1] = (partner[1:] != partner[:-1] + 1) | (partner[:-1] < 0)
    reach = np.zeros(n, dtype=np.int64)
    todo = np.flatnonzero(ends & same)
    padded = np.append(text.astype(np.int16), np.full(most + 2, -1, dtype=np.int16))
    a, b = todo, partner[todo]
    for step in range(most):
        if not len(todo):
            break
        fits = (padded[a + step] == padded[b + step]) & (padded[a + step] >= 0)
        reach[todo[~fits]] = step
        todo, a, b = todo[fits], a[fits], b[fits]
    reach[todo] = most
    stop = np.where(~same | ends, at, n)
    stop = np.minimum.accumulate(stop[::-1])[::-1]
    shared = stop - at + reach[np.minimum(stop, n - 1)]
    return shared[order]


def repeated(strings: list[np.ndarray], gid: list[int], many: list[bool], length: int) -> list[np.ndarray]:
    """Of each string of symbols, the offsets of parts of ``length`` symbols that start elsewhere too.

    ``gid``: number of the string's first place over all texts. ``many``: the string as a whole
    is known to occur more than once.
    """
    size = np.array([len(c) for c in strings])
    ends = np.cumsum(size + 1) - 1
    text = np.zeros(int(ends[-1]) + 1, dtype=np.int16)
    inside = np.ones(len(text), dtype=bool)
    inside[ends] = False
    text[inside] = np.concatenate(strings)
    order = suffix_array(text, length)
    shared = common_prefixes(text, order, length)
    own = np.searchsorted(ends, order, side="left")
    offset = order - (ends[own] - size[own])
    whole = size[own] - offset >= length
    block = np.cumsum(~(shared >= length))  # neighbours that share `length` bytes are one block
    block, own, offset = block[whole], own[whole], offset[whole]
    if not len(block):
        return [np.zeros(0, dtype=np.int64) for _ in strings]
    place = np.array(gid)[own] + offset
    first = np.append(0, np.flatnonzero(np.diff(block)) + 1)
    twice = np.minimum.reduceat(place, first) != np.maximum.reduceat(place, first)
    twice |= np.maximum.reduceat(np.array(many)[own].astype(np.int8), first) > 0
    hit = np.repeat(twice, np.diff(np.append(first, len(block))))
    own, offset = own[hit], offset[hit]
    sort = np.lexsort((offset, own))
    own, offset = own[sort], offset[sort]
    return np.split(offset, np.searchsorted(own, np.arange(1, len(strings))))


def runs(offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted offsets of strings as the runs of bytes they cover."""
    if not len(offsets):
        return offsets, offsets
    cut = np.flatnonzero(np.diff(offsets) > length) + 1
    return offsets[np.append(0, cut)], offsets[np.append(cut - 1, len(offsets) - 1)] + length


# --- the job ------------------------------------------------------------------------------


def _low(at: int) -> int:
    return at & 0xFFFFFFFF


_SCHEMA = "core binary, own long, t binary, low int, width int, shift int, n int, edge binary"
_NAMES = [x.split()[0] for x in _SCHEMA.split(", ")]


def _blocks(candidates: DataFrame, length: int) -> DataFrame:
    """The blocks of contexts that occur once, and of one of each that occurs more often.

    ``core`` and ``own``: digests of the bytes that all strings of the block hold, and of all bytes of its
    strings. ``edge``: the bytes before and after the core, ``BLOCK - 1 - shift`` of them before. ``n``: 1 if the
    context occurs once, else 2.
    """
    from xxhash import xxh3_64_intdigest, xxh3_128_digest

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for t, text, occ in zip(pdf["t"], pdf["text"], pdf["occ"]):
                raw = text.encode("utf-8", "surrogatepass")
                for o in occ:
                    if not (o["once"] or o["sample"]):
                        continue
                    at = o["at"]
                    begin = _low(at)
                    end = begin + (at >> 44)
                    origin = begin + (at >> 32 & 0xFFF) - (length - GRAM)  # of the offsets' grid
                    for block in range((begin - origin) // BLOCK, (end - origin) // BLOCK + 1):
                        first = origin + block * BLOCK  # the block's first string and last,
                        last = first + BLOCK - 1
                        low, high = max(begin, first), min(end, last)  # and those that are this anchor's
                        core = xxh3_128_digest(raw[last : first + length], block)
                        own = xxh3_64_intdigest(raw[low : high + length], low - first)
                        edge = raw[low:last] + raw[first + length : high + length]
                        out.append((core, _signed(own), t, low, high - low, low - first, 1 if o["once"] else 2, edge))
                if len(out) > 5000:
                    yield pd.DataFrame(out, columns=_NAMES)
                    out = []
            yield pd.DataFrame(out, columns=_NAMES)

    return mapped(candidates.select("t", "text", "occ"), run, _SCHEMA)


def _halves(blocks: DataFrame, width: int) -> DataFrame:
    """Each block of ``width`` offsets as two of half as many, rounded up, with the longer cores that these have."""
    from xxhash import xxh3_64_intdigest, xxh3_128_digest

    half = (width + 1) // 2
    rest = width - half

    def block(core: bytes, more: bytes, t: bytes, low: int, width: int, shift: int, n: int, edge: bytes) -> tuple:
        return xxh3_128_digest(core + more), _signed(xxh3_64_intdigest(edge, shift)), t, low, width, shift, n, edge

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for core, t, low, more, shift, n, edge in pdf[["core", "t", "low", "width", "shift", "n", "edge"]].itertuples(index=False):
                before, after = edge[: width - 1 - shift], edge[width - 1 - shift :]
                if shift < half:  # strings that hold the bytes before the core
                    high, cut = min(shift + more, half - 1), half - 1 - shift
                    out.append(block(core, b"<" + before[cut:], t, low, high - shift, shift, n, before[:cut] + after[:high]))
                if shift + more >= half:  # strings that hold the bytes after it
                    first = max(shift, half)
                    out.append(block(core, b">" + after[:rest], t, low + first - shift, shift + more - first, first - rest, n, before[first - shift :] + after[rest:]))
            yield pd.DataFrame(out, columns=_NAMES)

    return mapped(blocks.select("core", "t", "low", "width", "shift", "n", "edge"), run, _SCHEMA)


def _sorted_repeats(blocks: DataFrame, length: int, width: int) -> DataFrame:
    """Runs (t, a, b) that repeat, by suffix arrays over whole cores' blocks of ``width`` offsets. ``n``: how many blocks are the same."""
    part = width + 17  # symbols of a string whose core is a mark and sixteen bytes of its digest, and the 0 after it

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0
        for pdf in batches:
            core = pdf["core"].to_numpy()
            cut = np.append(np.flatnonzero(core[1:] != core[:-1]) + 1, len(pdf))
            low = 0
            for high in cut.tolist():
                rows = pdf.iloc[low:high]
                if size >= SORT_SYMBOLS and held[-1]["core"].iloc[-1] != rows["core"].iloc[0]:
                    yield solved(pd.concat(held))
                    held, size = [], 0
                held.append(rows)
                size += len(rows) * (part + width)
                low = high
        if held:
            yield solved(pd.concat(held))

    def solved(pdf: pd.DataFrame) -> pd.DataFrame:
        number = {t: i for i, t in enumerate(dict.fromkeys(pdf["t"]))}
        gid = [(number[t] << 32) + a for t, a in zip(pdf["t"], pdf["low"])]
        once = (pdf["n"] == 1).tolist()
        marks = np.concatenate([np.full((len(pdf), 1), CORE, dtype=np.int16), np.frombuffer(b"".join(pdf["core"]), dtype=np.uint8).reshape(-1, 16).astype(np.int16) + 1], axis=1)
        strings = []
        for edge, shift, mark in zip(pdf["edge"], pdf["shift"], marks):
            cut = width - 1 - shift
            e = np.frombuffer(edge, dtype=np.uint8).astype(np.int16) + 1
            strings.append(np.concatenate([e[:cut], mark, e[cut:]]))
        out = []
        for t, a, own, x in zip(pdf["t"], pdf["low"], once, repeated(strings, gid, [not x for x in once], part - 1)):
            if own and len(x):
                low, high = runs(x, length)
                out += [(t, a + int(p), a + int(q)) for p, q in zip(low, high)]
        return pd.DataFrame(out, columns=["t", "a", "b"])

    return mapped(blocks.repartition("core").sortWithinPartitions("core"), run, "t binary, a int, b int")


def _candidates(keyed: DataFrame, length: int) -> DataFrame:
    """Texts with repeated anchors, each once, and those anchors: ``once`` where no other context is the same,
    ``sample`` on one of equal contexts whose anchor has others."""
    found = written(anchors(keyed, length), "anchors", "zstd")
    again = written(found.groupBy("h").agg(F.count("*").alias("all")).where("all > 1"), "repeated-anchors")
    shared = written(found.join(small(again), "h"), "anchors-met-again", "zstd")
    each = shared.groupBy("h", "c").agg(F.count("*").alias("n"), F.max(F.xxhash64("t")).alias("pick"), F.max("all").alias("all"))
    known = each.select("h", "c", "pick", (F.col("n") == 1).alias("once"), (F.col("all") > F.col("n")).alias("others"))
    known = written(known, "contexts-met-again", "zstd")  # a table of its own, so that the join can split a hot context
    occ = shared.drop("all").join(known, ["h", "c"]).select("t", "at", "once", (F.col("others") & (F.xxhash64("t") == F.col("pick"))).alias("sample"))
    need = written(occ.distinct().groupBy("t").agg(F.collect_list(F.struct("at", "once", "sample")).alias("occ")), "texts-met-again", "zstd")
    one = keyed.groupBy("t").agg(F.max("k").alias("k"))
    need = written(need.join(one, "t"), "texts-met-again", "zstd")
    few = keyed.join(small(need.select("t", "k")), ["t", "k"], "left_semi")  # texts that don't matter stay where they are
    return written(few.join(need, ["t", "k"]).select("t", "text", "occ"), "repeat-candidates", "zstd")


def _open_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks whose core another has: ``all`` blocks are the same, ``m`` different ones share the core."""
    owns = blocks.groupBy("core", "own").agg(F.sum("n").alias("all"), F.max(F.xxhash64("t")).alias("pick"))
    cores = owns.groupBy("core").agg(F.count("*").alias("m"), F.sum("all").alias("any")).where("any > 1").drop("any")
    open_ = owns.join(cores, "core").select("core", "own", "all", "m", "pick")
    return written(blocks.join(open_, ["core", "own"]).drop("own"), "open-blocks", "zstd")


def _partly(candidates: DataFrame, length: int) -> DataFrame:
    """Runs (t, a, b) that repeat in contexts that don't as a whole. Cores with too many blocks are halved until none is left."""
    found, width = [], BLOCK
    blocks = written(_blocks(candidates, length), "blocks", "zstd")
    while True:
        live = _open_blocks(blocks)
        found.append(live.where("n = 1 AND all > 1").select("t", F.col("low").alias("a"), (F.col("low") + F.col("width") + length).alias("b")))
        unlike = live.where(F.col("m") > 1).where((F.col("all") == 1) | (F.xxhash64("t") == F.col("pick"))).withColumn("n", F.least("all", F.lit(2)).cast("int"))
        found.append(_sorted_repeats(unlike.where(F.col("m") <= HOT), length, width))
        if width == 1 or live.where(F.col("m") > HOT).isEmpty():
            return reduce(DataFrame.unionByName, found)
        blocks = written(_halves(unlike.where(F.col("m") > HOT), width), "half-blocks", "zstd")
        width = (width + 1) // 2


def repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Texts (t: the first half of their sha256, text) with repeated strings, and their runs (a, b).

    Runs may overlap and touch. ``length`` may be from 2 * BLOCK to 4000.
    """
    if not 2 * BLOCK <= length <= 4000:
        raise ValueError(f"length must be from {2 * BLOCK} to 4000")
    keyed = docs.select(
        F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("doc_id").alias("k")
    ).withColumn("t", F.unhex(F.substring(F.sha2("text", 256), 1, 32)))
    candidates = _candidates(keyed, length)
    partly = _partly(candidates, length)
    partly = written(partly.groupBy("t").agg(F.collect_list(F.struct("a", "b")).alias("partly")), "partly-repeated", "zstd")
    low = lambda o: o["at"].bitwiseAND(0xFFFFFFFF).cast("int")
    end = lambda o: (low(o) + F.shiftright(o["at"], 44) + length).cast("int")
    fully = F.transform(F.filter("occ", lambda o: ~o["once"]), lambda o: F.struct(low(o).alias("a"), end(o).alias("b")))
    return candidates.select("t", "text", fully.alias("fully")).join(small(partly, F.size("partly")), "t", "left").select(
        "t", "text", F.concat("fully", F.coalesce("partly", F.array().cast("array<struct<a:int,b:int>>"))).alias("runs")
    ).where(F.size("runs") > 0)


def whole_words(raw: bytes, a: int, b: int) -> int:
    """The words that stand in raw[a:b] from their first byte to their last."""
    part = raw[a:b]
    first = a > 0 and not raw[a - 1 : a].isspace() and not part[:1].isspace()
    last = b < len(raw) and not raw[b : b + 1].isspace() and not part[-1:].isspace()
    return len(part.split()) - first - last


def removed(found: DataFrame, words: int = 0) -> DataFrame:
    """Per text of ``repeats``: n_removed, n_spans, kept_sha256 and the text kept, without characters cut in half.

    ``words``: runs that hold fewer whole words stay; texts that lose nothing aren't returned.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for t, text, spans in zip(pdf["t"], pdf["text"], pdf["runs"]):
                raw = text.encode("utf-8", "surrogatepass")
                whole: list[list[int]] = []
                for a, b in sorted((r["a"], r["b"]) for r in spans):
                    if whole and a <= whole[-1][1]:
                        whole[-1][1] = max(whole[-1][1], b)
                    else:
                        whole.append([a, b])
                if words:
                    whole = [x for x in whole if whole_words(raw, *x) >= words]
                if not whole:
                    continue
                n, gone = len(whole), sum(b - a for a, b in whole)
                kept = [raw[a:b] for a, b in zip([0, *(b for _, b in whole)], [*(a for a, _ in whole), len(raw)])]
                rest = b"".join(kept)
                out.append((t, gone, n, hashlib.sha256(rest).hexdigest(), b" ".join(kept).decode("utf-8", "ignore").strip()))
            yield pd.DataFrame(out, columns=["t", "n_removed", "n_spans", "kept_sha256", "kept"])

    return mapped(found, run, "t binary, n_removed long, n_spans long, kept_sha256 string, kept string")


ADDED = ("n_removed", "n_spans", "kept_sha256", "kept")


def _made(docs: DataFrame, length: int, added: tuple[str, ...], words: int = 0) -> DataFrame:
    """What is removed and kept of each text that loses something, one row a text."""
    with clearing(docs.sparkSession):
        made = written(removed(repeats(docs, length), words).select("t", *added), "removed", "zstd", keep=True)
    once = made.count() == made.select("t").distinct().count()
    return made if once else made.dropDuplicates(["t"])  # repeated rows gave a text more than once


def replaced(docs: DataFrame, length: int = LENGTH, words: int = 0) -> DataFrame:
    """``docs`` with the text kept in place of each text that loses something, and ``changed``.

    As ``deduplicated``; runs of fewer than ``words`` whole words stay. Texts that stay are not moved, and of the others only what is kept. Clashing columns
    named t or changed are replaced.
    """
    made = _made(docs, length, ("kept",), words)
    rows = docs.drop("t", "changed").withColumn("t", F.unhex(F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 32)))
    ids = small(made.select("t"))
    stay = rows.join(ids, "t", "left_anti").withColumn("changed", F.lit(False))
    new = rows.join(ids, "t", "left_semi").drop("text").join(made.withColumnRenamed("kept", "text"), "t").withColumn("changed", F.lit(True))
    return stay.unionByName(new).drop("t")


def deduplicated(docs: DataFrame, length: int = LENGTH, added: tuple[str, ...] = ADDED) -> DataFrame:
    """``docs`` (doc_id, text, ...) with n_bytes and, of each text, what is removed and kept.

    Every byte in a string of ``length`` bytes that starts anywhere else too, in any row, goes; strings
    are judged on the input. ``kept`` is the text left, a space between its parts, without characters cut in half
    (the digest is of the bytes left, joined). Null text is empty; texts shorter than
    ``length`` stay as they are; repeated rows lose all that they hold if it is long enough. Clashing
    columns of ``docs`` are replaced.
    """
    made = _made(docs, length, added)
    text = F.coalesce("text", F.lit(""))
    rows = docs.drop("n_bytes", "_sha", "t", *ADDED).withColumns({"n_bytes": F.octet_length(text).cast("long"), "_sha": F.sha2(text, 256)})
    rows = rows.withColumn("t", F.unhex(F.substring("_sha", 1, 32))).join(made, "t", "left").drop("t")
    zero = F.lit(0).cast("long")
    other = {"n_removed": zero, "n_spans": zero, "kept_sha256": F.col("_sha"), "kept": F.col("text")}
    return rows.withColumns({c: F.coalesce(F.col(c), other[c]) for c in added}).drop("_sha")


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All whole texts, strings of 400 bytes. A null text is the empty one, repeated rows repeat each other's bytes; more as ``deduplicated`` says."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return deduplicated(docs, added=ADDED[:3]).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


QUERIES = {"op2_suffix_array_dedup": op2_suffix_array_dedup}
ORACLE: dict[str, str] = {}
