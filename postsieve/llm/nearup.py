"""Near-duplicate records with small edits.

Circulant MinHash: one permutation scrambles the shingle universe, a second one,
circularly shifted by k, gives the k-th signature coordinate, so all coordinates
come from two permutations. Both are bijections of the 32-bit integers, so the
universe is never tabulated. Signatures are cut into bands; records that share
a band are candidates, and each candidate is verified by exact Jaccard similarity
of its shingle sets.

Records with the same set of shingles form one class first, so exact copies are
never paired with each other; the class is told by 128 bits and named by its smallest
id. Pairs are searched between classes and expanded to rows only at the end
(``near_pairs``), kept as class links (``near_classes``) or joined into connected
components (``near_groups``).

Recall: with BANDS bands of ROWS coordinates a pair of similarity s is missed
with probability (1 - s**ROWS)**BANDS, that is 1.2 % at s = 0.6, 0.2 % at 0.65 and 0.02 % at 0.7.

Scale: texts are shingled once; the table of their classes, sketches and band keys
is checkpointed, and a text met again in a task leaves no keys. What is shuffled per
band is a 48-bit key and half of the class hash (a chance collision of halves makes
a candidate, no class). Candidates are cut by a 128-bit sketch of the signature
before any text is moved; the text of a class of a likely pair moves once, and one
of the two once more per pair to meet the other.

Defined cases: null texts and texts of fewer than MIN_WORDS words take no part
(in ``near_groups`` each is a group of its own), nor do rows without an id;
extra columns are ignored; repeated ids count once; an empty input gives an
empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

BANDS, ROWS = 32, 4
KEY_BITS = 48  # of a band key; a chance collision costs one verification
SHINGLE_BITS = 44  # of a shingle; a batch may hold 2**20 records
SKETCH, SIGMAS = 128, 3.5  # bits of a sketch, tolerance of its filter
MIN_WORDS = 20
SHINGLE = 3
THRESHOLD = 0.6
MAX_BATCH_CELLS = 4_000_000  # signature cells computed at once, bounds the memory of a batch

#: Multipliers and shifts of a 32-bit finaliser (a bijection) and of a 64-bit mixer.
_M32 = (np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35))
_M64 = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_SCRAMBLE = np.uint32(0x9E3779B9)

_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def permute(x: np.ndarray) -> np.ndarray:
    """The shifted permutation: a bijection of the 32-bit integers."""
    x = x ^ (x >> np.uint32(16))
    x = x * _M32[0]
    x ^= x >> np.uint32(13)
    x *= _M32[1]
    x ^= x >> np.uint32(16)
    return x


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M64[0]
    x = (x ^ (x >> np.uint64(27))) * _M64[1]
    return x ^ (x >> np.uint64(31))


def signatures(shingles: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """(records, k) coordinates; ``shingles`` are the 64-bit shingles of all records, each record a run from ``starts``."""
    scrambled = permute((shingles >> np.uint64(32)).astype(np.uint32) ^ _SCRAMBLE)  # first permutation
    out = np.empty((len(starts), k), dtype=np.uint32)
    step = np.uint32(0x3C6EF372)  # the shift of one coordinate against the next on the circle of 2**32
    at = np.uint32(0)
    for j in range(k):
        out[:, j] = np.minimum.reduceat(permute(scrambled + at), starts)
        at = np.uint32((int(at) + int(step)) & 0xFFFFFFFF)
    return out


class _Hashes(dict):
    """64-bit hashes of words, each computed once."""

    def __missing__(self, word: str) -> int:
        import xxhash

        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


class Shingler:
    """Turns texts into runs of distinct shingles of SHINGLE_BITS bits; words are hashed once per worker."""

    def __init__(self, size: int = SHINGLE, min_words: int = MIN_WORDS, memo: int = 500_000):
        self.size, self.min_words, self.memo = size, min_words, memo
        self.known = _Hashes()

    def runs(self, texts: list[str | None]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """(positions that take part, shingles of all of them, start of each run)."""
        if len(self.known) > self.memo:
            self.known.clear()
        kept, flat, counts, hash_of = [], [], [], self.known.__getitem__
        least = max(self.min_words, self.size)
        for i, t in enumerate(texts):
            if not t:
                continue
            w = words_of(t)
            if len(w) < least:
                continue
            kept.append(i)
            counts.append(len(w))
            flat.extend(map(hash_of, w))
        if not kept:
            return [], np.empty(0, np.uint64), np.empty(0, np.int64)
        h = np.array(flat, dtype=np.uint64)
        counts = np.array(counts)
        mixed = h.copy()
        for j in range(1, self.size):
            nxt = np.zeros_like(h)
            nxt[:-j] = h[j:]
            mixed = mix64(mixed * np.uint64(3) + np.uint64(j)) ^ nxt
        mixed = mix64(mixed)
        # the last size - 1 words of a record start no shingle
        ends = np.cumsum(counts)
        valid = np.ones(len(h), dtype=bool)
        for j in range(1, self.size):
            valid[ends - j] = False
        owner = np.repeat(np.arange(len(kept), dtype=np.uint64), counts)[valid]
        # one sort by record and shingle: the record fills the bits above SHINGLE_BITS
        low = np.uint64(SHINGLE_BITS)
        keyed = np.sort(owner << low | mixed[valid] >> np.uint64(64 - SHINGLE_BITS))
        keyed = keyed[np.r_[True, keyed[1:] != keyed[:-1]]]
        owner = keyed >> low
        return kept, mix64(keyed & np.uint64((1 << SHINGLE_BITS) - 1)), np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])


def fold(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One 64-bit hash of each run of distinct values in a fixed order."""
    pos = np.arange(len(values), dtype=np.uint64) - np.repeat(starts, np.diff(np.r_[starts, len(values)])).astype(np.uint64)
    return np.bitwise_xor.reduceat(mix64(values + pos * np.uint64(0x9E3779B97F4A7C15)), starts)


def _groups(starts: np.ndarray, total: int) -> Iterator[tuple[int, int, int, int]]:
    """Cuts runs into groups (lo, hi, first value, end) of about MAX_BATCH_CELLS values."""
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + MAX_BATCH_CELLS)))
        yield lo, hi, int(starts[lo]), int(starts[hi]) if hi < len(starts) else total
        lo = hi


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(records, bands) keys of KEY_BITS bits; the number of the band is part of the key."""
    sig = sig.astype(np.uint64)
    keys = np.empty((len(sig), bands), dtype=np.uint64)
    for j in range(bands):
        k = np.full(len(sig), j + 1, dtype=np.uint64)
        for r in range(rows):
            k = mix64(k * np.uint64(0x9E3779B97F4A7C15) + sig[:, j * rows + r])
        keys[:, j] = k >> np.uint64(64 - KEY_BITS)
    return keys


def sketches(sig: np.ndarray) -> np.ndarray:
    """(records, SKETCH / 64) words that hold the lowest bit of each of the first SKETCH coordinates."""
    bits = (sig[:, :SKETCH] & np.uint32(1)).astype(np.uint8)
    return np.packbits(bits, axis=1).view(np.uint64)


MAX_SEEN = 1_000_000  # class hashes a task remembers; beyond it a repeated text leaves its keys again


def prepare(rows: DataFrame, extra: list[str], bands: int = BANDS, per_band: int = ROWS) -> DataFrame:
    """(id, h1, h2, s1, s2, keys, extra...) of each text long enough: the hash of its shingle set in two halves, its sketch and band keys.

    Sketch and keys are null for a text whose class the task has met before.
    """

    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, seen = Shingler(), set()
        for b in batches:
            kept, sh, starts = s.runs(b.column(1).to_pylist())
            if not kept:
                continue
            h1, h2 = fold(sh, starts), fold(mix64(sh ^ _M64[0]), starts)
            place: list[int | None] = []  # of each text among the new ones
            fresh = []
            if len(seen) > MAX_SEEN:
                seen.clear()
            for i, h in enumerate(h1.tolist()):
                if h in seen:
                    place.append(None)
                else:
                    seen.add(h)
                    place.append(len(fresh))
                    fresh.append(i)
            ends = np.r_[starts, len(sh)]
            own = np.concatenate([sh[ends[i] : ends[i + 1]] for i in fresh]) if fresh else sh[:0]
            sizes = np.array([ends[i + 1] - ends[i] for i in fresh], dtype=np.int64)
            begin = np.cumsum(sizes) - sizes
            sketch, keys = [np.empty((0, 2), np.uint64)], [np.empty((0, bands), np.uint64)]
            for lo, hi, f, e in _groups(begin, len(own)):
                sig = signatures(own[f:e], begin[lo:hi] - f, max(bands * per_band, SKETCH))
                sketch.append(sketches(sig))
                keys.append(band_keys(sig, bands, per_band))
            sk, at, of = np.concatenate(sketch).view(np.int64), pa.array(kept), pa.array(place, pa.int64())
            flat = pa.array(np.concatenate(keys).reshape(-1).view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(fresh) + 1, dtype=np.int32) * bands), flat)
            cols = [b.column(0).take(at), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), *(pa.array(np.ascontiguousarray(sk[:, k])).take(of) for k in (0, 1)), lists.take(of)]
            yield pa.RecordBatch.from_arrays([*cols, *(b.column(2 + i).take(at) for i in range(len(extra)))], ["id", "h1", "h2", "s1", "s2", "keys", *extra])

    kinds = dict(rows.dtypes)
    more = "".join(f", {c} {kinds[c]}" for c in extra)
    return rows.select("id", "text", *extra).where("id IS NOT NULL").mapInArrow(op, f"id {kinds['id']}, h1 bigint, h2 bigint, s1 bigint, s2 bigint, keys array<bigint>{more}")


def representatives(prepared: DataFrame) -> DataFrame:
    """(h1, h2, cls, s1, s2): one row per class, named by its smallest id."""
    return prepared.groupBy("h1", "h2").agg(F.min("id").alias("cls"), F.min("s1").alias("s1"), F.min("s2").alias("s2"))


def members(prepared: DataFrame, reps: DataFrame, extra: list[str]) -> DataFrame:
    """(id, cls, extra...): the class of each text; a hot class is split by AQE, its row is small."""
    return prepared.select("id", "h1", "h2", *extra).join(reps.select("h1", "h2", "cls"), ["h1", "h2"]).select("id", "cls", *extra)


def band_rows(prepared: DataFrame) -> DataFrame:
    """(band_key, half): one row per class and band, and task."""
    return prepared.where("keys IS NOT NULL").select(F.explode("keys").alias("band_key"), F.col("h1").alias("half"))


def near_candidates(bands: DataFrame) -> DataFrame:
    """Distinct (a, b) halves, a < b, that share a band.

    Most band keys belong to one class. A window over the one shuffle leaves only
    the others, which are written once and joined with each other.
    """
    w = Window.partitionBy("band_key")
    several = bands.withColumns({"lo": F.min("half").over(w), "hi": F.max("half").over(w)}).where("lo < hi")
    shared = cut_lineage(several.select("band_key", "half").distinct())
    l, r = shared.alias("l"), shared.alias("r")
    pairs = l.join(r, (F.col("l.band_key") == F.col("r.band_key")) & (F.col("l.half") < F.col("r.half")))
    return pairs.select(F.col("l.half").alias("a"), F.col("r.half").alias("b")).distinct()


def likely(cand: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """Pairs of classes (a, b) whose sketches do not differ more than similarity ``threshold`` allows.

    Each of the SKETCH bits differs with probability (1 - s) / 2; a pair at the
    threshold is dropped only beyond SIGMAS standard deviations.
    """
    p = (1 - threshold) / 2
    most = SKETCH * p + SIGMAS * (SKETCH * p * (1 - p)) ** 0.5
    side = lambda x: reps.select(F.col("h1").alias(x), F.col("cls").alias(f"c{x}"), F.col("s1").alias(f"{x}1"), F.col("s2").alias(f"{x}2"))
    j = cand.join(side("a"), "a").join(side("b"), "b")
    differ = F.bit_count(F.col("a1").bitwiseXOR(F.col("b1"))) + F.bit_count(F.col("a2").bitwiseXOR(F.col("b2")))
    return j.where(differ <= int(most)).select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b"))


def verify(pairs: DataFrame, rows: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) of the pairs of classes at or above the threshold, by the exact sets of their texts."""
    used = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    texts = rows.select("id", "text").join(used, "id", "left_semi").dropDuplicates(["id"])
    j = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("y")), "b")
    kind = dict(rows.dtypes)["id"]

    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def grams(t: str) -> set[tuple[str, ...]]:
            w = words_of(t)
            return set(zip(*(w[i:] for i in range(SHINGLE))))

        for b in batches:
            out = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                p, q = grams(x), grams(y)
                i = len(p & q)
                u = len(p) + len(q) - i
                out.append(i / u if i * 10_000 >= u * round(threshold * 10_000) else None)
            sim = pa.array(out, pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), sim], ["a", "b", "similarity"]).filter(sim.is_valid())

    return j.select("a", "b", "x", "y").mapInArrow(op, f"a {kind}, b {kind}, similarity double")


def class_links(rows: DataFrame, prepared: DataFrame, reps: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, similarity) of every pair of distinct classes at or above the threshold."""
    return verify(likely(near_candidates(band_rows(prepared)), reps, threshold), rows, threshold)


def near_pairs(rows: DataFrame, copy_of: Callable[[Column], Column], threshold: float = THRESHOLD) -> DataFrame:
    """(row_id_a, row_id_b), a < b: all pairs of rows (id, text) at or above the threshold that are no copies.

    ``copy_of`` gives the canonical text two copies have in common.
    """
    keyed = rows.select("id", "text", F.unhex(F.md5(copy_of(F.col("text")))).alias("copy"))
    prepared = cut_lineage(prepare(keyed, ["copy"]))
    reps = cut_lineage(representatives(prepared))
    links = class_links(rows, prepared, reps, threshold)
    classes = cut_lineage(members(prepared, reps, ["copy"]).distinct())
    # a unit is the rows of one class that are copies of each other: units are paired, then rows, so no pair of copies is ever made
    units = classes.select("cls", "copy").distinct()
    ua, ub = units.select(F.col("cls").alias("a"), F.col("copy").alias("ca")), units.select(F.col("cls").alias("b"), F.col("copy").alias("cb"))
    across = links.select("a", "b").join(ua, "a").join(ub, "b").where("ca <> cb")
    # texts of one class that are no copies (other emoji, say) have a similarity of 1
    several = units.groupBy("cls").agg(F.count("*").alias("n")).where("n > 1").select(F.col("cls").alias("a"), F.col("cls").alias("b"))
    within = several.join(ua, "a").join(ub, "b").where("ca < cb")
    pairs = across.unionByName(within)
    m = pairs.join(classes.select(F.col("cls").alias("a"), F.col("copy").alias("ca"), F.col("id").alias("i")), ["a", "ca"])
    m = m.join(classes.select(F.col("cls").alias("b"), F.col("copy").alias("cb"), F.col("id").alias("j")), ["b", "cb"])
    return m.select(F.least("i", "j").alias("row_id_a"), F.greatest("i", "j").alias("row_id_b"))


def _linked(classes: DataFrame, links: DataFrame) -> DataFrame:
    ends = links.select(F.col("a").alias("cls")).unionByName(links.select(F.col("b").alias("cls")))
    n = ends.groupBy("cls").agg(F.count("*").alias("n_links"))
    return classes.select("id", "cls").join(n, "cls", "left").select("id", "cls", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def near_classes(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(id, cls, n_links): one row per text long enough, its class and the number of other classes linked to it."""
    prepared = cut_lineage(prepare(rows.select("id", "text"), []))
    reps = cut_lineage(representatives(prepared))
    return _linked(members(prepared, reps, []).distinct(), class_links(rows, prepared, reps, threshold))


def components(links: DataFrame) -> DataFrame:
    """(cls, root): every class that has a link, but the smallest of its connected component, with that smallest class.

    Large star and small star in turn: each step hangs the neighbours of a class
    on the smallest of them, the number of edges does not grow, and the edges
    stay as they are once all of them end at a root.
    """

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = cut_lineage(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before, now = None, mark(edges)
    while now != before:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = cut_lineage(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        before, now = now, mark(edges)
    return edges.select(F.col("a").alias("cls"), F.col("b").alias("root"))


def near_groups(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(id, cls, n_links): every row with the smallest id of its group of near-duplicates, and the number of other texts linked to its own.

    A group is a connected component of the links between shingle sets; null
    texts and texts of fewer than MIN_WORDS words are groups of their own.
    """
    rows = rows.select("id", "text").where("id IS NOT NULL")
    prepared = cut_lineage(prepare(rows, []))
    reps = cut_lineage(representatives(prepared))
    links = cut_lineage(class_links(rows, prepared, reps, threshold))
    # classes are named by their smallest id, so the smallest class of a component is its smallest id
    rooted = _linked(reps.select(F.col("cls").alias("id"), "cls"), links).join(components(links), "cls", "left").select("cls", F.coalesce("root", "cls").alias("root"), "n_links")
    grouped = members(prepared, reps, []).join(rooted, "cls").groupBy("id").agg(F.min("root").alias("cls"), F.max("n_links").alias("n_links"))
    return rows.select("id").distinct().join(grouped, "id", "left").select("id", F.coalesce("cls", "id").alias("cls"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
