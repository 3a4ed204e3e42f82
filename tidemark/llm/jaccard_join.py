"""Size-aware set similarity join on word n-grams: subsets for small sets, inverted lists for large ones.

Two documents link when 100 * intersection >= percent * union of their sets of word shingles.

* Equal sets are one set from the start.
* A set up to the boundary size gives the hash of every subset of each size that an intersection
  with a partner must have; sets that link share one of them.
* A larger set gives its rarest shingles, so many that two sets that link must share one (prefix
  filter). Rarity comes from a sketch of shingle counts over all documents, summed in a tree. What
  it can't see, such as passages that many documents share, shows in the exact lengths of the
  lists: shingles of long lists are demoted behind all others and the sets that gave them give
  rarer ones instead, as long as that saves more than it costs. Any order is exact; a poor one
  costs time, never a link.
* The boundary is the size up to which enumerating subsets costs less in all than posting to and
  scanning lists, by the corpus's own distribution of sizes and the mean length of a list of rare
  shingles, which the sketch measures.

Lists with one member are dropped by a bitmap before anything is shuffled by key. In each list
every member is compared with one pivot, the set with the fewest rarer shingles before the shared
one; components of the verified links follow. Lists whose members are then all in one component
are done. The others are split by the sizes of their sets (``SetJoin.banded``), so that sets of
sizes that can't link don't make a list long. Short ones have their pairs between components compared; long ones are
never crossed but refined: their members are posted again by how they differ from the pivot
(``SetJoin.refined``), where copies of one text with edits of their own share nothing, and the new
lists go through the same steps. So a group of copies costs about its size, not its square, and
no link between components is lost. Candidates must pass the size filter, the position filter at
a shared element and a bound on the intersection from both sets' profiles (how many shingles fall
into each of 64 buckets), all of which are exact; verification intersects the whole sets, made
anew from the texts of the few documents that are still in a pair.

Defined cases: a null or empty text has no shingles and links with nothing; fewer words than n
are one shingle; equal rows are in one component; the component of rows is the smallest id in it
(null ids count only where a component has no other); an empty table gives an empty result; other
columns are not read. Sets are told apart by 128-bit sums of mixed shingle hashes, rows by 64-bit
hashes of id and text.
"""

from __future__ import annotations

import collections
import itertools
import logging
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import settle

from .bitmaps import bitmap, keys_present, may_hold, size_for, split, without
from .components import components
from .shared import col, drop_written, fresh, lean, tree_sum, written
from .textcore import hashed_words, mix

#: Bytes of text whose words are hashed at a time.
SEGMENT = 1 << 19
#: Counters of the sketch, and the rows it is sent in; word counts that are told apart (the last stands for all above).
SKETCH, SLICES, WORD_COUNTS = 1 << 24, 64, 4096
#: A list is short while it has at most so many pairs between components for each member, or for ELEMENTS shingles of its
#: members and their pivots, of which refining makes a row each; WIDER times as many after each refinement, as then few lists are left.
FEW, ELEMENTS, WIDER = 16, 64, 4
#: A list is long from so many members on (a power of two); at most so many shingles are demoted at once, those of the longest
#: lists, into a table of so many bits.
LONG, MOST_DEMOTED, DEMOTED_BITS, ANEW = 8, 1 << 22, 1 << 27, 8
#: Buckets of a set's profile: how many of its shingles fall into each bounds its intersection with another.
PROFILE = 64


def overlap(a, b, percent: int):
    """The least intersection of sets of sizes a and b that link."""
    return -(-percent * (a + b) // (100 + percent))


def smallest_partner(a, percent: int):
    return -(-percent * a // 100)


def prefix(a, percent: int):
    """How many of its rarest shingles a set of size a must show."""
    return a - overlap(a, smallest_partner(a, percent), percent) + 1


def subset_sizes(a: int, percent: int) -> list[int]:
    most = 100 * a // percent
    return sorted({o for b in range(smallest_partner(a, percent), most + 1) if (o := int(overlap(a, b, percent))) <= a})


def subsets(a: int, percent: int) -> int:
    return sum(math.comb(a, o) for o in subset_sizes(a, percent))


def boundary(sizes: dict[int, int], scan: float, percent: int) -> tuple[int, float, float]:
    """The size up to which subsets are enumerated, for sets of these sizes and lists of ``scan`` members, and what subsets and lists then cost.

    A subset is one posting; a list's element is one posting and a scan of the list. A set above the boundary's
    smallest partner shows list elements (also small sets do, for large partners). Sizes are tried upwards until
    the subsets alone cost more than the best way found."""
    way = {a: n * int(prefix(a, percent)) * (1 + scan) for a, n in sizes.items()}
    light, heavy = 0.0, float(sum(way.values()))
    best, by_reach = (0, 0.0, heavy), collections.defaultdict(float)
    for a, cost in way.items():
        by_reach[100 * a // percent] += cost
    for x in range(1, max(sizes, default=0) + 1):
        light += sizes[x] * subsets(x, percent) if sizes.get(x) else 0
        heavy -= by_reach.get(x, 0.0)
        if light > best[1] + best[2]:
            break
        if light + heavy < best[1] + best[2]:
            best = (x, float(light), heavy)
    return best


def shingles(words: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each shingle of the rows, as often as it stands there."""
    length = np.diff(at)
    rows, hashes = [], []
    full = max(0, len(words) - k + 1)
    if full:
        h = np.full(full, 0x243F6A8885A308D3 + k, np.uint64)
        for i in range(k):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + words[i : i + full])
        row = np.searchsorted(at, np.arange(full), "right") - 1
        inside = np.arange(full) + k <= at[row + 1]
        rows.append(row[inside])
        hashes.append(h[inside])
    for n in range(1, k):
        short = np.flatnonzero(length == n)
        h = np.full(len(short), 0x243F6A8885A308D3 + n, np.uint64)
        for i in range(n):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + words[at[short] + i])
        rows.append(short)
        hashes.append(h)
    return (np.concatenate(rows), np.concatenate(hashes)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def pack(counts: np.ndarray) -> bytes:
    """Counts, most of them zero, as a bitmap and the others."""
    some = counts > 0
    return zlib.compress(np.int64(len(counts)).tobytes() + np.packbits(some).tobytes() + counts[some].astype("<i8").tobytes(), 1)


def unpack(packed: bytes) -> np.ndarray:
    data = zlib.decompress(packed)
    n = int(np.frombuffer(data, "<i8", 1)[0])
    some = np.unpackbits(np.frombuffer(data, np.uint8, -(-n // 8), 8), count=n).astype(bool)
    out = np.zeros(n, np.int64)
    out[some] = np.frombuffer(data[8 + -(-n // 8) :], "<i8")
    return out


def sketch_counts(texts: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle counts by hash over all texts, and how many texts have so many words."""

    def count(batches):
        total, words_of = np.zeros(SKETCH, np.uint32), np.zeros(WORD_COUNTS, np.int64)
        for b in batches:
            for _, _, words, at in hashed_words(b.column(0), most=SEGMENT):
                _, h = shingles(words, at, k)
                np.add.at(total, (h >> np.uint64(20)) & np.uint64(SKETCH - 1), np.uint32(1))
                words_of += np.bincount(np.minimum(np.diff(at), WORD_COUNTS - 1), minlength=WORD_COUNTS)
        rows = [(i, pack(p)) for i, p in enumerate(total.reshape(SLICES, -1)) if p.any()] + [(SLICES, pack(words_of))]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=["slot", "sums"])

    def add(parts):
        total = unpack(parts[0])
        for x in parts[1:]:
            total += unpack(x)
        return pack(total)

    counts, words_of = np.zeros((SLICES, SKETCH // SLICES), np.uint32), np.zeros(WORD_COUNTS, np.int64)
    for r in tree_sum(texts, count, add).collect():  # SLICES + 1 rows of fixed size
        if r["slot"] < SLICES:
            counts[r["slot"]] = np.minimum(unpack(r["sums"]), 0xFFFFFFFF)
        else:
            words_of = unpack(r["sums"])
    return counts, words_of


def levels(counts: np.ndarray) -> tuple[np.ndarray, float]:
    """A rank of frequency for each counter: 0 where it is no more than chance collisions make it. And the mean length of a
    list of a rare shingle (rank 0), as seen from its members: from squares of counts, less what chance collisions add."""
    mean, out, n, total, squares = counts.mean(), np.zeros(counts.shape, np.uint8), 0, 0.0, 0.0
    for i, part in enumerate(counts):  # slice by slice: the driver holds little else
        over = (part - mean) / (4 * math.sqrt(mean) + 1)
        out[i] = np.where(over > 1, np.minimum(2 * np.log2(np.maximum(over, 1)) + 1, 60), 0)
        rare = part[out[i] == 0].astype(float)
        n, total, squares = n + len(rare), total + rare.sum(), squares + rare @ rare
    return out.ravel(), max(1.0, float((squares - total * total / max(n, 1)) / max(total, 1.0)))


def _sums(row: np.ndarray, h: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums of each row's (distinct) hashes; rows in order."""
    at = np.searchsorted(row, np.arange(n_rows + 1))
    out = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        c = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(mix(h ^ np.uint64(salt)), out=c[1:])
        out.append(c[at[1:]] - c[at[:-1]])
    return out[0], out[1]


class SetMaker:
    """Distinct shingles of texts in order of rarity, and the keys they show."""

    def __init__(self, level: np.ndarray, k: int, percent: int, x: int, demoted: tuple[np.ndarray, ...] = ()):
        self.level, self.k, self.percent, self.x, self.demoted = level, k, percent, x, demoted

    def demoting(self, places: np.ndarray, bits: int) -> SetMaker:
        """The same with the shingles at these places of so many low bits behind all others (chance companions too)."""
        table = np.zeros(min(bits, DEMOTED_BITS) // 8, np.uint8)
        at = places & (8 * len(table) - 1)
        np.bitwise_or.at(table, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        return SetMaker(self.level, self.k, self.percent, self.x, (*self.demoted, table))

    def is_demoted(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), bool)
        for t in self.demoted:
            at = h & np.uint64(8 * len(t) - 1)
            out |= (t[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
        return out

    def sets(self, words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row, h = shingles(words, at, self.k)
        rank = self.level[(h >> np.uint64(20)) & np.uint64(SKETCH - 1)] + 128 * self.is_demoted(h).astype(np.uint8)
        order = np.lexsort((h, (row.astype(np.int64) << 8) | rank))
        row, h = row[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        return row[new], h[new]

    def keys(self, row: np.ndarray, h: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, key and position of each key shown: list keys of large sets, subset keys of small ones."""
        at = np.searchsorted(row, np.arange(n_rows + 1))
        n = np.diff(at)
        lists = (n > 0) & (100 * n // self.percent > self.x)  # also small sets with large partners
        pos = np.arange(len(row)) - at[row]
        shown = lists[row] & (pos < prefix(n, self.percent)[row])
        rows, keys, places = [row[shown]], [h[shown]], [pos[shown]]
        for r in np.flatnonzero((n > 0) & (n <= self.x)).tolist():
            m = mix(h[at[r] : at[r + 1]])
            total, a = m.sum(dtype=np.uint64), len(m)
            for o in subset_sizes(a, self.percent):
                gone = np.array(list(itertools.combinations(range(a), a - o)), np.int64).reshape(math.comb(a, o), a - o)
                key = mix((total - m[gone].sum(axis=1, dtype=np.uint64)) + np.uint64((o + 1) * 0xA0761D6478BD642F % (1 << 64)))
                rows.append(np.full(len(key), r))
                keys.append(key)
                places.append(np.zeros(len(key), np.int64))
        return np.concatenate(rows), np.concatenate(keys), np.concatenate(places)


def profiles(row: np.ndarray, h: np.ndarray, n_rows: int) -> np.ndarray:
    """Shingles of each row in each bucket, as 16-bit counts (saturated counts would not bound: such rows get none)."""
    counts = np.bincount(row * PROFILE + ((h >> np.uint64(9)) & np.uint64(PROFILE - 1)).astype(np.int64), minlength=n_rows * PROFILE).reshape(n_rows, PROFILE)
    counts[(counts > 65535).any(1)] = 65535
    return counts.astype("<u2")


def _plausible(percent: int):
    """Pairs whose profiles allow the intersection that a link needs."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), "<u2").reshape(-1, PROFILE).astype(np.int64) for c in ("x", "y"))
            least = overlap(b.column("xn").to_numpy(), b.column("yn").to_numpy(), percent)
            full = (x == 65535).all(1) | (y == 65535).all(1)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(full | (np.minimum(x, y).sum(1) >= least)))

    return run


def _linked(percent: int):
    """Pairs with both sets: those that link, by whole intersections."""

    def run(batches):
        for b in batches:
            xs, ys = b.column(2), b.column(3)
            keep = []
            for x, y in zip(xs, ys, strict=True):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _difference(percent: int):
    """From (pivot, member, pivot's set, member's set): the shingles in one of both sets only, as elements of the pivot's own space."""

    def run(batches):
        for b in batches:
            salts = mix(b.column(0).to_numpy().view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            n, d, far, elements = [], [], [], []
            for x, y, salt in zip(b.column(2), b.column(3), salts, strict=True):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                e = np.setxor1d(x, y, assume_unique=True)
                n.append(len(y))
                d.append(len(e))
                far.append((100 + percent) * len(e) > (100 - percent) * (len(x) + len(y)))
                elements.append(mix(e.view(np.uint64) ^ salt).view(np.int64))
            n, d = np.array(n, np.int64), np.array(d, np.int64)
            cols = [b.column(0), b.column(1), pa.array(n), pa.array(d), pa.array((100 + percent) * d - (100 - percent) * n), pa.array(far, pa.bool_()), pa.array(elements, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["p", "rep", "n", "d", "need", "far", "elements"])

    return run


class SetJoin:
    """One run of the join. Lists are rows (entry, rep, n, pos, rest, need): a set ``rep`` of ``n`` shingles shows an element
    ``entry`` at ``pos`` of an order that all members share, ``rest`` of its elements stand there and behind, and two
    members link only if they share at least (need + need) / (2 (100 + percent)) of them."""

    def __init__(self, rows: DataFrame, maker, percent: int):
        self.rows, self.maker, self.percent = rows, maker, percent
        self.sets: DataFrame | None = None

    def shown(self, rows: DataFrame) -> DataFrame:
        """Every row's set (size, two sums, profile) and the elements it shows, with their places."""
        maker, kind = self.maker, rows.schema["id"].dataType.simpleString()

        def show(batches):
            m = maker.value
            for b in batches:
                for first, last, words, at in hashed_words(b.column(2), most=SEGMENT):
                    row, h = m.sets(words, at)
                    s1, s2 = _sums(row, h, last - first)
                    kr, keys, places = m.keys(row, h, last - first)
                    order = np.argsort(kr, kind="stable")
                    offsets = pa.array(np.searchsorted(kr[order], np.arange(last - first + 1)).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([
                        b.column(0)[first:last], b.column(1)[first:last], pa.array(np.bincount(row, minlength=last - first), pa.int64()), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)),
                        pa.array([p.tobytes() for p in profiles(row, h, last - first)], pa.binary()),
                        pa.ListArray.from_arrays(offsets, pa.array(keys[order].view(np.int64))), pa.ListArray.from_arrays(offsets, pa.array(places[order].astype(np.int32)))],
                        names=["key", "id", "n", "s1", "s2", "profile", "shown", "places"])

        return written(rows.mapInArrow(lean(show), f"key long, id {kind}, n long, s1 long, s2 long, profile binary, shown array<long>, places array<int>"), "shown")

    @staticmethod
    def counted(entries: DataFrame, rows: int) -> tuple[DataFrame, int]:
        """How often each place of a bitmap is hit by the frame's entries, where more than once; and the bitmap's bits."""
        bits = size_for(rows, 4)
        at = F.col(entries.columns[0]).bitwiseAND(F.lit(bits - 1)).alias("pos")
        return written(entries.select(at).groupBy("pos").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "counts"), bits

    def demoted(self, shown: DataFrame, again) -> tuple[DataFrame, DataFrame, int]:
        """Rows (key, n, shown, places) after demotion, with what ``counted`` says of their entries; ``again`` makes the rows anew.

        Scanning a list costs its square at worst. Where long lists cost more than reading all texts again (``ANEW`` for
        each posting), their shingles are demoted; that is repeated while it halves the cost."""
        before = math.inf
        while True:
            rows = int(shown.agg(F.sum(F.size("shown"))).first()[0] or 0)
            counts, bits = self.counted(shown.select(F.explode("shown").alias("entry")), rows)
            powers = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("power")).agg(F.count(F.lit(1)).alias("places"), F.sum(F.col("n") * F.col("n")).alias("cost")).collect()
            powers = sorted((r["power"], r["places"], r["cost"]) for r in powers if 1 << r["power"] >= LONG)
            cost = sum(c for _, _, c in powers)
            logging.getLogger(__name__).info("%d postings, long lists cost %d", rows, cost)
            if cost <= ANEW * rows or cost > before / 2:
                return shown, counts, bits
            before, least, places = cost, 1 << 62, 0
            for power, n, _ in reversed(powers):
                places += n
                if places > MOST_DEMOTED:
                    break
                least = 1 << power
            places = counts.filter(F.col("n") >= least).select("pos").toPandas()["pos"].to_numpy(np.int64)  # at most MOST_DEMOTED
            drop_written(counts)
            old, self.maker = self.maker, self.rows.sparkSession.sparkContext.broadcast(self.maker.value.demoting(places, bits))
            old.destroy()
            shown = again()

    def lists(self, postings: DataFrame, counts: DataFrame, bits: int) -> DataFrame:
        """The postings whose entry has at least two, with the list's pivot: the member with the fewest elements before the shared one.

        Entries with one member go by a bitmap before anything is shuffled by entry."""
        twice = written(bitmap(counts.select("pos")), "twice")
        again = written(may_hold(postings, F.col("entry"), twice, bits, mixed=True), "postings")
        drop_written(twice, counts)
        pivot = F.min(F.struct("pos", "n", "rep", "rest", "need")).alias("pivot")
        heads = written(again.groupBy("entry").agg(F.count(F.lit(1)).alias("members"), pivot).filter("members > 1"), "heads")
        out = written(again.join(heads.select("entry", "members", *[F.col(f"pivot.{c}").alias(f"p_{c}") for c in ("rep", "n", "rest", "need")]), "entry"), "lists")
        drop_written(again, heads)
        return out

    def pairs(self, frame: DataFrame, a: str, b: str) -> DataFrame:
        """Distinct pairs that pass the size filter, and the position filter at a shared entry."""
        an, bn, ar, br = (F.col(c) for c in (f"{a}n", f"{b}n", f"{a}rest", f"{b}rest"))
        fits = (F.lit(100) * F.least(an, bn) >= F.lit(self.percent) * F.greatest(an, bn)) & (F.lit(2 * (100 + self.percent)) * F.least(ar, br) >= F.col(f"{a}need") + F.col(f"{b}need"))
        x, y = F.col(f"{a}rep"), F.col(f"{b}rep")
        return frame.filter((x != y) & fits).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()

    def star(self, lists: DataFrame) -> DataFrame:
        return self.pairs(lists, "", "p_")

    def banded(self, lists: DataFrame) -> DataFrame:
        """Every list as lists of members whose sizes allow links, as list j has those of bands j (``own``) and j + 1.

        A band is as wide as the size filter, so sets that link are in one band or in neighbouring ones: each of their
        pairs is in one list with an own member. (A little wider, so that no rounding parts them.)"""
        width = max(math.log(100 / self.percent), 1e-6) * (1 + 1e-9)
        band = F.floor(F.ln(F.col("n")) / F.lit(width))
        split = lists.withColumn("own", F.explode(F.array(F.lit(True), F.lit(False))))
        return split.withColumn("entry", F.xxhash64("entry", F.when(F.col("own"), band).otherwise(band - 1)))

    def crossed(self, lists: DataFrame) -> DataFrame:
        """All pairs of a banded list in different components, with an own member of the list."""
        x, y = (lists.select("entry", *(F.col(c).alias(f"{p}{c}") for c in ("rep", "n", "rest", "need", "label", "own"))) for p in "xy")
        return self.pairs(x.join(y, "entry").filter("xlabel <> ylabel AND xrep < yrep AND (xown OR yown)"), "x", "y")

    def of(self, table: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
        """The table's rows with a wanted key, one each; rows whose bit isn't set are not shuffled."""
        some = size_for(wanted.count(), 16)
        present = written(keys_present(wanted, some), "present")
        return may_hold(table, F.col(key), present, some).join(wanted.withColumnRenamed("key", key), key, "left_semi").dropDuplicates([key])

    def whole(self, keys: DataFrame) -> DataFrame:
        """(rep, set) for the keys: their whole sets, sorted, made anew from the texts."""
        maker = self.maker

        def make(batches):
            m = maker.value
            for b in batches:
                for first, last, words, at in hashed_words(b.column(1), most=SEGMENT):
                    row, h = m.sets(words, at)
                    offsets = pa.array(np.searchsorted(row, np.arange(last - first + 1)).astype(np.int32))
                    order = np.lexsort((h, row))
                    yield pa.RecordBatch.from_arrays([b.column(0)[first:last], pa.ListArray.from_arrays(offsets, pa.array(h[order].view(np.int64)))], names=["rep", "set"])

        return written(self.of(self.rows.select("key", "text"), "key", keys).mapInArrow(lean(make), "rep long, set array<long>"), "sets")

    def links(self, candidates: DataFrame) -> DataFrame:
        """Those of the (a, b) candidates that link: by a bound from both profiles, then by whole sets."""
        ends = lambda pairs: written(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "wanted")
        small = written(self.of(self.sets.select("key", "n", "profile"), "key", ends(candidates)), "profiles")  # written: a join can then split a pivot's pairs
        both = candidates.join(small.select(F.col("key").alias("a"), F.col("n").alias("xn"), F.col("profile").alias("x")), "a").join(small.select(F.col("key").alias("b"), F.col("n").alias("yn"), F.col("profile").alias("y")), "b")
        likely = written(both.mapInArrow(lean(_plausible(self.percent)), "a long, b long"), "plausible")
        sets = self.whole(ends(likely))
        both = likely.join(sets.select(F.col("rep").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("rep").alias("b"), F.col("set").alias("y")), "b")
        out = written(both.select("a", "b", "x", "y").mapInArrow(lean(_linked(self.percent)), "a long, b long"), "links")
        drop_written(sets, small)
        return out

    def refined(self, lists: DataFrame) -> DataFrame:
        """New lists in place of long ones: their members by how they differ from their pivot.

        With D(x) the symmetric difference of x and the pivot P, x and y differ in |D(x)| + |D(y)| - 2 |D(x) & D(y)|
        shingles, so they link if and only if the differences share enough. Members that link with P are in its
        component. If x doesn't link with P, a y that links with x has more than percent / (100 + percent) of D(y)
        in common with D(x). So differences show only their rarest elements, by exact counts among P's members:
        copies of one text with edits of their own share none."""
        p = self.percent
        around = written(lists.filter("rep <> p_rep").select(F.col("p_rep").alias("p"), "rep").distinct(), "around")
        sets = self.whole(written(around.select(F.explode(F.array("p", "rep")).alias("key")).distinct(), "wanted"))
        both = around.join(sets.withColumnRenamed("set", "y"), "rep").join(sets.select(F.col("rep").alias("p"), F.col("set").alias("x")), "p")
        differ = written(both.select("p", "rep", "x", "y").mapInArrow(lean(_difference(p)), "p long, rep long, n long, d long, need long, far boolean, elements array<long>"), "differences")
        drop_written(sets, around)
        elements = differ.select("p", "rep", F.explode("elements").alias("entry"))
        hits, bits = self.counted(elements.select("entry"), int(differ.agg(F.sum("d")).first()[0] or 0))
        twice = written(bitmap(hits.select("pos")), "twice")
        again = written(may_hold(elements, F.col("entry"), twice, bits, mixed=True), "elements")
        counts = written(again.groupBy("entry").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "counts")
        order = again.join(counts, "entry").groupBy("p", "rep").agg(F.array_sort(F.collect_list(F.struct("n", "entry"))).alias("common"))
        least = F.greatest(F.lit(1), F.ceil((p * F.col("need") - (100 - p) * 100 * F.col("n")) / F.lit(p * (100 + p)) - F.lit(1e-9)))
        asked = F.when(F.col("far"), least).otherwise(F.greatest(least, F.floor(p * F.col("d") / (100 + p) + F.lit(1e-9)) + 1))
        first = F.col("d") - F.size("common")  # elements that nobody else has come first
        out = (differ.drop("elements").join(order, ["p", "rep"]).select("rep", "n", "d", "need", first.alias("first"), asked.alias("asked"), F.posexplode("common").alias("i", "e"))
            .select(F.col("e.entry").alias("entry"), "rep", "n", (F.col("first") + F.col("i")).alias("pos"), "d", "need", "asked").filter("pos <= d - asked").select("entry", "rep", "n", "pos", (F.col("d") - F.col("pos")).alias("rest"), "need"))
        out = written(out, "refined")
        drop_written(differ, twice, again, counts, hits)
        return self.lists(out, *self.counted(out.select("entry"), out.count()))

    def labels(self, lists: DataFrame) -> DataFrame:
        """(node, label) of the sets that link with any other."""
        found, tested, links, before, few = self.star(lists), None, None, None, FEW
        while True:
            found = found if tested is None else found.join(tested, ["a", "b"], "left_anti")
            found = written(found, "candidates")
            tested = found if tested is None else tested.unionByName(found)
            new = self.links(found) if found.count() else found
            links = new if links is None else links.unionByName(new)
            labels = components(links)
            if lists is None:
                return labels
            labelled = written(lists.filter("members > 2").join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep")), "labelled")
            drop_written(lists)
            rest = self.banded(labelled)
            m, o, s = F.col("m"), F.col("o"), F.sum
            cost = rest.groupBy("entry", "label").agg(F.count(F.lit(1)).alias("m"), F.count_if(~F.col("own")).alias("o"), s(F.col("n") + F.col("p_n")).alias("elements"))
            apart = (s(m) * s(m) - s(m * m) - s(o) * s(o) + s(o * o)) / 2
            cost = cost.groupBy("entry").agg(s(m).alias("members"), s("elements").alias("elements"), apart.alias("cost"))
            heavy = F.col("cost") > few * F.greatest("members", F.col("elements") / ELEMENTS)
            cost = written(cost.filter("cost > 0").select("entry", "cost", heavy.alias("heavy")), "open")  # lists in one component are done
            total = cost.filter("heavy").agg(F.sum("cost")).first()[0] or 0
            if before is not None and total > before / 2:  # refining doesn't help any further
                cost, total = cost.withColumn("heavy", F.lit(False)), 0
            few *= WIDER
            before, open_ = total, written(rest.join(cost.select("entry", "heavy"), "entry"), "open")
            drop_written(labelled)
            found, lists = self.crossed(open_.filter("NOT heavy")), None
            if total:
                lists = self.refined(open_.filter("heavy"))
                found = found.unionByName(self.star(lists)).distinct()


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.xxhash64(col(id_col), col(text_col)).alias("key"), col(id_col).alias("id"), col(text_col).alias("text"))


def _joined(docs: DataFrame, n: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The sets of all rows, and the component (label, least id) of each class of equal sets."""
    spark, rows = docs.sparkSession, _rows(docs, id_col, text_col)
    sketch, words = sketch_counts(rows.select("text"), n)
    sizes: dict[int, int] = collections.Counter()
    for w, c in enumerate(words.tolist()):
        if w and c:
            sizes[max(1, w - n + 1)] += c
    level, scan = levels(sketch)
    del sketch
    x, light, heavy = boundary(sizes, scan, percent)
    logging.getLogger(__name__).info("boundary %d: subsets cost %.3g, lists cost %.3g", x, light, heavy)
    join = SetJoin(rows, spark.sparkContext.broadcast(SetMaker(level, n, percent, x)), percent)
    keyed = join.shown(rows)
    join.sets = written(keyed.select("key", "id", "n", "s1", "s2", "profile"), "sets")  # outlives the keys
    full = join.sets.filter("n > 0")
    classes = written(full.groupBy("s1", "s2", "n").agg(F.min("key").alias("rep"), F.min("id").alias("least"), F.count(F.lit(1)).alias("rows")), "classes")
    again = written(full.join(classes.filter("rows > 1"), ["s1", "s2", "n"]).groupBy("key", "rep").agg(F.count(F.lit(1)).alias("rows")), "copies")
    copies, twice = again.filter("key <> rep").select("key"), again.filter("key = rep AND rows > 1").select("key")
    twins = twice.count()  # rows with equal id and text

    def once(table: DataFrame) -> DataFrame:
        one = without(table.filter("n > 0").select("key", "n", "shown", "places"), "key", copies)
        if twins:
            through, others, same = split(one, "key", twice)
            one = through.unionByName(others).unionByName(same.dropDuplicates(["key"]))
        return one

    def anew() -> DataFrame:
        nonlocal keyed
        drop_written(keyed)
        keyed = join.shown(rows)
        return once(keyed)

    shown, counts, bits = join.demoted(once(keyed), anew)
    posting = F.explode(F.arrays_zip("shown", "places")).alias("x")
    postings = shown.select(F.col("key").alias("rep"), "n", posting).select(F.col("x.shown").alias("entry"), "rep", "n", F.col("x.places").cast("long").alias("pos"), (F.col("n") - F.col("x.places")).alias("rest"), (2 * percent * F.col("n")).alias("need"))
    lists = join.lists(postings, counts, bits)
    drop_written(keyed, again)
    labels = join.labels(lists)
    join.maker.destroy()
    named = written(classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep")), "classes")
    least = written(named.groupBy("label").agg(F.min("least").alias("component_id")), "components")
    return join.sets, written(named.join(least, "label").select("s1", "s2", "n", "label", "component_id"), "components")


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id (the smallest id reachable by links, its own included)."""
    sets, named = _joined(docs, n, percent, id_col, text_col)
    full = sets.filter("n > 0").select("id", "n", "s1", "s2").join(named, ["s1", "s2", "n"], "left").select("id", "n", "component_id")
    empty = sets.filter("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return full.unionByName(empty).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def drop_near_copies(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with one row of each component, the one with the smallest id (a null id after all others); all columns.

    Rows are told apart by id and text, so rows with equal ids are judged one by one; of rows equal in both one stays,
    unless they have no shingles."""
    sets, named = _joined(docs, n, percent, id_col, text_col)
    members = written(sets.filter("n > 0").join(named, ["s1", "s2", "n"]).select("key", "id", "label"), "members")
    order = F.struct(F.col("id").isNull(), "id", "key")
    chosen = written(members.groupBy("label").agg(F.min(order)["key"].alias("first"), F.count(F.lit(1)).alias("rows")).filter("rows > 1"), "chosen")
    judged = members.join(chosen, "label").groupBy("key", "first").agg(F.count(F.lit(1)).alias("rows"))
    judged = written(judged.select("key", (F.col("key") == F.col("first")).alias("first"), "rows"), "judged")
    (key,) = fresh(docs.columns, "key")
    keyed = docs.select("*", F.xxhash64(col(id_col), col(text_col)).alias(key))
    kept = without(keyed, key, written(judged.filter("NOT first").select("key"), "near-copies"))
    through, others, twins = split(kept, key, written(judged.filter("first AND rows > 1").select("key"), "twins"))
    return through.unionByName(others).unionByName(twins.dropDuplicates([key])).select(*map(col, docs.columns))


def op1_jaccard_join(spark, sf_dir):
    return jaccard_components(settle(spark).read.parquet(f"{sf_dir}/documents.parquet"), n=3, percent=90)
