"""Documents whose shingle sets have a Jaccard similarity above a threshold, by a partition of the universe.

Two sets of sizes s <= l with 100 * intersection >= t * union differ in at most
(s + l) * (100 - t) / (100 + t) elements.  So the universe is hashed into
segments, more of them than elements can differ, and the two agree wholly in
some segment.  In general, give every segment of one set a budget v: -1 (not
looked at), 0 (must be equal) or 1 (may differ in one element, found through
the segments with one element deleted).  Whenever the v + 1 add up to more than
the elements that can differ, some segment differs by no more than its budget.
Which segments get which budget is free, so each set spends where few others
are met: what it shares with many, such as a common passage, is skipped first.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowtally.lineage import cut
from flowtally.llm.base import query, table
from flowtally.llm.components import components

SEED = 7
# words of more bytes than this are hashed one by one
LONG = 64
# long words whose hash a task keeps, and classes it remembers to have emitted; both start afresh beyond that
KEPT_WORDS, KEPT_CLASSES = 1 << 12, 1 << 16
# bytes of texts that are hashed at once, cut where a word ends
BLOCK = 1 << 19
# signature rows a task sends at once
FLUSH = 1 << 17
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(h: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64 bits."""
    h = (h ^ (h >> np.uint64(30))) * _B
    h = (h ^ (h >> np.uint64(27))) * _C
    return h ^ (h >> np.uint64(31))


def _bytes_at_places() -> np.ndarray:
    """A random number for each byte at each place of a word, one row a place."""
    return _mix(np.arange(1, LONG * 256 + 1, dtype=np.uint64) * _A + np.uint64(SEED))


_PLACED = _bytes_at_places()
_IN_WORD = np.array([c != 32 and not 9 <= c <= 13 for c in range(256)])
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


class _Hashes(dict):
    """Long word -> its XXH64."""

    def __missing__(self, word: bytes):
        if len(self) > KEPT_WORDS:
            self.clear()
        h = xxhash.xxh64_intdigest(word, SEED)
        self[word] = h
        return h


def word_hashes(text: bytes, hashes: dict) -> tuple[np.ndarray, np.ndarray]:
    """``(start, hash)`` of each word of a text, ``BLOCK`` bytes at a time.

    A word's hash is the sum of the random numbers of its bytes at their
    places; words of more than ``LONG`` bytes have their XXH64.
    """
    starts, found, at = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], 0
    while at < len(text):
        space = _SPACE.search(text, at + BLOCK)
        stop = space.start() if space else len(text)
        raw = np.frombuffer(text, np.uint8, stop - at, at)
        where = np.flatnonzero(_IN_WORD[raw])
        if len(where):
            first = np.flatnonzero(np.diff(where, prepend=-2) > 1)
            size = np.diff(first, append=len(where))
            place = (np.arange(len(where)) - np.repeat(first, size)) % LONG
            sums = np.add.reduceat(_PLACED[place << 8 | raw[where]], first)
            h = _mix(sums + size.astype(np.uint64) * _B)
            for i in np.flatnonzero(size > LONG):
                begin = at + int(where[first[i]])
                h[i] = hashes[text[begin : begin + int(size[i])]]
            starts.append(where[first] + at)
            found.append(h)
        at = stop
    return np.concatenate(starts), np.concatenate(found)


def _shingles(w: np.ndarray, width: int) -> np.ndarray:
    """The hash of each run of ``width`` words."""
    last = max(0, len(w) - width + 1)
    h = _mix(w[:last] + np.uint64(width))
    for i in range(1, width):
        h = _mix(h * _A + w[i : i + last])
    return h


def _sets_of(texts: list[bytes], size: int, hashes: dict) -> Iterator[np.ndarray]:
    starts, w = word_hashes(b"\n".join(texts).lower(), hashes)
    ends = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts])).tolist()
    shingles, begin = _shingles(w, size), 0
    for end in ends:
        n = end - begin
        h = np.sort(shingles[begin : end - size + 1] if n >= size else _shingles(w[begin:end], n))
        yield h[np.diff(h, prepend=~h[:1]) != 0] if n else h
        begin = end


def shingle_sets(texts: Iterable[bytes | None], size: int, hashes: dict) -> Iterator[np.ndarray]:
    """The distinct ``size``-word shingles of each text, as sorted 64-bit hashes; empty without words."""
    waiting, held = [], 0
    for text in texts:
        waiting.append(text or b"")
        held += len(waiting[-1])
        if held >= BLOCK:
            yield from _sets_of(waiting, size, hashes)
            waiting, held = [], 0
    yield from _sets_of(waiting, size, hashes)


def shingle_set(text: bytes | None, size: int, hashes: dict) -> np.ndarray:
    """``shingle_sets`` of one text."""
    return next(shingle_sets([text], size, hashes))


def bands() -> list[tuple[int, int]]:
    """Size bands, smallest and largest size of each; half as wide again as the sizes they start with."""
    out, low = [], 1
    while low < 1 << 28:
        out.append((low, low + low // 2))
        low = out[-1][1] + 1
    return out


BANDS = bands()


@lru_cache(maxsize=1 << 16)
def band_of(n: int) -> int:
    return next(b for b, (_, high) in enumerate(BANDS) if n <= high)


def budget(n: int, band: int, percent: int) -> int:
    """The most elements in which a set of ``n`` can differ from a similar one of ``band`` that is no larger."""
    return (n + min(n, BANDS[band][1])) * (100 - percent) // (100 + percent)


def segments(band: int, percent: int) -> tuple[int, int]:
    """Segments of a band: one more than elements can differ, and how many of them allow a budget of 1."""
    high = BANDS[band][1]
    m = (high + high * 100 // percent) * (100 - percent) // (100 + percent) + 1
    return m, min(m, max(4, m // 16))


@lru_cache(maxsize=1 << 16)
def probed(n: int, percent: int) -> tuple[int, ...]:
    """Bands, its own first, that hold sets no larger than ``n`` which can be similar without being equal."""
    own = band_of(n)
    some = [b for b in range(own, -1, -1) if BANDS[b][1] * 100 >= percent * n]
    largest = n * 100 // percent
    # an own band is also looked up by larger sets
    possible = (n + largest) * (100 - percent) // (100 + percent) > 0
    return tuple(b for b in some if possible and (b == own or budget(n, b, percent) > 0))


def signatures(h: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """``(key, meta)`` of a set's segments and, where a budget of 1 is allowed, of its segments less one element.

    A key hashes band, segment number and the segment's elements.  ``meta``
    packs the set's size, the segment number, how far the band lies below the
    set's own, and 1 for a deletion.
    """
    n = len(h)
    keys, metas = [], []
    for below, band in enumerate(probed(n, percent)):
        m, loose = segments(band, percent)
        salt = np.uint64((band + 1) * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF)
        segment = ((_mix(h ^ salt) >> np.uint64(32)) % np.uint64(m)).astype(np.int64)
        g = _mix(h + salt)
        # sums modulo 2^64 by halves, whose sums a double holds exactly
        halves = (g & np.uint64(0xFFFFFFFF)).astype(np.float64), (g >> np.uint64(32)).astype(np.float64)
        low, high = (np.bincount(segment, x, m).astype(np.uint64) for x in halves)
        sums = low + (high << np.uint64(32))
        place = np.arange(1, m + 1, dtype=np.uint64) * _A + salt
        keys.append(_mix(sums + place))
        common = n << 33 | below << 1
        metas.append(np.arange(m, dtype=np.int64) << 5 | common)
        mine = np.flatnonzero(segment < loose)
        at = segment[mine]
        keys.append(_mix(sums[at] - g[mine] + place[at]))
        metas.append(at << 5 | common | 1)
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(keys).view(np.int64), np.concatenate(metas)


def class_of(h: np.ndarray) -> int:
    """One number for equal sets; 0 for the empty one."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(h.tobytes())).view(np.int64)) or 1 if len(h) else 0


def allocate(rows: list[tuple[int, int, int, int]], percent: int) -> tuple[dict[int, int], int]:
    """Budgets of one set: ``{row number: mode}`` of the rows that are looked up, and how much the set shares.

    ``rows`` are ``(key, meta, whole, less)``: the set's keys that others have
    too, with how many other indexed sets have them as a segment and as a
    segment less one element.  Segments not among them meet nobody and give
    their budget for nothing; the rest is bought from the cheapest.  Modes: 0
    looks for equal segments, 1 also for those with one more element, 2 is a
    deletion that looks for equal segments.
    """
    by_band: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
    for r, (_, meta, _, _) in enumerate(rows):
        by_band[meta >> 1 & 15][meta >> 5 & 0xFFFFFFF].append(r)
    modes: dict[int, int] = {}
    weight = 0
    for below, found in by_band.items():
        n = rows[next(iter(found.values()))[0]][1] >> 33
        band = band_of(n) - below
        m, loose = segments(band, percent)
        left = budget(n, band, percent) + 1
        left -= m - len(found) + loose - sum(i < loose for i in found)
        steps = []
        for i, some in found.items():
            exact = widened = 0
            for r in some:
                _, meta, whole, less = rows[r]
                if meta & 1:
                    widened += whole
                else:
                    exact, widened = exact + whole, widened + less
                    weight += whole if not below else 0
            if i >= loose:
                steps.append((exact, i, 1))
            elif widened >= exact:
                steps += [(exact, i, 1), (widened, i, 2)]
            else:  # the second unit costs less than the first: both at their mean
                mean = (exact + widened) / 2
                steps += [(mean, i, 1), (mean, i, 2)]
        if left <= 0:
            continue
        level: dict[int, int] = {}
        for _, i, reached in sorted(steps)[:left]:
            level[i] = max(level.get(i, 0), reached)
        for i, reached in level.items():
            for r in found[i]:
                _, meta, whole, less = rows[r]
                if meta & 1:
                    if reached == 2 and whole:
                        modes[r] = 2
                elif whole or (reached == 2 and less):
                    modes[r] = reached - 1
    return modes, weight


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))


def _members(texts: DataFrame, size: int, percent: int) -> DataFrame:
    """``(key, cls, n, weight, kind, mode)``: the keys several classes share.

    ``kind`` is 0 for an indexed segment, 1 for an indexed deletion, -1 for a
    key of a lower band; ``mode`` is that of ``allocate``, -1 if not looked up.
    """

    def emitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen, ready, waiting = _Hashes(), set(), [], 0

        def flushed():
            columns = [np.concatenate(c) for c in zip(*ready, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "cls", "meta"])

        for b in batches:
            for h in shingle_sets((t.as_py() for t in b.column("text")), size, hashes):
                cls = class_of(h)
                if not cls or cls in seen:
                    continue
                if len(seen) > KEPT_CLASSES:
                    seen.clear()
                seen.add(cls)
                keys, metas = signatures(h, percent)
                ready.append((keys, np.full(len(keys), cls, np.int64), metas))
                waiting += len(keys)
                if waiting >= FLUSH:
                    yield flushed()
                    ready, waiting = [], 0
        if ready:
            yield flushed()

    rows = texts.select("text").mapInArrow(emitted, "key long, cls long, meta long")
    same = Window.partitionBy("key")
    below, less = F.col("meta").bitwiseAND(30), F.col("meta").bitwiseAND(1)
    seen = rows.select(
        "*",
        F.min("cls").over(same).alias("low"),
        F.max("cls").over(same).alias("high"),
        F.count(F.when((below == 0) & (less == 0), 1)).over(same).alias("whole"),
        F.count(F.when((below == 0) & (less == 1), 1)).over(same).alias("less"),
    ).where("low <> high")
    # a row is not its own neighbour; two deletions of different sets say nothing about each other
    own = F.when((below == 0) & (less == 0), 1).otherwise(0)
    seen = seen.select("key", "cls", "meta", (F.col("whole") - own).alias("whole"), F.when(less == 0, F.col("less")).otherwise(0).alias("less"))
    # whether indexed or looking up, a row needs a segment to meet, or to be one that a deletion can meet
    seen = seen.where("whole > 0 OR less > 0 OR (meta & 31) = 0")
    # classes that several tasks have emitted
    seen = seen.groupBy("cls", "meta", "key").agg(F.max("whole").alias("whole"), F.max("less").alias("less"))
    sets = seen.groupBy("cls").agg(F.collect_list(F.struct("key", "meta", "whole", "less")).alias("rows"))

    def chosen(batches):
        for b in batches:
            out = []
            for cls, rows in zip(b["cls"], b["rows"], strict=True):
                rows = [(r["key"], r["meta"], r["whole"], r["less"]) for r in rows]
                modes, weight = allocate(rows, percent)
                for r, (key, meta, _, _) in enumerate(rows):
                    mode, kind = modes.get(r, -1), -1 if meta & 30 else meta & 1
                    if mode >= 0 or kind >= 0:
                        out.append((key, cls, meta >> 33, weight, kind, mode))
            yield pd.DataFrame(out, columns=["key", "cls", "n", "weight", "kind", "mode"])

    return sets.mapInPandas(chosen, "key long, cls long, n long, weight long, kind int, mode int")


def _common(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` with their sets' sizes and ``common``, counted element by element."""
    left = sets.select(F.col("cls").alias("a"), F.col("h").alias("ha"))
    right = sets.select(F.col("cls").alias("b"), F.col("h").alias("hb"))
    sizes = [F.size(f"h{x}").cast("long").alias(f"n{x}") for x in "ab"]
    both = F.size(F.array_intersect("ha", "hb")).cast("long").alias("common")
    return pairs.join(left, "a").join(right, "b").select("a", "b", *sizes, both)


def _similar(pairs: DataFrame, percent: int) -> DataFrame:
    """Of ``_common``, the pairs that are similar."""
    return pairs.where(F.col("common") * (100 + percent) >= (F.col("na") + F.col("nb")) * percent).select("a", "b")


def _pair(a: str, b: str) -> list:
    return [F.greatest(a, b).alias("a"), F.least(a, b).alias("b")]


def jaccard_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80
) -> DataFrame:
    """``(id, n_shingles, component_id)``: one row per row of ``docs``.

    A-Z is lower-cased, words are split at ASCII white space; a set holds the
    distinct runs of ``shingle`` words, a shorter text is one shingle.  Texts
    link if their sets have at least ``percent`` hundredths in common, and a
    component is named by its smallest id.  NULL and blank texts have no
    shingles and link with nothing, so each stays alone.  Rows with a NULL id
    take part; their component is the smallest id they reach, NULL if none.
    Repeated rows stay.  Other columns are not read.  Shingles are compared by
    64-bit hashes.

    Equal sets are one class, whatever their number, and a task emits a class
    once.  A key that one class alone has is dropped where it is counted.
    Classes that meet are first compared with the one of their key that shares
    most, so a group of near copies costs one comparison a member; after that
    only classes not yet connected are compared, all of them.
    """
    texts = _texts(docs, id_col, text_col)

    def classes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for b in batches:
            sets = ((len(h), class_of(h)) for h in shingle_sets((t.as_py() for t in b.column("text")), shingle, hashes))
            n, cls = np.fromiter(sets, np.dtype((np.int64, 2)), b.num_rows).T
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n), pa.array(cls)], ["id", "n", "cls"])

    made = cut(texts.mapInArrow(classes_of, "id long, n long, cls long"))
    members = cut(_members(texts, shingle, percent))
    rank = F.max(F.when(F.col("kind") >= 0, F.struct("weight", "cls")))
    hubs = members.groupBy("key").agg(F.max("mode").alias("m"), rank.alias("hub")).where("m >= 0")
    members = cut(members.drop("weight").join(cut(hubs.select("key", F.col("hub.cls").alias("hub"))), "key"))
    sets = _sets(texts, made, members, shingle)
    links = _links(members, sets, percent)
    classes = made.where("cls <> 0").groupBy("cls").agg(F.min("id").alias("low"))
    found = classes.join(links.select(F.col("node").alias("cls"), "component"), "cls", "left")
    found = cut(found.select("cls", "low", F.coalesce("component", "cls").alias("component")))
    lowest = found.groupBy("component").agg(F.min("low").alias("component_id"))
    named = cut(found.join(lowest, "component").select("cls", "component_id"))
    linked = made.join(named, "cls", "left")
    return linked.select("id", F.col("n").alias("n_shingles"), F.when(F.col("cls") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def _sets(texts: DataFrame, made: DataFrame, members: DataFrame, shingle: int) -> DataFrame:
    """``(cls, h)`` of the classes that may be compared, from one text of each."""
    wanted = cut(members.select("cls").distinct())
    chosen = made.join(wanted, "cls", "left_semi").where("id IS NOT NULL").groupBy("cls").agg(F.min("id").alias("id"))
    chosen = cut(chosen.select("id").distinct())
    some = texts.join(chosen, "id", "left_semi").union(texts.where("id IS NULL")).select("text")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = _Hashes(), set()
        for b in batches:
            classes, sets = [], []
            for h in shingle_sets((t.as_py() for t in b.column("text")), shingle, hashes):
                cls = class_of(h)
                if cls and cls not in seen:
                    if len(seen) > KEPT_CLASSES:
                        seen.clear()
                    seen.add(cls)
                    classes.append(cls)
                    sets.append(h.view(np.int64))
            ends = np.concatenate(([0], np.cumsum([len(h) for h in sets]))).astype(np.int32)
            values = np.concatenate(sets) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(classes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], ["cls", "h"])

    return cut(some.mapInArrow(hashed, "cls long, h array<long>").join(wanted, "cls", "left_semi").dropDuplicates(["cls"]))


def _lone(sets: DataFrame) -> DataFrame:
    """``(cls, lone)``: how many shingles of a class no other compared class has; classes without any are missing."""
    found = sets.select("cls", F.explode("h").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.min("cls").alias("cls"))
    return found.where("c = 1").groupBy("cls").agg(F.count(F.lit(1)).alias("lone"))


def _links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``(node, component)`` of the classes that link.

    First each class is compared with the hub of its keys, the class that
    shares most.  Members of a key that link with its hub are connected and
    need no comparison with each other, and neither do classes that link with
    the same other hub.  For the rest three bounds hold on what a pair x, y of
    a key can have in common.  Let ``lone`` be the shingles of a class that no
    compared class has, n its size and d its difference from the hub, counted
    exactly.

    * x and y have at most min(n - lone) in common;
    * the lone shingles of x are in neither the hub nor y, so x and y differ in
      at least d(y) - d(x) + 2 lone(x), and the same with x and y exchanged.

    A class y that does not link with the hub has d(y) whole > (n(y) + n(hub))
    rest, so by the second bound it can link with an x only if (d(x) - 2
    lone(x)) whole > (n(hub) - n(x)) rest.  Such x, called free, are few in a
    group of copies edited independently, and only with them is y compared.
    """
    whole, rest = 100 + percent, 100 - percent
    star = members.where("mode >= 0 AND cls <> hub").select(*_pair("cls", "hub")).distinct()
    star = cut(_common(star, sets))
    near = _similar(star, percent)
    # keys of which some member is not known to link with the hub
    both = near.select(F.col("a").alias("cls"), F.col("b").alias("hub")).union(near.select("b", "a"))
    rows = members.join(both.withColumn("near", F.lit(True)), ["cls", "hub"], "left")
    rows = rows.withColumn("near", F.col("near").isNotNull() | (F.col("cls") == F.col("hub")))
    open_keys = rows.groupBy("key").agg(F.min("near").alias("near")).where("NOT near").select("key")
    rows = cut(rows.join(cut(open_keys), "key").drop("near"))
    wanted = rows.where("cls <> hub").select(*_pair("cls", "hub")).distinct()
    star = cut(star.union(_common(wanted.join(star, ["a", "b"], "left_anti"), sets)))
    near = _similar(star, percent)
    both = near.select(F.col("a").alias("cls"), F.col("b").alias("label")).union(near.select("b", "a"))
    heads = members.select(F.col("hub").alias("label")).distinct()
    label = both.union(heads.select("label", "label")).join(heads, "label").groupBy("cls").agg(F.max("label").alias("label"))
    facts = label.withColumn("lone", F.lit(None).cast("long")).unionByName(_lone(sets), allowMissingColumns=True)
    facts = cut(facts.groupBy("cls").agg(F.max("label").alias("label"), F.max("lone").alias("lone")))
    d = F.col("na") + F.col("nb") - 2 * F.col("common")
    linked = F.col("common") * whole >= (F.col("na") + F.col("nb")) * percent
    far = star.select(F.col("a").alias("cls"), F.col("b").alias("hub"), F.col("nb").alias("n_hub"), d.alias("d"), linked.alias("linked"))
    far = far.union(star.select("b", "a", "na", d, linked))
    rows = rows.join(facts, "cls", "left").join(far, ["cls", "hub"], "left")
    is_hub = F.col("cls") == F.col("hub")
    rows = rows.withColumns(
        {
            "label": F.coalesce("label", "cls"),
            "lone": F.coalesce("lone", F.lit(0)),
            "n_hub": F.when(is_hub, F.col("n")).otherwise(F.col("n_hub")),
            "d": F.when(is_hub, 0).otherwise(F.col("d")),
            "out": ~(is_hub | F.col("linked")),
        }
    ).drop("linked", "hub")
    free = (F.col("d") - 2 * F.col("lone")) * whole > (F.col("n_hub") - F.col("n")) * rest
    rows = cut(rows.withColumn("free", free).drop("n_hub"))
    asks, index = rows.where("mode >= 0"), rows.where("kind >= 0")
    index = index.select("key", *[F.col(c).alias(f"{c}2") for c in ("cls", "n", "lone", "kind", "label", "d", "free", "out")])
    smaller = (F.col("n2") < F.col("n")) | ((F.col("n2") == F.col("n")) & (F.col("cls2") < F.col("cls")))
    meet = (F.col("mode") == 1) | (F.col("kind2") == 0)
    sizes = F.col("n") + F.col("n2")
    possible = F.least(F.col("n") - F.col("lone"), F.col("n2") - F.col("lone2")) * whole >= sizes * percent
    apart = F.greatest(F.col("d") - F.col("d2") + 2 * F.col("lone2"), F.col("d2") - F.col("d") + 2 * F.col("lone"))
    can = (F.col("label") != F.col("label2")) & smaller & meet & possible & (apart * whole <= sizes * rest)
    # one of the two does not link with the hub, and the other one is free
    last = asks.where("out").join(index.where("free2"), "key").where(can)
    last = last.union(asks.where("NOT out AND free").join(index.where("out2"), "key").where(can))
    last = last.select(*_pair("cls", "cls2")).distinct()
    return components(near.union(_similar(_common(last, sets), percent)))


@query("op12_jaccard_join")
def op12_jaccard_join(spark, sf_dir):
    groups = jaccard_groups(table(spark, sf_dir, "documents"))
    return groups.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")
