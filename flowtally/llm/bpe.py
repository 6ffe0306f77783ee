"""Byte-level BPE: encoding by ranked merges over the bytes of distinct words, decoding by joining pieces.

Two forms of the same fold.  ``fold_words`` is made of Spark's higher-order
functions over a table of distinct words.  ``encode`` runs the fold inside
Arrow batches, once per distinct word a task meets, many words at once: joining a corpus-wide word
table back to every word place would shuffle all words of the text, and a word
table grows with the corpus, so it can't be broadcast.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtally.llm.base import free_names, query, table

# distinct words whose ids a task keeps; it starts afresh beyond that
KEPT = 1 << 17
# words up to this many bytes are folded in a list, longer ones with a heap
SHORT = 48
UNRANKED = 1 << 62
# words whose ids are laid out at once; bounds memory whatever a text's length
GROUP = 1 << 18
# texts that are encoded, decoded and sent back at once
ROWS = 1024
SLOTS = 1 << 14


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    """Piece -> rank of a rank file: base64 piece and rank per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def fold(word: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Ids of a word: the leftmost neighbouring pair of lowest rank merges until none is ranked.

    A word that is a piece itself is that piece.  Short words keep the ranks of
    their pairs in a list, of which a merge changes two; long ones keep their pairs in a heap, so a run of
    millions of letters takes n log n steps.
    """
    whole = ranks.get(word)
    if whole is not None:
        return (whole,)
    if len(word) <= SHORT:
        parts = [word[i : i + 1] for i in range(len(word))]
        # rank of each part with the next one
        pairs = [ranks.get(word[i : i + 2], UNRANKED) for i in range(len(word) - 1)]
        while pairs and (least := min(pairs)) < UNRANKED:
            at = pairs.index(least)
            parts[at] += parts.pop(at + 1)
            pairs.pop(at)
            if at < len(pairs):
                pairs[at] = ranks.get(parts[at] + parts[at + 1], UNRANKED)
            if at:
                pairs[at - 1] = ranks.get(parts[at - 1] + parts[at], UNRANKED)
        return tuple(map(ranks.__getitem__, parts))
    n = len(word)
    end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        # stale entries: a part is gone or has grown since
        if not alive[i] or after[i] >= n or end[after[i]] != stop:
            continue
        j = after[i]
        end[i], after[i], alive[j] = stop, after[j], False
        if after[i] < n:
            before[after[i]] = i
            if (r := ranks.get(word[i : end[after[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[after[i]]))
        if before[i] >= 0 and (r := ranks.get(word[before[i] : stop])) is not None:
            heapq.heappush(heap, (r, before[i], stop))
    return tuple(ranks[word[i : end[i]]] for i in range(n) if alive[i])


@lru_cache(maxsize=4)
def pair_table(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(single, keys, merged)``: the rank of each byte, and of every pair of pieces whose joined bytes are a piece.

    ``keys`` are the pairs, first rank in the upper half, sorted; ``merged``
    has the rank of the joined piece.  The last key is no pair.
    """
    ranks = load_ranks(path)
    get = ranks.get
    found = [
        (left << 32 | right, rank)
        for piece, rank in ranks.items()
        for i in range(1, len(piece))
        if (left := get(piece[:i])) is not None and (right := get(piece[i:])) is not None
    ]
    keys, merged = np.array([*found, (np.iinfo(np.int64).max, UNRANKED)], np.int64).T
    order = np.argsort(keys)
    single = np.array([get(bytes([i]), -1) for i in range(256)], np.int64)
    return single, keys[order], merged[order]


def fold_many(words: list[bytes], path: str) -> list[list[int]]:
    """``fold`` of each word, all words at once; meant for words of up to ``SHORT`` bytes.

    Words of equally many parts are rows of one matrix.  Each merge takes one
    part away, so after a merge a row belongs to the matrix of one part less;
    matrices are folded from the widest on.
    """
    single, keys, merged = pair_table(path)
    if (single < 0).any():  # bytes without a rank may still be halves of a piece
        return [list(fold(word, load_ranks(path))) for word in words]
    get = load_ranks(path).get
    out: list = [None] * len(words)
    by_size: dict[int, list[int]] = {}
    for i, word in enumerate(words):
        whole = get(word)
        if whole is not None:
            out[i] = [whole]
        elif not word:
            out[i] = []
        else:
            by_size.setdefault(len(word), []).append(i)

    def ranked(left, right):
        pair = left << 32 | right
        at = np.searchsorted(keys, pair)
        return np.where(keys[at] == pair, merged[at], UNRANKED)

    widest = max(by_size, default=0)
    # word numbers, parts and the ranks of neighbouring parts
    who, parts, pairs = np.zeros(0, np.int64), np.zeros((0, widest), np.int64), np.zeros((0, max(0, widest - 1)), np.int64)
    for width in range(widest, 0, -1):
        some = by_size.get(width, [])
        raw = np.frombuffer(b"".join(words[i] for i in some), np.uint8).reshape(len(some), width)
        new = single[raw]
        who, parts = np.concatenate((who, np.array(some, np.int64))), np.concatenate((parts, new))
        pairs = np.concatenate((pairs, ranked(new[:, :-1], new[:, 1:])))
        if width == 1:
            at, least = np.zeros(len(who), np.int64), np.full(len(who), UNRANKED)
        else:
            at = pairs.argmin(1)
            least = pairs[np.arange(len(who)), at]
        done = least == UNRANKED
        for i, ids in zip(who[done].tolist(), parts[done].tolist(), strict=True):
            out[i] = ids
        if width == 1:
            break
        on = ~done
        who, parts, pairs, at, least = who[on], parts[on], pairs[on], at[on], least[on]
        before = np.arange(width - 1) < at[:, None]
        parts = np.where(before, parts[:, :-1], parts[:, 1:])
        pairs = np.where(before[:, :-1], pairs[:, :-1], pairs[:, 1:])
        rows = np.arange(len(who))
        parts[rows, at] = least
        left = np.nonzero(at > 0)[0]
        pairs[left, at[left] - 1] = ranked(parts[left, at[left] - 1], least[left])
        right = np.nonzero(at < width - 2)[0]
        pairs[right, at[right]] = ranked(least[right], parts[right, at[right] + 1])
    return out


def _encoder(ranks_path: str, pattern: str):
    """A function from texts to arrays of ids; a NULL text has none."""
    known: dict[str, list[int]] = {}
    split = regex.compile(pattern)

    def ids_of_words(found: list[str]) -> list[list[int]]:
        """Ids of each word; those not met yet are folded together."""
        if len(known) > KEPT:
            known.clear()
        new = list(set(found).difference(known))
        raw = [word.encode("utf-8", "surrogatepass") for word in new]
        short = [i for i, word in enumerate(raw) if len(word) <= SHORT]
        known.update(zip([new[i] for i in short], fold_many([raw[i] for i in short], ranks_path), strict=True))
        if len(short) == len(new):
            return list(map(known.__getitem__, found))
        # long words are not kept
        long = {w: fold(r, load_ranks(ranks_path)) for w, r in zip(new, raw, strict=True) if len(r) > SHORT}
        return [long[w] if w in long else known[w] for w in found]

    def ids_of(batch: pa.Array) -> pa.ListArray:
        flat, lengths, waiting, ends = [], [], [], []

        def flush():
            ids = ids_of_words(waiting)
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            flat.append(np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum())))
            # ids up to each text's last word here
            upto = np.concatenate(([0], np.cumsum(sizes)))[[end for _, end in ends]]
            for (row, _), n in zip(ends, np.diff(upto, prepend=0).tolist(), strict=True):
                lengths[row] += n
            waiting.clear()
            ends.clear()

        for row, text in enumerate(batch):
            found, at = split.findall(text.as_py() or ""), 0
            lengths.append(0)
            while len(found) - at + len(waiting) >= GROUP:
                stop = at + GROUP - len(waiting)
                waiting.extend(found[at:stop])
                ends.append((row, len(waiting)))
                at = stop
                flush()
            waiting.extend(found[at:] if at else found)
            ends.append((row, len(waiting)))
        if ends:
            flush()
        offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
        values = np.concatenate(flat) if flat else np.zeros(0, np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))

    return ids_of


def _decoder(ranks_path: str):
    """A function from arrays of ids to the bytes of their pieces."""
    piece = {r: p for p, r in load_ranks(ranks_path).items()}.__getitem__

    def joined(batch: pa.Array) -> pa.Array:
        out = []
        for row in batch:
            out.append(b"".join(map(piece, row.values.to_numpy(zero_copy_only=False).tolist())) if row.is_valid else None)
        return pa.array(out, pa.binary())

    return joined


def _slices(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        for at in range(0, len(batch), ROWS):
            yield batch.slice(at, ROWS)


def encode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with the text replaced by its token ids, ``array<int>``.

    Every match of ``pattern`` is encoded separately and no special token is
    recognised.  NULL text counts as empty and gives an empty array.  Columns
    other than the text, whatever their type, are carried along unseen.
    """
    keep = [c for c in docs.columns if c not in (text_col, ids_col)]

    @F.arrow_udf("array<int>")
    def ids_of(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from map(_encoder(ranks_path, pattern), _slices(texts))

    return docs.select(*keep, ids_of(F.col(text_col).cast("string")).alias(ids_col))


def decode(docs: DataFrame, ranks_path: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """``docs`` with ``bytes_col``: the pieces of its ids, joined.  NULL ids give NULL; an unknown id fails."""

    @F.arrow_udf("binary")
    def joined(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from map(_decoder(ranks_path), _slices(batches))

    return docs.withColumn(bytes_col, joined(F.col(ids_col)))


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """``docs`` with the text replaced by ``ids`` and by ``decoded``, as ``decode(encode(docs))`` makes them.

    Both steps run in one Python worker a task; two would share an executor's memory.
    """
    keep = [c for c in docs.columns if c not in (text_col, "ids", "decoded")]

    @F.arrow_udf("struct<ids array<int>, decoded binary>")
    def both(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ids_of, joined = _encoder(ranks_path, pattern), _decoder(ranks_path)
        for ids in map(ids_of, _slices(texts)):
            yield pa.StructArray.from_arrays([ids, joined(ids)], ["ids", "decoded"])

    (made,) = free_names(docs, "coded")
    coded = docs.select(*keep, both(F.col(text_col).cast("string")).alias(made))
    return coded.select(*keep, f"{made}.ids", f"{made}.decoded")


def _slot(piece):
    return F.pmod(F.xxhash64(piece), F.lit(SLOTS)).cast("int")


def rank_literal(spark, ranks_path: str):
    """The rank map as one literal: slots by hash, each a short text of ``,hex piece=rank`` entries.

    A Spark map is searched from its start, so one map of all ranks would be
    read half through at each lookup; a slot holds a few entries.  The literal
    is one text split at planning time.
    """
    ranks = load_ranks(ranks_path)
    hexed = spark.createDataFrame([(p.hex().upper(), r) for p, r in ranks.items()], "p string, r int")
    slots = [""] * SLOTS
    for row in hexed.select("p", "r", _slot(F.col("p")).alias("s")).collect():
        slots[row["s"]] += f",{row['p']}={row['r']}"
    return F.split(F.lit(";".join(slots)), ";")


def fold_words(words: DataFrame, ranks, word_col: str = "word") -> DataFrame:
    """``words`` with ``ids``: the fold as higher-order functions over the word's bytes.

    ``ranks`` is the literal of ``rank_literal``.  Pieces are hex strings, two
    digits a byte; each step of the outer fold merges the leftmost pair of
    lowest rank, and does nothing once no pair is ranked.  Meant for distinct
    words; NULL gives NULL and the empty word an empty array.
    """
    coded = F.hex(F.encode(F.col(word_col), "UTF-8"))

    def rank(piece):
        entry = F.call_function("substring_index", F.get(ranks, _slot(piece)), F.concat(F.lit(","), piece, F.lit("=")), F.lit(-1))
        # without the piece the whole slot is left, which begins with a comma or is empty
        return F.substring_index(entry, ",", 1).try_cast("int")

    def let(value, body):
        # lambdas know no common subexpressions, so a value used twice is bound as the element of an array
        return F.get(F.transform(F.array(value), body), 0)

    def step(parts, _):
        pairs = F.transform(F.sequence(F.lit(0), F.size(parts) - 2), lambda i: rank(F.concat(F.get(parts, i), F.get(parts, i + 1))))
        least = let(pairs, lambda p: F.coalesce(F.array_position(p, F.array_min(p)).cast("int"), F.lit(0)))

        def merge(at):
            pair = F.array(F.concat(F.get(parts, at - 1), F.get(parts, at)))
            merged = F.concat(F.slice(parts, F.lit(1), at - 1), pair, F.slice(parts, at + 2, F.size(parts)))
            return F.when(at > 0, merged).otherwise(parts)

        return F.when(F.size(parts) > 1, let(least, merge)).otherwise(parts)

    n = (F.length(coded) / 2).cast("int")
    empty = F.array().cast("array<string>")
    single = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(coded, 2 * i + 1, F.lit(2)))).otherwise(empty)
    steps = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    folded = F.aggregate(steps, single, step)
    parts = F.when(rank(coded).isNotNull(), F.array(coded)).otherwise(folded)
    return words.withColumn("ids", F.when(F.col(word_col).isNotNull(), F.transform(parts, rank)))


def digests(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with ``n_tokens``, ``ids_sha256`` and, from the decoded ids, ``decoded_sha256``."""
    coded = round_trip(docs, ranks_path, pattern, text_col)
    return coded.withColumns(
        {
            "n_tokens": F.size("ids").cast("long"),
            "ids_sha256": F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256),
            "decoded_sha256": F.sha2("decoded", 256),
        }
    ).drop("ids", "decoded")


def vocabulary() -> tuple[str, str]:
    """Rank file and splitting pattern of the production vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@query("op3_byte_bpe")
def op3_byte_bpe(spark, sf_dir):
    return digests(table(spark, sf_dir, "documents").select("doc_id", "text"), *vocabulary())
