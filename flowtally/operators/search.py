"""Token-overlap search of queries in documents."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowtally.lineage import cut
from flowtally.operators.ordered import top_k_per_group

# a token of more documents or of more queries than this is heavy
LIGHT_ROWS = 10_000
# documents that are dealt to one task at least
CELL_ROWS = 10_000
# words that one round broadcasts, and words of documents that are dealt to one task, about
ROUND_WORDS = 2_000_000
TASK_WORDS = 125_000
# longest documents of a scope that set the floors
LONGEST = 60
# Fixed value: what parts words
SPACES = r"[\s\x1c-\x1f\x85\p{Z}]+"
# Bits of a lane and lanes of a long; the highest bit of a lane and of the long are spare
LANES = ((7, 9), (9, 7), (10, 6), (12, 5), (15, 4), (21, 3), (31, 2))


def _words(text: str) -> Column:
    """The distinct lower-cased words of a text."""
    return F.array_remove(F.array_distinct(F.split(F.lower(F.col(text)), SPACES)), "")


def _scope(salt: int) -> Column:
    """The scope as one number; hashes skip NULL, so NULL is told from other places by a flag."""
    names = ("tenant", "collection")
    return F.xxhash64(F.lit(salt), *(c for name in names for c in (F.col(name).isNull(), F.col(name)))).alias("scope")


def _keys(scope: Column, text: str) -> Column:
    """The distinct words of a text as numbers."""
    return F.transform(_words(text), lambda word: F.xxhash64(scope, word)).alias("keys")


def _lexicon(queries: DataFrame, docs: DataFrame, salt: int) -> DataFrame:
    """For each number how often its words are asked and held, and whether a second hash tells several words."""

    def split(texts: DataFrame, text: str, asked: int) -> DataFrame:
        words = texts.select(_scope(salt), _scope(salt + 1).alias("other"), F.explode_outer(_words(text)).alias("token"))
        # unlike explode, the outer form adds no filter that would split every text once more
        rows = words.where("token IS NOT NULL").select(F.xxhash64("scope", "token").alias("key"), F.xxhash64("other", "token").alias("other"))
        return rows.withColumns({"asked": F.lit(asked), "held": F.lit(1 - asked)})

    both = split(queries, "query", 1).unionByName(split(docs, "text", 0))
    return both.groupBy("key").agg(
        F.sum("asked").alias("asked"), F.sum("held").alias("held"), (F.min("other") != F.max("other")).alias("several")
    )


def _salt(queries: DataFrame, docs: DataFrame) -> tuple[int, int]:
    """A salt under which no two words share a number, and the rows of the heaviest word that is asked and held."""
    for salt in count(0, 2):
        met = F.when((F.col("asked") > 0) & (F.col("held") > 0), F.greatest("asked", "held"))
        # the cut removes what was shuffled, as many rows as there are words
        several, most = cut(_lexicon(queries, docs, salt).agg(F.max("several"), F.max(met))).first()
        if not several:
            return salt, most or 0
    raise AssertionError


def text_search(
    queries: DataFrame,
    docs: DataFrame,
    k: int = 5,
    *,
    light_rows: int = LIGHT_ROWS,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """Top ``k`` documents per query within its tenant and collection.

    The score is the share of the query's distinct lower-cased words that the
    document holds, to 4 decimals; scores of 0 are left out and ties go to the
    smaller ``seq``, then ``doc_id``.  Queries are (tenant, collection,
    query_id, query), documents (tenant, collection, doc_id, text, seq).  NULL
    tenants and collections are scopes of their own, a NULL or empty text has
    no words, repeated rows of documents are hits of their own, and rows that
    share a ``query_id`` share its ``k`` places.

    Words are compared as numbers, under a salt for which a second hash tells no
    two words of one number.  A word of more than ``light_rows`` documents or
    queries is heavy.  Without heavy words, words of queries are joined with
    those of documents.  Otherwise queries go in rounds of bounded numbers of
    words.  A round's words become masks of the queries that have them, which
    are broadcast; each document adds up the masks of its words, and so counts
    what it shares with some 60 queries at once.  Documents are dealt to tasks,
    at least ``cell_rows`` to each.  Only counts that reach a floor are looked
    at one by one: the ``k``-th best of a query among the longest documents of
    its scope.  Both ways count every pair in full.
    """
    k = max(1, int(k))
    salt, most = _salt(queries, docs)
    # row numbers are final with the cut; those of documents follow the order of ties
    ranked = docs.withColumn("seq", F.col("seq").cast("bigint")).orderBy("seq", "doc_id").withColumn("row", F.monotonically_increasing_id())
    asked = _cut_texts(queries.withColumn("q", F.monotonically_increasing_id()), "query", salt, "q", "query_id").withColumnRenamed("n", "m")
    known = _cut_texts(ranked, "text", salt, "row", "doc_id", "seq")
    if most <= light_rows:
        ours, theirs = asked.select("q", "m", F.explode("keys").alias("key")), known.select("row", F.explode("keys").alias("key"))
        best = _best(ours.join(theirs, "key").groupBy("q", "m", "row").agg(F.count(F.lit(1)).alias("c")), k)
    else:
        best = _by_rounds(asked, known, k, cell_rows)
    scored = best.join(asked.select("q", "query_id"), "q").join(known.select("row", "doc_id", "seq"), "row")
    out = scored.select("query_id", "doc_id", F.bround(F.col("c") / F.col("m"), 4).alias("score"), "seq")
    return top_k_per_group(out, ["query_id"], [F.col("score").desc(), "seq", "doc_id"], k)


def _cut_texts(texts: DataFrame, text: str, salt: int, *ids: str) -> DataFrame:
    """Texts that have words: ``ids``, the scope, the words as numbers and how many."""
    placed = texts.withColumn("scope", _scope(salt))
    made = cut(placed.select(*ids, "scope", _keys(F.col("scope"), text)))
    return made.withColumn("n", F.size("keys")).where("n > 0")


def _best(pairs: DataFrame, k: int) -> DataFrame:
    """The best ``k`` documents of each query row."""
    return top_k_per_group(pairs, ["q"], [F.bround(F.col("c") / F.col("m"), 4).desc(), "row"], k)


def _by_rounds(asked: DataFrame, known: DataFrame, k: int, cell_rows: int) -> DataFrame:
    """The best documents of each query; every round counts for its queries what each document shares with them."""
    docs, words, largest = known.agg(F.count(F.lit(1)), F.sum("n"), F.max("n")).first()
    tasks = max(1, min(-(-words // TASK_WORDS), -(-docs // max(1, cell_rows))))
    floors = cut(_floors(asked, known, k, largest))
    rounds, number = _rounds(floors, largest)
    slots = cut(
        floors.select("q", "m", "floor", number.alias("round"))
        .join(asked.select("q", "scope"), "q")
        .orderBy("round", "scope", "floor", "q")
        .select("q", "m", "floor", "round", F.monotonically_increasing_id().alias("at"))
    )
    found = []
    for n, (least, most) in enumerate(rounds):
        bits, lanes = _lanes(min(most, largest))
        here = slots.where(F.col("round") == n).withColumns(_places(bits * lanes))
        masks = _masks(asked.select("q", "keys").join(F.broadcast(here.select("q", "group", "bit")), "q"))
        # a document of fewer words reaches no floor of this round
        theirs = known.where(F.col("n") >= least).select("row", "keys").repartition(tasks, "row")
        found.append(cut(_best(_reached(_counts(theirs, "row", masks, bits, lanes), here, bits, lanes), k)))
    best = found[0]
    for more in found[1:]:
        best = best.unionByName(more)
    return best


def _floors(asked: DataFrame, known: DataFrame, k: int, largest: int) -> DataFrame:
    """For each query the number of common words below which no document can be among its best ``k``.

    It is the ``k``-th best count among the longest documents of the scope;
    beyond 10000 words some counts less have the same score.
    """
    order = [F.col("n").desc(), "row"]
    longest = top_k_per_group(known.select("scope", "row", "n", "keys"), ["scope"], order, LONGEST)
    at = F.row_number().over(Window.partitionBy("scope").orderBy(*order)) - 1
    longest = cut(longest.select("scope", at.alias("at"), F.col("n").alias("m"), "keys"))
    bits, lanes = _lanes(largest)
    parts = max(1, -(-(longest.agg(F.sum("m")).first()[0] or 0) // ROUND_WORDS))
    best = asked.select("q", "m", F.lit(1).alias("floor"))
    for n in range(parts):
        ours = longest.where(F.pmod("scope", F.lit(parts)) == n).withColumns(_places(bits * lanes))
        counts = _counts(asked.where(F.pmod("scope", F.lit(parts)) == n).select("q", "m", "keys"), "q", _masks(ours), bits, lanes)
        each = F.flatten(F.collect_list(F.expr(f"transform(sequence(0, {bits * lanes - 1}), bit -> {_count('bit', bits)})")))
        kth = counts.groupBy("q").agg(each.alias("each")).select("q", F.expr(f"get(sort_array(each, false), {k - 1})").alias("kth"))
        floor = F.greatest(F.col("floor"), F.ceil(F.col("kth") - F.col("m") / 10_000).cast("int"))
        best = best.join(kth, "q", "left").select("q", "m", floor.alias("floor"))
    return best


def _rounds(floors: DataFrame, largest: int) -> tuple[list[tuple[int, int]], Column]:
    """The least floor and the longest query of each round, and the number of a query's round.

    A round has queries of one width of lanes and of near floors; those of one
    floor that are too many are dealt by hash.
    """
    width = F.size(F.filter(F.lit([1 << (bits - 1) for bits, _ in LANES]), lambda most: most <= F.least("m", F.lit(largest))))
    place = width.cast("bigint") * (1 << 32) + F.col("floor")
    rounds: list[tuple[int, int]] = []
    starts, firsts, parts, held, last = [], [], [], 0, None
    sums = floors.groupBy(place.alias("place")).agg(F.min("floor"), F.sum("m"), F.max("m"))
    for at, floor, words, most in sums.orderBy("place").collect():
        if at >> 32 != last or held + words > ROUND_WORDS:
            many = -(-words // ROUND_WORDS)
            starts, firsts, parts = [*starts, at], [*firsts, len(rounds)], [*parts, many]
            rounds += [(floor, most)] * many
            # what is dealt by hash is joined by no other floor
            held, last = words if many == 1 else ROUND_WORDS, at >> 32
        else:
            held += words
            rounds[-1] = (rounds[-1][0], max(rounds[-1][1], most))
    at = F.size(F.filter(F.lit(starts), lambda start: start <= place)) - 1
    return rounds, F.get(F.lit(firsts), at) + F.pmod(F.xxhash64("q"), F.get(F.lit(parts), at))


def _lanes(most: int) -> tuple[int, int]:
    """Bits and lanes for counts up to ``most``."""
    return next(x for x in LANES if most < 1 << (x[0] - 1))


def _places(width: int) -> dict[str, Column]:
    """The group of ``at``, and its bit there."""
    return {"group": F.expr(f"at div {width}"), "bit": F.expr(f"CAST(at % {width} AS INT)")}


def _masks(ours: DataFrame) -> DataFrame:
    """For each word the groups of texts that have it, each with a mask of these texts."""
    words = ours.select("group", F.expr("shiftleft(1L, bit)").alias("one"), F.explode("keys").alias("key"))
    masks = words.groupBy("key", "group").agg(F.bit_or("one").alias("mask"))
    # bounded by ROUND_WORDS, or by one text
    return F.broadcast(masks.groupBy("key").agg(F.collect_list("group").alias("groups"), F.collect_list("mask").alias("masks")))


def _counts(texts: DataFrame, row: str, masks: DataFrame, bits: int, lanes: int) -> DataFrame:
    """How many words each text shares with each text of the masks, by group.

    Every ``bits``-th bit of a mask goes to the same long, which adds up ``lanes``
    texts side by side.
    """
    lane = [F.sum(F.expr(f"shiftrightunsigned(mask, {i}) & {_ones(bits, lanes)}L")).alias(f"s{i}") for i in range(bits)]
    met = texts.select(row, F.explode("keys").alias("key")).join(masks, "key").select(row, "masks", F.posexplode("groups").alias("i", "group"))
    summed = met.select(row, "group", F.expr("get(masks, i)").alias("mask")).groupBy(row, "group").agg(*lane)
    return summed.select(row, "group", F.array(*(f"s{i}" for i in range(bits))).alias("lanes"))


def _ones(bits: int, lanes: int) -> int:
    return sum(1 << (bits * j) for j in range(lanes))


def _count(bit: str, bits: int) -> str:
    """The count of one text, taken from its lane."""
    return f"CAST(shiftrightunsigned(get(lanes, {bit} % {bits}), CAST({bits} * ({bit} div {bits}) AS INT)) & {(1 << bits) - 1}L AS INT)"


def _reached(counts: DataFrame, here: DataFrame, bits: int, lanes: int) -> DataFrame:
    """Query, document and number of common words wherever it reaches the query's floor."""
    ones, half = _ones(bits, lanes), 1 << (bits - 1)
    members = here.groupBy("group").agg(
        F.min("bit").alias("first"),
        F.min("floor").alias("low"),
        F.sort_array(F.collect_list(F.struct("bit", "q", "m", "floor"))).alias("members"),
    )
    # what reaches the least floor of the group carries into the spare bit of its lane
    any_lane = " | ".join(f"((get(lanes, {i}) + {ones}L * ({half} - low)) & {ones * half}L)" for i in range(bits))
    near = counts.join(F.broadcast(members), "group").where(f"({any_lane}) != 0")
    apart = near.select("row", "first", "members", "lanes", F.explode(F.lit(list(range(bits * lanes)))).alias("bit"))
    pairs = apart.select("row", F.expr("get(members, bit - first)").alias("member"), F.expr(_count("bit", bits)).alias("c"))
    return pairs.where("c >= member.floor").select("member.q", "member.m", "row", "c")
