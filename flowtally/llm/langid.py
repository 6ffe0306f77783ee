"""Language identification: a linear-chain conditional random field over the words of a text."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtally.llm.base import column, free_names, hash_bound, query, table

# each of the feature families below hashes into this many weights
FAMILY = 1 << 16
DIMS = 3 * FAMILY
# a chain is a line, in stretches of this many words
STRETCH = 256
# words whose marginals are computed at once; bounds memory whatever a text's length
GROUP = 100_000
# tokens whose emission scores a task keeps; it starts afresh beyond that
KEPT = 400_000
# new words whose features are laid out at once; a word has about thirty
LEARNED = 4096
_ODD = np.uint64(0x9E3779B97F4A7C15)


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``(feature ids, index of the word each belongs to)``, ordered by word.

    Byte bigrams and trigrams with the word's borders marked, prefixes of 2 to
    4 and suffixes of 2 to 5 bytes, and the word itself, made for all words at
    once on their joined bytes.
    """
    coded = [f"^{w}$".encode("utf-8", "surrogatepass") for w in words]
    size = np.fromiter(map(len, coded), np.int64, len(coded))
    raw = np.frombuffer(b"".join(coded) + b"\0\0\0\0", np.uint8).astype(np.uint64)
    first = np.concatenate(([0], np.cumsum(size)[:-1]))
    end = first + size
    owner = np.repeat(np.arange(len(coded)), size)
    place = np.arange(len(owner))
    room = end[owner] - place
    ids, who = [], []

    def hashed(values, salt):
        return ((values * np.uint64(8) + np.uint64(salt)) * _ODD >> np.uint64(48)).astype(np.int64)

    two = raw[:-1] << np.uint64(8) | raw[1:]
    three = two[:-1] << np.uint64(8) | raw[2:]
    at = place[room >= 2]
    ids.append(two[at].astype(np.int64))
    who.append(owner[at])
    at = place[room >= 3]
    ids.append(FAMILY + hashed(three[at], 0))
    who.append(owner[at])
    for n in (2, 3, 4, 5):
        for salt, begin in ((1, first), (2, end - n)):
            if n == 5 and salt == 1:
                continue
            has = np.nonzero(size > n)[0]
            value = np.zeros(len(has), np.uint64)
            for i in range(n):
                value = value << np.uint64(8) | raw[begin[has] + i]
            ids.append(2 * FAMILY + hashed(value, salt))
            who.append(has)
    ids.append(2 * FAMILY + np.fromiter((crc32(c) % FAMILY for c in coded), np.int64, len(coded)))
    who.append(np.arange(len(coded)))
    ids, who = np.concatenate(ids), np.concatenate(who)
    order = np.argsort(who, kind="stable")
    return ids[order], who[order]


def clean(token: str) -> str:
    """The token in lower case with what is no letter cut from its ends; empty if it has no letter."""
    if token.isalpha():
        return token.lower()
    inside = [i for i, c in enumerate(token) if c.isalpha()]
    return token[inside[0] : inside[-1] + 1].lower() if inside else ""


@dataclass
class Crf:
    """Emission weights per hashed feature and lexicon, and a transition score per pair of labels."""

    labels: list[str]
    weights: np.ndarray = field(repr=False)
    lexicon: dict[str, int] = field(repr=False)
    transitions: np.ndarray = field(repr=False)

    def emissions(self, words: list[str]) -> np.ndarray:
        """A row of label scores for each word."""
        ids, who = word_features(words)
        scores = self.weights[ids]
        out = np.stack([np.bincount(who, scores[:, j], len(words)) for j in range(len(self.labels))], axis=1)
        known = [(i, self.lexicon[w]) for i, w in enumerate(words) if w in self.lexicon]
        if known:
            rows, labs = np.asarray(known).T
            out[rows] += self.weights[DIMS + labs]
        return out


def forward_backward(emit: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Label marginals of every word; ``emit`` holds the chains one after the other.

    Chains run side by side, longest first, and words are laid out by step, so
    that step t is one block.  Each word's best label scores 1, and blocks are
    rescaled every few steps, so nothing under- or overflows.
    """
    k = emit.shape[1]
    ones = np.ones((k, k))
    a = np.exp(transitions - transitions.max())
    order = np.argsort(-lengths, kind="stable")
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))[order]
    steps = int(lengths.max(initial=0))
    active = np.searchsorted(-lengths[order], -np.arange(steps), side="left")
    base = np.concatenate(([0], np.cumsum(active)))
    place = np.empty(base[-1], np.int64)
    for t in range(steps):
        place[base[t] : base[t + 1]] = starts[: active[t]] + t
    e = emit[place]
    e = np.exp(e - e.max(axis=1, keepdims=True))
    alpha, beta = np.empty_like(e), np.ones_like(e)
    alpha[: base[1] if steps else 0] = e[: base[1] if steps else 0]
    for t in range(1, steps):
        now = alpha[base[t - 1] : base[t - 1] + active[t]] @ a
        now *= e[base[t] : base[t + 1]]
        if t % 8 == 0:
            now /= now @ ones
        alpha[base[t] : base[t + 1]] = now
    for t in range(steps - 2, -1, -1):
        block = slice(base[t + 1], base[t + 2])
        now = (beta[block] * e[block]) @ a.T
        if t % 8 == 0:
            now /= now @ ones
        beta[base[t] : base[t] + active[t + 1]] = now
    alpha *= beta
    alpha /= alpha @ ones
    out = np.empty_like(alpha)
    out[place] = alpha
    return out


def train(samples: list[tuple[str, list[str]]], length: int = 24, epochs: int = 6, rate: float = 0.2, seed: int = 7) -> Crf:
    """Fit on ``(label, words)``.

    Half of the training chains are code-switched: two halves of differently
    labelled windows.  Maximises the conditional likelihood by AdaGrad; the
    gradients are the observed minus the forward-backward expected counts.
    """
    labels = sorted({lang for lang, _ in samples})
    k = len(labels)
    index = {lang: i for i, lang in enumerate(labels)}
    seen = Counter((w, index[lang]) for lang, words in samples for w in set(words))
    total = Counter()
    for (w, _), n in seen.items():
        total[w] += n
    lexicon = {w: lab for (w, lab), n in sorted(seen.items()) if n >= 5 and n >= 0.9 * total[w]}
    weights = np.zeros((DIMS + k + 1, k))
    transitions = np.zeros((k, k))
    crf = Crf(labels, weights, lexicon, transitions)
    if k < 2:
        return crf
    vocabulary: dict[str, int] = {}
    chains = []
    for lang, words in samples:
        ids = [vocabulary.setdefault(w, len(vocabulary)) for w in words]
        chains += [(ids[i : i + length], index[lang]) for i in range(0, len(ids), length)]
    flat, who = word_features(list(vocabulary))
    listed = np.array([(i, DIMS + lexicon[w]) for w, i in vocabulary.items() if w in lexicon], np.int64).reshape(-1, 2)
    flat, who = np.concatenate((flat, listed[:, 1])), np.concatenate((who, listed[:, 0]))
    order = np.argsort(who, kind="stable")
    flat = flat[order]
    sizes = np.bincount(who, minlength=len(vocabulary))
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    rng = np.random.default_rng(seed)
    grad_w, grad_t = np.full_like(weights, 1e-6), np.full_like(transitions, 1e-6)
    for _ in range(epochs):
        perm = rng.permutation(len(chains))
        for at in range(0, len(perm), 128):
            words, gold, lengths = [], [], []
            batch = [chains[i] for i in perm[at : at + 128]]
            for i, (ids, lab) in enumerate(batch):
                other, lab2 = batch[i - 1]
                cut = len(ids) // 2 if i % 2 and lab2 != lab else len(ids)
                tail = other[: len(ids) - cut]
                words += ids[:cut] + tail
                gold += [lab] * cut + [lab2] * len(tail)
                lengths.append(cut + len(tail))
            words, gold, lengths = np.asarray(words), np.asarray(gold), np.asarray(lengths)
            n = sizes[words]
            spread = np.repeat(offsets[words] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            used, owner = flat[spread], np.repeat(np.arange(len(words)), n)
            emit = np.add.reduceat(weights[used], np.concatenate(([0], np.cumsum(n)[:-1])), axis=0)
            marg = forward_backward(emit, lengths, transitions)
            diff = -marg
            diff[np.arange(len(gold)), gold] += 1
            rows = np.unique(used, return_inverse=True)
            g = np.stack([np.bincount(rows[1], diff[owner, j], len(rows[0])) for j in range(k)], axis=1)
            g -= 1e-3 * weights[rows[0]]
            grad_w[rows[0]] += g * g
            weights[rows[0]] += rate * g / np.sqrt(grad_w[rows[0]])
            # neighbours within a chain; the expected pair is read off the neighbours' marginals and the link
            first = np.ones(len(gold), bool)
            first[np.cumsum(lengths)[:-1]] = False
            first[0] = False
            right = np.nonzero(first)[0]
            if len(right):
                seen_pairs = np.bincount(gold[right - 1] * k + gold[right], minlength=k * k).reshape(k, k)
                pair = marg[right - 1][:, :, None] * np.exp(transitions)[None] * marg[right][:, None, :]
                gt = seen_pairs - (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
                gt = gt / len(right) - 1e-2 * transitions
                grad_t += gt * gt
                transitions += rate * gt / np.sqrt(grad_t)
    return crf


class Tagger:
    """Document scores from word marginals, with emissions kept per task."""

    def __init__(self, crf: Crf):
        self.crf = crf
        self._forget()

    def _forget(self) -> None:
        # token -> row of its emission scores; row 0 stands for tokens without a letter
        self.known: dict[str, int] = {}
        self.scores = np.zeros((1024, len(self.crf.labels)))
        self.used = 1

    def _learn(self, tokens: list[str]) -> None:
        words = [(t, w) for t in tokens if (w := clean(t)) or self.known.setdefault(t, 0)]
        if not words:
            return
        need = self.used + len(words)
        if need > len(self.scores):
            self.scores = np.concatenate((self.scores, np.zeros((max(need, 2 * len(self.scores)) - len(self.scores), self.scores.shape[1]))))
        for at in range(0, len(words), LEARNED):
            part = [w for _, w in words[at : at + LEARNED]]
            self.scores[self.used + at : self.used + at + len(part)] = self.crf.emissions(part)
        self.known.update(zip((t for t, _ in words), range(self.used, need), strict=True))
        self.used = need

    def _add(self, tokens, lengths, owners, sums, counts) -> None:
        """Add the marginals of these chains to their documents' sums."""
        if len(self.known) > KEPT:
            self._forget()
        new = sorted(set(tokens).difference(self.known))
        if new:
            self._learn(new)
        ids = np.fromiter(map(self.known.__getitem__, tokens), np.int64, len(tokens))
        chain = np.repeat(np.arange(len(lengths)), lengths)[ids > 0]
        ids = ids[ids > 0]
        if not len(ids):
            return
        size = np.bincount(chain, minlength=len(lengths))
        marg = forward_backward(self.scores[ids], size[size > 0], self.crf.transitions)
        who = np.asarray(owners)[chain]
        for j in range(marg.shape[1]):
            sums[:, j] += np.bincount(who, marg[:, j], len(sums))
        counts += np.bincount(who, minlength=len(counts))

    def predict(self, texts) -> tuple[list[str], list[float]]:
        """The label with the highest mean word marginal, and that mean; ``und`` and 0 without a letter."""
        k = len(self.crf.labels)
        if not k:
            return ["und"] * len(texts), [0.0] * len(texts)
        sums, counts = np.zeros((len(texts), k)), np.zeros(len(texts), np.int64)
        tokens, lengths, owners = [], [], []
        for doc, text in enumerate(texts):
            for line in (text or "").split("\n"):
                found = line.split()
                for at in range(0, len(found), STRETCH):
                    part = found[at : at + STRETCH]
                    tokens += part
                    lengths.append(len(part))
                    owners.append(doc)
                    if len(tokens) >= GROUP:
                        self._add(tokens, lengths, owners, sums, counts)
                        tokens, lengths, owners = [], [], []
        if tokens:
            self._add(tokens, lengths, owners, sums, counts)
        mean = sums / np.maximum(counts, 1)[:, None]
        best = mean.argmax(axis=1)
        langs = [self.crf.labels[b] if n else "und" for b, n in zip(best, counts, strict=True)]
        return langs, np.clip(mean.max(axis=1), 0, 1).tolist()


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, rows: int = 2000, words: int = 72, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Crf:
    """Train on at most ``rows`` labelled rows, those with the smallest hash of their id.

    Of each row one window of ``words`` words is used, at a place the hash
    chooses.  Both bounds are parameters; only these windows reach the driver.
    """
    pick = F.xxhash64(F.lit("fit"), F.col(id_col))
    known = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull())
    bound = hash_bound(known.select(pick.alias("pick")), rows)
    known = known.where((pick <= bound) & F.col(text_col).isNotNull() if bound is not None else F.lit(False))
    known = known.select(pick.alias("pick"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    parts = F.split("text", r"\s+")
    known = known.select("pick", "lang", parts.alias("w"))
    begin = F.pmod("pick", F.greatest(F.size("w") - words + 1, F.lit(1))).cast("int") + 1
    taken = known.select("pick", "lang", F.slice("w", begin, F.lit(words)).alias("w")).orderBy("pick", "lang", "w").limit(rows).collect()
    samples = [(r["lang"], [c for c in map(clean, r["w"]) if c]) for r in taken]
    return train([(lang, w) for lang, w in samples if w])


def predict(docs: DataFrame, crf: Crf, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; the model is broadcast, its size is fixed.

    Only the text is read by the model.  NULL, empty and letterless texts are
    ``und`` with score 0.  Columns of those names are replaced; every other
    column, whatever its type, is carried along unseen.
    """
    shared = docs.sparkSession.sparkContext.broadcast(crf)
    state: dict[str, Tagger] = {}

    @F.pandas_udf("struct<lang_pred string, score double>")
    def tag(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tagger = state.setdefault("tagger", Tagger(shared.value))
        for batch in texts:
            langs, scores = tagger.predict(batch.tolist())
            yield pd.DataFrame({"lang_pred": langs, "score": scores})

    kept = [column(c) for c in docs.columns if c not in ("lang_pred", "score")]
    (made,) = free_names(docs, "tag")
    tagged = docs.select(*kept, tag(column(text_col).cast("string")).alias(made))
    return tagged.select(*kept, f"{made}.lang_pred", f"{made}.score")


@query("op5_language_id")
def op5_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    crf = fit(docs.where(~held_out()))
    out = predict(docs.select("doc_id", "text"), crf)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
