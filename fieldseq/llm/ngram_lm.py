"""Language-model scores from Elias-Fano n-gram tries, one per shard of contexts.

Every predicted word and its two predecessors form an event; events go to the shard of
the word in the middle, which sees everything said after that word. A shard counts the
events of training texts, builds its trie, scores its events and returns sums per text.
Contexts of a word too frequent for one shard are dealt by the word before it; what
follows that word is counted over all parts first and sent to each of them. The
unigram level has every word's own count: those of words that make up at least a
millionth of all tokens (so at most a million) are broadcast, those of the others are
joined and sent to the shards that ask for them. It is discounted like the others; below
it every known word and the one class of all unseen words have equal shares.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldseq.llm.base import query, shuffle_width, stored, table
from fieldseq.llm.elias_fano import Dealt, Trie, coded, find, log10_of
from fieldseq.llm.language import groups, is_held_out
from fieldseq.llm.words import mix, text_buffers, word_spans

GROUP_BYTES, GROUP_DOCS = 4 << 20, 30_000
SHARD_BYTES, CONTEXT_TOKENS, PARTS = 10 << 20, 1_000_000, 8
LEAST_SHARE, DISCOUNT = 1e-6, 0.75
PACK_ROWS = 200_000
_BEGIN, _END = np.uint64(1), np.uint64(2)
_TRAIN = 0x8000


def _text_groups(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Range of texts, and hashed words and text index of their words."""
    _, offsets = text_buffers(texts)
    for a0, b0 in groups(offsets, GROUP_BYTES):
        for a in range(a0, b0, GROUP_DOCS):
            b = min(a + GROUP_DOCS, b0)
            parts = list(word_spans(texts.slice(a, b - a)))
            word, doc = (np.concatenate([p[i] for p in parts]) for i in range(2)) if parts \
                else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            yield a, b, np.maximum(word, np.uint64(3)), doc


def _kinds(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As `np.unique` with the inverse, by hashing: only the kinds are sorted, which are few."""
    codes, kinds = pd.factorize(values)
    order = np.argsort(kinds)
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    return kinds[order], rank[codes]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, word, _ in _text_groups(batch.column(0)):
            kinds, count = np.unique(word, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(kinds.astype(np.int64)), pa.array(count)], ["word", "n"])


class Unigrams:
    """Counts of frequent words, most frequent first, and the share of words never seen."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, n_texts: int, total: int,
                 distinct: int) -> None:
        order = np.lexsort((words, -counts))
        self.words, self.counts = words[order], counts[order]
        self.total, self.distinct, self.n_texts = total, distinct, n_texts
        self.context_tokens = CONTEXT_TOKENS  # workers get the driver's value
        self.rank = np.argsort(self.words)
        self.sorted = self.words[self.rank]
        self.codes = self.codes_of(self.counts)
        self.unseen = self.codes_of(np.zeros(1))[0]

    def codes_of(self, counts: np.ndarray) -> np.ndarray:
        """Codes of the unigram probabilities of words with these counts; 0 is the unseen class."""
        if not self.total:  # nothing known but the end of a text
            return coded(np.full(len(counts), 0.5))
        even = DISCOUNT * self.distinct / (self.distinct + 1)
        return coded((np.maximum(counts - DISCOUNT, 0) + even) / self.total)

    def any_dealt(self) -> bool:
        return max(self.n_texts, int(self.counts.max())) > self.context_tokens

    def number(self, words: np.ndarray) -> np.ndarray:
        """Place of each word among the frequent ones, -1 for others."""
        at, known = find(self.sorted, words)
        return np.where(known, self.rank[at], -1)


def count_unigrams(docs: DataFrame, least_share: float = LEAST_SHARE
                   ) -> tuple[Unigrams, DataFrame | None]:
    """Count all words of the training texts (column `train`).

    Only the frequent words come back; the others are (word, n) in a stored table, None
    when there are none.
    """
    learned = docs.filter("train")
    counts = stored(learned.select("text").mapInArrow(_count_words, "word long, n long")
                    .groupBy("word").agg(F.sum("n").alias("n")), "word_counts")
    n_texts = learned.count()
    sums = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    total, distinct = (sums.n or 0) + n_texts, sums.v + (n_texts > 0)
    often = F.col("n") >= F.lit(least_share * total)  # at most 1 / least_share words
    frequent = counts.filter(often).toPandas()
    rare = counts.filter(~often) if len(frequent) < sums.v else None
    return Unigrams(np.append(frequent["word"].to_numpy(np.int64).view(np.uint64), (_END, _BEGIN)),
                    np.append(frequent["n"].to_numpy(np.int64), (n_texts, 0)), docs.count(),
                    total, distinct), rare


def _press(values: np.ndarray) -> bytes:
    """Byte planes, compressed, after their length."""
    planes = values.view(np.uint8).reshape(len(values), -1).T.tobytes() if len(values) else b""
    return np.int64(len(values)).tobytes() + pa.compress(planes, "zstd", asbytes=True)


def _unpress(data: bytes, kind: type) -> np.ndarray:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    if not n:
        return np.zeros(0, kind)
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data[8:], n * width, "zstd"), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, n).T).view(kind).ravel()


_SENT = ["shard", "batch", "often", "words", "w1", "w2", "w3", "at", "home", "counts"]
_SENT_SQL = ("shard int, batch long, often binary, words binary, w1 binary, w2 binary, "
             "w3 binary, at binary, home binary, counts binary")
_HOME = -1


def _context(before: np.ndarray, word: np.ndarray, count: np.ndarray, tokens: int) -> np.ndarray:
    """Shard key of a word in the middle; very frequent ones are dealt by what is before."""
    parts = np.maximum(1, -(-count // tokens)).astype(np.uint64)
    dealt = mix(word + (mix(before) % parts + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    return np.where(parts > 1, dealt, word)


class _Group:
    """Events of some texts: words by number of kind (frequent ones first), owner and shard."""

    def __init__(self, ids: np.ndarray, word: np.ndarray, doc: np.ndarray, uni: Unigrams,
                 shards: int) -> None:
        n = len(ids)
        self.per_doc = np.bincount(doc, minlength=n)
        # the words of each text, then its end
        now = np.full(len(word) + n, _END)
        now[np.arange(len(word)) + doc] = word
        self.owner = np.repeat(np.arange(n, dtype=np.int32), self.per_doc + 1)
        heads = np.concatenate(([0], np.cumsum(self.per_doc + 1)))[:-1]
        kinds, w3 = _kinds(np.append(now, _BEGIN))
        often = uni.number(kinds)
        count = np.where(often >= 0, uni.counts[often], -1)
        # numbers of kinds: frequent ones first, most frequent first
        order = np.lexsort((kinds, np.where(often >= 0, often, len(uni.words))))
        back = np.empty(len(order), np.int32)
        back[order] = np.arange(len(order), dtype=np.int32)
        kinds, often, count = (x[order] for x in (kinds, often, count))
        self.kinds, self.often, self.count = kinds, often, count
        w3 = back[w3]
        begin, w3 = w3[-1], w3[:-1]
        w2 = np.concatenate(([begin], w3[:-1]))
        w2[heads] = begin
        w1 = np.concatenate(([begin], w2[:-1]))
        w1[heads] = begin
        self.w1, self.w2, self.w3 = w1, w2, w3
        before = kinds[w1]
        before[heads] = mix(ids.astype(np.uint64))
        self.many = np.where(kinds == _BEGIN, uni.n_texts, np.maximum(count, 0))
        context = _context(before, kinds[w2], self.many[w2], uni.context_tokens)
        self.shard = (mix(context) % np.uint64(shards)).astype(np.int32)


def _events(shards: int, shared, dealt: bool = False):
    """Packed events by shard and the sums of each batch; with `dealt` only events of dealt contexts."""
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uni: Unigrams = shared.value
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            train = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for a, b, word, doc in _text_groups(batch.column(1)):
                n = b - a
                g = _Group(ids[a:b], word, doc, uni, shards)
                kinds, often, count, shard = g.kinds, g.often, g.count, g.shard
                owner, w1, w2, w3 = g.owner, g.w1, g.w2, g.w3
                if dealt:
                    shard = np.where((g.many > uni.context_tokens)[w2], shard, shards)
                # frequent words are counted here, the others where their contexts are
                base = np.bincount(owner, np.where(count >= 0, np.log10(np.maximum(count, 0) + 0.5), 0.0)[w3], n)
                known = np.bincount(owner, (count > 0)[w3], n)
                home = np.concatenate((ids[a:b], g.per_doc + 1, known.astype(np.int64))).tobytes() \
                    + base.tobytes()
                if not dealt:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([_HOME], pa.int32()), pa.array([number]),
                         *[pa.nulls(1, pa.binary())] * 6, pa.array([home], pa.binary()),
                         pa.nulls(1, pa.binary())], _SENT)
                order = np.lexsort((w2, shard))
                cut = np.searchsorted(shard[order], np.arange(shards + 1))
                at = np.where(train[a:b][owner], owner | _TRAIN, owner).astype(np.uint16)
                rows: list[list] = []
                slot = np.zeros(len(kinds), np.int64)
                for s in np.flatnonzero(np.diff(cut)):
                    take = order[cut[s]:cut[s + 1]]
                    used = np.zeros(len(kinds), bool)
                    used[w1[take]] = used[w2[take]] = used[w3[take]] = True
                    local = np.flatnonzero(used)
                    slot[local] = np.arange(len(local))
                    split = int((often[local] >= 0).sum())
                    kind = np.uint16 if len(local) < 65536 else np.uint32
                    rows.append([s, _press(np.diff(often[local[:split]], prepend=0).astype(np.uint32)),
                                 _press(np.diff(kinds[local[split:]], prepend=np.uint64(0))),
                                 *[_press(slot[x[take]].astype(kind)) for x in (w1, w2, w3)],
                                 _press(at[take])])
                if not rows:
                    continue
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], pa.int32()), pa.array([number] * len(rows)),
                     *[pa.array(c, pa.binary()) for c in columns[1:]],
                     *[pa.nulls(len(rows), pa.binary())] * 2], _SENT)
                number += 1
    return apply


def _asked(shards: int, shared):
    """(shard, word): the words that are not frequent and are predicted in a shard."""
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uni: Unigrams = shared.value
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for a, b, word, doc in _text_groups(batch.column(1)):
                g = _Group(ids[a:b], word, doc, uni, shards)
                rare = np.flatnonzero(g.often[g.w3] < 0)
                pair = np.unique(g.shard[rare].astype(np.int64) * len(g.kinds) + g.w3[rare])
                yield pa.RecordBatch.from_arrays(
                    [pa.array((pair // len(g.kinds)).astype(np.int32)),
                     pa.array(g.kinds[pair % len(g.kinds)].astype(np.int64))], ["shard", "word"])
    return apply


def _pairs(shared):
    """(shard, context, word, n): for each pair of a dealt context how many words stand before it.

    That is in training, and in this shard's parts; a word before is in one part only, so
    sums over shards are exact. Nothing stands before the first word of a text: texts are
    counted for it. Pairs only asked for have 0.
    """
    def apply(rows: pa.Table) -> pa.Table:
        shard = rows["shard"][0].as_py()
        _, kinds, _, _, (w1, w2, w3), at, _ = _unpacked(rows, shared.value)
        train = (np.concatenate(at) & _TRAIN) > 0
        pair, inverse = np.unique(w2.astype(np.int64) * len(kinds) + w3, return_inverse=True)
        triples = np.unique((w1.astype(np.int64) * len(pair) + inverse)[train])
        context = kinds[pair // len(kinds)]
        n = np.where(context == _BEGIN, np.bincount(inverse[train], minlength=len(pair)),
                     np.bincount(triples % len(pair), minlength=len(pair)))
        return pa.table([pa.array(np.full(len(pair), shard, np.int32)), pa.array(context.astype(np.int64)),
                         pa.array(kinds[pair % len(kinds)].astype(np.int64)), pa.array(n)],
                        ["shard", "context", "word", "n"])
    return apply


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, context or 0, word, n) as one row of events' form per shard and many rows."""
    held: list[pa.RecordBatch] = []

    def flush() -> pa.RecordBatch:
        shard, context, word, n = (np.concatenate([b.column(i).to_numpy() for b in held])
                                   for i in range(4))
        held.clear()
        order = np.lexsort((word, context, shard))
        shard, n = shard[order], n[order]
        context, word = (x[order].astype(np.uint64) for x in (context, word))
        first = np.append(np.flatnonzero(np.diff(shard, prepend=-1)), len(shard))
        cuts = list(zip(first, first[1:]))
        contexts, words = ([_press(np.diff(x[a:b], prepend=np.uint64(0))) for a, b in cuts]
                           for x in (context, word))
        none = pa.nulls(len(cuts), pa.binary())
        return pa.RecordBatch.from_arrays(
            [pa.array(shard[first[:-1]], pa.int32()), pa.nulls(len(cuts), pa.int64()), none,
             pa.array(words, pa.binary()), none, pa.array(contexts, pa.binary()), *[none] * 3,
             pa.array([_press(n[x:y]) for x, y in cuts], pa.binary())], _SENT)
    for batch in batches:
        if len(batch):
            held.append(batch)
        if sum(map(len, held)) >= PACK_ROWS:
            yield flush()
    if held:
        yield flush()


def _unpacked(rows: pa.Table, uni: Unigrams):
    """Words of a shard (hash, number, log10 of the unigram probability), its events and sent pairs."""
    sent = pc.is_valid(rows["counts"])
    asked, rows = rows.filter(sent), rows.filter(pc.invert(sent))
    often, rare, first = [], [], [0]
    for i in range(len(rows)):
        often.append(uni.words[np.cumsum(_unpress(rows["often"][i].as_py(), np.uint32), dtype=np.int64)])
        rare.append(np.cumsum(_unpress(rows["words"][i].as_py(), np.uint64), dtype=np.uint64))
        first.append(first[-1] + len(often[-1]) + len(rare[-1]))
    both = np.concatenate([x for pair in zip(often, rare) for x in pair])
    kinds, slot = _kinds(both)
    number = uni.number(kinds)
    codes = np.where(number >= 0, uni.codes[number], uni.unseen)
    pairs = [np.zeros((3, 0), np.int64)]
    for i in range(len(asked)):
        context, words = (np.cumsum(_unpress(asked[x][i].as_py(), np.uint64), dtype=np.uint64)
                          for x in ("w2", "words"))
        n, single = _unpress(asked["counts"][i].as_py(), np.int64), context == 0
        codes[find(kinds, words[single])[0]] = uni.codes_of(n[single])
        pairs.append(np.stack((find(kinds, context[~single])[0], find(kinds, words[~single])[0], n[~single])))
    events = []
    for name in ("w1", "w2", "w3"):
        parts = []
        for i in range(len(rows)):
            kind = np.uint16 if first[i + 1] - first[i] < 65536 else np.uint32
            parts.append(slot[first[i]:first[i + 1]][_unpress(rows[name][i].as_py(), kind)])
        events.append(np.concatenate(parts))
    at = [_unpress(x.as_py(), np.uint16) for x in rows["at"]]
    return rows["batch"], kinds, number, log10_of(codes), events, at, np.concatenate(pairs, axis=1)


def _dealt(kinds: np.ndarray, contexts: np.ndarray, pairs: np.ndarray, totals: np.ndarray) -> Dealt:
    """Values over all parts of those of a shard's contexts (ordered) that are dealt.

    The first word of a text has one word before it, BEGIN, so both levels come from its pairs.
    """
    at, is_dealt = find(totals[0], kinds[contexts].astype(np.int64))
    w2, at = np.flatnonzero(is_dealt), at[is_dealt]
    total, n_words = totals[1][at], totals[2][at]
    first = kinds[contexts[w2]] == _BEGIN
    place, mine = find(contexts, pairs[0])
    _, word, n = pairs[:, mine]
    place = place[mine]
    begins = kinds[contexts[place]] == _BEGIN
    return Dealt(w2, np.where(first, n_words, total), n_words, place, word, np.where(begins, 1, n),
                 w2[first], total[first], n_words[first], word[begins], n[begins])


def _score_shard(shared, whole_contexts):
    """Count, build tries, score; per batch and text the sums of this shard's events.

    The shard is worked off in parts of whole contexts, each with a trie of its own, so
    only one part is spread out in memory.
    """
    def apply(rows: pa.Table) -> pa.Table:
        names = ["batch", "at", "known", "base", "score", "home"]
        if rows["shard"][0].as_py() == _HOME:
            none = pa.nulls(len(rows), pa.binary())
            return pa.table([rows["batch"], none, none, none, none, rows["home"]], names)
        uni: Unigrams = shared.value
        batches, kinds, number, low, (w1, w2, w3), at, pairs = _unpacked(rows, uni)
        del rows
        width = len(kinds)
        uses = np.bincount(w2[(np.concatenate(at) & _TRAIN) > 0], minlength=width)
        starts = np.concatenate(([0], np.cumsum([int((x & 0x7FFF).max()) + 1 for x in at])))
        spot = np.concatenate([(x & 0x7FFF).astype(np.int32) + np.int32(s) for x, s in zip(at, starts)])
        train = np.concatenate(at) & _TRAIN > 0
        n = int(starts[-1])
        found, score, base, known = np.zeros(n, bool), np.zeros(n), np.zeros(n), np.zeros(n, np.uint32)
        found[spot] = True
        own = np.where(number < 0, np.log10(uses + 0.5), 0.0)
        whole = (1 << 63) // max(width * width, 1)  # contexts a 64-bit key has room for
        for part in range(PARTS):
            mine = np.flatnonzero(w2 % PARTS == part)
            if not len(mine):
                continue
            a, b, c = w1[mine].astype(np.int64), w2[mine], w3[mine]
            contexts, context = _kinds(b)
            if len(contexts) > whole:
                raise ValueError("shard too wide for its keys: lower SHARD_BYTES")
            key, inverse = np.unique((context * width + a) * width + c, return_inverse=True)
            seen = np.bincount(inverse, train[mine], len(key))
            d3, d12 = key % width, key // width
            d1, d2 = d12 % width, d12 // width
            dealt = _dealt(kinds, contexts, pairs, whole_contexts.value)
            if len(dealt.first):  # texts begin with the same context in all parts
                begin = np.flatnonzero(d2 == dealt.first[0])
                n_texts = np.zeros(width, np.int64)
                n_texts[dealt.first_word] = dealt.first_count
                seen[begin] = n_texts[d3[begin]]
            kept = np.flatnonzero(seen)
            trie = Trie(d1[kept], d2[kept], d3[kept], seen[kept], 10.0 ** low, width, DISCOUNT, dealt)
            value = trie.log10(d1, d2, d3, low)[inverse]
            trie.close()
            score += np.bincount(spot[mine], value, n)
            base += np.bincount(spot[mine], own[b], n)
            known += np.bincount(spot[mine], ((number < 0) & (uses > 0))[b], n).astype(np.uint32)
        parts = [np.flatnonzero(found[x:y]) for x, y in zip(starts, starts[1:])]
        return pa.table([
            batches,
            pa.array([_press(p.astype(np.uint16)) for p in parts], pa.binary()),
            pa.array([_press(known[x + p]) for x, p in zip(starts, parts)], pa.binary()),
            pa.array([_press(base[x + p]) for x, p in zip(starts, parts)], pa.binary()),
            pa.array([_press(score[x + p]) for x, p in zip(starts, parts)], pa.binary()),
            pa.nulls(len(parts), pa.binary())], names)
    return apply


def _sum_batch(rows: pa.Table) -> pa.Table:
    home = next(x for x in rows["home"] if x.is_valid).as_py()
    n = len(home) // 32
    ids, tokens, known = np.frombuffer(home, np.int64, 3 * n).reshape(3, n)
    known = known.copy()
    base, score = np.frombuffer(home, np.float64, n, 24 * n).copy(), np.zeros(n)
    for i in range(len(rows)):
        if rows["at"][i].is_valid:
            at = _unpress(rows["at"][i].as_py(), np.uint16)
            known[at] += _unpress(rows["known"][i].as_py(), np.uint32)
            base[at] += _unpress(rows["base"][i].as_py(), np.float64)
            score[at] += _unpress(rows["score"][i].as_py(), np.float64)
    return pa.table([pa.array(x) for x in (ids, tokens, known, base, score)],
                    ["doc_id", "n_tokens", "n_known", "base", "score"])


def score_texts(docs: DataFrame, discount_share: float = LEAST_SHARE) -> DataFrame:
    """Scores of all texts under a trigram model of those with `train`.

    `docs` has doc_id (long), text and train (boolean) and should be a table scan, whose
    tasks see the same rows when they are run again. Returns doc_id, n_tokens, n_known,
    train_tokens, base_score and score (both log10) per row. Null texts are empty and
    consist of their end; repeated rows are scored, and learned, as often as they occur.
    Without training texts all words have the same unigram share. Every unseen word has the
    probability of their class. `discount_share` says which counts are broadcast; scores do
    not depend on it.
    """
    spark = docs.sparkSession
    unigrams, rare = count_unigrams(docs, discount_share)
    shared = spark.sparkContext.broadcast(unigrams)  # at most 1 / discount_share words
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(shuffle_width(spark), -(-size // SHARD_BYTES))
    docs = docs.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("doc_id"), "text", "train")
    sent = docs.mapInArrow(_events(shards, shared), _SENT_SQL)
    counted, totals = [], np.zeros((3, 0), np.int64)
    if rare is not None:
        asked = docs.mapInArrow(_asked(shards, shared), "shard int, word long").distinct()
        counted.append(asked.join(rare, "word").select("shard", F.lit(0).cast("long").alias("context"),
                                                       "word", "n"))
    if unigrams.any_dealt():
        pairs = stored(docs.mapInArrow(_events(shards, shared, True), _SENT_SQL).groupBy("shard").applyInArrow(
            _pairs(shared), "shard int, context long, word long, n long"), "dealt_pairs")
        over_all = pairs.groupBy("context", "word").agg(F.sum("n").alias("n")).filter("n > 0")
        counted.append(pairs.drop("n").join(over_all, ["context", "word"])
                       .select("shard", "context", "word", "n"))
        totals = over_all.groupBy("context").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).orderBy(
            "context").toPandas().to_numpy(np.int64).T  # at most train_tokens / CONTEXT_TOKENS and BEGIN
    for rows in counted:
        sent = sent.unionByName(rows.mapInArrow(_packed, _SENT_SQL))
    where = F.when(F.col("shard") == _HOME, F.pmod("batch", F.lit(shards))).otherwise(F.lit(-1))
    scored = sent.groupBy("shard", where.alias("_at")).applyInArrow(
        _score_shard(shared, spark.sparkContext.broadcast(totals)),
        "batch long, at binary, known binary, base binary, score binary, home binary")
    sums = scored.groupBy("batch").applyInArrow(
        _sum_batch, "doc_id long, n_tokens long, n_known long, base double, score double")
    norm = float(np.log10(unigrams.total + 0.5 * (unigrams.distinct + 1)))
    return sums.select(F.nullif("doc_id", F.lit(_NO_ID)).alias("doc_id"), "n_tokens", "n_known",
                       F.lit(unigrams.total).cast("long").alias("train_tokens"),
                       (F.col("base") - F.col("n_tokens") * norm).alias("base_score"), "score")


_NO_ID = -(1 << 63)  # stands for a null doc_id on the way


@query("op6_ngram_lm_scores")
def op6_ngram_lm_scores(spark, sf_dir: str) -> DataFrame:
    held = F.coalesce(is_held_out(5, 1), F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (~held).alias("train"))
    return score_texts(docs).select(
        "doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score",
        (F.col("score") / F.col("n_tokens")).alias("token_score"))
