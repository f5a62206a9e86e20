"""Language identification with character language models.

One interpolated Kneser-Ney model per language over the letters of lower-cased words.
All models share sorted hash arrays per order: an n-gram known to any language has a
row of log probabilities, a context a row of back-off weights. The language with the
lowest cross-entropy per character wins; a calibrated bound rejects texts that no
model explains.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldseq.llm.base import hash_sample, query, stored, table
from fieldseq.llm.words import mix, text_buffers

ORDER, SAMPLE_DOCS, SAMPLE_CHARS = 5, 150, 200_000
TOLERANCE = 12  # deviations above a language's usual cost that are still its texts
GROUP_BYTES = 1 << 20
UNKNOWN = "und"
_PLANES = 0x40000
_LANES = mix(np.arange(101, 117, dtype=np.uint64)) | np.uint64(1)
_BEGIN, _END = 1, 2
_tables: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    """For each code point its lower-cased letter, 0 for other characters."""
    if "letters" not in _tables:
        out = np.zeros(_PLANES, np.uint32)
        for c in range(_PLANES):
            s = chr(c)
            if s.isalpha():
                low = s.lower()
                out[c] = ord(low) if len(low) == 1 else c
        _tables["letters"] = out
    return _tables["letters"]


def groups(offsets: np.ndarray, most: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most `most` bytes together; a longer text comes alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


@dataclass
class Words:
    """Letter words of a group of texts: padded symbols of distinct words, and occurrences."""

    symbols: np.ndarray  # begin mark, letters, end mark of each distinct word
    place: np.ndarray  # position of each symbol in its word, the begin mark at 0
    owner: np.ndarray  # distinct word each symbol belongs to
    size: np.ndarray  # symbols to predict per distinct word
    word: np.ndarray  # distinct word of each occurrence
    doc: np.ndarray  # text of each occurrence


def letter_words(raw: np.ndarray, offsets: np.ndarray) -> Words | None:
    """Words of the texts at `offsets`; None when no text has a letter."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    part = raw[lo:hi]
    heads = (part & 0xC0) != 0x80
    points = np.frombuffer(part.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    low = _letters()[np.minimum(points, _PLANES - 1)]
    at = np.flatnonzero(heads)
    doc = np.searchsorted(offsets, at + lo, "right") - 1
    letter = low > 0
    if not letter.any():
        return None
    fresh = letter.copy()
    fresh[1:] &= ~letter[:-1] | (doc[1:] != doc[:-1])
    starts = np.flatnonzero(fresh)
    letters = np.flatnonzero(letter)
    of = np.cumsum(fresh)[letters] - 1
    first = np.flatnonzero(fresh[letters])
    size = np.diff(np.append(first, len(letters)))
    place = np.arange(len(letters)) - np.repeat(first, size)
    powers = np.cumprod(np.concatenate(([np.uint64(1)], np.full(int(size.max()), _LANES[0]))))
    hashes = np.add.reduceat(mix(low[letters].astype(np.uint64)) * powers[place], first)
    _, sample, word = np.unique(hashes + size.astype(np.uint64), return_index=True,
                                return_inverse=True)
    chosen = size[sample]
    total = chosen + 2
    begin = np.concatenate(([0], np.cumsum(total)))[:-1]
    owner = np.repeat(np.arange(len(sample)), total)
    inside = np.arange(len(owner)) - np.repeat(begin, total)
    source = np.repeat(first[sample], total) + inside - 1
    symbols = low[letters][np.clip(source, 0, len(letters) - 1)].astype(np.uint64)
    symbols[begin] = _BEGIN
    symbols[begin + total - 1] = _END
    del of
    return Words(symbols, inside, owner, chosen + 1, word, doc[starts])


def gram_hashes(words: Words, order: int) -> list[np.ndarray]:
    """Hashes of the 1- to `order`-grams ending at each symbol (invalid where they begin earlier)."""
    value = mix(words.symbols)
    out = [value * _LANES[1]]
    for k in range(1, order):
        shifted = np.concatenate((np.zeros(k, np.uint64), value[:-k])) if len(value) > k \
            else np.zeros(len(value), np.uint64)
        out.append(out[-1] + shifted * _LANES[k + 1])
    return out


@dataclass
class Model:
    """Character models of several languages in sorted hash arrays."""

    languages: list[str]
    grams: list[np.ndarray] = field(default_factory=list)
    log_p: list[np.ndarray] = field(default_factory=list)
    contexts: list[np.ndarray] = field(default_factory=list)
    log_back: list[np.ndarray] = field(default_factory=list)
    unseen: np.ndarray | None = None
    sharpness: float = 1.0
    usual: np.ndarray | None = None  # cross-entropy per language on held-back texts
    spread: np.ndarray | None = None  # its deviation between texts
    noise: np.ndarray | None = None  # deviation of a single character's cost

    def word_costs(self, words: Words) -> np.ndarray:
        """Negative log2 probability of each distinct word, per language."""
        order = len(self.grams)
        hashes = gram_hashes(words, order)
        at = np.flatnonzero(words.place > 0)
        cost = np.zeros((len(at), len(self.languages)), np.float32)
        open_ = np.arange(len(at))
        for k in range(order, 0, -1):
            able = words.place[at[open_]] + 1 >= k
            here, wait = open_[able], open_[~able]
            asked = hashes[k - 1][at[here]]
            slot = np.searchsorted(self.grams[k - 1], asked)
            slot[slot == len(self.grams[k - 1])] = 0
            hit = self.grams[k - 1][slot] == asked
            cost[here[hit]] -= self.log_p[k - 1][slot[hit]]
            missed = here[~hit]
            if k > 1 and len(missed):
                asked = hashes[k - 2][at[missed] - 1]
                slot = np.searchsorted(self.contexts[k - 1], asked)
                slot[slot == len(self.contexts[k - 1])] = 0
                known = self.contexts[k - 1][slot] == asked
                cost[missed[known]] -= self.log_back[k - 1][slot[known]]
            open_ = np.concatenate((missed, wait))
        cost[open_] -= self.unseen
        first = np.searchsorted(words.owner[at], np.arange(len(words.size)))
        return np.add.reduceat(cost.astype(np.float64), first, axis=0)

    def text_costs(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character of each text and language, and characters counted."""
        n = len(offsets) - 1
        words = letter_words(raw, offsets) if self.languages else None
        if words is None:
            return np.zeros((n, max(1, len(self.languages)))), np.zeros(n)
        costs = self.word_costs(words)
        total = np.stack([np.bincount(words.doc, costs[words.word, i], n)
                          for i in range(len(self.languages))], axis=1)
        size = np.bincount(words.doc, words.size[words.word], n)
        return total / np.maximum(size, 1)[:, None], size

    def decide(self, cost: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language index, its calibrated probability, and whether it is rejected."""
        best = cost.argmin(axis=1)
        if not self.languages:
            return best, np.zeros(len(best)), np.ones(len(best), bool)
        rows = np.arange(len(best))
        odds = np.exp(-self.sharpness * (cost - cost[rows, best][:, None]))
        score = 1 / odds.sum(axis=1)
        bound = self.usual[best] + TOLERANCE * (self.spread[best] + self.noise[best] / np.sqrt(
            np.maximum(size, 1)))
        return best, score, (size == 0) | (score < 0.5) | (cost[rows, best] > bound)


def fit(texts: dict[str, list[str]], order: int = ORDER) -> Model:
    """Kneser-Ney models of all languages from texts; every fifth text only calibrates.

    Without any letter to learn from, the model has no languages and knows no text.
    """
    model = Model(sorted(texts))
    count = len(model.languages)
    held: list[tuple[int, str]] = []
    learned: list[tuple[int, str]] = []
    for i, name in enumerate(model.languages):
        own = texts[name]
        for j, text in enumerate(own):
            (held if len(own) >= 5 and j % 5 == 4 else learned).append((i, text))
    raw, offsets = text_buffers(pa.array([t for _, t in learned], pa.large_string()))
    words = letter_words(raw, offsets) if len(learned) else None
    if words is None:
        return Model([])
    tongue = np.array([i for i, _ in learned])
    # occurrences of each distinct word per language: rows language, columns word
    uses = np.bincount(tongue[words.doc] * len(words.size) + words.word,
                       minlength=count * len(words.size)).reshape(count, -1).astype(float)
    hashes = gram_hashes(words, order)
    raws, suffix, context, first_symbol = [], [], [], []
    model.contexts, model.grams = [], []
    for k in range(1, order + 1):
        at = np.flatnonzero((words.place > 0) & (words.place + 1 >= k))
        grams, sample, inverse = np.unique(hashes[k - 1][at], return_index=True, return_inverse=True)
        model.grams.append(grams)
        raws.append(np.stack([np.bincount(inverse, uses[i][words.owner[at]], len(grams))
                              for i in range(count)], axis=1))
        where = at[sample]
        first_symbol.append(words.place[where] + 1 == k)
        if k == 1:
            model.contexts.append(np.zeros(1, np.uint64))
            context.append(np.zeros(len(grams), np.int64))
            suffix.append(np.zeros(len(grams), np.int64))
        else:
            known, slot = np.unique(hashes[k - 2][where - 1], return_inverse=True)
            model.contexts.append(known)
            context.append(slot)
            suffix.append(np.searchsorted(model.grams[k - 2], hashes[k - 2][where]))
    lower = np.full((1, count), 1.0 / (len(model.grams[0]) + 1))
    model.unseen = None
    for k in range(1, order + 1):
        c = raws[k - 1]
        if k < order:
            above = (raws[k] > 0).astype(float)
            spread = np.stack([np.bincount(suffix[k], above[:, i], len(c)) for i in range(count)], axis=1)
            c = np.where(first_symbol[k - 1][:, None], c, spread)
            c = np.where((raws[k - 1] > 0) & (c == 0), 1.0, c) * (raws[k - 1] > 0)
        ones, twos = (c == 1).sum(axis=0), (c == 2).sum(axis=0)
        discount = np.clip((ones + 0.5) / (ones + 2.0 * twos + 1.0), 0.1, 0.9)
        size = len(model.contexts[k - 1])
        total = np.stack([np.bincount(context[k - 1], c[:, i], size) for i in range(count)], axis=1)
        kinds = np.stack([np.bincount(context[k - 1], c[:, i] > 0, size) for i in range(count)], axis=1)
        back = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
        p = np.maximum(c - discount, 0) / np.maximum(total[context[k - 1]], 1)
        p = np.where(c > 0, p, 0.0) + back[context[k - 1]] * lower[suffix[k - 1]]
        if k == 1:
            model.unseen = np.log2(back[0] * lower[0]).astype(np.float32)
        model.log_p.append(np.log2(p).astype(np.float32))
        model.log_back.append(np.log2(back).astype(np.float32))
        lower = p
    _calibrate(model, held or learned)
    return model


def _calibrate(model: Model, texts: list[tuple[int, str]]) -> None:
    """Sharpness of the scores and usual costs, from texts the models have not seen."""
    raw, offsets = text_buffers(pa.array([t for _, t in texts], pa.large_string()))
    parts = [model.text_costs(raw, offsets[a:b + 1]) for a, b in groups(offsets)]
    cost, size = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    truth = np.array([i for i, _ in texts])[size > 0]
    cost, size = cost[size > 0], size[size > 0]
    best_fit = -np.inf
    for sharpness in np.geomspace(0.25, 64, 25):
        z = -sharpness * (cost - cost.min(axis=1, keepdims=True))
        fit_ = float((z[np.arange(len(truth)), truth] - np.log(np.exp(z).sum(axis=1))).mean())
        if fit_ > best_fit:
            best_fit, model.sharpness = fit_, float(sharpness)
    own = cost[np.arange(len(truth)), truth]
    count = len(model.languages)
    mean = own.mean() if len(own) else 0.0
    model.usual, model.spread = np.full(count, mean), np.full(count, own.std() if len(own) else 1.0)
    for i in range(count):
        if (truth == i).any():
            model.usual[i] = own[truth == i].mean()
            model.spread[i] = max(own[truth == i].std(), 0.02)
    model.noise = np.full(count, 3.0)


def sample_texts(docs: DataFrame, per_language: int = SAMPLE_DOCS, longest: int = SAMPLE_CHARS
                 ) -> dict[str, list[str]]:
    """At most `per_language` texts of each language, by the order of a hash of the id.

    What reaches the driver is bounded by both parameters: a text of more than `longest`
    characters takes part as its pieces of that length, each on its own. Rows that repeat
    an id and language are drawn once.
    """
    known = docs.filter("lang is not null and text is not null").select("doc_id", "lang", "text")
    piece = F.explode(F.sequence(F.lit(0), F.floor((F.greatest(F.length("text"), F.lit(1)) - 1) / longest).cast("int")))
    keys = known.select("lang", "doc_id", piece.alias("piece")).distinct().withColumn(
        "_key", F.concat_ws(":", F.col("doc_id").cast("string"), F.nullif("piece", F.lit(0)).cast("string")))
    ids = stored(hash_sample(keys, "lang", "_key", per_language), "language_sample")
    drawn = known.join(ids.withColumnsRenamed({"doc_id": "_id", "lang": "_lang"}),
                       F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("lang") == F.col("_lang")))
    part = F.substring("text", F.col("piece") * longest + 1, F.lit(longest))
    out: dict[str, list[str]] = {}
    for row in drawn.select("lang", "_key", part.alias("text")).filter("text <> ''").groupBy("lang", "_key").agg(
            F.min("text").alias("text")).orderBy("lang", F.xxhash64("_key"), "text").collect():
        out.setdefault(row.lang, []).append(row.text)
    return out


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Add lang_pred, lang_score and lang_rejected to all rows, in one pass over the texts.

    Null texts and texts without a letter are `und` with score 0 and rejected, as are all
    texts when the model has no languages. Columns
    of these names are replaced; other columns and repeated rows stay as they are.
    """
    docs = docs.drop("lang_pred", "lang_score", "lang_rejected")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample it was fitted on
    names = docs.columns

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        labels = np.array([*m.languages, UNKNOWN], dtype=object)
        for batch in batches:
            raw, offsets = text_buffers(batch.column(names.index("text")))
            n = batch.num_rows
            pred, score, rejected = np.full(n, len(labels) - 1), np.zeros(n), np.ones(n, bool)
            for a, b in groups(offsets):
                cost, size = m.text_costs(raw, offsets[a:b + 1])
                best, value, bad = m.decide(cost, size)
                pred[a:b] = np.where(size > 0, best, len(labels) - 1)
                score[a:b] = np.where(size > 0, value, 0.0)
                rejected[a:b] = bad
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(labels[pred], pa.string()), pa.array(score),
                 pa.array(rejected)], [*names, "lang_pred", "lang_score", "lang_rejected"])

    out = (T.StructType(list(docs.schema)).add("lang_pred", "string").add("lang_score", "double")
           .add("lang_rejected", "boolean"))
    return docs.mapInArrow(apply, out)


def is_held_out(mod: int, rest: int):
    return F.crc32(F.col("doc_id").cast("string")) % mod == rest


@query("op7_language_id")
def op7_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(is_held_out(4, 2), F.lit(False))
    model = fit(sample_texts(docs.filter(~held)))
    return identify(docs.select("doc_id", "text"), model).select(
        "doc_id", held.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"),
        F.col("lang_rejected").alias("rejected"))
