"""N-gram Jaccard join by vertical partitioning.

The global order of shingle hashes is cut into fragments. Each fragment holds its part
of all documents and counts, on its own, which shingles of a document also occur
elsewhere; partial counts are summed per document. Only documents that share enough of
their shingles with others can link, and only shared shingles can count for a pair, so
everything after works on that remainder: documents meet on a prefix of the order, and
overlaps are counted fragment by fragment and summed per pair.

Equal sets are joined once. First each document is compared to the head (the smallest)
of every prefix shingle's documents; the links found make components. Then families,
the documents that meet one head, are compared block by block wherever they still
hold several components, so a large group of near copies costs about one comparison
per member, and no link between components is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldseq.llm.base import query, shuffle_width, stored, table
from fieldseq.llm.components import components
from fieldseq.llm.language import groups
from fieldseq.llm.vector_join import least_labels
from fieldseq.llm.words import mix, shingles, text_buffers, words

K, SHARE = 5, (3, 4)
FRAGMENT_BYTES = 8 << 20
OVERLAP_FRAGMENTS = 4
TILE, TILE_CELLS = 256, 4 << 20
GROUP_BYTES, GROUP_DOCS = 2 << 20, 60_000
_MOST = 0xFFFF  # counts of documents are kept up to here; they only order shingles
_NO_ID = -(1 << 63)  # stands for a null doc_id on the way
_LOW = np.uint64((1 << 48) - 1)


def _pack(tokens: np.ndarray) -> bytes:
    """48-bit tokens as two planes of 4 and 2 bytes."""
    return tokens.astype(np.uint32).tobytes() + (tokens >> np.uint64(32)).astype(np.uint16).tobytes()


def _unpack(data: bytes) -> np.ndarray:
    n = len(data) // 6
    low = np.frombuffer(data, np.uint32, n).astype(np.uint64)
    return low | (np.frombuffer(data, np.uint16, n, 4 * n).astype(np.uint64) << np.uint64(32))


_PARTS = ["tokens", "at", "many", "often", "ids", "sizes", "keys"]
_SENT = pa.schema([("fragment", pa.int32()), ("batch", pa.int64()),
                   *[(c, pa.binary()) for c in _PARTS]])
_TOLD_SQL = ", ".join(["batch long", *[f"{c} binary" for c in _PARTS]])
_HOME = -1


def _by_fragment(tokens: np.ndarray, fragments: int) -> list[np.ndarray]:
    part = (mix(tokens) % np.uint64(fragments)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    return np.split(order, np.searchsorted(part[order], np.arange(1, fragments)))


def _split(fragments: int, k: int):
    """Cut the shingles of some texts by fragment; what is shared among them stays with them.

    `tokens` are sent with the document `at` that has them. Shingles of several documents of
    a batch are sent once, as `many` with their count `often`, so a frequent one costs one
    entry per batch. Rows of fragment `_HOME` describe the documents of a batch and hold
    the occurrences of its `many`.
    """
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = number = TaskContext.get().partitionId() << 16
        for batch in batches:
            ids, marks = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64)
                          for i in (0, 2))
            _, offsets = text_buffers(batch.column(1))
            for a0, b0 in groups(offsets, GROUP_BYTES):
                for a in range(a0, b0, GROUP_DOCS):
                    b = min(a + GROUP_DOCS, b0)
                    h, doc = words(batch.column(1).slice(a, b - a))
                    doc, h = shingles(h, doc, b - a, k)
                    size = np.bincount(doc, minlength=b - a)
                    filled = np.flatnonzero(size)
                    heads = (np.cumsum(size) - size)[filled]
                    keys = np.zeros((b - a, 2), np.uint64)
                    if len(filled):
                        keys[filled, 0] = np.add.reduceat(mix(h), heads)
                        keys[filled, 1] = np.bitwise_xor.reduceat(mix(h + np.uint64(1)), heads)
                    token = h & _LOW
                    order = np.argsort(token, kind="stable")
                    lead = np.append(True, token[order][1:] != token[order][:-1])[:len(order)]
                    run = np.cumsum(lead) - 1
                    count = np.bincount(run) if len(run) else run
                    several = count[run] > 1
                    home = order[several]
                    empty = pa.array([b""], pa.binary())
                    yield pa.RecordBatch.from_arrays([
                        pa.array([_HOME], pa.int32()), pa.array([number]),
                        pa.array([_pack(token[home])], pa.binary()),
                        pa.array([doc[home].astype(np.uint16).tobytes()], pa.binary()), empty, empty,
                        pa.array([np.stack((ids[a:b], marks[a:b])).tobytes()], pa.binary()),
                        pa.array([size.astype(np.int64).tobytes()], pa.binary()),
                        pa.array([keys.tobytes()], pa.binary())], schema=_SENT)
                    one, more = np.sort(order[lead & ~several]), order[lead & several]
                    often = np.minimum(count[count > 1], _MOST).astype(np.uint16)
                    cut_one = _by_fragment(token[one], fragments)
                    cut_more = _by_fragment(token[more], fragments)
                    rows = []
                    for f in range(fragments):
                        x, y = one[cut_one[f]], cut_more[f]
                        if len(x) or len(y):
                            rows.append((f, _pack(token[x]), doc[x].astype(np.uint16).tobytes(),
                                         _pack(token[more[y]]), often[y].tobytes()))
                    columns = list(zip(*rows)) or [[]] * 5
                    none = pa.nulls(len(rows), pa.binary())
                    yield pa.RecordBatch.from_arrays([
                        pa.array(columns[0], pa.int32()), pa.array([number] * len(rows), pa.int64()),
                        *[pa.array(c, pa.binary()) for c in columns[1:]], none, none, none], schema=_SENT)
                    number += 1
                    if number >> 16 != first >> 16:
                        raise ValueError("more than 65,536 batches of texts in one scan task")
    return apply


def _shared_in_fragment(rows: pa.Table) -> pa.Table:
    """In how many documents each shingle of a fragment occurs, told to the batches that sent it.

    `tokens` and `at` are those a batch has once and others have too, `many` those it has in
    several documents; `often` has the counts of the first and then of the second.
    """
    if rows["fragment"][0].as_py() == _HOME:
        return rows.select(["batch", *_PARTS])
    single = [_unpack(x.as_buffer()) for x in rows["tokens"]]
    several = [_unpack(x.as_buffer()) for x in rows["many"]]
    at = [np.frombuffer(x.as_buffer(), np.uint16) for x in rows["at"]]
    counts = [np.frombuffer(x.as_buffer(), np.uint16) for x in rows["often"]]
    token = np.concatenate(single + several)
    order = np.argsort(token, kind="stable")
    run = np.empty(len(token), np.int32)
    run[order] = np.cumsum(np.append(True, token[order][1:] != token[order][:-1])) - 1
    del order
    weight = np.concatenate((np.ones(sum(map(len, single)), np.uint16), *counts))
    total = np.minimum(np.bincount(run, weight), _MOST).astype(np.uint16)[run]
    told, a, c = [], 0, sum(map(len, single))
    for one, place, more in zip(single, at, several):
        mine, theirs = total[a:a + len(one)], total[c:c + len(more)]
        a, c = a + len(one), c + len(more)
        keep = mine > 1
        told.append((_pack(one[keep]), place[keep].tobytes(), _pack(more),
                     np.concatenate((mine[keep], theirs)).tobytes()))
    none = pa.nulls(len(rows), pa.binary())
    return pa.table([rows["batch"], *[pa.array(x, pa.binary()) for x in zip(*told)], none, none, none],
                    ["batch", *_PARTS])


def _gathered(share: tuple[int, int]):
    """Sum what the fragments told a batch: per document its shared shingles and its prefix.

    The order of shingles is: those no other document has, then by number of documents,
    then by hash; rare ones make up the prefix.
    """
    up, down = share

    def apply(rows: pa.Table) -> pa.Table:
        home = next(i for i, x in enumerate(rows["ids"]) if x.is_valid)
        ids, marks = np.frombuffer(rows["ids"][home].as_buffer(), np.int64).reshape(2, -1)
        size = np.frombuffer(rows["sizes"][home].as_buffer(), np.int64)
        keys = np.frombuffer(rows["keys"][home].as_buffer(), np.int64).reshape(-1, 2)
        single = [_unpack(x.as_buffer()) for x in rows["tokens"]]
        at = [np.frombuffer(x.as_buffer(), np.uint16) for x in rows["at"]]
        several = [_unpack(x.as_buffer()) for x in rows["many"]]
        often = [np.frombuffer(x.as_buffer(), np.uint16) for x in rows["often"]]
        known = np.concatenate(several)
        rank = np.argsort(known)
        known_often = np.concatenate([o[len(s):] for i, (o, s) in enumerate(zip(often, single))
                                      if i != home] or [np.zeros(0, np.uint16)])[rank]
        known = known[rank]
        often = [o[:len(s)] if i != home else known_often[np.searchsorted(known, s)]
                 for i, (o, s) in enumerate(zip(often, single))]
        token, count = np.concatenate(single), np.concatenate(often).astype(np.uint64)
        doc = np.concatenate(at).astype(np.int64)
        shared = np.bincount(doc, minlength=len(ids))
        able = (shared * down >= size * up) & (size > 0)
        keep = np.flatnonzero(able[doc])
        token, doc, place = token[keep], doc[keep], (count[keep] << np.uint64(48)) | token[keep]
        # shingles no other document has come first in the order, so they take up the prefix
        need = -(-size * up // down)
        prefix = np.maximum(0, (size - need + 1) - (size - shared))
        by_rank, by_token = np.lexsort((place, doc)), np.lexsort((token, doc))
        cut = np.searchsorted(doc[by_rank], np.arange(len(ids) + 1))
        chosen = [(cut[i], cut[i + 1]) if able[i] else None for i in range(len(ids))]
        batch = rows["batch"][0].as_py()
        return pa.table([
            pa.array(ids), pa.array(marks), pa.array((batch << 16) + np.arange(len(ids))), pa.array(size),
            pa.array(keys[:, 0]), pa.array(keys[:, 1]),
            pa.array([None if x is None else token[by_rank[x[0]:x[0] + prefix[i]]].astype(np.int64)
                      for i, x in enumerate(chosen)], pa.list_(pa.int64())),
            pa.array([None if x is None else _pack(token[by_token[x[0]:x[1]]]) for x in chosen],
                     pa.binary())],
            ["doc_id", "text_hash", "uid", "n", "key1", "key2", "prefix", "tokens"])
    return apply


def shingle_sets(docs: DataFrame, k: int = K, share: tuple[int, int] = SHARE) -> DataFrame:
    """(doc_id, text_hash, uid, n, key1, key2, prefix, tokens) of all documents.

    `tokens` (packed) and `prefix` are null for documents that share less than `share` of
    their shingles with any others. `docs` should be a table scan, whose tasks see the
    same rows when they are run again.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    fragments = max(shuffle_width(spark), -(-size // FRAGMENT_BYTES))
    sent = (docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)), "text",
                        F.xxhash64("text")).mapInArrow(_split(fragments, k), "fragment int, " + _TOLD_SQL))
    where = F.when(F.col("fragment") == _HOME, F.pmod("batch", F.lit(fragments))).otherwise(F.lit(-1))
    told = (sent.groupBy("fragment", where.alias("_at")).applyInArrow(
        _shared_in_fragment, _TOLD_SQL))
    return (told.groupBy("batch").applyInArrow(
        _gathered(share), "doc_id long, text_hash long, uid long, n long, key1 long, key2 long, "
        "prefix array<long>, tokens binary"))


def _close(a: Column, b: Column, share: tuple[int, int]) -> Column:
    return F.least(a, b) * share[1] >= F.greatest(a, b) * share[0]


def _overlaps(fragments: int):
    """Shared shingles of pairs in each fragment of the order: (a, b, fragment, n)."""
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(i).to_numpy() for i in (0, 1))
            counts = np.zeros((len(a), fragments), np.int64)
            last, left = None, None
            for i in range(len(a)):
                if last != a[i]:
                    last, left = a[i], _unpack(batch.column(2)[i].as_buffer())
                right = _unpack(batch.column(3)[i].as_buffer())
                edges = (np.arange(1, fragments, dtype=np.uint64) << np.uint64(48)) // np.uint64(fragments)
                cut_l = np.concatenate(([0], np.searchsorted(left, edges), [len(left)]))
                cut_r = np.concatenate(([0], np.searchsorted(right, edges), [len(right)]))
                for f in range(fragments):
                    counts[i, f] = len(np.intersect1d(left[cut_l[f]:cut_l[f + 1]],
                                                      right[cut_r[f]:cut_r[f + 1]], True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(a), pa.array(b), batch.column(4), batch.column(5),
                 pa.array(counts.tolist(), pa.list_(pa.int64()))], ["a", "b", "na", "nb", "counts"])
    return apply


def verify(pairs: DataFrame, sets: DataFrame, share: tuple[int, int] = SHARE,
           fragments: int = OVERLAP_FRAGMENTS) -> DataFrame:
    """Pairs (a, b) whose overlap is at least `share` of their union.

    A pair's overlap is the sum of its partial counts per fragment. The tokens of `a`
    are fetched first, then those of `b`.
    """
    one = sets.select(F.col("uid").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    two = sets.select(F.col("uid").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "ta", "tb", "na", "nb")
    counted = both.mapInArrow(_overlaps(fragments),
                              "a long, b long, na long, nb long, counts array<long>")
    overlap = F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x)
    return (counted.withColumn("o", overlap)
            .filter(F.col("o") * share[1] >= (F.col("na") + F.col("nb") - F.col("o")) * share[0])
            .select("a", "b"))


def _tile(share: tuple[int, int]):
    """Links between the documents of two blocks of a family, as edges to the smallest uid reached.

    The shingles of the tile are cut into fragments; each fragment adds its counts for all
    pairs of the tile. Pairs already in one component need no answer.
    """
    up, down = share

    def apply(rows: pa.Table) -> pa.Table:
        uid, n, root, own = (rows[c].to_numpy() for c in ("uid", "n", "root", "own"))
        none = pa.table([pa.array([], pa.int64())] * 2, ["a", "b"])
        if (root == root[0]).all():
            return none
        tokens = [_unpack(x.as_buffer()) for x in rows["tokens"]]
        left = np.flatnonzero(own == rows["low"][0].as_py())
        right = np.flatnonzero(own == rows["high"][0].as_py())
        owner = np.repeat(np.arange(len(uid)), [len(x) for x in tokens])
        kinds, place, count = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
        order = np.argsort(place, kind="stable")
        order = order[count[place[order]] > 1]
        overlap = np.zeros((len(left), len(right)), np.float32)
        wide = max(1, TILE_CELLS // len(uid))
        for start in range(0, len(kinds), wide):
            a, b = np.searchsorted(place[order], (start, start + wide))
            held = np.zeros((len(uid), wide), np.float32)
            held[owner[order[a:b]], place[order[a:b]] - start] = 1
            overlap += held[left] @ held[right].T
        linked = overlap * down >= (n[left][:, None] + n[right][None, :] - overlap) * up
        linked &= root[left][:, None] != root[right][None, :]
        if not linked.any():
            return none
        one, two = least_labels(linked, uid[left], uid[right])
        node, least = np.concatenate((uid[left], uid[right])), np.concatenate((one, two))
        return pa.table([pa.array(node[node != least]), pa.array(least[node != least])], ["a", "b"])
    return apply


def family_links(met: DataFrame, sets: DataFrame, share: tuple[int, int] = SHARE, tile: int = TILE
                 ) -> DataFrame:
    """Links (a, b) between components among documents that meet the same head on some shingle.

    A family is dealt into blocks of about `tile` documents, and every two blocks meet in one
    task; nothing is emitted but the links that join components.
    """
    family = met.select("uid", "n", "root", F.col("head.uid").alias("head")).distinct()
    parts = family.groupBy("head").agg(F.ceil(F.count("*") / tile).alias("_parts"))
    dealt = (family.join(parts, "head")
             .withColumn("own", F.pmod(F.xxhash64("uid"), F.col("_parts")))
             .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
             .withColumns({"low": F.least("own", "_other"), "high": F.greatest("own", "_other")}))
    held = dealt.drop("n").join(sets.select("uid", "n", "tokens"), "uid").select(
        "head", "low", "high", "own", "uid", "n", "root", "tokens")
    return held.groupBy("head", "low", "high").applyInArrow(_tile(share), "a long, b long")


def near_texts(docs: DataFrame, k: int = K, share: tuple[int, int] = SHARE, stars: int = 1
               ) -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard similarity of `share` or more.

    Returns doc_id, text_hash, n_shingles, component_id (smallest doc_id) and group (a number
    per component) per input row. Null, empty and
    blank texts have no shingles and link with nothing; repeated rows link with each other.
    A null doc_id is returned as null and never names a component unless all ids in it are
    null. Other columns are ignored; an empty table gives no rows. `share` is a fraction of
    two integers, so similarities at the threshold are decided exactly.
    """
    sets = stored(shingle_sets(docs, k, share), "shingle_sets")
    able = sets.filter("tokens is not null")
    reps = stored(able.groupBy("key1", "key2", "n").agg(
        F.min("uid").alias("uid"), F.min_by("prefix", "uid").alias("prefix")), "distinct_sets")
    posted = reps.select("uid", "n", F.explode("prefix").alias("token"))
    tried, links, roots = None, None, None
    for step in range(stars + 1):
        if roots is None:
            placed = posted.withColumn("root", F.col("uid"))
        else:
            known = roots.withColumnRenamed("node", "uid").withColumnRenamed("root", "_root")
            placed = (posted.join(known, "uid", "left")
                      .withColumn("root", F.coalesce("_root", "uid")).drop("_root"))
        heads = (placed.groupBy("token").agg(F.min(F.struct("root", "uid", "n")).alias("head"),
                                             F.max("root").alias("_last"))
                 .filter(F.col("head.root") < F.col("_last")).drop("_last"))
        met = placed.join(heads, "token")
        if step == stars:
            found = stored(family_links(met, able, share), "family_links")
        else:
            posted = stored(met.select("uid", "n", "token"), "mixed_postings")
            pairs = met.filter((F.col("root") != F.col("head.root"))
                               & _close(F.col("n"), F.col("head.n"), share)).select(
                F.least("head.uid", "uid").alias("a"), F.greatest("head.uid", "uid").alias("b"))
            pairs = pairs.distinct()
            if tried is not None:
                pairs = pairs.join(tried, ["a", "b"], "left_anti")
            pairs = stored(pairs, "candidate_pairs")
            tried = pairs if tried is None else tried.unionByName(pairs)
            found = stored(verify(pairs, able, share), "links")
        links = found if links is None else links.unionByName(found)
        roots = stored(components(links), "roots")
    member = sets.select("doc_id", "text_hash", "uid", "n", "key1", "key2")
    classes = reps.select("key1", "key2", "n", F.col("uid").alias("rep"))
    named = roots.withColumnRenamed("node", "rep")
    classes = classes.join(named, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    placed = stored(member.join(classes.drop("rep"), ["key1", "key2", "n"], "left")
                    .withColumn("root", F.coalesce("root", "uid"))
                    .withColumn("doc_id", F.nullif("doc_id", F.lit(_NO_ID)))
                    .select("doc_id", "text_hash", "n", F.col("root").alias("group")), "classes")
    least = placed.groupBy("group").agg(F.min("doc_id").alias("component_id"))
    return placed.join(least, "group").select(
        "doc_id", "text_hash", F.col("n").alias("n_shingles"), "component_id", "group")


def one_of_each(docs: DataFrame, k: int = K, share: tuple[int, int] = SHARE) -> DataFrame:
    """The documents with the smallest id of each component, all columns kept.

    Rows equal in id and text stay once; documents without shingles all stay.
    """
    me = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    first = (near_texts(docs, k, share).groupBy("group").agg(F.min(me).alias("f"))
             .select(F.col("f.doc_id").alias("_near_id"), F.col("f.text_hash").alias("_near_hash")))
    hashed = docs.withColumn("_near_text", F.xxhash64("text"))
    return (hashed.join(first, F.col("doc_id").eqNullSafe(F.col("_near_id"))
                        & (F.col("_near_text") == F.col("_near_hash")), "left_semi")
            .dropDuplicates(["doc_id", "_near_text"]).drop("_near_text"))


_UPPER = "".join(map(chr, range(65, 91)))


@query("op3_ngram_jaccard_join", f"""
  with recursive w as (
    select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}',
      '{_UPPER.lower()}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
  s as materialized (
    select doc_id, unnest(list_distinct(case when len(w) = 0 then []
      when len(w) < 5 then [hash(array_to_string(w, ' '))]
      else list_transform(range(1, len(w) - 3), lambda i: hash(array_to_string(w[i:i + 4], ' '))) end)) as g
    from w),
  n as (select doc_id, count(g) as n from w left join s using (doc_id) group by doc_id),
  links as materialized (
    select x.a, x.b from (select l.doc_id as a, r.doc_id as b, count(*) as o
      from s l join s r using (g) where l.doc_id <> r.doc_id group by all) x
      join n p on p.doc_id = x.a join n q on q.doc_id = x.b
    where 100 * o >= 75 * (p.n + q.n - o)),
  reach as (
    select doc_id as a, doc_id as b from n
    union
    select r.a, l.b from reach r join links l on r.b = l.a)
  select n.doc_id, n.n as n_shingles, c.component_id
  from n join (select a as doc_id, min(b) as component_id from reach group by 1) c using (doc_id)""")
def op3_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_texts(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_shingles", "component_id")
