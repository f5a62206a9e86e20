"""Queries on filters, sparse, dense, fused, similar and shape search."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldseq.functions import grammar as G
from fieldseq.operators import bounded, dense, filters, fuse, latent, predicate_index, sparse
from fieldseq.operators.filters import Filters
from fieldseq.plans.base import (cte, possessions, query, r6, stored_possessions, table,
                                 with_sql)
from fieldseq.plans.eval_set import adapted, query_table
from fieldseq.sources.tables import written
from fieldseq.spec import ZONES



def tokens():
    return F.split("token_string", " ")


def hint_tokens():
    return F.split("hint", " ")


SPACE = r"[\s\x0b\x1c-\x1f\x{85}\pZ]+"


# --- the same in DuckDB SQL ------------------------------------------------------------

def sql_predicate(f: Filters) -> str:
    terms = [f"{n} = '{getattr(f, n)}'" for n in filters.EQUALITY if getattr(f, n) is not None]
    if f.start_band:
        terms.append(f"starts_with(start_zone, '{f.start_band}-')")
    if f.end_band:
        terms.append(f"starts_with(end_zone, '{f.end_band}-')")
    terms += [f"{n} = {str(getattr(f, n)).lower()}" for n in ("ended_in_shot", "ended_in_goal")
              if getattr(f, n) is not None]
    if f.min_xg is not None:
        terms.append(f"xg_sum >= {f.min_xg}::double")
    if f.min_events is not None:
        terms.append(f"n_events >= {f.min_events}")
    terms += [f"contains(token_string, '{t}')" for t in f.must_include]
    return " and ".join(terms) or "true"


def gram_list(w: str) -> str:
    return (f"list_concat({w}, list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i + 1]), "
            f"list_transform(range(1, len({w}) - 1), "
            f"lambda i: {w}[i] || ' ' || {w}[i + 1] || ' ' || {w}[i + 2]))")


def tfidf_ctes(p: str, id_col: str, source: str, needs: tuple[str, ...] = ()) -> None:
    """Named tables `{p}_vocab` and `{p}_post` over a source giving (id, w list)."""
    cte(f"{p}_w", source, needs)
    cte(f"{p}_tf", f"""select {id_col}, gram, count(*) as tf from
        (select {id_col}, unnest({gram_list('w')}) as gram from {p}_w) group by all""", (f"{p}_w",))
    cte(f"{p}_vocab", f"""select gram, count(*) as df,
        ln((1 + (select count(*) from {p}_w)::double) / (1 + count(*)::double)) + 1 as idf
        from {p}_tf group by gram having count(*) >= 2""", (f"{p}_tf",))
    cte(f"{p}_raw", f"""select {id_col}, gram, tf, (1 + ln(tf::double)) * idf as raw
        from {p}_tf join {p}_vocab using (gram)""", (f"{p}_vocab",))
    cte(f"{p}_post", f"""select {id_col}, gram, tf,
        raw / sqrt(sum(raw * raw) over (partition by {id_col})) as weight from {p}_raw""",
        (f"{p}_raw",))


def query_ctes(q: str, p: str, source: str, needs: tuple[str, ...] = ()) -> None:
    """Named table `{q}_vec(qid, gram, qw)` over a source giving (qid, w list)."""
    cte(f"{q}_raw", f"""select qid, gram, (1 + ln(count(*)::double)) * any_value(idf) as raw from
        (select qid, unnest({gram_list('w')}) as gram from ({source})) join {p}_vocab using (gram)
        group by qid, gram""", (*needs, f"{p}_vocab"))
    cte(f"{q}_vec", f"""select qid, gram, raw / sqrt(sum(raw * raw) over (partition by qid)) as qw
        from {q}_raw""", (f"{q}_raw",))


EVAL = adapted()
_VALUES = ", ".join("('{}', '{}', {})".format(
    q, hint, "[" + ", ".join(f"'{g}'" for g in f.given()) + "]::varchar[]")
    for q, (_, f, hint) in EVAL.items())
cte("evalq", f"select * from (values {_VALUES}) as t(qid, hint, given)")
cte("cand", " union all ".join(
    f"select '{q}' as qid, uid from poss where {sql_predicate(f)}"
    for q, (_, f, _h) in EVAL.items()), ("poss",))
tfidf_ctes("pt", "uid", "select uid, string_split(token_string, ' ') as w from poss", ("poss",))
query_ctes("eq", "pt", "select qid, string_split(hint, ' ') as w from evalq", ("evalq",))
cte("sparse_all", """select qid, uid, round(sum(weight * qw), 9) as score
    from pt_post join eq_vec using (gram) group by qid, uid having round(sum(weight * qw), 9) > 0""",
    ("pt_post", "eq_vec"))
cte("sparse_top", """select * from (select qid, uid, score, (row_number() over
    (partition by qid order by score desc, uid) - 1)::int as rank
    from sparse_all semi join cand using (qid, uid)) where rank < 50""", ("sparse_all", "cand"))


# --- queries ------------------------------------------------------------------------------

def eval_filters():
    return {q: f for q, (_, f, _h) in EVAL.items()}


def token_index(items):
    return sparse.fit_index(items, "uid", tokens())


def eval_sparse(spark, items):
    """Filtered sparse ranking of the evaluation queries (pool of 50 each)."""
    asked = query_table(spark, EVAL)
    return fuse.hybrid(asked, items, token_index(items), hint_tokens())["sparse"]


@query("filtered_candidates", with_sql(("cand",), "select qid, uid from cand"))
def filtered_candidates(spark, sf_dir):
    return filters.candidates(possessions(spark, sf_dir), eval_filters())


@query("candidate_counts", with_sql(("cand", "evalq"), """
select qid, count(uid) as n_candidates from evalq left join cand using (qid) group by qid"""))
def candidate_counts(spark, sf_dir):
    return filters.candidate_counts(possessions(spark, sf_dir), eval_filters())


MUST = {"m1": Filters(must_include=("CROSS", "SHOT@F")),
        "m2": Filters(must_include=("PASS@M-C",), min_events=5),
        "m3": Filters(start_band="D", end_band="F"),
        "m4": Filters(start_zone="M-C", ended_in_goal=False),
        "m5": Filters(competition="C1", season="S0", min_xg=0.3),
        "m6": Filters(opponent="T3", end_zone="F-C")}


@query("filter_kinds", with_sql(("poss",), " union all ".join(
    f"select '{q}' as qid, uid from poss where {sql_predicate(f)}" for q, f in MUST.items())))
def filter_kinds(spark, sf_dir):
    return filters.candidates(possessions(spark, sf_dir), MUST)


@query("tfidf_vocab", with_sql(("pt_vocab",), "select gram, df, round(idf, 6) as idf from pt_vocab"))
def tfidf_vocab(spark, sf_dir):
    v = sparse.fit_vocab(possessions(spark, sf_dir), "uid", tokens())
    return v.select("gram", "df", r6("idf").alias("idf"))


@query("tfidf_postings", with_sql(("pt_post",), """
select uid, gram, tf, round(weight, 6) as weight from pt_post"""))
def tfidf_postings(spark, sf_dir):
    index = token_index(possessions(spark, sf_dir))
    return index.postings.select("uid", "gram", "tf", r6("weight").alias("weight"))


tfidf_ctes("dt", "doc_id", f"""select doc_id,
  list_filter(regexp_split_to_array(text, '{SPACE}'), lambda v: v <> '') as w from documents""")


@query("document_vocab", with_sql(("dt_vocab",), """
select gram, df, round(idf, 6) as idf from dt_vocab"""))
def document_vocab(spark, sf_dir):
    v = sparse.fit_vocab(table(spark, sf_dir, "documents"), "doc_id", G.words(F.col("text")))
    return v.select("gram", "df", r6("idf").alias("idf"))


@query("sparse_index_statistics", with_sql(("pt_post", "poss"), """
select (select count(distinct uid) from pt_post) as n_docs, (select count(*) from pt_post) as nnz,
  (select count(distinct gram) from pt_post) as n_grams,
  (select round(avg(n_events), 6) from poss) as mean_words"""))
def sparse_index_statistics(spark, sf_dir):
    items = stored_possessions(spark, sf_dir)
    mean = items.agg(F.round(F.avg("n_events"), 6).alias("m")).scalar()
    return sparse.index_statistics(token_index(items)).withColumn("mean_words", mean)


@query("sparse_search", with_sql(("sparse_top", "poss"), """
select s.qid, s.rank, s.uid, round(s.score, 6) as score, p.team, p.opponent, p.competition,
  p.play_pattern, p.token_string, p.n_events, p.ended_in_shot
from sparse_top s join poss p using (uid)"""))
def sparse_search(spark, sf_dir):
    items = stored_possessions(spark, sf_dir)
    shown = fuse.hydrate(eval_sparse(spark, items), items,
                         ["team", "opponent", "competition", "play_pattern", "token_string",
                          "n_events", "ended_in_shot"])
    return (shown.withColumn("score", r6("score"))
            .withColumn("n_events", F.col("n_events").cast("bigint")))


@query("bounded_sparse_search", with_sql(("sparse_top",), """
select qid, uid, rank, round(score, 6) as score from sparse_top"""))
def bounded_sparse_search(spark, sf_dir):
    """The same ranking as `sparse_search`, with blocks below the threshold of a query left out."""
    items = stored_possessions(spark, sf_dir)
    index = token_index(items)
    asked = query_table(spark, EVAL)
    wanted = predicate_index.build(asked)
    grams = wanted.asked(sparse.query_vectors(asked, index.vocab, hint_tokens()))
    found = bounded.best(written(grams, "grams"), bounded.in_blocks(index), held=wanted.probe(items))
    return found.select("qid", "uid", "rank", r6("score").alias("score"))


@query("length_normalised_search", with_sql(("pt_post", "eq_vec", "poss", "pt_vocab"), """
select qid, uid, rank, round(score, 6) as score from (
  select *, (row_number() over (partition by qid order by score desc, uid) - 1)::int as rank from (
    select qid, uid, round(sum(idf * tf * 2.2::double / (tf + 1.2::double * (0.25::double
      + 0.75::double * n_events / (select avg(n_events) from poss)))), 9) as score
    from pt_post join eq_vec using (gram) join pt_vocab using (gram) join poss using (uid)
    group by qid, uid)) where rank < 20"""))
def length_normalised_search(spark, sf_dir):
    items = stored_possessions(spark, sf_dir)
    index = token_index(items)
    asked = query_table(spark, EVAL)
    vectors = sparse.query_vectors(asked, index.vocab, hint_tokens())
    lengths = items.select("uid", F.col("n_events").alias("n_words"))
    small = sparse.is_small(asked, hint_tokens())
    scored = sparse.bm25_scores(vectors, index, lengths, small=small)
    return sparse.rank(scored, "uid", 20).withColumn("score", r6("score"))


cte("seeds", """select team as qid, arg_max(uid, {'n': n_events, 'u': uid}) as seed
    from poss group by team""", ("poss",))
cte("similar_top", """select * from (select qid, uid, score, (row_number() over
    (partition by qid order by score desc, uid) - 1)::int as rank from (
      select s.qid, p.uid, round(sum(p.weight * q.weight), 9) as score
      from seeds s join pt_post q on q.uid = s.seed join pt_post p on p.gram = q.gram
      where p.uid <> s.seed group by s.qid, p.uid) where score > 0) where rank < 20""",
    ("seeds", "pt_post"))


def team_seeds(items):
    """The longest possession of every team."""
    return items.groupBy(F.col("team").alias("qid")).agg(
        F.max(F.struct("n_events", "uid"))["uid"].alias("uid"))


@query("similar_sparse", with_sql(("similar_top",), """
select qid, uid, rank, round(score, 6) as score from similar_top"""))
def similar_sparse(spark, sf_dir):
    items = stored_possessions(spark, sf_dir)
    found = fuse.similar(team_seeds(items), token_index(items).shared())["sparse"]
    return found.filter(F.col("rank") < 20).withColumn("score", r6("score"))


cte("vecs", """select vec_id, embedding::double[] as v,
    sqrt(list_dot_product(embedding::double[], embedding::double[])) as n from embeddings""")
cte("dense_top", """select * from (select qid, doc_id, score, (row_number() over
    (partition by qid order by score desc, doc_id) - 1)::int as rank from (
      select b.item_id as qid, v.vec_id as doc_id,
        round(list_dot_product(q.v, v.v) / (q.n * v.n), 9) as score
      from benchmark b join vecs q on q.vec_id = b.item_id, vecs v)) where rank < 50""", ("vecs",))


def document_vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")


def benchmark_queries(spark, sf_dir):
    """Benchmark passages as queries: their text, and the vector stored under their id."""
    vectors = document_vectors(spark, sf_dir).withColumnRenamed("doc_id", "qid")
    return (table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "qid")
            .join(vectors, "qid", "left"))


@query("dense_topk", with_sql(("dense_top",), """
select qid, doc_id, rank, round(score, 6) as score from dense_top"""))
def dense_topk(spark, sf_dir):
    found = dense.nearest(benchmark_queries(spark, sf_dir), document_vectors(spark, sf_dir),
                          item_id="doc_id")
    return found.withColumn("score", r6("score"))


@query("dense_similar", with_sql(("vecs",), """
select qid, doc_id, rank, round(score, 6) as score from (
  select qid, doc_id, score, (row_number() over (partition by qid order by score desc, doc_id) - 1)::int
    as rank from (
      select q.vec_id as qid, v.vec_id as doc_id,
        round(list_dot_product(q.v, v.v) / (q.n * v.n), 9) as score
      from labels l join vecs q on q.vec_id = l.doc_id and l.toxic = 1
        join vecs v on v.vec_id <> q.vec_id)) where rank < 20"""))
def dense_similar(spark, sf_dir):
    flagged = table(spark, sf_dir, "labels").filter(F.col("toxic") == 1).select("doc_id")
    vectors = document_vectors(spark, sf_dir)
    seeds = vectors.join(flagged, "doc_id").select(
        F.col("doc_id").alias("qid"), "embedding", F.col("doc_id").alias("seed"))
    found = dense.nearest(seeds, vectors, 20, item_id="doc_id", exclude="seed")
    return found.withColumn("score", r6("score"))


query_ctes("bq", "dt", f"""select item_id as qid,
  list_filter(regexp_split_to_array(text, '{SPACE}'), lambda v: v <> '') as w from benchmark""")
cte("doc_sparse", """select * from (select qid, doc_id, score, (row_number() over
    (partition by qid order by score desc, doc_id) - 1)::int as rank from (
      select qid, doc_id, round(sum(weight * qw), 9) as score from dt_post join bq_vec using (gram)
      group by qid, doc_id) where score > 0) where rank < 50""", ("dt_post", "bq_vec"))


@query("bounded_document_search", with_sql(("doc_sparse",), """
select qid, doc_id, rank, round(score, 6) as score from doc_sparse where rank < 10"""))
def bounded_document_search(spark, sf_dir):
    """Best documents for every benchmark passage."""
    words = G.words(F.col("text"))
    asked = benchmark_queries(spark, sf_dir)
    found = bounded.best_asked(table(spark, sf_dir, "documents"), "doc_id", words, asked, words, 10,
                               F.octet_length("text"))
    return found.select("qid", "doc_id", "rank", r6("score").alias("score"))


@query("hybrid_rrf", with_sql(("doc_sparse", "dense_top"), """
select qid, doc_id, rank, round(score, 6) as score from (
  select *, (row_number() over (partition by qid order by score desc, doc_id) - 1)::int as rank from (
    select qid, doc_id, sum(1.0::double / (61 + rank)) as score from (
      select qid, doc_id, rank from doc_sparse union all select qid, doc_id, rank from dense_top)
    group by qid, doc_id)) where rank < 20"""))
def hybrid_rrf(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    words = G.words(F.col("text"))
    asked = benchmark_queries(spark, sf_dir)
    near = bounded.best_asked(docs, "doc_id", words, asked, words, fuse.POOL, F.octet_length("text"))
    close = dense.nearest(asked, document_vectors(spark, sf_dir), fuse.POOL, item_id="doc_id")
    return fuse.fuse([near, close], "doc_id").withColumn("score", r6("score"))


SHAPES = {"s1": ["D-C", "M-C", "F-C"], "s2": ["M-L", "F-L"], "s3": ["F-R", "F-R", "F-C"],
          "s4": ["D-L", "M-LI", "M-C", "F-RI"], "s5": ["M-C"], "s6": ["F-C", "D-C"]}
SHAPE_FILTERS = {"s2": Filters(ended_in_shot=True), "s6": Filters(play_pattern="From Corner")}


def _shape_sql(q: str) -> str:
    zones = fuse.collapse(SHAPES[q])
    pattern = "(^| )" + " (.* )?".join(zones) + "( |$)"
    keep = sql_predicate(SHAPE_FILTERS.get(q, Filters()))
    return (f"select '{q}' as qid, uid, n_events, {len(zones)}::double / len(path) as coverage "
            f"from paths where {keep} and regexp_matches(array_to_string(path, ' '), '{pattern}')")


cte("paths", """select *, list_filter(string_split(zone_path, ' '),
    lambda z, i: i = 1 or z <> string_split(zone_path, ' ')[i - 1]) as path from poss""", ("poss",))
cte("shape_all", " union all ".join(_shape_sql(q) for q in SHAPES), ("paths",))


@query("reduced_paths", with_sql(("paths",), """
select uid, n_events, array_to_string(path, ' ') as path from paths"""))
def reduced_paths(spark, sf_dir):
    return fuse.reduced_paths(possessions(spark, sf_dir)).select(
        "uid", F.col("n_events").cast("bigint").alias("n_events"),
        F.array_join("path", " ").alias("path"))


@query("shape_search", with_sql(("shape_all",), """
select qid, uid, n_events, rank, round_even(coverage, 3) as score from (
  select *, (row_number() over (partition by qid order by coverage desc, n_events desc, uid desc)
    - 1)::int as rank from shape_all) where rank < 20"""))
def shape_search(spark, sf_dir):
    found = fuse.shape_search(possessions(spark, sf_dir), SHAPES, SHAPE_FILTERS)
    return found.select("qid", "uid", F.col("n_events").cast("bigint").alias("n_events"), "rank",
                        "score")


@query("shape_counts", with_sql(("shape_all",), """
select qid, count(*) as n_matched from shape_all group by qid"""))
def shape_counts(spark, sf_dir):
    return fuse.shape_counts(fuse.shape_matches(possessions(spark, sf_dir), SHAPES, SHAPE_FILTERS))


@query("shape_table", with_sql(("shape_all",), """
select qid, uid, n_events, rank, round_even(coverage, 3) as score from (
  select *, (row_number() over (partition by qid order by coverage desc, n_events desc, uid desc)
    - 1)::int as rank from shape_all) where rank < 20"""))
def shape_table(spark, sf_dir):
    """The same shapes as `shape_search`, drawn and filtered in a table."""
    found = fuse.shape_table_search(stored_possessions(spark, sf_dir), drawings(spark))
    return found.select("qid", "uid", F.col("n_events").cast("bigint").alias("n_events"), "rank", "score")


def drawings(spark):
    schema = spark.createDataFrame([], "qid string, zones array<string>").schema.add("filters", filters.FILTER_TYPE)
    return spark.createDataFrame([(q, zones, SHAPE_FILTERS.get(q, Filters()).as_row())
                                  for q, zones in SHAPES.items()], schema)


cte("opening", """select distinct array_to_string(path[1:4], ' ') as qid, path[1:4] as zones
    from paths where play_pattern = 'From Corner' and len(path) >= 4""", ("paths",))


@query("shapes_of_corners", with_sql(("opening", "paths"), """
select qid, uid, n_events, rank, round_even(coverage, 3) as score from (
  select o.qid, uid, n_events, 4::double / len(path) as coverage, (row_number() over (partition by o.qid
    order by 4::double / len(path) desc, n_events desc, uid desc) - 1)::int as rank
  from opening o join paths on regexp_matches(array_to_string(path, ' '),
    '(^| )' || array_to_string(o.zones, ' (.* )?') || '( |$)')) where rank < 5"""))
def shapes_of_corners(spark, sf_dir):
    """How corners open, drawn from the data: each opening of four zones, looked for everywhere."""
    items = stored_possessions(spark, sf_dir)
    start = F.slice("path", 1, 4)
    opening = (fuse.reduced_paths(items, ["play_pattern"])
               .filter((F.col("play_pattern") == "From Corner") & (F.size("path") >= 4))
               .select(F.array_join(start, " ").alias("qid"), start.alias("zones")).distinct())
    found = fuse.shape_table_search(items, opening, 5)
    return found.select("qid", "uid", F.col("n_events").cast("bigint").alias("n_events"), "rank", "score")


@query("unknown_zones", with_sql(("poss",), """
select zone, count(*) as n from (select unnest(string_split(zone_path, ' ')) as zone from poss)
where zone not in ('D-C', 'M-C', 'F-C') group by zone"""))
def unknown_zones(spark, sf_dir):
    """Zones of the table that a reduced grid of three would not know."""
    allowed = tuple(z for z in ZONES if z.endswith("-C"))
    bad = possessions(spark, sf_dir).select(
        F.split("zone_path", " ").alias("zones"),
        F.explode(filters.unknown_zones(F.split("zone_path", " "), allowed)).alias("zone"))
    times = F.size(F.filter("zones", lambda z: z == F.col("zone")))
    return bad.groupBy("zone").agg(F.sum(times).alias("n"))


@query("latent_vectors", with_sql(("pt_post",), """
select (select count(distinct uid) from pt_post) as n_items, 8 as rank, true as orthonormal,
  true as explains_more_than_its_share"""))
def latent_vectors(spark, sf_dir):
    """Vectors of possessions from their postings: are the directions orthonormal, and do eight of
    them explain more of the postings than eight of as many equally strong ones would?"""
    index = token_index(stored_possessions(spark, sf_dir))
    found = latent.fit(index.postings, rank=8, rounds=4)
    products = latent.inner_products(found.grams, 8)
    off = max(abs(products[i, j] - (i == j)) for i in range(8) for j in range(8))
    share = 8 / max(found.grams.count(), 8)
    return found.items.agg(F.count("*").alias("n_items")).select(
        "n_items", F.lit(len(found.singular)).alias("rank"), F.lit(bool(off < 1e-9)).alias("orthonormal"),
        F.lit(bool(share < found.explained <= 1 + 1e-9)).alias("explains_more_than_its_share"))
