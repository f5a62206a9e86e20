"""Queries on phrase annotation of texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldseq.operators import annotate
from fieldseq.plans.base import cte, query, table, with_sql

# Short words of the given prose; endings and overlaps occur often.
WORDS = {"A": ("the", "that", "th", "the on"), "B": ("and", "an", "han", "and the"),
         "C": ("on", "ion", "er on", "la", "le")}
NEAR_WORDS = {"N": ("in", "que", "der"), "M": ("it", "de", "ein")}

# Where an accented letter stands next to a phrase, word boundaries differ between
# regular-expression engines; in the SQL twin such letters become a plain one.
_PLAIN = "regexp_replace({}, '[À-ÖØ-öø-ɏ]', 'x', 'g')"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def hit_ctes(p: str, source: str, lexicon) -> None:
    """Table `{p}_hits(id, value, value_no, phrase, pos, fin)` over a source (id, text)."""
    parts = " union all ".join(f"""
      select id, '{v}' as value, {no} as value_no, regexp_extract_all(t, {_quoted(annotate.phrase_regex(ws))}) as m,
        string_split_regex(t, {_quoted(annotate.phrase_regex(ws))}) as g
      from (select id, {_PLAIN.format('text')} as t from ({source}))"""
                               for no, (v, ws) in enumerate(lexicon.items()))
    cte(f"{p}_raw", parts)
    cte(f"{p}_hits", f"""select id, value, value_no, substr(o.text, pos + 1, fin - pos) as phrase, pos, fin from (
        select id, value, value_no, (fin - length(phrase))::int as pos, fin::int as fin from (
          select id, value, value_no, phrase, sum(length(phrase) + length(gap)) over
            (partition by id, value_no order by i) as fin
          from (select id, value, value_no, unnest(m) as phrase, unnest(g[1:len(m)]) as gap,
            generate_subscripts(m, 1) as i from {p}_raw where len(m) > 0)))
      join ({source}) o using (id)""", (f"{p}_raw",))


_DOCS = "select doc_id as id, text from documents"
_TURNS = "select conv_id * 1000 + turn as id, text from conversations"
hit_ctes("dh", _DOCS, WORDS)
hit_ctes("dn", _DOCS, NEAR_WORDS)
hit_ctes("ch", _TURNS, WORDS)


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


def turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")


@query("phrase_hits", with_sql(("dh_hits",), "select id, value, phrase, pos from dh_hits"))
def phrase_hits(spark, sf_dir):
    return annotate.hits(documents(spark, sf_dir), WORDS).select("id", "value", "phrase", "pos")


cte("resolved", """with recursive kept as (
    select id, value, pos, fin from (select *, row_number() over (partition by id
      order by pos, fin desc, value_no) as o from ch_hits) where o = 1
    union all
    select id, value, pos, fin from (select h.id, h.value, h.pos, h.fin, row_number() over
        (partition by h.id order by h.pos, h.fin desc, h.value_no) as o
      from kept k join ch_hits h on h.id = k.id and h.pos >= k.fin) where o = 1)
  select * from kept""", ("ch_hits",))


@query("phrase_overlap_resolved", with_sql(("resolved",), "select id, value, pos, fin from resolved"))
def phrase_overlap_resolved(spark, sf_dir):
    kept = annotate.resolve_overlaps(annotate.hits(turns(spark, sf_dir), WORDS))
    return kept.select("id", "value", "pos", F.col("end").alias("fin"))


cte("probes", "select distinct id, pos as probe from dn_hits where value = 'N'", ("dn_hits",))
cte("targets", "select id, pos, value from dn_hits where value = 'M'", ("dn_hits",))


def near_tables(spark, sf_dir):
    found = annotate.hits(documents(spark, sf_dir), NEAR_WORDS)
    probes = found.filter(F.col("value") == "N").select("id", F.col("pos").alias("probe"))
    return found, probes


@query("asof_preceding", with_sql(("probes", "dh_hits"), """
select p.id, p.probe, h.value from probes p asof left join
  (select id, pos, any_value(value order by value_no desc) as value from dh_hits group by id, pos) h
  on p.id = h.id and p.probe > h.pos"""))
def asof_preceding(spark, sf_dir):
    """Lexicon value named last before each probe word."""
    found = annotate.hits(documents(spark, sf_dir), WORDS)
    last_named = found.groupBy("id", "pos").agg(F.max_by("value", "value_no").alias("value"))
    return annotate.preceding(last_named, near_tables(spark, sf_dir)[1])


@query("nearest_binding", with_sql(("probes", "targets"), """
select p.id, p.probe, t.pos::double as bound from probes p left join (
  select p.id, p.probe, arg_min(t.pos, (abs(t.pos - p.probe), t.pos)) as pos
  from probes p join targets t on t.id = p.id and t.pos between p.probe - 40 and p.probe + 40
  group by p.id, p.probe) t using (id, probe)"""))
def nearest_binding(spark, sf_dir):
    """Closest target word within 40 characters of each probe word."""
    found, probes = near_tables(spark, sf_dir)
    targets = found.filter(F.col("value") == "M").select("id", "pos", F.col("pos").alias("value"))
    found = annotate.nearest(targets, probes)
    return found.select("id", "probe", F.col("value").cast("double").alias("bound"))


@query("hits_outside_spans", with_sql(("ch_hits",), """
select id, phrase, pos from ch_hits h where value = 'C' and not exists (
  select 1 from ch_hits s where s.id = h.id and s.value <> 'C' and h.pos < s.fin and h.fin > s.pos)"""))
def hits_outside_spans(spark, sf_dir):
    found = annotate.hits(turns(spark, sf_dir), WORDS)
    mine = found.filter(F.col("value") == "C")
    return annotate.outside(mine, found.filter(F.col("value") != "C")).select("id", "phrase", "pos")


@query("first_outside_spans", with_sql(("ch_hits",), """
select id, min(pos) as pos from ch_hits h where value = 'C' and not exists (
  select 1 from ch_hits s where s.id = h.id and s.value <> 'C' and h.pos < s.fin and h.fin > s.pos)
group by id"""))
def first_outside_spans(spark, sf_dir):
    found = annotate.hits(turns(spark, sf_dir), WORDS)
    mine = found.filter(F.col("value") == "C")
    return annotate.first_outside(mine, found.filter(F.col("value") != "C")).select("id", "pos")


cte("cover", "select id, unnest(range(pos, fin)) as k from ch_hits", ("ch_hits",))


@query("uncovered_text", with_sql(("cover",), f"""
select id, trim(regexp_replace(coalesce(line, ''), '[ \\t\\n\\r\\f]+', ' ', 'g')) as uncovered
from ({_TURNS}) t left join (
  select id, string_agg(case when covered then ' ' else c end, '' order by k) as line from (
    select t.id, t.k, t.c, v.k is not null as covered from (
      select id, unnest(range(0, length(text))) as k, unnest(string_split(text, '')) as c
      from ({_TURNS})) t
    left join (select distinct id, k from cover) v on v.id = t.id and v.k = t.k) group by id)
  using (id)"""))
def uncovered_text(spark, sf_dir):
    texts = turns(spark, sf_dir)
    return annotate.uncovered(texts, annotate.hits(texts, WORDS))


cte("names", """select distinct name from (
    select array_to_string(string_split(text, ' ')[1:k], ' ') as name
    from benchmark, unnest(range(1, 6)) as r(k)
    union all select concat(repeat('*', k), '') from unnest(range(3, 5)) as r(k)) where name <> ''""")


@query("entity_longest", with_sql(("names",), """
select id, name, pos from (
  select id, name, pos, row_number() over (partition by id order by length(name) desc, name) as o from (
    select id, name, position(lower(name) in lower(text)) - 1 as pos, lower(text) as low
    from (select doc_id as id, text from documents), names where contains(lower(text), lower(name)))
  where not regexp_matches(case when pos = 0 then '' else substr(low, pos, 1) end, '[\\p{L}\\p{N}]')
    and not regexp_matches(substr(low, pos + length(name) + 1, 1), '[\\p{L}\\p{N}]')) where o = 1"""))
def entity_longest(spark, sf_dir):
    """Openings of 1 to 5 words of the benchmark passages, and marks, as names in all documents."""
    words = F.split("text", " ")
    names = table(spark, sf_dir, "benchmark").select(F.explode(F.array(
        F.lit("***"), F.lit("****"), *[F.array_join(F.slice(words, 1, k), " ") for k in range(1, 6)])
        ).alias("name"))
    return annotate.longest_entity(documents(spark, sf_dir), names)
