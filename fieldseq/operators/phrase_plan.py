"""Turns a table of English descriptions into filters and token hints.

Phrases are found by the annotation operators. What they mean together is decided
by expressions over small per-text arrays: hard filters from unambiguous phrases,
and a list of beats (an action with a place) that is rendered as a token line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldseq.operators import annotate
from fieldseq.operators import lexicon as L
from fieldseq.operators.filters import FILTER_TYPE
from fieldseq.operators.skew import stacked
from fieldseq.spec import BANDS

_HIT = "struct<pos:int,value:string,phrase:string>"
_BEAT = "struct<action:string,band:string,channel:string,box:boolean>"
_TERM = "struct<pos:int,phrase:string,effect:string>"
_KINDS = {"channel": L.CHANNEL_PHRASES, "band": L.BAND_PHRASES, "action": L.ACTION_PHRASES,
          "pattern": L.PATTERN_PHRASES, "attack": {"attack": L.ATTACK_PHRASES}}


def _none(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _empty(item: str) -> Column:
    return F.array().cast(f"array<{item}>")


def _last(items: Column) -> Column:
    return F.try_element_at(items, F.lit(-1))


def _beat(action: str | Column, band: str | Column | None, channel: str | Column | None,
          box: bool | Column = False) -> Column:
    parts = [F.lit(p) if isinstance(p, (str, bool)) else _none("string") if p is None else p
             for p in (action, band, channel, box)]
    return F.struct(*[p.cast(t).alias(n) for p, t, n in zip(
        parts, ("string", "string", "string", "boolean"), ("action", "band", "channel", "box"),
        strict=True)])


def _lookup(key: Column, table: dict[str, str], default: Column) -> Column:
    keys_of: dict[str, list[str]] = {}
    for k, v in table.items():
        keys_of.setdefault(v, []).append(k)
    out = default
    for v, keys in keys_of.items():
        out = F.when(key.isin(keys), v).otherwise(out)
    return out


def _default_band(action: Column, default: str | Column = "M") -> Column:
    return _lookup(action, L.DEFAULT_BAND, F.lit(default) if isinstance(default, str) else default)


def _nearest(hits: Column, pos: Column) -> Column:
    """Value of the closest hit within reach; the earlier one on a tie."""
    near = F.filter(F.transform(hits, lambda h, i: F.struct(
        F.abs(h["pos"] - pos).alias("d"), i.alias("i"), h["value"].alias("value"))),
        lambda c: c["d"] <= L.NEAR)
    return F.array_min(near)["value"]


def _term(hit: Column, effect: str | Column) -> Column:
    text = F.lit(effect) if isinstance(effect, str) else effect
    return F.when(hit.isNotNull(), F.struct(hit["pos"].alias("pos"), hit["phrase"].alias("phrase"),
                                            text.alias("effect")))


def _found(texts: DataFrame, id_col: str) -> DataFrame:
    """Texts with one array of hits per kind, and the first free attack phrase."""
    flat = {f"{kind}:{value}": phrases for kind, values in _KINDS.items()
            for value, phrases in values.items()}
    hits = annotate.hits(texts, flat, id_col)
    hits = hits.withColumns({"kind": F.split_part("value", F.lit(":"), F.lit(1)),
                             "value": F.split_part("value", F.lit(":"), F.lit(2))})
    disjoint = annotate.resolve_overlaps(
        hits.filter(F.col("kind").isin("channel", "band", "action")), id_col, ["kind"])
    columns = [id_col, "kind", "value", "value_no", "phrase", "pos", "end"]
    patterns = hits.filter(F.col("kind") == "pattern").select(*columns)
    claimed = stacked([disjoint.filter(F.col("kind") != "action").select(*columns), patterns])
    attack = annotate.first_outside(hits.filter(F.col("kind") == "attack"), claimed, id_col)
    attack = attack.select(id_col, F.struct("pos", "phrase").alias("attack"))

    def of(kind: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct(
            F.col("pos").cast("int").alias("pos"), "value", "phrase"))))

    best = F.max_by(F.struct("value", "phrase", "pos"), F.when(
        F.col("kind") == "pattern",
        F.struct(F.length("phrase"), -F.col("value_no"), -F.col("pos"))))
    grouped = stacked([disjoint.select(*columns), patterns]).groupBy(id_col).agg(
        of("channel").alias("channels"), of("band").alias("bands"), of("action").alias("actions"),
        best.alias("pattern"))
    joined = texts.join(grouped, id_col, "left").join(attack, id_col, "left")
    return joined.withColumns({c: F.coalesce(c, _empty(_HIT))
                               for c in ("channels", "bands", "actions")})


def plan(texts: DataFrame, teams: DataFrame | None = None, competitions: DataFrame | None = None,
         id_col: str = "qid", aggressive: bool = False) -> DataFrame:
    """(id, text, filters, hint, terms, ignored) for every text.

    `teams` and `competitions` have one column `name`. `terms` lists which phrase
    had which effect; `ignored` holds the words nothing was made of. With
    `aggressive`, distinctive actions named in the text become must_include.
    """
    rows = _found(texts.select(id_col, "text"), id_col)
    for column, names in (("team", teams), ("competition", competitions)):
        if names is None:
            rows = rows.withColumn(column, _none("struct<phrase:string,pos:int>"))
        else:
            named = annotate.longest_entity(texts, names, id_col).select(
                id_col, F.struct(F.col("name").alias("phrase"), F.col("pos")).alias(column))
            rows = rows.join(named, id_col, "left")
    text = F.col("text")
    rows = rows.withColumns({name: annotate.first_match(text, phrases)
                             for name, phrases in L.FLAG_PHRASES.items()})
    rows = _with_filters(rows)
    rows = _with_beats(rows)
    rows = rows.withColumn("hint", _rendered())
    rows = rows.withColumn("terms", _terms())
    must = F.array_sort(F.array_distinct(F.filter(
        F.transform("beats", lambda b: b["action"]), lambda a: a.isin(*L.DISTINCTIVE))))
    values = {
        "team": F.col("team")["phrase"], "competition": F.col("competition")["phrase"],
        "play_pattern": F.col("pattern")["value"], "end_zone": F.col("end_zone"),
        "start_band": F.col("start_band"), "end_band": F.col("end_band"),
        "ended_in_shot": F.when(F.col("shot_hit").isNotNull() & F.col("goal_hit").isNull(), True),
        "ended_in_goal": F.when(F.col("goal_hit").isNotNull(), True),
        "min_xg": F.when(F.col("high_xg").isNotNull(), L.HIGH_XG),
        "min_events": F.when(F.col("long").isNotNull(), L.LONG_EVENTS)
        .when(F.col("patient").isNotNull(), L.PATIENT_EVENTS),
        "must_include": F.when(F.size(must) > 0, must) if aggressive else _none("array<string>")}
    struct = F.struct(*[values.get(f.name, _none(f.dataType.simpleString()))
                        .cast(f.dataType).alias(f.name) for f in FILTER_TYPE.fields])
    return rows.select(id_col, "text", struct.alias("filters"), "hint", "terms",
                       _ignored(text, F.col("terms")).alias("ignored"))


# --- filters ------------------------------------------------------------------------

def _with_filters(rows: DataFrame) -> DataFrame:
    text = F.col("text")
    bare = F.get(F.filter("actions", lambda h: h["value"] == "SHOT"), 0)
    bare = F.when(bare.isNotNull(), F.struct(bare["phrase"].alias("phrase"),
                                             bare["pos"].alias("pos")))
    of_goal_kick = (F.coalesce(F.col("pattern")["value"] == "From Goal Kick", F.lit(False))
                    & (F.lower(F.col("goal")["phrase"]) == "goal"))
    rows = rows.withColumns({
        "goal_hit": F.when(~of_goal_kick, F.col("goal")),
        "shot_hit": F.coalesce(F.col("shot"), bare, F.col("cutback"))})

    def band_effect(h: Column) -> Column:
        start = F.greatest(F.lit(0), h["pos"] - L.LEAD_IN)
        lead = F.lower(F.substring(text, start + 1, h["pos"] - start))
        prev = _last(F.filter("actions", lambda a: a["pos"] < h["pos"]))["value"]
        won = F.coalesce(prev.isin(*L.BALL_WINNING), F.lit(False))
        opens = F.lower(h["phrase"]).isin(*L.START_PHRASES) | (
            (h["value"] == "D") & _any_in(lead, L.DEFENSIVE_LEADS))
        final = h["value"] == "F"
        placed = lead.contains("in the")
        effect = (F.when(opens, "start").when(_any_in(lead, L.ARRIVAL_LEADS) & final, "end")
                  .when(placed & won, "won").when(placed & final, "end").otherwise("hint"))
        return F.struct(h["pos"].alias("pos"), h["phrase"].alias("phrase"),
                        h["value"].alias("value"), effect.alias("effect"), prev.alias("prev"))

    rows = rows.withColumn("band_roles", F.transform("bands", band_effect))
    starts = F.filter("band_roles", lambda r: r["effect"].isin("start", "won"))
    channels = sorted((p for ps in L.CHANNEL_PHRASES.values() for p in ps), key=len, reverse=True)
    pattern = (rf"(?i)\b(?:{L.SHOT_WORDS})\b[^.]{{0,20}}?\bfrom the\s+("
               + "|".join(channels) + r")\b")
    at = F.regexp_instr(text, F.lit(pattern))
    named = F.lower(F.regexp_extract(text, pattern, 1))
    channel = _none("string")
    for value, phrases in L.CHANNEL_PHRASES.items():
        channel = F.when(named.isin(*phrases), value).otherwise(channel)
    return rows.withColumns({
        "start_band": F.when(F.col("buildup").isNotNull(), "D").otherwise(_last(starts)["value"]),
        "end_band": F.when(F.exists("band_roles", lambda r: r["effect"] == "end"), "F"),
        "end_channel_named": channel,
        "end_zone": F.concat(F.lit("F-"), channel),
        "shot_from": F.when(at > 0, F.struct((at - 1).alias("pos"),
                                             F.regexp_extract(text, pattern, 0).alias("phrase")))})


def _any_in(text: Column, parts: tuple[str, ...]) -> Column:
    hit = text.contains(parts[0])
    for p in parts[1:]:
        hit = hit | text.contains(p)
    return hit


# --- beats ---------------------------------------------------------------------------

def _with_beats(rows: DataFrame) -> DataFrame:
    """Each step adds to the list of beats; the order of the steps matters."""
    rows = rows.withColumn("beats", _of_actions())
    for step in (_restart, _high_regain, _build_up, _rebound, _cutback_and_combo, _box,
                 _closing_shot):
        rows = rows.withColumn("beats", step(F.col("beats")))
    empty = F.size("beats") == 0
    rows = rows.withColumns({
        "attack_alone": F.col("attack").isNotNull() & empty,
        "attack_used": F.col("attack").isNotNull() & (empty | _falls_short(F.col("beats")))})
    for step in (_onward, _padding):
        rows = rows.withColumn("beats", step(F.col("beats")))
    return rows


def _of_actions() -> Column:
    def beat(h: Column) -> Column:
        shot = h["value"] == "SHOT"
        return _beat(h["value"], F.when(shot, "F").otherwise(_nearest(F.col("bands"), h["pos"])),
                     F.when(shot, F.coalesce("end_channel_named", F.lit("C")))
                     .otherwise(_nearest(F.col("channels"), h["pos"])))
    return F.transform("actions", beat)


def _last_channel() -> Column:
    return F.coalesce(_last(F.col("channels"))["value"], F.lit("C"))


def _restart(beats: Column) -> Column:
    """A restart opens its possession."""
    pattern = F.col("pattern")["value"]
    out = beats
    for name, (band, channel, into_box) in L.RESTARTS.items():
        where = F.coalesce(F.get("channels", 0)["value"], F.lit(channel))
        box = F.lit(into_box) & (F.col("box").isNotNull() | (F.lit(name) == "From Corner"))
        out = F.when(pattern == name,
                     F.concat(F.array(_beat("SETP", band, where, box)), beats)).otherwise(out)
    return out


def _high_regain(beats: Column) -> Column:
    """'high' near a word for winning the ball puts it in the last third."""
    def lifted(b: Column) -> Column:
        spot = F.get(F.filter("actions", lambda h: h["value"] == b["action"]), 0)["pos"]
        start = F.greatest(F.lit(0), spot - 12)
        around = F.lower(F.substring(F.col("text"), start + 1, spot + 24 - start))
        up = b["action"].isin(*L.BALL_WINNING) & b["band"].isNull() & around.contains("high")
        return F.when(F.coalesce(up, F.lit(False)), _beat(b["action"], "F", b["channel"], b["box"])) \
            .otherwise(b)
    return F.transform(beats, lifted)


def _build_up(beats: Column) -> Column:
    opening = F.array(_beat("RECV", "D", "C"), _beat("CARRY", "D", "C"),
                      _beat("PASS", "D", "LI"), _beat("RECV", "M", "LI"))
    return F.when(F.col("buildup").isNotNull(), F.concat(opening, beats)).otherwise(beats)


def _rebound(beats: Column) -> Column:
    """The ball is won back between two attempts."""
    shots = F.filter(F.transform(beats, lambda b, i: F.when(b["action"] == "SHOT", i)),
                     lambda i: i.isNotNull())
    at = F.coalesce(F.get(shots, 1), F.get(shots, 0), F.size(beats))
    inserted = F.concat(F.slice(beats, F.lit(1), at), F.array(_beat("RECOV", "F", "C")),
                        F.slice(beats, at + 1, F.size(beats)))
    return F.when(F.col("rebound").isNotNull(), inserted).otherwise(beats)


def _cutback_and_combo(beats: Column) -> Column:
    def near(hit: str, default: str) -> Column:
        return F.coalesce(_nearest(F.col("channels"), F.col(hit)["pos"]), F.lit(default))
    squared = F.array(_beat("PASS", "F", near("cutback", "R"), True))
    wall = _beat("PASS", "F", near("combo", "LI"))
    return F.concat(
        beats, F.when(F.col("cutback").isNotNull(), squared).otherwise(_empty(_BEAT)),
        F.when(F.col("combo").isNotNull(), F.array(wall, wall)).otherwise(_empty(_BEAT)))


def _box(beats: Column) -> Column:
    """The last ball that can be played into the box is; else it is carried there."""
    able = F.filter(F.transform(beats, lambda b, i: F.when(b["action"].isin(*L.CAN_MODIFY), i)),
                    lambda i: i.isNotNull())
    marked = F.transform(beats, lambda b, i: F.when(
        i == _last(able), _beat(b["action"], b["band"], b["channel"], True)).otherwise(b))
    carried = F.concat(beats, F.array(_beat(
        "CARRY", "F", F.coalesce(_last(beats)["channel"], F.lit("C")), True)))
    applies = F.col("box").isNotNull() & F.col("outside").isNull() & (F.size(beats) > 0)
    return F.when(applies, F.when(F.size(able) > 0, marked).otherwise(carried)).otherwise(beats)


def _closing_shot(beats: Column) -> Column:
    wanted = F.col("goal_hit").isNotNull() | F.col("shot_hit").isNotNull()
    there = F.exists(beats, lambda b: b["action"] == "SHOT")
    out = F.when(wanted & ~there, F.concat(beats, F.array(_beat("SHOT", "F", "C")))) \
        .otherwise(beats)
    moved = F.transform(out, lambda b: F.when(b["action"] == "SHOT", _beat("SHOT", "M", "C"))
                        .otherwise(b))
    return F.when(F.col("outside").isNotNull(), moved).otherwise(out)


def _falls_short(beats: Column) -> Column:
    """Does the list end before the last third, and not with a shot?"""
    last = _last(beats)
    band = F.coalesce(last["band"], _default_band(last["action"]))
    return F.coalesce((band != "F") & (last["action"] != "SHOT"), F.lit(False))


def _onward(beats: Column) -> Column:
    """An attack that names nothing further ends in the last third."""
    last, ch = _last(beats), _last_channel()
    fresh = F.array(_beat("RECOV", "M", ch), _beat("CARRY", "M", ch), _beat("RECV", "F", ch))
    on = F.coalesce(last["channel"], F.lit("C"))
    band = F.coalesce(last["band"], _default_band(last["action"]))
    longer = F.concat(beats, F.array(_beat("CARRY", band, on), _beat("RECV", "F", on)))
    lone = F.array(_beat("CARRY", F.coalesce(_last(F.col("bands"))["value"], F.lit("F")), ch))
    return (F.when(F.col("attack_alone"), fresh).when(F.col("attack_used"), longer)
            .when(F.size(beats) == 0, lone).otherwise(beats))


def _padding(beats: Column) -> Column:
    """Too short a line matches nothing; touches are put in front, never before a restart."""
    first = F.get(beats, 0)
    band = F.coalesce(first["band"], _default_band(first["action"]))
    ch = F.coalesce(first["channel"], F.lit("C"))
    short = (F.size(beats) < L.SHORTEST_HINT) & (first["action"] != "SETP")
    return F.when(short, F.concat(F.array(_beat("RECV", band, ch), _beat("CARRY", band, ch)),
                                  beats)).otherwise(beats)


# --- hint ------------------------------------------------------------------------------

def _tok(action: str | Column, band: Column, channel: Column, forward: Column | bool = False,
         box: Column | bool = False, pressure: Column | bool = False) -> Column:
    word = F.lit(action) if isinstance(action, str) else action
    able = word.isin(*L.CAN_MODIFY)
    ahead = F.lit(forward) if isinstance(forward, bool) else forward
    boxed = F.lit(box) if isinstance(box, bool) else box
    pressed = F.lit(pressure) if isinstance(pressure, bool) else pressure
    return F.concat(word, F.lit("@"), band, F.lit("-"), channel,
                    F.when(able & (ahead | word.isin(*L.ALWAYS_FORWARD)), "+").otherwise(""),
                    F.when(able & boxed, ">").otherwise(""),
                    F.when(pressed, "^").otherwise(""))


def _depth(band: Column) -> Column:
    return _lookup(band, {b: str(i) for i, b in enumerate(BANDS)}, _none("string")).cast("int")


def _rendered() -> Column:
    """Token line of the beats; moving between zones costs a pass and a receipt."""
    beats = F.col("beats")
    first = F.get(beats, 0)
    band0 = F.coalesce(first["band"], _default_band(first["action"]))
    ch0 = F.coalesce(first["channel"], F.lit("C"))
    pressed = F.col("pressure").isNotNull()
    named = _last_channel()
    end_channel = F.when(named.isin("L", "R"), "C").otherwise(named)

    arrives = F.array(_tok("PASS", F.col("start_band"), ch0, True), _tok("RECV", band0, ch0))
    wide = F.array(_tok("PASS", F.lit("M"), ch0, True), _tok("RECV", F.lit("F"), ch0),
                   _tok("CARRY", F.lit("F"), ch0))
    lead_in = (F.when(F.col("start_band").isNotNull() & (F.col("start_band") != band0), arrives)
               .when((band0 == "F") & first["action"].isin("CROSS", "DRIB"), wide)
               .otherwise(_empty("string")))

    def state(toks: Column, band: Column, ch: Column) -> Column:
        return F.struct(toks.alias("toks"), band.cast("string").alias("band"),
                        ch.cast("string").alias("ch"))

    def step(s: Column, x: Column) -> Column:
        b = x["b"]
        band = F.coalesce(b["band"], _default_band(b["action"], s["band"]))
        ch = F.coalesce(b["channel"], s["ch"])
        moved = (band != s["band"]) | (ch != s["ch"])
        linked = moved & (x["i"] > 0)
        ahead = moved & (_depth(band) > _depth(s["band"]))
        link = F.when(linked, F.array(_tok("PASS", s["band"], s["ch"], ahead, False, pressed),
                                      _tok("RECV", band, ch, False, False, pressed))) \
            .otherwise(_empty("string"))
        own = F.array(_tok(b["action"], band, ch, False, b["box"], pressed))
        into = b["box"] & (b["action"] != "SHOT")
        taken = F.when(into, F.array(_tok("RECV", F.lit("F"), end_channel))) \
            .otherwise(_empty("string"))
        arrived = linked & (b["action"] == "RECV")
        return F.when(arrived, state(F.concat(s["toks"], link), band, ch)).otherwise(
            state(F.concat(s["toks"], link, own, taken), F.when(into, "F").otherwise(band),
                  F.when(into, end_channel).otherwise(ch)))

    numbered = F.transform(beats, lambda b, i: F.struct(b.alias("b"), i.alias("i")))
    return F.aggregate(numbered, state(lead_in, band0, ch0), step,
                       lambda s: F.array_join(s["toks"], " "))


# --- trace ------------------------------------------------------------------------------

def _terms() -> Column:
    """Which phrase had which effect, by position."""
    def said(prefix: str, value: Column) -> Column:
        return F.concat(F.lit(prefix), value)

    roles = F.transform("band_roles", lambda r: F.struct(
        r["pos"].alias("pos"), r["phrase"].alias("phrase"),
        F.when(r["effect"] == "start", said("start_band = ", r["value"]))
        .when(r["effect"] == "won", F.concat(F.lit("start_band = "), r["value"],
                                             F.lit(", place of "), r["prev"]))
        .when(r["effect"] == "end", F.lit("end_band = F"))
        .otherwise(F.concat(F.lit("hint band "), r["value"])).alias("effect")))
    channels = F.transform("channels", lambda h: F.struct(
        h["pos"].alias("pos"), h["phrase"].alias("phrase"),
        F.concat(F.lit("hint channel "), h["value"]).alias("effect")))
    actions = F.transform("actions", lambda h: F.struct(
        h["pos"].alias("pos"), h["phrase"].alias("phrase"),
        said("hint action ", h["value"]).alias("effect")))
    single = F.array_compact(F.array(*[t.cast(_TERM) for t in (
        _term(F.col("team"), said("team = ", F.col("team")["phrase"])),
        _term(F.col("competition"), said("competition = ", F.col("competition")["phrase"])),
        _term(F.col("pattern"), said("play_pattern = ", F.col("pattern")["value"])),
        _term(F.col("goal_hit"), "ended_in_goal = true"),
        F.when(F.col("goal_hit").isNull(), _term(F.col("shot_hit"), "ended_in_shot = true")),
        _term(F.col("high_xg"), f"min_xg = {L.HIGH_XG}"),
        _term(F.col("long"), f"min_events = {L.LONG_EVENTS}"),
        F.when(F.col("long").isNull(), _term(F.col("patient"), f"min_events = {L.PATIENT_EVENTS}")),
        F.when(F.col("outside").isNull(), _term(F.col("box"), "hint mark >")),
        _term(F.col("outside"), "hint shot from M or wide F"),
        _term(F.col("pressure"), "hint mark ^"),
        _term(F.col("direct"), "hint mark +"),
        _term(F.col("shot_from"), said("end_zone = ", F.col("end_zone"))),
        _term(F.col("buildup"), "start_band = D; hint passes out of D"),
        _term(F.col("rebound"), "hint RECOV between two shots"),
        _term(F.col("cutback"), "hint PASS with mark >, then a shot"),
        _term(F.col("combo"), "hint two passes in a row"),
        F.when(F.col("attack_used"), _term(F.col("attack"), F.when(
            F.col("attack_alone"), "hint tokens of an attack up to F")
            .otherwise("hint last step into F"))))]))
    return F.array_sort(F.concat(single, roles.cast(f"array<{_TERM}>"),
                                 channels.cast(f"array<{_TERM}>"),
                                 actions.cast(f"array<{_TERM}>")))


def _ignored(text: Column, terms: Column) -> Column:
    spans = F.array_sort(F.transform(terms, lambda t: F.struct(
        t["pos"].alias("pos"), (t["pos"] + F.length(t["phrase"])).alias("end"))))

    def cut(s: Column, x: Column) -> Column:
        gap = F.when(x["pos"] > s["at"], F.array(F.substring(text, s["at"] + 1, x["pos"] - s["at"]))) \
            .otherwise(_empty("string"))
        return F.struct(F.concat(s["out"], gap).alias("out"),
                        F.greatest(s["at"], x["end"]).alias("at"))

    line = F.aggregate(
        spans, F.struct(_empty("string").alias("out"), F.lit(0).alias("at")), cut,
        lambda s: F.concat_ws(" ", s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    return F.trim(F.regexp_replace(line, r"\s+", " "))
