"""Column expressions of the token grammar: zones, actions, modifiers, tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldseq.spec import (BANDS, CHANNELS, DEFAULT_GRID, RESTART_PASS_TYPES,
                           TYPE_TO_ACTION, GridSpec)

MODIFIER_CHARS = "+>^"
# Whitespace as Unicode defines it, spelled so that Java and RE2 read it alike.
WHITESPACE = r"[\s\x0b\x1c-\x1f\x{85}\pZ]+"


def _cell(value: Column, size: float, last: int) -> Column:
    """Index of the grid cell holding a coordinate; outside values go to the edge."""
    cell = F.greatest(F.lit(0), F.least(F.lit(last), F.floor(value / F.lit(size)).cast("int")))
    return F.when(value.isNotNull(), cell)


def band_index(x: Column, grid: GridSpec = DEFAULT_GRID) -> Column:
    return _cell(x, grid.band_width, len(BANDS) - 1)


def channel_index(y: Column, grid: GridSpec = DEFAULT_GRID) -> Column:
    return _cell(y, grid.channel_width, len(CHANNELS) - 1)


def _name_of(index: Column, names: tuple[str, ...]) -> Column:
    named = F.when(index == 0, names[0])
    for i, name in enumerate(names[1:], 1):
        named = named.when(index == i, name)
    return named


def band(x: Column, grid: GridSpec = DEFAULT_GRID) -> Column:
    return _name_of(band_index(x, grid), BANDS)


def channel(y: Column, grid: GridSpec = DEFAULT_GRID) -> Column:
    return _name_of(channel_index(y, grid), CHANNELS)


def zone(x: Column, y: Column, grid: GridSpec = DEFAULT_GRID) -> Column:
    return F.concat(band(x, grid), F.lit("-"), channel(y, grid))


def action(event_type: Column, pass_type: Column, is_cross: Column, technique: Column,
           x: Column, y: Column, end_x: Column, end_y: Column,
           grid: GridSpec = DEFAULT_GRID) -> Column:
    """Action word of an event; null for event types outside the vocabulary."""
    lateral = F.abs(end_y - y) >= grid.switch_dy
    level = F.abs(end_x - x) < grid.switch_dx
    of_pass = (F.when(pass_type.isin(*RESTART_PASS_TYPES), "SETP")
               .when(is_cross, "CROSS")
               .when(technique == "Through Ball", "THROUGH")
               .when(lateral & level, "SWITCH")
               .otherwise("PASS"))
    word = F.when(event_type == "Pass", of_pass)
    for name, mapped in TYPE_TO_ACTION.items():
        word = word.when(event_type == name, mapped)
    return word


def modifiers(action_word: Column, x: Column, end_x: Column, end_y: Column,
              under_pressure: Column, grid: GridSpec = DEFAULT_GRID) -> Column:
    """Fixed-order suffix: forward, into the box, under pressure. Shots take the last only."""
    has_end = (action_word != "SHOT") & end_x.isNotNull()
    forward = (end_x - x >= grid.progressive) | (band_index(end_x, grid) > band_index(x, grid))
    boxed = (end_x >= grid.box_x) & end_y.between(grid.box_y_min, grid.box_y_max)
    return F.concat(F.when(has_end & forward, "+").otherwise(""),
                    F.when(has_end & boxed, ">").otherwise(""),
                    F.when(under_pressure, "^").otherwise(""))


def token(action_word: Column, x: Column, y: Column, end_x: Column, end_y: Column,
          under_pressure: Column, grid: GridSpec = DEFAULT_GRID) -> Column:
    """`ACTION@ZONE` plus modifiers; null when there is no action or no place."""
    return F.concat(action_word, F.lit("@"), zone(x, y, grid),
                    modifiers(action_word, x, end_x, end_y, under_pressure, grid))


def lexeme(token_text: Column) -> Column:
    """Fold a token (or a line of tokens) into plain lower-case words."""
    folded = F.translate(F.lower(token_text), "@-", "__")
    for mark, word in (("+", "_prg"), (">", "_box"), ("^", "_prs")):
        folded = F.replace(folded, F.lit(mark), F.lit(word))
    return folded


def clock_seconds(minute: Column, second: Column) -> Column:
    return F.coalesce(minute, F.lit(0)) * 60 + F.coalesce(second, F.lit(0))


def possession_uid(match_id: Column, possession: Column) -> Column:
    return F.concat_ws(":", match_id.cast("string"), possession.cast("string"))


def split_uid(uid: Column) -> tuple[Column, Column]:
    return (F.split_part(uid, F.lit(":"), F.lit(1)).cast("bigint"),
            F.split_part(uid, F.lit(":"), F.lit(2)).cast("bigint"))


# --- reading token strings back -------------------------------------------------

def tokens_of(token_string: Column) -> Column:
    return F.split(token_string, " ")


def zone_of(token_text: Column) -> Column:
    """Zone part of a token, empty when the text has no zone."""
    return F.rtrim(F.split_part(token_text, F.lit("@"), F.lit(2)), F.lit(MODIFIER_CHARS))


def band_of(token_text: Column) -> Column:
    return F.split_part(zone_of(token_text), F.lit("-"), F.lit(1))


def side_of(zone_text: Column) -> Column:
    """Flank of a zone: L, R, or C for the middle."""
    part = F.split_part(zone_text, F.lit("-"), F.lit(-1))
    return F.when(part.isin("L", "LI"), "L").when(part.isin("R", "RI"), "R").otherwise("C")


def any_token(tokens: Column, *prefixes: str) -> Column:
    return F.exists(tokens, lambda t: _starts(t, prefixes))


def first_index(tokens: Column, *prefixes: str) -> Column:
    """0-based place of the first token with one of the prefixes, else null."""
    flags = F.transform(tokens, lambda t: _starts(t, prefixes))
    place = F.array_position(flags, True)
    return F.when(place > 0, (place - 1).cast("int"))


def shot_indices(tokens: Column) -> Column:
    """0-based places of all shots."""
    places = F.transform(tokens, lambda t, i: F.when(t.startswith("SHOT"), i))
    return F.filter(places, lambda i: i.isNotNull())


def last_shot_zone(token_string: Column) -> Column:
    """Zone of the last shot, empty when there is none."""
    return F.regexp_extract(token_string, r"^(?:.* )?SHOT@([DMF]-[LRCI]+)", 1)


def _starts(text: Column, prefixes: tuple[str, ...]) -> Column:
    hit = text.startswith(prefixes[0])
    for prefix in prefixes[1:]:
        hit = hit | text.startswith(prefix)
    return hit


# --- sequences --------------------------------------------------------------------

def collapse_repeats(items: Column) -> Column:
    """Drop items equal to the one before them."""
    return F.filter(items, lambda z, i: (i == 0) | (z != F.get(items, i - 1)))


def is_subsequence(shape: Column, path: Column) -> Column:
    """Do the shape's items occur in the path in order, gaps allowed?"""
    matched = F.aggregate(path, F.lit(0),
                          lambda n, z: F.when(z == F.get(shape, n), n + 1).otherwise(n))
    return matched == F.size(shape)


def ngrams(tokens: Column, longest: int = 3) -> Column:
    """All 1..longest-grams, space-joined. Short inputs give the ones that exist."""
    parts = [tokens]
    for n in range(2, longest + 1):
        # Grams one word shorter, each joined with the word that follows it.
        starts = F.greatest(F.lit(0), F.size(tokens) - (n - 1))
        parts.append(F.zip_with(F.slice(parts[-1], F.lit(1), starts),
                                F.slice(tokens, F.lit(n), starts),
                                lambda gram, word: F.concat(gram, F.lit(" "), word)))
    return F.concat(*parts)


def words(text: Column) -> Column:
    """Whitespace-separated, case-kept words of a text; no empty words."""
    return F.filter(F.split(text, WHITESPACE), lambda w: w != "")
