"""All occurrences of many phrases in one pass over each text.

The phrases of a block are compiled into one Aho-Corasick automaton, which tasks run over
batches of texts: the time for a text does not depend on the number of phrases. Tables of
phrases of any size are taken in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldseq.operators.skew import stacked

#: Phrases, and their bytes together, that one automaton holds.
PHRASES, PHRASE_BYTES = 50_000, 4 << 20
#: Hits a task holds before it sends them.
HITS = 100_000


def compiled(phrases: list[tuple[object, str]]):
    """Automaton from (number, phrase); equal phrases share a state. None without phrases."""
    import ahocorasick
    by_text: dict[str, list] = {}
    for number, phrase in phrases:
        if phrase:
            by_text.setdefault(phrase, []).append(number)
    if not by_text:
        return None
    machine = ahocorasick.Automaton()
    for phrase, numbers in by_text.items():
        machine.add_word(phrase, (len(phrase), numbers))
    machine.make_automaton()
    return machine


def _places(machine, text: str, words: bool, once: bool, leading: bool) -> Iterator[tuple[object, int]]:
    """(number, position) of phrases in a text, by the end of the phrase."""
    seen = set()
    for end, (length, numbers) in machine.iter(text):
        if once and length and numbers[0] in seen:
            continue
        at = end + 1 - length
        whole = not words or not ((at and text[at - 1].isalnum()) or text[end + 1:end + 2].isalnum())
        if once and (whole or leading):
            seen.add(numbers[0])
        if whole:
            for number in numbers:
                yield number, at


def _scan(phrases: list[tuple[object, str]], id_col: str, text_col: str, words: bool, once: bool,
          leading: bool, lowest: bool):
    everywhere = [(number, 0) for number, phrase in phrases if phrase == ""]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = compiled(phrases)
        out: list[tuple] = []
        for batch in batches:
            for key, text in zip(batch[id_col], batch[text_col]):
                if text is None:
                    continue
                found = [*everywhere, *(_places(machine, text, words, once, leading) if machine else ())]
                out += [(key, *hit) for hit in ([min(found)] if lowest and found else found)]
                if len(out) >= HITS:
                    yield pd.DataFrame(out, columns=[id_col, "number", "pos"])
                    out = []
        yield pd.DataFrame(out, columns=[id_col, "number", "pos"])
    return run


def occurrences(texts: DataFrame, phrases: DataFrame, id_col: str = "id", text_col: str = "text",
                words: bool = False, once: bool = False, leading: bool = False, lowest: bool = False,
                most: int = PHRASES, most_bytes: int = PHRASE_BYTES) -> DataFrame:
    """(id, number, pos): where each phrase (number long, phrase) stands in each text, 0-based.

    With `words`, only where no letter or digit touches it; with `once`, only the first such
    place; with `leading` as well, none unless the first place of all is such a place. With
    `lowest`, only the phrase with the smallest number, for each text and block. The empty phrase stands at the start of every text; null texts and phrases give no
    rows. Phrases are cut into blocks by hash, none larger than an automaton may be, and the
    texts are read once per block.
    """
    known = phrases.filter("phrase is not null").select(F.col("number").cast("long"), "phrase")
    size = known.agg(F.count("*").alias("n"), F.sum(F.octet_length("phrase")).alias("b")).first()
    out = T.StructType([texts.schema[id_col], T.StructField("number", T.LongType()), T.StructField("pos", T.IntegerType())])
    blocks = max(1, -(-size.n // max(1, most // 2)), -(-(size.b or 0) // max(1, most_bytes // 2)))
    place = F.pmod(F.xxhash64("phrase"), F.lit(blocks))
    parts = []
    for block in range(blocks):
        held = [tuple(r) for r in known.filter(place == block).collect()]
        if held or not parts:
            parts.append(texts.select(id_col, text_col).mapInPandas(_scan(
                held, id_col, text_col, words, once, leading, lowest), out))
    return stacked(parts)
