"""Names of any number found in texts by one automaton over all their spellings.

Spellings are lower-cased and put into an Aho-Corasick automaton, built once in a Python worker; a text is read once, and every
spelling that stands in it at word borders is a match. From these either all names are told, or those of the longest spellings first, no
character used twice. The plan has one function however many names there are.

A table of spellings up to MOST_BYTES is sent to the workers; its size is summed before. A larger one is dealt into
shards of that size, which read the texts one after the other; their matches meet by row before they are chosen from.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import stored

#: Bytes of names and spellings that a worker holds; an automaton takes about 20 times that.
MOST_BYTES = 16 << 20
MATCH = "start int, end int, place int, name string"
WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
PLAIN = re.compile(r"[a-z0-9.+-]+")


class Match(NamedTuple):
    """A spelling in a text: from start to end, its place in the order of spellings, and its name."""

    start: int
    end: int
    place: int
    name: str


def lowered(text: str) -> str:
    """The text in lower case, character by character, so that places stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


class Spellings:
    """An automaton over (name, spelling) pairs. Longer spellings come first in order, then as given.

    bordered: whether a spelling of other than plain characters needs borders too; a border is any character but a-z and 0-9.
    """

    def __init__(self, pairs: list[tuple[str, str]], bordered: bool) -> None:
        self.automaton = ahocorasick.Automaton()
        each: dict[str, list[tuple[int, str]]] = {}
        pairs = [(n, low) for n, a in pairs if (low := lowered(a))]
        for place, (name, low) in enumerate(sorted(pairs, key=lambda x: -len(x[1]))):
            each.setdefault(low, []).append((place, name))
        for low, names in each.items():
            self.automaton.add_word(low, (len(low), bordered or PLAIN.fullmatch(low) is not None, names))
        if each:
            self.automaton.make_automaton()
        self.empty = not each

    def matches(self, text: str | None) -> list[Match]:
        if not text or self.empty:
            return []
        low, out = lowered(text), []
        for last, (size, border, names) in self.automaton.iter(low):
            start, end = last + 1 - size, last + 1
            if border and ((start and low[start - 1] in WORD) or (end < len(low) and low[end] in WORD)):
                continue
            out += [Match(start, end, place, name) for place, name in names]
        return out


def longest_first(matches: list[Match]) -> list[Match]:
    """Matches of longer spellings first, none of which uses a character that one before it has used; spellings of several names tell the first."""
    taken: dict[int, int] = {}
    out = []
    for m in sorted(matches, key=lambda m: (-(m.end - m.start), m.place, m.start)):
        if not any(i in taken for i in range(m.start, m.end)):
            taken.update(dict.fromkeys(range(m.start, m.end), m.place))
            out.append(m)
    return sorted(out)


@lru_cache(4)
def built(pairs: tuple[tuple[str, str], ...], bordered: bool) -> Spellings:
    return Spellings(list(pairs), bordered)


def flat(names: dict[str, tuple[str, ...]]) -> tuple[tuple[str, str], ...]:
    return tuple((n, a) for n, some in names.items() for a in dict.fromkeys((n, *some)))


def names_in(text: Column, pairs: tuple[tuple[str, str], ...], exclusive: bool = False, bordered: bool = True) -> Column:
    """Names of a text, distinct, in the order of pairs; exclusive: of the longest spellings first alone. pairs: a bounded vocabulary."""
    size = sum(len(n.encode()) + len(a.encode()) for n, a in pairs)
    if size > MOST_BYTES:
        raise ValueError(f"{size} bytes of names: found() takes a table of any size")
    order = {n: i for i, n in reversed(list(enumerate(dict.fromkeys(n for n, _ in pairs))))}

    def run(texts: pd.Series) -> pd.Series:
        known = built(pairs, bordered)
        each = ((longest_first(m) if exclusive else m) for m in map(known.matches, texts))
        return pd.Series([sorted({m.name for m in some}, key=order.__getitem__) for some in each])

    return F.pandas_udf(run, "array<string>")(text)


def found(texts: DataFrame, row_id: str, text: str, spellings: DataFrame, name: str = "name", spelling: str = "spelling", exclusive: bool = True, bordered: bool = False) -> DataFrame:
    """row_id, start, end, name: the names of every text, in code points; longest spellings first, or all that there are.

    spellings: a table (name, spelling) of any size. row_id tells texts apart.
    """
    pairs = spellings.select(F.col(name).cast("string").alias("name"), F.col(spelling).cast("string").alias("spelling")).where("name IS NOT NULL AND spelling <> ''").distinct()
    size = pairs.agg(F.sum(F.octet_length("name") + F.octet_length("spelling")).alias("n")).first().n or 0
    shards = max(1, -(-int(size) * 5 // (4 * MOST_BYTES)))
    kind = texts.schema[row_id].dataType.simpleString()
    parts = []
    for shard in range(shards):
        some = pairs if shards == 1 else pairs.where(F.pmod(F.xxhash64("spelling"), F.lit(shards)) == shard)
        sent = texts.sparkSession.sparkContext.broadcast(tuple(sorted((r.name, r.spelling) for r in some.toLocalIterator())))
        part = texts.select(F.col(row_id), F.col(text)).mapInArrow(matched(sent, bordered), f"`{row_id}` {kind}, m array<struct<{MATCH.replace(' ', ':').replace(',:', ', ')}>>")
        parts.append(part if shards == 1 else stored(part, "matches"))
    one = parts[0]
    for part in parts[1:]:
        one = one.unionByName(part)
    if shards > 1:
        one = one.groupBy(row_id).agg(F.flatten(F.collect_list("m")).alias("m"))  # one row for each shard
    if exclusive:
        one = one.select(row_id, chosen("m").alias("m"))
    return one.select(row_id, F.inline("m")).drop("place")


def matched(sent, bordered: bool):
    """For mapInArrow: the matches of each text with the shard's spellings."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = built(sent.value, bordered)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("place", pa.int32()), ("name", pa.string())]))
        for batch in batches:
            found = [[m._asdict() for m in known.matches(t.as_py())] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], [batch.schema.names[0], "m"])

    return rows


def _chosen(matches: pd.Series) -> pd.Series:
    """Ties of spellings of one length go by name, as places differ from shard to shard."""
    each = ([Match(m["start"], m["end"], 0, m["name"]) for m in some] for some in matches)
    return pd.Series([[m._asdict() for m in longest_first(sorted(some, key=lambda m: m.name))] for some in each])


def chosen(matches: Column | str) -> Column:
    return F.pandas_udf(_chosen, f"array<struct<{MATCH.replace(' ', ':').replace(',:', ', ')}>>")(matches)
