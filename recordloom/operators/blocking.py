"""Candidate generation: plans from two record DataFrames to distinct (source1_entity_id, entity_id) pairs.

Equi-joins but for shared tokens; the engine picks broadcast or shuffle by size, and
adaptive execution splits skewed keys.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.functions.text import combine_keys, prepare
from recordloom.operators.overlap import overlapping

MAX_DF = 100_000


class Blocker(Protocol):
    """Both take prepared records (see ``functions.text.prepare``); ``pairs`` may repeat a pair, ``candidates`` doesn't."""

    def pairs(self, s1: DataFrame, corpus: DataFrame) -> DataFrame: ...

    def candidates(self, s1: DataFrame, corpus: DataFrame) -> DataFrame: ...


@dataclass(frozen=True)
class KeyBlocker:
    """Equal, non-empty keys; with ``use_country`` equal countries too, of which the empty one is legal."""

    key: str
    use_country: bool = True

    def pairs(self, s1: DataFrame, corpus: DataFrame) -> DataFrame:
        on = ["country", "key"] if self.use_country else ["key"]
        side = lambda df, name: df.select(F.col("entity_id").alias(name), "country", self._key().alias("key")).where("key <> ''")
        return side(s1, "source1_entity_id").join(side(corpus, "entity_id"), on).select("source1_entity_id", "entity_id")

    def candidates(self, s1: DataFrame, corpus: DataFrame) -> DataFrame:
        return self.pairs(s1, corpus).distinct()

    def _key(self):
        return combine_keys(F.col("name_key"), F.col("address_key")) if self.key == "name_address" else F.col(self.key)


def token_document_frequency(corpus: DataFrame, tokens: str, use_country: bool = True) -> DataFrame:
    """(country, token, df): postings, that is rows, not distinct ids."""
    return _postings(corpus, "entity_id", tokens, use_country).groupBy("country", "token").agg(F.count("*").alias("df"))


def _postings(records: DataFrame, name: str, tokens: str, use_country: bool) -> DataFrame:
    country = F.col("country") if use_country else F.lit("GLOBAL")
    return records.select(F.col("entity_id").alias(name), country.alias("country"), F.explode(tokens).alias("token"))


@dataclass(frozen=True)
class TokenBlocker:
    """Records that share tokens.

    Of a query's tokens those posted at most ``max_df`` times are valid; if none
    is, the rarest posted one (the alphabetically first of equals) is. A record with
    ``min_overlap`` postings among the valid tokens is a candidate, and where fewer
    tokens are valid, one with as many postings as there are valid tokens.

    Frequent tokens are dropped before records meet. Shared tokens are then counted in
    memory, a part of the queries against a block of the records at a time (see
    ``operators.overlap``), so no row is written for a shared token. Source-1 ids are taken for unique.
    """

    tokens: str = "name_tokens"
    min_overlap: int = 2
    use_country: bool = True
    max_df: int = MAX_DF

    def pairs(self, s1: DataFrame, corpus: DataFrame) -> DataFrame:
        country = (F.col("country") if self.use_country else F.lit("GLOBAL")).alias("country")
        held = corpus.select("entity_id", country, self.tokens).where(F.size(self.tokens) > 0)
        held = held.groupBy("entity_id", "country").agg(F.array_sort(F.flatten(F.collect_list(self.tokens))).alias("tokens"))
        df = token_document_frequency(held, "tokens")
        known = _postings(s1, "source1_entity_id", self.tokens, self.use_country).join(df, ["country", "token"])
        known = known.groupBy("source1_entity_id", "country").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("known"))
        below = F.filter("known", lambda t: t["df"] <= self.max_df)
        valid = F.when(F.size(below) > 0, below).otherwise(F.slice("known", 1, 1))
        asked = known.select("source1_entity_id", "country", F.transform(valid, lambda t: t["token"]).alias("tokens"))
        n_asked, n_held = (r.groupBy(country).agg(F.count("*").alias("n")) for r in (s1, corpus))
        return overlapping(asked, held, n_asked, n_held, self.min_overlap)

    def candidates(self, s1: DataFrame, corpus: DataFrame) -> DataFrame:
        return self.pairs(s1, corpus)


@dataclass(frozen=True)
class HybridBlocker:
    """The union of any blockers' candidates.

    Key blockers are one join: each record gives a row for each of its keys, so
    records are prepared and shuffled once, however many keys there are.
    """

    children: tuple[Blocker, ...] = field(default_factory=lambda: (KeyBlocker("name_key"), KeyBlocker("address_key")))

    def pairs(self, s1: DataFrame, corpus: DataFrame) -> DataFrame:
        keyed = [b for b in self.children if isinstance(b, KeyBlocker)]
        found = [b.pairs(s1, corpus) for b in self.children if not isinstance(b, KeyBlocker)]
        if keyed:
            found.append(self._keys(s1, "source1_entity_id", keyed).join(self._keys(corpus, "entity_id", keyed), "key").select("source1_entity_id", "entity_id"))
        return reduce(DataFrame.unionByName, found)

    def candidates(self, s1: DataFrame, corpus: DataFrame) -> DataFrame:
        return self.pairs(s1, corpus).distinct()

    @staticmethod
    def _keys(records: DataFrame, name: str, keyed: list[KeyBlocker]) -> DataFrame:
        """(name, key): a struct of the blocker's number, the country where it counts, and the key."""
        of = [F.struct(F.lit(k).alias("of"), (F.col("country") if b.use_country else F.lit("")).alias("country"), b._key().alias("value")) for k, b in enumerate(keyed)]
        return records.select(F.col("entity_id").alias(name), F.explode(F.array(*of)).alias("key")).where("key.value <> ''")


#: The baseline's two keys, without country; a key of both fields could add nothing.
BASELINE = HybridBlocker((KeyBlocker("ascii_name", use_country=False), KeyBlocker("ascii_address", use_country=False)))

BLOCKERS: dict[str, Callable[[], Blocker]] = {
    "exact_name": lambda: KeyBlocker("name_key"),
    "exact_address": lambda: KeyBlocker("address_key"),
    "token_name": TokenBlocker,
    "hybrid": HybridBlocker,
    "exact_name_global": lambda: KeyBlocker("name_key", use_country=False),
    "exact_address_global": lambda: KeyBlocker("address_key", use_country=False),
    "stripped_name": lambda: KeyBlocker("name_stripped_key"),
    "name_address": lambda: KeyBlocker("name_address", use_country=False),
    "token_address": lambda: TokenBlocker(tokens="address_tokens"),
    "token_global": lambda: TokenBlocker(use_country=False),
    "baseline": lambda: BASELINE,
}


def get_blocker(name: str) -> Blocker:
    if name not in BLOCKERS:
        raise ValueError(f"unknown blocker: {name}; there are {', '.join(BLOCKERS)}")
    return BLOCKERS[name]()


def block(s1: DataFrame, corpus: DataFrame, blocker: str | Blocker, unicode: str = "nfkc") -> DataFrame:
    """Candidates of raw records."""
    own = get_blocker(blocker) if isinstance(blocker, str) else blocker
    return own.candidates(prepare(s1, unicode), prepare(corpus, unicode))
