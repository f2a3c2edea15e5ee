"""Labelling sequences with the dictionary's prefixes.

Games are joined to openings on equality with one of their prefixes, by whole tokens, and
never on ``startswith``:

* a dictionary of small size is broadcast once and looked up by every prefix length, so games are not shuffled at
  all and popular sequences cost nothing extra. Files that it is made from tell its size if they are small; of larger
  ones, which may hold few distinct openings, it is written once to the shared folder and its own size counts;
* any other is matched on the distinct sequences and joined back. A prefix that nearly all
  sequences share is split by adaptive skew handling, into as many parts as its rows need.

Either way a game gets its ``chain``: the matching openings from shallowest to deepest.
Of openings with equal sequences the greatest id counts as the deepest.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqstats.functions.moves import prefixes, token_count
from seqstats.session import small_on_disk, written

CHAIN = "array<struct<id: string, moves: string, name: string>>"


def match_prefixes(
    games: DataFrame, openings: DataFrame, seq: str = "moves", n: int = 10, moves: str = "moves"
) -> DataFrame:
    """One row per game and matching opening, none for a game without a match.

    ``real_game`` is 1 on the game's deepest match and 0 on the others.
    """
    matched = with_chain(games, openings, seq, n, moves)
    last = F.size("chain") - 1
    return matched.select(*games.columns, F.posexplode("chain").alias("pos", "m"), last.alias("last")).select(
        *games.columns,
        F.col("m.id").alias("matched_id"),
        F.col("m.moves").alias("matched_moves"),
        (F.col("pos") == F.col("last")).cast("long").alias("real_game"),
    )


def deepest_match(
    games: DataFrame, openings: DataFrame, seq: str = "moves", n: int = 10, moves: str = "moves"
) -> DataFrame:
    """The longest matching opening of every matched game."""
    matched = with_chain(games, openings, seq, n, moves).where(F.size("chain") > 0)
    return _with_match(matched, games.columns, F.element_at("chain", -1))


def match_by_name_and_prefix(
    games: DataFrame, openings: DataFrame, seq: str = "moves", name: str = "original_name", n: int = 10,
    moves: str = "moves",
) -> DataFrame:
    """Longest matching opening whose name contains the game's base opening name.

    The base name is the text before the first colon. Every game is kept; the match is
    NULL where there is none.
    """
    base = F.substring_index(F.col(name), ":", 1)
    candidates = F.filter("chain", lambda m: F.contains(m["name"], base))
    return _with_match(
        with_chain(games, openings, seq, n, moves), games.columns, F.try_element_at(candidates, F.lit(-1))
    )


def _with_match(df: DataFrame, columns: list[str], match: Column) -> DataFrame:
    return df.select(*columns, match.alias("m")).select(
        *columns, F.col("m.id").alias("matched_id"), F.col("m.moves").alias("matched_moves")
    )


def with_chain(games: DataFrame, openings: DataFrame, seq: str, n: int, moves: str = "moves") -> DataFrame:
    """Games with the ``chain`` of matches among their first ``n`` tokens, empty if none."""
    named = F.col("name") if "name" in openings.columns else F.lit(None).cast("string")
    entries = openings.where((F.col(moves) != "") & (token_count(F.col(moves)) <= n)).select(
        F.col(moves).alias("key"), "id", named.alias("name"), token_count(F.col(moves)).alias("tokens")
    )
    dictionary, small = _by_key(entries), small_on_disk(openings)
    if not small and openings.inputFiles():
        dictionary = written(dictionary, "dictionary")
        small = small_on_disk(dictionary)
    return (_chain_by_lookup if small else _chain_by_shuffle)(games, dictionary, seq, n)


def _by_key(entries: DataFrame) -> DataFrame:
    """One row per distinct dictionary sequence, its openings by ascending id."""
    opening = F.struct("id", F.col("key").alias("moves"), "name")
    return entries.groupBy("key", "tokens").agg(F.sort_array(F.collect_list(opening)).alias("hits"))


def _chain_by_lookup(games: DataFrame, dictionary: DataFrame, seq: str, n: int) -> DataFrame:
    """A lookup per prefix length in one broadcast dictionary. No shuffle of games."""

    def look_up(df: DataFrame, k: int) -> DataFrame:
        part = dictionary.select(F.col("key").alias(f"_key_{k}"), F.col("hits").alias(f"_hits_{k}"))
        prefix = F.when(F.col("_tokens") >= k, F.substring_index(F.col(seq), " ", k))
        return df.join(F.broadcast(part), prefix == F.col(f"_key_{k}"), "left").drop(f"_key_{k}")

    none = F.array().cast(CHAIN)
    lengths = range(1, n + 1)
    found = [F.coalesce(f"_hits_{k}", none) for k in lengths]
    counted = games.withColumn("_tokens", token_count(F.col(seq)))
    return reduce(look_up, lengths, counted).select(*games.columns, F.concat(none, *found).alias("chain"))


def chain_by_shuffle(games: DataFrame, entries: DataFrame, seq: str, n: int | None) -> DataFrame:
    """Match the distinct sequences, then join back.

    Equal sequences collapse before the first shuffle. Both joins have one row per key on the
    right; a hot prefix or sequence on the left is split by adaptive skew handling.
    """
    return _chain_by_shuffle(games, _by_key(entries), seq, n)


def _chain_by_shuffle(games: DataFrame, dictionary: DataFrame, seq: str, n: int | None) -> DataFrame:
    keys = games.select(F.col(seq).alias("_seq")).where(F.col("_seq") != "").distinct()
    every = prefixes(F.col("_seq"))
    tried = keys.select("_seq", F.explode(every if n is None else F.slice(every, 1, n)).alias("key"))
    hits = tried.join(dictionary, "key")
    in_order = F.sort_array(F.collect_list(F.struct("tokens", "hits")))
    found = hits.groupBy("_seq").agg(F.flatten(F.transform(in_order, lambda h: h["hits"])).alias("_chain"))
    return games.join(found, games[seq] == found["_seq"], "left").select(
        *games.columns, F.coalesce("_chain", F.array().cast(CHAIN)).alias("chain")
    )


def exact_sequence_lookup(df: DataFrame, openings: DataFrame, seq: str = "pgn") -> DataFrame:
    """Id of the opening with exactly this move text (the smallest of several), or NULL."""
    by_text = openings.groupBy(F.col(seq).alias("_text")).agg(F.min("id").alias("matched_id"))
    return df.join(by_text, F.col(seq) == F.col("_text"), "left").drop("_text")
