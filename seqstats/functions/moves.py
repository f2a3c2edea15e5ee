"""Column expressions on game records and move text."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tags every game record has by the PGN standard, with the standard's
# placeholder for a record that leaves one out, and the tags without a placeholder.
ROSTER_TAGS = {"White": "?", "Black": "?", "Result": "*", "Event": "?"}
PLAIN_TAGS = ["WhiteElo", "BlackElo", "Opening"]
RESULTS = ["1-0", "0-1", "1/2-1/2", "*"]

TAG_LINE = r'(?m)^\[[A-Za-z0-9_]+\s+"[^\n]*"\]\s*$'


def tag(record: Column, name: str) -> Column:
    """Value of a header tag (the last one if repeated), NULL if the record has none."""
    headers = F.substring_index(record, "\n\n", 1)
    values = F.regexp_extract_all(headers, F.lit(rf'(?m)^\[{name}\s+"([^\n]*)"\]\s*$'), F.lit(1))
    return F.try_element_at(values, F.lit(-1))


def opening_name(name: Column) -> Column:
    return F.coalesce(name, F.lit("Unknown"))


def move_tokens(text: Column, n: int | None = 10) -> Column:
    """First ``n`` half-moves of a record's main line (all of them for ``None``).

    Comments, variations at any depth, annotations, move numbers, results and check or
    quality marks are left out. Also accepts bare move text such as an opening's.
    """

    def cleaned(body: Column) -> Column:
        marked = F.contains(body, F.lit("{")) | F.contains(body, F.lit(";"))
        return F.when(marked, F.regexp_replace(body, r"\{[^}]*\}?|;[^\n]*", " ")).otherwise(body)

    def main(body: Column) -> Column:
        return F.substring_index(F.ltrim(body, F.lit(" \n\t")), "\n\n", 1)

    def unmarked(body: Column) -> Column:
        return F.when(F.contains(body, F.lit("$")), F.regexp_replace(body, r"\$\d+", " ")).otherwise(body)

    def unbranched(body: Column) -> Column:
        """Without variations; where they are nested deeper or not closed, their marks are set apart for ``first``."""
        rest = body
        for _ in range(3):
            rest = F.regexp_replace(rest, r"\([^()]*+\)", " ")
        left = _let(rest, lambda r: F.when(~r.rlike("[()]"), r).otherwise(F.regexp_replace(body, r"([()])", " $1 ")))
        return F.when(F.contains(body, F.lit("(")), left).otherwise(body)

    def unnumbered(body: Column) -> Column:
        return F.regexp_replace(body, r"(?<!\S)\d+\.+", " ")

    def unsuffixed(body: Column) -> Column:
        return F.regexp_replace(F.translate(body, "\n\t", "  "), r"(?<![+#!?])[+#!?]++(?= |\z)", "")

    def words(body: Column) -> Column:
        return F.filter(F.split(body, " "), lambda w: (w != "") & ~w.isin(RESULTS))

    def first(found: Column) -> Column:
        moves = F.when(F.array_contains(found, "("), _main_line(found)).otherwise(found)
        return moves if n is None else F.slice(moves, 1, n)

    value = _movetext(text)
    for step in (cleaned, main, unmarked, unbranched, unnumbered, unsuffixed, words, first):
        value = _let(value, step)
    return value


def _main_line(words: Column) -> Column:
    """Words outside all parentheses."""
    start = F.struct(F.lit(0).alias("depth"), F.array().cast("array<string>").alias("kept"))

    def step(state: Column, word: Column) -> Column:
        depth, kept = state["depth"], state["kept"]
        return F.struct(
            F.when(word == "(", depth + 1)
            .when(word == ")", F.greatest(depth - 1, F.lit(0)))
            .otherwise(depth)
            .alias("depth"),
            F.when((depth == 0) & ~word.isin("(", ")"), F.concat(kept, F.array(word))).otherwise(kept).alias("kept"),
        )

    return F.aggregate(words, start, step, lambda state: state["kept"])


def _movetext(record: Column) -> Column:
    """A record without its tag lines."""
    blank = F.instr(record, "\n\n")
    tagged = F.startswith(record, F.lit("["))
    return (
        F.when(tagged & (blank > 0), F.substr(record, blank + 2))
        .when(tagged, F.regexp_replace(record, TAG_LINE, ""))
        .otherwise(record)
    )


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def sequence_key(tokens: Column) -> Column:
    return F.array_join(tokens, " ")


def token_count(sequence: Column) -> Column:
    return F.size(F.split(sequence, " "))


def prefixes(sequence: Column) -> Column:
    """Every prefix of a blank-separated sequence, by whole tokens, shortest first."""
    return F.transform(
        F.sequence(F.lit(1), token_count(sequence)),
        lambda k: F.array_join(F.slice(F.split(sequence, " "), F.lit(1), k), " "),
    )


def last_mover(pgn: Column) -> Column:
    """Side that made the last move: white's move directly follows its number."""
    return F.when(pgn.rlike(r"\. [^ ]*$"), "w").otherwise("b")


def opening_id(eco: Column, name: Column, sequence: Column) -> Column:
    """``ECO-dddd-dddd`` from the hashes of the opening's name and its sequence."""
    return F.concat_ws("-", eco, _hash_digits(name), _hash_digits(sequence))


def _hash_digits(text: Column) -> Column:
    """First four decimal digits of the md5 hash as one 128-bit number.

    A decimal holds 38 digits and the number may have 39, so it is divided by ten:
    with halves ``high`` and ``low`` that is ``(high div 10) * 2^64`` plus the tenth of
    ``(high mod 10) * 2^64 + low``.
    """
    digest = F.md5(text)
    two_64 = F.lit(Decimal(2**64)).cast("decimal(20,0)")
    high = F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")
    low = F.conv(F.substring(digest, 17, 16), 16, 10).cast("decimal(20,0)")
    ten = F.lit(10).cast("decimal(2,0)")
    high_tenth = F.floor(high / ten).cast("decimal(19,0)")
    rest = (high - high_tenth * ten).cast("decimal(1,0)") * two_64 + low
    number = (high_tenth * two_64).cast("decimal(38,0)") + F.floor(rest / ten).cast("decimal(20,0)")
    return F.substring(number.cast("string"), 1, 4)


def title_words(name: Column) -> Column:
    """Lower-case every word but its first character and turn underscores into blanks."""
    words = F.transform(
        F.split(name, " "), lambda w: F.concat(F.left(w, F.lit(1)), F.lower(F.substr(w, F.lit(2))))
    )
    return F.replace(F.array_join(words, " "), F.lit("_"), F.lit(" "))
