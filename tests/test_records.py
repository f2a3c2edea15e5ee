from conftest import rows
from pyspark.sql import functions as F

from seqstats.functions.moves import last_mover, move_tokens, opening_id, title_words
from seqstats.sources.openings import read_openings
from seqstats.sources.records import header_columns, ordered_sequence, parse_games, read_game_records

TEXT = """stray line before the first game
[Event "First"]
[White "Ann"]
[Black "Bob"]
[Result "1-0"]
[WhiteElo "1500"]
[Opening "Queen's Pawn: Main"]

1. d4 {a comment (with parens) 9. Qh7#
over two lines} d5 2. c4! ( 2. Nf3 Nf6 (2... e6 3. g3) 3. e3 ) 2... e6 $14 3. Nc3+ Nf6 ; rest of line
4. Bg5 Be7 5. e3 O-O 6. Nf3 1-0

[Event "Second"]
[White "ann"]
[White "Cay"]

1.e4 e5 2.Nf3 *
"""


def test_records_and_headers(spark, tmp_path):
    (tmp_path / "a.pgn").write_text(TEXT)
    (tmp_path / "b.pgn").write_bytes(b'[Event "Third"]\r\n[Black "Dee"]\r\n\r\n1. c4 c5\r\n2. g3 1/2-1/2')
    games = parse_games(read_game_records(spark, str(tmp_path)))
    assert rows(games, "event", "white", "black", "result", "w_elo", "original_name", "original_moves") == [
        ("First", "Ann", "Bob", "1-0", "1500", "Queen's Pawn: Main", "d4 d5 c4 e6 Nc3 Nf6 Bg5 Be7 e3 O-O"),
        ("Second", "Cay", "?", "*", None, "Unknown", "e4 e5 Nf3"),
        ("Third", "?", "Dee", "*", None, "Unknown", "c4 c5 g3"),
    ]


def test_records_survive_any_split(spark, tmp_path):
    """Splits cut records and markers anywhere; every record comes back once and whole."""
    games = "\n".join(f'[Event "e{i}"]\n[White "w{i}"]\n\n1. e4 e{i % 7 + 1} 1-0\n' for i in range(500))
    (tmp_path / "all.pgn").write_text(games)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (101, 997, 4096):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            found = header_columns(read_game_records(spark, str(tmp_path)))
            assert rows(found, "event", "white") == sorted((f"e{i}", f"w{i}") for i in range(500))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_move_tokens_of_plain_text(spark):
    texts = ["1. e4", "1. e4 e5 2. Nf3 Nc6 3. Bb5+ a6?!", "(1. d4) 1. e4 ((x) y) e5", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t STRING")
    found = [r[0] for r in df.select(move_tokens(F.col("t"), None)).collect()]
    assert found == [["e4"], ["e4", "e5", "Nf3", "Nc6", "Bb5", "a6"], ["e4", "e5"], [], None]


def test_last_mover_ids_and_titles(spark):
    df = spark.createDataFrame([("1. e4",), ("1. e4 e5",), ("1. e4 e5 2. Nf3",)], "pgn STRING")
    assert [r[0] for r in df.select(last_mover(F.col("pgn"))).collect()] == ["w", "b", "w"]
    one = spark.createDataFrame([("B00", "a name", "e2e4")], "eco STRING, name STRING, uci STRING")
    import hashlib

    digits = [str(int(hashlib.md5(t.encode()).hexdigest(), 16))[:4] for t in ("a name", "e2e4")]
    assert one.select(opening_id(F.col("eco"), F.col("name"), F.col("uci"))).first()[0] == "B00-" + "-".join(digits)
    named = spark.createDataFrame([("KING'S_GAMBIT declINED",)], "n STRING")
    assert named.select(title_words(F.col("n"))).first()[0] == "King's gambit declined"


def test_read_openings(spark, tmp_path):
    (tmp_path / "a.tsv").write_text('\teco\tname\tpgn\tuci\n0\tA00\tThe "Odd" One\t1. a3+ a6 2. b3\ta2a3 a7a6 b2b3\n')
    (tmp_path / "b.tsv").write_text("\teco\tname\tpgn\tuci\n0\tB00\tKing's Pawn\t1. e4\te2e4\n")
    found = read_openings(spark, str(tmp_path))
    assert rows(found, "eco", "name", "moves") == [("A00", 'The "Odd" One', "a3 a6 b3"), ("B00", "King's Pawn", "e4")]


def test_ordered_sequence_takes_first_by_order(spark):
    events = spark.createDataFrame([(1, t, f"e{t}") for t in range(9, 0, -1)] + [(2, 1, "x")], "k INT, t INT, v STRING")
    found = ordered_sequence(events, ["k"], ["t"], "v", 4)
    assert rows(found, "k", "moves") == [(1, "e1 e2 e3 e4"), (2, "x")]
