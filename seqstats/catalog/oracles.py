"""The catalogue's queries as plain SQL over the same tables, for cross-checking results.

Each text is written from the definition of the result, not from the Spark plan: prefixes
are compared with ``starts_with`` and distribution functions at every value of either sample.
"""

from __future__ import annotations

import re

SUFFIXES = ["w", "b", "won_w", "won_b"]
METRICS = [f"p_{s}" for s in SUFFIXES]
COUNTS = ["count_w", "won_w", "lost_w", "count_b", "won_b", "lost_b", "real_game_w", "real_game_b"]
SIX = COUNTS[:6]
MOMENTS = [f"{k}_{m}" for m in METRICS for k in ("mean", "std")]


def r6(expression: str, name: str | None = None) -> str:
    """Six places, halves of the last one up, without a negative zero."""
    value = f"round(CAST({expression} AS DOUBLE) + 1e-9, 6)"
    return f"CASE WHEN {value} = 0 THEN 0::DOUBLE ELSE {value} END AS {name or expression}"


def each(template: str, names: list[str]) -> str:
    return ", ".join(template.replace("@", n) for n in names)


def r6_all(names: list[str]) -> str:
    return ", ".join(r6(n) for n in names)


def position(z: str) -> str:
    step = f"least(400, greatest(round_even(({z} + 1) / 0.01::DOUBLE, 0) + 1, 1))"
    return f"CASE WHEN {z} IS NULL OR isnan({z}) OR isinf({z}) THEN 0 ELSE CAST({step} AS INTEGER) END"


def mover(text: str) -> str:
    return f"CASE WHEN regexp_matches({text}, '\\. [^ ]*$') THEN 'w' ELSE 'b' END"


def digits(text: str) -> str:
    return f"left(CAST(('0x' || md5({text}))::UHUGEINT AS VARCHAR), 4)"


SUM_SIX = each("CAST(sum(@) AS BIGINT) AS @", SIX)
COUNT_EIGHT = """
    count(*) FILTER (side = 'w') AS count_w,
    count(*) FILTER (side = 'w' AND result = '1-0') AS won_w,
    count(*) FILTER (side = 'w' AND result = '0-1') AS lost_w,
    count(*) FILTER (side = 'b') AS count_b,
    count(*) FILTER (side = 'b' AND result = '0-1') AS won_b,
    count(*) FILTER (side = 'b' AND result = '1-0') AS lost_b,
    CAST(coalesce(sum(real_game) FILTER (side = 'w'), 0) AS BIGINT) AS real_game_w,
    CAST(coalesce(sum(real_game) FILTER (side = 'b'), 0) AS BIGINT) AS real_game_b"""

# Tables the queries share; each may use the ones it names.
TABLES = {
    "games": """
        SELECT CAST(o_custkey AS VARCHAR) AS white,
               CAST((l_partkey * 7 + l_suppkey) % (SELECT count(*) FROM customer) AS VARCHAR) AS black,
               CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL
                    WHEN l_linestatus = 'O' THEN p_type || ': ' || p_name
                    ELSE p_brand || ': ' || p_type END AS original_name,
               concat_ws(' ', p_type, p_brand, p_name) AS moves,
               CASE l_returnflag WHEN 'R' THEN '1-0' WHEN 'A' THEN '0-1' ELSE '1/2-1/2' END AS result,
               strftime(o_orderdate, '%Y-%m') AS month
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
    "openings": """
        SELECT moves AS id, left(moves, 1) || '00' AS eco, name, pgn, moves AS uci, moves
        FROM (SELECT p_type AS moves, p_type AS name, '1. ' || p_type AS pgn FROM part WHERE p_type <> 'PROMO'
              UNION
              SELECT p_type || ' ' || p_brand, p_type || ': ' || p_brand, '1. ' || p_type || ' ' || p_brand
              FROM part WHERE p_brand <> 'Brand#1')""",
    "profiles": """
        SELECT CAST(c_custkey AS VARCHAR) AS id,
               CASE WHEN c_acctbal < 0 THEN NULL
                    WHEN c_mktsegment = 'MACHINERY' AND n_regionkey = 0 THEN chr(65 + n_nationkey) || 'X-N'
                    ELSE chr(65 + n_nationkey) || 'X' END AS country
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "iso": """
        SELECT chr(65 + n_nationkey) || 'X' AS ISO_A2, chr(65 + n_nationkey) || 'XX' AS ISO_A3, n_name AS country
        FROM nation""",
    "features": """
        SELECT ISO_A3 FROM iso UNION ALL SELECT DISTINCT upper(left(r_name, 2)) FROM region""",
    "hits": """
        SELECT s.moves, o.id AS matched_id, o.moves AS matched_moves, o.name,
               row_number() OVER (PARTITION BY s.moves ORDER BY length(o.moves) DESC, o.id DESC) AS rank
        FROM (SELECT DISTINCT moves FROM games) s JOIN openings o ON starts_with(s.moves || ' ', o.moves || ' ')""",
    "matches": """
        SELECT g.*, matched_id, matched_moves, CAST(rank = 1 AS BIGINT) AS real_game
        FROM games g JOIN hits h ON g.moves = h.moves""",
    "sides": """
        SELECT white AS username, 'w' AS side, matched_id, result, real_game, month FROM matches
        UNION ALL SELECT black, 'b', matched_id, result, real_game, month FROM matches""",
    "counts": f"""
        SELECT lower(username) AS id, matched_id, {COUNT_EIGHT} FROM sides GROUP BY username, matched_id""",
    "monthly": f"""
        SELECT month, lower(username) AS id, matched_id, {COUNT_EIGHT} FROM sides GROUP BY month, username, matched_id""",
    "deepest_counts": f"""
        SELECT username AS id, matched_id, {COUNT_EIGHT} FROM sides WHERE real_game = 1 GROUP BY username, matched_id""",
    "totals": """
        SELECT id, CAST(sum(real_game_w) AS BIGINT) AS total_count_w, CAST(sum(real_game_b) AS BIGINT) AS total_count_b
        FROM counts GROUP BY id""",
    "players": """
        SELECT c.id, matched_id, total_count_w, total_count_b,
               count_w / nullif(total_count_w, 0) AS p_w, count_b / nullif(total_count_b, 0) AS p_b,
               won_w / nullif(count_w, 0) AS p_won_w, won_b / nullif(count_b, 0) AS p_won_b, country
        FROM counts c JOIN totals t ON c.id = t.id LEFT JOIN profiles p ON c.id = p.id""",
    "counted": "SELECT * FROM players WHERE total_count_w + total_count_b >= 50",
    "located": "SELECT * FROM counted WHERE country IS NOT NULL",
    "moments": f"""
        SELECT matched_id, {each("coalesce(avg(@), 0) AS mean_@, coalesce(stddev_samp(@), 0) AS std_@", METRICS)}
        FROM counted GROUP BY matched_id""",
    "means": f"""
        SELECT country, matched_id, {each("avg(@) AS @", METRICS)} FROM located GROUP BY country, matched_id""",
    "standardized": f"""
        SELECT country, c.matched_id, {each("@", METRICS)},
               {each("(@ - mean_@) / (std_@ + 1e-17) AS stand_@", METRICS)}
        FROM means c JOIN moments m ON c.matched_id = m.matched_id""",
    "player_counts": """
        SELECT country, count(DISTINCT id) AS num_players FROM located GROUP BY country""",
    "sequences": """
        SELECT user_id, day, string_agg(event_type, ' ' ORDER BY rank) AS moves
        FROM (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, event_type,
                     row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y-%m-%d') ORDER BY ts, event_id) AS rank
              FROM events) WHERE rank <= 10 GROUP BY user_id, day""",
    "closure": """
        SELECT id, ancestor_id, row_number() OVER (PARTITION BY id ORDER BY length(above) DESC) - 1 AS depth
        FROM (SELECT o.id, a.id AS ancestor_id, a.moves AS above
              FROM openings o JOIN openings a ON starts_with(o.moves || ' ', a.moves || ' '))""",
    "counted_values": " UNION ALL ".join(
        f"SELECT matched_id, country, '{m}' AS metric, {m} AS v FROM counted" for m in METRICS
    ),
    "located_values": "SELECT * FROM counted_values WHERE country IS NOT NULL",
    # Both samples' distribution functions at every value of an opening and metric.
    "whole_steps": """
        SELECT matched_id, metric, v, sum(count(*)) OVER (PARTITION BY matched_id, metric ORDER BY v) AS below,
               sum(count(*)) OVER (PARTITION BY matched_id, metric) AS m
        FROM counted_values WHERE v IS NOT NULL GROUP BY matched_id, metric, v""",
    "part_values": """
        SELECT matched_id, country, metric, v, count(v) AS k FROM located_values GROUP BY matched_id, country, metric, v""",
    "part_sizes": """
        SELECT matched_id, country, metric, sum(k) AS n FROM part_values GROUP BY matched_id, country, metric""",
    "gaps": """
        SELECT s.matched_id, s.country, s.metric, n, m,
               CAST(sum(coalesce(k, 0)) OVER (PARTITION BY s.matched_id, s.country, s.metric ORDER BY w.v) AS BIGINT)
                   * CAST(m AS BIGINT) - CAST(below AS BIGINT) * CAST(n AS BIGINT) AS gap
        FROM part_sizes s JOIN whole_steps w ON s.matched_id = w.matched_id AND s.metric = w.metric
        LEFT JOIN part_values p
          ON s.matched_id = p.matched_id AND s.country = p.country AND s.metric = p.metric AND w.v = p.v""",
    "tests": """
        SELECT matched_id, country, metric, CAST(n AS BIGINT) AS n, CAST(max(m) AS BIGINT) AS m,
               CASE WHEN n > 0 THEN greatest(max(gap), max(-gap)) / (n * max(m)) END AS stat,
               CASE WHEN n > 0 THEN CASE WHEN max(-gap) > max(gap) THEN -1 ELSE 1 END END AS sign
        FROM gaps GROUP BY matched_id, country, metric, n""",
    "tested_values": """
        SELECT *, stat * sqrt(n * m / (n + m)) AS z FROM tests""",
    "limits": """
        SELECT * EXCLUDE (z), CASE WHEN z IS NULL THEN NULL WHEN z < 0.2 THEN 1::DOUBLE ELSE least(greatest(
            list_sum(list_transform(range(1, 101), lambda k: (CASE WHEN k % 2 = 1 THEN 2 ELSE -2 END)
                                                             * exp(-2.0::DOUBLE * k * k * z * z))), 0), 1) END AS p_value
        FROM tested_values""",
    "ks": f"""
        SELECT matched_id, country, {each(
            "max(stat) FILTER (metric = '@') AS @_stat, max(p_value) FILTER (metric = '@') AS @_p_value, "
            "max(sign) FILTER (metric = '@') AS @_sign", METRICS)}
        FROM limits GROUP BY matched_id, country""",
    # Every country's players and those of the next country by code: shares of games as white.
    "shares": """
        SELECT DISTINCT id, country, total_count_w / (total_count_w + total_count_b) AS v FROM located""",
    "share_pairs": """
        SELECT country, lead(country) OVER (ORDER BY country) AS other FROM (SELECT DISTINCT country FROM located)""",
    "share_tests": """
        SELECT country, n, m, max(abs(a * m - b * n)) AS reach,
               CASE WHEN n > 0 AND m > 0 THEN max(abs(a * m - b * n)) / (n * m) END AS stat,
               CASE WHEN n > 0 AND m > 0 THEN CASE WHEN max(b * n - a * m) > max(a * m - b * n) THEN -1 ELSE 1 END END AS sign
        FROM (SELECT country, CAST(sum(a) OVER (PARTITION BY country ORDER BY v) AS BIGINT) AS a,
                     CAST(sum(b) OVER (PARTITION BY country ORDER BY v) AS BIGINT) AS b,
                     CAST(sum(a) OVER (PARTITION BY country) AS BIGINT) AS n,
                     CAST(sum(b) OVER (PARTITION BY country) AS BIGINT) AS m
              FROM (SELECT country, v, sum(a) AS a, sum(b) AS b
                    FROM (SELECT country, v, 1 AS a, 0 AS b FROM shares
                          UNION ALL SELECT p.country, v, 0, 1 FROM shares s JOIN share_pairs p ON s.country = p.other)
                    GROUP BY country, v))
        GROUP BY country, n, m""",
    # Lattice paths to (i, d - i) that touched a point out of reach, and all paths, both over 2^d, by diagonals.
    "lattice": """
        WITH RECURSIVE walk AS (
            SELECT n, m, reach, 0 AS d, list_transform(range(0, n + 1), lambda i: 0::DOUBLE) AS hits,
                   list_transform(range(0, n + 1), lambda i: CASE WHEN i = 0 THEN 1::DOUBLE ELSE 0::DOUBLE END) AS paths
            FROM (SELECT DISTINCT least(n, m) AS n, greatest(n, m) AS m, reach FROM share_tests WHERE n > 0 AND m > 0)
            UNION ALL
            SELECT n, m, reach, d + 1,
                   list_transform(range(0, n + 1), lambda i:
                       CASE WHEN abs(i * m - (d + 1 - i) * n) >= reach
                            THEN (paths[i + 1] + CASE WHEN i > 0 THEN paths[i] ELSE 0 END) / 2
                            ELSE (hits[i + 1] + CASE WHEN i > 0 THEN hits[i] ELSE 0 END) / 2 END),
                   list_transform(range(0, n + 1), lambda i: (paths[i + 1] + CASE WHEN i > 0 THEN paths[i] ELSE 0 END) / 2)
            FROM walk WHERE d < n + m)
        SELECT n, m, reach, CASE WHEN reach = 0 THEN 1::DOUBLE ELSE hits[n + 1] / paths[n + 1] END AS p
        FROM walk WHERE d = n + m""",
    "deviations": f"""
        SELECT coalesce(j.country, n.country) AS country, j.matched_id, num_players, o.name, o.pgn, {mover("o.pgn")} AS color,
               {each("@_p_value, stand_@", METRICS)}, {each("@", MOMENTS)}
        FROM (SELECT coalesce(k.country, c.country) AS country, coalesce(k.matched_id, c.matched_id) AS matched_id,
                     {each("@_p_value, stand_@", METRICS)}
              FROM ks k FULL JOIN standardized c ON k.country = c.country AND k.matched_id = c.matched_id) j
        FULL JOIN player_counts n ON j.country = n.country
        LEFT JOIN moments m ON j.matched_id = m.matched_id
        JOIN openings o ON j.matched_id = o.id
        WHERE length(coalesce(j.country, n.country)) = 2""",
    "by_color": " UNION ALL ".join(
        f"""SELECT matched_id, country, p_{c}_p_value AS p_val_played, stand_p_{c} AS dev_played,
            stand_p_{c} * std_p_{c} + mean_p_{c} AS prob_played, p_won_{c}_p_value AS p_val_won,
            stand_p_won_{c} AS dev_won, stand_p_won_{c} * std_p_won_{c} + mean_p_won_{c} AS prob_won,
            color, num_players, name, pgn FROM deviations WHERE color = '{c}'"""
        for c in "wb"
    ),
    "placed": f"""
        SELECT i.ISO_A3 AS country, matched_id, s.country AS iso_a2,
               {", ".join(f"{position(f'stand_p_{s}')} AS pos_{s}, coalesce(p_{s}, 0) AS p_{s}" for s in SUFFIXES)}
        FROM standardized s JOIN iso i ON s.country = i.ISO_A2""",
}

GAME = "white, black, moves, result"
PI2 = "(pi() * pi())"


def finite_tail(stat: str, pooled: str, source: str, columns: str) -> str:
    """Tail of the one-sample statistic for a rounded pooled size: the expansion to the order size^(-3/2), and far out the
    one-sided asymptotic tail doubled. ``g`` is the square of pi*(k - 1/2), ``w`` that of pi*k."""

    def half(term: str) -> str:
        return f"list_sum(list_transform(range(1, 13), lambda k: 2 * ({term.replace('g', f'((k - 0.5::DOUBLE) ** 2 * {PI2})')}) * exp(-((k - 0.5::DOUBLE) ** 2 * {PI2}) / (2 * z * z))))"

    def whole(term: str) -> str:
        return f"list_sum(list_transform(range(1, 13), lambda k: 2 * ({term.replace('w', f'(k * k * {PI2})')}) * exp(-(k * k * {PI2}) / (2 * z * z))))"

    root = "sqrt(pi() / 2)"
    k0 = f"2 * {root} / z * {half('0.5::DOUBLE')}"
    k1 = f"{root} / (6 * z ** 4) * {half('g - z ** 2')}"
    k2 = (
        f"{root} / (72 * z ** 7) * {half('6 * z ** 6 + 2 * z ** 4 + (2 * z ** 4 - 5 * z ** 2) * g + (1 - 2 * z ** 2) * g * g')}"
        f" - {root} / (36 * z ** 3) * {whole('w')}"
    )
    k3 = (
        f"{root} / (6480 * z ** 10) * {half('(5 - 30 * z ** 2) * g * g * g + (212 * z ** 4 - 60 * z ** 2) * g * g + (135 * z ** 4 - 96 * z ** 6) * g - 30 * z ** 6 - 90 * z ** 8')}"
        f" + {root} / (108 * z ** 6) * {whole('3 * z ** 2 * w - w * w')}"
    )
    return f"""
        SELECT {columns}, CASE WHEN d IS NULL THEN NULL WHEN z < 0.2 THEN 1::DOUBLE
            WHEN z * z > 9 THEN least(greatest(2 * exp(-(6 * size * d + 1) ** 2 / (18 * size)), 0), 1)
            ELSE least(greatest(1 - ({k0} + ({k1}) / sqrt(size) + ({k2}) / size + ({k3}) / (size * sqrt(size))), 0), 1) END AS p
        FROM (SELECT *, {stat} AS d, CAST({pooled} AS DOUBLE) AS size, {stat} * sqrt({pooled}) AS z FROM {source})"""


POOLED = "round_even(n * m / (n + m), 0)"
TABLES["finite"] = finite_tail("stat", POOLED, "tests", "matched_id, country, metric, n, m, stat, sign")
TABLES["share_finite"] = finite_tail("stat", POOLED, "share_tests", "country, n, m, reach, stat, sign")
MOVES_TEXT = """CASE WHEN len(t) > 0 THEN array_to_string(
    list_transform(t, lambda x, i: CASE WHEN i % 2 = 1 THEN CAST((i + 1) // 2 AS VARCHAR) || '. ' || x ELSE x END), ' ') END"""
ELO = "CAST(CAST(@ AS INTEGER) + 1000 AS VARCHAR)"
SIGNIFICANT = f"""
    SELECT matched_id, country, {r6_all(["p_val_played", "dev_played", "prob_played", "p_val_won", "dev_won", "prob_won"])},
           color, num_players, name, pgn
    FROM by_color WHERE p_val_# < 0.05 AND abs(dev_#) > 0.3 AND num_players >= 40"""
DISTRIBUTION = "SELECT matched_id, # metric, " + r6("v", "value") + " FROM & WHERE v IS NOT NULL"
COUNTED_VALUES = """
    SELECT matched_id, # metric, @, players
    FROM (SELECT matched_id, # metric, v, count(*) AS players FROM & WHERE v IS NOT NULL GROUP BY ALL)""".replace("@", r6("v", "value"))
NEW_PLAYERS = """
    SELECT CASE WHEN CAST(id AS BIGINT) % 2 = 0 THEN 'P' ELSE 'p' END || id AS id
    FROM (SELECT DISTINCT id FROM counts WHERE id NOT IN (SELECT id FROM profiles WHERE country IS NOT NULL))"""
P_DIGITS = "CASE WHEN @ IS NOT NULL THEN printf('%.5e', @) END AS p_value"

SQL = {
    # game records
    "read_game_records": f"""
        SELECT '[Event "Rated game ' || month || '"]' || chr(10) || '[White "' || white || '"]' || chr(10)
               || '[Black "' || black || '"]' || chr(10) || '[Result "' || result || '"]' || chr(10)
               || '[WhiteElo "' || {ELO.replace("@", "white")} || '"]' || chr(10)
               || CASE WHEN result <> '1/2-1/2' THEN '[BlackElo "' || {ELO.replace("@", "black")} || '"]' || chr(10) ELSE '' END
               || CASE WHEN original_name IS NOT NULL THEN '[Opening "' || original_name || '"]' || chr(10) ELSE '' END
               || chr(10) || '1. ' || t[1]
               || CASE WHEN result = '1-0' THEN ' {{ a (quiet) start }} ( 1. other (1. deeper) move! ) $3' ELSE '' END
               || substr({MOVES_TEXT}, length(t[1]) + 4) || '+ ' || result AS record
        FROM (SELECT *, string_split(moves, ' ') AS t FROM games)""",
    "header_columns": f"""
        SELECT white, black, result, 'Rated game ' || month AS event, {ELO.replace("@", "white")} AS w_elo,
               CASE WHEN result <> '1/2-1/2' THEN {ELO.replace("@", "black")} END AS b_elo, original_name
        FROM games""",
    "opening_name": "SELECT white, black, moves, coalesce(original_name, 'Unknown') AS opening_name FROM games",
    "move_tokens": """
        SELECT white, black, replace(moves, ' ', '|') AS tokens,
               array_to_string(string_split(moves, ' ')[1:3], '|') AS first_three FROM games""",
    "sequence_key": "SELECT white, black, array_to_string(string_split(moves, ' ')[1:3], ' ') AS key FROM games",
    "ordered_sequence": "SELECT * FROM sequences",
    "shape_columns": "SELECT black AS second, white AS first, result AS score FROM games",
    "drop_matching": "SELECT * EXCLUDE (real_game_w, real_game_b, lost_w, lost_b) FROM counts",
    "flatten_profile": """
        SELECT lower('Player' || id) AS id, country, CAST(length(country) AS INTEGER) AS code_length FROM profiles""",
    "product_columns": "SELECT id, matched_id, " + ", ".join(r6(m, f"share_{m}") for m in METRICS) + " FROM players",
    # dictionary and stages
    "union_files": "SELECT eco, name, pgn, uci, 'x' AS \"Unnamed: 0\" FROM openings",
    "read_openings": f"""
        SELECT eco, name, pgn, uci, eco || '-' || {digits("name")} || '-' || {digits("uci")} AS id, moves FROM openings""",
    "read_stage": "SELECT * FROM counts",
    "read_columns": "SELECT c_custkey, c_mktsegment FROM customer",
    "month_range": """
        SELECT strftime(d, '%Y-%m') AS month, coalesce(n, 0) AS n
        FROM (SELECT unnest(range(date_trunc('month', min(o_orderdate)), max(o_orderdate) + INTERVAL 1 SECOND,
                                  INTERVAL 1 MONTH)) AS d FROM orders)
        LEFT JOIN (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY ALL) o
          ON strftime(d, '%Y-%m') = o.month""",
    "read_months": "SELECT * FROM monthly",
    "read_known": "SELECT * FROM iso",
    "write_stage": "SELECT * FROM iso",
    "write_stage_gzip": "SELECT * FROM profiles",
    "write_csv": "SELECT c_custkey, c_name, " + r6("c_acctbal") + " FROM customer",
    "checkpointed": "SELECT * FROM profiles",
    "promote_resumed": "SELECT * FROM profiles",
    # filters
    "filter_matched": """
        SELECT white, black, g.moves, matched_id FROM games g JOIN (
            SELECT moves, base, max_by(matched_id, length(matched_moves)) AS matched_id
            FROM (SELECT DISTINCT g.moves, string_split(original_name, ':')[1] AS base, matched_id, matched_moves
                  FROM games g JOIN hits h ON g.moves = h.moves
                  WHERE contains(h.name, string_split(original_name, ':')[1])) GROUP BY moves, base) b
          ON g.moves = b.moves AND string_split(g.original_name, ':')[1] = b.base""",
    "result_flags": """
        SELECT white, black, result, CAST(result = '1-0' AS INTEGER) AS white_won,
               CAST(result = '0-1' AS INTEGER) AS black_won FROM games""",
    "filter_min_games": "SELECT * FROM totals WHERE total_count_w + total_count_b >= 80",
    "filter_has_country": "SELECT * FROM profiles WHERE country IS NOT NULL",
    "filter_valid_id": """
        SELECT c_name AS id, c_nationkey FROM customer WHERE c_acctbal >= 0 AND c_mktsegment <> 'MACHINERY'""",
    "filter_iso2": "SELECT * FROM profiles WHERE length(country) = 2",
    "filter_significant": f"""
        SELECT j.matched_id, j.country, {r6("p_w_p_value", "p_val_played")}, {r6("stand_p_w", "dev_played")}, num_players
        FROM (SELECT c.*, p_w_p_value FROM standardized c JOIN ks k
                ON k.country = c.country AND k.matched_id = c.matched_id) j
        JOIN player_counts n ON j.country = n.country
        WHERE p_w_p_value < 0.05 AND abs(stand_p_w) > 0.3 AND num_players >= 40""",
    "filter_outliers": f"""
        SELECT country, c.matched_id, {r6("p_w", "p")}, {r6("p_won_w", "p_won")}, {r6("mean_p_w", "mean_p")},
               {r6("std_p_w", "std_p")}, {r6("mean_p_won_w", "mean_p_won")}, {r6("std_p_won_w", "std_p_won")}
        FROM means c JOIN moments m ON c.matched_id = m.matched_id
        WHERE abs(p_w - mean_p_w) >= std_p_w OR abs(p_won_w - mean_p_won_w) >= std_p_won_w""",
    "drop_unresolved": """
        SELECT p.country AS ISO_A2, id, i.country, ISO_A3 FROM profiles p JOIN iso i ON p.country = i.ISO_A2""",
    "filter_side": f"""
        SELECT matched_id, 'b' AS color, name, pgn FROM moments JOIN openings ON matched_id = id
        WHERE {mover("pgn")} = 'b'""",
    # matching and hierarchy
    "match_prefixes": f"SELECT {GAME}, matched_id, matched_moves, real_game FROM matches",
    "match_prefixes_by_shuffle": f"SELECT {GAME}, matched_id, matched_moves, real_game FROM matches",
    "match_event_sequences": """
        SELECT s.*, k.moves AS matched_id, k.moves AS matched_moves,
               CAST(len(string_split(k.moves, ' ')) = least(3, len(string_split(s.moves, ' '))) AS BIGINT) AS real_game
        FROM sequences s JOIN (
            SELECT DISTINCT array_to_string(string_split(moves, ' ')[1:k], ' ') AS moves
            FROM sequences, (SELECT unnest([1, 2, 3]) AS k)) k ON starts_with(s.moves || ' ', k.moves || ' ')""",
    "deepest_match": f"SELECT {GAME}, matched_id, matched_moves FROM matches WHERE real_game = 1",
    "match_by_name_and_prefix": """
        SELECT white, black, g.moves, result, original_name, matched_id, matched_id AS matched_moves
        FROM games g LEFT JOIN (
            SELECT moves, base, max_by(matched_id, length(matched_moves)) AS matched_id
            FROM (SELECT DISTINCT g.moves, string_split(original_name, ':')[1] AS base, matched_id, matched_moves
                  FROM games g JOIN hits h ON g.moves = h.moves
                  WHERE contains(h.name, string_split(original_name, ':')[1])) GROUP BY moves, base) b
          ON g.moves = b.moves AND string_split(g.original_name, ':')[1] = b.base""",
    "prefix_edges": """
        SELECT o.id AS child_id, max_by(a.id, length(a.moves)) AS parent_id
        FROM openings o LEFT JOIN openings a ON starts_with(o.moves, a.moves || ' ') GROUP BY o.id""",
    "prefix_closure": "SELECT id, ancestor_id, CAST(depth AS INTEGER) AS depth FROM closure",
    "opening_intervals": """
        SELECT id, CAST(first AS INTEGER) AS first, CAST(first + size - 1 AS INTEGER) AS last, CAST(depth AS INTEGER) AS depth
        FROM (SELECT id, row_number() OVER (ORDER BY replace(moves, ' ', chr(1)) || chr(1), id) AS first FROM openings)
        JOIN (SELECT ancestor_id AS id, count(*) AS size FROM closure GROUP BY ancestor_id) USING (id)
        JOIN (SELECT id, count(*) AS depth FROM closure GROUP BY id) USING (id)""",
    "base_nodes": """
        SELECT d.id, d.matched_id FROM deepest_counts d LEFT JOIN (
            SELECT DISTINCT d.id, d.matched_id
            FROM deepest_counts d JOIN closure c ON c.id = d.matched_id AND c.depth > 0
            JOIN deepest_counts p ON p.id = d.id AND p.matched_id = c.ancestor_id) below
          ON d.id = below.id AND d.matched_id = below.matched_id
        WHERE below.id IS NULL""",
    "rollup_counts": f"""
        SELECT * FROM (SELECT d.id, c.ancestor_id AS matched_id, {SUM_SIX}
                       FROM deepest_counts d JOIN closure c ON c.id = d.matched_id GROUP BY d.id, c.ancestor_id) u
        WHERE EXISTS (SELECT 1 FROM deepest_counts p JOIN closure c ON c.ancestor_id = p.matched_id
                      WHERE p.id = u.id AND c.id = u.matched_id) AND {" + ".join(SIX)} > 0""",
    "exact_sequence_lookup": """
        SELECT white, black, shown AS pgn, id AS matched_id
        FROM (SELECT *, '1. ' || array_to_string(string_split(moves, ' ')[1:2], ' ') AS shown FROM games)
        LEFT JOIN openings ON openings.pgn = shown""",
    "last_mover": f"SELECT id, {mover('pgn')} AS color FROM openings",
    "opening_id": f"""
        SELECT p_partkey, left(p_type, 1) || '00-' || {digits("p_name")} || '-'
               || {digits("p_type || ' ' || CAST(p_partkey AS VARCHAR)")} AS id FROM part""",
    # joins
    "outer_fill": """
        SELECT username, matched_id, count(*) FILTER (side = 'w' AND result = '1-0') AS won_w,
               count(*) FILTER (side = 'w' AND result = '0-1') AS lost_w,
               count(*) FILTER (side = 'b' AND result = '0-1') AS won_b
        FROM sides WHERE (side = 'w' AND result IN ('1-0', '0-1')) OR (side = 'b' AND result = '0-1')
        GROUP BY username, matched_id""",
    "join_totals": "SELECT c.*, total_count_w, total_count_b FROM counts c JOIN totals t ON c.id = t.id",
    "join_country": "SELECT c.*, country FROM counts c LEFT JOIN profiles p ON c.id = p.id",
    "join_moments": f"""
        SELECT c.matched_id, country, {r6_all(METRICS)}, {r6_all(MOMENTS)}
        FROM means c JOIN moments m ON c.matched_id = m.matched_id""",
    "join_ks_country": f"""
        SELECT coalesce(c.country, k.country) AS country, coalesce(c.matched_id, k.matched_id) AS matched_id,
               {", ".join(f"{r6(m + '_stat')}, {r6(m + '_p_value')}, {m}_sign" for m in METRICS)},
               {r6_all(METRICS)}, {r6_all([f"stand_{m}" for m in METRICS])}
        FROM ks k FULL JOIN (SELECT * FROM standardized WHERE length(country) = 2) c
          ON k.country = c.country AND k.matched_id = c.matched_id""",
    "join_player_counts": f"""
        SELECT n.country, matched_id, {r6_all(METRICS)}, num_players
        FROM (SELECT * FROM means WHERE length(country) = 2) c RIGHT JOIN player_counts n ON c.country = n.country""",
    "join_global": f"""
        SELECT c.matched_id, country, {r6_all(METRICS)}, {r6_all(MOMENTS)}
        FROM means c LEFT JOIN (SELECT * FROM moments WHERE mean_p_w > 0.01) m ON c.matched_id = m.matched_id""",
    "join_opening_names": f"""
        SELECT matched_id, country, {r6_all(METRICS)}, {mover("pgn")} AS color, name, pgn
        FROM means JOIN openings ON matched_id = id""",
    "new_players": NEW_PLAYERS,
    "new_players_by_filter": NEW_PLAYERS,
    "new_countries": """
        SELECT DISTINCT country AS ISO_A2 FROM profiles p WHERE NOT EXISTS (SELECT 1 FROM iso WHERE ISO_A2 = p.country)""",
    "attach_player_counts": f"""
        SELECT c.country, matched_id, {r6_all(METRICS)}, num_players
        FROM means c LEFT JOIN (SELECT * FROM player_counts WHERE length(country) = 2) n ON c.country = n.country""",
    "map_iso3": """
        SELECT ISO_A3 AS country, num_players, n.country AS iso_a2 FROM player_counts n LEFT JOIN iso ON n.country = ISO_A2""",
    "resolve_country": """
        SELECT n.country AS ISO_A2, num_players, i.country, ISO_A3
        FROM player_counts n LEFT JOIN iso i ON n.country = i.ISO_A2""",
    "country_names": f"""
        SELECT i.country, matched_id, {r6_all(METRICS)} FROM means c JOIN iso i ON c.country = i.ISO_A2""",
    "dense_grid": f"""
        SELECT f.ISO_A3, o.id AS matched_id, {", ".join(
            f"coalesce(pos_{s}, 0) AS pos_{s}, {r6(f'coalesce(p_{s}, 0)', f'p_{s}')}" for s in SUFFIXES)}
        FROM features f CROSS JOIN openings o LEFT JOIN placed p ON f.ISO_A3 = p.country AND o.id = p.matched_id""",
    "feature_player_counts": """
        SELECT f.ISO_A3, coalesce(num_players, 0) AS num_players
        FROM features f LEFT JOIN iso i ON f.ISO_A3 = i.ISO_A3 LEFT JOIN player_counts n ON n.country = i.ISO_A2""",
    "opening_metadata": f"""
        SELECT c.matched_id, name, pgn, {r6_all(MOMENTS)}
        FROM (SELECT DISTINCT matched_id FROM means) c JOIN openings o ON c.matched_id = o.id
        LEFT JOIN (SELECT * FROM moments WHERE mean_p_w > 0.01) m ON c.matched_id = m.matched_id""",
    # aggregates
    "player_openings": f"""
        SELECT lower(name) AS id, matched_id, {COUNT_EIGHT}
        FROM (SELECT *, CASE WHEN result = '1-0' THEN 'P' ELSE 'p' END || username AS name FROM sides) GROUP BY name, matched_id""",
    "player_openings_along_paths": "SELECT * FROM counts",
    "merge_counts": "SELECT * FROM counts",
    "player_totals": "SELECT * FROM totals",
    "country_player_counts": "SELECT * FROM player_counts",
    "country_player_counts_approx": "SELECT *, true AS within_bounds, true AS as_in_one_pass FROM player_counts",
    "global_moments_updated": f"SELECT matched_id, {r6_all(MOMENTS)} FROM moments",
    "country_means": f"SELECT country, matched_id, {r6_all(METRICS)} FROM means",
    "global_moments": f"SELECT matched_id, {r6_all(MOMENTS)} FROM moments",
    "distributions_global": COUNTED_VALUES.replace("#", "").replace("&", "counted_values"),
    "distributions_country": COUNTED_VALUES.replace("#", "country,").replace("&", "located_values"),
    "distribution_arrays": DISTRIBUTION.replace("#", "country,").replace("&", "located_values"),
    "distributions_in_parts": DISTRIBUTION.replace("#", "").replace("&", "counted_values"),
    "distinct_keys": "SELECT DISTINCT matched_id FROM matches",
    "dedupe_known": f"""
        SELECT o_custkey, min(o_orderkey) AS o_orderkey, {r6("min_by(o_totalprice, o_orderkey)", "o_totalprice")},
               min_by(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY o_custkey""",
    "upsert_latest": """
        SELECT id, total_count_w, CASE WHEN total_count_w > 30 THEN -1 ELSE total_count_b END AS total_count_b FROM totals""",
    "num_countries": "SELECT count(*) AS num_countries FROM iso",
    # statistics
    "player_probabilities": f"SELECT * EXCLUDE ({each('@', METRICS)}), {r6_all(METRICS)} FROM players",
    "standardize": f"""
        SELECT country, matched_id, {r6_all(METRICS)}, {r6_all([f"stand_{m}" for m in METRICS])} FROM standardized""",
    "unstandardize": f"""
        SELECT country, s.matched_id, {r6("stand_p_b * std_p_b + mean_p_b", "prob_played")},
               {r6("stand_p_won_b * std_p_won_b + mean_p_won_b", "prob_won")}
        FROM standardized s JOIN moments m ON s.matched_id = m.matched_id""",
    "ks_two_sample": f"""
        SELECT matched_id, metric, CAST(n AS BIGINT) AS n, CAST(m AS BIGINT) AS m,
               {r6("CASE WHEN n > 0 AND m > 0 THEN max(abs(a / n - b / m)) END", "stat")},
               CASE WHEN n > 0 AND m > 0 THEN CASE WHEN max(b * n - a * m) > max(a * m - b * n) THEN -1 ELSE 1 END END AS sign
        FROM (SELECT matched_id, metric,
                     CAST(sum(count(v) FILTER (country IS NOT NULL)) OVER (PARTITION BY matched_id, metric ORDER BY v) AS BIGINT) AS a,
                     CAST(sum(count(v) FILTER (country IS NULL)) OVER (PARTITION BY matched_id, metric ORDER BY v) AS BIGINT) AS b,
                     CAST(sum(count(v) FILTER (country IS NOT NULL)) OVER (PARTITION BY matched_id, metric) AS BIGINT) AS n,
                     CAST(sum(count(v) FILTER (country IS NULL)) OVER (PARTITION BY matched_id, metric) AS BIGINT) AS m, v
              FROM counted_values GROUP BY matched_id, metric, v)
        WHERE v IS NOT NULL OR (n = 0 AND m = 0) GROUP BY matched_id, metric, n, m""",
    "ks_subset": "SELECT matched_id, country, metric, n, m, " + r6("stat") + ", sign FROM tests",
    "ks_pvalue": f"SELECT matched_id, country, metric, n, m, {r6('stat')}, sign, {r6('p_value')} FROM limits",
    "ks_pvalue_finite": f"SELECT matched_id, country, metric, n, m, {r6('stat')}, sign, {P_DIGITS.replace('@', 'p')} FROM finite",
    "ks_pvalue_exact": f"""
        SELECT country, t.n, t.m, {r6("stat")}, sign, {P_DIGITS.replace("@", "p")}
        FROM share_tests t LEFT JOIN lattice l ON least(t.n, t.m) = l.n AND greatest(t.n, t.m) = l.m AND t.reach = l.reach""",
    "ks_pvalue_auto": f"""
        SELECT country, t.n, t.m, {r6("stat")}, sign,
               {P_DIGITS.replace("@", "CASE WHEN greatest(t.n, t.m) <= 60 THEN l.p ELSE t.p END")}
        FROM share_finite t LEFT JOIN lattice l ON least(t.n, t.m) = l.n AND greatest(t.n, t.m) = l.m AND t.reach = l.reach""",
    "significant_deviations": SIGNIFICANT.replace("#", "won") + " AND color = 'b'",
    "all_significant_played": SIGNIFICANT.replace("#", "played"),
    "all_significant_won": SIGNIFICANT.replace("#", "won"),
    "bin_position": "SELECT country, matched_id, "
    + ", ".join(f"{position(f'stand_p_{s}')} AS pos_{s}" for s in SUFFIXES)
    + " FROM standardized",
    "band": """
        SELECT matched_id, CASE WHEN CAST(u AS DOUBLE) < 100 THEN '>' ELSE '' END || u || '%' AS upper, c || '%' AS mean,
               CASE WHEN CAST(l AS DOUBLE) > 0 THEN '<' ELSE '' END || l || '%' AS lower
        FROM (SELECT matched_id, printf('%.2f', least(mean_p_w + 3 * std_p_w, 1) * 100) AS u,
                     printf('%.2f', mean_p_w * 100) AS c, printf('%.2f', greatest(mean_p_w - std_p_w, 0) * 100) AS l
              FROM moments)""",
    "opening_profile": f"""
        SELECT i.country, name, 'b' AS color, {r6("p_b", "p")}, {r6("p_won_b", "p_won")}, {r6("mean_p_b", "mean_p")},
               {r6("std_p_b", "std_p")}, {r6("mean_p_won_b", "mean_p_won")}, {r6("std_p_won_b", "std_p_won")},
               coalesce(abs(p_b - mean_p_b) >= std_p_b OR abs(p_won_b - mean_p_won_b) >= std_p_won_b, false) AS outlier
        FROM means c JOIN iso i ON c.country = i.ISO_A2 JOIN moments m ON c.matched_id = m.matched_id
        JOIN openings o ON c.matched_id = o.id WHERE c.matched_id = 'MEDIUM Brand#2'""",
    # batches, sorts, unions
    "request_batches": """
        SELECT run, batch_no, batch_no // 26 AS slot, batch_no // 26 * 600 AS start_offset_s, string_agg(id, ',' ORDER BY id) AS ids
        FROM (SELECT id, rank // 700 AS run, rank % 700 // 300 AS batch_no
              FROM (SELECT c_name AS id, row_number() OVER (ORDER BY c_name) - 1 AS rank FROM customer))
        GROUP BY run, batch_no""",
    "sort_by_sequence": "SELECT * FROM openings",
    "sort_by_deviation": "SELECT matched_id, country, " + r6("stand_p_w", "dev_played") + " FROM standardized",
    "sort_by_player": "SELECT * FROM counts",
    "first_n": f"SELECT o_orderkey, {r6('o_totalprice')} FROM orders ORDER BY orders.o_totalprice, o_orderkey LIMIT 100",
    "union_all": f"""
        SELECT name, {r6("balance")} FROM (
            SELECT c_name AS name, c_acctbal AS balance FROM customer UNION ALL SELECT s_name, s_acctbal FROM supplier
            UNION ALL SELECT c_name, c_acctbal FROM customer)""",
    "union_evolving": f"""
        SELECT c_name AS name, c_mktsegment, NULL::DOUBLE AS s_acctbal FROM customer
        UNION ALL SELECT s_name, NULL, {r6("s_acctbal")} FROM supplier""",
    "union_sides": """
        SELECT white AS id, 'white' AS side, result FROM games UNION ALL SELECT black, 'black', result FROM games""",
    # scalar functions
    "scalar_string": f"""
        SELECT p_partkey, replace(t, ' ', '###') AS replaced, starts_with(t, 'LARGE') AS starts, contains(t, 'ring') AS holds,
               string_split(t, ':')[1] AS base, lower(p_type) AS lowered, CAST(length(t) AS INTEGER) AS size,
               {mover("t")} AS mover, p_brand || ',' || p_type AS joined,
               format('{{:,}}', CAST(floor(p_retailprice * 100) AS BIGINT)) AS grouped,
               left(p_type, 1) || lower(substr(p_type, 2)) || ' mode ' || left(p_brand, 1) || lower(substr(p_brand, 2)) AS titled,
               p_brand || '_POS_WON_W' AS suffixed, '[Event ' || p_name AS marked
        FROM (SELECT *, p_type || ': ' || p_name AS t FROM part)""",
    "scalar_math": f"""
        SELECT c_custkey, {r6("abs(c_acctbal)", "absolute")}, {r6("least(c_acctbal, 100)", "smaller")},
               {r6("greatest(c_acctbal, 100)", "larger")}, CAST(round_even(c_acctbal / 100, 0) AS INTEGER) AS half_even,
               {r6("CASE WHEN c_acctbal > 0 THEN c_acctbal ELSE 0 END", "filled")},
               {r6("(c_acctbal - 4500) / (c_acctbal + 1e-17)", "ratio")},
               {r6("c_acctbal / nullif(c_nationkey, 0)", "share")},
               {r6("floor(c_acctbal / 10000 * 1000 + 0.5) / 10", "percent")}
        FROM customer""",
    "scalar_date": """
        SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month,
               strftime(date_trunc('month', o_orderdate) + INTERVAL 5 MONTH, '%Y-%m') AS later,
               CAST((year(o_orderdate) - 1992) * 12 + month(o_orderdate) - 1 AS INTEGER) AS since FROM orders""",
    "scalar_map_json": """
        SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_nationkey ELSE 0 END AS looked_up,
               array_to_string(string_split(c_name, '0')[1:2], '-') AS sliced,
               '{"name":"' || c_name || '","place":{"c_nationkey":' || CAST(c_nationkey AS VARCHAR) || '}}' AS document
        FROM customer""",
    # map documents
    "read_features": """
        SELECT ISO_A3, 'ISO_A3' AS key, ISO_A3 AS value FROM features
        UNION ALL SELECT ISO_A3, 'ADMIN', lower(ISO_A3) FROM features
        UNION ALL SELECT ISO_A3, 'member id', '"f' || ISO_A3 || '"' FROM features
        UNION ALL SELECT ISO_A3, 'member bbox', '[0,1]' FROM features
        UNION ALL SELECT NULL, 'collection name', '"countries"' UNION ALL SELECT NULL, 'collection crs', '{"type":"name"}'""",
    "write_features": """
        SELECT lower(ISO_A3) AS admin, 'f' || ISO_A3 AS id,
               '{"coordinates":[0.5,' || CAST(length(ISO_A3) AS VARCHAR) || '],"type":"Point"}' AS geometry FROM features""",
    "feature_enrichment": " UNION ALL ".join(
        f"""SELECT f.ISO_A3, o.id || '_{label}' AS key, {r6(f"CAST(coalesce({cell}, 0) AS DOUBLE)", "value")}
        FROM features f CROSS JOIN (SELECT DISTINCT matched_id AS id FROM placed) o
        LEFT JOIN placed p ON f.ISO_A3 = p.country AND o.id = p.matched_id"""
        for s in SUFFIXES
        for label, cell in ((f"POS_{s.upper()}", f"pos_{s}"), (s.upper(), f"p_{s}"))
    )
    + """ UNION ALL SELECT ISO_A3, 'member bbox', 1::DOUBLE FROM features
        UNION ALL SELECT f.ISO_A3, 'PLAYER_COUNT', CAST(coalesce(num_players, 0) AS DOUBLE)
        FROM features f LEFT JOIN iso i ON f.ISO_A3 = i.ISO_A3 LEFT JOIN player_counts n ON n.country = i.ISO_A2""",
    "write_metadata": f"""
        SELECT 300 AS positive_positions, 100 AS negative_positions, (SELECT count(*) FROM iso) AS num_countries,
               c.matched_id, name, pgn, {r6_all(MOMENTS)}
        FROM (SELECT DISTINCT matched_id FROM means) c JOIN openings o ON c.matched_id = o.id
        JOIN moments m ON c.matched_id = m.matched_id""",
    "read_metadata": """
        SELECT 300 AS positive_positions, 100 AS negative_positions, (SELECT count(*) FROM iso) AS num_countries,
               CAST(count(DISTINCT matched_id) AS INTEGER) AS num_openings, 'kept' AS source FROM means""",
    # jobs
    "games": f"""
        SELECT white, black, coalesce(original_name, 'Unknown') AS original_name, moves AS original_moves, result,
               {ELO.replace("@", "white")} AS w_elo,
               CASE WHEN result <> '1/2-1/2' THEN {ELO.replace("@", "black")} END AS b_elo,
               'Rated game ' || month AS event, matched_id, matched_moves, real_game FROM matches""",
    "merge_months": "SELECT * FROM counts",
    "month_ledger": f"""
        SELECT id, matched_id, {each("CAST(sum(@) AS BIGINT) AS @", COUNTS)}, count(DISTINCT month) AS months
        FROM monthly WHERE month NOT IN ('1995-03', '1996-12') GROUP BY id, matched_id""",
    "new_player_batches": """
        SELECT run, batch_no, batch_no // 3 AS slot, batch_no // 3 * 600 AS start_offset_s, string_agg(id, ',' ORDER BY id) AS ids
        FROM (SELECT id, rank // 120000 AS run, rank % 120000 // 20 AS batch_no
              FROM (SELECT id, row_number() OVER (ORDER BY id) - 1 AS rank
                    FROM (SELECT DISTINCT CASE WHEN CAST(id AS BIGINT) % 2 = 0 THEN 'P' ELSE 'p' END || id AS id
                          FROM counts WHERE id NOT IN (SELECT id FROM profiles WHERE country IS NOT NULL))))
        GROUP BY run, batch_no""",
    "merge_profiles": """
        SELECT id, country, NULL AS source FROM profiles WHERE country IS NOT NULL
        UNION ALL SELECT 'p' || id, country, 'new' FROM profiles WHERE country IS NULL""",
    "country_probabilities": f"""
        SELECT country, matched_id, {r6_all(METRICS)}, {r6_all([f"stand_{m}" for m in METRICS])} FROM standardized""",
    "ks_test": f"""
        SELECT matched_id, country, {", ".join(f"{r6(m + '_stat')}, {r6(m + '_p_value')}, {m}_sign" for m in METRICS)}
        FROM ks""",
    "known_countries": """
        SELECT ISO_A2, ISO_A3, country, CASE WHEN ISO_A2 < 'KX' THEN 'seen' END AS place_id FROM iso
        WHERE ISO_A2 < 'KX' OR ISO_A2 IN (SELECT country FROM means)""",
}


def _needed(text: str, found: list[str]) -> list[str]:
    """Shared tables a text uses, each after the ones it uses itself."""
    for name, body in TABLES.items():
        if name not in found and re.search(rf"(FROM|JOIN|,)\s+{name}\b", text):
            _needed(body, found)
            if name not in found:
                found.append(name)
    return found


def oracles() -> dict[str, str]:
    texts = {}
    for name, text in SQL.items():
        tables = _needed(text, [])
        shared = ",\n".join(f"{t} AS MATERIALIZED ({TABLES[t]})" for t in tables)
        texts[name] = f"WITH {shared}\n{text}" if tables else text
    return texts
