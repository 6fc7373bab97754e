"""SQL building blocks for the comparison queries."""

from __future__ import annotations

MATCHES = """
m AS (
 SELECT CAST(o_orderkey // 50 AS BIGINT) AS id, CAST(year(o_orderdate) AS INT) AS season,
  CAST(o_orderdate AS DATE) AS date,
  concat('Venue ', CAST(o_custkey % 12 AS STRING)) AS venue,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'Final' ELSE 'League' END AS match_type,
  concat('Team ', CAST(a AS STRING)) AS team1, concat('Team ', CAST(b AS STRING)) AS team2,
  concat('Team ', CAST(CASE WHEN price % 2 = 0 THEN a ELSE b END AS STRING)) AS toss_winner,
  CASE WHEN o_orderstatus = 'F' THEN 'bat' ELSE 'field' END AS toss_decision,
  CASE WHEN price % 25 = 0 THEN NULL
       ELSE concat('Team ', CAST(CASE WHEN price % 3 < 2 THEN a ELSE b END AS STRING)) END AS winner,
  CASE WHEN o_orderstatus = 'F' THEN CAST(price % 80 AS INT) ELSE 0 END AS win_by_runs,
  CASE WHEN o_orderstatus <> 'F' THEN CAST(1 + price % 10 AS INT) ELSE 0 END AS win_by_wickets
 FROM (SELECT *, CAST(floor(o_totalprice) AS BIGINT) AS price, o_custkey % 8 AS a,
              (o_custkey % 8 + 1 + (o_orderkey // 50) % 7) % 8 AS b
       FROM orders
       WHERE o_orderkey IN (SELECT MIN(o_orderkey) FROM orders GROUP BY o_orderkey // 50)) o)"""

DELIVERIES = """
d AS (
 SELECT x.*, batsman_runs + extra_runs AS total_runs,
  CASE WHEN over < 6 THEN 'powerplay' WHEN over < 15 THEN 'middle' ELSE 'death' END AS phase,
  CASE WHEN inning = 1 THEN m.team1 ELSE m.team2 END AS batting_team,
  CASE WHEN inning = 1 THEN m.team2 ELSE m.team1 END AS bowling_team,
  CASE WHEN dismissal_kind IS NULL THEN NULL WHEN dismissal_kind = 'run out' THEN non_striker
       ELSE batter END AS player_dismissed,
  CASE WHEN dismissal_kind IS NOT NULL THEN 'pressure_error' WHEN batsman_runs >= 4 THEN 'aggressive'
       WHEN batsman_runs = 0 AND extra_runs = 0 THEN 'defensive' ELSE 'neutral' END AS intent
 FROM (SELECT CAST(l_orderkey // 50 AS BIGINT) AS match_id,
  CAST(1 + (l_orderkey % 50) // 25 AS INT) AS inning,
  CAST(((l_orderkey % 25) * 20) // 25 AS INT) AS over,
  CAST(1 + (l_linenumber - 1) % 6 AS INT) AS ball,
  concat('B', CAST(l_partkey % 60 AS STRING)) AS batter,
  concat('B', CAST((l_partkey + 7) % 60 AS STRING)) AS non_striker,
  concat('W', CAST(l_suppkey % 40 AS STRING)) AS bowler,
  CASE CAST(l_quantity AS INT) % 8 WHEN 3 THEN 1 WHEN 4 THEN 1 WHEN 5 THEN 2 WHEN 6 THEN 4 WHEN 7 THEN 6
       ELSE 0 END AS batsman_runs,
  CASE WHEN l_tax >= 0.075 THEN 1 ELSE 0 END AS extra_runs,
  CASE WHEN CAST(floor(l_extendedprice) AS BIGINT) % 20 = 0
       THEN CASE l_linenumber % 4 WHEN 0 THEN 'caught' WHEN 1 THEN 'bowled' WHEN 2 THEN 'run out'
                 ELSE 'lbw' END END AS dismissal_kind,
  row_number() OVER (PARTITION BY l_orderkey // 50
    ORDER BY l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_discount,
             l_tax, l_quantity, l_returnflag, l_linestatus) AS seq
  FROM lineitem) x JOIN m ON m.id = x.match_id)"""


def r(num: str, den: str, scale: int = 1, nd: int = 2) -> str:
    """round(scale * num / den, nd) on whole numbers, half away from zero, null when den is 0."""
    f = 10 ** nd
    return (f"(CAST((2 * {scale * f} * CAST(({num}) AS HUGEINT) + ({den})) // NULLIF(2 * ({den}), 0) AS DOUBLE)"
            f" / {f}.0)")


def cents(col: str) -> str:
    return f"CAST(ROUND({col} * 100) AS BIGINT)"


def mean2(col: str, nd: int) -> str:
    return r(f"SUM({cents(col)})", f"(100 * COUNT({col}))", 1, nd)


def even(expr: str) -> str:
    return f"(round_even(({expr}) * 100.0, 0) / 100.0)"


def isum(expr: str) -> str:
    return f"CAST(SUM({expr}) AS BIGINT)"


def isum_if(cond: str) -> str:
    return f"CAST(COALESCE(SUM(CASE WHEN {cond} THEN 1 ELSE 0 END), 0) AS BIGINT)"


OUT = "dismissal_kind IS NOT NULL AND player_dismissed = batter"
DOT = "batsman_runs = 0 AND extra_runs = 0"

BATTING = f"""
bat AS (
 SELECT batter AS player, m.season, 'batsman' AS role, phase, COUNT(DISTINCT match_id) AS innings,
  {isum('batsman_runs')} AS runs, COUNT(*) AS balls_faced,
  {r('SUM(batsman_runs)', 'COUNT(*)', 100)} AS strike_rate,
  {r('SUM(batsman_runs)', f'SUM(CASE WHEN {OUT} THEN 1 ELSE 0 END)')} AS average,
  CAST(0 AS BIGINT) AS wickets, CAST(0 AS DOUBLE) AS economy,
  {r(f'SUM(CASE WHEN {DOT} THEN 1 ELSE 0 END)', 'COUNT(*)', 100)} AS dot_pct
 FROM d JOIN m ON d.match_id = m.id WHERE batter IS NOT NULL GROUP BY 1, 2, 3, 4)"""

BOWLING = f"""
bowl AS (
 SELECT bowler AS player, m.season, 'bowler' AS role, phase, COUNT(DISTINCT match_id) AS innings,
  CAST(0 AS BIGINT) AS runs, CAST(0 AS BIGINT) AS balls_faced, CAST(0 AS DOUBLE) AS strike_rate,
  CAST(0 AS DOUBLE) AS average,
  {isum_if("dismissal_kind IS NOT NULL AND dismissal_kind NOT IN ('run out', 'retired hurt')")} AS wickets,
  {r('SUM(total_runs)', 'COUNT(*)', 6)} AS economy,
  {r('SUM(CASE WHEN total_runs = 0 THEN 1 ELSE 0 END)', 'COUNT(*)', 100)} AS dot_pct
 FROM d JOIN m ON d.match_id = m.id WHERE bowler IS NOT NULL GROUP BY 1, 2, 3, 4)"""

CAREER = "\ncareer AS (SELECT * FROM bat UNION ALL SELECT * FROM bowl)"

H2H = f"""
h AS (
 SELECT batter, bowler, phase, COUNT(*) AS balls, {isum('batsman_runs')} AS runs,
  {isum_if(OUT)} AS wickets,
  {r('SUM(batsman_runs)', 'COUNT(*)', 100)} AS strike_rate,
  {r(f'SUM(CASE WHEN {DOT} THEN 1 ELSE 0 END)', 'COUNT(*)', 100)} AS dot_pct,
  {r('SUM(CASE WHEN batsman_runs >= 4 THEN 1 ELSE 0 END)', 'COUNT(*)', 100)} AS boundary_pct
 FROM d WHERE batter IS NOT NULL AND bowler IS NOT NULL GROUP BY 1, 2, 3)"""


def _rate(p: str) -> str:
    inside = f"CASE WHEN phase = '{p}' THEN total_runs END"
    return r(f"SUM({inside})", f"COUNT({inside})", 6)


INNINGS = "\ninn AS (SELECT match_id, inning, SUM(total_runs) AS inn_runs FROM d GROUP BY 1, 2)"

VENUE = f"""
v AS (
 SELECT m.venue, m.season,
  {r('SUM(CASE WHEN d.inning = 1 THEN inn_runs END)', 'COUNT(CASE WHEN d.inning = 1 THEN 1 END)')} AS avg_first_inn,
  {r("SUM(CASE WHEN winner = team1 AND toss_decision = 'bat' THEN 1 "
     "WHEN winner = team2 AND toss_decision = 'field' THEN 1 ELSE 0 END)", 'COUNT(DISTINCT m.id)', 100)}
   AS win_bat_first_pct,
  {_rate('powerplay')} AS avg_powerplay_rr, {_rate('middle')} AS avg_middle_rr, {_rate('death')} AS avg_death_rr
 FROM m JOIN d ON m.id = d.match_id
  JOIN inn ON inn.match_id = d.match_id AND inn.inning = d.inning
 WHERE m.venue IS NOT NULL AND m.season IS NOT NULL GROUP BY 1, 2)"""

FORM = f"""
form AS (
 SELECT team, season, {isum_if('rn <= 5 AND won = 1')} AS last5_wins, {isum_if('rn <= 5 AND won = 0')} AS last5_losses,
  {r('SUM(CASE WHEN rn <= 5 THEN margin END)', 'COUNT(CASE WHEN rn <= 5 THEN margin END)')} AS avg_rr_diff,
  {r('SUM(CASE WHEN rn <= 5 AND won = 1 THEN 1 ELSE 0 END)', '5', 100)} AS form_rating
 FROM (SELECT *, row_number() OVER (PARTITION BY team, season ORDER BY id DESC) AS rn
       FROM (SELECT id, season, team1 AS team, CASE WHEN winner = team1 THEN 1 ELSE 0 END AS won,
                    win_by_runs + win_by_wickets * 10 AS margin FROM m
             UNION ALL
             SELECT id, season, team2, CASE WHEN winner = team2 THEN 1 ELSE 0 END,
                    win_by_runs + win_by_wickets * 10 FROM m) s) t
 WHERE team IS NOT NULL AND season IS NOT NULL GROUP BY 1, 2)"""

SEASON = f"""
champ AS (SELECT season, winner AS champion FROM
 (SELECT season, winner, row_number() OVER (PARTITION BY season ORDER BY COUNT(*) DESC, winner) AS rn
  FROM m WHERE winner IS NOT NULL GROUP BY season, winner) c WHERE rn = 1),
fin AS (SELECT * FROM (SELECT season, team1 AS f1, team2 AS f2, winner AS final_winner,
  row_number() OVER (PARTITION BY season ORDER BY id) AS rn FROM m WHERE match_type = 'Final') f WHERE rn = 1),
scorer AS (SELECT * FROM (SELECT season, player, SUM(runs) AS total,
  row_number() OVER (PARTITION BY season ORDER BY SUM(runs) DESC, player) AS rn FROM bat GROUP BY 1, 2) q WHERE rn = 1),
wick AS (SELECT * FROM (SELECT season, player, SUM(wickets) AS total,
  row_number() OVER (PARTITION BY season ORDER BY SUM(wickets) DESC, player) AS rn FROM bowl GROUP BY 1, 2) q
  WHERE rn = 1),
ss AS (
 SELECT s.season, COALESCE(champion, 'Unknown') AS champion,
  CASE WHEN f1 <> COALESCE(champion, 'Unknown') THEN f1 WHEN f2 <> COALESCE(champion, 'Unknown') THEN f2
       ELSE 'Unknown' END AS runner_up,
  final_winner, COALESCE(scorer.player, 'N/A') AS top_scorer, CAST(COALESCE(scorer.total, 0) AS BIGINT) AS top_runs,
  COALESCE(wick.player, 'N/A') AS top_bowler, CAST(COALESCE(wick.total, 0) AS BIGINT) AS top_wickets,
  total_matches, COALESCE(avg_score, 0.0) AS avg_score
 FROM (SELECT season, COUNT(*) AS total_matches FROM m WHERE season IS NOT NULL GROUP BY 1) s
  LEFT JOIN champ ON champ.season = s.season LEFT JOIN fin ON fin.season = s.season
  LEFT JOIN scorer ON scorer.season = s.season LEFT JOIN wick ON wick.season = s.season
  LEFT JOIN (SELECT season, {mean2('avg_first_inn', 1)} AS avg_score FROM v GROUP BY 1) av ON av.season = s.season)"""

PROFILE = f"""
vp AS (
 SELECT venue, COALESCE({mean2('avg_first_inn', 1)}, 0.0) AS avg_score,
  LEAST(COALESCE({mean2('win_bat_first_pct', 1)}, 0.0), 100.0) AS bat_first_win,
  COALESCE({mean2('avg_powerplay_rr', 2)}, 0.0) AS pp_rr, COALESCE({mean2('avg_middle_rr', 2)}, 0.0) AS mid_rr,
  COALESCE({mean2('avg_death_rr', 2)}, 0.0) AS death_rr
 FROM v GROUP BY 1)"""

# Building blocks in dependency order; a query names the ones it needs.
_BLOCKS = {
    "m": (MATCHES, []),
    "d": (DELIVERIES, ["m"]),
    "bat": (BATTING, ["d", "m"]),
    "bowl": (BOWLING, ["d", "m"]),
    "career": (CAREER, ["bat", "bowl"]),
    "h": (H2H, ["d"]),
    "inn": (INNINGS, ["d"]),
    "v": (VENUE, ["d", "m", "inn"]),
    "form": (FORM, ["m"]),
    "ss": (SEASON, ["m", "bat", "bowl", "v"]),
    "vp": (PROFILE, ["v"]),
}


def add_block(name: str, text: str, needs: list[str]) -> None:
    _BLOCKS[name] = (text, needs)


def sql(needs: str, body: str) -> str:
    """``WITH`` the named blocks (and what they depend on), then ``body``."""
    order: list[str] = []

    def visit(name: str) -> None:
        for dep in _BLOCKS[name][1]:
            visit(dep)
        if name not in order:
            order.append(name)

    for name in needs.split():
        visit(name)
    return "WITH " + ",".join(_BLOCKS[n][0].strip() for n in order) + "\n" + body.strip()
