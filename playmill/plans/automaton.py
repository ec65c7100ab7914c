"""DuckDB SQL of the validator's automaton: a recursive table that takes one play of each run at a time."""

from __future__ import annotations

from playmill.streaming.rules import ADMIN_WORDS, PATTERN_WORDS
from playmill.streaming.validator import Limits

#: The state of a run between two plays.
STATE = ["quarter", "seconds", "away", "home", "plays", "same_text", "same_clock", "low_clock", "substitutions", "likeness", "clock", "score", "quarters", "situation", "wording", "patterns", "context", "snapshot", "ended"]


def _says(text: str, *words: str) -> str:
    return f"regexp_matches({text}, '{'|'.join(words)}')"


def _facts(source: str, court: bool) -> str:
    """Each play with what it says by itself; ``court`` where the source has shooter, player and court."""
    up, low = "upper(t)", "lower(t)"
    words = "string_split_regex(regexp_replace(regexp_replace(regexp_replace(upper(t), '\\d+:\\d+', 'TIME', 'g'), '\\d+ - \\d+', 'SCORE', 'g'), '\\d+', 'NUM', 'g'), '\\s+')"
    names = ", ".join(f"'{w}'" for w in PATTERN_WORDS)
    keys = f"list_filter([{names}], lambda w: contains({up}, w))[1:3]"
    pattern = f"concat_ws('|', CASE WHEN points > 0 THEN 'SHOT:' || points || 'PT' END, CASE WHEN len({keys}) > 0 THEN 'DESC:' || array_to_string({keys}, '-') END)"
    gap, last = "abs(away - home)", "seconds < 30 AND abs(away - home) <= 3"
    odd = " OR ".join(
        [
            f"({_says(up, 'TIMEOUT')} AND {gap} > 20 AND seconds >= 120)",
            f"({_says(up, 'FOUL')} AND {_says(up, 'INTENTIONAL')} AND quarter < 4 AND seconds >= 120 AND {gap} > 15)",
            f"({last} AND {gap} > 1 AND {_says(up, 'SLOW', 'DELIBERATE')})",
            f"(points = 1 AND NOT {_says(up, 'FOUL', 'FREE')})",
            f"({_says(up, 'SUB')} AND {last})",
        ]
    )
    wrong = " OR ".join(
        [
            f"(points = 3 AND NOT {_says(up, '3', 'THREE', 'POINTER')} AND {_says(up, 'SHOT', 'MAKE', 'SCORE')})",
            f"(points = 2 AND {_says(up, '3')} AND {_says(up, 'THREE', 'POINTER')})",
            f"(points = 1 AND NOT {_says(up, 'FOUL', 'FREE', 'TECHNICAL')})",
            f"(len(court) > 0 AND player <> '' AND NOT list_contains(court, player) AND NOT contains({up}, upper(player)))",
            f"({_says(up, 'SUB')} AND NOT regexp_matches(replace({up}, 'SUB', ''), '\\p{{L}}'))",
            f"(quarter = 4 AND NOT {_says(up, 'FOURTH', '4TH')} AND {_says(up, 'FIRST', '1ST')})",
        ]
    )
    scores = _says(up, "SCORE", "MAKE", "BASKET", "SHOT", "POINT")
    own = "shooter, player, court" if court else "CAST(NULL AS VARCHAR) AS shooter, '' AS player, CAST([] AS VARCHAR[]) AS court"
    return f"""told AS (SELECT run_id, seq, quarter, seconds, away, home, points, coalesce(description, '') AS t, {own} FROM {source}),
facts AS MATERIALIZED (SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS rn, seq, quarter, seconds, away, home, points, shooter, t,
  list_distinct(list_filter({words}, lambda w: w <> '')) AS words, contains({low}, 'period') AS period, {_says(low, *ADMIN_WORDS)} AS adm, {_says(low, 'substitution', 'timeout', 'unknown', 'end of', 'technical')} AS closing, contains({low}, 'sub') AS sub,
  CASE WHEN {pattern} = '' THEN 'GENERIC_PLAY' ELSE {pattern} END AS pattern, coalesce({odd}, FALSE) AS odd, t <> '' AND coalesce({wrong}, FALSE) AS wrong,
  {scores} AND NOT {_says(up, 'MISS', 'BLOCK', 'REBOUND')} AS claims, t <> '' AND NOT {scores} AND NOT {_says(up, 'SUB', 'TIMEOUT', 'FOUL')} AS mute, coalesce(len(court) > len(list_distinct(court)), FALSE) AS twice FROM told)"""


def _ending(lim: Limits) -> str:
    """Why a quarter ends, or null, from the state before (s_*), the play and its counters."""
    zero = "list_filter(s_context, lambda r: r.seconds = 0)"
    number = lambda rows, flag: f"len(list_filter({rows}, lambda r: r.{flag}))"
    period = f"period OR {number(zero, 'period')} > 0"
    if lim.fast:
        rest = f"WHEN {number(f'({zero})[-8:]', 'adm')} >= 2 AND (same_clock >= 4 OR len({zero}) >= 4) THEN 'administrative plays'"
    else:
        recent = "list_filter(s_context[-6:], lambda r: r.seconds = 0)"
        rest = f"""WHEN same_clock >= {lim.admin_at} AND closing AND {number(f'({recent})[-5:]', 'closing')} + 1 >= 3 THEN 'administrative plays'
      WHEN same_clock >= {lim.substitutions_at} AND {number(recent, 'sub')} + CAST(sub AS INT) >= 3 THEN 'substitutions' WHEN same_clock >= {lim.stall_at} THEN 'clock stands at the end'"""
    return f"CASE WHEN seconds = 0 AND quarter BETWEEN 1 AND 3 THEN CASE WHEN {period} THEN 'end of period' {rest} END END"


def _checks(lim: Limits) -> list[tuple[str, str, str, str]]:
    """(condition, reason, trigger, consecutive) of the checks that ask for another play, in order."""
    return [
        (f"same_text >= {lim.same_text}", "'repeated response'", "same_text", "same_text"),
        (f"likeness >= {lim.similar_strikes}", "'near-duplicate responses'", "similar", "likeness"),
        (f"coalesce(list_filter(patterns, lambda x: x.k = pattern)[1].n, 0) >= {lim.pattern}", "'pattern repeated: ' || pattern", "pattern", str(lim.pattern)),
        (f"substitutions >= {lim.substitutions}", "'too many substitutions'", "substitutions", "substitutions"),
        (f"clock >= {lim.clock_strikes}", "'clock runs forward'", "clock", "clock"),
        (f"greatest(fall_a, fall_h) > {lim.score_drop} OR score >= {lim.score_strikes}", "'score falls'", "score", "score"),
        (f"coalesce(points > 0 AND s_plays > 0 AND abs(CASE shooter WHEN 'A' THEN -fall_a WHEN 'H' THEN -fall_h END - points) > {lim.shot_gap}, FALSE)", "'score and shot disagree'", "shot", "NULL"),
        (f"points > {lim.max_points} OR greatest(-fall_a, -fall_h) > {lim.max_jump} OR greatest(away, home) > {lim.max_score} OR ahead > {lim.max_quarter_jump} OR (same_quarter AND s_seconds >= 0 AND seconds - s_seconds > {lim.max_clock_jump}) OR twice", "'impossible figures'", "impossible", "NULL"),
        (f"ahead > {lim.quarter_skip}", "'quarters skipped'", "quarter_skip", "NULL"),
        (f"quarters >= {lim.quarter_strikes}", "'quarters begin far from their full clock'", "quarter", "quarters"),
        (f"situation >= {lim.situation_strikes}", "'plays do not fit the situation'", "situation", "situation"),
        (f"wording >= {lim.text_strikes}", "'text contradicts the play'", "text", "wording"),
    ]


def validator_sql(source: str, lim: Limits, court: bool = False) -> str:
    """Common table expressions ending in ``judged`` (run_id, seq, verdict, reason, trigger, consecutive, attempts, restored, next_quarter)."""
    entry = "STRUCT(seq BIGINT, quarter INT, seconds INT, t VARCHAR, words VARCHAR[], period BOOLEAN, adm BOOLEAN, closing BOOLEAN, sub BOOLEAN)[]"
    first = ["0", "-1", "0", "0", "0", *["0"] * 10, "CAST([] AS STRUCT(k VARCHAR, n INT)[])", f"CAST([] AS {entry})", f"CAST(NULL AS {entry})", "FALSE"]
    kinds = ["INT"] * 15 + [None] * 4
    start = ", ".join(f"CAST({v} AS {k}) AS {n}" if k else f"{v} AS {n}" for v, k, n in zip(first, kinds, STATE))
    over = "quarter >= 4 AND seconds = 0 AND away <> home" + (" OR quarter = 4 AND seconds = 0" if lim.fast else "")
    stuck = lim.fast_same_clock if lim.fast else lim.same_clock
    ladder = [(over, "END_GAME", "'time expired'", "quarter_4_time_expired", "NULL")]
    if not lim.fast:
        ladder.append((f"low_clock >= {lim.low_clock_plays}", "END_GAME", "'clock runs out'", "low_clock", "low_clock"))
    ladder += [("ending IS NOT NULL", "QUARTER_TRANSITION", "ending", "end_of_quarter", "same_clock")]
    ladder += [(f"same_clock >= {stuck}", "ROLLBACK_TIME", "'clock stuck, back to ' || coalesce(snapshot[-1].seq, -1)", "same_clock", "same_clock")]
    if not lim.fast:
        ladder += [(c, "RETRY", r, t, n) for c, r, t, n in _checks(lim)]
    verdict = "CASE " + " ".join(f"WHEN {c} THEN {{'verdict': '{k}', 'reason': {r}, 'trigger': '{t}', 'consecutive': CAST({n} AS INT)}}" for c, k, r, t, n in ladder) + " ELSE {'verdict': 'VALID', 'reason': '', 'trigger': NULL, 'consecutive': NULL} END"
    again = lambda name, trigger: f"CASE WHEN v.verdict = 'RETRY' AND v.trigger = '{trigger}' THEN 0 ELSE {name} END"
    forget = "v.verdict IN ('ROLLBACK_TIME', 'QUARTER_TRANSITION')"
    kept = "CASE WHEN v.trigger = 'score' THEN s_{0} ELSE {0} END"
    context = f"CASE WHEN v.verdict = 'ROLLBACK_TIME' THEN coalesce(snapshot, []) ELSE list_append(s_context, {{'seq': seq, 'quarter': quarter, 'seconds': seconds, 't': t, 'words': words, 'period': period, 'adm': adm, 'closing': closing, 'sub': sub}})[-{lim.context}:] END"
    after = {
        "quarter": "quarter", "seconds": f"CASE WHEN {forget} THEN -1 ELSE seconds END", "away": kept.format("away"), "home": kept.format("home"), "plays": "s_plays + 1",
        "same_text": again("same_text", "same_text"), "same_clock": f"CASE WHEN {forget} THEN 0 ELSE same_clock END", "low_clock": "low_clock", "substitutions": again("substitutions", "substitutions"),
        "likeness": again("likeness", "similar"), "clock": again("clock", "clock"), "score": again("score", "score"), "quarters": again("quarters", "quarter"), "situation": again("situation", "situation"), "wording": again("wording", "text"),
        "patterns": "CASE WHEN v.verdict = 'RETRY' AND v.trigger = 'pattern' THEN list_transform(patterns, lambda x: {'k': x.k, 'n': CASE WHEN x.k = pattern THEN 0 ELSE x.n END}) ELSE patterns END",
        "context": context, "snapshot": "CASE WHEN v.verdict <> 'ROLLBACK_TIME' THEN snapshot END", "ended": "v.verdict = 'END_GAME'",
    }
    moved = ", ".join(f"CASE WHEN s_ended THEN s_{n} ELSE {after[n]} END AS {n}" for n in STATE)
    alike = f"len(list_filter(s_context[-{lim.look_back}:], lambda r: r.t <> t AND len(list_intersect(r.words, words)) / greatest(len(list_distinct(list_concat(r.words, words))), 1) > {lim.similar}))"
    return f"""{_facts(source, court)},
folded(run_id, rn, {", ".join(STATE)}, seq, v, restored, next_quarter) AS (
SELECT DISTINCT run_id, CAST(0 AS BIGINT), {start}, CAST(NULL AS BIGINT), {{'verdict': '', 'reason': '', 'trigger': CAST(NULL AS VARCHAR), 'consecutive': CAST(NULL AS INT)}}, CAST(NULL AS BIGINT[]), CAST(NULL AS INT) FROM facts
UNION ALL
SELECT run_id, rn, {moved}, seq, CASE WHEN s_ended THEN {{'verdict': 'END_GAME', 'reason': 'after the end', 'trigger': NULL, 'consecutive': NULL}} ELSE v END, CASE WHEN NOT s_ended AND v.verdict = 'ROLLBACK_TIME' THEN list_transform(coalesce(snapshot, []), lambda r: r.seq) END, CASE WHEN NOT s_ended AND v.verdict = 'QUARTER_TRANSITION' THEN quarter + 1 END
FROM (SELECT *, {verdict} AS v FROM (SELECT *, {_ending(lim)} AS ending FROM (SELECT *,
  CASE WHEN len(patterns_all) > {lim.patterns_held} THEN list_filter(patterns_all, lambda x: x.n > 1) ELSE patterns_all END AS patterns,
  CASE WHEN same_clock = 1 THEN list_filter(s_context, lambda r: r.quarter <> quarter OR r.seconds <> seconds) ELSE s_snapshot END AS snapshot FROM (SELECT *,
  CASE WHEN same_quarter AND seconds = s_seconds THEN s_same_clock + 1 ELSE 0 END AS same_clock, CASE WHEN quarter = 4 AND seconds < {lim.low_clock} THEN s_low_clock + 1 ELSE 0 END AS low_clock,
  CASE WHEN len(s_context) > 0 AND s_context[-1].t = t THEN s_same_text + 1 ELSE 0 END AS same_text, s_likeness + CASE WHEN {alike} >= {lim.similar_plays} THEN 1 ELSE 0 END AS likeness,
  CASE WHEN sub THEN s_substitutions + 1 ELSE 0 END AS substitutions, CASE WHEN same_quarter THEN s_clock ELSE 0 END + CASE WHEN same_quarter AND seconds - s_seconds > {lim.clock_forward} THEN 1 ELSE 0 END AS clock,
  s_score + CASE WHEN fall_a > 0 THEN 1 ELSE 0 END + CASE WHEN fall_h > 0 THEN 1 ELSE 0 END AS score, s_situation + CAST(odd AS INT) AS situation,
  s_quarters + CASE WHEN ahead = 1 AND CASE WHEN quarter <= 4 THEN abs(seconds - 720) > 300 ELSE abs(seconds - 300) > 180 END THEN 1 ELSE 0 END AS quarters,
  s_wording + CASE WHEN wrong OR (s_plays > 0 AND CASE WHEN fall_a < 0 OR fall_h < 0 THEN mute ELSE claims END) THEN 1 ELSE 0 END AS wording,
  list_append(list_filter(s_patterns, lambda x: x.k <> pattern), {{'k': pattern, 'n': CAST(coalesce(list_filter(s_patterns, lambda x: x.k = pattern)[1].n, 0) + 1 AS INT)}}) AS patterns_all
  FROM (SELECT p.*, {", ".join(f"s.{n} AS s_{n}" for n in STATE)}, s.plays > 0 AND p.quarter = s.quarter AS same_quarter, CASE WHEN s.plays > 0 THEN p.quarter - s.quarter ELSE 0 END AS ahead,
    CASE WHEN s.plays > 0 THEN s.away - p.away ELSE 0 END AS fall_a, CASE WHEN s.plays > 0 THEN s.home - p.home ELSE 0 END AS fall_h FROM folded s JOIN facts p ON p.run_id = s.run_id AND p.rn = s.rn + 1)))))),
judged AS (SELECT run_id, seq, v.verdict AS verdict, v.reason AS reason, v.trigger AS trigger, v.consecutive AS consecutive, plays AS attempts, restored, next_quarter FROM folded WHERE rn > 0)"""


def query_sql(source: str, lim: Limits, court: bool, body: str) -> str:
    """A statement over the verdicts."""
    return f"WITH RECURSIVE {validator_sql(source, lim, court)} {body}"
