"""Sequence-state validation: one fold per run, used in batch and in Structured Streaming.

In batch ``playmill.streaming.fold`` runs it in the JVM; ``step`` is the same automaton for streams, a play at a time.
Checks run in a fixed order and the first that fires decides.  All compare a play with the play before it and with the
context, the last ``Limits.context`` plays; the state moves on only afterwards.  A rollback restores the context to the
plays before the clock stood still, a transition forgets the clock.  A fall of the score that fires is not
believed, so the scores before it stay.  Batch and stream give the same verdicts for the same order; the stream sorts the rows of a batch and gives a late one, behind a play that was
judged already, the verdict LATE without a change of state.

Windows of ``playmill.streaming.rules`` count the same strikes without Python where no restart of state is needed.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playmill.streaming import fold
from playmill.streaming.rules import ADMIN_WORDS, PATTERN_WORDS

IN = "run_id long, seq long, quarter int, seconds int, away int, home int, points int, description string"
OUT = "run_id long, seq long, verdict string, reason string, trigger string, consecutive int, attempts int, restored array<long>, next_quarter int"


@dataclass
class Limits:
    """Fixed values of the normal mode; pass others to change them.  ``fast`` checks end, transition and clock only."""

    fast: bool = False
    context: int = 20
    same_text: int = 3
    similar: float = 0.85
    look_back: int = 5
    similar_plays: int = 3
    similar_strikes: int = 5
    pattern: int = 12
    patterns_held: int = 50
    same_clock: int = 8
    fast_same_clock: int = 5
    admin_at: int = 3
    substitutions_at: int = 4
    stall_at: int = 5
    low_clock: int = 5
    low_clock_plays: int = 5
    clock_forward: int = 10
    clock_strikes: int = 5
    score_drop: int = 3
    score_strikes: int = 5
    max_points: int = 4
    max_jump: int = 6
    max_quarter_jump: int = 3
    max_clock_jump: int = 720
    max_score: int = 300
    shot_gap: int = 5
    quarter_skip: int = 2
    quarter_strikes: int = 5
    situation_strikes: int = 8
    substitutions: int = 10
    text_strikes: int = 6


@dataclass
class State:
    """What a run remembers: bounded whatever its length."""

    quarter: int = 0
    seconds: int = -1
    away: int = 0
    home: int = 0
    plays: int = 0
    last_seq: int | None = None
    same_text: int = 0
    same_clock: int = 0
    low_clock: int = 0
    substitutions: int = 0
    similar_strikes: int = 0
    clock_strikes: int = 0
    score_strikes: int = 0
    quarter_strikes: int = 0
    situation_strikes: int = 0
    text_strikes: int = 0
    patterns: dict[str, int] = field(default_factory=dict)
    context: list[list] = field(default_factory=list)  # (seq, quarter, seconds, text)
    snapshot: list[list] | None = None
    ended: bool = False
    words: dict[str, frozenset[str]] = field(default_factory=dict)  # of the texts in view, worked out once; not kept


@dataclass
class Verdict:
    """One play's verdict; ``restored`` are the plays a rollback goes back to, ``next_quarter`` where a transition leads."""

    verdict: str = "VALID"
    reason: str = ""
    trigger: str | None = None
    consecutive: int | None = None
    restored: list[int] | None = None
    next_quarter: int | None = None


def _plain(text: str) -> str:
    text = re.sub(r"\d+:\d+", "TIME", text.upper())
    return re.sub(r"\d+", "NUM", re.sub(r"\d+ - \d+", "SCORE", text))


def _overlap(x: frozenset[str], y: frozenset[str]) -> float:
    return len(x & y) / len(x | y) if x | y else 0.0


def _has(text: str, words: tuple[str, ...]) -> bool:
    text = text.lower()
    return any(w in text for w in words)


def _pattern(points: int, text: str) -> str:
    text = text.upper()
    words = [w for w in PATTERN_WORDS if w in text][:3]
    return "|".join([f"SHOT:{points}PT"] * (points > 0) + ["DESC:" + "-".join(words)] * bool(words)) or "GENERIC_PLAY"


def _contradicts(quarter: int, points: int, text: str, player: str, court: list[str]) -> bool:
    """Whether a description contradicts the other fields of its play, as ``rules.contradiction``."""
    text = text.upper()
    says = lambda *words: any(w in text for w in words)
    return bool(text) and (
        (points == 3 and not says("3", "THREE", "POINTER") and says("SHOT", "MAKE", "SCORE"))
        or (points == 2 and says("3") and says("THREE", "POINTER"))
        or (points == 1 and not says("FOUL", "FREE", "TECHNICAL"))
        or (bool(player) and bool(court) and player not in court and player.upper() not in text)
        or (says("SUB") and not any(c.isalpha() for c in text.replace("SUB", "")))
        or (quarter == 4 and not says("FOURTH", "4TH") and says("FIRST", "1ST"))
    )


def _misreports(text: str, rose: bool) -> bool:
    """Whether a description speaks of a score that did not rise, or is silent about one that did, as ``rules.scoring_words``."""
    text = text.upper()
    says = lambda *words: any(w in text for w in words)
    scores = says("SCORE", "MAKE", "BASKET", "SHOT", "POINT")
    return bool(text) and (not says("SUB", "TIMEOUT", "FOUL") and not scores if rose else scores and not says("MISS", "BLOCK", "REBOUND"))


def _odd_situation(quarter: int, seconds: int, gap: int, points: int, text: str) -> bool:
    text, late, last = text.upper(), seconds < 120, seconds < 30 and gap <= 3
    return (
        ("TIMEOUT" in text and gap > 20 and not late)
        or ("FOUL" in text and "INTENTIONAL" in text and quarter < 4 and not late and gap > 15)
        or (last and gap > 1 and ("SLOW" in text or "DELIBERATE" in text))
        or (points == 1 and not ("FOUL" in text or "FREE" in text))
        or (last and "SUB" in text)
    )


def _quarter_end(s: State, quarter: int, seconds: int, text: str, lim: Limits) -> str | None:
    """Why a quarter before the fourth ends here, or None."""
    if seconds != 0 or not 0 < quarter < 4:
        return None
    zero = [c[3] for c in s.context if c[2] == 0]
    if "period" in text.lower() or any("period" in t.lower() for t in zero):
        return "end of period"
    if lim.fast:
        return "administrative plays" if sum(_has(t, ADMIN_WORDS) for t in zero[-8:]) >= 2 and (s.same_clock >= 4 or len(zero) >= 4) else None
    recent = [c[3] for c in s.context[-6:] if c[2] == 0]
    admin = ("substitution", "timeout", "unknown", "end of", "technical")
    if s.same_clock >= lim.admin_at and _has(text, admin) and 1 + sum(_has(t, admin) for t in recent[-5:]) >= 3:
        return "administrative plays"
    if s.same_clock >= lim.substitutions_at and sum("sub" in t.lower() for t in [*recent, text]) >= 3:
        return "substitutions"
    return "clock stands at the end" if s.same_clock >= lim.stall_at else None


def step(s: State, seq: int, quarter: int, seconds: int, away: int, home: int, points: int, text: str, lim: Limits, shooter: str | None = None, player: str | None = None, court: list[str] | None = None) -> Verdict:
    """The verdict on one play; ``s`` is updated in place.  ``shooter`` is A or H, ``court`` the names on it."""
    if s.last_seq is not None and seq <= s.last_seq:
        return Verdict("LATE", "behind a play that was judged already")
    s.last_seq = seq
    if s.ended:
        return Verdict("END_GAME", "after the end")
    first = s.plays == 0
    same_quarter = not first and quarter == s.quarter
    s.same_clock = s.same_clock + 1 if same_quarter and seconds == s.seconds else 0
    if s.same_clock == 1:  # the context up to the last play with another clock
        s.snapshot = [c for c in s.context if (c[1], c[2]) != (quarter, seconds)]
    s.low_clock = s.low_clock + 1 if quarter == 4 and seconds < lim.low_clock else 0
    recent = [c[3] for c in s.context[-lim.look_back :]]
    s.same_text = s.same_text + 1 if recent and text == recent[-1] else 0
    for t in {text, *recent} - s.words.keys():
        s.words[t] = frozenset(_plain(t).split())
    s.similar_strikes += sum(text != r and _overlap(s.words[text], s.words[r]) > lim.similar for r in recent) >= lim.similar_plays
    if len(s.words) > 10 * lim.look_back:
        s.words = {t: s.words[t] for t in (text, *recent)}
    s.substitutions = s.substitutions + 1 if "SUB" in text.upper() else 0
    pattern = _pattern(points, text)
    s.patterns[pattern] = s.patterns.get(pattern, 0) + 1
    if len(s.patterns) > lim.patterns_held:
        s.patterns = {k: n for k, n in s.patterns.items() if n > 1}
    drop = 0 if first else max(s.away - away, s.home - home)
    jump = 0 if first else max(away - s.away, home - s.home)
    ahead = 0 if first else quarter - s.quarter
    s.clock_strikes = (s.clock_strikes if same_quarter else 0) + (same_quarter and seconds - s.seconds > lim.clock_forward)
    s.score_strikes += 0 if first else (s.away > away) + (s.home > home)
    full, tolerance = (720, 300) if quarter <= 4 else (300, 180)
    s.quarter_strikes += ahead == 1 and abs(seconds - full) > tolerance
    s.situation_strikes += _odd_situation(quarter, seconds, abs(away - home), points, text)
    s.text_strikes += _contradicts(quarter, points, text, player or "", court or []) or (not first and _misreports(text, jump > 0))
    gain = {"A": away - s.away, "H": home - s.home}.get(shooter)
    off_shot = not first and points > 0 and gain is not None and abs(gain - points) > lim.shot_gap
    odd = same_quarter and s.seconds >= 0 and seconds - s.seconds > lim.max_clock_jump or len(set(court or [])) < len(court or [])

    out = Verdict()
    ending = _quarter_end(s, quarter, seconds, text, lim)
    if quarter >= 4 and seconds == 0 and away != home or lim.fast and quarter == 4 and seconds == 0:
        out, s.ended = Verdict("END_GAME", "time expired", "quarter_4_time_expired"), True
    elif s.low_clock >= lim.low_clock_plays and not lim.fast:
        out, s.ended = Verdict("END_GAME", "clock runs out", "low_clock", s.low_clock), True
    elif ending:
        out = Verdict("QUARTER_TRANSITION", ending, "end_of_quarter", s.same_clock, next_quarter=quarter + 1)
    elif s.same_clock >= (lim.fast_same_clock if lim.fast else lim.same_clock):
        held = s.snapshot or []
        out = Verdict("ROLLBACK_TIME", f"clock stuck, back to {held[-1][0] if held else -1}", "same_clock", s.same_clock, [c[0] for c in held])
    elif not lim.fast:
        out = _retry(s, out, drop, jump, ahead, points, max(away, home), pattern, off_shot, odd, lim)
    if out.trigger != "score":
        s.away, s.home = away, home
    s.quarter, s.seconds, s.plays = quarter, seconds, s.plays + 1
    s.context = [*s.context, [seq, quarter, seconds, text]][-lim.context :]
    if out.verdict == "ROLLBACK_TIME":
        s.context, s.snapshot = s.snapshot or [], None
    if out.verdict in ("ROLLBACK_TIME", "QUARTER_TRANSITION"):
        s.same_clock, s.seconds = 0, -1
    return out


def _retry(s: State, out: Verdict, drop: int, jump: int, ahead: int, points: int, top: int, pattern: str, off_shot: bool, odd: bool, lim: Limits) -> Verdict:
    """The checks that ask for another play, in order; the counter of the one that fires starts again."""
    again = lambda reason, trigger, n=None: Verdict("RETRY", reason, trigger, n)
    if s.same_text >= lim.same_text:
        out, s.same_text = again("repeated response", "same_text", s.same_text), 0
    elif s.similar_strikes >= lim.similar_strikes:
        out, s.similar_strikes = again("near-duplicate responses", "similar", s.similar_strikes), 0
    elif s.patterns.get(pattern, 0) >= lim.pattern:
        out, s.patterns[pattern] = again(f"pattern repeated: {pattern}", "pattern", lim.pattern), 0
    elif s.substitutions >= lim.substitutions:
        out, s.substitutions = again("too many substitutions", "substitutions", s.substitutions), 0
    elif s.clock_strikes >= lim.clock_strikes:
        out, s.clock_strikes = again("clock runs forward", "clock", s.clock_strikes), 0
    elif drop > lim.score_drop or s.score_strikes >= lim.score_strikes:
        out, s.score_strikes = again("score falls", "score", s.score_strikes), 0
    elif off_shot:
        out = again("score and shot disagree", "shot")
    elif points > lim.max_points or jump > lim.max_jump or top > lim.max_score or ahead > lim.max_quarter_jump or odd:
        out = again("impossible figures", "impossible")
    elif ahead > lim.quarter_skip:
        out = again("quarters skipped", "quarter_skip")
    elif s.quarter_strikes >= lim.quarter_strikes:
        out, s.quarter_strikes = again("quarters begin far from their full clock", "quarter", s.quarter_strikes), 0
    elif s.situation_strikes >= lim.situation_strikes:
        out, s.situation_strikes = again("plays do not fit the situation", "situation", s.situation_strikes), 0
    elif s.text_strikes >= lim.text_strikes:
        out, s.text_strikes = again("text contradicts the play", "text", s.text_strikes), 0
    return out


#: What a play is judged by, and what is said of it besides its run.
PLAYED = ("seq", "quarter", "seconds", "away", "home", "points", "description", "shooter", "player", "court")
JUDGED = ("seq", "verdict", "reason", "trigger", "consecutive", "attempts", "restored", "next_quarter")


def judged(plays: Iterable[Sequence], s: State, lim: Limits) -> list[tuple]:
    """``JUDGED`` of each play, in the order given."""
    got = []
    for seq, quarter, seconds, away, home, points, text, shooter, player, court in plays:
        v = step(s, int(seq), int(quarter), int(seconds), int(away), int(home), int(points), text or "", lim, shooter, player, None if court is None else list(court))
        got.append((seq, v.verdict, v.reason, v.trigger, v.consecutive, s.plays, v.restored, v.next_quarter))
    return got


def _fold(rows: pd.DataFrame, s: State, lim: Limits) -> pd.DataFrame:
    rows = rows.sort_values("seq", kind="stable")
    plays = zip(*[rows[c].tolist() if c in rows else [None] * len(rows) for c in PLAYED])
    out = pd.DataFrame(judged(plays, s, lim), columns=JUDGED).astype({"consecutive": "Int32", "next_quarter": "Int32"})
    out.insert(0, "run_id", rows["run_id"].tolist())
    return out


def validate(plays: DataFrame, lim: Limits | None = None) -> DataFrame:
    """Verdicts on all plays of all runs, in batch; plays as in ``IN``, and shooter, player and court where there are any."""
    return fold.verdicts(plays, lim or Limits())


def validate_stream(plays: DataFrame, lim: Limits | None = None, idle: str | None = None) -> DataFrame:
    """The same over a stream, as ``playmill.streaming.stateful`` keeps its state."""
    from playmill.streaming import stateful  # it builds on this module

    return stateful.validate_stream(plays, lim, idle)


def with_records(verdicts: DataFrame, plays: DataFrame) -> DataFrame:
    """Terminal verdicts as records for storage: type, reason, trigger, counts and the state of the game."""
    kinds = {"END_GAME": "game_ended", "ROLLBACK_TIME": "rollback_time", "QUARTER_TRANSITION": "quarter_transition"}
    kind = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])[F.col("verdict")]
    ended = verdicts.where(F.col("verdict").isin(*kinds) & F.col("trigger").isNotNull())
    state = plays.select("run_id", "seq", "quarter", "seconds", "away", "home", F.substring("description", 1, 100).alias("description"))
    return ended.join(state, ["run_id", "seq"]).select("run_id", "seq", kind.alias("type"), "reason", "trigger", "consecutive", "attempts", "quarter", "seconds", "away", "home", "description", F.size("restored").alias("restored"))
