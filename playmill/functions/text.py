"""String functions: scores, descriptions, event codes and identifiers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INTEGER = r"^[+-]?\d+$"


def whole(text: Column) -> Column:
    """The integer a text holds, else null (a decimal point is not an integer)."""
    return F.when(text.rlike(INTEGER), text.try_cast("int"))


def score_sides(text: Column) -> tuple[Column, Column]:
    """Away and home of ``X a - Y b``: the integer at the end of each side, null where it has none or the sides are not two."""
    cut = " - "
    two = F.length(text) - F.length(F.replace(text, F.lit(cut), F.lit(""))) == len(cut)
    last = lambda count: F.regexp_extract(F.substring_index(text, cut, count), r"(?:^|\s)([+-]?\d+) *\z", 1).try_cast("int")
    return F.when(two, last(1)), F.when(two, last(-1))


def score_pair(text: Column) -> Column:
    """``X a - Y b`` as struct(away, home), null where either side has no integer at its end."""
    away, home = score_sides(text)
    return F.when(away.isNotNull() & home.isNotNull(), F.struct(away.alias("away"), home.alias("home")))


def without_parentheses(text: Column) -> Column:
    """Parenthesised parts removed, white space squeezed and trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\([^)]*\)", ""), r"\s+", " "))


def distance(text: Column) -> Column:
    """The digits before the first foot mark, else null."""
    return F.nullif(F.regexp_extract(text, r"(\d+)'", 1), F.lit(""))


def score_text(away: Column, home: Column, away_team: Column, home_team: Column) -> Column:
    """``AWY 18 - HOM 11``."""
    return F.format_string("%s %d - %s %d", away_team, away, home_team, home)


def normalized(text: Column) -> Column:
    """Upper case with times, scores and numbers replaced by their kind."""
    out = F.upper(text)
    for pattern, kind in ((r"\d{1,2}:\d{2}", "TIME"), (r"[A-Z]{2,4} \d+ - [A-Z]{2,4} \d+", "SCORE"), (r"\d+", "NUM"), (r"\s+", " ")):
        out = F.regexp_replace(out, pattern, kind)
    return F.trim(out)


def word_overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of the word sets of two texts, 0 where both are empty."""
    x, y = (F.array_distinct(F.filter(F.split(F.lower(t), r"\s+"), lambda w: w != "")) for t in (a, b))
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / union)


def enriched(description: Column, same_team: Column, opponent: Column) -> Column:
    """Rebounds named by kind, and fouls with the team they were committed on."""
    rebound = F.regexp_replace(description, r"(?i)\bREBOUND\b", F.when(same_team, "OFF.REBOUND").otherwise("DEF.REBOUND"))
    return F.when(F.upper(description).contains("REBOUND"), F.upper(rebound)).when(F.upper(description).contains("FOUL"), F.concat(description, F.lit(" on "), opponent)).otherwise(description)


# Shot kinds of structured plays in order of precedence: words, code if made, code if missed, points.
SHOTS = [
    (("3pt", "three"), "3pm", "3pa", 3),
    (("layup",), "layup", "layupa", 2),
    (("dunk",), "dunk", "dunka", 2),
    (("hook",), "hook", "hooka", 2),
    (("jump shot", "jumper", "fadeaway", "floating"), "2pm", "2pa", 2),
]
# Other plays in order of precedence: event type, words of the play type, then (words, code) of its kinds; no words: the rest.
OTHERS = [
    ("rebound", ("rebound",), [(("offensive",), "o_reb"), ((), "d_reb")]),
    ("foul", ("foul", "personal", "shooting", "offensive"), [(("offensive", "charge"), "o_foul"), (("shooting", "flagrant"), "s_foul"), (("technical",), "tech"), ((), "p_foul")]),
    ("turnover", ("bad pass", "lost ball", "traveling", "backcourt"), [((), "tov")]),
    ("violation", ("shot clock", "kicked ball", "goaltending"), [((), "viol")]),
]
# Last resort by words of the play type.
ADMIN = [(("jump ball",), "jumpball"), (("timeout",), "timeout"), (("sub",), "sub"), (("start of period", "end of period"), "period")]


def _has(text: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | text.contains(w)
    return found


def structured_event(play_type: Column, result: Column, event_type: Column, points: Column, shot_distance: Column, steal: Column) -> Column:
    """struct(code, points) of a structured play, by the tables above; the first that fits wins."""
    kind, made, event = (F.trim(F.lower(F.coalesce(c, F.lit("")))) for c in (play_type, result, event_type))
    points = F.coalesce(points.cast("int"), F.lit(0))
    feet = F.when(shot_distance > 0, shot_distance.cast("int").cast("string")).otherwise("")
    code = lambda name, pts=None, suffix=None: F.struct((F.concat(F.lit(name), suffix) if suffix is not None else F.lit(name)).alias("code"), F.lit(pts).cast("int").alias("points"))
    shot, out = (event == "shot") | _has(kind, ("shot", "layup", "dunk")), None
    steps: list[tuple[Column, Column]] = []
    for words, yes, no, worth in SHOTS:
        fits = shot & _has(kind, words)
        steps += [(fits & ((made == "made") | (points == worth)), code(yes, worth, feet)), (fits, code(no, None, feet))]
    steps += [(shot & (points == 3), code("3pm", 3, feet)), (shot & (points == 2), code("2pm", 2, feet)), (shot & (points == 1), code("ftm", 1))]
    steps += [(shot & F.coalesce(shot_distance >= 23, F.lit(False)), code("3pa", None, feet)), (shot, code("2pa", None, feet))]
    throw = (event == "free throw") | kind.contains("free throw")
    steps += [(throw & ((made == "made") | (points == 1)), code("ftm", 1)), (throw, code("ftx"))]
    for name, words, kinds in OTHERS:
        fits = (event == name) | _has(kind, words)
        steps += [(fits & (_has(kind, own) if own else F.lit(True)), code(label)) for own, label in kinds]
    steps.append((F.coalesce(steal != "", F.lit(False)), code("stl")))
    steps += [(_has(kind, words), code(label)) for words, label in ADMIN]
    steps += [(points == 1, code("ftm", 1)), (points == 2, code("2pm", 2, feet)), (points == 3, code("3pm", 3, feet))]
    for test, value in steps:
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(code("unknown"))


# Shots in descriptions in order of precedence: words, words that exclude it, code if made, code if missed, points.
TEXT_SHOTS = [
    (("3PT",), (), "3pm", "3pa", 3),
    (("LAYUP",), (), "layup", "layupa", 2),
    (("DUNK",), ("TIP DUNK",), "dunk", "dunka", 2),
]
# Other events in descriptions in order of precedence.
TEXT_EVENTS = [
    (("DEF.REBOUND", "DEFENSIVE REBOUND"), "d_reb"),
    (("OFF.REBOUND", "OFFENSIVE REBOUND"), "o_reb"),
    (("STEAL",), "stl"),
    (("TURNOVER", "LOST BALL", "BAD PASS", "OUT OF BOUNDS", "TRAVEL", "DOUBLE DRIBBLE"), "tov"),
    (("OFFENSIVE FOUL", "O.FOUL"), "o_foul"),
    (("SHOOTING FOUL", "S.FOUL"), "s_foul"),
    (("PERSONAL FOUL", "P.FOUL"), "p_foul"),
    (("TIMEOUT",), "timeout"),
]


def described_event(description: Column, given_points: Column, score_delta: Column) -> Column:
    """struct(code, points) of a described play."""
    return worded_event(F.upper(description), F.coalesce(distance(description), F.lit("")), F.coalesce(given_points, F.greatest(score_delta, F.lit(0)), F.lit(0)))


def worded_event(d: Column, feet: Column, scored: Column) -> Column:
    """The same of the description in upper case, its distance or '', and the points scored; each is named many times, so bind them first where nothing else does."""
    points = lambda worth: F.when(scored > 0, scored).otherwise(F.lit(worth)).cast("int")
    none = F.lit(None).cast("int")
    value = lambda name, pts=none, suffix=None: F.struct((F.concat(F.lit(name), suffix) if suffix is not None else F.lit(name)).alias("code"), pts.alias("points"))
    miss, nothing = d.contains("MISS"), scored == 0
    steps = [(d.isNull(), value("unknown"))]
    for words, but, yes, no, worth in TEXT_SHOTS:
        fits = _has(d, words) & ~_has(d, but)
        steps += [(fits & miss, value(no, none, feet)), (fits, value(yes, points(worth), feet))]
    tip, jump, throw = d.contains("TIP DUNK"), _has(d, ("JUMP SHOT", "PULLUP", "BANK SHOT")), d.contains("FREE THROW")
    steps += [(tip & (miss | nothing), value("tipdunk_a")), (tip, value("tipdunk_m", points(2)))]
    steps += [(_has(d, ("PUTBACK", "PUT BACK")) & (scored > 0), value("putback2", scored.cast("int")))]
    steps += [(jump & miss, value("2pa", none, feet)), (jump, value("2pm", points(2), feet))]
    steps += [(throw & (miss | nothing), value("ftx")), (throw, value("ftm", F.lit(1)))]
    steps += [(_has(d, words), value(label)) for words, label in TEXT_EVENTS]
    out = None
    for test, v in steps:
        out = F.when(test, v) if out is None else out.when(test, v)
    return out.otherwise(value("unknown"))


def game_number(game_id: Column) -> Column:
    """struct(season_code, number) of an 8- or 10-character game id, else null."""
    short = F.when(F.length(game_id) == 10, F.substring(game_id, 3, 8)).when(F.length(game_id) == 8, game_id)
    return F.when(short.rlike(r"^\d{8}$"), F.struct(F.substring(short, 1, 3).alias("season_code"), F.substring(short, 4, 5).try_cast("int").alias("number")))


def preview(text: Column, n: int) -> Column:
    """The first n characters, with an ellipsis where more follow."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


# Layouts of a score text: two teams of 2 to 15 letters, each with its score.
SCORE_LAYOUTS = [
    r"^([A-Z]{2,15})\s*(\d+)\s*[-,]\s*([A-Z]{2,15})\s*(\d+)$",
    r"^([A-Z]{2,15}): (\d+) ([A-Z]{2,15}): (\d+)$",
    r"^([A-Z]{2,15}) (\d+) ([A-Z]{2,15}) (\d+)$",
]


def team_scores(score: Column) -> Column:
    """struct(first_team, first_score, second_team, second_score) of a score text in any layout, else null."""
    plain = F.trim(F.regexp_replace(F.upper(score), r"\s+", " "))
    found = F.lit(None)
    for layout in reversed(SCORE_LAYOUTS):
        part = lambda i, layout=layout: F.regexp_extract(plain, layout, i)
        made = F.struct(part(1).alias("first_team"), part(2).try_cast("int").alias("first_score"), part(3).alias("second_team"), part(4).try_cast("int").alias("second_score"))
        found = F.when(plain.rlike(layout), made).otherwise(found)
    return found


# Sentences of event codes: codes, words behind a name, text without one.
SENTENCES = [
    (("ftm",), "made free throw", "Free throw made"),
    (("fta",), "missed free throw", "Free throw missed"),
    (("d_reb", "d"), "defensive rebound", "Defensive rebound"),
    (("o_reb", "o"), "offensive rebound", "Offensive rebound"),
    (("tov", "t"), "turnover", "Turnover"),
    (("p_foul", "p"), "personal foul", "Personal foul"),
    (("s_foul",), "shooting foul", "Shooting foul"),
    (("t_foul",), "technical foul", "Technical foul"),
    (("steal", "s"), "steal", "Steal"),
    (("assist", "a"), "assist", "Assist"),
    (("block", "b"), "block", "Block"),
    (("flagrant", "f"), "flagrant foul", "Flagrant foul"),
]
# Events that name nobody, and shots by the beginning of their code: with a distance, and without one.
NAMELESS = [("sub", "Substitution"), ("jumpball", "Jump ball"), ("timeout", "Timeout")]
SHOT_SENTENCES = [("2p", "jumper", "2-point shot"), ("3p", "three-pointer", "Three-pointer")]


def play_sentence(code: Column, place: Column, name: Column) -> Column:
    """A play in words.  ``place`` is the actor's place in the roster, -1 for nobody; ``name`` their name or null.

    The last word of a name is used, and "Player" where it is not known.  A layup always reads as missed.
    """
    event = F.lower(code)
    last = F.element_at(F.split(F.trim(name), r"\s+"), -1)
    who = F.when(place != -1, F.when(F.coalesce(last, F.lit("")) == "", "Player").otherwise(last))
    named = lambda words, alone: F.when(who.isNull(), alone).otherwise(F.concat(who, F.lit(" "), words))
    steps: list[tuple[Column, Column]] = []
    for start, noun, bare in SHOT_SENTENCES:
        feet = F.regexp_extract(event, start + r"[ma](\d+)", 1)
        did = F.when(event.contains("m"), "made").otherwise("missed")
        far = F.concat(feet, F.lit(f"' {noun}"))
        steps.append((event.startswith(start) & (feet != ""), named(F.concat(did, F.lit(" "), far), F.concat(far, F.lit(" "), did))))
        steps.append((event.startswith(start), named(F.concat(did, F.lit(f" {noun}")), F.concat(F.lit(f"{bare} "), did))))
    steps.append((event.contains("layup"), named(F.lit("missed layup"), F.lit("Layup missed"))))
    steps.append((event.contains("dunk"), named(F.lit("dunked"), F.lit("Dunk"))))
    feet = F.regexp_extract(event, r"hook(\d+)", 1)
    tail = F.when(feet != "", F.concat(F.lit(" ("), feet, F.lit("')"))).otherwise("")
    steps.append((event.contains("hook"), named(F.concat(F.lit("hook shot"), tail), F.concat(F.lit("Hook shot"), tail))))
    steps += [(event.isin(*codes), named(F.lit(words), F.lit(alone))) for codes, words, alone in SENTENCES]
    steps += [(event == c, F.lit(alone)) for c, alone in NAMELESS]
    out = None
    for test, value in steps:
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(named(code, code))
