"""The validator's counters as window expressions: what needs no restart of state runs in the JVM, one sort a run.

Each function adds a column to rows with a run key and an order.  ``strikes`` is the common automaton: flagged rows are
counted, and every ``limit``-th of them fires and starts the count again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words of administrative plays, and of plays that name a pattern.
ADMIN_WORDS = ("sub", "substitution", "timeout", "jump", "technical", "unknown")
PATTERN_WORDS = ("MAKE", "MISS", "FOUL", "SUB", "TIMEOUT", "REBOUND", "STEAL", "TURNOVER", "ASSIST")
#: How many plays a run's context holds.
CONTEXT = 20


def _run(keys: list[str], order: str):
    return Window.partitionBy(*keys).orderBy(order)


def _any_word(text: Column, words: tuple[str, ...]) -> Column:
    return F.coalesce(text.rlike("|".join(words)), F.lit(False))


def strikes(flag: Column, limit: int, keys: list[str], order: str) -> Column:
    """Whether a flagged row is the ``limit``-th since the last one that fired."""
    flag = F.coalesce(flag, F.lit(False))
    return flag & (F.sum(flag.cast("int")).over(_run(keys, order)) % limit == 0)


def clock_strikes(df: DataFrame, keys: list[str], order: str, quarter: str, seconds: str, forward: int = 10, limit: int = 5) -> DataFrame:
    """``fired``: the clock ran forward for the ``limit``-th time; a new quarter starts the count again."""
    w = _run(keys, order)
    changed = F.coalesce(F.col(quarter) != F.lag(quarter).over(w), F.lit(True))
    parted = df.withColumn("__part", F.sum(changed.cast("int")).over(w))
    ahead = ~changed & (F.col(seconds) - F.lag(seconds).over(w) > forward)
    return parted.withColumn("__ahead", ahead).withColumn("fired", strikes(F.col("__ahead"), limit, [*keys, "__part"], order)).drop("__part", "__ahead")


def score_strikes(df: DataFrame, keys: list[str], order: str, away: str, home: str, drop: int = 3, limit: int = 5) -> DataFrame:
    """``fired``: a score fell by more than ``drop``, or fell for the ``limit``-th time since it last fired."""
    w = _run(keys, order)
    fall = F.greatest(*[F.lag(c).over(w) - F.col(c) for c in (away, home)])
    # large falls fire at once and start the count again, so small ones are counted between them
    marked = df.withColumn("__fall", F.coalesce(fall, F.lit(0))).withColumn("__part", F.coalesce(F.sum((F.col("__fall") > drop).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    small = strikes((F.col("__fall") > 0) & (F.col("__fall") <= drop), limit, [*keys, "__part"], order)
    return marked.withColumn("fired", (F.col("__fall") > drop) | small).drop("__fall", "__part")


def quarter_resets(df: DataFrame, keys: list[str], order: str, quarter: str, seconds: str, limit: int = 5) -> DataFrame:
    """``fired``: more than two quarters were skipped, or for the ``limit``-th time a quarter began far from its full clock.

    Fixed values: 720 seconds within 300 for quarters one to four, 300 within 180 for overtime.
    """
    w = _run(keys, order)
    ahead = F.col(quarter) - F.lag(quarter).over(w)
    off = F.when(F.col(quarter) <= 4, F.abs(F.col(seconds) - 720) > 300).otherwise(F.abs(F.col(seconds) - 300) > 180)
    marked = df.withColumn("__off", (ahead == 1) & off).withColumn("__skip", F.coalesce(ahead > 2, F.lit(False)))
    return marked.withColumn("fired", F.col("__skip") | strikes(F.col("__off"), limit, keys, order)).drop("__off", "__skip")


def odd_situation(description: Column, quarter: Column, seconds: Column, away: Column, home: Column, points: Column) -> Column:
    """Whether a play makes no sense at that score and clock.

    Fixed values: a blowout is more than 20 points, final minutes are under 120 seconds, final seconds under 30, very
    close is 3 points or less.
    """
    gap, text = F.abs(away - home), F.upper(F.coalesce(description, F.lit("")))
    late, last = seconds < 120, (seconds < 30) & (gap <= 3)
    return (
        (text.contains("TIMEOUT") & (gap > 20) & ~late)
        | (text.contains("FOUL") & text.contains("INTENTIONAL") & (quarter < 4) & ~late & (gap > 15))
        | (last & (text.contains("SLOW") | text.contains("DELIBERATE")) & (gap > 1))
        | ((points == 1) & ~(text.contains("FOUL") | text.contains("FREE")))
        | (text.contains("SUB") & last)
    )


def _says(text: Column, *words: str) -> Column:
    """Whether a text in capitals holds one of the words."""
    return F.coalesce(text.rlike("|".join(words)), F.lit(False))


def contradiction(text: Column, points: Column, quarter: Column, player: Column, court: Column) -> Column:
    """Whether a description in capitals contradicts the other fields of its play; an empty one contradicts nothing.

    Fixed values: the words that speak of threes, fouls, shots, substitutions and quarters.
    """
    kinds = [
        (points == 3) & ~_says(text, "3", "THREE", "POINTER") & _says(text, "SHOT", "MAKE", "SCORE"),
        (points == 2) & _says(text, "3") & _says(text, "THREE", "POINTER"),
        (points == 1) & ~_says(text, "FOUL", "FREE", "TECHNICAL"),
        (player != "") & (F.size(court) > 0) & ~F.array_contains(court, player) & ~F.contains(text, F.upper(player)),
        _says(text, "SUB") & ~F.replace(text, F.lit("SUB"), F.lit("")).rlike(r"\p{L}"),
        (quarter == 4) & ~_says(text, "FOURTH", "4TH") & _says(text, "FIRST", "1ST"),
    ]
    found = F.coalesce(kinds[0], F.lit(False))
    for k in kinds[1:]:
        found = found | F.coalesce(k, F.lit(False))
    return (text != "") & found


def scoring_words(text: Column) -> Column:
    """(claims, mute): a description in capitals that needs a score to have risen, and one that must not go with a rise.

    Fixed values: the words of scoring, of misses, and of plays beside which a score may rise.
    """
    says = _says(text, "SCORE", "MAKE", "BASKET", "SHOT", "POINT")
    return F.struct((says & ~_says(text, "MISS", "BLOCK", "REBOUND")).alias("claims"), ((text != "") & ~says & ~_says(text, "SUB", "TIMEOUT", "FOUL")).alias("mute"))


def stuck_clock(df: DataFrame, keys: list[str], order: str, clock: list[str], limit: int = 8, kept: int = CONTEXT - 1) -> DataFrame:
    """``same`` (rows before in a row with this clock), ``fired`` (at every ``limit``-th) and ``restored``.

    ``restored`` holds the order keys of the plays a run goes back to where it fired: the last ``kept`` ones before the
    clock stood still.
    """
    w = _run(keys, order)
    moved = F.coalesce(F.reduce(F.array(*[F.col(c) != F.lag(c).over(w) for c in clock]), F.lit(False), lambda a, b: a | b), F.lit(True))
    parted = df.withColumn("__part", F.sum(moved.cast("int")).over(w))
    same = parted.withColumn("same", F.row_number().over(_run([*keys, "__part"], order)) - 1)
    fired = same.withColumn("fired", (F.col("same") > 0) & (F.col("same") % limit == 0))
    # what stood before the first of the equal ones, carried along
    before = fired.withColumn("__before", F.collect_list(order).over(w.rowsBetween(-kept, -1)))
    restored = F.when(F.col("fired"), F.first("__before").over(_run([*keys, "__part"], order)))
    return before.withColumn("restored", restored).drop("__part", "__before")


def fast_verdicts(df: DataFrame, keys: list[str], order: str, quarter: str, seconds: str, description: str, stuck: int = 5) -> DataFrame:
    """``verdict`` of the fast mode: end of game, end of quarter, stuck clock, else valid.

    At 0 seconds of quarters one to three a quarter ends if this play or one at 0 seconds among the last ``CONTEXT``
    names a period, or if at least two of the last eight of those are administrative and there are four or more (or the
    clock has stood for four).
    """
    w = _run(keys, order)
    text = F.lower(F.coalesce(F.col(description), F.lit("")))
    zero = F.col(seconds) == 0
    rows = df.withColumn("__zero", F.when(zero, F.struct(text.contains("period").alias("period"), _any_word(text, ADMIN_WORDS).alias("admin"))))
    moved = F.coalesce(F.col(seconds) != F.lag(seconds).over(w), F.lit(True))
    rows = rows.withColumn("__part", F.sum(moved.cast("int")).over(w)).withColumn("__ago", F.collect_list("__zero").over(w.rowsBetween(-CONTEXT, -1)))
    rows = rows.withColumn("__same", F.row_number().over(_run([*keys, "__part"], order)) - 1)
    ago = F.col("__ago")
    admin = F.size(F.filter(F.slice(ago, F.greatest(F.size(ago) - 7, F.lit(1)), 8), lambda p: p["admin"]))
    ends = text.contains("period") | F.exists(ago, lambda p: p["period"]) | ((admin >= 2) & ((F.size(ago) >= 4) | (F.col("__same") >= 4)))
    verdict = F.when(zero & (F.col(quarter) == 4), "END_GAME").when(zero & (F.col(quarter) < 4) & ends, "QUARTER_TRANSITION").when(F.col("__same") >= stuck, "ROLLBACK_TIME").otherwise("VALID")
    return rows.withColumn("verdict", verdict).drop("__zero", "__part", "__ago", "__same")


def play_pattern(player: Column, points: Column, description: Column) -> Column:
    """The signature of a play: player, points and up to three key words, else GENERIC_PLAY."""
    text = F.upper(F.coalesce(description, F.lit("")))
    words = F.slice(F.filter(F.array(*[F.lit(w) for w in PATTERN_WORDS]), lambda w: F.contains(text, w)), 1, 3)
    parts = F.concat_ws(
        "|",
        F.when(F.coalesce(player, F.lit("")) != "", F.concat(F.lit("PLAYER:"), F.substring(player, 1, 10))),
        F.when(points > 0, F.concat(F.lit("SHOT:"), points.cast("string"), F.lit("PT"))),
        F.when(F.size(words) > 0, F.concat(F.lit("DESC:"), F.array_join(words, "-"))),
    )
    return F.when(parts == "", "GENERIC_PLAY").otherwise(parts)


def pattern_strikes(df: DataFrame, keys: list[str], order: str, pattern: Column, limit: int = 12) -> DataFrame:
    """``pattern`` and ``fired``: one signature for the ``limit``-th time in a run."""
    marked = df.withColumn("pattern", pattern)
    return marked.withColumn("fired", F.row_number().over(_run([*keys, "pattern"], order)) % limit == 0)


def termination_record(verdicts: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first terminal verdict of each run with the state it was given in; runs without one are left out."""
    kinds = F.when(F.col("verdict") == "END_GAME", "game_ended").when(F.col("verdict") == "ROLLBACK_TIME", "rollback_time").when(F.col("verdict") == "QUARTER_TRANSITION", "quarter_transition")
    ended = verdicts.withColumn("type", kinds).where("type is not null")
    state = F.min_by(F.struct("type", "quarter", "seconds", "away", "home", F.substring("description", 1, 100).alias("description")), order)
    total = F.count(F.lit(1)).alias("terminations")
    return ended.groupBy(*keys).agg(state.alias("s"), F.min(order).alias("at"), total).select(*keys, "at", "s.*", "terminations")
