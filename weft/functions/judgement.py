"""Parsing of a pair judge's answers and coercion of score and truth columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weft.functions.text import strip

# Words of the answers: fixed values.
YES, NO, UNKNOWN = "はい", "いいえ", "不明"
SCORE_KEY, REASON_KEY = "類似度スコア:", "理由:"
SCORE_PATTERN = r"類似度スコア:\s*([0-9.]+)"
NO_JUDGEMENT = "LLMの応答から判定（はい/いいえ）を抽出できませんでした。応答: "


def _only(text: Column, yes, no) -> Column:
    """``yes`` or ``no`` if the text has just one of the two words."""
    has_yes, has_no = text.contains(YES), text.contains(NO)
    return F.when(has_yes & ~has_no, yes).when(has_no & ~has_yes, no)


def parse_judgement(answer: Column) -> Column:
    """struct(judgement, score, reason) of an answer.

    The judgement is the first line without a final full stop, if that is one of the two words; else the
    only one of them in the answer; else UNKNOWN.  The score is that of the first line with the score key and
    a number.  The reason starts at the first line with the reason key after the score (or the judgement), or,
    where there is no score, at the line after the judgement; it runs to the end.
    """
    text = F.coalesce(answer, F.lit(""))
    lines = F.transform(F.split(strip(text), "\n"), strip)
    first = F.rtrim(lines[0], F.lit(".。"))
    said = F.when(first.isin(YES, NO), first)
    scores = F.transform(lines, lambda x: F.regexp_extract(x, SCORE_PATTERN, 1).try_cast("double"))
    at = F.coalesce(F.array_position(F.transform(scores, lambda s: s.isNotNull()), True), F.lit(0)).cast("int")
    score = F.when(at > 0, F.try_element_at(scores, F.greatest(at, F.lit(1))))
    start = F.when(at > 0, at + 1).when(said.isNotNull(), 2).otherwise(1).cast("int")
    rest = F.slice(lines, start, F.size(lines) + 1)
    keyed = F.coalesce(F.array_position(F.transform(rest, lambda x: x.startswith(REASON_KEY)), True), F.lit(0)).cast("int")
    free = (at == 0) & said.isNotNull() & (F.size(rest) > 0) & ~F.coalesce(F.try_element_at(rest, F.lit(1)), F.lit("")).startswith(REASON_KEY[:-1] + ":") & ~F.coalesce(F.try_element_at(rest, F.lit(1)), F.lit("")).startswith(SCORE_KEY[:-1])
    cut = F.slice(rest, F.greatest(keyed, F.lit(1)), F.size(lines) + 1)
    after_key = F.regexp_replace(F.array_join(cut, "\n"), f"^{REASON_KEY}", "")
    reason = strip(F.when(free, F.array_join(rest, "\n")).when(keyed > 0, after_key).otherwise(""))
    judgement = F.coalesce(said, _only(text, F.lit(YES), F.lit(NO)), F.lit(UNKNOWN))
    return F.struct(judgement.alias("judgement"), score.alias("score"), reason.alias("reason"))


def parse_verdict(answer: Column, strip_dot: bool = False) -> Column:
    """struct(is_similar, score, error): the first line's word, else the only one in the answer; the score
    after its key.  A missing judgement follows from a score of 0.5 or more, a missing score is 1 or 0 by the
    judgement, and without both there is an error.  Scores out of range stand."""
    text = F.coalesce(answer, F.lit(""))
    lines = F.split(text, "\n")
    first = F.lower(strip(lines[0]))
    said = F.coalesce(F.when(first.contains(YES), True).when(first.contains(NO), False), _only(text, F.lit(True), F.lit(False)))
    line = F.try_element_at(F.filter(lines, lambda x: x.contains(SCORE_KEY)), F.lit(1))
    number = strip(F.substring_index(line, SCORE_KEY, -1))
    score = (F.rtrim(number, F.lit(".")) if strip_dot else number).try_cast("double")
    similar = F.coalesce(said, score >= 0.5)
    full = F.coalesce(score, F.when(similar, 1.0).when(~similar, 0.0))
    error = F.when(similar.isNull(), F.concat(F.lit(NO_JUDGEMENT), text))
    return F.struct(similar.alias("is_similar"), full.alias("score"), error.alias("error"))


def score_or_zero(c: Column) -> Column:
    """A number, or 0 for anything else."""
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


def score_or_skip(c: Column, markers: tuple[str, ...] = ("", "none", "n/a")) -> Column:
    """0 for null and the ``markers``; null, for the caller to drop, where it is no number."""
    return F.when(c.isNull() | F.lower(F.trim(c)).isin(*markers), 0.0).otherwise(c.try_cast("double"))


def truth(c: Column) -> Column:
    """true/false/1/0 in any case; anything else, null too, counts as true."""
    word = F.lower(c.cast("string"))
    return F.when(word.isin("false", "0"), False).otherwise(True)


def by_threshold(score: Column, least: float = 0.5) -> Column:
    return score >= least
