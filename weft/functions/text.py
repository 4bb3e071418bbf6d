"""Text columns of records: representations, prompt details, prompts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Wording that prompts and listings must have: fixed values.
NO_TITLE, NO_AUTHOR, NO_PUBLISHER, NO_DATE = "タイトル不明", "著者不明", "出版社不明", "出版日不明"
SYSTEM_PROMPT = (
    "あなたは2つの書誌情報が実質的に同一の文献を指すかどうかを判断する専門家です。\n"
    "まず、2つの書誌情報が同一の文献と思われる場合は「はい」、そうでない場合は「いいえ」で明確に回答してください。\n"
    "次に、その判断の確信度を示す類似度スコアを0.0（全く異なる）から1.0（完全に同一）の範囲で提示してください。"
)
ASK = "以下の2つの書誌情報が、実質的に同一の文献を指しているかどうかを判断してください。"
ASK_SHORT = "可能な限り「はい」または「いいえ」で明確に回答し、必要であれば簡潔な理由を続けてください。"
ANSWER = "これらは同一の文献ですか？\n回答:"


def strip(c: Column) -> Column:
    """White space of any script off both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def text_representation(fields: Sequence[Column]) -> Column:
    """Non-empty fields, stripped and joined by a space; a field of white space leaves an empty token."""
    return F.concat_ws(" ", *[F.when(f != "", strip(f)) for f in fields])


def record_text(fields: Sequence[Column]) -> Column:
    """Non-blank fields, stripped and joined by a space, or null if there is none."""
    some = [F.nullif(strip(f), F.lit("")) for f in fields]
    return F.nullif(F.concat_ws(" ", *some), F.lit(""))


def list_text(items: Column) -> Column:
    """The non-blank items of an array, joined by ", "; null if there is none."""
    kept = F.filter(F.transform(items, strip), lambda x: x.isNotNull() & (x != ""))
    return F.nullif(F.array_join(kept, ", "), F.lit(""))


def _details(title: Column, author: Column, publisher: Column, date: Column) -> Column:
    return F.format_string("タイトル: %s\n著者: %s\n出版社: %s\n出版日: %s", title, author, publisher, date)


def prompt_details(title: Column, author: Column, publisher: Column, date: Column, record_id: Column | None = None, found: Column | None = None) -> Column:
    """A record's block in a prompt; a default stands for a missing field (null), not for an empty one.
    With ``found`` false the block says that the record isn't known."""
    text = _details(F.coalesce(title, F.lit(NO_TITLE)), F.coalesce(author, F.lit(NO_AUTHOR)), F.coalesce(publisher, F.lit(NO_PUBLISHER)), F.coalesce(date, F.lit(NO_DATE)))
    if found is None:
        return text
    return F.when(found, text).otherwise(F.format_string("レコードID %s の書誌情報なし", record_id.cast("string")))


def prompt_details_any(title: Column, bib_title: Column, authors: Column, publisher: Column, bib_publisher: Column, date: Column, bib_date: Column) -> Column:
    """The same over generic names first and prefixed ones second; ``authors`` is an array, whose emptiness
    also gets the default."""
    author = F.coalesce(F.nullif(F.array_join(authors, ", "), F.lit("")), F.lit(NO_AUTHOR))
    return _details(F.coalesce(title, bib_title, F.lit(NO_TITLE)), author, F.coalesce(publisher, bib_publisher, F.lit(NO_PUBLISHER)), F.coalesce(date, bib_date, F.lit(NO_DATE)))


def listing_details(title: Column, authors: Column, publisher: Column, date: Column) -> Column:
    """A record's line in a cluster listing; missing parts read N/A, authors are joined by "/"."""
    na = F.lit("N/A")
    return _details(F.coalesce(title, na), F.coalesce(F.nullif(F.array_join(authors, "/"), F.lit("")), na), F.coalesce(publisher, na), F.coalesce(date, na))


def pair_prompt(details_1: Column, details_2: Column, short_answer: bool = False) -> Column:
    """The question about two records; ``short_answer`` asks for yes or no and a reason only."""
    ask = f"{ASK}\n{ASK_SHORT}" if short_answer else ASK
    gap = "\n\n"
    return F.concat(F.lit(f"{ask}{gap}書誌情報1:\n"), details_1, F.lit(f"{gap}書誌情報2:\n"), details_2, F.lit(f"{gap}{ANSWER}"))


def file_safe_model(name: Column) -> Column:
    """A model's name for use in a file name."""
    safe = F.replace(F.replace(name, F.lit(":"), F.lit("_")), F.lit("/"), F.lit("-"))
    return F.when(F.coalesce(name, F.lit("")) == "", F.lit("unknown_model")).otherwise(safe)
