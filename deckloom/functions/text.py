"""Text expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters, digits and underscore of all scripts, as both Java and RE2 know them.
WORD = r"[\p{L}\p{N}_]"
SPOKEN_WORD = rf"{WORD}+(?:[-’']{WORD}+)*"


def spoken_words(c: Column) -> Column:
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(SPOKEN_WORD)).cast("long")


def words(c: Column) -> Column:
    """Words between white space."""
    t = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " "))


def word_count(c: Column) -> Column:
    """How many ``words`` a text has."""
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(r"\S+")).cast("long")


def squeezed(c: Column) -> Column:
    """Without control characters that XML forbids, white space as one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", ""), r"\s+", " "))


def slug(c: Column, limit: int = 40) -> Column:
    t = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "-")
    t = F.substring(F.regexp_replace(t, r"^-+|-+$", ""), 1, limit)
    return F.coalesce(F.nullif(t, F.lit("")), F.lit("section"))


def stems(c: Column) -> Column:
    """Distinct beginnings of five letters of words of four or more, and all digit groups."""
    found = F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}]{4,}|[0-9]+)"), 1)
    return F.array_distinct(F.transform(found, lambda w: F.when(w < ":", w).otherwise(F.substring(w, 1, 5))))  # digits come before all letters


def distinct_words(c: Column) -> Column:
    """Distinct lower-case words of two characters or more; % counts as one of them."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}_%]{2,})"), 1))


def parse_number(c: Column) -> Column:
    """Numbers such as ``1 250``, ``−89 %`` or ``×3``; null for other text."""
    t = F.replace(F.replace(F.translate(F.coalesce(c, F.lit("")), "   %×x+", ""), F.lit("−"), F.lit("-")), F.lit(","), F.lit("."))
    return F.when(t.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), t.cast("double"))


#: Texts that are nothing but a prompt, and patterns of prompts for text, photos and speakers.
WHOLE_PROMPTS = ("заголовок", "текст", "подзаголовок", "название", "описание", "title", "text", "subtitle", "heading", "body", "caption", "подпись")
TEXT_PROMPTS = (
    r"lorem\s+ipsum", r"\bxxx+\b", r"\btodo\b", r"\btbd\b", r"\{\{", r"\[\s*(текст|text|\.\.\.)\s*\]", r"вставьте\s+(текст|заголовок|фото)", r"вставить\s+(текст|заголовок|фото)", r"insert\s+(text|photo|title)",
    r"click\s+to\s+add", r"нажмите,?\s+чтобы", r"текст\s+слайда", r"заголовок\s+слайда", r"образец\s+текста", r"не\s+забудьте\s+удалить", r"удалите\s+(этот|эту|данн[\p{L}]+)\s+(слайд|страниц[\p{L}]+)",
    r"(этот|данный)\s+слайд\s+(можно|нужно|следует|необходимо)\s+удалить", r"(delete|remove)\s+(this\s+)?slide",
)
#: A piece of text for each of TEXT_PROMPTS that it can't do without; some are shared.
PROMPT_PIECES = ("ipsum", "xxx", "todo", "tbd", "{{", "[", "встав", "insert", "click", "нажмите", "слайд", "образец", "удалит", "delete", "remove")
PHOTO_PROMPT = r"(вставьте|вставить|добавьте|добавить)\s*(фото|изображение|картинку)|место\s*для\s*фото|insert\s*(photo|image|picture)"
SPEAKER_PROMPT = (
    r"(имя|фио)\s*,?\s*(спикер|докладчик|выступающ)|(спикер|докладчик)[\p{L}]*\s*,?\s*должност|(^|[^\p{L}])фио([^\p{L}]|$)|фамилия\s*,?\s*имя|имя\s*,?\s*фамилия|speaker\s*name|name\s*,?\s*(surname|position|job\s*title)"
)


def prompt_pattern(c: Column) -> Column:
    """The number of the first pattern of TEXT_PROMPTS in a text, -1 for a text of WHOLE_PROMPTS, else null.

    A text is prepared once, and patterns are tried only where a piece that one of them needs is found, one by one only
    where one of them is.
    """

    def number(t: Column) -> Column:
        may = reduce(lambda a, b: a | b, [t.contains(x) for x in PROMPT_PIECES])
        some = t.rlike("|".join(f"(?:{p})" for p in TEXT_PROMPTS))
        first = F.coalesce(*[F.when(t.rlike(p), i) for i, p in enumerate(TEXT_PROMPTS)])
        return F.when(t.isin(*WHOLE_PROMPTS), -1).when(may & some, first).cast("long")

    return F.transform(F.array(F.lower(squeezed(c))), number)[0]


def is_photo_prompt(c: Column) -> Column:
    return F.lower(squeezed(c)).rlike(PHOTO_PROMPT)


def is_speaker_prompt(c: Column) -> Column:
    return F.lower(squeezed(c)).rlike(SPEAKER_PROMPT)


def format_number(c: Column) -> Column:
    """A number as text: whole ones in groups of three digits, others with one digit behind a comma."""
    whole = F.replace(F.format_number(c, 0), F.lit(","), F.lit(" "))
    return F.when(c == F.floor(c), whole).otherwise(F.replace(F.format_string("%.1f", F.bround(c, 1)), F.lit("."), F.lit(",")))
