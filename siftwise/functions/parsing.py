"""Reading verdicts out of model answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_line(raw: Column) -> Column:
    text = F.regexp_replace(F.coalesce(raw, F.lit("")), r"^\s+|\s+$", "")
    return F.lower(F.trim(F.element_at(F.split(text, "\n"), 1)))


def parse_yes_no(raw: Column) -> Column:
    """Yes or No by the start of the first line, else by its first such word, else UNKNOWN."""
    line = first_line(raw)
    words = F.filter(F.split(F.regexp_replace(line, "[,.]", " "), r"\s+"), lambda w: w.isin("yes", "no"))
    return (
        F.when(line.startswith("yes"), "Yes").when(line.startswith("no"), "No")
        .when(F.size(words) > 0, F.initcap(F.get(words, F.lit(0)))).otherwise("UNKNOWN")
    )


def parse_3way(raw: Column) -> Column:
    """True, False or Unsure as Yes, No, Unsure, by the same rules."""
    line = first_line(raw)
    words = F.filter(F.split(F.regexp_replace(line, "[,.]", " "), r"\s+"), lambda w: w.isin("true", "false", "unsure"))
    name = lambda w: F.when(w == "true", "Yes").when(w == "false", "No").when(w == "unsure", "Unsure")
    start = F.when(line.startswith("true"), "Yes").when(line.startswith("false"), "No").when(line.startswith("unsure"), "Unsure")
    return F.coalesce(start, name(F.get(words, F.lit(0))), F.lit("UNKNOWN"))


def parse_zero_shot(raw: Column) -> Column:
    """The last line with text: exactly Yes or No, then by prefix, then as a capitalised word anywhere."""
    lines = F.filter(F.transform(F.split(F.coalesce(raw, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    last = F.coalesce(F.try_element_at(lines, F.lit(-1)), F.lit(""))
    plain = F.lower(F.regexp_replace(last, r"\.$", ""))
    word = F.regexp_extract(F.coalesce(raw, F.lit("")), r"\b(Yes|No)\b", 1)
    return (
        F.when(plain == "yes", "Yes").when(plain == "no", "No")
        .when(F.lower(last).startswith("yes"), "Yes").when(F.lower(last).startswith("no"), "No")
        .when(word != "", word).otherwise("PARSE_FAIL")
    )


def parse_leading_yes_no(raw: Column) -> Column:
    """Yes or No as the first word, else null."""
    word = F.lower(F.regexp_extract(F.coalesce(raw, F.lit("")), r"(?i)^\s*(yes|no)\b", 1))
    return F.when(word == "yes", "Yes").when(word == "no", "No")


def json_object(raw: Column) -> Column:
    """The outermost braces of an answer, with prose or a code fence around them; null without any."""
    found = F.regexp_extract(F.coalesce(raw, F.lit("")), r"(?s)(\{.*\})", 1)
    return F.when(found != "", found)


def json_field(raw: Column, field: str) -> Column:
    """A trimmed, non-empty text field of the object in an answer; else null."""
    value = F.trim(F.get_json_object(json_object(raw), f"$.{field}"))
    return F.when(value != "", value)


def flat_json_field(raw: Column, field: str) -> Column:
    """As json_field, of the whole answer if that is an object, else of the first braces without braces inside."""
    text = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(raw, F.lit(""))), r"^```(json)?\s*", ""), r"\s*```$", "")
    whole = F.get_json_object(text, f"$.{field}")
    flat = F.get_json_object(F.regexp_extract(text, r"(\{[^{}]*\})", 1), f"$.{field}")
    value = F.trim(F.coalesce(whole, flat))
    return F.when(value != "", value)


def parse_match_json(raw: Column) -> Column:
    """Yes, No or unsure by the field match of a JSON answer; of other answers by the words unsure, true, false; else PARSE_FAIL."""
    text = F.trim(F.coalesce(raw, F.lit("")))
    value = F.lower(F.get_json_object(text, "$.match"))
    low = F.lower(text)
    by_word = (
        F.when(low.contains("unsure"), "unsure").when(low.contains("true") & ~low.contains("false"), "Yes")
        .when(low.contains("false"), "No").otherwise("PARSE_FAIL")
    )
    by_value = F.when(value == "unsure", "unsure").when(value.isin("", "0", "false") | value.isNull(), "No").otherwise("Yes")
    return F.when(text.rlike(r"(?s)^\{.*\}$") & F.get_json_object(text, "$").isNotNull(), by_value).otherwise(by_word)


def yes_as_int(label: Column) -> Column:
    return F.when(label == "Yes", 1).when(label == "No", 0)


def truthy(text: Column) -> Column:
    return F.lower(F.trim(F.coalesce(text, F.lit("")))).isin("yes", "1", "true")
