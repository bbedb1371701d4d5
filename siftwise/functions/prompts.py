"""Chat messages and prompt texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SYSTEM = {
    "two": "You judge whether a document satisfies a condition. Reply with Yes or No only.",
    "three": "You judge whether a document satisfies a condition. Reply with True, False or Unsure only.",
    "careful": "You judge whether a document satisfies a condition. Doubt first impressions. Reply with True, False or Unsure only.",
}
#: System texts of collectors that ask without lessons.
ZERO_SHOT = {
    "word": "You judge whether a document satisfies a condition. Answer with exactly one word, Yes or No.",
    "reasoned": "You judge whether a document satisfies a condition. Reason briefly, then give Yes or No alone on the last line.",
    "json": 'You judge whether a document satisfies a condition. If in doubt, say so. Reply with {"match": true}, {"match": false} or {"match": "unsure"} only.',
}
GUIDANCE = "Lessons from earlier cases:"


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def question(condition: Column, text: Column) -> Column:
    return F.concat(F.lit("Condition: "), condition, F.lit("\nDocument:\n"), text, F.lit("\nAnswer:"))


def chat(condition: Column, text: Column, lessons: Column, demos: Column, style: str = "two") -> Column:
    """Messages: system with numbered lessons, demonstrations as turns, the question. lessons: array<string>; demos: array<struct<text, label>>."""
    numbered = F.transform(lessons, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x))
    system = F.when(F.size(lessons) > 0, F.concat(F.lit(f"{SYSTEM[style]}\n{GUIDANCE}\n"), F.array_join(numbered, "\n"))).otherwise(SYSTEM[style])
    label = (lambda d: d["label"]) if style == "two" else (lambda d: F.when(d["label"] == "Yes", "True").otherwise("False"))
    turns = F.flatten(F.transform(demos, lambda d: F.array(message("user", question(condition, d["text"])), message("assistant", label(d)))))
    return F.concat(F.array(message("system", system)), turns, F.array(message("user", question(condition, text))))


def zero_shot(condition: Column, text: Column, variant: str = "word") -> Column:
    """Messages of a collector's question; an unknown variant raises."""
    if variant not in ZERO_SHOT:
        raise KeyError(f"unknown variant {variant!r}; known: {sorted(ZERO_SHOT)}")
    return F.array(message("system", F.lit(ZERO_SHOT[variant])), message("user", question(condition, text)))


def rendered(messages: Column) -> Column:
    return F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n\n")


def explain(condition: Column, text: Column, verdict: Column) -> Column:
    return F.concat(question(condition, text), F.lit(" "), verdict, F.lit("\nIn two sentences, say which passages led you there."))


def lesson(condition: Column, text: Column, small: Column, large: Column, reason: Column) -> Column:
    return F.concat(F.lit("A helper answered "), small, F.lit(" where "), large, F.lit(" is right.\nCondition: "), condition, F.lit("\nDocument:\n"), text, F.lit("\nIts reason: "), reason, F.lit('\nReply with JSON {"lesson": ..., "when": ...}.'))


def verify(demos: Column, condition: Column, text: Column, verdict: Column, shown: int = 4, longest: int = 2000, separator: str = "\n---\n") -> Column:
    """Self-check prompt: up to `shown` demonstrations, then the case with the last `longest` characters of the text."""
    case = F.concat(F.lit("Document: "), F.right(text, F.lit(longest)), F.lit("\nCondition: "), condition, F.lit("\nProposed: "), verdict, F.lit("\nVerdict:"))
    return F.array_join(F.concat(F.slice(demos, 1, shown), F.array(case)), separator)


def predicate_from_pair(first: Column, second: Column) -> Column:
    return F.concat(F.lit("Write a condition that document A meets and document B does not.\nA:\n"), first, F.lit("\nB:\n"), second, F.lit('\nReply with JSON {"condition": ...}.'))


def confirm(condition: Column, text: Column) -> Column:
    """Whether a document meets a written condition: the second call of a predicate's making."""
    return F.concat(F.lit("Does the document meet the condition? Start with Yes or No.\nCondition: "), condition, F.lit("\nDocument:\n"), text)


def instruction(prefix: Column, body: Column, suffix: Column) -> Column:
    """Task text with braces doubled for a formatter."""
    return F.concat(prefix, F.replace(F.replace(body, F.lit("{"), F.lit("{{")), F.lit("}"), F.lit("}}")), suffix)
