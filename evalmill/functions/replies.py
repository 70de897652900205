"""Parsing replies into answers, as Column expressions.

Patterns are Java's. ``\\s`` is ASCII white space on both sides of the comparison; NULL texts are empty.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns: what counts as an answer marker, a probability, an option, a hedge.
BOXED = r"\\boxed\s*\{((?:[^{}]|\{[^{}]*\})*)\}"
PROBABILITY = r"(?<![\d.])(0?\.\d+|0|1(?:\.0+)?)(?![\d.])"
CLOSING_PROBABILITY = r"(?<![\d.])(0?\.\d+|0|1(?:\.0+)?)[*_`\s]*[.]?$"
STARRED = r"\*\s*(\d*\.?\d+)\s*\*"
LOOSE_NUMBER = r"(?<![\d.])(\d*\.\d+|[01])(?![\d.])"
OPTION_LINE = r"(?m)^\s*([A-Z])[.)]\s+\S"
BINARY_DEMAND = r"(?i)\\boxed\{\s*Yes\s*\}\s*or\s*\\boxed\{\s*No\s*\}"
NON_ANSWER = (
    r"(?i)^\s*(n/?a|tbd|unknown|unclear|none|null|nil|\?+|\.{2,}|-+|insert answer here|cannot\s+(be\s+)?determine\w*|no\s+answer"
    r"|not\s+enough\s+(information|data)|i\s+(don'?t|do\s+not)\s+know|undetermined|indeterminate|maybe|possibly|uncertain)\s*[.!]?\s*$"
)
MARKUP = r"[*_`$#]+"
ANSWER_PREFIX = r"(?i)^\W*(the\s+)?(final|correct)?\s*answer\s*(is)?\s*[:\-]?\s*"
STEP = r"(?im)^\s*(?:step\s*)?\d+[.):]"
TERMINAL = "[.!?)\\]}\"\u201d\u2019]\\s*$"
REFUSAL_OPENING = r"(?i)^\s*(i\s+(cannot|can't|can not|am unable to|won't|will not|do not|don't)\b|sorry\b|unable to\b|no answer\b|i'm sorry\b|as an ai\b|i am an ai\b)"
TRAILING_MARKUP = r"[*_`~\s]+$"
CLOSING_FIGURE = r"(?<![A-Za-z])\d+(?:\.\d+)?\s*%?$"
ENDS_BOXED = r"\\boxed\s*\{((?:[^{}]|\{[^{}]*\})*)\}\s*$"
TRAILING_CLOSERS = "[\\s*_`~.!?,;:\"')\\]\u201d\u2019$\\\\]+$"
REASONING_CHARS = 120
REFUSAL_CHARS = 200


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def stripped(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _rstripped(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+$", "")


def _group(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, NULL without a match."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def boxed(text: Column) -> Column:
    """struct(answer, raw_box, n_boxes, compliant); the last box wins, even an empty one."""
    boxes = F.regexp_extract_all(_text(text), F.lit(BOXED), 1)
    raw = stripped(F.try_element_at(boxes, F.lit(-1)))
    parts = F.filter(F.transform(F.split(raw, ","), stripped), lambda x: x != "")
    return F.struct(parts.alias("answer"), raw.alias("raw_box"), F.size(boxes).alias("n_boxes"), (F.size(boxes) > 0).alias("compliant"))


def _in_range(numbers: Column) -> Column:
    return F.filter(F.transform(numbers, lambda x: x.try_cast("double")), lambda x: x.between(0.0, 1.0))


def closing_probability(text: Column) -> Column:
    """struct(prob, compliant, source): compliant only if the reply ends with a number in [0, 1]."""
    t = _rstripped(_text(text))
    tail = stripped(F.element_at(F.split(t, r"\r\n|[\n\r\x0B\f\x{85}\x{2028}\x{2029}]"), -1))
    end = _group(tail, CLOSING_PROBABILITY).try_cast("double")
    last = F.try_element_at(_in_range(F.regexp_extract_all(t, F.lit(PROBABILITY), 1)), F.lit(-1))
    source = F.when(end.isNotNull(), "final_line").when(last.isNotNull(), "number_not_final")
    return F.struct(F.coalesce(end, last).alias("prob"), end.isNotNull().alias("compliant"), source.alias("source"))


def loose_probability(text: Column) -> Column:
    """The last starred number in [0, 1], else the last one of the last four lines, else of the text."""
    t = _text(text)
    lines = F.filter(F.split(stripped(t), "\n"), lambda x: stripped(x) != "")
    tail = F.array_join(F.slice(lines, F.greatest(F.lit(1), F.size(lines) - 3), 4), "\n")
    tries = [F.try_element_at(_in_range(F.regexp_extract_all(c, F.lit(p), 1)), F.lit(-1)) for c, p in ((t, STARRED), (tail, LOOSE_NUMBER), (t, LOOSE_NUMBER))]
    return F.coalesce(*tries)


def cleaned(line: Column) -> Column:
    """A line without markup and without an "answer is" before it."""
    return stripped(F.regexp_replace(F.regexp_replace(line, MARKUP, " "), ANSWER_PREFIX, ""))


def answer_lines(text: Column, k: int = 6) -> Column:
    """The last k lines that are not blank, last first, cleaned; lines that clean to nothing are left out."""
    lines = F.filter(F.split(stripped(_text(text)), "\n"), lambda x: stripped(x) != "")
    last = F.slice(lines, F.greatest(F.lit(1), F.size(lines) - (k - 1)), k)
    return F.filter(F.transform(F.reverse(last), cleaned), lambda x: x != "")


def chain_steps(text: Column) -> Column:
    """Numbered steps, or the lines that are not blank where there are none."""
    t = _text(text)
    steps = F.size(F.regexp_extract_all(t, F.lit(STEP), 0))
    return F.when(steps > 0, steps).otherwise(F.size(F.filter(F.split(t, "\n"), lambda x: stripped(x) != "")))


def options_offered(prompt: Column) -> Column:
    """The distinct option letters of a prompt, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(_text(prompt), F.lit(OPTION_LINE), 1)))


def answer_type(prompt: Column) -> Column:
    """binary, multiple_choice (two letters or more are offered) or free_text."""
    return F.when(_text(prompt).rlike(BINARY_DEMAND), "binary").when(F.size(options_offered(prompt)) >= 2, "multiple_choice").otherwise("free_text")


def interpreted(box: Column, prompt: Column) -> Column:
    """struct(kind, interpretable, value, why): whether what a box holds can answer this prompt, and the answer.

    The value of an answer is Yes or No, the options chosen in order with commas, or the text; of what is none, what the box holds.
    """
    raw = stripped(_text(box))
    kind = answer_type(prompt)
    offered = options_offered(prompt)
    picked = F.array_distinct(F.transform(F.filter(F.split(raw, r"[,;/]| and "), lambda x: stripped(x) != ""), lambda x: F.upper(F.regexp_replace(stripped(x), r"\.+$", ""))))
    inner = F.when(raw.rlike(r"(?s)^\\text\s*\{(.*)\}$"), stripped(F.regexp_extract(raw, r"(?s)^\\text\s*\{(.*)\}$", 1))).otherwise(raw)
    why = (
        F.when(raw == "", "empty")
        .when(raw.rlike(NON_ANSWER), "hedge")
        .when((kind == "binary") & ~F.lower(F.regexp_replace(raw, r"\.+$", "")).isin("yes", "no"), "not_yes_or_no")
        .when((kind == "multiple_choice") & (F.size(picked) == 0), "no_option")
        .when((kind == "multiple_choice") & (F.size(F.array_except(picked, offered)) > 0), "not_offered")
        .when((kind == "multiple_choice") & (F.size(picked) == F.size(offered)), "all_options")
        .when((kind == "free_text") & (F.length(inner) < 2), "too_short")
    )
    value = F.when(raw == "", None).when(why.isNotNull(), raw).when(kind == "binary", F.initcap(F.lower(F.regexp_replace(raw, r"\.+$", "")))).when(kind == "multiple_choice", F.array_join(F.array_sort(picked), ",")).otherwise(inner)
    return F.struct(kind.alias("kind"), why.isNull().alias("interpretable"), value.alias("value"), why.alias("why"))


def interpreted_probability(prob: Column) -> Column:
    """struct(kind, interpretable, value, why): whether a forecast's figure is a probability that can be scored."""
    why = F.when(prob.isNull() | F.isnan(prob), "none").when((prob < 0) | (prob > 1), "outside")
    return F.struct(F.lit("probability").alias("kind"), why.isNull().alias("interpretable"), prob.alias("value"), why.alias("why"))


def reconciled(verdict: Column, text: Column, bench: Column, finish_reason: Column) -> Column:
    """A reader's verdict, where it says TRUNCATED although the facts disprove it replaced by COMPLETE.

    The facts: the provider says that the model stopped, and the reply ends with its own non-empty answer marker.
    """
    ends = F.when(bench == "btf3", closing_probability(text)["compliant"]).otherwise(F.endswith(_rstripped(_text(text)), F.lit("}")))
    disproved = (verdict == "TRUNCATED") & (finish_reason == "stop") & has_marker(text, bench) & ends
    return F.when(F.coalesce(disproved, F.lit(False)), F.lit("COMPLETE")).otherwise(verdict)


def has_marker(text: Column, bench: Column) -> Column:
    """Whether a non-empty answer marker of the benchmark's own kind is there."""
    boxes = F.filter(F.regexp_extract_all(_text(text), F.lit(BOXED), 1), lambda x: stripped(x) != "")
    return F.when(bench == "btf3", closing_probability(text)["compliant"]).otherwise(F.size(boxes) > 0)


def looks_finished(text: Column, bench: Column) -> Column:
    """Ends with a figure, its answer, a terminal mark, or is a short whole refusal."""
    t = F.regexp_replace(_rstripped(_text(text)), TRAILING_MARKUP, "")
    short = t.rlike(REFUSAL_OPENING) & (F.length(t) <= REFUSAL_CHARS)
    return t.rlike(CLOSING_FIGURE) | ((bench == "btf3") & closing_probability(t)["compliant"]) | t.rlike(TERMINAL) | short


def ends_with_answer(text: Column) -> Column:
    """Whether the text ends in a box that holds something, typography aside."""
    box = _group(F.regexp_replace(_rstripped(_text(text)), TRAILING_CLOSERS, ""), ENDS_BOXED)
    return F.coalesce(stripped(box) != "", F.lit(False))


def reasoning_evidence(text: Column, reasoning: Column) -> Column:
    """struct(has, source, chars): the reasoning field, or long enough prose before the first box."""
    field = stripped(_text(reasoning))
    prose = stripped(F.substring_index(_text(text), "\\boxed", 1))
    long = F.length(prose) >= REASONING_CHARS
    source = F.array_compact(F.array(F.when(field != "", "reasoning_field"), F.when(long, "visible_prose")))
    chars = F.greatest(F.length(field), F.when(long, F.length(prose)).otherwise(0))
    return F.struct((F.size(source) > 0).alias("has"), source.alias("source"), chars.alias("chars"))


def completeness_verdict(text: Column, bench: Column, finish_reason: Column, usage: Column) -> Column:
    """The verdict from facts alone; the order of the rules is their meaning."""
    t = stripped(_text(text))
    marker = has_marker(text, bench)
    return (
        F.when(finish_reason == "error", "PROVIDER_ERROR")
        .when(usage.isNull(), "UNDECIDED")
        .when(F.coalesce(usage["prompt_tokens"], F.lit(0)) == 0, "PROVIDER_ERROR")
        .when(finish_reason == "length", "TRUNCATED")
        .when(t == "", "EMPTY_HTTP")
        .when(~marker & ~looks_finished(text, bench), "TRUNCATED")
        .when(~marker, "NO_ANSWER")
        .when(bench == "btf3", "COMPLETE")
        .otherwise("UNDECIDED")
    )


def reply_class(text: Column, finish_reason: Column) -> Column:
    """Compliance of a probability reply, or why not; a reply cut by its budget is no content class."""
    tail = F.substring(_rstripped(_text(text)), -400, 400)
    return (
        F.when(finish_reason == "length", "TRUNCATED_budget")
        .when(stripped(_text(text)) == "", "EMPTY")
        .when(closing_probability(text)["compliant"], "compliant")
        .when(tail.rlike(r"\d{1,3}(?:\.\d+)?\s*%"), "percent")
        .when(tail.rlike(PROBABILITY), "prose_after_number")
        .otherwise("no_figure")
    )


def choice_verdict(kind: Column, gold: Column, text: Column, finish_reason: Column) -> Column:
    """struct(status, correct) of a capability reply: kinds mcq, integer and exact; other kinds are not scored.

    The last candidate line that parses decides; without one the whole text does.
    """
    lines = answer_lines(text)

    def last_match(pattern: str, prepare) -> Column:
        found = F.filter(F.transform(lines, lambda c: F.try_element_at(F.regexp_extract_all(prepare(c), F.lit(pattern), 0), F.lit(-1))), lambda x: x.isNotNull())
        whole = F.try_element_at(F.regexp_extract_all(prepare(_text(text)), F.lit(pattern), 0), F.lit(-1))
        return F.coalesce(F.try_element_at(found, F.lit(1)), whole)

    letter = last_match(r"\b[ABCD]\b", F.upper)
    integer = last_match(r"-?\d+", lambda c: F.regexp_replace(c, ",", ""))
    bare = lambda c: F.when(F.ltrim(c, F.lit("0")) == "", "0").otherwise(F.ltrim(c, F.lit("0")))
    wanted = F.lower(stripped(gold))
    exact = F.exists(F.slice(lines, 1, 3), lambda c: F.contains(F.lower(c), wanted))
    status = (
        F.when(finish_reason == "length", "TRUNCATED").when(stripped(_text(text)) == "", "EMPTY").when(gold.isNull(), "UNSCORED")
        .when(((kind == "mcq") & letter.isNull()) | ((kind == "integer") & integer.isNull()), "NOPARSE")
        .when(kind.isin("mcq", "integer", "exact"), "OK").otherwise("UNSCORED")
    )
    correct = F.when(status == "OK", F.when(kind == "mcq", letter == gold).when(kind == "integer", bare(integer) == bare(gold)).otherwise(exact))
    return F.struct(status.alias("status"), correct.alias("correct"))


def reader_verdict(reply: Column) -> Column:
    """The verdict a reader's reply states on lines that start with ``verdict:``.

    NULL without such a line, if lines disagree, or if a line names a second verdict outside of a
    parenthesis that closes it.
    """
    word = r"(?:complete|truncated|no_answer|unclear)"
    stated = rf"(?i)^\s*verdict:\s*({word})\b(.*)$"
    lines = F.filter(F.split(_text(reply), r"\r?\n"), lambda x: x.rlike(stated))
    rest = F.transform(lines, lambda x: F.regexp_extract(x, stated, 2))
    torn = F.exists(rest, lambda x: x.rlike(rf"(?i)\b{word}\b") & ~x.rlike(r"^\s*\(.*\)\s*$"))
    named = F.array_distinct(F.transform(lines, lambda x: F.upper(F.regexp_extract(x, stated, 1))))
    one = F.get(named, F.lit(0))
    return F.when(~torn & (F.size(named) == 1), F.when(one == "UNCLEAR", "UNDECIDED").otherwise(one))


def extracted_probability(reply: Column) -> Column:
    """struct(readable, prob) of an extractor's ``PROB:`` line; NONE is a readable abstention.

    An unreadable reply is an error, not an abstention: callers refuse rows that are not readable.
    """
    line = r"(?im)PROB:\s*(NONE|[01](?:\.\d+)?|\.\d+)\s*$"
    value = _group(_text(reply), line)
    prob = value.try_cast("double")
    readable = value.isNotNull() & ((F.upper(value) == "NONE") | F.coalesce(prob.between(0.0, 1.0), F.lit(False)))
    return F.struct(readable.alias("readable"), F.when(readable, prob).alias("prob"))
