"""Text keys and predicates as Column expressions: nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The four character classes for ideographs, one per rule.
CJK_TOOL = r"[一-龥㐀-䶿豈-﫿]"
CJK_STATISTICS = r"[一-鿿㐀-䶿豈-﫿]"
NON_ENGLISH = r"[一-鿿㐀-䶿豈-﫿぀-ゟ゠-ヿ가-힯　-〿]"
CJK_GUARD = r"[㐀-䶿一-鿿　-〿]"

# Words of time that make a tool time-bound.
TIME_WORDS = [
    "date", "dates", "time", "times", "datetime", "timestamp", "start_time", "end_time", "start_date", "end_date", "pick_up_time", "drop_off_time",
    "pickup_time", "dropoff_time", "pick_up_date", "drop_off_date", "pickup_date", "dropoff_date", "duration", "when", "schedule", "scheduled",
    "day", "days", "hour", "hours", "minute", "minutes", "second", "seconds", "period", "periods", "year", "years", "month", "months", "week",
    "weeks",
]
_WORDS = "|".join(TIME_WORDS)
_TITLES = "|".join(w.capitalize() for w in TIME_WORDS)
#: In lower case: a word by itself, or between separators or ends. As written: inside a camelCase name, which
#: also takes words like updateX; that is part of the rule.
TIME_LOWER = rf"\b({_WORDS})\b|(^|[_\-\s])({_WORDS})[_\-\s]|[_\-\s]({_WORDS})$"
TIME_CAMEL = rf"({_WORDS})[A-Z]|[A-Za-z]({_TITLES})|({_TITLES})[A-Z]"


def strip(c: Column) -> Column:
    """Both ends without white space, Unicode's too; null stays null."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def blank(c: Column) -> Column:
    """True for null, empty and white space only."""
    return F.coalesce(strip(c), F.lit("")) == ""


def text_key(name: Column, description: Column) -> Column:
    """Stripped name and description on lines of their own, runs of line ends as one; nulls count as ''."""
    both = F.concat(strip(F.coalesce(name, F.lit(""))), F.lit("\n"), strip(F.coalesce(description, F.lit(""))))
    return strip(F.regexp_replace(both, "\n+", "\n"))


def signature(c: Column, carriage: bool = True) -> Column:
    """Without space, tab and newline (and carriage return unless told otherwise); null becomes ''."""
    return F.translate(F.coalesce(c, F.lit("")), " \t\n\r" if carriage else " \t\n", "")


def collapsed(c: Column) -> Column:
    """Runs of white space as one space, ends stripped; null stays null."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), r"^ | $", "")


def without_space(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s", "")


def slug(c: Column) -> Column:
    """Lower case; only word characters, spaces and hyphens; runs of the latter two as one hyphen, none at the ends."""
    kept = F.regexp_replace(F.lower(c), r"(?U)[^\w\s-]", "")
    return F.regexp_replace(F.regexp_replace(kept, r"(?U)[-\s]+", "-"), r"^-+|-+$", "")


def schema_type(c: Column) -> Column:
    """A parameter type as a JSON Schema type, 'string' where it is unknown or null."""
    # Parameter type names.
    known = {"string": "string", "number": "number", "integer": "integer", "boolean": "boolean", "array": "array", "object": "object"}
    names = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    return F.coalesce(F.try_element_at(names, F.lower(c)), F.lit("string"))


def markdown_escape(c: Column) -> Column:
    """Pipes escaped and line ends as spaces, for a cell of a Markdown table."""
    return F.replace(F.replace(c, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def tool_signature(domain: Column, category: Column, name: Column) -> Column:
    """'domain::category::name' with NA for nulls."""
    return F.concat_ws("::", *[F.coalesce(x, F.lit("NA")) for x in (domain, category, name)])


def first_filled(*columns: Column) -> Column:
    """The first column that is neither null nor ''."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def report_text(c: Column, width: int = 100) -> Column:
    return F.left(c, F.lit(width))


def specific(c: Column) -> Column:
    """A value that can't be a common word: a digit, one of _ - . or more than 12 characters."""
    return c.rlike(r"[0-9]|[_.-]") | (F.length(c) > 12)


def candidate_tokens(c: Column, most: int = 12) -> Column:
    """The first distinct tokens of at least 3 letters, digits and _-. marks, compared without case."""
    found = F.regexp_extract_all(F.lower(c), F.lit(r"([a-z0-9][a-z0-9_.-]{2,})"), F.lit(1))
    return F.slice(F.array_distinct(found), 1, most)


def offending(c: Column, pattern: str = NON_ENGLISH, most: int = 10) -> Column:
    """Up to ``most`` distinct characters of a class, in order of appearance."""
    return F.slice(F.array_distinct(F.regexp_extract_all(c, F.lit(f"({pattern})"), F.lit(1))), 1, most)


def time_bound(c: Column) -> Column:
    """Whether a text speaks of time."""
    return F.lower(c).rlike(TIME_LOWER) | c.rlike(TIME_CAMEL)


def dataset_name(c: Column) -> Column:
    """The data set a file name stands for: without directory, extension and the usual suffixes."""
    stem = F.regexp_replace(F.regexp_extract(c, r"([^/]+)$", 1), r"\.jsonl?$", "")
    return F.regexp_replace(F.regexp_replace(stem, r"^(result|pred|generated)_", ""), r"_(train|test|result|pred|origin|filtered)$", "")


def file_properties(c: Column) -> Column:
    """Hop, turn, strategy and domain as a file's name says, with single-hop and single-turn where it is silent."""
    low = F.lower(c)
    said = lambda *names: F.coalesce(*[F.when(low.contains(n), F.lit(v)) for n, v in names])
    return F.create_map(
        F.lit("hop"), F.coalesce(said(("single-hop", "single-hop"), ("multi-hop", "multi-hop")), F.lit("single-hop")),
        F.lit("turn"), F.coalesce(said(("single-turn", "single-turn"), ("multi-turn", "multi-turn")), F.lit("single-turn")),
        F.lit("strategy"), F.coalesce(said(("parallel", "Parallel"), ("serial", "Serial")), F.lit("")),
        F.lit("domain"), F.coalesce(said(("out_domain", "out_domain"), ("in_domain", "in_domain")), F.lit("")),
        F.lit("other"), c,
    )


def with_values(message: Column, values: Column) -> Column:
    """The stripped message with the distinct missing values named after it; as it is where none is missing."""
    named = F.array_join(F.array_distinct(values), ", ")
    return F.when(F.size(F.coalesce(values, F.array().cast("array<string>"))) > 0, F.concat(strip(F.coalesce(message, F.lit(""))), F.lit(" Specifically: "), named, F.lit("."))).otherwise(message)


def bullets(c: Column) -> Column:
    """The items of a text's list lines, by bullet or by number."""
    lines = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), strip), lambda x: x.rlike(r"^([•\-*]|[0-9][).].)"))
    return F.transform(lines, lambda x: strip(F.regexp_replace(x, r"^([•\-* ]+|[0-9][).])", "")))


def observation(result: Column, arguments: Column) -> Column:
    """The blocks of an observation as JSON: a text, the list of the result's items, a table of the arguments."""
    text = F.struct(F.lit("text").alias("type"), strip(F.concat(F.lit("Result analysis completed.\n\n"), strip(F.coalesce(result, F.lit(""))))).alias("text"))
    items = F.struct(F.lit("list").alias("type"), F.lit("Key Findings").alias("title"), bullets(result).alias("items"))
    rows = F.transform(F.map_entries(arguments), lambda e: F.struct(e["key"].alias("parameter"), e["value"].alias("value")))
    table = F.struct(F.lit("table").alias("type"), F.lit("Input Parameters").alias("title"), F.array(F.lit("parameter"), F.lit("value")).alias("headers"), rows.alias("rows"))
    parts = F.array(F.to_json(text), F.when(F.size(bullets(result)) > 0, F.to_json(items)), F.when(F.size(arguments) > 0, F.to_json(table)))
    return F.concat(F.lit("["), F.array_join(F.array_compact(parts), ", "), F.lit("]"))
