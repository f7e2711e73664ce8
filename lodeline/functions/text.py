"""Text, JSON and markup expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space at the ends of a text.
WHITE_SPACE = "".join(chr(c) for c in range(0x10000) if chr(c).isspace())
SQL_WHITE_SPACE = f"'{WHITE_SPACE}'"

# Phrases that end a conversation.
TERMINATION_PHRASES = ("terminate", "task completed", "conversation complete", "no further action needed")

# Personal-data, secret and prompt-injection patterns.
SENSITIVE_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "phone": r"\+?[0-9]{1,3}[-. ]?\(?[0-9]{3}\)?[-. ][0-9]{3}[-. ][0-9]{4}",
    "ip": r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b",
    "card": r"\b[0-9]{4}[- ][0-9]{4}[- ][0-9]{4}[- ][0-9]{4}\b",
    "key": r"\b(?:sk|pk|ghp|AKIA)[-_A-Za-z0-9]{16,}",
    "injection": r"(?i)(ignore (?:all |the )?previous instructions|disregard the above|reveal your system prompt)",
}


def strip(text: Column) -> Column:
    """Without white space of any kind (also tabs, line ends, no-break and other Unicode blanks) at either end."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def words(text: Column) -> Column:
    """Words separated by whitespace, blanks left out."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def token_estimate(text: Column, method: str = "chars") -> Column:
    """``chars``: length/4, at least 1; ``words_up``: words*1.3; ``words_down``: words*0.75."""
    if method == "chars":
        return F.greatest(F.floor(F.length(text) / 4), F.lit(1)).cast("long")
    factor = {"words_up": 1.3, "words_down": 0.75}[method]
    return F.floor(word_count(text) * F.lit(factor)).cast("long")


def strip_tags(markdown: Column, html: Column) -> Column:
    """Markup tags replaced by blanks, from the first input that is not blank."""
    first = F.coalesce(F.when(strip(markdown) != "", markdown), html)
    return strip(F.regexp_replace(F.regexp_replace(first, r"<[^>]+>", " "), r"\s+", " "))


def json_span(text: Column) -> Column:
    """From the first ``{`` to the last ``}``, or NULL."""
    return F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))


def fenced_block(text: Column) -> Column:
    """Body of the first fenced python block, else the whole text."""
    pattern = r"(?s)```python\s*(.*?)```"
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1)).otherwise(text)


def clean_path(path: Column) -> Column:
    """Trimmed, forward slashes, no leading ``./`` and no single trailing slash."""
    p = F.replace(strip(path), F.lit("\\"), F.lit("/"))
    return F.regexp_replace(F.regexp_replace(p, r"^\./", ""), r"/$", "")


def clean_path_list(paths: Column) -> Column:
    """Cleaned paths without blanks and repeats, first occurrence first."""
    return F.array_distinct(F.filter(F.transform(paths, clean_path), lambda p: p != ""))


def termination_flag(text: Column, phrases: tuple[str, ...] = TERMINATION_PHRASES) -> Column:
    lower = F.lower(text)
    out = F.lit(False)
    for p in phrases:
        out = out | lower.contains(p.lower())
    return out


def flatten_parts(content: Column) -> Column:
    """Message content as one text: a plain string, or the joined parts of a JSON list.

    A part gives its ``text``, else its ``content``, else its JSON form.
    """
    parts = F.from_json(content, "array<map<string,string>>")
    pieces = F.transform(
        parts, lambda p: F.coalesce(F.try_element_at(p, F.lit("text")), F.try_element_at(p, F.lit("content")), F.to_json(p))
    )
    is_list = F.ltrim(content).startswith("[") & parts.isNotNull()
    return F.when(is_list, F.array_join(pieces, "\n")).otherwise(content)


def main_text(html: Column) -> Column:
    """Readable text of a page: no script, style, navigation or comments, one block per line."""
    t = F.regexp_replace(html, r"(?is)<!--.*?-->", " ")
    for tag in ("script", "style", "nav"):
        t = F.regexp_replace(t, rf"(?is)<{tag}[^>]*>.*?</{tag}>", " ")
    t = F.regexp_replace(t, r"(?is)<head[^>]*>.*?</head>", " ")
    t = F.regexp_replace(t, r"(?i)<(?:/p|/div|/h[1-6]|/li|/tr|/article|/section|/ul|/ol|/table|br)[^>]*>", "\n")
    t = F.regexp_replace(t, r"<[^>]+>", " ")
    # The named entities that are unescaped; the ampersand comes last.
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    t = F.regexp_replace(t, r"[ \t\r\f]+", " ")
    return F.trim(F.regexp_replace(t, r"[ ]*\n[ \n]*", "\n"), F.lit(" \n"))


def count_matches(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("long")


def role_prefix(role: Column, style: str = "named") -> Column:
    """``named``: System/Human/Assistant; ``two_party``: user (also for system) or model."""
    if style == "two_party":
        return F.when(role.isin("user", "system"), "user").otherwise("model")
    return F.when(role == "system", "System").when(role == "user", "Human").when(role == "assistant", "Assistant")
