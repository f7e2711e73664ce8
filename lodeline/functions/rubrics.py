"""Scoring responses by a table of rules.

A rubric has named tests and tiers. A tier is ``(points, condition)``; the first tier whose
condition holds gives the points. A condition is a list of clauses joined by `` & ``, each
clause a list of tests joined by ``|``; ``!`` negates a test. Both a Spark column and a SQL
expression can be made from the same table.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodeline.functions.text import SQL_WHITE_SPACE, strip

# Tests and tiers per prompt. A test is (feature, argument[, comparison, number]):
#   has      any phrase occurs in the lowercased response
#   raw      any phrase occurs in the response as written
#   each     every phrase occurs in the response as written
#   groups   how many of the phrase groups have a hit
#   times    occurrences of a text;  chars, lines, sentences, numbered, long_numbered: sizes
#   equals   the lowercased response without .!, is one of the texts
RUBRICS: dict[str, dict] = {
    "R1": {
        "tests": {"right": ("has", ["0.05", "five cents"]), "why": ("has", ["equation", "subtract", "difference", "x +"])},
        "tiers": [(3, "right & why"), (2, "right")],
        "else": 0,
    },
    "R2": {
        "tests": {"right": ("has", ["mixed"]), "long": ("chars", None, ">", 100), "why": ("has", ["label", "wrong"])},
        "tiers": [(3, "right & long & why"), (2, "right")],
        "else": 0,
    },
    "R3": {
        "tests": {"right": ("has", ["5 minute", "five minute", "5min"]), "why": ("has", ["rate", "parallel", "same time"])},
        "tiers": [(3, "right & why"), (2, "right")],
        "else": 0,
    },
    "R4": {
        "tests": {"right": ("has", ["5", "five"]), "over": ("has", ["at least", "up to", "could be"])},
        "tiers": [(3, "right & !over"), (1, "over")],
        "else": 0,
    },
    "R5": {
        "tests": {
            "numbers": ("each", ["5", "3", "2", "4"]),
            "lines": ("lines", None, ">=", 4),
            "liters": ("times", "liter", ">=", 4),
            "pour": ("has", ["pour", "fill", "empty"]),
        },
        "tiers": [(3, "numbers & lines|liters & pour"), (2, "numbers|lines|liters & numbers|pour")],
        "else": 1,
    },
    "C1": {
        "tests": {
            "def": ("raw", ["def "]),
            "name": ("has", ["palindrome"]),
            "doc": ("raw", ['"""', "'''"]),
            "asserts": ("times", "assert", ">=", 2),
            "prints": ("times", "print", ">=", 2),
            "test": ("has", ["test"]),
            "edge": ("has", ["lower", "replace", "strip", "punctuation", "space"]),
        },
        "tiers": [(3, "def & name & edge & doc & asserts|prints|test"), (2, "def & name & edge"), (1, "def & name")],
        "else": 0,
    },
    "C2": {
        "tests": {
            "four": ("groups", [["sum("], ["group by"], ["order by"], ["limit", "top 3"]], ">=", 4),
            "three": ("groups", [["sum("], ["group by"], ["order by"], ["limit", "top 3"]], ">=", 3),
            "two": ("groups", [["sum("], ["group by"], ["order by"], ["limit", "top 3"]], ">=", 2),
            "desc": ("has", ["desc"]),
        },
        "tiers": [(3, "four & desc"), (2, "three"), (1, "two")],
        "else": 0,
    },
    "C3": {
        "tests": {
            "mutable": ("has", ["mutable", "immutable", "change"]),
            "square": ("times", "[", ">=", 1),
            "round": ("times", "(", ">=", 1),
            "use": ("has", ["performance", "memory", "constant", "fixed", "hash"]),
        },
        "tiers": [(3, "mutable & square & round & use"), (2, "mutable & square|use & round|use"), (1, "mutable")],
        "else": 0,
    },
    "C4": {
        "tests": {
            "loop": ("has", ["for", "while", "range(3)"]),
            "catch": ("has", ["except", "try"]),
            "sleep": ("has", ["sleep"]),
            "power": ("has", ["**", "*2", "exponential"]),
            "def": ("raw", ["def "]),
        },
        "tiers": [(3, "def & loop & catch & sleep & power"), (2, "loop & catch"), (1, "loop|catch")],
        "else": 0,
    },
    "C5": {
        "tests": {
            "race": ("has", ["race condition"]),
            "thread": ("has", ["thread"]),
            "concurrent": ("has", ["concurrent"]),
            "fix": ("has", ["lock", "mutex", "semaphore"]),
        },
        "tiers": [
            (3, "race & thread & fix"),
            (2, "race & thread|concurrent & thread|fix"),
            (1, "race & thread|concurrent"),
        ],
        "else": 0,
    },
    "S1": {
        "tests": {
            "exact": ("sentences", None, "=", 2),
            "short": ("sentences", None, "<=", 3),
            "facts": ("groups", [["webb", "telescope"], ["infrared"], ["early universe", "big bang"], ["mirror", "6.5"]], ">=", 2),
            "fact": ("groups", [["webb", "telescope"], ["infrared"], ["early universe", "big bang"], ["mirror", "6.5"]], ">=", 1),
        },
        "tiers": [(3, "exact & facts"), (2, "short & facts"), (1, "fact")],
        "else": 0,
    },
    "S2": {
        "tests": {
            n: ("groups", [["onboarding", "8 days"], ["app", "crash", "2.3"], ["hire", "sales", "4 rep", "understaffed"]], "=", k)
            for n, k in (("three", 3), ("two", 2), ("one", 1))
        },
        "tiers": [(3, "three"), (2, "two"), (1, "one")],
        "else": 0,
    },
    "S3": {
        "tests": {
            "main": ("has", ["embed", "daily work", "process not event", "continuous", "workflow", "not periodic"]),
            "problem": ("has", ["90%", "forgotten", "fails"]),
        },
        "tiers": [(3, "main & problem"), (2, "main")],
        "else": 1,
    },
    "S4": {
        "tests": {
            "attention": ("has", ["attention"]),
            "jargon": ("has", ["tensor", "gradient", "backprop", "embedding layer"]),
            "short": ("sentences", None, "<=", 3),
        },
        "tiers": [(3, "attention & !jargon & short"), (2, "attention & short"), (1, "attention|short")],
        "else": 0,
    },
    "S5": {
        "tests": {
            "flaw": (
                "has",
                ["not objective", "subjective", "bias", "sample", "doesn't mean best", "correlation", "other factors", "market", "competition"],
            ),
            "specific": ("has", ["survivorship", "selection bias", "doesn't cover", "not comprehensive"]),
        },
        "tiers": [(3, "flaw & specific"), (2, "flaw")],
        "else": 1,
    },
    "I1": {
        "tests": {
            "five": ("numbered", None, "=", 5),
            "low": ("numbered", None, ">=", 3),
            "high": ("numbered", None, "<=", 7),
            "wordy": ("long_numbered", None, ">", 0),
        },
        "tiers": [(3, "five & !wordy"), (2, "five"), (1, "low & high")],
        "else": 0,
    },
    "I2": {
        "tests": {
            "grumpy": ("has", ["ugh", "sigh", "whatever", "look", "seriously", "fine", "geez", "god", "..."]),
            "answer": ("has", ["hour", "open", "am", "pm"]),
        },
        "tiers": [(3, "grumpy & answer"), (2, "grumpy|answer")],
        "else": 1,
    },
    "I3": {
        "tests": {
            n: (
                "groups",
                [
                    ["discuss", "meeting", "schedule", "financial"],
                    ["talk", "chat", "hey", "yo"],
                    ["💰", "💵", "💬", "🗣", "📊", "😬", "😅"],
                ],
                "=",
                k,
            )
            for n, k in (("three", 3), ("two", 2), ("one", 1))
        },
        "tiers": [(3, "three"), (2, "two"), (1, "one")],
        "else": 0,
    },
    "I4": {
        "tests": {
            "three": ("verse_lines", None, "=", 3),
            "some": ("verse_lines", None, ">", 0),
            "shape": ("verse_shape", [(2, 4), (3, 6), (2, 4)]),
        },
        "tiers": [(3, "three & shape"), (2, "three"), (1, "some")],
        "else": 0,
    },
    "I5": {"tests": {"exact": ("equals", ["yes", "no"])}, "tiers": [(3, "exact")], "else": 0},
}


def _lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), strip), lambda s: s != "")


def _test(text: Column, lower: Column, spec: tuple) -> Column:
    kind, arg = spec[0], spec[1]
    any_of = lambda where, phrases: _fold([where.contains(p) for p in phrases], lambda a, b: a | b)
    if kind == "has":
        return any_of(lower, arg)
    if kind == "raw":
        return any_of(text, arg)
    if kind == "each":
        return _fold([text.contains(p) for p in arg], lambda a, b: a & b)
    if kind == "equals":
        return strip(F.replace(F.replace(strip(lower), F.lit("."), F.lit("")), F.lit("!"), F.lit(""))).isin(arg)
    verse = F.filter(_lines(text), lambda s: ~s.startswith("#"))
    if kind == "verse_shape":
        sizes = [F.size(F.filter(F.split(F.get(verse, F.lit(i)), r"\s+"), lambda w: w != "")) for i in range(len(arg))]
        return F.coalesce(_fold([n.between(lo, hi) for n, (lo, hi) in zip(sizes, arg)], lambda a, b: a & b), F.lit(False))
    numbered = F.filter(_lines(text), lambda s: s.rlike("^[0-9]"))
    value = {
        "groups": lambda: _fold([any_of(lower, g).cast("int") for g in arg], lambda a, b: a + b),
        "times": lambda: (F.length(text) - F.length(F.replace(text, F.lit(arg), F.lit("")))) / len(arg),
        "chars": lambda: F.length(text),
        "lines": lambda: F.size(_lines(text)),
        "sentences": lambda: F.size(F.filter(F.split(text, "[.!?]"), lambda s: F.length(strip(s)) > 10)),
        "numbered": lambda: F.size(numbered),
        "long_numbered": lambda: F.size(F.filter(numbered, lambda s: F.length(s) > 30)),
        "verse_lines": lambda: F.size(verse),
    }[kind]()
    op, n = spec[2], spec[3]
    return {">": value > n, ">=": value >= n, "=": value == n, "<=": value <= n}[op]


def _fold(items, join):
    out = items[0]
    for x in items[1:]:
        out = join(out, x)
    return out


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_test(text: str, spec: tuple) -> str:
    kind, arg = spec[0], spec[1]
    lower = f"lower({text})"
    any_of = lambda where, phrases: "(" + " OR ".join(f"contains({where}, {_sql_text(p)})" for p in phrases) + ")"
    lines = f"list_filter(list_transform(string_split({text}, chr(10)), lambda s: trim(s, {SQL_WHITE_SPACE})), lambda s: s <> '')"
    verse = f"list_filter({lines}, lambda s: NOT starts_with(s, '#'))"
    numbered = f"list_filter({lines}, lambda s: regexp_matches(s, '^[0-9]'))"
    if kind == "has":
        return any_of(lower, arg)
    if kind == "raw":
        return any_of(text, arg)
    if kind == "each":
        return "(" + " AND ".join(f"contains({text}, {_sql_text(p)})" for p in arg) + ")"
    if kind == "equals":
        return f"trim(replace(replace(trim({lower}, {SQL_WHITE_SPACE}), '.', ''), '!', ''), {SQL_WHITE_SPACE}) IN ({', '.join(map(_sql_text, arg))})"
    if kind == "verse_shape":
        sizes = [f"len(list_filter(regexp_split_to_array(({verse})[{i + 1}], '\\s+'), lambda w: w <> ''))" for i in range(len(arg))]
        parts = [f"{n} BETWEEN {lo} AND {hi}" for n, (lo, hi) in zip(sizes, arg)]
        return f"coalesce({' AND '.join(parts)}, FALSE)"
    value = {
        "groups": lambda: "(" + " + ".join(f"CAST({any_of(lower, g)} AS INTEGER)" for g in arg) + ")",
        "times": lambda: f"(length({text}) - length(replace({text}, {_sql_text(arg)}, ''))) / {len(arg)}",
        "chars": lambda: f"length({text})",
        "lines": lambda: f"len({lines})",
        "sentences": lambda: f"len(list_filter(regexp_split_to_array({text}, '[.!?]'), lambda s: length(trim(s, {SQL_WHITE_SPACE})) > 10))",
        "numbered": lambda: f"len({numbered})",
        "long_numbered": lambda: f"len(list_filter({numbered}, lambda s: length(s) > 30))",
        "verse_lines": lambda: f"len({verse})",
    }[kind]()
    return f"({value} {spec[2]} {spec[3]})"


def _clauses(condition: str) -> list[list[tuple[bool, str]]]:
    return [[(t.startswith("!"), t.lstrip("!")) for t in c.split("|")] for c in condition.split(" & ")]


def _combine(condition: str, tests: dict[str, Column]) -> Column:
    ors = [_fold([~tests[n] if no else tests[n] for no, n in c], lambda a, b: a | b) for c in _clauses(condition)]
    return _fold(ors, lambda a, b: a & b)


def _sql_combine(condition: str, text: str, tests: dict[str, tuple]) -> str:
    one = lambda no, n: ("NOT " if no else "") + _sql_test(text, tests[n])
    return " AND ".join("(" + " OR ".join(one(no, n) for no, n in c) + ")" for c in _clauses(condition))


def rubric_score(
    prompt: Column, text: Column, rubrics: dict[str, dict] = RUBRICS, *, lower: Column | None = None
) -> Column:
    """0-3 points of a response by the rubric of its prompt; unknown prompts get 1.

    ``lower`` may name a column that already holds the lowercased text, so that it is not
    made again for every phrase.
    """
    out = None
    lower = F.lower(text) if lower is None else lower
    for pid, r in rubrics.items():
        tests = {n: _test(text, lower, spec) for n, spec in r["tests"].items()}
        points = None
        for score, condition in r["tiers"]:
            hit = _combine(condition, tests)
            points = F.when(hit, score) if points is None else points.when(hit, score)
        points = points.otherwise(r["else"])
        out = F.when(prompt == pid, points) if out is None else out.when(prompt == pid, points)
    return out.otherwise(1)


def rubric_sql(prompt: str, text: str, rubrics: dict[str, dict] = RUBRICS) -> str:
    cases = []
    for pid, r in rubrics.items():
        tiers = [f"WHEN {_sql_combine(c, text, r['tests'])} THEN {score}" for score, c in r["tiers"]]
        cases.append(f"WHEN {prompt} = '{pid}' THEN CASE {' '.join(tiers)} ELSE {r['else']} END")
    return f"CASE {' '.join(cases)} ELSE 1 END"
