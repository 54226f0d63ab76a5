"""Quality rules from plain sentences, read with a small grammar.

A sentence is cut into tokens (columns, values, comparisons, properties, negations); other words are skipped. The first column is the
subject, the first token that asserts something is the head, and negations before it turn it round. What comes out is a rule or a
predicate, which is checked like any other (predicates.py). Only strings are worked on here.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from millweir.functions.conditions import StepError
from millweir.plans.predicates import Predicate
from millweir.plans.quality import Rule

# Phrases for actions and severities.
ACTION_WORDS = {"quarantine": r"\bquarantin\w*|\bset aside\b", "drop": r"\bdrop\w*|\bremove\w*|\bdelete\w*|\breject\w*|\bdiscard\w*", "fail": r"\bfail (the )?(run|pipeline|load)\b|\bstop (the )?(run|pipeline|load)\b|\babort\b|\bblock\b", "flag": r"\bflag\w*|\bwarn\w*|\bmark\b"}
SEVERITY_WORDS = {"critical": r"\bcritical\b|\bsevere\b|\bblocker\b", "high": r"\bhigh\b|\bimportant\b|\bmajor\b", "low": r"\blow\b|\bminor\b|\bnice to have\b"}

#: What each kind of phrase means. A phrase is a pattern of whole words; of two phrases at one place the longer one counts.
PHRASES: list[tuple[str, str, str]] = [
    ("not", "", r"(?:must|may|should|is|are|has|have|do|does) ?n[o']t|mustn't|can ?not|can't|never|not|no|without"),
    ("compare", ">=", r"at least|minimum(?: of)?|on or after|(?:greater|more|larger|later) than or equal to|>="), ("compare", "<=", r"at most|maximum(?: of)?|up to|on or before|(?:less|smaller|lower|earlier) than or equal to|<="),
    ("compare", ">", r"(?:greater|more|larger|higher|bigger|later|older)(?: than)?|exceeds?|above|over|after|>"), ("compare", "<", r"(?:less|smaller|lower|fewer|earlier|younger)(?: than)?|below|under|before|<"),
    ("compare", "=", r"equals?(?: to)?|(?:the )?same as|match(?:es)?|exactly|="), ("compare", "<>", r"different from|differs? from|unequal to|<>|!="),
    ("property", "unique", r"unique|distinct"), ("property", "repeated", r"duplicates?|duplicated|repeated"),
    ("property", "blank", r"null|empty|blank|missing"), ("property", "filled", r"required|mandatory|present|provided|filled(?: in)?|(?:have|has) a value"),
    ("property", "email", r"valid e-?mail(?: address)?|e-?mail (?:format|address)"), ("property", "phone", r"valid (?:phone|telephone|mobile)(?: number)?"), ("property", "date", r"valid date"), ("property", "in_reference", r"(?:valid|known) country"),
    ("sign", ">", r"positive"), ("sign", "<", r"negative"), ("sign", ">=", r"non-?negative|zero or (?:more|greater)"),
    ("time", ">", r"in the future"), ("time", "<", r"in the past"), ("today", "", r"today|the current date|now"),
    ("between", "", r"between|within"), ("years", "", r"years?(?: old| of age)?"), ("length", "", r"(?:characters?|letters?|chars?)(?: long)?"), ("length", "digits", r"digits?(?: long)?"),
    ("shape", "^[0-9]+$", r"(?:only|all) (?:digits|numbers)|numeric"), ("shape", "^[A-Za-z0-9]+$", r"alphanumeric|(?:only )?letters and (?:digits|numbers)"), ("shape", "^[A-Za-z]+$", r"(?:only|all) letters|alphabetic"), ("shape", "^[^a-z]*$", r"upper ?case"), ("shape", "^[^A-Z]*$", r"lower ?case"),
    ("text", "startswith", r"(?:start|begin)s?(?:ing)? with"), ("text", "endswith", r"ends?(?:ing)? (?:with|in)"), ("text", "contains", r"contains?(?:ing)?|includes?"),
    ("list", "", r"(?:one|any) of|either|in|allowed values(?: are)?"), ("and", "", r"and|to"), ("or", "", r"or|,"),
]
_VALUE = r"""(?P<date>\d{4}-\d{2}-\d{2})|(?P<number>-?\d[\d,]*(?<!,)(?:\.\d+)?)|(?P<quoted>'[^']*'|"[^"]*")"""
_LEXICON = [(kind, value, re.compile(rf"(?:{p})(?!\w)" if p[-1].isalnum() or p[-1] in ")?*" else p, re.I)) for kind, value, p in PHRASES]
_NEGATED = {">": "<=", "<": ">=", ">=": "<", "<=": ">", "=": "<>", "<>": "="}


@dataclass(frozen=True)
class Token:
    kind: str
    value: str
    text: str


def tokens(text: str, columns: list[str]) -> list[Token]:
    """The sentence in tokens; the longest match at a place counts, a column's name before a phrase as long."""
    names = [(c, re.compile(r"[\s_]+".join(map(re.escape, re.split(r"[\s_]+", c))) + r"(?!\w)", re.I)) for c in sorted(columns, key=len, reverse=True)]
    value, word, out, at = re.compile(_VALUE), re.compile(r"\w+|\S"), [], 0
    while at < len(text):
        if text[at].isspace():
            at += 1
            continue
        column = next(((c, m) for c, p in names if (m := p.match(text, at))), None)
        literal = value.match(text, at)
        phrases = [(len(m[0]), kind, meaning, m) for kind, meaning, p in _LEXICON if (m := p.match(text, at))]
        if column and len(column[1][0]) >= max((p[0] for p in phrases), default=0):
            m, token = column[1], Token("column", column[0], column[1][0])
        elif literal:
            m, token = literal, Token(literal.lastgroup or "", literal[0].strip("'\""), literal[0])
        elif phrases:
            _, kind, meaning, m = max(phrases, key=lambda x: x[0])
            token = Token(kind, meaning, m[0])
        else:
            m = word.match(text, at)
            token = Token("word", m[0], m[0])
        out.append(token)
        at = m.end()
    return out


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _sql(t: Token) -> str:
    """A token as an operand."""
    made = {"column": lambda v: f"`{v}`", "number": lambda v: v.replace(",", ""), "date": lambda v: f"to_date('{v}')", "today": lambda v: "current_date()"}
    return made.get(t.kind, _text)(t.value)


@dataclass(frozen=True)
class Sentence:
    column: str
    head: Token
    negated: bool
    rest: list[Token]
    before: list[Token]

    @property
    def quoted(self) -> str:
        return f"`{self.column}`"

    def operands(self) -> list[Token]:
        return [t for t in self.rest if t.kind in ("number", "date", "quoted", "column", "today")]

    def operator(self, op: str) -> str:
        return _NEGATED[op] if self.negated else op

    def predicate(self, sql: str, turn: bool = False) -> dict:
        return {"sql": f"NOT {sql}" if turn and self.negated else sql, "column": self.column}


def _property(s: Sentence) -> dict:
    """blank and repeated are the opposites of filled and unique."""
    opposite = {"blank": "not_null", "repeated": "unique"}
    name = opposite.get(s.head.value, {"filled": "not_null"}.get(s.head.value, s.head.value))
    if (s.head.value in opposite) != s.negated:
        raise StepError(f"there is no rule that {s.column!r} is {'not ' if s.negated else ''}{s.head.text}")
    return {"rule": name, "column": s.column, "params": {}}


def _compare(s: Sentence) -> dict:
    unit = next((t for t in s.rest if t.kind in ("years", "length")), None)
    right = s.operands()
    if not right:
        plain = " ".join(t.text for t in s.rest)
        if not plain:
            raise StepError(f"nothing to compare {s.column!r} with")
        return s.predicate(f"{s.quoted} {s.operator(s.head.value)} {_text(plain)}")
    op = s.operator(s.head.value)
    if unit and unit.kind == "years":
        # someone over or at least n years old was born n years ago or earlier
        days, op = int(int(right[0].value) * 365.25), {">": ">=", "<=": "<"}.get(op, op)
        return s.predicate(f"datediff(current_date(), to_date({s.quoted})) {op} {days}")
    if unit:
        return _of_length(s, op, right[0], unit)
    left = f"to_date({s.quoted})" if right[0].kind == "today" else s.quoted
    return s.predicate(f"{left} {op} {_sql(right[0])}")


def _of_length(s: Sentence, op: str, number: Token, unit: Token) -> dict:
    digits = f" AND trim({s.quoted}) RLIKE '^[0-9]+$'" if unit.value == "digits" else ""
    return s.predicate(f"length(trim({s.quoted})) {op} {number.value}{digits}")


def _length(s: Sentence) -> dict:
    """A number of characters without a comparison."""
    number = next((t for t in reversed(s.before) if t.kind == "number"), None)
    if number is None:
        raise StepError(f"how long {s.column!r} shall be isn't said")
    return _of_length(s, "=" if s.head.value == "digits" else ">=", number, s.head)


def _between(s: Sentence) -> dict:
    ends = s.operands()
    if len(ends) < 2:
        raise StepError(f"between needs two values, {s.column!r} got {len(ends)}")
    return s.predicate(f"({s.quoted} BETWEEN {_sql(ends[0])} AND {_sql(ends[1])})", turn=True)


def _list(s: Sentence) -> dict:
    """Values parted by commas or "or"."""
    parts: list[list[Token]] = [[]]
    for t in s.rest:
        if t.kind == "or":
            parts.append([])
        elif t.text not in "().:":
            parts[-1].append(t)
    values = [" ".join(t.value or t.text for t in p) for p in parts if p]
    if not values:
        raise StepError(f"no values are named for {s.column!r}")
    return s.predicate("(" + _in_list(s.quoted, values) + ")", turn=True) if s.negated else {"rule": "in_set", "column": s.column, "params": {"values": values}}


def _in_list(quoted: str, values: list[str]) -> str:
    return f"lower(trim({quoted})) IN ({', '.join(_text(v.lower()) for v in values)})"


def _function(s: Sentence) -> dict:
    if not s.rest:
        raise StepError(f"the text that {s.column!r} {s.head.text} is missing")
    return s.predicate(f"{s.head.value}({s.quoted}, {_text(s.rest[0].value or s.rest[0].text)})", turn=True)


HEADS: dict[str, Callable[[Sentence], dict]] = {
    "property": _property, "compare": _compare, "between": _between, "list": _list, "text": _function, "length": _length,
    "sign": lambda s: s.predicate(f"{s.quoted} {s.operator(s.head.value)} 0"),
    "time": lambda s: s.predicate(f"to_date({s.quoted}) {s.operator(s.head.value)} current_date()"),
    "shape": lambda s: s.predicate(f"({s.quoted} RLIKE '{s.head.value}')", turn=True),
}


def requirement(text: str, columns: list[str]) -> dict:
    """{"rule", "column", "params"} or {"sql", "column"} of one requirement."""
    found = tokens(text.strip(" .;"), columns)
    column = next((t for t in found if t.kind == "column"), None)
    if column is None:
        raise StepError(f"no column is named in {text!r}")
    # "contains only letters": what follows the verb says more
    at = next((i for i, t in enumerate(found) if t.kind in HEADS and not (t.kind == "text" and found[i + 1 : i + 2] and found[i + 1].kind == "shape")), None)
    if at is None:
        raise StepError(f"the requirement {text!r} isn't understood")
    negations = sum(t.kind == "not" for t in found[:at])
    return HEADS[found[at].kind](Sentence(column.value, found[at], negations % 2 == 1, found[at + 1 :], found[:at]))


def _as_sql(r: dict) -> str:
    """A requirement inside a condition."""
    if "sql" in r:
        return r["sql"]
    quoted = f"`{r['column']}`"
    plain = {"not_null": lambda: f"({quoted} IS NOT NULL AND trim({quoted}) <> '')", "in_set": lambda: _in_list(quoted, r["params"]["values"])}
    if r["rule"] not in plain:
        raise StepError(f"{r['rule']} can't be part of a condition")
    return plain[r["rule"]]()


def to_rule(text: str, df: DataFrame) -> Rule:
    """A rule from a sentence or a predicate. "if A then B" becomes NOT (A) OR (B)."""
    columns = [c for c in df.columns if not c.startswith("__")]
    action = next((a for a, words in ACTION_WORDS.items() if re.search(words, text, re.I)), "flag")
    severity = next((s for s, words in SEVERITY_WORDS.items() if re.search(words + r"\W*(severity|priority)?", text, re.I)), "medium")
    said = re.sub(r"[,;.]?\s*(?:otherwise|else|and)?\s*\b(?:quarantine|drop|remove|delete|reject|discard|flag|warn|fail|stop|abort|block)\b[^.;]*$", "", text, flags=re.I).strip(" .;,")
    said = re.sub(r"[,(]?\s*\b(?:critical|high|medium|low)\b\s*(?:severity|priority)\)?", "", said, flags=re.I).strip() or text
    rule = lambda kind, column, params, dimension="validity": Rule(kind, column, params, name=text, dimension=dimension, severity=severity, on_fail=action)
    try:
        return rule("expression", min(Predicate(said, df).columns, default=None), {"sql": said})
    except StepError:
        pass
    if m := re.match(r"(?:if|when)\s+(.+?)\s*(?:,\s*then|,|\bthen\b)\s*(.+)$", said, re.I):
        left, right = (requirement(x, columns) for x in m.groups())
        made, dimension = {"sql": f"NOT ({_as_sql(left)}) OR ({_as_sql(right)})", "column": right["column"]}, "consistency"
    else:
        made, dimension = requirement(said, columns), "validity"
    if "rule" in made:
        return rule(made["rule"], made["column"], made["params"])
    Predicate(made["sql"], df)
    return rule("expression", made["column"], {"sql": made["sql"]}, dimension)
