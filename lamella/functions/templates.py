"""Prompt templates as columns. `${...}` holds a path into `context` or `inputs`, a literal, `a ?: b`, or `test ? c : d`,
where a test is comparisons joined by `and`, `or` and `not`.

A template is read once on the driver and becomes a concat of columns, so nothing is parsed per row. Anything that
isn't one of those forms (calls, constructors, type references) is refused before anything runs.
"""

from __future__ import annotations

import functools
import operator
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

PLACE = re.compile(r"\$\{(.*?)\}", re.S)
PATH = re.compile(r"\s*(context|inputs)((?:\??\.[A-Za-z_]\w*)+)\s*\Z")
LITERAL = re.compile(r"\s*(?:'([^']*)'|(-?\d+(?:\.\d+)?)|(true|false|null))\s*\Z")
COMPARED = re.compile(r"(.+?)\s*(==|!=|>=|<=|>|<)\s*(.+)", re.S)
OPERATORS: dict[str, Callable] = {"==": operator.eq, "!=": operator.ne, ">=": operator.ge, "<=": operator.le, ">": operator.gt, "<": operator.lt}


class TemplateError(ValueError):
    """A template that may not run."""


def term(text: str, missing: list[Column]) -> Column:
    """A path or a literal as text. A key that isn't there at all is collected in `missing`; a null value is null."""
    if m := PATH.match(text):
        root, safe = F.col(m[1]), "?." in m[2]
        first, *rest = [p for p in re.split(r"\??\.", m[2]) if p]
        if not safe:
            missing.append(~F.map_contains_key(root, first))
        value = F.try_element_at(root, F.lit(first))
        return F.get_json_object(value, "$." + ".".join(rest)) if rest else value
    if m := LITERAL.match(text):
        return F.lit(None).cast("string") if m[3] == "null" else F.lit(m[1] if m[1] is not None else m[2] or m[3])
    raise TemplateError(f"not allowed in a template: {text.strip()!r}")


def test_of(text: str, missing: list[Column]) -> Column:
    """Comparisons joined by and, or and not; null equals null only. Texts that are both numbers compare as numbers."""
    for word, how in ((r"\s+or\s+|\s*\|\|\s*", operator.or_), (r"\s+and\s+|\s*&&\s*", operator.and_)):
        parts = re.split(word, text.strip())
        if len(parts) > 1:
            return functools.reduce(how, (test_of(p, missing) for p in parts))
    if m := re.match(r"\s*(?:!|not\s+)(?!=)(.+)\Z", text, re.S):
        return ~test_of(m[1], missing)
    c = COMPARED.match(text.strip())
    if not c:
        if re.match(r"\s*(context|inputs|true|false)\b", text):
            return F.coalesce(term(text, missing) == "true", F.lit(False))
        raise TemplateError(f"not a comparison: {text.strip()!r}")
    a, b = term(c[1], missing), term(c[3], missing)
    x, y = a.try_cast("double"), b.try_cast("double")
    both = F.when(x.isNotNull() & y.isNotNull(), OPERATORS[c[2]](x, y)).otherwise(OPERATORS[c[2]](a, b))
    none = F.lit({"==": True, "!=": False}.get(c[2], False)) if c[2] in ("==", "!=") else F.lit(False)
    return F.when(a.isNull() & b.isNull(), none).when(a.isNull() | b.isNull(), F.lit(c[2] == "!=")).otherwise(both)


def expression(text: str, missing: list[Column]) -> Column:
    """A key that is missing in the branch that isn't taken does no harm."""
    if "?:" in text:
        first, other = text.split("?:", 1)
        value = term(first, [])
        return F.when(F.coalesce(value, F.lit("")) != "", value).otherwise(expression(other, missing))
    if m := re.match(r"(.+?)\?(?!\.)((?:'[^']*'|[^:'])+):(.+)\Z", text, re.S):
        test = F.coalesce(test_of(m[1], missing), F.lit(False))
        branches = []
        for branch, taken in ((m[2], test), (m[3], ~test)):
            gone: list[Column] = []
            branches.append(term(branch, gone))
            missing += [taken & F.coalesce(g, F.lit(True)) for g in gone]
        return F.when(test, branches[0]).otherwise(branches[1])
    return term(text, missing)


def resolve(template: str | None) -> tuple[Column, Column]:
    """Columns over `context` and `inputs` (maps of text): the resolved text, and whether a key is missing."""
    if not template:
        return F.lit(""), F.lit(False)
    parts, missing, at = [], [], 0
    for m in PLACE.finditer(template):
        parts += [F.lit(template[at : m.start()]), F.coalesce(expression(m[1], missing), F.lit(""))]
        at = m.end()
    gone = F.lit(False)
    for c in missing:
        gone |= F.coalesce(c, F.lit(True))
    return F.concat(*parts, F.lit(template[at:])), gone
