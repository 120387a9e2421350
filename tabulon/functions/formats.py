"""Number and date formats: built-in ids, format codes, tokens to patterns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Value types of built-in format ids (modulo 1000), first and last id.
BUILT_IN = [(0, 0, "general"), (1, 4, "decimal"), (10, 11, "percent"), (20, 23, "currency"), (30, 36, "date"), (40, 45, "time"), (50, 50, "datetime"), (60, 61, "scientific"), (70, 71, "fraction"), (99, 99, "boolean"), (100, 100, "text")]

# Letters of date patterns by format token.
TOKENS = {
    2: "a", 3: "a", 4: "m", 5: "mm", 6: "M", 7: "MM", 8: "MMM", 9: "MMMM", 10: "H", 11: "HH", 12: "s", 13: "ss", 14: "Q", 15: "QQQ", 16: "d", 17: "dd", 18: "EEEE", 19: "E", 20: "yy", 21: "yyyy", 22: "E", 23: "EEEE ", 26: "EEEE",
    28: "MMMMM", 40: "E", 41: "EEEE", 42: "yy", 43: "yyyy", 44: "G", 45: "G", 46: "G", 47: "yyyy", 48: "yyyyG",
}
LITERALS = (-1, -12, -17, -18, -19)

# Pattern letters by strftime letter.
STRFTIME = {"Y": "yyyy", "y": "yy", "B": "MMMM", "b": "MMM", "h": "MMM", "m": "MM", "e": "d", "d": "dd", "A": "EEEE", "a": "E", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "s": "ss", "p": "a", "Q": "Q", "%": "%"}


def value_types(spark: SparkSession) -> DataFrame:
    """The built-in ids as a dimension table: format_id, value_type."""
    return spark.createDataFrame([(k, t) for a, b, t in BUILT_IN for k in range(a, b + 1)], "format_id int, value_type string")


def value_type(format_id: Column) -> Column:
    """The value type of a format id; number for ids that are not built in."""
    own, out = F.pmod(format_id, F.lit(1000)), None
    for a, b, t in BUILT_IN:
        out = F.when(own.between(a, b), t) if out is None else out.when(own.between(a, b), t)
    return out.otherwise("number")


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'" if re.search("[A-Za-z']", text) else text


def token_pattern(items: list[tuple[int, str]]) -> str | None:
    """(token, its text) of a date format as a pattern; None if a token has no translation."""
    out = []
    for token, text in items:
        if token in LITERALS:
            out.append(quoted(text))
        elif token == -3:
            out.append(" ")
        elif token in TOKENS:
            out.append(TOKENS[token])
        else:
            return None
    return "".join(out)


def strftime_pattern(text: str) -> str | None:
    """A strftime-like format as a pattern; None if a letter has no translation."""
    out, at, plain = [], 0, ""
    while at < len(text):
        if text[at] == "%" and at + 1 < len(text):
            own = STRFTIME.get(text[at + 1])
            if own is None:
                return None
            if own == "%":
                plain += "%"
            else:
                out += [quoted(plain)] * bool(plain) + [own]
                plain = ""
            at += 2
        else:
            plain += text[at]
            at += 1
    return "".join(out + [quoted(plain)] * bool(plain))


CODE = re.compile(r"\"[^\"]*\"|\\.|AM/PM|[Yy]+|[Mm]+|[Dd]+|[Hh]+|[Ss]+|.", re.S)


def date_code_pattern(code: str) -> str | None:
    """A spreadsheet date code (YYYY-MM-DD HH:MM) as a pattern; None if it holds no date or time. An M after hours or before seconds is minutes."""
    parts = CODE.findall(code)
    kinds = [p[0].lower() if re.fullmatch("[YyMmDdHhSs]+", p) else "" for p in parts]
    if not any(kinds) or re.search("[0#]", code):
        return None
    solid = [(k, i) for i, k in enumerate(kinds) if k]
    out = []
    for i, (part, kind) in enumerate(zip(parts, kinds, strict=True)):
        n = len(part)
        if kind == "m":
            at = solid.index(("m", i))
            minutes = at and solid[at - 1][0] == "h" or at + 1 < len(solid) and solid[at + 1][0] == "s"
            out.append(("m" if minutes else "M") * min(n, 2 if minutes else 4))
        elif kind == "d":
            out.append({1: "d", 2: "dd", 3: "E"}.get(n, "EEEE"))
        elif kind == "y":
            out.append("yy" if n <= 2 else "yyyy")
        elif kind == "h":
            out.append(("h" if "AM/PM" in code else "H") * min(n, 2))
        elif kind == "s":
            out.append("s" * min(n, 2))
        else:
            out.append("a" if part == "AM/PM" else quoted(part.strip('"') if part[0] == '"' else part.removeprefix("\\")))
    return "".join(out)


def formatted(x: Column, code: str) -> Column:
    """TEXT: a value by a format code. Up to three sections: positive; negative; zero."""
    if pattern := date_code_pattern(code):
        return F.date_format(x, pattern)
    sections = code.split(";")
    one = lambda v, c: _number(v, c)
    if len(sections) == 1:
        return F.when(x < 0, F.concat(F.lit("-"), one(-x, code))).otherwise(one(x, code))
    out = F.when(x < 0, one(-x, sections[1]))
    if len(sections) > 2:
        out = out.when(x == 0, one(x, sections[2]))
    return out.otherwise(one(x, sections[0]))


def _number(x: Column, code: str) -> Column:
    m = re.search(r"[#0,]*[#0](?:\.[#0]*)?(?:E[+-]?0+)?", code)
    if not m:
        return F.lit(code.replace('"', ""))
    body, head, tail = m[0], code[: m.start()].replace('"', ""), code[m.end() :].replace('"', "")
    digits = len(body.split(".")[1].split("E")[0]) if "." in body else 0
    value = x * 100 if "%" in tail else x
    if "E" in body:
        text = F.format_string(f"%.{digits}E", value.cast("double"))
    else:
        text = F.format_number(value, digits)
        text = text if "," in body else F.replace(text, F.lit(","), F.lit(""))
        least = len(re.sub(r"[^0]", "", body.split(".")[0]))
        if least > 1:
            text = F.lpad(text, least + (digits + 1 if digits else 0), "0")
    return F.concat(F.lit(head), text, F.lit(tail))


#: A conditional format's sections: (operator, limit, code).
OPERATORS = {"=": lambda x, y: x == y, "<>": lambda x, y: x != y, "<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}


def conditional(x: Column, sections: list[tuple[str | None, float, str]], otherwise: str) -> Column:
    """By the first section whose condition holds."""
    out = None
    for operator, limit, code in sections:
        test, text = OPERATORS[operator](x, limit), formatted(x, code)
        out = F.when(test, text) if out is None else out.when(test, text)
    return formatted(x, otherwise) if out is None else out.otherwise(formatted(x, otherwise))
