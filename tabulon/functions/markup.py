"""Formula markup of text documents as MathML: a recursive-descent reader.

Texts that don't parse come out as plain text in one element.
"""

from __future__ import annotations

import re
from html import escape

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Words and their signs.
GREEK = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
SIGNS = {name: chr(0x3B1 + k + (k >= 17)) for k, name in enumerate(GREEK)} | {"infinity": "∞", "infty": "∞", "partial": "∂", "nabla": "∇", "emptyset": "∅", "dotslow": "…", "dotsaxis": "⋯", "hbar": "ℏ", "forall": "∀", "exists": "∃"}
BINARY = {"+": "+", "-": "−", "*": "∗", "/": "/", "cdot": "⋅", "times": "×", "div": "÷", "over": None, "and": "∧", "or": "∨", "plusminus": "±", "cup": "∪", "union": "∪", "cap": "∩", "intersection": "∩", "setminus": "∖"}
RELATIONS = {"=": "=", "<": "<", ">": ">", "<=": "≤", ">=": "≥", "<>": "≠", "neq": "≠", "approx": "≈", "equiv": "≡", "sim": "∼", "in": "∈", "notin": "∉", "subset": "⊂", "supset": "⊃", "toward": "→", "leftarrow": "←", "rightarrow": "→", "parallel": "∥", "ortho": "⊥"}
LARGE = {"sum": "∑", "prod": "∏", "int": "∫", "iint": "∬", "iiint": "∭", "lint": "∮", "lim": "lim", "coprod": "∐"}
FUNCTIONS = frozenset("sin cos tan cot sinh cosh tanh coth arcsin arccos arctan ln log exp abs fact".split())
ACCENTS = {"hat": "^", "bar": "¯", "vec": "→", "tilde": "~", "dot": "˙", "ddot": "¨", "acute": "´", "grave": "`", "check": "ˇ", "breve": "˘", "circle": "˚", "overline": "¯"}
BRACKETS = {"(": ")", "[": "]", "{": "}", "lbrace": "rbrace", "langle": "rangle", "lline": "rline", "lceil": "rceil", "lfloor": "rfloor"}
SHOWN = {"lbrace": "{", "rbrace": "}", "langle": "⟨", "rangle": "⟩", "lline": "|", "rline": "|", "lceil": "⌈", "rceil": "⌉", "lfloor": "⌊", "rfloor": "⌋", "none": ""}
STYLES = {"bold": 'mathvariant="bold"', "ital": 'mathvariant="italic"', "nitalic": 'mathvariant="normal"'}

TOKEN = re.compile(r"\s*(?:\"((?:\\.|[^\"])*)\"|(\d+(?:[.,]\d+)?)|([A-Za-z%][A-Za-z]*)|(<=|>=|<>|\+-|-\+|##|[-+*/=<>^_(){}\[\]#~`|&,;:!?.']))")


class BadMarkup(ValueError):
    pass


class Markup:
    def __init__(self, text: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        text = text.strip()
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise BadMarkup(f"no token at {text[at:]!r}")
            at = m.end()
            kind = m.lastindex
            self.tokens.append((("", "text", "number", "word", "sign")[kind], m[kind]))
        self.at = 0

    def peek(self) -> str | None:
        return self.tokens[self.at][1].lower() if self.at < len(self.tokens) and self.tokens[self.at][0] in ("word", "sign") else None

    def take(self) -> tuple[str, str]:
        if self.at >= len(self.tokens):
            raise BadMarkup("the markup ends early")
        self.at += 1
        return self.tokens[self.at - 1]

    def expect(self, name: str) -> None:
        if self.peek() != name:
            raise BadMarkup(f"{name} is missing")
        self.at += 1

    def lines(self) -> str:
        out = [self.row()]
        while self.peek() == "newline":
            self.take()
            out.append(self.row())
        if self.at < len(self.tokens):
            raise BadMarkup("a bracket too many")
        return out[0] if len(out) == 1 else "<mtable>" + "".join(f"<mtr><mtd>{x}</mtd></mtr>" for x in out) + "</mtable>"

    def row(self, ends: tuple = ("newline", "}", "right", "##", "#")) -> str:
        parts = []
        while self.at < len(self.tokens) and self.peek() not in ends:
            parts.append(self.relation(ends))
        return parts[0] if len(parts) == 1 else f"<mrow>{''.join(parts)}</mrow>"

    def chain(self, signs: dict, below, ends: tuple) -> str:
        parts = [below(ends)]
        while (name := self.peek()) in signs and name not in ends:
            self.take()
            parts += [f"<mo>{escape(signs[name])}</mo>", below(ends)]
        return parts[0] if len(parts) == 1 else f"<mrow>{''.join(parts)}</mrow>"

    def relation(self, ends: tuple) -> str:
        return self.chain(RELATIONS, self.sum, ends)

    def sum(self, ends: tuple) -> str:
        return self.chain({k: v for k, v in BINARY.items() if k in ("+", "-", "or", "cup", "union", "plusminus")}, self.product, ends)

    def product(self, ends: tuple) -> str:
        out = self.power(ends)
        while (name := self.peek()) in BINARY and name not in ("+", "-", "or", "cup", "union", "plusminus") and name not in ends:
            self.take()
            right = self.power(ends)
            out = f"<mfrac>{out}{right}</mfrac>" if name == "over" else f"<mrow>{out}<mo>{escape(BINARY[name])}</mo>{right}</mrow>"
        return out

    def power(self, ends: tuple) -> str:
        base, low, high = self.term(ends), None, None
        while (name := self.peek()) in ("^", "_", "sup", "sub", "rsup", "rsub"):
            self.take()
            if name in ("^", "sup", "rsup"):
                high = self.term(ends)
            else:
                low = self.term(ends)
        if low and high:
            return f"<msubsup>{base}{low}{high}</msubsup>"
        return f"<msub>{base}{low}</msub>" if low else f"<msup>{base}{high}</msup>" if high else base

    def term(self, ends: tuple) -> str:
        kind, own = self.take()
        name = own.lower()
        if kind == "text":
            return f"<mtext>{escape(own)}</mtext>"
        if kind == "number":
            return f"<mn>{own}</mn>"
        if name == "{":
            inner = self.row(("}",))
            self.expect("}")
            return f"<mrow>{inner}</mrow>"
        if name == "left":
            opening = self.take()[1].lower()
            inner = self.row(("right",))
            self.expect("right")
            closing = self.take()[1].lower()
            return f"<mrow><mo>{escape(SHOWN.get(opening, opening))}</mo>{inner}<mo>{escape(SHOWN.get(closing, closing))}</mo></mrow>"
        if name in BRACKETS:
            closing = BRACKETS[name]
            inner = self.row((closing,))
            self.expect(closing)
            return f"<mrow><mo>{escape(SHOWN.get(name, name))}</mo>{inner}<mo>{escape(SHOWN.get(closing, closing))}</mo></mrow>"
        if name == "sqrt":
            return f"<msqrt>{self.term(ends)}</msqrt>"
        if name == "nroot":
            degree, base = self.term(ends), self.term(ends)
            return f"<mroot>{base}{degree}</mroot>"
        if name in LARGE:
            low = high = None
            while self.peek() in ("from", "to", "^", "_"):
                which = self.take()[1].lower()
                value = self.term(ends)
                low, high = (value, high) if which in ("from", "_") else (low, value)
            sign = f"<mo>{LARGE[name]}</mo>"
            head = f"<munderover>{sign}{low}{high}</munderover>" if low and high else f"<munder>{sign}{low}</munder>" if low else f"<mover>{sign}{high}</mover>" if high else sign
            return f"<mrow>{head}{self.power(ends)}</mrow>"
        if name in ACCENTS:
            return f'<mover accent="true">{self.term(ends)}<mo>{escape(ACCENTS[name])}</mo></mover>'
        if name in STYLES:
            return f"<mstyle {STYLES[name]}>{self.term(ends)}</mstyle>"
        if name in ("matrix", "stack", "binom"):
            return self.table(name, ends)
        if name in FUNCTIONS:
            return f"<mrow><mi>{name}</mi>{self.power(ends)}</mrow>"
        if name in ("-", "+", "neg", "plusminus", "+-"):
            sign = {"-": "−", "neg": "¬", "plusminus": "±", "+-": "±"}.get(name, name)
            return f"<mrow><mo>{sign}</mo>{self.power(ends)}</mrow>"
        if name.startswith("%"):
            return f"<mi>{SIGNS.get(name[1:], escape(own[1:]))}</mi>"
        if name in SIGNS and kind == "word" and name not in GREEK:
            return f"<mi>{SIGNS[name]}</mi>"
        if kind == "word":
            return f"<mi>{escape(own)}</mi>"
        if name in ("~", "`"):
            return '<mspace width="0.5em"/>'
        if own in ")]}":
            raise BadMarkup("a bracket too many")
        return f"<mo>{escape(own)}</mo>"

    def table(self, name: str, ends: tuple) -> str:
        if name == "binom":
            top, bottom = self.term(ends), self.term(ends)
            return f'<mrow><mo>(</mo><mfrac linethickness="0">{top}{bottom}</mfrac><mo>)</mo></mrow>'
        self.expect("{")
        rows = [[self.row(("#", "##", "}"))]]
        while self.peek() in ("#", "##"):
            mark = self.take()[1]
            if mark == "##" or name == "stack":
                rows.append([])
            rows[-1].append(self.row(("#", "##", "}")))
        self.expect("}")
        return "<mtable>" + "".join("<mtr>" + "".join(f"<mtd>{c}</mtd>" for c in r) + "</mtr>" for r in rows) + "</mtable>"


def mathml(text: str) -> str:
    try:
        body = Markup(text).lines()
    except BadMarkup:
        body = f"<mtext>{escape(text)}</mtext>"
    return f'<math xmlns="http://www.w3.org/1998/Math/MathML">{body}</math>'


@F.pandas_udf(StringType())
def to_mathml(texts: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else mathml(t) for t in texts], dtype=object)
