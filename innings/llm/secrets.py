"""Secret scan by assignment-aware lexing.

Two readers go over every whole text. The base patterns find key-value forms,
access keys and long hexadecimal runs. The lexer reads source and
configuration syntax into pairs of a name and an expression of literals and
names, carries the literals through the names they are assigned to, and scores
every literal by the names it reaches and by its own form. It knows
``name = "x"``, ``name: x``, ``"name": "x"``, ``export NAME=x``,
``name := 'x'``, chains (``a = b = "x"``: all names get the value),
annotations (``a: str = "x"``: the annotated name gets it), subscripts and
attributes (``env["NAME"] = "x"``, ``self.name = "x"``), lists and calls
(``names = ["x", "y"]``, ``f("x")``: every literal in them), schemes
(``Authorization: Bearer x``) and pairs of attributes
(``key="name" value="x"``).

Defined results: a null text counts as empty and has no spans; rows are
independent, so repeated rows and equal ids give repeated results; a literal
that several names reach has the best score; long texts are read whole; an
empty table gives no rows; other columns are kept out. Work is linear in the
text: an expression node is marked once for each of the few weights.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# The base patterns in the order of their kinds, with the least length of the group that counts.
BASE = {
    "assign": (r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    "access": (r"(AKIA[A-Z0-9]+)", 1, 20),
    "hex": (r"([0-9a-f]+)", 1, 24),
}
_ASSIGN = re.compile(BASE["assign"][0], re.IGNORECASE | re.ASCII)
# A failing run of the last two can't hold a passing one, so the least length may stand in the pattern.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}", re.ASCII)
_HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ["assign", "access", "hex", "literal"]

#: How much a part of a target name says that its value is secret.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.9, "credential": 0.9,
    "apikey": 1.0, "privatekey": 1.0, "accesskey": 1.0, "encryptionkey": 1.0, "signingkey": 1.0, "secretkey": 1.0,
    "sharedkey": 1.0, "masterkey": 0.9, "sessionkey": 0.9, "authkey": 0.9, "accountkey": 0.9, "auth": 0.7,
    "authorization": 0.8, "bearer": 0.9, "passcode": 0.9, "salt": 0.7, "dsn": 0.7, "cookie": 0.6, "signature": 0.6,
}
_LEXEME = re.compile(
    r"""(?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`[^`\n]*`)"""
    r"""|(?P<op>:=|=>|==|!=|<=|>=|=|:|\+|,|;|\(|\)|\[|\]|\{|\}|<|>|\n|\#|//)"""
    r"""|(?P<word>[^\s"'`:=+,;()\[\]{}\#<>]+)""",
)
_NAME = re.compile(r"[A-Za-z_$][A-Za-z0-9_.$-]*\Z")
_ASSIGNS = {"=", ":", ":=", "=>"}
_BREAK = {";", "\n", "{", "}", "#", "//", "<", ">"}
_OPENS, _CLOSES = {"(": ")", "[": "]"}, {")", "]"}
#: Fixed: words before a value that say what it is, and attributes that hold a name and its value.
_SCHEMES = {"bearer", "basic", "token", "digest", "apikey"}
_NAMING, _HOLDING = {"key", "name", "id"}, {"value"}


class _Value:
    """Literals and names joined in an expression; ``score`` is the best target reached so far."""

    __slots__ = ("parts", "span", "text", "score")

    def __init__(self, parts=(), span=None, text=""):
        self.parts, self.span, self.text, self.score = parts, span, text, 0.0


def name_weight(name: str) -> float:
    """0 for an ordinary name, up to 1: the best of its parts, plurals, camel case and separators taken apart."""
    words = [w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+", name)]
    words = [w[:-1] if w.endswith("s") and w[:-1] in SENSITIVE else w for w in words]
    joined = [a + (b[:-1] if b == "keys" else b) for a, b in zip(words, words[1:])]
    return max((SENSITIVE.get(w, 0.0) for w in words + joined), default=0.0)


def literal_weight(text: str) -> float:
    """0 to 1 by length, entropy per character and kinds of characters; placeholders and prose score low."""
    if len(text) < 6 or any(c.isspace() for c in text) or re.search(r"^<.*>$|^\$\{|^\*+$|example|changeme", text, re.I):
        return 0.0
    counts: dict[str, int] = {}
    for c in text:
        counts[c] = counts.get(c, 0) + 1
    entropy = -sum(n / len(text) * math.log2(n / len(text)) for n in counts.values())
    kinds = sum(bool(re.search(k, text)) for k in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(1.0, 0.5 * min(1.0, entropy / 3.5) + 0.15 * kinds + min(0.2, len(text) / 160))


class _Reader:
    """Pairs of a name and its value, from the lexemes of a text, left to right."""

    def __init__(self, text: str):
        self.tokens = [(m.lastgroup, m.group(), m.start(), m.end()) for m in _LEXEME.finditer(text)]
        self.known: dict[str, _Value] = {}

    def _op(self, i: int, *ops: str) -> bool:
        return i < len(self.tokens) and self.tokens[i][0] == "op" and self.tokens[i][1] in ops

    def _name(self, i: int) -> tuple[str | None, int]:
        """A target at ``i`` and the place behind it: a name, a quoted one, or a subscript of either kind."""
        if i >= len(self.tokens) or self.tokens[i][0] == "op":
            return None, i
        kind, lexeme, _, _ = self.tokens[i]
        name = lexeme[1:-1] if kind == "string" else lexeme
        if not _NAME.match(name):
            return None, i
        while self._op(i + 1, "[") and self._op(i + 3, "]") and self.tokens[i + 2][0] != "op":
            inner = self.tokens[i + 2]
            name = inner[1][1:-1] if inner[0] == "string" else name
            i += 3
        return name, i + 1

    def pairs(self) -> Iterator[tuple[str, _Value]]:
        i, tokens = 0, self.tokens
        held = ""  # name that an attribute has given to the value attribute behind it
        while i < len(tokens):
            name, after = self._name(i)
            if name is None or not self._op(after, *_ASSIGNS):
                if self._op(i, "\n", "<", ">"):
                    held = ""
                i = max(after, i + 1)
                continue
            names, i = [name], after + 1
            if self._op(after, ":") and i < len(tokens) and tokens[i][0] == "word":
                # An annotation stands between a name and its value: name: kind = value.
                kind, then = self._name(i)
                if kind and self._op(then, "="):
                    i = then + 1
            while True:  # a = b = value
                more, then = self._name(i)
                if not more or not self._op(then, "=", ":="):
                    break
                names.append(more)
                i = then + 1
            value, i = self._value(i)
            if held and name.lower() in _HOLDING:
                names.append(held)
            literal = next((p.text for p in value.parts if p.span), "")
            held = literal if name.lower() in _NAMING and _NAME.match(literal) else held
            for each in names:
                self.known[each] = value
                yield each, value

    def _value(self, i: int) -> tuple[_Value, int]:
        """Literals and known names of an expression; in brackets all of them, else as long as they are joined by +."""
        parts: list[_Value] = []
        open_: list[str] = []
        glued, tokens = True, self.tokens
        while i < len(tokens):
            kind, lexeme, start, end = tokens[i]
            if kind == "op":
                if lexeme in _BREAK and not (lexeme == "\n" and open_):
                    break
                if lexeme in _OPENS:
                    open_.append(_OPENS[lexeme])
                elif lexeme in _CLOSES:
                    if not open_ or open_.pop() != lexeme:
                        break
                    glued = False
                    i += 1
                    continue
                elif lexeme != "+" and not (lexeme in (",", "\n") and open_):
                    break
                glued = True
            elif not glued and not open_:
                break
            elif open_ and self._op(i + 1, *_ASSIGNS):
                break  # a pair of its own
            elif kind == "string":
                parts.append(_Value((), (start + 1, end - 1), lexeme[1:-1]))
                glued = False
            else:
                bare = lexeme.rstrip(".|")
                if bare in self.known:
                    parts.append(self.known[bare])
                elif not parts and re.search(r"[0-9]", bare) and len(bare) >= 8:
                    parts.append(_Value((), (start, start + len(bare)), bare))  # unquoted configuration value
                glued = bare.lower() in _SCHEMES
            i += 1
        return _Value(tuple(parts)), i


def assignments(text: str) -> Iterator[tuple[str, _Value]]:
    """Name and expression of every assignment, in order of the text, with earlier names put in."""
    return _Reader(text).pairs()


def literals(text: str, threshold: float = 0.55) -> list[tuple[int, int, float]]:
    """Start, end and score of the literals whose score reaches the threshold."""
    if "=" not in text and ":" not in text:
        return []
    found: dict[tuple[int, int], float] = {}
    for name, value in assignments(text):
        weight = name_weight(name)
        if weight == 0:
            continue
        queue = [value]
        while queue:
            node = queue.pop()
            if node.score >= weight:
                continue
            node.score = weight
            if node.span and (score := weight * literal_weight(node.text)) >= threshold:
                found[node.span] = max(found.get(node.span, 0.0), score)
            queue.extend(node.parts)
    return sorted((a, b, round(s, 6)) for (a, b), s in found.items())


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of the base patterns: leftmost, non-overlapping per kind, failing matches dropped."""
    spans: list[tuple[int, int, str]] = []
    if "=" in text or ":" in text:
        spans += [(*m.span(), "assign") for m in _ASSIGN.finditer(text) if len(m.group(2)) >= BASE["assign"][2]]
    spans += [(*m.span(), "access") for m in _ACCESS.finditer(text)]
    spans += [(*m.span(), "hex") for m in _HEX.finditer(text)]
    return spans


def joined(spans: list[tuple[int, int, str]]) -> str:
    ordered = sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in ordered)


SCHEMA = ("doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, "
          "n_literal long, best_score double")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.55) -> DataFrame:
    """One row per document: counts, digest of the base spans, all spans, and the best literal score (null: none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_literal", "best_score")}
            for value in batch.column(1):
                text = value.as_py() or ""
                base = base_spans(text)
                more = literals(text, threshold)
                for kind in ("assign", "access", "hex"):
                    rows[f"n_{kind}"].append(sum(s[2] == kind for s in base))
                rows["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
                rows["spans"].append(joined(base + [(a, b, "literal") for a, b, _ in more]))
                rows["n_literal"].append(len(more))
                rows["best_score"].append(max((s for _, _, s in more), default=None))
            types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), *(pa.array(v, t) for v, t in zip(rows.values(), types))],
                names=["doc_id", *rows])

    return docs.select(id_col, text_col).mapInArrow(run, SCHEMA)
