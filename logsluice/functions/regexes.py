"""Line regexes with named groups, made ready for Spark's (Java) regex functions.

Specs use the ``(?P<name>...)`` form. Java knows neither that spelling nor ``_``
in names, so groups are numbered and the names kept aside. The differences in
meaning that matter for log lines are evened out: ``.`` and ``$`` know only
``\\n`` as a line end, a bare ``$`` is the end of the text, ``[`` and ``&&`` are
plain characters inside a class, and ``\\s`` leaves out vertical tab.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parts of a matched line are joined with a control character (one byte, so that Java keeps the
# text in its compact form). Lines that hold it take the slower way in LineRegex._split().
SEP = "\x01"


class RegexError(ValueError):
    """A regex that cannot be carried over."""


@dataclass(frozen=True)
class Token:
    """One piece of a regex. Kinds: atom, open, close, alt, quant."""

    kind: str
    text: str
    name: str | None = None  # set for capturing groups, "" when unnamed


def _class_end(pattern: str, start: int) -> int:
    i = start + 1
    if pattern[i : i + 1] == "^":
        i += 1
    if pattern[i : i + 1] == "]":
        i += 1
    while i < len(pattern):
        if pattern[i] == "\\":
            i += 2
        elif pattern.startswith("[:", i) and pattern.find(":]", i) > 0:
            i = pattern.find(":]", i) + 2
        elif pattern[i] == "]":
            return i
        else:
            i += 1
    raise RegexError(f"unclosed class in {pattern!r}")


_POSIX = {"alpha": "Alpha", "digit": "Digit", "alnum": "Alnum", "upper": "Upper", "lower": "Lower",
          "space": "Space", "punct": "Punct", "xdigit": "XDigit", "cntrl": "Cntrl", "print": "Print",
          "graph": "Graph", "blank": "Blank", "ascii": "ASCII"}


def _class_body(body: str) -> str:
    """Inside of a class in Java's terms."""
    out, i = [], 0
    while i < len(body):
        if body[i] == "\\":
            pair = body[i : i + 2]
            out.append(r"\t\n\f\r " if pair == r"\s" else pair)
            i += 2
        elif body.startswith("[:", i) and ":]" in body[i:]:
            end = body.index(":]", i)
            name = body[i + 2 : end]
            out.append((r"\P{" if name.startswith("^") else r"\p{") + _POSIX[name.lstrip("^")] + "}")
            i = end + 2
        else:
            out.append("\\" + body[i] if body[i] in "[&" else body[i])
            i += 1
    return "".join(out)


def tokenize(pattern: str) -> list[Token]:
    """Split a regex into pieces, already in Java's spelling."""
    out: list[Token] = []
    i = 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            pair = pattern[i : i + 2]
            if pair in (r"\p", r"\P", r"\x") and pattern[i + 2 : i + 3] == "{":
                end = pattern.index("}", i) + 1
                out.append(Token("atom", pattern[i:end]))
                i = end
                continue
            if pair in (r"\C", r"\Q", r"\E") or pair[1:].isdigit() and pair != r"\0":
                raise RegexError(f"{pair} is not allowed in {pattern!r}")
            text = {r"\s": r"[\t\n\f\r ]", r"\S": r"[^\t\n\f\r ]"}.get(pair, pair)
            # An escaped plain character such as "\-" or "\ " stands for itself.
            out.append(Token("atom", text))
            i += 2
        elif ch == "[":
            end = _class_end(pattern, i)
            body = pattern[i + 1 : end]
            negated = body.startswith("^")
            body = body[1:] if negated else body
            lead = "\\]" if body.startswith("]") else ""
            body = body[1:] if lead else body
            out.append(Token("atom", "[" + ("^" if negated else "") + lead + _class_body(body) + "]"))
            i = end + 1
        elif ch == "(":
            if pattern.startswith("(?P<", i) or (pattern.startswith("(?<", i) and pattern[i + 3 : i + 4] not in "=!"):
                start = pattern.index("<", i) + 1
                end = pattern.index(">", i)
                out.append(Token("open", "(", pattern[start:end]))
                i = end + 1
            elif pattern.startswith(("(?=", "(?!", "(?<=", "(?<!"), i):
                raise RegexError(f"look-around is not allowed in {pattern!r}")
            elif pattern.startswith("(?", i):
                end = i + 2
                while pattern[end] not in ":)":
                    end += 1
                if "U" in pattern[i + 2 : end]:
                    raise RegexError(f"flag U is not allowed in {pattern!r}")
                kind = "open" if pattern[end] == ":" else "atom"
                out.append(Token(kind, pattern[i : end + 1]))
                i = end + 1
            else:
                out.append(Token("open", "(", ""))
                i += 1
        elif ch == ")":
            out.append(Token("close", ")"))
            i += 1
        elif ch == "|":
            out.append(Token("alt", "|"))
            i += 1
        elif ch in "*+?" or (ch == "{" and pattern[i + 1 : i + 2].isdigit() and "}" in pattern[i:]):
            end = pattern.index("}", i) + 1 if ch == "{" else i + 1
            if pattern[end : end + 1] == "?":
                end += 1
            out.append(Token("quant", pattern[i:end]))
            i = end
        else:
            text = {"$": r"\z", "{": r"\{", "}": r"\}"}.get(ch, ch)
            if ch == "$" and "(?m" in pattern:
                text = "$"
            out.append(Token("atom", text))
            i += 1
    return out


# Parts of a cut line: text outside and inside of captures, and captures that lie in another one.
PLAIN, CAPTURE, INNER = "plain", "capture", "inner"


@dataclass(frozen=True)
class LineRegex:
    """A compiled line regex.

    ``java`` numbers the spec's groups 1..n. ``cut`` matches the same lines and has a group for
    every stretch of text, at whatever depth, in the order of the text; ``kinds`` names them, and
    ``places`` gives the group of each of the spec's groups. One replacement with it gives both the
    captures and the text between them.
    """

    source: str
    java: str
    names: tuple[str, ...]
    cut: str
    kinds: tuple[str, ...]
    places: tuple[int, ...]
    branches: bool

    @property
    def anchored(self) -> bool:
        return self.java.startswith("^") and not self.branches

    def _whole(self, body: str) -> str:
        head = r"\A()" if self.anchored else r"\A((?s:.*?))"
        return rf"{head}(?d:{body})((?s:.*))\z"

    def captures(self, line: Column) -> Column:
        """Array of 1 + n texts on a match (the first is no capture); one element otherwise."""
        n = len(self.names)
        template = SEP.join(f"${i + 1}" for i in range(1, n + 1))
        return self._split(line, self._whole(self.java), SEP + template, [i + 1 for i in range(1, n + 1)], skip=1)

    def parts(self, line: Column) -> Column:
        """Whole line cut in texts on a match: lead, one for each of ``kinds``, tail; else one element."""
        count = len(self.kinds) + 2
        template = SEP.join(f"${i}" for i in range(1, count + 1))
        return self._split(line, self._whole(self.cut), template, list(range(1, count + 1)), skip=0)

    @staticmethod
    def _split(line: Column, whole: str, template: str, groups: list[int], skip: int) -> Column:
        quick = F.split(F.regexp_replace(line, whole, template), SEP)
        each = [F.lit("")] * skip + [F.regexp_extract(line, whole, g) for g in groups]
        slow = F.when(line.rlike(whole), F.array(*each)).otherwise(F.array(line))
        return F.when(F.contains(line, F.lit(SEP)), slow).otherwise(quick)


@dataclass
class _Node:
    """A piece of a regex with its quantifier; a group has branches."""

    text: str
    name: str | None = None
    branches: list[list[_Node]] | None = None
    quant: str = ""

    @property
    def captures(self) -> bool:
        return self.name is not None or any(n.captures for b in self.branches or () for n in b)


def _tree(tokens: list[Token]) -> list[list[_Node]]:
    stack: list[list[list[_Node]]] = [[[]]]
    groups: list[_Node] = []
    for t in tokens:
        if t.kind == "open":
            node = _Node(t.text, t.name, [])
            stack[-1][-1].append(node)
            groups.append(node)
            stack.append([[]])
        elif t.kind == "close":
            if not groups:
                raise RegexError("a group is closed that was not opened")
            groups.pop().branches = stack.pop()
        elif t.kind == "alt":
            stack[-1].append([])
        elif t.kind == "quant" and stack[-1][-1]:
            stack[-1][-1][-1].quant += t.text
        else:
            stack[-1][-1].append(_Node(t.text))
    if groups:
        raise RegexError("a group is not closed")
    return stack[0]


def _bare(branches: list[list[_Node]]) -> str:
    """The same regex without captures."""

    def one(node: _Node) -> str:
        if node.branches is None:
            return node.text + node.quant
        return ("(?:" if node.name is not None else node.text) + _bare(node.branches) + ")" + node.quant

    return "|".join("".join(map(one, branch)) for branch in branches)


def _repeats(quant: str) -> tuple[int, int | None, str]:
    """(least, most, laziness) of a quantifier."""
    if not quant:
        return 1, 1, ""
    lazy = "?" if len(quant) > 1 and quant[-1] == "?" else ""
    body = quant.removesuffix("?") if lazy else quant
    if body[0] != "{":
        return {"?": (0, 1), "*": (0, None), "+": (1, None)}[body] + (lazy,)
    low, comma, high = body[1:-1].partition(",")
    return int(low), (int(high) if high else None) if comma else int(low), lazy


class _Cutter:
    """Writes a regex anew with groups for all stretches of text."""

    def __init__(self) -> None:
        self.kinds: list[str] = []
        self.places: list[int] = []

    def group(self, kind: str) -> int:
        self.kinds.append(kind)
        return len(self.kinds)

    def branches(self, branches: list[list[_Node]], inside: bool) -> str:
        return "|".join(self.sequence(branch, inside) for branch in branches)

    def sequence(self, nodes: list[_Node], inside: bool) -> str:
        """``inside`` a capture no stretches are cut: the whole of it is one."""
        out, plain = [], []

        def flush() -> None:
            if plain:
                if inside:
                    out.extend(plain)
                else:
                    self.group(PLAIN)
                    out.append("(" + "".join(plain) + ")")
                plain.clear()

        for node in nodes:
            if node.branches is None and node.text.startswith("(?"):
                flush()  # a flag counts up to the end of its group, so it stands outside of stretches
                out.append(node.text)
            elif not node.captures:
                plain.append(_bare([[node]]))
            else:
                flush()
                out.append(self.capturing(node, inside))
        flush()
        return "".join(out)

    def capturing(self, node: _Node, inside: bool) -> str:
        """A group with captures. Those of a repeated one are of the last time; the times before are plain text."""
        low, high, lazy = _repeats(node.quant)
        before = ""
        if high is None or high > 1:
            bare = "(?:" if node.name is not None else node.text
            more = "" if high is None else str(high - 1)
            repeated = f"{bare}{_bare(node.branches)}){{{max(0, low - 1)},{more}}}{lazy}"
            if inside:
                before = repeated
            else:
                self.group(PLAIN)
                before = f"({repeated})"
        if node.name is not None:
            self.places.append(self.group(INNER if inside else CAPTURE))
            last = "(" + self.branches(node.branches, True) + ")"
        else:
            last = node.text + self.branches(node.branches, inside) + ")"
        return f"(?:{before}{last})?{lazy}" if low == 0 else before + last


@lru_cache(maxsize=256)
def compile_regex(pattern: str) -> LineRegex:
    tokens = tokenize(pattern)
    names = tuple(t.name or "" for t in tokens if t.kind == "open" and t.name is not None)
    java = "".join(t.text for t in tokens)
    tree, cutter = _tree(tokens), _Cutter()
    cut = cutter.branches(tree, False)
    return LineRegex(pattern, java, names, cut, tuple(cutter.kinds), tuple(cutter.places), len(tree) > 1)


def to_java(pattern: str) -> str:
    """Pattern for rlike / regexp_extract_all, groups numbered."""
    return "(?d)" + compile_regex(pattern).java
