"""An assignment-aware lexer: names and the literals that reach them, in source code and configuration syntax.

One pass over the tokens of a text with a stack of open brackets. Tokens are strings (with prefixes, triple quotes,
templates), names with dots, brackets, operators, line ends, markup elements and bare values of configuration
files. A statement of a bracket level is a target, if an assignment operator has come, and the terms after it:

* `name = value`, `name: value`, `name := value`, `name => value`, quoted names, `x["name"] = value`, type annotations
  and chains of targets;
* literals joined by +, ., .., || or by standing side by side; lists, dictionaries and the arguments of calls give
  alternatives; of a call the first argument is a name and no value if it looks like one and others follow
  (`getenv("NAME", "value")`), and a pair of its own with the second (`define("NAME", "value")`);
* `<name>value</name>`, attributes, and pairs of key (or name) and value beside each other;
* block values of YAML (| and >), here-documents, and values of many lines in triple quotes, line by line.

A name on the right side stands for what it was given last before that, in its scope or those around it, or, where
nothing came before, for what it is given last in the whole text. Scopes are functions and classes, by
indentation, and sections. A bare word that is no known name is a literal if it holds a digit; after a colon a bare
value counts only where the name stands first in its line, as prose has colons too. Comments are read like code: a
secret that is commented out is still out.

Every token is looked at once, and names are links and no copies, so work grows with the text and nothing is limited.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

NAME = r"[A-Za-z_$][A-Za-z0-9_$]*(?:(?:[.\-]|->|::)[A-Za-z0-9_$]+)*"
_NAMED = re.compile(NAME)
_TOKEN = re.compile(
    rf"""(?P<url>[A-Za-z][A-Za-z0-9+.\-]*://[^\s"'<>`]*)
    |(?P<triple>(?P<tp>[bBrRuUfF]{{0,2}})(?P<tq>\"\"\"|''')(?P<tv>.*?)(?P=tq))
    |(?P<string>(?<![A-Za-z0-9_])(?P<sp>[bBrRuUfF@$]{{0,2}})(?:"(?P<s1>(?:[^"\\\n]|\\.)*)"|'(?P<s2>(?:[^'\\\n]|\\.)*)'|`(?P<s3>(?:[^`\\\n]|\\.)*)`)|"(?P<s4>(?:[^"\\\n]|\\.)*)")
    |(?P<element><(?P<en>{NAME})(?:\s[^<>]*)?>(?:<!\[CDATA\[(?P<ec>[^<\]]*)\]\]>|(?P<ev>[^<>]*))</(?P=en)\s*>)
    |(?P<name>{NAME})
    |(?P<number>[0-9][A-Za-z0-9_.]*)
    |(?P<assign>:=|=>|[+.]=(?!=)|=(?![=~])|(?<!:):(?![:/=]))
    |(?P<join>\|\||\.\.|\+|(?<=\s)\.(?=\s)|(?<=["'])\.(?=["'$]))
    |(?P<open>[(\[{{])|(?P<close>[)\]}}])
    |(?P<end>[,;])
    |(?P<line>\\?\r?\n)
    |(?P<other>[=!<>~+\-*/%&|^]+=|[^\s])""",
    re.VERBOSE | re.DOTALL,
)
_BARE = re.compile(r"""[^\s"'`,;(){}\[\]<>#+][^\s"'`,;(){}\[\]<>#]*""")
_REST = re.compile(r"[\x20\t]*(?:[#;,].*)?$", re.MULTILINE)
_BLOCK = re.compile(r"[|>][+\-]?[0-9]?[+\-]?[\x20\t]*(?:\#.*)?\n")
_HERE = re.compile(r"<<[-~]?(?P<q>[\"']?)(?P<word>[A-Za-z_]\w*)(?P=q)[^\n]*\n")
_ALONE = re.compile(r"^[\x20\t]*([A-Za-z_]\w*)[\x20\t]*;?$", re.MULTILINE)
_QUOTED = re.compile(r"[\x20\t]*[bBrRuUfF]{0,2}[\"'`]")
_PREFIXED = re.compile(r"[bBrRuUfF]{1,2}[\"']")
_ATTRIBUTE = re.compile(rf"""({NAME})\s*=\s*(?:"([^"]*)"|'([^']*)')""")
_HEADER = re.compile(r"^[\x20\t]*(?:(?:export|default|public|private|protected|internal|static|async|final|abstract|override|pub|local)\s+)*(?:def|class|function|func|fn|sub|proc|module|namespace|interface|struct|impl)\b|^[\x20\t]*\[[\w .:\-]+\][\x20\t]*$", re.MULTILINE)
_HOLE = re.compile(r"\$?\{([^{}]*)\}")
_TEMPLATE = re.compile(r"\$\{([^{}]*)\}")
_LINE = re.compile(r"[^\n]+")
_PAIR_NAMES = {"key", "name", "id"}


class Expression:
    """The right side of an assignment: places of literals and the expressions behind names, joined in turn."""

    __slots__ = ("known", "open", "options", "parts", "told")

    def __init__(self, parts: list[tuple[int, int] | Expression], options: bool = False):
        self.parts, self.options, self.known, self.open, self.told = parts, options, None, False, False

    def literals(self) -> Iterator[tuple[int, int]]:
        """The places of all its literals, without those that an earlier call has given."""
        waiting = [self]
        while waiting:
            now = waiting.pop()
            if not now.told:
                now.told = True
                for p in now.parts:
                    if isinstance(p, Expression):
                        waiting.append(p)
                    else:
                        yield p


class Assignment(NamedTuple):
    name: str
    value: Expression


class _Term(NamedTuple):
    kind: str  # "text", "name" or "group"
    value: object  # an expression, a name, or the expressions of a group
    start: int
    end: int
    first: bool  # whether it stands first in its line
    key: str = ""  # the string within, as a name


class _Frame:
    __slots__ = ("alternatives", "argument", "before", "first", "joined", "keyed", "kind", "operator", "start", "targets", "terms")

    def __init__(self, kind: str, start: int):
        self.kind, self.start = kind, start
        self.alternatives: list[Expression] = []
        self.argument, self.first, self.keyed = 0, None, False
        self.clear()

    def clear(self) -> None:
        self.targets: list[tuple[str, int]] = []
        self.terms: list[_Term] = []
        self.joined, self.operator = True, ""
        self.before: _Term | None = None


class _Scopes:
    """The scope of every place of a text, by the indentation of headers of functions and classes, and by sections."""

    def __init__(self, text: str):
        self.starts, self.ids, self.parents = [0], [0], [-1]
        headers = {m.start() for m in _HEADER.finditer(text)}
        if not headers:
            return
        stack: list[tuple[int, int]] = []
        section = 0
        for m in _LINE.finditer(text):
            line = m.group()
            body = line.lstrip()
            if not body:
                continue
            indent = len(line) - len(body)
            while stack and indent <= stack[-1][0]:
                stack.pop()
            if m.start() in headers:
                if body.startswith("["):
                    stack, section = [], self._new(0)
                else:
                    stack.append((indent, self._new(stack[-1][1] if stack else section)))
            now = stack[-1][1] if stack else section
            if now != self.ids[-1]:
                self.starts.append(m.start())
                self.ids.append(now)

    def _new(self, parent: int) -> int:
        self.parents.append(parent)
        return len(self.parents) - 1

    def at(self, place: int) -> int:
        return self.ids[bisect_right(self.starts, place) - 1]


class _Reader:
    def __init__(self, text: str):
        self.text, self.scopes = text, _Scopes(text)
        self.given: dict[tuple[int, str], Expression] = {}
        self.waiting: list[tuple[Expression, int, str, tuple[int, int] | None]] = []
        self.found: list[Assignment] = []
        self.ends: dict[str, list[int]] | None = None
        self.beside: tuple[str, int] | None = None  # what a pair's key says, and where it ended

    # names

    def _known(self, scope: int, name: str) -> Expression | None:
        while scope >= 0:
            if (scope, name) in self.given:
                return self.given[scope, name]
            scope = self.scopes.parents[scope]
        return None

    def _refer(self, name: str, start: int, literal: tuple[int, int] | None) -> Expression:
        scope = self.scopes.at(start)
        known = self._known(scope, name)
        if known is not None:
            return known
        later = Expression([])
        self.waiting.append((later, scope, name, literal))
        return later

    def _settle(self) -> None:
        for later, scope, name, literal in self.waiting:
            known = self._known(scope, name)
            if known is None and "." in name:
                known = self._known(scope, name.rpartition(".")[2])
            if known is not None and known is not later:
                later.parts, later.options = [known], known.options
            elif literal is not None and any(c.isdigit() for c in name):
                later.parts = [literal]

    def _assign(self, name: str, place: int, value: Expression) -> None:
        scope = self.scopes.at(place)
        if name.startswith(("self.", "this.")):
            scope = max(0, self.scopes.parents[scope])
        self.given[scope, name] = value
        self.found.append(Assignment(name, value))

    # literals

    def _literal(self, start: int, end: int, template: re.Pattern[str] | None) -> Expression:
        """The inside of a string; names in the holes of a template are followed."""
        if template is None or template.search(self.text, start, end) is None:
            return Expression([(start, end)])
        parts: list[tuple[int, int] | Expression] = []
        at = start
        for m in template.finditer(self.text, start, end):
            parts += [(at, m.start())] if m.start() > at else []
            if _NAMED.fullmatch(m.group(1).strip()):
                parts.append(self._refer(m.group(1).strip(), start, None))
            at = m.end()
        return Expression(parts + ([(at, end)] if end > at else []))

    def _lines(self, start: int, end: int) -> Expression:
        """Literals of many lines: each without the white space around it."""
        parts: list[tuple[int, int] | Expression] = []
        for m in _LINE.finditer(self.text, start, end):
            line = m.group()
            if inner := line.strip():
                at = m.start() + len(line) - len(line.lstrip())
                parts.append((at, at + len(inner)))
        return Expression(parts)

    def _alone(self) -> dict[str, list[int]]:
        """Where lines of one word alone begin: ends of here-documents."""
        if self.ends is None:
            self.ends = {}
            for m in _ALONE.finditer(self.text):
                self.ends.setdefault(m[1], []).append(m.start())
        return self.ends

    # statements

    def _value(self, frame: _Frame) -> list[Expression]:
        """The alternatives of the statement's terms."""
        if len(frame.terms) == 1 and frame.terms[0].kind == "group":
            return frame.terms[0].value
        parts: list[tuple[int, int] | Expression] = []
        for t in frame.terms:
            if t.kind == "name":
                parts.append(self._refer(t.value, t.start, (t.start, t.end) if frame.operator == "=" or frame.targets and t.first else None))
            else:
                parts += t.value if t.kind == "group" else [t.value]
        return [Expression(parts)] if parts else []

    def _finish(self, frame: _Frame) -> None:
        """The end of a statement, argument or element."""
        if frame.targets:
            options = self._value(frame)
            if options:
                value = options[0] if len(options) == 1 else Expression(list(options), True)
                for name, place in frame.targets:
                    self._assign(name, place, value)
                name, place = frame.targets[-1]
                last = frame.terms[-1]
                if name.lower() in _PAIR_NAMES and (said := last.key or last.kind == "name" and last.value):
                    self.beside = said, last.end
                elif name.lower() == "value" and self.beside and place - self.beside[1] < 80 and self.text.count("\n", self.beside[1], place) <= 1:
                    self._assign(self.beside[0], place, value)
                if frame.kind != "{" or frame.keyed:
                    frame.alternatives += options
        elif frame.kind in "([" and frame.terms:
            if frame.argument == 0 and len(frame.terms) == 1 and frame.terms[0].key:
                frame.first = frame.terms[0]
            options = self._value(frame)
            if frame.argument == 1 and frame.first is not None and frame.kind == "(" and options:
                self._assign(frame.first.key, frame.first.start, options[0] if len(options) == 1 else Expression(list(options), True))
            frame.alternatives += options
        frame.clear()

    def _add(self, frame: _Frame, term: _Term) -> None:
        if frame.terms and not frame.joined and not (frame.terms[-1].kind == term.kind == "text"):
            # a statement that nothing ends: another term follows; of two names one may be a type
            before = frame.terms[0] if len(frame.terms) == 1 and not frame.targets and frame.terms[0].kind == term.kind == "name" else None
            self._finish(frame)
            frame.before = before
        frame.terms.append(term)
        frame.joined = False

    def _target(self, frame: _Frame, operator: str) -> bool:
        """Whether the terms so far name what a value is given to."""
        if len(frame.terms) != 1 or frame.joined:
            return False
        term = frame.terms[0]
        name = term.value if term.kind == "name" else term.key
        if not name:
            return False
        if operator == ":" and not (term.first or frame.kind in "({" or term.kind == "text"):
            return False
        if frame.targets and frame.operator == ":" and operator != ":":
            frame.terms = []  # the term was the type of what came before
        else:
            if frame.before is not None and operator == "=":
                frame.targets.append((frame.before.value, frame.before.start))
            frame.targets.append((name, term.start))
            frame.terms, frame.before = [], None
        frame.operator, frame.joined = operator, True
        frame.keyed |= operator in (":", "=>")
        return True

    def read(self) -> list[Assignment]:
        text = self.text
        stack = [_Frame("top", 0)]
        at, fresh = 0, True  # fresh: nothing but marks of a list has come in this line
        while (m := _TOKEN.search(text, at)) is not None:
            kind, start, at = m.lastgroup, m.start(), m.end()
            frame = stack[-1]
            if kind == "line":
                fresh = True
                if frame.kind in ("top", "{") and frame.terms and not frame.joined and not m.group().startswith("\\"):
                    self._finish(frame)
                elif frame.kind in ("top", "{") and frame.targets and not frame.terms and not _QUOTED.match(text, at):
                    frame.clear()
                continue
            if kind == "string":
                inner = next(k for k in ("s1", "s2", "s3", "s4") if m[k] is not None)
                a, b = m.span(inner)
                template = _HOLE if m["sp"] and m["sp"].lower().strip("rb@$") == "f" or m["sp"] == "$" else _TEMPLATE if inner == "s3" else None
                self._add(frame, _Term("text", self._literal(a, b, template), start, at, fresh, m[inner] if _NAMED.fullmatch(m[inner]) else ""))
            elif kind == "triple":
                a, b = m.span("tv")
                self._add(frame, _Term("text", self._lines(a, b), start, at, fresh))
            elif kind == "name":
                if frame.kind in ("top", "{") and fresh and frame.targets and not frame.terms:
                    frame.clear()
                word = m.group()
                if word in ("export", "set", "let", "var", "const", "local", "final", "static") and not frame.targets:
                    continue  # what stands before a target; the line is still fresh
                self._add(frame, _Term("name", word, start, at, fresh))
            elif kind in ("number", "url"):  # where a URL leads to is no secret of itself
                self._add(frame, _Term("text", Expression([(start, at)] if kind == "number" else []), start, at, fresh))
            elif kind == "element":
                a, b = m.span("ec") if m["ec"] is not None else m.span("ev")
                self._finish(frame)
                self._assign(m["en"], start, self._lines(a, b))
                if "=" in text[start:a]:
                    self._attributes(m)
            elif kind == "assign":
                operator = m.group()
                before = list(frame.terms)
                if frame.terms and self._target(frame, operator):
                    if operator in ("+=", ".="):
                        frame.terms, frame.operator = before, "="
                    else:
                        at = self._bare(frame, at, operator)
                elif operator != "=" and frame.kind == "{":
                    self._finish(frame)
                else:
                    frame.clear()
            elif kind == "join":
                if frame.terms:
                    frame.joined = True
            elif kind == "open":
                last = frame.terms[-1] if frame.terms and not frame.joined else None
                near = last is not None and last.end == start
                stack.append(_Frame(m.group() if not (m.group() == "[" and near) else "index", start))
            elif kind == "close":
                self._close(stack, {")": "(", "]": "[index", "}": "{"}[m.group()], at)
            elif kind == "end":
                self._finish(frame)
                frame.argument += 1
            elif m.group() not in "-*@#/" or not fresh:
                if frame.targets and frame.terms or not frame.targets:
                    self._finish(frame)
                if m.group() == "<" and frame.targets and (h := _HERE.match(text, start)) is not None:
                    ends = self._alone().get(h["word"], [])
                    if (i := bisect_right(ends, h.end() - 1)) < len(ends):
                        frame.terms = [_Term("text", self._lines(h.end(), ends[i]), start, ends[i], False)]
                        at = _ALONE.match(text, ends[i]).end()
                        self._finish(frame)
                continue
            else:
                continue  # the mark of a list or a comment before the first name
            fresh = False
        while stack:
            self._finish(stack.pop())
        self._settle()
        return self.found

    def _attributes(self, m: re.Match[str]) -> None:
        """The attributes of a markup element with a value."""
        head = self.text[m.start() : m.start("ec") if m["ec"] is not None else m.start("ev")]
        for attribute in _ATTRIBUTE.finditer(head):
            inner = 2 if attribute[2] is not None else 3
            a, b = attribute.span(inner)
            self._assign(attribute[1], m.start(), Expression([(m.start() + a, m.start() + b)]))
            if attribute[1].lower() in _PAIR_NAMES and _NAMED.fullmatch(attribute[inner]):
                a, b = m.span("ec") if m["ec"] is not None else m.span("ev")
                self._assign(attribute[inner], m.start(), self._lines(a, b))

    def _bare(self, frame: _Frame, at: int, operator: str) -> int:
        """After an assignment operator: a block or a bare value, if there is one; where reading goes on."""
        text = self.text
        while text[at : at + 1] in (" ", "\t"):
            at += 1
        if operator == ":" and (m := _BLOCK.match(text, at)) is not None:
            key = text.rfind("\n", 0, frame.targets[-1][1]) + 1
            indent = len(text[key : frame.targets[-1][1]]) - len(text[key : frame.targets[-1][1]].lstrip("\x20\t"))
            end = m.end()
            for line in _LINE.finditer(text, end):
                body = line.group().lstrip("\x20\t")
                if body and len(line.group()) - len(body) <= indent:
                    break
                end = line.end()
            frame.terms = [_Term("text", self._lines(m.end(), end), at, end, False)]
            self._finish(frame)
            return end
        m = _BARE.match(text, at)
        if m is None or _PREFIXED.match(text, at) or m.group()[0] in "|&*!?" or "://" in m.group():
            return at
        word = m.group()
        named = _NAMED.fullmatch(word) is not None
        if named or text[m.end() : m.end() + 1] in ("(", "["):
            if not named or operator == ":" and frame.kind == "top" and _REST.match(text, m.end()) is None:
                return at  # code, or words of prose
            if text[m.end() : m.end() + 1] in ("(", "["):
                return at
            frame.terms.append(_Term("name", word, at, m.end(), operator == ":"))
            frame.joined = False
            return m.end()
        if operator == ":" and frame.kind == "top" and _REST.match(text, m.end()) is None:
            frame.clear()  # prose
            return m.end()
        frame.terms.append(_Term("text", Expression([m.span()]), at, m.end(), False))
        frame.joined = False
        return m.end()

    def _close(self, stack: list[_Frame], kinds: str, at: int) -> None:
        if not any(f.kind in kinds for f in stack[:0:-1][:1]):
            if not any(f.kind != "top" and f.kind in kinds for f in stack[-4:]):
                return  # one that closes nothing near
            while stack[-1].kind not in kinds:
                self._finish(stack.pop())
        frame = stack.pop()
        key = frame.terms[0].key if frame.kind == "index" and len(frame.terms) == 1 else ""
        self._finish(frame)
        outer = stack[-1]
        last = outer.terms[-1] if outer.terms and not outer.joined else None
        if frame.kind == "index":
            if last is not None:
                outer.terms[-1] = _Term("group" if key else last.kind, [] if key else last.value, last.start, at, last.first, key)
            return
        called = frame.kind == "(" and last is not None and last.kind == "name" and last.end == frame.start
        options = frame.alternatives
        if called:
            outer.terms.pop()
            if frame.first is not None and frame.argument >= 1:
                options = options[1:]
            elif frame.first is not None and re.search(r"(?i)(?:env|get|getproperty|property|lookup|fetch|read|param|config)$", last.value):
                options = []
        elif outer.terms and not outer.joined:
            self._finish(outer)
        if frame.kind != "{" or outer.targets or outer.kind in "([":
            outer.terms.append(_Term("group", options, frame.start, at, False))
            outer.joined = False


def assignments(text: str) -> list[Assignment]:
    """Every name that is given a value, in order, with the expression behind it."""
    return _Reader(text).read()
