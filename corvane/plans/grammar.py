"""User-defined grammars: rules as text, parse trees as nested tuples."""

from __future__ import annotations

import re


class Grammar:
    """Rules `name = alternative | alternative`, one a line; an alternative is a row of names, 'literals' and /patterns/.

    The first rule is the start. Alternatives are tried in order and results are remembered by place, so parsing takes time
    in proportion to text and rules. A rule may begin with itself in its first alternatives: these grow from the left.
    White space between parts is skipped.
    """

    PART = re.compile(r"\s*(?:'([^']*)'|/((?:[^/\\]|\\.)*)/|([A-Za-z_]\w*))")

    def __init__(self, text: str):
        self.rules: dict[str, list[list[tuple[str, object]]]] = {}
        for line in filter(None, (x.split("#")[0].strip() for x in text.splitlines())):
            name, _, body = line.partition("=")
            self.rules[name.strip()] = [self._alternative(x) for x in re.split(r"\|(?=(?:[^'/]|'[^']*'|/(?:[^/\\]|\\.)*/)*$)", body)]
        self.start = next(iter(self.rules))
        for name in (p for alts in self.rules.values() for alt in alts for kind, p in alt if kind == "rule"):
            if name not in self.rules:
                raise ValueError(f"no rule is named {name}")

    def _alternative(self, text: str) -> list[tuple[str, object]]:
        out, at, text = [], 0, text.rstrip()
        while at < len(text):
            m = self.PART.match(text, at)
            if not m:
                raise ValueError(f"can't read {text[at:]!r}")
            out.append(("literal", m[1]) if m[1] is not None else ("pattern", re.compile(m[2])) if m[2] is not None else ("rule", m[3]))
            at = m.end()
        return out

    def parse(self, text: str) -> tuple:
        """(rule, part, part, ...), parts being texts or such tuples; an error names the farthest place that was reached."""
        self.text, self.known, self.far = text, {}, 0
        found = self._rule(self.start, 0)
        if found is None or self._skip(found[1]) < len(text):
            raise ValueError(f"no parse beyond place {self.far}: {text[self.far : self.far + 20]!r}")
        return found[0]

    def _skip(self, at: int) -> int:
        while at < len(self.text) and self.text[at].isspace():
            at += 1
        return at

    def _rule(self, name: str, at: int):
        key = (name, at)
        if key in self.known:
            return self.known[key]
        self.known[key] = None
        while (found := self._any(name, at)) is not None and (self.known[key] is None or found[1] > self.known[key][1]):
            self.known[key] = found  # the next turn may use this one at its left
            if not any(alt and alt[0] == ("rule", name) for alt in self.rules[name]):
                break
        return self.known[key]

    def _any(self, name: str, at: int):
        for alt in self.rules[name]:
            parts, end = [], at
            for kind, part in alt:
                if kind == "rule":
                    found = self._rule(part, end)
                    if found is None:
                        break
                    parts.append(found[0])
                    end = found[1]
                    continue
                end = self._skip(end)
                self.far = max(self.far, end)
                if kind == "literal":
                    got = part if self.text.startswith(part, end) else None
                else:
                    m = part.match(self.text, end)
                    got = m[0] if m else None
                if got is None:
                    break
                parts.append(got)
                end += len(got)
            else:
                return (name, *parts), end
        return None
