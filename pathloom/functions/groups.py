"""Places of a regex's groups: the same regex with all text between its groups captured.

Spark gives the text of a group but not where it stands.  Once every piece of a match is in
some group, a group starts where the pieces before it end.
"""

from __future__ import annotations

import re

_ATOM = re.compile(r"\\Q.*?(?:\\E|$)|\\[1-9][0-9]?|\\[pPxu]\{[^}]*\}|\\.|[^\\]", re.S)
_QUANTIFIER = re.compile(r"(?:[*+?]|\{[0-9]+(?:,[0-9]*)?\})[+?]?")
_OPENING = re.compile(r"\((?:\?(?:<[A-Za-z][A-Za-z0-9]*>|[:=!>]|<[=!]|[a-zA-Z-]+:|[a-zA-Z-]+\)))?")
Terms = list[tuple[int, int]]


class _Rewriter:
    def __init__(self, pattern: str):
        self.text, self.at = pattern, 0
        self.count = 0  # groups of the regex that is asked
        self.old = 0  # groups of the given one
        self.number: dict[int, int] = {}
        self.places: dict[int, tuple[int, Terms]] = {}

    def fresh(self) -> int:
        self.count += 1
        return self.count

    def character_class(self) -> str:
        """From [ to its ], nested ones included."""
        start, depth = self.at, 0
        while self.at < len(self.text):
            c = self.text[self.at]
            self.at += 2 if c == "\\" else 1
            depth += (c == "[") - (c == "]")
            if depth == 0:
                break
        return self.text[start : self.at]

    def quantifier(self) -> str:
        m = _QUANTIFIER.match(self.text, self.at)
        self.at = m.end() if m else self.at
        return m[0] if m else ""

    def has_groups(self) -> bool:
        """Whether the group that starts here holds a capturing one."""
        probe = _Rewriter(self.text)
        probe.at = _OPENING.match(self.text, self.at).end()
        probe.body([], False)
        return probe.old > 0

    def skip_group(self) -> str:
        probe = _Rewriter(self.text)
        probe.at = _OPENING.match(self.text, self.at).end()
        probe.body([], False)
        start, self.at = self.at, probe.at + 1
        return self.text[start : self.at]

    def body(self, base: Terms, repeated: bool) -> tuple[str, Terms]:
        """Alternatives up to the closing bracket.  ``base``: what a group's place is counted
        from; returns the rewritten text and the pieces whose lengths add up to all of it."""
        out, every = [], []
        first = True
        while True:
            text, pieces = self.sequence(base)
            out.append(text)
            every += pieces
            if self.at >= len(self.text) or self.text[self.at] == ")":
                break
            if repeated and (pieces or not first):
                raise ValueError("groups in alternatives that are repeated have no certain place")
            first = False
            self.at += 1
        return "|".join(out), every

    def sequence(self, base: Terms) -> tuple[str, Terms]:
        out: list[str] = []
        pieces: Terms = []
        run = ""

        def close() -> None:
            nonlocal run
            if run:
                k = self.fresh()
                out.append(f"({run})")
                pieces.append((k, 1))
                run = ""

        while self.at < len(self.text) and self.text[self.at] not in ")|":
            c = self.text[self.at]
            if c == "[":
                run += self.character_class() + self.quantifier()
            elif c != "(":
                atom = _ATOM.match(self.text, self.at)[0]
                self.at += len(atom)
                if re.fullmatch(r"\\[1-9][0-9]?", atom):
                    atom = "\\" + str(self.number.get(int(atom[1:]), 0)) + "(?:)"
                run += atom + self.quantifier()
            else:
                opening = _OPENING.match(self.text, self.at)[0]
                if opening.endswith(")") and opening != "(":  # flags for what follows
                    close()
                    self.at += len(opening)
                    out.append(opening)
                    continue
                capturing = opening == "(" or opening.startswith("(?<") and opening[3] not in "=!"
                if not capturing and not self.has_groups():
                    run += self.skip_group() + self.quantifier()
                    continue
                if opening[:3] in ("(?=", "(?!") or opening[:4] in ("(?<=", "(?<!"):
                    raise ValueError("groups in a look-around have no place in the match")
                close()
                self.group(opening, capturing, base, out, pieces)
        close()
        return "".join(out), pieces

    def group(self, opening: str, capturing: bool, base: Terms, out: list[str], pieces: Terms) -> None:
        end, plain = self.closing(), not self.has_groups()
        m = _QUANTIFIER.match(self.text, end + 1)
        repeated = bool(m)
        total = self.fresh() if repeated else 0
        own = old = 0
        if capturing:
            self.old += 1
            old, own = self.old, self.fresh()
            self.number[old] = own
        within = self.text[self.at + len(opening) : end]
        self.at += len(opening)
        start = [*base, *pieces]
        if repeated:  # what is captured is of the last turn, which ends where all turns end
            start += [(total, 1)]
        if capturing:
            start_own = [*start, (own, -1)] if repeated else start
            self.places[old] = (own, start_own)
            if plain:
                inner, self.at = within, end
            else:
                inner, _ = self.body(start_own, repeated)
        elif not repeated:
            inner, held = self.body(start, False)
        else:
            mark = len(self.places)
            inner, held = self.body([], True)
            back = [(k, -s) for k, s in held]
            for g in list(self.places)[mark:]:
                number, terms = self.places[g]
                self.places[g] = (number, [*start, *back, *terms])
        self.at += 1
        quantifier = self.quantifier()
        if repeated:
            out.append(f"({opening}{inner}){quantifier})")
            pieces.append((total, 1))
        else:
            out.append(f"{opening}{inner})")
            pieces.extend([(own, 1)] if capturing else held)

    def closing(self) -> int:
        probe = _Rewriter(self.text)
        probe.at = self.at
        probe.skip_group()
        if probe.at > len(self.text):
            raise ValueError(f"unmatched bracket in {self.text}")
        return probe.at - 1


def captured(pattern: str) -> tuple[str, dict[int, tuple[int, Terms]]]:
    """The rewritten regex, and for each group of the given one its number there and the groups
    whose lengths, with their signs, add up to its start."""
    r = _Rewriter(pattern)
    text, _ = r.body([], False)
    if r.at < len(pattern):
        raise ValueError(f"unmatched bracket in {pattern}")
    return text, r.places
