"""Recognition of token streams by memoised derivatives of context-free grammars.

A grammar is a set of rules over hash-consed language nodes. The derivative of a
language by a token is the language of what may follow that token. Every node
remembers its derivatives, so that a parse is a walk along remembered edges and a
new node is only built for a context that was not met before. An empty derivative
marks the token at which the text leaves the language; a last derivative that does
not hold the empty word marks a text that stops too early.

Rules must not be left-recursive: repetition is written with ``*`` and ``+``.
"""

from __future__ import annotations

import re

_TOK, _CAT, _ALT, _STAR, _REF, _BAN, _EPS, _EMPTY = range(8)


class Node:
    __slots__ = ("kind", "a", "b", "null", "d", "n")

    def __init__(self, kind, a, b, null, n):
        self.kind, self.a, self.b, self.null, self.n = kind, a, b, null, n
        self.d: dict = {}


class Grammar:
    """``text`` holds rules ``name = ... ;`` with ``|``, ``*``, ``+``, ``?``, brackets,
    'literal' tokens, UPPERCASE token classes and lower-case rule names; ``x \\ ('a' | 'b')``
    is x unless it begins with one of these tokens.

    ``max_nodes`` bounds the memory of the memo: beyond it all derivatives are
    forgotten and built again when needed; results do not depend on it."""

    def __init__(self, text: str, start: str = "file", max_nodes: int = 400_000):
        self.text, self.start, self.max_nodes = text, start, max_nodes
        self.terminals: set[str] = set()
        self.reset()

    def reset(self) -> None:
        self.nodes: dict = {}
        self.count = 2
        self.empty = Node(_EMPTY, None, None, False, 0)
        self.eps = Node(_EPS, None, None, True, 1)
        self.rules: dict[str, Node] = {}
        for name, body in _rules(self.text):
            self.rules[name] = self._build(body)
        self._nullables()
        self.root = self.rules[self.start]

    # -- construction -------------------------------------------------------
    def _make(self, kind, a, b, null) -> Node:
        key = (kind, a if not isinstance(a, Node) else a.n, b if not isinstance(b, Node) else b.n)
        node = self.nodes.get(key)
        if node is None:
            node = self.nodes[key] = Node(kind, a, b, null, self.count)
            self.count += 1
        return node

    def cat(self, a: Node, b: Node) -> Node:
        if a is self.empty or b is self.empty:
            return self.empty
        if a is self.eps:
            return b
        if b is self.eps:
            return a
        if a.kind == _CAT:  # to the right, so that equal rests are the same node
            return self.cat(a.a, self.cat(a.b, b))
        return self._make(_CAT, a, b, a.null and b.null)

    def alt(self, parts) -> Node:
        flat: dict[int, Node] = {}
        todo = list(parts)
        while todo:
            p = todo.pop()
            if p.kind == _ALT:
                todo.extend(p.a)
            elif p is not self.empty:
                flat[p.n] = p
        if len(flat) > 1:  # common heads and rests are merged: a r | a s is a (r | s), a r | b r is (a | b) r
            for head in (True, False):
                groups: dict[int, list[Node]] = {}
                for p in flat.values():
                    if p.kind == _CAT:
                        groups.setdefault((p.a if head else p.b).n, []).append(p)
                for same in groups.values():
                    if len(same) > 1:
                        for p in same:
                            del flat[p.n]
                        if head:
                            merged = self.cat(same[0].a, self.alt([p.b for p in same]))
                        else:
                            merged = self.cat(self.alt([p.a for p in same]), same[0].b)
                        flat[merged.n] = merged
        if not flat:
            return self.empty
        if len(flat) == 1:
            return next(iter(flat.values()))
        key = tuple(sorted(flat))
        node = self.nodes.get((_ALT, key))
        if node is None:
            kinds = [flat[k] for k in key]
            node = self.nodes[(_ALT, key)] = Node(_ALT, kinds, None, any(p.null for p in kinds), self.count)
            self.count += 1
        return node

    def star(self, a: Node) -> Node:
        return a if a.kind in (_STAR, _EPS) else self._make(_STAR, a, None, True)

    def _build(self, body) -> Node:
        op = body[0]
        if op == "tok":
            self.terminals.add(body[1])
            return self._make(_TOK, body[1], None, False)
        if op == "ref":
            return self._make(_REF, body[1], None, False)
        if op == "cat":
            out = self.eps
            for part in reversed(body[1]):
                out = self.cat(self._build(part), out)
            return out
        if op == "alt":
            return self.alt([self._build(p) for p in body[1]])
        inner = self._build(body[1])
        if op == "ban":
            return self._make(_BAN, inner, body[2], inner.null)
        return {"*": self.star, "+": lambda x: self.cat(x, self.star(x)), "?": lambda x: self.alt([x, self.eps])}[op](inner)

    def _nullables(self) -> None:
        changed = True
        while changed:
            changed = False
            for node in [*self.nodes.values()]:
                k = node.kind
                new = node.null or (
                    (k == _REF and self.rules[node.a].null)
                    or (k == _BAN and node.a.null)
                    or (k == _CAT and node.a.null and node.b.null)
                    or (k == _ALT and any(p.null for p in node.a))
                )
                if new != node.null:
                    node.null, changed = new, True

    # -- derivatives --------------------------------------------------------
    def derive(self, node: Node, t: str) -> Node:
        got = node.d.get(t)
        if got is not None:
            return got
        k = node.kind
        if k == _TOK:
            out = self.eps if node.a == t else self.empty
        elif k == _CAT:
            out = self.cat(self.derive(node.a, t), node.b)
            if node.a.null:
                out = self.alt((out, self.derive(node.b, t)))
        elif k == _ALT:
            out = self.alt([self.derive(p, t) for p in node.a])
        elif k == _STAR:
            out = self.cat(self.derive(node.a, t), node)
        elif k == _REF:
            out = self.derive(self.rules[node.a], t)
        elif k == _BAN:
            out = self.empty if t in node.b else self.derive(node.a, t)
        else:
            out = self.empty
        node.d[t] = out
        return out

    def fresh(self) -> Node:
        """The start language; call it once before each text."""
        if self.count > self.max_nodes:
            self.reset()
        return self.root


_DSL = re.compile(r"\s+|--[^\n]*|('[^']+'|[A-Za-z_]+|[=;|*+?()\\])")


def _rules(text: str):
    toks = [m for m in _DSL.findall(text) if m]
    i = 0
    while i < len(toks):
        name = toks[i]
        if toks[i + 1] != "=":
            raise ValueError(f"rule {name} lacks =")
        body, i = _alt(toks, i + 2)
        if toks[i] != ";":
            raise ValueError(f"rule {name} ends at {toks[i]}")
        yield name, body
        i += 1


def _alt(toks, i):
    parts = []
    while True:
        seq = []
        while toks[i] not in ("|", ")", ";"):
            t = toks[i]
            if t == "(":
                item, i = _alt(toks, i + 1)
                i += 1
            else:
                item = ("tok", t[1:-1]) if t[0] == "'" else ("tok", t) if t.isupper() else ("ref", t)
                i += 1
            while toks[i] in "*+?\\":
                if toks[i] == "\\":
                    end = toks.index(")", i)
                    item = ("ban", item, tuple(x[1:-1] for x in toks[i + 2 : end] if x != "|"))
                    i = end
                else:
                    item = (toks[i], item)
                i += 1
            seq.append(item)
        parts.append(("cat", seq))
        if toks[i] != "|":
            return (parts[0] if len(parts) == 1 else ("alt", parts)), i
        i += 1
