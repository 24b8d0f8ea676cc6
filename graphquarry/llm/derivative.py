"""Parsing with derivatives, memoised: recursive grammars over token streams."""

from __future__ import annotations


class Grammar:
    """Languages as hash-consed nodes: an alternative, sequence or repetition that was made before is the same node.

    ``derive`` takes the derivative by a token and remembers it per node and token, so a grammar turns into a lazily
    built automaton as far as its states recur. Sharing and the laws of the empty language, of the empty word and of
    repeated alternatives keep the nodes few; beyond ``limit`` nodes the memory starts afresh from the grammar.
    """

    def __init__(self, limit: int = 200_000):
        self.limit = limit
        self.rules: dict[str, int] = {}
        self.reset()

    def reset(self) -> None:
        self.nodes: list[tuple] = []
        self.index: dict[tuple, int] = {}
        self.memo: dict[tuple[int, str], int] = {}
        self._nullable: dict[int, bool] = {}
        self.none = self._node(("none",))
        self.empty = self._node(("empty",))

    def _node(self, key: tuple) -> int:
        at = self.index.get(key)
        if at is None:
            at = self.index[key] = len(self.nodes)
            self.nodes.append(key)
        return at

    def tok(self, *names: str) -> int:
        """One token of any of these names."""
        return self._node(("tok", frozenset(names)))

    def any(self) -> int:
        return self._node(("any",))

    def seq(self, *parts: int) -> int:
        out = self.empty
        for p in reversed(parts):
            if p == self.none or out == self.none:
                return self.none
            if p == self.empty:
                continue
            if out == self.empty:
                out = p
            elif self.nodes[p][0] == "seq":  # to the right, so that equal sequences are equal nodes
                out = self.seq(self.nodes[p][1], self.seq(self.nodes[p][2], out))
            else:
                out = self._node(("seq", p, out))
        return out

    def alt(self, *parts: int) -> int:
        flat: set[int] = set()
        for p in parts:
            if self.nodes[p][0] == "alt":
                flat |= self.nodes[p][1]
            elif p != self.none:
                flat.add(p)
        if not flat:
            return self.none
        return next(iter(flat)) if len(flat) == 1 else self._node(("alt", frozenset(flat)))

    def star(self, part: int) -> int:
        return self.empty if part in (self.none, self.empty) else self._node(("star", part))

    def opt(self, part: int) -> int:
        return self.alt(part, self.empty)

    def ref(self, name: str) -> int:
        """A rule by name; set it in ``rules``."""
        return self._node(("ref", name))

    def nullable(self, node: int) -> bool:
        """Whether the language holds the empty word: the least fixed point over the rules."""
        known = self._nullable.get(node)
        if known is not None:
            return known
        seen: list[int] = []
        stack, seen_set = [node], set()
        while stack:
            n = stack.pop()
            if n in seen_set:
                continue
            seen_set.add(n)
            seen.append(n)
            stack += self._parts(n)
        value = dict.fromkeys(seen, False)
        changed = True
        while changed:
            changed = False
            for n in reversed(seen):
                if not value[n] and self._null_of(n, value):
                    value[n] = changed = True
        self._nullable.update(value)
        return value[node]

    def _parts(self, n: int) -> list[int]:
        key = self.nodes[n]
        if key[0] == "alt":
            return list(key[1])
        if key[0] == "seq":
            return [key[1], key[2]]
        return [self.rules[key[1]]] if key[0] == "ref" else []

    def _null_of(self, n: int, value: dict[int, bool]) -> bool:
        key = self.nodes[n]
        match key[0]:
            case "empty" | "star":
                return True
            case "alt":
                return any(value[p] for p in key[1])
            case "seq":
                return value[key[1]] and value[key[2]]
            case "ref":
                return value[self.rules[key[1]]]
        return False

    def derive(self, node: int, token: str) -> int:
        """What may follow ``token`` in the language; left recursion is not supported."""
        got = self.memo.get((node, token))
        if got is not None:
            return got
        key = self.nodes[node]
        match key[0]:
            case "tok":
                out = self.empty if token in key[1] else self.none
            case "any":
                out = self.empty
            case "alt":
                out = self.alt(*[self.derive(p, token) for p in sorted(key[1])])
            case "star":
                out = self.seq(self.derive(key[1], token), node)
            case "ref":
                out = self.derive(self.rules[key[1]], token)
            case "seq":
                out = self.seq(self.derive(key[1], token), key[2])
                if self.nullable(key[1]):
                    out = self.alt(out, self.derive(key[2], token))
            case _:
                out = self.none
        self.memo[node, token] = out
        return out


class Parser:
    """Runs a grammar made by ``build(grammar) -> start node`` over token streams."""

    def __init__(self, build, limit: int = 200_000):
        self.build, self.grammar = build, Grammar(limit)
        self.start = build(self.grammar)

    def run(self, tokens) -> tuple[int | None, bool]:
        """(index of the token at which no derivative is left, or None; whether the end may come here)."""
        g = self.grammar
        if len(g.nodes) > g.limit:
            g.reset()
            self.start = self.build(g)
        state = self.start
        for k, t in enumerate(tokens):
            state = g.derive(state, t)
            if state == g.none:
                return k, False
        return None, g.nullable(state)
