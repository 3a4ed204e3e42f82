"""A word-end BPE vocabulary compiled into a deterministic transducer.

A sequence of tokens is what BPE makes of a word exactly if BPE leaves each two neighbours alone,
and every prefix of a word has one last token that fits so. So reading a symbol can change only
tokens within the longest suffix that begins some token. The automaton walks the trie of the
vocabulary with failure links; its state is the trie node together with, for every place within
that suffix, the last token there and how many tokens less stand before it. A transition carries
the change in emitted tokens (which may be zero or negative, as when letters merge); the last
symbol of a word has a sign of its own and leads back to the start. States are compiled when they
are first reached and kept up to ``MOST_STATES``, then compiled anew.
"""

from __future__ import annotations

import json

from .bpe import byte_alphabet

MOST_STATES = 120_000
START = 0
_END = 256  # added to the last byte of a word


class Transducer:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        byte_of = {sign: b for b, sign in enumerate(byte_alphabet())}
        self.rank: dict[int, tuple[int, int]] = {}
        for n, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[vocab[a] << 20 | vocab[b]] = n, vocab[a + b]
        self.base = [vocab[s] for s in byte_alphabet()] + [vocab[s + end] for s in byte_alphabet()]
        self.spell: dict[int, tuple[int, ...]] = {}
        for text, token in vocab.items():
            whole = text.endswith(end) and text != end
            signs = [byte_of.get(c) for c in (text[: -len(end)] if whole else text)]
            if None not in signs and signs:
                spelt = (*signs[:-1], signs[-1] + _END * whole)
                if self.merged(spelt) == [token]:  # others are never emitted
                    self.spell[token] = spelt
        self._compile()
        self.fits_memo: dict[int, bool] = {}
        self._empty()

    def _compile(self) -> None:
        """The trie of all tokens with failure links, and from each node the nearest suffix that is a token."""
        child: dict[int, int] = {}
        token, depth, parent, sign = [-1], [0], [0], [0]
        for t, spelt in self.spell.items():
            node = 0
            for d, c in enumerate(spelt, 1):
                key = node << 9 | c
                if key not in child:
                    child[key] = len(token)
                    token.append(-1)
                    depth.append(d)
                    parent.append(node)
                    sign.append(c)
                node = child[key]
            token[node] = t
        fail, link = [0] * len(token), [0] * len(token)
        for node in sorted(range(1, len(token)), key=depth.__getitem__):
            f = fail[parent[node]]
            while parent[node] and (f << 9 | sign[node]) not in child and f:
                f = fail[f]
            if parent[node]:
                fail[node] = child.get(f << 9 | sign[node], 0)
            link[node] = fail[node] if token[fail[node]] >= 0 else link[fail[node]]
        self.child, self.fail, self.link, self.token, self.depth = child, fail, link, token, depth

    def _empty(self) -> None:
        first = (0, ((-1, 0),))
        self.states, self.number = [first], {first: START}
        self.moves: dict[int, int] = {}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("states", "number", "moves", "fits_memo")}

    def __setstate__(self, state):
        self.__dict__ |= state
        self.fits_memo = {}
        self._empty()

    def merged(self, symbols) -> list[int]:
        """BPE by its definition: the earliest learnt pair first, from the left."""
        out = [self.base[s] for s in symbols]
        while len(out) > 1:
            found = [(self.rank[k][0], i) for i in range(len(out) - 1) if (k := out[i] << 20 | out[i + 1]) in self.rank]
            if not found:
                break
            _, i = min(found)
            out[i : i + 2] = [self.rank[out[i] << 20 | out[i + 1]][1]]
        return out

    def fits(self, a: int, b: int) -> bool:
        """Whether BPE leaves token b behind token a as it is."""
        key = a << 20 | b
        got = self.fits_memo.get(key)
        if got is None:
            if len(self.fits_memo) > 8 * MOST_STATES:
                self.fits_memo.clear()
            got = self.fits_memo[key] = self.merged(self.spell[a] + self.spell[b]) == [a, b]
        return got

    def move(self, state: int, symbol: int) -> int:
        """The transition: the next state << 8 | the change in emitted tokens + 128."""
        node, window = self.states[state]
        child = self.child
        while (node << 9 | symbol) not in child and node:
            node = self.fail[node]
        node = child.get(node << 9 | symbol, 0)
        at = node if self.token[node] >= 0 else self.link[node]
        while True:
            before, fewer = window[-self.depth[at]]
            if before < 0 or self.fits(before, self.token[at]):
                break
            at = self.link[at]
        more = fewer + 1
        if symbol >= _END:
            to = START
        else:
            kept = window[-self.depth[node] :] if self.depth[node] else ()
            new = (node, (*((t, n - more) for t, n in kept), (self.token[at], 0)))
            if len(self.states) >= MOST_STATES:
                self._empty()
                state = -1  # its number is gone
            to = self.number.get(new)
            if to is None:
                to = self.number[new] = len(self.states)
                self.states.append(new)
        if state >= 0:
            self.moves[state << 9 | symbol] = to << 8 | more + 128
        return to << 8 | more + 128

    def emitted(self, word: bytes) -> int:
        """Tokens of one word (a piece between the library's cuts)."""
        if not word:
            return 0
        moves, state, total = self.moves, START, 0
        for symbol in word[:-1]:
            got = moves.get(state << 9 | symbol)
            if got is None:
                got = self.move(state, symbol)
                moves = self.moves
            state = got >> 8
            total += (got & 255) - 128
        got = moves.get(state << 9 | word[-1] | _END)
        if got is None:
            got = self.move(state, word[-1] | _END)
        return total + (got & 255) - 128
