"""Levenshtein automata with weighted confusions of shapes, intersected with a vocabulary trie."""

from __future__ import annotations

#: Cost of a substitution, insertion or deletion of any character, and of a confusion of shapes.
ANY, SHAPE = 2, 1


class Trie:
    """Words with weights; children by character, the weight of a word under the empty string."""

    def __init__(self, words: dict[str, int]):
        self.root: dict = {}
        for w, n in words.items():
            node = self.root
            for c in w:
                node = node.setdefault(c, {})
            node[""] = n


class Shapes:
    """Confusions: a string as read may stand for a string as printed. Single substitutions, splits and merges alike."""

    def __init__(self, pairs: list[tuple[str, str]]):
        self.by_first: dict[str, list[tuple[str, str]]] = {}
        for read, printed in pairs:
            self.by_first.setdefault(read[0], []).append((read, printed))


def candidates(trie: Trie, word: str, shapes: Shapes, budget: int, edits: int = 0) -> list[tuple[str, int, int]]:
    """All words of the lower-case trie that edits of `budget` in all turn into `word`, at most `edits` of them other than
    confusions: (word, least cost, weight).

    Confusions with capitals apply where these may stand: read ones in words that aren't capitals only, printed ones at the
    start or before capitals.

    Walks the product of the automaton of `word` (states: characters consumed, cost, edits) and the trie; a branch dies as
    soon as the trie has no such prefix, so the retrieval is complete without listing spellings.
    """
    n, best = len(word), {}
    low = "".join(x if len(x := c.lower()) == 1 else c for c in word)
    shout = word.isupper()
    spelled = shout and word.isalpha()
    stack, seen = [(trie.root, 0, 0, 0, "")], {}
    while stack:
        node, i, k, e, prefix = stack.pop()
        state = (prefix, i, e)
        if seen.get(state, 99) <= k:
            continue
        seen[state] = k
        if i == n and "" in node and k < best.get(prefix, (99, 0))[0]:
            best[prefix] = (k, node[""])
        if e < edits and k + ANY <= budget:
            for c, child in node.items():
                if c:
                    stack.append((child, i, k + ANY, e + 1, prefix + c))  # one was lost
                    if i < n and c != low[i]:
                        stack.append((child, i + 1, k + ANY, e + 1, prefix + c))
            if i < n:
                stack.append((node, i + 1, k + ANY, e + 1, prefix))  # one came in
        if i == n:
            continue
        c = low[i]
        child = node.get(c)
        if child is not None:
            stack.append((child, i + 1, k, e, prefix + c))
        if k + SHAPE <= budget:
            pairs = shapes.by_first.get(c, ())
            if c != word[i] and not spelled:
                pairs = (*pairs, *shapes.by_first.get(word[i], ()))
            for read, printed in pairs:
                if len(read) == 1 or low.startswith(read, i):
                    if printed.isupper():
                        if i and not shout:
                            continue
                        printed = printed.lower()
                    to = node
                    for p in printed:
                        to = to.get(p)
                        if to is None:
                            break
                    else:
                        stack.append((to, i + len(read), k + SHAPE, e, prefix + printed))
    return [(w, k, weight) for w, (k, weight) in best.items()]
