"""Plain versions of two stages, for small tables."""

from collections import Counter


def brute_lines(texts, least=10):
    """Of lines in ten or more documents only the one in the smallest id stays; emptied documents go."""
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").lower()
    n, first = Counter(), {}
    for i in sorted(texts):
        for k in {key(x) for x in texts[i].split("\n")} - {""}:
            n[k] += 1
            first.setdefault(k, i)
    out = {}
    for i, t in texts.items():
        lines = t.split("\n")
        kept = [x for x in lines if n[key(x)] < least or first[key(x)] == i]
        if len(kept) == len(lines) or any(x.strip() for x in kept):
            out[i] = "\n".join(kept)
    return out


def shingles(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def components_of(texts):
    """The smallest id reachable by links: sets of five-word shingles with a similarity of 0.8 or more."""
    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}
