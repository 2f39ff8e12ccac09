"""Brute-force versions shared by tests."""

from collections import defaultdict

from tagloom.llm import decontaminate as dc


def brute_components(rows):
    """doc_id -> (set size, smallest linked id) by comparing all pairs of sets."""
    sets = {}
    for d, t in rows:
        words = "".join(c.lower() if "A" <= c <= "Z" else " " if c in "\t\n\x0b\x0c\r" else c for c in t or "").split(" ")
        words = [w for w in words if w]
        sets[d] = {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def brute_leaks(docs, items):
    """(doc_id, item_id) of contaminated pairs by comparing every document with every item."""
    codes = dc._TokenCodes()
    of_items = {r["item_id"]: dc.template_windows(r["text"], codes) for r in items}
    out = set()
    for d in docs:
        at, h, values = dc.template_windows(d["text"], codes)
        where = defaultdict(list)
        for i, x in enumerate(h.tolist()):
            where[x].append(i)
        for item, (iat, ih, iv) in of_items.items():
            lines = defaultdict(list)
            for i, x in enumerate(ih.tolist()):
                for j in where.get(x, ()):
                    lines[at[j] - iat[i]].append((i, j))
            found = set()
            for pairs in lines.values():
                slots = {(int(a), int(b)) for i, j in pairs for a, b in zip(iv[i], values[j], strict=True) if a}
                if len({a for a, _ in slots}) == len(slots) == len({b for _, b in slots}):
                    found |= {i for i, _ in pairs}
            if len(ih) and 100 * len(found) >= dc.PERCENT * len(ih):
                out.add((d["doc_id"], item))
    return out
