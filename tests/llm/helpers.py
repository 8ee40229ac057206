"""Brute-force versions of the operators, in plain Python."""

import re
from collections import defaultdict

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def smallest_reachable(ids, links):
    top = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(top[a], top[b])
            if top[a] != low or top[b] != low:
                top[a] = top[b] = low
                changed = True
    return top


def near_groups(texts, percent=75):
    """{id: smallest id reachable} for {id: text}."""
    sets = {i: shingle_set(t) for i, t in texts.items()}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return smallest_reachable(ids, links)


def without_repeats(texts):
    """{id: text} with the lines of later occurrences of three-line windows cut out."""
    seen, gone = {}, defaultdict(set)
    for i in sorted(texts):
        lines = (texts[i] or "").split("\n")
        full = [k for k, line in enumerate(lines) if line.strip(" ")]
        for at in range(len(full) - 2):
            cover = full[at : at + 3]
            window = tuple(lines[k].strip(" ") for k in cover)
            if window in seen:
                gone[i].update(cover)
            else:
                seen[window] = i
    return {i: t if i not in gone else "\n".join(line for k, line in enumerate(t.split("\n")) if k not in gone[i]) for i, t in texts.items()}


def plain_words(text):
    return [w for w in re.split(r"[^\w]+|_", (text or "").lower()) if w]


def contained(texts, items, percent=75):
    """{(id, item)} by exact containment of the item's distinct shingles."""
    out = set()
    for item, text in items.items():
        words = plain_words(text)
        n = min(5, len(words))
        want = {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if words else set()
        for i, doc in texts.items():
            have = plain_words(doc)
            if want and 100 * len(want & {tuple(have[k : k + n]) for k in range(len(have) - n + 1)}) >= percent * len(want):
                out.add((i, item))
    return out
