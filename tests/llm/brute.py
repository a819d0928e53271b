"""Plain versions of the operators, one row at a time, for small inputs."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import xxhash

BLANK = re.compile(r"[^\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def fingerprint(text: str | None, shingle: int) -> int:
    words = BLANK.findall((text or "").translate(FOLD))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints: list[int], radius: int) -> list[int]:
    """A group number for each fingerprint."""
    root = list(range(len(prints)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def near_duplicates(rows: list[tuple[int | None, str | None]], shingle: int, radius: int) -> list[tuple]:
    prints = [fingerprint(t, shingle) for _, t in rows]
    group = groups(prints, radius)
    smallest: dict[int, int] = {}
    for (doc, _), g in zip(rows, group, strict=True):
        if doc is not None:
            smallest[g] = min(doc, smallest.get(g, doc))
    return [(doc, f"{p:016x}", smallest.get(g)) for (doc, _), p, g in zip(rows, prints, group, strict=True)]


def contamination(text: str | None, items: list[tuple[int | None, str | None]], window: int) -> tuple[int, set[int], set]:
    """Words, hit places, items."""
    words, hit, named = WORD.findall((text or "").translate(FOLD)), set(), set()
    at = defaultdict(list)
    for item, content in items:
        own = WORD.findall((content or "").translate(FOLD))
        size = min(window, len(own))
        for i in range(len(own) - size + 1 if own else 0):
            at[tuple(own[i : i + size])].append(item)
    for size in {len(w) for w in at}:
        for i in range(len(words) - size + 1):
            if found := at.get(tuple(words[i : i + size])):
                hit.update(range(i, i + size))
                named.update(x for x in found if x is not None)
    return len(words), hit, named


def repeated(rows: list[tuple[int | None, str | None]], least: int) -> Counter:
    """(doc_id, start, end) of stretches covered by passages that different documents share."""
    documents = {(d, t or ""): BLANK.findall(t or "") for d, t in rows}
    owners = defaultdict(set)
    for key, words in documents.items():
        for i in range(len(words) - least + 1):
            owners[tuple(words[i : i + least])].add(key)
    out: Counter = Counter()
    for key, words in documents.items():
        end = start = -1
        for i in range(len(words) - least + 1):
            if len(owners[tuple(words[i : i + least])]) > 1:
                if i > end:
                    if end > 0:
                        out[key[0], start, end] += 1
                    start = i
                end = i + least
        if end > 0:
            out[key[0], start, end] += 1
    return out


def without_later_copies(rows: list[tuple[int | None, str | None]], least: int) -> list[str | None]:
    """The texts without later occurrences of passages that several documents have; ids are in order and told apart by id."""
    documents = {(d, t or ""): BLANK.findall(t or "") for d, t in rows}
    places = defaultdict(list)
    for key in sorted(documents, key=lambda k: (k[0] is not None, k[0] or 0)):
        for i in range(len(documents[key]) - least + 1):
            places[tuple(documents[key][i : i + least])].append((key, i))
    gone = defaultdict(set)
    for at in places.values():
        if len({key for key, _ in at}) > 1:
            for key, i in at[1:]:
                gone[key].update(range(i, i + least))
    out: list[str | None] = []
    for d, t in rows:
        cut, pieces = gone[d, t or ""], re.findall(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", t or "")
        head = re.match(r"[\x20\x09-\x0D]*", t or "").group()
        out.append(head + "".join(p for i, p in enumerate(pieces) if i not in cut) if cut else t)
    return out


def statistics(text: str | None) -> tuple[int, int, int, int, int]:
    text = text or ""
    words = BLANK.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if BLANK.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            covered.update((i, i + 1, i + 2))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def without_boilerplate(rows: list[tuple[str | None, str | None]], ratio: float, least: int) -> list[str | None]:
    """(site, text) rows."""
    bare = lambda line: line.strip(" \t\n\v\f\r")
    pages, holding = Counter(s for s, _ in rows), Counter()
    for site, text in rows:
        holding.update({(site, bare(x)) for x in (text or "").split("\n")} - {(site, "")})
    gone = {k for k, n in holding.items() if n >= least and n > pages[k[0]] * ratio}
    return [None if t is None else "\n".join(x for x in t.split("\n") if (s, bare(x)) not in gone) for s, t in rows]
