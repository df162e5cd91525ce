"""Plain versions of the operators, for small tables."""

import re


def shingle_set(text, n=5):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", low) if x]
    if not w:
        return frozenset()
    if len(w) < n:
        return frozenset([tuple(w)])
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1))


def jaccard_components(rows, percent=75):
    """doc_id -> (n_shingles, component_id), comparing all pairs that share a shingle."""
    sets = {d: shingle_set(t) for d, t in rows}
    where = {}
    for d, s in sets.items():
        for g in s:
            where.setdefault(g, []).append(d)
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    done = set()
    for d, s in sets.items():
        for o in {o for g in s for o in where[g] if o < d}:
            if (o, d) not in done:
                done.add((o, d))
                both = len(s & sets[o])
                if 100 * both >= percent * (len(s) + len(sets[o]) - both):
                    a, b = find(o), find(d)
                    root[max(a, b)] = min(a, b)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def base_spans(text):
    """(kind, start, end) by kind and start."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((0, *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append((1, *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()][::-1]
        if 16 <= len(d) <= 19 and sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0:
            out.append((2, *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= sum(c in "0123456789" for c in m.group()) <= 15:
            out.append((3, *m.span()))
    return sorted(out)


def quality_base(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    text = text or ""
    split = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
    w = split(text)
    seen = {}
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if split(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def repeated_bytes(rows, length=200):
    """doc_id -> (n_bytes, removed runs), looking at all windows."""
    seen, out = {}, {}
    raw = {d: (t or "").encode() for d, t in rows}
    for d, b in raw.items():
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            seen[w] = 2 if w in seen else 1
    for d, b in raw.items():
        runs = []
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                if runs and i <= runs[-1][1]:
                    runs[-1][1] = i + length
                else:
                    runs.append([i, i + length])
        out[d] = (len(b), [tuple(r) for r in runs])
    return out
