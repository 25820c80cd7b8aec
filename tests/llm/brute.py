"""Plain single-process versions that the operators are held against."""

import itertools
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    folded = re.sub(r"[A-Z]", lambda m: m[0].lower(), text or "")
    words = WORD.findall(folded)
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def components(rows, threshold=85):
    """rows: (id, text). Sorted (id, n_shingles, component, kept)."""
    sets = [(i, shingles(t)) for i, t in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in itertools.combinations(range(len(sets)), 2):
        a, b = sets[x][1], sets[y][1]
        if a and b and min(len(a), len(b)) * 100 >= threshold * max(len(a), len(b)):
            if 100 * len(a & b) >= threshold * len(a | b):
                root[find(x)] = find(y)
    low = {}
    for x, (i, _) in enumerate(sets):
        r = find(x)
        low[r] = i if low.get(r) is None else low[r] if i is None else min(low[r], i)
    return sorted((i, len(s), low[find(x)], i == low[find(x)]) for x, (i, s) in enumerate(sets))


def statistics(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    text = text or ""
    words = WORD.findall(text)
    windows = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def secret_spans(text):
    """(start, rank, stop) of the named patterns, in order."""
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def entropy_windows(word, window=20):
    """Largest entropy over the windows of a word."""
    import math

    best = 0.0
    for i in range(len(word) - window + 1):
        part = word[i : i + window]
        best = max(best, -sum(part.count(c) / window * math.log2(part.count(c) / window) for c in set(part)))
    return best


def _without_made_up(word):
    """What stays of a word: no folder named by a made-up value, nothing near another mark of one."""
    made_up = ("example", "sample", "dummy", "placeholder", "changeme")
    marks = (*made_up, "x" * 6, "0" * 6, "abcdefgh", "01234567", "12345678")
    kept, folders = [""], word.split("/")
    for i, name in enumerate(folders):
        last = i == len(folders) - 1
        if not last and re.fullmatch("[A-Za-z_-]*", name) and any(m in name.lower() for m in made_up):
            kept.append("")
        else:
            kept[-1] += name if last else name + "/"
    out = []
    for part in kept:
        at = 0
        out.append("")
        while at < len(part):
            ends = [at + n + len(m) for m in marks for n in range(41) if part[at + n : at + n + len(m)].lower() == m]
            if ends:
                at = min(max(ends) + 40, len(part))
                out.append("")
            else:
                out[-1] += part[at]
                at += 1
    return out


def entropy_spans(text, base):
    from lavra.llm import secrets

    out = []
    for m in re.finditer(secrets.CANDIDATE, text or ""):
        if any(a < m.end() and m.start() < b for a, _, b in base) or re.search(secrets.ALLOWED, m[0]):
            continue
        least = secrets.HEX_BITS if re.fullmatch("[0-9a-fA-F]+", m[0]) else secrets.MIXED_BITS
        if any(entropy_windows(w) >= least - 1e-9 for w in _without_made_up(m[0])):
            out.append((m.start(), 3, m.end()))
    return out
