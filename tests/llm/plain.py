"""The pipeline's stages in plain Python, one row at a time, for small fixtures."""

import re
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile("[^\\x20\\x09-\\x0D]+")
WHITE = re.compile("[\\x20\\x09-\\x0D]+")


def words_of(text):
    return WORD.findall(text or "")


def base_of(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = words_of(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    symbols = len(re.findall("[#*$%&|<>]", text or ""))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def ratio_scores(rows, trusted):
    """The mean log ratio of each text's hashed 4-byte n-grams, with counters."""

    def buckets(text):
        raw = (text or "").encode()
        return [((int.from_bytes(raw[i : i + 4], "little") * 0x9E3779B1) & 0xFFFFFFFF) >> 16 for i in range(len(raw) - 3)]

    raw = Counter(b for _, t, *_ in rows for b in buckets(t))
    target = Counter(b for i, t, *_ in rows if i in trusted for b in buckets(t))

    def log(counts, b):
        return np.log((counts[b] + 0.5) / (sum(counts.values()) + 0.5 * 65536))

    weight = {b: log(target, b) - log(raw, b) for b in raw}
    return [np.mean([weight[b] for b in buckets(t)]) if buckets(t) else 0.0 for _, t, *_ in rows]


def well_made(rows, trusted, threshold):
    kept = []
    for row, score in zip(rows, ratio_scores(rows, trusted), strict=True):
        n_words, _, _, _, repeated = base_of(row[1])
        if n_words >= 50 and 100 * repeated <= 50 * n_words and score >= threshold:
            kept.append(row)
    return kept


def first_of(rows, group):
    """The row of the smallest id (null last) of each group."""
    best = {}
    for place, row in enumerate(rows):
        key, order = group[place], (row[0] is None, row[0] or 0, place)
        if key not in best or order < best[key][0]:
            best[key] = order, row
    return [row for _, row in best.values()]


def exact_firsts(rows):
    return first_of(rows, [WHITE.sub(" ", t or "") for _, t, *_ in rows])


def near_firsts(rows):
    sets = [frozenset(zip(*(words_of(t)[k:] for k in range(5)))) for _, t, *_ in rows]
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 5 * len(a & sets[j]) >= 4 * len(a | sets[j]) and label[i] != label[j]:
                label = [label[j] if x == label[i] else x for x in label]
    return first_of(rows, label)


SECRETS = (
    (re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 8),
    (re.compile("(AKIA[A-Z0-9]+)"), 16),
    (re.compile("([0-9a-f]{32,})"), 32),
    (re.compile("([A-Za-z0-9+/_=-]{24,})"), 24),
)


def without_secrets(rows, mark="[SECRET]"):
    """Rows (id, text, source) with the spans of values that fewer than three sources hold replaced."""
    spans, owners = [], defaultdict(set)
    for _, text, source in rows:
        mine = []
        for kind, (pattern, least) in enumerate(SECRETS):
            for m in pattern.finditer(text or ""):
                value = m[1]
                mixed = all(re.search(p, value) for p in ("[a-z]", "[A-Z]", "[0-9]"))
                if len(value) >= least and (kind < 3 or mixed):
                    mine.append((m.start(), m.end(), value))
                    owners[value].add(source)
        spans.append(mine)
    cleaned = []
    for (doc_id, text, source), mine in zip(rows, spans, strict=True):
        islands = []
        for start, end, value in sorted(mine):
            if len(owners[value]) >= 3:
                continue
            if islands and start < islands[-1][1]:
                islands[-1][1] = max(islands[-1][1], end)
            else:
                islands.append([start, end])
        for start, end in reversed(islands):
            text = text[:start] + mark + text[end:]
        cleaned.append((doc_id, text, source))
    return cleaned


def best_fit(lengths, sizes, cost):
    """Bins (opened size, words) of best-fit decreasing, item by item; the size to open is chosen once per length.

    Which of several bins with equal room takes a piece is open, so only the rooms are fixed.
    """
    counts, bins, chosen = Counter(lengths), [], {}
    waiting = Counter(lengths)
    for length in sorted(lengths, reverse=True):
        fits = [b for b in bins if b[0] - b[1] >= length]
        if fits:
            best = min(fits, key=lambda b: b[0] - b[1])
        else:
            if length not in chosen:
                prices = []
                for size in (s for s in sizes if s >= length):
                    held = min(waiting[length], size // length) * length
                    for shorter in sorted((x for x in counts if x < length), reverse=True):
                        held += min(counts[shorter], (size - held) // shorter) * shorter
                    prices.append((cost(size) / held, -size))
                chosen[length] = -min(prices)[1]
            best = [chosen[length], 0]
            bins.append(best)
        best[1] += length
        waiting[length] -= 1
    return bins
