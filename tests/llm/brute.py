"""Plain versions of the operators, for comparison."""

import hashlib
import itertools
import re

WORD = re.compile(rb"[^\x20\x09-\x0d]+")
WHITE = " \t\n\x0b\x0c\r"


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text, fold=True):
    text = ascii_lower(text) if fold else text or ""
    return [w.decode() for w in WORD.findall(text.encode())]


def shingles(text, size):
    w = words(text)
    return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def components(docs, size, percent):
    """{(id): smallest id reachable} and set sizes of (id, text) rows; ids are distinct."""
    sets = {i: shingles(t, size) for i, t in docs}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def dedup(docs, min_chars=10):
    """[(id, n_lines, n_dropped, kept text)] of (id, text) rows; a null id is the largest."""
    key = lambda line: ascii_lower(line.strip(WHITE))
    big = 1 << 63
    owner = {}
    for i, t in docs:
        for line in (t or "").split("\n"):
            k = key(line)
            if len(k) >= min_chars:
                owner[k] = min(owner.get(k, big + 1), big if i is None else i)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < min_chars or owner[key(x)] == (big if i is None else i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def chats(rows):
    """{conv_id: (n_turns, turns_sha256, loss_chars, loss_sha256)} of (conv_id, turn, role, text) rows."""
    out = {}
    for conv, group in itertools.groupby(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0,
                                                                    r[2] or "", r[3] or "")), key=lambda r: r[0]):
        group = [(r[2] or "", r[3] or "") for r in group]
        loss = "".join(t for r, t in group if r == "assistant")
        out[conv] = (len(group), sha("".join(f"{r}\n{t}\n" for r, t in group)), len(loss), sha(loss))
    return out


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    text = text or ""
    w = words(text, fold=False)
    n, chars = len(w), sum(map(len, w))
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    lines = text.split("\n")
    full = [x for x in lines if words(x)]
    dup = len(full) - len(set(full))
    grams = [tuple(w[i:i + 8]) for i in range(n - 7)]
    seen = {}
    for i, g in enumerate(grams):
        seen.setdefault(g, []).append(i)
    covered = {i + j for at in seen.values() if len(at) > 1 for i in at for j in range(8)}
    base = n < 20 or 100 * len(covered) > 30 * n
    wordlike = sum(bool(re.search(r"[A-Za-z0-9\x80-\U0010ffff]", x)) for x in w)
    bad = (100 * symbols > 15 * n or chars > 15 * n or 2 * chars < 3 * n or 100 * dup > 50 * len(lines) or 2 * wordlike < n)
    white = " \t\x0b\x0c\r"
    bullets = sum(x.lstrip(white).startswith(("-", "*", "\u2022")) for x in lines)
    ellipses = sum(x.rstrip(white).endswith(("...", "\u2026")) for x in lines)
    top = max((w.count(x) for x in set(w)), default=0)
    bad = bad or 100 * top > 30 * n or 100 * bullets > 90 * len(lines) or 100 * ellipses > 30 * len(lines)
    return n, chars, symbols, dup, len(covered), base, not (base or bad)


def contained(docs, items, size=5, percent=80):
    """{(doc, item, shingles of the item, shared)} of (id, text) rows."""
    out = []
    for d, text in docs:
        w = words(text)
        for i, item in items:
            v = words(item)
            k = min(size, len(v))
            if not k:
                continue
            want = {tuple(v[j:j + k]) for j in range(len(v) - k + 1)}
            have = {tuple(w[j:j + k]) for j in range(len(w) - k + 1)}
            if 100 * len(want & have) >= percent * len(want):
                out.append((d, i, len(want), len(want & have)))
    return out


PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def license_base(text):
    """n_words, n_base, first_word, last_word, base_labels."""
    w = re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", ascii_lower(text))
    hits = [(i, label) for phrase, label in PHRASES.items() for i in range(len(w)) if w[i:i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in hits]
    return len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))


def pieces(docs, path, capacity=2048):
    """[(id, piece, start, length, crc32)] of (id, text) rows."""
    import struct
    import zlib

    from tokenizers import Tokenizer
    t = Tokenizer.from_file(path)
    out = []
    for i, text in docs:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        for k, a in enumerate(range(0, len(ids), capacity)):
            part = ids[a:a + capacity]
            out.append((i, k, a, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
    return out


def lm(docs, mu, folds=5, fold=1, order=2):
    """[(id, held_out, n_tokens, n_known, train_tokens, base_score, score)] of (id, text) rows, with n-grams up to ``order``."""
    import collections
    import math
    import zlib
    seen = collections.Counter()
    seqs = []
    for i, text in docs:
        held = zlib.crc32(("" if i is None else str(i)).encode()) % folds == fold
        seq = (0, *words(text), 1)
        seqs.append((i, held, seq))
        if not held:
            seen.update(seq[a:a + k] for k in range(1, order + 1) for a in range(len(seq) - k + 1))
    n = sum(c for g, c in seen.items() if len(g) == 1 and g != (0,))
    v = sum(len(g) == 1 and g != (0,) for g in seen)
    out = []
    for i, held, seq in seqs:
        base = score = 0.0
        for at in range(1, len(seq)):
            p = (seen[seq[at],] + 0.5) / (n + 0.5 * (v + 1))
            base += math.log10(p)
            for k in range(1, order):
                context = seq[at - k:at] if at >= k else ()
                if context and seen[context]:
                    p = (seen[context + (seq[at],)] + mu * p) / (seen[context] + mu)
            score += math.log10(p)
        out.append((i, held, len(seq) - 1, sum(seen[w,] > 0 for w in seq[1:]), n, base, score))
    return out
