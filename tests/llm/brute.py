"""The operators' results by the plainest means."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict
from itertools import accumulate


def near(rows, threshold=(4, 5)):
    """doc_id -> (smallest doc_id that links lead to, number of links), over all pairs of sets of five-word shingles."""
    docs = defaultdict(list)
    for d, t in rows:
        words = (t or "").encode().split()
        n = min(5, len(words))
        if words and d is not None:
            docs[frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))].append(d)
    sets, links, root = list(docs), Counter(), {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    def unite(a, b):
        a, b = sorted((find(a), find(b)))
        root[b] = a

    for i, s in enumerate(sets):
        for a in set(docs[s]):
            links[a] += len(docs[s]) - 1
            unite(a, docs[s][0])
        for t in sets[:i]:
            common = len(s & t)
            if common * threshold[1] >= threshold[0] * (len(s) + len(t) - common):
                for a in set(docs[s]):
                    links[a] += len(docs[t])
                for b in set(docs[t]):
                    links[b] += len(docs[s])
                unite(docs[s][0], docs[t][0])
    return {d: (find(d), links[d]) for d, _ in rows if d is not None}


def cut(rows, length=50):
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: every string of a length that also starts in an earlier document is removed."""
    rank = lambda d: (1 << 63) - 1 if d is None else d
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            first[s] = min(rank(d), first.get(s, rank(d)))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < rank(d):
                gone[p : p + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((d, len(b), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return out


def targets(sizes, weights=(1, 2, 3), cap=3):
    """Source -> target, by handing the excess on until none is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, full = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in full]
        if not free:
            return full
        level = (total - sum(full.values())) / sum(weight[s] for s in free)
        above = [s for s in free if weight[s] * level > cap * sizes[s]]
        if not above:
            return full | {s: weight[s] * level for s in free}
        full |= {s: cap * sizes[s] for s in above}


def repeats(rows, length=50):
    """Of texts without copies: (string, its occurrences) for every run of strings of a length that two ids have and that occur alike."""
    texts, seen = [], set()
    for d, t in sorted(rows, key=lambda x: (x[0] is None, x[0] or 0)):
        b = (t or "").encode()
        if b not in seen:
            texts.append((d, b))
            seen.add(b)
    at = defaultdict(list)
    for k, (_, b) in enumerate(texts):
        for p in range(len(b) - length + 1):
            at[b[p : p + length]].append((k, p))
    alike = lambda k, p, by: [(j, q - by) for j, q in at.get(texts[k][1][p + by : p + by + length], ())] if 0 <= p + by <= len(texts[k][1]) - length else None
    found = set()
    for places in at.values():
        if len({texts[k][0] for k, _ in places}) < 2:
            continue
        (k, p), low, high = places[0], 0, 0
        while alike(k, p, low - 1) == places:
            low -= 1
        while alike(k, p, high + 1) == places:
            high += 1
        found.add((texts[k][1][p + low : p + high + length], tuple(sorted((texts[j][0], q + low) for j, q in places))))
    return found


def language_model(rows, order, mu, step):
    """doc_id -> held_out, n_tokens, n_known, train_tokens, base_score, score, from plain counts; n-gram probabilities are rounded
    to steps of the logarithm, as they are kept."""
    end = b"\n"
    docs = [(d, zlib.crc32(b"" if d is None else str(d).encode()) % 7 == 2, [*(t or "").encode().lower().split(), end]) for d, t in rows]
    counts = Counter()
    for _, held, words in docs:
        if not held:
            padded = [end, *words]  # what follows the beginning follows an end
            for j in range(len(words)):
                counts[(words[j],)] += 1
                for k in range(2, order + 1):
                    if j + 2 >= k:
                        counts[tuple(padded[j + 2 - k : j + 2])] += 1
    total, distinct = sum(n for g, n in counts.items() if len(g) == 1), sum(len(g) == 1 for g in counts)
    rounded = lambda p: 10 ** (-step * (min(255, max(1, round(-math.log10(p) / step) + 1)) - 1))

    def probability(gram):
        if len(gram) == 1:
            return (counts[gram] + 1) / (total + distinct + 1)
        shorter, size = probability(gram[1:]), counts[gram[:-1]]
        if counts[gram]:
            return rounded((counts[gram] + mu * rounded(shorter)) / (size + mu))
        return shorter * mu / (size + mu) if size else shorter

    out = {}
    for d, held, words in docs:
        padded = [end, *words]
        grams = [tuple(padded[max(0, j + 2 - order) : j + 2]) if order > 1 else (w,) for j, w in enumerate(words)]
        base = sum(math.log10(probability((w,))) for w in words)
        out[d] = held, len(words), sum(counts[(w,)] > 0 for w in words), total, base, sum(math.log10(probability(g)) for g in grams)
    return out


def alignment(rows):
    """doc_id -> n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum, each whole text at once."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    a.encode_special_tokens = True
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(x): x for x in own} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in own)}
    names = {i: t for t, i in a.get_vocab().items()}
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    found = {}
    for d, t in rows:
        ids_a, ids_b = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        parts = [bytes(byte[c] for c in names[i]) for i in ids_a], [piece(i) for i in ids_b]
        if not t or any(b"".join(p) != (" " + t).encode() for p in parts):
            found[d] = 0, 0, [], Counter()
            continue
        ends = [list(accumulate(map(len, p))) for p in parts]
        groups, at = [], [0, 0]
        for cut in sorted(set(ends[0]) & set(ends[1])):
            upto = [e.index(cut) + 1 for e in ends]
            groups.append((ids_a[at[0] : upto[0]], ids_b[at[1] : upto[1]]))
            at = upto
        found[d] = len(ids_a), len(ids_b), groups, Counter((x, y) for g, h in groups for x in g for y in h)
    held = Counter(p for *_, links in found.values() for p in links)
    most = defaultdict(int)
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    text = lambda groups: ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
    return {
        d: (n_a, n_b, len(groups), sum(links.values()), hashlib.sha256(text(groups).encode()).hexdigest() if n_a else "", sum(k for p, k in links.items() if held[p] == most[p[0]]), sum(k * held[p] for p, k in links.items()))
        for d, (n_a, n_b, groups, links) in found.items()
    }


def divergence(rows, least=3, ranks=200):
    """(lang, source, part, item) -> value, rank, densely over all kept terms; rows (text, lang, source)."""
    low = str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})
    counts, documents, groups = Counter(), Counter(), {}
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = "".join(c if c.isascii() and c.isalpha() or ord(c) > 127 else " " for c in (text or "").translate(low)).split(" ")
        groups.setdefault(lang, set()).add(source)
        counts.update((lang, source, t) for t in terms if t)
        documents.update((lang, t) for t in set(terms) if t)
    out = {}
    for lang, sources in groups.items():
        kept = sorted(t for (x, t), n in documents.items() if x == lang and n >= least)
        def shares(n):
            total = sum(n.values())
            return {t: 1 + 10**9 * (n[t] + 1) // (total + len(kept)) for t in kept}
        n = {s: {t: counts[lang, s, t] for t in kept} for s in sources}
        p, q = {s: shares(n[s]) for s in sources}, shares({t: sum(n[s][t] for s in sources) for t in kept})
        far = lambda x, y: (x - y) ** 2 // y
        for s in sources:
            pairs = [(sum(far(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            own = [(far(p[s][t], q[t]), t) for t in kept if n[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", own)):
                for k, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))):
                    if part == "pair" or k < ranks:
                        out[lang, s, part, item] = value, k + 1
    return out
