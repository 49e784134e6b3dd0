"""Plain versions of the trained operators, of the mix and of the near-duplicate search, for comparison on small tables."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import xxhash

from corpusloom.llm import langid, mixing, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
M64 = (1 << 64) - 1


# --- quality: one dictionary of weights, one coordinate at a time ---------------------------------------------------


def gram_counts(text):
    tokens = [xxhash.xxh64_intdigest(t) for t in quality.TOKEN.findall(text or "")]
    mix, shift = int(quality.MIX), 64 - quality.BITS
    grams = [(t * mix & M64) >> shift for t in tokens]
    for a, b in zip(tokens, tokens[1:], strict=False):
        pair = int(quality.AGAIN) if a == b else (a * mix & M64) ^ ((b >> 7) * 0xC2B2AE3D27D4EB4F & M64)
        grams.append(pair >> shift)
    return Counter(grams), len(grams)


def ftrl(texts, labels, epochs=3, seed=5, alpha=0.5, beta=1.0, l1=0.001, l2=0.01):
    z, n = defaultdict(float), defaultdict(float)

    def weight(k):
        return 0.0 if abs(z[k]) <= l1 else -(z[k] - math.copysign(l1, z[k])) / ((beta + math.sqrt(n[k])) / alpha + l2)

    rows = []
    for t in texts:
        counts, total = gram_counts(t)
        rows.append([*((k, c * quality.SCALE / math.sqrt(max(1, total))) for k, c in counts.items()), ("bias", 1.0)])
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            used = [(k, v, weight(k)) for k, v in rows[i]]
            p = 1 / (1 + math.exp(-max(-30, min(30, sum(w * v for _, v, w in used)))))
            for k, v, w in used:
                g = (p - labels[i]) * v
                z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / alpha * w
                n[k] += g * g
    return {k: weight(k) for k in list(z)}


def quality_score(weights, text):
    counts, total = gram_counts(text)
    dot = sum(weights.get(k, 0.0) * c for k, c in counts.items()) * quality.SCALE / math.sqrt(max(1, total))
    return 1 / (1 + math.exp(-max(-30, min(30, dot + weights.get("bias", 0.0)))))


# --- language: a convolution written out ----------------------------------------------------------------------------


def language(net, text):
    """(language, probability) of a text under the weights of ``net``."""
    if not text or not any(map(str.isalpha, text)):
        return "und", 0.0
    data, size = text.encode(), langid.WINDOW
    logits = []
    for at in range(0, len(data), size):
        window = np.frombuffer(data[at : at + size].ljust(size, b"\0"), np.uint8)
        features = []
        for i, width in enumerate(langid.WIDTHS):
            for f in range(i * langid.FILTERS, (i + 1) * langid.FILTERS):
                kernel = net.conv[: width * langid.DIM, f].reshape(width, langid.DIM)
                # places beyond the last whole reach of the widest filter are left out for all of them
                places = size - langid.REACH + 1
                response = sum(net.emb[window[k : k + places]] @ kernel[k] for k in range(width))
                features.append(max(0.0, float(response.max()) + float(net.bias[f])))
        logits.append(np.array(features) @ net.out + net.out_bias)
    mean = np.mean(logits, axis=0)
    p = np.exp(mean - mean.max())
    p /= p.sum()
    return net.classes[int(p.argmax())], float(p.max())


# --- near-duplicates ------------------------------------------------------------------------------------------------


def shingle_set(text, size=5):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def classes_at(texts, similarity=0.8, size=5):
    """Smallest index of the class of each text."""
    sets, group = [shingle_set(t, size) for t in texts], list(range(len(texts)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for b in range(len(sets)):
        for a in range(b):
            if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                group[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))]


# --- the mix, block by block ----------------------------------------------------------------------------------------


def targets(sizes, budget=1.5, top=2.0):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-8")))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    open_, target, left = set(sizes), {}, budget * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > top * sizes[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in full:
            target[s] = top * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def seat_by_seat(shares, seats, caps):
    quota = [0] * len(shares)
    for _ in range(seats):
        able = [i for i in range(len(shares)) if quota[i] < caps[i] and shares[i] > 0]
        if not able:
            break
        quota[max(able, key=lambda i: (shares[i] / (2 * quota[i] + 1), -i))] += 1
    return quota


def mix(rows, seed=42, block=mixing.BLOCK_WORDS, shard_rows=mixing.SHARD_ROWS):
    """[(doc_id, source, size, taken, copies)] of ``rows`` [(doc_id, source, size)], words taken block by block."""

    def draw(*parts):
        return hashlib.md5(":".join(str(p) for p in (seed, *parts) if p is not None).encode()).hexdigest()[:16]

    size = Counter()
    for _, s, n in rows:
        size[s] += n
    sources = sorted(size, key=lambda s: (s is None, (s or "").encode("utf-8")))
    target = targets(dict(size))
    seats = round(sum(target.values()) / block)
    quotas = seat_by_seat([target[s] for s in sources], seats, [math.ceil(size[s] * 2 / block) for s in sources])
    out = []
    for k, s in enumerate(sources):
        own = [(draw(d), d, n) for d, src, n in rows if src == s]
        shards = math.ceil(len(own) / shard_rows)
        parts = [[r for r in own if int(r[0][:8], 16) % shards == i] for i in range(shards)]
        words = [sum(n for _, _, n in p) for p in parts]
        blocks = [max(1, math.floor(w / block + 0.5)) for w in words]
        given = seat_by_seat(words, quotas[k], [b * 2 if w else 0 for b, w in zip(blocks, words, strict=True)])
        for i, part in enumerate(parts):
            b, w = blocks[i], words[i]
            passes, rest = divmod(given[i], b)
            phase = int(draw("phase", k, i)[:8], 16) % b
            chosen = [((j + 1) * rest + phase) // b - (j * rest + phase) // b for j in range(b)]
            edge = [j * w / b for j in range(b + 1)]
            at = 0
            for _, d, n in sorted(part, key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2])):
                inside = sum(c * max(0.0, min(at + n, edge[j + 1]) - max(at, edge[j])) for j, c in enumerate(chosen))
                middle = min((2 * at + n) * b // (2 * max(w, 1)), b - 1)
                out.append((d, s, n, passes * n + inside, passes + chosen[middle] if n else 0))
                at += n
    return out
