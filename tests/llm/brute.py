"""Plain Python answers to the queries, for small tables. Rows are ``(doc_id, text)``."""

from __future__ import annotations

import base64
import hashlib
import re
from collections import Counter, defaultdict

import xxhash

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def sha(data: bytes | str) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def substring_dedup(rows, window=35):
    words = [SPACE.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (doc, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((doc, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def contained(rows, items, share=0.8):
    def shingles(text):
        w = ALNUM.findall(lower(text or ""))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    out = set()
    for item, item_text in items:
        own = shingles(item_text)
        for doc, text in rows if own else []:
            shared = len(own & shingles(text))
            if shared >= share * len(own):
                out.add((doc, item, shared, len(own), round(shared / len(own), 6)))
    return list(out)


def byte_bpe(rows, path, pattern):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    encoding = tiktoken.Encoding("test", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    out = []
    for doc, text in rows:
        ids = encoding.encode_ordinary(text or "")
        out.append((doc, len(ids), sha(",".join(map(str, ids))), sha(text or "")))
    return out


def base_licenses(rows, phrases):
    out = []
    for doc, text in rows:
        w = ALNUM.findall(lower(text or ""))
        found = [(i, label) for p, label in phrases for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        at = [i for i, _ in found]
        out.append((doc, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))))
    return out


def edited(rows):
    """``doc_id, n_chars, edited_sha256``; ids must differ."""
    order = sorted(rows, key=lambda r: -r[0])
    out = []
    for k, (doc, text) in enumerate(order):
        text, following = text or "", order[(k + 1) % len(order)][1] or ""
        n = len(text) // 3
        out.append((doc, len(text), sha(text[: len(text) - n] + following[:n])))
    return out


def term_bits(text):
    """The fingerprint of weighted terms."""
    w = SPACE.findall(text or "")
    votes, total = [0] * 64, 0
    for before, own in zip(["", *w], w):
        h = xxhash.xxh64_intdigest(own.encode(), seed=xxhash.xxh64_intdigest(before.encode(), seed=42))
        weight = min(len(own), 15)
        total += weight
        votes = [v + weight * (h >> b & 1) for b, v in enumerate(votes)]
    return sum(1 << b for b, v in enumerate(votes) if 2 * v > total)


def fingerprinted(rows, every=100, radius=3):
    """``doc_id, fingerprint, edited_fingerprint, near_edited, near_next, n_near``; ids must differ."""
    order = sorted(rows, key=lambda r: -r[0])
    bits = [term_bits(text) for _, text in order]
    like = lambda a, b: 1 - (a ^ b).bit_count() / 64
    out = []
    for k, (doc, text) in enumerate(order):
        text, following = text or "", order[(k + 1) % len(order)][1] or ""
        n = len(text) // 3
        own = term_bits(text[: len(text) - n] + following[:n])
        near = sum((bits[k] ^ b).bit_count() <= radius for b in bits) - 1 if doc % every == 0 else None
        out.append((doc, f"{bits[k]:016x}", f"{own:016x}", like(bits[k], own), like(bits[k], bits[(k + 1) % len(order)]), near))
    return out


def line_dedup(rows, min_characters=20, min_documents=3):
    key = lambda line: lower(line.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_characters:
                holders[key(line)].add(doc)
    largest = lambda docs: max(docs, key=lambda d: (d is not None, d or 0))
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(holders[key(x)]) < min_documents or doc == largest(holders[key(x)])]
        out.append((doc, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return out


def simhash(text: str | None) -> int:
    w = SPACE.findall(lower(text or ""))
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(rows, radius=4):
    bits = [simhash(t) for _, t in rows]
    root = list(range(len(rows)))

    def up(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (bits[i] ^ bits[j]).bit_count() <= radius:
                root[up(i)] = up(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[up(i)] = min(least.get(up(i), doc), doc)
    return [(doc, f"{b:016x}", least.get(up(i))) for i, ((doc, _), b) in enumerate(zip(rows, bits))]
