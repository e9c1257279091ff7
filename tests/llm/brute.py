"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_right
from collections import defaultdict

from xxhash import xxh64_intdigest

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower_ascii(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def fingerprint(text, k=4, seed=42):
    words = WORD.findall(lower_ascii(text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxh64_intdigest(s.encode(), seed) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_groups(rows, radius=4):
    """rows: (doc_id, text). Returns (doc_id, fingerprint hex, component_id) per row."""
    prints = [fingerprint(t) for _, t in rows]
    distinct = sorted(set(prints))
    root = {f: f for f in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    least = {}
    for (d, _), f in zip(rows, prints, strict=True):
        if d is not None:
            least[find(f)] = min(d, least.get(find(f), d))
    return [(d, f"{f:016x}", least.get(find(f))) for (d, _), f in zip(rows, prints, strict=True)]


def remove_repeats(rows, window=50):
    first = {}
    words = [(float("inf") if d is None else d, WORD.findall(t or "")) for d, t in rows]
    for d, w in words:
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            first[key] = min(d, first.get(key, d))
    out = []
    for (d, _), (order, w) in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < order:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def pieces(rows, tokenizer, most=2048):
    """{(doc_id, piece): (start, length, crc)}"""
    import numpy as np

    out = defaultdict(list)
    for d, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        cut = [0] if len(ids) <= most else [0, *([len(ids) % most] if len(ids) % most else [most])]
        while cut[-1] + most < len(ids) and len(ids) > most:
            cut.append(cut[-1] + most)
        for k, a in enumerate(cut):
            b = cut[k + 1] if k + 1 < len(cut) else len(ids)
            out[(d, k)].append((a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    return out


def token_alignment(rows, a_path, b_path):
    """rows: (doc_id, text). Whole texts by both tokenizers, links by comparing all byte ranges in order."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(a_path)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=b_path)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in plain)}
    docs = []
    for d, t in rows:
        ia = a.encode(" " + t, add_special_tokens=False).ids if t else []
        ib = b.encode(t) if t else []
        xa = [bytes(letter[c] for c in a.id_to_token(i)) for i in ia]
        xb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
        if not t or b"".join(xa) != (" " + t).encode() or b"".join(xb) != (" " + t).encode():
            docs.append((d, [], [], [], 0, ""))
            continue

        def ends(x):
            out, at = [], 0
            for w in x:
                out.append(at := at + len(w))
            return out

        ea, eb = ends(xa), ends(xb)
        common = sorted(set(ea) & set(eb))
        links, j = [], 0
        for i in range(len(ia)):
            while eb[j] <= ea[i] - len(xa[i]):
                j += 1
            k = j
            while k < len(ib) and eb[k] - len(xb[k]) < ea[i]:
                links.append((ia[i], ib[k]))
                k += 1
        groups, la, lb = [], 0, 0
        for c in common:
            x, y = bisect_right(ea, c), bisect_right(eb, c)
            groups.append(",".join(map(str, ia[la:x])) + "|" + ",".join(map(str, ib[lb:y])))
            la, lb = x, y
        docs.append((d, ia, ib, links, len(common), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    count = defaultdict(int)
    for _, _, _, links, _, _ in docs:
        for x in links:
            count[x] += 1
    most = defaultdict(int)
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    return [(d, len(ia), len(ib), g, len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), h) for d, ia, ib, links, g, h in docs]


def damaged(turns):
    """(conv_id, turn, role, text) after the damage of the contract."""
    blank = lambda x: " " if x is None else x
    out = []
    for c, t, r, x in turns:
        r, x = blank(r), blank(x)
        fault = zlib.crc32(f"{blank(c)}:{blank(t)}".encode()) % 20
        if fault == 0:
            continue
        x = "" if fault == 1 else re.sub("[.!?]", "", x) if fault == 2 else x
        out += [(c, t, "user" if fault == 4 else r, x)] * (2 if fault == 3 else 1)
    return out


def repair_conversations(turns, ids=()):
    """Whole conversations by Dijkstra over (cost, audit), so ties fall to the least string."""
    from heapq import heappop, heappush

    by = defaultdict(list, {c: [] for c in ids})
    for c, t, r, x in turns:
        by[c].append((t, " " if r is None else r, " " if x is None else x))
    out = []
    for conv, rows in by.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{r[1]}\0{r[2]}".encode()).digest()))
        seen, faults = set(), []
        for _, r, x in rows:
            letters = re.findall(r"[^\x20\x09-\x0D]", x)
            faults.append("blank" if not letters else "duplicate" if (r, x) in seen else "truncated" if letters[-1] not in ".!?" else "")
            seen.add((r, x))
        heap, done = [(0, "", 0, "", ())], set()
        while True:
            cost, audit, i, last, lines = heappop(heap)
            if i == len(rows) and last in ("", "a"):
                break
            if (i, last) in done:
                continue
            done.add((i, last))
            following = "a" if last == "u" else "u"
            name = {"u": "user", "a": "assistant"}[following]
            heappush(heap, (cost + 2, audit + "I", i, following, (*lines, f"{name}:")))
            if i < len(rows):
                _, r, x = rows[i]
                heappush(heap, (cost + 3, audit + "D", i + 1, last, lines))
                if faults[i] not in ("blank", "duplicate"):
                    more = faults[i] == "truncated"
                    if r[:1] == following or (r[:1] == "s" and last == ""):
                        heappush(heap, (cost + more, audit + "K", i + 1, r[:1], (*lines, f"{r}:{x}")))
                    heappush(heap, (cost + 2 + more, audit + "R", i + 1, following, (*lines, f"{name}:{x}")))
        at = [t for t, _, _ in rows if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
        out.append((conv, max(at) - min(at) + 1 - len(set(at)) if at else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


def quality(doc_id, text):
    """(doc_id, words, their code points, symbols, lines with a word, duplicate lines, words in repeated windows)."""
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (doc_id, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines), len(lines) - len(set(lines)), len(covered))
