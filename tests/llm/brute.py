"""Plain-Python counterparts of what the queries return, row by row."""

import hashlib
import math
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def plain_words(text):
    return PLAIN.findall((text or "").translate(UPPER))


def conversation(turns):
    """turns: (role, text) in order."""
    turns = [(r or "", t or "") for r, t in turns]
    loss = "".join(t for r, t in turns if r == "assistant")
    return {"n_turns": len(turns), "turns_sha256": sha("".join(f"{r}\n{t}\n" for r, t in turns)), "loss_chars": len(loss), "loss_sha256": sha(loss)}


def secrets(text):
    text = text or ""
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""".replace("(password", "((?i:password").replace("api_?key)", "api_?key))", 1), re.ASCII)
    found = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(text) if len(m.group(2)) >= 6]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 24]
    found.sort()
    count = lambda k: sum(f[3] == k for f in found)
    return {"n_assign": count("assign"), "n_access": count("access"), "n_hex": count("hex"), "base_sha256": sha(",".join(f"{k}:{a}:{b}" for a, _, b, k in found))}


def luhn(digits):
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = int(ch) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def personal(text):
    text = text or ""
    digits = lambda s: re.sub(r"[^0-9]", "", s)
    found = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    found += [("card", m) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))]
    found += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m.group())) <= 15]
    count = lambda k: sum(kind == k for kind, _ in found)
    return {f"n_{k}": count(k) for k in ("email", "ip", "card", "phone")} | {"base_sha256": sha(",".join(f"{k}:{m.start()}:{m.end()}" for k, m in found))}


def quality(text):
    text = text or ""
    words = WORD.findall(text)
    seen, marked = {}, set()
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i:i + 3]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            marked |= {i + j for i in places for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n, repeated = len(words), len(marked)
    return {"n_words": n, "word_chars": sum(map(len, words)), "n_symbols": sum(ch in "#*$%&|<>" for ch in text),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": repeated, "base_failed": n < 50 or 100 * repeated > 50 * n}


def hits(text, items):
    """items: (item_id, text)."""
    words = plain_words(text)
    marked, named = set(), set()
    for item, item_text in items:
        ws = plain_words(item_text)
        size = min(10, len(ws))
        for i in range(len(ws) - size + 1 if ws else 0):
            for j in range(len(words) - size + 1):
                if words[j:j + size] == ws[i:i + size]:
                    marked |= set(range(j, j + size))
                    named.add(str(item))
    return {"n_words": len(words), "n_hit": len(marked), "n_items": len(named), "items_sha256": sha(",".join(sorted(named))), "contaminated": bool(marked)}


def mix_targets(sizes):
    """source -> target."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    capped = set()
    total = sum(sizes.values())
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        rest = sum(weight[s] for s in order if s not in capped)
        target = {s: 3.0 * sizes[s] if s in capped else left * weight[s] / rest for s in order}
        over = {s for s in order if s not in capped and target[s] > 3 * sizes[s]}
        if not over:
            return target
        capped |= over


def shingle_set(text):
    ws = plain_words(text)
    return {tuple(ws[i:i + 5]) for i in range(len(ws) - 4)} or ({tuple(ws)} if ws else set())


def spaced_shingles(text):
    ws = WORD.findall((text or "").translate(UPPER))
    return {tuple(ws[i:i + 5]) for i in range(len(ws) - 4)} or ({tuple(ws)} if ws else set())


def joined_components(rows):
    """rows: (doc_id, text). Tuples of (doc_id, n_shingles, component_id); all pairs that share a shingle are compared."""
    sets = [spaced_shingles(t) for _, t in rows]
    by, near = {}, [set() for _ in rows]
    for i, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        for j in {j for x in s for j in by[x] if j < i}:
            both = len(s & sets[j])
            if 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                near[i].add(j)
                near[j].add(i)
    least, seen = {}, set()
    for i in range(len(rows)):
        if i not in seen:
            group, todo = {i}, [i]
            while todo:
                more = near[todo.pop()] - group
                group |= more
                todo += more
            seen |= group
            ids = [rows[j][0] for j in group if rows[j][0] is not None]
            least |= dict.fromkeys(group, min(ids, default=None))
    return [(d, len(sets[i]), least[i]) for i, (d, _) in enumerate(rows)]


def near_classes(rows, similar, threshold=0.8):
    """rows: (id, text). Class of each row: the smallest id of its connected component; pairs found through shared shingles."""
    rows = list(rows)
    sets = [similar(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    by = {}
    for i, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(i)
    pairs = {(a, b) for members in by.values() for k, a in enumerate(members) for b in members[k + 1:]}
    equal = {}
    for i, (_, t) in enumerate(rows):
        if t is not None:
            pairs.add((equal.setdefault(t, i), i))
    for a, b in pairs:
        if rows[a][1] == rows[b][1] or (sets[a] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])):
            parent[root(a)] = root(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return {d: least[root(i)] for i, (d, _) in enumerate(rows)}


def merkle(rows):
    """rows: (doc_id, source, lang, n_chars, text). Tuples of (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, more=0: sha("".join(map(field, (r[0], r[1], r[2], r[3] if r[3] is None else r[3] + more, r[4]))))

    def climb(nodes):
        """Root, and for each node its steps: (digests before it, digests after it) per level."""
        steps, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for k, i in enumerate(at):
                run = i // 2 * 2
                steps[k].append((nodes[run:i], nodes[i + 1:run + 2]))
            nodes = [sha("".join(nodes[i:i + 2])) for i in range(0, len(nodes), 2)]
            at = [i // 2 for i in at]
        return nodes[0], steps

    langs = sorted({r[2] for r in rows}, key=lambda v: (v is not None, (v or "").encode()))
    groups = [sorted((r for r in rows if r[2] == v), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for v in langs]
    trees = [climb([leaf(r) for r in g]) for g in groups]
    root, above = climb([t[0] for t in trees])
    out = []
    for g, (subroot, steps), top in zip(groups, trees, above):
        for r, own in zip(g, steps):
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            digest = leaf(r, int(changed))
            for before, after in own + top:
                digest = sha("".join([*before, digest, *after]))
            proof = sha("".join(d for before, after in own + top for d in before + after))
            out.append((r[0], leaf(r), subroot, root, proof, digest, digest == root))
    return out


def vector_codes(rows):
    """rows: (vec_id, vector, label), every vector of the same length or to be left out. Tuples of the query's columns."""
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    size = len(kept[0][1]) // 16
    kept = [r for r in kept if len(r[1]) == 16 * size]
    part = lambda q, p: q[p * size:(p + 1) * size]
    books = [[part(r[1], p) for r in kept[:64]] for p in range(16)]
    distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda q, p: min(range(len(books[p])), key=lambda e: (distance(part(q, p), books[p][e]), e))
    for _ in range(2):
        moved = []
        for p in range(16):
            chosen = [nearest(r[1], p) for r in kept]
            own = [[part(r[1], p) for r, e in zip(kept, chosen) if e == k] for k in range(len(books[p]))]
            moved.append([[sum(xs) // len(xs) for xs in zip(*mine)] if mine else books[p][k] for k, mine in enumerate(own)])
        books = moved
    codes = [[nearest(r[1], p) for p in range(16)] for r in kept]
    errors = [sum(distance(part(r[1], p), books[p][e]) for p, e in enumerate(c)) for r, c in zip(kept, codes)]
    digest = sha(",".join(str(x) for book in books for entry in book for x in entry))
    by = {}
    for r, e in zip(kept, errors):
        by[r[2]] = by.get(r[2], 0) + e
    return [(r[0], bytes(c).hex(), e, by[r[2]], digest) for r, c, e in zip(kept, codes, errors)]
