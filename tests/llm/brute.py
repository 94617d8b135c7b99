"""Plain versions of the corpus operators, over lists of dicts, to hold the distributed ones against."""

import math
import re
import zlib
from collections import Counter, defaultdict

from glyphmill.llm import lines as L
from glyphmill.llm import quality as Q
from glyphmill.llm import urls as U

WORD = re.compile(r"[^\x20\x09-\x0D]+")


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def unite(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


def base_counts(text):
    words = WORD.findall(text or "")
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {p for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    full = [line for line in (text or "").split("\n") if WORD.search(line)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(full) - len(set(full)), len(covered)


def histograms(text):
    text, words = text or "", WORD.findall(text or "")
    classes = [len(re.findall(p, text)) for p in Q.CLASSES.values()]
    white = len(re.findall(r"[\x20\x09-\x0D]", text))
    classes += [len(text.encode()) - len(text), white, len(text) - white - sum(classes)]
    return classes, Counter(w.lower() for w in words), len(words)


def distance(p, q):
    def term(x, m):
        return x * math.log2(x / m) if x > 0 else 0.0

    return math.sqrt(max(0.0, sum(term(a, (a + b) / 2) + term(b, (a + b) / 2) for a, b in zip(p, q, strict=True)) / 2))


def quality(docs):
    """doc_id: (class distance, word distance, kept)."""
    made = [histograms(d["text"]) for d in docs]
    failed = [n < 50 or 100 * base_counts(d["text"])[4] > 50 * n for d, (_, _, n) in zip(docs, made, strict=True)]
    out, bins = {}, {}
    for k, d in enumerate(docs):
        (c, w, n), lang = made[k], d["lang"]
        name = ("of", lang)
        like = [i for i, e in enumerate(docs) if e["lang"] == lang and not failed[i]]
        if len(like) < Q.SUPPORT_DOCS or sum(made[i][2] for i in like) < Q.SUPPORT_WORDS:
            like, name = [i for i in range(len(docs)) if not failed[i]], "all"
        if name not in bins:
            held = Counter(x for i in like for x in made[i][1] if re.fullmatch(r"[^\W\d_]+", x))
            bins[name] = sorted(held, key=lambda x: (-held[x], x))[: Q.COMMON]
        like = [i for i in like if i != k]
        total = sum(made[i][2] for i in like)
        if not n or not total:
            out[d["doc_id"]] = (None, None, not failed[k])
            continue
        sums = [sum(made[i][0][j] for i in like) for j in range(len(c))]
        by_class = distance([x / sum(c) for x in c], [x / sum(sums) for x in sums])
        common = {b: sum(made[i][1][b] for i in like) for b in bins[name]}
        p, q = ([src[b] / size for b in bins[name]] for src, size in ((w, n), (common, total)))
        by_word = distance([*p, 1 - sum(p)], [*q, 1 - sum(q)])
        far = n >= Q.CLASS_GUARD and by_class > Q.CLASS_LIMIT or n >= Q.WORD_GUARD and by_word > Q.WORD_LIMIT
        out[d["doc_id"]] = (by_class, by_word, not failed[k] and not far)
    return out


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def normal(line):
    return re.sub("[0-9]+", "0", re.sub(r"[\x20\x09-\x0D]+", " ", line)).lower().strip(" ")


def within(a, b, most):
    """Whether the edit distance is at most `most`; rows are cut to the diagonal's neighbourhood."""
    if abs(len(a) - len(b)) > most:
        return False
    row = {j: j for j in range(min(len(b), most) + 1)}
    for i, x in enumerate(a, 1):
        low, high = max(0, i - most), min(len(b), i + most)
        new = {}
        for j in range(low, high + 1):
            best = row.get(j, most) + 1
            if j:
                best = min(best, new.get(j - 1, most) + 1, row.get(j - 1, most + 1) + (x != b[j - 1]))
            new[j] = best
        if min(new.values()) > most:
            return False
        row = new
    return row.get(len(b), most + 1) <= most


def dedup_lines(docs):
    """doc_id: text without repeated lines; lines are linked by edit similarity alone, all pairs of near lengths."""
    groups, places = Union(), []
    for d in sorted(docs, key=lambda d: d["doc_id"]):
        for at, line in enumerate((d["text"] or "").split("\n")):
            if n := normal(line):
                places.append((d["doc_id"], at, n))
                groups.find(n)
    listed = sorted(groups.up, key=len)
    letters = [Counter(n) for n in listed]
    for i, a in enumerate(listed):
        for j in range(i + 1, len(listed)):
            most = len(listed[j]) * (100 - L.SIMILAR) // 100
            if len(listed[j]) - len(a) > most:
                break
            if (letters[j] - letters[i]).total() <= most and within(a, listed[j], most):
                groups.unite(a, listed[j])
    first = {}
    for doc, at, n in places:
        first.setdefault(groups.find(n), (doc, at))
    gone = {(doc, at) for doc, at, n in places if first[groups.find(n)] != (doc, at)}
    return {d["doc_id"]: d["text"] and "\n".join(line for at, line in enumerate(d["text"].split("\n")) if (d["doc_id"], at) not in gone) for d in docs}


def shingles(text, n):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def near_duplicates(docs, n, t):
    """doc_id: (size of its set, least doc_id that links reach)."""
    sets, groups = {d["doc_id"]: shingles(d["text"], n) for d in docs}, Union()
    listed = sorted(sets)
    for i, a in enumerate(listed):
        groups.find(a)
        for b in listed[i + 1 :]:
            if sets[a] and sets[b] and 100 * (o := len(sets[a] & sets[b])) >= t * (len(sets[a]) + len(sets[b]) - o):
                groups.unite(a, b)
    return {d: (len(s), groups.find(d)) for d, s in sets.items()}


def repeats(docs, size=50):
    """doc_id: positions of the words that go."""
    words, owner = {d["doc_id"]: WORD.findall(d["text"] or "") for d in docs}, {}
    for doc in sorted(words):
        for i in range(len(words[doc]) - size + 1):
            owner.setdefault(tuple(words[doc][i : i + size]), doc)
    return {doc: {p for i in range(len(w) - size + 1) if owner[tuple(w[i : i + size])] < doc for p in range(i, i + size)} for doc, w in words.items()}


def without(text, gone):
    """The text less its lost words and the white space after each run of them."""
    spans, out, at = [m.span() for m in WORD.finditer(text)], [], 0
    for p in sorted(gone):
        if p - 1 not in gone:
            out.append(text[at : spans[p][0]])
        if p + 1 not in gone:
            at = spans[p + 1][0] if p + 1 < len(spans) else len(text)
    return "".join([*out, text[at:]])


def with_tail(doc, words):
    h, n = zlib.crc32(str(doc).encode()), len(words)
    g = h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def periodic_runs(words, least=12):
    """(start, length, period) of all runs, by start, then period: each period's stretches of matches, less those with a smaller period."""
    found = {}
    for p in range(1, len(words) // 2 + 1):
        a = None
        for j in range(len(words) - p + 1):
            if j < len(words) - p and words[j] == words[j + p]:
                a = j if a is None else a
            elif a is not None:
                if j - a + p >= max(least, 2 * p):
                    found.setdefault((a, j + p), p)
                a = None
    return sorted(((a, b - a, p) for (a, b), p in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(words, found):
    gone = {i for start, length, period in found for i in range(start + period, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def spelling_words(docs, spoil=31):
    """Counts of words of seven characters and more."""
    total = Counter()
    for d in docs:
        for run in re.findall("[A-Za-z\u00C0-\u00FF]+", d["text"] or ""):
            word = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{d['doc_id']}:{word}".encode())
            if h % spoil == 0:
                i = h % len(word)
                word = word[:i] + word[i + 1 :]
            total[word] += 1
    return {w: n for w, n in total.items() if len(w) >= 7 and n >= 2}


def near(a, b):
    """Whether one inserted, deleted or replaced character makes b of a."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def spelling_groups(counts, times=10):
    """word: (form, root, n, n_near, form_n), near words by the patterns that all deletions make, and all pairs of these."""
    patterns = defaultdict(set)
    for w in counts:
        patterns[w].add(w)
        for i in range(len(w)):
            patterns[w[:i] + w[i + 1 :]].add(w)
    neighbours = defaultdict(set)
    for some in patterns.values():
        for a in some:
            neighbours[a] |= {b for b in some if a != b and near(a, b)}
    form = {}
    for w, n in counts.items():
        best = min(neighbours[w], key=lambda b: (-counts[b], b), default=None)
        form[w] = best if best and counts[best] >= times * n else None
    out = {}
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n, len(neighbours[w]), form[w] and counts[form[w]])
    return out


def url_templates(counts):
    """(host, shape): (template, purity), from (host, shape): (n, blocked, allowed); one host's tree after the other, by recursion."""

    def first(shape):
        return "/" + shape.split("/")[1] if "/" in shape else ""

    def pure(b, a, towards=U.PRIOR):
        return (b + towards * U.WEIGHT) / (b + a + U.WEIGHT)

    said = defaultdict(lambda: [0, 0])
    for (host, shape), (_, b, a) in counts.items():
        parts = host.split(".")
        for key in (("own", host, first(shape)), ("first", first(shape)), ("shape", shape), ("label", parts[-1], shape), ("domain", *parts[-2:], shape)):
            said[key][0] += b
            said[key][1] += a
    known = {}
    for (host, shape), (n, b, a) in counts.items():
        parts, own = host.split("."), said["own", host, first(shape)]
        every = said["first", first(shape)]
        prior = pure(every[0] - own[0], every[1] - own[1])
        told = n if sum(every) > sum(own) else 0
        for key in (("shape", shape), ("label", parts[-1], shape), ("domain", *parts[-2:], shape)):
            prior = pure(said[key][0] - b, said[key][1] - a, prior)
        known[host, shape] = (n, b, a, told, told * prior)

    def total(keys):
        return [sum(c) for c in zip(*(known[k] for k in keys), strict=True)]

    def evidence(sums, towards=U.PRIOR):
        n, b, a, told, expected = sums
        return pure(b + expected * U.WEIGHT / n, a + (told - expected) * U.WEIGHT / n, towards) if n else pure(b, a, towards)

    def by_segment(items, segment):
        found = defaultdict(list)
        for k, rest in items:
            found[segment(k, rest)].append((k, rest))
        return found

    template = {}

    def grow(node, items):
        if len({rest for _, rest in items}) == 1:
            template.update({k: node + rest for k, rest in items})
            return
        template.update({k: node for k, rest in items if not rest})
        items = [(k, rest) for k, rest in items if rest]
        heads, whole, alone, wide = by_segment(items, lambda _, rest: first(rest)), total(k for k, _ in items), set(), set()
        sizes = {g: total(k for k, _ in some) for g, some in heads.items()}
        spread = -sum(z[0] / whole[0] * math.log2(z[0] / whole[0]) for z in sizes.values())
        for g, z in sizes.items():
            others = evidence([x - y for x, y in zip(whole, z, strict=True)])
            if len(heads) > 1 and abs(evidence(z, others) - others) > U.GAP:
                alone.add(g)
            elif spread > math.log2(U.MAX_CHILDREN) and U.MAX_CHILDREN * z[0] < whole[0]:
                wide.add(g)
        tails = Counter()
        for k, rest in items:
            tails[rest[len(first(rest)) :]] += known[k][0]
        below = defaultdict(list)
        for g, some in by_segment(items, lambda _, rest: "/*" if first(rest) in wide else first(rest)).items():
            z, mine = total(k for k, _ in some), Counter()
            for k, rest in some:
                mine[rest[len(first(rest)) :]] += known[k][0]
            differ = sum(abs(mine[x] / z[0] - tails[x] / whole[0]) for x in tails)
            merges = 100 * differ <= 2 * U.MERGE + 1e-9 and abs(evidence(z) - evidence(whole)) <= U.GAP
            for k, rest in some:
                below["/*" if merges and first(rest) not in alone else g].append((k, rest[len(first(rest)) :]))
        for g, some in below.items():
            grow(node + g, some)

    for host, some in by_segment([(k, k[1]) for k in known], lambda k, _: k[0]).items():
        grow("", some)
    judged = defaultdict(list)
    for k in known:
        judged[k[0], template[k]].append(k)
    return {k: (template[k], evidence(total(judged[k[0], template[k]]))) for k in known}
