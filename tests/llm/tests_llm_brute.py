"""Plain versions that the pipeline's test compares with."""

from kvlake.llm import decontam, jaccard


def components_brute(rows):
    sets = []
    for _, text in rows:
        w = (text or "").encode().translate(jaccard._LOWER).split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - min(5, len(w)) + 1)} if w else set())
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            c = len(sets[a] & sets[b])
            if c and 100 * c >= 80 * len(sets[a] | sets[b]):
                up[max(find(a), find(b), key=lambda k: rows[k][0])] = min(find(a), find(b), key=lambda k: rows[k][0])
    return [rows[find(k)][0] for k in range(len(rows))]


def leaks_brute(text, bench, rate=0.2):
    words = decontam.words_of(text)
    known = set(words)
    for _, item in bench:
        own = decontam.words_of(item)
        limit = int(rate * len(own) + 1e-9)
        if not own or sum(w not in known for w in own) > limit:
            continue
        row = [0] * (len(words) + 1)
        for k, a in enumerate(own, 1):
            new = [k]
            for j, b in enumerate(words):
                new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
            row = new
        if min(row) <= limit:
            return True
    return False
