"""Plain loops that state the expected results for small random inputs."""


def iob(tags):
    spans, cur = [], None
    for i, t in enumerate(tags):
        if t.startswith("B-"):
            if cur:
                spans.append(tuple(cur))
            cur = [i, i + 1, t[2:]]
        elif t.startswith("I-"):
            if cur:
                cur[1] = i + 1
            else:
                cur = [i, i + 1, t[2:]]
        elif cur:
            spans.append(tuple(cur))
            cur = None
    return spans + ([tuple(cur)] if cur else [])


def merges(gaps):
    """Merge the closest neighbouring groups, leftmost first, until one is left."""
    groups = [(i, i) for i in range(len(gaps) + 1)]
    out = []
    while len(groups) > 1:
        k = min(range(len(groups) - 1), key=lambda i: (gaps[groups[i][1]], i))
        joined = (groups[k][0], groups[k + 1][1])
        groups[k : k + 2] = [joined]
        out.append(joined)
    return out


def greedy(spans):
    """spans: (s, e, confidence)."""
    kept = []
    for s, e, c in sorted(spans, key=lambda x: (-round(x[2], 9), x[0] - x[1], x[0])):
        if not any((a <= s and b >= e) or (a >= s and b <= e) for a, b, _ in kept):
            kept.append((s, e, c))
    return kept


def parent(span, spans):
    s, e = span
    around = [(b - a, -a, (a, b)) for a, b in spans if a <= s and b >= e and (a, b) != span]
    return min(around)[2] if around else None


def tree_spans(text):
    """[(label, start, end)] of a well-formed bracket tree in pre-order."""
    toks = text.replace("(", " ( ").replace(")", " ) ").split()
    out, stack, leaves, i = [], [], 0, 0
    while i < len(toks):
        if toks[i] == "(":
            label = toks[i + 1] if toks[i + 1] not in "()" else ""
            i += bool(label)
            stack.append(len(out))
            out.append([label, leaves, None])
        elif toks[i] == ")":
            out[stack.pop()][2] = leaves
        else:
            leaves += 1
        i += 1
    return [tuple(x) for x in out]
