"""A nested-loop model of the range operators."""


def match(q, s, type="any", max_gap=-1, min_overlap=0, ignore_strand=False):
    (_, qn, qs, qe, qd), (_, sn, ss, se, sd) = q, s
    if qn != sn or not (ignore_strand or "*" in (qd, sd) or qd == sd):
        return False
    shared = min(qe, se) - max(qs, ss) + 1
    apart = max(ss - qe, qs - se) - 1
    slack = max(max_gap, 0)
    ok = apart <= max_gap and max(shared, 0) >= min_overlap
    if type == "start":
        ok = ok and abs(qs - ss) <= slack
    elif type == "end":
        ok = ok and abs(qe - se) <= slack
    elif type == "equal":
        ok = ok and abs(qs - ss) <= slack and abs(qe - se) <= slack
    elif type == "within":
        ok = ok and qs >= ss and qe <= se and (max_gap <= 0 or (se - ss) - (qe - qs) <= max_gap)
    return ok


def pairs(qs, ss, **options):
    return sorted((q[0], s[0]) for q in qs for s in ss if match(q, s, **options))


def components(ids, edges):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    order = {r: k for k, r in enumerate(sorted({root(i) for i in ids}), 1)}
    out = {i: order[root(i)] for i in ids}
    sizes = list(out.values())
    return {i: (c, sizes.count(c)) for i, c in out.items()}


def positions(ranges, strand=True):
    """Covered positions by (seqname, strand)."""
    out = {}
    for _, n, a, b, d in ranges:
        out.setdefault((n, d if strand else "*"), set()).update(range(a, b + 1))
    return out


def runs(covered):
    out, items = [], sorted(covered)
    for p in items:
        if out and out[-1][1] == p - 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return [tuple(r) for r in out]


def beyond(q, ss, ahead, ignore_strand=False):
    """(distance, id) of the nearest subject that q precedes (ahead) or follows."""
    found = []
    for s in ss:
        if s[1] != q[1]:
            continue
        qd, sd = ("+", "+") if ignore_strand else (q[4], s[4])
        if qd != "-" and sd != "-" and (s[2] > q[3] if ahead else s[3] < q[2]):
            found.append(((s[2] - q[3] if ahead else q[2] - s[3]) - 1, s[0]))
        if qd != "+" and sd != "+" and (s[3] < q[2] if ahead else s[2] > q[3]) and not ignore_strand:
            found.append(((q[2] - s[3] if ahead else s[2] - q[3]) - 1, s[0]))
    return min(found, default=(None, None))
