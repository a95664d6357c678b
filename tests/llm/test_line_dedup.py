import hashlib
from collections import defaultdict

from sylvan.llm.line_dedup import line_dedup_digest

SP = " \t\n\x0b\x0c\r"


def brute(pairs):
    holds = defaultdict(set)
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(SP))
    for i, t in pairs:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40:
                holds[key(x)].add(i)
    out = []
    for i, t in pairs:
        lines = (t or "").split("\n")
        keep = [x for x in lines if len(holds[key(x)]) < 5 or i == max(j for j in holds[key(x)] if j is not None)]
        out.append((i, len(lines), len(lines) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    return sorted(out, key=repr)


A, B, SHORT = "Shared line that is long enough to be counted by the rule, é", "another shared line " * 3, "short shared line"


def test_against_brute_force(docs_of):
    pairs = [(i, f"{A}\nown {i}\n  {A.upper().replace('É', 'é')}\t\n{SHORT}\n") for i in range(6)]
    pairs += [(i, f"{B}\n{A}") for i in range(10, 14)] + [(14, None), (15, ""), (16, "\n\n"), (None, A), (13, f"{B}\n{A}"), (13, B + "\nx"), (20, (A + "\n") * 3000 + "end")]
    got = [tuple(r) for r in line_dedup_digest(docs_of(pairs)).collect()]
    assert sorted(got, key=repr) == brute(pairs)
    assert line_dedup_digest(docs_of([])).collect() == []


def test_line_in_a_third_of_documents(docs_of):
    pairs = [(i, f"{A if i % 3 == 0 else f'line {i} ' * 10}\nend {i}") for i in range(4000)]
    assert sorted((tuple(r) for r in line_dedup_digest(docs_of(pairs)).collect()), key=repr) == brute(pairs)
