import random
import re

from corpusloom.llm import secrets

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def truth(t):
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 12]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return [(k, a, b) for a, _, k, b in sorted(out)]


def test_base_rules_against_regexes():
    rng = random.Random(1)
    parts = ["password", "Token", "secret", "api_key", "APIKEY", "passwd", "=", ":", " ", '"', "'", "AKIA", "A", "0123456789", "abcdef", "deadbeef01", "é", "xyz", ".", "\n", "Z9", "_", "="]
    machine = secrets.automaton(secrets.BASE)
    for _ in range(8000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert secrets.spans(t, machine) == truth(t)
        assert [s for s in secrets.spans(t) if s[0] in ("assign", "access", "hex")] == truth(t)


def test_operator(spark):
    key = "token = abcdefghijkl0"
    rows = [(1, f"é {key} x", "z"), (1, f"é {key} x", "z"), (2, None, None), (3, "", "q"), (4, "w " * 20_000 + "ghp_" + "A" * 36, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, secret_spans string")
    got = sorted((r.doc_id, [tuple(s) for s in r.secret_spans]) for r in secrets.find_secrets(df).collect())
    assert got == [(1, [("assign", 2, 23)])] * 2 + [(2, []), (3, []), (4, [("github", 40_000, 40_040)])]
    clean = {r.doc_id: r.text for r in secrets.redact(df).collect()}
    assert clean[1] == "é [SECRET] x" and clean[2] is None and clean[4].endswith("w [SECRET]")
    assert secrets.find_secrets(df.limit(0)).count() == 0
