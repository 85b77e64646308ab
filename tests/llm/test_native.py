"""URL filters, chat formatting and sharding against plain versions in Python."""

from collections import Counter, defaultdict
from zlib import crc32

import numpy as np

from corpusloom.llm import chat, sharding, url_filters

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"), ("block", "a.b.example.net", "/en/x")]


def brute_verdict(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    for c in "?#":
        rest = rest.split(c, 1)[0]
    host, slash, path = rest.partition("/")
    host, path = "".join(c.lower() if c.isascii() else c for c in host), slash + path
    fits = [(len(h) + len(p), len(h), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[2] if fits else None, max(fits)[3] if fits else "allow"


def test_urls(spark):
    hosts = ["net", "x.net", "example.net", "EXAMPLE.net", "www.example.net", "a.b.example.net", "q.a.b.example.net", "example-x.net", "example.com", "z.example.com", "org", "a.org", "notorg", "", "net.", "example.net:80", "É.net"]
    paths = ["", "/", "/en/", "/en/x/y", "/de/1", "/fr/z?q=1", "/fr#/x", "?a/b", "#/de/"]
    urls = [f"http://{h}{p}" for h in hosts for p in paths] + [None, "", "no scheme/en/", "a://b://c/d", "http://" + "l." * 200 + "net/" + "p" * 5000] + ["https://m.example.net/en/1"] * 300
    df = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    rules = url_filters.rule_table(spark, RULES + [RULES[0], ("block", None, "/")])
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judge(df, rules).collect()}
    assert got == {i: brute_verdict(u) for i, u in enumerate(urls)}
    assert url_filters.judge(df.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filters.judge(df, rules.limit(0)).collect()} == {"allow"}


def brute_chats(rows):
    convs = defaultdict(set)
    for c, n, role, text, _ in rows:
        if c is not None:
            convs[c].add((n, role, text))
    order = {c: tuple((r, t) for _, r, t in sorted(x, key=lambda y: y[0])) for c, x in convs.items()}
    out = {}
    for c, turns in order.items():
        if any(len(o) > len(turns) and o[: len(turns)] == turns for o in order.values()):
            continue
        same = [o for o in order if order[o] == turns]
        if c == min(same):
            body = "".join(f"<|im_start|>{r or 'unknown'}\n{(t or '').replace('<|im_', '<| im_')}<|im_end|>\n" for r, t in turns)
            out[c] = (len(turns), len(same), body)
    return out


def test_chats(spark):
    rows = []
    base = [("user", "hi"), ("assistant", "hello <|im_end|>"), ("user", None), (None, ""), ("user", "long " * 5000)]
    for c in range(40):
        rows += [(c, i, *base[i], "x") for i in range(c % 5 + 1)]
    rows += [(100, 0, "user", "hi", "x"), (100, 1, "assistant", "other", "x"), (101, 0, "user", "", "x"), (102, 0, "user", None, "x"), (None, 0, "user", "lost", "x")]
    rows += rows[:50]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n_turns string")
    got = {r.conv_id: (r.n_turns, r.n_copies, r.rendered) for r in chat.format_chats(df).collect()}
    assert got == brute_chats(rows)
    assert chat.format_chats(df.limit(0)).count() == 0


def check_shards(rows, out, shards):
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in out) == Counter((d, len((t or "").encode()) + 16, crc32((t or "").encode())) for d, t in rows)
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    counts = [len(slots[s]) for s in range(shards)]
    assert max(counts) - min(counts) <= 1 and set(slots) <= set(range(shards))
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert {r.law for r in out} <= {"rows"} and {r.grown_shard for r in out} <= {None}


def test_shards(spark):
    rows = [(i, f"text {i}") for i in range(300)] + [(1000 + i, "hot") for i in range(250)] + [(2000 + i, f"pair {i // 2}") for i in range(160)]
    rows += [(None, "text 1"), (5, None), (6, None), (7, ""), (8, ""), (7, ""), (9, "é" * 20_000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, shard string")
    out = sharding.shard_documents(df, 7).collect()
    check_shards(rows, out, 7)
    where = defaultdict(Counter)
    for r in out:
        if r.linked > 1:
            where[r.text_crc32][r.shard] += 1
    hot = sorted(where[crc32(b"hot")].values())
    assert sum(hot[-3:]) >= 0.8 * 250  # no two shards can hold it
    cut = sum(len(where[crc32(f"pair {i}".encode())]) > 1 for i in range(80))
    assert cut <= 4
    check_shards([], sharding.shard_documents(df.limit(0), 7).collect(), 7)
    only = [(i, f"t{i // 3}") for i in range(90)]
    out = sharding.shard_documents(spark.createDataFrame(only, "doc_id long, text string"), 5).collect()
    check_shards(only, out, 5)


def test_allowed_moves():
    rng = np.random.default_rng(0)
    for _ in range(50):
        asked, spare = rng.integers(0, 50, (6, 6)), rng.integers(0, 20, 6)
        np.fill_diagonal(asked, 0)
        got = sharding.allowed_moves(asked, spare)
        assert (got >= 0).all() and (got <= asked).all() and (got.sum(0) - got.sum(1) <= spare).all()


def test_columns_with_the_operators_own_names(spark):
    from corpusloom.llm import language_id, mixing

    rows = [(i, f"some words here {i % 3}", "en", "s", f"http://a.net/{i}", 1, 2, 3, 4) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, url string, _key int, _hash int, _letters int, _tie int")
    given = sorted(tuple(r) for r in df.collect())
    back = lambda out: sorted(tuple(r) for r in out.select(*df.columns).distinct().collect())
    assert back(mixing.mix(df)) == given
    assert back(url_filters.judge(df, url_filters.rule_table(spark, RULES))) == given
    assert back(language_id.identify(df, language_id.learn(df.select("doc_id", "lang", "text")))) == given
