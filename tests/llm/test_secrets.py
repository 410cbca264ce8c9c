"""Secret scans against Python's regular expressions."""

import hashlib
import random
import re

from stratalens.llm import queries, secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
NAMES = ["assign", "access", "hex"]


def base(t):
    t = t or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if m.end() - m.start() >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if m.end() - m.start() >= 24])


def text_of(spans):
    return ",".join(f"{NAMES[k]}:{a}:{b}" for a, k, b in spans)


def scan(spark, rows):
    return {r.doc_id: r for r in secrets.scan(spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, base string")).collect()}


def spans(r):
    return [(secrets.KINDS[s.kind], s.start, s.end) for s in r.spans]


def test_random_texts(spark):
    rnd = random.Random(3)
    parts = ["password", "Token", "api_key", "apikey", "SECRET", '"', "'", " ", "  ", ":", "=", "abc", "abcdef123", "AKIA", "A" * 20, "AKIA" + "Z" * 16, "0123456789abcdef", "deadbeef01", "é", "😀", "\n", "ſ", "K", "-"]
    rows = [(i, "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25)))) for i in range(2000)]
    got = scan(spark, rows)
    for i, t in rows:
        assert [(s.start, s.kind, s.end) for s in got[i].base] == base(t), ascii(t)


def test_table(spark, smallest):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{smallest}/documents.parquet").collect()}
    got = queries.op9_secrets(spark, smallest).collect()
    assert len(got) == len(texts)
    for r in got:
        want = base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(text_of(want).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == i for _, k, _ in want) for i in range(3)]
        assert set(filter(None, text_of(want).split(","))) <= set(r.spans.split(","))


KEY, IDENT, STRONG = "wJalrXUtnFEMI/K7MDENG+bPxRfiCYEXAMPLEKEY", "ASIA" + "Q" * 16, "AKIA" + "Q" * 16


def test_parts_need_each_other(spark):
    rows = [
        (1, f"{KEY} alone"), (2, f"{STRONG} and {KEY}"), (3, f"{IDENT} with {KEY}"), (4, "https://db.example.com here"), (5, "see https://db.example.com with token=abcdef99"),
        (6, STRONG + " " * 500 + KEY), (7, f"{IDENT} https://h.example.com"), (8, f"{KEY} {KEY}"), (9, "x" * 199 + f" {STRONG} " + "y" * 100 + f" {KEY}"),
    ]
    got = {i: [k for k, _, _ in spans(r)] for i, r in scan(spark, rows).items()}
    assert got == {1: [], 2: ["access", "key"], 3: ["ident", "key"], 4: [], 5: ["endpoint", "assign"], 6: ["access"], 7: ["ident", "endpoint"], 8: [], 9: ["access", "key"]}


def test_cases(spark):
    rows = [(None, None), (1, ""), (2, "z" * 200_000 + " token=abcdefg " + "z" * 200_000), (2, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = secrets.scan(df).collect()
    assert sorted(len(r.spans) for r in got) == [0, 0, 0, 1]
    assert secrets.scan(df.limit(0)).count() == 0
    many = " ".join(f"{STRONG} {KEY}" for _ in range(500))
    assert len(scan(spark, [(1, many)])[1].spans) == 1000


def test_endpoints_support_other_parts(spark):
    rows = [(1, f"{KEY} https://h.example.com"), (2, f"{IDENT} at https://h.example.com"), (3, "https://a.example.com https://b.example.com"), (4, f"{IDENT} {IDENT}")]
    got = {i: [k for k, _, _ in spans(r)] for i, r in scan(spark, rows).items()}
    assert got == {1: ["key", "endpoint"], 2: ["ident", "endpoint"], 3: [], 4: []}


def test_configuration_blocks(spark):
    """Env files and INI sections: unquoted values, and parts far apart in one block but not across sections or prose."""
    filler = "".join(f"option_{i} = value {i}\n" for i in range(40))
    rows = [
        (1, f"aws_access_key_id={STRONG}\naws_secret_access_key={KEY}\n"),
        (2, f"[default]\naws_access_key_id = {STRONG}\n{filler}# c\naws_secret_access_key = {KEY}"),
        (3, f"id={STRONG}\n{filler}\n{filler}value={KEY}\n"),
        (4, f"export ID={IDENT}\n{filler}export URL=https://h.example.com\n"),
        (5, f"id: {STRONG} " + "prose " * 60 + f"{KEY}\n"),
        (6, f"a={KEY}\n{filler}b={KEY}\n"),
        (7, "é😀\n" + filler * 500 + f"ID={IDENT}\n" + filler * 500 + f"KEY={KEY}\n"),
    ]
    got = {i: [k for k, _, _ in spans(r)] for i, r in scan(spark, rows).items()}
    assert got == {1: ["access", "key"], 2: ["access", "key"], 3: ["access"], 4: ["ident", "endpoint"], 5: ["access"], 6: [], 7: ["ident", "key"]}


WEAK = {
    "key": r"(?<![A-Za-z0-9+/_.-])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/_=.-])",
    "ident": r"(?<![A-Z0-9])(?:ASIA|AROA|AIDA|AGPA|AIPA|ANPA)[A-Z0-9]{16}(?![A-Z0-9])",
    "endpoint": r"(?ia)\b(?:https?|ftp|amqps?|rediss?|mongodb(?:\+srv)?|postgres(?:ql)?|mysql)://[a-z0-9_.:@-]+",
}
SETTING = re.compile(r"""[ \t]*([#;].*|((export|set)[ \t]+|-[ \t]+)?["']?[A-Za-z_][A-Za-z0-9_.-]*["']?[ \t]*[:=](?:[ \t]*+\S++){0,8}+[ \t\r]*)""")


def linked(t, scope=200):
    """All pairs of parts: weak parts with one of another role close by or in the same run of settings."""
    parts = [(a, NAMES[k], b) for a, k, b in base(t)] + [(m.start(), k, m.end()) for k, p in WEAK.items() for m in re.finditer(p, t)]
    block, at = [], 0
    runs, inside = [], None
    for line in t.split("\n"):
        if SETTING.fullmatch(line):
            inside = at if inside is None else inside
        elif inside is not None:
            runs.append((inside, at))
            inside = None
        at += len(line) + 1
    if inside is not None:
        runs.append((inside, at))
    keep = [p for p in parts if p[1] in NAMES]
    for a, k, b in parts:
        if k in NAMES:
            continue
        for c, o, d in parts:
            if secrets.ROLE[o] == secrets.ROLE[k] or not (d <= a or c >= b):
                continue
            if c <= b + scope and d >= a - scope or any(x <= min(a, c) and max(b, d) <= y for x, y in runs):
                keep.append((a, k, b))
                break
    return sorted((a, secrets.KINDS.index(k), b) for a, k, b in keep)


def test_linked_spans_by_brute_force(spark):
    rnd = random.Random(8)
    parts = [STRONG, IDENT, KEY, "https://db.example.com:99", "token=abcdef99", "0123456789abcdef" * 2, "prose here ", "x" * 90 + " ", "é😀 " * 40, "name = value\n", "id=", "# c\n", "\n", "\n\n", " ", " ", "[section]\n"]
    rows = [(i, "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30)))) for i in range(1500)]
    got = scan(spark, rows)
    for i, t in rows:
        assert [(s.start, s.kind, s.end) for s in got[i].spans] == linked(t), ascii(t)


def test_many_matches_in_one_text(spark):
    """A megabyte of matches takes time in proportion, not by its square."""
    import time

    text = " ".join(f"{i:024x}" for i in range(40_000)) + " token=abcdef" * 40_000
    began = time.perf_counter()
    got = scan(spark, [(1, text)])[1]
    assert time.perf_counter() - began < 30
    assert [(s.start, s.kind, s.end) for s in got.base] == base(text)
